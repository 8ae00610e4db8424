"""Shards along a Hilbert curve through several metadata dimensions (DataFrame functions only).

Each dimension is quantised to 2**bits cells of about equally many rows (values stay whole, so a frequent
one is a cell of its own); a row's cells are a point of a grid, and its number on the Hilbert curve through
the grid is the key rows are sorted by. Neighbours on the curve are neighbours in every dimension, so a run
of it spans a narrow box: a shard's smallest and largest values let a reader skip it by any dimension, not
by the first sort column only. The sorted rows are cut into runs, by one of two laws: `rows`, counts at most
one apart, or `bytes`, sizes that miss an equal share by half a row at each cut.

The sort is Spark's range partitioning; a row's place is its place in its range plus the rows of lower
ranges, so no task holds a shard. Ranges are cut on the curve, then the text's checksum and the id, so
that a frequent cell, and copies of one text, are spread; equal texts of equal metadata are neighbours.

Null text counts no bytes and has checksum 0; nulls of a dimension are its lowest value; rows without an id
come first among equals; repeated rows are placed one after the other. Columns that are named like an
output are replaced, others pass. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayscope.llm.common import Scratch, fresh, small
from assayscope.operators.ordering import positions, running

SHARDS = 8
BITS = 6
LAWS = ("rows", "bytes")


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(digits, next states) by state * 2**dims + the point's bit of each dimension, of the Hilbert curve
    in `dims` dimensions. A state is an entry corner and a direction; a step turns the cell's corner into
    its place along the curve (Gray code, rotated), and gives the state inside that cell."""
    size, mask = 1 << dims, (1 << dims) - 1
    turn = lambda x, by: (x << by % dims | x >> (dims - by % dims)) & mask if by % dims else x
    gray = lambda i: i ^ i >> 1
    place = {gray(i): i for i in range(size)}
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  trailing set bits
    entry = lambda i: 0 if i == 0 else gray((i - 1) // 2 * 2)
    along = lambda i: 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % dims
    digits, after = [], []
    for corner in range(size):
        for direction in range(dims):
            for point in range(size):
                i = place[turn(point ^ corner, dims - (direction + 1) % dims)]
                digits.append(i)
                after.append((corner ^ turn(entry(i), direction + 1)) * dims + (direction + along(i) + 1) % dims)
    return digits, after


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The number on the curve of the point with these cells (0 to 2**bits - 1 each)."""
    dims = len(cells)
    states = dims << dims
    tables = [F.array(*[F.lit(x).cast("long") for x in t]) for t in curve_tables(dims)]

    def step(acc: Column, level: Column) -> Column:
        state = acc % states
        corner = F.lit(0).cast("long")
        for c in cells:
            corner = corner * 2 + F.floor(c / F.pow(F.lit(2.0), level)).cast("long") % 2
        at = (state * (1 << dims) + corner + 1).cast("int")
        return (F.floor(acc / states).cast("long") * (1 << dims) + F.element_at(tables[0], at)) * states + F.element_at(tables[1], at)

    levels = F.array(*[F.lit(b) for b in reversed(range(bits))])
    return F.floor(F.aggregate(levels, F.lit(0).cast("long"), step) / states).cast("long")


def cells_of(values: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """name, cell: each different value's cell, by the share of rows with smaller values."""
    folded = values.groupBy(name).agg(F.count("*").alias("__n"))
    r = running(folded, [], [F.col(name).asc_nulls_first()], "__n", "__low", "__all")
    return r.select(name, F.floor(F.col("__low") * (1 << bits) / F.col("__all")).cast("long").alias("__cell"))


def size_class(size: Column) -> Column:
    """Sixteen classes for each doubling of a whole number from 1 on, so a few hundred values in all."""
    length = F.length(F.bin(size))
    high = F.rpad(F.substring(F.bin(size), 1, 5), 5, "0")
    return (length * 16 + F.conv(high, 2, 10).cast("int") - 16).cast("int")


def measured(docs: DataFrame, bits: int = BITS, thin: bool = False) -> tuple[DataFrame, list[str]]:
    """docs (thin: its doc_id) with size, text_crc32 and the curve number under fresh names, and these names.
    Thin rows are written once; else the dimensions are, and docs is read again."""
    size, crc, curve, a, b, c = fresh(docs.columns, "size", "crc", "curve", "a", "b", "c")
    d = docs.withColumns({size: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, crc: F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    d = d.withColumns({a: size_class(F.col(size)), b: F.col("lang"), c: F.col("source")})
    scratch = Scratch(docs.sparkSession, "hilbert")
    d = scratch.save(d.select("doc_id", size, crc, a, b, c), "rows") if thin else d
    keys = d if thin else scratch.save(d.select(a, b, c), "dimensions")
    cells = fresh(d.columns, "cell_a", "cell_b", "cell_c")
    for x, cell in zip((a, b, c), cells):
        # a row per different value; docs that change between readings may have one that is not there
        t = small(scratch, cells_of(keys.select(x), x, bits).select(F.col(x).alias("__v"), F.col("__cell").alias(cell)), "cells")
        d = d.join(t, d[x].eqNullSafe(t["__v"]), "left").drop("__v").withColumn(cell, F.coalesce(cell, F.lit(0)))
    return d.withColumn(curve, hilbert_index([F.col(x) for x in cells], bits)).drop(a, b, c, *cells), [size, crc, curve]


OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """The rows of docs(doc_id, text, lang, source, ...) with size, text_crc32, law, shard, slot and
    grown_shard; a text that isn't among docs' other columns is only measured. The order within a shard is
    that of the slots."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    d, (size, crc, curve) = measured(docs, bits)
    return _cut(d, docs.columns, size, crc, curve, shards, law)


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """doc_id and the outputs of shard(), without moving texts."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    d, (size, crc, curve) = measured(docs.select("doc_id", "text", "lang", "source"), bits, thin=True)
    return _cut(d, ["doc_id"], size, crc, curve, shards, law)


def _cut(d: DataFrame, columns: list[str], size: str, crc: str, curve: str, shards: int, law: str) -> DataFrame:
    own = [c for c in columns if c.lower() not in OUTPUTS]
    # the row's own columns travel as one, so that no name of theirs meets one of ours; repeated rows are told
    # apart by where they are read
    d = d.select(F.struct(*own).alias("row"), F.col("doc_id").alias("id"), F.col(size).alias("size"), F.col(crc).alias("crc"), F.col(curve).alias("curve"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("curve"), F.col("crc"), F.col("id").asc_nulls_first(), F.col("size"), F.col("tie")]
    if law == "rows":
        d = positions(d, [], order, "pos", "n")
        d = d.withColumn("shard", F.floor(F.col("pos") * shards / F.col("n")).cast("int"))
        d = d.withColumn("slot", (F.col("pos") - F.floor((F.col("shard") * F.col("n") + (shards - 1)) / shards)).cast("long"))
    else:
        d = positions(running(d, [], order, "size", "low", "total"), [], ["low"], "pos")
        middle = (F.col("low") + F.col("size") / F.lit(2.0)) * shards / F.col("total")
        d = d.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
        first = d.groupBy("shard").agg(F.min("pos").alias("start"))  # a row per shard
        d = d.join(F.broadcast(first), "shard").withColumn("slot", F.col("pos") - F.col("start"))
    out = [F.col("size"), F.col("crc"), F.lit(law), F.col("shard"), F.col("slot"), F.lit(None).cast("int")]
    return d.select(*[F.col("row").getField(c).alias(c) for c in own], *[o.alias(n) for o, n in zip(out, OUTPUTS)])


def write_shards(sharded: DataFrame, path: str, parts: int | None = None) -> None:
    """shard()'s rows as Parquet files below shard=..., each sorted by slot; a large shard is several files
    of adjoining slots."""
    order = ["shard", "slot"]
    sharded.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)


def manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """shard, rows, bytes, and the smallest and largest value of each column, by which readers skip shards."""
    spans = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *spans)


_DIGITS, _AFTER = curve_tables(3)
_STATES = 24
ORACLE = f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), i)) AS tab),
d AS (SELECT doc_id, lang, source, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM documents, tab),
v AS (SELECT *, length(bin(size)) * 16 + CAST(('0b' || rpad(substr(bin(size), 1, 5), 5, '0')) AS INT) - 16 AS cls FROM d),
a AS (SELECT cls, CAST(floor((sum(count(*)) OVER (ORDER BY cls) - count(*)) * {1 << BITS} / sum(count(*)) OVER ()) AS BIGINT) AS ca FROM v GROUP BY cls),
b AS (SELECT lang, CAST(floor((sum(count(*)) OVER (ORDER BY lang NULLS FIRST) - count(*)) * {1 << BITS} / sum(count(*)) OVER ()) AS BIGINT) AS cb FROM v GROUP BY lang),
c AS (SELECT source, CAST(floor((sum(count(*)) OVER (ORDER BY source NULLS FIRST) - count(*)) * {1 << BITS} / sum(count(*)) OVER ()) AS BIGINT) AS cc FROM v GROUP BY source),
p AS (SELECT v.*, ca, cb, cc FROM v JOIN a USING (cls) JOIN b ON v.lang IS NOT DISTINCT FROM b.lang JOIN c ON v.source IS NOT DISTINCT FROM c.source),
h AS (SELECT *, list_reduce({list(reversed(range(BITS)))}::BIGINT[], lambda acc, x: (acc // {_STATES} * 8 + {_DIGITS}[(acc % {_STATES}) * 8 + ((ca >> x) & 1) * 4 + ((cb >> x) & 1) * 2 + ((cc >> x) & 1) + 1]) * {_STATES}
    + {_AFTER}[(acc % {_STATES}) * 8 + ((ca >> x) & 1) * 4 + ((cb >> x) & 1) * 2 + ((cc >> x) & 1) + 1], 0::BIGINT) // {_STATES} AS curve FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST, size) - 1 AS pos, count(*) OVER () AS n FROM h)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * {SHARDS} // n AS INT) AS shard, CAST(pos - (pos * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM o
"""
