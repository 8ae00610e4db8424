"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A window of an item's length is a leak of the item if the weighted Jaccard similarity of their 5-word
shingles, each weighing as often as it occurs, is at least 0.8. Words are runs of letters and digits,
lower-cased, so that case and punctuation don't hide a leak; a text of fewer than five words is one shingle.

1. a window that shares no shingle with any item can't reach 0.8, so windows are laid where a document
   shingle is an item shingle, aligned to the shingle's place in that item. Documents stay where they
   are: shingles are exploded and looked up inside the scan's stage;
2. equal windows are folded into one, whatever the number of documents that hold them;
3. each distinct window and item gets a 64-bit SimHash of its words, cut into BLOCKS blocks of 16 bits. Two
   fingerprints within RADIUS differ in RADIUS // BLOCKS bits at most in some block. The items, the small side,
   list every value that near in each block, so an equi-join on (length, block number, block value) yields
   all pairs within the radius and few others, which bit_count(xor) drops. Which item a window was laid for
   is not carried along: the fingerprints alone find the item;
4. candidates are verified on their full weighted shingles, and leaks are joined back to the documents.

Null or blank texts leak nothing; blank items match nothing; null ids are judged like others; items of
equal words are all reported; rows that share an id are reported once per place. Further columns, whatever
their names, pass unread.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayscope.llm.common import Scratch, fresh

SHINGLE = 5
PERCENT = 80
RADIUS = 15
BLOCKS = 4
#: Item shingles up to this number are broadcast (24 bytes each); beyond it the lookup is a shuffle join.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    # split, not regexp_extract_all: that copies the text for every match
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingle_hashes(w: Column, k: int) -> Column:
    """Hash of the k words at each place; null where fewer are left."""
    def at(x, i):
        rest = [F.get(w, i + j) for j in range(1, k)]
        return F.when(i + k <= F.size(w), F.xxhash64(x, *rest))

    return F.transform(w, at)


def shingle_texts(w: Column, k: int) -> Column:
    """The shingles as strings; the whole sequence if it is shorter than k words."""
    whole = F.array(F.array_join(w, " "))
    places = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
    return F.when(F.size(w) < k, whole).otherwise(F.transform(places, lambda i: F.array_join(F.slice(w, i, k), " ")))


def simhash(w: Column) -> Column:
    """64-bit SimHash of the words, each weighing as often as it occurs."""
    h = F.transform(w, lambda x: F.xxhash64(x))
    ones = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(h, F.lit(0), lambda acc, x: acc + F.getbit(x, b).cast("int")),
    )
    half = F.size(w) / F.lit(2.0)
    powers = F.transform(ones, lambda n, i: F.when(n > half, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(powers, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def blocks(fingerprint: Column) -> Column:
    """BLOCKS (number, value) structs that together hold all 64 bits."""
    bits = 64 // BLOCKS
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fingerprint, i * bits).bitwiseAND(mask).alias("value")) for i in range(BLOCKS)])


def near_blocks(fingerprint: Column, radius: int) -> Column:
    """Every (number, value) that a block of a fingerprint within `radius` may have where it differs least:
    in radius // BLOCKS bits or fewer."""
    bits, most = 64 // BLOCKS, radius // BLOCKS
    flips = [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]
    flips = F.array(*[F.lit(f).cast("long") for f in flips])
    return F.flatten(F.transform(blocks(fingerprint), lambda x: F.transform(flips, lambda f: F.struct(x["no"].alias("no"), x["value"].bitwiseXOR(f).alias("value")))))


def _items(benchmark: DataFrame, k: int) -> DataFrame:
    """One row per distinct word sequence: item (its hash), w, length, shingle size, item_ids."""
    b = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    b = b.groupBy("w").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    return b.select(
        F.xxhash64("w", F.size("w")).alias("item"), "w", F.size("w").alias("length"), F.least(F.size("w"), F.lit(k)).alias("k"), "item_ids"
    )


def _once(column: str, use) -> Column:
    """use(column), with the column's expression evaluated once a row and not again for each element that use
    goes through."""
    return F.get(F.transform(F.array(column), use), 0)


def _with_words(docs: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, text_hash, at (the structs of fields that a written table has for the text) and w, its words."""
    per = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*fields)).alias("at"))
    per = per.withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    per = F.broadcast(per) if found.count() <= BROADCAST_ROWS else per
    held = docs.select("doc_id", "text").join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash")))
    return held.select("doc_id", F.col("hit_hash").alias("text_hash"), "at", words(F.col("text")).alias("w"))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, item_id, start, length, similarity: each place of docs(doc_id, text) that
    leaks an item of benchmark(item_id, text)."""
    items = _items(benchmark, k)
    # get() past the end is null, which xxhash64 skips: a shorter shingle hashes its own words
    places = items.select(
        "k", "length",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("length") - F.col("k")), lambda i: F.xxhash64(*[F.when(F.lit(j) < F.col("k"), F.get(F.col("w"), i + j)) for j in range(k)]))).alias("offset", "h"),
    ).distinct()
    seen = places.agg(F.count("*").alias("n"), F.collect_set("k").alias("ks")).first()
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    hits = []
    for size in sorted(seen["ks"]) or [k]:
        # the words themselves aren't carried through the explode, which would copy them for every word
        s = d.select("doc_id", "text_hash", F.size("w").alias("n"), shingle_hashes(F.col("w"), size).alias("hashes"))
        s = s.select("doc_id", "text_hash", "n", F.posexplode_outer("hashes").alias("pos", "h"))
        at = places.where(F.col("k") == size)
        s = s.join(F.broadcast(at) if seen["n"] <= BROADCAST_ROWS else at, "h")
        start = F.greatest(F.least(F.col("pos") - F.col("offset"), F.col("n") - F.col("length")), F.lit(0))
        hits.append(s.select("doc_id", "text_hash", start.alias("start"), "length"))
    found = scratch.save(reduce(DataFrame.unionByName, hits).distinct(), "hits")
    # only texts with a hit are cut into words again; windows are told apart by their hash, and one of each
    # kind brings its words
    places_ = _with_words(docs, found, ["start", "length"])
    cut = lambda w: F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), F.xxhash64(F.slice(w, x["start"] + 1, x["length"]), x["length"]).alias("window")))
    held = places_.select("doc_id", "text_hash", _once("w", cut).alias("cut")).select("doc_id", "text_hash", F.inline("cut"))
    held = scratch.save(held.dropDuplicates(["doc_id", "text_hash", "start", "length"]), "windows")

    one = held.groupBy("window", "length").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("r"))
    one = scratch.save(one.select("r.doc_id", "r.text_hash", "r.start", "length", "window"), "examples")
    sliced = lambda w: F.transform("at", lambda x: F.struct(x["window"].alias("window"), x["length"].alias("length"), F.slice(w, x["start"] + 1, x["length"]).alias("w")))
    distinct = _with_words(docs, one, ["start", "length", "window"]).select(_once("w", sliced).alias("cut")).select(F.inline("cut"))
    distinct = scratch.save(distinct.dropDuplicates(["window", "length"]), "distinct")
    prints = distinct.withColumn("print", simhash(F.col("w")))
    item_prints = items.withColumn("print", simhash(F.col("w")))
    left = prints.select("window", "length", "print", F.explode(blocks(F.col("print"))).alias("block"))
    right = item_prints.select("item", "length", F.col("print").alias("item_print"), F.explode(near_blocks(F.col("print"), radius)).alias("block"))
    pairs = left.join(right, ["length", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs = scratch.save(pairs.select("window", "item", "length").distinct(), "pairs")

    a = distinct.select("window", F.explode(shingle_texts(F.col("w"), k)).alias("s")).groupBy("window", "s").agg(F.count("*").alias("ca"))
    b = items.select("item", F.explode(shingle_texts(F.col("w"), k)).alias("s")).groupBy("item", "s").agg(F.count("*").alias("cb"))
    common = pairs.join(a, "window").join(b, ["item", "s"]).groupBy("window", "item", "length").agg(F.sum(F.least("ca", "cb")).alias("common"))
    # a window may be shorter than the item only where the document is
    sizes = distinct.select("window", F.greatest(F.size("w") - k + 1, F.lit(1)).alias("na"))
    item_sizes = items.select("item", "item_ids", F.greatest(F.size("w") - k + 1, F.lit(1)).alias("nb"))
    good = common.join(sizes, "window").join(item_sizes, "item").withColumn("either", F.col("na") + F.col("nb") - F.col("common"))
    good = good.where(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("either"))
    good = good.select("window", "length", F.explode("item_ids").alias("item_id"), (F.col("common") / F.col("either")).alias("similarity"))
    return held.select("doc_id", "text_hash", "start", "length", "window").join(good, ["window", "length"]).select(
        "doc_id", "text_hash", "item_id", "start", "length", "similarity"
    )


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with all their columns."""
    id_, hash_ = fresh(docs.columns, "id", "hash")
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[id_]) & (F.xxhash64(docs["text"]) == bad[hash_]), "left_anti")
