"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target of words: the weighted share of all words, stopped at `most` times what the
source has, the excess shared out again by weight.

Within a source documents are not taken alike: one of s words, where the source's mean is m, has a weight
that grows with s / (s + m), in LEVELS steps, so that very short documents, which hold little context, are
taken less often. Its expected number of copies is x = min(most, c * weight), with the c at which the
expected words meet the target. floor(x) whole copies are certain, and p = x - floor(x) is the document's
inclusion probability in the sample that fills the rest: documents are ranked by
Q = (u / (1 - u)) / (p / (1 - p)), u being a fixed pseudo-random number of the document, and taken in that
order while that brings the sum of words nearer to what the target still lacks. So the sample's size in
words is fixed, up to half a document.

The order is cut without sorting a source: words are summed in BINS bins of Q first, and only the bin
that holds the cut is ranked. Sizes and numbers are written once; texts are never shuffled, but for those
of the bins that hold a cut.

Null text counts 0 words; null sources are one source, ordered last; null ids take part like others.
Rows that agree in id, source and text are ranked next to each other. A source without words has target 0.
Further columns pass, but for those named like an output, which is put in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayscope.llm.common import Scratch, small

WEIGHTS = (1, 2, 3)
BINS = 4096
LEVELS = 64
OUTPUTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def word_count(text):
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(parts: DataFrame, by: list[str], order: list, size: str, weight: str, total: str, most: int) -> DataFrame:
    """parts with `given`: of the group's `total`, the share by weight, stopped at most * size, the excess
    shared again. Parts stop in the order of most * size / weight: the first ones are stopped, and the rest
    share what is left."""
    every = Window.partitionBy(*by)
    before = every.orderBy(F.col(size) / F.col(weight), *order).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col(size) * F.lit(most)
    p = parts.withColumns({
        "fill_cap": cap,
        "fill_all": F.sum(weight).over(every),
        "fill_words": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "fill_weight": F.coalesce(F.sum(weight).over(before), F.lit(0).cast("long")),
    })
    # words for each unit of weight, if exactly the parts before this one are stopped
    p = p.withColumn("fill_level", (F.col(total) - F.col("fill_words")).cast("double") / (F.col("fill_all") - F.col("fill_weight")))
    free = F.col("fill_level") * F.col(weight) <= F.col("fill_cap")
    p = p.withColumn("fill_rate", F.min(F.when(free, F.struct("fill_weight", "fill_level"))).over(every)["fill_level"])
    share = F.col("fill_rate") * F.col(weight)
    given = F.when(F.col("fill_rate").isNull() | (share > F.col("fill_cap")), F.col("fill_cap").cast("double")).otherwise(share)
    return p.withColumn("given", given).drop("fill_cap", "fill_all", "fill_words", "fill_weight", "fill_level", "fill_rate")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, docs, target of sizes(source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = [F.col("source").isNull(), F.col("source")]
    turn = (F.row_number().over(Window.orderBy(*order)) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn.cast("int")))
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    return fill(per, [], order, "source_size", "weight", "total", most).select("source", "source_size", "docs", F.col("given").alias("target"))


def level(size: Column, source_size: Column, docs: Column) -> Column:
    """The step, from 1 to LEVELS, of s / (s + m)."""
    s = size * docs
    return F.greatest(F.coalesce(F.ceil(F.try_divide(s * F.lit(LEVELS), s + source_size)), F.lit(1)), F.lit(1)).cast("long")


def uniform(key):
    """A number in (0, 1) fixed by the key, the same in every SQL engine: 48 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def _drawn(docs: DataFrame) -> DataFrame:
    """docs as `row`, with source, id, size and u."""
    key = F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("size"), uniform(key).alias("u")
    )


def pareto_mix(docs: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) with mix_size, mix_source_size, mix_target, mix_copies and
    mix_taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    d = _drawn(docs)
    sizes = scratch.save(d.select("source", "size", "u"), "sizes")
    # tables of a row per source, or per source and level; documents stay where they are, so a source with a
    # third of them is no hot spot
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "of")
    targets = small(scratch, targets, "targets")

    def with_level(x: DataFrame) -> DataFrame:
        x = x.join(targets, x["source"].eqNullSafe(targets["of"])).drop("of")
        return x.withColumn("level", level(F.col("size"), F.col("source_size"), F.col("docs")))

    parts = with_level(sizes).groupBy("source", "level").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    parts = parts.withColumn("weight", F.col("level") * F.col("words"))
    parts = fill(parts.where("words > 0"), ["source"], [F.col("level").desc()], "words", "weight", "target", most)
    rate = F.col("given") / F.col("words")
    parts = parts.withColumns({"whole": F.floor(rate).cast("long"), "p": rate - F.floor(rate)})
    parts = parts.withColumn("lack", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source")))
    parts = small(scratch, parts.select(F.col("source").alias("of"), F.col("level").alias("at"), "whole", "p", "lack"), "levels")

    def placed(x: DataFrame) -> DataFrame:
        x = with_level(x)
        x = x.join(parts, x["source"].eqNullSafe(parts["of"]) & (x["level"] == parts["at"]), "left").drop("of", "at")
        odds = F.col("u") / (F.lit(1.0) - F.col("u"))
        x = x.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (F.col("p") / (F.lit(1.0) - F.col("p")))))
        return x.withColumn("bin", F.floor(F.col("q") / (F.col("q") + 1) * BINS).cast("int"))

    in_bins = placed(sizes).where("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("lack").alias("lack"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = in_bins.withColumn("before", before).where("before <= lack and before + words > lack")
    cut = small(scratch, cut.select(F.col("source").alias("of"), F.col("bin").alias("cut"), "before"), "cuts")

    x = placed(d)
    x = x.join(cut, x["source"].eqNullSafe(cut["of"]), "left").drop("of")
    on = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    ranked = Window.partitionBy("source").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(ranked)
    at_cut = x.where(on).withColumn("extra", F.when(upto - F.col("size") / F.lit(2.0) <= F.col("lack"), 1).otherwise(0))
    rest = x.where(~on).withColumn("extra", F.when(F.col("q").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), 1).otherwise(0))
    # a document without words is in no part
    copies = F.coalesce("whole", F.lit(0).cast("long")) + F.col("extra")
    outputs = [F.col("size"), F.col("source_size"), F.col("target"), copies, F.col("size") * copies]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in OUTPUTS]
    return at_cut.unionByName(rest).select(*own, *[o.alias(n) for o, n in zip(outputs, OUTPUTS)])


ORACLE = """
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM per),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(3 * source_size) OVER b, 0) AS capped_words, coalesce(sum(weight) OVER b, 0) AS capped_weight
    FROM w WINDOW b AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - capped_words AS DOUBLE) / CAST(all_weight - capped_weight AS DOUBLE) AS level FROM c),
r AS (SELECT arg_min(level, capped_weight) AS rate FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, docs, CASE WHEN rate IS NULL OR rate * weight > cap THEN CAST(cap AS DOUBLE) ELSE rate * weight END AS target
    FROM l CROSS JOIN r),
j AS (SELECT d.*, t.source_size, t.target, greatest(1, coalesce(CAST(ceil(CAST(size * docs * 64 AS DOUBLE) / nullif(CAST(size * docs + t.source_size AS DOUBLE), 0)) AS BIGINT), 1)) AS lev
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p0 AS (SELECT source, lev, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target FROM j GROUP BY source, lev HAVING sum(size) > 0),
p1 AS (SELECT *, lev * words AS pw, 3 * words AS pcap FROM p0),
p2 AS (SELECT *, sum(pw) OVER (PARTITION BY source) AS all_weight, coalesce(sum(pcap) OVER b, 0) AS capped_words, coalesce(sum(pw) OVER b, 0) AS capped_weight
    FROM p1 WINDOW b AS (PARTITION BY source ORDER BY words / pw, lev DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p3 AS (SELECT *, (target - CAST(capped_words AS DOUBLE)) / CAST(all_weight - capped_weight AS DOUBLE) AS plevel FROM p2),
p4 AS (SELECT source, arg_min(plevel, capped_weight) FILTER (plevel * pw <= pcap) AS prate FROM p3 GROUP BY source),
p5 AS (SELECT p3.*, CASE WHEN prate IS NULL OR prate * pw > pcap THEN CAST(pcap AS DOUBLE) ELSE prate * pw END / words AS rate FROM p3 JOIN p4 ON p3.source IS NOT DISTINCT FROM p4.source),
p6 AS (SELECT source, lev, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS p, target - CAST(sum(CAST(floor(rate) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS lack FROM p5),
u AS (SELECT j.*, coalesce(whole, 0) AS whole, p, lack,
    (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
    FROM j LEFT JOIN p6 ON j.source IS NOT DISTINCT FROM p6.source AND j.lev = p6.lev),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS q FROM u),
s AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target,
    CAST(size * (whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0 <= lack THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM s
"""
