"""URL filter: blocked Bloom filter of listed canonical URLs, then an exact hash join (DataFrame
functions only).

A listed URL is a rule `host/path`: it fits its host and all subdomains if the url's path starts with
the rule's path; of the rules that fit, the longest wins. A url can only be fitted by the keys
(host suffix, path cut to the length of some rule's path), so each distinct (host, path) gives these few
keys. The Bloom filter has one 64-bit block per key hash, four bits a key, built by a bit_or aggregation;
keys whose bits are all set are possible hits, and the hash join with the list removes false positives.

Null urls, and urls without `://`, have empty host and path: no rule fits them. Repeated rows are judged
alike; an empty table gives an empty table; an empty list allows all. Further columns pass, but for those
named like an output, which is put in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Verdict where no listed URL fits.
DEFAULT = "allow"
OUTPUTS = ("host", "path", "rule", "verdict")
KEYS_PER_BLOCK = 4
#: Blocks up to this number are broadcast (16 bytes each); beyond it the filter is joined by shuffle.
BROADCAST_BLOCKS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block, mask of keys(key)."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("key"))).alias("mask"))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """The rows of pages(page_id, url, ...) with host, path, rule and verdict. rules: host, path, verdict."""
    spark = pages.sparkSession
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if rules is None else rules
    # a host's endings of more labels than any rule's host fit none
    listed = rules.select("host", F.concat("host", "path").alias("rule"), F.concat_ws("\n", "host", "path").alias("key"), F.length("path").alias("cut"), F.col("verdict").alias("rule_verdict"))
    counted = listed.agg(F.count("*").alias("n"), F.collect_set("cut").alias("cuts"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    blocks = max(1, counted["n"] // KEYS_PER_BLOCK + 1)
    cuts = F.array(*[F.lit(c) for c in sorted(counted["cuts"])]).cast("array<int>")

    own = [F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in OUTPUTS]
    judged = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - F.lit((counted["labels"] or 1) - 1), F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(cuts, lambda c: c <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda c: F.concat_ws("\n", s, F.substr(F.col("path"), F.lit(1), c)))))
    # the filter meets the keys in the scan's stage: only possible hits go on
    keys = judged.where("host <> ''").select("host", "path", F.explode(keys).alias("key"))
    filter_ = bloom(listed, blocks)
    filter_ = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    possible = keys.withColumn("block", _block(F.col("key"), blocks)).join(filter_, "block")
    possible = possible.where(_bits(F.col("key")).bitwiseAND(F.col("mask")) == _bits(F.col("key")))
    exact = possible.join(listed.drop("host"), "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    best = best.select("host", "path", "best.rule", "best.rule_verdict")
    # urls without a host would all meet in one task
    out = judged.where("host <> ''").join(best, ["host", "path"], "left")
    hostless = judged.where("host = ''").select("host", "path", "row", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
    out = out.unionByName(hostless)
    return out.select(*own, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS rn FROM pages),
m AS (SELECT rn, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM p JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rn)
"""
