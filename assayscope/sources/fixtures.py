"""Views of the given tables in the shapes that the operators work on, in Spark and in SQL.

An order is a variant of its customer's segment (or nation); its distinct part sizes are its mutations.
Equal variants are merged: exact decimal sums, one division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_order

METHODS = ["m_disc", "m_qty", "m_retail", "m_tax"]
BASE_COLUMNS = ["assay", "mutant", "dms_score", "dms_score_bin"]
_SOURCES = {"dms_score": "l_extendedprice", "m_qty": "l_quantity", "m_disc": "l_discount", "m_tax": "l_tax", "m_retail": "p_retailprice"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _variants(spark: SparkSession, sf_dir: str, assay: Column) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(orders.select("o_orderkey", assay.alias("assay")), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = [F.sum(F.col(c).cast("decimal(18,2)")).alias(m) for m, c in _SOURCES.items()]
    token = F.concat(F.lit("A"), F.col("p_size").cast("string"), F.lit("V"))
    per = lines.groupBy("assay", "o_orderkey").agg(F.array_join(F.array_sort(F.collect_set(token)), ":").alias("mutant"), F.count("*").alias("lines"), *sums)
    merged = per.groupBy("assay", "mutant").agg(*[(F.sum(m).cast("double") / F.sum("lines")).alias(m) for m in _SOURCES])
    mean = F.avg("dms_score").over(Window.partitionBy("assay"))
    return merged.withColumn("dms_score_bin", (F.col("dms_score") > mean).cast("int"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assay, mutant, dms_score, m_qty, m_disc, m_tax, m_retail, dms_score_bin; five assays."""
    return _variants(spark, sf_dir, F.col("c_mktsegment"))


def variants25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a nation as assay."""
    return _variants(spark, sf_dir, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))


def assay_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assay, assay_type of variants25."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("assay"), F.col("r_name").alias("assay_type"))


def scores_long(v: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """assay, mutant, dms_score, method, score, ord; scores that aren't finite are left out."""
    keep = ["assay", "mutant", "dms_score", "dms_score_bin"]
    long = v.select(*keep, *methods).unpivot(keep, methods, "method", "score")
    return long.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).withColumn("ord", mutation_order(F.col("mutant")))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policy, seed, round (0 to 5), n_observed, best, hit."""
    e = table(spark, sf_dir, "events").where("event_type is not null and user_id is not null and value is not null")
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    e = e.withColumn("round", F.row_number().over(w) - 1).where("round <= 5")
    e = e.select(F.col("event_type").alias("policy"), F.col("user_id").alias("seed"), "round", "value")
    top = Window.partitionBy("policy").orderBy(F.col("value").desc(), "seed", "round")
    n = F.count("*").over(Window.partitionBy("policy"))
    e = e.withColumns({"top": F.row_number().over(top) <= F.greatest(F.lit(1), F.ceil(n * F.lit(0.01)))})
    run = Window.partitionBy("policy", "seed").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("policy", "seed", "round", (20 + 10 * F.col("round")).alias("n_observed"), F.max("value").over(run).alias("best"), F.max(F.col("top").cast("int")).over(run).alias("hit"), "value")


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure, residue, x, y, z."""
    e = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    at = lambda i: F.get("embedding", i).cast("double") * 60
    return e.select(F.col("label").alias("structure"), r.alias("residue"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein, sequence."""
    return table(spark, sf_dir, "documents").where("lang is not null and text is not null").select(F.col("lang").alias("protein"), F.col("text").alias("sequence"))


# -- the same in SQL ------------------------------------------------------------------------------


def _sql(assay: str) -> str:
    sums = ", ".join(f"sum(CAST({c} AS DECIMAL(18,2))) AS {m}" for m, c in _SOURCES.items())
    means = ", ".join(f"CAST(sum({m}) AS DOUBLE) / sum(lines) AS {m}" for m in _SOURCES)
    return f"""per_order AS (SELECT {assay} AS assay, o_orderkey, string_agg(DISTINCT 'A' || p_size || 'V', ':' ORDER BY 'A' || p_size || 'V') AS mutant,
    count(*) AS lines, {sums} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
merged AS (SELECT assay, mutant, {means} FROM per_order GROUP BY assay, mutant),
variants AS (SELECT *, CAST(dms_score > avg(dms_score) OVER (PARTITION BY assay) AS INT) AS dms_score_bin, len(string_split(mutant, ':')) AS ord,
    string_split(mutant, ':') AS parts FROM merged)"""


VARIANTS = _sql("c_mktsegment")
VARIANTS25 = _sql("'NATION_' || c_nationkey")
TYPES = "types AS (SELECT 'NATION_' || n_nationkey AS assay, r_name AS assay_type FROM nation JOIN region ON n_regionkey = r_regionkey)"
LONG = "long AS (SELECT assay, mutant, dms_score, dms_score_bin, ord, method, score FROM variants UNPIVOT (score FOR method IN (m_disc, m_qty, m_retail, m_tax)))"
TRAJECTORIES = """e0 AS (SELECT event_type AS policy, user_id AS seed, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS round
    FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL),
e1 AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY value DESC, seed, round) <= greatest(1, ceil(count(*) OVER (PARTITION BY policy) * 0.01::DOUBLE)) AS top FROM e0 WHERE round <= 5),
traj AS (SELECT policy, seed, round, 20 + 10 * round AS n_observed, max(value) OVER w AS best, max(CAST(top AS INT)) OVER w AS hit, value FROM e1
    WINDOW w AS (PARTITION BY policy, seed ORDER BY round ROWS UNBOUNDED PRECEDING))"""
COORDS = """coords AS (SELECT label AS structure, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS residue,
    CAST(embedding[1] AS DOUBLE) * 60 AS x, CAST(embedding[2] AS DOUBLE) * 60 AS y, CAST(embedding[3] AS DOUBLE) * 60 AS z
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"""
ALIGNMENTS = "alignments AS (SELECT lang AS protein, text AS sequence FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL)"
