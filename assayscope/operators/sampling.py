"""Deterministic samples and few-measurement splits, ordered by the MD5 of a text key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayscope.operators.ordering import matched
from assayscope.sources.ingest import written


def hash_order(*key: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def first_by_hash(df: DataFrame, by: list[str], item: str, k: int, key: Column) -> DataFrame:
    """The k rows of each group (all of a smaller one) that come first by (key, item), with their rank from 1; key is
    an MD5 in hex.

    Digests are evenly spread, so a bound on their first digits, set by the group's size, leaves some four times k of
    its rows. Only these are dealt out and ordered. A group of which too few are left is ordered whole.
    """
    whole = 1 << 32
    n = F.count("*")
    sizes = df.groupBy(*by).agg(n.alias("__size"))
    share = F.ceil(F.lit(float(4 * k + 100)) / F.col("__size") * F.lit(float(whole))).cast("long")
    bound = F.when(share < whole, F.lpad(F.lower(F.hex(share)), 8, "0")).otherwise(F.lit("g"))  # after all digits
    first = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("__key", item))).where(F.col("rank") <= k)
    keyed = df.withColumn("__key", key)
    # one row per group
    sizes = written(sizes.withColumn("__bound", bound), "sizes")
    some = written(matched(keyed, F.broadcast(sizes), by).where(F.substring("__key", 1, 8) < F.col("__bound")).drop("__size", "__bound"), "drawn")
    left = matched(sizes, some.groupBy(*by).agg(n.alias("__left")), by, "left")
    short = left.where(F.coalesce("__left", F.lit(0)) < F.least(F.lit(k), "__size")).select(*by)
    if short.isEmpty():
        return first(some).drop("__key")
    short = written(short, "short")
    few = matched(keyed, F.broadcast(short.withColumn("__short", F.lit(True))), by).drop("__short")
    return first(matched(some, F.broadcast(short), by, "left_anti")).unionByName(first(few)).drop("__key")


def sample_k(df: DataFrame, by: list[str], item: str, k: int | Column, salt: str = "sample") -> DataFrame:
    """k rows of each group (all of a smaller one), with their rank from 1."""
    d = df.withColumn("__salt", F.lit(salt))
    if isinstance(k, int):
        return first_by_hash(d, by, item, k, hash_order("__salt", *by, item)).drop("__salt")
    order = Window.partitionBy(*by).orderBy(hash_order("__salt", *by, item), item)
    return d.withColumn("rank", F.row_number().over(order)).drop("__salt").where(F.col("rank") <= k)


def retain_top(df: DataFrame, by: list[str], value: str, item: str, size: int, share: int = 100, least: int = 500) -> DataFrame:
    """A pool of `size` rows per group: its max(least, size / share) best rows, the rest sampled."""
    top = max(least, size // share)
    best = Window.partitionBy(*by).orderBy(F.col(value).desc(), item)
    d = df.withColumn("__top", F.row_number().over(best) <= top)
    order = Window.partitionBy(*by, "__top").orderBy(hash_order(*by, item), item)
    d = d.withColumn("__rn", F.row_number().over(order))
    return d.where(F.col("__top") | (F.col("__rn") <= max(0, size - top))).drop("__top", "__rn")


REGIMES = ("single_only", "mixed_random", "single_plus_double")


def low_n_splits(spark: SparkSession, variants: DataFrame, seeds: list[int], budgets: list[int], regimes: Sequence[str] = REGIMES) -> DataFrame:
    """assay, seed, budget, regime, rank, mutant from variants(assay, mutant, ord).

    single_only: singles; mixed_random: any mutated variant; single_plus_double: singles, then up to
    budget // 2 doubles, then any other variants until the budget is met. Splits are drawn each by itself, so those of some
    regimes or budgets are the same as among all.
    """
    grid = spark.createDataFrame([(s, b) for s in seeds for b in budgets], "seed int, budget int")
    v = variants.where("ord > 0").select("assay", "mutant", "ord").distinct()
    # some tens of parameter rows
    g = v.crossJoin(F.broadcast(grid))
    key = ["assay", "seed", "budget", "regime"]

    def ranked(df, regime):
        d = df.withColumn("regime", F.lit(regime))
        d = first_by_hash(d, key, "mutant", max(budgets), hash_order(*key, "mutant"))
        return d.where(F.col("rank") <= F.col("budget")).select(*key, "rank", "mutant")

    drawn = {REGIMES[0]: lambda: ranked(g.where("ord = 1"), REGIMES[0]), REGIMES[1]: lambda: ranked(g, REGIMES[1]), REGIMES[2]: lambda: _plus_double(g, key, budgets)}
    return reduce(DataFrame.unionByName, [drawn[r]() for r in regimes])


def _plus_double(g: DataFrame, key: list[str], budgets: list[int]) -> DataFrame:
    # the third regime in one pass: singles and doubles ranked within their kind, then one order of
    # preference: chosen singles, chosen doubles, the rest
    p = g.withColumns({"regime": F.lit(REGIMES[2]), "__kind": F.least(F.col("ord"), F.lit(3))})
    whole = Window.partitionBy(*key)
    # of each kind no more than twice the budget can be reached
    p = first_by_hash(p, [*key, "__kind"], "mutant", 2 * max(budgets), hash_order(*key, "mutant")).withColumnRenamed("rank", "__rn")
    p = p.withColumns({"__s": F.count_if(F.col("ord") == 1).over(whole), "__d": F.count_if(F.col("ord") == 2).over(whole)})
    n_single = F.least(F.col("__s"), F.col("budget") - F.least(F.col("__d"), F.floor(F.col("budget") / 2)))
    p = p.withColumn("__ns", n_single)
    tier = F.when((F.col("ord") == 1) & (F.col("__rn") <= F.col("__ns")), 0).when((F.col("ord") == 2) & (F.col("__rn") <= F.col("budget") - F.col("__ns")), 1).otherwise(2)
    p = p.withColumn("__tier", tier)
    order = Window.partitionBy(*key).orderBy("__tier", hash_order(*key, "mutant"), "mutant")
    return p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(budgets)).where(F.col("rank") <= F.col("budget")).select(*key, "rank", "mutant")
