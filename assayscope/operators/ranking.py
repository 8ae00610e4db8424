"""Ranks, quantiles and bins within groups. Ties are broken by the item, ascending, unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayscope.operators.ordering import at_places, carried, matched, positions, ranged, running


def midrank(value: str, by: list[str], descending: bool = False) -> Column:
    """Rank from 1, ties averaged; one sort, as ties are the row's peers in the same order."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc() if descending else F.col(value).asc())
    peers = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(order) + (peers - 1) / F.lit(2.0)


def tie_ranks(folded: DataFrame, by: list[str], value: str, name: str, weight: str = "__n", total: str | None = None) -> DataFrame:
    """folded, one row per group and different value with the rows that hold it (weight), and each value's
    rank from 1 with ties averaged. Ranges of values are counted, no group is ordered in one task."""
    out = running(folded, by, [value], weight, "__low", total)
    return out.withColumn(name, F.col("__low") + (F.col(weight) + 1) / F.lit(2.0)).drop("__low")


def distributed_midrank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the rank of value in its group, ties averaged; null where value is null."""
    folded = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    return matched(df, tie_ranks(folded, by, value, name).select(*by, value, name), [*by, value], "left")


def shares_below(scores: DataFrame, probes: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """probes(by, value, ...) with the share of their group's scores that are at most their value, as bisection
    from the right over the sorted scores gives it; null in a group without scores and for a null probe.

    Scores and probes are folded by value, merged in one order and counted through; probes need not be scores.
    """
    one = scores.where(F.col(value).isNotNull()).select(*by, value, F.lit(1).alias("__score"))
    asked = probes.where(F.col(value).isNotNull()).select(*by, value, F.lit(0).alias("__score"))
    folded = one.unionByName(asked).groupBy(*by, value).agg(F.sum("__score").alias("__n"), F.min("__score").alias("__asked"))
    r = running(folded, by, [value], "__n", "__low", "__all").where("__asked = 0")
    r = r.select(*by, value, F.try_divide(F.col("__low") + F.col("__n"), F.col("__all")).alias(name))
    return matched(probes, r, [*by, value], "left")


def ordinal(value: str, by: list[str], item: str, descending: bool = False, item_descending: bool = False) -> Column:
    first = F.col(value).desc() if descending else F.col(value).asc()
    return F.row_number().over(Window.partitionBy(*by).orderBy(first, F.col(item).desc() if item_descending else F.col(item).asc()))


def rank_scale(value: str, by: list[str], item: str) -> Column:
    """Ordinal rank from 0 to 1."""
    n = F.count("*").over(Window.partitionBy(*by))
    return (ordinal(value, by, item) - 1) / F.greatest(F.lit(1), n - 1)


def top_k(df: DataFrame, by: list[str], value: str, item: str, k: int, spread: int = 16) -> DataFrame:
    """The k best rows of each group with their rank. Every task sends on its own k best of a group at most,
    and a group's come together in `spread` parts first."""
    order = [F.col(value).desc(), F.col(item).asc()]
    part = F.pmod(F.xxhash64(item), F.lit(spread))
    some = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_cuts(df: DataFrame, by: list[str], value: str, item: str, sizes: dict[str, Column], name: str) -> DataFrame:
    """One row per group: its rows, lowest and highest value, and for each size (which may use the column
    n) the last row of that many best ones, as a struct of value and item. A row is among them if it is not
    after that one (see not_after). Only the ranges' counts and one row per size are looked at."""
    t = ranged(df.where(F.col(value).isNotNull()), [*by, F.col(value).desc(), item])
    per = carried(t, by).withColumn("n", F.col("__total"))
    last = {k: F.least(c, F.col("n")) - 1 for k, c in sizes.items()}
    wanted = reduce(or_, [(p >= F.col("__before")) & (p < F.col("__before") + F.col("__size")) for p in last.values()])
    place = F.col("__before") + F.col("__at") - F.col("__first")
    hit = matched(t, per.where(wanted), [*by, "__part"]).groupBy(*by).agg(*[F.max(F.when(place == p, F.struct(value, item))).alias(f"{name}_{k}") for k, p in last.items()])
    whole = t.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias(f"{name}_lo"), F.max(value).alias(f"{name}_hi"))
    return matched(whole, hit, by)


def not_after(value: str, item: str, cut: str) -> Column:
    """Whether a row is at or before a cut of top_cuts()."""
    v, i = F.col(f"{cut}.{value}"), F.col(f"{cut}.{item}")
    return (F.col(value) > v) | ((F.col(value) == v) & (F.col(item) <= i))


def quantile_bins(df: DataFrame, value: str, item: str, labels: list[str], name: str) -> DataFrame:
    """df with label number int(i * L / n) of the i-th row by (value, item)."""
    d = positions(df, [], [F.col(value).asc_nulls_first(), item], "__i", "__size")
    slot = F.least(F.lit(len(labels) - 1), F.floor(F.col("__i") * len(labels) / F.col("__size")))
    return d.withColumn(name, F.element_at(F.array(*map(F.lit, labels)), (slot + 1).cast("int"))).drop("__i", "__size")


def at_indexes(df: DataFrame, by: list[str], value: str, **places: Column) -> DataFrame:
    """One row per group: the values at 0-based indexes of the ascending order; an index may use the column
    n, the number of the group's rows with a value."""
    return at_places(df, by, value, places)


def at_index(df: DataFrame, by: list[str], value: str, index: Column, name: str) -> DataFrame:
    return at_places(df, by, value, {name: index})


def first_hit(df: DataFrame, by: list[str], order: str, hit: str, cost: str) -> DataFrame:
    """Per run: the first round with a hit, its cost, and the last cost where there is none."""
    hits = F.when(F.col(hit), F.col(order))
    return df.groupBy(*by).agg(
        F.min(hits).alias("first_round"),
        F.min(F.when(F.col(hit), F.col(cost))).alias("labels_to_hit"),
        F.max(cost).alias("final_cost"),
        F.max(F.col(hit).cast("int")).alias("hit"),
    )


def zscore(value: str, by: list[str]) -> Column:
    """Score by the population deviation; deviation 0 counts as 1."""
    w = Window.partitionBy(*by)
    s = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(s == 0, 1.0).otherwise(s)
