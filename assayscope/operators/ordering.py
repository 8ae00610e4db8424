"""Positions in a global order, without a task that holds a whole group.

Rows are dealt into ranges of the order (Spark samples the bounds), sorted within their range and written
once, each with its range and its place there. A row's position in its group is then the number of the
group's rows in lower ranges (one small row per group and range) plus its place: no window over a group.
The table is written because two evaluations of a range partitioning may sample different bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayscope.sources.ingest import written

_PLACES = 33  # bits of monotonically_increasing_id below the partition's number


def ranged(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df as a written table in ranges of the order, with __part, the range, and __at, the place in it
    from 0. Rows that tie in the whole order may be split between ranges if the order ends in something
    that tells them apart."""
    d = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    d = d.withColumn("__id", F.monotonically_increasing_id())
    d = d.withColumns({"__part": F.shiftright("__id", _PLACES), "__at": F.col("__id").bitwiseAND(F.lit((1 << _PLACES) - 1))})
    return written(d.drop("__id"), "ranged")


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; right's copies of them are dropped."""
    names = {c: f"__on_{c}" for c in on}
    cond = F.lit(True)
    for c, k in names.items():
        cond = cond & left[c].eqNullSafe(F.col(k))
    return left.join(right.withColumnsRenamed(names), cond, how).drop(*names.values())


def carried(table: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by, __part, __before, __first, __total: of each group and range, the rows (or the weight) of the
    group in lower ranges, the group's first place in this one, and the whole group's rows (weight)."""
    size = F.sum(weight) if weight else F.count("*")
    per = table.groupBy(*by, "__part").agg(size.alias("__size"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*by)
    lower = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumns({"__before": F.coalesce(F.sum("__size").over(lower), F.lit(0)), "__total": F.sum("__size").over(group)})


def positions(df: DataFrame, by: list[str], order: list[Column | str], name: str, size: str | None = None) -> DataFrame:
    """df with each row's place from 0 in its group's order, as `name`, and the group's rows as `size`."""
    t = ranged(df, [*by, *order])
    out = matched(t, carried(t, by), [*by, "__part"])
    out = out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first"))
    return (out.withColumn(size, F.col("__total")) if size else out).select(*df.columns, name, *([size] if size else []))


def running(df: DataFrame, by: list[str], order: list[Column | str], weight: str, name: str, total: str | None = None) -> DataFrame:
    """df with the sum of `weight` over the rows before each in its group's order, as `name`, and the
    group's sum as `total`. Sums inside a range are a window over that range."""
    t = ranged(df, [*by, *order])
    out = matched(t, carried(t, by, weight), [*by, "__part"])
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(name, F.col("__before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (out.withColumn(total, F.col("__total")) if total else out).select(*df.columns, name, *([total] if total else []))


def at_places(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """One row per group: the values at the given 0-based places of the ascending order. A place may use
    the column n, the group's rows with a value; one outside of 0 to n - 1 gives null.

    Two counting passes: values are folded and counted by range, and only the ranges that hold a place are
    looked into.
    """
    folded = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    t = ranged(folded, [*by, value])
    per = carried(t, by, "__n").withColumn("n", F.col("__total"))
    wanted = F.lit(False)
    for p in places.values():
        wanted = wanted | ((p >= F.col("__before")) & (p < F.col("__before") + F.col("__size")))
    hit = matched(t, per.where(wanted), [*by, "__part"])
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("__low", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    here = lambda p: (p >= F.col("__low")) & (p < F.col("__low") + F.col("__n"))
    return hit.groupBy(*by).agg(*[F.max(F.when(here(p), F.col(value))).alias(k) for k, p in places.items()])
