"""Choosing the next batch to measure from a pool of predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_parts, mutation_sites
from assayscope.operators.ranking import top_k
from assayscope.sources.ingest import written


def unobserved(pool: DataFrame, observed: DataFrame, by: list[str], item: str) -> DataFrame:
    return pool.join(observed.select(*by, item), [*by, item], "left_anti")


def best_batch(scores: DataFrame, by: list[str], item: str, score: str | Column, batch: int) -> DataFrame:
    """by, item, rank of the `batch` best rows per group; ties go to the smaller item."""
    s = F.col(score) if isinstance(score, str) else score
    return top_k(scores.select(*by, item, s.alias("__score")), by, "__score", item, batch).select(*by, item, "rank")


def ensemble_across(columns: list[str]) -> tuple[Column, Column]:
    """Mean and sample deviation (0 of a single value) over a row's predictions, missing ones left out."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    n, zero = F.size(there), F.lit(0.0)
    mean = F.try_divide(F.aggregate(there, zero, lambda total, x: total + x), n)
    spread = F.aggregate(there, zero, lambda total, x: total + (x - mean) * (x - mean))
    return mean, F.when(n < 2, 0.0).otherwise(F.sqrt(F.try_divide(spread, n - 1)))


def ensemble(predictions: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """Mean and sample deviation over the models of each item, rounded so that ties are exact."""
    g = predictions.groupBy(*by, item).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    return g.select(*by, item, F.round("mean", 9).alias("mean"), F.round(F.coalesce("std", F.lit(0.0)), 9).alias("std"))


def greedy(rows: list[tuple[str, float, frozenset]], batch: int, penalty: float, left_out: tuple[float, str] | None = None) -> tuple[list[str], bool]:
    """Items chosen one by one by score less penalty per site shared with the chosen ones, and whether they
    are the choice from all rows, where the best row not given is `left_out` (its score and item).

    Lazy: rows come in the order of their scores, so a step ends at the first score that the best penalised
    one reaches.
    """
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    chosen, used, taken, sure = [], set(), set(), True
    while len(chosen) < min(batch, len(order)):
        best = None
        for k, (name, score, sites) in enumerate(order):
            if best is not None and -score > best[0]:
                break
            if k not in taken:
                mine = (-(score - penalty * len(sites & used)), name, k)
                best = mine if best is None else min(best, mine)
        if left_out is not None and (best[0], best[1]) > (-left_out[0], left_out[1]):
            sure = False
        taken.add(best[2])
        chosen.append(best[1])
        used |= order[best[2]][2]
    return chosen, sure and (left_out is None or len(order) >= batch)


#: Rows of a group that one task may choose from.
HEAD = 2000


def acquire_diverse(pool: DataFrame, by: list[str], item: str, score: str, batch: int, weight: float = 0.02, head: int = HEAD) -> DataFrame:
    """by, item, rank of a greedy batch that is penalised by weight * score range for each site shared
    with rows chosen before.

    Of rows with the same sites only the `batch` best can be chosen, as their penalty is the same; of these
    only the `head` best of a group reach one task, merged from what each task holds. Scores without a
    penalty are upper bounds: a choice stands if it is no worse than the best row that was left out.
    Groups where some choice can't be told so are chosen step by step in Spark, one aggregation a step.
    """
    d = pool.where(F.col(score).isNotNull()).withColumn("sites", F.array_sort(mutation_sites(mutation_parts(F.col(item)))))
    span = d.groupBy(*by).agg((F.max(score) - F.min(score)).alias("range"))
    heads = written(top_k(d, [*by, "sites"], score, item, batch).drop("rank"), "heads")
    first = top_k(heads, by, score, item, head + 1).join(span, by)
    types = dict(pool.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*by, item]) + ", rank int, sure boolean"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        left_out = (pdf[score].iloc[head], pdf[item].iloc[head]) if len(pdf) > head else None
        rows = [(i, s, frozenset(t)) for i, s, t in zip(pdf[item][:head], pdf[score][:head], pdf["sites"][:head])]
        got, sure = greedy(rows, batch, weight * float(pdf["range"].iloc[0]), left_out)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(got) for c in by}, item: got, "rank": range(1, len(got) + 1), "sure": [sure] * len(got)})

    picked = written(first.groupBy(*by).applyInPandas(pick, schema), "picked")
    sure = picked.where("sure").select(*by, item, "rank")
    doubt = picked.where("not sure").select(*by).distinct()
    if doubt.isEmpty():
        return sure
    return sure.unionByName(_stepwise(heads.join(doubt, by, "left_semi"), span, by, item, score, batch, weight))


def _stepwise(heads: DataFrame, span: DataFrame, by: list[str], item: str, score: str, batch: int, weight: float) -> DataFrame:
    """The greedy choice of acquire_diverse() without gathering a group: at each step every row's penalised
    score is compared by one aggregation. Used sites are a short list per group."""
    chosen, left = None, heads.join(span, by)
    for step in range(1, batch + 1):
        rows = left
        if chosen is not None:
            used = chosen.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("sites"))).alias("used"))
            rows = left.join(chosen.select(*by, item), [*by, item], "left_anti").join(used, by)
        else:
            rows = left.withColumn("used", F.array().cast("array<string>"))
        value = F.col(score) - F.lit(weight) * F.col("range") * F.size(F.array_intersect("sites", "used"))
        best = rows.withColumn("value", value).groupBy(*by).agg(F.max("value").alias("value"))
        at = rows.withColumn("value", value).join(best, [*by, "value"]).groupBy(*by).agg(F.min_by(F.struct(item, "sites"), F.col(item)).alias("r"))
        one = at.select(*by, F.col(f"r.{item}").alias(item), F.col("r.sites").alias("sites"), F.lit(step).alias("rank"))
        chosen = written(one if chosen is None else chosen.unionByName(one), "chosen")
    return chosen.select(*by, item, "rank")
