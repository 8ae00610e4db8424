"""Calibration models fitted per group: closed forms from sums, and ridge regression on sparse features."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-8


def linear_1(train: DataFrame, by: list[str], x: str, y: str, ridge: float = RIDGE) -> DataFrame:
    """by, intercept, slope of y ~ 1 + x; a constant x has slope 0."""
    m = train.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("n_train"))
    c = train.join(m, by).withColumns({"dx": F.col(x) - F.col("mx"), "dy": F.col(y) - F.col("my")})
    s = c.groupBy(*by).agg(F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("n_train").alias("n_train"))
    s = s.withColumn("slope", F.col("sxy") / (F.col("sxx") + F.lit(ridge)))
    return s.select(*by, "n_train", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def linear_2(train: DataFrame, by: list[str], a: str, z: str, y: str, ridge: float = RIDGE) -> DataFrame:
    """by, intercept, slope_a, slope_z of y ~ 1 + a + z by Cramer's rule on centred sums."""
    m = train.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(z).alias("mz"), F.avg(y).alias("my"), F.count("*").alias("n_train"))
    c = train.join(m, by).withColumns({"da": F.col(a) - F.col("ma"), "dz": F.col(z) - F.col("mz"), "dy": F.col(y) - F.col("my")})
    p = lambda u, v, n: F.sum(F.col(u) * F.col(v)).alias(n)
    keep = [F.first(k).alias(k) for k in ("ma", "mz", "my", "n_train")]
    s = c.groupBy(*by).agg(p("da", "da", "aa"), p("dz", "dz", "zz"), p("da", "dz", "az"), p("da", "dy", "ay"), p("dz", "dy", "zy"), *keep)
    aa, zz = F.col("aa") + F.lit(ridge), F.col("zz") + F.lit(ridge)
    det = aa * zz - F.col("az") * F.col("az")
    s = s.withColumns({"slope_a": F.try_divide(F.col("ay") * zz - F.col("az") * F.col("zy"), det), "slope_z": F.try_divide(aa * F.col("zy") - F.col("az") * F.col("ay"), det)})
    return s.select(*by, "n_train", "slope_a", "slope_z", (F.col("my") - F.col("slope_a") * F.col("ma") - F.col("slope_z") * F.col("mz")).alias("intercept"))


#: Rows of a group that one small QR factorisation takes, and factors that one step up the tree stacks.
QR_ROWS, QR_FAN = 2048, 16


def ridge_grouped(train: DataFrame, test: DataFrame, by: list[str], item: str, y: str, ridge: float = 1.0, spare: int | None = None) -> DataFrame:
    """by, item, score of a ridge regression with an unpenalised intercept per group (see ridge_weights()).

    train and test hold sparse features as rows (by, item, feature, value), train also y on each row."""
    weights = ridge_weights(train, by, item, y, ridge, spare)
    base = weights.where("feature = ''").select(*by, F.col("weight").alias("base"))
    dot = test.join(weights, [*by, "feature"]).groupBy(*by, item).agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    items = test.select(*by, item).distinct().join(base, by)
    return items.join(dot, [*by, item], "left").select(*by, item, (F.col("base") + F.coalesce("dot", F.lit(0.0))).alias("score"))


def ridge_weights(train: DataFrame, by: list[str], item: str, y: str, ridge: float = 1.0, spare: int | None = None) -> DataFrame:
    """by, feature, weight of a ridge regression per group; the feature '' is the unpenalised intercept.

    A tree of small QR factorisations: each block of a group's rows is reduced to a triangle no larger than features
    squared, triangles are stacked and reduced again, and the last one is solved with the penalty's rows
    below it. Products of features, which square the condition number, are never formed, and no task holds
    more than QR_ROWS rows of a group, or QR_FAN triangles. Groups with fewer than features + `spare` rows
    are refused, if spare is given: they have no scores.
    """
    types = dict(train.dtypes)
    t = train.select(*by, item, "feature", "value", y)
    sizes = t.groupBy(*by).agg(F.count_distinct(item).alias("__rows"), F.count_distinct("feature").alias("__features"))
    if spare is not None:
        sizes = sizes.where(F.col("__rows") >= F.col("__features") + spare)
    blocks = F.ceil(F.col("__rows") / QR_ROWS)
    t = t.join(sizes.select(*by, blocks.alias("__blocks")), by).withColumn("block", F.pmod(F.xxhash64(item), F.col("__blocks")))
    levels, most = 0, t.agg(F.max("__blocks")).first()[0] or 1
    while most > 1:
        levels, most = levels + 1, -(-most // QR_FAN)
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", block long, features array<string>, row int, factor array<double>"
    keys = [*by, "block"]

    def factored(key, names, matrix) -> pd.DataFrame:
        r = np.linalg.qr(matrix, mode="r")
        return pd.DataFrame({**{k: [v] * len(r) for k, v in zip(keys, key)}, "features": [names] * len(r), "row": range(len(r)), "factor": list(r)})

    def leaf(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=item, columns="feature", values="value", aggfunc="sum", fill_value=0.0)
        names = ["", *wide.columns]
        truth = pdf.groupby(item)[y].first().loc[wide.index].to_numpy()
        return factored(key, names, np.column_stack([np.ones(len(wide)), wide.to_numpy(), truth]))

    def stacked(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        # blocks may know different features; the intercept, named '', comes first
        names = sorted({f for fs in pdf["features"] for f in fs})
        at = {f: i for i, f in enumerate(names)}
        out = np.zeros((len(pdf), len(names) + 1))
        for i, (fs, factor) in enumerate(zip(pdf["features"], pdf["factor"])):
            out[i, [at[f] for f in fs]], out[i, -1] = factor[:-1], factor[-1]
        return names, out

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return factored(key, *stacked(pdf))

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = stacked(pdf)
        penalty = np.sqrt(ridge) * np.eye(len(names))[[i for i, f in enumerate(names) if f != ""]]
        a, b = np.vstack([m[:, :-1], penalty]), np.concatenate([m[:, -1], np.zeros(len(penalty))])
        return pd.DataFrame({**{k: [v] * len(names) for k, v in zip(by, key)}, "feature": names, "weight": np.linalg.lstsq(a, b, rcond=None)[0]})

    f = t.drop("__blocks").groupBy(*keys).applyInPandas(leaf, schema)
    for _ in range(levels):
        f = f.withColumn("block", F.floor(F.col("block") / QR_FAN)).groupBy(*keys).applyInPandas(join, schema)
    return f.groupBy(*by).applyInPandas(solve, ", ".join(f"{k} {types[k]}" for k in by) + ", feature string, weight double")


def waves(columns: int, size: int = 64, scale: float = 1.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of random Fourier features, fixed by the seed."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((size, columns)) / scale, rng.uniform(0.0, 2 * np.pi, size)


def kernel_features(d: DataFrame, by: list[str], item: str, features: list[str], size: int = 64, scale: float = 1.0, seed: int = 7) -> DataFrame:
    """by, item, feature, value: `size` random Fourier features of each row, whose products approach the
    Gaussian kernel exp(-|x - y|**2 / (2 * scale**2)) of the columns `features`.

    The frequencies are fixed by the seed, the same for every group and row, so nothing is fitted here.
    """
    w, phase = waves(len(features), size, scale, seed)
    turn = [reduce(add, [F.col(f) * F.lit(float(w[k, j])) for j, f in enumerate(features)], F.lit(float(phase[k]))) for k in range(size)]
    values = F.array(*[F.cos(x) * F.lit(float(np.sqrt(2.0 / size))) for x in turn])
    out = d.select(*by, item, F.posexplode(values).alias("__k", "value"))
    return out.select(*by, item, F.concat(F.lit("wave:"), F.lpad(F.col("__k").cast("string"), 4, "0")).alias("feature"), "value")


def best_gain(df: DataFrame, group: str, method: str, value: str, base: Column, mode: str) -> DataFrame:
    """group, mode, gain: the best method's mean value less the base rows' mean; null without either.
    A group that was judged in several modes is an error, as its values can't be compared."""
    m = df.groupBy(group, method, base.alias("__base")).agg(F.avg(value).alias("__mean"), F.min(mode).alias("__lo"), F.max(mode).alias("__hi"))
    lo, hi = F.min("__lo"), F.max("__hi")
    g = m.groupBy(group).agg(
        F.when(lo == hi, lo).when(hi.isNotNull(), F.raise_error(F.lit("a group is judged in several modes"))).alias(mode),
        (F.max(F.when(~F.col("__base"), F.col("__mean"))) - F.max(F.when(F.col("__base"), F.col("__mean")))).alias("gain"),
    )
    return g.select(group, mode, "gain")
