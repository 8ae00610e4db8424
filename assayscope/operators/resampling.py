"""Bootstrap intervals and paired permutation tests as joins and aggregations."""

from __future__ import annotations

import math
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_int(*key: Column | str) -> Column:
    """A whole number below 2**32 fixed by the key, the same in every SQL engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bootstrap_mean_ci(df: DataFrame, by: list[str], item: str, value: str, draws: int = 1000) -> DataFrame:
    """by, n, mean, lo, hi: the mean and the 2.5 and 97.5 percentiles of `draws` resampled means. Each
    draw takes n rows by hash; draws are aggregated where the rows are, none is collected."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w.orderBy(item)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    sizes = d.groupBy(*by).agg(F.max("n").alias("n"))
    grid = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    grid = grid.withColumn("i", hash_int(*by, "b", "j") % F.col("n"))
    exact = F.sum(F.col(value).cast("decimal(28,10)")).cast("double")
    means = grid.join(d.drop("n"), [*by, "i"]).groupBy(*by, "b").agg((exact / F.count("*")).alias("m"))
    ci = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ci, by)


#: A prime below 2**31: squares of numbers below it fit 64 bits.
PRIME = 2_147_483_647
#: Steps by which a row's number moves from draw to draw.
STRIDE = 1_000_003


def _poisson_steps(most: int = 12) -> list[int]:
    """From which of the numbers below PRIME on a Poisson(1) count is more than 0, 1, 2, ..."""
    p, total, out = math.exp(-1.0), 0.0, []
    for k in range(most):
        total += p
        out.append(round(total * PRIME))
        p /= k + 1
    return out


POISSON_STEPS = _poisson_steps()
_WIDE = Context(prec=60)


#: Parts of a group that are resampled apart, and rows whose counts of all draws are held at once.
LANES, ROWS = 64, 256
_LIMB = 10**8  # in which values are added up: a limb's sums over ROWS counts stay whole in doubles


def poisson_counts(r: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each draw (a column) takes each row: two squarings modulo PRIME stir the row's number and the draw's."""

    def squared(x, plus):
        x = x * x + plus
        # PRIME is 2**31 - 1: the digits above it count once
        x = (x & PRIME) + (x >> 31)
        return np.where(x >= PRIME, x - PRIME, x)

    r, b = r[:, None], draws[None, :]
    x = squared(squared((r + b * STRIDE) % PRIME, r), b).astype(np.int32)
    counts = np.zeros(x.shape)
    for t in POISSON_STEPS[:4]:
        counts += x >= t
    # one number in fifty
    far = np.nonzero(x >= POISSON_STEPS[3])
    if len(far[0]):
        counts[far] = np.searchsorted(np.array(POISSON_STEPS), x[far], side="right")
    return counts


def bootstrap_weights_ci(df: DataFrame, by: list[str], item: str, value: str, draws: int = 1000) -> DataFrame:
    """by, n, mean, lo, hi like bootstrap_mean_ci(), for groups of any size: instead of drawing n rows, each
    row says by hash how often each draw takes it (counts of mean 1), so a draw is two sums over the rows.

    Rows are dealt out once. Each task adds up its rows' weights and weighted values for all draws, a few rows at a
    time, as matrix products of whole numbers, and sends on one row per group, lane and draw. A draw that takes no row
    at all (in tiny groups) is left out.
    """
    there = df.where(F.col(value).isNotNull())
    lane = F.pmod(F.xxhash64(item), F.lit(LANES)).alias("__lane")
    d = there.select(*by, F.col(value).cast("decimal(28,10)").alias("__v"), (hash_int(F.lit("boot"), *by, item) % PRIME).alias("__r"), lane)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", b int, __sum decimal(38,10), __w long"

    def added(table: pa.Table) -> pa.Table:
        units = np.array([int(v.scaleb(10, _WIDE)) for v in table["__v"].to_pylist()], dtype=object)
        limbs = []
        while len(limbs) < 3:
            units, low = units // _LIMB, units % _LIMB
            limbs.append(low)
        terms = np.column_stack([np.ones(len(units)), *limbs, units]).astype(float)
        r, of = table["__r"].to_numpy().astype(np.int64), np.arange(draws, dtype=np.int64)
        total = np.zeros((draws, terms.shape[1]), dtype=np.int64)
        for at in range(0, len(r), ROWS):
            total += (poisson_counts(r[at : at + ROWS], of).T @ terms[at : at + ROWS]).astype(np.int64)
        sums = [sum(int(x) * _LIMB**k for k, x in enumerate(row[1:])) for row in total]
        first = table.slice(0, 1)
        keys = {c: pa.concat_arrays(first[c].chunks).take(np.zeros(draws, dtype=np.int64)) for c in by}
        exact = pa.array([Decimal(x).scaleb(-10, _WIDE) for x in sums], pa.decimal128(38, 10))
        return pa.table({**keys, "b": pa.array(of, pa.int32()), "__sum": exact, "__w": total[:, 0]})

    drawn = d.groupBy(*by, "__lane").applyInArrow(added, schema)
    means = drawn.groupBy(*by, "b").agg(F.try_divide(F.sum("__sum").cast("double"), F.sum("__w")).alias("m"))
    ci = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return there.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ci, by)


def _sign_sums(values: Column) -> Column:
    """All sums of the values with either sign, 2**size of them."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, start, lambda sums, v: F.concat(F.transform(sums, lambda s: s + v), F.transform(sums, lambda s: s - v)))


def _exact_hits(d: DataFrame, by: list[str]) -> DataFrame:
    """by, hits, tried: of all sign patterns of a group's values v (numbered i of n), those whose sum is at
    least as far from 0 as the sum as observed.

    Meeting in the middle: the sums of either half of the values, 2**(n/2) each, are put in one order with
    the bounds that each left sum sets for its right partners, and counted through.
    """
    half = F.floor(F.col("n") / 2)
    g = d.groupBy(*by).agg(F.abs(F.sum("v")).alias("seen"), F.collect_list(F.when(F.col("i") < half, F.col("v"))).alias("left"), F.collect_list(F.when(F.col("i") >= half, F.col("v"))).alias("right"))
    right = g.select(*by, F.explode(_sign_sums(F.col("right"))).alias("x")).groupBy(*by, "x").agg(F.count("*").alias("c"))
    left = g.select(*by, "seen", F.explode(_sign_sums(F.col("left"))).alias("a")).groupBy(*by, "seen", "a").agg(F.count("*").alias("c"))
    # right sums of at most -seen - a, and those above seen - a - 1; with nothing seen, every pattern counts
    asked = left.select(*by, F.explode(F.array(F.struct((-F.col("seen") - F.col("a")).alias("x"), F.lit(1).alias("sign")), F.struct((F.col("seen") - F.col("a") - 1).alias("x"), F.lit(-1).alias("sign")))).alias("p"), "c")
    both = right.select(*by, "x", "c", F.lit(0).cast("long").alias("w")).unionByName(asked.select(*by, "p.x", F.lit(0).cast("long").alias("c"), (F.col("p.sign") * F.col("c")).alias("w")))
    both = both.groupBy(*by, "x").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("x"))  # 3 * 2**(n/2) rows of a group
    low = both.withColumn("u", upto).groupBy(*by).agg(F.sum(F.col("u") * F.col("w")).alias("low"), F.sum("c").alias("rights"))
    whole = g.select(*by, "seen", F.size("left").alias("lefts"))
    tried = F.col("rights") * F.pow(F.lit(2.0), F.col("lefts")).cast("long")
    return low.join(whole, by).select(*by, F.when(F.col("seen") == 0, tried).otherwise(F.col("low") + tried).alias("hits"), tried.alias("tried"))


def paired_permutation(diffs: DataFrame, by: list[str], item: str, diff: str, exact_up_to: int = 20, flips: int = 50_000) -> DataFrame:
    """by, n, mean_difference, p_value of a two-sided sign-flip test on nonzero differences.

    Up to `exact_up_to` differences all 2**n sign patterns are counted, without listing them; beyond it
    `flips` hashed ones with (hits + 1) / (flips + 1). Differences are whole numbers of 1e-9, so sums compare
    exactly.
    """
    d = diffs.where(F.col(diff).isNotNull()).withColumn("v", F.round(F.col(diff) * 1e9).cast("long"))
    every = d.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(diff).alias("mean_difference"))
    w = Window.partitionBy(*by)
    d = d.where("v <> 0").select(*by, "v", (F.row_number().over(w.orderBy(item)) - 1).cast("int").alias("i"), F.count("*").over(w).cast("int").alias("n"))
    small = _exact_hits(d.where(F.col("n") <= exact_up_to), by).withColumn("p", F.col("hits") / F.col("tried"))
    big = d.where(F.col("n") > exact_up_to)
    drawn = big.withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(flips - 1).cast("long"))))
    sums = drawn.groupBy(*by, "perm").agg(F.abs(F.sum(F.when(hash_int(*by, "perm", "i") % 2 == 1, F.col("v")).otherwise(-F.col("v")))).alias("a"))
    seen = big.groupBy(*by).agg(F.abs(F.sum("v")).alias("seen"))
    hits = sums.join(seen, by).groupBy(*by).agg(F.count_if(F.col("a") >= F.col("seen")).alias("hits"))
    p = small.select(*by, "p").unionByName(hits.select(*by, ((F.col("hits") + 1) / F.lit(flips + 1)).alias("p")))
    out = every.join(p, by, "left").join(d.groupBy(*by).agg(F.max("n").alias("n")), by, "left")
    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), "mean_difference", F.coalesce("p", F.lit(1.0)).alias("p_value"))
