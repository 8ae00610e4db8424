"""Residuals of double mutants against the additive expectation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_pairs, mutation_parts, pair_key
from assayscope.operators.additive import EXACT


def strict_double_residuals(v: DataFrame, least: int = 100) -> DataFrame:
    """assay, mutant, single_a, single_b, their scores, wt_proxy, additive, residual, flags; assays with
    at least `least` doubles whose parts are both measured. The mean single stands for the wild type."""
    one = v.where("ord = 1").select("assay", F.col("mutant").alias("part"), F.col("dms_score").alias("s"))
    wt = one.groupBy("assay").agg(F.avg("s").alias("wt_proxy"))
    two = v.where("ord = 2").withColumn("p", mutation_parts(F.col("mutant")))
    two = two.select("assay", "mutant", F.get("p", 0).alias("single_a"), F.get("p", 1).alias("single_b"), F.col("dms_score").alias("score_double"))
    a = one.withColumnsRenamed({"part": "single_a", "s": "score_single_a"})
    b = one.withColumnsRenamed({"part": "single_b", "s": "score_single_b"})
    d = two.join(a, ["assay", "single_a"]).join(b, ["assay", "single_b"]).join(wt, "assay")
    x, y, z, w = (F.col(c) for c in ("score_single_a", "score_single_b", "score_double", "wt_proxy"))
    additive = F.round(x + y - w, 9)
    d = d.withColumn("additive_prediction", additive).withColumn("epistasis_residual", F.round(z - F.col("additive_prediction"), 9))
    d = d.withColumns({
        "abs_epistasis_residual": F.abs("epistasis_residual"),
        "sign_epistasis": (((x - w) * (z - y) < 0) | ((y - w) * (z - x) < 0)).cast("int"),
        "reciprocal": (((x - w) * (z - w) < 0) & ((y - w) * (z - w) < 0)).cast("int"),
        "n": F.count("*").over(Window.partitionBy("assay")),
    })
    return d.where(F.col("n") >= least)


def with_scores(residuals: DataFrame, scores: DataFrame) -> DataFrame:
    """residuals with each method's score; rows whose method lacks the variant are absent."""
    return residuals.join(scores.select("assay", "mutant", "method", "score"), ["assay", "mutant"])


def pair_orders(doubles: DataFrame, higher: DataFrame, seeds: list[int], most: int) -> DataFrame:
    """assay, pair, epistasis_residual, mutant, policy, seed, o: in which order (from 1 to `most`) each policy and
    seed would measure the doubles. A budget takes the first ones, so budgets of an order are nested.

    random_doubles: by hash, for each seed. informative_pair_coverage: pairs that most higher variants have come
    first; it knows no seed, which is -1 here.
    """
    d = doubles.select("assay", "mutant", "epistasis_residual", pair_key(F.col("single_a"), F.col("single_b")).alias("pair"))
    first = lambda rows, *order: rows.withColumn("o", F.row_number().over(Window.partitionBy("assay", "policy", "seed").orderBy(*order, "mutant"))).where(F.col("o") <= most)
    drawn = d.withColumns({"policy": F.lit("random_doubles"), "seed": F.explode(F.array(*map(F.lit, seeds)))})
    drawn = first(drawn, F.md5(F.concat_ws("|", "assay", "seed", "mutant")))
    informed = d.join(pair_frequencies(higher), ["assay", "pair"], "left").withColumns({"policy": F.lit("informative_pair_coverage"), "seed": F.lit(-1)})
    return drawn.unionByName(first(informed, F.coalesce("freq", F.lit(0)).desc()).drop("freq"))


def pair_frequencies(variants: DataFrame) -> DataFrame:
    """assay, pair, freq: how many variants have the pair."""
    p = variants.select("assay", F.explode(mutation_pairs(mutation_parts(F.col("mutant")))).alias("p"))
    return p.groupBy("assay", pair_key(F.col("p.a"), F.col("p.b")).alias("pair")).agg(F.count("*").alias("freq"))


def pair_corrections(higher: DataFrame, orders: DataFrame, budgets: list[int]) -> DataFrame:
    """higher(assay, mutant, ord, score, ...) once for each policy, seed and budget, with score + the mean
    residual of those of its pairs that the budget has measured, how many these are, and its pairs.

    Each variant's pairs meet the orders once; sums over the prefixes of an order serve all budgets.
    """
    p = higher.select("assay", "mutant", F.explode(mutation_pairs(mutation_parts(F.col("mutant")))).alias("p"))
    p = p.select("assay", "mutant", pair_key(F.col("p.a"), F.col("p.b")).alias("pair"))
    run = ["policy", "seed"]
    upto = lambda b, x: F.when(F.col("o") <= b, x)
    sums = [F.sum(upto(b, F.col("epistasis_residual").cast(EXACT))).alias(f"s{b}") for b in budgets] + [F.count(upto(b, F.lit(1))).alias(f"k{b}") for b in budgets]
    known = p.join(orders.select("assay", "pair", "epistasis_residual", "o", *run), ["assay", "pair"]).groupBy("assay", "mutant", *run).agg(*sums)
    # a few runs per assay
    runs = orders.select("assay", *run).distinct()
    out = higher.join(runs, "assay").join(known, ["assay", "mutant", *run], "left")
    each = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"s{b}").cast("double").alias("s"), F.coalesce(f"k{b}", F.lit(0)).alias("known")) for b in budgets])
    out = out.select(*higher.columns, *run, F.explode(each).alias("x")).select(*higher.columns, *run, "x.*")
    mean = F.coalesce(F.try_divide("s", "known"), F.lit(0.0))
    pairs = (F.col("ord") * (F.col("ord") - 1) / 2).cast("long")
    return out.withColumns({"pairwise_score": F.round(F.col("score") + mean, 9), "pairs": pairs}).drop("s")


def enrichment(df: DataFrame, by: list[str], score: str, hit: str, item: str, ks: list[int], size: str | None = None, hits: str | None = None) -> DataFrame:
    """Hit rate of the top k by score against the base rate, for each k; ties go to the larger item. The base
    rate is that of the group's rows, or hits / size where these columns tell it for the group. Enrichment is
    one division of whole numbers; null without a hit."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(item).desc())
    d = df.withColumn("o", F.row_number().over(order))
    n = F.max(size) if size else F.count("*")
    total = F.max(hits) if hits else F.sum(hit)
    out = d.groupBy(*by).agg(F.count("*").alias("rows"), n.alias("size"), total.alias("total"), *[F.sum(F.when(F.col("o") <= k, F.col(hit))).alias(f"k{k}") for k in ks])
    out = out.unpivot([*by, "rows", "size", "total"], [f"k{k}" for k in ks], "k", "found").withColumn("k", F.substring("k", 2, 9).cast("int"))
    taken = F.least("k", "rows")
    return out.select(
        *by, "k", (F.col("total") / F.col("size")).alias("base_rate"), (F.col("found") / taken).alias("hit_rate"),
        F.try_divide((F.col("found") * F.col("size")).cast("double"), (taken * F.col("total")).cast("double")).alias("enrichment"),
    )
