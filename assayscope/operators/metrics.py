"""Ranking-quality metrics as aggregations over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayscope.operators.ordering import matched, positions
from assayscope.operators.ranking import not_after, tie_ranks, top_cuts, top_k
from assayscope.sources.ingest import written


def pearson(x: str | Column, y: str | Column, least: int = 3) -> Column:
    """Correlation of the rows where both are present; null below `least` rows or without variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c).cast("double") for c in (x, y))  # sums of squared whole ranks overflow
    n = F.count(x)
    cov = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    var = (n * F.sum(x * x) - F.sum(x) * F.sum(x)) * (n * F.sum(y * y) - F.sum(y) * F.sum(y))
    flat = (n < least) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (var <= 0)
    return F.when(~flat, F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))))


def rank_correlation(df: DataFrame, by: list[str], truth: str, pred: str, least: int = 3) -> DataFrame:
    """n and spearman per group of a table that can be read twice, with both values present.

    Both sides are folded by value and ranked through counts of value ranges. Only truth's ranks go back to
    the rows; there they are summed by prediction, whose ranks then meet these sums.
    """
    n = F.count("*").alias("__n")
    rt = tie_ranks(df.groupBy(*by, truth).agg(n), by, truth, "__rt").select(*by, truth, "__rt")
    rows = matched(df.select(*by, truth, pred), rt, [*by, truth])
    t = F.col("__rt")
    folded = rows.groupBy(*by, pred).agg(n, F.sum(t).alias("__st"), F.sum(t * t).alias("__stt"), F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    f = tie_ranks(folded, by, pred, "__rp")
    p, w = F.col("__rp"), F.col("__n").cast("double")
    sums = f.groupBy(*by).agg(
        F.sum("__n").alias("n"), F.sum(w * p).alias("__x"), F.sum(w * p * p).alias("__xx"), F.sum("__st").alias("__y"), F.sum("__stt").alias("__yy"),
        F.sum(p * F.col("__st")).alias("__xy"), (F.min(p) == F.max(p)).alias("__flat_x"), (F.min("__lo") == F.max("__hi")).alias("__flat_y"),
    )
    c, m = F.col, F.col("n").cast("double")
    var = (m * c("__xx") - c("__x") * c("__x")) * (m * c("__yy") - c("__y") * c("__y"))
    rho = F.when((c("n") >= least) & ~c("__flat_x") & ~c("__flat_y") & (var > 0), F.try_divide(m * c("__xy") - c("__x") * c("__y"), F.sqrt(F.greatest(var, F.lit(0.0)))))
    return sums.select(*by, "n", rho.alias("spearman"))


def spearman(df: DataFrame, by: list[str], truth: str, pred: str, least: int = 3) -> DataFrame:
    """n, spearman and abs_spearman per group."""
    d = written(df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(*by, truth, pred), "pairs")
    return rank_correlation(d, by, truth, pred, least).withColumn("abs_spearman", F.abs("spearman"))


def paired_rows(df: DataFrame, by: list[str], truth: str, pred: str, item: str, *more: str) -> DataFrame:
    """The rows with both values, written, as several passes read them."""
    return written(df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(*dict.fromkeys([*by, item, truth, pred, *more])), "pairs")


def top_size(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(share)))


def gain(truth: Column) -> Column:
    """2**rel - 1 with rel the min-max scaled truth."""
    rel = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((truth - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return F.pow(F.lit(2.0), rel) - 1


def top_metrics(d: DataFrame, by: list[str], truth: str, pred: str, item: str, k: int, shares: dict[str, float] | None = None) -> DataFrame:
    """One row per group of paired_rows(): n, NDCG, best and mean truth of the predicted top k, and which
    part of truth's best rows (shares of the group, by output name) is in it.

    The predicted and the true top k are selected by threshold; of truth's best rows only the last one is
    looked up, and the k predicted rows are compared with it.
    """
    shares = {"top1pct_recall_at_k": 0.01, "top5pct_recall_at_k": 0.05} if shares is None else shares
    cuts = top_cuts(d, by, truth, item, {k: top_size(F.col("n"), s) for k, s in shares.items()}, "true")
    value = F.col(truth)
    head = matched(top_k(d, by, pred, item, k), cuts, by).withColumnsRenamed({"true_lo": "lo", "true_hi": "hi"})
    found = {x: F.count_if(not_after(truth, item, f"true_{x}")) / F.max(top_size(F.col("n"), s)) for x, s in shares.items()}
    got = head.groupBy(*by).agg(
        F.first("n").alias("n"), F.sum(gain(value) / F.log2(F.col("rank") + 1.0)).alias("__dcg"), *[c.alias(x) for x, c in found.items()],
        F.max(value).alias("best_true_in_pred_top_k"), F.avg(value).alias("mean_true_in_pred_top_k"),
    )
    ideal = matched(top_k(d, by, truth, item, k), cuts, by).withColumnsRenamed({"true_lo": "lo", "true_hi": "hi"})
    ideal = ideal.groupBy(*by).agg(F.sum(gain(value) / F.log2(F.col("rank") + 1.0)).alias("__ideal"))
    out = matched(got, ideal, by)
    return out.select(*by, "n", F.coalesce(F.try_divide("__dcg", "__ideal"), F.lit(0.0)).alias("ndcg_at_k"), *shares, "best_true_in_pred_top_k", "mean_true_in_pred_top_k")


def zero_shot_metrics(scores: DataFrame, by: list[str], truth: str, pred: str, item: str, order: str, k: int = 100) -> DataFrame:
    """Rank correlation, counts by mutation order and top-k discovery of every group."""
    d = paired_rows(scores, by, truth, pred, item, order)
    o = F.col(order)
    counts = d.groupBy(*by).agg(F.count_if(o == 1).alias("n_singles"), F.count_if(o == 2).alias("n_doubles"), F.count_if(o > 2).alias("n_higher_order"))
    out = matched(matched(rank_correlation(d, by, truth, pred), counts, by), top_metrics(d, by, truth, pred, item, k).drop("n"), by)
    return out.withColumn("abs_spearman", F.abs("spearman"))


def extended_metrics(scores: DataFrame, by: list[str], truth: str, pred: str, item: str, least: int = 20) -> DataFrame:
    """Pearson, errors of z-scores, hit rate and enrichment of the predicted top 10 and 20 in truth's top 1 %,
    and the recall of its top 10 %, of groups of `least` rows."""
    d = paired_rows(scores, by, truth, pred, item)
    n = F.col("n")
    t = top_cuts(d, by, truth, item, {"p1": top_size(n, 0.01), "p10": top_size(n, 0.1)}, "true")
    p = top_cuts(d, by, pred, item, {"a10": F.lit(10).cast("long"), "a20": F.lit(20).cast("long"), "p10": top_size(n, 0.1)}, "pred").drop("n")
    scale = d.groupBy(*by).agg(*[f(c).alias(f"{k}_{x}") for k, c in (("t", truth), ("p", pred)) for x, f in (("mean", F.avg), ("std", F.stddev_pop))])
    r = matched(d, matched(matched(t, p, by), scale, by).where(n >= least), by)
    z = lambda k, c: (F.col(c) - F.col(f"{k}_mean")) / F.when(F.col(f"{k}_std") == 0, 1.0).otherwise(F.col(f"{k}_std"))
    gap = z("t", truth) - z("p", pred)
    top1, top10 = not_after(truth, item, "true_p1"), not_after(truth, item, "true_p10")
    size = F.count("*")
    hits = {k: F.count_if(top1 & not_after(pred, item, f"pred_a{k}")) / F.least(F.lit(k), size) for k in (10, 20)}
    base = F.count_if(top1) / size
    return r.groupBy(*by).agg(
        F.first("n").alias("n"), pearson(truth, pred).alias("pearson"), F.sqrt(F.avg(gap * gap)).alias("rmse_z"), F.avg(F.abs(gap)).alias("mae_z"),
        hits[10].alias("hit_rate_at_10"), hits[20].alias("hit_rate_at_20"), F.try_divide(hits[10], base).alias("enrichment_at_10"), F.try_divide(hits[20], base).alias("enrichment_at_20"),
        (F.count_if(top10 & not_after(pred, item, "pred_p10")) / F.count_if(top10)).alias("top10pct_recall"),
    )


def auc_sums(d: DataFrame, by: list[str], label: str, pred: str) -> DataFrame:
    """n, n_pos and auc per group: positives are counted by value, and ranks are those of the values."""
    pos = F.col(label) == 1
    f = d.groupBy(*by, pred).agg(F.count("*").alias("__n"), F.count_if(pos).alias("__pos"))
    f = tie_ranks(f, by, pred, "__r").groupBy(*by).agg(F.sum("__n").alias("n"), F.sum("__pos").alias("n_pos"), F.sum(F.col("__pos") * F.col("__r")).alias("__sum"))
    p, q = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return f.select(*by, "n", "n_pos", F.try_divide(F.col("__sum") - p * (p + 1) / F.lit(2.0), (p * q).cast("double")).alias("auc"))


def binary_metrics(df: DataFrame, by: list[str], label: str, pred: str, item: str, least: int = 10) -> DataFrame:
    """AUC from mid-ranks, MCC and recall of the predicted top fraction; groups of `least` rows with both classes."""
    d = paired_rows(df, by, label, pred, item)
    size = F.col("n")
    cuts = top_cuts(d, by, pred, item, {"p10": top_size(size, 0.1), "p1": top_size(size, 0.01)}, "pred").drop("n")
    pos = F.col(label) == 1
    called = not_after(pred, item, "pred_p10")
    c = matched(d, cuts, by).groupBy(*by).agg(*[F.count_if(x).cast("double").alias(k) for k, x in (("tp", called & pos), ("fp", called & ~pos), ("tp1", not_after(pred, item, "pred_p1") & pos))])
    out = matched(auc_sums(d, by, label, pred), c, by).where((size >= least) & (F.col("n_pos") > 0) & (F.col("n_pos") < size))
    p, tp, fp = F.col("n_pos"), F.col("tp"), F.col("fp")
    fn, tn = p - tp, size - p - fp
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))
    return out.select(
        *by, "n", (p / size).alias("positive_rate"), "auc", F.abs(F.col("auc") - 0.5).alias("abs_auc_minus_half"), mcc.alias("mcc_top10pct"),
        F.try_divide(tp, p.cast("double")).alias("recall_pos_at_top10pct"), F.try_divide("tp1", p.cast("double")).alias("recall_pos_at_top1pct"),
    )
