"""Queries on ranks, metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayscope.functions import scalars as S
from assayscope.functions.scalars import r6
from assayscope.operators import metrics as M
from assayscope.operators import ranking as K
from assayscope.plans.registry import add
from assayscope.sources import fixtures as X
from assayscope.sources.ingest import written

V = f"WITH {X.VARIANTS}"
VL = f"WITH {X.VARIANTS}, {X.LONG}"
VL25 = f"WITH {X.VARIANTS25}, {X.LONG}"
AM = ["assay", "method"]


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def corr(x: str, y: str, least: int = 3) -> str:
    """SQL of the guarded correlation."""
    var = f"((count(*) * sum({x} * {x}) - sum({x}) * sum({x})) * (count(*) * sum({y} * {y}) - sum({y}) * sum({y})))"
    return f"CASE WHEN count(*) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}) AND {var} > 0 THEN (count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt({var}) END"


def midrank(v: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)::DOUBLE"


def long(spark, sf, v=None):
    return X.scores_long(v or X.variants(spark, sf))


def long25(spark, sf):
    return X.scores_long(X.variants25(spark, sf))


def rounded(df, *keep):
    """All double columns to six places."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- ranks ----------------------------------------------------------------------------------------


@add(f"{VL} SELECT assay, method, mutant, {midrank('score', 'assay, method')} AS midrank FROM long", name="midrank")
def midrank_scores(spark, sf):
    return long(spark, sf).withColumn("midrank", K.midrank("score", AM).cast("double")).select(*AM, "mutant", "midrank")


@add(f"{VL} SELECT assay, method, mutant, {midrank('score', 'assay, method')} AS midrank FROM long")
def distributed_midrank(spark, sf):
    return K.distributed_midrank(long(spark, sf), AM, "score", "midrank").select(*AM, "mutant", "midrank")


@add(f"{VL} SELECT assay, method, mutant, row_number() OVER (PARTITION BY assay, method ORDER BY score, mutant) AS ordinal FROM long")
def ordinal_rank(spark, sf):
    return long(spark, sf).withColumn("ordinal", K.ordinal("score", AM, "mutant")).select(*AM, "mutant", "ordinal")


@add(f"{VL} SELECT assay, method, mutant, {r('(row_number() OVER (PARTITION BY assay, method ORDER BY score, mutant) - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY assay, method) - 1)')} AS scaled FROM long")
def rank_scale(spark, sf):
    return long(spark, sf).withColumn("scaled", r6(K.rank_scale("score", AM, "mutant"))).select(*AM, "mutant", "scaled")


@add(f"{V} SELECT assay, mutant, {r('cume_dist() OVER (PARTITION BY assay ORDER BY dms_score)')} AS percentile FROM variants")
def percentile_of_score(spark, sf):
    v = written(X.variants(spark, sf).select("assay", "mutant", "dms_score"), "variants")
    return rounded(K.shares_below(v, v, ["assay"], "dms_score", "percentile").select("assay", "mutant", "percentile"))


# of each line's own price, which is no variant's mean price in general, among the scores of its assay
_PROBES = "probes AS (SELECT l_orderkey, l_linenumber, c_mktsegment AS assay, CAST(l_extendedprice AS DOUBLE) AS dms_score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


@add(f"""{V}, {_PROBES}, sorted AS (SELECT assay, list_sort(list(dms_score)) AS s FROM variants GROUP BY 1), pt AS (SELECT assay, dms_score, (SELECT count(*) FROM variants v WHERE v.assay = p.assay AND v.dms_score <= p.dms_score)::DOUBLE / len(s) AS share FROM (SELECT DISTINCT assay, dms_score FROM probes) p JOIN sorted USING (assay))
SELECT l_orderkey, l_linenumber, assay, {r('share')} AS percentile FROM probes JOIN pt USING (assay, dms_score)""")
def percentile_of_probe(spark, sf):
    o = X.table(spark, sf, "orders").join(X.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("assay"))
    p = X.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "assay", F.col("l_extendedprice").cast("double").alias("dms_score"))
    share = K.shares_below(X.variants(spark, sf), written(p, "probes"), ["assay"], "dms_score", "percentile")
    return rounded(share.select("l_orderkey", "l_linenumber", "assay", "percentile"))


@add(f"{VL}, r AS (SELECT *, row_number() OVER (PARTITION BY assay, method ORDER BY score DESC, mutant) AS rank FROM long) SELECT assay, method, mutant, rank FROM r WHERE rank <= 100")
def topk_per_group(spark, sf):
    return K.top_k(long(spark, sf), AM, "score", "mutant", 100).select(*AM, "mutant", "rank")


_MEANS25 = "means AS (SELECT assay, avg(dms_score) AS value FROM variants GROUP BY 1)"


def means25(spark, sf):
    return X.variants25(spark, sf).groupBy("assay").agg(F.avg("dms_score").alias("value"))


@add(f"WITH {X.VARIANTS25}, {_MEANS25}, i AS (SELECT *, row_number() OVER (ORDER BY value, assay) - 1 AS i, count(*) OVER () AS n FROM means) SELECT assay, ['low', 'mid', 'high', 'top'][least(3, floor(i * 4 / n))::INT + 1] AS bin FROM i")
def quantile_bins(spark, sf):
    return K.quantile_bins(means25(spark, sf), "value", "assay", ["low", "mid", "high", "top"], "bin").select("assay", "bin")


@add(f"WITH {X.VARIANTS25}, {_MEANS25}, i AS (SELECT *, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM means), c AS (SELECT max(CASE WHEN i = n // 3 THEN value END) AS lo, max(CASE WHEN i = 2 * n // 3 THEN value END) AS hi FROM i) SELECT assay, CASE WHEN value <= lo THEN 'low' WHEN value >= hi THEN 'high' ELSE 'mid' END AS tertile FROM means, c")
def tertile_cut(spark, sf):
    # written: means that are added up again in another order may differ from the cuts taken of them
    m = written(means25(spark, sf), "means").withColumn("g", F.lit(1))
    cuts = K.at_indexes(m, ["g"], "value", lo=F.floor(F.col("n") / 3), hi=F.floor(F.col("n") * 2 / 3))
    m = m.join(F.broadcast(cuts), "g")  # one row
    return m.select("assay", F.when(F.col("value") <= F.col("lo"), "low").when(F.col("value") >= F.col("hi"), "high").otherwise("mid").alias("tertile"))


@add(f"{V}, i AS (SELECT assay, dms_score, row_number() OVER (PARTITION BY assay ORDER BY dms_score) - 1 AS i, count(*) OVER (PARTITION BY assay) AS n FROM variants) SELECT assay, {r('max(CASE WHEN i = round_even(0.75 * (n - 1), 0) THEN dms_score END)')} AS q75 FROM i GROUP BY 1")
def nearest_rank_quantile(spark, sf):
    q = K.at_index(X.variants(spark, sf), ["assay"], "dms_score", F.bround(F.lit(0.75) * (F.col("n") - 1), 0), "q75")
    return rounded(q)


_RUNS = f"""WITH {X.TRAJECTORIES}, h AS (SELECT policy, seed, min(CASE WHEN hit = 1 THEN round END) AS first_round, min(CASE WHEN hit = 1 THEN n_observed END) AS labels_to_hit,
max(n_observed) AS final_cost, max(hit) AS hit FROM traj GROUP BY 1, 2)"""


@add(f"{_RUNS} SELECT * FROM h")
def first_hit(spark, sf, t=None):
    t = (t or X.trajectories(spark, sf)).withColumn("hit", F.col("hit") == 1)
    return K.first_hit(t, ["policy", "seed"], "round", "hit", "n_observed")


@add(f"{_RUNS} SELECT policy, count(*) AS n_runs, {r('avg(hit)')} AS hit_rate, {r('avg(coalesce(labels_to_hit, final_cost))')} AS mean_labels FROM h GROUP BY 1")
def hit_time_summary(spark, sf, t=None):
    h = first_hit(spark, sf, t)
    return rounded(h.groupBy("policy").agg(F.count("*").alias("n_runs"), F.avg("hit").alias("hit_rate"), F.avg(F.coalesce("labels_to_hit", "final_cost")).alias("mean_labels")))


@add(f"WITH {X.TRAJECTORIES} SELECT policy, seed, round, best, {r('(SELECT count(*) FROM traj p WHERE p.policy = t.policy AND p.value <= t.best)::DOUBLE / (SELECT count(*) FROM traj p WHERE p.policy = t.policy)')} AS percentile FROM traj t")
def best_so_far(spark, sf):
    t = X.trajectories(spark, sf)
    # the best value so far is one of the pool's own values, so its share below is looked up by value
    w = Window.partitionBy("policy").orderBy("value")
    share = t.select("policy", F.col("value").alias("best"), F.cume_dist().over(w).alias("percentile")).distinct()
    return t.join(share, ["policy", "best"]).select("policy", "seed", "round", "best", r6(F.col("percentile")).alias("percentile"))


@add(f"{V} SELECT assay, mutant, round((m_qty - avg(m_qty) OVER w) / CASE WHEN stddev_pop(m_qty) OVER w = 0 THEN 1 ELSE stddev_pop(m_qty) OVER w END, 5) + 0.0 AS z FROM variants WINDOW w AS (PARTITION BY assay)")
def group_zscore(spark, sf):
    return X.variants(spark, sf).select("assay", "mutant", (F.round(K.zscore("m_qty", ["assay"]), 5) + F.lit(0.0)).alias("z"))


# -- metrics --------------------------------------------------------------------------------------


@add(f"{VL} SELECT assay, method, {r(corr('dms_score', 'score'))} AS pearson FROM long GROUP BY 1, 2")
def pearson_guarded(spark, sf):
    return rounded(long(spark, sf).groupBy(*AM).agg(M.pearson("dms_score", "score").alias("pearson")))


def spearman_sql(source: str, by: str, truth: str = "dms_score", pred: str = "score") -> str:
    return f"(SELECT {by}, count(*) AS n, {corr('rt', 'rp')} AS spearman FROM (SELECT *, {midrank(truth, by)} AS rt, {midrank(pred, by)} AS rp FROM {source} WHERE {truth} IS NOT NULL AND {pred} IS NOT NULL) GROUP BY {by})"


@add(f"{VL} SELECT assay, method, n, {r('spearman')} AS spearman, {r('abs(spearman)')} AS abs_spearman FROM {spearman_sql('long', 'assay, method')}")
def spearman(spark, sf):
    return rounded(M.spearman(long(spark, sf), AM, "dms_score", "score"))


_SUBSETS = "subs AS (SELECT *, unnest(CASE WHEN ord = 2 THEN ['all', 'double'] WHEN ord > 2 THEN ['all', 'higher'] ELSE ['all'] END) AS subset FROM long)"


def subsets(df):
    kind = F.when(F.col("ord") == 2, F.array(F.lit("all"), F.lit("double"))).when(F.col("ord") > 2, F.array(F.lit("all"), F.lit("higher"))).otherwise(F.array(F.lit("all")))
    return df.withColumn("subset", F.explode(kind))


@add(f"{VL}, {_SUBSETS} SELECT assay, method, subset, n, {r('spearman')} AS spearman FROM {spearman_sql('subs', 'assay, method, subset')}")
def spearman_by_order(spark, sf):
    return rounded(M.spearman(subsets(long(spark, sf)), [*AM, "subset"], "dms_score", "score").drop("abs_spearman"))


def ranked_sql(source: str, by: str, name: str = "rk", item: str = "mutant") -> str:
    w = f"PARTITION BY {by}"
    return f"""{name} AS (SELECT *, row_number() OVER ({w} ORDER BY score DESC, {item}) AS rank_pred, row_number() OVER ({w} ORDER BY dms_score DESC, {item}) AS rank_true,
    count(*) OVER ({w}) AS n, min(dms_score) OVER ({w}) AS lo, max(dms_score) OVER ({w}) AS hi, {midrank('dms_score', by)} AS rt, {midrank('score', by)} AS rp FROM {source})"""


_GAIN = "(pow(2.0, CASE WHEN hi = lo THEN 0.0 ELSE (dms_score - lo) / (hi - lo) END) - 1)"


def top_sql(k: int = 100) -> dict[str, str]:
    inside = f"rank_pred <= least({k}, n)"
    size = lambda p: f"greatest(1, ceil(n * {p}::DOUBLE))"
    rec = lambda p: f"count_if({inside} AND rank_true <= {size(p)})::DOUBLE / count_if(rank_true <= {size(p)})"
    ideal = f"sum(CASE WHEN rank_true <= least({k}, n) THEN {_GAIN} / log2(rank_true + 1.0) END)"
    return {
        "ndcg_at_k": f"CASE WHEN {ideal} = 0 THEN 0.0 ELSE sum(CASE WHEN {inside} THEN {_GAIN} / log2(rank_pred + 1.0) END) / {ideal} END",
        "top1pct_recall_at_k": rec(0.01),
        "top5pct_recall_at_k": rec(0.05),
        "best_true_in_pred_top_k": f"max(CASE WHEN {inside} THEN dms_score END)",
        "mean_true_in_pred_top_k": f"avg(CASE WHEN {inside} THEN dms_score END)",
    }


def top_list(*names: str) -> str:
    return ", ".join(f"{r(top_sql()[x])} AS {x}" for x in names)


def _top_query(*names):
    def run(spark, sf):
        d = M.paired_rows(long(spark, sf), AM, "dms_score", "score", "mutant")
        return rounded(M.top_metrics(d, AM, "dms_score", "score", "mutant", 100).select(*AM, *names))

    return run


for _name, _cols in (("ndcg_at_k", ["ndcg_at_k"]), ("top_pct_recall", ["top1pct_recall_at_k", "top5pct_recall_at_k"]), ("best_mean_in_topk", ["best_true_in_pred_top_k", "mean_true_in_pred_top_k"])):
    add(f"{VL}, {ranked_sql('long', 'assay, method')} SELECT assay, method, {top_list(*_cols)} FROM rk GROUP BY 1, 2", name=_name)(_top_query(*_cols))

_ZS = f"zs AS (SELECT assay, method, count(*) AS n, {corr('rt', 'rp')} AS spearman, count_if(ord = 1) AS n_singles, count_if(ord = 2) AS n_doubles, count_if(ord > 2) AS n_higher_order, " + ", ".join(f"{e} AS {x}" for x, e in top_sql().items()) + " FROM rk GROUP BY 1, 2)"
ZS = f"{ranked_sql('long', 'assay, method')}, {_ZS}"


def zero_shot(df):
    return M.zero_shot_metrics(df, AM, "dms_score", "score", "mutant", "ord")


@add(f"{VL}, {ZS} SELECT assay, method, n, {r('spearman')} AS spearman, {r('abs(spearman)')} AS abs_spearman, n_singles, n_doubles, n_higher_order, {', '.join(f'{r(x)} AS {x}' for x in top_sql())} FROM zs")
def zero_shot_metrics(spark, sf, v=None):
    return rounded(zero_shot(long(spark, sf, v)))


_EXT = f"""{VL}, r0 AS (SELECT *, row_number() OVER w1 AS rank_pred, row_number() OVER w2 AS rank_true, count(*) OVER g AS n,
(dms_score - avg(dms_score) OVER g) / coalesce(nullif(stddev_pop(dms_score) OVER g, 0), 1) AS zt, (score - avg(score) OVER g) / coalesce(nullif(stddev_pop(score) OVER g, 0), 1) AS zp
FROM long WINDOW g AS (PARTITION BY assay, method), w1 AS (PARTITION BY assay, method ORDER BY score DESC, mutant), w2 AS (PARTITION BY assay, method ORDER BY dms_score DESC, mutant)),
q AS (SELECT assay, method, count(*) AS n, {corr('dms_score', 'score')} AS pearson, sqrt(avg((zt - zp) * (zt - zp))) AS rmse_z, avg(abs(zt - zp)) AS mae_z,
count_if(rank_true <= greatest(1, ceil(n * 0.01::DOUBLE)) AND rank_pred <= 10)::DOUBLE / least(10, count(*)) AS h10, count_if(rank_true <= greatest(1, ceil(n * 0.01::DOUBLE)) AND rank_pred <= 20)::DOUBLE / least(20, count(*)) AS h20,
count_if(rank_true <= greatest(1, ceil(n * 0.01::DOUBLE)))::DOUBLE / count(*) AS base,
count_if(rank_true <= greatest(1, ceil(n * 0.1::DOUBLE)) AND rank_pred <= greatest(1, ceil(n * 0.1::DOUBLE)))::DOUBLE / count_if(rank_true <= greatest(1, ceil(n * 0.1::DOUBLE))) AS rec FROM r0 WHERE n >= 20 GROUP BY 1, 2)"""
_EXT_COLS = {"pearson": "pearson", "rmse_z": "rmse_z", "mae_z": "mae_z", "hit_rate_at_10": "h10", "hit_rate_at_20": "h20", "enrichment_at_10": "h10 / base", "enrichment_at_20": "h20 / base", "top10pct_recall": "rec"}


@add(f"{_EXT} SELECT assay, method, n, {', '.join(f'{r(e)} AS {c}' for c, e in _EXT_COLS.items())} FROM q")
def extended_metrics(spark, sf):
    return rounded(M.extended_metrics(long(spark, sf), AM, "dms_score", "score", "mutant"))


_BIN = f"""b0 AS (SELECT *, {midrank('score', 'assay, method')} AS rp, row_number() OVER (PARTITION BY assay, method ORDER BY score DESC, mutant) AS o, count(*) OVER (PARTITION BY assay, method) AS nn FROM long),
b1 AS (SELECT assay, method, count(*) AS n, count_if(dms_score_bin = 1)::DOUBLE AS p, sum(CASE WHEN dms_score_bin = 1 THEN rp END) AS s, count_if(dms_score_bin = 1 AND o <= greatest(1, ceil(nn * 0.1::DOUBLE)))::DOUBLE AS tp,
count_if(dms_score_bin = 0 AND o <= greatest(1, ceil(nn * 0.1::DOUBLE)))::DOUBLE AS fp, count_if(dms_score_bin = 1 AND o <= greatest(1, ceil(nn * 0.01::DOUBLE)))::DOUBLE AS tp1 FROM b0 GROUP BY 1, 2),
b2 AS (SELECT *, n - p AS q, (s - p * (p + 1) / 2.0) / (p * (n - p)) AS auc, p - tp AS fn, n - p - fp AS tn FROM b1 WHERE n >= 10 AND p > 0 AND p < n),
bm AS (SELECT assay, method, n, p / n AS positive_rate, auc, abs(auc - 0.5) AS abs_auc_minus_half, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0) AS mcc_top10pct,
tp / p AS recall_pos_at_top10pct, tp1 / p AS recall_pos_at_top1pct FROM b2)"""
_BCOLS = ["positive_rate", "auc", "abs_auc_minus_half", "mcc_top10pct", "recall_pos_at_top10pct", "recall_pos_at_top1pct"]


def binary(spark, sf, v=None):
    return M.binary_metrics(long(spark, sf, v), AM, "dms_score_bin", "score", "mutant")


def _binary_query(*cols):
    return lambda spark, sf: rounded(binary(spark, sf).select(*AM, "n", *cols))


for _name, _cols in (("auc_rank", ["auc"]), ("mcc_top_fraction", ["mcc_top10pct"]), ("recall_top_fraction", ["recall_pos_at_top10pct", "recall_pos_at_top1pct"]), ("binary_metrics", _BCOLS)):
    add(f"{VL}, {_BIN} SELECT assay, method, n, {', '.join(f'{r(c)} AS {c}' for c in _cols)} FROM bm", name=_name)(_binary_query(*_cols))


@add(f"{VL}, {_BIN} SELECT method, {', '.join(f'{r(f'avg({c})')} AS {c}' for c in _BCOLS)} FROM bm GROUP BY 1")
def binary_summary(spark, sf, v=None):
    return rounded(binary(spark, sf, v).groupBy("method").agg(*[F.avg(c).alias(c) for c in _BCOLS]))


@add(f"{VL}, k AS (SELECT *, row_number() OVER (PARTITION BY assay, method ORDER BY score DESC, mutant) AS o FROM long) SELECT assay, method, {r('count_if(dms_score_bin = 1 AND o <= 100)::DOUBLE / nullif(sum(dms_score_bin), 0)')} AS recall FROM k GROUP BY 1, 2 HAVING count(*) >= 3")
def label_recall_at_k(spark, sf):
    d = written(long(spark, sf).select(*AM, "mutant", "score", "dms_score_bin"), "scores")
    every = d.groupBy(*AM).agg(F.count("*").alias("n"), F.sum("dms_score_bin").alias("labels")).where("n >= 3")
    hits = K.top_k(d, AM, "score", "mutant", 100).groupBy(*AM).agg(F.sum("dms_score_bin").alias("hits"))
    return rounded(every.join(hits, AM).select(*AM, F.try_divide("hits", "labels").alias("recall")))


_BUCKET = "bk AS (SELECT *, CASE ord WHEN 0 THEN 'wt_or_unknown' WHEN 1 THEN 'single' WHEN 2 THEN 'double' ELSE 'higher' END AS bucket FROM longa)"
#: scores with the additive model of all singles as one more method
ADDITIVE = """base AS (SELECT assay, avg(dms_score) AS b FROM variants WHERE ord = 1 GROUP BY 1), eff AS (SELECT assay, mutant AS part, CAST(dms_score - b AS DECIMAL(28,10)) AS e FROM variants JOIN base USING (assay) WHERE ord = 1),
addp AS (SELECT v.assay, v.mutant, CAST(sum(coalesce(e, 0)) AS DOUBLE) AS s FROM (SELECT assay, mutant, unnest(parts) AS part FROM variants) v LEFT JOIN eff USING (assay, part) GROUP BY 1, 2),
additive AS (SELECT v.assay, v.mutant, v.dms_score, v.dms_score_bin, v.ord, 'additive_all_singles' AS method, round(b + s, 9) AS score FROM variants v JOIN addp USING (assay, mutant) JOIN base USING (assay)),
longa AS (SELECT assay, mutant, dms_score, dms_score_bin, ord, method, score FROM long UNION ALL SELECT * FROM additive)"""


def with_additive(spark, sf, v=None):
    from assayscope.operators.additive import additive_scores

    v = v or X.variants(spark, sf)
    o = v.withColumn("ord", S.mutation_order(F.col("mutant")))
    a = additive_scores(o, o.where("ord = 1")).withColumn("method", F.lit("additive_all_singles"))
    cols = ["assay", "mutant", "dms_score", "dms_score_bin", "ord", "method", "score"]
    return X.scores_long(v).select(*cols).unionByName(a.select(*cols))


_S2M = f"{VL}, {ADDITIVE}, {_BUCKET}, {ranked_sql('bk', 'assay, method, bucket')}, sm AS (SELECT assay, method, bucket, count(*) AS n, {corr('rt', 'rp')} AS spearman, {top_sql()['top1pct_recall_at_k']} AS top1pct_recall_at_k FROM rk GROUP BY 1, 2, 3)"


def s2m(spark, sf, v=None):
    d = with_additive(spark, sf, v).withColumn("bucket", S.order_bucket(F.col("ord")))
    by = [*AM, "bucket"]
    d = M.paired_rows(d, by, "dms_score", "score", "mutant")
    recall = M.top_metrics(d, by, "dms_score", "score", "mutant", 100).select(*by, "top1pct_recall_at_k")
    return M.rank_correlation(d, by, "dms_score", "score").join(recall, by)


@add(f"{_S2M} SELECT assay, method, bucket, n, {r('spearman')} AS spearman, {r('top1pct_recall_at_k')} AS top1pct_recall_at_k FROM sm")
def single_to_multi_metrics(spark, sf):
    return rounded(s2m(spark, sf))


@add(f"{_S2M} SELECT method, bucket, count(*) AS n_assays, {r('avg(abs(spearman))')} AS mean_abs_spearman, {r('avg(top1pct_recall_at_k)')} AS mean_recall FROM sm GROUP BY 1, 2")
def single_to_multi_summary(spark, sf, v=None):
    return rounded(s2m(spark, sf, v).groupBy("method", "bucket").agg(F.count("*").alias("n_assays"), F.avg(F.abs("spearman")).alias("mean_abs_spearman"), F.avg("top1pct_recall_at_k").alias("mean_recall")))


# -- summaries ------------------------------------------------------------------------------------

_WIN = "win AS (SELECT method, count(*) AS wins FROM (SELECT assay, method, row_number() OVER (PARTITION BY assay ORDER BY abs(round(spearman, 9)) DESC, method) AS o FROM zs WHERE spearman IS NOT NULL) WHERE o = 1 GROUP BY 1)"
ZS25 = f"{VL25}, {ZS}, {_WIN}"


def wins(zs):
    o = F.row_number().over(Window.partitionBy("assay").orderBy(F.abs(F.round("spearman", 9)).desc(), "method"))
    return zs.where("spearman is not null").withColumn("o", o).where("o = 1").groupBy("method").agg(F.count("*").alias("wins"))


@add(f"{ZS25} SELECT * FROM win")
def assay_wins(spark, sf):
    return wins(zero_shot(long25(spark, sf)))


_SUMMARY = f"""summ AS (SELECT method, count(*) AS n_assays, avg(spearman) AS mean_spearman, median(spearman) AS median_spearman, avg(abs(spearman)) AS mean_abs_spearman, median(abs(spearman)) AS median_abs_spearman,
coalesce(avg(ndcg_at_k), 0.0) AS mean_ndcg, coalesce(avg(top1pct_recall_at_k), 0.0) AS mean_top1pct_recall, coalesce(avg(top5pct_recall_at_k), 0.0) AS mean_top5pct_recall FROM zs GROUP BY 1)"""
_SCOLS = ["mean_spearman", "median_spearman", "mean_abs_spearman", "median_abs_spearman", "mean_ndcg", "mean_top1pct_recall", "mean_top5pct_recall"]


def summary(zs):
    z = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    s = zs.groupBy("method").agg(
        F.count("*").alias("n_assays"), F.avg("spearman").alias("mean_spearman"), F.median("spearman").alias("median_spearman"), F.avg("abs_spearman").alias("mean_abs_spearman"),
        F.median("abs_spearman").alias("median_abs_spearman"), z("ndcg_at_k").alias("mean_ndcg"), z("top1pct_recall_at_k").alias("mean_top1pct_recall"), z("top5pct_recall_at_k").alias("mean_top5pct_recall"),
    )
    return s.join(wins(zs), "method", "left").fillna(0, ["wins"])


@add(f"{ZS25}, {_SUMMARY} SELECT method, n_assays, {', '.join(f'{r(c)} AS {c}' for c in _SCOLS)}, coalesce(wins, 0) AS wins FROM summ LEFT JOIN win USING (method)")
def zero_shot_summary(spark, sf):
    return rounded(summary(zero_shot(long25(spark, sf))))


@add(f"""{ZS25}, {_SUMMARY}, c AS (SELECT *, CASE WHEN starts_with(method, 'm_q') THEN 'volume' WHEN starts_with(method, 'm_t') THEN 'tax' ELSE 'price' END AS category FROM summ LEFT JOIN win USING (method))
SELECT category, count(*) AS n_methods, {r('avg(mean_abs_spearman)')} AS mean_abs_spearman, arg_max(method, mean_abs_spearman) AS best_method, CAST(sum(coalesce(wins, 0)) AS BIGINT) AS wins FROM c GROUP BY 1""")
def zero_shot_category_summary(spark, sf):
    s = summary(zero_shot(long25(spark, sf)))
    c = s.withColumn("category", S.prefix_category(F.col("method"), [("m_q", "volume"), ("m_t", "tax")], "price"))
    return rounded(c.groupBy("category").agg(F.count("*").alias("n_methods"), F.avg("mean_abs_spearman").alias("mean_abs_spearman"), F.max_by("method", "mean_abs_spearman").alias("best_method"), F.sum("wins").alias("wins")))


@add(f"{_EXT} SELECT method, count(*) AS n_assays, {', '.join(f'{r(f"avg({e})")} AS {c}' for c, e in _EXT_COLS.items())} FROM q GROUP BY 1")
def extended_summary(spark, sf, v=None):
    e = M.extended_metrics(long(spark, sf, v), AM, "dms_score", "score", "mutant")
    return rounded(e.groupBy("method").agg(F.count("*").alias("n_assays"), *[F.avg(c).alias(c) for c in _EXT_COLS]))


@add(f"{ZS25.replace('WITH ', f'WITH {X.TYPES}, ', 1)} SELECT assay_type, method, count(*) AS n_assays, {r('avg(abs(spearman))')} AS mean_abs_spearman FROM zs JOIN types USING (assay) GROUP BY 1, 2")
def by_assay_type(spark, sf):
    z = zero_shot(long25(spark, sf)).join(X.assay_types(spark, sf), "assay")
    return rounded(z.groupBy("assay_type", "method").agg(F.count("*").alias("n_assays"), F.avg("abs_spearman").alias("mean_abs_spearman")))


@add(f"{_S2M.replace(VL, f'WITH {X.TYPES}, {X.VARIANTS25}, {X.LONG}', 1)} SELECT assay_type, bucket, method, count(*) AS n_assays, {r('avg(abs(spearman))')} AS mean_abs_spearman FROM sm JOIN types USING (assay) WHERE spearman IS NOT NULL GROUP BY 1, 2, 3")
def single_to_multi_by_assay_type(spark, sf):
    d = s2m(spark, sf, X.variants25(spark, sf)).where("spearman is not null").join(X.assay_types(spark, sf), "assay")
    return rounded(d.groupBy("assay_type", "bucket", "method").agg(F.count("*").alias("n_assays"), F.avg(F.abs("spearman")).alias("mean_abs_spearman")))


@add(f"""{ZS25.replace('WITH ', f'WITH {X.TYPES}, ', 1)}, st AS (SELECT *, CASE WHEN n > 250 THEN 'large' ELSE 'small' END AS size_class, CASE WHEN n_doubles > 30 THEN 'dense' ELSE 'sparse' END AS density FROM zs JOIN types USING (assay)),
g AS (SELECT method, 'assay_type' AS stratum, assay_type AS level, spearman FROM st UNION ALL SELECT method, 'size_class', size_class, spearman FROM st UNION ALL SELECT method, 'density', density, spearman FROM st)
SELECT stratum, level, method, count(*) AS n_assays, {r('avg(abs(spearman))')} AS mean_abs_spearman FROM g GROUP BY 1, 2, 3""")
def by_strata_grouping_sets(spark, sf):
    z = zero_shot(long25(spark, sf)).join(X.assay_types(spark, sf), "assay")
    z = z.withColumns({"size_class": F.when(F.col("n") > 250, "large").otherwise("small"), "density": F.when(F.col("n_doubles") > 30, "dense").otherwise("sparse")})
    g = z.select("method", "abs_spearman", "assay_type", "size_class", "density").unpivot(["method", "abs_spearman"], ["assay_type", "size_class", "density"], "stratum", "level")
    return rounded(g.groupBy("stratum", "level", "method").agg(F.count("*").alias("n_assays"), F.avg("abs_spearman").alias("mean_abs_spearman")))


@add(f"{ZS25}, b AS (SELECT assay, max(abs(spearman)) AS best FROM zs GROUP BY 1), p AS (SELECT assay, {', '.join(f'''max(CASE WHEN method = '{m}' THEN abs(spearman) END) AS {m}''' for m in ('m_qty', 'm_tax'))} FROM zs GROUP BY 1), a AS (SELECT assay, arg_max(method, round(abs(spearman), 9)) AS best_method FROM zs GROUP BY 1) SELECT p.assay, {r('m_qty')} AS m_qty, {r('m_tax')} AS m_tax, best_method, {r('best')} AS best_value FROM p JOIN b USING (assay) JOIN a USING (assay)")
def zero_shot_pivot(spark, sf):
    z = zero_shot(long25(spark, sf))
    p = z.groupBy("assay").pivot("method", ["m_qty", "m_tax"]).agg(F.first("abs_spearman"))
    b = z.groupBy("assay").agg(F.max_by("method", F.round("abs_spearman", 9)).alias("best_method"), F.max("abs_spearman").alias("best_value"))
    return rounded(p.join(b, "assay"))


GAINS = "gains AS (SELECT assay, max(CASE WHEN method IN ('m_qty', 'm_tax') THEN abs(spearman) END) - max(CASE WHEN method IN ('m_disc', 'm_retail') THEN abs(spearman) END) AS gain FROM zs GROUP BY 1)"


def gains(zs):
    best = lambda *m: F.max(F.when(F.col("method").isin(*m), F.col("abs_spearman")))
    return zs.groupBy("assay").agg((best("m_qty", "m_tax") - best("m_disc", "m_retail")).alias("gain"))


@add(f"{ZS25}, {GAINS} SELECT assay, {r('gain')} AS gain FROM gains")
def structure_gain(spark, sf):
    return rounded(gains(zero_shot(long25(spark, sf))))


@add(f"WITH {X.TRAJECTORIES} SELECT policy, round, count(*) AS n, {r('avg(n_observed)')} AS n_observed, {r('avg(best)')} AS best, {r('avg(hit)')} AS hit FROM traj GROUP BY 1, 2")
def active_curve(spark, sf, t=None):
    return rounded((t or X.trajectories(spark, sf)).groupBy("policy", "round").agg(F.count("*").alias("n"), F.avg("n_observed").alias("n_observed"), F.avg("best").alias("best"), F.avg("hit").alias("hit")))


@add(f"WITH {X.TRAJECTORIES}, o AS (SELECT seed, policy, row_number() OVER (PARTITION BY seed ORDER BY best DESC, policy) AS o FROM traj WHERE round = 5) SELECT policy, count(*) AS wins FROM o WHERE o = 1 GROUP BY 1")
def active_final_wins(spark, sf):
    t = X.trajectories(spark, sf).where("round = 5")
    o = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("best").desc(), "policy"))
    return t.withColumn("o", o).where("o = 1").groupBy("policy").agg(F.count("*").alias("wins"))


@add(f"WITH {X.TRAJECTORIES}, p AS (SELECT seed % 10 AS assay, policy, avg(hit) AS rate FROM traj WHERE round = 5 GROUP BY 1, 2) SELECT assay, {r('''max(CASE WHEN policy = 'click' THEN rate END)''')} AS click, {r('''max(CASE WHEN policy = 'view' THEN rate END)''')} AS view, {r('''max(CASE WHEN policy = 'click' THEN rate END) - max(CASE WHEN policy = 'view' THEN rate END)''')} AS gain FROM p GROUP BY 1")
def active_gain(spark, sf):
    t = X.trajectories(spark, sf).where("round = 5").withColumn("assay", F.col("seed") % 10)
    p = t.groupBy("assay").pivot("policy", ["click", "view"]).agg(F.avg("hit")).withColumn("gain", F.col("click") - F.col("view"))
    return rounded(p)
