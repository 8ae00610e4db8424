"""Queries on the additive model, double-mutant residuals and pairwise corrections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_parts, pair_key, site_pair_key
from assayscope.operators import epistasis as E
from assayscope.operators import metrics as M
from assayscope.operators import ranking as K
from assayscope.operators.additive import additive_scores
from assayscope.operators.ordering import positions
from assayscope.plans.ranking import ADDITIVE, VL, corr, midrank, r, ranked_sql, rounded, spearman_sql, subsets, top_sql, with_additive
from assayscope.plans.registry import add
from assayscope.plans.sampling import SPLITS, ordered, splits
from assayscope.sources import fixtures as X
from assayscope.sources.ingest import written

#: Assays with fewer strict doubles are left out, and nations, whose orders are a fifth as many.
LEAST, LEAST25 = 100, 10
#: Fewer reciprocal doubles of a method, doubles of a subset, or doubles of an assay tell nothing of it.
LEAST_RECIPROCAL, LEAST_SUBSET, LEAST_ENRICHED = 20, 50, 100
V = f"WITH {X.VARIANTS}"
def res_sql(least: int) -> str:
    return f"""wt AS (SELECT assay, avg(dms_score) AS wt FROM variants WHERE ord = 1 GROUP BY 1), one AS (SELECT assay, mutant AS part, dms_score AS s FROM variants WHERE ord = 1),
d0 AS (SELECT v.assay, v.mutant, parts[1] AS single_a, parts[2] AS single_b, v.dms_score AS ab, a.s AS a, b.s AS b, wt FROM variants v JOIN one a ON a.assay = v.assay AND a.part = parts[1] JOIN one b ON b.assay = v.assay AND b.part = parts[2] JOIN wt ON wt.assay = v.assay WHERE ord = 2),
d1 AS (SELECT *, round(a + b - wt, 9) AS additive_prediction, count(*) OVER (PARTITION BY assay) AS n FROM d0),
res AS (SELECT *, round(ab - additive_prediction, 9) AS residual, abs(round(ab - additive_prediction, 9)) AS abs_residual, CAST((a - wt) * (ab - b) < 0 OR (b - wt) * (ab - a) < 0 AS INT) AS sign, CAST((a - wt) * (ab - wt) < 0 AND (b - wt) * (ab - wt) < 0 AS INT) AS reciprocal FROM d1 WHERE n >= {least})"""


RES = res_sql(LEAST)
VR = f"{V}, {RES}"
VLR = f"{VL}, {RES}"


def residuals(spark, sf, v=None):
    return E.strict_double_residuals(ordered(v or X.variants(spark, sf)), LEAST)


@add(f"{VR} SELECT assay, mutant, single_a, single_b, {r('ab')} AS score_double, {r('a')} AS score_single_a, {r('b')} AS score_single_b, {r('wt')} AS wt_proxy, {r('additive_prediction')} AS additive_prediction, {r('residual')} AS epistasis_residual, {r('abs_residual')} AS abs_epistasis_residual, sign AS sign_epistasis FROM res")
def strict_double_residuals(spark, sf):
    return rounded(residuals(spark, sf).drop("reciprocal", "n"))


@add(f"{VR} SELECT assay, mutant, sign AS sign_epistasis FROM res")
def sign_epistasis(spark, sf):
    return residuals(spark, sf).select("assay", "mutant", "sign_epistasis")


@add(f"{VLR} SELECT assay, mutant, method, {r('score')} AS score FROM res JOIN long USING (assay, mutant) WHERE reciprocal = 1")
def reciprocal_sign(spark, sf):
    v = X.variants(spark, sf)
    d = E.with_scores(residuals(spark, sf, v).where("reciprocal = 1"), X.scores_long(v))
    return rounded(d.select("assay", "mutant", "method", "score"))


@add(f"""{VLR}, k AS (SELECT method, row_number() OVER (PARTITION BY method ORDER BY score, assay || mutant) AS x, row_number() OVER (PARTITION BY method ORDER BY ab, assay || mutant) AS y FROM res JOIN long USING (assay, mutant) WHERE reciprocal = 1)
SELECT method, count(*) AS n, {r(f"abs({corr('x', 'y')})")} AS abs_spearman FROM k GROUP BY 1 HAVING count(*) >= {LEAST_RECIPROCAL}""")
def reciprocal_summary(spark, sf):
    v = X.variants(spark, sf)
    d = E.with_scores(residuals(spark, sf, v).where("reciprocal = 1"), X.scores_long(v)).withColumn("item", F.concat("assay", "mutant"))
    d = d.withColumns({"x": K.ordinal("score", ["method"], "item"), "y": K.ordinal("score_double", ["method"], "item")})
    return rounded(d.groupBy("method").agg(F.count("*").alias("n"), F.abs(M.pearson("x", "y")).alias("abs_spearman")).where(F.col("n") >= LEAST_RECIPROCAL))


@add(f"{VLR} SELECT assay, method, count(*) AS n, {r('avg(score)')} AS mean_score, {r('avg(residual)')} AS mean_residual FROM res JOIN long USING (assay, mutant) GROUP BY 1, 2")
def score_variant_join(spark, sf):
    v = X.variants(spark, sf)
    d = E.with_scores(residuals(spark, sf, v), X.scores_long(v))
    return rounded(d.groupBy("assay", "method").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("epistasis_residual").alias("mean_residual")))


# correlation of each method with the double's score, residual and |residual|; recall of strong rows
_AM = "assay, method"
EZ = f"""j AS (SELECT assay, mutant, method, score, ab AS dms_score, residual, abs_residual, sign, additive_prediction FROM res JOIN long USING (assay, mutant)),
h AS (SELECT *, {midrank('score', _AM)} AS rp, {midrank('dms_score', _AM)} AS r1, {midrank('residual', _AM)} AS r2, {midrank('abs_residual', _AM)} AS r3, {midrank('additive_prediction', _AM)} AS r4,
row_number() OVER (PARTITION BY {_AM} ORDER BY score DESC, mutant) AS o, count(*) OVER (PARTITION BY {_AM}) AS n, list_sort(list(abs_residual) OVER (PARTITION BY {_AM})) AS sorted FROM j),
t AS (SELECT *, CAST(abs_residual >= sorted[greatest(ceil(n * 0.75::DOUBLE), 1)::INT] AS INT) AS strong FROM h),
ez AS (SELECT assay, method, count(*) AS n, {corr('rp', 'r1')} AS spearman_score, {corr('rp', 'r2')} AS spearman_residual, {corr('rp', 'r3')} AS spearman_abs_residual, {corr('r4', 'r1')} AS spearman_additive,
count_if(strong = 1 AND o <= 100)::DOUBLE / nullif(sum(strong), 0) AS recall_strong, count_if(sign = 1 AND o <= 100)::DOUBLE / nullif(sum(sign), 0) AS recall_sign FROM t GROUP BY 1, 2)"""
_EZ = ["spearman_score", "spearman_residual", "spearman_abs_residual", "spearman_additive", "recall_strong", "recall_sign"]


def epistasis_metrics(spark, sf):
    v = written(X.variants(spark, sf), "variants")
    by = ["assay", "method"]
    d = E.with_scores(residuals(spark, sf, v), X.scores_long(v))
    cut = K.at_index(d.drop("n"), by, "abs_epistasis_residual", F.greatest(F.ceil(F.col("n") * F.lit(0.75)) - 1, F.lit(0)), "cut")
    d = d.join(cut, by)
    d = d.withColumns({"strong": (F.col("abs_epistasis_residual") >= F.col("cut")).cast("int"), "o": K.ordinal("score", by, "mutant", descending=True)})
    ranks = {"rp": "score", "r1": "score_double", "r2": "epistasis_residual", "r3": "abs_epistasis_residual", "r4": "additive_prediction"}
    d = d.withColumns({k: K.midrank(c, by) for k, c in ranks.items()})
    recall = lambda c: F.try_divide(F.count_if((F.col(c) == 1) & (F.col("o") <= 100)), F.sum(c))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), M.pearson("rp", "r1").alias("spearman_score"), M.pearson("rp", "r2").alias("spearman_residual"), M.pearson("rp", "r3").alias("spearman_abs_residual"),
        M.pearson("r4", "r1").alias("spearman_additive"), recall("strong").alias("recall_strong"), recall("sign_epistasis").alias("recall_sign"),
    )


@add(f"{VLR}, {EZ} SELECT assay, method, n, {', '.join(f'{r(c)} AS {c}' for c in _EZ)}, {r('abs(spearman_score) - abs(spearman_additive)')} AS gain FROM ez")
def epistasis_zero_shot(spark, sf):
    return rounded(epistasis_metrics(spark, sf).withColumn("gain", F.abs("spearman_score") - F.abs("spearman_additive")))


@add(f"{VLR}, {EZ}, g AS (SELECT *, abs(spearman_score) - abs(spearman_additive) AS gain FROM ez) SELECT method, {r('avg(abs(spearman_score))')} AS mean_abs, {r('avg(coalesce(gain, 0))')} AS mean_gain, count_if(gain > 1e-9) AS n_gain, {r('avg(recall_strong)')} AS recall_strong FROM g GROUP BY 1")
def epistasis_method_summary(spark, sf):
    g = epistasis_metrics(spark, sf).withColumn("gain", F.abs("spearman_score") - F.abs("spearman_additive"))
    return rounded(g.groupBy("method").agg(F.avg(F.abs("spearman_score")).alias("mean_abs"), F.avg(F.coalesce("gain", F.lit(0.0))).alias("mean_gain"), F.count_if(F.col("gain") > 1e-9).alias("n_gain"), F.avg("recall_strong").alias("recall_strong")))


EPI_SUMMARY = "SELECT assay, count(*) AS n, avg(abs_residual) AS mean_abs, median(abs_residual) AS median_abs, CAST(sum(sign) AS BIGINT) AS n_sign, avg(sign) AS sign_fraction FROM res GROUP BY 1"


def epi_summary(res):
    return res.groupBy("assay").agg(F.count("*").alias("n"), F.avg("abs_epistasis_residual").alias("mean_abs"), F.median("abs_epistasis_residual").alias("median_abs"), F.sum("sign_epistasis").alias("n_sign"), F.avg("sign_epistasis").alias("sign_fraction"))


@add(f"{VR}, e AS ({EPI_SUMMARY}) SELECT assay, n, {r('mean_abs')} AS mean_abs, {r('median_abs')} AS median_abs, n_sign, {r('sign_fraction')} AS sign_fraction FROM e")
def epistasis_assay_summary(spark, sf):
    return rounded(epi_summary(residuals(spark, sf)))


# metrics inside a subset of the doubles; the additive prediction is one more method
_SUBSETS = {"high": "abs_residual >= cut", "sign": "sign = 1"}
_GUARD = {"high": 1, "sign": LEAST_SUBSET}


def _subset_sql(where: str, least: int = 1) -> str:
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY assay ORDER BY abs_residual) - 1 AS i FROM res), cut AS (SELECT assay, max(CASE WHEN i = least(n - 1, floor(n * 0.75::DOUBLE)) THEN abs_residual END) AS cut FROM q GROUP BY 1),
chosen AS (SELECT assay, mutant, ab, residual, additive_prediction FROM res JOIN cut USING (assay) WHERE {where}),
sub AS (SELECT assay, mutant, method, score, ab, residual FROM chosen JOIN long USING (assay, mutant) UNION ALL SELECT assay, mutant, 'additive_prediction', additive_prediction, ab, residual FROM chosen),
so AS (SELECT assay, method, {midrank('score', _AM)} AS rp, {midrank('ab', _AM)} AS rt, {midrank('residual', _AM)} AS rr, row_number() OVER (PARTITION BY {_AM} ORDER BY score DESC, mutant) AS o,
row_number() OVER (PARTITION BY {_AM} ORDER BY ab DESC, mutant) <= greatest(1, ceil(count(*) OVER (PARTITION BY {_AM}) * 0.01::DOUBLE)) AS top FROM sub),
m AS (SELECT assay, method, count(*) AS n, {corr('rp', 'rt')} AS spearman, {corr('rp', 'rr')} AS spearman_residual, count_if(top AND o <= 100)::DOUBLE / count_if(top) AS recall FROM so GROUP BY 1, 2 HAVING count(*) >= {least})"""


def _subset(spark, sf, which, v=None, res=None):
    v = v or written(X.variants(spark, sf), "variants")
    d = res or residuals(spark, sf, v)
    if which == "high":
        cut = K.at_index(d.drop("n"), ["assay"], "abs_epistasis_residual", F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.75))), "cut")
        d = d.join(cut, "assay").where("abs_epistasis_residual >= cut")
    else:
        d = d.where("sign_epistasis = 1")
    by = ["assay", "method"]
    keep = [*by, "mutant", "score", "score_double", "epistasis_residual"]
    s = E.with_scores(d, X.scores_long(v)).select(*keep).unionByName(d.withColumns({"method": F.lit("additive_prediction"), "score": F.col("additive_prediction")}).select(*keep))
    s = s.withColumns({"rp": K.midrank("score", by), "rt": K.midrank("score_double", by), "rr": K.midrank("epistasis_residual", by), "n": F.count("*").over(Window.partitionBy(*by))})
    s = s.withColumns({"o": K.ordinal("score", by, "mutant", descending=True), "top": K.ordinal("score_double", by, "mutant", descending=True) <= M.top_size(F.col("n"), 0.01)})
    return s.groupBy(*by).agg(
        F.count("*").alias("n"), M.pearson("rp", "rt").alias("spearman"), M.pearson("rp", "rr").alias("spearman_residual"),
        (F.count_if(F.col("top") & (F.col("o") <= 100)) / F.count_if("top")).alias("recall"),
    ).where(F.col("n") >= _GUARD[which]).withColumn("abs_spearman", F.abs("spearman"))


for _name, _which in (("high_residual_metrics", "high"), ("sign_subset_metrics", "sign")):
    add(f"{VLR}, {_subset_sql(_SUBSETS[_which], _GUARD[_which])} SELECT assay, method, n, {r('spearman')} AS spearman, {r('abs(spearman)')} AS abs_spearman, {r('spearman_residual')} AS spearman_residual, {r('recall')} AS recall FROM m", name=_name)(
        lambda spark, sf, which=_which: rounded(_subset(spark, sf, which))
    )


@add(f"{VLR} " + " UNION ALL ".join(f"(WITH {_subset_sql(w, _GUARD[k])} SELECT '{k}' AS subset, method, count(*) AS n_assays, {r('avg(abs(spearman))')} AS mean_abs_spearman, {r('avg(spearman_residual)')} AS mean_spearman_residual, {r('avg(recall)')} AS mean_recall FROM m WHERE spearman IS NOT NULL GROUP BY 2)" for k, w in _SUBSETS.items()))
def residual_subset_summary(spark, sf):
    v = written(X.variants(spark, sf), "variants")
    res = written(residuals(spark, sf, v), "residuals")
    both = [_subset(spark, sf, k, v, res).where("spearman is not null").groupBy(F.lit(k).alias("subset"), "method").agg(F.count("*").alias("n_assays"), F.avg("abs_spearman").alias("mean_abs_spearman"), F.avg("spearman_residual").alias("mean_spearman_residual"), F.avg("recall").alias("mean_recall")) for k in _SUBSETS]
    return rounded(both[0].unionByName(both[1]))


KS = [10, 20, 50, 100]
#: Fewer doubles of an assay, or fewer scored ones of a method, tell nothing.
LEAST_RANKED = 50
_HD = f"""{VLR}, hh AS (SELECT assay, mutant, additive_prediction, n, CAST(row_number() OVER (PARTITION BY assay ORDER BY abs_residual DESC, mutant DESC) <= greatest(1, ceil(0.25::DOUBLE * n)) AS INT) AS strong,
CAST(residual > 0 AND row_number() OVER (PARTITION BY assay ORDER BY residual DESC, mutant DESC) <= greatest(1, ceil(0.1::DOUBLE * n)) AS INT) AS positive, sign, sum(sign) OVER (PARTITION BY assay) AS signs FROM res WHERE n >= {LEAST_RANKED}),
hk AS (SELECT assay, mutant, additive_prediction, n, unnest(['strong', 'positive', 'sign']) AS kind, unnest([strong, positive, CASE WHEN signs > 0 THEN sign ELSE strong END]) AS hit FROM hh),
ht AS (SELECT *, sum(hit) OVER (PARTITION BY assay, kind) AS total FROM hk),
hs AS (SELECT assay, mutant, method, score FROM hh JOIN long USING (assay, mutant) UNION ALL SELECT assay, mutant, 'additive_prediction', additive_prediction FROM hh),
ho AS (SELECT *, row_number() OVER (PARTITION BY assay, method ORDER BY score DESC, mutant DESC) AS o, count(*) OVER (PARTITION BY assay, method) AS m FROM hs),
hd AS (SELECT assay, method, kind, k, CAST(max(total) AS DOUBLE) / max(n) AS base_rate, CAST(sum(CASE WHEN o <= k THEN hit END) AS DOUBLE) / least(k, max(m)) AS hit_rate,
CAST(sum(CASE WHEN o <= k THEN hit END) * max(n) AS DOUBLE) / nullif(CAST(least(k, max(m)) * max(total) AS DOUBLE), 0) AS enrichment FROM ho JOIN ht USING (assay, mutant), (VALUES (10), (20), (50), (100)) ks(k) WHERE m >= {LEAST_RANKED} GROUP BY 1, 2, 3, 4)"""


def hit_discovery(spark, sf):
    """Strong, positive and sign hits of every assay among the doubles that a method, or the additive prediction,
    ranks first. Without a sign hit the strong ones stand in."""
    v = written(X.variants(spark, sf), "variants")
    res = residuals(spark, sf, v).where(F.col("n") >= LEAST_RANKED)
    top = lambda c, share: K.ordinal(c, ["assay"], "mutant", True, True) <= M.top_size(F.col("n"), share)
    d = res.withColumns({"strong": top("abs_epistasis_residual", 0.25).cast("int"), "positive": (top("epistasis_residual", 0.1) & (F.col("epistasis_residual") > 0)).cast("int")})
    d = d.withColumn("sign", F.when(F.sum("sign_epistasis").over(Window.partitionBy("assay")) > 0, F.col("sign_epistasis")).otherwise(F.col("strong")))
    kinds = ["strong", "positive", "sign"]
    d = d.select("assay", "mutant", "n", *kinds).unpivot(["assay", "mutant", "n"], kinds, "kind", "hit").withColumn("total", F.sum("hit").over(Window.partitionBy("assay", "kind")))
    scores = E.with_scores(res.select("assay", "mutant"), X.scores_long(v)).unionByName(res.select("assay", "mutant", F.lit("additive_prediction").alias("method"), F.col("additive_prediction").alias("score")))
    scores = scores.withColumn("m", F.count("*").over(Window.partitionBy("assay", "method"))).where(F.col("m") >= LEAST_RANKED)
    return E.enrichment(scores.join(d, ["assay", "mutant"]), ["assay", "method", "kind"], "score", "hit", "mutant", KS, "n", "total")


@add(f"{_HD} SELECT assay, method, kind, k, {r('base_rate')} AS base_rate, {r('hit_rate')} AS hit_rate, {r('enrichment')} AS enrichment FROM hd")
def epistatic_hit_discovery(spark, sf):
    return rounded(hit_discovery(spark, sf))


@add(f"{_HD} SELECT method, kind, k, count(*) AS n_assays, {r('avg(hit_rate)')} AS mean_hit_rate, {r('avg(enrichment)')} AS mean_enrichment FROM hd GROUP BY 1, 2, 3")
def epistatic_hit_summary(spark, sf):
    return rounded(hit_discovery(spark, sf).groupBy("method", "kind", "k").agg(F.count("*").alias("n_assays"), F.avg("hit_rate").alias("mean_hit_rate"), F.avg("enrichment").alias("mean_enrichment")))


_EU = f"""{VLR}, s AS (SELECT assay, mutant, method, (row_number() OVER (PARTITION BY assay, method ORDER BY score, mutant) - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY assay, method) - 1) AS s FROM (SELECT assay, mutant, method, score FROM res JOIN long USING (assay, mutant))),
a0 AS (SELECT assay, mutant, (row_number() OVER (PARTITION BY assay ORDER BY additive_prediction, mutant) - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY assay) - 1) AS add_rank FROM res),
u0 AS (SELECT assay, mutant, round(avg(s), 9) AS mean, round(coalesce(stddev_samp(s), 0), 9) AS std, round(abs(max(CASE WHEN method = 'm_qty' THEN s END) - max(CASE WHEN method = 'm_retail' THEN s END)), 9) AS split FROM s GROUP BY 1, 2),
eu AS (SELECT u0.*, round(abs(add_rank - mean), 9) AS disagreement FROM u0 JOIN a0 USING (assay, mutant))"""


def uncertainty(spark, sf):
    v = X.variants(spark, sf)
    res = residuals(spark, sf, v).drop("n")
    s = E.with_scores(res, X.scores_long(v)).withColumn("s", K.rank_scale("score", ["assay", "method"], "mutant"))
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("s")))
    u = s.groupBy("assay", "mutant").agg(F.round(F.avg("s"), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("s"), F.lit(0.0)), 9).alias("std"), F.round(F.abs(of("m_qty") - of("m_retail")), 9).alias("split"))
    a = res.withColumn("add_rank", K.rank_scale("additive_prediction", ["assay"], "mutant"))
    return u.join(a, ["assay", "mutant"]).withColumn("disagreement", F.round(F.abs(F.col("add_rank") - F.col("mean")), 9))


@add(f"{_EU} SELECT assay, mutant, {r('mean')} AS mean, {r('std')} AS std, {r('split')} AS split, {r('disagreement')} AS disagreement FROM eu")
def ensemble_uncertainty(spark, sf):
    return rounded(uncertainty(spark, sf).select("assay", "mutant", "mean", "std", "split", "disagreement"))


_UE = f"""{_EU}, c AS (SELECT assay, list_sort(list(abs_residual))[floor(0.75::DOUBLE * (count(*) - 1))::INT + 1] AS cut FROM res GROUP BY 1),
x AS (SELECT assay, mutant, CAST(abs_residual >= cut AS INT) AS hit, mean, std, split, disagreement FROM res JOIN c USING (assay) JOIN eu USING (assay, mutant)),
y AS (SELECT assay, mutant, hit, kind, score FROM x UNPIVOT (score FOR kind IN (mean, std, split, disagreement))),
z AS (SELECT *, row_number() OVER (PARTITION BY assay, kind ORDER BY score DESC, mutant DESC) AS o FROM y),
w AS (SELECT assay, kind, k, avg(hit) AS base_rate, avg(CASE WHEN o <= k THEN hit END) AS hit_rate, CAST(sum(CASE WHEN o <= k THEN hit END) * count(*) AS DOUBLE) / nullif(CAST(least(k, count(*)) * sum(hit) AS DOUBLE), 0) AS enrichment FROM z, (VALUES (10), (50), (100)) ks(k) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST_ENRICHED})"""


@add(f"{_UE} SELECT assay, kind, k, {r('base_rate')} AS base_rate, {r('hit_rate')} AS hit_rate, {r('enrichment')} AS enrichment FROM w")
def uncertainty_enrichment(spark, sf):
    u = written(uncertainty(spark, sf), "uncertainty")
    u = u.join(u.groupBy("assay").count().where(F.col("count") >= LEAST_ENRICHED).select("assay"), "assay", "left_semi")
    cut = K.at_index(u, ["assay"], "abs_epistasis_residual", F.floor(F.lit(0.75) * (F.col("n") - 1)), "cut")
    u = u.join(cut, "assay").withColumn("hit", (F.col("abs_epistasis_residual") >= F.col("cut")).cast("int"))
    kinds = ["mean", "std", "split", "disagreement"]
    u = u.select("assay", "mutant", "hit", *kinds).unpivot(["assay", "mutant", "hit"], kinds, "kind", "score")
    return rounded(E.enrichment(u, ["assay", "kind"], "score", "hit", "mutant", [10, 50, 100]))


# -- additive model on splits -----------------------------------------------------------------------

_K = "assay, seed, budget, regime"
ADD_SPLIT = f"""tr AS (SELECT s.*, dms_score, ord FROM splits s JOIN variants USING (assay, mutant)),
tb AS (SELECT {_K}, coalesce(avg(CASE WHEN ord = 1 THEN dms_score END), avg(dms_score)) AS b, count(*) AS n_train FROM tr GROUP BY {_K}),
te AS (SELECT {_K}, mutant AS part, CAST(dms_score - b AS DECIMAL(28,10)) AS e FROM tr JOIN tb USING ({_K}) WHERE ord = 1),
held AS (SELECT tb.assay, seed, budget, regime, b, n_train, v.mutant, v.parts, v.ord, v.dms_score FROM tb JOIN variants v ON v.assay = tb.assay ANTI JOIN splits s ON s.assay = tb.assay AND s.seed = tb.seed AND s.budget = tb.budget AND s.regime = tb.regime AND s.mutant = v.mutant),
ts AS (SELECT {_K}, mutant, CAST(sum(e) AS DOUBLE) AS s FROM (SELECT {_K}, mutant, unnest(parts) AS part FROM held) JOIN te USING ({_K}, part) GROUP BY {_K}, mutant),
adds AS (SELECT h.*, round(b + coalesce(s, 0), 9) AS score FROM held h LEFT JOIN ts USING ({_K}, mutant))"""
_KEYS = ["assay", "seed", "budget", "regime"]


def heldout(spark, sf, v=None):
    """(training rows, held-out rows) of every split, with scores of the variants."""
    v = written(ordered(v or X.variants(spark, sf)), "variants")
    s = written(splits(spark, sf, v.drop("ord")), "splits")
    train = s.join(v, ["assay", "mutant"])
    # a row per split, and its budget of rows: variants stay where they are
    test = v.join(F.broadcast(s.select(*_KEYS).distinct()), "assay").join(F.broadcast(s.select(*_KEYS, "mutant")), [*_KEYS, "mutant"], "left_anti")
    return train, test


_ALK = f"{V}, {SPLITS}, {ADD_SPLIT}, subs AS (SELECT *, unnest(CASE WHEN ord = 2 THEN ['all', 'double'] WHEN ord > 2 THEN ['all', 'higher'] ELSE ['all'] END) AS subset FROM adds), m AS {spearman_sql('subs', _K + ', subset')}"


@add(f"{_ALK} SELECT {_K}, subset, n, {r('spearman')} AS spearman FROM m")
def additive_lookup(spark, sf):
    import numpy as np
    import pyarrow as pa

    from assayscope.operators import heldout as H
    from assayscope.plans.calibration import split_rows

    v, keys, rows = split_rows(spark, sf)
    if H.fits_a_task(v, ["dms_score"]):

        def judged(rows, m):
            held, y, s, o = rows.held(m), rows["dms_score"], rows.additive(m), rows["ord"]
            by_truth, by_score = rows.ascending("dms_score"), H.along(s)
            for subset, mask in (("all", held), ("double", held & (o == 2)), ("higher", held & (o > 2))):
                if mask.any():
                    rt = H.centred(y, by_truth[mask[by_truth]])
                    yield pa.table({"split": [m["split"]], "subset": [subset], "n": [int(mask.sum())], "spearman": pa.array([H.spearman(rt, s, by_score[mask[by_score]])], "float64")})

        found = H.by_seed(v, written(H.models(keys, rows), "models"), ["dms_score", "ord"], judged, "split int, subset string, n long, spearman double")
        return rounded(found.join(F.broadcast(keys), "split").select(*_KEYS, "subset", "n", "spearman"))
    train, test = heldout(spark, sf)
    return rounded(M.spearman(subsets(additive_scores(test, train, _KEYS, few=True)), [*_KEYS, "subset"], "dms_score", "score").drop("abs_spearman"))


@add(f"{VL}, {ADDITIVE} SELECT assay, mutant, {r('score')} AS score FROM additive")
def additive_all_singles(spark, sf):
    return rounded(with_additive(spark, sf).where("method = 'additive_all_singles'").select("assay", "mutant", "score"))


# -- pairwise correction ----------------------------------------------------------------------------

PAIR_SEEDS, PAIR_BUDGETS = [0, 1, 2, 3, 4], [20, 50, 100]
_RUN = "assay, policy, seed, budget"
_PAIRS = f"""hp AS (SELECT assay, mutant, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM variants WHERE ord > 2),
hk AS (SELECT x.assay, x.mutant, least(x.part, y.part) || ':' || greatest(x.part, y.part) AS pair FROM hp x JOIN hp y ON x.assay = y.assay AND x.mutant = y.mutant AND x.i < y.i),
pf AS (SELECT assay, pair, count(*) AS freq FROM hk GROUP BY 1, 2), dp AS (SELECT *, least(single_a, single_b) || ':' || greatest(single_a, single_b) AS pair FROM res),
po AS (SELECT assay, mutant, pair, residual, 'random_doubles' AS policy, seed, row_number() OVER (PARTITION BY assay, seed ORDER BY md5(concat_ws('|', assay, seed, mutant)), mutant) AS o FROM dp, (VALUES {', '.join(f'({x})' for x in PAIR_SEEDS)}) s(seed)
UNION ALL SELECT assay, mutant, pair, residual, 'informative_pair_coverage', -1, row_number() OVER (PARTITION BY assay ORDER BY coalesce(freq, 0) DESC, mutant) FROM dp LEFT JOIN pf USING (assay, pair)),
pb(budget) AS (VALUES {', '.join(f'({x})' for x in PAIR_BUDGETS)}), pu AS (SELECT {_RUN}, CAST(count_if(o <= budget) AS BIGINT) AS n_train FROM po, pb GROUP BY {_RUN}),
kb AS (SELECT hk.assay, hk.mutant, policy, seed, budget, CAST(sum(CAST(residual AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS m, count(*) AS known FROM hk JOIN po USING (assay, pair) JOIN pb ON o <= budget GROUP BY 1, 2, 3, 4, 5),
pw AS (SELECT a.assay, a.mutant, policy, seed, budget, n_train, a.dms_score, round(a.score + coalesce(m, 0), 9) AS score, coalesce(known, 0) AS known, CAST(ord * (ord - 1) / 2 AS BIGINT) AS pairs FROM additive a JOIN pu USING (assay) LEFT JOIN kb USING (assay, mutant, policy, seed, budget) WHERE ord > 2
UNION ALL SELECT assay, mutant, 'none', -1, 0, 0, dms_score, score, 0, CAST(ord * (ord - 1) / 2 AS BIGINT) FROM additive WHERE ord > 2 AND assay IN (SELECT assay FROM res))"""


RUN = ["assay", "policy", "seed", "budget"]
#: Tasks that share an assay's runs.
LANES = 3


def pairwise_models(spark, sf):
    """(variants numbered within their assay, the higher ones of assays with doubles enough, doubles in each policy's order,
    one row per assay, policy and seed: its additive model and measured pairs), all written."""
    from assayscope.operators import heldout as H

    v = written(positions(ordered(X.variants(spark, sf)), ["assay"], ["mutant"], "item"), "variants")
    res = written(E.strict_double_residuals(v, LEAST).drop("n"), "residuals")
    # a row per assay
    higher = v.where("ord > 2").join(F.broadcast(res.select("assay").distinct()), "assay", "left_semi")
    orders = written(E.pair_orders(res, higher, PAIR_SEEDS, max(PAIR_BUDGETS)), "orders")
    parts = mutation_parts(F.col("mutant"))
    pair = F.struct("o", F.get(parts, 0).alias("a"), F.get(parts, 1).alias("b"), F.col("epistasis_residual").alias("value"))
    runs = orders.groupBy("assay", "policy", "seed").agg(F.collect_list(pair).alias("measured"))
    plain = res.select("assay", F.lit("none").alias("policy"), F.lit(-1).alias("seed"), F.array().cast(dict(runs.dtypes)["measured"]).alias("measured")).distinct()
    # the additive model of all singles; their own residuals are not looked at
    one = v.where("ord = 1").withColumn("split", F.col("assay"))
    model = H.models(v.select("assay", F.lit(0).alias("seed"), F.col("assay").alias("split")).distinct(), one).select("assay", "base", "effects")
    return v, higher, orders, written(runs.unionByName(plain).join(model, "assay"), "models")


def run_scores(rows, m):
    """(budget, known pairs, scores of the variants) of each of a run's budgets; the plain additive model has the budget 0."""
    from assayscope.operators import heldout as H

    score = rows.additive(m)
    for budget, known, mean in rows.pair_means(m["measured"], [0] if m["policy"] == "none" else PAIR_BUDGETS):
        for at in rows.chunks():
            mean[at] = H.half_up(score[at] + mean[at], 9)
        yield budget, known, mean


def by_lane(higher, models, columns, judged, schema):
    """What judged(variants, run) yields, an assay's runs dealt to LANES tasks, which hold its numbers."""
    from assayscope.operators import heldout as H

    m = models.withColumns({"of": F.col("seed"), "seed": F.pmod(F.col("seed") + 1, F.lit(LANES))})
    return H.by_seed(higher, m, ["dms_score", "ord", *columns], judged, schema)


def pairwise(v, orders):
    """Scores of the higher variants for each run, written, for assays of any size."""
    higher = written(additive_scores(v.where("ord > 2"), v.where("ord = 1")).join(orders.select("assay").distinct(), "assay", "left_semi"), "higher")
    plain = higher.select("*", F.lit("none").alias("policy"), F.lit(-1).alias("seed"), F.lit(0).alias("budget"), F.lit(0).cast("long").alias("known"), F.col("score").alias("pairwise_score"), (F.col("ord") * (F.col("ord") - 1) / 2).cast("long").alias("pairs"))
    return written(E.pair_corrections(higher, orders, PAIR_BUDGETS).unionByName(plain), "pairwise")


def per_seed(df):
    """The run that knows no seed stands for all of them; the additive model has none."""
    seeds = F.when(F.col("policy") == "informative_pair_coverage", F.array(*map(F.lit, PAIR_SEEDS))).when(F.col("seed") < 0, F.array(F.lit(None).cast("int"))).otherwise(F.array("seed"))
    return df.withColumn("seed", F.explode(seeds))


def _per_seed_sql(source: str) -> str:
    return f"(SELECT * EXCLUDE (seed), unnest(CASE WHEN policy = 'informative_pair_coverage' THEN {PAIR_SEEDS} WHEN seed < 0 THEN [NULL] ELSE [seed] END) AS seed FROM {source})"


_PWM = f"""{VLR}, {ADDITIVE}, {_PAIRS}, m AS {spearman_sql('pw', _RUN)}, t AS (SELECT *, row_number() OVER (PARTITION BY {_RUN} ORDER BY score DESC, mutant) <= 100 AS first, row_number() OVER (PARTITION BY {_RUN} ORDER BY dms_score DESC, mutant) <= greatest(1, ceil(count(*) OVER (PARTITION BY {_RUN}) * 0.01::DOUBLE)) AS top FROM pw),
c AS (SELECT {_RUN}, any_value(n_train) AS n_train, sum(known)::DOUBLE / sum(pairs) AS coverage, count_if(first AND top)::DOUBLE / count_if(top) AS recall FROM t GROUP BY {_RUN}),
pm AS (SELECT assay, policy, seed, budget, CASE WHEN policy = 'none' THEN 'additive_all_singles' ELSE 'pairwise_residual_from_doubles' END AS model, n_train, n, spearman, recall, coverage FROM m JOIN c USING ({_RUN}))"""


def pairwise_metrics(spark, sf):
    """Metrics of every run. An assay's runs are ordered in a few tasks, which hold its numbers; assays beyond H.WHOLE variants
    are ordered by Spark."""
    import numpy as np
    import pyarrow as pa

    from assayscope.operators import heldout as H

    v, higher, orders, models = pairwise_models(spark, sf)
    trained = orders.groupBy("assay", "policy", "seed").agg(F.count("*").alias("doubles"))
    if H.fits_a_task(higher, ["dms_score"]):

        def judged(rows, m):
            y, n = rows["dms_score"], len(rows)
            rt = rows.once("rt", lambda: H.centred(y, rows.ascending("dms_score")))
            top = rows.once("top", lambda: H.marked(n, H.highest(y, rows.ascending("dms_score"), max(1, int(np.ceil(n * 0.01))))))
            pairs = rows.once("pairs", lambda: sum(int((o * (o - 1) // 2).sum()) for o in (rows["ord"][at].astype(np.int64) for at in rows.chunks())))
            for budget, known, score in run_scores(rows, m):
                at = H.along(score)
                yield pa.table({
                    "assay": [m["assay"]], "policy": [m["policy"]], "seed": [m["of"]], "budget": [budget], "n": [n], "spearman": pa.array([H.spearman(rt, score, at)], "float64"),
                    "recall": [float(top[H.highest(score, at, 100)].sum() / top.sum())], "coverage": [float(known.sum(dtype=np.int64) / pairs)],
                })

        m = by_lane(higher, models, [], judged, "assay string, policy string, seed int, budget int, n long, spearman double, recall double, coverage double")
    else:
        d = pairwise(v, orders).select(*RUN, "mutant", "dms_score", F.col("pairwise_score").alias("score"), "known", "pairs")
        recall = M.top_metrics(d, RUN, "dms_score", "score", "mutant", 100, {"recall": 0.01}).select(*RUN, "recall")
        m = M.rank_correlation(d, RUN, "dms_score", "score").join(recall, RUN).join(d.groupBy(*RUN).agg((F.sum("known") / F.sum("pairs")).alias("coverage")), RUN)
    m = m.join(F.broadcast(trained), ["assay", "policy", "seed"], "left").withColumn("n_train", F.coalesce(F.least("doubles", "budget"), F.lit(0)).cast("long"))
    return m.withColumn("model", F.when(F.col("policy") == "none", "additive_all_singles").otherwise("pairwise_residual_from_doubles")).drop("doubles")


@add(f"{_PWM} SELECT assay, seed, budget, model, policy, n_train, n, {r('spearman')} AS spearman, {r('abs(spearman)')} AS abs_spearman, {r('recall')} AS top1pct_recall, {r('coverage')} AS pair_coverage FROM {_per_seed_sql('pm')}")
def pairwise_residual(spark, sf):
    m = per_seed(pairwise_metrics(spark, sf)).withColumnsRenamed({"recall": "top1pct_recall", "coverage": "pair_coverage"})
    return rounded(m.withColumn("abs_spearman", F.abs("spearman")))


@add(f"{_PWM} SELECT model, policy, budget, count(*) AS n_rows, {r('avg(abs(spearman))')} AS mean_abs_spearman, {r('avg(recall)')} AS mean_recall, {r('avg(coverage)')} AS mean_coverage FROM {_per_seed_sql('pm')} GROUP BY 1, 2, 3")
def pairwise_summary(spark, sf):
    g = per_seed(pairwise_metrics(spark, sf)).groupBy("model", "policy", "budget")
    return rounded(g.agg(F.count("*").alias("n_rows"), F.avg(F.abs("spearman")).alias("mean_abs_spearman"), F.avg("recall").alias("mean_recall"), F.avg("coverage").alias("mean_coverage")))


# the base of each run and one score, fitted on the singles and the measured doubles (or the singles alone),
# judged on higher orders
_RM = f"{_RUN}, method"
_PCM = f"""{VLR}, {ADDITIVE}, {_PAIRS}, ru AS (SELECT DISTINCT {_RUN} FROM pw),
tr AS (SELECT ru.*, a.mutant, a.dms_score, a.score AS a FROM ru JOIN additive a USING (assay) WHERE a.ord = 1 UNION ALL SELECT {_RUN}, po.mutant, a.dms_score, round(a.score + residual, 9) FROM po JOIN pb ON o <= budget JOIN additive a USING (assay, mutant)),
tz AS (SELECT tr.*, method, l.score AS z FROM tr JOIN long l USING (assay, mutant)), pm AS (SELECT {_RM}, avg(a) AS ma, avg(z) AS mz, avg(dms_score) AS my FROM tz GROUP BY {_RM}),
ps AS (SELECT {_RM}, ma, mz, my, sum((a - ma) * (a - ma)) + 1e-8 AS aa, sum((z - mz) * (z - mz)) + 1e-8 AS zz, sum((a - ma) * (z - mz)) AS az, sum((a - ma) * (dms_score - my)) AS ay, sum((z - mz) * (dms_score - my)) AS zy FROM tz JOIN pm USING ({_RM}) GROUP BY {_RM}, ma, mz, my),
pf2 AS (SELECT *, (ay * zz - az * zy) / (aa * zz - az * az) AS sa, (aa * zy - az * ay) / (aa * zz - az * az) AS sz FROM ps),
pq AS (SELECT {', '.join('pw.' + c for c in _RUN.split(', '))}, l.method, pw.mutant, pw.dms_score, round(my - sa * ma - sz * mz + sa * pw.score + sz * l.score, 6) AS score FROM pw JOIN long l USING (assay, mutant) JOIN pf2 ON pf2.assay = pw.assay AND pf2.policy = pw.policy AND pf2.seed = pw.seed AND pf2.budget = pw.budget AND pf2.method = l.method), m AS {spearman_sql('pq', _RM)},
cm AS (SELECT * REPLACE (CASE WHEN policy = 'none' THEN 'singles_only' ELSE policy END AS policy) FROM m)"""


def pairwise_training(v, orders, runs):
    """Training rows of every run: all singles with their additive prediction, and the doubles it has measured,
    whose one pair is known."""
    one = v.where("ord = 1")
    base = additive_scores(v.where("ord <= 2"), one).select("assay", "mutant", "dms_score", "score", *X.METHODS)
    singles = base.join(one.select("assay", "mutant"), ["assay", "mutant"], "left_semi").withColumn("base", F.col("score")).join(runs, "assay")
    taken = orders.withColumn("budget", F.explode(F.array(*map(F.lit, PAIR_BUDGETS)))).where("o <= budget").select("assay", "mutant", "policy", "seed", "budget", "epistasis_residual")
    doubles = base.join(taken, ["assay", "mutant"]).withColumn("base", F.round(F.col("score") + F.col("epistasis_residual"), 9)).drop("epistasis_residual")
    return singles.unionByName(doubles).drop("score")


def pair_runs(models):
    """assay, policy, seed, budget of every run."""
    budgets = F.when(F.col("policy") == "none", F.array(F.lit(0))).otherwise(F.array(*map(F.lit, PAIR_BUDGETS)))
    return models.select("assay", "policy", "seed", F.explode(budgets).alias("budget"))


@add(f"{_PCM} SELECT assay, seed, budget, policy, method, n, {r('spearman')} AS spearman FROM {_per_seed_sql('cm')}")
def pairwise_calibrated(spark, sf):
    import numpy as np
    import pyarrow as pa

    from assayscope.operators import heldout as H
    from assayscope.operators.calibration import linear_2

    v, higher, orders, models = pairwise_models(spark, sf)
    long = lambda d, *keep: d.select(*RUN, *keep, "base", *X.METHODS).unpivot([*RUN, *keep, "base"], X.METHODS, "method", "z")
    train = pairwise_training(v, orders, pair_runs(models))
    fit = linear_2(long(train, "dms_score"), [*RUN, "method"], "base", "z", "dms_score").drop("n_train")
    if H.fits_a_task(higher, ["dms_score", *X.METHODS]):

        def judged(rows, m):
            rt = rows.once("rt", lambda: H.centred(rows["dms_score"], rows.ascending("dms_score")))
            fits = m["fits"] or []
            for budget, _, base in run_scores(rows, m):
                for f in (f for f in fits if f["budget"] == budget):
                    of = lambda c, f=f: np.nan if f[c] is None else f[c]
                    score = rows.each(lambda at, f=f, of=of: H.half_up(of("intercept") + of("slope_a") * base[at] + of("slope_z") * rows[f["method"]][at], 6))
                    yield pa.table({"assay": [m["assay"]], "policy": [m["policy"]], "seed": [m["of"]], "budget": [budget], "method": [f["method"]], "n": [len(rows)], "spearman": pa.array([H.spearman(rt, score, H.along(score))], "float64")})

        fits = fit.groupBy("assay", "policy", "seed").agg(F.collect_list(F.struct("budget", "method", "intercept", "slope_a", "slope_z")).alias("fits"))
        fitted = written(models.join(fits, ["assay", "policy", "seed"]), "fitted")
        m = by_lane(higher, fitted, X.METHODS, judged, "assay string, policy string, seed int, budget int, method string, n long, spearman double")
    else:
        p = pairwise(v, orders)
        rows = long(p.withColumn("base", F.col("pairwise_score")), "mutant", "dms_score").join(fit, [*RUN, "method"])
        rows = rows.withColumn("score", F.round(F.col("intercept") + F.col("slope_a") * F.col("base") + F.col("slope_z") * F.col("z"), 6))
        m = M.spearman(rows, [*RUN, "method"], "dms_score", "score").drop("abs_spearman")
    return rounded(per_seed(m.withColumn("policy", F.when(F.col("policy") == "none", "singles_only").otherwise(F.col("policy")))))


@add()
def pairwise_ensemble(spark, sf):
    """The base of each run and all scores, fitted on the singles and the measured doubles, as predictions of the
    higher orders."""
    import numpy as np
    import pyarrow as pa

    from assayscope.operators import heldout as H
    from assayscope.operators.calibration import RIDGE, ridge_weights

    names = ["base", *X.METHODS]
    v, higher, orders, models = pairwise_models(spark, sf)
    train = written(pairwise_training(v, orders, pair_runs(models)).dropna(subset=names), "training")
    # standardised on the training rows: the fit is the same, its equations are better conditioned
    stats = train.groupBy(*RUN).agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("a", F.avg), ("s", F.stddev_pop))])
    z = train.join(stats, RUN).withColumns({c: (F.col(c) - F.col(f"{c}_a")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")) for c in names})
    z = z.select(*RUN, "mutant", "dms_score", *names).unpivot([*RUN, "mutant", "dms_score"], names, "feature", "value")
    weights = ridge_weights(z, RUN, "mutant", "dms_score", RIDGE).groupBy(*RUN).agg(F.collect_list(F.struct("feature", "weight")).alias("weights"))
    fits = weights.join(stats, RUN).groupBy("assay", "policy", "seed").agg(F.collect_list(F.struct("budget", "weights", *[f"{c}_{n}" for c in names for n in "as"])).alias("fits"))

    def predict(rows, m):
        fits = {f["budget"]: f for f in m["fits"]}
        for budget, _, base in run_scores(rows, m):
            if budget not in fits:
                continue
            f = fits[budget]
            w = {x["feature"]: x["weight"] for x in f["weights"]}
            score = np.full(len(rows), w[""])
            for c in names:
                score = score + w[c] * ((base if c == "base" else rows[c]) - f[f"{c}_a"]) / (f[f"{c}_s"] or 1.0)
            there = np.flatnonzero(~np.isnan(score))
            yield pa.table({"run": np.full(len(there), m["run"]), "budget": np.full(len(there), budget), "mutant": rows.table["mutant"].take(there), "score": H.half_up(score[there], 4)})

    # some runs per assay
    m = written(models.join(fits, ["assay", "policy", "seed"]).withColumn("run", F.row_number().over(Window.orderBy("assay", "policy", "seed"))), "fitted")
    found = H.by_block(higher, m, ["mutant", *X.METHODS], predict, "run int, budget int, mutant string, score double")
    return found.join(F.broadcast(m.select("run", "assay", "policy", "seed")), "run").select(*RUN, "mutant", "score")


@add(f"""{VR}, hp AS (SELECT assay, mutant, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM variants WHERE ord > 2),
f AS (SELECT x.assay, least(x.part, y.part) || ':' || greatest(x.part, y.part) AS pair, count(*) AS freq FROM hp x JOIN hp y ON x.assay = y.assay AND x.mutant = y.mutant AND x.i < y.i GROUP BY 1, 2),
o AS (SELECT res.assay, mutant, coalesce(freq, 0) AS freq, row_number() OVER (PARTITION BY res.assay ORDER BY coalesce(freq, 0) DESC, mutant) AS rank FROM res LEFT JOIN f ON f.assay = res.assay AND f.pair = least(single_a, single_b) || ':' || greatest(single_a, single_b)) SELECT * FROM o""")
def informative_doubles(spark, sf):
    v = ordered(X.variants(spark, sf))
    d = E.strict_double_residuals(v, LEAST).withColumn("pair", pair_key(F.col("single_a"), F.col("single_b"))).join(E.pair_frequencies(v.where("ord > 2")), ["assay", "pair"], "left")
    d = d.withColumn("freq", F.coalesce("freq", F.lit(0)))
    return d.select("assay", "mutant", "freq", K.ordinal("freq", ["assay"], "mutant", descending=True).alias("rank"))


SELECT_SEEDS, SELECT_BUDGETS = [0, 1, 2, 3, 4], [20, 50, 100]
#: Mean |residual| from which an assay counts as strongly epistatic, and the doubles that must be left to judge by.
STRONG_MEAN, LEFT = 1.0, 50
_SK = "assay, policy, seed, budget"
_POL = {"random": "md5(concat_ws('|', 'random', assay, seed, budget, mutant))", "extreme": "-round(abs(additive_prediction - add_mean), 9)", "coverage": "md5(concat_ws('|', 'coverage', assay, seed, budget, mutant))", "oracle": "-abs_residual"}
_POLS = " UNION ALL ".join(f"SELECT assay, mutant, '{p}' AS policy, seed, budget, row_number() OVER (PARTITION BY assay, seed, budget ORDER BY {o}, mutant) AS o FROM rg" for p, o in _POL.items())
_MEAN = "CAST(sum(CAST({} AS DECIMAL(28,10))) AS DOUBLE) / count(*)"
_DS = f"""{VR}, rm AS (SELECT assay, {_MEAN.format('additive_prediction')} AS add_mean, {_MEAN.format('abs_residual')} AS abs_mean FROM res GROUP BY 1),
rs AS (SELECT res.*, add_mean, CASE WHEN abs_mean >= {STRONG_MEAN} THEN 'high_epistasis' ELSE 'low_mid_epistasis' END AS epistasis_bin, array_to_string(list_sort([single_a[2:-2], single_b[2:-2]]), ':') AS site FROM res JOIN rm USING (assay)),
rg AS (SELECT rs.*, seed, budget FROM rs, (VALUES {', '.join(f'({x})' for x in SELECT_SEEDS)}) s(seed), (VALUES {', '.join(f'({x})' for x in SELECT_BUDGETS)}) b(budget) WHERE n >= budget + {LEFT}),
po AS ({_POLS}), ch AS (SELECT * FROM po WHERE o <= budget),
cs AS (SELECT {_SK}, site, {_MEAN.format('residual')} AS v FROM ch JOIN rs USING (assay, mutant) GROUP BY {_SK}, site),
ca AS (SELECT {_SK}, {_MEAN.format('residual')} AS fallback FROM ch JOIN rs USING (assay, mutant) GROUP BY {_SK}),
he AS (SELECT rs.assay, rs.mutant, rs.site, rs.epistasis_bin, rs.ab AS dms_score, rs.additive_prediction, ca.policy, ca.seed, ca.budget, fallback FROM rs JOIN ca ON ca.assay = rs.assay ANTI JOIN ch ON ch.assay = rs.assay AND ch.policy = ca.policy AND ch.seed = ca.seed AND ch.budget = ca.budget AND ch.mutant = rs.mutant),
hs AS (SELECT he.*, round(additive_prediction + coalesce(v, fallback), 9) AS score FROM he LEFT JOIN cs USING ({_SK}, site)),
ma AS {spearman_sql('hs', _SK, pred='additive_prediction')}, mc AS {spearman_sql('hs', _SK)},
ho AS (SELECT *, row_number() OVER (PARTITION BY {_SK} ORDER BY score DESC, mutant) <= 100 AS by_score, row_number() OVER (PARTITION BY {_SK} ORDER BY additive_prediction DESC, mutant) <= 100 AS by_add,
row_number() OVER (PARTITION BY {_SK} ORDER BY dms_score DESC, mutant) <= greatest(1, ceil(count(*) OVER (PARTITION BY {_SK}) * 0.01::DOUBLE)) AS top FROM hs),
hr AS (SELECT {_SK}, epistasis_bin, count_if(top AND by_score)::DOUBLE / count_if(top) AS recall, count_if(top AND by_add)::DOUBLE / count_if(top) AS recall_add FROM ho GROUP BY {_SK}, epistasis_bin),
ds AS (SELECT {_SK}, epistasis_bin, mc.n, mc.spearman, mc.spearman - ma.spearman AS delta, recall, recall - recall_add AS delta_recall FROM mc JOIN ma USING ({_SK}) JOIN hr USING ({_SK}))"""


def selection(spark, sf):
    """Held-out quality of the pair correction learned from doubles that each policy picks, against the additive
    prediction alone."""
    mean = lambda c: F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count("*")
    res = written(E.strict_double_residuals(ordered(X.variants(spark, sf)), LEAST), "residuals").withColumn("site", site_pair_key(F.array("single_a", "single_b")))
    means = res.groupBy("assay").agg(mean("additive_prediction").alias("add_mean"), F.when(mean("abs_epistasis_residual") >= STRONG_MEAN, "high_epistasis").otherwise("low_mid_epistasis").alias("epistasis_bin"))
    res = res.join(means, "assay")
    runs = spark.createDataFrame([(s, b) for s in SELECT_SEEDS for b in SELECT_BUDGETS], "seed int, budget int")
    grid = res.join(F.broadcast(runs), F.col("n") >= F.col("budget") + LEFT)
    drawn = lambda p: F.md5(F.concat_ws("|", F.lit(p), "assay", "seed", "budget", "mutant"))
    orders = {"random": drawn("random"), "extreme": -F.round(F.abs(F.col("additive_prediction") - F.col("add_mean")), 9), "coverage": drawn("coverage"), "oracle": -F.col("abs_epistasis_residual")}
    picked = None
    for p, o in orders.items():
        one = grid.select("assay", "seed", "budget", "mutant", "site", "epistasis_residual", F.lit(p).alias("policy"), F.row_number().over(Window.partitionBy("assay", "seed", "budget").orderBy(o, "mutant")).alias("o"))
        picked = one if picked is None else picked.unionByName(one)
    ch = picked.where("o <= budget")
    key = ["assay", "policy", "seed", "budget"]
    held = res.drop("n").join(ch.groupBy(*key).agg(mean("epistasis_residual").alias("fallback")), "assay").join(ch.select(*key, "mutant"), [*key, "mutant"], "left_anti")
    held = held.join(ch.groupBy(*key, "site").agg(mean("epistasis_residual").alias("v")), [*key, "site"], "left")
    held = held.withColumn("score", F.round(F.col("additive_prediction") + F.coalesce("v", "fallback"), 9))
    first = lambda c: K.ordinal(c, key, "mutant", descending=True)
    d = held.withColumns({"m": F.count("*").over(Window.partitionBy(*key)), "o_score": first("score"), "o_add": first("additive_prediction"), "o_true": first("score_double")})
    d = d.withColumns({"r_score": K.midrank("score", key), "r_add": K.midrank("additive_prediction", key), "r_true": K.midrank("score_double", key)})
    top = F.col("o_true") <= M.top_size(F.col("m"), 0.01)
    recall = lambda o: F.count_if(top & (F.col(o) <= 100)) / F.count_if(top)
    return d.groupBy(*key, "epistasis_bin").agg(
        F.count("*").alias("n"), M.pearson("r_true", "r_score").alias("spearman"), (M.pearson("r_true", "r_score") - M.pearson("r_true", "r_add")).alias("delta"),
        recall("o_score").alias("recall"), (recall("o_score") - recall("o_add")).alias("delta_recall"),
    )


@add(f"{_DS} SELECT {_SK}, epistasis_bin, n, {r('spearman')} AS spearman, {r('delta')} AS delta, {r('recall')} AS recall, {r('delta_recall')} AS delta_recall FROM ds")
def double_selection(spark, sf):
    return rounded(selection(spark, sf))


@add(f"{_DS} SELECT policy, budget, epistasis_bin, count(*) AS n_runs, {r('avg(delta)')} AS mean_delta, {r('avg(delta_recall)')} AS mean_delta_recall, {r('avg(spearman)')} AS mean_spearman FROM ds GROUP BY 1, 2, 3")
def double_selection_summary(spark, sf):
    g = selection(spark, sf).groupBy("policy", "budget", "epistasis_bin")
    return rounded(g.agg(F.count("*").alias("n_runs"), F.avg("delta").alias("mean_delta"), F.avg("delta_recall").alias("mean_delta_recall"), F.avg("spearman").alias("mean_spearman")))
