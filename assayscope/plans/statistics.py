"""Queries on bootstrap intervals, paired tests and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayscope.operators import metrics as M
from assayscope.operators import ranking as K
from assayscope.operators import resampling as S
from assayscope.operators.epistasis import with_scores
from assayscope.operators.sampling import sample_k
from assayscope.plans.epistasis import LEAST_RECIPROCAL, VLR, residuals
from assayscope.plans.ranking import ZS25, corr, long25, r, rounded, zero_shot
from assayscope.plans.registry import add
from assayscope.sources import fixtures as X
from assayscope.sources import ingest as I
from assayscope.sources.ingest import written

DRAWS = 1000
#: Candidates of a nation that are judged where it has more.
CANDIDATES = 500


def _hash(*key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8))::BIGINT"


# values of a group: |spearman| of a method over the nations
_ABS = "vals AS (SELECT assay, method, round(abs(spearman), 9) AS v FROM zs WHERE spearman IS NOT NULL)"


def values(spark, sf):
    return zero_shot(long25(spark, sf)).where("spearman is not null").select("assay", "method", F.round("abs_spearman", 9).alias("v"))


@add(f"""{ZS25}, {_ABS}, bd AS (SELECT method, v, row_number() OVER (PARTITION BY method ORDER BY assay) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM vals),
bg AS (SELECT DISTINCT method, n, b, j FROM bd, range({DRAWS}) t(b), range(25) u(j) WHERE j < n), bm AS (SELECT bg.method, b, CAST(sum(CAST(v AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS m FROM bg JOIN bd ON bd.method = bg.method AND bd.i = {_hash('bg.method', 'b', 'j')} % bg.n GROUP BY 1, 2),
bc AS (SELECT method, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY 1) SELECT method, count(*) AS n, {r('avg(v)')} AS mean, {r('any_value(lo)')} AS lo, {r('any_value(hi)')} AS hi FROM vals JOIN bc USING (method) GROUP BY 1""")
def bootstrap_mean_ci(spark, sf):
    return rounded(S.bootstrap_mean_ci(values(spark, sf), ["method"], "assay", "v", DRAWS))


_STEPS = " + ".join(f"(x >= {t})::INT" for t in S.POISSON_STEPS)


# the scores of all variants of an assay: too many for drawing row by row
@add(f"""WITH {X.VARIANTS}, h AS (SELECT assay, CAST(dms_score AS DECIMAL(28,10)) AS v, {_hash("'boot'", 'assay', 'mutant')} % {S.PRIME} AS r FROM variants),
x0 AS (SELECT assay, v, r, b, (r + b * {S.STRIDE}) % {S.PRIME} AS x FROM h, range({DRAWS}) t(b)), x1 AS (SELECT assay, v, b, (x * x + r) % {S.PRIME} AS x FROM x0), x2 AS (SELECT assay, v, b, (x * x + b) % {S.PRIME} AS x FROM x1), w AS (SELECT assay, b, v, {_STEPS} AS w FROM x2),
m AS (SELECT assay, b, CAST(sum(v * w) AS DOUBLE) / sum(w) AS m FROM w GROUP BY 1, 2), c AS (SELECT assay, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)
SELECT assay, count(*) AS n, {r('avg(dms_score)')} AS mean, {r('any_value(lo)')} AS lo, {r('any_value(hi)')} AS hi FROM variants JOIN c USING (assay) GROUP BY 1""")
def bootstrap_scores_ci(spark, sf):
    v = written(X.variants(spark, sf).select("assay", "mutant", "dms_score"), "variants")
    return rounded(S.bootstrap_weights_ci(v, ["assay"], "mutant", "dms_score", DRAWS))


@add(f"{ZS25}, {_ABS} SELECT method, {r('quantile_cont(v, 0.1)')} AS p10, {r('quantile_cont(v, 0.5)')} AS p50, {r('quantile_cont(v, 0.9)')} AS p90 FROM vals GROUP BY 1")
def interpolated_percentile(spark, sf):
    v = values(spark, sf)
    return rounded(v.groupBy("method").agg(*[F.percentile("v", q / 100).alias(f"p{q}") for q in (10, 50, 90)]))


_PM = "pm AS (SELECT a.assay, a.v - b.v AS d FROM vals a JOIN vals b ON a.assay = b.assay WHERE a.method = 'm_qty' AND b.method = 'm_tax')"


def paired(spark, sf):
    p = values(spark, sf).groupBy("assay").pivot("method", ["m_qty", "m_tax"]).agg(F.first("v"))
    return p.dropna().select("assay", (F.col("m_qty") - F.col("m_tax")).alias("d"))


@add(f"{ZS25}, {_ABS}, {_PM} SELECT assay, {r('d')} AS difference FROM pm")
def paired_method_join(spark, sf):
    return rounded(paired(spark, sf).withColumnRenamed("d", "difference"))


def permutation_sql(source: str, by: str, item: str, exact: int, flips: int) -> str:
    return f"""pv AS (SELECT {by}, {item}, d, round(d * 1e9)::BIGINT AS v FROM {source} WHERE d IS NOT NULL), pe AS (SELECT {by}, avg(d) AS mean_difference FROM pv GROUP BY 1),
pz AS (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY {item}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM pv WHERE v <> 0), pt AS (SELECT {by}, abs(sum(v)) AS seen, max(n) AS n FROM pz GROUP BY 1),
pp AS (SELECT {by}, seen, unnest(range(CASE WHEN n <= {exact} THEN 1::BIGINT << least(n, {exact})::INT ELSE {flips} END)) AS perm FROM pt),
ps AS (SELECT pp.{by}, perm, any_value(seen) AS seen, any_value(n) AS n, abs(sum(CASE WHEN (CASE WHEN n <= {exact} THEN (perm & (1::BIGINT << least(i, 62)::INT)) <> 0 ELSE {_hash(f'pp.{by}', 'perm', 'i')} % 2 = 1 END) THEN v ELSE -v END)) AS a FROM pp JOIN pz ON pz.{by} = pp.{by} GROUP BY 1, 2),
ph AS (SELECT {by}, any_value(n) AS n, CASE WHEN any_value(n) <= {exact} THEN count_if(a >= seen)::DOUBLE / count(*) ELSE (count_if(a >= seen) + 1)::DOUBLE / (count(*) + 1) END AS p FROM ps GROUP BY 1)
SELECT {by}, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('mean_difference')} AS mean_difference, {r('coalesce(p, 1.0)')} AS p_value FROM pe LEFT JOIN ph USING ({by})"""


_PTY = "pty AS (SELECT assay_type, assay, d FROM pm JOIN types USING (assay) UNION ALL SELECT 'ALL', assay, d FROM pm)"


@add(f"{ZS25.replace('WITH ', f'WITH {X.TYPES}, ', 1)}, {_ABS}, {_PM}, {_PTY}, {permutation_sql('pty', 'assay_type', 'assay', 20, 50000)}")
def paired_permutation(spark, sf):
    d = paired(spark, sf).join(X.assay_types(spark, sf), "assay").select("assay_type", "assay", "d")
    d = d.unionByName(d.withColumn("assay_type", F.lit("ALL")))
    return rounded(S.paired_permutation(d, ["assay_type"], "assay", "d", 20, 50_000).withColumn("n", F.col("n").cast("long")))


@add(f"""{VLR}, k AS (SELECT assay, method, row_number() OVER (PARTITION BY assay, method ORDER BY score, mutant) AS x, row_number() OVER (PARTITION BY assay, method ORDER BY ab, mutant) AS y FROM res JOIN long USING (assay, mutant)),
rho AS (SELECT assay, method, round(abs({corr('x', 'y')}), 9) AS v FROM k GROUP BY 1, 2 HAVING count(*) >= {LEAST_RECIPROCAL}), rd AS (SELECT 'all' AS grp, a.assay, a.v - b.v AS d FROM rho a JOIN rho b ON a.assay = b.assay WHERE a.method = 'm_qty' AND b.method = 'm_retail'), {permutation_sql('rd', 'grp', 'assay', 20, 50000)}""")
def reciprocal_paired_test(spark, sf):
    v = X.variants(spark, sf)
    d = with_scores(residuals(spark, sf, v), X.scores_long(v))
    by = ["assay", "method"]
    d = d.withColumns({"x": K.ordinal("score", by, "mutant"), "y": K.ordinal("score_double", by, "mutant")})
    rho = d.groupBy(*by).agg(F.round(F.abs(M.pearson("x", "y")), 9).alias("v"), F.count("*").alias("n")).where(F.col("n") >= LEAST_RECIPROCAL).drop("n")
    p = rho.groupBy("assay").pivot("method", ["m_qty", "m_retail"]).agg(F.first("v"))
    p = p.select(F.lit("all").alias("grp"), "assay", (F.col("m_qty") - F.col("m_retail")).alias("d"))
    return rounded(S.paired_permutation(p, ["grp"], "assay", "d", 20, 50_000).withColumn("n", F.col("n").cast("long")))


# -- quality checks ----------------------------------------------------------------------------------

#: The summaries that are checked: their keys, and the columns that should lie between 0 and 1. Errors of
#: z-scores and enrichments needn't, so that the check has something to find.
CHECKED = {
    "zero_shot_metrics": (["assay", "method"], ["abs_spearman", "ndcg_at_k", "top1pct_recall_at_k", "top5pct_recall_at_k"]),
    "zero_shot_summary": (["method"], ["mean_spearman", "mean_abs_spearman", "mean_ndcg", "mean_top1pct_recall"]),
    "binary_summary": (["method"], ["auc", "mcc_top10pct", "recall_pos_at_top10pct"]),
    "extended_summary": (["method"], ["pearson", "rmse_z", "hit_rate_at_10", "enrichment_at_10"]),
    "single_to_multi_summary": (["method", "bucket"], ["mean_abs_spearman", "mean_recall"]),
    "hit_time_summary": (["policy"], ["hit_rate"]),
    "active_curve": (["policy", "round"], ["hit"]),
}


def _qc_sql() -> str:
    from assayscope.plans.registry import _SQL

    one = lambda s, keys, cols: f"""(SELECT '{s}' AS summary, row_no, field, value FROM (SELECT row_number() OVER (ORDER BY {', '.join(keys)}) AS row_no, {', '.join(f'{c}::DOUBLE AS {c}' for c in cols)} FROM ({_SQL[s]})) UNPIVOT (value FOR field IN ({', '.join(cols)})) WHERE value < 0 OR value > 1)"""
    return " UNION ALL ".join(one(s, *c) for s, c in CHECKED.items())


@add(_qc_sql())
def qc_range_check(spark, sf):
    """Summaries of the same rows share them, and each is written, as numbering its rows looks at it twice."""
    from assayscope.plans.registry import _QUERIES

    v, t = written(X.variants(spark, sf), "variants"), written(X.trajectories(spark, sf), "trajectories")
    shared = {"zero_shot_summary": [], "hit_time_summary": [t], "active_curve": [t]}
    tables = {s: written(_QUERIES[s](spark, sf, *shared.get(s, [v])), s) for s in CHECKED}
    found = [I.out_of_range(tables[s], *c).select(F.lit(s).alias("summary"), "row_no", "field", "value") for s, c in CHECKED.items()]
    return reduce(DataFrame.unionByName, found)


@add(f"WITH {X.VARIANTS25}, g AS (SELECT assay, count(*) AS n FROM variants GROUP BY 1), f AS (SELECT assay, least(n, {CANDIDATES}) AS n, CAST(n > {CANDIDATES} AS INT) AS sampled FROM g) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_assays, CAST(sum(sampled) AS BIGINT) AS n_sampled FROM f")
def qc_sampled_counts(spark, sf):
    """Candidates, assays and assays flagged as sampled, where a nation's candidates are cut to CANDIDATES."""
    v = X.variants25(spark, sf).select("assay", "mutant")
    n = v.groupBy("assay").agg(F.count("*").alias("n"))
    kept = sample_k(v, ["assay"], "mutant", CANDIDATES, "large").join(n, "assay")
    flags = kept.groupBy("assay").agg(F.count("*").alias("rows"), F.max((F.col("n") > CANDIDATES).cast("int")).alias("sampled"))
    return flags.agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_assays"), F.sum("sampled").alias("n_sampled"))
