"""Queries that join the assays' features and recommend a strategy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_order, r6
from assayscope.operators import ranking as K
from assayscope.operators.epistasis import strict_double_residuals
from assayscope.plans.epistasis import EPI_SUMMARY, LEAST25, epi_summary, res_sql
from assayscope.plans.ingest import _MANIFEST, _STRICT, manifest
from assayscope.plans.ranking import ZS25, r, rounded, zero_shot
from assayscope.plans.registry import add
from assayscope.sources import fixtures as X
from assayscope.sources.ingest import written

#: one row per assay: counts, epistasis, predictor quality, alignment depth stand-in, type
FEATURES = f"""{ZS25.replace('WITH ', f'WITH {X.TYPES}, ', 1)}, {_STRICT}, {_MANIFEST}, {res_sql(LEAST25)}, epi AS ({EPI_SUMMARY}),
zp AS (SELECT assay, max(CASE WHEN method = 'm_qty' THEN abs(spearman) END) AS zs_qty, max(CASE WHEN method = 'm_tax' THEN abs(spearman) END) AS zs_tax, max(abs(spearman)) AS zs_best FROM zs GROUP BY 1),
cu AS (SELECT 'NATION_' || c_nationkey AS assay, count(*) AS depth FROM customer GROUP BY 1), su AS (SELECT 'NATION_' || s_nationkey AS assay, count(*) AS support FROM supplier GROUP BY 1),
feat AS (SELECT m.assay, assay_type, n_variants, n_order_2 AS n_doubles, n_higher_order, round(mean_abs, 6) AS epi_mean_abs, round(sign_fraction, 6) AS epi_sign, round(zs_qty, 6) AS zs_qty, round(zs_tax, 6) AS zs_tax, round(zs_best, 6) AS zs_best, depth, support
FROM manifest m LEFT JOIN types USING (assay) LEFT JOIN epi USING (assay) LEFT JOIN zp USING (assay) LEFT JOIN cu USING (assay) LEFT JOIN su USING (assay))"""


def features(spark, sf):
    v = written(X.variants25(spark, sf), "variants")
    e = epi_summary(strict_double_residuals(v.withColumn("ord", mutation_order(F.col("mutant"))), LEAST25))
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("abs_spearman")))
    z = zero_shot(X.scores_long(v)).groupBy("assay").agg(of("m_qty").alias("zs_qty"), of("m_tax").alias("zs_tax"), F.max("abs_spearman").alias("zs_best"))
    name = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string")).alias("assay")
    cu = X.table(spark, sf, "customer").groupBy(name("c_nationkey")).agg(F.count("*").alias("depth"))
    su = X.table(spark, sf, "supplier").groupBy(name("s_nationkey")).agg(F.count("*").alias("support"))
    f = manifest(v).select("assay", "n_variants", F.col("n_order_2").alias("n_doubles"), "n_higher_order")
    # one row per assay on every side
    for side in (X.assay_types(spark, sf), e.select("assay", F.round("mean_abs", 6).alias("epi_mean_abs"), F.round("sign_fraction", 6).alias("epi_sign")), z.select("assay", *[F.round(c, 6).alias(c) for c in ("zs_qty", "zs_tax", "zs_best")]), cu, su):
        f = f.join(side, "assay", "left")
    return written(f, "features")  # a small table that every cut reads again


_FCOLS = "assay, assay_type, n_variants, n_doubles, n_higher_order, epi_mean_abs, epi_sign, zs_qty, zs_tax, zs_best, depth, support"


@add(f"{FEATURES} SELECT {_FCOLS} FROM feat")
def decision_features(spark, sf):
    return features(spark, sf)


@add(f"{FEATURES} SELECT assay, zs_qty - zs_tax AS quality_difference, epi_sign - zs_best AS sign_difference FROM (SELECT assay, round(zs_qty - zs_tax, 6) + 0.0 AS d1, zs_qty, zs_tax, epi_sign, zs_best FROM feat)".replace("zs_qty - zs_tax AS quality", "d1 AS quality").replace("epi_sign - zs_best AS sign", f"{r('epi_sign - zs_best')} AS sign"))
def score_difference_features(spark, sf):
    return features(spark, sf).select("assay", r6(F.col("zs_qty") - F.col("zs_tax")).alias("quality_difference"), r6(F.col("epi_sign") - F.col("zs_best")).alias("sign_difference"))


_CUT = "cuts AS (SELECT list_sort(list(epi_mean_abs)) AS l, count(epi_mean_abs) AS n FROM feat WHERE epi_mean_abs IS NOT NULL)"
_STRATA = f"""{_CUT}, strata AS (SELECT assay, CASE WHEN n_higher_order >= 100 THEN 'higher' WHEN n_doubles >= 20 THEN 'double' ELSE 'single' END AS mutation_stratum, CASE WHEN n_doubles / n_variants >= 0.15::DOUBLE THEN 'dense' ELSE 'sparse' END AS double_density,
CASE WHEN epi_mean_abs IS NULL THEN 'missing' WHEN epi_mean_abs <= l[n // 3 + 1] THEN 'low' WHEN epi_mean_abs >= l[2 * n // 3 + 1] THEN 'high' ELSE 'mid' END AS epistasis FROM feat, cuts)"""


def three_way(value: str, lo: str, hi: str):
    v = F.col(value)
    return F.when(v.isNull(), "missing").when(v <= F.col(lo), "low").when(v >= F.col(hi), "high").otherwise("mid")


def with_cuts(f, value: str, lo, hi, prefix: str):
    """Two cut values of a column over all rows, joined to every row."""
    g = f.select(F.lit(1).alias("g"), value)
    cuts = K.at_indexes(g, ["g"], value, **{f"{prefix}_lo": lo, f"{prefix}_hi": hi})
    return f.withColumn("g", F.lit(1)).join(F.broadcast(cuts), "g", "left").drop("g")  # one row


def tertiles(f, value: str, prefix: str):
    return with_cuts(f, value, F.floor(F.col("n") / 3), F.floor(F.col("n") * 2 / 3), prefix)


@add(f"{FEATURES}, {_STRATA} SELECT * FROM strata")
def assay_strata(spark, sf):
    f = tertiles(features(spark, sf), "epi_mean_abs", "epi")
    return f.select(
        "assay", F.when(F.col("n_higher_order") >= 100, "higher").when(F.col("n_doubles") >= 20, "double").otherwise("single").alias("mutation_stratum"),
        F.when(F.col("n_doubles") / F.col("n_variants") >= F.lit(0.15), "dense").otherwise("sparse").alias("double_density"), three_way("epi_mean_abs", "epi_lo", "epi_hi").alias("epistasis"),
    )


# nearest-rank cuts and the ordered rules; comparisons with null are false
_RCUT = "rc AS (SELECT list_sort(list(epi_sign)) AS es, list_sort(list(zs_best)) AS zb, list_sort(list(depth)) AS dp FROM feat), rq AS (SELECT es[round_even((len(es) - 1) * 2 / 3.0, 0)::INT + 1] AS es_hi, zb[round_even((len(zb) - 1) * 2 / 3.0, 0)::INT + 1] AS zb_hi, dp[round_even((len(dp) - 1) / 3.0, 0)::INT + 1] AS dp_lo FROM rc)"
_RULES = "CASE WHEN zs_qty - zs_tax >= {gain} THEN 'structure_first' WHEN epi_sign >= es_hi THEN 'measure_doubles' WHEN zs_best >= zb_hi AND zs_best >= {floor} THEN 'zero_shot' WHEN depth <= dp_lo THEN 'supervised' WHEN n_higher_order > {many} THEN 'pairwise' ELSE 'additive' END"


def rules_sql(gain: str = "0.02", floor: str = "0.1", many: str = "200") -> str:
    return _RULES.format(gain=gain, floor=floor, many=many)


def with_rule_cuts(f):
    up, low = F.bround((F.col("n") - 1) * 2 / F.lit(3.0), 0), F.bround((F.col("n") - 1) / F.lit(3.0), 0)
    for value, index, name in (("epi_sign", up, "es_hi"), ("zs_best", up, "zb_hi"), ("depth", low, "dp_lo")):
        cut = K.at_index(f.select(F.lit(1).alias("g"), value), ["g"], value, index, name)
        f = f.withColumn("g", F.lit(1)).join(F.broadcast(cut), "g", "left").drop("g")
    return f


def strategy(gain=0.02, floor=0.1, many=200):
    lit = lambda x: x if not isinstance(x, (int, float)) else F.lit(x)
    return (
        F.when(F.col("zs_qty") - F.col("zs_tax") >= lit(gain), "structure_first").when(F.col("epi_sign") >= F.col("es_hi"), "measure_doubles")
        .when((F.col("zs_best") >= F.col("zb_hi")) & (F.col("zs_best") >= lit(floor)), "zero_shot").when(F.col("depth") <= F.col("dp_lo"), "supervised")
        .when(F.col("n_higher_order") > lit(many), "pairwise").otherwise("additive")
    )


_DEC = "fd AS (SELECT * REPLACE (zs_qty::DECIMAL(18,6) AS zs_qty, zs_tax::DECIMAL(18,6) AS zs_tax) FROM feat, rq)"
FR = f"{FEATURES}, {_RCUT}, {_DEC}"


def ruled(spark, sf):
    """Features with the rules' cuts; the compared differences are exact decimals."""
    f = with_rule_cuts(features(spark, sf))
    return f.withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("zs_qty", "zs_tax")})


_GAIN, _FLOOR = "0.02::DECIMAL(18,6)", "0.1"


def dec(x: float):
    return F.lit(x).cast("decimal(18,6)")


@add(f"{FR} SELECT assay, {rules_sql(_GAIN)} AS strategy FROM fd")
def recommend_strategy(spark, sf):
    return ruled(spark, sf).select("assay", strategy(dec(0.02)).alias("strategy"))


@add(f"{FEATURES}, {_CUT} SELECT assay, CASE WHEN epi_mean_abs IS NULL THEN 'missing' WHEN epi_mean_abs <= l[n // 3 + 1] THEN 'low' WHEN epi_mean_abs >= l[2 * n // 3 + 1] THEN 'high' ELSE 'mid' END AS bin FROM feat, cuts")
def three_way_bin(spark, sf):
    return tertiles(features(spark, sf), "epi_mean_abs", "epi").select("assay", three_way("epi_mean_abs", "epi_lo", "epi_hi").alias("bin"))


_REC = f"{FR}, {_STRATA}, rec AS (SELECT fd.assay, assay_type, epistasis, {rules_sql(_GAIN)} AS strategy, CAST(zs_best AS DOUBLE) AS zs_best, epi_mean_abs FROM fd JOIN strata USING (assay))"


def recommendations(spark, sf):
    f = tertiles(ruled(spark, sf), "epi_mean_abs", "epi")
    return f.select("assay", "assay_type", three_way("epi_mean_abs", "epi_lo", "epi_hi").alias("epistasis"), strategy(dec(0.02)).alias("strategy"), "zs_best", "epi_mean_abs")


@add(f"{_REC} SELECT assay, assay_type, epistasis, strategy, {r('zs_best')} AS zs_best FROM rec")
def recommendation_table(spark, sf):
    return rounded(recommendations(spark, sf).drop("epi_mean_abs"))


_MODE = "md AS (SELECT {by}, strategy, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, strategy) AS o FROM {src} GROUP BY {by}, strategy)"


def mode_of(df, by: list[str], what: str = "strategy"):
    """The most frequent value of each group; ties go to the smaller value."""
    c = df.groupBy(*by, what).agg(F.count("*").alias("c"))
    o = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("c").desc(), what))
    return c.withColumn("o", o).where("o = 1").select(*by, F.col(what).alias("mode"), F.col("c").alias("mode_count"))


@add(f"{_REC}, {_MODE.format(by='assay_type', src='rec')} SELECT assay_type, strategy AS mode FROM md WHERE o = 1")
def mode_strategy(spark, sf):
    return mode_of(recommendations(spark, sf), ["assay_type"]).drop("mode_count")


@add(f"{_REC}, {_MODE.format(by='epistasis', src='rec')} SELECT rec.epistasis, count(*) AS n, {r('avg(zs_best)')} AS mean_zs_best, {r('avg(epi_mean_abs)')} AS mean_epistasis, any_value(md.strategy) AS mode FROM rec JOIN (SELECT * FROM md WHERE o = 1) md ON md.epistasis = rec.epistasis GROUP BY 1")
def strategy_summary(spark, sf):
    d = recommendations(spark, sf)
    s = d.groupBy("epistasis").agg(F.count("*").alias("n"), F.avg("zs_best").alias("mean_zs_best"), F.avg("epi_mean_abs").alias("mean_epistasis"))
    return rounded(s.join(mode_of(d, ["epistasis"]).drop("mode_count"), "epistasis"))


_VALUES = ["zs_qty", "zs_tax", "zs_best"]
_BINS = ["assay_type", "epistasis", "mutation_stratum"]
_BYBIN = " UNION ALL ".join(f"SELECT '{b}' AS bin_field, {b} AS bin, '{v}' AS field, {v} AS value FROM fb" for b in _BINS for v in _VALUES)


@add(f"{FEATURES}, {_STRATA}, fb AS (SELECT feat.*, epistasis, mutation_stratum FROM feat JOIN strata USING (assay)), bb AS ({_BYBIN}) SELECT bin_field, bin, field, count(*) AS n, {r('avg(value)')} AS mean FROM bb WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def decision_by_bin(spark, sf):
    f = tertiles(features(spark, sf), "epi_mean_abs", "epi").withColumns({
        "epistasis": three_way("epi_mean_abs", "epi_lo", "epi_hi"),
        "mutation_stratum": F.when(F.col("n_higher_order") >= 100, "higher").when(F.col("n_doubles") >= 20, "double").otherwise("single"),
    })
    f = f.select(*_BINS, *_VALUES).unpivot(_BINS, _VALUES, "field", "value").where("value is not null")
    f = f.unpivot(["field", "value"], _BINS, "bin_field", "bin")
    return rounded(f.groupBy("bin_field", "bin", "field").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


# -- stability over 27 x 3 = 81 threshold scenarios -----------------------------------------------------

_G, _FL, _MA = (0.01, 0.02, 0.03), (0.05, 0.1, 0.15), (50, 100, 150, 200, 250, 300, 350, 400, 450)
_SCEN = "scen AS (SELECT g::DECIMAL(18,6) AS g, f::DOUBLE AS f, m FROM (VALUES " + ", ".join(f"({g})" for g in _G) + ") a(g), (VALUES " + ", ".join(f"({f})" for f in _FL) + ") b(f), (VALUES " + ", ".join(f"({m})" for m in _MA) + ") c(m))"
_STAB = f"{FR}, {_SCEN}, cr AS (SELECT assay, g, f, m, {rules_sql('g', 'f', 'm')} AS strategy FROM fd, scen)"


def scenarios(spark, sf):
    s = spark.createDataFrame([(g, f, m) for g in _G for f in _FL for m in _MA], "g double, f double, m int").withColumn("g", F.col("g").cast("decimal(18,6)"))
    # a literal table of 81 rows against one row per assay
    return ruled(spark, sf).crossJoin(F.broadcast(s)).withColumn("strategy", strategy(F.col("g"), F.col("f"), F.col("m")))


@add(f"{_STAB} SELECT strategy, count(*) AS n, count(DISTINCT assay) AS n_assays FROM cr GROUP BY 1")
def scenario_cross(spark, sf):
    return scenarios(spark, sf).groupBy("strategy").agg(F.count("*").alias("n"), F.countDistinct("assay").alias("n_assays"))


@add(f"{_STAB}, ct AS (SELECT assay, strategy, count(*) AS c FROM cr GROUP BY 1, 2), mo AS (SELECT assay, strategy, c, row_number() OVER (PARTITION BY assay ORDER BY c DESC, strategy) AS o, count(*) OVER (PARTITION BY assay) AS k FROM ct) SELECT assay, strategy AS mode, {r('c / 81.0')} AS fraction, k AS n_strategies FROM mo WHERE o = 1")
def rule_stability(spark, sf):
    d = scenarios(spark, sf)
    k = d.groupBy("assay").agg(F.countDistinct("strategy").alias("n_strategies"))
    return mode_of(d, ["assay"]).join(k, "assay").select("assay", "mode", r6(F.col("mode_count") / F.lit(81.0)).alias("fraction"), "n_strategies")
