"""Queries on few-measurement calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_parts
from assayscope.operators import calibration as C
from assayscope.operators import heldout as H
from assayscope.operators import metrics as M
from assayscope.operators import ranking as K
from assayscope.operators.additive import additive_scores
from assayscope.operators.ordering import positions
from assayscope.operators.sampling import hash_order
from assayscope.plans.epistasis import ADD_SPLIT, heldout
from assayscope.plans.ranking import midrank, r, rounded, corr, top_sql
from assayscope.plans.registry import add
from assayscope.plans.sampling import SPLITS, ordered
from assayscope.plans.sampling import splits as draw_splits
from assayscope.sources import fixtures as X
from assayscope.sources.ingest import shared_path, written

KEYS = ["assay", "seed", "budget", "regime"]
_K = "assay, seed, budget, regime"
_MET = X.METHODS
#: Candidates that are judged in a large group.
SAMPLED = 20_000
B = f"WITH {X.VARIANTS}, {SPLITS}, {ADD_SPLIT}"
_ZS = ", ".join(f"{{'method': '{m}', 'z': {m}}}" for m in _MET)
#: training rows by method, and the closed-form fits of linear_1 and linear_2
FITS = f"""trz AS (SELECT {_K}, mutant, u.method, u.z, dms_score AS y FROM (SELECT {_K}, s.mutant, dms_score, unnest([{_ZS}]) AS u FROM splits s JOIN variants USING (assay, mutant))),
m1 AS (SELECT {_K}, method, avg(z) AS mz, avg(y) AS my, count(*) AS n_train FROM trz GROUP BY {_K}, method),
f1 AS (SELECT {_K}, method, n_train, my, mz, sum((z - mz) * (y - my)) / (sum((z - mz) * (z - mz)) + 1e-8) AS slope FROM trz JOIN m1 USING ({_K}, method) GROUP BY {_K}, method, n_train, my, mz),
tra AS (SELECT t.*, round(b + coalesce(s, 0), 9) AS a FROM trz t JOIN tb USING ({_K}) LEFT JOIN (SELECT {_K}, mutant, CAST(sum(e) AS DOUBLE) AS s FROM (SELECT {_K}, mutant, unnest(parts) AS part FROM splits JOIN variants USING (assay, mutant)) JOIN te USING ({_K}, part) GROUP BY {_K}, mutant) q USING ({_K}, mutant)),
m2 AS (SELECT {_K}, method, avg(a) AS ma, avg(z) AS mz, avg(y) AS my FROM tra GROUP BY {_K}, method),
s2 AS (SELECT {_K}, method, ma, mz, my, sum((a - ma) * (a - ma)) + 1e-8 AS aa, sum((z - mz) * (z - mz)) + 1e-8 AS zz, sum((a - ma) * (z - mz)) AS az, sum((a - ma) * (y - my)) AS ay, sum((z - mz) * (y - my)) AS zy FROM tra JOIN m2 USING ({_K}, method) GROUP BY {_K}, method, ma, mz, my),
f2 AS (SELECT {_K}, method, ma, mz, my, (ay * zz - az * zy) / (aa * zz - az * az) AS sa, (aa * zy - az * ay) / (aa * zz - az * az) AS sz FROM s2)"""


def calibration_rows(spark, sf, v=None, **which):
    """(splits, training rows, held-out rows): splits are numbered, variants by their place in their assay, and
    rows hold the additive prediction a of their split."""
    v = written(positions(ordered(v or X.variants(spark, sf)), ["assay"], ["mutant"], "item"), "variants")
    s = written(draw_splits(spark, sf, v.drop("ord", "item"), **which), "splits")
    # one row per split
    keys = written(s.select(*KEYS).distinct().withColumn("split", F.row_number().over(Window.orderBy(*KEYS))), "keys")
    drawn = s.join(keys, KEYS).select("split", "assay", "mutant")
    train = written(drawn.join(v, ["assay", "mutant"]), "training")
    test = keys.select("split", "assay").join(v, "assay").join(train.select("split", "item"), ["split", "item"], "left_anti")
    scored = lambda d: additive_scores(d, train, ["split"], few=True).withColumnRenamed("score", "a")
    return keys, scored(train), scored(test)


def by_method(train):
    """Training rows, one per method with its score z."""
    return train.select("split", "mutant", "dms_score", "a", *_MET).unpivot(["split", "mutant", "dms_score", "a"], _MET, "method", "z")


@add(f"{B}, {FITS} SELECT {_K}, method, n_train, {r('slope')} AS slope, {r('my - slope * mz')} AS intercept FROM f1")
def linear_1(spark, sf):
    keys, train, _ = calibration_rows(spark, sf)
    return rounded(C.linear_1(by_method(train), ["split", "method"], "z", "dms_score").join(keys, "split").select(*KEYS, "method", "n_train", "slope", "intercept"))


@add(f"{B}, {FITS} SELECT {_K}, method, round(sa, 4) + 0.0 AS slope_a, round(sz, 4) + 0.0 AS slope_z FROM f2")
def linear_2(spark, sf):
    keys, train, _ = calibration_rows(spark, sf)
    f = C.linear_2(by_method(train), ["split", "method"], "a", "z", "dms_score").join(keys, "split")
    return f.select(*KEYS, "method", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("slope_a", "slope_z")])


PRED = f"""hz AS (SELECT {_K}, mutant, ord, dms_score, a, u.method, u.z FROM (SELECT {_K}, h.mutant, h.ord, h.dms_score, h.score AS a, unnest([{_ZS}]) AS u FROM adds h JOIN variants v USING (assay, mutant))),
pred AS (SELECT {_K}, mutant, dms_score, method, u.model, u.score FROM (SELECT hz.*, unnest([{{'model': 'linear_1', 'score': round(f1.my - f1.slope * f1.mz + f1.slope * z, 6)}}, {{'model': 'linear_2', 'score': round(f2.my - sa * f2.ma - sz * f2.mz + sa * a + sz * z, 6)}}]) AS u FROM hz JOIN f1 USING ({_K}, method) JOIN f2 USING ({_K}, method))
UNION ALL SELECT {_K}, mutant, dms_score, 'none', 'additive', score FROM adds)"""


#: The predictions that a held-out row has: (model, method) by column.
MODELS = {"additive": ("additive", "none")} | {f"{model}__{m}": (model, m) for model in ("linear_1", "linear_2") for m in _MET}


def predictions(spark, sf, v=None, **which):
    """(splits, held-out rows), a row having a column for each of MODELS: rows are neither repeated nor moved for
    each model and method."""
    keys, train, held = calibration_rows(spark, sf, v, **which)
    long, by = by_method(train), ["split", "method"]
    fits = C.linear_1(long, by, "z", "dms_score").select(*by, F.col("slope").alias("s1"), F.col("intercept").alias("i1")).join(C.linear_2(long, by, "a", "z", "dms_score").select(*by, "slope_a", "slope_z", F.col("intercept").alias("i2")), by)
    coefficients = ["s1", "i1", "slope_a", "slope_z", "i2"]
    wide = fits.groupBy("split").pivot("method", _MET).agg(*[F.first(c).alias(c) for c in coefficients])
    p = held.join(wide, "split")  # one row per split
    of = lambda m, c: F.col(f"{m}_{c}")
    p = p.withColumns({f"linear_1__{m}": F.round(of(m, "i1") + of(m, "s1") * F.col(m), 6) for m in _MET})
    p = p.withColumns({f"linear_2__{m}": F.round(of(m, "i2") + of(m, "slope_a") * F.col("a") + of(m, "slope_z") * F.col(m), 6) for m in _MET})
    return keys, p.withColumnRenamed("a", "additive").select("split", "item", "mutant", "dms_score", *MODELS)


def split_rows(spark, sf, v=None, **which):
    """(variants numbered within their assay, splits, training rows with their additive prediction), of all splits or of
    those of the budgets and regimes in `which`."""
    v = written(positions(ordered(v or X.variants(spark, sf)), ["assay"], ["mutant"], "item"), "variants")
    s = written(draw_splits(spark, sf, v.select("assay", "mutant"), **which), "splits")
    # one row per split
    keys = written(s.select(*KEYS).distinct().withColumn("split", F.row_number().over(Window.orderBy(*KEYS))), "keys")
    drawn = s.join(keys, KEYS).select("split", "assay", "mutant")
    # a split's budget of rows
    train = written(v.join(F.broadcast(drawn), ["assay", "mutant"]), "training")
    return v, keys, written(additive_scores(train, train, ["split"], few=True).withColumnRenamed("score", "a"), "training")


def linear_models(keys, train):
    """Each split's additive model with its linear fits of every score, as m_slope columns."""
    long, by = written(by_method(train), "long"), ["split", "method"]
    fits = C.linear_1(long, by, "z", "dms_score").select(*by, F.col("slope").alias("s1"), F.col("intercept").alias("i1")).join(C.linear_2(long, by, "a", "z", "dms_score").select(*by, "slope_a", "slope_z", F.col("intercept").alias("i2")), by)
    wide = fits.groupBy("split").pivot("method", _MET).agg(*[F.first(c).alias(c) for c in ("s1", "i1", "slope_a", "slope_z", "i2")])
    return written(H.models(keys, train, wide), "models")


def predicted(rows: H.Variants, m: dict, wanted=MODELS, at: slice = slice(None)) -> dict:
    """The predictions of a split for all rows, or for those of a chunk, by column of MODELS."""
    out = {}
    of = lambda method, c: np.nan if m[f"{method}_{c}"] is None else m[f"{method}_{c}"]
    for c in wanted:
        model, x = MODELS[c]
        if model == "additive":
            out[c] = rows.additive(m)[at]
        elif model == "linear_1":
            out[c] = H.half_up(of(x, "i1") + of(x, "s1") * rows[x][at], 6)
        else:
            out[c] = H.half_up(of(x, "i2") + of(x, "slope_a") * rows.additive(m)[at] + of(x, "slope_z") * rows[x][at], 6)
    return out


def per_model(found, keys, *fields, wanted=MODELS):
    """Rows with a struct of fields for each wanted one of MODELS, as rows by split, model and method."""
    rows = F.array(*[F.struct(F.lit(model).alias("model"), F.lit(m).alias("method"), *[F.col(f"{c}__{x}").alias(x) for x in fields]) for c, (model, m) in ((c, MODELS[c]) for c in wanted)])
    return found.select("split", F.explode(rows).alias("r")).select("split", "r.*").join(keys, "split").select(*KEYS, "method", "model", *fields)


_PK = f"{_K}, method, model"
LOWN = f"""{PRED}, rk AS (SELECT *, row_number() OVER (PARTITION BY {_PK} ORDER BY score DESC, mutant) AS rank_pred, row_number() OVER (PARTITION BY {_PK} ORDER BY dms_score DESC, mutant) AS rank_true, count(*) OVER (PARTITION BY {_PK}) AS n,
min(dms_score) OVER (PARTITION BY {_PK}) AS lo, max(dms_score) OVER (PARTITION BY {_PK}) AS hi, {midrank('dms_score', _PK)} AS rt, {midrank('score', _PK)} AS rp FROM pred),
lown AS (SELECT {_PK}, count(*) AS n_test, {corr('rt', 'rp')} AS spearman_all, {top_sql()['top1pct_recall_at_k']} AS recall, max(CASE WHEN rank_pred <= 100 THEN dms_score END) AS best FROM rk GROUP BY {_PK})"""
BL = f"{B}, {FITS}, {LOWN}"


def low_n(spark, sf, v=None, wanted=MODELS, **which):
    """Metrics of every split, method and model, or of those that a query asks for: `wanted` of MODELS, and splits of the
    budgets and regimes in `which`. A seed's splits of an assay are ordered in one task, which holds the assay's
    numbers, one split after another; assays beyond H.WHOLE variants, or with scores missing, are ordered by Spark."""
    v, keys, train = split_rows(spark, sf, v, **which)
    if not H.fits_a_task(v, ["dms_score", *_MET]):
        return low_n_by_windows(spark, sf, v.drop("ord", "item"), wanted, **which)

    def judged(rows, m):
        held, y = rows.held(m), rows["dms_score"]
        n = int(held.sum())
        if n == 0:
            return

        def order(column, falling=False):
            at = rows.ascending(column)
            at = at[held[at]]
            return at[::-1] if falling else at

        by_truth = order("dms_score")
        rt = H.centred(y, by_truth)
        top = H.marked(len(rows), H.highest(y, by_truth, max(1, int(np.ceil(n * 0.01)))))
        del by_truth
        for c in wanted:
            p = rows.each(lambda at, c=c: predicted(rows, m, [c], at)[c])
            # a line through a score, rounded, has the score's order or its reverse
            line = order(MODELS[c][1], (m[f"{MODELS[c][1]}_s1"] or 0.0) < 0) if MODELS[c][0] == "linear_1" else None
            at = H.along(p, held, line)
            inside = H.highest(p, at, 100)
            yield pa.table({
                "split": [m["split"]], "model": [MODELS[c][0]], "method": [MODELS[c][1]], "n_test": [n], "spearman_all": pa.array([H.spearman(rt, p, at)], "float64"),
                "recall": [float(top[inside].sum() / top.sum())], "best": [float(y[inside].max())],
            })

    found = H.by_seed(v, linear_models(keys, train), ["dms_score", *_MET], judged, "split int, model string, method string, n_test long, spearman_all double, recall double, best double")
    return found.join(F.broadcast(keys), "split").select(*KEYS, "method", "model", "n_test", "spearman_all", "recall", "best")


def low_n_by_windows(spark, sf, v=None, wanted=MODELS, **which):
    """The same for assays of any size. A split's rows are dealt out once and ordered by truth and by each
    prediction where they are; of equal predictions the place goes by the variant."""
    keys, p = predictions(spark, sf, v, **which)
    here = Window.partitionBy("split")
    p = p.select("split", "item", "dms_score", *wanted).repartition("split")
    p = p.withColumns({"n": F.count("*").over(here), "rank_true": K.ordinal("dms_score", ["split"], "item", descending=True), "rt": K.midrank("dms_score", ["split"], descending=True)})
    top = F.col("rank_true") <= M.top_size(F.col("n"), 0.01)
    p = p.withColumn("top", top).drop("rank_true")
    found = [F.count("*").alias("n")]
    for c in wanted:
        p = p.withColumns({f"{c}__o": K.ordinal(c, ["split"], "item", descending=True) <= 100, f"{c}__r": K.midrank(c, ["split"], descending=True)}).drop(c)
        inside = F.col(f"{c}__o")
        found += [
            F.count("*").alias(f"{c}__n_test"), M.pearson("rt", f"{c}__r").alias(f"{c}__spearman_all"), (F.count_if(inside & F.col("top")) / F.count_if("top")).alias(f"{c}__recall"),
            F.max(F.when(inside, F.col("dms_score"))).alias(f"{c}__best"),
        ]
    return per_model(p.groupBy("split").agg(*found), keys, "n_test", "spearman_all", "recall", "best", wanted=wanted)


@add(f"{BL} SELECT {_PK}, n_test, {r('spearman_all')} AS spearman_all, {r('recall')} AS recall, {r('best')} AS best FROM lown")
def low_n_calibration(spark, sf):
    return rounded(low_n(spark, sf))


@add(f"{BL} SELECT budget, regime, model, method, count(*) AS n, {r('avg(abs(spearman_all))')} AS mean_abs_spearman, {r('avg(recall)')} AS mean_recall FROM lown WHERE spearman_all IS NOT NULL OR recall IS NOT NULL GROUP BY 1, 2, 3, 4")
def low_n_summary(spark, sf):
    d = low_n(spark, sf).where("spearman_all is not null or recall is not null")
    return rounded(d.groupBy("budget", "regime", "model", "method").agg(F.count("*").alias("n"), F.avg(F.abs("spearman_all")).alias("mean_abs_spearman"), F.avg("recall").alias("mean_recall")))


@add(f"{BL}, w AS (SELECT model, method, row_number() OVER (PARTITION BY {_K} ORDER BY round(recall, 9) DESC, model, method) AS o FROM lown) SELECT model, method, count(*) AS wins FROM w WHERE o = 1 GROUP BY 1, 2")
def low_n_wins(spark, sf):
    o = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.round("recall", 9).desc(), "model", "method"))
    return low_n(spark, sf).withColumn("o", o).where("o = 1").groupBy("model", "method").agg(F.count("*").alias("wins"))


_PCT = "pc AS (SELECT l.*, (SELECT count_if(v.dms_score <= l.best)::DOUBLE / count(*) FROM variants v WHERE v.assay = l.assay) AS percentile FROM lown l)"


def percentiles(spark, sf, v=None, wanted=MODELS, **which):
    v = written(v or X.variants(spark, sf), "variants")
    low = written(low_n(spark, sf, v, wanted, **which), "low_n").withColumnRenamed("best", "dms_score")
    return K.shares_below(v, low, ["assay"], "dms_score", "percentile").withColumnRenamed("dms_score", "best")


@add(f"{BL}, {_PCT} SELECT budget, regime, model, coalesce(nullif(method, ''), 'none') AS method, {r('avg(percentile)')} AS mean_percentile, {r('avg(recall)')} AS mean_recall FROM pc GROUP BY 1, 2, 3, 4")
def low_n_percentile_summary(spark, sf):
    return rounded(percentiles(spark, sf).groupBy("budget", "regime", "model", F.coalesce(F.nullif("method", F.lit("")), F.lit("none")).alias("method")).agg(F.avg("percentile").alias("mean_percentile"), F.avg("recall").alias("mean_recall")))


# the decision table takes one budget and regime, the additive model and one score at a time
_MIXED20 = "budget = 20 AND regime = 'mixed_random'"
_ONLY20 = {"budgets": [20], "regimes": ["mixed_random"]}
_LINES = [c for c, (model, _) in MODELS.items() if model == "linear_1"]
_GAIN = "max(CASE WHEN model = 'linear_1' THEN p END) - max(CASE WHEN model = 'additive' THEN p END)"


@add(f"{BL}, {_PCT}, gg AS (SELECT assay, model, method, avg(percentile) AS p FROM pc WHERE {_MIXED20} GROUP BY 1, 2, 3) SELECT assay, 'full candidate pool' AS mode, {r(_GAIN)} AS gain FROM gg GROUP BY 1")
def low_n_gain(spark, sf):
    p = percentiles(spark, sf, wanted=["additive", *_LINES], **_ONLY20).where(_MIXED20).where("model in ('linear_1', 'additive')").withColumn("mode", F.lit("full candidate pool"))
    return rounded(C.best_gain(p, "assay", "method", "percentile", F.col("model") == "additive", "mode"))


@add(f"{BL.replace(X.VARIANTS, f'{X.TYPES}, {X.VARIANTS25}', 1)}, {_PCT} SELECT assay_type, method, count(*) AS n_rows, {r('avg(percentile)')} AS mean_percentile FROM pc JOIN types USING (assay) WHERE {_MIXED20} AND model = 'linear_1' GROUP BY 1, 2")
def low_n_by_assay_type(spark, sf):
    p = percentiles(spark, sf, X.variants25(spark, sf), _LINES, **_ONLY20).where(_MIXED20).where("model = 'linear_1'").join(X.assay_types(spark, sf), "assay")
    return rounded(p.groupBy("assay_type", "method").agg(F.count("*").alias("n_rows"), F.avg("percentile").alias("mean_percentile")))


_PAIRED = f"pj AS (SELECT a.assay, a.seed, a.budget, a.model, a.method, abs(b.spearman_all) - abs(a.spearman_all) AS d_spearman, b.recall - a.recall AS d_recall FROM lown a JOIN lown b ON a.assay = b.assay AND a.seed = b.seed AND a.budget = b.budget AND a.model = b.model AND a.method = b.method WHERE a.regime = 'single_only' AND b.regime = 'single_plus_double')"


def paired(spark, sf):
    d = low_n(spark, sf, regimes=["single_only", "single_plus_double"])
    key = ["assay", "seed", "budget", "model", "method"]
    p = d.groupBy(*key).pivot("regime", ["single_only", "single_plus_double"]).agg(F.first(F.abs("spearman_all")).alias("s"), F.first("recall").alias("r"), F.count(F.lit(1)).alias("n"))
    p = p.where("single_only_n is not null and single_plus_double_n is not null")
    return p.select(*key, (F.col("single_plus_double_s") - F.col("single_only_s")).alias("d_spearman"), (F.col("single_plus_double_r") - F.col("single_only_r")).alias("d_recall"))


@add(f"{BL}, {_PAIRED} SELECT assay, seed, budget, model, method, {r('d_spearman')} AS d_spearman, {r('d_recall')} AS d_recall FROM pj")
def paired_regime_join(spark, sf):
    return rounded(paired(spark, sf))


@add(f"{BL}, {_PAIRED} SELECT budget, model, method, count(d_spearman) AS n_spearman, count(d_recall) AS n_recall, {r('avg(d_spearman)')} AS mean_d_spearman, {r('avg(d_recall)')} AS mean_d_recall FROM pj GROUP BY 1, 2, 3")
def data_value_summary(spark, sf):
    return rounded(paired(spark, sf).groupBy("budget", "model", "method").agg(F.count("d_spearman").alias("n_spearman"), F.count("d_recall").alias("n_recall"), F.avg("d_spearman").alias("mean_d_spearman"), F.avg("d_recall").alias("mean_d_recall")))


@add(f"""{BL}, sa AS (SELECT {_K}, mutant, row_number() OVER (PARTITION BY {_K} ORDER BY md5(concat_ws('|', {_K}, mutant)), mutant) AS h, count(*) OVER (PARTITION BY {_K}) AS nn FROM held),
sb AS (SELECT p.*, nn, row_number() OVER (PARTITION BY {', '.join(f'p.{k}' for k in _PK.split(', '))} ORDER BY score DESC, mutant) AS o FROM pred p JOIN sa USING ({_K}, mutant) WHERE h <= {SAMPLED})
SELECT {_PK}, count(*) AS n_candidates, CAST(max(nn) > {SAMPLED} AS INT) AS sampled, {r('max(CASE WHEN o <= 100 THEN dms_score END)')} AS best FROM sb GROUP BY {_PK}""")
def low_n_calibration_sampled(spark, sf):
    """The candidates of a large split are sampled once, and every model is judged on the same ones."""
    keys, p = predictions(spark, sf)
    here = Window.partitionBy("split")
    p = p.join(keys, "split").repartition("split").withColumns({"h": F.row_number().over(here.orderBy(hash_order(*KEYS, "mutant"), "item")), "nn": F.count("*").over(here)})
    p = p.where(F.col("h") <= SAMPLED).select("split", "item", "dms_score", "nn", *MODELS)
    found = []
    for c in MODELS:
        p = p.withColumn(f"{c}__o", K.ordinal(c, ["split"], "item", descending=True) <= 100).drop(c)
        found += [F.count("*").alias(f"{c}__n_candidates"), (F.max("nn") > SAMPLED).cast("int").alias(f"{c}__sampled"), F.max(F.when(F.col(f"{c}__o"), F.col("dms_score"))).alias(f"{c}__best")]
    return rounded(per_model(p.groupBy("split").agg(*found), keys, "n_candidates", "sampled", "best"))


@add(f"{B}, om AS (SELECT {_K}, ord, avg(dms_score) AS m FROM tr GROUP BY {_K}, ord), gm AS (SELECT {_K}, avg(dms_score) AS g FROM tr GROUP BY {_K}) SELECT {_K}, mutant, {r('g')} AS global_mean, {r('coalesce(m, g)')} AS order_mean FROM held JOIN gm USING ({_K}) LEFT JOIN om USING ({_K}, ord)")
def mean_baselines(spark, sf):
    train, test = heldout(spark, sf)
    g = train.groupBy(*KEYS).agg(F.avg("dms_score").alias("global_mean"))
    o = train.groupBy(*KEYS, "ord").agg(F.avg("dms_score").alias("m"))
    p = test.join(g, KEYS).join(o, [*KEYS, "ord"], "left")
    return rounded(p.select(*KEYS, "mutant", "global_mean", F.coalesce("m", "global_mean").alias("order_mean")))


@add(f"{B}, c AS (SELECT {_K}, part, count(*) AS n FROM (SELECT {_K}, unnest(parts) AS part FROM splits JOIN variants USING (assay, mutant)) GROUP BY {_K}, part), o AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY n DESC, part) AS rank FROM c) SELECT * FROM o WHERE rank <= 300")
def mutation_vocabulary(spark, sf):
    train, _ = heldout(spark, sf)
    return vocabulary(train)


def vocabulary(train, most: int = 300, by=KEYS):
    c = train.select(*by, F.explode(mutation_parts(F.col("mutant"))).alias("part")).groupBy(*by, "part").agg(F.count("*").alias("n"))
    return c.withColumn("rank", K.ordinal("n", by, "part", descending=True)).where(F.col("rank") <= most)


# -- ridge on sparse features (rows-only check) -------------------------------------------------------


_BY = ["split"]


def _ridge(spark, sf, features, spare: int | None = None):
    """Predictions of every split's ridge for its held-out rows. features(training rows) gives the training rows'
    features, a row each; a held-out row's are only formed in the task that predicts it, by _ridge_score()."""
    v, keys, train = split_rows(spark, sf)
    train = train.withColumnsRenamed({"ord": "order", "a": "additive"}).withColumn("order", F.col("order").cast("double"))
    stats = written(train.groupBy(*_BY).agg(*[f(c).alias(f"{c}_{n}") for c in _KERNEL for n, f in (("a", F.avg), ("s", F.stddev_pop))]), "stats")
    t = features(train, stats).join(train.select(*_BY, "mutant", "dms_score"), [*_BY, "mutant"])
    w = C.ridge_weights(written(t, "features"), _BY, "mutant", "dms_score", spare=spare)
    w = w.groupBy(*_BY).agg(F.collect_list(F.struct("feature", "weight")).alias("weights"))
    model = written(H.models(keys, train.withColumnRenamed("order", "ord"), w, stats), "models")

    def predict(rows, m):
        held = np.flatnonzero(rows.held(m))
        yield pa.table({"split": np.full(len(held), m["split"]), "mutant": rows.table["mutant"].take(held), "score": H.half_up(_ridge_score(rows, m)[held], 6)})

    found = H.by_block(v, model, ["mutant", "ord", *X.METHODS], predict, "split int, mutant string, score double")
    return found.join(F.broadcast(keys), "split").select(*KEYS, "mutant", "score")


def _ridge_score(rows: H.Variants, m: dict) -> np.ndarray:
    w = {f["feature"]: f["weight"] for f in m["weights"]}
    plain = {c: rows[c] for c in X.METHODS} | {"order": rows["ord"].astype(float), "additive": rows.additive(m)}

    def standard(c):
        a, s = m[f"{c}_a"], m[f"{c}_s"]
        return np.full(len(rows), np.nan) if a is None else (plain[c] - a) / (s or 1.0)

    out = np.full(len(rows), w[""])
    if "wave:0000" in w:
        turn, phase = C.waves(len(_KERNEL))
        f = np.cos(np.column_stack([standard(c) for c in _KERNEL]) @ turn.T + phase) * np.sqrt(2.0 / len(phase))
        return out + np.nan_to_num(f) @ np.array([w.get(f"wave:{k:04d}", 0.0) for k in range(len(phase))])
    for c, x in plain.items():
        if c in w:
            out += w[c] * np.nan_to_num(standard(c) if c in X.METHODS else x)
    return out + rows.part_sums({f.removeprefix("site:"): x for f, x in w.items() if f.startswith("site:")})


def _standard(train, stats, columns):
    z = {c: (F.col(c) - F.col(f"{c}_a")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")) for c in columns}
    return train.join(stats, _BY).withColumns(z)


def _score_features(train, stats):
    return _standard(train, stats, X.METHODS).select(*_BY, "mutant", "order", *X.METHODS).unpivot([*_BY, "mutant"], ["order", *X.METHODS], "feature", "value")


def _site_features(train, stats):
    tokens = train.select(*_BY, "mutant", F.explode(mutation_parts(F.col("mutant"))).alias("part")).join(vocabulary(train, by=_BY).select(*_BY, "part"), [*_BY, "part"])
    tokens = tokens.select(*_BY, "mutant", F.concat(F.lit("site:"), "part").alias("feature"), F.lit(1.0).alias("value"))
    return tokens.unionByName(train.select(*_BY, "mutant", F.lit("order").alias("feature"), F.col("order").alias("value")))


@add()
def ridge_grouped(spark, sf):
    """All scores; a split with fewer than two rows more than features has no fit."""
    return _ridge(spark, sf, _score_features, spare=2)


def _and_additive(features):
    """The features and the additive prediction learned from the same training rows."""
    return lambda train, stats: features(train, stats).unionByName(train.select(*_BY, "mutant", F.lit("additive").alias("feature"), F.col("additive").alias("value")))


@add()
def site_ridge(spark, sf):
    return _ridge(spark, sf, _site_features)


@add()
def additive_site_ridge(spark, sf):
    return _ridge(spark, sf, _and_additive(_site_features))


@add()
def score_ridge(spark, sf):
    return _ridge(spark, sf, _score_features)


@add()
def additive_score_ridge(spark, sf):
    return _ridge(spark, sf, _and_additive(_score_features))


_KERNEL = [*X.METHODS, "order", "additive"]


def _kernel_features(train, stats):
    """Random Fourier features of the scores, the order and the additive prediction, each standardised per split."""
    return C.kernel_features(_standard(train, stats, _KERNEL), _BY, "mutant", _KERNEL)


@add()
def kernel_ridge(spark, sf):
    """A Gaussian kernel's regression with unit noise on every split, through its random features."""
    return _ridge(spark, sf, _kernel_features)


_POOLED = [*X.METHODS, "additive"]


def pooled_rows(spark, sf):
    """(training rows: features, label; what held-out rows are predicted from: variants, splits, and a row per split with its
    additive model and the means to subtract): scores and additive predictions standardised per split, and the order."""
    from pyspark.ml.feature import VectorAssembler

    v, keys, train = split_rows(spark, sf)
    d = train.withColumnRenamed("a", "additive")
    s = written(d.groupBy(*_BY).agg(*[f(m).alias(f"{m}_{n}") for m in _POOLED for n, f in (("a", F.avg), ("s", F.stddev_pop))], F.avg("dms_score").alias("y_a")), "stats")
    z = {f"z_{m}": (F.col(m) - F.col(f"{m}_a")) / F.when(F.col(f"{m}_s") == 0, 1.0).otherwise(F.col(f"{m}_s")) for m in _POOLED}
    d = d.join(s, _BY).withColumns(z | {"label": F.col("dms_score") - F.col("y_a"), "order": F.col("ord").cast("double")})
    # every round of the fits reads the training rows
    fit = written(VectorAssembler(inputCols=[*z, "order"], outputCol="features").transform(d).select("features", "label"), "pooled")
    return fit, (v, keys, written(H.models(keys, train, s), "models"))


def zoo():
    """Name and estimator of each pooled regressor."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    return {
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "lasso": LinearRegression(regParam=0.001, elasticNetParam=1.0), "elastic_net": LinearRegression(regParam=0.001, elasticNetParam=0.5),
        "forest": RandomForestRegressor(numTrees=24, maxDepth=5, minInstancesPerNode=2, seed=7), "boosting": GBTRegressor(maxIter=30, maxDepth=4, stepSize=0.05, seed=7),
        "sampled_boosting": GBTRegressor(maxIter=40, maxDepth=2, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.9", seed=7),
    }


def exported(fitted, spark):
    """A fitted regressor as numpy: (weights, intercept) of a linear model, or its trees as (weight, feature, threshold, next
    node to either side, value), a leaf being its own next node. Trees are read from the tables that Spark saves."""
    if hasattr(fitted, "coefficients"):
        return fitted.coefficients.toArray(), fitted.intercept
    path = shared_path(spark, "model")
    fitted.save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", 0).alias("threshold"))
    trees = []
    # some dozen trees of bounded depth
    for i, t in n.toPandas().sort_values(["treeID", "id"]).groupby("treeID"):
        leaf = (t.leftChild < 0).to_numpy()
        assert (t.id.to_numpy() == np.arange(len(t))).all()
        to = [np.where(leaf, np.arange(len(t)), t[c]) for c in ("leftChild", "rightChild")]
        weight = fitted.treeWeights[i] / (1 if isinstance(fitted, GBTRegressionModel) else len(fitted.treeWeights))
        trees.append((weight, np.where(leaf, 0, t.feature), np.where(leaf, 0.0, t.threshold), *to, t.prediction.to_numpy()))
    return trees


def regressed(model, x: np.ndarray) -> np.ndarray:
    """Predictions of an exported() regressor for the columns of x, one row per feature."""
    if isinstance(model, tuple):
        return model[0] @ x + model[1]
    flat, here, out = x.ravel(), np.arange(x.shape[1]), np.zeros(x.shape[1])
    for weight, feature, threshold, left, right, value in model:
        at = np.zeros(x.shape[1], dtype=np.int64)
        while True:
            then = np.where(flat[feature[at] * x.shape[1] + here] <= threshold[at], left[at], right[at])
            if (then == at).all():
                break
            at = then
        out += weight * value[at]
    return out


def pooled_predictions(fit, held, models):
    """One row per held-out row and model. Held-out rows are formed and predicted where the variants are."""
    v, keys, of_splits = held
    known = {name: exported(est.fit(fit), fit.sparkSession) for name, est in models.items()}

    def predict(rows, m):
        at = np.flatnonzero(rows.held(m))
        plain = {c: rows[c] for c in X.METHODS} | {"additive": rows.additive(m)}
        x = np.array([(plain[c][at] - m[f"{c}_a"]) / (m[f"{c}_s"] or 1.0) for c in _POOLED] + [rows["ord"][at].astype(float)])
        if np.isnan(x).any():
            raise ValueError("a score is missing")
        found = {f"p_{name}": H.half_up(regressed(model, x) + m["y_a"], 4) for name, model in known.items()}
        yield pa.table({"split": np.full(len(at), m["split"]), "mutant": rows.table["mutant"].take(at), **found})

    schema = "split int, mutant string, " + ", ".join(f"p_{name} double" for name in models)
    out = H.by_block(v, of_splits, ["mutant", "ord", *X.METHODS], predict, schema).join(F.broadcast(keys), "split")
    p = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"p_{name}").alias("score")) for name in models]))
    return out.select(*KEYS, "mutant", p.alias("p")).select(*KEYS, "mutant", "p.model", "p.score")


@add()
def pooled_ml_regressors(spark, sf):
    """One fit of each regressor over all splits' training rows, on scores standardised per split."""
    return pooled_predictions(*pooled_rows(spark, sf), zoo())
