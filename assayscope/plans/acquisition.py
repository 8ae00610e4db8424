"""Queries that choose the next batch of every split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayscope.operators import acquisition as A
from assayscope.operators import metrics as M
from assayscope.operators import ranking as K
from assayscope.operators import sampling as P
from assayscope.operators import heldout as H
from assayscope.plans.calibration import B, FITS, KEYS, MODELS, PRED, linear_models, predicted, predictions, split_rows
from assayscope.plans.epistasis import heldout
from assayscope.plans.ranking import r, rounded
from assayscope.plans.registry import add
from assayscope.sources import fixtures as X
from assayscope.sources.ingest import written

_K = "assay, seed, budget, regime"
BP = f"{B}, {FITS}, {PRED}, ap AS (SELECT * FROM pred)"
BATCH = 20


def pool(spark, sf):
    return predictions(spark, sf)


def named(batch, keys, *more):
    """A batch by split, as a batch by the split's assay, seed, budget and regime."""
    return batch.join(keys, "split").select(*KEYS, "mutant", "rank", *more)


def blockwise(spark, sf, wanted, scores, fields="fit string"):
    """The batch of each split and fit: scores(predictions) gives the scores to choose by, by fit. A block sends on its own
    best rows only."""
    v, keys, train = split_rows(spark, sf)

    def firsts(rows, m):
        held = rows.held(m)
        for fit, s in scores(predicted(rows, m, wanted)).items():
            s = s[held]
            at = H.best(s, BATCH)
            yield pa.table({"split": np.full(len(at), m["split"]), "fit": [fit] * len(at), "mutant": rows.table["mutant"].take(np.flatnonzero(held)[at]), "score": pa.array(s[at], from_pandas=True)})

    found = H.by_block(v, linear_models(keys, train), ["mutant", *X.METHODS], firsts, f"split int, {fields}, mutant string, score double")
    return keys, A.best_batch(written(found, "firsts"), ["split", "fit"], "mutant", "score", BATCH)


def best(spark, sf, score, *wanted):
    keys, b = blockwise(spark, sf, wanted, lambda p: {"": score(p)})
    return named(b, keys)


def spread(p):
    """Mean and sample deviation (0 of a single value) over the predictions of each row, missing ones left out."""
    there = [~np.isnan(x) for x in p.values()]
    n = sum(t.astype(np.int64) for t in there)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = sum((np.where(t, x, 0.0) for t, x in zip(there, p.values())), 0.0) / n
        var = sum((np.where(t, (x - mean) * (x - mean), 0.0) for t, x in zip(there, p.values())), 0.0) / (n - 1)
        return H.half_up(mean, 5), H.half_up(np.where(n < 2, 0.0, np.sqrt(var)), 5)


def _best_sql(source: str, score: str) -> str:
    return f"o AS (SELECT {_K}, mutant, row_number() OVER (PARTITION BY {_K} ORDER BY {score} DESC, mutant) AS rank FROM {source}) SELECT * FROM o WHERE rank <= {BATCH}"


@add(f"{B}, o AS (SELECT {_K}, mutant, row_number() OVER (PARTITION BY {_K} ORDER BY md5(concat_ws('|', 'acquire', {_K}, mutant)), mutant) AS rank FROM held) SELECT * FROM o WHERE rank <= {BATCH}")
def acquire_random(spark, sf):
    _, test = heldout(spark, sf)
    return P.sample_k(test.select(*KEYS, "mutant"), KEYS, "mutant", BATCH, "acquire")


@add(f"{BP}, {_best_sql('''(SELECT * FROM ap WHERE model = 'additive')''', 'score')}")
def acquire_additive(spark, sf):
    return best(spark, sf, lambda p: p["additive"], "additive")


@add(f"""{BP}, o AS (SELECT {_K}, model, method, mutant, row_number() OVER (PARTITION BY {_K}, model, method ORDER BY coalesce(score, 0) DESC, mutant) AS rank FROM ap WHERE model <> 'additive') SELECT * FROM o WHERE rank <= {BATCH}""")
def acquire_linear(spark, sf):
    """By each linear model of each score."""
    fits = [c for c, (model, _) in MODELS.items() if model != "additive"]
    keys, b = blockwise(spark, sf, fits, lambda p: {c: np.where(np.isnan(x), 0.0, x) for c, x in p.items()})
    return named(b.withColumns({"model": F.split_part("fit", F.lit("__"), F.lit(1)), "method": F.split_part("fit", F.lit("__"), F.lit(2))}), keys, "model", "method")


_DIS = f"di AS (SELECT {_K}, mutant, round(abs(max(CASE WHEN model = 'additive' THEN score END) - max(CASE WHEN model = 'linear_1' AND method = 'm_qty' THEN score END)), 6) AS d FROM ap GROUP BY {_K}, mutant)"


@add(f"{BP}, {_DIS}, {_best_sql('di', 'd')}")
def acquire_disagreement(spark, sf):
    return best(spark, sf, lambda p: H.half_up(np.abs(p["additive"] - p["linear_1__m_qty"]), 6), "additive", "linear_1__m_qty")


_ENS = f"en AS (SELECT {_K}, mutant, round(avg(score), 5) AS mean, round(coalesce(stddev_samp(score), 0), 5) AS std FROM ap GROUP BY {_K}, mutant)"


def ensemble(spark, sf):
    keys, p = pool(spark, sf)
    mean, std = A.ensemble_across(list(MODELS))
    return keys, p.select("split", "mutant", F.round(mean, 5).alias("mean"), F.round(std, 5).alias("std"))


_UCB = " UNION ALL ".join(f"SELECT {_K}, mutant, row_number() OVER (PARTITION BY {_K} ORDER BY round(mean + {w} * std, 6) DESC, mutant) AS rank, {w}::DOUBLE AS weight FROM en" for w in (0.0, 0.5))


@add(f"{BP}, {_ENS}, o AS ({_UCB}) SELECT * FROM o WHERE rank <= {BATCH}")
def acquire_ensemble(spark, sf):
    """By the mean of all predictions, and by the mean and half their deviation."""

    def weighed(p):
        mean, std = spread(p)
        return {str(w): H.half_up(mean + w * std, 6) for w in (0.0, 0.5)}

    keys, b = blockwise(spark, sf, MODELS, weighed)
    return named(b.withColumn("weight", F.col("fit").cast("double")), keys, "weight")


_COMBO = f"co AS (SELECT {_K}, mutant, row_number() OVER (PARTITION BY {_K} ORDER BY mean, mutant) AS a, row_number() OVER (PARTITION BY {_K} ORDER BY std, mutant) AS b FROM en)"


@add(f"{BP}, {_ENS}, {_COMBO}, {_best_sql('co', '2 * a + b')}")
def acquire_rank_combo(spark, sf):
    # rank(mean) + 0.5 rank(std), both over the same number of rows
    v, keys, train = split_rows(spark, sf)
    if not H.fits_a_task(v, ["dms_score", *X.METHODS]):
        keys, e = ensemble(spark, sf)
        w = Window.partitionBy("split")
        e = e.repartition("split").withColumns({"a": F.row_number().over(w.orderBy("mean", "mutant")), "b": F.row_number().over(w.orderBy("std", "mutant"))})
        return named(A.best_batch(e, ["split"], "mutant", 2 * F.col("a") + F.col("b"), BATCH), keys)

    def ranked(rows, m):
        held, mean, std = rows.held(m), np.empty(len(rows)), np.empty(len(rows))
        for at in rows.chunks():
            mean[at], std[at] = spread(predicted(rows, m, at=at))
        total = np.zeros(len(rows), dtype=H.narrow(3 * len(rows)))
        for weight, x in ((2, mean), (1, std)):
            at = np.argsort(x, kind="stable")
            at = at[held[at]]
            total[at] += weight * np.arange(1, len(at) + 1, dtype=total.dtype)
        # rows that aren't held out have nothing and come last
        at = H.best(total, BATCH)
        at = at[held[at]]
        yield pa.table({"split": np.full(len(at), m["split"]), "item": rows.item[at], "rank": np.arange(1, len(at) + 1)})

    found = H.by_seed(v, linear_models(keys, train), X.METHODS, ranked, "split int, item long, rank int")
    return with_names(found, v, keys)


def with_names(batch, v, keys):
    """A batch of items by split, with their mutants; batches are a few rows of each split."""
    few = F.broadcast(written(batch, "batch").join(keys, "split"))
    return v.select("assay", "item", "mutant").join(few, ["assay", "item"]).select(*KEYS, "mutant", "rank")


@add()
def acquire_diverse(spark, sf):
    v, keys, train = split_rows(spark, sf)
    if not H.fits_a_task(v, ["dms_score", *X.METHODS]):
        keys, p = pool(spark, sf)
        return named(A.acquire_diverse(written(p.select("split", "mutant", "additive"), "pool"), ["split"], "mutant", "additive", BATCH), keys)

    def diverse(rows, m):
        held = np.flatnonzero(rows.held(m)).astype(H.narrow(len(rows)))
        s = rows.additive(m)[held]
        if len(s) == 0:
            return
        width, head = 0.02 * float(s.max() - s.min()), A.HEAD
        # the highest scores, more of them where the choice among these can't be told to be that among all
        while True:
            at = H.best(s, head + 1)
            names = [sites(p) for p in rows.parts(held[at])]
            left_out = (float(s[at[head]]), int(rows.item[held[at[head]]])) if len(at) > head else None
            got, sure = A.greedy([(int(rows.item[held[i]]), float(s[i]), t) for i, t in zip(at[:head], names)], BATCH, width, left_out)
            if sure:
                break
            head *= 4
        yield pa.table({"split": [m["split"]] * len(got), "item": got, "rank": list(range(1, len(got) + 1))})

    found = H.by_seed(v, written(H.models(keys, train), "models"), [], diverse, "split int, item long, rank int")
    return with_names(found, v, keys)


def sites(parts):
    """The positions of a variant, as mutation_sites() has them."""
    return frozenset(p[1:-1] for p in parts or [] if len(p) >= 3)


@add(f"WITH {X.VARIANTS} SELECT assay, mutant, {r('cume_dist() OVER (PARTITION BY assay ORDER BY dms_score)')} AS percentile, CAST(row_number() OVER (PARTITION BY assay ORDER BY dms_score DESC, mutant) <= greatest(1, ceil(count(*) OVER (PARTITION BY assay) * 0.01::DOUBLE)) AS INT) AS top1pct FROM variants")
def pool_truth(spark, sf):
    v = written(X.variants(spark, sf).select("assay", "mutant", "dms_score"), "variants")
    cut = K.top_cuts(v, ["assay"], "dms_score", "mutant", {"top": M.top_size(F.col("n"), 0.01)}, "best").select("assay", "best_top")
    d = K.shares_below(v, v, ["assay"], "dms_score", "percentile").join(cut, "assay")
    return rounded(d.select("assay", "mutant", "percentile", K.not_after("dms_score", "mutant", "best_top").cast("int").alias("top1pct")))
