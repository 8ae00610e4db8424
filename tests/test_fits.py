"""Queries without SQL that fit models: every row against a dense solve in numpy, from training and held-out rows that
SQL draws on its own."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from assayscope.plans import calibration, epistasis, registry
from assayscope.plans.calibration import KEYS
from assayscope.sources.fixtures import METHODS

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "embeddings")


def sql(folder, text):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c.execute(text).df()


@pytest.fixture(scope="module")
def splits():
    """Training and held-out rows by split, with the additive prediction learned from the split's own rows."""
    scores = ", ".join(f"v.{m}" for m in METHODS)
    train, held = (
        dict(list(sql(SF, f"{calibration.B} SELECT {', '.join('t.' + k for k in KEYS)}, t.mutant, t.dms_score, t.ord, v.parts, {scores} FROM {t} t JOIN variants v USING (assay, mutant)").groupby(KEYS)))
        for t in ("tr", "held")
    )
    out = {}
    for k, t in train.items():
        single = t[t.ord == 1]
        base = (single if len(single) else t).dms_score.mean()
        effect = dict(zip(single.mutant, single.dms_score - base))
        out[k] = [d.assign(additive=[base + sum(effect.get(p, 0.0) for p in parts) for parts in d.parts]).reset_index(drop=True) for d in (t, held[k])]
    return out


def standard(train, held, names):
    a, s = train[names].mean(), train[names].std(ddof=0)
    s = s.where(s > 1e-9 * a.abs().clip(lower=1e-300), 1.0)
    return [((d[names] - a) / s).to_numpy() for d in (train, held)]


def by_scores(train, held, more=()):
    x = standard(train, held, METHODS)
    return [np.column_stack([z, d[["ord", *more]]]) for z, d in zip(x, (train, held))]


def by_sites(train, held, more=()):
    n = pd.Series([p for parts in train.parts for p in parts]).value_counts()
    known = sorted(n.index, key=lambda p: (-n[p], p))[:300]
    return [np.column_stack([[[float(p in set(parts)) for p in known] for parts in d.parts], d[["ord", *more]]]) for d in (train, held)]


def by_waves(train, held):
    names = [*METHODS, "ord", "additive"]
    rng = np.random.default_rng(7)
    w, phase = rng.standard_normal((64, len(names))), rng.uniform(0.0, 2 * np.pi, 64)
    return [np.sqrt(2 / 64) * np.cos(z @ w.T + phase) for z in standard(train, held, names)]


def ridge(x, y, asked, penalty=1.0):
    """Centred normal equations: the intercept bears no penalty."""
    mx, my = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + penalty * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return my + (asked - mx) @ w


def rows(got, keys):
    return {k: d.set_index("mutant")["score"] for k, d in got.groupby(keys)}


@pytest.mark.parametrize("name, features", [
    ("score_ridge", by_scores), ("additive_score_ridge", lambda t, h: by_scores(t, h, ["additive"])),
    ("site_ridge", by_sites), ("additive_site_ridge", lambda t, h: by_sites(t, h, ["additive"])), ("kernel_ridge", by_waves),
])
def test_ridges_of_all_splits_equal_dense_solves(spark, splits, name, features):
    got = rows(registry.queries()[name](spark, SF).toPandas(), KEYS)
    assert set(got) == set(splits)
    for k, (train, held) in splits.items():
        x, asked = features(train, held)
        want = ridge(x.astype(float), train.dms_score.to_numpy(), asked.astype(float))
        assert len(got[k]) == len(held)
        np.testing.assert_allclose(got[k].loc[held.mutant].to_numpy(), want, rtol=1e-6, atol=1e-3)


def test_small_splits_have_no_fit(spark, splits):
    got = rows(registry.queries()["ridge_grouped"](spark, SF).toPandas(), KEYS)
    enough = {k: v for k, v in splits.items() if len(v[0]) >= len(METHODS) + 1 + 2}
    assert set(got) == set(enough)
    for k, (train, held) in enough.items():
        x, asked = by_scores(train, held)
        np.testing.assert_allclose(got[k].loc[held.mutant].to_numpy(), ridge(x, train.dms_score.to_numpy(), asked), rtol=1e-6, atol=1e-3)


def test_pooled_fits(spark, splits):
    fit, held = calibration.pooled_rows(spark, SF)
    names = [*METHODS, "additive"]
    x = {k: [np.column_stack([z, d.ord]) for z, d in zip(standard(t, h, names), (t, h))] for k, (t, h) in splits.items()}
    xs = np.vstack([a for a, _ in x.values()])
    y = np.concatenate([t.dms_score - t.dms_score.mean() for t, _ in splits.values()])
    seen = np.array([[*r.features, r.label] for r in fit.collect()])
    want = np.column_stack([xs, y])
    order = lambda m: m[np.lexsort(np.round(m, 6).T)]
    np.testing.assert_allclose(order(seen), order(want), rtol=1e-6, atol=1e-6)

    models = calibration.zoo()
    got = calibration.pooled_predictions(fit, held, {m: models[m] for m in ("ridge", "lasso", "elastic_net", "forest")}).toPandas()
    assert set(got.model) == {"ridge", "lasso", "elastic_net", "forest"} and len(got) == 4 * sum(len(h) for _, h in splits.values())
    # the penalties are minute beside the labels' spread, so the linear models are near least squares
    w = np.linalg.lstsq(np.column_stack([np.ones(len(xs)), xs]), y, rcond=None)[0]
    spread = y.std()
    for model, found in got.groupby("model"):
        found = rows(found, KEYS)
        gap = np.concatenate([found[k].loc[h.mutant].to_numpy() - (t.dms_score.mean() + np.column_stack([np.ones(len(h)), x[k][1]]) @ w) for k, (t, h) in splits.items()])
        assert np.abs(gap).mean() < (0.001 if model != "forest" else 0.5) * spread, model
    again = calibration.pooled_predictions(fit, held, {"forest": calibration.zoo()["forest"]}).toPandas()
    key = [*KEYS, "mutant"]
    assert again.sort_values(key).score.tolist() == got[got.model == "forest"].sort_values(key).score.tolist()


def test_pair_ensemble_of_all_runs(spark):
    # of the smallest tables no assay has enough doubles
    folder, run = SF.replace("sf0.001", "sf0.01"), ["assay", "policy", "seed", "budget"]
    scores, of = ", ".join(f"v.{m}" for m in METHODS), ", ".join(f"t.{k}" for k in run)
    train = sql(folder, f"{epistasis._PCM} SELECT {of}, t.mutant, t.dms_score, t.a AS base, {scores} FROM tr t JOIN variants v USING (assay, mutant)")
    held = dict(list(sql(folder, f"{epistasis._PCM} SELECT {of}, t.mutant, t.score AS base, {scores} FROM pw t JOIN variants v USING (assay, mutant)").groupby(run)))
    got = rows(registry.queries()["pairwise_ensemble"](spark, folder).toPandas(), run)
    assert set(got) == set(held) and len(got) > 20
    for k, t in train.groupby(run):
        x, asked = standard(t, held[k], ["base", *METHODS])
        np.testing.assert_allclose(got[k].loc[held[k].mutant].to_numpy(), ridge(x, t.dms_score.to_numpy(), asked, 1e-8), rtol=1e-6, atol=1e-3)
