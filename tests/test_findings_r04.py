"""Findings of the fourth round: whole assays in a task's memory. Each test fails on the code before."""

import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from assayscope.operators import heldout as H
from assayscope.plans import registry
from assayscope.plans.calibration import _MET

SF = "/root/testdata/sf0.001"


def assay(n, lists=True):
    rng = np.random.default_rng(5)
    parts = [[f"A{p}V" for p in rng.choice(50, k, replace=False) + 1] for k in rng.integers(3, 9, n)]
    return pa.table({
        "item": range(n), **{c: rng.normal(size=n) for c in ("dms_score", *_MET)}, "ord": pa.array([len(p) for p in parts], pa.int32()),
        "parts": parts if lists else [":".join(p) for p in parts],
    })


class Taken(Exception):
    pass


@pytest.mark.parametrize(("query", "most"), [("low_n_summary", 115), ("acquire_diverse", 65), ("acquire_rank_combo", 100), ("additive_lookup", 90), ("pairwise_summary", 100)])
def test_a_task_holds_few_columns_of_an_assay(spark, monkeypatch, query, most):
    """Bytes a variant that a whole assay, read from batches, and what is computed of it take at their peak."""
    seen = {}

    def taken(v, model, columns, each, schema):
        seen.update(columns=columns, each=each, models=[m.asDict(recursive=True) for m in model.limit(2).collect()])
        raise Taken

    monkeypatch.setattr(H, "by_seed", taken)
    sf = SF if query != "pairwise_summary" else "/root/testdata/sf0.01"
    with pytest.raises(Taken):
        registry.queries()[query](spark, sf)
    monkeypatch.setattr(H, "CHUNK", 4096)
    n = 100_000
    t = assay(n, lists=False).select(["item", *seen["columns"], "parts"])
    tracemalloc.start()
    try:
        rows = H.Variants(iter(t.to_batches(5000)))
        found = [x.num_rows for m in seen["models"] for x in seen["each"](rows, m)]
        peak = tracemalloc.get_traced_memory()[1] / n
    finally:
        tracemalloc.stop()
    assert sum(found) > 0 and peak < most


def test_batches_in_any_order_are_an_assay(monkeypatch):
    """Rows come in batches of any order, parts as lists or as text; none stands for a variant without parts."""
    monkeypatch.setattr(H, "CHUNK", 7)
    t = assay(100, lists=False).to_pydict()
    t["parts"][4], t["parts"][60], t["parts"][99] = "", "B:B:C", None
    parts = [p.split(":") if p else [] for p in t["parts"]]
    at = list(range(100))
    random.Random(3).shuffle(at)
    mixed = pa.table({c: [x[i] for i in at] for c, x in t.items()} | {"mutant": [f"m{i}" for i in at]})
    rows = H.Variants(iter(mixed.to_batches(13)))
    assert rows.item.tolist() == list(range(100)) and rows["dms_score"].tolist() == t["dms_score"]
    assert rows.table["mutant"].to_pylist() == [f"m{i}" for i in range(100)]
    places = np.array([99, 4, 60, 0, 7, 6, 60])
    assert rows.parts(places) == [parts[i] for i in places]
    weights = {"A1V": 0.5, "A2V": -3.0, "B": 7.0, "unknown": 1.0}
    assert rows.part_sums(weights).tolist() == [sum(weights.get(p, 0.0) for p in ps) for ps in parts]
    for units in (10**9, 10**18):
        effects = [{"part": "B", "units": units}, {"part": "A3V", "units": -units // 7}]
        want = [round(float(1 + Fraction(sum(e["units"] * ps.count(e["part"]) for e in effects), 10**10)), 9) for ps in parts]
        np.testing.assert_allclose(rows.additive({"base": 1.0, "effects": effects}), want, rtol=1e-15)
    assert np.flatnonzero(~rows.held({"taken": [3, 98, 250, -1]})).tolist() == [3, 98]


def test_ranks_are_told_chunk_by_chunk(monkeypatch):
    """Runs of equal values across chunks, few values, one value; rank correlations of held rows; the highest rows."""
    monkeypatch.setattr(H, "CHUNK", 7)
    rng = np.random.default_rng(1)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    for n, values in ((1, 3), (6, 2), (7, 7), (50, 3), (200, 1), (200, 40), (200, 10**6)):
        x, y = rng.integers(0, values, n) / 3, rng.integers(0, 30, n) / 7
        for held in (np.ones(n, dtype=bool), rng.random(n) < 0.7):
            order = H.along(x, held)
            assert [r for _, c in H.doubled(x, order) for r in c] == (2 * rank(x[held]))[np.argsort(x[held], kind="stable")].tolist()
            got = H.spearman(H.centred(y, H.along(y, held)), x, order)
            a, b = rank(y[held]), rank(x[held])
            if held.sum() < 3 or a.std() == 0 or b.std() == 0:
                assert got is None
            else:
                assert np.isclose(got, np.corrcoef(a, b)[0, 1], rtol=0, atol=1e-12)
            for k in (1, 5, 60):
                want = sorted(np.flatnonzero(held), key=lambda i: (-x[i], i))[:k]
                assert sorted(H.highest(x, order, k).tolist()) == sorted(want)
    x = np.full(20, np.nan)
    assert H.spearman(np.arange(20), x, H.along(x)) is None and sorted(H.highest(x, H.along(x), 3).tolist()) == [0, 1, 2]


def test_models_reach_the_task_of_their_seed(spark):
    """By seed, every model meets all variants of its assay, and no others; values arrive as they are."""
    v = spark.createDataFrame([(a, f"A{i}V:A{i + 1}V", i, i / 7) for a in "xy" for i in range(30 if a == "x" else 20)], "assay string, mutant string, item long, z double")
    given = [(a, s, 10 * s + k, [float("nan"), None, 1 / 3]) for a in "xy" for s in range(3) for k in range(2)]
    model = spark.createDataFrame(given, "assay string, seed int, split int, list array<double>")

    def each(rows, m):
        assert np.isnan(m["list"][0]) and m["list"][1:] == [None, 1 / 3]
        yield pa.table({"split": [m["split"]], "assay": [m["assay"]], "n": [len(rows)], "z": [float(rows["z"].sum())], "parts": [int(rows.sizes.sum())]})

    got = sorted(map(tuple, H.by_seed(v, model, ["z"], each, "split int, assay string, n long, z double, parts long").collect()))
    n = {"x": 30, "y": 20}
    assert [(*g[:3], round(g[3], 9), g[4]) for g in got] == sorted((s, a, n[a], round(sum(i / 7 for i in range(n[a])), 9), 2 * n[a]) for a, _, s, _ in given)
