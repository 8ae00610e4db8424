"""Ranks, shares, cuts, resampling, fits and batches against brute force, with ties, hot values and odd groups."""

import bisect
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayscope.operators import acquisition as A
from assayscope.operators import calibration as C
from assayscope.operators import metrics as M
from assayscope.operators import ordering as O
from assayscope.operators import ranking as K
from assayscope.operators import resampling as R

rnd = random.Random(3)
#: g has many ties and one value that a third of its rows hold; h is small; n has no group name.
ROWS = [("g", float(rnd.choice([1, 1, 2, 3, rnd.randrange(40)])), float(rnd.randrange(25)), f"m{i:04d}") for i in range(900)]
ROWS += [("h", float(i % 3), float(-i), f"m{i:04d}") for i in range(7)] + [(None, 1.0, 2.0, "m1"), (None, 0.5, 3.0, "m2"), ("e", None, 1.0, "m1")]


@pytest.fixture(scope="module")
def d(spark):
    return spark.createDataFrame(ROWS, "g string, v double, p double, m string").repartition(5)


def groups(column=1):
    out = {}
    for r in ROWS:
        if r[column] is not None:
            out.setdefault(r[0], []).append(r)
    return out


def test_positions_and_running_sums(d):
    rows = d.where("v is not null")
    got = {(r.g, r.m): (r.i, r.n) for r in O.positions(rows, ["g"], [F.col("v").desc(), "m"], "i", "n").collect()}
    sums = {(r.g, r.m): (r.low, r.total) for r in O.running(rows, ["g"], ["v", "m"], "p", "low", "total").collect()}
    for g, mine in groups().items():
        for i, r in enumerate(sorted(mine, key=lambda r: (-r[1], r[3]))):
            assert got[g, r[3]] == (i, len(mine))
        low = 0.0
        for r in sorted(mine, key=lambda r: (r[1], r[3])):
            assert sums[g, r[3]] == (low, sum(x[2] for x in mine))
            low += r[2]
    assert len(got) == len(sums) == sum(map(len, groups().values()))


def test_probes_that_are_no_scores(spark, d):
    probes = [("g", x) for x in (-1.0, 0.5, 1.0, 2.5, 99.0, 1.0)] + [("h", 0.0), ("h", None), ("none", 1.0), (None, 0.75)]
    out = K.shares_below(d, spark.createDataFrame(probes, "g string, v double").withColumn("id", F.monotonically_increasing_id()), ["g"], "v", "share").collect()
    known = {g: sorted(r[1] for r in mine) for g, mine in groups().items()}
    assert len(out) == len(probes)
    for r in out:
        want = None if r.v is None or r.g not in known else bisect.bisect_right(known[r.g], r.v) / len(known[r.g])
        assert r.share == want


def test_cuts_and_heads_equal_full_sorts(d):
    share = {"a": M.top_size(F.col("n"), 0.01), "b": M.top_size(F.col("n"), 0.35), "c": F.lit(10_000).cast("long")}
    cuts = {r.g: r for r in K.top_cuts(d, ["g"], "v", "m", share, "top").collect()}
    heads = {}
    for r in K.top_k(d.where("v is not null"), ["g"], "v", "m", 12).collect():
        heads.setdefault(r.g, []).append((r["rank"], r.m))
    for g, mine in groups().items():
        order = sorted(mine, key=lambda r: (-r[1], r[3]))
        for name, size in (("a", max(1, math.ceil(len(mine) * 0.01))), ("b", max(1, math.ceil(len(mine) * 0.35))), ("c", len(mine))):
            cut = cuts[g][f"top_{name}"]
            assert (cut.v, cut.m) == (order[size - 1][1], order[size - 1][3])
        assert (cuts[g].n, cuts[g].top_lo, cuts[g].top_hi) == (len(mine), order[-1][1], order[0][1])
        assert sorted(heads[g]) == [(i + 1, r[3]) for i, r in enumerate(order[:12])]


def test_order_statistics(d):
    n = F.col("n")
    got = {r.g: r for r in K.at_indexes(d, ["g"], "v", low=F.floor(n / 3), high=F.floor(n * 2 / 3), last=n - 1, beyond=n).collect()}
    for g, mine in groups().items():
        v = sorted(r[1] for r in mine)
        assert (got[g].low, got[g].high, got[g].last, got[g].beyond) == (v[len(v) // 3], v[2 * len(v) // 3], v[-1], None)


def test_rank_correlation_and_auc_equal_windows(d):
    by = ["g"]
    got = {r.g: r.spearman for r in M.spearman(d.where("g is not null"), by, "v", "p").collect()}
    w = d.where("v is not null and g is not null").withColumns({"a": K.midrank("v", by), "b": K.midrank("p", by)})
    for r in w.groupBy("g").agg(M.pearson("a", "b").alias("x")).collect():
        assert got[r.g] == (None if r.x is None else pytest.approx(r.x, abs=1e-12))
    labelled = d.withColumn("l", (F.crc32("m") % 3 == 0).cast("int"))
    auc = {r.g: r.auc for r in M.auc_sums(labelled, by, "l", "p").collect()}
    rows = [(r.g, r.l, r.p) for r in labelled.collect()]
    for g in ("g", "h"):
        pos, neg = ([p for x, l, p in rows if x == g and l == k] for k in (1, 0))
        assert auc[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_ranges_split_a_group(spark, d):
    # no range of the order holds the whole group
    t = O.ranged(d.where("g = 'g'"), ["g", "v", "m"], parts=6)
    sizes = [r["count"] for r in t.groupBy("__part").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 400


@pytest.mark.parametrize("n", [1, 2, 5, 10, 13])
def test_sign_flips_equal_all_patterns(spark, n):
    pick = random.Random(n)
    diffs = {"a": [pick.randint(-9, 9) or 1 for _ in range(n)], "tied": [1] * n, "even": [(-1) ** i for i in range(n)]}
    rows = [(g, i, x / 8) for g, v in diffs.items() for i, x in enumerate(v)] + [("a", 99, 0.0)]
    got = {r.g: r for r in R.paired_permutation(spark.createDataFrame(rows, "g string, i int, x double"), ["g"], "i", "x").collect()}
    for g, v in diffs.items():
        hits = sum(abs(sum(s * x for s, x in zip(signs, v))) >= abs(sum(v)) for signs in itertools.product((1, -1), repeat=n))
        assert got[g].p_value == hits / 2**n and got[g].n == n


def test_many_sign_flips_without_listing_them(spark):
    # 2**40 patterns of equal differences: only the two extreme ones reach the sum
    rows = [("g", i, 0.5) for i in range(24)]
    got = R.paired_permutation(spark.createDataFrame(rows, "g string, i int, x double"), ["g"], "i", "x", exact_up_to=24).first()
    assert got.p_value == 2 / 2**24


def test_bootstrap_by_weights_covers_the_mean(spark):
    pick = random.Random(1)
    values = [pick.gauss(10, 4) for _ in range(400)]
    d = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("one", 0, 3.0), ("g", 9999, None)], "g string, i int, v double")
    got = {r.g: r for r in R.bootstrap_weights_ci(d, ["g"], "i", "v", 1000).collect()}
    spread = np.std(values) / math.sqrt(len(values))
    assert got["g"].n == 400 and got["g"].mean == pytest.approx(np.mean(values))
    assert got["g"].lo == pytest.approx(np.mean(values) - 1.96 * spread, abs=0.25 * spread) and got["g"].hi == pytest.approx(np.mean(values) + 1.96 * spread, abs=0.25 * spread)
    assert (got["one"].lo, got["one"].hi) == (3.0, 3.0)
    assert R.POISSON_STEPS[0] == round(math.exp(-1) * R.PRIME)


def sparse(spark, x, y, group="g"):
    return spark.createDataFrame([(group, f"i{i:04d}", f"f{j}", float(x[i, j]), float(y[i])) for i in range(len(x)) for j in range(x.shape[1])], "g string, item string, feature string, value double, y double")


def solved(x, y, ridge):
    c = np.hstack([np.ones((len(x), 1)), x])
    a = np.vstack([c, np.sqrt(ridge) * np.eye(c.shape[1])[1:]])
    return c @ np.linalg.lstsq(a, np.concatenate([y, np.zeros(x.shape[1])]), rcond=None)[0]


def test_ridge_tree_equals_a_dense_solve(spark, monkeypatch):
    monkeypatch.setattr(C, "QR_ROWS", 16)
    monkeypatch.setattr(C, "QR_FAN", 2)
    g = np.random.default_rng(1)
    x = g.standard_normal((300, 4))
    x[:, 3] = x[:, 2] + 1e-7 * g.standard_normal(300)  # normal equations would lose this column
    y = x @ [1.0, -2.0, 3.0, 500.0] + 4.0
    t = sparse(spark, x, y)
    got = {r.item: r.score for r in C.ridge_grouped(t, t.drop("y"), ["g"], "item", "y", 1e-12).collect()}
    assert [got[f"i{i:04d}"] for i in range(300)] == pytest.approx(list(solved(x, y, 1e-12)), abs=1e-6)


def test_ridge_refuses_small_groups(spark):
    g = np.random.default_rng(2)
    t = sparse(spark, g.standard_normal((5, 3)), g.standard_normal(5), "enough").unionByName(sparse(spark, g.standard_normal((4, 3)), g.standard_normal(4), "few"))
    assert {r.g for r in C.ridge_grouped(t, t.drop("y"), ["g"], "item", "y", spare=2).collect()} == {"enough"}
    assert {r.g for r in C.ridge_grouped(t, t.drop("y"), ["g"], "item", "y").collect()} == {"enough", "few"}


def test_kernel_features_approach_the_kernel_and_its_regression(spark):
    g = np.random.default_rng(3)
    x = g.uniform(-1.5, 1.5, (40, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    d = spark.createDataFrame([("g", f"i{i:04d}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g string, item string, a double, b double, y double")
    f = C.kernel_features(d, ["g"], "item", ["a", "b"], size=512)
    z = f.toPandas().pivot(index="item", columns="feature", values="value").sort_index().to_numpy()
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    assert np.abs(z @ z.T - exact).max() < 0.2
    t = f.join(d.select("item", "y"), "item")
    got = {r.item: r.score for r in C.ridge_grouped(t, f, ["g"], "item", "y").collect()}
    assert [got[f"i{i:04d}"] for i in range(40)] == pytest.approx(list(solved(z, y, 1.0)), abs=1e-8)
    # the kernel's own regression, with unit noise
    own = exact @ np.linalg.solve(exact + np.eye(40), y - y.mean()) + y.mean()
    assert np.corrcoef(own, [got[f"i{i:04d}"] for i in range(40)])[0, 1] > 0.97


@pytest.mark.parametrize("head", [2000, 6, 2])
def test_diverse_batches_equal_plain_greedy(spark, head):
    pick = random.Random(head)
    rows = [(g, ":".join(f"A{s}V" for s in sorted(pick.sample(range(1, 9), pick.randint(1, 3)))) + f":B{100 + i}C", float(pick.randrange(60))) for g in "abc" for i in range(60)]
    # many rows of one site set, so that heads are cut
    rows += [("d", f"A1{chr(65 + i % 26)}:A2{chr(65 + i // 26)}", float(i % 50)) for i in range(120)] + [("one", "A1V", 1.0)]
    got = {}
    for r in A.acquire_diverse(spark.createDataFrame(rows, "g string, m string, s double"), ["g"], "m", "s", 5, 0.2, head).collect():
        got.setdefault(r.g, []).append((r["rank"], r.m))
    for g in {r[0] for r in rows}:
        mine = [(m, s, frozenset(t[1:-1] for t in m.split(":") if len(t) >= 3)) for x, m, s in rows if x == g]
        span = max(r[1] for r in mine) - min(r[1] for r in mine)
        want, used, left = [], set(), list(mine)
        while left and len(want) < 5:
            best = min(left, key=lambda r: (-(r[1] - 0.2 * span * len(r[2] & used)), r[0]))
            left.remove(best)
            want.append(best[0])
            used |= best[2]
        assert [m for _, m in sorted(got[g])] == want
