"""Findings of the third round: each test fails on the code before."""

import random
import re

from pyspark.sql import functions as F

from assayscope.plans import ranking, registry


def test_tertile_cuts_are_of_the_same_means(spark, monkeypatch):
    # means that differ each time they are computed, as sums of doubles do between two runs
    noise = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    monkeypatch.setattr(ranking, "means25", lambda s, sf: s.range(25).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("assay"), noise().alias("value")))
    for _ in range(3):
        n = {r.tertile: r["count"] for r in registry.queries()["tertile_cut"](spark, "").groupBy("tertile").count().collect()}
        assert n == {"low": 9, "mid": 7, "high": 9}


def test_first_by_hash_orders_a_group_whole_where_digests_are_no_sample(spark):
    from assayscope.operators import sampling as P

    d = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("item"), F.when(F.col("id") % 2 == 0, F.md5(F.col("id").cast("string"))).otherwise(F.lpad(F.col("id").cast("string"), 32, "f")).alias("key"))
    got = {g: sorted((r["rank"], r["item"]) for r in rows) for g, rows in ((g, [r for r in P.first_by_hash(d, ["g"], "item", 7, F.col("key")).collect() if r.g == g]) for g in (0, 1))}
    for g, rows in got.items():
        want = sorted(((r.key, r.item) for r in d.where(f"g = {g}").collect()))[:7]
        assert rows == [(i + 1, item) for i, (_, item) in enumerate(want)]


def test_held_out_rows_are_ranked_alike(spark, monkeypatch):
    """The same correlations by whole assays and by Spark's own ordering."""
    from assayscope.operators import heldout as H

    def run(name):
        return sorted(map(tuple, registry.queries()[name](spark, "/root/testdata/sf0.001").collect()), key=repr)

    found = {n: run(n) for n in ("additive_lookup",)}
    monkeypatch.setattr(H, "WHOLE", 10)
    for n, rows in found.items():
        assert rows and run(n) == rows, n


def test_neighbours_in_split_cells_are_counted_once(spark, monkeypatch):
    """Cells beyond a task's rows are split; pairs are counted without a join that lists them."""
    from assayscope.operators import structure as T

    monkeypatch.setattr(T, "POINTS", 3)
    monkeypatch.setattr(T, "OTHERS", 4)
    rng = random.Random(3)
    pts = [(s, r, *[rng.uniform(-9, 9) for _ in range(3)]) for s in (1, 2) for r in range(40)]
    d = spark.createDataFrame(pts, "structure int, residue int, x double, y double, z double")
    near = lambda a, b: a[0] == b[0] and a[1] != b[1] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 25.0
    got = {(r.structure, r.residue): r.neighbours for r in T.radius_counts(d, 5.0).collect()}
    assert got == {p[:2]: sum(near(p, q) for q in pts) for p in pts}


def test_bootstrap_adds_up_draws_in_tasks(spark):
    """All draws of a row are sums of its task: no row is listed once for each draw. Sums are exact, of any sign and size."""
    from decimal import Decimal

    import numpy as np

    from assayscope.operators import resampling as R

    # numbers at the ends and at the steps of the counts
    r = np.array([0, 1, 2, R.PRIME - 1, R.PRIME // 2, *R.POISSON_STEPS], dtype=np.int64)
    want = []
    for x in r.tolist():
        for b in range(50):
            y = (x + b * R.STRIDE) % R.PRIME
            y = (y * y + x) % R.PRIME
            y = (y * y + b) % R.PRIME
            want.append(sum(y >= t for t in R.POISSON_STEPS))
    counts = R.poisson_counts(r, np.arange(50))
    assert counts.ravel().tolist() == want

    rows = [("g", i, (-1) ** i * (10.0**11 + i / 7)) for i in range(600)] + [("h", 1, 2.5)]
    d = spark.createDataFrame(rows, "g string, i int, v double")
    keyed = d.select("g", F.col("v").cast("decimal(28,10)").alias("v"), (R.hash_int(F.lit("boot"), "g", "i") % R.PRIME).alias("r")).collect()
    got = {x.g: x for x in R.bootstrap_weights_ci(d, ["g"], "i", "v", 40).collect()}
    for g in "gh":
        of = [x for x in keyed if x.g == g]
        w = R.poisson_counts(np.array([x.r for x in of], dtype=np.int64), np.arange(40)).astype(int)
        means = [float(sum((x.v * int(k) for x, k in zip(of, w[:, b])), Decimal(0))) / int(w[:, b].sum()) for b in range(40) if w[:, b].sum()]
        assert abs(got[g].lo - np.quantile(means, 0.025)) < 1e-6 and abs(got[g].hi - np.quantile(means, 0.975)) < 1e-6


def test_pair_corrections_are_made_where_the_variants_are():
    """Known pairs and their means of each budget, repeated parts and huge residuals included, against a count by hand."""
    from fractions import Fraction

    import numpy as np
    import pyarrow as pa

    from assayscope.operators import heldout as H

    rng = random.Random(5)
    parts = [[rng.choice("abcdef") for _ in range(rng.randint(3, 5))] for _ in range(60)]
    rows = H.Variants(pa.table({"item": range(60), "parts": parts}))
    for scale in (1.0, 1e9):
        measured = [{"a": a, "b": b, "value": round(scale * rng.uniform(-3, 3), 9 if scale == 1 else 2), "o": o} for o, (a, b) in enumerate([("a", "b"), ("c", "c"), ("b", "d"), ("b", "a"), ("e", "z"), ("d", "f")], 1)]
        for budget, known, mean in rows.pair_means(measured, [2, 4, 100]):
            for i, p in enumerate(parts):
                pairs = [sorted((p[j], p[k])) for j in range(len(p)) for k in range(j + 1, len(p))]
                of = [Fraction(str(m["value"])) for m in measured for q in pairs if m["o"] <= budget and q == sorted((m["a"], m["b"]))]
                assert known[i] == len(of)
                assert np.isclose(mean[i], float(sum(of) / len(of)) if of else 0.0, rtol=1e-12, atol=0)


def test_pair_runs_are_ranked_alike(spark, monkeypatch):
    """The same by whole assays and by Spark's own ordering; and no rows of the runs are written by the first."""
    from assayscope.operators import heldout as H
    from assayscope.plans import epistasis as P

    def run(name):
        return sorted(map(tuple, registry.queries()[name](spark, "/root/testdata/sf0.01").collect()), key=repr)

    with monkeypatch.context() as m:
        m.setattr(P, "pairwise", None)
        found = {n: run(n) for n in ("pairwise_residual", "pairwise_calibrated")}
    monkeypatch.setattr(H, "WHOLE", 10)
    for n, rows in found.items():
        assert rows and run(n) == rows, n


def test_pooled_regressors_predict_in_blocks(spark, monkeypatch):
    """Exported models predict as Spark's do, and no held-out row is written."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from assayscope.plans import calibration as C

    x = np.random.default_rng(4).normal(size=(400, 6))
    d = spark.createDataFrame([(Vectors.dense(r), float(r[0] * r[1] + r[2])) for r in x], ["features", "label"])
    for name, est in C.zoo().items():
        fitted = est.fit(d)
        want = {tuple(r.features): r.prediction for r in fitted.transform(d).collect()}
        got = C.regressed(C.exported(fitted, spark), np.ascontiguousarray(x.T))
        np.testing.assert_allclose(got, [want[tuple(r)] for r in x], rtol=1e-9, atol=1e-9, err_msg=name)
    names, plain = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: names.append(name) or plain(df, name))
    assert C.pooled_ml_regressors(spark, "/root/testdata/sf0.001").count() > 0 and "held" not in names


def test_checked_summaries_share_their_rows(spark, monkeypatch):
    """The variants and trajectories are formed once for all summaries, and a summary is computed before its rows are numbered."""
    from assayscope.plans import statistics as P
    from assayscope.sources import fixtures as X

    formed, numbered = [], []
    for name in ("variants", "variants25", "trajectories"):
        monkeypatch.setattr(X, name, lambda s, sf, name=name, make=getattr(X, name): formed.append(name) or make(s, sf))
    monkeypatch.setattr(P.I, "out_of_range", lambda table, *a, check=P.I.out_of_range: numbered.append(table.inputFiles()) or check(table, *a))
    assert registry.queries()["qc_range_check"](spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(formed) == ["trajectories", "variants", "variants25"]
    assert len(numbered) == len(P.CHECKED) and all("/root/testdata" not in f for files in numbered for f in files)


def test_low_n_queries_judge_the_splits_they_ask_for(spark, monkeypatch):
    """Splits that a query leaves out are neither drawn nor judged; those that it asks for are the same as among all."""
    from assayscope.plans import calibration as C
    from assayscope.plans import sampling as S

    asked, plain = [], S.P.low_n_splits
    monkeypatch.setattr(S.P, "low_n_splits", lambda spark, v, seeds, budgets, regimes=S.P.REGIMES: asked.append((tuple(budgets), tuple(regimes))) or plain(spark, v, seeds, budgets, regimes))
    sf = "/root/testdata/sf0.001"
    every = {tuple(r) for r in C.low_n_calibration(spark, sf).collect()}
    some = {tuple(r) for r in C.rounded(C.low_n(spark, sf, wanted=["additive", "linear_1__m_qty"], budgets=[20], regimes=["mixed_random"])).collect()}
    assert some == {r for r in every if r[2:4] == (20, "mixed_random") and r[4:6] in (("none", "additive"), ("m_qty", "linear_1"))}
    assert C.low_n_gain(spark, sf).count() == 5 and C.paired_regime_join(spark, sf).count() > 0
    assert asked == [((20, 50, 100), S.P.REGIMES), ((20,), ("mixed_random",)), ((20,), ("mixed_random",)), ((20, 50, 100), ("single_only", "single_plus_double"))]


def test_predictions_of_a_split_share_its_additive_one_and_the_orders_of_scores(monkeypatch):
    """The additive prediction is summed once a split, and ranks along a known order, risen or not, are those of a sort."""
    import numpy as np
    import pyarrow as pa

    from assayscope.operators import heldout as H
    from assayscope.plans import calibration as C

    x = np.random.default_rng(2).integers(0, 40, 300) / 7
    rows = H.Variants(pa.table({"item": range(300), "parts": [["a", "b"][: i % 3] for i in range(300)], **{m: x for m in C.X.METHODS}}))
    sums, plain = [], rows.part_sums
    monkeypatch.setattr(rows, "part_sums", lambda w: sums.append(w) or plain(w))
    for slope in (0.3, -0.2, 0.0):
        m = {"base": 1.0, "effects": [{"part": "a", "units": 5}], "taken": []} | {f"{k}_{c}": slope for k in C.X.METHODS for c in ("s1", "i1", "slope_a", "slope_z", "i2")}
        for c in C.MODELS:
            p = C.predicted(rows, m, [c])[c]
            want = [(p < v).sum() + ((p == v).sum() + 1) / 2 for v in p]
            for at in (rows.ascending("m_qty"), rows.ascending("m_qty")[::-1], None):
                order, ranks = H.midranks(p, at)
                assert ranks.tolist() == [want[i] for i in order]
    assert len(sums) == 3


def test_covered_points_are_looked_for_once(spark, monkeypatch):
    """A residue's surface is computed before it is cut and joined, and covered points are those that all pairs tell."""
    from assayscope.operators import structure as T
    from assayscope.plans import structure as S

    monkeypatch.setattr(T, "POINTS", 300)
    monkeypatch.setattr(T, "OTHERS", 20)
    rng = random.Random(8)
    pts = [(1, r, *[rng.uniform(-6, 6) for _ in range(3)]) for r in range(70)]
    d = spark.createDataFrame(pts, "structure int, residue int, x double, y double, z double")
    want = {}
    for _, r, *a in pts:
        ball = [[p + 4.0 * u for p, u in zip(a, v)] for _, *v in T.sphere_points()]
        want[r] = sum(any(q[1] != r and sum((s - t) ** 2 for s, t in zip(b, q[2:])) <= 16.0 for q in pts) for b in ball)
    assert {r.residue: r.covered for r in T.residue_sasa(d).collect()} == want
    seen, plain = [], S.K.at_indexes
    monkeypatch.setattr(S.K, "at_indexes", lambda t, *a, **k: seen.append(t.inputFiles()) or plain(t, *a, **k))
    assert S.sasa_summary(spark, "/root/testdata/sf0.001").count() > 0 and S.exposure_summary(spark, "/root/testdata/sf0.001").count() > 0
    assert all("/residues-" in f for files in seen for f in files) and len(seen) == 2


def test_neighbours_are_counted_in_as_many_tasks_as_pairs_ask_for(spark, monkeypatch):
    """Cells are dealt to more tasks as pairs grow, whatever the session's shuffles; rows without a place are near to nothing."""
    from assayscope.operators import structure as T

    monkeypatch.setattr(T, "PAIRS", 50)
    rng = random.Random(6)
    pts = [(s, r, *[rng.uniform(-9, 9) for _ in range(3)]) for s in (1, 2) for r in range(40)] + [(1, 40, float("nan"), 0.0, 0.0), (1, 41, 0.0, float("inf"), 0.0)]
    d = spark.createDataFrame(pts, "structure int, residue int, x double, y double, z double")
    near = lambda a, b: a[0] == b[0] and a[1] != b[1] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 25.0
    got = {(r.structure, r.residue): r.neighbours for r in T.radius_counts(d, 5.0).collect()}
    assert got == {p[:2]: sum(near(p, q) for q in pts) for p in pts}
    found = T.near_counts(d.withColumnRenamed("residue", "owner").withColumn("i", F.lit(0)), d, 5.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert max(map(int, re.findall(r"hashpartitioning\(.*, (\d+)\)", plan))) > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_distances_at_the_radius_are_told_exactly():
    """Single precision leaves pairs near the radius to doubles: integers have many at it, and far from the origin too."""
    import numpy as np

    from assayscope.operators import structure as T

    rng = np.random.default_rng(7)
    for scale, far in ((1.0, 0.0), (0.1, 0.0), (1.0, 1e7)):
        x, near = (np.sort(rng.integers(-w, w, (n, 3)), axis=0) * scale + far for w, n in ((5, 300), (15, 5000)))
        for p in (x, near):
            p[:, 1:] = rng.permutation(p[:, 1:])
        d = (x[:, None] - near[None]) ** 2
        want = (d[..., 0] + d[..., 1] + d[..., 2] <= (10 * scale) ** 2).sum(axis=1)
        assert want.min() > 0 and T.counts_within(x, near, 10 * scale).tolist() == want.tolist()
