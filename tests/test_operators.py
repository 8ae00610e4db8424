"""Operators on hand-made rows: ties, few rows, constant values, odd texts, and some invariants."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayscope.functions import scalars as S
from assayscope.operators import acquisition as A
from assayscope.operators import calibration as C
from assayscope.operators import epistasis as E
from assayscope.operators import metrics as M
from assayscope.operators import ranking as K
from assayscope.operators import resampling as R
from assayscope.operators import sampling as P
from assayscope.operators import structure as T
from assayscope.operators.additive import additive_scores
from assayscope.sources import ingest as I


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_parse_finite(spark):
    texts = [("1.5",), (" -2 ",), ("nan",), ("None",), ("inf",), ("",), ("x",), (None,), ("NA",)]
    got = spark.createDataFrame(texts, "t string").select(S.parse_finite(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [1.5, -2.0, None, None, None, None, None, None, None]


def test_mutation_strings(spark):
    d = spark.createDataFrame([("",), ("WT",), ("_wt",), ("A1V",), ("A1V:C22D",), ("A1V:A1V",)], "m string")
    got = d.select(S.mutation_order(F.col("m")), F.array_join(S.mutation_sites(S.mutation_parts(F.col("m"))), ","), F.size(S.mutation_pairs(S.mutation_parts(F.col("m"))))).collect()
    assert [tuple(r) for r in got] == [(0, "", 0), (0, "", 0), (0, "", 0), (1, "1", 0), (2, "1,22", 1), (2, "1", 1)]


def test_spearman_ties_and_small_groups(spark):
    d = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 9.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 5.0), ("d", None, 1.0)],
        "g string, y double, p double",
    )
    got = {r.g: (r.n, r.spearman) for r in M.spearman(d, ["g"], "y", "p").collect()}
    assert got["a"][1] == pytest.approx(1.0)
    assert got["b"] == (2, None) and got["c"] == (3, None) and "d" not in got


def test_distributed_midrank_equals_window(spark):
    d = spark.createDataFrame([("g", float(i % 7), i) for i in range(50)] + [("h", 1.0, i) for i in range(9)], "g string, v double, i int")
    both = K.distributed_midrank(d, ["g"], "v", "far").withColumn("near", K.midrank("v", ["g"]))
    assert both.where("far <> near").count() == 0 and both.count() == 59


def test_top_metrics_with_k_above_n(spark):
    d = spark.createDataFrame([("g", f"m{i}", float(i), float(i)) for i in range(5)], "g string, m string, y double, p double")
    out = M.top_metrics(M.paired_rows(d, ["g"], "y", "p", "m"), ["g"], "y", "p", "m", 100).first()
    assert out.ndcg_at_k == pytest.approx(1.0) and out.top1pct_recall_at_k == 1.0 and out.best_true_in_pred_top_k == 4.0


def test_auc_of_reversed_scores(spark):
    d = spark.createDataFrame([("g", f"m{i}", int(i % 3 == 0), float((i * 7) % 11), -float((i * 7) % 11)) for i in range(20)], "g string, m string, l int, p double, q double")
    a = M.binary_metrics(d, ["g"], "l", "p", "m").first().auc
    b = M.binary_metrics(d, ["g"], "l", "q", "m").first().auc
    assert a + b == pytest.approx(1.0)


def test_splits_are_disjoint_and_sized(spark):
    v = spark.createDataFrame([("a", f"m{i}", 1 if i < 8 else 2 if i < 12 else 3) for i in range(60)], "assay string, mutant string, ord int")
    s = P.low_n_splits(spark, v, [0, 1], [10, 100])
    assert s.groupBy("assay", "seed", "budget", "regime", "mutant").count().where("count > 1").count() == 0
    got = {(r.regime, r.budget): r.n for r in s.where("seed = 0").groupBy("regime", "budget").agg(F.count("*").alias("n")).collect()}
    assert got == {("single_only", 10): 8, ("single_only", 100): 8, ("mixed_random", 10): 10, ("mixed_random", 100): 60, ("single_plus_double", 10): 10, ("single_plus_double", 100): 60}


def test_additive_data_has_no_residual(spark):
    one = {f"A{i}V": float(i) for i in range(1, 6)}
    mean = sum(one.values()) / len(one)
    v = [("a", m, s, 1) for m, s in one.items()] + [("a", f"{x}:{y}", one[x] + one[y] - mean, 2) for x in one for y in one if x < y]
    d = spark.createDataFrame(v, "assay string, mutant string, dms_score double, ord int")
    res = E.strict_double_residuals(d, 2)
    assert res.count() == 10 and res.agg(F.max("abs_epistasis_residual")).first()[0] == pytest.approx(0.0, abs=1e-8)
    scored = additive_scores(d, d.where("ord = 1"))
    assert scored.where("abs(score - dms_score) > 1e-8").count() == 0


def test_additive_without_singles(spark):
    d = spark.createDataFrame([("a", "A1V:C2D", 4.0, 2), ("a", "A1V:E3F", 2.0, 2)], "assay string, mutant string, dms_score double, ord int")
    assert {r.score for r in additive_scores(d, d).collect()} == {3.0}


def test_linear_fits(spark):
    d = spark.createDataFrame([("g", float(x), float(x * x % 5), 2.0 * x - 3.0 * (x * x % 5) + 1.0) for x in range(10)] + [("c", 1.0, 1.0, float(x)) for x in range(4)], "g string, a double, z double, y double")
    two = {r.g: r for r in C.linear_2(d, ["g"], "a", "z", "y").collect()}
    assert two["g"].slope_a == pytest.approx(2.0, abs=1e-6) and two["g"].slope_z == pytest.approx(-3.0, abs=1e-6)
    one = {r.g: r for r in C.linear_1(d, ["g"], "a", "y").collect()}
    assert one["c"].slope == 0.0 and one["c"].intercept == pytest.approx(1.5)


def test_ridge_matches_normal_equations(spark):
    import numpy as np

    x = np.array([[1.0, 0.0], [2.0, 1.0], [3.0, 0.5], [4.0, -1.0]])
    y = np.array([1.0, 2.0, 2.5, 5.0])
    c = np.hstack([np.ones((4, 1)), x])
    w = np.linalg.solve(c.T @ c + np.diag([0, 1.0, 1.0]), c.T @ y)
    t = spark.createDataFrame([("g", f"i{i}", f"f{j}", float(x[i, j]), float(y[i])) for i in range(4) for j in range(2)], "g string, item string, feature string, value double, y double")
    got = {r.item: r.score for r in C.ridge_grouped(t, t.drop("y"), ["g"], "item", "y").collect()}
    assert [got[f"i{i}"] for i in range(4)] == pytest.approx(list(c @ w))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sets(st.integers(0, 5), min_size=1, max_size=3)), min_size=1, max_size=30), st.integers(1, 6))
def test_greedy_shortlist_is_enough(items, batch):
    all_rows = [(f"m{i:02d}", float(s), frozenset(t)) for i, (s, t) in enumerate(items)]
    span = max(r[1] for r in all_rows) - min(r[1] for r in all_rows)
    most = max(len(r[2]) for r in all_rows)
    edge = sorted((r[1] for r in all_rows), reverse=True)[: batch][-1]
    short = [r for r in all_rows if r[1] >= edge - 0.02 * span * most]
    assert A.greedy(short, batch, 0.02 * span) == A.greedy(all_rows, batch, 0.02 * span)
    # the same by looking at every row at each step
    chosen, used, left = [], set(), list(all_rows)
    while left and len(chosen) < batch:
        best = min(left, key=lambda r: (-(r[1] - 0.02 * span * len(r[2] & used)), r[0]))
        left.remove(best)
        chosen.append(best[0])
        used |= best[2]
    assert A.greedy(all_rows, batch, 0.02 * span) == (chosen, True)


def test_permutation(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5, 0.25, 1.0])] + [("z", 0, 0.0), ("z", 1, 0.0)], "g string, i int, d double")
    got = {r.g: r for r in R.paired_permutation(d, ["g"], "i", "d").collect()}
    assert got["a"].p_value == pytest.approx(2 / 8) and got["z"].p_value == 1.0 and got["z"].n == 0


def test_neighbours_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    pts = [(0, i, rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for i in range(60)]
    got = {r.residue: r.neighbours for r in T.radius_counts(spark.createDataFrame(pts, "structure int, residue int, x double, y double, z double"), 10.0).collect()}
    want = {a[1]: sum(a[1] != b[1] and math.dist(a[2:], b[2:]) <= 10.0 for b in pts) for a in pts}
    assert got == want


def test_pair_distance_needs_all_coordinates(spark):
    c = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 3.0, 4.0, 0.0)], "structure int, residue int, x double, y double, z double")
    s = spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [1, 9]), (0, 3, [1])], "structure int, variant int, positions array<int>")
    assert {r.variant: r.min_distance for r in T.pair_distances(s, c).collect()} == {1: 5.0, 2: None, 3: None}


def test_sources(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "one.csv").write_text("mutant,score\nA1V,1.5\n")
    (tmp_path / "csv" / "two.csv").write_text("mutant,score\nA1V,\n")
    assert rows(I.scan_assays(spark, str(tmp_path / "csv"), ["mutant", "score"]).select("assay", "score"), "assay") == [("one", "1.5"), ("two", None)]
    (tmp_path / "aln").mkdir()
    (tmp_path / "aln" / "p.a2m").write_text(">first\nAC-\nGT\n>second\nA\n")
    assert rows(I.read_alignment_records(spark, str(tmp_path / "aln")), "header") == [("p", "first", "AC-GT"), ("p", "second", "A")]
    atom = "ATOM      1  CA  ALA A   7      11.000  12.500  -3.250  1.00  0.00           C"
    lines = spark.createDataFrame([("s", 0, atom), ("s", 1, atom.replace("11.000", "10.000")), ("s", 2, "END")], "structure string, line_no int, value string")
    assert rows(I.read_ca_coords(lines), "residue") == [("s", 7, 10.0, 12.5, -3.25)]


def test_union_checked_rejects_other_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y int")
    with pytest.raises(ValueError):
        I.union_checked(a, b)


def test_last_wins(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, n int, v int")
    assert rows(I.last_wins(d, ["k"], "n").select("k", "v"), "k") == [("a", 6), ("b", 7)]


def test_best_gain(spark):
    d = spark.createDataFrame(
        [("a", "none", "additive", 0.5, "full"), ("a", "m", "linear", 0.2, "full"), ("a", "n", "linear", 0.4, "full"), ("a", "n", "linear", 0.2, "full"), ("b", "m", "linear", 0.9, "full")],
        "assay string, method string, model string, p double, mode string",
    )
    base = F.col("model") == "additive"
    got = rows(C.best_gain(d, "assay", "method", "p", base, "mode"), "assay")
    assert got[0][:2] == ("a", "full") and math.isclose(got[0][2], -0.2) and got[1] == ("b", "full", None)
    mixed = d.withColumn("mode", F.when(F.col("method") == "n", "sample").otherwise("full"))
    with pytest.raises(Exception, match="several modes"):
        C.best_gain(mixed, "assay", "method", "p", base, "mode").collect()


def test_predictor_category(spark):
    d = spark.createDataFrame([("EVE_single",), ("VenusREM",), ("VenusREM2",), ("ESM-IF1",), ("ESM2",), ("",), (None,)], "m string")
    got = [r[0] for r in d.select(S.predictor_category(F.col("m"))).collect()]
    assert got == ["evolution_or_msa", "other_variant_effect", "other", "structure_aware", "sequence_plm", "other", "other"]


def test_method_counts_lists_empty_columns(spark):
    d = spark.createDataFrame([("a", 1.0, None), ("b", None, None)], "assay string, m double, n double")
    assert rows(I.method_counts(d, ["assay"]), "method") == [("m", 1), ("n", 0)]
