"""The ordinal fit against a direct optimiser, and scores against a text-by-text computation."""

import re

import numpy as np
import pyarrow as pa
from assayscope.llm import quality
from assayscope.llm import words as W


def sample(n=240, columns=6, seed=2):
    g = np.random.default_rng(seed)
    x = (g.random((n, columns)) < 0.4).astype(float)
    margin = x @ np.array([2.0, -1.5, 0.8, 0.0, -0.4, 1.2])[:columns] + g.logistic(size=n)
    grade = (margin > -0.3).astype(int) + (margin > 1.5)
    doc, col = np.nonzero(x)
    return x, doc, col, grade


def objective(theta, x, grade, balance):
    """Penalised, balanced likelihood from the definition: P(grade <= k) = 1 / (1 + exp(w.x - a_k))."""
    w, a = theta[:-2], np.array([theta[-2], theta[-2] + np.exp(theta[-1])])
    below = 1 / (1 + np.exp((x @ w)[:, None] - a[None]))
    p = np.column_stack([below[:, 0], below[:, 1] - below[:, 0], 1 - below[:, 1]])
    return -(balance * np.log(p[np.arange(len(grade)), grade])).sum() + quality.L2 / 2 * (w**2).sum()


def newton(f, start, steps=40, h=1e-4):
    theta, k = start.copy(), len(start)
    eye = np.eye(k) * h
    for _ in range(steps):
        g = np.array([(f(theta + e) - f(theta - e)) / (2 * h) for e in eye])
        hess = np.array([[(f(theta + a + b) - f(theta + a - b) - f(theta - a + b) + f(theta - a - b)) / (4 * h * h) for b in eye] for a in eye])
        step = np.linalg.solve(hess + 1e-6 * np.eye(k), g)
        rate = 1.0
        while f(theta - rate * step) > f(theta) and rate > 1e-6:
            rate /= 2
        theta = theta - rate * step
        if np.abs(g).max() < 1e-7:
            break
    return theta


def test_the_fit_is_the_optimum_of_its_likelihood():
    x, doc, col, grade = sample()
    n = len(grade)
    got = quality.fit(doc, col, np.ones(len(col)), grade, sigmas=0.0)
    scale = 1 / np.sqrt(np.maximum(1, x.sum(axis=0) / n * 20))
    rates = np.bincount(grade, minlength=3) / n
    balance = 1 / np.sqrt(rates[grade])
    balance /= balance.sum()
    f = lambda t: objective(t, x * scale, grade, balance)
    best = newton(f, np.array([0.0] * x.shape[1] + [-0.5, 0.3]))
    mine = np.concatenate([got.weights[: x.shape[1]] / scale, [got.thresholds[0], np.log(np.diff(got.thresholds)[0])]])
    assert f(mine) - f(best) < 1e-3 * f(best)
    want = quality.Ordinal(best[:-2] * scale, np.array([best[-2], best[-2] + np.exp(best[-1])]), rates)
    tails = got.tails(x @ got.weights[: x.shape[1]])
    assert np.abs(tails - want.tails(x @ want.weights)).max() < 0.05
    # one set of weights, ordered thresholds: tails fall with the grade
    assert got.thresholds[0] < got.thresholds[1] and (tails[:, 0] >= tails[:, 1]).all()


def test_columns_that_tell_nothing_stay_out():
    x, doc, col, grade = sample(n=2000)
    noise = np.random.default_rng(8).random((2000, 40)) < 0.3
    d, c = np.nonzero(noise)
    got = quality.fit(np.concatenate([doc, d]), np.concatenate([col, c + 100]), np.ones(len(doc) + len(d)), grade)
    assert np.count_nonzero(got.weights[100:140]) == 0 and got.weights[0] > 0.5 > -0.5 > got.weights[1]


def test_scores_are_those_of_each_text_alone(spark):
    texts = ["plain words here", "Plain, (words) HERE!", "", None, "...", "x" * 5000, "one two one two " * 3000, "Ünï çode wörds 123 a1", "plain"]
    g = np.random.default_rng(1)
    model = quality.Ordinal(g.normal(size=quality.BUCKETS + quality.SHAPES), np.array([-0.2, 0.7]), np.array([0.2, 0.3, 0.5]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^ \t\n\r\x0b\x0c]+", text or "")
        if words:
            (_, block, _), *_ = W.blocks(pa.array([text]))
            _, cols, vals = quality.features(block)
            # a column per distinct word, marks and case aside, and shares of shapes that add up to 4
            distinct = {re.sub(r"^[^a-z0-9\x80-￿]+|[^a-z0-9\x80-￿]+$", "", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in words}
            assert len(cols[cols < quality.BUCKETS]) == len(distinct) and abs(vals[cols >= quality.BUCKETS].sum() - 4) < 1e-9
            margin = sum(v * model.weights[c] for c, v in zip(cols, vals))
            tails = [1 / (1 + np.exp(a - margin)) for a in model.thresholds]
        else:
            tails = [0.8, 0.5]
        r = got[i]
        assert abs(r.p_at_least_1 - tails[0]) < 1e-9 and abs(r.p_at_least_2 - tails[1]) < 1e-9 and abs(r.expected_grade - sum(tails)) < 1e-9
        assert r.kept == (tails[1] >= quality.KEEP or not words)
