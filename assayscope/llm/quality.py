"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 toxic, 1 neither toxic nor good, 2 good. With shared weights w and ordered
thresholds a_0 < a_1, P(grade <= k | x) = sigmoid(a_k - w.x). Features are hashed text: presence of each
word (lower-cased, letters only), and the share of words of each shape (the set of character classes in
a word). The model is fitted on a bounded sample of labelled rows, drawn by the hash of the id
(SAMPLE_ROWS); every document is then scored on its whole text.

Output: expected grade, P(grade >= 1), P(grade >= 2), and `kept` where the latter is at least KEEP. A
null, empty or wordless text has no feature: it gets the grades' base rates, and is kept. Without labels
everything is kept. Rows that share an id are scored separately. Further columns pass, but for those named
like an output, which is put in their place; the stage returns the input's columns as they were.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayscope.llm import words as W
from assayscope.llm.common import fresh

#: Labelled rows that the model is fitted on.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18
SHAPES = 1 << 10
GRADES = 3
KEEP = 0.5
STEPS = 250
L2 = 2e-4
#: Standard errors by which the grade must differ where a feature is present, for it to be used.
SIGMAS = 4.0

# classes: lower, upper, digit, other letters' bytes, and 28 kinds of ASCII punctuation
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
_CLASS[128:] = 8
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = np.uint32(1) << np.uint32(4 + _i % 28)
_LETTERS = W._BYTE_LOWER.copy()
_LETTERS[:48] = 0
_LETTERS[58:65] = 0
_LETTERS[91:97] = 0
_LETTERS[123:128] = 0


def features(block: W.Words):
    """Per document: distinct word buckets and shape shares, as (document, column, value)."""
    n = np.diff(block.at)
    k = len(n)
    doc = np.repeat(np.arange(k), n)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # words without their punctuation: leading or trailing marks don't change the letters' own hash
    trimmed_start, trimmed_end = _trim(block)
    h = W._spans(_LETTERS[block.data], trimmed_start, trimmed_end)
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    key = np.unique(doc * BUCKETS + bucket)
    masks = np.bitwise_or.reduceat(_CLASS[block.data], block.starts)
    shape = (W.mix(masks.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    both, count = np.unique(doc * SHAPES + shape, return_counts=True)
    docs = np.concatenate([key // BUCKETS, both // SHAPES])
    cols = np.concatenate([key % BUCKETS, BUCKETS + both % SHAPES])
    vals = np.concatenate([np.ones(len(key)), 4.0 * count / n[both // SHAPES]])
    return docs, cols, vals


def _trim(block: W.Words):
    letter = np.concatenate([[0], np.cumsum(_LETTERS[block.data] != 0)])
    spots = np.flatnonzero(_LETTERS[block.data] != 0)
    lo, hi = letter[block.starts], letter[block.ends]
    has = hi > lo
    start, end = block.starts.copy(), block.starts.copy()
    start[has] = spots[lo[has]]
    end[has] = spots[hi[has] - 1] + 1
    return start, end


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights and thresholds of the cumulative-link model."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, rates: np.ndarray):
        self.weights, self.thresholds, self.rates = weights, thresholds, rates

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each margin w.x."""
        return 1 - _sigmoid(self.thresholds[None, :] - margin[:, None])

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, w=self.weights, a=self.thresholds, r=self.rates)
        return to.getvalue()

    @staticmethod
    def load(blob: bytes) -> Ordinal:
        got = np.load(io.BytesIO(blob))
        return Ordinal(got["w"], got["a"], got["r"])


def fit(doc: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, l2: float = L2, sigmas: float = SIGMAS) -> Ordinal:
    """Adam on the cumulative-link likelihood. Only columns whose rows' share of some grades `<= k` lies at
    least `sigmas` standard errors from the overall share take part; the rest stay at 0."""
    n, width = len(grade), BUCKETS + SHAPES
    seen = np.bincount(col, minlength=width)
    ok = np.zeros(len(col), bool)
    for k in range(GRADES - 1):
        below = (grade <= k) - np.mean(grade <= k)
        apart = np.abs(np.bincount(col, below[doc], minlength=width))
        ok |= apart[col] >= sigmas * max(below.std(), 1e-9) * np.sqrt(seen[col])
    doc, val = doc[ok], val[ok]
    names, col = np.unique(col[ok], return_inverse=True)
    # common words say little: weigh columns by their rarity, so that steps are alike
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(col, minlength=len(names)) / n * 20))
    val = val * scale[col]
    rates = np.bincount(grade, minlength=GRADES) / n
    cum = np.clip(np.cumsum(rates)[:-1], 1e-3, 1 - 1e-3)
    theta = np.concatenate([np.zeros(len(names)), np.log(cum / (1 - cum))])
    theta[-1] = np.log(max(theta[-1] - theta[-2], 1e-2))  # the second threshold is the first plus exp
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = rates[grade]
    balance = 1 / np.sqrt(np.maximum(share, 1e-6))
    balance /= balance.sum()
    for t in range(1, STEPS + 1):
        margin = np.bincount(doc, val * theta[:-2][col], minlength=n)
        a0, gap = theta[-2], np.exp(theta[-1])
        edge = np.array([-np.inf, a0, a0 + gap, np.inf])
        upper, lower = edge[grade + 1] - margin, edge[grade] - margin
        su, sl = _sigmoid(upper), _sigmoid(lower)
        su[np.isposinf(upper)], sl[np.isneginf(lower)] = 1, 0
        p = np.maximum(su - sl, 1e-9)
        du, dl = su * (1 - su) / p, sl * (1 - sl) / p
        g_margin = balance * (du - dl)
        g = np.zeros_like(theta)
        g[:-2] = np.bincount(col, val * g_margin[doc], minlength=len(names)) + l2 * theta[:-2]
        by_edge = np.zeros(4)
        np.add.at(by_edge, grade + 1, -balance * du)
        np.add.at(by_edge, grade, balance * dl)
        g[-2] = by_edge[1] + by_edge[2]
        g[-1] = by_edge[2] * gap
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w = np.zeros(width)
    w[names] = theta[:-2] * scale
    return Ordinal(w, np.array([theta[-2], theta[-2] + np.exp(theta[-1])]), rates)


def _featurise(batches):
    for batch in batches:
        grades = batch.column("grade")
        ids = batch.column("h")
        for row, block, _ in W.blocks(batch.column("text")):
            d, c, v = features(block)
            k = len(block.at) - 1
            cut = np.searchsorted(d, np.arange(k + 1)) if len(d) and (np.diff(d) >= 0).all() else None
            if cut is None:
                order = np.argsort(d, kind="stable")
                d, c, v = d[order], c[order], v[order]
                cut = np.searchsorted(d, np.arange(k + 1))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, k), grades.slice(row, k), pa.array([c[i:j] for i, j in zip(cut, cut[1:])], pa.list_(pa.int64())), pa.array([v[i:j] for i, j in zip(cut, cut[1:])], pa.list_(pa.float64()))],
                names=["h", "grade", "cols", "vals"],
            )


def _fit_sample(frames):
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    t = pd.concat(parts, ignore_index=True)
    t["key"] = [int(np.sum(c)) for c in t["cols"]]
    t = t.sort_values(["h", "grade", "key"], kind="stable").reset_index(drop=True)
    size = np.array([len(c) for c in t["cols"]])
    doc = np.repeat(np.arange(len(t)), size)
    col = np.concatenate([np.asarray(c, np.int64) for c in t["cols"]]) if size.sum() else np.zeros(0, np.int64)
    val = np.concatenate([np.asarray(v, float) for v in t["vals"]]) if size.sum() else np.zeros(0)
    yield pd.DataFrame({"model": [fit(doc, col, val, t["grade"].to_numpy(np.int64)).dump()]})


def grade_of():
    return F.when(F.col("toxic") == 1, 0).when(F.coalesce(F.col("quality"), F.lit(0)) >= 1, 2).otherwise(1)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ordinal | None:
    """The model fitted on about sample_rows labelled rows; None without any."""
    rated = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    n = rated.count()
    rate = min(1.0, sample_rows / max(n, 1))
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30))
    drawn = rated.select(F.col("doc_id").alias("of"), grade_of().alias("grade"), h.alias("h")).where(F.col("h") < int(rate * (1 << 30)))
    # at most about sample_rows rows of 20 bytes
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("of")).select("h", "grade", "text")
    features_ = sample.mapInArrow(_featurise, "h long, grade int, cols array<long>, vals array<double>")
    got = features_.repartition(1).mapInPandas(_fit_sample, "model binary").collect()
    return Ordinal.load(bytes(got[0]["model"])) if got else None


OUTPUTS = ("expected_grade", "p_at_least_1", "p_at_least_2", "kept")


def score(docs: DataFrame, model: Ordinal | None, keep: float = KEEP, outputs: tuple = OUTPUTS) -> DataFrame:
    """All columns of docs with expected_grade, p_at_least_1, p_at_least_2 and kept, under the names of outputs."""
    own = [c for c in docs.columns if c.lower() not in outputs]
    docs = docs.select(*own)
    schema = T.StructType(list(docs.schema.fields))
    for c, kind in zip(outputs, ("double", "double", "double", "boolean")):
        schema = schema.add(c, kind)
    if model is None:
        return docs.select("*", *[F.lit(None).cast("double").alias(c) for c in outputs[:3]], F.lit(True).alias(outputs[3]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        base = np.cumsum(m.rates[::-1])[::-1][1:]
        for batch in batches:
            for row, block, _ in W.blocks(batch.column(batch.schema.get_field_index("text"))):
                k = len(block.at) - 1
                d, c, v = features(block)
                tails = m.tails(np.bincount(d, v * m.weights[c], minlength=k))
                blank = np.diff(block.at) == 0
                tails[blank] = base
                part = batch.slice(row, k)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array((tails[:, 1] >= keep) | blank)],
                    names=[*part.schema.names, *outputs],
                )

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row of docs, without its text."""
    return score(docs.select("doc_id", "text"), learn(docs, labels)).drop("text")


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    names = tuple(fresh(docs.columns, *OUTPUTS))
    return score(docs, learn(docs, labels), outputs=names).where(names[3]).select(*docs.columns)
