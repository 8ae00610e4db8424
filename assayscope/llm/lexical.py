"""Ranked lexical search: an Aho-Corasick automaton of all item terms reads every document.

No index of the documents is built. The items' terms make one automaton over bytes, each term with a
separator on both sides so that only whole terms match; it is broadcast and run over the folded text
(separators to one byte, A-Z lower-cased). Two scans: the first counts documents and terms of the corpus
and the documents that hold each term; the second, knowing every term's weight, maps the automaton's
outputs to the items that use them, scores each document against all items it shares a term with, and keeps
the best TOP per item of its task. So a task sends on at most TOP rows per item, and texts are never shuffled.

Items that use more than BOOK terms in all are dealt into several books by hash, each with automaton and
scans of its own: that bounds what is collected and broadcast, never the result.

A document counts if it holds a term. Null text holds none; a document without an id takes part and comes
last among equal scores; repeated rows are documents of their own. Items that share an id (null is one id)
are one item with the terms of all their different texts; an item without a term has no rows. Columns other
than doc_id, text and item_id are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
#: (item, term) rows of a book.
BOOK = 400_000
#: (document, item) pairs, and terms times the items that use them, which are scored at once.
CELLS, OUTPUTS = 1 << 21, 1 << 21
#: Tasks' rows of an item meet in so many groups first.
FAN_IN = 32

_GUARD = 0x20
#: Separators become the guard, A-Z lower-case; bytes from 0x80 are parts of letters.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else _GUARD for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    different = items.select("item_id", "text").where("text is not null").distinct()
    return different.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


class Book:
    """The automaton of some items' terms, and which items use each term how often."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        terms = sorted({t for _, t, _ in rows})
        self.items = sorted({i for i, _, _ in rows}, key=lambda i: (i is None, i))
        of_term, of_item = {t: k for k, t in enumerate(terms)}, {i: k for k, i in enumerate(self.items)}
        uses = sorted((of_term[t], of_item[i], n) for i, t, n in rows)
        self.size = len(terms)
        self.bounds = np.searchsorted([u[0] for u in uses], np.arange(self.size + 1))
        self.item = np.array([u[1] for u in uses], np.int64)
        self.times = np.array([u[2] for u in uses], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in of_term.items():
            self.automaton.add_word(f" {t.encode().decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def read(self, text: bytes) -> tuple[int, Counter]:
        """The number of terms of a text, and how often it holds each term of the book. Every byte is a
        symbol; neighbouring terms share the separator between them."""
        folded = text.translate(_FOLD)
        inside = np.frombuffer(folded, np.uint8) != _GUARD
        n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].any())
        return n, Counter(map(itemgetter(1), self.automaton.iter(f" {folded.decode('latin-1')} "))) if n else Counter()


def _texts(batch):
    ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
    for i in range(len(batch)):
        if (t := texts[i]).is_valid:
            yield ids[i].as_py(), t.as_buffer().to_pybytes()


#: Numbers of two rows that count the corpus: its documents and its terms.
DOCUMENTS, TERMS = -1, -2


def _count(book):
    def scan(batches):
        b = book.value
        df, docs, terms = np.zeros(b.size, np.int64), 0, 0
        for batch in batches:
            for _, text in _texts(batch):
                n, found = b.read(text)
                docs, terms = docs + (n > 0), terms + n
                df[list(found)] += 1
        held = np.flatnonzero(df)
        numbers, counts = np.append(held, [DOCUMENTS, TERMS]), np.append(df[held], [docs, terms])
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(counts)], names=["term", "n"])

    return scan


class Best:
    """The TOP best documents of each item so far: higher score, then smaller id, ids that are null last."""

    def __init__(self, items: int, top: int):
        self.top, self.edge = top, np.zeros(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, no id, id

    def add(self, score: np.ndarray, nameless: np.ndarray, ids: np.ndarray) -> None:
        """score: documents x items."""
        doc, item = np.nonzero((score > 0) & (score >= self.edge))
        new = [item, score[doc, item], nameless[doc], ids[doc]]
        item, points, no_id, name = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((name, no_id, -points, item))
        first = np.searchsorted(item[order], np.arange(len(self.edge) + 1))
        place = np.arange(len(order)) - first[item[order]]
        order = order[place < self.top]
        self.rows = [x[order] for x in (item, points, no_id, name)]
        full = np.flatnonzero(np.diff(first) >= self.top)
        if len(full):
            at = np.searchsorted(self.rows[0], full) + self.top - 1
            self.edge[full] = self.rows[1][at]


def _rank(book, weights, docs: int, terms: int, top: int, item_type: pa.DataType):
    def scan(batches):
        b, w = book.value, weights.value
        uses = np.diff(b.bounds)
        best = Best(len(b.items), top)
        held: list[tuple] = []  # (id, number of terms, counts) of documents not scored yet
        waiting = 0

        def score():
            nonlocal waiting
            lengths = np.array([len(f) for _, _, f in held])
            m = np.array([25 + 75 * n * docs // terms for _, n, _ in held], np.int64)
            doc = np.repeat(np.arange(len(held)), lengths)
            term = np.fromiter((t for _, _, f in held for t in f), np.int64, lengths.sum())
            tf = np.fromiter((c for _, _, f in held for c in f.values()), np.int64, lengths.sum())
            points = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            n = uses[term]
            use = np.arange(n.sum()) + np.repeat(b.bounds[term] - (np.cumsum(n) - n), n)
            total = np.zeros(len(held) * len(b.items), np.int64)
            np.add.at(total, np.repeat(doc, n) * len(b.items) + b.item[use], np.repeat(points, n) * b.times[use])
            ids = [i for i, _, _ in held]
            best.add(total.reshape(len(held), -1), np.array([i is None for i in ids], np.int64), np.array([i or 0 for i in ids], np.int64))
            held.clear()
            waiting = 0

        for batch in batches:
            for name, text in _texts(batch):
                n, found = b.read(text)
                if found:
                    held.append((name, n, found))
                    waiting += int(uses[list(found)].sum())
                    if waiting >= OUTPUTS or len(held) * len(b.items) >= CELLS:
                        score()
        if held:
            score()
        item, points, no_id, ids = best.rows
        task = np.full(len(item), TaskContext.get().partitionId(), np.int32)
        columns = [pa.array([b.items[i] for i in item], item_type), pa.array(ids, mask=no_id.astype(bool)), pa.array(points), pa.array(task)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score", "task"])

    return scan


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = BOOK) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = item_terms(items)
    kind = items.schema["item_id"].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    total = terms.count()
    books = max(1, math.ceil(total / most))
    schema = f"item_id {kind.simpleString()}, doc_id long, score long, task int"
    found = spark.createDataFrame([], schema)
    for k in range(books):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(books)) == k).collect()  # about `most` rows
        if not rows:
            continue
        made = Book([tuple(r) for r in rows])
        book = spark.sparkContext.broadcast(made)
        counts = texts.mapInArrow(_count(book), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r.term: r.n for r in counts.collect()}  # a row per term of the book
        n, length = counts.pop(DOCUMENTS, 0), counts.pop(TERMS, 0)
        if not n:
            continue
        w = np.zeros(made.size, np.int64)
        for t, df in counts.items():
            w[t] = weight(n, df)
        scan = _rank(book, spark.sparkContext.broadcast(w), n, length, top, arrow)
        found = found.unionByName(texts.mapInArrow(scan, schema))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # many tasks' rows of an item meet in groups of tasks first
    some = Window.partitionBy("item_id", F.col("task") % FAN_IN).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


#: Only sound on unique ids, which the driver's tables have.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
dn AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
tot AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dn),
it AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS times FROM it GROUP BY item_id, term),
u AS (SELECT doc_id, n, unnest(w) AS term FROM dn),
tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM u SEMI JOIN q USING (term) GROUP BY doc_id, n, term),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN wt USING (term), tot GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
