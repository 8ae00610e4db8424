"""Filter interaction audit: what each filter removes in every order of applying the filters.

A document's failed filters are a set; documents are counted by it in every part. The states of a run are
the sets of filters applied so far, a lattice of 2**k subsets, and a step is an edge from a set to one with
one filter more. What an edge removes depends on its two ends only, so all k! orders share k * 2**(k-1)
edges. Forward counts tell how many orders reach a state, backward counts how many lead on from it; an edge
lies on forward * backward orders. These weights give each filter's removals summed over all orders (k!
times its Shapley value) with each edge looked at once, and an order's steps are read from the same edges.

The identity filter fails a document if its text is that of a document with a smaller id, whether or not
that one was removed. Texts are told apart by their SHA-256. Copies are counted by text and part before
texts meet, so a text that a third of all documents share is a few rows.

Null text counts as empty, null source as the part ''. A document without an id is compared with none: it
never fails the identity filter and makes no other fail. Rows that repeat an id and its text pass together.
An id that `labels` holds several times is good (toxic) if one of its rows says so; one it doesn't hold is
neither. Columns other than doc_id, text and source are ignored, whatever their names. Without documents
there are no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails filters A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def lattice(k: int) -> tuple[list[int], list[int]]:
    """Of each subset of k filters: the orders in which it can be reached from the empty set, and the
    orders in which the rest can follow."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s in range(full + 1):
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(range(full)):
        backward[s] = sum(backward[s | 1 << f] for f in range(k) if not s >> f & 1)
    return forward, backward


def edges(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that take this edge)."""
    forward, backward = lattice(k)
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of every order."""
    out = []
    for order in permutations(range(len(letters))):
        state = 0
        for i, f in enumerate(order):
            out.append(("".join(letters[x] for x in order), i + 1, state, f))
            state |= 1 << f
    return out


def failure_counts(docs: DataFrame, labels: DataFrame, identity: str = "E") -> tuple[DataFrame, str]:
    """(part, mask, good, toxic, n): documents by the set of filters they fail; and the filters' letters,
    the lowest bit first."""
    text = F.coalesce("text", F.lit(""))
    failures = text_failures(text)
    letters = "".join(failures) + identity
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))
    d = docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))])
    cell = ["part", "mask", "good", "toxic"]
    known = d.where("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    rows = known.groupBy("doc_id", "key", *cell).agg(F.count("*").alias("n"))
    copies = rows.groupBy("key", *cell).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("low"))
    # a row per part and label of a text, not per document
    first = F.min("low.doc_id").over(Window.partitionBy("key"))
    copies = copies.withColumn("passing", F.when(F.col("low.doc_id") == first, F.col("low.n")).otherwise(0))
    bit = F.lit(1 << len(failures))
    both = F.array(F.struct("mask", F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    split = copies.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    nameless = d.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return split.unionByName(nameless).groupBy(*cell).agg(F.sum("n").alias("n")), letters


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts, letters = failure_counts(docs, labels)
    k = len(letters)
    states = F.array(*[F.lit(s) for s in range(1 << k)])
    # at most 4 * 2**k counts a part
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))).alias("cells"))

    def alive(what: str) -> Column:
        """Of each state, the documents that fail none of its filters."""
        passing = lambda s: F.filter("cells", lambda c: c["mask"].bitwiseAND(s) == 0)
        return F.transform(states, lambda s: F.aggregate(passing(s), F.lit(0).cast("long"), lambda total, c: total + c[what]))

    parts = cells.select("part", alive("n").alias("all"), alive("good").alias("good"), alive("toxic").alias("toxic"))
    edge = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(s | 1 << f).alias("after"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges(k)])
    e = parts.select("*", F.explode(edge).alias("e")).select("*", "e.*").drop("e")
    at = lambda a, i: F.get(a, i)
    lost = lambda a: at(a, F.col("state")) - at(a, F.col("after"))
    one = F.col("after") - F.col("state")
    fails = at("all", F.lit(0)) - at("all", one)
    others = F.lit((1 << k) - 1) - one
    e = e.select(
        "part", "state", "filter", "orders", at("all", F.col("after")).alias("kept"), lost("all").alias("removed"), (fails - lost("all")).alias("redundant"),
        (at("all", others) - at("all", F.lit((1 << k) - 1))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    # k * 2**(k-1) rows a part
    e = e.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "filter")))
    walk = docs.sparkSession.createDataFrame(steps(letters), "filter_order string, step int, state int, filter int")
    # a literal table of k! * k rows
    out = e.join(F.broadcast(walk), ["state", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: Every order is walked by itself; only sound on unique ids, which the driver's tables have.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS m FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
walk(filter_order, step, s, f) AS (VALUES {', '.join(f"('{o}', {i}, {s}, {1 << f})" for o, i, s, f in steps('ABCDE'))}),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN m & (s | f) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & s = 0 AND m & f <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & s <> 0 AND m & f <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & s = 0 AND m & f <> 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN m & s = 0 AND m & f <> 0 THEN x ELSE 0 END) AS toxic_lost
    FROM h CROSS JOIN walk GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
