"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct 4-word shingles (A-Z lower-cased; with fewer words the whole
sequence). Documents with equal sets, told by a 128-bit digest of the set, are one *node*. Nodes that
share a band of their signature are candidates. A candidate pair is first compared on signature batches:
with m of n values equal and a uniform prior, the similarity s has the posterior Beta(m + 1, n - m + 1),
and the pair goes as soon as P(s >= threshold) falls below MISS. Survivors are confirmed on the full sets.

Members of a bucket are not paired with each other but with a few pivots of the bucket, the members that
share most buckets with others: an original shares more than its edited copies do, so that one pivot links
a group of copies. Members that a verified link has joined to all others need no further pair. A pivot
that has met all members of a bucket leaves it, and the number of pivots grows each round, until each
bucket holds one component. So every candidate pair is either tested, already joined, or ruled out.

Pairs are ruled out exactly: x and y can only reach a similarity of t if they share t / (1 + t) * (|x| + |y|)
shingles, and x shares no more than those that any other member of a crowded bucket holds; and of its
rarest shingles they share one at least. After the first round the holders of each shingle are counted, so
that edited copies below the threshold, which would meet each other in vain, leave a crowded bucket after
one aggregation, and others meet only those with which they share more than the original's words.

Null text or no word: empty set, linked with nothing. Null doc_id: judged, linked with nothing, kept.
Rows that share an id are separate documents. Further columns, whatever their names, pass unread.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayscope.llm import words as W
from assayscope.llm.common import Scratch, components, fresh, row_key

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BATCH = 25
#: Chance, under the posterior, at which a pair that could still reach the threshold is dropped.
MISS = 1e-5
SHINGLE = 4
#: Factor by which the number of a bucket's pivots grows each round, from one.
MORE_PIVOTS = 16
#: Members up to which all of a bucket are pivots at once.
SMALL = 8
#: Members from which on the shared shingles of a bucket are counted.
CROWD = 32
THRESHOLD = 80

_rng = np.random.default_rng(0x5EED)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@cache
def least_matches(threshold: float, n: int, miss: float) -> int:
    """The fewest equal values of n at which P(s >= threshold | data) is still at least `miss`."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= miss:  # P(Beta(m + 1, n - m + 1) >= t) = P(Bin(n + 1, t) <= m)
            return m
    return n


def _sets(block: W.Words, k: int):
    """Distinct shingle hashes of each document, sorted, one after the other; bounds; set hashes."""
    h, at = W.shingles(block.hashes(lower=True), block.at, k)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc)) if len(at) > 2 else np.argsort(h)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    at = np.searchsorted(doc, np.arange(len(at)))
    node = np.empty((len(at) - 1, 2), np.uint64)
    for half, salt in enumerate((0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B)):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(W.mix(h ^ np.uint64(salt)), dtype=np.uint64, out=run[1:])
        node[:, half] = W.mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64))
    return h, at, node


def _binary(rows: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Each row's bytes as a binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    whole = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    return whole if null is None else pa.compute.if_else(pa.array(~null), whole, pa.scalar(None, pa.binary()))


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of HASHES minima per document; documents without a shingle get ones."""
    filled = np.flatnonzero(np.diff(at))
    sig = np.full((len(at) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    if len(filled):
        low = (h >> np.uint64(32)).astype(np.uint32)
        high = h.astype(np.uint32)
        for k in range(HASHES):
            v = (low ^ _XOR[k]) * _MUL[k]
            v ^= v >> np.uint32(15)
            v += high
            v *= np.uint32(0x85EBCA6B)
            sig[filled, k] = np.minimum.reduceat(v, at[:-1][filled])
    return sig


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for row, block, _ in W.blocks(batch.column("text")):
                h, at, node = _sets(block, k)
                n = np.diff(at)
                sig = _signatures(h, at)
                part = batch.slice(row, len(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row_key"),
                        pa.array(n.astype(np.int64)),
                        _binary(node, n == 0),
                        _binary(sig, n == 0),
                    ],
                    names=["doc_id", "row_key", "n_shingles", "node", "sig"],
                )

    return run


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.frombuffer(b"".join(batch.column("node").to_pylist()), np.uint64).reshape(-1, 2)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(node), BANDS, ROWS)
        h = np.full((len(node), BANDS), 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            h = W.mix(h ^ sig[:, :, r].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), _binary(np.repeat(node, BANDS, axis=0))], names=["bucket", "node"])


def _sequential(threshold: float):
    def run(batches):
        need = [(n, least_matches(threshold, n, MISS)) for n in range(BATCH, HASHES + 1, BATCH)]
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            left = np.arange(len(a))
            equal = np.zeros(len(a), np.int64)
            for n, least in need:
                equal[left] += (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(axis=1)
                left = left[equal[left] >= least]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(left)), batch.column("b").take(pa.array(left))], names=["a", "b"])

    return run


def _pack_nodes(k: int):
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = batch.column("text")
            blobs = text.cast(pa.large_binary())
            for row, block, _ in W.blocks(text):
                _, at, node = _sets(block, k)
                n = np.diff(at)
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(has + row)), _binary(node[has]), pa.array([z.compress(blobs[int(i)].as_buffer()) for i in has + row], pa.binary())],
                    names=["doc_id", "node", "packed"],
                )

    return run


def _unpack_sets(k: int):
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([z.decompress(x) for x in batch.column("packed").to_pylist()], pa.large_binary()).view(pa.large_string())
            nodes = batch.column("node")
            for row, block, _ in W.blocks(texts):
                h, at, _ = _sets(block, k)
                yield pa.RecordBatch.from_arrays([nodes.slice(row, len(at) - 1), pa.array([h[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], names=["node", "items"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return run


def _distinct_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """node, items: the full set of each wanted node, from the text of its first document."""
    first = nodes.join(wanted, "node").select("node", F.col("rep").alias("doc_id"))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_pack_nodes(k), "doc_id long, node binary, packed binary")
    texts = texts.join(first, ["doc_id", "node"], "left_semi").select("node", "packed")
    return scratch.save(texts.mapInArrow(_unpack_sets(k), "node binary, items binary"), "sets")


def _items(batches):
    """One row per shingle of each node's set."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            items = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
            if items:
                again = np.repeat(np.arange(len(items)), [len(x) for x in items])
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(again)), pa.array(np.concatenate(items))], names=["node", "item"])


def _partner_bound(shared: Column, size: Column, percent: int) -> Column:
    """The size of the largest set that can reach the threshold with a set of `size` items, if these two have
    no more than `shared` items in common."""
    return F.floor(shared * (100 + percent) / F.lit(percent)).cast("long") - size


def _rule_out(m: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members without those of crowded buckets that no other member of a crowded bucket can link to;
    `bound` lowered to what the rest can link to; `rare`: as many of a set's rarest shingles, those of fewer than
    CROWD holders, as may matter (31 bits of each: they only rule out)."""
    crowded = F.col("n") >= CROWD
    items = sets.join(m.where(crowded).select("node").distinct(), "node").select("node", "items").mapInArrow(_items, "node binary, item long")
    few = items.groupBy("item").agg(F.count("*").alias("holders")).where(F.col("holders") < CROWD)
    each = items.join(few, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "item"))).alias("few"))
    each = each.select(
        "node", F.size(F.filter("few", lambda x: x["holders"] == 1)).alias("alone"),
        F.transform("few", lambda x: x["item"].bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")).alias("few"),
    )
    most = F.col("size") - F.ceil(F.col("size") * percent / F.lit(100)) + 1
    m = m.drop("rare").join(each, "node", "left")
    m = m.withColumns({
        "bound": F.when(crowded, F.least("bound", _partner_bound(F.col("size") - F.coalesce("alone", F.lit(0)), F.col("size"), percent))).otherwise(F.col("bound")),
        "rare": F.when(crowded, F.slice(F.coalesce("few", F.array().cast("array<int>")), F.lit(1), most.cast("int"))),
    })
    # of two sets that link, the smaller one's bound is not below its own size
    full = m.where("bound >= size").groupBy("bucket").agg(F.min("size").alias("least_full"))
    m = m.join(full, "bucket", "left").where("bound >= size or bound >= least_full")
    return m.select("bucket", "node", "root", "size", "popular", "bound", "rare")


def _may_link(percent: int) -> Column:
    """Whether member and pivot, by their sizes and shared shingles, may reach the threshold: they need
    `both` shingles in common, so one of the size - both + 1 rarest of either."""
    both = F.ceil((F.col("size") + F.col("pivot_size")) * percent / F.lit(100 + percent))
    need, pivot_need = ((F.col(c) - both + 1).cast("int") for c in ("size", "pivot_size"))
    meet = (
        F.when(need <= F.size("rare"), F.arrays_overlap(F.slice("rare", F.lit(1), F.greatest(need, F.lit(0))), F.col("pivot_rare")))
        .when(pivot_need <= F.size("pivot_rare"), F.arrays_overlap(F.slice("pivot_rare", F.lit(1), F.greatest(pivot_need, F.lit(0))), F.col("rare")))
        .otherwise(True)
    )
    met = F.col("rare").isNull() | F.col("pivot_rare").isNull() | meet
    return (F.col("size") <= F.col("pivot_bound")) & (F.col("pivot_size") <= F.col("bound")) & met


def _open(m: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, and the number n of members."""
    stats = m.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    return m.join(stats, "bucket")


def _links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame | None:
    """node, root of all nodes that a verified link joins to another; None if there are none."""
    buckets = nodes.select("node", "sig").mapInArrow(_bands, "bucket long, node binary")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")  # a node has one row a bucket
    members = scratch.save(buckets.join(shared, "bucket"), "members")
    if members.isEmpty():
        return None
    wanted = scratch.save(members.groupBy("node").agg(F.sum("n").alias("popular")).join(nodes.select("node", "size"), "node"), "wanted")
    sets = _distinct_sets(docs, nodes, wanted.select("node"), scratch, k)
    sigs = scratch.save(nodes.select("node", "sig").join(wanted.select("node"), "node"), "signatures")
    members = members.join(wanted, "node").withColumn("bound", _partner_bound(F.col("size"), F.col("size"), percent)).withColumn("rare", F.lit(None).cast("array<int>"))

    links, roots, pivots = None, None, 1
    while True:
        m = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        m = scratch.save(m if pivots == 1 else _open(m), "open")
        if pivots == MORE_PIVOTS and not m.where(F.col("n") >= CROWD).isEmpty():
            m = scratch.save(_open(_rule_out(m, sets, percent)), "left")
        if m.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("popular"), "node"))
        many = F.when(F.col("n") <= SMALL, SMALL).otherwise(pivots)
        chosen = m.withColumn("rank", rank).where((F.col("rank") <= max(pivots, SMALL)) & (F.col("rank") <= many))
        chosen = chosen.select("bucket", *[F.col(c).alias(f"pivot_{c}") for c in ("node", "root", "size", "bound", "rare")])
        apart = (F.col("root") != F.col("pivot_root")) & _may_link(percent)
        if pivots == 1:
            met = m.join(chosen, "bucket").where(apart)
        else:  # a pair meets in the least of its buckets only
            own = m.groupBy("node").agg(F.collect_list("bucket").alias("own"))
            theirs = chosen.groupBy("pivot_node").agg(F.collect_list("bucket").alias("theirs"))
            least = F.array_min(F.array_intersect("own", "theirs")) == F.col("bucket")
            met = m.join(own, "node").join(chosen.join(theirs, "pivot_node"), "bucket").where(apart & least)
        pairs = met.select(F.least("node", "pivot_node").alias("a"), F.greatest("node", "pivot_node").alias("b")).distinct()
        signed = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        left = signed.mapInArrow(_sequential(percent / 100), "a binary, b binary")
        full = left.join(sets.select(F.col("node").alias("a"), F.col("items").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("set_b")), "b")
        found = full.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a binary, b binary")
        found = scratch.save(found, "links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            roots = scratch.save(components(scratch, links), "roots")
        # the pivots have met every member of their buckets
        met = chosen.select("bucket", F.col("pivot_node").alias("node"))
        members = scratch.save(m.join(met, ["bucket", "node"], "left_anti").select("bucket", "node", "size", "popular", "bound", "rare"), "members")
        pivots *= MORE_PIVOTS
    return roots


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, k: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, row_key, n_shingles, node, component_id, kept for every row of docs(doc_id, text, ...)."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("row_key"), "text")
    signed = scratch.save(docs.mapInArrow(_sign(k), "doc_id long, row_key long, n_shingles long, node binary, sig binary"), "signed")
    filled = signed.where("node is not null and doc_id is not null")
    nodes = scratch.save(filled.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"), F.min("n_shingles").alias("size")), "nodes")
    roots = _links(docs, nodes, scratch, k, percent)
    reps = nodes.select("node", "rep")
    if roots is None:
        owner = reps.select("node", F.col("rep").alias("component_id"))
    else:
        named = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        owner = named.join(least, "root").select("node", "component_id")
    out = signed.drop("sig").join(owner, "node", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "row_key", "n_shingles", "node", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup_stage(docs: DataFrame, k: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """The rows of docs that represent their component, with all their columns. Of rows that share
    both id and text, all stay or none."""
    judged = near_duplicates(docs, k=k, percent=percent)
    id_, key = fresh(docs.columns, "id", "key")
    lost = judged.where("not kept").select(F.col("doc_id").alias(id_), F.col("row_key").alias(key)).distinct()
    return docs.join(lost, (docs["doc_id"] == lost[id_]) & (row_key(docs["text"]) == lost[key]), "left_anti")
