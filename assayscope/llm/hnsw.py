"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Vectors link if their labels are equal and not null and their cosine, in double precision, is at least
0.93. Equal vectors of a label, told by 128 bits of hashes, are folded
into one row with a count. Each label's distinct vectors are
cut into shards of bounded size; each shard gets an HNSW graph; every shard is queried with the vectors of
every shard of its label (each unordered pair of shards once, so that a link is counted alike for both
ends). A query descends to the base layer with a beam, then floods along the graph through all vectors
above the threshold, so that a large group of near copies is found whole whatever the beam. The beam is
widened until an audit against brute force, on fixed vectors of both shards of the pair, finds AUDIT_RECALL
of the links of each of them, so that vectors with few links count as much as those of a large group. If
WIDEST isn't enough, the pair of shards is compared by brute force. Queries run in blocks of BLOCK: the links of
a block are counted and thinned to a spanning forest before the next one; within one shard, where a link counts if
either end finds it, a bit per pair stays. A task returns counts of links and the edges of that forest, never all
pairs.

Null, zero or non-finite vectors, vectors of a minority length within their shard pair, and null labels
link with nothing and are kept. Rows that share an id are separate vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayscope.llm.common import Scratch, components

THRESHOLD = 0.93
#: Vectors of a shard, and numbers in it where vectors are long (but SHORTEST vectors in any case).
SHARD, NUMBERS, SHORTEST = 16_384, 1 << 22, 2_048
#: Queries that run at once; a multiple of eight.
BLOCK = 256
DEGREE = 12
BEAM = 16
#: The widest beam tried; beyond it all pairs of two bounded shards cost less than the search.
WIDEST = 256
#: Vectors of each shard that are audited.
AUDIT = 1_024
AUDIT_RECALL = 0.98


class HNSW:
    """Layered proximity graph of unit vectors. links[layer] is an array [vector, slot], -1 empty."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.x, self.degree = x, degree
        n = len(x)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(degree)).astype(int), 4)
        order = np.argsort(-level, kind="stable")
        self.members = [order[: int((level >= k).sum())] for k in range(int(level.max(initial=0)) + 1)]
        self.links = []
        for layer, members in enumerate(self.members):
            width = degree * (2 if layer == 0 else 1)
            self.links.append(np.full((n, width), -1, np.int32))
        self.entry = int(order[0]) if n else -1
        self.ready = [1] * len(self.members)
        # vectors enter in blocks of doubling size, highest layers first
        done = 1
        while done < n:
            block = order[done : min(n, done + min(done, 256))]
            self._insert(block, level)
            done += len(block)

    def _insert(self, block, level):
        found = self._descend(self.x[block], level[block])
        near = self.x[block] @ self.x[block].T
        for layer, (ids, sims) in found.items():
            inside = np.flatnonzero(level[block] >= layer)
            width = self.links[layer].shape[1]
            # neighbours inside the block count as well
            both_ids = np.concatenate([ids, np.broadcast_to(block[inside], (len(inside), len(inside)))], axis=1)
            own = near[np.ix_(inside, inside)].copy()
            np.fill_diagonal(own, -2)
            both_sims = np.concatenate([sims, own], axis=1)
            top = np.argsort(-both_sims, axis=1, kind="stable")[:, : self.degree]
            rows = np.arange(len(inside))[:, None]
            best, score = both_ids[rows, top], both_sims[rows, top]
            src = np.repeat(block[inside], best.shape[1])
            dst, score = best.ravel(), score.ravel()
            ok = (dst >= 0) & (score > -2)
            self._connect(layer, np.concatenate([src[ok], dst[ok]]), np.concatenate([dst[ok], src[ok]]), width)

    def _connect(self, layer, src, dst, width):
        """Add edges and keep the nearest of each vector, one slot in four for far ones."""
        links = self.links[layer]
        touched = np.unique(src)
        old = links[touched]
        s = np.concatenate([src, np.repeat(touched, width)])
        d = np.concatenate([dst, old.ravel()])
        s, d = s[d >= 0], d[d >= 0]
        pair = np.unique(s.astype(np.int64) * len(self.x) + d)
        s, d = pair // len(self.x), pair % len(self.x)
        sim = np.einsum("ij,ij->i", self.x[s], self.x[d])
        order = np.lexsort((-sim, s))
        s, d = s[order], d[order]
        at = np.searchsorted(s, touched)
        rank = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
        size = np.diff(np.append(at, len(s)))[np.searchsorted(touched, s)]
        # of more than `width` neighbours: the nearest three quarters, and the last quarter spread over the rest
        near = width - width // 4
        spread = np.where(size > width, (rank - near) * (width // 4) // np.maximum(size - near, 1), rank - near)
        before = np.where(size > width, (rank - 1 - near) * (width // 4) // np.maximum(size - near, 1), rank - 1 - near)
        slot = np.where(rank < near, rank, near + spread)
        take = (rank < near) | (spread != before) | (rank == near)
        links[touched] = -1
        ok = take & (slot < width)
        links[s[ok], slot[ok]] = d[ok]

    def _beam(self, layer, q, start_ids, width):
        """Best-first search of all queries in step: (ids, sims) of the `width` nearest found."""
        n, m = len(self.x), len(q)
        links = self.links[layer]
        ids = np.full((m, width), -1, np.int64)
        sims = np.full((m, width), -2.0, self.x.dtype)
        k = min(start_ids.shape[1], width)
        ids[:, :k] = start_ids[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("ij,ikj->ik", q, self.x[ids[:, :k]]), -2)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)
        for c in range(k):
            good = ids[:, c] >= 0
            seen[rows[good], ids[good, c]] = True
        open_ = ids >= 0
        while True:
            can = np.where(open_, sims, -3)
            pick = can.argmax(axis=1)
            live = can[rows, pick] > -2
            if not live.any():
                return ids, sims
            r = rows[live]
            p = pick[live]
            open_[r, p] = False
            nb = links[ids[r, p]]
            new = (nb >= 0) & ~seen[r[:, None], nb]
            seen[np.repeat(r, new.sum(axis=1)), nb[new]] = True
            s = np.where(new, np.einsum("ij,ikj->ik", q[r], self.x[nb]), -2)
            all_ids = np.concatenate([ids[r], nb], axis=1)
            all_sims = np.concatenate([sims[r], s], axis=1)
            all_open = np.concatenate([open_[r], new], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            rr = np.arange(len(r))[:, None]
            ids[r], sims[r] = all_ids[rr, top], all_sims[rr, top]
            open_[r] = all_open[rr, top] & (sims[r] > -2)

    def _descend(self, q, levels):
        """Candidates of new vectors on each layer up to their level."""
        out = {}
        start = np.full((len(q), 1), self.entry, np.int64)
        for layer in reversed(range(len(self.links))):
            want = np.flatnonzero(levels >= layer)
            ids, sims = self._beam(layer, q, start, 2 * self.degree)
            start = ids
            if len(want):
                out[layer] = (ids[want], sims[want])
        return out

    def found(self, q: np.ndarray, threshold: float, beam: int):
        """(first query, query, vector) by block of queries: all pairs found with a similarity of at least the
        threshold; a beam as wide as the graph is brute force."""
        for lo in range(0, len(q), BLOCK):
            part = q[lo : lo + BLOCK]
            if beam >= len(self.x):
                a, v = np.nonzero(part @ self.x.T >= threshold)
            else:
                start = np.full((len(part), 1), self.entry, np.int64)
                for layer in reversed(range(1, len(self.links))):
                    start, _ = self._beam(layer, part, start, min(beam, 8))
                a, v = self._flood(part, *self._beam(0, part, start, beam), threshold)
            yield lo, a + lo, v

    def within(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of all blocks."""
        blocks = [(np.zeros(0, int), np.zeros(0, int)), *((a, v) for _, a, v in self.found(q, threshold, beam))]
        return np.concatenate([a for a, _ in blocks]), np.concatenate([v for _, v in blocks])

    def _flood(self, q, ids, sims, threshold):
        """From the beam's hits through all neighbours above the threshold."""
        seen = np.zeros((len(q), len(self.x)), bool)
        r, c = np.nonzero((ids >= 0))
        seen[r, ids[r, c]] = True
        r, c = np.nonzero((ids >= 0) & (sims >= threshold))
        front_q, front_v = r, ids[r, c]
        hits_q, hits_v = [front_q], [front_v]
        while len(front_q):
            nb = self.links[0][front_v]
            fq = np.repeat(front_q, nb.shape[1])
            fv = nb.ravel()
            ok = fv >= 0
            key = np.unique(fq[ok].astype(np.int64) * len(self.x) + fv[ok])
            fq, fv = key // len(self.x), key % len(self.x)
            new = ~seen[fq, fv]
            fq, fv = fq[new], fv[new]
            seen[fq, fv] = True
            keep = np.zeros(len(fq), bool)
            for i in range(0, len(fq), 65536):
                keep[i : i + 65536] = np.einsum("ij,ij->i", q[fq[i : i + 65536]], self.x[fv[i : i + 65536]]) >= threshold
            front_q, front_v = fq[keep], fv[keep]
            hits_q.append(front_q)
            hits_v.append(front_v)
        return np.concatenate(hits_q), np.concatenate(hits_v)

    def audited_beam(self, threshold: float, beam: int = BEAM, others: np.ndarray | None = None) -> int:
        """The first beam, doubling, that finds enough of the links of each audited vector: fixed ones of
        the graph, self matches left out, and of the other vectors that will be queried. The graph's size
        (brute force) if none does."""
        n = len(self.x)
        pick = _spread(n)
        q = self.x[pick] if others is None else np.concatenate([self.x[pick], others[_spread(len(others))]])
        truth = (q @ self.x.T) >= threshold
        truth[np.arange(len(pick)), pick] = False
        linked = np.flatnonzero(truth.any(axis=1))
        q, truth = q[linked], truth[linked]
        while beam < min(n, WIDEST + 1):
            a, v = self.within(q, threshold, beam)
            got = np.zeros_like(truth)
            got[a, v] = True
            if ((got & truth).sum(axis=1) >= AUDIT_RECALL * truth.sum(axis=1)).all():
                return beam
            beam *= 2
        return n


def _spread(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.stack([np.asarray(x.values, np.float64) for x in column])


def _unit(x):
    # a power of two changes no digit, and squares of very large or small components stay numbers
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Trees that edges unite; root[i] is the least vector of the tree of i."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of those edges (a, b) that unite trees."""
        lo, hi = np.minimum(self.root[a], self.root[b]), np.maximum(self.root[a], self.root[b])
        apart = np.flatnonzero(lo != hi)
        _, first = np.unique(lo[apart].astype(np.int64) * len(self.root) + hi[apart], return_index=True)
        above: dict[int, int] = {}

        def find(i):
            while i in above:
                i = above[i]
            return i

        keep = []
        for k in apart[first].tolist():
            i, j = find(int(lo[k])), find(int(hi[k]))
            if i != j:
                above[max(i, j)] = min(i, j)
                keep.append(k)
        to = np.arange(len(self.root))
        for i in sorted(above):  # a tree goes to a smaller one, whose own root is known by then
            to[i] = to[above[i]]
        self.root = to[self.root]
        return np.array(keep, int)


def _verified(blocks, x, y, threshold):
    """Blocks of pairs whose cosine, in double precision, is at least the threshold."""
    for lo, q, v in blocks:
        good = np.zeros(len(q), bool)
        for i in range(0, len(q), 65536):
            good[i : i + 65536] = np.einsum("ij,ij->i", x[q[i : i + 65536]], y[v[i : i + 65536]]) >= threshold
        yield lo, q[good], v[good]


def _either(blocks, n: int):
    """Blocks of pairs of one shard, each pair from both ends if either end has it; a bit per pair is held."""
    bits = np.zeros((n, -(-n // 8)), np.uint8)
    for lo, q, v in blocks:
        rows = np.zeros((min(BLOCK, n - lo), n), bool)
        rows[q - lo, v] = True
        bits[lo : lo + len(rows)] = np.packbits(rows, axis=1)
    for lo in range(0, n, BLOCK):
        rows = np.unpackbits(bits[lo : lo + BLOCK], axis=1, count=n)
        ends = np.unpackbits(bits[:, lo // 8 : (lo + BLOCK) // 8], axis=1)[:, : len(rows)].T
        q, v = np.nonzero(rows | ends)
        q += lo
        yield lo, q[q != v], v[q != v]


def _search_pair(threshold: float):
    """Two shards of one label: queries of the first against the graph of the second."""

    def run(both: pa.Table) -> pa.Table:
        node, other, links = [], [], []
        shard = np.asarray(both.column("shard"))
        left, right = (both.filter(pa.array(shard == both.column(c)[0].as_py())) for c in ("a", "b"))
        if left.num_rows and right.num_rows:
            same = both.column("a")[0].as_py() == both.column("b")[0].as_py()
            x = _unit(_matrix(left.column("vector")))
            y = x if same else _unit(_matrix(right.column("vector")))
            slack = threshold - 1e-5
            graph, queries = HNSW(y.astype(np.float32)), x.astype(np.float32)
            beam = graph.audited_beam(slack, others=None if same else queries)
            blocks = _verified(graph.found(queries, slack, beam), x, y, threshold)
            (na, ca), (nb, cb) = ([np.asarray(side.column(c)) for c in ("node", "count")] for side in (left, right))
            total, back = np.zeros(len(x)), np.zeros(len(y))
            forest = Forest(len(x) if same else len(x) + len(y))
            for _, q, v in _either(blocks, len(x)) if same else blocks:
                total += np.bincount(q, cb[v], minlength=len(x))
                if not same:
                    back += np.bincount(v, ca[q], minlength=len(y))
                keep = forest.add(q, v if same else v + len(x))
                node.append(na[q[keep]])
                other.append(nb[v[keep]])
            edges = sum(map(len, node))
            links = [0] * edges
            for names, n in ((na, total), (nb, back)):
                node.append(names[n > 0])
                links += n[n > 0].astype(int).tolist()
            other = [*np.concatenate(other).tolist(), *[None] * (len(links) - edges)] if edges else [None] * len(links)
        node = np.concatenate(node) if node else np.zeros(0, np.int64)
        return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def _hashes() -> tuple[Column, Column]:
    """Two hashes of a labelled vector, chained from different seeds: equal vectors are told by 128 bits."""
    return F.xxhash64("label", "vector", F.lit(1)), F.xxhash64(F.lit(2), "label", "vector")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label, ...)."""
    scratch = scratch or Scratch(vectors.sparkSession, "hnsw")
    x = F.transform("embedding", lambda v: v.cast("double"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("vector"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("vector", lambda e: e != 0), F.lit(False)
    )
    # -0.0 and 0.0 are one value
    v = v.withColumn("vector", F.transform("vector", lambda e: e + F.lit(0.0)))
    key, check = _hashes()
    v = scratch.save(v.withColumns({"key": F.when(sound, key), "check": F.when(sound, check)}), "vectors")
    good = v.where("key is not null")
    nodes = good.groupBy("key", "check", "label", F.size("vector").alias("dims")).agg(F.min("vec_id").alias("vec"), F.count("*").alias("count"), F.first("vector").alias("vector"))
    # numbered as they are written, once; two vectors of one key are two nodes
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    room = F.least(F.lit(shard), F.greatest(F.lit(SHORTEST), F.floor(F.lit(NUMBERS) / F.col("dims"))))
    sizes = nodes.groupBy("label", "dims").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / room).cast("int"))
    # key hashes spread a label's vectors evenly over its shards
    placed = nodes.join(sizes, ["label", "dims"]).withColumn("shard", F.pmod("key", "shards").cast("int"))
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    pair = F.transform(every, lambda s: F.struct(F.least("shard", s).alias("a"), F.greatest("shard", s).alias("b")))
    dealt = placed.select("label", "dims", "node", "vector", "count", "shard", F.explode(pair).alias("pair"))
    dealt = dealt.select("label", "dims", "pair.a", "pair.b", "node", "vector", "count", "shard")
    found = dealt.groupBy("label", "dims", "a", "b").applyInArrow(_search_pair(threshold), "node long, other long, links long")
    found = scratch.save(found, "found")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(scratch, found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "key", "check", "vec", "count").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("vec").alias("component_id"))
    named = named.join(least, "root").join(links, "node", "left")
    named = named.select("key", "check", "component_id", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    out = v.select("vec_id", "key", "check").join(named, ["key", "check"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
