"""Substring dedup: passages of 50 words or more that a document with a smaller id holds already.

Plan (all shuffles carry fixed-size rows, but for two that carry zstd-packed texts):

1. every document is cut at its minimisers: the 20-word run of least hash in each 50-word window. All
   windows with one minimiser make a *piece* (about 65 words, overlapping its neighbours), so equal
   windows of different documents always lie in pieces with the same anchor hash. A piece that a document
   repeats is one row with all its places;
2. anchors that lie in one document only are dropped (partial min/max of the id before the shuffle);
3. equal pieces are folded into one with the smallest id, and its words are fetched;
4. pieces are dealt to shards by anchor. Each shard builds an FM-index of its pieces (suffix order,
   BWT in a wavelet matrix of packed bits with block ranks) and streams its pieces against it by
   backward search, truncated at the window length: each step that reaches 50 words reports the
   smallest id among the suffixes of its interval. An anchor with more pieces than a shard may hold is
   indexed in several shards, and its pieces are streamed against each of them;
5. the reported intervals are joined back to every document that holds the piece, united and cut out.

Pieces count as equal by their anchor and 128 bits of their words' hashes; inside a shard words are compared
as they are.

Rows with null id keep all words and remove none; null or blank text has no words; rows that share an
id never remove each other's words; a table without rows gives a table without rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayscope.llm import words as W
from assayscope.llm.common import Scratch, fresh, row_key

WINDOW = 50
ANCHOR = 20
#: What tells pieces apart: the anchor's hash and 128 bits of the words.
PIECE = ["anchor", "content", "check"]
#: Pieces of one index; memory of a shard is about 65 words x 100 bytes x this.
SHARD_PIECES = 8_000


# -- FM-index ---------------------------------------------------------------------------------------


class FMIndex:
    """FM-index of sequences of word numbers (1 and up), each with the id it stands for."""

    def __init__(self, seqs: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int = WINDOW):
        """seqs: all sequences one after the other; at: their bounds; ids: one per sequence."""
        k = len(at) - 1
        length = np.diff(at)
        where = np.arange(len(seqs)) + np.repeat(np.arange(k), length)  # a 0 ends each sequence
        text = np.zeros(len(seqs) + k, np.int64)
        text[where] = seqs
        self.n = n = len(text)
        self.window = window
        stop = np.repeat(at[1:] + np.arange(k), length + 1)
        owner = np.repeat(np.arange(k), length + 1)
        place = np.arange(n)
        # Suffix order by doubling; a comparison ends at the sequence's 0, ties go by place.
        ranks, rank, step = [], text, 1
        longest = int(length.max(initial=0)) + 1
        while True:
            ranks.append(rank.astype(np.int64))
            if step >= longest:
                break
            far = place + step
            second = np.where(far <= stop, rank[np.minimum(far, n - 1)] + 1, 0)
            key = rank.astype(np.int64) * (int(rank.max()) + 2 if n else 1) + second
            order = np.argsort(key, kind="quicksort")
            new = np.empty(n, np.int64)
            srt = key[order]
            new[order] = np.concatenate([[0], np.cumsum(srt[1:] != srt[:-1])])
            rank, step = new, step * 2
        sa = np.argsort(rank, kind="stable")
        bwt = text[sa - 1]
        self.sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self._wavelet(bwt)
        # Intervals of the suffixes that agree on `window` words, and on one word less.
        self.least = self._group(sa, ranks, window, ids[owner])[2]
        self.lo_less, self.hi_less, _ = self._group(sa, ranks, window - 1, None)

    def _group(self, sa, ranks, depth, ids):
        n = self.n
        differs = np.zeros(max(n - 1, 0), bool)
        done = 0
        for level in reversed(range(len(ranks))):
            if done + (1 << level) <= depth:
                r = ranks[level][np.minimum(sa + done, n - 1)]
                differs |= r[1:] != r[:-1]
                done += 1 << level
        start = np.flatnonzero(np.concatenate([[True], differs])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(start, n))
        least = np.repeat(np.minimum.reduceat(ids[sa], start), size) if ids is not None and n else None
        return np.repeat(start, size), np.repeat(start + size, size), least

    def _wavelet(self, bwt):
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        seq = bwt
        for level in reversed(range(self.levels)):
            b = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(b, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(b) - b.sum()))
            seq = np.concatenate([seq[~b], seq[b]])
        # Where each symbol's run starts on the last level.
        self.base = self._descend(np.zeros(self.sigma, np.int64), np.arange(self.sigma))

    def _descend(self, pos, symbol):
        for k, level in enumerate(reversed(range(self.levels))):
            word = pos >> 6
            below = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & below)
            pos = np.where((symbol >> level) & 1, self.zeros[k] + ones, pos - ones)
        return pos

    def backward(self, lo, hi, symbol):
        """The interval of symbol + pattern from that of the pattern."""
        both = self._descend(np.concatenate([lo, hi]), np.concatenate([symbol, symbol]))
        shift = self.first[symbol] - self.base[symbol]
        m = len(lo)
        return both[:m] + shift, both[m:] + shift

    def matches(self, seqs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each position of the streamed sequences: the smallest id that holds the window of words
        starting there, or the largest int64. Symbols below 1 or unknown match nothing."""
        none = np.iinfo(np.int64).max
        out = np.full(len(seqs), none)
        w = self.window
        lane = np.flatnonzero(np.diff(at) >= w)
        low = at[:-1][lane]
        end = at[1:][lane] - 1  # the last word of the pattern; i: the next word to prepend
        i = end.copy()
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        while len(lane):
            c = seqs[i]
            known = (c > 0) & (c < self.sigma)
            lo2, hi2 = self.backward(lo, hi, np.where(known, c, 0))
            ok = known & (lo2 < hi2)
            full = ok & (end - i + 1 == w)
            out[i[full]] = self.least[lo2[full]]
            # a whole window: give up its last word; no match: start again one word to the left
            lo = np.where(full, self.lo_less[np.minimum(lo2, self.n - 1)], np.where(ok, lo2, 0))
            hi = np.where(full, self.hi_less[np.minimum(lo2, self.n - 1)], np.where(ok, hi2, self.n))
            end = end - (full | ~ok)
            i = np.where(ok, i - 1, end)
            alive = (end - low + 1 >= w) & (i >= low)
            if not alive.all():
                lane, low, end, i, lo, hi = (x[alive] for x in (lane, low, end, i, lo, hi))
        return out


# -- the stages ---------------------------------------------------------------------------------------


def _pieces_of(block: W.Words):
    """(document, anchor hash, piece hash, first word, number of windows) of a block's pieces."""
    h = block.hashes()
    at = block.at
    n = len(h)
    if n < WINDOW:
        return None
    k = W.spans(h, np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
    span = WINDOW - ANCHOR + 1
    least = W.rolling_min(k, span)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(start):
        return None
    value = least[start]
    # a run of windows with one anchor hash makes a piece; in text that repeats itself, where the hash stays
    # on, the run is cut once its first occurrence has left the window
    last = np.concatenate([[True], (value[1:] != value[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]])])
    run = np.flatnonzero(last)
    into = np.arange(len(start)) - np.repeat(run, np.diff(np.append(run, len(start))))
    first = np.flatnonzero(into % span == 0)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    content = W.spans(h, begin, begin + count + WINDOW - 1)
    check = W.spans(W.mix(h ^ np.uint64(0xD1B54A32D192ED03)), begin, begin + count + WINDOW - 1)
    d = doc[begin]
    return d, value[first], content, check, begin - at[d], count


def _emit_pieces(batches):
    """One row per document and piece, with all places where it begins."""
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("row_key")
        for row, block, _ in W.blocks(batch.column("text")):
            got = _pieces_of(block)
            if got is None:
                continue
            order = np.lexsort((got[4], got[3], got[2], got[0]))
            d, anchor, content, check, begin, count = (x[order] for x in got)
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (content[1:] != content[:-1]) | (check[1:] != check[:-1])]))
            begins = pa.ListArray.from_arrays(pa.array(np.append(new, len(d)).astype(np.int32)), pa.array(begin.astype(np.int32)))
            take = pa.array(d[new] + row)
            longs = [pa.array(x[new].view(np.int64)) for x in (anchor, content, check)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), keys.take(take), *longs, begins, pa.array(count[new].astype(np.int32))],
                names=["doc_id", "row_key", "anchor", "content", "check", "begins", "windows"],
            )


_PIECES = "doc_id long, row_key long, anchor long, content long, check long, begins array<int>, windows int"


def _pack(batches):
    """Texts cross a shuffle packed with zstd."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        i = batch.schema.get_field_index("text")
        texts = batch.column(i).cast(pa.large_binary())
        packed = pa.array([z.compress(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [packed if k == i else c for k, c in enumerate(batch.columns)], names=["packed" if f.name == "text" else f.name for f in batch.schema]
        )


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, packed: the text's UTF-8 bytes under zstd."""
    return docs.select("doc_id", row_key(F.col("text")).alias("row_key"), "text").mapInArrow(_pack, "doc_id long, row_key long, packed binary")


def unpack(z, blob) -> bytes:
    return b"" if blob is None else z.decompress(blob)


def _cut_pieces(batches):
    """The words of the wanted pieces of each document."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for blob, wanted in zip(batch.column("packed").to_pylist(), batch.column("pieces").to_pylist()):
            w = unpack(z, blob).split()
            out += [(p["anchor"], p["content"], p["check"], p["doc_id"], b" ".join(w[p["begin"] : p["begin"] + p["windows"] + WINDOW - 1])) for p in wanted]
            if len(out) >= 20_000:
                yield _piece_batch(out)
                out = []
        if out:
            yield _piece_batch(out)


_CUT = "anchor long, content long, check long, doc_id long, words binary"


def _piece_batch(rows):
    a, c, k, d, t = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int64()) for x in (a, c, k, d)), pa.array(t, pa.binary())], names=["anchor", "content", "check", "doc_id", "words"]
    )


def _search(batches):
    """Each shard, one after the other: index its pieces, stream its pieces against the index, report runs of
    windows with the smallest id that holds them. Rows are sorted by shard."""
    held, now = [], None
    for batch in batches:
        shard = np.asarray(batch.column("shard"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and shard[lo] != now:
                yield from _search_shard(pa.Table.from_batches(held))
                held = []
            now = shard[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from _search_shard(pa.Table.from_batches(held))


def _number(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each word as a number from 1 on, equal for equal words, and the bounds of the pieces."""
    data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero(data == 32) + 1]).astype(np.int64)
    each = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    number = np.asarray(each.dictionary_encode().indices).astype(np.int64) + 1
    return number, np.cumsum([0] + [p.count(b" ") + 1 for p in pieces])


def _search_shard(t):
    number, at = _number(t.column("words").to_pylist())
    indexed = np.asarray(t.column("indexed"))
    inside = np.repeat(indexed, np.diff(at))
    ids = np.asarray(t.column("doc_id"))
    index = FMIndex(number[inside], np.concatenate([[0], np.cumsum(np.diff(at)[indexed])]), ids[indexed])
    found = index.matches(number, at)
    # runs of windows of one piece that share their smallest id
    doc = np.repeat(np.arange(len(ids)), np.diff(at))
    offset = np.arange(len(found)) - at[doc]
    hit = np.flatnonzero(found < np.iinfo(np.int64).max)
    if not len(hit):
        return
    new = np.concatenate([[True], (np.diff(hit) != 1) | (found[hit[1:]] != found[hit[:-1]]) | (doc[hit[1:]] != doc[hit[:-1]])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(hit)))
    h = hit[first]
    out = pd.DataFrame({"row": doc[h], "off": offset[h].astype(np.int32), "len": size.astype(np.int32), "least": found[h]})
    yield pa.RecordBatch.from_arrays(
        [*(t.column(c).combine_chunks().take(pa.array(out.row)) for c in PIECE), pa.array(out.off), pa.array(out.len), pa.array(out.least)],
        names=[*PIECE, "off", "len", "least"],
    )


def _keep(batches):
    """Cut the intervals out and digest what is left."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        total, removed, digest, kept = [], [], [], []
        for blob, cuts in zip(batch.column("packed").to_pylist(), batch.column("cuts").to_pylist()):
            w = unpack(z, blob).split()
            n = len(w)
            if cuts:
                gone = np.zeros(n + 1, np.int64)
                for c in cuts:
                    gone[c["s"]] += 1
                    gone[c["e"]] -= 1
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                w = [w[i] for i in keep.tolist()]
            text = b" ".join(w)
            total.append(n)
            removed.append(n - len(w))
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "row_key", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def removals(docs: DataFrame, scratch: Scratch, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, row_key, cuts (array of word intervals s..e) for the documents that lose words."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("row_key"), "text")
    pieces = keyed.mapInArrow(_emit_pieces, _PIECES)
    shared = pieces.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    held = scratch.save(pieces.join(shared, "anchor"), "pieces")

    wanted = (
        held.groupBy(*PIECE)
        .agg(F.min(F.struct("doc_id", "row_key", F.get("begins", F.lit(0)).alias("begin"), "windows")).alias("at"))
        .select(*PIECE, "at.*")
    )
    lists = wanted.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct(*PIECE, "doc_id", "begin", "windows")).alias("pieces"))
    cut = packed(docs.where(F.col("doc_id").isNotNull())).join(lists, ["doc_id", "row_key"]).select("packed", "pieces").mapInArrow(_cut_pieces, _CUT)
    cut = scratch.save(cut, "words")
    n = cut.count()
    shards = max(1, -(-n // shard_pieces))
    crowded = cut.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > shard_pieces).select("anchor", F.ceil(F.col("n") / shard_pieces).cast("int").alias("parts"))
    split = cut.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select(
        *PIECE, "doc_id", "words",
        F.pmod(F.xxhash64("anchor", "part"), F.lit(shards)).cast("int").alias("shard"),
        (F.pmod(F.col("content"), F.col("parts")) == F.col("part")).alias("indexed"),
    )
    runs = split.repartition(shards, "shard").sortWithinPartitions("shard")
    runs = runs.mapInArrow(_search, "anchor long, content long, check long, off int, len int, least long")
    runs = runs.groupBy(*PIECE).agg(F.collect_list(F.struct("off", "len", "least")).alias("runs"))
    runs = scratch.save(runs, "runs")

    mine = F.filter("runs", lambda r: r["least"] < F.col("doc_id"))
    at = lambda begin, r: F.struct((begin + r["off"]).alias("s"), (begin + r["off"] + r["len"] + F.lit(WINDOW - 1)).alias("e"))
    cuts = F.flatten(F.transform("begins", lambda begin: F.transform(mine, lambda r: at(begin, r))))
    hits = held.join(runs, PIECE).select("doc_id", "row_key", cuts.alias("cuts")).where(F.size("cuts") > 0)
    return hits.groupBy("doc_id", "row_key").agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts"))


def substring_dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of docs(doc_id, text, ...)."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = removals(docs, scratch)
    return packed(docs).join(cuts, ["doc_id", "row_key"], "left").mapInArrow(
        _keep, "doc_id long, row_key long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


def substring_dedup_stage(docs: DataFrame) -> DataFrame:
    """The columns of docs with the text cut to its kept words; a document left without a word goes,
    one that had none stays as it is."""
    kept = substring_dedup(docs).where("n_removed > 0").select("doc_id", "row_key", "kept_text", (F.col("n_removed") == F.col("n_words")).alias("gone")).dropDuplicates(["doc_id", "row_key"])
    id_, key, text, gone = fresh(docs.columns, "id", "key", "text", "gone")
    kept = kept.withColumnsRenamed({"doc_id": id_, "row_key": key, "kept_text": text, "gone": gone})
    joined = docs.join(kept, (docs["doc_id"] == kept[id_]) & (row_key(docs["text"]) == kept[key]), "left")
    joined = joined.where(~F.coalesce(gone, F.lit(False)))
    own = {
        "text": F.coalesce(text, "text").alias("text"),
        "n_chars": F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars") if "n_chars" in docs.columns else None,
    }
    return joined.select(*[own.get(c, F.col(c)) for c in docs.columns])
