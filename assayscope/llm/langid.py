"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of a bounded sample of its labelled text is built. A text is parsed
greedily into the longest phrases that occur in the sample. The expected length of a phrase grows with the
logarithm of what a language had to learn from, so its phrases are weighed by that: the language that needs the
fewest phrases, normalised so, wins. With samples of one length the plain counts decide. Each code point of the samples is a symbol of its own. Automata are turned into dense
tables over the commonest characters, in which a missing transition starts a new phrase, and a sorted list
of the transitions over all others, so parsing is one look-up per character; a batch of texts is cut into lanes of LANE characters that advance together (a phrase never crosses a lane's end, for any
language alike). Whole texts are parsed; the sample limits only what is learned.

`und` where the text is null or has no letter, or nothing could be learned. Ties go to the language that
comes first by code point. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayscope.llm.common import Scratch, small

#: Characters learned per language, from spans of documents in the order of their hash.
SAMPLE_CHARS = 40_000
#: Characters of one document that are learned at most, so that one long text can't be the whole sample;
#: the hash says where in the text they start.
SAMPLE_PER_DOC = 2_000
#: Characters, commonest first, that have a column in the dense table.
SYMBOLS = 63
LANE = 1024


def transitions(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions {symbol: state} of each state of the suffix automaton of a sequence; state 0 is the root."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p != -1:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move


def dense(move: list[dict[int, int]], symbols: int) -> np.ndarray:
    """The transitions [state, symbol] over the first symbols; -1 where there is none."""
    out = np.full((len(move), symbols), -1, np.int32)
    for state, to in enumerate(move):
        for c, q in to.items():
            if c < symbols:
                out[state, c] = q
    return out


def automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Dense transitions [state, symbol] of the suffix automaton of a sequence; -1 where there is none."""
    return dense(transitions(text), symbols)


def parser(move: np.ndarray) -> np.ndarray:
    """Table of next states, the lowest bit set where a new phrase starts. A symbol that the sample
    doesn't hold is a phrase of its own and leads back to the root."""
    root = np.where(move[0] < 0, 0, move[0])
    return np.where(move < 0, root[None, :] * 2 + 1, move * 2).astype(np.int32)


class Model:
    """Languages, the symbol of each code point, and one parsing table of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        #: What a phrase of each language counts for.
        self.weight = np.array([np.log(2.0 + len(codes(samples[x]))) for x in self.langs])
        every = codes("".join(samples[x] for x in self.langs))
        values, counts = np.unique(every, return_counts=True)
        # one symbol for all code points that no sample holds; no automaton has a transition over it
        self.symbols = len(values)
        self.symbol = np.full(len(_LETTER), self.symbols, np.int32)
        self.symbol[values[np.lexsort((values, -counts))]] = np.arange(self.symbols)
        tables, base, at, rare = [], [], 0, {}
        for x in self.langs:
            move = transitions(self.symbol[codes(samples[x])])
            # the last column stays empty: a symbol without a column of its own
            t = parser(np.pad(dense(move, SYMBOLS), ((0, 0), (0, 1)), constant_values=-1))
            rare |= {(at + state) * self.symbols + c: at + q for state, to in enumerate(move) for c, q in to.items() if c >= SYMBOLS}
            tables.append(t + 2 * at)
            base.append(at)
            at += len(t)
        #: state * symbols + symbol of the transitions that the table lacks, sorted, and where they lead.
        self.keys = np.array(sorted(rare), np.int64)
        self.to = np.array([rare[k] for k in self.keys.tolist()], np.int64)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.base = np.array(base, np.int64)

    def _rare(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """As the table's entries, for symbols that have no column in it."""

        def look(at):
            key = at * self.symbols + c[:, None]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[k] == key, self.to[k], -1)

        root = look(np.broadcast_to(self.base, state.shape))
        to = look(state)
        return np.where(to >= 0, to * 2, np.where(root >= 0, root, self.base) * 2 + 1)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Number of phrases of each text, by language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        data = [self.symbol[codes(t)] for t in texts]
        size = np.array([len(d) for d in data], np.int64)
        lanes = -(-size // LANE)
        whole = np.concatenate(data) if data else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(np.cumsum(size) - size, lanes) + (np.arange(len(owner)) - first) * LANE
        length = np.minimum(LANE, np.repeat(np.cumsum(size), lanes) - start)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        state = np.repeat(self.base[None, :], len(start), axis=0).astype(np.int64)
        count = np.ones(state.shape, np.int32)
        width = SYMBOLS + 1
        ends = np.searchsorted(-length, -np.arange(1, LANE + 1), "right")  # lanes that are that long
        for i in range(int(length[0]) if len(length) else 0):
            live = ends[i]
            c = whole[start[:live] + i].astype(np.int64)
            got = self.table[state[:live] * width + np.minimum(c, SYMBOLS)[:, None]]
            rare = np.flatnonzero((c >= SYMBOLS) & (c < self.symbols))
            if len(rare):
                got[rare] = self._rare(state[rare], c[rare])
            count[:live] += got & 1
            state[:live] = got >> 1
        np.add.at(out, owner, count)
        return out


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with runs of anything but letters as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_LETTER[c], c, 32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def learn(docs: DataFrame) -> Model:
    """A model from docs(doc_id, text, lang): a bounded number of characters per language, drawn by the
    hash of the id so that a rerun draws the same."""
    d = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_PER_DOC, F.lit(0)) + 1) + 1
    d = d.withColumn("text", F.substring("text", start.cast("int"), F.lit(SAMPLE_PER_DOC)))
    # one row per language; broadcast, so that rows that aren't drawn are dropped before the shuffle
    sizes = small(Scratch(docs.sparkSession, "langid"), d.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")), "sizes")
    # twice the wanted number is drawn, then cut in the order of the hash
    rate = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_CHARS) / F.col("chars"))
    drawn = d.join(sizes, "lang").where(F.pmod("h", F.lit(1 << 20)) < F.greatest(rate * (1 << 20), F.lit(1 << 12) * rate))
    from pyspark.sql import Window

    so_far = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = drawn.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < SAMPLE_CHARS).orderBy("lang", "h", "text").select("lang", "text").collect()
    samples: dict[str, str] = {}
    for r in rows:
        samples[r["lang"]] = samples.get(r["lang"], "") + " " + r["text"]
    return Model({k: v[:SAMPLE_CHARS] for k, v in samples.items() if any(c.isalpha() for c in v[:SAMPLE_CHARS])})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs but text, with lang_pred and score (the share of normalised phrases that the winner
    saves against the runner-up; 1 where there is no runner-up, 0 for und)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    i = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            preds, scores = [], []
            texts = batch.column(i)
            for lo in range(0, len(texts), 1000):
                part = [t or "" for t in texts.slice(lo, 1000).to_pylist()]
                n = m.phrases(part) * m.weight if m.langs else None
                for k, t in enumerate(part):
                    if n is None or not any(map(str.isalpha, t)):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    best = int(n[k].argmin())
                    rest = np.delete(n[k], best)
                    preds.append(m.langs[best])
                    scores.append(float(1 - n[k][best] / rest.min()) if len(rest) else 1.0)
            left = [c for c in range(batch.num_columns) if c != i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in left), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*(batch.schema.names[c] for c in left), "lang_pred", "score"])

    schema = docs.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
