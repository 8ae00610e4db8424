"""Held-out rows of splits, evaluated where the variants are.

Nearly every variant of an assay is held out by each of its splits, so rows by split are many times the variants, and
dealing them out or sorting them fills disks. Here variants are dealt out once, as blocks of an assay, or once a seed as
the whole assay, and meet the splits' models there (one row per split). A split's rows exist only as numpy columns
inside a task, one split after another; of a whole assay some 100 bytes a variant at most are held at once.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_parts
from assayscope.operators.additive import EXACT

#: Variants of a block.
BLOCK = 16_384
#: Variants that a task computes on at once.
CHUNK = 131_072
#: Variants of an assay that one task orders; a larger assay's splits are ordered by Spark.
WHOLE = 6_000_000
_UNITS = 10**10  # of an exact effect
_NANO = 10**9  # units of a residual


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded with ties away from zero, without -0.0."""
    y = x * 10.0**places
    t = np.trunc(y)
    return (t + np.where(np.abs(y - t) >= 0.5, np.sign(y), 0.0)) / 10.0**places + 0.0


class Variants:
    """Variants of an assay, or of a block of it, in the order of their item numbers, as columns, read batch by batch.

    Numbers are numpy columns and parts are numbered, in as few bytes as their number asks for; anything else is in `table`.
    What is computed of them is computed by chunks, so that a task holds few columns of the assay's length at once.
    """

    def __init__(self, batches: pa.Table | Iterable[pa.RecordBatch]):
        self._names, numbers, texts, sizes, codes = {}, {}, {}, [], []
        for b in batches.to_batches() if isinstance(batches, pa.Table) else batches:
            for name, x in zip(b.schema.names, b.columns):
                if name == "parts":
                    n, c = self._numbered(x)
                    sizes.append(n)
                    codes.append(c)
                elif pa.types.is_primitive(x.type):
                    # a copy, as a view would keep the batch
                    numbers.setdefault(name, []).append(np.array(x.to_numpy(zero_copy_only=False)))
                else:
                    texts.setdefault(name, []).append(x)
        joined = lambda xs, dtype: np.concatenate([xs.pop(0).astype(dtype, copy=False) for _ in range(len(xs))]) if xs else np.array([], dtype=dtype)
        item = numbers.pop("item", [])
        self.item = joined(item, narrow(max((int(x.max(initial=0)) for x in item), default=0)))
        self.sizes, self._codes = joined(sizes, np.min_scalar_type(max((int(x.max(initial=0)) for x in sizes), default=0))), joined(codes, np.min_scalar_type(len(self._names)))
        self._columns, self.table = {c: joined(xs, xs[0].dtype) for c, xs in numbers.items()}, pa.table({c: pa.chunked_array(xs) for c, xs in texts.items()})
        self._made, self._additive = {}, (None, None)
        self._count()
        if (self.item[1:] < self.item[:-1]).any():
            self._sort()

    def _numbered(self, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many parts each variant has, and their numbers; x has lists, or texts with a colon between parts."""
        lists = x
        if not pa.types.is_list(x.type):
            lists = pc.if_else(pc.equal(x, ""), pa.scalar([], pa.list_(pa.string())), pc.split_pattern(x, ":"))
        names = lists.flatten().dictionary_encode()
        of = np.array([self._names.setdefault(p, len(self._names)) for p in names.dictionary.to_pylist()], dtype=np.int64)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return n.astype(np.min_scalar_type(int(n.max(initial=0)))), of.astype(np.min_scalar_type(len(self._names)))[names.indices.to_numpy(zero_copy_only=False)]

    def _count(self) -> None:
        self._starts = np.cumsum([0] + [int(self.sizes[at].sum(dtype=np.int64)) for at in self.chunks()])

    def _sort(self) -> None:
        order = np.argsort(self.item, kind="stable").astype(narrow(len(self)))
        starts, sorted_codes = np.cumsum(self.sizes, dtype=np.int64) - self.sizes, np.empty_like(self._codes)
        self.sizes, done = self.sizes[order], 0
        for at in self.chunks():
            n = self.sizes[at].astype(np.int64)
            ends = np.cumsum(n)
            here = np.repeat(starts[order[at]] - (ends - n), n) + np.arange(ends[-1])
            sorted_codes[done : done + len(here)] = self._codes[here]
            done += len(here)
        self.item, self._codes, self.table = self.item[order], sorted_codes, self.table.take(order) if self.table.num_columns else self.table
        for c in self._columns:
            self._columns[c] = self._columns[c][order]
        self._count()

    def __len__(self) -> int:
        return len(self.item)

    def __getitem__(self, column: str) -> np.ndarray:
        return self._columns[column]

    def chunks(self) -> Iterator[slice]:
        for lo in range(0, len(self), CHUNK):
            yield slice(lo, min(lo + CHUNK, len(self)))

    def each(self, make: Callable[[slice], np.ndarray]) -> np.ndarray:
        """What make(chunk) gives for every chunk, as one column."""
        out = np.empty(len(self))
        for at in self.chunks():
            out[at] = make(at)
        return out

    def _parts(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a chunk's parts, and where each of its variants ends among them."""
        k = at.start // CHUNK
        return self._codes[self._starts[k] : self._starts[k + 1]], np.cumsum(self.sizes[at], dtype=np.int64)

    def parts(self, places: np.ndarray) -> list[list[str]]:
        """The parts of the variants at some places."""
        names, out = list(self._names), [[]] * len(places)
        for k in np.unique(places // CHUNK):
            codes, ends = self._parts(slice(k * CHUNK, min((k + 1) * CHUNK, len(self))))
            for i in np.flatnonzero(places // CHUNK == k):
                end, n = ends[places[i] % CHUNK], int(self.sizes[places[i]])
                out[i] = [names[c] for c in codes[end - n : end]]
        return out

    def once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        """make(), computed for the first of the models that ask for it."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def ascending(self, column: str) -> np.ndarray:
        """Places of the variants in the ascending order of a column, which all models share."""
        return self.once(f"order of {column}", lambda: along(self[column]))

    def _added(self, weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The sum of the weights of each variant's parts, chunk by chunk."""
        for at in self.chunks():
            codes, ends = self._parts(at)
            # an end marker, so that variants without parts may come last
            values, n = np.append(weights[codes], weights[-1:] * 0), self.sizes[at]
            yield at, np.where(n > 0, np.add.reduceat(values, ends - n), 0)

    def part_sums(self, weights: dict[str, float]) -> np.ndarray:
        """The sum of each variant's parts' weights; parts without one count 0."""
        out = np.empty(len(self))
        for at, sums in self._added(np.array([*(weights.get(p, 0.0) for p in self._names), 0.0])):
            out[at] = sums
        return out

    def pair_means(self, measured: list[dict], budgets: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each budget: the budget, how many of each variant's pairs are among the first so many measured ones (a, b,
        value, o), and their mean value, 0 where none is. Values have nine places, so their sums are of whole units. The counts
        hold until the next budget is asked for."""
        units = {m["o"]: round(m["value"] * _NANO) for m in measured}
        bounded = max(map(abs, units.values()), default=0) * len(measured) * int(self.sizes.max(initial=0)) ** 2 < 2**53
        total = np.zeros(len(self), dtype=np.int64 if bounded else object)
        known, done = np.zeros(len(self), dtype=np.int32), 0
        for budget in sorted(budgets):
            new = sorted((m for m in measured if done < m["o"] <= budget), key=lambda m: m["o"])
            mean, done = np.zeros(len(self)), budget
            for chunk in self.chunks():
                pairs = _Pairs(self._parts(chunk)[0], self.sizes[chunk])
                here, sums = known[chunk], total[chunk]  # views
                for m in new:
                    at, n = pairs.with_pair(self._names.get(m["a"]), self._names.get(m["b"]))
                    sums[at] += units[m["o"]] * (n.astype(np.int64) if bounded else n.astype(object))
                    here[at] += n
                at = np.flatnonzero(here)
                mean[chunk][at] = (sums[at] / _NANO if bounded else np.array([x / _NANO for x in sums[at]])) / here[at]
            yield budget, known, mean

    def additive(self, model: dict) -> np.ndarray:
        """The additive prediction of a split, kept until that of another is asked for."""
        if self._additive[0] is not model:
            self._additive = None, None
            self._additive = model, self._sums(model)
        return self._additive[1]

    def _sums(self, model: dict) -> np.ndarray:
        """Sums of whole units are exact in doubles up to 2**53."""
        if model["base"] is None:
            return np.full(len(self), np.nan)
        effects = {e["part"]: e["units"] for e in model["effects"] or []}
        most = max(map(abs, effects.values()), default=0) * int(self.sizes.max(initial=0))
        if most <= 2**53:
            out = self.part_sums(effects)
            for at in self.chunks():
                out[at] = half_up(model["base"] + out[at] / _UNITS, 9)
            return out
        out = np.empty(len(self))
        for at, sums in self._added(np.array([*(effects.get(p, 0) for p in self._names), 0], dtype=object)):
            out[at] = half_up(model["base"] + np.array([x / _UNITS for x in sums]), 9)
        return out

    def held(self, model: dict) -> np.ndarray:
        """Which rows the split has not trained on."""
        taken = np.array(model["taken"], dtype=np.int64)
        at = np.searchsorted(self.item, taken)
        at = at[(at < len(self)) & (self.item[np.minimum(at, len(self) - 1)] == taken)]
        return ~marked(len(self), at)


class _Pairs:
    """How often the variants of a chunk have a part, or a pair of parts."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self._codes, self._rows = codes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self._counted, self._scratch = {}, np.zeros(len(sizes), dtype=np.int32)

    def counted(self, part: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the variants with a part, ascending, and how often each has it."""
        if part not in self._counted:
            at = self._rows[np.flatnonzero(self._codes == part)] if part is not None else self._rows[:0]
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.array([], dtype=np.int64)
            self._counted[part] = at[start], np.diff(start, append=len(at)).astype(np.int32)
        return self._counted[part]

    def with_pair(self, a: int | None, b: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the variants with both parts, and how many pairs of the two each has."""
        at, n = self.counted(b)
        if a == b:
            pairs = n * (n - 1) // 2
        else:
            other, m = self.counted(a)
            self._scratch[other] = m
            pairs = n * self._scratch[at]
            self._scratch[other] = 0
        return at[pairs > 0], pairs[pairs > 0]


def models(keys: DataFrame, train: DataFrame, *more: DataFrame) -> DataFrame:
    """assay, seed, split, base, effects, taken: a split's additive model and the items it trains on, a list no longer than
    its budget; and the columns of more, tables by split."""
    single, truth = F.col("ord") == 1, F.col("dms_score")
    base = train.groupBy("split").agg(F.coalesce(F.avg(F.when(single, truth)), F.avg(truth)).alias("base"), F.collect_list("item").alias("taken"))
    units = ((truth - F.col("base")).cast(EXACT) * F.lit(_UNITS)).cast("long")
    effects = train.where(single).join(base, "split").select("split", F.struct(F.col("mutant").alias("part"), units.alias("units")).alias("e"))
    effects = effects.where("e.units is not null").groupBy("split").agg(F.collect_list("e").alias("effects"))
    out = keys.select("assay", "seed", "split").join(base, "split").join(effects, "split", "left")
    for m in more:
        out = out.join(m, "split")
    return out


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def by_block(v: DataFrame, model: DataFrame, columns: list[str], each: Callable, schema: str) -> DataFrame:
    """What each(block, model) yields for every block of v's variants and every split of their assay."""
    arrow, by = _arrow(schema), ["assay", "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            rows = Variants(left.drop_columns(by))
            for m in right.to_pylist():
                out += [t.select(arrow.names).cast(arrow) for t in each(rows, m)]
        return pa.concat_tables(out) if out else arrow.empty_table()

    block = F.floor(F.col("item") / BLOCK).alias("block")
    rows = v.select("assay", "item", *columns, mutation_parts(F.col("mutant")).alias("parts"), block)
    # the models go to each block: a row per block and split
    blocks = v.groupBy("assay").agg(F.max("item").alias("last")).select("assay", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / BLOCK))).alias("block"))
    return rows.groupBy(*by).cogroup(model.join(F.broadcast(blocks), "assay").groupBy(*by)).applyInArrow(run, schema)


def by_seed(v: DataFrame, model: DataFrame, columns: list[str], each: Callable, schema: str) -> DataFrame:
    """What each(assay, model) yields for every split, a seed's splits of an assay in one task, with all its variants.

    The task reads its rows batch by batch and keeps their numbers only; a cogroup would hold its Arrow tables beside them.
    """
    arrow, by = _arrow(schema), ["assay", "__seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = []

        def variants():
            for b in batches:
                given = b.column("__model")
                if given.null_count < len(given):
                    models.extend(map(pickle.loads, given.drop_null().to_pylist()))
                    b = b.filter(given.is_null())
                if b.num_rows:
                    yield b.select(["item", *columns, "parts"])

        rows = Variants(variants())
        if len(rows):
            for m in models:
                for t in each(rows, m):
                    yield from t.select(arrow.names).cast(arrow).to_batches()

    # parts as one text, which is less to shuffle than a list
    rows = v.select("assay", "item", *columns, F.array_join(mutation_parts(F.col("mutant")), ":").alias("parts"))
    seeds = model.groupBy("assay").agg(F.collect_set("seed").alias("__seeds"))  # one row per assay
    rows = rows.join(F.broadcast(seeds), "assay").withColumn("__seed", F.explode("__seeds")).drop("__seeds")
    # models are rows among the variants, as bytes: a nested column would be written for every variant
    types = dict(model.dtypes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [pickle.dumps(m) for m in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("assay"), b.column("seed"), pa.array(given, pa.binary())], names=[*by, "__model"])

    given = model.mapInArrow(packed, f"assay {types['assay']}, __seed {types['seed']}, __model binary")
    return rows.unionByName(given, allowMissingColumns=True).groupBy(*by).applyInArrow(run, schema)


def fits_a_task(v: DataFrame, columns: list[str]) -> bool:
    """Whether no assay has more than WHOLE variants, nor a row without one of the columns."""
    n = v.groupBy("assay").agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) == F.col("n"))
    return n.where((F.col("n") > WHOLE) | ~same).isEmpty()


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the first of equal ones first; nan comes last."""
    missing = np.isnan(score) if score.dtype.kind == "f" else np.zeros(len(score), dtype=bool)
    s = np.where(missing, -np.inf, score) if missing.any() else score
    if len(s) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= cut)
    else:
        at = np.arange(len(s))
    return at[np.lexsort((at, -s[at], missing[at]))][:k]


def narrow(most: int) -> type:
    """A signed type that holds numbers up to `most`."""
    return np.int32 if most < 2**31 else np.int64


def along(x: np.ndarray, held: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """Places of the rows, or of those held, in the ascending order of x. A known order of these that is ascending already
    saves the sort; any other is not used."""
    if known is not None and all((s[1:] >= s[:-1]).all() for s in (x[known[lo : lo + CHUNK + 1]] for lo in range(0, len(known), CHUNK))):
        return known
    order = np.argsort(x).astype(narrow(len(x)))
    return order if held is None else order[held[order]]


def doubled(x: np.ndarray, order: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Twice the ranks (from 1, ties averaged) of the places in ascending order, chunk by chunk of the order."""
    n, first, until, last = len(order), 0, 0, None
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)
        s, at = x[order[lo:hi]], np.arange(lo, hi)
        new = np.concatenate([[lo == 0 or s[0] != last], s[1:] != s[:-1]])
        start = np.maximum.accumulate(np.where(new, at, first))
        if until <= hi:
            # where the last run of equal values ends
            until, step = hi, 64
            while until < n:
                other = np.flatnonzero(x[order[until : until + step]] != s[-1])
                if len(other):
                    until += int(other[0])
                    break
                until, step = min(until + step, n), min(4 * step, CHUNK)
        end = np.minimum.accumulate(np.append(np.where(new[1:], at[1:], n), until)[::-1])[::-1]
        first, last = start[-1], s[-1]
        yield slice(lo, hi), start + end + 1


def midranks(x: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, ranks of the rows in that order): ascending from 1, ties averaged. An order that is ascending already saves
    the sort; any other is not used."""
    order = along(x, known=order)
    return order, np.concatenate([np.array([]), *(r / 2 for _, r in doubled(x, order))])


def centred(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place, twice the difference between the rank of each row of the ascending order and the mean rank; 0 for others."""
    out = np.zeros(len(x), dtype=narrow(len(x)))
    for at, r in doubled(x, order):
        out[order[at]] = r - (len(order) + 1)
    return out


def spearman(truth: np.ndarray, x: np.ndarray, order: np.ndarray, least: int = 3) -> float | None:
    """Rank correlation of x with what `truth` has the centred ranks of, over the rows of x's ascending order; None below
    `least` rows or without variance. Sums are exact: those of a chunk are below 2**63 up to 8,000,000 rows."""
    if len(order) < least or np.isnan(x[order[-1]]):
        return None
    aa = ab = bb = 0
    for at, r in doubled(x, order):
        a, b = truth[order[at]].astype(np.int64), r - (len(order) + 1)
        aa, ab, bb = aa + int(a @ a), ab + int(a @ b), bb + int(b @ b)
    return ab / float(aa) ** 0.5 / float(bb) ** 0.5 if aa and bb else None


def marked(n: int, places: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[places] = True
    return out


def highest(x: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest rows of the ascending order, in any order; of equal ones the first are taken, and nan last."""
    if len(order) <= k:
        return order
    if np.isnan(x[order[-1]]):
        at = np.sort(order)
        return at[best(x[at], k)]
    cut, value = x[order[len(order) - k]], lambda i: x[order[i]]
    low, high = (side(range(len(order)), cut, key=value) for side in (bisect_left, bisect_right))
    return np.concatenate([order[high:], np.sort(order[low:high])[: k - (len(order) - high)]])
