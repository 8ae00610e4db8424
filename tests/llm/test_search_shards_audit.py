"""Lexical search, Hilbert shards and the filter audit against brute force, with odd rows and tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayscope.llm import audit, hilbert, lexical

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
rnd = random.Random(5)
WORDS = ["Alpha", "beta", "gamma", "delta9", "épée", "naïve", "ab", "a", "中文", "X1"] + ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5))) for _ in range(60)]


def text(n):
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", ", ", "-", "\n", "\x00", "  ", "#", "."]) for _ in range(n))


TEXTS = [text(rnd.randint(1, 80)) for _ in range(60)]
TEXTS += TEXTS[:8] + ["", "  \t", None, "alpha", "ALPHA", "alphabeta", "éé é", "...", "beta beta beta", TEXTS[0] * 40]
ROWS = [(i, t, ["en", "de", None][i % 3], None if i % 5 == 0 else f"s{i % 4}", 1) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[3], (None, TEXTS[2], "en", "s1", 1), (ROWS[4][0], TEXTS[9], "en", "", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- lexical search -------------------------------------------------------------------------------------


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(lexical.TERM, low)


def plain_search(rows, items, top):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for name in {i for i, _ in items}:
        wanted = Counter(t for x in {x for i, x in items if i == name} for t in terms(x))
        scored = []
        for i, c, size in held:
            m = 25 + 75 * size * n // length
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(name, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


ITEM_ROWS = [(1, "alpha beta beta"), (2, "épée 中文 nothere"), (3, text(40)), (4, None), (5, "..."), (6, "nothere"), (7, "Ab A x1"), (3, text(5)), (7, "Ab A x1"), (None, "gamma delta9")]


@pytest.mark.parametrize("most, top", [(400_000, 10), (6, 3)])
def test_search_equals_brute_force(spark, docs, most, top):
    got = lexical.search(docs, spark.createDataFrame(ITEM_ROWS, ITEMS), top, most).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search([(r[0], r[1]) for r in ROWS], ITEM_ROWS, top)


def test_search_in_small_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    want = sorted(map(repr, lexical.search(docs, items).collect()))
    monkeypatch.setattr(lexical, "CELLS", 1)
    monkeypatch.setattr(lexical, "OUTPUTS", 1)
    assert sorted(map(repr, lexical.search(docs, items).collect())) == want


def test_search_of_odd_tables(spark, docs, none):
    items, no_items = spark.createDataFrame(ITEM_ROWS, ITEMS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none, items).count() == lexical.search(docs, no_items).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("item_id", "term", "rank", "score", "task", "n")})
    want = sorted(map(repr, lexical.search(docs, items).collect()))
    assert sorted(map(repr, lexical.search(clash, items.withColumns({"doc_id": F.lit(1), "term": F.lit(2)})).collect())) == want


def test_search_of_named_items(spark, docs):
    got = lexical.search(docs, spark.createDataFrame([("a", "alpha"), ("b", "beta")], "item_id string, text string"))
    assert dict(got.dtypes)["item_id"] == "string" and {r.item_id for r in got.collect()} == {"a", "b"}


# -- Hilbert shards -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    d = spark.range(side**dims).select(*[(F.floor(F.col("id") / side**k) % side).alias(f"c{k}") for k in range(dims)])
    got = d.withColumn("h", hilbert.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(side**dims))
    points = [tuple(r)[:dims] for r in got]
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in itertools.pairwise(points))


def test_cells_hold_equal_shares(spark):
    d = spark.createDataFrame([(None,)] * 8 + [(i,) for i in range(24)] + [(99,)] * 32, "v int")
    got = {r.v: r["__cell"] for r in hilbert.cells_of(d, "v", 3).collect()}
    assert got[None] == 0 and got[0] == 1 and got[23] == 3 and got[99] == 4


def test_size_classes_follow_sizes(spark):
    got = [r.c for r in spark.range(1, 3000).orderBy("id").select(hilbert.size_class(F.col("id")).alias("c")).collect()]
    assert got == sorted(got) and got[15] == got[16 - 1] and len(set(got)) < 150


@pytest.mark.parametrize("law", hilbert.LAWS)
def test_shards_follow_the_law(spark, docs, law):
    got = hilbert.assign(docs, 8, law).collect()
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert {(r.law, r.grown_shard) for r in got} == {(law, None)}
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        sizes = [sum(r["size"] for r in got if r.shard <= s) for s in range(8)]
        assert all(abs(x - sizes[-1] * (s + 1) / 8) <= max(r["size"] for r in got) / 2 for s, x in enumerate(sizes))


def test_shards_of_odd_tables(spark, docs, none):
    assert hilbert.assign(none).count() == hilbert.shard(none, law="bytes").count() == 0
    one = hilbert.assign(docs.limit(1)).first()
    assert (one.shard, one.slot) == (0, 0)
    clash = docs.withColumns({c: F.lit("x") for c in ("size", "shard", "SLOT", "law", "curve", "_size", "_curve", "cell_a", "tie", "__total")})
    out = hilbert.shard(clash)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.where("law <> 'rows' or _size <> 'x' or __total <> 'x'").count() == 0
    assert sorted((repr(r.doc_id), r.shard, r.slot) for r in out.select("doc_id", "shard", "slot").collect()) == sorted((repr(r.doc_id), r.shard, r.slot) for r in hilbert.assign(docs).collect())


def test_written_shards_can_be_skipped_by_each_dimension(spark, tmp_path):
    pick = random.Random(3)
    rows = [(i, "x" * int(2 ** pick.uniform(3, 10)), pick.choice("abcd"), f"s{pick.randrange(16):02d}", 1) for i in range(2000)]
    d = spark.createDataFrame(rows, DOCS)
    sharded = hilbert.shard(d, 32)
    hilbert.write_shards(sharded, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000 and back.where("shard = 7").orderBy("slot").select("slot").collect() == [(i,) for i in range(back.where("shard = 7").count())]
    spans = hilbert.manifest(back, ["size", "lang", "source"]).collect()
    assert sum(r["rows"] for r in spans) == 2000
    # sorted by one column, every other column would need nearly all 32 shards
    hit = lambda lo, hi, c: sum(r[f"min_{c}"] <= hi and r[f"max_{c}"] >= lo for r in spans)
    assert max(hit("a", "a", "lang"), hit("s03", "s03", "source"), hit(8, 16, "size")) <= 20


# -- filter audit -----------------------------------------------------------------------------------------


def fails(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))]


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    docs = []
    for i, t, _, source, _ in rows:
        t = t or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        docs.append((source or "", {f for f, x in zip("ABCDE", [*fails(t), copy]) if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed[f] += len(gone)
                all_failing = sum(f in d[1] for d in mine)
                out[part, order, step] = [len(left), len(gone), all_failing - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


def test_audit_equals_walking_every_order(spark):
    pick = random.Random(9)
    body = lambda n, k: " ".join(pick.choice("abcdefghijklmnopqrstuvwxyz"[:k]) * pick.randint(1, 9) for _ in range(n))
    texts = [body(pick.choice([10, 49, 50, 80]), pick.choice([3, 26])) + pick.choice(["", "", " $", " ABCDEFGHIJKLMNOP" * 3]) for _ in range(120)]
    texts += [pick.choice(texts[:20]) for _ in range(60)] + [None, "", "", " "]
    rows = [(i, t, "en", pick.choice(["s1", "s2", "s3", "", None]), 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[0], "en", "s1", 1), (None, texts[0], "en", "s1", 1), (rows[7][0], "another", "en", "s2", 1), (-4, texts[3], "en", "only", 1)]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 180, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = audit.audit(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == plain_audit(rows, labels) and len(got) == 600 * 5


@pytest.mark.parametrize("k", [1, 3, 5, 6])
def test_paths_of_the_lattice(k):
    forward, backward = audit.lattice(k)
    assert forward[-1] == backward[0] == math.factorial(k)
    for f in range(k):
        assert sum(w for _, g, w in audit.edges(k) if g == f) == math.factorial(k)


def test_audit_of_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(none, labels).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "good", "toxic", "key", "n", "quality")})
    a, b = (sorted(map(repr, audit.audit(d, labels).collect())) for d in (docs, clash))
    assert a == b and len(a) == 600 * len({r[3] or "" for r in ROWS})


def test_five_megabytes(spark):
    pick = random.Random(8)
    long = " ".join(pick.choice(WORDS) for _ in range(1_200_000))
    d = spark.createDataFrame([(1, long, "en", "a", 1), (2, long, "en", "a", 1), (3, "beta gamma", "en", "b", 1)], DOCS)
    items = spark.createDataFrame([(1, "beta gamma épée")], ITEMS)
    got = [tuple(r) for r in lexical.search(d, items).orderBy("rank").collect()]
    assert got == plain_search([(r.doc_id, r.text) for r in d.collect()], [(1, "beta gamma épée")], 10)
    assert hilbert.assign(d).where(F.col("size") > 5_000_000).count() == 2
    out = audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1 and part = 'a'").first()
    assert (out.kept, out.removed) == (1, 1)
