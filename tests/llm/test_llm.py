"""The training-data operators against brute force, with nulls, empty tables, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayscope.llm import common, decontam, hnsw, langid, minhash, mixing, quality, substring, urlfilter, warc, wrapper
from assayscope.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long, clash string"
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, short, blank and null texts, repeated ids."""
    base = [prose(rnd.randint(60, 160)) for _ in range(25)]
    passage = prose(70)
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        texts.append(t)
        for _ in range(3):
            v = list(w)
            v[rnd.randrange(len(v))] = "changed"
            texts.append("  ".join(v) + "\n")
    texts += [prose(30) + " " + passage + "\t" + prose(20) for _ in range(5)]
    texts += [(prose(60) + " ") * 3, "a b", "a b", "one", "", "   ", None, "a  b\x0bc"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    return rows + [rows[3], (rows[4][0], rows[5][1], None, None, None, None), (None, base[0], None, "s1", 0, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- word hashing -----------------------------------------------------------------------------------


def test_word_hashes_follow_the_words(spark):
    import pyarrow as pa

    texts = ["a b  a", None, "", " b\nc ", "Ab ab", "é"]
    found, each = [], []
    for _, block, _ in W.blocks(pa.array(texts), most=8):
        h = block.hashes(lower=True)
        for i, j in zip(block.at, block.at[1:]):
            found.append(j - i)
            each.append(list(h[i:j]))
    assert found == [len(words(t)) for t in texts]
    assert each[0][0] == each[0][2] != each[0][1] and each[0][1] == each[3][0] and each[4][0] == each[4][1]


def test_rolling_min():
    x = np.array([5, 3, 4, 9, 1, 7, 2])
    assert list(W.rolling_min(x, 3)) == [min(x[i : i + 3]) for i in range(5)]


# -- 1 quality --------------------------------------------------------------------------------------


def rated(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3
        t = prose(40)
        if bad == 0:
            t = t + " vile " + prose(5)
        if bad == 1:
            t = " ".join(x.upper() + "!!" for x in t.split())
        rows.append((i, t, "en", "s", len(t), None))
        labels.append((i, int(bad != 1), int(bad == 0)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_grades(spark, none):
    d, labels = rated(spark)
    out = quality.score(d, quality.learn(d, labels.where("doc_id % 2 = 0"))).where("doc_id % 2 = 1").collect()
    right = {g: sum(r.kept == (g == 2) for r in out if r.doc_id % 3 == g) / 66 for g in range(3)}
    assert min(right.values()) > 0.9, right
    assert all(0 <= r.p_at_least_2 <= r.p_at_least_1 <= 1 and abs(r.expected_grade - r.p_at_least_1 - r.p_at_least_2) < 1e-9 for r in out)
    assert quality.classify(none, labels).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, None), (1, "", None, None, None, None)], DOCS)
    assert quality.classify(odd, labels.limit(0)).where("kept").count() == 2


# -- 2 substring ------------------------------------------------------------------------------------


def brute_cuts(rows):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - 49):
            if i is not None:
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [12_000, 5])
def test_substring_equals_brute_force(docs, none, shard, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_PIECES", shard)
    monkeypatch.setattr(substring.removals, "__defaults__", (shard,))
    got = substring.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_cuts(ROWS)
    assert substring.substring_dedup(none).count() == 0


def test_fm_index_finds_what_is_there():
    seqs = [np.array([1, 2, 3, 1, 2, 3, 4]), np.array([3, 1, 2, 3, 4, 4])]
    at = np.array([0, 7, 13])
    index = substring.FMIndex(np.concatenate(seqs), at, np.array([7, 5]), window=3)
    q = np.array([1, 2, 3, 9, 4, 4, 1, 3, 4, 4])
    got = index.matches(q, np.array([0, 4, 10]))
    none_ = np.iinfo(np.int64).max
    assert list(got) == [5, none_, none_, none_, none_, none_, none_, 5, none_, none_]


# -- 3 WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    page = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é" * 90
    rows = [(5, "http://b.org/x", page), (2, "http://a.b.org/y\n?", page), (9, "http://b.org/x", "short"), (10, None, None), (11, "http://b.org/", "short"), (12, "http://a.b.org/", page), (12, "http://a.b.org/", page)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.archive_pages(p).orderBy("index_position").collect()
    assert all(r.intact for r in out) and [r.index_position for r in out] == list(range(len(rows)))
    keys = [(r.url_key, r.captured, r.page_id) for r in out]
    assert keys == sorted(keys)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    size = len(page.encode())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i > 2
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want) and size >= 100
    assert warc.archive_pages(p.limit(0)).count() == 0


def test_loser_tree():
    for k in range(0, 7):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# -- 4 language ---------------------------------------------------------------------------------------


def test_suffix_automaton_holds_all_substrings():
    s = np.array([0, 1, 0, 0, 2, 1, 0, 1])
    move = langid.automaton(s, 3)

    def has(q):
        at = 0
        for c in q:
            at = move[at, c]
            if at < 0:
                return False
        return True

    inside = {tuple(s[i:j]) for i in range(8) for j in range(i + 1, 9)}
    for a in range(3):
        for b in range(3):
            for c in range(3):
                for q in ((a,), (a, b), (a, b, c)):
                    assert has(q) == (q in inside)


def test_language(spark, none):
    parts = {"xx": "bada gobu dibo", "yy": "retel sinat lomer"}
    rows = [(i, " ".join(rnd.choice(parts[x].split()) + rnd.choice(["", "a", "en"]) for _ in range(40)), x, None, 0, None) for i in range(60) for x in [("xx", "yy")[i % 2]]]
    rows += [(100, None, "xx", None, None, None), (101, "123 !!", None, None, None, None), (101, rows[0][1], None, None, None, None)]
    out = langid.language_ids(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.lang_pred == ("xx", "yy")[r.doc_id % 2] for r in out if r.doc_id < 60) >= 59
    assert sorted(r.lang_pred for r in out if r.doc_id >= 100) == ["und", "und", "xx"] and all(0 <= r.score <= 1 for r in out)
    assert langid.language_ids(none).count() == 0


def test_languages_of_many_letters():
    # 200 letters each, all rarer than the 70 syllables of "ko"; the last language lies beyond U+FFFF
    pick = random.Random(3)
    text = lambda first, n: " ".join("".join(chr(first + pick.randrange(200)) for _ in range(4)) for _ in range(n))
    starts = {"aa": 0x4E00, "bb": 0x5E00, "cc": 0x20000}
    ko = "".join(chr(0xAC00 + i) for i in range(70))
    m = langid.Model({"ko": ko * 600, **{k: text(v, 2000) for k, v in starts.items()}})
    n = m.phrases([text(v, 60) for v in starts.values()] + [ko])
    assert [m.langs[k] for k in n.argmin(axis=1)] == ["aa", "bb", "cc", "ko"]


def test_language_is_not_learned_from_openings_alone(spark):
    opening = ("kalo mire vuto sane " * 125)[:2500]
    parts = {"xx": "bada gobu dibo", "yy": "retel sinat lomer"}
    rows = [(i, opening + " ".join(rnd.choice(parts[x].split()) for _ in range(500)), x, None, 0, None) for i in range(80) for x in [("xx", "yy")[i % 2]]]
    out = langid.language_ids(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.lang_pred == ("xx", "yy")[r.doc_id % 2] for r in out)


# -- 5 vectors ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [2048, 40])
def test_vectors_equal_brute_force(spark, shard):
    g = np.random.default_rng(3)
    centre = g.normal(size=(30, 16))
    x = np.concatenate([centre, np.repeat(centre[:6], 25, axis=0) + 0.08 * g.normal(size=(150, 16)), centre[:5]])
    rows = [(i, [float(v) for v in e], int(i % 3)) for i, e in enumerate(x)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [1.0, None], 2), (505, [1.0], 2), (506, [2.0], 2), (506, [2.0], 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hnsw.near_vectors(d, shard=shard).collect()
    n = len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.arange(n)[:, None] % 3 == np.arange(n)[None] % 3)
    np.fill_diagonal(link, False)
    comp = np.arange(n)
    while True:
        new = np.minimum(comp, np.where(link, comp[None], n).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    for r in got:
        if r.vec_id < 500:
            assert (r.n_links, r.component_id, r.kept) == (link[r.vec_id].sum(), comp[r.vec_id], comp[r.vec_id] == r.vec_id)
    rest = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id >= 500)
    assert rest == [(500, 0, 500, True), (501, 0, 501, True), (502, 0, 502, True), (503, 0, 503, True), (504, 0, 504, True), (505, 2, 505, True), (506, 2, 505, False), (506, 2, 505, False)]
    assert hnsw.near_vectors(d.limit(0)).count() == 0


def test_audit_sees_sparse_links_and_queries_from_outside():
    g = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    pairs = np.repeat(g.normal(size=(150, 32)), 2, axis=0) + 0.02 * g.normal(size=(300, 32))
    x = unit(np.concatenate([g.normal(size=(1, 32)) + 0.02 * g.normal(size=(700, 32)), pairs]))
    cut = hnsw.HNSW(x)
    for links in cut.links:  # nothing leads to the pairs any more
        links[links >= 700] = -1
    cut.entry = 0
    beam = cut.audited_beam(0.93)
    found = set(zip(*map(np.ndarray.tolist, cut.within(x[700:], 0.93, beam))))
    assert all((i, 700 + (i ^ 1)) in found for i in range(300))
    # vectors of the graph have no links among each other, those of the other shard do
    lone = hnsw.HNSW(x[700::2])
    for links in lone.links:
        links[:] = -1
    a, v = lone.within(x[701::2], 0.93, lone.audited_beam(0.93, others=x[701::2]))
    assert set(zip(a.tolist(), v.tolist())) >= {(i, i) for i in range(150)}


# -- 6 mix --------------------------------------------------------------------------------------------


def test_mix(docs, none):
    out = mixing.pareto_mix(docs).collect()
    rows = ROWS
    assert len(out) == len(rows)
    size = {}
    for _, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    assert {r.source: r.mix_source_size for r in out} == size
    target = {r.source: r.mix_target for r in out}
    assert sum(target.values()) == pytest.approx(sum(size.values())) and all(target[s] <= 3 * size[s] + 1e-6 for s in size)
    order = sorted(size, key=lambda s: (s is None, s))
    free = [s for s in order if target[s] < 3 * size[s] - 1e-6]
    assert len({round(target[s] / (1, 2, 3)[order.index(s) % 3], 6) for s in free}) <= 1
    for s in size:
        took = sum(r.mix_taken for r in out if r.source == s)
        assert abs(took - target[s]) <= max(r.mix_size for r in out if r.source == s)
    assert all(0 <= r.mix_taken <= 3 * r.mix_size for r in out)
    key = lambda x: sorted((str(r.doc_id), r.mix_size, r.mix_taken) for r in x)
    assert key(out) == key(mixing.pareto_mix(docs.repartition(2)).collect())
    assert mixing.pareto_mix(none).count() == 0


# -- 7 decontamination ----------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, none):
    items = [(i, prose(rnd.randint(12, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, None)]
    items[11] = (11, items[0][1])
    rows = []
    for i, (_, t) in enumerate(items[:11]):
        w = t.upper().split()
        rows.append((i, prose(25) + " " + ", ".join(w) + " " + prose(30), None, None, None, None))
        rows.append((100 + i, prose(20) + " " + " ".join(w[: len(w) // 2]) + " " + prose(30), None, None, None, None))
    rows += [(200, items[2][1], None, None, None, None), (201, None, None, None, None, None), (202, "two", None, None, None, None), (203, "so two words here", None, None, None, None), (203, "", None, None, None, None)]
    d, b = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: [x for x in re.split(r"[^\w]+", (t or "").lower()) if x]

    def shingles(w):
        from collections import Counter

        return Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    want = set()
    for i, t, *_ in rows:
        w = norm(t)
        for j, u in items:
            v = norm(u)
            for p in range(max(1, len(w) - len(v) + 1)):
                if v and w:
                    a, c = shingles(w[p : p + len(v)]), shingles(v)
                    if 100 * sum((a & c).values()) >= 80 * sum((a | c).values()):
                        want.add((i, j))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()}
    assert got == want and (0, 0) in got and (0, 11) in got and (203, 52) in got
    assert decontam.leaks(none, b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0
    left = {r.doc_id for r in decontam.decontaminate_stage(d, b).collect()}
    assert left == {r[0] for r in rows} - {i for i, _ in want} | {203}


def test_blocks_meet_within_the_radius(spark):
    rows = []
    for i in range(400):
        x, n = rnd.getrandbits(64), rnd.randint(0, decontam.RADIUS)
        y = x
        for b in rnd.sample(range(64), n):
            y ^= 1 << b
        rows.append((i, x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    d = spark.createDataFrame(rows, "i int, x long, y long")
    meet = F.arrays_overlap(decontam.blocks(F.col("x")), decontam.near_blocks(F.col("y"), decontam.RADIUS))
    assert d.where(meet).count() == 400
    r = d.select("x", decontam.blocks(F.col("x")).alias("b")).first()
    assert sum(b.value << 16 * b.no for b in r.b) == r.x % (1 << 64)


def test_near_leaks_by_place_and_similarity(spark):
    """Start, length and similarity of every leak against brute force, over items edited in one to three words."""
    pick = random.Random(5)
    items = [(i, " ".join(pick.choice(VOCAB) for _ in range(pick.randint(14, 59)))) for i in range(60)]
    rows = []
    for i, t in items * 4:
        w = t.split()
        for _ in range(len(rows) % 3):
            at = pick.choice([0, 1, len(w) - 1, pick.randrange(len(w))])
            w[at : at + 1] = pick.choice([["changed"], ["changed", w[at]], []])
        rows.append((len(rows), " ".join(pick.choice(VOCAB) for _ in range(12)) + " " + " ".join(w) + " " + " ".join(pick.choice(VOCAB) for _ in range(12))))
    d, b = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start): (r.length, r.similarity) for r in decontam.leaks(d, b).collect()}

    def counted(w):
        from collections import Counter

        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    norm = lambda t: [x for x in re.split(r"[^\w]+", t.lower()) if x]
    want, near = {}, 0
    for i, t in rows:
        w = norm(t)
        for j, u in items:
            v = norm(u)
            for p in range(len(w) - len(v) + 1):
                if w[p + 5 : p + 8] != v[5:8] and w[p : p + 3] != v[:3] and w[p + len(v) - 3 : p + len(v)] != v[-3:]:
                    continue
                a, c = counted(w[p : p + len(v)]), counted(v)
                s = sum((a & c).values()) / sum((a | c).values())
                if s >= 0.8:
                    want[i, j, p] = (len(v), s)
    near = [k for k, (_, s) in want.items() if s < 1]
    assert {k: v for k, v in got.items() if k in want} == {k: pytest.approx(v) for k, v in want.items() if k in got}
    # windows are laid where a shingle stands as in the item: every other place of a leak overlaps one of these
    assert {k[:2] for k in want} == {k[:2] for k in got} and len(near) > 60
    assert sum(k in got for k in near) >= 0.95 * len(near)


# -- 8 URLs ---------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "http://example.com/de", "http://x.net/es/a", "http://net/fr/", "http://xnet/es/", "ftp://com", "nothing", None, "", "http://a.com/#/en/", "http://example.com/en"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(d).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert [got[i][2:] for i in range(1, 12)] == [
        ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("com/", "allow"),
    ]
    assert got[7][:2] == ("", "") and got[8][:2] == ("", "")
    assert urlfilter.judge(d).count() == 13 and urlfilter.judge(d.limit(0)).count() == 0
    rules = spark.createDataFrame([(f"h{i}.org", "/", "block") for i in range(300)], "host string, path string, verdict string")
    many = spark.createDataFrame([(i, f"http://h{i}.org/p") for i in range(600)], "page_id long, url string")
    assert urlfilter.judge(many, rules).where("verdict = 'block'").count() == 300


# -- 9 MinHash --------------------------------------------------------------------------------------------


def test_minhash_equals_brute_force(docs, none):
    rows = [r for r in ROWS if r[0] is not None]
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def shingles(t):
        w = words((t or "").translate(low))
        return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i : i + 4]) for i in range(len(w) - 3)])

    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for c, r in zip(comp, rows):
        least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((r[0], len(s), least[c], least[c] == r[0]) for r, s, c in zip(rows, sets, comp))
    got = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(none).count() == 0


def edited(base, n, most, pick):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(pick.randint(1, most)):
            w[pick.randrange(len(w))] = f"new{pick.randrange(40)}"
        out.append(" ".join(w))
    return out


def components_by_hand(rows, k=4):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    number, sets = {}, []
    for _, t in rows:
        w = words((t or "").translate(low))
        sets.append({number.setdefault(tuple(w[i : i + k]), len(number)) for i in range(max(len(w) - k + 1, min(len(w), 1)))})
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    links = 0
    for i, s in enumerate(sets):
        met = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, both in met.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links += 1
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [find(i) for i in range(len(rows))], links


@pytest.mark.parametrize("original", [True, False])
def test_a_crowd_of_edited_copies(spark, original):
    """Copies on both sides of the threshold, with edits that recur, with and without the original."""
    pick = random.Random(17)
    base = " ".join(pick.choice(VOCAB) for _ in range(130))
    texts = [base] * original + edited(base, 260, 9, pick)
    rows = list(enumerate(texts))
    comp, links = components_by_hand(rows)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert links > 1000 and len(set(comp)) > 30
    assert sorted((r.doc_id, r.component_id) for r in out) == list(enumerate(comp))


def test_recall_on_the_given_documents(spark):
    """At MISS, and with the bands' own chance to meet, at least 0.95 of the documents keep their component."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    comp, _ = components_by_hand(rows)
    want = {r[0]: rows[c][0] for r, c in zip(rows, comp)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert all(want[i] == want[c] for i, c in got.items())  # no link below the threshold


def test_posterior_bound_keeps_sure_pairs():
    for n in (25, 50, 125):
        m = minhash.least_matches(0.8, n, 1e-5)
        assert 0 < m < 0.8 * n and minhash.least_matches(0.8, n, 1e-9) <= m


def test_components_both_ways(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9] + [(100, 5), (7, 7)], "a long, b long")
    found = [{tuple(r) for r in common.components(common.Scratch(spark, "cc"), edges, local=n).collect()} for n in (1000, -1)]
    assert found[0] - {(7, 7)} >= found[1] and all((n, (n // 10) * 10) in found[1] for n in range(30)) and (100, 0) in found[1]


# -- 10 HTML ----------------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content"><article><h1>Head &amp; more</h1><p>One <b>two</b>
 three<br>four<p>Five<!-- x --><script>var a = "</p>";</script><ul><li>Six<li>Seven</ul><div class="ad">Buy</div><aside>Side</aside><form>Go</form></article>
<div class="comments"><p>Reader</p></div></div><footer>&copy; F</footer></body></html>"""


def test_html(spark):
    want = "Head & more\n\nOne two three four\n\nFive\n\nSix\n\nSeven"
    assert wrapper.extract(PAGE, "article") == want and wrapper.extract(PAGE, None) == want
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("Five", f"Five {i}")) for i in range(6)] + [(7, None, None), (8, "x", ""), (9, "http://h0.org/z", "<p>Only <i>text</i>"), (9, "http://h0.org/z", "<p>Only <i>text</i>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in wrapper.main_texts(d).collect())
    texts = [want.replace("Five", f"Five {i}") for i in range(6)] + ["", "", "Only text", "Only text"]
    assert got == [(r[0], t, len(t)) for r, t in zip(rows, texts)]
    assert wrapper.main_texts(d.limit(0)).count() == 0


def test_every_template_of_a_host_has_a_wrapper(spark):
    # 60 pages hold div.content as the article; three of another template hold it as a teaser
    usual = "<body><div class='content'><p>Usual article number {}, long enough.</p></div></body>"
    rare = "<body><div class='content'><p>Teaser {0}</p></div><div class='story'><p>" + "Rare article {0}. " * 9 + "</p></div></body>"
    long = "<body>" + "<p></p>" * 4000 + "<div class='content'><p>Teaser {0}</p></div><article><p>" + "Late article {0}. " * 9 + "</p></article></body>"
    rows = [(i, f"http://h.org/{i}", (usual if i < 60 else rare if i < 63 else long).format(i)) for i in range(66)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrapper.main_texts(d).collect()}
    want = lambda i: f"Usual article number {i}, long enough." if i < 60 else (f"{'Rare' if i < 63 else 'Late'} article {i}. " * 9).strip()
    assert got == {i: want(i) for i in range(66)}


def test_pages_that_differ_in_a_number_share_a_template():
    page = '<body class="postid-{0}"><article id="post-{0}" class="post type-post"><p>Text {0}</p></article></body>'
    assert len({wrapper.template(wrapper.read(page.format(i))[0]) for i in (1, 22, 333)}) == 1


@pytest.mark.parametrize("body, text", [
    ('<div class="content has-sidebar"><p>Text</p></div>', "Text"),
    ('<div class="post-content no-sidebar"><p>Text</p></div>', "Text"),
    ('<div class="article-header"><h1>Title</h1></div>', "Title"),
    ('<p class="legal">Text', "Text"),
    ('<section class="legal">Text</section>', "Text"),
    ('<div class="related-story">Text</div>', "Text"),
    ('<article><p>Text</p><section class="post-comments">Ha</section><div class="comment-body">Ha</div></article>', "Text"),
    ('<article><p>Text</p><div class="article-ad">Buy</div><div class="content-sidebar">More</div><div class="post-footer">End</div></article>', "Text"),
    ('<div id="main" class="main sidebar-left"><p>Text</p></div>', "Text"),
    ('<article><p class="share">A share of profits rose.</p><p class="ad">Buy</p></article>', "A share of profits rose."),
    ('<article><p>Press <button>Save</button>, so <math><mi>x</mi></math> stays.</p><button>Like</button></article>', "Press Save, so x stays."),
    ('<div class="ad-slot">Buy</div><div id="comments">Ha</div><p>Text', "Text"),
])
def test_marks_are_whole_names(body, text):
    assert wrapper.extract(body, None) == text


def test_deep_and_broken_markup_takes_linear_time():
    import time

    began = time.time()
    w = wrapper.infer(["<div>" * 5000 + "<p>text</p>" + "</div>" * 5000])
    wrapper.article(wrapper.preorder(w))
    wrapper.read("<a b " * 50_000)
    assert time.time() - began < 5


# -- odd columns, long texts, empty tables ------------------------------------------------------------------


ODD = "kept boolean, rule string, verdict string, host string, mix_copies long, mix_size long, copy_no int, _id long, __id long, _hash long, _key string, __gone boolean, expected_grade double, size long, u double, row string, level int"


def odd(spark, rows):
    names = ODD.split(", ")
    values = {"boolean": "true", "string": "'x'", "long": "7L", "double": "0.5D", "int": "3"}
    extra = [F.expr(values[n.split()[1]]).alias(n.split()[0]) for n in names]
    return spark.createDataFrame(rows, DOCS).select("*", *extra)


def test_clashing_columns(spark, docs):
    import corpus_pipeline as C

    d, (rated_docs, labels) = odd(spark, ROWS), rated(spark, 60)
    plain = lambda f: sorted(map(repr, f.select("doc_id", "text").collect()))
    benchmark = spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string")
    for stage in (lambda x: quality.quality_stage(x, labels), minhash.near_dedup_stage, substring.substring_dedup_stage, lambda x: decontam.decontaminate_stage(x, benchmark)):
        out = stage(d)
        assert out.columns == d.columns and plain(out) == plain(stage(docs))
        assert {(r.kept, r.rule, r._id, r["__gone"]) for r in out.select("kept", "rule", "_id", "__gone").collect()} == {(True, "x", 7, True)}
    mixed = C.source_mix(spark, d, "")
    assert len({c.lower() for c in mixed.columns}) == len(mixed.columns) and mixed.where("copy_no < 1 or copy_no > 3 or size <> 7").count() == 0
    pages = spark.createDataFrame([(1, "http://net/fr/", "<p>a")], "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("host", "Rule", "block", "mask", "rule_verdict", "row", "path")])
    r = urlfilter.judge(pages).first()
    assert (r.host, r.path, r.rule, r.verdict, r.block, r.rule_verdict) == ("net", "/fr/", "net/fr/", "block", "x", "x")
    assert wrapper.main_texts(pages).first().text == "a" and warc.archive_pages(pages).first().intact


def test_stages_of_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for out in (quality.quality_stage(none, labels), minhash.near_dedup_stage(none), substring.substring_dedup_stage(none), decontam.decontaminate_stage(none, benchmark), mixing.pareto_mix(none)):
        assert out.count() == 0


def test_a_text_of_five_megabytes(spark):
    pick = random.Random(8)
    long = " ".join(pick.choice(VOCAB) for _ in range(1_100_000))
    assert len(long) > 5_000_000 * 0.9
    d = spark.createDataFrame([(1, long, "xx", "a", None, None), (2, long, "yy", "a", None, None), (3, prose(60), "xx", "b", None, None)], DOCS)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect()} == {(1, 1), (2, 1), (3, 3)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(d).collect()}
    assert cut == {1: (1_100_000, 0), 2: (1_100_000, 1_100_000), 3: (60, 0)}
    assert mixing.pareto_mix(d).where("mix_size = 1100000").count() == 2
    assert langid.language_ids(d).count() == 3
    html = spark.createDataFrame([(1, "http://a.org/", f"<article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert wrapper.main_texts(html).first().n_chars == len(long)


# -- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as C

    d, labels = rated(spark, 400)
    every = d.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    item = "qqa qqb qqc qqd qqe qqf qqg qqh qqi qqj qqk"
    every = every.unionByName(spark.createDataFrame([(50_000, prose(20) + " " + item + " " + prose(20), "en", "s", 1, None)], DOCS))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(C.STAGES):
        before, out = kept.columns, stage(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        kept = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert kept.count() > 0 and (i == 4 or kept.columns == before), name
    assert kept.where("doc_id = 50000").count() == 0
