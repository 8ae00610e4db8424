"""Inputs that once gave wrong, partial or very late results."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayscope.llm import decontam, hnsw, langid, quality, urlfilter, warc

PAGES = "page_id long, url string, html string"


def test_captures_do_not_know_the_session_time_zone(spark):
    # the end of summer time in New York: local clocks show one hour twice
    first = 1_604_205_000 - warc.EPOCH
    rows = [(first + 600 * i, "http://a.org/x", f"page {i}") for i in range(16)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [got[i].index_position for i, *_ in rows] == list(range(16)) and got[first].captured == "2020-11-01T04:30:00Z"


def test_captures_of_very_large_page_ids_stay_in_order(spark):
    ids = [None, 0, 5, 2_999_999_999, 3_000_000_000, 3_000_000_001, 10**15, 10**15 + 1]
    got = {r.page_id: r.index_position for r in warc.archive_pages(spark.createDataFrame([(i, "http://a.org/", "x") for i in ids], PAGES)).collect()}
    assert [got[i] for i in ids] == list(range(len(ids)))


def test_a_damaged_archive_is_told():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse(record * 3))) == 3 and list(warc.parse(b"")) == []
    for bad in (record + b"x" + record, (record * 2)[:-1], (record * 2)[:-8]):
        with pytest.raises(ValueError, match="damaged"):
            list(warc.parse(bad))


def test_a_language_with_little_to_learn_from_is_found(spark):
    pick = random.Random(4)

    def language():
        vocabulary = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 7))) for _ in range(150)]
        return lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))

    a, b = language(), language()
    learned = [(i, a(60), "a") for i in range(400)] + [(500 + i, b(5), "b") for i in range(8)]
    model = langid.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(f"{name}{i}", f(30)) for name, f in (("a", a), ("b", b)) for i in range(200)], "doc_id string, text string")
    got = langid.identify(asked, model).collect()
    assert sum(r.doc_id[0] == r.lang_pred for r in got) >= 0.95 * 400


def test_phrases_are_those_of_a_plain_greedy_parser():
    pick = random.Random(2)
    samples = {x: "".join(pick.choice(alphabet) for _ in range(300)) for x, alphabet in (("a", "abc "), ("b", "abdé "), ("c", "中文ab "))}
    model = langid.Model(samples)
    texts = ["".join(pick.choice("aab b") for _ in range(n)) for n in (1, 7, 200, langid.LANE)]

    def plain(text, sample):
        text, sample = ("".join(map(chr, langid.codes(x))) for x in (text, sample))
        n, i = 0, 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    assert model.phrases(texts).tolist() == [[plain(t, samples[x]) for x in model.langs] for t in texts]


def test_vectors_of_any_magnitude(spark):
    base = [(0, [1.0, 0.1]), (1, [1.0, 0.1001]), (2, [0.0, 1.0])]
    rows = [(i + 10 * k, "l", [x * s for x in v]) for k, s in enumerate((1.0, 1e200, 1e-200, 1e-310)) for i, v in base] + [(90, "l", [1.0, 1.0]), (91, "l", [1e-200, 1e-200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert {got[i + 10 * k] for k in range(4) for i in (0, 1)} == {(7, 0)} and {got[2 + 10 * k] for k in range(4)} == {(3, 2)} and got[90] == got[91] == (1, 90)


@pytest.mark.parametrize("blind", [0, 1])
def test_vectors_that_share_one_hash_stay_apart(spark, monkeypatch, blind):
    hashes = hnsw._hashes
    monkeypatch.setattr(hnsw, "_hashes", lambda: tuple(F.lit(7).cast("long") if k == blind else h for k, h in enumerate(hashes())))
    base = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.01, 1.0], [0.0, 0.0, 1.0]]
    rows = [(i, "a" if i < 8 else "b", base[i % 4]) for i in range(12)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert got == {i: (1, i % 4) if i % 4 < 2 else (3, 2) for i in range(8)} | {8: (0, 8), 9: (0, 9), 10: (1, 10), 11: (1, 10)}


def test_one_word_sixty_thousand_times(spark):
    docs = spark.createDataFrame([(1, "ha " * 60_000), (2, "other words that have nothing to do with it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "ha " * 100)], "item_id long, text string")
    began = time.time()
    out = decontam.leaks(docs, items)
    assert out.groupBy("doc_id", "item_id", "length").agg(F.count("*").alias("n"), F.min("similarity").alias("s")).collect() == [(1, 7, 100, 59_901, 1.0)]
    assert time.time() - began < 100


def test_a_host_of_many_labels(spark):
    long = "a." * 12_000
    rows = [(1, f"http://{long}example.com/en/x", None), (2, f"http://{long}www.example.com/en/", None), (3, f"http://{long}org/", None)]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: (None, "allow")} and time.time() - began < 15


def test_five_megabytes_of_quality_and_benchmark(spark):
    pick = random.Random(1)
    vocabulary = ["".join(pick.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    long = " ".join(pick.choice(vocabulary) for _ in range(1_050_000))
    item = " ".join(pick.choice(vocabulary) for _ in range(40))
    docs = spark.createDataFrame([(1, long + " " + item), (2, "good words " * 30), (3, "bad words " * 30)], "doc_id long, text string")
    out = decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert (1_050_000, 1.0) in {(r.start, r.similarity) for r in out.collect()}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 3


def test_links_of_one_shard_count_from_either_end():
    pick = np.random.default_rng(4)
    n = 2 * hnsw.BLOCK + 37
    far = pick.random((n, n)) < 0.01
    blocks = [(lo, *(a + b for a, b in zip(np.nonzero(far[lo : lo + hnsw.BLOCK]), (lo, 0)))) for lo in range(0, n, hnsw.BLOCK)]
    got = np.zeros((n, n), bool)
    for _, q, v in hnsw._either(iter(blocks), n):
        assert not got[q, v].any()
        got[q, v] = True
    want = far | far.T
    np.fill_diagonal(want, False)
    assert (got == want).all()


def test_forest_of_blocks_unites_what_edges_unite():
    pick = np.random.default_rng(9)
    for n, m in ((1, 0), (50, 20), (300, 280), (300, 900)):
        a, b = pick.integers(0, n, m), pick.integers(0, n, m)
        forest, kept = hnsw.Forest(n), []
        for lo in range(0, m, 64):
            kept += [lo + k for k in forest.add(a[lo : lo + 64], b[lo : lo + 64])]
        for edges in (range(m), kept):
            root = list(range(n))
            changed = True
            while changed:
                changed = False
                for k in edges:
                    least = min(root[a[k]], root[b[k]])
                    changed |= root[a[k]] != least or root[b[k]] != least
                    root[a[k]] = root[b[k]] = least
            assert root == forest.root.tolist()
        assert len(kept) == n - len(set(root))
