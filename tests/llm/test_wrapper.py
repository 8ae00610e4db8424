"""Wrapper inference: alignment against brute force, groups, slots, and articles found through it."""

import random
from functools import lru_cache

import pytest
from assayscope.llm import wrapper
from assayscope.llm.common import Scratch
from pyspark.sql import functions as F

HTML = "page_id long, url string, html string"
SIGS = ["div.a", "div.b", "div.a b", "div#x", "div#y", "div", "p", "article#post-x", "article.q", "article#z.q"]


def test_alignment_is_the_best_of_all():
    pick = random.Random(3)

    def best(a, b):
        @lru_cache(None)
        def of(i, j):
            if i == len(a) or j == len(b):
                return 0
            fit = wrapper.likeness(a[i], b[j])
            return max(of(i + 1, j), of(i, j + 1), of(i + 1, j + 1) + fit if fit else 0)

        return of(0, 0)

    for _ in range(400):
        a, b = ([pick.choice(SIGS) for _ in range(pick.randint(0, 7))] for _ in range(2))
        x, y = ([wrapper.Part(s) for s in side] for side in (a, b))
        got = wrapper.pairs(x, y)
        # all elements, each once, in their order
        assert [p for p, _ in got if p] == x and [q for _, q in got if q] == y
        fits = [wrapper.likeness(p.sig, q.sig) for p, q in got if p and q]
        assert all(fits) and sum(fits) == best(a, b)


@pytest.mark.parametrize("pages, expected", [
    (["<body><p>a", "<body><p>a"], "[body[(p[])+]]"),
    (["<body><p>a<p>b", "<body><h2>x</h2><p>c"], "[body[(h2[$]? p[$]+)+]]"),
    (["<body><div>a</div><div>b</div>", "<body><div>c</div>"], "[body[div[$]+]]"),
    (["<div class=w>a</div>", "<div class=v>b</div><div class=w>c</div>"], "[div.v[$]? div.w[$]]"),
    # turns of two, of which the second page has one
    (["<div class=q>1</div><div class=a>2</div>" * 3, "<div class=q>1</div><div class=a>2</div>"], "[(div.q[$] div.a[$])+]"),
    # a mismatch inside a repeated group is an optional part of it
    (["<div class=i>1</div><div class=i><section>2</section></div>", "<div class=i>3</div>"], "[div.i[$ section[$]?]+]"),
    # ids and classes that differ are slots
    (["<article id=hello class='post news'>a", "<article id=other class='post sport'>b"], "[article#*.post[$]]"),
    (["<div id=post-7>a", "<div id=post-8>b"], "[div#post-0[$]]"),
    ([""], "[]"),
])
def test_wrappers_as_expressions(pages, expected):
    for order in (pages, pages[::-1]):
        assert wrapper.expression(wrapper.infer(order)) == expected


def _page(pick, depth=0):
    if depth == 3:
        return "text %d" % pick.randint(0, 9)
    names = ["<div class=a>", "<div class=b>", "<section>", "<p>", "<div id=post-x>", "<div id=post-y>"]
    return "".join((n := pick.choice(names)) + _page(pick, depth + 1) + ("</p>" if n == "<p>" else "</section>" if n == "<section>" else "</div>") for _ in range(pick.randint(0, 4)))


def test_merged_wrappers_keep_their_counts_and_survive_a_round_trip():
    pick = random.Random(5)
    pages = [_page(pick) for _ in range(40)]
    one = wrapper.infer(pages)
    halves = [wrapper.infer(pages[:20]), wrapper.infer(pages[20:])]
    both = wrapper.align(*(wrapper.load(wrapper.dump(x))[0] for x in halves))
    assert one.pages == both.pages == 40
    chars = sum(sum(wrapper.stream(p)[2]) for p in pages)
    assert chars == sum(x.chars for x, _ in wrapper.preorder(one)) == sum(x.chars for x, _ in wrapper.preorder(both))
    assert wrapper.dump(wrapper.load(wrapper.dump(one))[0]) == wrapper.dump(one)


def test_every_page_is_parsed_by_its_wrapper():
    # what a part of the wrapper says of its pages is what parsing finds in them
    pages = [f"<body><div class=top>t{i}</div>" + "<div class=gallery>g</div>" * (i % 3) + f"<div class=text><p>{i}</p></div>" * (1 + i % 2) + "<div class=end>e</div>" * (i % 2) for i in range(12)]
    w = wrapper.infer(pages)
    for x, parent in wrapper.preorder(w):
        if wrapper._tag(x.sig) != "div":
            continue
        held = 0
        for p in pages:
            sigs, parents, *_ = wrapper.stream(p)
            found = wrapper.parse(w, wrapper.build(sigs, parents), {id(x)})
            assert sorted(found) == [i for i, s in enumerate(sigs) if s == x.sig] and len(found) <= x.most
            held += bool(found)
        assert held == x.pages and x.optional == (held < len(pages))


def test_slots_choose_the_container():
    # the longer text is the same on all pages, so it is the template's, not an article
    page = "<body><div class='content'><p>{}</p></div><div class='story'><p>News {}</p></div></body>"
    parts = wrapper.preorder(wrapper.infer([page.format("About us. " * 20, 1), page.format("About us. " * 20, "2, and more")]))
    assert [parts[i][0].sig for i in wrapper.article(parts)] == ["div.story"]


def test_ids_of_letters_do_not_part_a_template(spark):
    # alone, each page would be all slots, and its longest container the article
    about = "About this site and those who write it, the same on every page. " * 5
    page = "<body><div class='about'><p>{1}</p></div><div class='gallery'>{2}</div><div class='item' id='{0}'><p>News of {0}.</p></div></body>"
    names = ["hello", "winter", "garden", "trains", "letters", "music"]
    long = {n: f"News of {n}. " * (40 + i) for i, n in enumerate(names)}
    rows = [(i, f"http://h.org/{n}", page.format(n, about, "Picture" if i % 2 else "").replace(f"News of {n}.", long[n])) for i, n in enumerate(names)]
    d = spark.createDataFrame(rows, HTML).repartition(3)
    assert {r.page_id: r.text for r in wrapper.main_texts(d).collect()} == {i: long[n].strip() for i, n in enumerate(names)}


def test_rounds_of_merging_unite_all_partial_wrappers(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><div class=head>Site</div><div class=text><p>Number {i} of many</p></div>" + "<div class=more>m</div>" * (i % 3)) for i in range(60)]
    d = spark.createDataFrame(rows, HTML).repartition(12)
    read = d.select("page_id", "url", "html", F.element_at(F.split("url", "/"), 3).alias("site")).mapInArrow(wrapper._read, wrapper.PAGES)
    scratch = Scratch(spark, "test")
    saved = scratch.save(read, "pages")
    got = {fan: {r.site: r for r in wrapper.wrappers(scratch, saved, fan).collect()} for fan in (2, 256)}
    for found in got.values():
        assert set(found) == {"h0.org", "h1.org"}
        for r in found.values():
            parts = wrapper.load(r.wrapper)
            assert parts[0].pages == 30 and [parts[i].sig for i in r.chosen] == ["div.text"]
            assert wrapper.expression(parts[0]) == "[body[div.head[] div.text[(p[$])+] div.more[$]*]]"


def test_wide_and_changing_lists_stay_bounded():
    pick = random.Random(1)
    pages = ["".join(f"<div class=c{''.join(pick.choice('abcdefgh') for _ in range(6))}>{j}</div>" for j in range(120)) for _ in range(30)]
    w = wrapper.infer(pages)
    assert w.pages == 30 and max(len(x.kids) for x, _ in wrapper.preorder(w)) <= wrapper.WIDE
    assert sum(x.chars for x, _ in wrapper.preorder(w)) == sum(sum(wrapper.stream(p)[2]) for p in pages)
    sigs, parents, *_ = wrapper.stream(pages[7])
    assert sorted(wrapper.parse(w, wrapper.build(sigs, parents), {id(x) for x in w.kids})) == list(range(1, 121))
