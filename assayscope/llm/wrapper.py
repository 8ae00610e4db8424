"""HTML main-text extraction by union-free wrapper inference.

Every page is read once, in tasks, into its token stream: the block elements outside of boilerplate, nested, with
the length and hash of the text right in each. Pages of a host whose text lies under the same chain of elements share a
template, and each template has a wrapper, inferred from all of its pages by aligning one after another:

* elements that follow each other with the same name, id and class, alone or in turns of up to `PERIOD`, become a
  repeated group; a run of text blocks between containers is a repeated group whose members are optional;
* the children of an element are aligned with those that the wrapper has there, in order, for the greatest sum of
  likeness; what stays without a partner on either side becomes optional;
* text that differs between pages is a slot, and so are numbers in ids and classes, ids that differ from page to
  page, and classes that only some pages have.

The wrapper never branches (union-free). Tasks align the pages they hold and hand on one wrapper per template; wrappers
are aligned with wrappers in rounds of `FAN`, so a host with a third of all pages is no hot spot. A wrapper has the
size of a page's structure: beyond `WIDE` different children an element's children are one repeated group of optional
members, told by their tags; beyond `CELLS` comparisons they are such a group, told by their names.

The wrapper tells where the article is: the container that holds most text of slots. A page is then parsed by the
wrapper: its elements are aligned with it once more, and its text is what stands in the elements that meet that
container, without boilerplate, in page order; text that is the same on all pages stays, if it stands there. A page of
a template without a container, or that lacks it, is read whole, without boilerplate.

Classes and ids that name page furniture (`ad-slot`, `post-comments`, but neither `article-header` nor
`has-sidebar`) mark boilerplate, as tags like nav do; names of articles only decide between containers.

Blocks are cut at block-level tags; `br` is white space. Null or blank html gives an empty text. Broken
markup: unclosed elements end with their parent. Rows that share an id are read separately. Further columns,
whatever their names, pass unread.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayscope.llm.common import Scratch, small
from assayscope.llm.urlfilter import host_of

#: Pages whose results a task holds at once.
ROWS = 500
#: Longest turn of siblings that is looked for as a repeated group.
PERIOD = 4
#: Comparisons of an ordered alignment of two lists of children, and different children of one element; beyond
#: these they are a repeated group of optional members.
CELLS, WIDE = 40_000, 200
#: Wrappers that a task aligns in a round, and wrappers that it holds before it hands them on.
FAN, HELD = 256, 2_000
#: Templates up to which wrappers are broadcast: a few KB each.
TEMPLATES = 5_000

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead title tr ul".split()
)
#: Elements that can hold an article; in a path they stand with id and class, other blocks by name only.
CONTAINERS = frozenset("html body main article section div td".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video select button xmp noframes".split())
BOILERPLATE = frozenset("head nav header footer aside form menu dialog".split()) | RAW
#: An open element of the first kind is closed by a start tag of the second.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
# Words that name page furniture, words that name an article, and words that only qualify.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments commentlist disqus replies"
    " respond sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup"
    " modal newsletter subscribe signup share sharing social widget login search toolbar pagination pager skip hidden".split()
)
ARTICLE = frozenset("article post entry content story main body text".split())
QUALIFY = frozenset("has no with without not".split())
#: Marks that may as well say what a paragraph is about; they tell furniture on larger elements only.
AMBIGUOUS = frozenset("share sharing notice notices respond replies search social promotion menu skip banner".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTR = re.compile(r"(?:^|\s)(id|class|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


def tokens(page: str):
    """("<", name, attributes), (">", name, ""), ("t", "", text) in order; the content of raw elements
    is one text within its element."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "t", "", page[at:]
            return
        if m.start() > at:
            yield "t", "", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield ">", name, ""
            continue
        yield "<", name, m[3] or ""
        if name in ("script", "style", "textarea", "title", "xmp", "iframe", "noframes") and not (m[3] or "").endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            yield "t", "", page[at : end.start() if end else n]
            yield ">", name, ""
            at = end.end() if end else n


_NUMBER = re.compile(r"\d+")


def signature(name: str, attrs: str) -> str:
    """An element as it looks in a wrapper: its name, id and class. Numbers in them are slots, as in `post-17`:
    they differ from page to page of one template."""
    if not attrs.strip():
        return name
    got = {m[1].lower(): _NUMBER.sub("0", _SPACE.sub(" ", m[2] or m[3] or m[4] or "").strip()) for m in _ATTR.finditer(attrs)}
    own = re.sub(r"[.#*]", "_", got.get("id", ""))
    return name + (f"#{own}" if own else "") + (f".{got['class']}" if got.get("class") else "")


def is_boilerplate(name: str, attrs: str) -> bool:
    if name in BOILERPLATE:
        return True
    if not attrs.strip() or name in ("body", "html", "article", "main"):
        return False
    marked = article = False
    for m in _ATTR.finditer(attrs):
        k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
        if k == "role" and v.lower() in ROLES:
            return True
        if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.I):
            return True
        if k in ("id", "class"):
            for words in map(_words, v.split()):
                found = [x for x in words if x in MARKS and not (name in PROSE and x in AMBIGUOUS)]
                if found and len(words) == 1:
                    return True
                marked |= bool(found) and not any(x in QUALIFY for x in words)
                article |= bool(words) and all(x in ARTICLE for x in words)
    # `main sidebar-left` is an article beside a sidebar
    return marked and not article


def _words(name: str) -> list[str]:
    """The words of one class or id, without their numbers: `ad-slot2`, `siteFooter`."""
    parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if x]
    return [w for x in parts if (w := x.lower().rstrip("0123456789"))]


class Node:
    """An open element: name, whether it is boilerplate, and the number of the block it stands in (-1: not told yet)."""

    __slots__ = ("name", "bad", "at")

    def __init__(self, name: str, bad: bool, at: int):
        self.name, self.bad, self.at = name, bad, at


def walk(page: str):
    """(kind, name, text or attributes, innermost open element)."""
    stack: list[Node] = [Node("", False, 0)]
    open_: Counter = Counter()
    for kind, name, rest in tokens(page):
        if kind == "<":
            while stack and name in CLOSED_BY.get(stack[-1].name, ()):
                open_[stack.pop().name] -= 1
            top = stack[-1]
            # a button in a sentence is a word of it
            bad = top.bad or not (name == "button" and open_["p"]) and is_boilerplate(name, rest)
            if name not in VOID and not rest.endswith("/"):
                stack.append(Node(name, bad, top.at))
                open_[name] += 1
                yield kind, name, rest, stack[-1]
            else:
                yield kind, name, rest, top
        elif kind == ">":
            if open_[name]:
                while True:
                    gone = stack.pop().name
                    open_[gone] -= 1
                    if gone == name:
                        break
            yield kind, name, "", stack[-1]
        else:
            yield kind, name, rest, stack[-1]


# -- reading --------------------------------------------------------------------------------------


def read(page: str) -> tuple[list[list], list[list]]:
    """The block elements of a page outside boilerplate, [[signature, parent, texts]], parents first, the page itself
    being the first, and all its text outside boilerplate, [[block, element, text]] in page order."""
    nodes: list[list] = [["", -1, []]]
    parts: list[list] = []
    block = 0
    for kind, name, rest, at in walk(page):
        if kind != "t" and name in BLOCK:
            block += 1
            if kind == "<" and not at.bad and name not in VOID and not rest.endswith("/"):
                nodes.append([signature(name, rest) if name in CONTAINERS else name, at.at, []])
                at.at = len(nodes) - 1
        elif (kind == "t" or name == "br") and not at.bad:
            if kind != "t":
                rest = "\n"
            elif not rest.isspace():
                nodes[at.at][2].append(rest)
            if parts and parts[-1][0] == block and parts[-1][1] == at.at:
                parts[-1][2].append(rest)
            else:
                parts.append([block, at.at, [rest]])
    return nodes, [[b, i, "".join(t)] for b, i, t in parts]


def template(nodes: list[list]) -> int:
    """The chain of elements down which most of a page's text lies, as a hash: tags and first classes, no ids."""
    text = [sum(map(len, x[2])) for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        text[nodes[i][1]] += text[i]
    heir: dict[int, int] = {}
    for i in range(len(nodes) - 1, 0, -1):
        if 2 * text[i] > text[nodes[i][1]] and _tag(nodes[i][0]) in CONTAINERS:
            heir[nodes[i][1]] = i
    chain, i = [], 0
    while i in heir:
        i = heir[i]
        tag, _, classes = _names(nodes[i][0])
        chain.append(tag if tag in ("html", "body") or not classes else f"{tag}.{classes[0]}")
        if tag in ("article", "main"):
            break
    return _hash("/".join(chain))


def _tag(sig: str) -> str:
    return re.match(r"[^#.]*", sig)[0]


@lru_cache(100_000)
def _names(sig: str) -> tuple[str, str, tuple[str, ...]]:
    """Tag, id and classes of a signature."""
    tag, own, classes = re.fullmatch(r"([^#.]*)(?:#([^.]*))?(?:\.(.*))?", sig, re.S).groups()
    return tag, own or "", tuple((classes or "").split())


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


# -- inference ------------------------------------------------------------------------------------

RUN = "~"


class Part:
    """A part of a wrapper, of one page or of many: an element, or (RUN) a run of text blocks. It has the pages that hold
    it, its most times on a page, whether it may lack where its parent stands, its repeated group among its siblings (0: none
    but itself), the characters right in it, the least and greatest hash a page has of them, and its children: in order (0),
    or as optional members told by signature (1) or tag (2). On a page, `members` are the numbers of its elements."""

    __slots__ = ("sig", "pages", "most", "optional", "group", "chars", "lo", "hi", "loose", "kids", "members")

    def __init__(self, sig, pages=1, most=1, optional=False, group=0, chars=0, lo=0, hi=0, loose=0, members=()):
        self.sig, self.pages, self.most, self.optional, self.group = sig, pages, most, optional, group
        self.chars, self.lo, self.hi, self.loose, self.kids, self.members = chars, lo, hi, loose, [], list(members)


@lru_cache(200_000)
def likeness(a: str, b: str) -> int:
    """How well two elements go together, from 0 (not at all) to 4 (the same)."""
    if a == b:
        return 4
    (tag, own, classes), (other, own2, classes2) = _names(a), _names(b)
    if tag != other:
        return 0
    if tag in ("html", "body", "main"):
        return 3
    if classes or classes2:
        if set(classes) & set(classes2):
            return 3 if classes == classes2 else 2
        return 1 if tag == "article" and not (classes and classes2) else 0
    if tag == "article":
        return 3
    return int("*" in (own, own2) or bool(own and own2) and _words(own)[:1] == _words(own2)[:1])


@lru_cache(200_000)
def common(a: str, b: str) -> str:
    """The signature of both elements: `*` is an id that differs."""
    if a == b:
        return a
    (tag, own, classes), (_, own2, classes2) = _names(a), _names(b)
    shared = [x for x in classes if x in classes2]
    own = own if own == own2 else "*"
    return tag + (f"#{own}" if own or not shared else "") + (f".{' '.join(shared)}" if shared else "")


def pairs(a: list[Part], b: list[Part]) -> list[tuple[Part | None, Part | None]]:
    """Two lists aligned in order for the greatest sum of likeness; None stands for no partner. Ties: the partner
    that comes first."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo].sig == b[lo].sig:
        lo += 1
    while n > lo and m > lo and a[n - 1].sig == b[m - 1].sig:
        n, m = n - 1, m - 1
    x, y = a[lo:n], b[lo:m]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        below, row = best[i + 1], best[i]
        for j in range(len(y) - 1, -1, -1):
            fit = likeness(x[i].sig, y[j].sig)
            row[j] = max(below[j], row[j + 1], below[j + 1] + fit if fit else 0)
    out: list[tuple] = list(zip(a[:lo], b[:lo]))
    i = j = 0
    while i < len(x) or j < len(y):
        fit = likeness(x[i].sig, y[j].sig) if i < len(x) and j < len(y) else 0
        if fit and best[i][j] == best[i + 1][j + 1] + fit:
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i][j] == best[i + 1][j]:
            out.append((x[i], None))
            i += 1
        else:
            out.append((None, y[j]))
            j += 1
    return out + list(zip(a[n:], b[m:]))


def _key(sig: str, loose: int) -> str:
    return sig if loose < 2 else _tag(sig)


def _members(part: Part, loose: int) -> None:
    """The children of a part as optional members, each once."""
    if part.loose >= loose:
        return
    part.loose, kids, part.kids = loose, part.kids, []
    at: dict[str, Part] = {}
    for x in kids:
        key = _key(x.sig, loose)
        if key in at:
            align(at[key], x, True)
        else:
            at[key] = x
            part.kids.append(x)
        at[key].group = 0


def partners(a: Part, b: Part) -> list[tuple[Part | None, Part | None]]:
    """The children of two parts, aligned."""
    if not a.loose and not b.loose and len(a.kids) * len(b.kids) > CELLS and [x.sig for x in a.kids] != [x.sig for x in b.kids]:
        _members(a, 1)
    loose = max(a.loose, b.loose)
    if not loose:
        return pairs(a.kids, b.kids)
    _members(a, loose)
    _members(b, loose)
    at = {_key(x.sig, loose): x for x in b.kids}
    out = [(x, at.pop(_key(x.sig, loose), None)) for x in a.kids]
    return out + [(None, y) for y in b.kids if _key(y.sig, loose) in at]


def align(a: Part, b: Part, same: bool = False) -> Part:
    """Generalise a, so that it fits what b fits, too; `same` if both stand on the same page. b is used up."""
    work = [(a, b)]
    while work:
        a_, b_ = work.pop()
        a_.sig = common(a_.sig, b_.sig)
        a_.optional |= b_.optional
        a_.chars += b_.chars
        if same:
            a_.pages, a_.most = max(a_.pages, b_.pages), a_.most + b_.most
            a_.lo = a_.hi = (31 * a_.lo + b_.lo) % (1 << 61)
        else:
            a_.pages, a_.most = a_.pages + b_.pages, max(a_.most, b_.most)
            a_.lo, a_.hi = min(a_.lo, b_.lo), max(a_.hi, b_.hi)
        a_.members += b_.members
        beyond = max((x.group for x in a_.kids), default=0)
        kids = []
        for x, y in partners(a_, b_):
            if y is not None and y.group:
                y.group += beyond
            if x is None or y is None:
                kids.append(x or y)
                kids[-1].optional = True
            else:
                x.group = x.group or y.group
                kids.append(x)
                work.append((x, y))
        a_.kids = kids
        if len(kids) > WIDE:
            # pairs of this part first: its children are united by tag when all are aligned
            mine = [w for w in work if any(w[0] is x for x in kids)]
            work = [w for w in work if w not in mine]
            for x, y in mine:
                align(x, y, same)
            _members(a_, 2)
    return a


def _runs(kids: list[Part]) -> list[Part]:
    """Text blocks that follow each other as members of a run."""
    out: list[Part] = []
    for x in kids:
        if _tag(x.sig) in CONTAINERS:
            out.append(x)
            continue
        if not out or out[-1].sig != RUN:
            out.append(Part(RUN, loose=1))
        for have in out[-1].kids:
            if have.sig == x.sig:
                align(have, x, True)
                break
        else:
            out[-1].kids.append(x)
    return out


def _fold(kids: list[Part]) -> list[Part]:
    """Siblings that repeat, alone or in turns, once."""
    out: list[Part] = []
    for x in kids:
        out.append(x)
        again = True
        while again:
            again = False
            for p in range(1, PERIOD + 1):
                if len(out) >= 2 * p and all(out[i - 2 * p].sig == out[i - p].sig for i in range(p)):
                    group = out[-2 * p].group or 1 + max(y.group for y in out)
                    for i in range(p):
                        align(out[i - 2 * p], out[i - p], True)
                        if p > 1:
                            out[i - 2 * p].group = group
                    del out[-p:]
                    again = True
                    break
    return out


def build(sigs, parents, chars=None, hashes=None) -> Part:
    """A page as a wrapper of its own."""
    parts = [Part(s, members=[i]) for i, s in enumerate(sigs)]
    if chars is not None:
        for x, n, h in zip(parts, chars, hashes):
            x.chars, x.lo, x.hi = n, h, h
    for x, parent in zip(parts[1:], parents[1:]):
        parts[parent].kids.append(x)
    for x in reversed(parts):  # children before parents
        if x.kids:
            x.kids = _fold(_runs(x.kids))
    return parts[0]


def stream(page: str) -> tuple[list, list, list, list]:
    """Signatures, parents, characters and hashes of the elements of a page."""
    return columns(read(page)[0])


def columns(nodes: list[list]) -> tuple[list, list, list, list]:
    return [x[0] for x in nodes], [x[1] for x in nodes], [sum(map(len, x[2])) for x in nodes], [_hash(" ".join(" ".join(x[2]).split())) % (1 << 61) if x[2] else 0 for x in nodes]


def infer(pages) -> Part:
    """The wrapper of pages given as texts."""
    first, *rest = [build(*stream(p)) for p in pages]
    for x in rest:
        align(first, x)
    return first


def preorder(root: Part) -> list[tuple[Part, int]]:
    """Parts with the number of their parent."""
    out, work = [], [(root, -1)]
    while work:
        x, parent = work.pop()
        out.append((x, parent))
        work += [(k, len(out) - 1) for k in reversed(x.kids)]
    return out


def dump(root: Part) -> str:
    return json.dumps([[parent, x.sig, x.pages, x.most, int(x.optional), x.group, x.chars, x.lo, x.hi, x.loose] for x, parent in preorder(root)])


def load(text: str) -> list[Part]:
    """The parts of a wrapper in the order of `preorder`; the first is the whole."""
    out: list[Part] = []
    for parent, sig, pages, most, optional, *rest in json.loads(text):
        out.append(Part(sig, pages, most, bool(optional), *rest))
        if parent >= 0:
            out[parent].kids.append(out[-1])
    return out


def expression(root: Part) -> str:
    """The wrapper as a regular expression over elements: `+` repeated, `?` optional, `*` both, ( ) groups, [ ] children,
    $ a slot of text."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        slot = "$" if x.chars and (x.lo != x.hi or x.pages < root.pages or root.pages == 1) else ""
        inner: list = []
        kids = sorted(x.kids, key=lambda k: k.sig) if x.loose else x.kids
        for i, k in enumerate(kids):
            before, after = (kids[j].group if 0 <= j < len(kids) else 0 for j in (i - 1, i + 1))
            repeated = k.most > max(x.most, 1) and not k.group
            inner += ["(" if k.group and before != k.group else "", k, ("*" if k.optional else "+") if repeated else "?" if k.optional else ""]
            inner += [")+" if k.group and after != k.group else "", " " if i + 1 < len(kids) else ""]
        opens, closes = ("(", ")+") if x.sig == RUN else (f"{x.sig}[", "]")
        out.append(opens + slot + (" " if slot and inner else ""))
        work += [closes, *reversed(inner)]
    return "".join(out)


def article(parts: list[tuple[Part, int]]) -> list[int]:
    """Numbers of the article's container in a wrapper's preorder: the deepest one that has nearly all of the slots'
    text of the best candidates. Several if containers alike share the article; none if no container stands out. Ties: the
    deepest, then the last."""
    total_pages = parts[0][0].pages
    # one page alone is all slots; so are equal pages
    text = [x.chars if total_pages == 1 or x.lo != x.hi or x.pages < total_pages else 0 for x, _ in parts]
    if not any(text):
        text = [x.chars for x, _ in parts]
    depth = [0] * len(parts)
    for i, (_, parent) in enumerate(parts):
        depth[i] = depth[parent] + 1 if i else 0
    for i in range(len(parts) - 1, 0, -1):
        text[parts[i][1]] += text[i]
    total = text[0]
    named, plain = [], []
    for i, (x, _) in enumerate(parts):
        n = text[i]
        if not i or 2 * x.pages < total_pages or not n:
            continue
        tag = _tag(x.sig)
        if tag in ("article", "main") or tag in ("div", "section", "td") and is_article(x.sig[len(tag) :]):
            named.append((tag == "article", n, depth[i], i))
        elif tag in ("div", "section", "td", "body") and n >= 0.7 * total:
            plain.append((depth[i], n, i))
    good = [x for x in named if x[1] >= 0.3 * total]
    if good:
        sig = parts[max(good)[3]][0].sig
        return sorted(x[3] for x in good if parts[x[3]][0].sig == sig)
    return [max(plain)[2]] if plain else []


def parse(wrapper: Part, page: Part, chosen: set[int]) -> list[int]:
    """Numbers of the page's elements that meet the chosen parts (by id()) of the wrapper."""
    found, work = [], [(wrapper, page)]
    while work:
        w, p = work.pop()
        if id(w) in chosen:
            found += p.members
        else:
            work += [(x, y) for x, y in partners(w, p) if x is not None and y is not None]
    return found


def is_article(marks: str) -> bool:
    """Whether the id and classes of a container name an article; this only decides between containers that
    hold enough of the slots' text."""
    return any(x in ARTICLE for x in re.split(r"[-_\s#.]+", marks.lower()))


# -- extraction ---------------------------------------------------------------------------------------


def render(parts, inside: set[int] | None) -> str:
    """The blocks of text that stand in the nodes of `inside` (all text if it is None); parts as of read."""
    out: list[str] = []
    now: list[str] = []
    at = None
    for block, i, text in [*parts, (None, 0, "")]:
        if block != at:
            done = _SPACE.sub(" ", entities.unescape("".join(now))).strip()
            if done:
                out.append(done)
            now, at = [], block
        if inside is None or i in inside:
            now.append(text)
    return "\n\n".join(out)


def within(parents, containers) -> set[int] | None:
    """The elements in the containers; None if there are no containers."""
    if not containers:
        return None
    found = set(containers)
    for i, parent in enumerate(parents):
        if parent in found:
            found.add(i)
    return found


def extract(page: str | None, container: str | None) -> str:
    """The text of a page in the elements that have the container's signature (in the whole page if there
    is none), without boilerplate."""
    if not page:
        return ""
    nodes, parts = read(page)
    return render(parts, within([x[1] for x in nodes], [i for i, x in enumerate(nodes) if x[0] == container]))


PAGES = (
    "page_id long, url string, site string, template long, sigs array<string>, parents array<int>, chars array<long>, hashes array<long>, "
    "blocks array<int>, places array<int>, texts array<string>"
)
WRAPPERS = "site string, template long, wrapper string"


def _read(batches):
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            out: list[list] = [[] for _ in range(8)]
            for page in batch.column("html"):
                nodes, parts = read(page.as_py() or "")
                for column, value in zip(out, [template(nodes), *columns(nodes), *([p[k] for p in parts] for k in range(3))]):
                    column.append(value)
            ints, longs, strings = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())
            kinds = (pa.int64(), strings, ints, longs, longs, ints, ints, strings)
            done = [batch.column(c) for c in ("page_id", "url", "site")] + [pa.array(v, k) for v, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(done, names=[c.split()[0] for c in PAGES.split(", ")])


def _batch(held: dict) -> pa.RecordBatch:
    sites, templates = (pa.array([k[i] for k in held], kind) for i, kind in ((0, pa.string()), (1, pa.int64())))
    return pa.RecordBatch.from_arrays([sites, templates, pa.array([dump(x) for x in held.values()], pa.string())], names=["site", "template", "wrapper"])


def _start(batches):
    """One wrapper per template from the pages of a task; more if the task meets more than `HELD` templates."""
    held: dict = {}
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("site", "template", "sigs", "parents", "chars", "hashes"))):
            site, kind, *page = (x.as_py() for x in row)
            page = build(*page)
            have = held.setdefault((site, kind), page)
            if have is not page:
                align(have, page)
        if len(held) > HELD:
            yield _batch(held)
            held = {}
    if held:
        yield _batch(held)


def _unite(group: pd.DataFrame) -> pd.DataFrame:
    first, *rest = [load(w)[0] for w in sorted(group["wrapper"])]
    for x in rest:
        align(first, x)
    return group.iloc[:1][["site", "template"]].assign(wrapper=dump(first))


def _choose(batches):
    for batch in batches:
        chosen = [article(preorder(load(w)[0])) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("site", "template", "wrapper")), pa.array(chosen, pa.list_(pa.int32()))], names=["site", "template", "wrapper", "chosen"])


@lru_cache(256)
def _wrapper(text: str) -> list[Part]:
    return load(text)


def _render(batches):
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            texts = []
            for row in zip(*(batch.column(c) for c in ("sigs", "parents", "wrapper", "chosen", "blocks", "places", "texts"))):
                sigs, parents, text, chosen, *parts = (x.as_py() for x in row)
                containers = []
                if chosen:
                    w = _wrapper(text)
                    containers = parse(w[0], build(sigs, parents), {id(w[i]) for i in chosen})
                texts.append(render(list(zip(*parts)), within(parents, containers)))
            done = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(done, names=["page_id", "url", "text", "n_chars"])


def wrappers(scratch: Scratch, pages: DataFrame, fan: int = FAN) -> DataFrame:
    """site, template, wrapper, chosen: the wrapper of each template of a host, and the numbers of its parts that hold
    the article. pages as of _read, written."""
    site = ["site", "template"]
    w = scratch.save(pages.select(*site, "sigs", "parents", "chars", "hashes").mapInArrow(_start, WRAPPERS).withColumn("row", F.monotonically_increasing_id()), "wrappers")
    while (most := w.groupBy(site).count().agg(F.max("count")).first()[0] or 0) > 1:
        # as many groups a template as its wrappers need; rows of the written table keep their number
        groups = -(-most // fan)
        last, turn = w, F.pmod(F.xxhash64("row"), F.lit(groups)) if groups > 1 else F.lit(0)
        done = w.groupBy(*site, turn.alias("turn")).applyInPandas(_unite, WRAPPERS)
        w = scratch.save(done.withColumn("row", F.monotonically_increasing_id()), "wrappers")
        scratch.drop(last)
    return w.select(*site, "wrapper").mapInArrow(_choose, WRAPPERS + ", chosen array<int>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html, ...)."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("site"))
    done = scratch.save(p.mapInArrow(_read, PAGES), "pages")
    # one row per template; if they are few, pages stay where they are, so a host with a third of them is no hot spot
    found = small(scratch, wrappers(scratch, done), "templates", TEMPLATES)
    joined = done.join(found, ["site", "template"], "left")
    kept = ("page_id", "url", "sigs", "parents", "wrapper", "chosen", "blocks", "places", "texts")
    return joined.select(*kept).mapInArrow(_render, "page_id long, url string, text string, n_chars long")
