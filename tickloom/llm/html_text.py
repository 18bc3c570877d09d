"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM, decoded by Viterbi.

A leaf block is the text between two block-level boundaries. Its features are
its ancestors' tags with their roles, the class and id words of its ancestors,
its own tag, the shape of its text (length, links, sentences, place), and where
it stands to the container that holds most of the page's prose. The field is
trained on pages made and labelled by rule, with many layouts, named and
unnamed containers and noise within articles: no table holds labelled pages.

Reading is linear in the page, also on hostile markup: what a failed look ahead
costs is counted, and beyond a few readings of the page tags end at the next >.
"""

from __future__ import annotations

import functools
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, session, textkit

# Elements whose content is never text, elements that make no block of their own, elements without content.
HIDDEN = "script style noscript template iframe svg math object head title textarea select canvas audio video"
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN.split() if t not in ("head", "svg", "math", "object")}
_TAG = re.compile(
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S,
)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
#: Readings of a page that failed looks ahead for a tag's end may add up to.
READINGS = 4
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SKIP = {"svg", "math", "object"}
_HEAD = set("base basefont bgsound head html link meta noscript script style template title".split())  # what can stand in a head
_HEAD_ENDS = {"head", "body", "html", "br"}
_BARE_VALUE = re.compile(r"=\s*[^\s\"']+\Z")
_GAPS = {"br", "img", "input"}
_PARAGRAPH = {"p"}
#: Elements that hold text but do not contain an article.
_PARTS = set("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tfoot tr td th caption figure figcaption address center hr".split())

FEATURES = 1 << 14


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


class Node:
    """An open element: its parent, the features that no ancestor has, and the nearest container."""

    __slots__ = ("up", "tag", "new", "own", "box", "mass", "weight")

    def __init__(self, up, tag: str, new: tuple, own: tuple):
        self.up, self.tag, self.new, self.own = up, tag, new, own
        self.box = up.box if up is not None and tag in _PARTS else self
        self.mass = 0
        self.weight = None


class Block:
    """node: the innermost open element; text; characters inside links."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def _closed(attrs: str) -> bool:
    """Whether a tag closes itself; the slash of an unquoted value does not."""
    return attrs.endswith("/") and not _BARE_VALUE.search(attrs)


def _reader(page: str):
    """next tag at or behind a place: a match whose group 2 is None for comments and declarations, or None."""
    last, left = page.rfind(">"), READINGS * len(page) + 4096

    def following(at: int):
        nonlocal left
        while (i := page.find("<", at)) >= 0:
            nxt = page[i + 1 : i + 2]
            if not (nxt.isascii() and nxt.isalpha() or nxt in ("/", "!", "?")):
                at = i + 1
                continue
            m = _TAG.match(page, i) if left > 0 or nxt in ("!", "?") else None
            if m is None:
                left -= len(page) - i if nxt != "/" or page[i + 2 : i + 3].isalpha() else 0
                m = _PLAIN_TAG.match(page, i) if i < last else None
            if m is not None:
                return m
            at = i + 1
        return None

    return following


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; character references decoded, white space made one space.

    A head ends at its end tag or at the first text or element that cannot stand
    in it. An svg, math or object without an end tag hides nothing.
    """
    out: list[Block] = []
    root = Node(None, "", (_slot("any"),), ())
    stack: list[Node] = []
    opened: dict[str, int] = {}  # open elements by tag
    active: dict[int, int] = {root.new[0]: 1}  # features of the open elements
    parts: list[tuple[str, bool]] = []
    hidden: list[tuple[str, int]] = []  # open svg, math and object, with where their content begins
    bare: set[int] = set()  # begins of those never closed
    endless: set[str] = set()  # hidden elements without a further end tag
    head = False
    link = 0

    def flush() -> None:
        text = "".join([p for p, _ in parts])
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append(Block(stack[-1] if stack else root, text, sum([len(p) for p, inside in parts if inside])))
        parts.clear()

    def push(tag: str, names: str) -> None:
        up = stack[-1] if stack else root
        new = tuple([x for x in _element_slots(tag, names) if x not in active])
        for x in new:
            active[x] = 1
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(Node(up, tag, new, _leaf_slots(tag, up.tag)))

    def pop() -> str:
        node = stack.pop()
        for x in node.new:
            del active[x]
        opened[node.tag] -= 1
        return node.tag

    at = 0
    following = _reader(page)
    while (m := following(at)) is not None or hidden:
        if hidden and (m is None or (m[2] or "").lower() == "body" and not m[1]):
            # these stay open to the body or the end of the page: read on behind the outermost
            bare.update(begin for _, begin in hidden)
            at = hidden[0][1]
            hidden.clear()
            continue
        start = m.start()
        if start > at and not hidden and not (head and page[at:start].isspace()):
            head = False
            parts.append((page[at:start], link > 0))
        at = m.end()
        end, tag, attrs = m.group(1, 2, 3)
        if tag is None:
            continue
        tag = tag.lower()
        if head and (tag in _HEAD_ENDS if end else tag not in _HEAD):
            head = False
        if tag in INLINE and tag not in _RAW:
            if hidden:
                continue
            if tag == "a":
                link = 0 if end else 1
            elif tag in _GAPS:
                parts.append((" ", False))
            continue
        if tag in _RAW and not end:
            closed = _closed(attrs)
            if closed and (tag in endless or any(t != "object" for t, _ in hidden)):
                continue
            shut = None if tag in endless else _RAW[tag].search(page, at)
            if shut is None:
                endless.add(tag)
            if shut or not closed:
                at = shut.end() if shut else len(page)
            continue
        if parts:
            flush()
        link = 0
        if tag in _SKIP:
            if not end:
                if at not in bare and not _closed(attrs):
                    hidden.append((tag, at))
            elif any(t == tag for t, _ in hidden[-64:]):
                for i in range(len(hidden) - 1, -1, -1):
                    if hidden[i][0] == tag:
                        bare.update(begin for _, begin in hidden[i + 1 :])
                        del hidden[i:]
                        break
            continue
        if tag == "head":
            head = not end
            continue
        if hidden:
            continue
        if end:
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        shut = CLOSES.get(tag, _PARAGRAPH)
        while stack and stack[-1].tag in shut:
            pop()
        names = ""
        if "=" in attrs:
            names = " ".join(sorted({w.lower() for found in _NAMES.findall(attrs) for w in _WORD.findall(" ".join(found))}))
        push(tag, names)
    if at < len(page):
        parts.append((page[at:], link > 0))
    flush()
    return out


#: Stems of names that often stand for a role, with something before or behind them.
_STEMS = ("comment", "ad", "ads", "advert", "banner", "promo", "sponsor", "side", "menu", "nav", "foot", "head", "cookie", "consent", "notice", "share", "social", "related", "login", "form", "widget", "content", "article", "post", "entry", "main", "body", "story", "text")


@functools.lru_cache(20_000)
def _element_slots(tag: str, names: str) -> tuple[int, ...]:
    slots = {_slot("t:" + tag)}
    for w in names.split()[:64]:
        slots.add(_slot("c:" + w))
        slots.update(_slot("s:" + stem) for stem in _STEMS if len(stem) > 3 and stem in w and stem != w)
    return tuple(sorted(slots))


@functools.lru_cache(20_000)
def _leaf_slots(tag: str, up: str) -> tuple[int, ...]:
    return _slot("own:" + tag), _slot("up:" + up + ">" + tag if up else "up:" + tag)


_CUES = ("©", "copyright", "all rights", "cookie", "subscri", "sign in", "log in", "login", "advert", "sponsored", "newsletter", "share this", "accept")


def _cued(text: str) -> bool:
    low = text.lower()
    return any([c in low for c in _CUES])


def _text_slots(b: Block, i: int, n: int) -> tuple[int, ...]:
    size = len(b.text)
    words = b.text.count(" ") + 1
    return (
        _LENGTH[min(15, size.bit_length())],
        _LINKED[min(4, 4 * b.linked // max(1, size))],
        _ENDS[b.text[-1] in ".!?\"'»…"],
        _WORDS[min(7, words.bit_length())],
        _PLACE[4 * i // n],
        _CUE[size < 400 and _cued(b.text)],
    )


_LENGTH = [_slot(f"len{i}") for i in range(16)]
_LINKED = [_slot(f"link{i}") for i in range(5)]
_ENDS = [_slot(f"end{i}") for i in range(2)]
_WORDS = [_slot(f"words{i}") for i in range(8)]
_PLACE = [_slot(f"place{i}") for i in range(5)]
_CUE = [_slot(f"cue{i}") for i in range(2)]
_PAD = FEATURES


_SHARE = [_slot(f"share{i}") for i in range(5)]
_KIN = [_slot(f"kin{i}") for i in range(5)]
_SIDE = [_slot(f"side{i}") for i in range(3)]


def _prose_slots(page_blocks: list[Block]) -> list[tuple[int, ...]]:
    """Per block: its container's share of the page's prose, its kinship to the container with most of it, and its place before, among or behind that one's prose."""
    masses, total = [], 0
    for b in page_blocks:
        mass = max(0, len(b.text) - b.linked) if b.text.count(" ") >= 5 else 0
        b.node.box.mass += mass
        masses.append(mass)
        total += mass
    boxes = [b.node.box for b in page_blocks]
    best = max(boxes, key=lambda x: x.mass)
    above, x = set(), best.up
    while x is not None:
        above.add(id(x))
        x = x.up
    among = [i for i, (b, m) in enumerate(zip(boxes, masses, strict=True)) if b is best and m] or [0]
    first, last = among[0], among[-1]
    out = []
    for i, b in enumerate(boxes):
        share = 0 if not b.mass else 1 + min(3, int(b.mass * 10 // total) // 2)
        up = b.up
        kin = 0 if b is best else 1 if up is best else 2 if up is best.up else 3 if id(b) in above else 4
        out.append((_SHARE[share], _KIN[kin], _SIDE[0 if i < first else 1 if i <= last else 2]))
    return out


def _path(node: Node) -> tuple[int, ...]:
    slots, x = list(node.own), node
    while x is not None:
        slots.extend(x.new)
        x = x.up
    return tuple(slots)


def _rows(page_blocks: list[Block]) -> np.ndarray:
    n = len(page_blocks)
    rows = [(*_path(b.node), *_text_slots(b, i, n), *prose) for i, (b, prose) in enumerate(zip(page_blocks, _prose_slots(page_blocks), strict=True))] if n else []
    width = max(map(len, rows), default=0)
    return np.array([r + (_PAD,) * (width - len(r)) for r in rows], np.int64)


def made_pages(count: int = 420, seed: int = 23) -> list[tuple[str, list[bool]]]:
    """Pages with, for each leaf block, whether it belongs to the article."""
    r = np.random.default_rng(seed)
    bits = ["th", "on", "er", "an", "re", "he", "in", "ed", "nd", "ha", "tion", "ment", "que", "sch", "ung", "os", "la", "ver", "eau", "ll"]
    word = lambda: "".join(r.choice(bits, int(r.integers(1, 4))))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    any_of = lambda *x: x[int(r.integers(len(x)))]
    out = []
    for _ in range(count):
        page, labels = [], []

        def put(markup: str, main: bool) -> None:
            page.append(markup)  # noqa: B023
            labels.append(main)  # noqa: B023

        def links(n: int) -> None:
            page.append("<ul>")  # noqa: B023
            for _ in range(n):
                put(f'<li><a href="/{word()}">{word()}{" " + word() if r.random() < 0.3 else ""}</a></li>', False)
            page.append("</ul>")  # noqa: B023

        def comments() -> None:
            own = any_of("div", "section", "aside", "ol", "ul")
            page.append(f'<{own} {any_of("class", "id")}="{any_of("comments", "comments", "comment-list", "user-comments", "replies", "discussion", "disqus", "responses")}">')  # noqa: B023
            if r.random() < 0.4:
                put(f"<h3>{int(r.integers(1, 99))} {word()}</h3>", False)
            for _ in range(int(r.integers(1, 6))):
                if r.random() < 0.5:
                    put(f'<{any_of("div", "p", "li")} class="{any_of("comment", "reply", word())}">{prose(any_of(3, 10, 40, 90))}', False)
                else:
                    page.append("<div>")  # noqa: B023
                    put(f"<p>{prose(any_of(3, 10, 40, 90))}</p>", False)
                    page.append("</div>")  # noqa: B023
            page.append(f"</{own}>")  # noqa: B023

        def noise() -> None:
            kind = int(r.integers(12))
            own = any_of("div", "section", "aside")
            if kind == 0:
                page.append("<nav>")  # noqa: B023
                links(int(r.integers(2, 8)))
                page.append("</nav>")  # noqa: B023
            elif kind == 1:
                page.append(f'<div class="{any_of("menu", "navbar", "topnav", "breadcrumb", "nav-menu")}">')  # noqa: B023
                links(int(r.integers(2, 8)))
                page.append("</div>")  # noqa: B023
            elif kind in (2, 3):
                put(f'<div class="{any_of("ad", "ads", "advert", "ad banner", "banner", "promo", "sponsored", "advertisement")}">{prose(int(r.integers(2, 25)))}</div>', False)
            elif kind == 4:
                page.append(f'<{own} class="{any_of("sidebar", "side", "widget", "related", "recommended", "trending")}">')  # noqa: B023
                put(f"<h3>{word()} {word()}</h3>", False)
                put(f"<p>{prose(int(r.integers(4, 20)))}</p>", False)
                links(int(r.integers(1, 5)))
                page.append(f"</{own}>")  # noqa: B023
            elif kind == 5:
                page.append(f"<aside>")  # noqa: B023, F541
                put(f"<p>{prose(int(r.integers(4, 30)))}</p>", False)
                page.append("</aside>")  # noqa: B023
            elif kind == 6:
                put(f'<div class="{any_of("cookie", "cookie-notice", "consent", "notice", "gdpr", "popup", "alert")}">{prose(int(r.integers(4, 25)))}</div>', False)
            elif kind == 7:
                comments()
            elif kind == 8:
                page.append(f'<form action="/{word()}">')  # noqa: B023
                put(f"<label>{word()} {word()}</label><input name={word()}>", False)
                put(f"<button>{word()}</button>", False)
                page.append("</form>")  # noqa: B023
            elif kind == 9:
                put(f'<div class="{any_of("share", "social", "newsletter", "login", "subscribe", "tags", "byline-links")}">{prose(int(r.integers(1, 8)))}</div>', False)
            elif kind == 10:
                page.append("<header>")  # noqa: B023
                put(f"<div>{word()} {word()}</div>", False)
                page.append("</header>")  # noqa: B023
            else:
                put(f'<div {any_of("class", "id")}="{any_of("header", "masthead", "site-header", "topbar")}">{word()} {word()}</div>', False)

        def article() -> None:
            named = f'class="{word()}{any_of("", "-" + word(), str(int(r.integers(99))))}"'
            opened = any_of("<section>", "<div>", "<div>", f"<div {named}>", f"<section {named}>", f"<div><div {named}>", "<section><div>", "", "<article>", f"<article {named}>", "<article>", "<article>", "<article>", '<article class="post">', "<main>", '<div class="content">', '<div id="content">', '<div class="post-body">', '<div class="article">', '<section class="entry">', '<div class="story">', "<main><article>", '<div id="main">')
            page.append(opened)  # noqa: B023
            for _ in range(int(r.integers(0, 2)) + (r.random() < 0.7)):
                put(f"<{any_of('h1', 'h1', 'h2')}>{prose(int(r.integers(2, 10)))}" + "</h1>", True)
            for _ in range(int(r.integers(1, 12))):
                kind = r.random()
                n = any_of(1, 2, 6, 15, 40, 90)
                if kind < 0.7:
                    lead = any_of("", "", "", "<b>", f'<a href="/{word()}">{word()}</a> ', "<em>" + word() + "</em> ")
                    put(f"<p>{lead}{prose(n)}{any_of('', '', '<br>')}{any_of('</p>', '</p>', '')}", True)
                elif kind < 0.78:
                    put(f"<h2>{prose(3)}</h2>", True)
                elif kind < 0.84:
                    put(f"<blockquote>{prose(n)}</blockquote>", True)
                elif kind < 0.9:
                    page.append("<ul>")  # noqa: B023
                    for _ in range(int(r.integers(1, 4))):
                        put(f"<li>{prose(int(r.integers(2, 12)))}</li>", True)
                    page.append("</ul>")  # noqa: B023
                elif kind < 0.94:
                    put(f"<pre>{prose(n)}</pre>", True)
                elif kind < 0.97:
                    page.append("<table>")  # noqa: B023
                    put(f"<tr><td>{prose(3)}</td>", True)
                    page.append("</tr></table>")  # noqa: B023
                elif kind < 0.985:
                    page.append(f"<div {named}>")  # noqa: B023
                    put(f"<p>{prose(n)}</p>", True)
                    page.append("</div>")  # noqa: B023
                else:
                    noise()
            if r.random() < 0.25:
                noise()
            if r.random() < 0.45:
                comments()
            page.append("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened))))  # noqa: B023

        page.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        if r.random() < 0.3:
            page.append('<div class="page wrapper">')
        for _ in range(int(r.integers(0, 4))):
            noise()
        article()
        for _ in range(int(r.integers(0, 3))):
            noise()
        if r.random() < 0.8:
            put(any_of(f"<footer>&copy; {word()} &middot; {prose(6)}", f'<div class="footer">Copyright {word()} {prose(4)}', f'<div id="footer">{prose(5)}'), False)
        out.append(("".join(page), labels))
    return out


@functools.lru_cache(1)
def train() -> crf.Chain:
    """The field, fitted on made_pages(); labels 0 other, 1 article."""
    sequences = []
    for page, labels in made_pages():
        found = blocks(page)
        if len(found) == len(labels) and found:
            sequences.append((_rows(found), np.array(labels, np.int64)))
    return crf.train(sequences, FEATURES + 1, 2, epochs=5, pad=_PAD)


class Extractor:
    """Scores each element once, then labels pages with plain arithmetic."""

    def __init__(self, model: crf.Chain):
        w = model.weights
        self.w = (w[:, 1] - w[:, 0]).tolist()  # only the difference matters to the best path
        self.t = model.transitions.tolist()
        self.s = model.start.tolist()

    def _weight(self, node: Node) -> float:
        """The weight of a node's features and its ancestors', each kept once it is known."""
        chain = []
        while node is not None and node.weight is None:
            chain.append(node)
            node = node.up
        total = node.weight if node is not None else 0.0
        for x in reversed(chain):
            total += sum([self.w[i] for i in x.new])
            x.weight = total
        return total

    def text(self, page: str) -> str:
        found = blocks(page)
        n = len(found)
        if not n:
            return ""
        w, (t00, t01), (t10, t11) = self.w, *self.t
        back = []
        a = b = 0.0
        prose = _prose_slots(found)
        for i, block in enumerate(found):
            e = self._weight(block.node) + sum([w[j] for j in block.node.own]) + sum([w[j] for j in _text_slots(block, i, n)]) + sum([w[j] for j in prose[i]])
            if i:
                p, q = a + t00, b + t10
                x, y = a + t01, b + t11
                back.append((q > p, y > x))
                a, b = max(p, q), max(x, y) + e
            else:
                a, b = self.s[0], self.s[1] + e
        state = b > a
        keep = [False] * n
        for i in range(n - 1, -1, -1):
            keep[i] = state
            if i:
                state = back[i - 1][state]
        return "\n\n".join(block.text for block, k in zip(found, keep, strict=True) if k)


OUT = "page_id long, url string, text string, n_chars long"
_OUT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, model: crf.Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    A null or empty html, or one without an article, gives an empty text. Broken
    markup is read as far as it goes, very long pages whole and one at a time. Of
    equally good labellings the one with fewer article blocks is taken, and of
    containers with equally much prose the first counts. Repeated rows give equal
    rows; other columns, whatever their names, are ignored; an empty table gives
    an empty result.
    """
    session.ship(pages.sparkSession)
    model = model or train()

    def run(batches):
        extractor = Extractor(model)
        for batch in batches:
            texts = textkit.column(batch, "html")
            _, at = textkit.raw_text(texts)
            for lo, hi in textkit.slices(at):
                found = [extractor.text(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                cols = [textkit.column(batch, c).slice(lo, hi - lo) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], schema=_OUT_ARROW)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, OUT)
