"""Main-text extraction: boosted trees over the nodes of the DOM, decoded so that no node contradicts its ancestors.

A node is *content* (its text is kept), *left out* (with all below it) or *open* (a container of both).  The
trees give each node's log-probabilities from its own and its subtree's density, its tag and attribute words,
depth and siblings.  Decoding finds the labelling of the whole tree of the highest sum under the rules: below
left out all is left out, below content there is content or what is left out of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.boosting import BoostedTrees
from plumbline.llm.common import batched

OPEN, CONTENT, OUT = 0, 1, 2
#: Pages written for training; a documented bound of what the model is fitted on.
TRAINING_PAGES = 500

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"=\s*[\"']|>")
#: Elements whose contents are no text of the page: code, a window's title, the insides of form controls.
_SKIPPED = {"script", "style", "title", "textarea", "select", "button"}
#: Elements that stand for others where those can't be shown: nodes of their own, but part of the line inside a paragraph.
_STAND_INS = {"noscript", "object", "iframe", "template", "canvas", "audio", "video"}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = set(
    "html body div p article section main nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 form fieldset "
    "blockquote pre figure figcaption address details summary center dialog menu head".split()
)
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_KINDS = ["p", "li", "ul ol dl menu", "h1", "h2 h3 h4 h5 h6", "div", "article main", "section", "nav", "header", "footer", "aside", "form fieldset", "table tr td th", "blockquote pre", "figure figcaption"]
_KIND = {t: i for i, ts in enumerate(_KINDS) for t in ts.split()}


def markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """The markup of a page, in one pass: (begin, end, tag or "" for what is none, whether it closes, attributes); text is what
    lies between.  A skipped element is one piece, from its tag to its end.

    Quotes that follow ``=`` may hold ``>``.  A quote that is never closed counts for nothing; and once the quotes of a tag leave
    it without an end, they count for nothing in the rest of the page.  So no place is searched twice for the same thing.
    """
    size, at, quoting = len(source), 0, True
    never: set[str] = set()  # what does not occur from here on

    def find(what: str, start: int) -> int:
        if what in never:
            return -1
        found = source.find(what, start)
        if found < 0:
            never.add(what)
        return found

    def end_of(start: int) -> int:
        """Where the ``>`` of a tag stands, or -1."""
        nonlocal quoting
        here = start
        while quoting and (edge := _EDGE.search(source, here)):
            if edge[0] == ">":
                return edge.start()
            closed = find(edge[0][-1], edge.end())
            here = edge.end() if closed < 0 else closed + 1
        quoting = False
        return find(">", start)

    while (begin := find("<", at)) >= 0:
        if source.startswith("<!--", begin):
            end = find("-->", begin + 4)
            at = size if end < 0 else end + 3
            yield begin, at, "", False, ""
        elif source.startswith(("<!", "<?"), begin):
            end = find(">", begin)
            at = size if end < 0 else end + 1
            yield begin, at, "", False, ""
        elif name := _NAME.match(source, begin):
            end = end_of(name.end())
            if end < 0:
                at = name.end()
                if find("<", at) < 0:  # an unfinished tag at the end
                    yield begin, size, "", False, ""
                    at = size
                continue
            tag, closing, at = name[1].lower(), source[begin + 1] == "/", end + 1
            attributes = source[name.end() : end]
            if tag in _SKIPPED and not closing and not attributes.endswith("/"):
                last = None if f"</{tag}" in never else _CLOSERS[tag].search(source, at)
                if last is None:
                    never.add(f"</{tag}")
                at = size if last is None else last.end()
            yield begin, at, tag, closing, attributes
        else:
            at = begin + 1


_CLOSERS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _SKIPPED}


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth, minlength=1))[:-1])


class Dom:
    """Block nodes of several pages, as parallel lists; text runs in page order with the node that holds them."""

    def __init__(self):
        self.tag, self.words, self.parent, self.depth, self.page, self.label = [], [], [], [], [], []
        self.inputs: list[int] = []
        self.run_node, self.run_text, self.run_linked, self.run_page = [], [], [], []
        self.pages = 0

    def add(self, source: str) -> None:
        page, first = self.pages, len(self.tag)
        self.pages += 1
        self._node("#page", "", -1, 0, page)
        stack, names, opened = [first], ["#page"], Counter()
        parts: list[str] = []
        linked, in_link, last = 0, 0, 0

        def flush():
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.run_node.append(stack[-1]), self.run_text.append(text), self.run_linked.append(min(linked, len(text))), self.run_page.append(page)
                linked = 0

        def say(raw: str):
            nonlocal linked
            if raw and not opened["head"]:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if in_link:
                    linked += len(text)

        def leave(tag: str):
            """Close the innermost element of the name, and all inside it."""
            while True:
                own = names.pop()
                stack.pop()
                opened[own] -= 1
                if own == tag:
                    return

        for begin, end, tag, closing, attributes in markup(source):
            say(source[last:begin])
            last = end
            if not tag:
                continue
            if tag in _SKIPPED:
                parts.append(" ")
                if not closing and tag in ("button", "textarea", "select"):
                    self.inputs[stack[-1]] += 1
            elif tag in _VOID:
                parts.append(" ")
                if tag == "hr":
                    flush()
                elif tag == "input":
                    self.inputs[stack[-1]] += 1
            elif tag in _BLOCK or tag in _STAND_INS and (opened[tag] if closing else not opened["p"]):
                flush()
                if closing:
                    if opened[tag]:
                        leave(tag)
                        in_link = 0
                    continue
                if tag in ("html", "body"):
                    if tag == "body" and opened["head"]:
                        leave("head")
                    if opened[tag]:
                        continue
                if opened["p"] and tag != "head":
                    leave("p")
                same, around = _CLOSES.get(tag, ((), ()))
                if any(opened[t] for t in same):
                    for name in reversed(names):
                        if name in around:
                            break
                        if name in same:
                            leave(name)
                            break
                if opened["head"] and tag != "head":
                    leave("head")
                stack.append(self._node(tag, attributes, stack[-1], len(stack), page))
                names.append(tag)
                opened[tag] += 1
            elif tag in _STAND_INS:
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
        say(source[last:])
        flush()

    def _node(self, tag: str, attributes: str, parent: int, depth: int, page: int) -> int:
        words, label = [], None
        if attributes and "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                if name.lower() == "data-y":
                    label = value
                else:
                    words += [w.lower() for w in _WORD.findall(value)]
        self.tag.append(tag), self.words.append(words), self.parent.append(parent), self.depth.append(depth), self.page.append(page), self.label.append(label), self.inputs.append(0)
        return len(self.tag) - 1


class Extractor:
    """The fitted model.  Trained here on pages that ``sample_pages`` writes, with the label of every node known."""

    def __init__(self, pages: list[str], rounds: int = 30):
        dom = Dom()
        for p in pages:
            dom.add(p)
        y = self._labels(dom)
        known = y >= 0
        self.tags, self.words = Counter(), Counter()
        seen: dict[bool, tuple[Counter, Counter]] = {True: (Counter(), Counter()), False: (Counter(), Counter())}
        for i in np.flatnonzero(known & (y != OPEN)).tolist():
            tags, words = seen[bool(y[i] == CONTENT)]
            tags[dom.tag[i]] += 1
            words.update(set(dom.words[i]))
        odds = lambda a, b: {k: float(np.log((a[k] + 1) / (b[k] + 1))) for k in {*a, *b}}
        self.tags, self.words = odds(seen[True][0], seen[False][0]), odds(seen[True][1], seen[False][1])
        x = self.features(dom)
        self.model = BoostedTrees(3, rounds).fit(x[known], y[known])

    @staticmethod
    def _labels(dom: Dom) -> np.ndarray:
        """A node without a label of its own has its parent's."""
        kinds = {"o": OPEN, "c": CONTENT, "x": OUT}
        y = np.full(len(dom.tag), OPEN)
        for i, (label, parent) in enumerate(zip(dom.label, dom.parent, strict=True)):
            y[i] = kinds[label] if label else (y[parent] if parent >= 0 else OPEN)
        return y

    def features(self, dom: Dom) -> np.ndarray:
        n = len(dom.tag)
        parent, depth, page = np.array(dom.parent, np.int64), np.array(dom.depth, np.int64), np.array(dom.page, np.int64)
        run = np.array(dom.run_node, np.int64)
        size = np.fromiter(map(len, dom.run_text), np.float64, len(run))
        marks = np.fromiter((sum(map(t.count, ".,;:!?")) for t in dom.run_text), np.float64, len(run))
        blanks = np.fromiter((t.count(" ") + 1 for t in dom.run_text), np.float64, len(run))
        link = np.array(dom.run_linked, np.float64)
        kind = np.array([_KIND.get(t, len(_KINDS)) for t in dom.tag])
        own = np.zeros((n, 9))
        for c, v in enumerate((size, link, marks, blanks, np.ones(len(run)))):
            own[:, c] = np.bincount(run, v, n)
        own[:, 5], own[:, 6], own[:, 7], own[:, 8] = 1, kind == 1, kind == 0, dom.inputs
        whole = own.copy()
        levels = _levels(depth)
        for at in reversed(levels[1:]):
            np.add.at(whole, parent[at], whole[at])
        up = np.maximum(parent, 0)
        # Siblings stand together once sorted by parent; the order of nodes is page order.
        order = np.argsort(parent, kind="stable")
        same = parent[order][1:] == parent[order][:-1]
        before, after = np.full(n, -1), np.full(n, -1)
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
        family = np.bincount(up[parent >= 0], minlength=n)
        start = np.r_[0, np.cumsum(parent[order][1:] != parent[order][:-1])] if n else np.zeros(0, np.int64)
        rank = np.zeros(n)
        heads = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if n else np.zeros(0, np.int64)
        rank[order] = np.arange(n) - heads[start]
        root = np.searchsorted(page, np.arange(dom.pages))
        page_size = np.maximum(whole[root, 0][page], 1)
        ahead = np.cumsum(own[:, 0]) - own[:, 0]
        ahead = (ahead - ahead[root][page]) / page_size
        tag_odds = np.array([self.tags.get(t, 0.0) for t in dom.tag])
        word_odds = np.array([sum(self.words.get(w, 0.0) for w in ws) if ws else 0.0 for ws in dom.words])
        low, high = np.minimum(word_odds + np.minimum(tag_odds, 0), 0), np.maximum(word_odds, 0)
        for at in levels[1:]:
            low[at] = np.minimum(low[at], low[parent[at]])
            high[at] = np.maximum(high[at], high[parent[at]])
        t = np.maximum(whole[:, 0], 1)
        near = lambda i, v: np.where(i >= 0, v[np.maximum(i, 0)], -1.0)
        density = whole[:, 1] / t
        columns = [
            depth, np.log1p(whole[:, 0]), np.log1p(own[:, 0]), density, own[:, 1] / np.maximum(own[:, 0], 1), whole[:, 0] / np.maximum(whole[:, 4], 1), whole[:, 2] / np.maximum(whole[:, 3], 1),
            whole[:, 0] / page_size, t / np.maximum(whole[up, 0], 1), np.log1p(family), np.log1p(family[up]), rank / np.maximum(family[up], 1), near(before, np.log1p(whole[:, 0])), near(after, np.log1p(whole[:, 0])),
            near(before, density), near(after, density), whole[:, 6] / whole[:, 5], whole[:, 7] / whole[:, 5], np.log1p(whole[:, 7]), np.log1p(whole[:, 8]), ahead, tag_odds, word_odds, low, high, tag_odds[up], word_odds[up],
            np.log1p(whole[:, 5]),
        ]
        return np.column_stack([*columns, np.eye(len(_KINDS) + 1)[kind][:, :-1]]) if n else np.zeros((0, len(columns) + len(_KINDS)))

    def decode(self, dom: Dom, scores: np.ndarray) -> np.ndarray:
        """The state of each node in the best consistent labelling."""
        n = len(dom.tag)
        parent, depth = np.array(dom.parent, np.int64), np.array(dom.depth, np.int64)
        best = scores.copy()
        levels = _levels(depth)
        for at in reversed(levels[1:]):
            b = best[at]
            inside = np.maximum(b[:, CONTENT], b[:, OUT])
            np.add.at(best, parent[at], np.column_stack([np.maximum(b[:, OPEN], inside), inside, b[:, OUT]]))
        state = np.zeros(n, np.int64)
        for d, at in enumerate(levels):
            if not d:
                state[at] = best[at].argmax(1)
                continue
            b, above = best[at], state[parent[at]]
            b = np.where((above == CONTENT)[:, None] & (np.arange(3) == OPEN), -np.inf, b)
            state[at] = np.where(above == OUT, OUT, b.argmax(1))
        return state

    def texts(self, pages: list[str]) -> list[str]:
        dom = Dom()
        for p in pages:
            dom.add(p)
        state = self.decode(dom, self.model.log_probabilities(self.features(dom)))
        out: list[list[str]] = [[] for _ in pages]
        for node, text, page in zip(dom.run_node, dom.run_text, dom.run_page, strict=True):
            if state[node] == CONTENT:
                out[page].append(text)
        return ["\n".join(x) for x in out]


#: Attribute words of made-up training pages, by the part of the page that they are for.
_NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav links toc pagination pager tabs",
    "header": "header masthead banner logo top site branding toolbar topbar",
    "footer": "footer copyright bottom colophon legal foot credits imprint",
    "aside": "sidebar aside widget related recommended popular trending rail secondary tags categories archive teaser",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner dfp adsense commercial",
    "notice": "cookie consent notice alert gdpr popup modal overlay warning privacy banner",
    "form": "newsletter subscribe signup login search form contact register",
    "comments": "comments comment reply respond discussion disqus thread commentlist feedback",
    "share": "share social sharing buttons follow facebook twitter meta byline",
    "content": "content article post entry story text body main page single blog news document prose",
    "wrap": "wrapper container row col inner outer layout grid site page app root wrap column",
}


def sample_pages(count: int, seed: int = 3) -> list[str]:
    """Made-up pages in which every block names its label in ``data-y``."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: bool(rng.random() < p)
    syllables = "an be cor da el fi gra hou in jo ka lo mu nen or pa qui re sto ti un ver wo xa yl zu th é sch ción ung eau".split()

    def words(lo: int, hi: int, end: str = "") -> str:
        n = int(rng.integers(lo, hi + 1))
        out = ["".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]
        for i in range(0, n, max(2, int(rng.integers(5, 14)))):
            out[i] = out[i].capitalize()
            if i and end:
                out[i - 1] += pick(".", ".", ",", "!", "?")
        return html.escape(" ".join(out)) + end

    def attrs(part: str, label: str | None, named: float = 0.6) -> str:
        own = "" if label is None else f' data-y="{label}"'
        if chance(named):
            names = pick(*_NAMES[part].split())
            if chance(0.3):
                names += pick(" ", "-", "_") + pick(*_NAMES[pick(part, "wrap")].split())
            own += f' {pick("class", "class", "id")}="{names}"'
        elif chance(0.3):
            own += f' class="{pick("x", "css", "sc", "m")}-{int(rng.integers(1000))}"'
        return own

    def close(tag: str) -> str:
        return "" if chance(0.12) and tag in ("p", "li") else f"</{tag}>"

    def block(tag: str, text: str) -> str:
        return f"<{tag}>{text}{close(tag)}"

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(block("li", f'<a href="/{i}">{words(1, 3)}</a>') for i in range(int(rng.integers(lo, hi + 1)))) + "</ul>"

    def boilerplate(part: str) -> str:
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(part)
        tag = semantic if semantic and chance(0.6) else pick("div", "div", "section") if part != "comments" else pick("div", "section", "ol")
        # Without a telling tag there is a telling name, for otherwise no reader of the source could tell either.
        a = attrs(part, "x", 0.5 if tag == semantic else 1.0)
        if part in ("nav", "header"):
            inner = links(2, 9) if chance(0.8) else "".join(f'<a href="#">{words(1, 2)}</a> ' for _ in range(5))
            if part == "header":
                inner = pick(block("h1", words(1, 4)), block("p", words(2, 6)), f"<div>{words(1, 3)}</div>", "") + (inner if chance(0.5) else "")
        elif part == "footer":
            inner = pick("", links(2, 6)) + pick(f"&copy; {words(1, 3)} &middot; {words(2, 12, '.')}", block("p", f"&copy; 2020 {words(2, 9, '.')}"), f"<div>{words(2, 12, '.')}</div>")
        elif part == "aside":
            inner = pick("", block("h3", words(1, 3)), block("h2", words(1, 3))) + pick(links(2, 8), "".join(block("p", f'<a href="/">{words(3, 9)}</a>') for _ in range(3)), block("p", words(4, 30, ".")))
        elif part == "form":
            inner = pick("", block("p", words(2, 12, "."))) + f"<label>{words(1, 2)}</label><input name=q><button>{words(1, 2)}</button>"
            if tag != "form":
                inner = f"<form>{inner}</form>"
        elif part == "comments":
            item = "li" if tag == "ol" else "div"
            inner = pick("", block("h3", words(1, 2))) + "".join(f"<{item}{attrs('comments', None, 0.7)}><p>{words(3, 45, '.')}</p>{pick('', f'<p>{words(2, 20, chr(46))}</p>')}</{item}>" for _ in range(int(rng.integers(1, 7))))
        else:
            inner = pick(words(3, 25, "."), block("p", words(3, 25, ".")), f'<a href="/ad">{words(2, 9)}</a>', f"<div>{words(2, 9)}</div>")
        return f"<{tag}{a}>{inner}</{tag}>"

    def paragraph() -> str:
        text = words(*pick((1, 4), (4, 20), (20, 120), (30, 200)), ".")
        if chance(0.3):
            text = pick("<b>", "<i>", "<em>", "<span>") + text + pick("", "<br>", "</b>")
        if chance(0.15):
            text += f' <a href="/x">{words(1, 4)}</a> ' + words(1, 20, ".")
        return block("p", text)

    def article() -> str:
        tag = pick("article", "article", "article", "main", "div", "div", "section")
        a = attrs("content", "c", 0.35 if tag in ("article", "main") else 1.0)
        parts = [block(pick("h1", "h1", "h2"), words(2, 14))] if chance(0.75) else []
        if chance(0.1):
            parts.append(words(5, 60, "."))
        for _ in range(int(rng.integers(1, pick(2, 4, 9, 16)))):
            parts.append(paragraph())
            if chance(0.08):
                parts.append(pick(block("h2", words(1, 6)), "<ul>" + "".join(block("li", words(2, 20, ".")) for _ in range(4)) + "</ul>", block("blockquote", words(5, 40, ".")), "<table><tr><td>" + words(1, 3) + "<td>" + words(1, 3) + "</table>", f"<pre>{words(5, 30)}</pre>", f"<figure><figcaption>{words(3, 14, '.')}</figcaption></figure>"))
        if chance(0.25):
            parts.insert(int(rng.integers(1, len(parts) + 1)), boilerplate(pick("ad", "share", "aside", "form")))
        if chance(0.12):
            parts.append(boilerplate("comments"))
        inner = "".join(parts)
        if chance(0.15):
            inner = f"<div{attrs(pick('content', 'wrap'), None)}>{inner}</div>"
        return f"<{tag}{a}>{inner}</{tag}>"

    def page() -> str:
        top = [boilerplate(p) for p in ("notice", "header", "nav", "ad") if chance(0.55)]
        rest = [boilerplate(p) for p in ("share", "comments", "aside", "form", "ad") if chance(0.3)]
        body = article() if chance(0.97) else ""
        if chance(0.35):
            side = boilerplate("aside")
            body = f"<div{attrs('wrap', 'o')}>{pick(body + side, side + body)}{rest.pop() if rest and chance(0.3) else ''}</div>"
        for _ in range(int(rng.integers(0, 3))):
            body = f"<{pick('div', 'main') if chance(0.3) else 'div'}{attrs('wrap', 'o')}>{body}</div>".replace("<main", "<div", 1) if chance(0.5) else body
        parts = [*top, body, *rest, *([boilerplate("footer")] if chance(0.8) else [])]
        end = "</body></html>" if chance(0.85) else ""
        return f'<!DOCTYPE html><html data-y="o"><head><title>{words(2, 9)}</title><style>p{{}}</style></head><body data-y="o"{attrs("wrap", None, 0.2)}>{pick("", chr(10)).join(parts)}{end}'

    return [page() for _ in range(count)]


@lru_cache(maxsize=2)
def extractor(pages: int = TRAINING_PAGES, seed: int = 3) -> Extractor:
    return Extractor(sample_pages(pages, seed))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Extractor | None = None) -> DataFrame:
    """``(page_id, url, text)`` of every row: the main text's blocks in page order, joined by a line break.

    A null or empty page, and one without content, has empty text.  Null ids and repeated rows are kept; extra
    columns are not read; an empty table gives an empty one.  Pages are read whole, whatever their length.
    """
    told = pages.sparkSession.sparkContext.broadcast(model or extractor())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = [x or "" for x in b.column("html").to_pylist()]
            for i, j in batched(map(len, sources), 2_000_000):
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(i, j - i), b.column("url").slice(i, j - i), pa.array(told.value.texts(sources[i:j]), pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
