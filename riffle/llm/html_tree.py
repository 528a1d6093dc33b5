"""HTML main text: a tree-structured graphical model over the DOM.

Each element is content or not. A potential for its own look (kind of tag, words in its
class, id and role, link density, text length) and one between parent and child (by the
child's kind) are counted from labelled pages. Sum-product messages pass up the tree and
down again, which gives each element's exact marginal; text in elements whose marginal
is above one half is kept, block by block.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags by kind; any other tag is inline. Fixed by the HTML standard.
_KINDS = {
    "article": "article main",
    "box": "html body div section center table tbody thead tfoot tr details figure hgroup",
    "block": "p h1 h2 h3 h4 h5 h6 blockquote pre td th li dl dt dd figcaption caption summary address ul ol",
    "menu": "nav menu",
    "header": "header",
    "footer": "footer",
    "aside": "aside dialog",
    "form": "form fieldset select textarea button input label option",
}
KIND = {tag: kind for kind, tags in _KINDS.items() for tag in tags.split()}
_WHOLE = frozenset(("article", "main", "body", "html"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown.
_HIDDEN = frozenset("head script style noscript template svg iframe object canvas audio video math".split())
#: Of another language than HTML: only here does a slash end an element at its start tag.
_FOREIGN = frozenset(("svg", "math"))
_RAW = frozenset("script style textarea title noscript iframe template".split())
#: What may stand in a head; anything else ends it, as text does.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
_RAW_IN_HEAD = frozenset("title style script noscript template noframes".split())
#: A start tag of these closes an open p.
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table html body article section div".split())
#: Words of class, id and role that speak against or for content.
_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "contentinfo copyright dialog discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notification overlay pagination paywall popup promo promoted promotion related recommended replies reply responses search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
_FOR = frozenset("article articlebody body content entry main post story text".split())
#: What stands in a tag after its name: a quote quotes only right after an equals sign.
_REST = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
#: A comment: empty, or up to --> or --!>.
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
_TAG = re.compile(rf"{_COMMENT}|<(/?)([a-zA-Z][^\s/>]*)({_REST})(?:>|\Z)|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|</>", re.S)
#: A slash at the end of a tag that isn't the last character of a value without quotes.
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>][^\s>]*/\Z")
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"data-label=\"([01])\"")


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z){_REST}(?:>|\Z)", re.I | re.S)


def _after_raw(source: str, tag: str, at: int) -> tuple[int, int]:
    """Where the raw text from `at` ends, and its end tag; without one both at the page's end."""
    stop = _raw_end(tag).search(source, at)
    return stop.span() if stop else (len(source), len(source))


def _self_closed(attributes: str) -> bool:
    return attributes.endswith("/") and not _UNQUOTED_SLASH.search(attributes)


def _head_end(source: str, at: int) -> int:
    """Where the head whose start tag ends at `at` ends."""
    while True:
        m = _TAG.search(source, at)
        if source[at : m.start() if m else len(source)].strip() or m is None:
            return at
        if m[2] is None:
            at = m.end()
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("head", "body", "html", "br"):
                return m.end() if tag == "head" else m.start()
        elif tag not in _IN_HEAD:
            return m.start()
        at = m.end()
        if not m[1] and tag in _RAW_IN_HEAD:
            at = _after_raw(source, tag, at)[1]


def _ends(source: str, tag: str) -> dict[int, int]:
    """Where the element of each start tag that has an end tag ends, nested ones counted."""
    out, open_ = {}, []
    for m in re.compile(rf"{_COMMENT}|<(/?){tag}(?=[\s/>])({_REST})>", re.I | re.S).finditer(source):
        if m[1]:
            if open_:
                out[open_.pop()] = m.end()
        elif m[1] is not None and not (tag in _FOREIGN and _self_closed(m[2])):
            open_.append(m.start())
    return out


class Dom:
    """Elements in document order, parents before children, and the text between block borders."""

    __slots__ = ("chars", "events", "hint", "kind", "label", "linked", "parent")

    def __init__(self, source: str):
        self.parent, self.kind, self.hint, self.label = [-1], ["box"], [0], [""]
        self.chars, self.linked = [0], [0]
        #: Text pieces (element, text); None where a block ends.
        self.events: list[tuple[int, str] | None] = []
        self._parse(source)
        for i in range(len(self.parent) - 1, 0, -1):
            self.chars[self.parent[i]] += self.chars[i]
            self.linked[self.parent[i]] += self.linked[i]

    def _text(self, at: int, text: str, in_link: bool) -> None:
        if text:
            self.events.append((at, text))
            n = len(text) if not text.isspace() else 0
            self.chars[at] += n
            self.linked[at] += n if in_link else 0

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        links, at = 0, 0
        # Where on the stack the open elements of each tag are, and those that aren't inline: nothing is searched.
        places: dict[str, list[int]] = defaultdict(list)
        kinds: list[int] = []
        ends: dict[str, dict[int, int]] = {}

        def close(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                tag, _ = stack.pop()
                places[tag].pop()
                links -= tag == "a"
                if tag in KIND:
                    kinds.pop()
                    self.events.append(None)

        def innermost(tags: Iterable[str]) -> int:
            return max((places[t][-1] for t in tags if places[t]), default=0)

        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._text(stack[-1][1], source[at:], links > 0)
                break
            self._text(stack[-1][1], source[at : m.start()], links > 0)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if places[tag]:
                    close(places[tag][-1])
                continue
            if tag in _HIDDEN and not (tag in _FOREIGN and _self_closed(m[3])):
                # Its end tag ends it; without one raw text runs to the page's end, and of others only the tag is hidden.
                if tag == "head":
                    at = _head_end(source, at)
                    continue
                if tag in _RAW:
                    at = _after_raw(source, tag, at)[1]
                else:
                    if tag not in ends:
                        ends[tag] = _ends(source, tag)
                    at = ends[tag].get(m.start(), at)
                continue
            if tag in _CLOSES_P and kinds and stack[kinds[-1]][0] == "p":
                close(kinds[-1])
            if tag in _CLOSES and (k := innermost(_CLOSES[tag])) > innermost(_SCOPE):
                close(k)
            if tag in KIND:
                self.events.append(None)
            elif tag in ("br", "wbr"):
                self._text(stack[-1][1], " " if tag == "br" else "", links > 0)
            if tag in _VOID or tag in _HIDDEN:
                continue
            self.parent.append(stack[-1][1])
            self.kind.append(KIND.get(tag, "inline"))
            # What an article or the whole page is called tells of its parts (has-comments), not against it.
            self.hint.append(max(_hint(m[3]), 0) if tag in _WHOLE else _hint(m[3]))
            self.label.append(x[1] if (x := _LABEL.search(m[3])) else "")
            self.chars.append(0)
            self.linked.append(0)
            places[tag].append(len(stack))
            if tag in KIND:
                kinds.append(len(stack))
            stack.append((tag, len(self.parent) - 1))
            links += tag == "a"
            if tag in _RAW:
                stop, at_end = _after_raw(source, tag, at)
                self._text(stack[-1][1], source[at:stop], False)
                close(len(stack) - 1)
                at = at_end

    def look(self, i: int) -> tuple:
        """The features of element i: (name, value) pairs."""
        n = self.chars[i]
        share = self.linked[i] / n if n else 0.0
        return (
            ("kind", self.kind[i]),
            ("hint", self.hint[i]),
            ("links", 0 if share < 0.2 else 1 if share < 0.6 else 2),
            ("size", 0 if n < 25 else 1 if n < 120 else 2),
        )


def _hint(attributes: str) -> int:
    if not attributes or "=" not in attributes:
        return 0
    words = {w for m in _HINT.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    return -1 if words & _AGAINST else 1 if words & _FOR else 0


@dataclass
class Potentials:
    """look[name, value] = (weight if not content, if content); step[kind] = the same for (parent, child)."""

    look: dict[tuple, tuple[float, float]]
    step: dict[str, tuple[tuple[float, float], tuple[float, float]]]


def train(pages: list[str], smooth: float = 0.05) -> Potentials:
    """Count potentials from pages whose elements bear data-label (0 or 1) or inherit it."""
    look: dict[tuple, list[float]] = defaultdict(lambda: [smooth, smooth])
    step: dict[str, list[list[float]]] = defaultdict(lambda: [[smooth, smooth], [smooth, smooth]])
    total = [0.0, 0.0]
    for page in pages:
        dom = Dom(page)
        y = [0] * len(dom.parent)
        for i in range(1, len(y)):
            y[i] = int(dom.label[i]) if dom.label[i] else y[dom.parent[i]]
            step[dom.kind[i]][y[dom.parent[i]]][y[i]] += 1
            total[y[i]] += 1
            for f in dom.look(i):
                look[f][y[i]] += 1
    return Potentials(
        {f: (c[0] / (total[0] + 1), c[1] / (total[1] + 1)) for f, c in look.items()},
        {k: tuple((a / (a + b), b / (a + b)) for a, b in rows) for k, rows in step.items()},  # type: ignore[misc]
    )


def marginals(dom: Dom, p: Potentials) -> list[float]:
    """Probability of content of each element, by messages up and down the tree."""
    n = len(dom.parent)
    even, even_step = (0.5, 0.5), ((0.5, 0.5), (0.5, 0.5))
    # The page itself isn't content, unless nothing in it has a block of its own.
    own = [[1.0, 0.0] if any(k != "inline" for k in dom.kind[1:]) else [0.0, 1.0]]
    for i in range(1, n):
        a = b = 1.0
        for f in dom.look(i):
            w = p.look.get(f, even)
            a, b = a * w[0], b * w[1]
        own.append([a / (a + b), b / (a + b)])
    step = [p.step.get(k, even_step) for k in dom.kind]
    up: list[tuple[float, float]] = [even] * n  # message of i to its parent
    for i in range(n - 1, 0, -1):  # children come after their parents
        s, (a, b) = step[i], own[i]
        u, v = s[0][0] * a + s[0][1] * b, s[1][0] * a + s[1][1] * b
        up[i] = (u / (u + v), v / (u + v))
        q = own[dom.parent[i]]
        a, b = q[0] * up[i][0], q[1] * up[i][1]
        z = a + b
        q[0], q[1] = (a / z, b / z) if z > 0 else (0.5, 0.5)
    for i in range(1, n):  # own becomes the belief; the parent's is complete by now
        s, q, m = step[i], own[dom.parent[i]], up[i]
        a, b = q[0] / max(m[0], 1e-300), q[1] / max(m[1], 1e-300)
        x, y = a * s[0][0] + b * s[1][0], a * s[0][1] + b * s[1][1]
        x, y = x * own[i][0], y * own[i][1]
        z = x + y
        own[i] = [x / z, y / z] if z > 0 and math.isfinite(z) else own[i]
    return [q[1] for q in own]


def main_text(source: str, p: Potentials) -> str:
    """The page's content blocks, white space made single and trimmed, joined by newlines."""
    dom = Dom(source)
    keep = marginals(dom, p)
    blocks, now = [], []
    for e in [*dom.events, None]:
        if e is None:
            if now and (text := " ".join(html.unescape("".join(now)).split())):
                blocks.append(text)
            now = []
        elif keep[e[0]] > 0.5:
            now.append(e[1])
    return "\n".join(blocks)


_SYLLABLES = "ka lo mi ten sur vel dor pa qui ron est ba nu fel gra".split()


def labelled_pages(count: int = 240, seed: int = 7) -> list[str]:
    """Invented pages of common layouts whose elements bear data-label: the training set."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi)))

    def para() -> str:
        text = words(1, 6) if rng.random() < 0.15 else words(8, 90)
        if rng.random() < 0.3:
            text += f' <a href="#">{words(1, 3)}</a> {words(2, 8)}'
        if rng.random() < 0.3:
            text = f"<b>{text}</b>" if rng.random() < 0.5 else f"{text} <em>{words(1, 3)}</em> {words(1, 5)}"
        return f"<p>{text}</p>"

    def noise() -> str:
        name = rng.choice(sorted(_AGAINST))
        tag = rng.choice(("div", "div", "section", "aside", "form", "ul"))
        attr = f'class="{name}"' if rng.random() < 0.7 else f'id="{name}"' if tag != "aside" else ""
        inner = rng.choice((words(3, 14), f"<p>{words(3, 60)}</p>", f"<ul>{links(2, 6)}</ul>", f"<h3>{words(1, 4)}</h3><p>{words(5, 40)}</p>", f"<div><p>{words(4, 50)}</p><p>{words(2, 20)}</p></div>"))
        return f'<{tag} {attr} data-label="0">{inner}</{tag}>'

    def body() -> str:
        parts = [f"<h1>{words(1, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choices((para(), f"<h2>{words(1, 6)}</h2>", f"<ul><li>{words(2, 20)}</li><li>{words(2, 20)}</li></ul>", f"<blockquote><p>{words(5, 40)}</p></blockquote>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<pre>{words(3, 30)}</pre>", f"<div>{para()}</div>"), (12, 2, 1, 1, 1, 1, 1))[0])
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), noise())
        return "".join(parts)

    pages = []
    for _ in range(count):
        tag, attr = rng.choice((("article", ""), ("article", ""), ("main", ""), ("div", f'class="{rng.choice(sorted(_FOR))}"'), ("div", 'id="content"'), ("section", 'class="post entry"')))
        core = f'<{tag} {attr} data-label="1">{body()}</{tag}>'
        if rng.random() < 0.25:
            core = f'<main data-label="1">{core}</main>'
        elif rng.random() < 0.25:
            core = f"<div>{core}</div>"
        before = [f'<nav data-label="0"><ul>{links(3, 8)}</ul></nav>'] * rng.randint(0, 1) + [f'<header data-label="0"><a href="/">{words(1, 3)}</a><p>{words(1, 9)}</p></header>'] * rng.randint(0, 1)
        after = [f'<footer data-label="0">&copy; {words(2, 20)}</footer>', *(noise() for _ in range(rng.randint(0, 2)))]
        pages.append(f'<html><body data-label="0">{"".join(before)}{noise() if rng.random() < 0.6 else ""}{core}{"".join(after)}</body></html>')
    return pages


def extract(pages: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    A null or empty page, or one without content, has the text ''. Pages are read whole,
    each by itself; repeated rows repeat their result; other columns are ignored.
    """
    p = potentials or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(t.as_py() or "", p) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
