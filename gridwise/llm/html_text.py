"""Main text of web pages by composite text density.

Every node gets characters per tag, lowered by the share of its characters and tags that stand in links. The node whose
children's densities have the largest sum is taken; the lowest density between it and the body is the threshold that
other subtrees on the way must reach to belong to the text. Where an article (or else main) element lies on the way, the
outermost is taken whole instead of the node; the threshold holds for what lies beside it.

Menus, forms, notices and the like go by tag, role or class name first. A class name alone doesn't decide: an element that
holds an article, or on a page without one more than half of the text, is a frame around it and stays, also if it is a form.

Null or empty html gives an empty text; so does a page without text outside of menus, forms and the like. Pages are
independent rows: nothing is shuffled, and the longest page bounds the memory of a task.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwise.llm.common import by_bytes

# Names of HTML elements and of the usual class names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input label math menu meter nav noembed noframes"
    " noscript object output progress script select style svg template textarea title video xmp".split()
)
# Names that say furniture wherever they stand in a class or id, and names that say so only where the whole class is made of
# such names and of words for parts of a layout.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors sidebar sidenav menu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr newsletter comment comments commentlist"
    " disqus replies respond pagination pager".split()
)
OFTEN = frozenset(
    "promo promotion banner notice notices popup modal overlay subscribe subscription signup share sharing social related"
    " recommended reply toolbar widget copyright login".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons card col column container content count feed footer form group header"
    " heading icon icons inner item items left link links list main message middle module more outer page panel post posts right"
    " row section side site slot story stories strip text title top unit wrap wrapper x".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# What the start of an element ends besides an open paragraph, unless one of `HOLDERS` lies between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
HOLDERS = frozenset("ul ol dl select table".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z0-9]+")
NOT_REALLY = re.compile(r"\b(?:no|has|with|without|not)[-_]\w+", re.I)


class Page:
    """Elements in document order. `last[i]` is the last element inside element i; `texts` has (element, text)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.last, self.off = ["#root"], [0], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self._parse(source)

    def _open(self, stack: list[int], name: str, off: int) -> int:
        i = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.last.append(i)
        self.off.append(off)
        return i

    def _close(self, stack: list[int], to: int) -> None:
        """End all open elements from position `to` of the stack."""
        for i in stack[to:]:
            self.last[i] = len(self.tag) - 1
        del stack[to:]

    def _parse(self, source: str) -> None:
        stack, at = [0], 0
        lowered = ""
        while True:
            found = TOKEN.search(source, at)
            text = source[at : found.start() if found else len(source)]
            if text:
                self.texts.append((stack[-1], entities.unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            name = found["name"] or found["name2"]
            if not name:
                continue
            name = name.lower()
            if found["end"] or found["end2"]:
                self._end(stack, name)
                continue
            if name in BLOCK:
                self._imply(stack, name)
            i = self._open(stack, name, furniture(name, found["rest"] or found["rest2"] or ""))
            if name in BLOCK or name == "br":
                self.texts.append((i, " "))
            if name in RAW:
                lowered = lowered or source.lower()
                if len(lowered) != len(source):  # a few letters change length
                    lowered = "".join(c.lower() if c < "\x80" else c for c in source)
                end = lowered.find(f"</{name}", at)
                at = len(source) if end < 0 else end
                if end >= 0:
                    close = source.find(">", end)
                    at = len(source) if close < 0 else close + 1
            elif name not in VOID:
                stack.append(i)
        self._close(stack, 0)

    def _imply(self, stack: list[int], name: str) -> None:
        """End the paragraph, item or cell that the start of a block ends without an end tag."""
        closes, lowest = ENDS.get(name, frozenset()), 0
        for k in range(len(stack) - 1, 0, -1):
            open_name = self.tag[stack[k]]
            if open_name == "p" or open_name in closes:
                lowest = k
            elif open_name in BLOCK and (not closes or open_name in HOLDERS):
                break
        if lowest:
            self._close(stack, lowest)

    def _end(self, stack: list[int], name: str) -> None:
        if name in ("html", "body"):
            return
        inline = name not in BLOCK
        for k in range(len(stack) - 1, 0, -1):
            open_name = self.tag[stack[k]]
            if open_name == name:
                self._close(stack, k)
                if not inline:
                    self.texts.append((stack[-1], " "))
                return
            if inline and open_name in BLOCK:
                return


NAMED, HIDDEN = 1, 2


def furniture(name: str, attributes: str) -> int:
    """Whether an element's class or id (NAMED) or its role or visibility (HIDDEN) says that it isn't part of the text."""
    if not attributes or name in ("html", "body", "main", "article"):
        return 0
    named = 0
    for mark, *values in MARKS.findall(attributes):
        mark, value = mark.lower(), "".join(values).lower()
        if mark in ("class", "id"):
            if any(map(names_furniture, NOT_REALLY.sub(" ", value).split())):
                named = NAMED
        elif mark == "role":
            if value.strip() in ROLES:
                return HIDDEN
        elif mark == "hidden" or mark == "aria-hidden" and value == "true":
            return HIDDEN
        elif mark == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN
    return named


def names_furniture(token: str) -> bool:
    """Whether a class says furniture: `comments`, `user-comments`, `share-bar`, but not `share-prices` or `login-guide`."""
    words = set(WORD.findall(token))
    return bool(words & FURNITURE) or bool(words & OFTEN) and words <= OFTEN | LAYOUT


def frames(page: Page) -> list[bool]:
    """Elements that stay although their names or tags say furniture: those that hold an article, or, on a page without one,
    more than half of the text, which isn't mostly links."""
    n = len(page.tag)
    holds = [name in ("article", "main") for name in page.tag]
    chars, linked = [0] * n, [0] * n
    for i, text in page.texts:
        chars[i] += len("".join(text.split()))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        holds[p] = holds[p] or holds[i]
        if page.tag[i] == "a":
            linked[i] = chars[i]
        if page.tag[i] not in DROPPED - {"form"} and page.off[i] != HIDDEN:
            chars[p] += chars[i]
            linked[p] += linked[i]
    if holds[0]:
        return holds
    return [2 * c > chars[0] and 2 * l <= c for c, l in zip(chars, linked)]


def densities(page: Page, off: list[bool], body: int) -> tuple[list[float], list[float]]:
    """Composite density of each element and the sum of it over each element's children and own text."""
    n = len(page.tag)
    own = [0] * n
    for i, text in page.texts:
        if not off[i]:
            own[i] += len("".join(text.split()))
    chars, tags, linked, link_tags = own[:], [1] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if off[i]:
            continue
        if page.tag[i] == "a":
            linked[i], link_tags[i] = chars[i], tags[i]
        p = page.parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i]
        linked[p] += linked[i]
        link_tags[p] += link_tags[i]
    share = linked[body] / chars[body] if chars[body] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if off[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], tags[i], linked[i], link_tags[i]
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        ratio = c / max(lc, 1) * (t / max(lt, 1))
        density[i] = c / t * max(math.log(ratio), 0.0) / max(math.log(base), 1.0) if ratio > 0 else 0.0
        total[i] += own[i]
        if i:
            total[page.parent[i]] += density[i]
    return density, total


def main_text(source: str | None) -> str:
    """Text of the part of a page that composite text density selects, blocks joined by one space."""
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    # Furniture by name that is a frame around the text stays; what lies in dropped elements goes. Of a form only the controls
    # go where it is a frame.
    frame = frames(page)
    holds = [name in ("article", "main") for name in page.tag]
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[page.parent[i]] = True
    inside = [False] * n
    off = [False] * n
    for i in range(1, n):
        p, tag = page.parent[i], page.tag[i]
        inside[i] = inside[p] or tag in ("article", "main")
        gone = tag in DROPPED and (tag != "form" or not frame[i])
        gone = gone or page.off[i] == HIDDEN and not holds[i] or page.off[i] == NAMED and not frame[i]
        off[i] = off[p] or gone or tag == "header" and not inside[i] and not holds[i]
    body = next((i for i in range(n) if page.tag[i] == "body" and not off[i]), 0)
    density, total = densities(page, off, body)
    best = max(range(n), key=lambda i: (total[i] if body <= i <= page.last[body] and not off[i] else -1.0, -i))
    if total[best] <= 0:
        return ""
    path = [best]
    while path[-1] != body and path[-1]:
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path)
    articles = [i for i in path if page.tag[i] == "article"] or [i for i in path if page.tag[i] == "main"]
    top = articles[-1] if articles else best
    ranges = [(top, page.last[top])]
    on_path = set(path)
    for i in range(body + 1, page.last[body] + 1):
        within = top <= i <= page.last[top]
        if page.parent[i] in on_path and i not in on_path and not within and density[i] >= threshold > 0 and not off[i]:
            ranges.append((i, page.last[i]))
    keep = bytearray(n)
    for first, last in ranges:
        keep[first : last + 1] = b"\1" * (last + 1 - first)
    return " ".join("".join(text for i, text in page.texts if keep[i] and not off[i]).split())


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` with column `text`; a column of that name is replaced."""
    rest = [c for c in pages.columns if c not in (html, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0, 4 << 20):
            found = pa.array([main_text(x) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], names=[*rest, text])

    chosen = pages.select(F.col(f"`{html}`").cast("string").alias(html), *[f"`{c}`" for c in rest])
    schema = pages.select(*[f"`{c}`" for c in rest], F.lit("").alias(text)).schema
    return chosen.mapInArrow(run, schema)
