"""HTML tokeniser: the one place where page structure needs a real parser.

A page becomes its text nodes, each once, and its elements of interest in document order.  An element
knows the range of text nodes below it (``begin``, ``end``), so its text is put together by a native expression
(``element_text``) and only where it is wanted, and the range of tokens below it (``i``, ``until``), so being below it is a comparison of
numbers.  Callers name the selectors they will ask about (:class:`Selectors`); every token says for each of them which element
that matches it stands above.  Plain paragraphs, list items, cells, spans and links (without id, class or role) count for
themselves only, and paragraphs, items, cells and links end where the HTML standard ends them.  A token has a fixed number of
numbers, however deep it lies: the size of the result grows with that of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import pieces

NUMBERS = T.IntegerType()
TOKEN = T.StructType(
    [T.StructField("tag", T.StringType())]
    + [T.StructField(n, NUMBERS) for n in ("i", "until", "parent", "begin", "end")]
    + [T.StructField(n, T.StringType()) for n in ("href", "title")]
    + [T.StructField("at", T.ArrayType(NUMBERS))]
)
ROOT = T.StructType([T.StructField(n, NUMBERS) for n in ("first", "last")])
PAGE = T.StructType(
    [T.StructField("tokens", T.ArrayType(TOKEN)), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("roots", T.ArrayType(ROOT))]
)
TEXT = "#text"
# --- fixed values of the HTML standard ---------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(["script", "style", "template"])
ELEMENTS = frozenset("title h1 h2 h3 h4 h5 h6 p li a time meta dialog aside nav span".split())
PLAIN = frozenset("p li span a td th tr font".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr main menu nav ol p pre search section table ul".split()
)
# start tag: open elements it ends, unless one of the others was opened after them
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "a": (frozenset(["a"]), frozenset(["table", "td", "button"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
PARAGRAPH = (frozenset(["p"]), frozenset(["table", "td", "th", "caption", "button", "object"]))


class _Page(HTMLParser):
    """Tokens of one page.  For each selector a token has -1, or twice the number of the outermost matching element's root, plus one
    if that element stands above the token (and is not the token itself)."""

    def __init__(self, patterns: tuple[re.Pattern, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.patterns = patterns
        self.tokens: list[list] = []
        self.texts: list[str] = []
        self.roots: list[list[int]] = []
        self.nothing = (-1,) * len(patterns)
        # tag, marks for what is below, token of the nearest element that is not plain, own token, own roots
        self.open: list[tuple[str, tuple[int, ...], int, list | None, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}  # where in ``open`` each tag stands
        self.matched: dict[str, tuple[int, ...]] = {}  # selectors that a step matches
        self.hidden = 0

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, _, _, token, roots = self.open.pop()
            self.places[tag].pop()
            self.hidden -= tag in HIDDEN
            if token is not None:
                token[2], token[5] = len(self.tokens), len(self.texts)
            for r in roots:
                self.roots[r][1] = len(self.tokens)

    def _end_open(self, rule: tuple[frozenset, frozenset]) -> None:
        last = max((self.places[t][-1] for t in rule[0] if self.places.get(t)), default=-1)
        if last > max((self.places[t][-1] for t in rule[1] if self.places.get(t)), default=-1):
            self._close(last)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end_open(PARAGRAPH)
        if tag in ENDS:
            self._end_open(ENDS[tag])
        values = {k: v or "" for k, v in attrs}
        own = tag + ("#" + values["id"] if values.get("id") else "")
        own += "".join("." + c for c in values.get("class", "").split())
        own += f"[{values['role']}]" if values.get("role") else ""
        above, parent = (self.open[-1][1], self.open[-1][2]) if self.open else (self.nothing, -1)
        hits = self.matched.get(own)
        if hits is None:
            hits = self.matched[own] = tuple(k for k, p in enumerate(self.patterns) if p.fullmatch(own + "@"))
        marks, here, roots = list(above), list(above), []
        for k in hits:
            if above[k] < 0:  # the outermost match
                roots.append(len(self.roots))
                self.roots.append([len(self.tokens), len(self.tokens) + 1])
                marks[k], here[k] = 2 * roots[-1] + 1, 2 * roots[-1]
        token, place = None, len(self.tokens)
        if tag in ELEMENTS:
            link = values.get("href") if tag == "a" else values.get("datetime") or values.get("name")
            name = values.get("content", "") if tag == "meta" else values.get("title")
            token = [tag, place, place + 1, parent, len(self.texts), len(self.texts), link, name, here]
            self.tokens.append(token)
        if tag not in VOID:
            plain = own in PLAIN
            self.places.setdefault(tag, []).append(len(self.open))
            self.hidden += tag in HIDDEN
            self.open.append((tag, above if plain else tuple(marks), parent if plain else (place if token else -1), token, tuple(roots)))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.texts.append(data)
        if not data.isspace():
            above, parent = (self.open[-1][1], self.open[-1][2]) if self.open else (self.nothing, -1)
            place = len(self.tokens)
            self.tokens.append([TEXT, place, place + 1, parent, len(self.texts) - 1, len(self.texts), None, None, list(above)])


def _parse(html: str | None, patterns: tuple[re.Pattern, ...] = ()) -> dict:
    page = _Page(patterns)
    if html:
        page.feed(html)
        page.close()
        page._close(0)
    return {
        "tokens": [dict(zip(TOKEN.names, t, strict=True)) for t in page.tokens], "texts": page.texts,
        "roots": [{"first": a, "last": b} for a, b in page.roots],
    }


def step_pattern(selector: str) -> str:
    """Regular expression of elements (``name#id.class[role]@``) that match ``name``, ``#id``, ``.class`` or ``[role]``."""
    if selector.startswith("#"):
        return rf"[^#]*{selector}(?=[.\[@]).*"
    if selector.startswith("."):
        return rf".*\{selector}(?=[.\[@]).*"
    if selector.startswith("["):
        return rf".*\{selector[:-1]}\].*"
    return rf"{selector}(?=[#.\[@]).*"


class Selectors:
    """Selectors by name, and others given as ``name=regular expression of the element``."""

    def __init__(self, *names: str, **patterns: str) -> None:
        every = {n: step_pattern(n) for n in names} | patterns
        self.place = {n: k for k, n in enumerate(every)}
        self.patterns = tuple(every.values())

    def page(self, html: Column) -> Column:
        """Tokens, texts and roots of a page."""
        patterns = self.patterns

        @F.arrow_udf(PAGE)
        def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            compiled, page = tuple(re.compile(p) for p in patterns), to_arrow_type(PAGE)
            for some in batches:
                for htmls in pieces(some):
                    yield pa.array([_parse(h, compiled) for h in htmls], page)

        return parsed(html)

    def _at(self, token: Column, name: str) -> Column:
        return token["at"][self.place[name]]

    def inside(self, token: Column, name: str) -> Column:
        """The token matches, or an element above it does."""
        return self._at(token, name) >= 0

    def below(self, token: Column, name: str) -> Column:
        """An element above the token matches."""
        return (self._at(token, name) >= 0) & (self._at(token, name) % 2 == 1)

    def first_root(self, tokens: Column, roots: Column, *names: str) -> Column:
        """Range of the first element that matches the first selector that any token is inside of; null when there is none."""
        found = []
        for name in names:
            hit = F.get(F.filter(tokens, lambda t: self.inside(t, name)), F.lit(0))  # noqa: B023 - used at once
            found.append(F.get(roots, F.shiftright(self._at(hit, name), 1)))
        return F.coalesce(*found)


def element_text(token: Column, texts: Column) -> Column:
    """Text of a token: its text nodes joined without anything between them."""
    return F.array_join(F.slice(texts, token["begin"] + 1, token["end"] - token["begin"]), "")


def under(token: Column, root: Column) -> Column:
    """The token is the element of a root, or below it."""
    return (token["i"] >= root["first"]) & (token["i"] < root["last"])


def within(token: Column, other: Column) -> Column:
    """The token is another one, or below it."""
    return (token["i"] >= other["i"]) & (token["i"] < other["until"])
