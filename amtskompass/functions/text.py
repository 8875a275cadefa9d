"""Text expressions shared by all jobs.

Everything is a native column expression except Unicode compatibility
normalisation, which Spark has no function for.  ``nfkc`` sends only the rows
through Arrow that contain a character the normalisation could change; all
other rows stay in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from string import Formatter
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import pieces

# Unicode white space as browsers and script engines define it (ASCII \\s is not enough).
# Classes are written as a cheap range test intersected with the exact set: most characters
# fail the first test, which is several times faster than a long union of ranges.
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = (
    r"[\t-\r \u00a0-\uffff&&"
    r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
)
# Any character outside the inner set may change under NFKC or NFKD-style composition.
MAY_CHANGE = (
    r"[\x80-\x{10ffff}&&"
    r"[^\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2010\u2012-\u2016\u2018-\u2023\u20ac"
    r"\u3001-\u3029\u4e00-\u9fff]]"
)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) costly columns so that they are evaluated exactly once per row.

    Catalyst merges projections and substitutes aliases into filters pushed below them, which
    would copy a long rule cascade into every place that reads it.  A one-element ``inline``
    keeps the values behind a generator: later filters on them stay above it, filters on other
    columns still reach the scan.
    """
    known = set(df.columns)
    names = {n: f"_new_{n}" if n in known else n for n in columns}
    out = df.select("*", F.inline(F.array(F.struct(*[value.alias(names[n]) for n, value in columns.items()]))))
    replaced = {new: n for n, new in names.items() if new != n}
    return out.drop(*replaced.values()).withColumnsRenamed(replaced) if replaced else out


def bound(col: Column, build: Callable[[Column], Column]) -> Column:
    """``build(col)`` with ``col`` evaluated once, however often the built expression reads it."""
    return F.get(F.transform(F.array(col), build), F.lit(0))


def _normaliser(form: str):
    @F.arrow_udf(T.StringType())
    def normalise(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in batches:
            for values in pieces(some):
                yield pa.array([None if v is None else unicodedata.normalize(form, v) for v in values], pa.string())

    return normalise


def nfkc(col: Column) -> Column:
    """NFKC; rows made of stable characters never leave the JVM."""
    def risky(x: Column) -> Column:
        return F.when((F.octet_length(x) > F.length(x)) & x.rlike(MAY_CHANGE), x)

    return F.coalesce(_normaliser("NFKC")(bound(col, risky)), col)


def strip_marks(col: Column) -> Column:
    """NFKD without combining marks; pure ASCII rows never leave the JVM."""
    decomposed = _normaliser("NFKD")(F.when(F.octet_length(col) > F.length(col), col))
    return F.regexp_replace(F.coalesce(decomposed, col), r"[\u0300-\u036f]", "")


def collapse_spaces(col: Column) -> Column:
    """Every run of white space becomes one blank.

    Line breaks and tabs are plain replacements; the regular expression only runs on rows
    that have a double blank or an unusual space.  The lambda binds the text once.
    """
    for char in "\t\n\x0b\f\r":
        col = F.replace(col, F.lit(char), F.lit(" "))

    def squeeze(x: Column) -> Column:
        unusual = (F.octet_length(x) > F.length(x)) & x.rlike(SPACE.replace("[\\t-\\r \\u00a0-", "[\\u00a0-"))
        return F.when(x.contains("  ") | unusual, F.regexp_replace(x, SPACE + "+", " ")).otherwise(x)

    return bound(col, squeeze)


def trim_all(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(col, F.lit(WHITE))


def clean_text(col: Column) -> Column:
    """Collapse all white space including line breaks, then trim."""
    return F.trim(collapse_spaces(col))


def normalize_text(col: Column) -> Column:
    """Search form: lower case, NFKC, single blanks, trimmed."""
    return clean_text(nfkc(F.lower(col)))


def normalize_needle(value: str) -> str:
    """Driver-side twin of :func:`normalize_text` for constant search terms."""
    return " ".join(unicodedata.normalize("NFKC", value.lower()).split())


def includes_text(normalized: Column, needle: str | None) -> Column:
    """Substring test on an already normalised column; an empty needle matches everything."""
    return normalized.contains(normalize_needle(needle)) if needle else F.lit(True)


def text_or(col: Column, fallback: Column) -> Column:
    """Trimmed text, or ``fallback`` when missing or blank."""
    return F.coalesce(F.nullif(trim_all(col), F.lit("")), fallback)


def list_or(col: Column, fallback: Column) -> Column:
    """Trimmed non-empty members, or ``fallback`` when none is left."""
    kept = F.filter(F.transform(col, trim_all), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(fallback)


def distinct_in_order(*arrays: Column) -> Column:
    """Merge arrays keeping the first occurrence of each member."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def fill(template: str, **values: Column) -> Column:
    """Text template with ``{name}`` placeholders filled from columns; missing values become empty."""
    parts = [
        F.coalesce(values[name].cast("string"), F.lit("")) if name else F.lit(literal)
        for literal, name in text_parts(template)
    ]
    return F.concat(*parts)


def text_parts(template: str) -> list[tuple[str, str]]:
    """Literal pieces and placeholder names in order; exactly one of the two is set."""
    out: list[tuple[str, str]] = []
    for literal, name, _, _ in Formatter().parse(template):
        out += [(literal, "")] if literal else []
        out += [("", name)] if name else []
    return out


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_sql(name: str, needles: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({name}, {_quoted(n)})" for n in _needed(needles)) + ")"


def _needed(needles: Sequence[str]) -> list[str]:
    """Needles without those implied by a shorter one."""
    return [n for n in needles if not any(o != n and o in n for o in needles)]


# The rule functions take a Column or the name of a column.  A named column is put into one
# SQL expression, which is built far faster than hundreds of single Column objects.


def first_match(text: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: Column) -> Column:
    """Ordered rules: the first one with a needle contained in ``text`` decides."""
    if isinstance(text, str):
        cases = " ".join(f"WHEN {_any_sql(text, n)} THEN {_quoted(label)}" for label, n in rules)
        return F.coalesce(F.expr(f"CASE {cases} END"), default)
    result: Column | None = None
    for label, needles in rules:
        hit = contains_any(text, needles)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return default if result is None else result.otherwise(default)


def contains_any(text: Column | str, needles: Sequence[str]) -> Column:
    """True when any needle is contained."""
    if isinstance(text, str):
        return F.expr(_any_sql(text, needles))
    first, *rest = _needed(needles)
    cond = text.contains(first)
    for needle in rest:
        cond = cond | text.contains(needle)
    return cond


def strip_cdata(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"^<!\[CDATA\[", ""), r"\]\]>\z", "")


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(strip_cdata(col), "<[^>]*>", " ")


# --- fixed values: the decoded entities, in decoding order (ampersand first) ----
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def decode_entities(col: Column) -> Column:
    """Six entities, ampersand first: a doubly escaped bracket decodes fully."""
    for entity, plain in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(plain))
    return col


def escape_like(value: str) -> str:
    """Make a user term literal inside a LIKE pattern (backslash escape); commas become blanks."""
    for char in ("\\", "%", "_"):
        value = value.replace(char, "\\" + char)
    return value.replace(",", " ")


def escape_like_column(col: Column) -> Column:
    return F.replace(F.regexp_replace(col, r"([\\%_])", r"\\$1"), F.lit(","), F.lit(" "))


def detail_key(refnr: Column) -> Column:
    """Key of the job detail lookup: base64 of the reference number."""
    return F.base64(refnr.cast("binary"))


@F.pandas_udf(T.StringType())
def absolute_url(urls: pd.Series, bases: pd.Series) -> pd.Series:
    """Resolve links against their page; unusable ones become empty."""

    def resolve(url, base):
        if url is None:
            return ""
        try:
            joined = urljoin(base or "", url)
            parts = urlsplit(joined)
        except ValueError:
            return ""
        if not parts.scheme or (parts.scheme in ("http", "https") and not parts.netloc):
            return ""
        return joined if parts.path or parts.scheme not in ("http", "https") else joined.replace(parts.netloc, parts.netloc + "/", 1)

    return pd.Series([resolve(u, b) for u, b in zip(urls, bases)], dtype="object")


def url_origin(url: Column) -> Column:
    """Scheme and host of an absolute http(s) url, else null."""
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.lit(""))
