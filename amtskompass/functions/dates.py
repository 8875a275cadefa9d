"""Date parsing, formatting and relative-date predicates.  Time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import UNDATED_LABEL


def normalize_date(col: Column) -> Column:
    """RFC-822, ISO or German ``d.M.yyyy`` text to ``yyyy-MM-dd``; empty text when unreadable.

    ISO and RFC-822 times with an offset are read as instants and shown in the session
    time zone (UTC).  Dotted dates are always day first.
    """
    text = F.regexp_replace(F.trim(col), r"^\w{3,9}, *", "")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    mail = F.when(
        text.rlike(r"^\d{1,2} \w{3} \d{4}"),
        F.coalesce(
            F.try_to_timestamp(F.regexp_replace(text, r"(GMT|UTC|UT|Z)\z", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")),
            F.try_to_timestamp(text, F.lit("d MMM yyyy")),
        ),
    )
    day = F.regexp_extract(col, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 1)
    month = F.regexp_extract(col, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 2)
    year = F.regexp_extract(col, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 3)
    german = F.when(day != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    return F.coalesce(F.date_format(F.coalesce(iso, mail), "yyyy-MM-dd"), german, F.lit(""))


def format_date(col: Column) -> Column:
    """``yyyy-MM-dd...`` to the display form; other text unchanged; missing gets a label."""
    head = F.substring(col, 1, 10)
    y, m, d = (F.get(F.split(head, "-"), F.lit(i)) for i in range(3))
    whole = (F.coalesce(y, F.lit("")) != "") & (F.coalesce(m, F.lit("")) != "") & (F.coalesce(d, F.lit("")) != "")

    def number(part: Column) -> Column:
        return F.coalesce(part.try_cast("int").cast("string"), F.lit("NaN"))

    shown = F.concat(number(y), F.lit("年"), number(m), F.lit("月"), number(d), F.lit("日"))
    return F.when(F.coalesce(col, F.lit("")) == "", UNDATED_LABEL).when(whole, shown).otherwise(col)


def as_timestamp(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def within_days(published: Column, days: int, as_of: str) -> Column:
    """Keep dates not older than ``as_of`` minus ``days``.

    The date's midnight is compared with the full timestamp, so a row dated exactly
    ``days`` ago survives only when ``as_of`` is a midnight.
    """
    if days <= 0:
        return F.lit(True)
    return published.cast("timestamp") >= as_timestamp(as_of) - F.make_interval(days=F.lit(days))


def is_new(published: Column, as_of: str) -> Column:
    """Published strictly less than three days before ``as_of``."""
    age = as_timestamp(as_of).cast("double") - published.cast("timestamp").cast("double")
    return F.coalesce(age < 3 * 24 * 3600, F.lit(False))


def since(published_text: Column, start: str | None) -> Column:
    """Date-text filter that keeps undated rows."""
    if not start:
        return F.lit(True)
    return published_text.isNull() | (published_text == "") | (published_text >= start)
