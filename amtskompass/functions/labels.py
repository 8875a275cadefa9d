"""Job tags, work types, office topics, page labels and dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .needles import all_labels, rule_bits
from .text import bound, contains_any, distinct_in_order, first_match, trim_all


def job_tags(description: Column) -> Column:
    """All keyword tags of a job description, in rule order.

    Needles with capitals can never match the lower-cased text; they stay in the list as data.
    """
    return bound(rule_bits(F.lower(F.coalesce(description, F.lit(""))), C.JOB_TAG_RULES), lambda bits: all_labels(bits, C.JOB_TAG_RULES))


def clean_tag_reply(description: Column, reply: Column) -> Column:
    """Known tags of a comma separated reply; keyword tags when none is known or the text is short."""
    parts = F.transform(F.split(F.coalesce(reply, F.lit("")), "[,，]"), trim_all)
    valid = F.filter(parts, lambda t: (F.length(t) <= 15) & t.isin(C.JOB_TAGS))
    short = F.length(trim_all(F.coalesce(description, F.lit("")))) < 20
    both = F.struct(valid.alias("valid"), job_tags(description).alias("found"))
    return bound(both, lambda b: F.when(short | (F.size(b["valid"]) == 0), b["found"]).otherwise(b["valid"]))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(key: Column, values: dict[str, str]) -> Column:
    """Dimension lookup in a small fixed mapping; unknown keys give null."""
    return F.try_element_at(literal_map(values), key)


def work_type_from_codes(codes: Column) -> Column:
    """Labels of the known working-time codes, case-insensitive, unknown ones dropped."""
    labels = F.transform(codes, lambda c: lookup(F.lower(c), C.WORK_TYPES))
    return F.coalesce(F.array_compact(labels), F.array().cast("array<string>"))


def infer_work_type(mini: Column, morning: Column, afternoon: Column, title: Column, description: Column) -> Column:
    """Work types from detail flags and text; full time when nothing is found."""
    text = F.concat_ws(" ", F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))))
    on = lambda c: F.coalesce(c, F.lit(False))
    part = F.lit("兼职")

    def found(t: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(on(mini), F.lit("迷你岗")),
                F.when(on(morning) | on(afternoon), part),
                F.when(contains_any(t, C.FULL_TIME_NEEDLES), F.lit("全职")),
                F.when(contains_any(t, C.PART_TIME_NEEDLES), part),
                F.when(contains_any(t, C.REMOTE_NEEDLES), F.lit("远程")),
            )
        )

    full = F.array(F.lit("全职"))
    return bound(bound(text, found), lambda w: F.when(F.size(w) > 0, F.array_distinct(w)).otherwise(full))


def office_topic(title: Column, url: Column) -> Column:
    text = F.concat_ws(" ", F.lower(title), F.lower(url))
    return bound(text, lambda t: first_match(t, C.OFFICE_TOPIC_RULES, F.lit(C.OFFICE_TOPIC_DEFAULT)))


def office_title(title: Column) -> Column:
    """Label of the first dictionary entry contained in the title, else its first 60 characters."""
    rules = [(label, [needle]) for needle, label in C.OFFICE_TITLES]
    return bound(F.lower(title), lambda t: first_match(t, rules, F.substring(title, 1, 60)))


def keyed_office(url: Column) -> Column:
    """Struct (key, label, title_zh, topic) of the first known key inside the url."""

    def row(entry) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(entry, ("key", "label", "title_zh", "topic"))])

    result = None
    for entry in C.KEYED_OFFICE_PAGES:
        hit = url.contains(entry[0])
        result = F.when(hit, row(entry)) if result is None else result.when(hit, row(entry))
    return result.otherwise(row(C.KEYED_OFFICE_PAGES[0]))


def page_labels(name: Column) -> Column:
    """Struct (category, tags, target_groups) of a guide page name, with defaults for unknown pages."""
    named = F.coalesce(name, F.lit(""))
    category = lookup(named, {p[0]: p[1] for p in C.GUIDE_PAGES})

    def arrays(field: int, default: Column) -> Column:
        result = None
        for page in C.GUIDE_PAGES:
            if page[field] is None:
                continue
            value = F.array(*[F.lit(v) for v in page[field]])
            result = F.when(named == page[0], value) if result is None else result.when(named == page[0], value)
        return result.otherwise(default)

    return F.struct(
        F.coalesce(category, F.lit(C.OTHER_CATEGORY)).alias("category"),
        arrays(2, F.array(named)).alias("tags"),
        arrays(3, F.array(*[F.lit(g) for g in C.GUIDE_PAGE_DEFAULT_GROUPS])).alias("target_groups"),
    )


def merge_tags(*arrays: Column) -> Column:
    """Order-preserving union of tag arrays."""
    return distinct_in_order(*arrays)
