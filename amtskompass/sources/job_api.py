"""Job feed payloads: nested JSON pages to job rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import work_type_from_codes
from .schemas import JOB_PAGE

JOB_URL = "https://www.arbeitsagentur.de/jobsuche/jobangebot/"  # fixed value: public job page address


def explode_job_pages(pages: DataFrame) -> DataFrame:
    """Response pages ``(keyword, kw_ord, page, body)`` to one row per hit, keeping the result position."""
    parsed = F.from_json("body", JOB_PAGE)["stellenangebote"]
    return pages.select("keyword", "kw_ord", "page", F.posexplode(parsed).alias("pos", "item"))


def _first_text(*cols: Column) -> Column:
    """First non-empty text, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def hit_refnr(item: Column) -> Column:
    return _first_text(item["refnr"], item["arbeitsmarktdaten"]["refnr"])


def normalize_jobs(hits: DataFrame, as_of: str, item: str = "item") -> DataFrame:
    """Payload items to job rows: nested fallbacks, date prefix, constant defaults.

    A ``refnr`` column already derived from the items is kept as it is, and with it the
    partitioning of hits that were grouped by it.
    """
    raw = F.col(item)
    date_text = raw["aktuelleVeroeffentlichungsdatum"]
    codes = F.when(F.size(raw["arbeitszeit"]) > 0, raw["arbeitszeit"]).otherwise(raw["arbeitsmarktdaten"]["arbeitszeit"])
    # a present 'ort' is used even when empty; 'stadt' only stands in for a missing one
    city = F.coalesce(raw["arbeitsort"]["ort"], raw["arbeitsort"]["stadt"], F.lit(""))
    refnr = F.col("refnr") if "refnr" in hits.columns else hit_refnr(raw)
    fields = {
        "refnr": refnr,
        "title_de": _first_text(raw["titel"], raw["berufsbezeichnung"]),
        "employer": F.coalesce(raw["arbeitgeber"], F.lit("")),
        "city": city,
        "state_code": _first_text(raw["arbeitsort"]["region"], raw["region"]),
        "work_type": work_type_from_codes(codes),
        "is_limited": F.lit(False),
        "entry_date": F.lit(None).cast("date"),
        "tags": F.array().cast("array<string>"),
        "source_url": F.concat(F.lit(JOB_URL), refnr),
        "published_at": F.when(F.length(date_text) >= 10, F.substring(date_text, 1, 10).try_cast("date")),
        "is_active": F.lit(True),
        "translated": F.lit(False),
        "synced_at": F.lit(as_of).cast("timestamp"),
    }
    kept = [c for c in hits.columns if c not in (item, "refnr")]
    return hits.select(*kept, *[value.alias(name) for name, value in fields.items()])
