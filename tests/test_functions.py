"""Golden values of the scalar functions, labels and taxonomy."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from amtskompass.functions import constants as C
from amtskompass.functions import dates, keys, labels, needles, replies, taxonomy, text

c = F.col


def test_normalize_text_folds_width_case_and_space(one):
    assert one({"a": "  Ｆoo\u3000\u00a0BAR\n ½ "}, text.normalize_text(c("a"))) == "foo bar 1⁄2"
    assert text.normalize_needle("  Ｆoo\u3000BAR ") == "foo bar"


def test_stable_characters_really_are_stable():
    import re

    pattern = re.sub(r"\\x\{10ffff\}", "\\\\U0010ffff", text.MAY_CHANGE)
    inner = pattern[pattern.index("[^") : -1]
    for code in range(0x80, 0xFFFF):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if not re.match(inner, char):
            assert unicodedata.normalize("NFKC", char) == char
            assert unicodedata.combining(char) == 0


def test_clean_and_trim(one):
    assert one({"a": "\u2003a \t b\n\nc\ufeff"}, text.clean_text(c("a"))) == "a b c"
    assert one({"a": "\u00a0 a b \n"}, text.trim_all(c("a"))) == "a b"


def test_entities_decode_ampersand_first(one):
    assert one({"a": "&amp;lt;b&gt; &quot;x&#39;&nbsp;"}, text.decode_entities(c("a"))) == "<b> \"x' "


def test_needles_implied_by_shorter_ones_change_nothing(one):
    for value in ("kinder", "kind", "ki", "儿童金"):
        want = any(n in value for n in ["儿童", "儿童金", "kind", "kinder"])
        assert one({"a": value}, text.contains_any(c("a"), ["儿童", "儿童金", "kind", "kinder"])) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Wed, 22 Apr 2026 10:00:00 GMT", "2026-04-22"), ("2026-04-22", "2026-04-22"), ("22.04.2026", "2026-04-22"),
        ("05.04.2026", "2026-04-05"), ("Wed, 22 Apr 2026 23:30:00 -0200", "2026-04-23"), ("2026-04-22T10:00:00Z", "2026-04-22"),
        ("garbage", ""), ("", ""),
    ],
)
def test_normalize_date(one, raw, want):
    assert one({"a": raw}, dates.normalize_date(c("a"))) == want


def test_format_date(one):
    assert one({"a": "2026-04-05T00:00"}, dates.format_date(c("a"))) == "2026年4月5日"
    assert one({"a": ""}, dates.format_date(c("a"))) == "未注明"
    assert one({"a": "bald"}, dates.format_date(c("a"))) == "bald"


def test_within_days_keeps_time_of_day(one):
    day = c("a").cast("date")
    assert one({"a": "2024-06-05"}, dates.within_days(day, 10, "2024-06-15 00:00:00")) is True
    assert one({"a": "2024-06-05"}, dates.within_days(day, 10, "2024-06-15 00:00:01")) is False


def test_is_new_is_strict(one):
    day = c("a").cast("date")
    assert one({"a": "2024-06-12"}, dates.is_new(day, "2024-06-15 00:00:00")) is False
    assert one({"a": "2024-06-12"}, dates.is_new(day, "2024-06-14 23:59:59")) is True


def test_slugs(one):
    assert one({"a": "Größe & Maß"}, keys.feed_slug(c("a"))).startswith("grosse-mass-")
    assert one({"a": "!!!"}, keys.feed_slug(c("a"))).startswith("policy-")
    slug = one({"a": "Für Änderung"}, keys.timed_slug(c("a"), F.timestamp_seconds(F.lit(1700000000))))
    assert slug == "fuer-aenderung-loyw3v28"
    assert one({"a": "中文 Titel!"}, keys.scrape_slug(c("a"), F.lit("https://a.b/c"))).startswith("中文-titel---a.b-c---")


def test_service_key(one):
    assert one({"a": "https://a.b/c-d?e"}, keys.service_key(c("a"), "p")) == "p_a_b_c_d_e"
    long = one({"a": "https://" + "x" * 200}, keys.service_key(c("a"), "p"))
    assert len(long) == 89 and long[80] == "_"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Antrag auf Einbürgerung und Visum 签证", "入籍与长期居留"), ("residence permit", "居留与签证"), ("本文不涉及个人居留权益的判断。Hund", "宠物与犬税"),
        ("nichts", "其他"), ("税", "税务与社保"),
    ],
)
def test_display_category_first_rule_wins(one, raw, want):
    assert one({"a": raw}, taxonomy.display_category(taxonomy.lookup_text(c("a")))) == want


def test_rule_sets_differ(one):
    assert one({"a": "residence permit"}, taxonomy.ingest_category(F.lit(""), F.lit("x"), c("a"))) == "其他"
    assert one({"a": "教育"}, taxonomy.display_category(c("a"))) == "留学与大学"
    assert one({"a": "教育"}, taxonomy.ingest_category(F.lit(""), F.lit("x"), c("a"))) == "其他"


def test_display_groups_ignore_stored_groups(spark):
    row = {"title_zh": "蓝卡", "title_de": "", "summary_zh": None, "key_changes": None, "content_de_summary": None,
           "region_level": "bogus", "region_name": " Kreis Ludwigsburg ", "target_groups": ["x"], "category": "y"}
    schema = ("title_zh string, title_de string, summary_zh string, key_changes array<string>, content_de_summary string,"
              " region_level string, region_name string, target_groups array<string>, category string")
    got = taxonomy.normalize_policies(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert got["category"] == "工作与蓝卡"
    assert got["target_groups"] == ["蓝卡人群"]
    assert (got["region_name"], got["region_level"]) == ("Landkreis Ludwigsburg", "Landkreis")


@pytest.mark.parametrize(
    "name,level,region,state",
    [
        ("Stuttgart", "市", "Stuttgart", "Baden-Württemberg"), ("baden w", None, "Baden-Württemberg", "Baden-Württemberg"),
        ("Deutschland", "州", "联邦", "联邦"), ("Bundesland X", "州", "联邦", "联邦"), (" Ulm ", "市", "Ulm", "Ulm"), ("Bayern", "联邦", "联邦", "联邦"),
    ],
)
def test_regions(spark, name, level, region, state):
    df = spark.createDataFrame([(name, level)], "region_name string, region_level string")
    got = taxonomy.with_regions(df).first()
    assert (got["_region"], got["_state"]) == (region, state)


def test_wanted_region():
    assert taxonomy.wanted_region("Bavaria") == "Bayern"
    assert taxonomy.wanted_region("Bundesgebiet") == "联邦"
    assert taxonomy.wanted_region(" Ulm ") == "Ulm"


def test_job_tags_dead_needles(one):
    assert one({"a": "IT Fullstack"}, labels.job_tags(c("a"))) == []
    assert one({"a": "Praktikum als Koch"}, labels.job_tags(c("a"))) == ["留学生适合", "实习岗", "餐饮/酒店"]


def test_clean_tag_reply(one):
    long = F.lit("eine sehr lange Beschreibung als Koch")
    assert one({"a": "IT/技术，falsch, 英语即可"}, labels.clean_tag_reply(long, c("a"))) == ["IT/技术", "英语即可"]
    assert one({"a": "nur falsch"}, labels.clean_tag_reply(long, c("a"))) == ["餐饮/酒店"]
    assert one({"a": "IT/技术"}, labels.clean_tag_reply(F.lit("Koch"), c("a"))) == ["餐饮/酒店"]


def test_work_types(one):
    off = F.lit(None).cast("boolean")
    assert one({"a": "Vormittag"}, labels.infer_work_type(off, off, off, c("a"), c("a"))) == ["全职"]
    assert one({"a": "Teilzeit oder Vollzeit"}, labels.infer_work_type(F.lit(True), F.lit(True), off, c("a"), F.lit(None))) == ["迷你岗", "兼职", "全职"]
    assert one({"a": "x"}, labels.work_type_from_codes(F.array(F.lit("VZ"), F.lit("q"), F.lit("ho")))) == ["全职", "远程"]


def test_page_labels(one):
    known = one({"a": "wohngeld"}, labels.page_labels(c("a")))
    assert (known["category"], known["target_groups"]) == ("住房与租房", ["新移民", "留学生", "求职者"])
    part = one({"a": "steuerklasse"}, labels.page_labels(c("a")))
    assert (part["category"], part["tags"]) == ("税务与社保", ["steuerklasse"])


def test_keyed_office(one):
    assert one({"a": "https://h/x/erstaufnahme-leistungen"}, labels.keyed_office(c("a")))["title_zh"] == "首次接收与难民福利"
    assert one({"a": "https://h/x"}, labels.keyed_office(c("a")))["key"] == "auslaenderbehoerde"


@pytest.mark.parametrize(
    "raw,want",
    [
        ('Hier ```json\n{"a": 1}\n``` Ende', '{"a": 1}'), ('x {"a": {"b": 1}} y', '{"a": {"b": 1}}'), ("kein", None), ("} {", None),
        ('```\n[1]\n``` {"a": 1}', None),
    ],
)
def test_json_object_text(one, raw, want):
    assert one({"a": raw}, replies.json_object_text(c("a"))) == want


def test_fence_stripped(one):
    assert one({"a": '```json\n[1,\n2]\n```'}, replies.fence_stripped(c("a"))) == "[1,\n2]"
    assert one({"a": '```json\n[1]'}, replies.fence_stripped(c("a"))) == "[1]"
    assert one({"a": ' a\x01b\tc '}, replies.fence_stripped(c("a"))) == "ab\tc"
    assert one({"a": "```\n```"}, replies.fence_stripped(c("a"))) == ""


def test_unwrap_text_block(one):
    assert one({"a": '{"type": "text", "text": "{\\"x\\": 1}"}'}, replies.unwrap_text_block(c("a"))) == '{"x": 1}'
    assert one({"a": '{"x": 1}'}, replies.unwrap_text_block(c("a"))) == '{"x": 1}'


def test_reply_items_shapes(spark):
    from pyspark.sql import types as T

    item = T.StructType([T.StructField("id", T.StringType())])
    texts = [
        '[{"id": "a"}, {"id": "b"}]', '{"id": "a"}', '{"results": [{"id": "a"}]}', '{"id": "a"}\n{"id": "b"}\nfalsch',
        "[kaputt", '{\n "id": "a"\n}', "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {}
    for r in replies.reply_items(df, "t", item).orderBy("n", "pos").collect():
        got.setdefault(r["n"], []).append(r["item"]["id"])
    assert got == {0: ["a", "b"], 1: ["a"], 2: ["a"], 3: ["a", "b"], 5: ["a"]}


@pytest.mark.parametrize("raw,want", [("0.8", 0.8), ("0.8 sicher", 0.8), ("7", 1.0), ("-1", 0.0), ("NaN", 0.0), ("x", 0.0), ("", 0.0), ("1e-1", 0.1)])
def test_confidence(one, raw, want):
    assert one({"a": raw}, replies.normalize_confidence(c("a"))) == want


def test_url_join(one):
    for url, base, want in [
        ("/f.xml", "https://a.b/c/d", "https://a.b/f.xml"), ("f.xml", "https://a.b/c/d", "https://a.b/c/f.xml"),
        ("https://x.y", "https://a.b", "https://x.y/"), ("http://[bad", "https://a.b", ""), ("f", "", ""),
    ]:
        assert one({"u": url, "b": base}, text.absolute_url(c("u"), c("b"))) == want


def test_escape_like(one):
    assert text.escape_like("50%_a,b\\") == "50\\%\\_a b\\\\"
    assert one({"a": "50%_a,b\\"}, text.escape_like_column(c("a"))) == "50\\%\\_a b\\\\"


def test_fixed_values_are_consistent():
    assert len(C.FEED_KEYWORDS) == 39 and len(C.JOB_TAGS) == 22 and len(C.STATE_CODES) == 16
    assert [t for t, _ in C.JOB_TAG_RULES] == C.JOB_TAGS


RULES = [("a", ["ab", "b"]), ("b", ["abc", "IT"]), ("none", []), ("c", ["签证", "ü", "bca"]), ("all", [""]), ("d", ["b b"])]


@pytest.mark.parametrize("seed", range(3))
def test_one_pass_finds_the_rules_that_contains_finds(spark, seed):
    rnd = random.Random(seed)
    texts = [None, "", "签证", "xabcab", "b b", "IT"] + ["".join(rnd.choice("abc ITü签证") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(3)
    bits = needles.rule_bits(c("t"), RULES, RULES[:2])
    got = df.select("n", needles.all_labels(bits, RULES).alias("all"), needles.all_labels(bits, RULES[:2], len(RULES)).alias("two"), needles.first_label(bits, RULES[:4], F.lit("-")).alias("first"))
    for r in got.collect():
        found = [label for label, words in RULES if texts[r["n"]] is not None and any(w in texts[r["n"]] for w in words)]
        assert r["all"] == found and r["two"] == [label for label in found if label in "ab"]
        assert r["first"] == next((label for label in found if label != "all" and label != "d"), "-")


def test_too_many_rules_are_refused():
    with pytest.raises(ValueError):
        needles.rule_bits(F.lit("x"), [(str(i), [str(i)]) for i in range(63)])


def test_disclaimers_are_blanked_only_where_they_occur(one):
    assert one({"a": " 不构成法律建议。 VISA  x "}, taxonomy.lookup_text(c("a"))) == " 。 visa x"


# --- long batches go through Python helpers in pieces ---------------------------------


def test_pieces_are_bounded_and_whole():
    import pyarrow as pa

    from amtskompass.functions.batches import PIECE_BYTES, PIECE_ROWS, pieces

    texts = ["", None, "ä" * PIECE_BYTES, "x", *["y" * 1000] * 5000, None, *["z"] * 3000]
    found = list(pieces(pa.array(texts).slice(1)))
    assert [t for some in found for t in some] == texts[1:]
    assert all(len(some) == 1 or (len(some) <= PIECE_ROWS and sum(len((t or "").encode()) for t in some) <= PIECE_BYTES) for some in found)
    assert list(pieces(pa.array([], pa.string()))) == []


def test_helpers_keep_rows_across_pieces(spark):
    from amtskompass.functions.html import Selectors

    df = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.repeat(F.lit("ﬁ "), 400), F.lit("<a href='"), F.col("id").cast("string"), F.lit("'>"))).alias("t"))
    page = Selectors().page(F.col("t"))["tokens"]
    got = df.select("id", F.length(text.nfkc(F.col("t"))).alias("n"), needles.rule_bits(F.col("t"), [("a", ["ﬁ"]), ("b", ["'8'"])]).alias("bits"), F.filter(page, lambda t: t["tag"] == "a")["href"].alias("href"))
    for r in got.collect():
        assert (r["n"], r["bits"], r["href"]) == ((None, None, []) if r["id"] % 7 == 0 else (1200 + 11 + len(str(r["id"])), 3 if r["id"] == 8 else 1, [str(r["id"])]))
