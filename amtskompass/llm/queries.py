"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import table
from . import crf, inverted, kdtree, licenses, merkle, packing, quality, recompress, sharding, simhash, suffixes, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
), g AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram,
         count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
  FROM w
), f AS (
  SELECT doc_id, i, word, n = 13 AND min(CASE WHEN n = 13 THEN doc_id END) OVER (PARTITION BY gram) < doc_id AS later FROM g
), c AS (
  SELECT doc_id, i, word, coalesce(bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM f
), d AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""


@query("op5_substring_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.removed_windows(table(spark, sf_dir, "documents"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed_strings(table(spark, sf_dir, "documents"))


TOKENIZER = "byte_bpe_50k.json"


@query("op1_cost_balanced_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query("op4_url_template_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urls.filtered(table(spark, sf_dir, "pages"), labels)


@query("op7_label_propagation_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


@query("op8_crf_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.personal_data(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), w AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[s + 1 : s + least(len(words), 13)], ' ') AS gram
  FROM b, unnest(range(0, greatest(len(words) - 12, least(len(words), 1)))) AS t(s)
), sizes AS (SELECT DISTINCT n FROM w), g AS (
  SELECT doc_id, n, s, array_to_string(words[s + 1 : s + n], ' ') AS gram FROM d, sizes, unnest(range(0, greatest(len(words) - n + 1, 0))) AS t(s)
), m AS (SELECT g.doc_id, w.item_id, g.s, g.n FROM g JOIN w USING (n, gram)
), h AS (SELECT doc_id, count(DISTINCT s + i) AS n_hit FROM m, unnest(range(0, n)) AS t(i) GROUP BY doc_id
), c AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near_items", "text_hash")


@query("op10_weak_supervision_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def _tree_sql(name: str, levels: int) -> str:
    """CTEs ``name1`` .. of the upper levels over ``name0 (grp, pos, n, h)`` and ``names0`` .. of what flanks a node in its run."""
    return ",\n".join(
        f"""{name}{k + 1} AS (
  SELECT grp, pos // 3 AS pos, (max(n) + 2) // 3 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY {name}{k}.pos)) END AS h
  FROM {name}{k} GROUP BY grp, {name}{k}.pos // 3
), {name}s{k} AS (
  SELECT x.grp, x.pos, any_value(x.n) > 1 AS real, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS before,
         coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS after
  FROM {name}{k} x JOIN {name}{k} y ON x.grp IS NOT DISTINCT FROM y.grp AND x.pos // 3 = y.pos // 3 GROUP BY x.grp, x.pos
)"""
        for k in range(levels)
    )


def _op11_sql(row_levels: int = 14, group_levels: int = 8) -> str:
    """Level by level, for up to 3 ** 14 rows a source and 3 ** 8 sources."""
    enc = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = []
    for k, (tree, level, grp, pos) in enumerate([("r", k, "grp", "pos") for k in range(row_levels)] + [("g", k, "0", "gpos") for k in range(group_levels)]):
        steps.append(f"""f{k + 1} AS (
  SELECT f.* REPLACE (CASE WHEN s.real THEN sha256(s.before || f.node || s.after) ELSE f.node END AS node, f.proof || s.before || s.after AS proof)
  FROM f{k} f JOIN {tree}s{level} s ON s.grp IS NOT DISTINCT FROM f.{grp} AND s.pos = f.{pos} // {3**level}
)""".replace("f.0 ", "0 "))
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), d AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS tampered,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM documents, crc
), r0 AS (
  SELECT source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         leaf AS h, doc_id, CASE WHEN crc % 2 = 0 THEN tampered ELSE leaf END AS claimed
  FROM d
), {_tree_sql("r", row_levels)}, g0 AS (
  SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, grp AS name FROM r{row_levels}
), {_tree_sql("g", group_levels)}, f0 AS (
  SELECT doc_id, r0.grp, r0.pos, g0.pos AS gpos, r0.h AS leaf, g0.h AS subroot, claimed AS node, '' AS proof FROM r0 JOIN g0 ON r0.grp IS NOT DISTINCT FROM g0.name
), {", ".join(steps)}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.h AS verified
FROM f{row_levels + group_levels}, g{group_levels} t
"""


@query("op11_merkle_manifest", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = merkle.verified(merkle.documents_manifest(table(spark, sf_dir, "documents"), tampered))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", "verified")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op12_kdtree_top_k", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


@query("op13_qdwh_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), first=8)
