"""Registered queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard, katz, licenses, manifest, mixing, packing, quality, suffix_dedup, token_store, toxicity, warc, whitening
from .common import read, tune


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return suffix_dedup.repeats(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return token_store.store_and_read(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    records = warc.archive_and_read(read(spark, sf_dir, "pages"))
    return records.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return mixing.mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return whitening.components(read(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return manifest.manifest_check(read(spark, sf_dir, "documents"))


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return katz.language_model(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_suffix_dedup, op4_packing, op5_token_store, op6_fingerprints, op7_warc, op8_mixing, op9_jaccard_join, op10_toxicity, op11_whitening, op12_merkle_manifest, op13_katz_scores)}


OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
g AS (SELECT hex, max(page_id) AS holder FROM h GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM h JOIN g USING (hex)
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(gs) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n_shingles + q.n_shingles - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n_shingles, min(y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY ALL
"""


def _op12() -> str:
    """Six levels of 16 for each source, and six over the sources, which 16 million rows of a source don't exceed."""
    piece = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(piece, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"
    parts = [
        "c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)",
        f"d AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN coalesce({crc} % 5 = 0, false) THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents, c)",
        "p0 AS (SELECT *, leaf AS h, coalesce(other, leaf) AS fold, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM d)",
        "n0 AS (SELECT g, pos, h, m FROM p0)",
    ]
    for kind, start in (("", 0), ("top", 6)):
        for k in range(start, start + 6):
            run = "OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN {})"
            parts.append(f"s{k} AS (SELECT *, CASE WHEN m > 1 THEN coalesce(string_agg(h, '') {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') END AS l, CASE WHEN m > 1 THEN coalesce(string_agg(h, '') {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') END AS r FROM n{k})")
            parts.append(f"n{k + 1} AS (SELECT g, pos // 16 AS pos, CASE WHEN m > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (m + 15) // 16 AS m FROM n{k} GROUP BY g, pos // 16, m)")
            parts.append(f"p{k + 1} AS (SELECT p.* REPLACE (CASE WHEN s.m > 1 THEN sha256(l || fold || r) ELSE fold END AS fold, CASE WHEN s.m > 1 THEN proof || l || r ELSE proof END AS proof, p.pos // 16 AS pos) FROM p{k} p JOIN s{k} s ON p.g IS NOT DISTINCT FROM s.g AND p.pos = s.pos)")
        if not kind:  # the subroots are the leaves of the tree over the sources
            parts.append("roots AS (SELECT g AS of, h AS subroot, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM n6)")
            parts[-2:] = [f"q6 AS ({parts[-2][len('p6 AS ('):-1]})", parts[-1], "p6 AS (SELECT q6.* REPLACE ('' AS g, place AS pos), subroot FROM q6 JOIN roots ON q6.g IS NOT DISTINCT FROM roots.of)"]
            parts = [x.replace("n6 AS (", "n6s AS (", 1) if x.startswith("n6 AS (") else x.replace("FROM n6)", "FROM n6s)") if x.startswith("roots") else x for x in parts]
            parts.append("n6 AS (SELECT '' AS g, place AS pos, subroot AS h, m FROM roots)")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, n12.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = n12.h AS verified FROM p12, n12"


OP12 = _op12()


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7, "op9_jaccard_join": OP9, "op12_merkle_manifest": OP12}
