"""The registered queries of this folder, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import op1_secrets, op2_toxicity, op3_licenses, op4_near_dedup, op5_pii, op6_ann, op7_exact_dedup, op8_line_dedup, op9_bpe, op10_mixing, op11_jaccard_join, op12_whitening, op13_lexical
from traceloom.llm.tables import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secrets.digests(table(spark, sf_dir, "documents"))


def op2_toxic_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licenses.license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii.digests(table(spark, sf_dir, "documents"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7_exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return found.withColumnRenamed("text_hash", "text_sha256")


def op8_line_dedup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing.mix(table(spark, sf_dir, "documents"))


def op11_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op12_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan, op2_toxic_pu, op3_license_scan, op4_minhash_near_dedup, op5_personal_data,
        op6_multi_index_hashing, op7_progressive_dedup, op8_line_dedup_minhash, op9_bpe_chunks, op10_pivotal_mixing,
        op11_t_occurrence_join, op12_polarised_whitening, op13_limited_accumulators,
    )
    return {f.__name__: f for f in found}


_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)])) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.doc_id
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)])) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n + y.n - common)
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.doc_id
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_EXACT = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), placed AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM placed
"""


_LEXICAL = r"""
WITH words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest([x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> '']) AS term
  FROM benchmark
), whole AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM words
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(
    floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))
  )::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), whole GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def sql() -> dict[str, str]:
    return {"op4_minhash_near_dedup": _NEAR, "op7_progressive_dedup": _EXACT, "op11_t_occurrence_join": _JOIN, "op13_limited_accumulators": _LEXICAL}
