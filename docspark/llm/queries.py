"""The registered queries of the operators: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, license_scan, quality
from .common import documents
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .sharding import assign_shards
from .suffix_dedup import suffix_dedup
from .token_output import token_output


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), min_bytes=400, keep_bytes=False).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), n_shards=8)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality_scores(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict_language(docs, language.train(docs))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("found")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), tokenizer_path())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_output": op8_token_output,
    "op9_near_dedup": op9_near_dedup,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    # each 400-byte string by its MD5, from pages of hexadecimal digits; the runs of the repeated ones
    "op1_suffix_dedup": """
        WITH bytes AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents
        ), bases AS (
            SELECT doc_id, h, n_bytes, unnest(range(0, n_bytes - 399, 512)) AS base FROM bytes WHERE n_bytes >= 400
        ), pages AS (
            SELECT doc_id, base, least(512, n_bytes - 399 - base) AS n, substring(h, 2 * base + 1, 2 * 912) AS page FROM bases
        ), starts AS (
            SELECT doc_id, base, unnest(range(0, n)) AS p, page FROM pages
        ), named AS (
            SELECT doc_id, base + p AS p, md5_number(substring(page, 2 * p + 1, 800)) AS name FROM starts
        ), repeated AS (
            SELECT doc_id, p FROM named WHERE name IN (SELECT name FROM named GROUP BY name HAVING count(*) > 1)
        ), opened AS (
            SELECT doc_id, p, (p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400) IS NOT TRUE AS opens FROM repeated
        ), runs AS (
            SELECT doc_id, p, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM opened
        ), spans AS (
            SELECT doc_id, run, min(p) AS s, max(p) + 400 AS e FROM runs GROUP BY doc_id, run
        ), pieces AS (
            SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS s, s AS e FROM spans
            UNION ALL SELECT b.doc_id, coalesce(max(x.e), 0), b.n_bytes FROM bytes b LEFT JOIN spans x USING (doc_id)
            GROUP BY b.doc_id, b.n_bytes
        ), kept AS (
            SELECT doc_id, string_agg(substring(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k
            FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n_bytes, n_bytes - strlen(k) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM bytes JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) USING (doc_id)
    """,
    # the CRC takes each byte, then eight steps (marked -1) over its bits
    "op2_sharding": """
        WITH sized AS (
            SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM documents
        ), summed AS (
            SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                    regexp_extract_all(hex(encode(t)), '..'),
                    lambda x: [('0x' || x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda c, b: CASE WHEN b >= 0 THEN xor(c, b)
                    WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
                4294967295::BIGINT)::BIGINT AS text_crc32
            FROM sized
        ), placed AS (
            SELECT *, sum(size) OVER () AS total,
                sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM summed
        ), cut AS (
            SELECT *, least(7, ((2 * upto - size) * 8) // (2 * total))::INTEGER AS shard FROM placed
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
            NULL::INTEGER AS grown_shard
        FROM cut
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM split
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), smallest AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept, doc_id = component_id AS row_kept
        FROM sets JOIN smallest USING (doc_id)
    """,
    "op6_license_scan": license_scan.oracle_sql(),
    "op5_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM normal
    """,
}
