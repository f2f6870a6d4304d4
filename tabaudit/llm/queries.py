"""One query an operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Only for these queries; a deployment passes a key of its own.
PII_KEY = b"example key of the queries"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import edited_fingerprints

    return edited_fingerprints(_docs(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces
    from .store import work_dir

    return pack(pieces(_docs(spark, sf_dir), vocabulary_path("word_bpe_49k.json")), work_dir(spark, "packing"))


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(_docs(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(_docs(spark, sf_dir).select("doc_id", "text", "lang"), labels).drop("text")


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import audio_features

    return audio_features(_docs(spark, sf_dir), keep=False).drop("spans")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), width=3, percent=85)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import work_dir
    from .token_files import read_token_digests, write_token_files

    folder = work_dir(spark, "token-files")
    index = write_token_files(_docs(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), folder)
    return read_token_digests(index, folder)


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(_docs(spark, sf_dir))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(_docs(spark, sf_dir).select("doc_id", "text"), PII_KEY)


#: Shingles, their overlaps and what is reachable by links, over all documents; DuckDB takes some ten seconds for 1,000 of them.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n_shingles + q.n_shingles - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT r.doc_id, any_value(n_shingles) AS n_shingles, min(reach) AS component_id, min(reach) = r.doc_id AS kept FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_merkle_fingerprints, op3_packing, op4_sampled_pieces, op5_quality, op6_audio, op7_near_dedup, op8_token_files, op9_katz_scores, op10_pseudonyms)}


def oracle_sql() -> dict[str, str]:
    return {"op7_near_dedup": NEAR_DEDUP_SQL}
