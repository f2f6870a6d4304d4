"""From raw documents to packed sequences: quality, line dedup, near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of `documents`; the last
returns the packed pieces. Stages are written as Parquet and read again, so a lost executor costs a stage's tasks at most.

  quality      documents that the classifier rejects go
  lines        repeated lines, exact or fuzzy, go from all but the first place; a document may be left with an empty text
  near_dedup   of each group of near copies (five words, 0.8) the document with the smallest doc_id stays
  pii          validated personal data and secrets become pseudonyms
  packing      texts are cut and packed into sequences of at most 4096 ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.lines import dedup_lines
from tabaudit.llm.near_dedup import near_duplicates
from tabaudit.llm.packing import pack, pieces
from tabaudit.llm.pii import pseudonymise
from tabaudit.llm.quality import classify
from tabaudit.llm.queries import PII_KEY, vocabulary_path
from tabaudit.llm.store import save, small_side, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs.select(COLUMNS), labels).where("accepted").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(dedup_lines(docs.select(COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, width=5, percent=80)
    gone = save(found.where("not kept").select("doc_id").distinct(), work_dir(spark, "gone"), "ids")
    return docs.select(COLUMNS).join(small_side(gone), "doc_id", "left_anti").select(COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(pseudonymise(docs.select(COLUMNS), PII_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, vocabulary_path("word_bpe_49k.json")), work_dir(spark, "packing"))


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL has no tokenizer, no edit distance of all lines and no language model; no test runs the stages yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
