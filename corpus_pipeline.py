"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, mixing, ngram_join, quality, token_files
from seqloom.llm.common import Work, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and boilerplate lines from the others."""
    judged = quality.judge(docs).filter("kept")
    return _with_text(judged.withColumn("text", F.col("text_left")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id, a null id last. Shingles of five words, similarity 0.8.

    Rows are told apart by a written number of their own, so rows that link with nothing stay, whatever their id.
    """
    work = Work(spark, "pipeline-ngrams")
    rows = work.table("rows", docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    found = ngram_join.near_duplicates(rows.select("row", "text"), work, width=5, percent=80, id_column="row")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    named = found.select(F.col("doc_id").alias("found_row"), "component_id").join(rows.select("row", "doc_id"), F.col("found_row") == F.col("row"))
    keep = work.table("keep", named.groupBy("component_id").agg(F.min(place)["row"].alias("keep_row")))
    return rows.join(small(keep.select("keep_row")), F.col("row") == F.col("keep_row"), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a text of which no word is left goes."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS, cut=True)
    return _with_text(found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target shares of their sources, in a global shuffle."""
    return mixing.mix(docs).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files, which stay in the shared folder, and returns their index."""
    import public_tokenizers

    work = Work(spark, "pipeline-tokens", keep=True)
    token_files.write_tokens(docs, work, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_index(spark, work)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing_to_weights), ("token-ID output", token_output)]

#: SQL cannot express the stages (shingle components, byte-pair encoding): tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Work(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        docs = work.table(f"stage{n}", stage(spark, docs, sf_dir))
    return docs
