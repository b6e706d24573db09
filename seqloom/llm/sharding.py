"""Contiguous shards of near equal bytes from prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import Work, tasks


def shard_by_bytes(docs: DataFrame, work: Work, n_shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row.

    Rows go by ascending id, nulls first, then size and checksum. A row's size is its text's UTF-8 bytes plus 1
    (null: none, so 1). A shard is the stretch of the total that holds the row's middle byte, so each shard's
    sum is within one row of the target; empty shards occur only where there are too few rows. Equal texts
    are not kept together: their groups may hold a third of all rows, which no equal cut could keep whole.
    Rows are range-partitioned once and written; only one total for each partition meets in one task.
    """
    text = F.col(f"`{text_column}`")
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    parts = tasks(docs)
    # the last key only splits repeats of one row, which are alike
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ["doc_id", "size", "text_crc32", "tie"]
    rows = work.table("rows", rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    whole = rows.agg(F.sum("size").alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # as many rows as partitions
    placed = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside)).join(F.broadcast(totals), "part").crossJoin(F.broadcast(whole))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(({middle_sql()}) * {n_shards}) div (2 * total)")).cast("int")).withColumn("ordinal", F.col("rows_before") + F.col("nth") - 1)
    first = placed.groupBy("shard").agg(F.min("ordinal").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # as many rows as shards
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ordinal") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def middle_sql() -> str:
    """Twice the offset of a row's middle byte."""
    return "2 * CAST(bytes_before + upto AS DECIMAL(30,0)) - size"


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in shards 0 to 7 by bytes."""
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark, "sharding"))

