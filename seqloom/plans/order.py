"""Order specifications and contiguous ordinals.

A sequence keeps its order as hidden columns plus directions; nothing is sorted until an operator needs
positions or a terminal returns rows.
"""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = "__sl_"
ORD = f"{HIDDEN}ord"
#: Plans estimated above this many bytes (compressed ones, where files are read) get the distributed ordinal instead
#: of a one-partition window.
ONE_TASK_BYTES = 32 << 20
#: What a row counts where only rows can be counted.
ROW_BYTES = 32
#: Rows in a block of the two-level running aggregates.
BLOCK_ROWS = 1 << 20

_numbers = itertools.count()


def fresh(kind: str = "k") -> str:
    return f"{HIDDEN}{kind}{next(_numbers)}"


@dataclass(frozen=True)
class Key:
    """One sort key: the hidden column that holds it, its direction and where nulls go."""

    name: str
    asc: bool = True
    nulls_first: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        if self.asc:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()

    def flipped(self) -> "Key":
        return Key(self.name, not self.asc, not self.nulls_first)


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return True


def packed(keys: list[Key]) -> tuple[Column, bool] | None:
    """The keys as one struct that compares as they do, ascending or (False) descending; None where directions are
    mixed or there are no keys."""
    if not keys or len({k.asc for k in keys}) > 1:
        return None
    up = keys[0].asc
    parts = []
    for k in keys:
        # a struct compares field by field with nulls smallest, so null placement is a field of its own
        late = F.col(k.name).isNull() if up != k.nulls_first else F.col(k.name).isNotNull()
        parts += [late, F.col(k.name)]
    return F.struct(*[p.alias(f"f{i}") for i, p in enumerate(parts)]), up


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_ordinal(df: DataFrame, keys: list[Key], one_task_bytes: int | None = None) -> DataFrame:
    """Adds ORD, the 0-based position in the given order.

    Small inputs use one window. Larger ones are range-sorted once and written, after which each row's position is
    its partition's offset plus its place in the partition; only the per-partition counts meet in one task.
    """
    order = [k.column() for k in keys] or [F.monotonically_increasing_id()]
    if small_plan(df, one_task_bytes):
        return df.withColumn(ORD, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    at, pid, offset = fresh("m"), fresh("p"), fresh("s")
    fixed = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    fixed = fixed.withColumn(pid, F.shiftright(at, 33))
    totals = fixed.groupBy(pid).agg(F.count("*").alias("n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(pid, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    # one row for each partition: bounded by the partition count, not by the data
    return fixed.join(F.broadcast(totals), pid).withColumn(ORD, F.col(offset) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, pid, offset)


def small_plan(df: DataFrame, most: int | None = None) -> bool:
    """Whether one task may sort the frame: by Catalyst's estimate, and where the plan makes rows that the estimate
    does not see (exploded arrays, Python functions), by a count that stops at as many rows."""
    most = ONE_TASK_BYTES if most is None else most
    if estimated_bytes(df) > most:
        return False
    if not re.search(r"\b(Generate|MapIn\w+|FlatMap\w+) ", df._jdf.queryExecution().optimizedPlan().toString()):
        return True
    rows = max(1, most // ROW_BYTES)
    return df.limit(rows + 1).count() <= rows


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, gone when the driver ends: a lost executor costs nothing
    that came before it. Types that Parquet lacks are checkpointed instead."""
    spark = df.sparkSession
    try:
        path = temporary(spark, f"seqloom-{uuid.uuid4().hex}")
    except RuntimeError:
        path = None
    if path is None or any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema.fields):
        ensure_checkpoint_dir(df)
        return df.checkpoint(eager=True)
    df.write.parquet(f"{path}/table")
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def shared_folder(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where all tasks run here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/seqloom-checkpoints"


def temporary(spark, name: str) -> str:
    """A new folder in the shared one, which Hadoop deletes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def ensure_checkpoint_dir(df: DataFrame) -> None:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def running(df: DataFrame, name: str, kind: str, value: Column, block: int = BLOCK_ROWS) -> DataFrame:
    """Adds a running aggregate over ORD in two levels: inside blocks of rows, then over block totals."""
    if kind == "count":
        value = F.lit(1).cast("long")
    fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[kind]
    b, own, tot, pre = fresh("b"), fresh("v"), fresh("t"), fresh("c")
    df = df.withColumn(b, F.floor(F.col(ORD) / block)).withColumn(own, value)
    inside = Window.partitionBy(b).orderBy(ORD).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(name, fold(own).over(inside))
    earlier = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(b).agg(fold(own).alias(tot)).select(b, fold(tot).over(earlier).alias(pre))
    df = df.join(carry, b, "left")
    if kind in ("sum", "count"):
        total = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(pre), F.lit(0))
    else:
        total = (F.least if kind == "min" else F.greatest)(name, pre)
    return df.withColumn(name, total).drop(b, own, pre)
