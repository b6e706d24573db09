"""Sequences from rows, ranges, files and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.base import _kind_of
from seqloom.operators.seq import AsyncSeq, Seq
from seqloom.plans.order import HIDDEN, Key

_AT = f"{HIDDEN}at"


def from_rows(spark: SparkSession, rows: Iterable, schema=None) -> Seq:
    """Rows in the given order; plain values become the one column `value`."""
    rows = list(rows)
    plain = not rows or not isinstance(rows[0], (tuple, dict, list)) if schema is None else isinstance(schema, str) and " " not in schema.strip()
    if plain:
        rows, schema = [(r,) for r in rows], f"value {schema or _kind_of(rows)}"
    df = spark.createDataFrame(rows, schema)
    names = df.columns
    packed = spark.createDataFrame([(n, *([r.get(c) for c in names] if isinstance(r, dict) else r)) for n, r in enumerate(rows)], df.schema.__class__([_at_field(), *df.schema.fields]))
    return Seq(packed, [Key(_AT)], (("from", None),))


def _at_field():
    from pyspark.sql import types as T

    return T.StructField(_AT, T.LongType())


def from_df(df: DataFrame, order_by: list | None = None) -> Seq:
    return Seq.of(df, order_by)


def from_async(df: DataFrame, order_by: list | None = None) -> AsyncSeq:
    return AsyncSeq(Seq.of(df, order_by))


def empty(spark: SparkSession, schema="value long") -> Seq:
    return Seq.of(spark.createDataFrame([], schema))


def range_(spark: SparkSession, start: int, count: int) -> Seq:
    if count < 0:
        raise ValueError("count must not be negative")
    return Seq.of(spark.range(start, start + count).select(F.col("id").alias("value")), ["value"])


def repeat(spark: SparkSession, value, count: int) -> Seq:
    if count < 0:
        raise ValueError("count must not be negative")
    return Seq(spark.range(count).select(F.lit(value).alias("value"), F.col("id").alias(_AT)), [Key(_AT)], (("from", None),))


def pipe(df: DataFrame, transform: Callable[[Seq], object]):
    return transform(Seq.of(df))


def read(spark: SparkSession, path: str, format: str = "parquet", order_by: list | None = None, **options) -> Seq:
    """Any format that Spark reads; filters and column choices reach the scan."""
    return Seq.of(spark.read.format(format).options(**options).load(path), order_by)


def write(seq: Seq, path: str, format: str = "parquet", mode: str = "errorifexists", ordered: bool = False, **options) -> None:
    (seq.ordered_df() if ordered else seq.df).write.format(format).mode(mode).options(**options).save(path)


#: The constructors are on the classes too: Seq.from_rows(spark, ...), AsyncSeq.range(spark, ...).
for _name, _make in {"from_rows": from_rows, "from_df": from_df, "empty": empty, "range": range_, "repeat": repeat, "read": read}.items():
    setattr(Seq, _name, staticmethod(_make))
    setattr(AsyncSeq, _name, staticmethod(lambda *a, _make=_make, **k: AsyncSeq(_make(*a, **k))))
