"""Left folds by Python functions: one streaming pass over sorted rows, with nothing but the accumulator in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.plans.exprs import Py


def result_type(func: Py) -> T.DataType:
    return T._parse_datatype_string(func.returns) if isinstance(func.returns, str) else func.returns


def scan(rows: DataFrame, value: Column, order: list[Column], seed, func: Py, at: str, last: bool = False) -> DataFrame:
    """The accumulator after each row as `value`, with its position, the seed at 0; or the last one only. A fold has to
    see rows in their order, so one task reads the sorted partitions one after the other."""
    call, kind = func.func, result_type(func)
    arrow = to_arrow_type(kind)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, n = seed, 0
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                acc = call(acc, v)
                out.append(acc)
            if not last:
                yield pa.record_batch([pa.array(out, arrow), pa.array(range(n + 1, n + 1 + len(out)), pa.int64())], ["value", at])
            n += len(out)
        if last:
            yield pa.record_batch([pa.array([acc], arrow), pa.array([n], pa.int64())], ["value", at])

    start = rows.sparkSession.range(1).select(F.lit(seed).cast(kind).alias("value"), F.lit(0).cast("long").alias(at))
    ordered = rows.orderBy(*order).select(value.alias("value")).coalesce(1)
    out = start.union(ordered.mapInArrow(step, T.StructType([T.StructField("value", kind), T.StructField(at, T.LongType())])))
    return out.agg(F.max_by("value", at).alias("value")) if last else out


def by_key(rows: DataFrame, key: Column, value: Column, first: Column, up: bool, seed, func: Py, at: str) -> DataFrame:
    """key, value (the group's last accumulator) and the place of its first row. Rows are sorted by key and place, so a
    group of any size passes through one accumulator. A callable seed gets the group's first item."""
    call, kind = func.func, result_type(func)
    arrow = to_arrow_type(kind)

    def group(schema: pa.Schema, done: list) -> pa.RecordBatch:
        cols = [pa.array([d[k] for d in done], t) for k, t in enumerate((schema.field("key").type, arrow, schema.field(at).type))]
        return pa.record_batch(cols, ["key", "value", at])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None  # key, accumulator, place
        for b in batches:
            done, schema = [], b.schema
            for k, v, o in zip(*(b.column(c).to_pylist() for c in ("key", "item", at))):
                if now is None or (k != now[0] and not (k != k and now[0] != now[0])):
                    if now is not None:
                        done.append(now)
                    now = (k, seed(v) if callable(seed) else seed, o)
                now = (now[0], call(now[1], v), now[2])
            if done:
                yield group(schema, done)
        if now is not None:
            yield group(schema, [now])

    plain = rows.select(key.alias("key"), value.alias("item"), first.alias(at))
    kinds = plain.schema
    plain = plain.repartition("key").sortWithinPartitions("key", F.col(at).asc() if up else F.col(at).desc())
    return plain.mapInArrow(step, T.StructType([kinds["key"], T.StructField("value", kind), kinds[at]]))
