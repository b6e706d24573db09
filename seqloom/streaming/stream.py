"""Sequences over Structured Streaming.

Stateless operators and keyed counts run as streaming plans. What needs positions or a sort is defined on a
micro-batch (for_each_batch), or by landing the stream in a table and running as batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.seq import Seq


class StreamSeq:
    def __init__(self, df: DataFrame):
        self.df = df

    def _via(self, op: str, *a) -> "StreamSeq":
        return StreamSeq(getattr(Seq(self.df), op)(*a).df)

    def Where(self, predicate) -> "StreamSeq":
        return self._via("Where", predicate)

    def Select(self, selector) -> "StreamSeq":
        return self._via("Select", selector)

    def SelectMany(self, selector) -> "StreamSeq":
        return StreamSeq(self.df.select(F.explode(Seq(self.df)._col(selector)).alias("value")))

    def OfType(self, guard=None) -> "StreamSeq":
        return self._via("OfType", guard)

    def Cast(self, schema=None) -> "StreamSeq":
        return self._via("Cast", schema)

    def Take(self, count: int) -> "StreamSeq":
        return StreamSeq(self.df.limit(count))

    def with_watermark(self, column: str, delay: str) -> "StreamSeq":
        return StreamSeq(self.df.withWatermark(column, delay))

    def DistinctBy(self, *columns: str) -> "StreamSeq":
        """One item for each key, whichever arrives first. Without a watermark on one of them, state grows."""
        return StreamSeq(self.df.dropDuplicates(list(columns)))

    def CountBy(self, *columns: str) -> "StreamSeq":
        return StreamSeq(self.df.groupBy(*columns).agg(F.count("*").alias("count")))

    def Join(self, other: "StreamSeq | DataFrame", on) -> "StreamSeq":
        return StreamSeq(self.df.join(getattr(other, "df", other), on))

    def for_each_batch(self, func: Callable[[Seq, int], None], checkpoint: str, order_by=None, **trigger):
        """Runs func on each micro-batch as an ordered sequence."""
        trigger = trigger or {"availableNow": True}
        return self.df.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(lambda b, n: func(Seq.of(b, order_by), n)).start()

    def to_table(self, name: str, mode: str = "append", **trigger):
        """A query into a memory table, for tests and small results."""
        return self.df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def from_readable_stream(df: DataFrame) -> StreamSeq:
    return StreamSeq(df)


def to_readable_stream(seq: Seq) -> Iterator:
    """Rows in order, fetched partition by partition as they are consumed."""
    return iter(seq)
