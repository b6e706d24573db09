"""Seq: all operators together, with snake_case names beside the PascalCase ones and an async face."""

from __future__ import annotations

import asyncio
import re
import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from seqloom.operators.combine import Combine
from seqloom.operators.lazy import Lazy
from seqloom.operators.terminals import Terminals
from seqloom.plans.order import ORD


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


class Seq(Lazy, Combine, Terminals):
    """An ordered, lazy sequence over a DataFrame."""

    def pipe(self, transform):
        return transform(self)

    def as_async(self) -> "AsyncSeq":
        return AsyncSeq(self)


for _name in [n for n in dir(Seq) if re.match(r"[A-Z]", n)]:
    if not hasattr(Seq, _snake(_name)):
        setattr(Seq, _snake(_name), getattr(Seq, _name))


def register(name: str, func: Callable, replace: bool = False) -> None:
    """Adds an operator to all sequences: func(seq, ...), under the PascalCase name and its snake_case form. What gives
    a Seq is lazy; what gives anything else is a terminal, with an Async form on AsyncSeq."""
    if not re.fullmatch(r"[A-Z][A-Za-z0-9]*", name):
        raise ValueError(f"an operator's name is in PascalCase, not {name!r}")
    for n in (name, _snake(name)):
        if hasattr(Seq, n) and not replace:
            raise ValueError(f"there is an operator {n} already")
    for n in (name, _snake(name)):
        setattr(Seq, n, func)


class LateSeq(Seq):
    """A sequence that is planned only when its rows are read."""

    def __init__(self, source: Seq, kind: str, detail=None):
        self._source, self._built = source, None
        self._log, self._chain, self._contiguous = (*source._log, (kind, detail)), 0, False

    def _build(self):
        raise NotImplementedError

    def _plan(self):
        if self._built is None:
            self._built = self._build()
        return self._built

    @property
    def _df(self):
        return self._plan()[0]

    @property
    def _keys(self):
        return self._plan()[1]


class GroupedSeq(LateSeq):
    """What GroupBy gives: Agg() never builds the groups' arrays."""

    def __init__(self, source: Seq, key, element):
        super().__init__(source, "groupBy")
        self._key, self._element = key, element

    def _build(self):
        s, seen, at = self._source._first_seen()
        s, items = s._in_order(s._col(self._element))
        df = s._df.groupBy(s._col(self._key).alias("key")).agg(seen, items.alias("elements"))
        return df.select("key", "elements", at.name), [at]


class SkippedSeq(LateSeq):
    """What Skip gives: all items but the first ones, by position, so no task gets them all. With a Take the two are a
    range, which near the start needs no positions."""

    def __init__(self, source: Seq, count: int):
        super().__init__(source, "skip", count)
        self._count = count

    def _build(self):
        s = self._source._ordinal()
        return s._df.filter(F.col(ORD) >= self._count), s._keys

    def Take(self, count: int):
        s, df = self._source._range(self._count, count)
        out = s._with(df, "take", detail=count)
        out._log = (*self._log, ("take", count))
        return out

    take = Take


class AsyncSeq:
    """Lazy operators return another AsyncSeq; `<Terminal>Async` runs the job in a thread.

    Cancelling the awaiting task cancels the Spark job by its tag.
    """

    def __init__(self, seq: Seq):
        self._seq = seq

    def __getattr__(self, name: str):
        if name.endswith("Async"):
            return lambda *a, **k: self._run(getattr(self._seq, name[:-5]), *a, **k)
        target = getattr(self._seq, name)
        if not callable(target):
            return target

        def call(*a, **k):
            a = [x._seq if isinstance(x, AsyncSeq) else x for x in a]
            out = target(*a, **k)
            return AsyncSeq(out) if isinstance(out, Seq) else out

        return call

    async def _run(self, func, *a, **k):
        tag, spark = f"seqloom-{uuid.uuid4().hex}", self._seq.spark
        a = [x._seq if isinstance(x, AsyncSeq) else x for x in a]

        def tagged():
            spark.addTag(tag)
            try:
                return func(*a, **k)
            finally:
                spark.removeTag(tag)

        try:
            return await asyncio.to_thread(tagged)
        except asyncio.CancelledError:
            spark.interruptTag(tag)
            raise

    def __aiter__(self):
        async def items():
            it, end = iter(self._seq), object()
            while (x := await asyncio.to_thread(next, it, end)) is not end:
                yield x

        return items()
