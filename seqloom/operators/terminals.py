"""Terminals. X() runs and returns a Python value; x_df() gives the same as a DataFrame, without running."""

from __future__ import annotations

import threading
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.errors import AbortedError, ArgumentOutOfRangeError, EmptySequenceError, InvalidOperationError, MoreThanOneElementError
from seqloom.functions.pagination import CursorPage, clamp_page_size, create_page_result, parse_cursor
from seqloom.operators.base import Base
from seqloom.plans.exprs import Py, arity
from seqloom.plans.folds import scan
from seqloom.plans.order import ORD, Key, small_plan, with_ordinal

_NOTHING = object()


def _value(row):
    d = row.asDict()
    return d["value"] if list(d) == ["value"] else row


class Lookup:
    """A multi-map: a missing key gives an empty group."""

    def __init__(self, groups: dict):
        self._groups = groups

    def get(self, key) -> list:
        return self._groups.get(key, [])

    def contains(self, key) -> bool:
        return key in self._groups

    @property
    def count(self) -> int:
        return len(self._groups)

    def __iter__(self):
        return iter(self._groups.items())


class Terminals(Base):
    def _filtered(self, predicate):
        return self if predicate is None else self.Where(predicate)

    # -- rows ------------------------------------------------------------------------------------------------
    def ToArray(self) -> list:
        return [_value(r) for r in self.ordered_df().collect()]

    def ToList(self) -> list:
        return self.ToArray()

    def __iter__(self):
        return (_value(r) for r in self.ordered_df().toLocalIterator(prefetchPartitions=True))

    def ForEach(self, action, concurrency: int = 1, signal=None) -> None:
        """action(item) or action(item, position), in order on the driver, one row at a time; or with a concurrency in
        as many tasks at most on the executors. A signal is anything with is_set(); once it is set, AbortedError ends
        the call."""
        indexed = arity(action) > 1
        if concurrency > 1:
            self._for_each_in_tasks(action, indexed, concurrency, signal)
            return
        for n, item in enumerate(self):
            if signal is not None and signal.is_set():
                raise AbortedError("the signal was set")
            action(item, n) if indexed else action(item)

    def _for_each_in_tasks(self, action, indexed: bool, concurrency: int, signal) -> None:
        s, names = self._ordinal() if indexed else self, self.columns
        df = s._df.select(*s._visible(), *([ORD] if indexed else []))

        def act(rows):
            for r in rows:
                item = r["value"] if names == ["value"] else Row(**{c: r[c] for c in names})
                action(item, r[ORD]) if indexed else action(item)

        tag, over, context = f"seqloom-{uuid.uuid4().hex}", threading.Event(), s.spark.sparkContext

        def watch():
            while not over.wait(0.2):
                if signal.is_set():
                    context.cancelJobsWithTag(tag)

        context.addJobTag(tag)
        if signal is not None:
            threading.Thread(target=watch, daemon=True).start()
        try:
            df.coalesce(concurrency).foreachPartition(act)
        except Exception as e:
            if signal is not None and signal.is_set():
                raise AbortedError("the signal was set") from e
            raise
        finally:
            over.set()
            context.removeJobTag(tag)

    def to_set_df(self) -> DataFrame:
        return self.df.distinct()

    def ToSet(self) -> set:
        return {_value(r) for r in self.to_set_df().collect()}

    def ToHashSet(self) -> set:
        return self.ToSet()

    # -- one element -----------------------------------------------------------------------------------------
    def first_df(self, predicate=None) -> DataFrame:
        return self._filtered(predicate).Take(1).df

    def last_df(self, predicate=None) -> DataFrame:
        return self._filtered(predicate).Reverse().Take(1).df

    def single_df(self, predicate=None) -> DataFrame:
        return self._filtered(predicate).df.limit(2)

    def element_at_df(self, index: int) -> DataFrame:
        return self.Skip(index).Take(1).df

    def min_by_df(self, key) -> DataFrame:
        return self._best(key, False).df

    def max_by_df(self, key) -> DataFrame:
        return self._best(key, True).df

    def _best(self, key, desc):
        # nulls are smallest; ties go to the first item
        return self._with(self._df, "best").OrderBy(key, descending=desc, nulls="last" if desc else "first").Take(1)

    @staticmethod
    def _one(df: DataFrame, default=_NOTHING, most: bool = False):
        rows = df.collect()
        if most and len(rows) > 1:
            raise MoreThanOneElementError("expected one element, found more")
        if rows:
            return _value(rows[0])
        if default is _NOTHING:
            raise EmptySequenceError("expected an element, found none")
        return default

    def First(self, predicate=None):
        return self._one(self.first_df(predicate))

    def FirstOrDefault(self, default=None, predicate=None):
        return self._one(self.first_df(predicate), default)

    def FirstOrThrow(self, predicate=None):
        return self.First(predicate)

    def Last(self, predicate=None):
        return self._one(self.last_df(predicate))

    def LastOrDefault(self, default=None, predicate=None):
        return self._one(self.last_df(predicate), default)

    def LastOrThrow(self, predicate=None):
        return self.Last(predicate)

    def Single(self, predicate=None):
        return self._one(self.single_df(predicate), most=True)

    def SingleOrDefault(self, default=None, predicate=None):
        return self._one(self.single_df(predicate), default, most=True)

    def SingleOrThrow(self, predicate=None):
        return self.Single(predicate)

    def ElementAt(self, index: int):
        if index < 0 or not (rows := self.element_at_df(index).collect()):
            raise ArgumentOutOfRangeError(f"Index {index} is out of range")
        return _value(rows[0])

    def ElementAtOrDefault(self, index: int, default=None):
        return default if index < 0 else self._one(self.element_at_df(index), default)

    def MinBy(self, key):
        return self._one(self.min_by_df(key))

    def MaxBy(self, key):
        return self._one(self.max_by_df(key))

    # -- truth -----------------------------------------------------------------------------------------------
    def any_df(self, predicate=None) -> DataFrame:
        s = self._filtered(predicate)
        return s._df.limit(1).agg((F.count("*") > 0).alias("value"))

    def all_df(self, predicate) -> DataFrame:
        bad = self._df.filter(~F.coalesce(self._col(predicate).cast("boolean"), F.lit(False)))
        return bad.limit(1).agg((F.count("*") == 0).alias("value"))

    def contains_df(self, value, comparer=None) -> DataFrame:
        c = self._item()
        want = F.struct(*[F.lit(value[n]).cast(f.dataType).alias(n) for n, f in zip(self.columns, self.schema.fields)]) if isinstance(value, dict) else F.lit(value)
        c, want = (comparer(c), comparer(want)) if comparer else (c, want)
        return self._df.filter(c.eqNullSafe(want)).limit(1).agg((F.count("*") > 0).alias("value"))

    def sequence_equal_df(self, second, comparer=None) -> DataFrame:
        a, b = self._ordinal(), self._other(second)._ordinal()
        norm = comparer or (lambda c: c)
        left = a._df.select(ORD, norm(a._item()).alias("a"), F.lit(True).alias("pa"))
        right = b._df.select(ORD, norm(b._item()).alias("b"), F.lit(True).alias("pb"))
        bad = F.col("pa").isNull() | F.col("pb").isNull() | ~F.col("a").eqNullSafe(F.col("b"))
        return left.join(right, ORD, "full").filter(bad).limit(1).agg((F.count("*") == 0).alias("value"))

    def Any(self, predicate=None) -> bool:
        return self.any_df(predicate).head()[0]

    def All(self, predicate) -> bool:
        return self.all_df(predicate).head()[0]

    def Contains(self, value, comparer=None) -> bool:
        return self.contains_df(value, comparer).head()[0]

    def SequenceEqual(self, second, comparer=None) -> bool:
        return self.sequence_equal_df(second, comparer).head()[0]

    # -- numbers ---------------------------------------------------------------------------------------------
    def count_df(self, predicate=None) -> DataFrame:
        return self._filtered(predicate)._df.agg(F.count("*").alias("value"))

    def _exact(self, c: Column) -> Column:
        """A sum without rounding drift; nulls count as 0.

        Each double goes one way: with up to 4 decimals as a whole number of units, with up to 12 as a decimal, both
        added exactly, and as itself where neither gives it back (very small, very large, NaN). Where an exact sum
        runs over, the plain one stands in.
        """
        kind = self._df.select(c.alias("c")).schema["c"].dataType
        if not isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.coalesce(F.sum(c), F.lit(0))
        c = c.cast("double")
        yes = lambda x: F.coalesce(x, F.lit(False))
        units = F.when(F.abs(c) < 9e11, F.rint(c * 10000.0).cast("long"))
        fine = yes(units / F.lit(10000.0) == c)
        exact = F.when(~fine & (F.abs(c) < 1e18), c.cast("decimal(38,12)"))
        near = yes(exact.cast("double") == c)
        a, b = F.try_sum(F.when(fine, units)), F.try_sum(F.when(near, exact))
        over = (a.isNull() & (F.count_if(fine) > 0)) | (b.isNull() & (F.count_if(near) > 0))
        whole = (a.cast("decimal(20,0)") * F.lit(Decimal("0.0001"))).cast("double")
        parts = [F.coalesce(x, F.lit(0.0)) for x in (whole, b.cast("double"), F.sum(F.when(~fine & ~near, c)))]
        return F.when(over, F.sum(c)).otherwise(parts[0] + parts[1] + parts[2])

    def sum_df(self, selector=None) -> DataFrame:
        return self._df.agg(self._exact(self._col(selector)).alias("value"))

    def average_df(self, selector=None) -> DataFrame:
        return self._df.agg(F.try_divide(self._exact(self._col(selector)).cast("double"), F.count("*")).alias("value"))

    def min_df(self, selector=None) -> DataFrame:
        return self._df.agg(F.min(self._col(selector)).alias("value"))

    def max_df(self, selector=None) -> DataFrame:
        return self._df.agg(F.max(self._col(selector)).alias("value"))

    def median_df(self, selector=None, null_as_zero: bool = False) -> DataFrame:
        return self.percentile_df(50, selector, null_as_zero)

    def percentile_df(self, p: float, selector=None, null_as_zero: bool = False) -> DataFrame:
        if not 0 <= p <= 100:
            raise ArgumentOutOfRangeError("percentile must lie between 0 and 100")
        c = self._col(selector)
        values = self._df.select((F.coalesce(c, F.lit(0)) if null_as_zero else c).cast("double").alias("value"))
        if small_plan(values):
            return values.agg(F.percentile("value", p / 100).alias("value"))
        # by rank: no task holds all values
        ranked = with_ordinal(values.filter("value IS NOT NULL"), [Key("value")])
        at = ranked.agg(((F.count("*") - 1) * (p / 100)).alias("at"))
        beside = ranked.crossJoin(F.broadcast(at)).filter(F.col(ORD).between(F.floor("at"), F.ceil("at")))
        share = F.max(F.col("at") - F.floor("at"))
        return beside.agg((F.min("value") * (1 - share) + F.max("value") * share).alias("value"))

    def mode_df(self, key=None) -> DataFrame:
        s, seen, at = self._first_seen()
        df = s._df.groupBy(s._col(key).alias("value")).agg(F.count("*").alias("n"), seen)
        return df.orderBy(F.desc("n"), at.column()).limit(1).select("value")

    def Count(self, predicate=None) -> int:
        return self.count_df(predicate).head()[0]

    def LongCount(self) -> int:
        return self.Count()

    def Sum(self, selector=None):
        return self.sum_df(selector).head()[0]

    def _number(self, df: DataFrame):
        value = df.head()[0]
        if value is None and not self.Any():
            raise EmptySequenceError("expected an element, found none")
        return value

    def Min(self, selector=None):
        return self._number(self.min_df(selector))

    def Max(self, selector=None):
        return self._number(self.max_df(selector))

    def Average(self, selector=None):
        return self._number(self.average_df(selector))

    def Median(self, selector=None, null_as_zero=False):
        return self._number(self.median_df(selector, null_as_zero))

    def Percentile(self, p, selector=None, null_as_zero=False):
        return self._number(self.percentile_df(p, selector, null_as_zero))

    def Mode(self, key=None):
        rows = self.mode_df(key).collect()
        if not rows:
            raise EmptySequenceError("expected an element, found none")
        return rows[0][0]

    # -- folds -----------------------------------------------------------------------------------------------
    def aggregate_df(self, seed, func, of=None) -> DataFrame:
        """func: "sum", "count", "min", "max" (parallel), py(lambda acc, item: ..., type) in one streaming pass, or a
        Column lambda (acc, item) over the ordered array."""
        if isinstance(func, Py):
            return scan(self._df, self._col(of), [k.column() for k in self._keys], seed, func, ORD, last=True)
        c = self._col(of)
        if isinstance(func, str):
            whole = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[func](c)
            zero = F.lit(seed)
            both = zero + F.coalesce(whole, F.lit(0)) if func in ("sum", "count") else (F.least if func == "min" else F.greatest)(zero, whole)
            return self._df.agg(both.alias("value"))
        s = self._ordinal()
        a = F.sort_array(F.collect_list(F.struct(F.col(ORD).alias("o"), s._col(of).alias("v"))))
        return s._df.agg(a.alias("a")).select(F.aggregate("a", F.lit(seed), lambda acc, x: func(acc, x["v"])).alias("value"))

    def Aggregate(self, seed, func, of=None):
        """A left fold. A plain Python function of (acc, item[, index]) runs on the driver over the ordered rows; given as
        py(func, type) it runs in a task."""
        if isinstance(func, (str, Py)):
            return self.aggregate_df(seed, func, of).head()[0]
        acc, indexed = seed, arity(func) > 2
        for n, item in enumerate(self if of is None else self.Select(of)):
            acc = func(acc, item, n) if indexed else func(acc, item)
        return acc

    def Reduce(self, *args, of=None):
        """Reduce(func) starts from the first item; Reduce(seed, func) from the seed. As in Aggregate, a named func runs
        in parallel and a Python function on the driver over the ordered rows."""
        if len(args) == 2:
            return self.Aggregate(args[0], args[1], of)
        items = iter(self if of is None else self.Select(of))
        acc = next(items, _NOTHING)
        if acc is _NOTHING:
            raise EmptySequenceError("nothing to reduce, and no seed")
        func, indexed = args[0], arity(args[0]) > 2
        for n, item in enumerate(items, 1):
            acc = func(acc, item, n) if indexed else func(acc, item)
        return acc

    # -- maps ------------------------------------------------------------------------------------------------
    def dictionary_df(self, key, element=None) -> DataFrame:
        return self._df.select(self._col(key).alias("key"), self._col(element).alias("element"))

    def ToDictionary(self, key, element=None) -> dict:
        s = self._with(self._df.select(self._col(key).alias("key"), self._col(element).alias("element"), *self._hidden()), "toDictionary")
        out: dict = {}
        for r in s.ordered_df().toLocalIterator():
            if r["key"] in out:
                raise InvalidOperationError(f"Duplicate key: {r['key']}")
            out[r["key"]] = r["element"]
        return out

    def ToMap(self, key, element=None) -> dict:
        return self.ToDictionary(key, element)

    def ToObject(self, key, element=None) -> dict:
        return {str(k): v for k, v in self.ToDictionary(key, element).items()}

    def ToLookup(self, key, element=None) -> Lookup:
        return Lookup({r["key"]: r["elements"] for r in self.GroupBy(key, element).ordered_df().collect()})

    def count_by_df(self, key) -> DataFrame:
        return self.GroupBy(key).Agg(count=F.count("*")).df

    def CountBy(self, key) -> dict:
        return {r["key"]: r["count"] for r in self.GroupBy(key).Agg(count=F.count("*")).ordered_df().collect()}

    # -- parts -----------------------------------------------------------------------------------------------
    def Partition(self, predicate):
        """Two sequences: items that fit and the rest."""
        c = F.coalesce(self._col(predicate).cast("boolean"), F.lit(False))
        return self._with(self._df.filter(c), "partition"), self._with(self._df.filter(~c), "partition")

    def SplitAt(self, index: int):
        if index < 0:
            raise ValueError("index must not be negative")
        s, at = self._ordinal(), F.col(ORD)
        return s._with(s._df.filter(at < index), "splitAt"), s._with(s._df.filter(at >= index), "splitAt")

    def paginate_df(self, page: int, size: int, most: int = 1000) -> DataFrame:
        """The page's items, each beside the page's figures; the total is one aggregate over the sequence."""
        size, page = clamp_page_size(size, most), max(1, int(page))
        total = self._df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
        figures = total.select(F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total", "total_pages", (F.lit(page) < F.col("total_pages")).alias("has_next"), F.lit(page > 1).alias("has_previous"))
        return self.Page(page, size).df.crossJoin(F.broadcast(figures))

    def Paginate(self, page: int, size: int, most: int = 1000):
        size, page = clamp_page_size(size, most), max(1, int(page))
        return create_page_result(self.Page(page, size).ToArray(), page, size, self.Count())

    def CursorPage(self, size: int, cursor: str | None = None, most: int = 1000) -> CursorPage:
        """One row more than the page tells whether there is a next one, so nothing is counted."""
        size, start = clamp_page_size(size, most), parse_cursor(cursor)
        items = self.Skip(start).Take(size + 1).ToArray()
        more = len(items) > size
        return CursorPage(items[:size], str(start + size) if more else None, more)

    def KeysetPage(self, size: int, column: str, after=None):
        """Items after a key value: stable under inserts, and a range predicate instead of an offset."""
        s = self if after is None else self.WhereGt(column, after)
        return s.OrderBy(column).Take(clamp_page_size(size))

    # -- explain ---------------------------------------------------------------------------------------------
    def Explain(self) -> list[dict]:
        return [{"index": n, "kind": kind, "detail": detail} for n, (kind, detail) in enumerate(x for x in self._log if x[0] not in ("from", "ordinal"))]

    def ExplainText(self) -> str:
        return "\n".join(f"{e['index']}: {e['kind']}" + (f" ({e['detail']})" if e["detail"] is not None else "") for e in self.Explain())

    def explain(self, mode: str = "formatted") -> None:
        self._sorted().explain(mode)


