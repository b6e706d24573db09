"""Filtering, projection, ordering and positional operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import predicates as P
from seqloom.operators.base import Base
from seqloom.plans.exprs import Py, check_path, resolve
from seqloom.plans.folds import scan
from seqloom.plans.order import HIDDEN, ORD, Key, fresh, running


#: Positions up to here are reached by taking the first of each task.
NEAR = 100_000


def _count(n: int, least: int = 0) -> int:
    if n < least:
        raise ValueError(f"count must be at least {least}, not {n}")
    return n


class Lazy(Base):
    # -- filters ---------------------------------------------------------------------------------------------
    def _where(self, c: Column, kind: str):
        return self._with(self._df.filter(c), kind)

    def Where(self, predicate):
        """Keeps items for which the predicate is true; a two-argument lambda also gets the item's position."""
        s = self._ordinal() if self._needs_ordinal(predicate) else self
        return s._where(s._col(predicate), "where")

    def TryWhere(self, predicate):
        """Like Where, but an item whose predicate fails is dropped. Use try_ functions in Columns, or py()."""
        if isinstance(predicate, Py):
            predicate = Py(predicate.func, predicate.returns, catch=True)
        return self._where(self._col(predicate), "tryWhere")

    def OfType(self, guard=None):
        """Without a guard, items that are non-null objects or arrays; with one, items it accepts."""
        if guard is not None:
            return self._where(self._col(guard), "ofType")
        if self.columns != ["value"]:
            return self._with(self._df, "ofType")
        kind = self.schema["value"].dataType
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return self._where(F.col("value").isNotNull(), "ofType")
        if isinstance(kind, T.VariantType):
            shape = F.schema_of_variant("value")
            return self._where(F.coalesce(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.lit(False)), "ofType")
        return self._where(F.lit(False), "ofType")

    def Cast(self, schema=None):
        """The same items; with a {column: type} mapping, cast."""
        df = self._df
        for name, kind in (schema or {}).items():
            df = df.withColumn(name, F.col(f"`{name}`").cast(kind))
        return self._with(df, "cast")

    def _path(self, path: str):
        kind: T.DataType | None = self.schema
        for p in check_path(path):
            kind = kind[p].dataType if isinstance(kind, T.StructType) and p in kind.names else None
        return resolve(self.schema, path), kind

    def WhereEq(self, path, value):
        return self._where(P.eq(self._path(path)[0], value), "where")

    def WhereNotEq(self, path, value):
        return self._where(P.ne(self._path(path)[0], value), "where")

    def WhereGt(self, path, value):
        return self._where(P.gt(self._path(path)[0], value), "where")

    def WhereGte(self, path, value):
        return self._where(P.gte(self._path(path)[0], value), "where")

    def WhereLt(self, path, value):
        return self._where(P.lt(self._path(path)[0], value), "where")

    def WhereLte(self, path, value):
        return self._where(P.lte(self._path(path)[0], value), "where")

    def WhereIn(self, path, values):
        return self._where(P.isin(self._path(path)[0], values), "where")

    def WhereNotIn(self, path, values):
        return self._where(P.not_in(self._path(path)[0], values), "where")

    def WhereBetween(self, path, low, high):
        return self._where(P.between(self._path(path)[0], low, high), "where")

    def WhereContains(self, path, text, insensitive=False):
        return self._where(P.contains(*self._text(path, text), insensitive), "where")

    def WhereStartsWith(self, path, text, insensitive=False):
        return self._where(P.starts_with(*self._text(path, text), insensitive), "where")

    def WhereEndsWith(self, path, text, insensitive=False):
        return self._where(P.ends_with(*self._text(path, text), insensitive), "where")

    def _text(self, path, text):
        c, kind = self._path(path)
        return c, text, kind or T.NullType()

    def WhereNull(self, path):
        return self._where(self._path(path)[0].isNull(), "where")

    def WhereNotNull(self, path):
        return self._where(self._path(path)[0].isNotNull(), "where")

    def WhereTruthy(self, path):
        c, kind = self._path(path)
        return self._where(P.truthy(c, kind or T.NullType()), "where")

    def WhereFalsy(self, path):
        c, kind = self._path(path)
        return self._where(P.falsy(c, kind or T.NullType()), "where")

    # -- projections -----------------------------------------------------------------------------------------
    def Select(self, selector):
        """One output for each item: a Column gives `value`, a dict gives named columns."""
        s = self._ordinal() if self._needs_ordinal(selector) else self
        out = s._raw(selector)
        return s._with(s._df.select(*s._outputs(out), *s._hidden()), "select")

    def SelectMany(self, selector):
        """Flattens the array that the selector gives; order is the item's, then the element's."""
        s = self._ordinal() if self._needs_ordinal(selector) else self
        pos = fresh("pos")
        df = s._df.select(F.posexplode(s._col(selector)).alias(pos, "value"), *s._hidden())
        return s._with(df, "selectMany", [*s._keys, Key(pos)])

    def Flatten(self):
        """One level of arrays or maps; a map gives its (key, value) entries."""
        kind = self.schema["value"].dataType
        return self.SelectMany(F.map_entries("value") if isinstance(kind, T.MapType) else F.col("value"))

    def Pluck(self, path):
        return self.Select(self._path(path)[0])

    def SelectKeys(self, *names):
        df = self._df.select(*[(F.col(f"`{n}`") if n in self.columns else F.lit(None)).alias(n) for n in names], *self._hidden())
        return self._with(df, "select")

    def OmitKeys(self, *names):
        return self._with(self._df.drop(*names), "select")

    def WithIndex(self):
        s = self._ordinal()
        return s._with(s._df.select(s._item().alias("value"), F.col(ORD).alias("index"), ORD), "withIndex")

    def Index(self):
        s = self._ordinal()
        return s._with(s._df.select(F.col(ORD).alias("index"), s._item().alias("item"), ORD), "index")

    def Tap(self, action):
        """Runs an action on each item as it passes. It runs on executors and again when a task is retried."""
        item = self.columns

        def act(batches):
            for b in batches:
                for row in b.select(item).to_pylist():
                    action(row)
                yield b

        return self._with(self._df.mapInArrow(act, self._df.schema), "tap")

    def AsEnumerable(self):
        return self._with(self._df, "asEnumerable")

    # -- position --------------------------------------------------------------------------------------------
    def Take(self, count: int):
        return self._with(self._sorted().limit(_count(count)), "take", detail=count)

    def Skip(self, count: int):
        from seqloom.operators.seq import SkippedSeq

        return SkippedSeq(self, count) if _count(count) else self._with(self._df, "skip", detail=count)

    def _range(self, start: int, count: int):
        """Items from a position on, and the sequence whose keys they have: the best of all near the start, by ordinal
        further on, where a task's best would be too many."""
        if start + _count(count) <= NEAR:
            return self, self._sorted().offset(start).limit(count)
        s = self._ordinal()
        return s, s._df.filter((F.col(ORD) >= start) & (F.col(ORD) < start + count))

    def Page(self, page: int, size: int):
        return self.Skip((max(1, page) - 1) * size).Take(size)

    def TakeLast(self, count: int):
        flipped = [k.flipped().column() for k in self._keys]
        return self._with(self._df.orderBy(*flipped).limit(max(0, count)), "takeLast", detail=count)

    def SkipLast(self, count: int):
        if count <= 0:
            return self._with(self._df, "skipLast", detail=count)
        s = self._ordinal()
        most = s._df.agg(F.max(ORD).alias(f"{HIDDEN}most"))
        df = s._df.crossJoin(F.broadcast(most)).filter(F.col(ORD) <= F.col(f"{HIDDEN}most") - count)
        return s._with(df.drop(f"{HIDDEN}most"), "skipLast", detail=count)

    def _cut(self, predicate):
        """With the position of the first item that fails the predicate, one row, beside each item."""
        s = self._ordinal()
        good = F.coalesce(s._col(predicate), F.lit(False))
        cut = s._df.agg(F.min(F.when(~good, F.col(ORD))).alias(f"{HIDDEN}cut"))
        return s, s._df.crossJoin(F.broadcast(cut)), F.col(f"{HIDDEN}cut")

    def TakeWhile(self, predicate):
        s, df, cut = self._cut(predicate)
        return s._with(df.filter(cut.isNull() | (F.col(ORD) < cut)).drop(f"{HIDDEN}cut"), "takeWhile")

    def SkipWhile(self, predicate):
        s, df, cut = self._cut(predicate)
        return s._with(df.filter(F.col(ORD) >= cut).drop(f"{HIDDEN}cut"), "skipWhile")

    def DefaultIfEmpty(self, default=None):
        """The items, or the default alone where there are none. Lazy: emptiness is part of the plan."""
        some = self._df.limit(1).select(F.lit(1).alias(f"{HIDDEN}some"))
        row = default if isinstance(default, dict) else {self.columns[0]: default}
        one = self.spark.range(1).select(
            *[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema.fields],
            *[F.lit(None).cast(self._df.schema[k.name].dataType).alias(k.name) for k in self._keys],
        )
        one = one.join(F.broadcast(some), F.lit(True), "left_anti")
        hidden = [k.name for k in self._keys]
        return self._with(self._df.select(*self._visible(), *hidden).unionByName(one), "defaultIfEmpty")

    def Chunk(self, size: int):
        """Arrays of consecutive items, the last one possibly shorter."""
        _count(size, 1)
        s, at = self._ordinal(), fresh("c")
        df = s._df.groupBy(F.floor(F.col(ORD) / size).alias(at)).agg(F.sort_array(F.collect_list(F.struct(F.col(ORD).alias("o"), s._item().alias("v")))).alias("value"))
        return s._with(df.select(F.transform("value", lambda x: x["v"]).alias("value"), at), "chunk", [Key(at)])

    def Buffer(self, size: int, step: int = 1):
        """Full sliding windows of consecutive items; a step beyond the size counts as the size."""
        _count(size, 1), _count(step, 1)
        step = min(step, size)
        s, at = self._ordinal(), fresh("b")
        o = F.col(ORD)
        first = F.greatest(F.lit(0), F.ceil((o - size + 1) / step)).cast("long")
        last = F.floor(o / step).cast("long")
        df = s._df.select(s._item().alias("v"), o.alias("o"), F.explode(F.when(first <= last, F.sequence(first, last))).alias(at))
        df = df.groupBy(at).agg(F.sort_array(F.collect_list(F.struct("o", "v"))).alias("value")).filter(F.size("value") == size)
        return s._with(df.select(F.transform("value", lambda x: x["v"]).alias("value"), at), "buffer", [Key(at)])

    def _previous(self, c: Column, name: str):
        """Each row with a value of the row before it; two levels keep the shift distributed."""
        s, b = self._ordinal(), fresh("b")
        block = 1 << 20
        df = s._df.withColumn(name, c).withColumn(b, F.floor(F.col(ORD) / block))
        inside = F.lag(name).over(Window.partitionBy(b).orderBy(ORD))
        edge = df.filter(F.col(ORD) % block == block - 1).select((F.col(b) + 1).alias(b), F.col(name).alias(f"{name}e"))
        df = df.join(edge, b, "left")
        df = df.withColumn(f"{name}p", F.when(F.col(ORD) % block == 0, F.col(f"{name}e")).otherwise(inside))
        return s, df.drop(b, f"{name}e")

    def Pairwise(self):
        """Each item with the one before it: prev and cur."""
        name = fresh("w")
        s, df = self._previous(self._item(), name)
        df = df.filter(F.col(ORD) > 0).select(F.col(f"{name}p").alias("prev"), F.col(name).alias("cur"), ORD)
        return s._with(df, "pairwise")

    def AdjacentDistinct(self, key=None):
        """Drops an item equal to the one before it; the key stands for a comparer."""
        name = fresh("w")
        s, df = self._previous(self._col(key), name)
        keep = (F.col(ORD) == 0) | ~F.col(name).eqNullSafe(F.col(f"{name}p"))
        return s._with(df.filter(keep).drop(name, f"{name}p"), "adjacentDistinct")

    def Scan(self, seed, func, of=None):
        """The seed and every running accumulator after it.

        func: "sum", "count", "min" or "max", folded in parallel; py(lambda acc, item: ..., type), in one streaming pass
        over the ordered rows; or a Column lambda (acc, item), which needs the whole sequence in one array.
        """
        if isinstance(func, Py):
            return self._with(scan(self._df, self._col(of), [k.column() for k in self._keys], seed, func, ORD), "scan", [Key(ORD)])
        s = self._ordinal()
        if isinstance(func, str):
            name = fresh("s")
            df = running(s._df, name, func, s._col(of))
            c = F.col(name)
            c = F.lit(seed) + c if func in ("sum", "count") else (F.least if func == "min" else F.greatest)(F.lit(seed), c)
            df = df.select(c.alias("value"), (F.col(ORD) + 1).alias(ORD))
            first = s.spark.range(1).select(F.lit(seed).cast(df.schema["value"].dataType).alias("value"), F.lit(0).cast("long").alias(ORD))
            return s._with(first.unionByName(df), "scan", [Key(ORD)])
        whole = s._df.agg(F.sort_array(F.collect_list(F.struct(F.col(ORD).alias("o"), s._col(of).alias("v")))).alias("a"))
        steps = F.aggregate("a", F.array(F.lit(seed)), lambda acc, x: F.concat(acc, F.array(func(F.element_at(acc, -1), x["v"]))))
        return s._with(whole.select(F.posexplode(steps).alias(ORD, "value")), "scan", [Key(ORD)])

    # -- order -----------------------------------------------------------------------------------------------
    def _order(self, key, desc, nulls, locale, comparer):
        s = self._ordinal() if self._needs_ordinal(key) else self
        c = s._col(key)
        if locale:
            c = F.collate(c, locale)
        if comparer:
            c = comparer(c)
        name = fresh()
        new = Key(name, not desc, nulls == "first")
        at = s._chain
        keys = [*s._keys[:at], new, *s._keys[at:]]
        return s._with(s._df.withColumn(name, c), "orderBy", keys, detail=f"{'desc' if desc else 'asc'}", chain=at + 1)

    def OrderBy(self, key, descending=False, nulls="last", locale=None, comparer=None):
        """Stable. Nulls come last unless asked for first. Right after another OrderBy it breaks ties. A comparer is
        given as a function from the key to what its order goes by."""
        return self._order(key, descending, nulls, locale, comparer)

    def OrderByDescending(self, key, nulls="last", locale=None, comparer=None):
        return self._order(key, True, nulls, locale, comparer)

    def ThenBy(self, key, descending=False, nulls="last", locale=None, comparer=None):
        return self._order(key, descending, nulls, locale, comparer)

    def ThenByDescending(self, key, nulls="last", locale=None, comparer=None):
        return self._order(key, True, nulls, locale, comparer)

    def Order(self, descending=False, nulls="last", locale=None, comparer=None):
        return self._order(None, descending, nulls, locale, comparer)

    def OrderDescending(self, nulls="last", locale=None, comparer=None):
        return self._order(None, True, nulls, locale, comparer)

    def Reverse(self):
        return self._with(self._df, "reverse", [k.flipped() for k in self._keys])
