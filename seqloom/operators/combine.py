"""Grouping, joins and set operators over two sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.base import Base
from seqloom.plans.exprs import Py, RowProxy
from seqloom.plans.folds import by_key
from seqloom.plans.order import HIDDEN, ORD, Key, fresh

L, R = f"{HIDDEN}l_", f"{HIDDEN}r_"


#: Beyond so many keys, sequences that are put one after the other get positions instead.
MOST_KEYS = 8


def _met(left: DataFrame, right: DataFrame, ok: str, ik: str, on) -> DataFrame:
    """The pairs of different keys that the comparer accepts."""
    return left.select(ok).distinct().join(right.select(ik).distinct(), on(F.col(ok), F.col(ik)))


def _joined(left: DataFrame, right: DataFrame, ok: str, ik: str, on, how: str) -> DataFrame:
    """An inner, left or right join, or the rows of the right side that meet none ("unmet")."""
    if on is None:
        if how == "unmet":
            return right.join(left.select(ok).distinct(), F.col(ok).eqNullSafe(F.col(ik)), "left_anti")
        return left.join(right, F.col(ok).eqNullSafe(F.col(ik)), how)
    a, b = fresh("om"), fresh("im")
    met = _met(left, right, ok, ik, on).toDF(a, b)
    inner, outer = F.col(ik).eqNullSafe(F.col(b)), F.col(ok).eqNullSafe(F.col(a))
    if how == "unmet":
        return right.join(met.select(b).distinct(), inner, "left_anti")
    if how == "left":
        return left.join(met.join(right, inner), outer, "left")
    return left.join(met, outer).join(right, inner, how)


class Combine(Base):
    # -- grouping --------------------------------------------------------------------------------------------
    def GroupBy(self, key, element=None):
        """key and elements, groups by first appearance. Agg() right after it aggregates without the arrays."""
        from seqloom.operators.seq import GroupedSeq

        return GroupedSeq(self._ordinal() if self._needs_ordinal(key) or self._needs_ordinal(element) else self, key, element)

    def GroupByMany(self, *keys, element=None):
        return self.GroupBy(list(keys), element)

    def Agg(self, **aggregates: Column):
        """Plain aggregates of the groups of the GroupBy just before."""
        s, seen, at = self._source._first_seen()
        df = s._df.groupBy(s._col(self._key).alias("key")).agg(seen, *[c.alias(n) for n, c in aggregates.items()])
        return s._with(df, "groupAgg", [at])

    def AggregateBy(self, key, seed=None, func=None, comparer=None):
        """key and value in first-seen order. func: an aggregate Column, or a Column lambda (acc, item) folded
        over the group's ordered array, or py(lambda acc, item: ..., type) in a streaming pass; a callable seed is called
        with the group's first item. A comparer is given as a function that normalises keys; a group then has the key
        of its first item."""
        if isinstance(func, Column) and comparer is None:
            return self.GroupBy(key).Agg(value=func)
        s = self._ordinal() if self._needs_ordinal(key) else self
        c = s._col(key)
        if isinstance(func, Py):
            t, order, up = s._packed()
            at = fresh("g")
            df = by_key(t._df, comparer(c) if comparer else c, t._item(), order, up, seed, func, at)
            if comparer:
                own = t._df.groupBy(comparer(c).alias("k")).agg((F.min_by if up else F.max_by)(c, order).alias("first"))
                df = df.join(own, F.col("key").eqNullSafe(F.col("k"))).select(F.col("first").alias("key"), "value", at)
            return s._with(df, "aggregateBy", [Key(at, up)])
        if isinstance(func, Column):
            t, order, up = s._packed()
            g = t.GroupBy(comparer(c)).Agg(first=(F.min_by if up else F.max_by)(c, order), value=func)
            return g._with(g._df.select(F.col("first").alias("key"), "value", *g._hidden()), "aggregateBy")
        g = s.GroupBy(comparer(c) if comparer else c, F.struct(c.alias("k"), s._item().alias("v")))
        first = F.element_at("elements", 1)
        start = seed(first["v"]) if callable(seed) else F.lit(seed)
        fold = F.aggregate("elements", start, lambda a, x: func(a, x["v"]))
        return g._with(g._df.select((first["k"] if comparer else F.col("key")).alias("key"), fold.alias("value"), *g._hidden()), "aggregateBy")

    # -- joins -----------------------------------------------------------------------------------------------
    def _sides(self, inner, outer_key, inner_key, on):
        """Both inputs, their frames with keys apart, a function that joins the frames, and the inner order."""
        o, i = self, self._other(inner)
        okey, ikey = o._col(outer_key), i._col(inner_key)
        ok, ik = fresh("ok"), fresh("ik")
        left = o._df.select(okey.alias(ok), F.lit(True).alias(f"{L}p"), *[F.col(f"`{c}`").alias(L + c) for c in o.columns], *o._hidden())
        right = i._df.select(ikey.alias(ik), F.lit(True).alias(f"{R}p"), *[F.col(f"`{c}`").alias(R + c) for c in i.columns], *[F.col(k.name).alias(f"{k.name}i") for k in i._keys])
        return o, i, lambda how: _joined(left, right, ok, ik, on, how), [Key(f"{k.name}i", k.asc, k.nulls_first) for k in i._keys]

    def _result(self, o, i, df: DataFrame, result, keys, kind):
        po = RowProxy(o.schema, {c: L + c for c in o.columns}, F.col(f"{L}p"))
        pi = RowProxy(i.schema, {c: R + c for c in i.columns}, F.col(f"{R}p"))
        if result is None:
            out = {c: F.col(L + c) for c in o.columns} | {c if c not in o.columns else f"{c}_inner": F.col(R + c) for c in i.columns}
        else:
            out = result(po, pi)
        return o._with(df.select(*o._outputs(out), *[F.col(k.name) for k in keys]), kind, keys)

    def Join(self, inner, outer_key, inner_key, result=None, on=None):
        """Inner join on null-safe equal keys, in outer order, then inner order. `on` gives a general comparer, which
        meets different keys only."""
        o, i, joined, ikeys = self._sides(inner, outer_key, inner_key, on)
        return self._result(o, i, joined("inner"), result, [*o._keys, *ikeys], "join")

    def LeftJoin(self, inner, outer_key, inner_key, result=None, on=None):
        o, i, joined, ikeys = self._sides(inner, outer_key, inner_key, on)
        return self._result(o, i, joined("left"), result, [*o._keys, *ikeys], "leftJoin")

    def RightJoin(self, inner, outer_key, inner_key, result=None, on=None):
        o, i, joined, ikeys = self._sides(inner, outer_key, inner_key, on)
        return self._result(o, i, joined("right"), result, [*ikeys, *o._keys], "rightJoin")

    def FullJoin(self, inner, outer_key, inner_key, result=None, on=None):
        """Outer items first, matched or not, then the unmatched inner ones in their order.

        A left join and then the inner rows whose key no outer row has: Spark's own full join holds all rows of a
        key in memory and never splits a hot one, while a left join spills and is split.
        """
        o, i, joined, ikeys = self._sides(inner, outer_key, inner_key, on)
        late = fresh("u")
        df = joined("left").withColumn(late, F.lit(False)).unionByName(joined("unmet").withColumn(late, F.lit(True)), allowMissingColumns=True)
        return self._result(o, i, df, result, [Key(late), *o._keys, *ikeys], "fullJoin")

    def GroupJoin(self, inner, outer_key, inner_key, result=None, on=None):
        """Each outer item with the array of its matches, empty where there are none."""
        i = self._other(inner)
        ok, ik, got = fresh("ok"), fresh("ik"), fresh("g")
        outer = self._df.withColumn(ok, self._col(outer_key))
        i, items = i._in_order(i._item())
        rows, by = i._df.withColumn(ik, i._col(inner_key)), ik
        if on is not None:
            met, by = fresh("om"), fresh("im")
            rows = rows.join(_met(outer, rows, ok, ik, on).toDF(by, met), F.col(ik).eqNullSafe(F.col(met)))
        groups = rows.groupBy(F.col(by).alias(f"{got}k")).agg(items.alias(got))
        df = outer.join(groups, F.col(ok).eqNullSafe(F.col(f"{got}k")), "left")
        empty = F.array().cast(groups.schema[got].dataType)
        matches = F.coalesce(F.col(got), empty)
        out = {**{c: F.col(f"`{c}`") for c in self.columns}, "matches": matches} if result is None else result(self._proxy(), matches)
        return self._with(df.select(*self._outputs(out), *self._hidden()), "groupJoin")

    def Zip(self, second, result=None):
        """Pairs by position, as many as the shorter side has."""
        a, b = self._ordinal(), self._other(second)._ordinal()
        left = a._df.select(ORD, F.lit(True).alias(f"{L}p"), *[F.col(f"`{c}`").alias(L + c) for c in a.columns])
        right = b._df.select(ORD, F.lit(True).alias(f"{R}p"), *[F.col(f"`{c}`").alias(R + c) for c in b.columns])
        return self._result(a, b, left.join(right, ORD), result, [Key(ORD)], "zip")

    # -- set operators ---------------------------------------------------------------------------------------
    def _stack(self, second, kind):
        """Both sequences, one after the other: a branch number is the first key, then come the keys of each."""
        a, b = self, self._other(second)
        if len(a._keys) + len(b._keys) > MOST_KEYS:
            a, b = a._ordinal(), b._ordinal()
        branch = fresh("br")
        akeys, bkeys = ([Key(fresh(), k.asc, k.nulls_first) for k in x._keys] for x in (a, b))
        named = lambda x, keys: [F.col(k.name).alias(n.name) for k, n in zip(x._keys, keys)]
        names = [c if c in a.columns or len(a.columns) != len(b.columns) else n for c, n in zip(b.columns, a.columns if len(a.columns) == len(b.columns) else b.columns)]
        left = a._df.select(*a._visible(), F.lit(0).alias(branch), *named(a, akeys))
        right = b._df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(b.columns, names)], *named(b, bkeys))
        right = right.select(*a._visible(), F.lit(1).alias(branch), *[k.name for k in bkeys])
        return self._with(left.unionByName(right, allowMissingColumns=True), kind, [Key(branch), *akeys, *bkeys])

    def Concat(self, second):
        return self._stack(second, "concat")

    def Append(self, items):
        return self._stack(items, "append")

    def Prepend(self, items):
        return self._other(items)._stack(self, "prepend")

    def DistinctBy(self, key, comparer=None):
        """The first item of each key. A comparer is given as a function that normalises keys."""
        s = self._ordinal() if self._needs_ordinal(key) else self
        c, rank, k = s._col(key), fresh("r"), fresh("d")
        w = Window.partitionBy(k).orderBy(*[x.column() for x in s._keys])
        df = s._df.withColumn(k, comparer(c) if comparer else c).withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1)
        return s._with(df.drop(rank, k), "distinctBy")

    def Distinct(self, comparer=None):
        out = self.DistinctBy(None, comparer)
        out._log = (*self._log, ("distinct", None))
        return out

    def Union(self, second, comparer=None):
        return self._stack(second, "union").Distinct(comparer)

    def UnionBy(self, second, key, comparer=None):
        return self._stack(second, "unionBy").DistinctBy(key, comparer)

    def _member(self, second, key, how, comparer, whole: bool):
        k, m = fresh("k"), fresh("m")
        other = self._other(second)
        c, d = self._col(key), other._item()
        if whole and other.columns != self.columns and len(other.columns) > 1:
            d = F.struct(*[F.col(f"`{b}`").alias(a) for a, b in zip(self.columns, other.columns)])
        if comparer:
            c, d = comparer(c), comparer(d)
        df = self._df.withColumn(k, c).join(other._df.select(d.alias(m)).distinct(), F.col(k).eqNullSafe(F.col(m)), how)
        return df.drop(k)

    def Intersect(self, second, comparer=None):
        return self._with(self._member(second, None, "left_semi", comparer, True), "intersect").Distinct(comparer)

    def Except(self, second, comparer=None, distinct=False):
        """Items that the second sequence lacks. Repeats are kept unless distinct is asked for."""
        out = self._with(self._member(second, None, "left_anti", comparer, True), "except")
        return out.Distinct(comparer) if distinct else out

    def IntersectBy(self, keys, key, comparer=None):
        """The first item of each key that is among `keys`."""
        return self._with(self._member(keys, key, "left_semi", comparer, False), "intersectBy").DistinctBy(key, comparer)

    def ExceptBy(self, keys, key, comparer=None):
        return self._with(self._member(keys, key, "left_anti", comparer, False), "exceptBy").DistinctBy(key, comparer)
