"""The sequence itself: a DataFrame, an order specification and a log of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.plans.exprs import Py, RowProxy, arity, resolve
from seqloom.plans.order import HIDDEN, ORD, Key, fresh, orderable, packed, with_ordinal


class Base:
    """Immutable. Visible columns are the item; hidden ones carry its order."""

    def __init__(self, df: DataFrame, keys: list[Key] = (), log: tuple = (), chain: int = 0):
        self._df, self._keys, self._log, self._chain = df, list(keys), tuple(log), chain
        self._contiguous = False  # ORD is present and has no gaps

    @classmethod
    def of(cls, df: DataFrame, order_by: list | None = None):
        """A sequence over df in the order of the given columns; without any, in that of all columns."""
        if order_by is None:
            order_by = [f.name for f in df.schema.fields if orderable(f.dataType)]
        named = [(fresh(), F.col(f"`{c}`") if isinstance(c, str) else c) for c in order_by]
        return cls(df.select("*", *[c.alias(n) for n, c in named]), [Key(n) for n, _ in named], (("from", None),))

    # -- shape ---------------------------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if not c.startswith(HIDDEN)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self._df.schema.fields if not f.name.startswith(HIDDEN)])

    @property
    def spark(self):
        return self._df.sparkSession

    @property
    def df(self) -> DataFrame:
        """The items as an unordered DataFrame."""
        return self._df.select(*self._visible())

    def ordered_df(self) -> DataFrame:
        return self._sorted().select(*self._visible())

    def _sorted(self) -> DataFrame:
        return self._df.orderBy(*[k.column() for k in self._keys]) if self._keys else self._df

    def _visible(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns]

    def _hidden(self) -> list[Column]:
        return [F.col(k.name) for k in self._keys]

    def _item(self) -> Column:
        return F.col("value") if self.columns == ["value"] else F.struct(*self._visible())

    def _with(self, df: DataFrame, kind: str, keys=None, detail=None, chain: int = 0):
        from seqloom.operators.seq import Seq

        return Seq(df, self._keys if keys is None else keys, (*self._log, (kind, detail)), chain)

    def _ordinal(self):
        """The same sequence with ORD in its frame and as its only key."""
        if self._contiguous:
            return self
        df, keys = self._df, self._keys
        if ORD in df.columns:  # positions of an earlier step, now with gaps
            old = fresh()
            df, keys = df.withColumnRenamed(ORD, old), [Key(old, k.asc, k.nulls_first) if k.name == ORD else k for k in keys]
        out = self._with(with_ordinal(df, keys).drop(*[k.name for k in keys]), "ordinal", [Key(ORD)])
        out._contiguous = True
        return out

    def _packed(self):
        """A sequence, and its order as one struct that is ascending or (False) descending."""
        if (c := packed(self._keys)) is not None:
            return self, *c
        return self._ordinal(), F.struct(F.col(ORD).alias("f0")), True

    def _first_seen(self):
        """A sequence, the aggregate that gives a group's first position in it, and that position as a key."""
        s, c, up = self._packed()
        at = fresh("g")
        return s, (F.min(c) if up else F.max(c)).alias(at), Key(at, up)

    def _in_order(self, value: Column) -> tuple:
        """A sequence and the aggregate that gives a group's values as an array in its order."""
        s, c, up = self._packed()
        return s, F.transform(F.sort_array(F.collect_list(F.struct(c.alias("o"), value.alias("v"))), up), lambda x: x["v"])

    # -- selectors -----------------------------------------------------------------------------------------
    def _proxy(self) -> RowProxy:
        return RowProxy(self.schema)

    def _needs_ordinal(self, sel) -> bool:
        return callable(sel) and not isinstance(sel, (Column, Py, str)) and arity(sel) > 1

    def _raw(self, sel):
        if sel is None:
            return self._item()
        if isinstance(sel, Py):
            return sel.column(F.struct(*self._visible()))
        if isinstance(sel, Column):
            return sel
        if isinstance(sel, str):
            return resolve(self.schema, sel)
        if isinstance(sel, (list, tuple)):
            return F.struct(*[self._raw(s).alias(s if isinstance(s, str) else f"k{i}") for i, s in enumerate(sel)])
        if callable(sel):
            out = sel(self._proxy(), F.col(ORD)) if arity(sel) > 1 else sel(self._proxy())
            if isinstance(out, (RowProxy,)):
                return out.as_struct()
            return out if isinstance(out, (Column, dict)) else self._raw(list(out)) if isinstance(out, (list, tuple)) else F.lit(out)
        return F.lit(sel)

    def _col(self, sel) -> Column:
        out = self._raw(sel)
        return F.struct(*[c.alias(n) for n, c in out.items()]) if isinstance(out, dict) else out

    def _outputs(self, out) -> list[Column]:
        """The visible columns that a selector's result stands for."""
        if isinstance(out, dict):
            return [(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in out.items()]
        return [out.alias("value")]

    def _other(self, other):
        """Any sequence or DataFrame as a second input."""
        from seqloom.operators.seq import Seq

        if isinstance(other, DataFrame):
            return Seq.of(other)
        if isinstance(other, Base):
            return other
        rows = list(other)
        if rows and isinstance(rows[0], (tuple, dict, list)):
            schema = self.schema if len(self.schema) == len(rows[0]) else None
            frame = self.spark.createDataFrame(rows, schema)
        else:
            kind = self.schema["value"].dataType if self.columns == ["value"] else None
            schema = T.StructType([T.StructField("value", kind)]) if kind else "value " + _kind_of(rows)
            frame = self.spark.createDataFrame([(r,) for r in rows], schema)
        return Seq.of(frame.withColumn(f"{HIDDEN}m", F.monotonically_increasing_id()).coalesce(1), [f"{HIDDEN}m"])._without_marker()

    def _without_marker(self):
        return self._with(self._df.drop(f"{HIDDEN}m"), "rows")


def _kind_of(rows: list) -> str:
    known = next((r for r in rows if r is not None), None)
    return {bool: "boolean", int: "long", float: "double", str: "string"}.get(type(known), "string")
