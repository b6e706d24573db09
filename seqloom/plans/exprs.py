"""Selectors: paths, Columns, traceable lambdas and explicit Python functions."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSAFE = ("__proto__", "constructor", "prototype")  # fixed values: path segments never followed


def check_path(path: str) -> list[str]:
    parts = path.split(".")
    if not path or any(not p or p in UNSAFE for p in parts):
        raise ValueError(f"Invalid property path: {path!r}")
    return parts


def resolve(schema: T.StructType, path: str, names: dict[str, str] | None = None) -> Column:
    """The column of a dot path; a segment that the schema lacks gives null."""
    parts = check_path(path)
    kind: T.DataType = schema
    for i, p in enumerate(parts):
        if isinstance(kind, T.StructType) and p in kind.names:
            kind = kind[p].dataType
        elif isinstance(kind, T.MapType) and i:
            kind = kind.valueType
        else:
            return F.lit(None)
    out = F.col(f"`{(names or {}).get(parts[0], parts[0])}`")
    for p in parts[1:]:
        out = out.getItem(p) if re.fullmatch(r"\w+", p) else out.getField(p)
    return out


class RowProxy:
    """Stands for one row while a lambda is traced into a Column."""

    def __init__(self, schema: T.StructType, names: dict[str, str] | None = None, present: Column | None = None):
        self._schema, self._names, self._present = schema, names, present

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return resolve(self._schema, name, self._names)

    def __getitem__(self, path: str) -> Column:
        return resolve(self._schema, path, self._names)

    def is_present(self) -> Column:
        """False on the side of an outer join that has no row."""
        return F.lit(True) if self._present is None else F.coalesce(self._present, F.lit(False))

    def as_struct(self) -> Column:
        return F.struct(*[resolve(self._schema, n, self._names).alias(n) for n in self._schema.names])

    def __bool__(self) -> bool:
        raise TypeError("a row cannot be tested in Python while it is traced; use Column operators or py(f, type)")


@dataclass(frozen=True)
class Py:
    """A Python function over whole rows: opaque to the optimizer, so it must be asked for by name."""

    func: Callable
    returns: T.DataType | str
    catch: bool = False

    def column(self, item: Column) -> Column:
        func, catch = self.func, self.catch

        def call(row):
            try:
                return func(row)
            except Exception:
                if catch:
                    return None
                raise

        return F.udf(call, self.returns, useArrow=True)(item)  # rows come in Arrow batches


def py(func: Callable, returns: T.DataType | str) -> Py:
    return Py(func, returns)


def arity(func: Callable) -> int:
    return len([p for p in inspect.signature(func).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)])
