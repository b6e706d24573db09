"""Filter clauses and groups compiled to Columns, and their HTTP form."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable
from urllib.parse import parse_qs

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import predicates as P
from seqloom.plans.exprs import UNSAFE, check_path, resolve

#: The clause operations of the filter format.
OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "between", "contains", "startsWith", "endsWith", "null", "notNull")
MAX_LIMIT, MAX_DEPTH = 1000, 5


def kind_at(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in check_path(path):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def field_predicate(schema: T.StructType, clause: dict) -> Column:
    """One clause {field, op, value, value2, insensitive}. An operation outside OPS raises ValueError."""
    field, op, value = clause["field"], clause["op"], clause.get("value")
    c, kind = resolve(schema, field), kind_at(schema, field)
    if kind is None:
        c = F.lit(None)
    pairs: dict[str, Callable] = {"eq": P.eq, "ne": P.ne, "gt": P.gt, "gte": P.gte, "lt": P.lt, "lte": P.lte}
    if op in pairs:
        return pairs[op](c, value)
    if op in ("in", "nin"):
        return (P.isin if op == "in" else P.not_in)(c, value or [])
    if op == "between":
        return P.between(c, value, clause.get("value2"))
    texts = {"contains": P.contains, "startsWith": P.starts_with, "endsWith": P.ends_with}
    if op in texts:
        return texts[op](c, "" if value is None else str(value), kind, bool(clause.get("insensitive")))
    if op == "null":
        return c.isNull()
    if op == "notNull":
        return c.isNotNull()
    raise ValueError(f"Unknown filter operation: {op!r}")


path_predicate = field_predicate


def build_predicate(schema: T.StructType, group: dict) -> Column:
    """A clause, or {not}, {and: [...]}, {or: [...]}, looked for in that order; empty groups match everything."""
    if "field" in group:
        return field_predicate(schema, group)
    if group.get("not"):
        return P.not_(build_predicate(schema, group["not"]))
    if group.get("and"):
        return P.and_(*[build_predicate(schema, g) for g in group["and"]])
    if group.get("or"):
        return P.or_(*[build_predicate(schema, g) for g in group["or"]])
    return F.lit(True)


def parse_positive_int(text) -> int | None:
    m = re.fullmatch(r"\s*(\d+)\s*", str(text)) if text is not None else None
    return int(m[1]) if m and int(m[1]) > 0 else None


def clamp_limit(limit: float, most: int = MAX_LIMIT) -> int:
    return 1 if not math.isfinite(limit) or limit < 1 else min(math.floor(limit), most)


def assert_allowed_field(field: str, allowed: Iterable[str] | None = None) -> None:
    check_path(field)
    if allowed is not None and field not in set(allowed):
        raise ValueError(f"Field is not allowed: {field}")


def assert_max_depth(depth: int, most: int = MAX_DEPTH) -> None:
    if depth > most:
        raise ValueError("Filter is nested too deeply")


def sanitize_filter_object(value, most: int = MAX_DEPTH, depth: int = 0):
    """A copy without unsafe keys; lists are kept as they are."""
    assert_max_depth(depth, most)
    if not isinstance(value, dict):
        return value
    return {k: sanitize_filter_object(v, most, depth + 1) for k, v in value.items() if k not in UNSAFE}


def safe_api_error(error) -> str:
    return str(error) if isinstance(error, Exception) and str(error) else "Request failed"


def parse_filter_json(text: str, allowed: Iterable[str] | None = None, most: int = MAX_DEPTH) -> dict:
    """Reads a filter. {and}, {or}, {not} are looked for in that order; a bare clause becomes {and: [clause]}
    and any other shape matches everything."""

    def shaped(g, depth: int) -> dict:
        assert_max_depth(depth, most)
        if isinstance(g, dict):
            g = sanitize_filter_object(g, most)
            for word in ("and", "or"):
                if isinstance(g.get(word), list):
                    return {word: [one(x, depth + 1) for x in g[word]]}
            if isinstance(g.get("not"), dict):
                return {"not": one(g["not"], depth + 1)}
            if "field" in g and "op" in g:
                return {"and": [one(g, depth)]}
        return {"and": []}

    def one(g, depth: int) -> dict:
        if isinstance(g, dict) and "field" in g and "op" in g:
            assert_allowed_field(str(g["field"]), allowed)
            return sanitize_filter_object(g, most)
        return shaped(g, depth)

    return shaped(json.loads(text), 0)


def parse_query_string(query: str, allowed: Iterable[str] | None = None, most: int = MAX_DEPTH) -> dict:
    """page, pageSize (or page_size), limit, sort and filter; numbers that do not parse are left out."""
    raw = {k: v[-1] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
    out: dict = {}
    for name, text in (("page", raw.get("page")), ("pageSize", raw.get("pageSize", raw.get("page_size")))):
        if (n := parse_positive_int(text)) is not None:
            out[name] = n
    if (n := parse_positive_int(raw.get("limit"))) is not None:
        out["limit"] = clamp_limit(n)
    if raw.get("sort"):
        out["sort"] = raw["sort"]
    if raw.get("filter"):
        out["filter"] = parse_filter_json(raw["filter"], allowed, most)
    return out


def predicate_from_parsed_query(schema: T.StructType, parsed: dict) -> Column | None:
    return build_predicate(schema, parsed["filter"]) if parsed.get("filter") else None


def assert_filter_shape(schema: T.StructType, group: dict) -> None:
    """Every field of a filter must exist in the schema."""
    if "field" in group:
        if kind_at(schema, group["field"]) is None:
            raise ValueError(f"Unknown field: {group['field']}")
        return
    for g in [*group.get("and", []), *group.get("or", []), *([group["not"]] if group.get("not") else [])]:
        assert_filter_shape(schema, g)


def validate_filter_with_schema(group: dict, safe_parse: Callable[[dict], tuple[bool, object]], schema: T.StructType | None = None) -> dict:
    good, value = safe_parse(group)
    if not good:
        raise ValueError(f"Filter does not fit its schema: {value}")
    if schema is not None:
        assert_filter_shape(schema, group)
    return group
