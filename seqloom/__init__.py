"""Ordered, lazy sequences on Spark DataFrames."""

from seqloom.functions import predicates
from seqloom.functions.errors import AbortedError, ArgumentOutOfRangeError, EmptySequenceError, InvalidOperationError, MoreThanOneElementError
from seqloom.functions.filters import (
    assert_allowed_field, assert_filter_shape, assert_max_depth, build_predicate, clamp_limit, field_predicate, parse_filter_json, parse_positive_int,
    parse_query_string, path_predicate, predicate_from_parsed_query, safe_api_error, sanitize_filter_object, validate_filter_with_schema,
)
from seqloom.functions.pagination import CursorPage, Page, clamp_page_size, create_page_result
from seqloom.functions.result import NONE, Err, Nothing, Ok, Some, debug_log, err, from_nullable, is_debug_mode, ok, set_debug_mode, some, try_run, try_run_sync
from seqloom.operators.seq import AsyncSeq, Seq, register
from seqloom.operators.terminals import Lookup
from seqloom.plans.exprs import py
from seqloom.sources.read import empty, from_async, from_df, from_rows, pipe, range_, read, repeat, write
from seqloom.streaming.stream import StreamSeq, from_readable_stream, to_readable_stream

__all__ = [
    "NONE", "AbortedError", "ArgumentOutOfRangeError", "AsyncSeq", "CursorPage", "EmptySequenceError", "Err", "InvalidOperationError", "Lookup", "MoreThanOneElementError", "Nothing", "Ok", "Page",
    "Seq", "Some", "StreamSeq", "assert_allowed_field", "assert_filter_shape", "assert_max_depth", "build_predicate", "clamp_limit", "clamp_page_size", "create_page_result",
    "debug_log", "empty", "err", "field_predicate", "from_async", "from_df", "from_nullable", "from_readable_stream", "from_rows", "is_debug_mode", "ok", "parse_filter_json",
    "parse_positive_int", "parse_query_string", "path_predicate", "pipe", "predicate_from_parsed_query", "predicates", "py", "range_", "read", "register", "repeat", "safe_api_error",
    "sanitize_filter_object", "set_debug_mode", "some", "to_readable_stream", "try_run", "try_run_sync", "validate_filter_with_schema", "write",
]
