"""Option and Result values."""

from __future__ import annotations

import logging
from collections.abc import Awaitable, Callable
from dataclasses import dataclass
from typing import Any

log = logging.getLogger("seqloom")


@dataclass(frozen=True)
class Some:
    value: Any
    is_some: bool = True


@dataclass(frozen=True)
class Nothing:
    is_some: bool = False


@dataclass(frozen=True)
class Ok:
    value: Any
    is_ok: bool = True


@dataclass(frozen=True)
class Err:
    error: Any
    is_ok: bool = False


NONE = Nothing()


def some(value) -> Some:
    return Some(value)


def from_nullable(value) -> Some | Nothing:
    return NONE if value is None else Some(value)


def ok(value) -> Ok:
    return Ok(value)


def err(error) -> Err:
    return Err(error)


def try_run_sync(func: Callable) -> Ok | Err:
    try:
        return Ok(func())
    except Exception as e:
        return Err(e)


async def try_run(func: Callable[[], Awaitable]) -> Ok | Err:
    try:
        return Ok(await func())
    except Exception as e:
        return Err(e)


def set_debug_mode(on: bool) -> None:
    log.setLevel(logging.DEBUG if on else logging.WARNING)


def is_debug_mode() -> bool:
    return log.isEnabledFor(logging.DEBUG)


def debug_log(*parts) -> None:
    log.debug(" ".join(map(str, parts)))
