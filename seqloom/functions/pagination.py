"""Page objects and their arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

MAX_PAGE = 1000


@dataclass
class Page:
    items: list
    page: int
    page_size: int
    total: int
    total_pages: int
    has_next: bool
    has_previous: bool


@dataclass
class CursorPage:
    items: list
    next_cursor: str | None
    has_next: bool


def clamp_page_size(size: float, most: int = MAX_PAGE) -> int:
    return 1 if not math.isfinite(size) or size < 1 else min(math.floor(size), most)


def create_page_result(items: list, page: int, page_size: int, total: int) -> Page:
    pages = math.ceil(total / page_size) if page_size > 0 else 0
    return Page(items, page, page_size, total, pages, page < pages, page > 1)


def parse_cursor(cursor: str | None) -> int:
    try:
        return max(0, int(cursor or 0))
    except ValueError:
        return 0
