"""Cursors and pages."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..errors import InvalidConfig, InvalidCursor


@dataclass(frozen=True)
class Page:
    items: list[Any]
    next_cursor: str | None


def encode(kind: str, item_id: int) -> str:
    return f"{kind}:{item_id}"


def decode(kind: str, cursor: str) -> int:
    prefix, _, number = cursor.partition(":")
    if prefix != kind or not (number.isascii() and number.isdigit()) or int(number) >= 1 << 64:
        raise InvalidCursor(f"not a cursor of this query: {cursor!r}")
    return int(number)


def check(limit: int | None, size: int) -> None:
    if limit is not None:
        raise InvalidConfig("limit() can't be combined with page()")
    if size < 1:
        raise InvalidConfig("page size must be greater than zero")


def no_cursor(after: str | None) -> None:
    if after is not None:
        raise InvalidConfig("after() requires page()")
