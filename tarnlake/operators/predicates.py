"""Filters of the listing and search services."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def equals(**values) -> Column:
    """Equality on every given column; a__b stands for the nested field a.b."""
    return all_of([F.col(k.replace("__", ".")) == F.lit(v) for k, v in values.items()])


def in_range(column: str, low=None, high=None) -> Column:
    """Inclusive; a bound that is None is open."""
    c = F.col(column)
    return all_of([x for x in (c >= F.lit(low) if low is not None else None, c <= F.lit(high) if high is not None else None) if x is not None])


def below(column: str, limit) -> Column:
    """Strictly below; no filter if the limit is falsy (0 too), as the job history has it."""
    return F.col(column) < F.lit(limit) if limit else F.lit(True)


def matches(column: str, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive regular expression anywhere in the text, or the text itself if literal; no filter if blank."""
    if not pattern or not pattern.strip():
        return F.lit(True)
    if literal:
        return F.contains(F.lower(F.col(column)), F.lower(F.lit(pattern)))
    return F.col(column).rlike("(?iu)" + pattern)


def since(column: str, anchor: datetime | Column, days: int = 7) -> Column:
    """At most `days` before the anchor; the anchor is given, never the clock."""
    at = anchor if isinstance(anchor, Column) else F.lit(anchor)
    return F.col(column) >= at - F.expr(f"INTERVAL {days} DAYS")


def is_object_id(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{24}$")


def not_blank(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0


def check_page(page: int, limit: int, order: str) -> None:
    if page < 1 or not 1 <= limit <= 100:
        raise InvalidArgument("INVALID_PAGE", "page starts at 1 and limit is 1 to 100")
    if order not in ("asc", "desc"):
        raise InvalidArgument("INVALID_ORDER", "order is asc or desc")


def check_settings(ids: list[str], top_k: int, accuracy: float) -> None:
    if not ids:
        raise InvalidArgument("NO_COLLECTIONS", "no knowledge base is selected")
    if top_k <= 0 or not 0 <= accuracy <= 1:
        raise InvalidArgument("INVALID_SETTINGS", "top_k is positive and accuracy is 0 to 1")


def check_message(text: str) -> str:
    """The trimmed message, cut to 1000 characters."""
    clean = (text or "").strip()
    if len(clean) < 2:
        raise InvalidArgument("MESSAGE_TOO_SHORT", "a message has two characters at least")
    return clean[:1000]


def valid_readings(df: DataFrame) -> DataFrame:
    return df.filter(F.col("value") >= 0)


def valid_profiles(df: DataFrame) -> DataFrame:
    return df.filter((F.col("age") >= 0) & (F.col("bmi") >= 0))
