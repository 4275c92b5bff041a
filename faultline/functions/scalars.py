"""Small expressions that several views share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: value domains
PRIORITIES = ("critical", "high", "medium", "low")
USABLE = ("success", "not_applicable", "limit_reached")
CONCLUSIVE_RESULTS = ("pass", "warn", "fail")
ACTIVE, ARCHIVED = "Active", "Archived"


def conclusive(status: str = "status", result: str = "result") -> Column:
    return F.col(status).isin("success", "not_applicable") & F.col(result).isin(*CONCLUSIVE_RESULTS)


def usable(status: str = "status", result: str = "result") -> Column:
    return F.col(status).isin(*USABLE) & F.col(result).isin(*CONCLUSIVE_RESULTS)


def safe_rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def hours_between(start: Column, end: Column) -> Column:
    """Hour boundaries crossed from start to end."""
    return F.timestamp_diff("HOUR", F.date_trunc("hour", start), F.date_trunc("hour", end))


def flags(named: Sequence[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, each with a comma after it."""
    return F.concat(*[F.when(F.coalesce(c, F.lit(False)), F.lit(f"{name},")).otherwise(F.lit("")) for name, c in named])


def priority_rank(priority: Column) -> Column:
    low = F.lower(F.coalesce(priority, F.lit("")))
    rank = F.when(low == PRIORITIES[0], 0)
    for i, name in enumerate(PRIORITIES[1:], 1):
        rank = rank.when(low == name, i)
    return rank.otherwise(len(PRIORITIES))


def workflow_of(status: Column) -> Column:
    return F.upper(F.coalesce(status, F.lit("NEW")))


def owner_of(owner: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(owner), F.lit("")), F.lit("Unassigned"))


def has_tag(tags: Column, wanted: Sequence[str]) -> Column:
    """Whether a JSON array of tags holds one of the wanted; malformed text holds none."""
    parsed = F.from_json(tags, "array<string>")
    return F.coalesce(F.exists(parsed, lambda t: F.trim(t).isin(*wanted)), F.lit(False))


def contains_text(columns: Sequence[Column], wanted: str) -> Column:
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return F.contains(F.lower(joined), F.lit(wanted.strip().lower()))


def day_bounds(first: date | None, last: date | None, zone: str) -> tuple[datetime | None, datetime | None]:
    """Inclusive local dates as UTC instants [first 00:00, the day after last 00:00)."""

    def utc(day: date) -> datetime:
        return datetime.combine(day, time(), ZoneInfo(zone)).astimezone(timezone.utc).replace(tzinfo=None)

    return (utc(first) if first else None), (utc(last + timedelta(days=1)) if last else None)


def formula_guarded(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula, with an apostrophe before it."""
    risky = F.ltrim(text).rlike(r"^[=+\-@]") | text.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def owner_text(value: object) -> str | None:
    """An owner setting as text: a string, or a list of them joined by ', '."""
    if value is None:
        return None
    values = [value] if isinstance(value, str) else value
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise ValueError("an owner must be a string or a list of strings")
    return ", ".join(v.strip() for v in values if v.strip()) or None


def sheet_name(name: str, check_id: str, taken: set[str]) -> str:
    """A sheet name of at most 31 characters, unique regardless of case."""
    base = re.sub(r"[\[\]:*?/\\']", "_", name)[:22]
    found = f"{base}_{hashlib.sha256(check_id.encode()).hexdigest()[:8]}"
    n = 2
    while found.casefold() in taken:
        found = f"{found[:28]}_{n}"
        n += 1
    taken.add(found.casefold())
    return found
