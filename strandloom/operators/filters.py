"""Metadata filters compiled to predicates: a pre-filter, and the stricter one for rows after a rank cut."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# Keys whose ranges are dates.
DATE_KEYS = ("document_date", "created_at", "modified_at", "date")
OPERATORS = {"gte": "__ge__", "lte": "__le__", "gt": "__gt__", "lt": "__lt__"}


def condition(df: DataFrame, key: str, value, strict: bool) -> Column | None:
    """One key of a filter. A dict is a range, a list a choice, anything else an exact match.

    On an array column the pre-filter matches any element; strict (after a rank cut) compares scalars only, so an array
    never matches."""
    column, many = F.col(key), isinstance(df.schema[key].dataType, ArrayType)
    if isinstance(value, dict):
        bounds = [(OPERATORS[k], v) for k, v in value.items() if k in OPERATORS]
        if key in DATE_KEYS:
            stamp = column.cast("timestamp").cast("double")
            for _, v in bounds:
                datetime.fromisoformat(str(v))  # a bound that is no date raises, rather than match no row
            return reduce(Column.__and__, [getattr(stamp, op)(F.to_timestamp(F.lit(str(v))).cast("double")) for op, v in bounds]) if bounds else None
        return reduce(Column.__and__, [getattr(column, op)(F.lit(v)) for op, v in bounds]) if bounds else None
    if many:
        if strict:
            return F.lit(False)
        return F.arrays_overlap(column, F.array(*map(F.lit, value))) if isinstance(value, (list, tuple)) else F.array_contains(column, value)
    return column.isin(list(value)) if isinstance(value, (list, tuple)) else column == F.lit(value)


# Keys of filters that always hold, and of those that may be loosened.
HARD_KEYS = ("plan_name", "plan_number", "source", "category")
SOFT_KEYS = ("section_type", "content_type", "chunk_tags", "contains_age_info", "contains_currency", "plan_type", "premium_type", "document_date")


def split_filter(conditions: dict, always: tuple[str, ...] = ("project_ids",)) -> tuple[dict, dict]:
    """The hard and the soft part of a filter. Keys of `always` (tenants) stay in both, so that no relaxation crosses
    tenants; with always=() they vanish, as other unknown keys do."""
    keep = {k: v for k, v in conditions.items() if k in always}
    pick = lambda keys: {k: v for k, v in conditions.items() if k in keys} | keep
    return pick(HARD_KEYS), pick(SOFT_KEYS)


def temporal_presets(today: Column) -> dict[str, tuple[Column, Column | None]]:
    """Named ranges of dates, relative to a given day: first and last day, the last open if null."""
    year = F.trunc(today, "year")
    return {
        "last_30_days": (F.date_sub(today, 30), None), "last_90_days": (F.date_sub(today, 90), None), "this_year": (year, None),
        "last_year": (F.add_months(year, -12), F.date_sub(year, 1)),
    }


def apply_filter(df: DataFrame, conditions: dict, strict: bool = False) -> DataFrame:
    """The rows that meet all conditions; an empty filter keeps all."""
    found = [c for k, v in conditions.items() if (c := condition(df, k, v, strict)) is not None]
    return df.where(reduce(Column.__and__, found)) if found else df
