"""Predicates: LIKE escaping, date windows, message filters, and the metadata predicate language.

Every builder returns a Column, so Catalyst merges the conjuncts and pushes what it
can to the scan.  A missing argument adds no predicate.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORT_COLUMNS = ("date", "subject", "sender_email", "folder")


def escape_like(text: str) -> str:
    """``text`` with the wildcards of LIKE escaped by a backslash."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_like(column: Column, needle: str) -> Column:
    """Case-insensitive substring, the needle taken literally."""
    return column.ilike(f"%{escape_like(needle)}%")


def date_window(column: Column, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Days from ``date_from`` to ``date_to``, both inclusive, as a range the scan can prune by."""
    tests = [F.lit(True)]
    if date_from:
        tests.append(column >= F.to_timestamp_ntz(F.lit(date_from[:10])))
    if date_to:
        tests.append(column < F.to_timestamp_ntz(F.date_add(F.to_date(F.lit(date_to[:10])), 1).cast("string")))
    return reduce(Column.__and__, tests)


def flag(column: Column) -> Column:
    """Tolerant boolean: true, 1 and yes in any case."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def in_list(column: Column, item: str) -> Column:
    """Exact member, case-insensitively, of a comma-separated list."""
    return F.array_contains(F.transform(F.split(F.lower(column), ","), lambda x: F.trim(x)), item.strip().lower())


def sender_matches(email: Column, name: Column, needle: str) -> Column:
    return contains_like(email, needle) | F.coalesce(contains_like(name, needle), F.lit(False))


def message_filter(sender: str | None = None, category: str | None = None, date_from: str | None = None, date_to: str | None = None, min_value: float | None = None) -> Column:
    """The conjunction of the filters that are given, over the messages view."""
    tests = [date_window(F.col("date"), date_from, date_to)]
    if sender:
        tests.append(contains_like(F.col("sender_email"), sender))
    if category:
        tests.append(F.col("category") == category)
    if min_value is not None:
        tests.append(F.col("value") >= min_value)
    return reduce(Column.__and__, tests)


def page(rows: DataFrame, sort_by: str, descending: bool, limit: int | None, offset: int = 0, key: str = "uid") -> DataFrame:
    """A page in a total order; an unknown sort column falls back to the newest first."""
    if sort_by not in SORT_COLUMNS:
        sort_by, descending = "date", True
    column = F.col(sort_by)
    ordered = rows.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_first(), key).offset(offset)
    return ordered if limit is None else ordered.limit(limit)


# metadata predicates

_COMPARE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def _variant(metadata: Column, key: str, value: object) -> Column:
    kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, int | float) else "string"
    found = F.try_variant_get(metadata, f"$['{key}']", kind)
    return found


def _is_kind(metadata: Column, key: str, value: object) -> Column:
    """The stored value has the type of ``value``; a comparison across types is false."""
    kind = F.schema_of_variant(F.try_variant_get(metadata, f"$['{key}']", "variant"))
    if isinstance(value, bool):
        return kind == "BOOLEAN"
    if isinstance(value, int | float):
        return kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|INT)$")
    return kind == "STRING"


def _operator(metadata: Column, key: str, name: str, value: object) -> Column:
    if name in ("$in", "$nin"):
        inside = reduce(Column.__or__, (_operator(metadata, key, "$eq", v) for v in value), F.lit(False))
        return inside if name == "$in" else ~inside
    if name == "$ne":
        return ~_operator(metadata, key, "$eq", value)
    if name == "$contains":
        return F.coalesce(F.contains(_variant(metadata, key, ""), F.lit(str(value))), F.lit(False))
    same = _is_kind(metadata, key, value)
    if name == "$eq":
        return F.coalesce(same & (_variant(metadata, key, value) == F.lit(value)), F.lit(False))
    if name in _COMPARE:
        return F.coalesce(same & getattr(_variant(metadata, key, value), _COMPARE[name])(F.lit(value)), F.lit(False))
    return F.lit(False)


def metadata_predicate(metadata: Column, where: Mapping[str, object] | None) -> Column:
    """``where`` over a variant: $and and $or of {key: value} and {key: {operator: value}}.

    A missing key, a value of another type and an unknown operator are false, never
    an error.
    """
    if not where:
        return F.lit(True)
    tests = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts = [metadata_predicate(metadata, part) for part in value]
            tests.append(reduce(Column.__and__ if key == "$and" else Column.__or__, parts, F.lit(key == "$and")))
        elif isinstance(value, Mapping):
            tests += [_operator(metadata, key, name, operand) for name, operand in value.items()]
        else:
            tests.append(_operator(metadata, key, "$eq", value))
    return reduce(Column.__and__, tests)


def metadata_filter(rows: DataFrame, column: str, where: Mapping[str, object] | str | None) -> DataFrame:
    """Rows whose JSON text ``column`` satisfies ``where`` (a mapping or JSON)."""
    where = json.loads(where) if isinstance(where, str) else where
    return rows.where(metadata_predicate(F.try_parse_json(F.col(column)), where))


def structured(rows: DataFrame, request: dict) -> DataFrame:
    """Messages (uid, sender_email, category, date, value) that meet a request, in its order, up to its limit.

    Known fields: sender, date_from, date_to (days, both inclusive), category (a list),
    min_score, sort_by (score, date, sender), limit; another field or order, a limit
    below 1 or days in the wrong order raise ValueError.
    """
    known = {"sender", "date_from", "date_to", "category", "min_score", "sort_by", "limit"}
    orders = {"score": [F.desc("value")], "date": [F.desc("date")], "sender": [F.asc("sender_email")]}
    if unknown := set(request) - known:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    if request.get("sort_by", "score") not in orders or request.get("limit", 1) < 1 or (request.get("date_from") or "") > (request.get("date_to") or "9999"):
        raise ValueError(f"a request that cannot be met: {request}")
    if request.get("sender"):
        rows = rows.where(F.contains(F.lower("sender_email"), F.lit(request["sender"].lower())))
    if request.get("date_from"):
        rows = rows.where(F.col("date") >= F.lit(request["date_from"]).cast("timestamp_ntz"))
    if request.get("date_to"):
        rows = rows.where(F.col("date") < F.date_add(F.lit(request["date_to"]).cast("date"), 1).cast("timestamp_ntz"))
    if request.get("category"):
        rows = rows.where(F.col("category").isin(*request["category"]))
    if request.get("min_score") is not None:
        rows = rows.where(F.col("value") >= request["min_score"])
    return rows.orderBy(*orders[request.get("sort_by", "score")], "uid").limit(request.get("limit", 20))
