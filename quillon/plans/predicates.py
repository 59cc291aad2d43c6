"""Structured predicates: lists of (column, op, value) as Columns that the scan can push down."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def like_any_case(column: str, value: str) -> Column:
    """column contains value, whatever the case; % and _ in value are ordinary characters."""
    return F.contains(F.lower(F.col(column)), F.lit(value.lower()))


def word_match(column: str, *words: str) -> Column:
    """column has one of words between word boundaries, whatever the case."""
    return F.col(column).rlike(r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b")


def pattern_mask(column: str, patterns: Iterable[str]) -> Column:
    """column matches one of patterns, whatever the case."""
    return F.col(column).rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def pattern_evidence(column: str, patterns: Iterable[str]) -> Column:
    return F.regexp_extract(F.col(column), "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")", 0)


#: Types whose columns compare as they are, so that the comparison reaches the scan.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _number(value):
    x = float(value)
    return int(x) if x.is_integer() else x


def predicate(column: str, op: str, value, numeric: bool, kind: str = "string") -> Column:
    """One predicate. Rows whose value is null or no number don't pass.

    kind: the column's type. A numeric column is compared with a plain literal, which the scan takes; strings compare
    whatever their case, which no scan can, so only their being there is pushed down.
    """
    c = F.col(column)
    if op == "contains":
        return like_any_case(column, str(value))
    if op == "contains_any":
        return word_match(column, *(v for v in str(value).split("|") if v))
    if op != "in" and op not in COMPARE:
        raise ValueError(f"unknown operation {op!r}")
    if numeric:
        left = c if kind in NUMBERS or kind.startswith("decimal") else c.try_cast("double")
        right = [_number(v) for v in value] if op == "in" else _number(value)
    else:
        left = F.lower(c.cast("string"))
        right = [str(v).lower() for v in value] if op == "in" else str(value).lower()
    if op == "in":
        return left.isin(right)
    return {"eq": left == right, "ne": left != right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}[op]


def apply_predicates(df: DataFrame, predicates: list[dict], numeric: Iterable[str] = (), strict: bool = True) -> DataFrame:
    """Rows of df that pass all predicates (dicts with column, op, value).

    strict: an unknown column is an error; otherwise its predicate is left out. An unknown operation is always an error.
    Each predicate is a filter of its own, so that Catalyst can push down those that the scan understands.
    """
    numeric, kinds = set(numeric), dict(df.dtypes)
    for p in predicates:
        if p["column"] not in kinds:
            if strict:
                raise KeyError(f"no column {p['column']!r}")
            continue
        df = df.where(predicate(p["column"], p["op"], p["value"], p["column"] in numeric, kinds[p["column"]]))
    return df


FORBIDDEN = re.compile(r"\b(?:attach|detach|pragma|insert|update|delete|drop|alter|create|replace|vacuum|merge|truncate|grant|revoke|load|refresh|cache)\b", re.IGNORECASE)


def guard(sql: str, table: str) -> str:
    """sql, if it is one SELECT from table alone; an error otherwise. Strings and quoted names don't count as keywords."""
    from quillon.plans.dialect import masked

    bare = masked(sql.strip().rstrip(";"))
    if ";" in bare:
        raise ValueError("more than one statement")
    if not re.match(r"\s*select\b", bare, re.IGNORECASE):
        raise ValueError("not a SELECT")
    if m := FORBIDDEN.search(bare):
        raise ValueError(f"{m[0]} is not allowed")
    found = {m[1].strip('`"').lower() for m in re.finditer(r"\b(?:from|join)\s+([\w.`\"]+)", bare, re.IGNORECASE)}
    if found != {table.lower()}:
        raise ValueError(f"reads {sorted(found)}, not {table}")
    return sql.strip().rstrip(";")
