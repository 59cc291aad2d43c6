"""Structured filters read from a question in words, by vocabulary and comparators."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillon.plans import dialect, predicates


@dataclass(frozen=True)
class StructuredFilter:
    column: str
    op: str
    value: str
    source: str


# Comparators in words and the operation that each means.
COMPARATORS = (
    (r"(?:from|since)\s+{n}\s+(?:onwards?|on)", "ge"),
    (r"(?:at least|no less than|not under)\s+{n}", "ge"),
    (r"(?:at most|no more than|up to|not over)\s+{n}", "le"),
    (r"(?:after|since|over|above|more than|longer than|greater than)\s+{n}", "gt"),
    (r"(?:before|under|below|less than|shorter than|fewer than)\s+{n}", "lt"),
)
EXPLICIT = r"\b{c}\s*(?:=|:|\bis\b|\bequals\b)\s*['\"]?([\w$.-]+)"
CONTAINS = r"\b{c}\s+contains\s+['\"]?([\w$.-]+)"


def extract(question: str, columns, year: str | None = "year", minutes: str | None = "runtime", vocabulary: dict[str, tuple[str, ...]] | None = None, named: dict[str, str] | None = None, compat: bool = False) -> list[StructuredFilter]:
    """Filters of question on columns, each once, in the order of the text's rules.

    year, minutes: columns for years (19xx, 20xx) and for numbers with 'minutes'. vocabulary: column to words whose
    mention is a contains filter, an s at the end aside. named: column to a phrase after which its value stands, such as
    'directed by'. compat: a year that a comparator uses is also an equality, which leaves nothing; off by default.
    """
    columns, out = list(columns), []

    def add(column, op, value, source):
        f = StructuredFilter(column, op, str(value).strip(), source)
        if column in columns and f not in out:
            out.append(f)

    taken = set()
    for column, number in ((year, r"((?:19|20)\d\d)"), (minutes, r"(\d+)\s*(?:-\s*)?min(?:ute)?s?")):
        if not column:
            continue
        for said, op in COMPARATORS:
            for m in re.finditer(said.format(n=number), question, re.IGNORECASE):
                if m.start(1) not in taken:
                    taken.add(m.start(1))
                    add(column, op, m[1], m[0])
    for m in re.finditer(r"\b((?:19|20)\d\d)\b", question) if year else ():
        if compat or m.start(1) not in taken:
            add(year, "eq", m[1], m[0])
    for column, words in (vocabulary or {}).items():
        for w in words:
            if m := re.search(rf"\b{re.escape(w)}s?\b", question, re.IGNORECASE):
                add(column, "contains", w, m[0])
    for column, phrase in (named or {}).items():
        if m := re.search(rf"\b{phrase}\s+((?:[A-Z][\w'.-]*)(?:\s+[A-Z][\w'.-]*)*)", question):
            add(column, "contains", m[1].rstrip("."), m[0])
    for column in columns:
        for said, op in ((EXPLICIT, "eq"), (CONTAINS, "contains")):
            for m in re.finditer(said.format(c=re.escape(column)), question, re.IGNORECASE):
                add(column, op, m[1].rstrip("."), m[0])
    for m in re.finditer(r"\$(\d+(?:\.\d\d)?)", question):
        add("price", "contains", "$" + m[1], m[0])
    return out


def prune(df: DataFrame, table: str, question: str, sql: str | None = None, numeric=(), **known) -> tuple[DataFrame, str, list[StructuredFilter], str | None]:
    """(rows, mode, filters, error): rows of df that the structured part of a question keeps.

    With sql (a query string, as a parser gave it) its WHERE is used if it passes the guard: mode 'sql'; if not, mode
    'rules_fallback' with the error. Without sql, mode 'rules'.
    """
    error = None
    if sql:
        try:
            q = dialect.parse(sql)
            where = f" WHERE {q.where}" if q.where else ""
            predicates.guard(f"SELECT * FROM {table}{where}", table)
            return (df.where(q.where) if q.where else df), "sql", [], None
        except Exception as e:  # whatever a parser wrote: the rules take over, and the result says so
            error = f"{type(e).__name__}: {e}"
    found = extract(question, df.columns, **known)
    kept = predicates.apply_predicates(df, [{"column": f.column, "op": f.op, "value": f.value} for f in found], numeric, strict=False)
    return kept, "rules_fallback" if sql else "rules", found, error
