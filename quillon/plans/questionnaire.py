"""The catalogue of benchmark questions: a structured part as predicates on roles, and a topic of the text.

Roles (kind, year, minutes, person, title) are mapped to a table's columns when a question is asked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans import predicates


@dataclass(frozen=True)
class Question:
    """structured: alternatives, each a list of (role, op, value); a row passes if one of them passes whole."""

    suite: str
    name: str
    structured: tuple[tuple[tuple[str, str, object], ...], ...]
    topic: str

    def text(self) -> str:
        return f"does the text speak of {self.topic}?"


def _one(suite: str, topic: str, *parts) -> Question:
    return Question(suite, f"{suite}/{topic}", (parts,), topic)


# The shapes of the structured parts and the topics, by suite.
QUESTIONS: tuple[Question, ...] = (
    _one("movies-historical", "recommendation", ("year", "eq", 1999)),
    _one("movies-historical", "fun", ("kind", "contains", "comedy"), ("minutes", "lt", 100)),
    _one("movies-historical", "fear", ("kind", "contains", "horror"), ("minutes", "ge", 80), ("minutes", "le", 110)),
    _one("movies-historical", "acting", ("kind", "contains", "drama")),
    _one("movies-historical", "visuals", ("kind", "contains", "action"), ("kind", "contains", "adventure")),
    _one("movies-historical", "chemistry", ("person", "contains", "nolan")),
    _one("movies-historical", "pacing", ("title", "contains", "night")),
    _one("movies", "humour", ("kind", "contains", "comedy")),
    _one("movies", "acting", ("kind", "contains", "drama"), ("year", "ge", 2000)),
    _one("movies", "chemistry", ("kind", "contains", "romance"), ("minutes", "ge", 90), ("minutes", "le", 120)),
    _one("movies", "excitement", ("kind", "contains", "action"), ("minutes", "ge", 100)),
    Question("movies", "movies/ending", ((("kind", "contains", "thriller"),), (("kind", "contains", "mystery"),)), "the ending"),
    _one("movies", "soundtrack", ("kind", "contains", "music"), ("year", "lt", 2000)),
    _one("movies", "emotion", ("kind", "contains", "family"), ("minutes", "le", 100)),
    *(_one("products", t, ("title", "contains", k)) for k, t in (("shoe", "comfort"), ("dress", "size"), ("blanket", "softness"), ("jacket", "warmth"), ("hat", "sun"), ("boot", "walking"), ("bag", "durability"))),
    *(_one("products-held-out", t, ("title", "contains", k)) for k, t in (("ring", "tarnish"), ("belt", "adjustment"), ("shirt", "itching"), ("jeans", "sizing"), ("bra", "support"), ("leggings", "sheerness"))),
)


def candidates(df: DataFrame, question: Question, columns: dict[str, str], values: dict | None = None) -> DataFrame:
    """Rows of df that pass the structured part. columns: role to column; values: replaces values that a table has otherwise."""
    kinds, values = dict(df.dtypes), values or {}

    def whole(parts):
        tests = [predicates.predicate(columns[r], op, values.get(v, v), kinds[columns[r]] != "string", kinds[columns[r]]) for r, op, v in parts]
        return reduce(lambda a, b: a & b, tests)

    return df.where(F.coalesce(reduce(lambda a, b: a | b, map(whole, question.structured)), F.lit(False)))
