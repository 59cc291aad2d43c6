"""Semantic filters: relational operators over rows that all structured filters have already passed."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import SHORT, SUMMARY
from quillon.plans.dialect import SemanticQuery, parse
from quillon.sources.judges import Judge
from quillon.sources.stored import store


def _short(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < SHORT


def judged(df: DataFrame, text: str, question: str, judge: Judge, out: str = "answer", cache: AnswerCache | None = None) -> DataFrame:
    """df with the answer to question in column out.

    Short texts are No without a call. A judge in Python is called once for each distinct text, and its answers are stored
    before they are joined back, so that no rerun pays twice; with a cache, what an earlier query asked is not asked again.
    A failure counts as No.
    """
    native = judge.answer_column(F.col(text), question)
    if native is not None:
        return df.withColumn(out, F.when(_short(F.col(text)), "No").otherwise(native))
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)

    def call(batches):
        for b in batches:
            yield pd.DataFrame({"__key": b["__key"], "__answer": [a or "No" for a in judge.answers(b["__text"].tolist(), question)]})

    wanted = df.where(~_short(F.col(text))).select(key.alias("__key"), F.col(text).alias("__text")).groupBy("__key").agg(F.first("__text").alias("__text"))
    if cache is not None:
        old = store(cache.known(question), "known")
        wanted = wanted.join(old, "__key", "left_anti")
    told = store(wanted.mapInPandas(call, "__key string, __answer string"), "answers")
    if cache is not None:
        cache.learn(question, told)
        told = told.unionByName(old)
    return df.withColumn("__k", key).join(told, F.col("__k") == F.col("__key"), "left").withColumn(out, F.coalesce("__answer", F.lit("No"))).drop("__k", "__key", "__answer")


def sem_filter(df: DataFrame, text: str, question: str, judge: Judge, expected: str = "Yes") -> DataFrame:
    """Rows whose answer equals expected, whatever the case."""
    return judged(df, text, question, judge, "__said").where(F.lower(F.trim("__said")) == expected.strip().lower()).drop("__said")


def summary(df: DataFrame, text: str, judge: Judge, out: str) -> DataFrame:
    """df with a summary of text: '(no review)' for short ones; the judge reads the first SUMMARY characters."""

    @F.pandas_udf("string")
    def call(t: pd.Series) -> pd.Series:
        return pd.Series(judge.summaries(t.tolist()))

    return df.withColumn(out, F.when(_short(F.col(text)), "(no review)").otherwise(call(F.substring(F.coalesce(text, F.lit("")), 1, SUMMARY))))


def run(spark: SparkSession, query: str | SemanticQuery, judge: Judge, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A query of the dialect: relational filters, then the semantic ones in their order, then order, limit and select list."""
    q = parse(query) if isinstance(query, str) else query
    df = (tables or {}).get(q.table)
    df = spark.table(q.table) if df is None else df
    if q.where:
        df = df.where(q.where)
    for p in q.predicates:
        df = sem_filter(df, p.column, p.question, judge, p.expected)
    wanted = []
    for n, (expr, alias) in enumerate(q.items):
        if isinstance(expr, tuple):
            # a limit comes before the calls
            df = df if q.limit is None or q.group else _relational(df, q, "*", True)
            df = summary(df, expr[1], judge, f"__summary{n}")
            wanted.append(f"`__summary{n}` AS `{alias}`")
        elif expr == "*":
            wanted += [f"`{c}`" for c in df.columns if not c.startswith("__summary")]
        else:
            wanted.append(f"{expr} AS `{alias}`" if alias else expr)
    return _relational(df, q, ", ".join(wanted))


def _relational(df: DataFrame, q: SemanticQuery, items: str, plain: bool = False) -> DataFrame:
    """What Spark SQL does of a query once its filters have run; plain: only order and limit."""
    parts = ["SELECT DISTINCT" if q.distinct and not plain else "SELECT", items, "FROM {rows}"]
    if q.group and not plain:
        parts += ["GROUP BY", q.group, *(["HAVING", q.having] if q.having else [])]
    if q.order:
        parts += ["ORDER BY", ", ".join(q.order)]
    if q.limit is not None:
        parts += ["LIMIT", str(q.limit)]
    return df.sparkSession.sql(" ".join(p.replace("{", "{{").replace("}", "}}") if p != "FROM {rows}" else p for p in parts), rows=df)


class AnswerCache:
    """Answers that outlive a query: a table at path of the digests of questions and texts, and what was said.

    judged() asks only for texts whose digest the table lacks and appends what it learns.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], "question string, __key string, __answer string").write.mode("ignore").parquet(path)

    def known(self, question: str) -> DataFrame:
        # a text that two writers learnt of at once has one answer
        rows = self.spark.read.parquet(self.path).where(F.col("question") == hashlib.sha256(question.encode()).hexdigest())
        return rows.groupBy("__key").agg(F.min("__answer").alias("__answer"))

    def learn(self, question: str, told: DataFrame) -> None:
        told.select(F.lit(hashlib.sha256(question.encode()).hexdigest()).alias("question"), "__key", "__answer").write.mode("append").parquet(self.path)


def register(spark: SparkSession, judge: Judge) -> None:
    """sem_answer(text, question) and sem_summary(text) for Spark SQL: sugar; run() places the calls better."""

    @F.pandas_udf("string")
    def answer(t: pd.Series, q: pd.Series) -> pd.Series:
        out = pd.Series("No", index=t.index)
        for question, rows in t.groupby(q):
            some = rows[rows.fillna("").str.strip().str.len() >= SHORT]
            out[some.index] = [a or "No" for a in judge.answers(some.tolist(), question)]
        return out

    @F.pandas_udf("string")
    def summarise(t: pd.Series) -> pd.Series:
        return pd.Series(["(no review)" if len((x or "").strip()) < SHORT else y for x, y in zip(t, judge.summaries(t.tolist()))])

    spark.udf.register("sem_answer", answer)
    spark.udf.register("sem_summary", summarise)


def to_query(question: str, table: str, columns, text: str = "text", complete=None, **known) -> str:
    """The query string of a question in words: complete(prompt) is a model's answer; without it, the rules' filters."""
    from quillon.plans import dialect, questions

    if complete is not None:
        prompt = f"Table {table}({', '.join(columns)}). Write one SELECT for the question; ask of the text by answer({text}, 'question') = 'Yes'.\nQuestion: {question}"
        return dialect.first_statement(complete(prompt))
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    sign = {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    parts = [f"{f.column} ILIKE {quote('%' + f.value + '%')}" if f.op == "contains" else f"{f.column} {sign[f.op]} {f.value if f.value.replace('.', '', 1).isdigit() else quote(f.value)}" for f in questions.extract(question, columns, **known)]
    parts.append(f"answer({text}, {quote(dialect.semantic_part(question))}) = 'Yes'")
    return f"SELECT * FROM {table} WHERE {' AND '.join(parts)}"
