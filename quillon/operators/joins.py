"""Joins by exact id and the semantic joins that judge (row, text) pairs in batches."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import token_count, token_count_py
from quillon.operators.cascade import bisect
from quillon.sources.judges import YES, Judge
from quillon.sources.stored import store, with_ordinal


def ordered_semi_join(df: DataFrame, key: str, chosen: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of df whose key chosen (key, ordinal) has, with the first ordinal that it has there."""
    first = chosen.groupBy(key).agg(F.min(ordinal).alias(ordinal))
    return df.join(first, key)


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child that refer to no row of parent."""
    return child.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left_anti")


def lookup_list(df: DataFrame, key: str, list_col: str, names: DataFrame, names_key: str, name: str, out: str, sep: str = ",") -> DataFrame:
    """key, out: the ids in list_col replaced by their names, in order, each name once, joined by ', '."""
    each = df.select(key, F.posexplode(F.split(list_col, sep)).alias("__pos", "__id")).withColumn("__id", F.trim("__id"))
    named = each.join(names.select(F.col(names_key).alias("__n"), F.col(name).alias("__name")), F.col("__id") == F.col("__n"))
    got = F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__name"))), lambda x: x["__name"])
    return named.groupBy(key).agg(F.array_join(F.array_distinct(got), ", ").alias(out))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def dry_run_join(entities: DataFrame, texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """The pairs by id whose text has one of terms, whatever the case: what a judge of those terms would say."""
    return entities.join(texts, key).where(F.col(text).rlike("(?i)(?:" + "|".join(terms) + ")"))


def mean_tokens(df: DataFrame, text: str) -> DataFrame:
    """tokens: the mean of the column's token counts; 1 without rows."""
    return df.agg(F.coalesce(F.avg(token_count(F.col(text).cast("string"))), F.lit(1.0)).alias("tokens"))


def optimal_block(mean1: float, mean2: float, result: float, prompt: int, budget: int, selectivity: float) -> tuple[int, int]:
    """Rows of the two blocks that fill a token budget best: tokens b1*mean1 + b2*mean2 + b1*b2*selectivity*result + prompt.

    At the optimum both sides cost the same; the quadratic in that common cost gives it.
    """
    room = max(budget - prompt, 1)
    a = selectivity * result / (mean1 * mean2)
    cost = (-2 + (4 + 4 * a * room) ** 0.5) / (2 * a) if a > 0 else room / 2
    return max(1, int(cost / mean1)), max(1, int(cost / mean2))


def completion_cap(rows: int, budget: int, cap: int = 512) -> int:
    return min(budget, cap, max(48, 16 + 16 * rows))


def pack(sizes: list[int], budget: int, most: int, wanted: int = 16, prompt: int = 0, state: list | None = None) -> list[int]:
    """Batch numbers of rows in order: a batch closes when its rows would be more than most, or leave less than wanted
    completion tokens a row; a row that alone is too large has a batch of its own.

    state (batch, tokens, rows) carries an open batch from one call to the next.
    """
    out, state = [], [0, 0, 0] if state is None else state
    for s in sizes:
        batch, used, rows = state
        if rows and (rows + 1 > most or budget - prompt - used - s < wanted * (rows + 1)):
            batch, used, rows = batch + 1, 0, 0
        out.append(batch)
        state[:] = batch, used + s, rows + 1
    return out


def packed(rows: DataFrame, budget: int = 4096, most: int = 25, wanted: int = 16) -> DataFrame:
    """rows (ordinal, text) with batch, packed by token count within ranges of the order.

    Each range of the ordinal is packed for itself, so a range's last batch may be small; names are (range, number).
    """

    def run(batches):
        state = [0, 0, 0]
        for b in batches:
            yield pd.DataFrame({"ordinal": b["ordinal"], "range": b["range"], "batch": pack(b["tokens"].tolist(), budget, most, wanted, state=state)})

    sized = rows.select("ordinal", token_count(F.col("text")).alias("tokens"))
    ranged = sized.repartitionByRange("ordinal").sortWithinPartitions("ordinal").withColumn("range", F.spark_partition_id())
    numbered = store(ranged.mapInPandas(run, "ordinal long, range int, batch long"), "packed")
    return rows.join(numbered, "ordinal")


@dataclass
class JoinOutcome:
    """rows: the pairs that pass. calls: id of the call, rows, tokens, overflow."""

    rows: DataFrame
    calls: DataFrame


#: Rows that Python gets at once, as whole calls: a group for each call costs more than a small call does.
ROWS = 1024


def asked(rows: DataFrame, text: str, by: list[str], carried: list[str], ask) -> DataFrame:
    """ordinal, carried, by, passed, overflow of rows (ordinal, text, carried, by): those that share by are one call.

    ask gets a call's texts by ordinal and gives whether each passes, and whether the call overflows. Calls are dealt whole
    to groups of some ROWS rows. A carried text is null where it doesn't pass.
    """
    kept = ["ordinal", *carried, *by]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([*by, "ordinal"], ignore_index=True)
        texts, passed, overflow = g[text].fillna("").tolist(), [], []
        starts = g.index[(g[by] != g[by].shift()).any(axis=1)].tolist()
        for lo, hi in zip(starts, [*starts[1:], len(g)]):
            said, over = ask(texts[lo:hi])
            passed += said
            overflow += [over] * (hi - lo)
        out = g[kept].assign(passed=passed, overflow=overflow)
        return out.assign(**{text: out[text].where(out["passed"], None)}) if text in carried else out

    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*by), F.lit(rows.count() // ROWS + 1)))
    schema = rows.select(*kept).schema.add("passed", "boolean").add("overflow", "boolean")
    return store(dealt.groupBy("__deal").applyInPandas(run, schema), "joined")


def single_pass_join(entities: DataFrame, texts: DataFrame, key: str, text: str, question: str, judge: Judge, budget: int = 4096, most: int = 25, retry: bool = False) -> JoinOutcome:
    """Rows paired by id up front, packed into calls by token budget. An id that a call omits is a no, or with retry halved."""
    joined = entities.join(texts.select(F.col(key).alias("__k"), F.col(text).alias("__t")), F.col(key) == F.col("__k"))
    p = store(with_ordinal(joined, key, "__t"), "pairs")
    b = packed(p.select("ordinal", F.col("__t").alias("text")), budget, most)

    def ask(t: list[str]) -> tuple[list[bool], bool]:
        got = judge.decide(t, question)
        overflow = any(i not in got for i in range(len(t)))
        if overflow and retry:
            return [bool(x) for x in bisect(t, question, judge)[0]], overflow
        return [got.get(i) == YES for i in range(len(t))], overflow

    said = asked(b.withColumn("tokens", token_count(F.col("text")).cast("long")), "text", ["range", "batch"], ["tokens"], ask)
    rows = p.join(said.where("passed").select("ordinal"), "ordinal").drop("__k", "ordinal").withColumnRenamed("__t", text if text not in entities.columns else f"text_{text}")
    calls = said.groupBy("range", "batch").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.max("overflow").alias("overflow"))
    return JoinOutcome(rows, calls)


def block_join(entities: DataFrame, texts: DataFrame, key: str, text: str, question: str, judge: Judge, size1: int, size2: int, budget: int | None = None, prompt: int = 64) -> JoinOutcome:
    """Blocks of both sides; every pair of blocks that shares an id is one call, over the rows that share one.

    The blocks that meet come from an equi-join of their ids, so pairs of blocks without a common id never exist. With a
    budget of tokens, a call has what its rows and the prompt leave of it for the completion, up to completion_cap; a call
    that would have none is refused. Refused and incomplete calls overflow.
    """
    return _block_calls(entities, _met(entities, texts, key, text), key, text, question, judge, size1, size2, budget, prompt)


def _met(entities: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """k, t, n, ordinal: texts whose id entities has, with the ranks of the id among those of entities and of the text among all texts.

    A text without an entity only counts: its id stands for it in the sort.
    """
    left = with_ordinal(entities.select(F.col(key).alias("k")).distinct(), "k", name="n")
    right = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).join(left, "k", "left").withColumn("t", F.when(F.col("n").isNotNull(), F.col("t")))
    return with_ordinal(right, "k", "t").where("n IS NOT NULL")


def _block_calls(entities: DataFrame, met: DataFrame, key: str, text: str, question: str, judge: Judge, size1: int, size2: int, budget: int | None, prompt: int) -> JoinOutcome:
    blocks = met.withColumns({"block1": F.floor((F.col("n") - 1) / size1), "block2": F.floor((F.col("ordinal") - 1) / size2)}).drop("n")

    def ask(t: list[str]) -> tuple[list[bool], bool]:
        room = None if budget is None else budget - prompt - sum(map(token_count_py, t))
        got = judge.decide(t, question) if room is None else judge.decide_within(t, question, completion_cap(len(t), room)) if room > 0 else {}
        return [got.get(i) == YES for i in range(len(t))], any(i not in got for i in range(len(t)))

    said = asked(blocks, "t", ["block1", "block2"], ["k", "t"], ask)
    passed = said.where("passed").select(F.col("k").alias("__k"), F.col("t").alias(text if text not in entities.columns else f"text_{text}"))
    calls = said.groupBy("block1", "block2").agg(F.count("*").alias("rows"), F.max("overflow").alias("overflow"))
    return JoinOutcome(entities.join(passed, F.col(key) == F.col("__k")).drop("__k"), calls)


def adaptive_join(entities: DataFrame, texts: DataFrame, key: str, text: str, question: str, judge: Judge, budget: int = 4096, selectivity: float = 0.001, factor: float = 4.0, rounds: int = 6, result: float = 8.0) -> JoinOutcome:
    """block_join with block sizes from an estimate of selectivity, raised by factor until no call overflows."""
    m1, m2 = (mean_tokens(df, c).first()[0] for df, c in ((entities, key), (texts, text)))
    out, prompt, met = None, 64, _met(entities, texts, key, text)  # rounds differ in the sizes of blocks alone
    for _ in range(rounds):
        b1, b2 = optimal_block(m1, m2, result, prompt, budget, selectivity)
        out = _block_calls(entities, met, key, text, question, judge, b1, b2, budget, prompt)
        if out.calls.where("overflow").isEmpty():
            break
        selectivity *= factor
    return out
