"""Quality rules as a short-circuit cascade, by DataFrame functions only.

A rule is a name, the counts that it needs and a condition on them that rejects a text. plan() measures each rule on a
bounded sample: the share that it rejects and the seconds that it takes, its counts included. The cascade asks the rules in
order of rejections per second; a rule, and each count that no rule before it needed, is evaluated only for texts that all
rules before it let through. The order can differ between runs, the verdict can't: a text is kept if no rule rejects it.

keep() filters by the whole cascade, the base rules among the others. judge() returns the counts as well, so there they are
worked out for every text and the cascade only chooses among the conditions.

Windows of five words are compared within one text by a 64-bit hash of their words: two different windows of a text of n
words are taken for equal with a chance below n * n / 2 ** 65. Only texts in which a hash occurs twice are sorted for the
positions; the others have no repeated words.

Defined results: a null text counts as empty; an empty text has no words and fails the base rules; an empty table gives an
empty result (the rules then keep their given order); rows are judged one by one, so ties and repeated rows get the same
verdict; very long texts take time in proportion to their length (sorting aside); other columns are left alone, and a column
named as judge()'s result is an error.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import WORD, let, settle, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows, about, on which the rules' costs and selectivities are estimated; a bound of the estimate, not of what is judged.
SAMPLE_ROWS = 2000
#: Tasks over which the sample is spread.
SAMPLE_PARTS = 8


def _repeated(w: Column, span: int = WINDOW) -> Column:
    """Words of w that lie in a window of span words found twice or more in w."""

    def hashed(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - span + 1), lambda i: F.xxhash64(*(F.element_at(ws, i + k) for k in range(span))))

    def covered(hs: Column) -> Column:
        ranked = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, F.when(k + 1 < n, k + 1))), lambda x: x["i"]))

        count = lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-span).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(x - a["last"], F.lit(span))).cast("long").alias("n"), x.alias("last")),
            lambda a: a["n"],
        )
        return let(let(ranked, positions), count)

    zero = F.lit(0).cast("long")
    some = lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(zero)
    return F.when(F.size(w) > span, let(hashed(w), some)).otherwise(zero)


def _long(c: Column) -> Column:
    return c.cast("long")


# What rules can need: from the text and what they need themselves, in an order in which each can be made.
MADE = {
    "words": ((), lambda e: words(e["text"])),
    "n_words": (("words",), lambda e: _long(F.size(e["words"]))),
    "word_chars": ((), lambda e: _long(F.length(F.translate(e["text"], " \t\n\x0b\x0c\r", "")))),
    "n_symbols": ((), lambda e: _long(F.length(e["text"]) - F.length(F.translate(e["text"], SYMBOLS, "")))),
    "lines": ((), lambda e: F.filter(F.split(e["text"], "\n", -1), lambda x: x.rlike(WORD))),
    "n_lines": (("lines",), lambda e: _long(F.size(e["lines"]))),
    "n_dup_lines": (("lines",), lambda e: _long(F.size(e["lines"]) - F.size(F.array_distinct(e["lines"])))),
    "n_repeat_words": (("words",), lambda e: _repeated(e["words"])),
}
NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _with(needs, env: dict, body) -> Column:
    """body(env with needs): what env lacks is computed once for each row that gets here."""
    for n in needs:
        if n not in env:
            before, make = MADE[n]
            if any(b not in env for b in before):
                return _with(before, env, lambda e: _with(needs, e, body))
            return let(make(env), lambda c: _with(needs, env | {n: c}, body))
    return body(env)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def features(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of a text."""
    return let(whole(text), lambda t: _with(NAMES, {"text": t}, lambda e: F.struct(*(e[k].alias(k) for k in NAMES))))


@dataclass(frozen=True)
class Rule:
    """rejects(e): a condition, never null, on e["text"] and on what needs names (keys of MADE)."""

    name: str
    needs: tuple
    rejects: object


def share(e: dict, pattern: str) -> Column:
    """Characters of the text that match pattern, by 100 characters of words."""
    t = e["text"]
    return 100 * (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / F.greatest(e["word_chars"], F.lit(1))


def stutters(w: Column) -> Column:
    """Words of w that equal the word before them."""
    return F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))


BASE = (
    Rule("few_words", ("n_words",), lambda e: e["n_words"] < 10),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda e: e["n_repeat_words"] * 100 > e["n_words"] * 20),
)
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda e: e["n_symbols"] * 10 > e["n_words"]),
    Rule("short_words", ("word_chars", "n_words"), lambda e: e["word_chars"] * 10 < e["n_words"] * 25),
    Rule("long_words", ("word_chars", "n_words"), lambda e: e["word_chars"] > e["n_words"] * 12),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda e: e["n_dup_lines"] * 100 > e["n_lines"] * 50),
    Rule("capitals", ("word_chars",), lambda e: share(e, r"\p{Lu}+") > 40),
    Rule("no_letters", ("word_chars",), lambda e: share(e, r"[\p{L}\p{M}]+") < 40),
    Rule("stops", ("word_chars",), lambda e: share(e, r"[!?]{2,}") > 5),
    Rule("stutter", ("words", "n_words"), lambda e: stutters(e["words"]) * 100 > e["n_words"] * 30),
)


def verdict(rules, env: dict) -> Column:
    """True if none of rules rejects. Each is asked, and what it needs is made, only if those before it did not reject."""
    if not rules:
        return F.lit(True)
    return _with(rules[0].needs, env, lambda e: F.when(rules[0].rejects(e), F.lit(False)).otherwise(verdict(rules[1:], e)))


def plan(sample: DataFrame, rules, known: str | None = None) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds a row) in the order in which a cascade asks them, measured on sample.

    sample: text, and in known a struct of the counts that cost the rules nothing.
    """
    env = {"text": F.col("text")} | ({k: F.col(known)[k] for k in NAMES} if known else {})
    n = sample.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    none = min(_timed(sample, F.lit(False))[1] for _ in range(3))
    found = []
    for r in rules:
        both = [_timed(sample, ~verdict([r], env)) for _ in range(2)]
        found.append((r, both[0][0] / n, max(min(t for _, t in both) - none, 1e-4) / n))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def _timed(sample: DataFrame, condition: Column) -> tuple[int, float]:
    began = time.perf_counter()
    n = sample.agg(F.coalesce(F.sum(condition.cast("int")), F.lit(0))).first()[0]
    return n, time.perf_counter() - began


def sampled(texts: DataFrame, rows: int) -> DataFrame:
    """About rows of texts, from all of its partitions alike, stored. Only what is drawn is shuffled."""
    n = texts.count()
    some = texts.sample(min(1.0, rows / n), seed=1) if n else texts
    return settle(some.repartition(SAMPLE_PARTS), "rules-sample")


def _clear(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(whole(F.col(text)).alias("text"))


def keep(docs: DataFrame, rules=(*BASE, *RULES), text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns as they are."""
    order = [r for r, _, _ in plan(sampled(_clear(docs, text), sample_rows), rules)] if sample_rows else list(rules)
    return docs.where(let(whole(F.col(text)), lambda t: verdict(order, {"text": t})))


def judge(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, out: str = "quality") -> DataFrame:
    """docs with a struct column out: the counts, base_failed (by BASE) and kept (no rule rejects, neither of BASE nor of rules)."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out!r}")
    order = list(rules)
    if sample_rows:
        some = sampled(_clear(docs, text), sample_rows).select("text", features(F.col("text")).alias("f"))
        order = [r for r, _, _ in plan(settle(some, "rules-counts"), rules, "f")]

    def made(t: Column, f: Column) -> Column:
        env = {"text": t} | {k: f[k] for k in NAMES}
        failed = ~verdict(BASE, env)
        return F.struct(*(f[k].alias(k) for k in NAMES), failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(order, env)).alias("kept"))

    return docs.withColumn(out, let(whole(F.col(text)), lambda t: let(features(t), lambda f: made(t, f))))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document, whole texts; a null text counts as empty."""
    done = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", *(F.col("quality")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


#: The same counts and verdict for DuckDB.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM q) GROUP BY r),
f AS (SELECT doc_id, t, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars * 10 < n_words * 25 OR word_chars > n_words * 12
            OR n_dup_lines * 100 > n_lines * 50
            OR 100 * (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g'))) / greatest(word_chars, 1) > 40
            OR 100 * (length(t) - length(regexp_replace(t, '[\p{L}\p{M}]+', '', 'g'))) / greatest(word_chars, 1) < 40
            OR 100 * (length(t) - length(regexp_replace(t, '[!?]{2,}', '', 'g'))) / greatest(word_chars, 1) > 5
            OR n_stutters * 100 > n_words * 30) AS kept
FROM b
"""
