import re
from collections import Counter

import duckdb

from quillon.llm import rules

W = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e",
    "a b c d e a b c d e",
    "a " * 9,
    "x y\n" * 12,
    "# ## $ <|> & % * |\n\n#",
    "é 𝄞 ß x   y\x0bz\x1fq",
    "a b c d e f g h a b c d e f i j k a b c d e",
    " ".join(f"w{i}" for i in range(30000)),
    "lorem ipsum dolor sit amet " * 4000,
    "THE END!! OF ALL!! THINGS!! IS NEAR!! SO RUN!! AWAY!! NOW!! OR!! NEVER!! AGAIN!!",
    "the quick brown fox jumps over the lazy dog and then it goes home to sleep for the night",
    "same line here\nsame line here \nsame line here\n\n \nother",
]


def brute(text):
    t = text or ""
    w = W.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    rep = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed)


def test_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as f", "2 as n_words", "'k' as kept")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    for i, t in enumerate(TEXTS):
        q = got[i].quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(t), i
        assert got[i].text == t and got[i].kept == "k"
        assert not (q.base_failed and q.kept)
    assert got[14].quality.kept and not got[13].quality.kept and not got[8].quality.kept


def test_empty(spark):
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.doc_id: r.quality.kept for r in rules.judge(docs).collect()}
    b = {r.doc_id: r.quality.kept for r in rules.judge(docs, rules.RULES[::-1], sample_rows=0).collect()}
    assert a == b


def test_cheap_and_selective_rules_come_first(spark):
    from pyspark.sql import functions as F

    few = [rules.Rule("never", (), lambda e: F.lit(False)), rules.Rule("most", ("n_words",), lambda e: e["n_words"] < 200)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    (first, rejected, _), _ = rules.plan(docs, few)
    assert first.name == "most" and rejected > 0


def test_keep_is_the_same_cascade(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(-1 - i, t, None, None, None) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long"))
    want = sorted(r.doc_id for r in rules.judge(docs).where("quality.kept").collect())
    assert sorted(r.doc_id for r in rules.keep(docs).collect()) == want == sorted(r.doc_id for r in rules.keep(docs, (*rules.RULES[::-1], *rules.BASE), sample_rows=0).collect())
    assert rules.keep(docs).columns == docs.columns and rules.keep(docs.where("false")).count() == 0


def test_rejected_texts_pay_for_one_rule(spark):
    """A rule after one that rejects is not evaluated: here it would fail."""
    from pyspark.sql import functions as F

    broken = rules.Rule("broken", ("words",), lambda e: F.raise_error(F.lit("asked")).cast("boolean"))
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert rules.keep(docs, (rules.BASE[0], broken), sample_rows=0).count() == 0


def test_clashing_column(spark):
    import pytest

    with pytest.raises(ValueError):
        rules.judge(spark.createDataFrame([("a", 1)], "text string, quality int"))


def test_query_and_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    rows = con.execute(rules.OP4_SQL).fetchall()
    got = [tuple(r) for r in rules.op4_quality_rules(spark, d).collect()]
    assert sorted(got) == sorted(rows)
