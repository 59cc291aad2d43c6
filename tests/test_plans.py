import pytest

from quillon.functions.text import excerpt, token_count_py
from quillon.plans import dialect, predicates, questions
from quillon.plans.dialect import SemPredicate
from quillon.plans.schema import pick_column
from quillon.sources import judges


def test_parse_query():
    q = dialect.parse("Sure:\n```sql\nSELECT id, summary(text) AS s FROM t WHERE (a LIKE 'x AND y' OR b = 1) AND answer(text, 'is it (very) good; ''really''?') = 'Yes' AND n BETWEEN 1 AND 5 ORDER BY n DESC, summary(text) LIMIT 7;\nnotes\n```")
    assert q.items == [("id", None), (("summary", "text"), "s")] and q.table == "t" and q.limit == 7 and q.order == ["n DESC"]
    assert q.predicates == [SemPredicate("text", "is it (very) good; 'really'?", "Yes")]
    assert q.where == "((a LIKE 'x AND y' OR b = 1)) AND n BETWEEN 1 AND 5" or q.where == "(a LIKE 'x AND y' OR b = 1) AND n BETWEEN 1 AND 5"


def test_only_semantic_predicates():
    q = dialect.parse("select * from t where answer(a, \"one\") = 'no' and answer(b, 'two') = 'Yes'")
    assert q.where is None and [p.column for p in q.predicates] == ["a", "b"]
    assert dialect.semantic_part("select * from t where answer(a, 'one') = 'no' and answer(b, 'two') = 'Yes'") == "one and two"


@pytest.mark.parametrize("where", ["answer(a, 'q') = 'Yes' OR b = 1", "answer(a, 'q') != 'No'", "answer(a, 'q') IN ('Yes')", "NOT answer(a, 'q') = 'Yes'", "(answer(a, 'q') = 'Yes' OR b = 1) AND c = 2"])
def test_unsupported_semantic_predicates(where):
    with pytest.raises(ValueError):
        dialect.parse(f"SELECT * FROM t WHERE {where}")


def test_query_from_predicates():
    sql = dialect.from_predicates("t", [{"column": "title", "op": "contains", "value": "o'neil"}], "fine?", columns=("id",))
    q = dialect.parse(sql)
    assert q.where == "title ILIKE '%o''neil%'" and q.predicates == [SemPredicate("text", "fine?", "Yes")]


def test_guard():
    assert predicates.guard("SELECT a FROM t WHERE b = 'drop table x; from y'", "t")
    for bad in ("DELETE FROM t", "SELECT 1 FROM t; SELECT 2 FROM t", "SELECT * FROM u", "SELECT * FROM t JOIN u", "WITH x AS (SELECT 1) SELECT * FROM t", "SELECT drop FROM t"):
        with pytest.raises(ValueError):
            predicates.guard(bad, "t")


def test_questions():
    f = lambda q, **k: [(x.column, x.op, x.value) for x in questions.extract(q, ["year", "runtime", "genres", "director", "price"], vocabulary={"genres": ("Drama", "Comedy")}, named={"director": "directed by"}, **k)]
    assert f("dramas after 1990 under 120 minutes directed by Jane Doe.") == [("year", "gt", "1990"), ("runtime", "lt", "120"), ("genres", "contains", "Drama"), ("director", "contains", "Jane Doe")]
    assert f("films of 1999") == [("year", "eq", "1999")]
    assert f("since 1990") == [("year", "gt", "1990")] and f("since 1990 onward") == [("year", "ge", "1990")]
    assert ("year", "eq", "1990") in f("after 1990", compat=True)
    assert f("runtime: 90 and costs $5") == [("runtime", "eq", "90"), ("price", "contains", "$5")]


def test_prune_falls_back(spark):
    df = spark.createDataFrame([(1, 1980), (2, 2000)], "id long, year int")
    rows, mode, found, error = questions.prune(df, "t", "after 1990", "SELECT * FROM t WHERE nonsense((", numeric=["year"])
    assert mode == "rules_fallback" and error and [r.id for r in rows.collect()] == [2] and len(found) == 1
    rows, mode, _, _ = questions.prune(df, "t", "x", "SELECT * FROM t WHERE year < 1990 AND answer(text, 'q') = 'Yes'")
    assert mode == "sql" and [r.id for r in rows.collect()] == [1]


def test_predicates_reject_what_they_do_not_know(spark):
    df = spark.createDataFrame([(1, "A")], "id long, s string")
    with pytest.raises(KeyError):
        predicates.apply_predicates(df, [{"column": "x", "op": "eq", "value": 1}])
    with pytest.raises(ValueError):
        predicates.apply_predicates(df, [{"column": "s", "op": "near", "value": 1}])
    assert predicates.apply_predicates(df, [{"column": "s", "op": "eq", "value": "a"}]).count() == 1
    assert predicates.apply_predicates(df, [{"column": "s", "op": "gt", "value": 1}], numeric=["s"]).count() == 0


def test_parsers():
    assert judges.parse_decision('{"decision": "no"}') == "NO" and judges.parse_decision("Well, Yes.") == "YES" and judges.parse_decision("uncertain, yes?") is None
    assert judges.parse_batch("PAIR_1: YES\npair 2 - no\n3) maybe\nROW_9: YES", 3) == {0: "YES", 1: "NO", 2: "UNCERTAIN"}
    assert judges.parse_batch('```json\n{"PAIR_1": "match", "2": "reject"}\n```', 2) == {0: "YES", 1: "NO"}
    assert judges.parse_batch('[{"id": "row 2", "decision": "no"}]', 2) == {1: "NO"}
    assert judges.parse_ids("tt12: no, tt1 yes; tt9", ["tt1", "tt12", "tt3"]) == {"tt12": "NO", "tt1": "YES"}
    assert judges.log_odds({" Yes": -0.1, "no": -2.1}) == pytest.approx(2.0)
    assert judges.log_odds({"yes": -9.0}) > 0 > judges.log_odds({"No": -0.01}) and judges.log_odds({"x": 0.0}) is None


def test_ids_are_looked_up(monkeypatch):
    """No pattern is compiled for a text, and an id after a bare one is read too."""
    import re

    made, compile = [], re.compile
    finditer = re.finditer
    monkeypatch.setattr(re, "compile", lambda *a: made.append(a) or compile(*a))
    monkeypatch.setattr(re, "finditer", lambda *a: made.append(a) or finditer(*a))
    for i in range(100):
        assert judges.parse_ids(f"xid{i}, id{i}0 and id{i}: no; id{i}: yes", [f"id{i}"]) == {f"id{i}": "NO"}
    assert judges.parse_ids("[id1, id2, a.b (c)] id-3 decision: 'Maybe'", ["id1", "id2", "id-3", "id", "a.b", "a.b (c)", "", "9"]) == {"id1": "YES", "id2": "YES", "a.b (c)": "YES", "id-3": "UNCERTAIN"}
    assert judges.parse_ids(None, ["a"]) == {} == judges.parse_ids("a", []) and not made


def test_batches_are_parsed_once(spark, monkeypatch):
    from quillon import catalog_parts

    asked, parse = [], judges.parse_batch
    monkeypatch.setattr(judges, "parse_batch", lambda text, n: asked.append(n) or parse(text, n))
    assert judges.parse_batches(["PAIR_1: YES\nPAIR_3: NO", "1) no", ""], [3, 1, 0]) == [["YES", None, "NO"], ["NO"], []]
    assert asked == [3, 1, 0]
    customers = spark.range(5000).selectExpr("id AS c_custkey", "CAST(0 AS int) AS c_nationkey", "'no' AS w")
    sizes = [len(r.xs) for r in catalog_parts._batches(customers, spark.createDataFrame([(0, "A")], "n_nationkey int, n_name string")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1024


def test_retries(monkeypatch):
    import io
    import urllib.error

    seen, waits = [], []

    def opened(request, timeout):
        seen.append(1)
        if len(seen) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return io.BytesIO(b'{"ok": 1}')

    monkeypatch.setattr(judges.urllib.request, "urlopen", opened)
    assert judges.fetch("http://x", {}, wait=waits.append) == {"ok": 1} and waits == [2.0, 4.0]

    def refused(request, timeout):
        raise urllib.error.HTTPError("u", 404, "no", {}, None)

    monkeypatch.setattr(judges.urllib.request, "urlopen", refused)
    with pytest.raises(urllib.error.HTTPError):
        judges.fetch("http://x", {}, wait=waits.append)


def test_small_functions():
    assert token_count_py("") == 1 and token_count_py("a, b") == 3
    assert pick_column(["x", "Review"], "text", "review") == "Review"
    long = "word " * 100 + "needle " + "tail " * 100
    cut = excerpt(long, ["needle"], 60)
    assert len(cut) <= 60 and "needle" in cut and cut.startswith("...") and cut.endswith("...")
    assert excerpt("short text", ["x"]) == "short text"


def test_questions_are_not_replaced_by_a_word_in_them():
    asked = "which films would viewers recommend the soundtrack of?"
    assert dialect.semantic_part(asked) == asked
    assert dialect.semantic_part("show me movies with positive reviews") == "is the text positive?"
    assert dialect.semantic_part("comedies with bad reviews?") == "is the text negative?"


def test_registered_functions(spark):
    from quillon.operators import semantic
    from quillon.sources.judges import LexicalJudge

    semantic.register(spark, LexicalJudge({"rain?": ["rain"]}))
    spark.createDataFrame([(1, "much rain fell there"), (2, "the sun was out"), (3, "rain"), (4, None)], "id int, t string").createOrReplaceTempView("quillon_sky")
    got = {r.id: (r.a, r.s) for r in spark.sql("SELECT id, sem_answer(t, 'rain?') AS a, sem_summary(t) AS s FROM quillon_sky").collect()}
    assert got == {1: ("Yes", "much rain fell there"), 2: ("No", "the sun was out"), 3: ("No", "(no review)"), 4: ("No", "(no review)")}


def test_comparisons_reach_the_scan(spark):
    from quillon.plans import predicates

    df = predicates.apply_predicates(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), [{"column": "p_size", "op": "ge", "value": "10"}, {"column": "p_size", "op": "in", "value": ["12", 13]}], numeric=["p_size"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "In(p_size, [12,13])" in plan
