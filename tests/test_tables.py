import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions.beta import Band
from quillon.operators import dictionary, suites
from quillon.plans.schema import EntityTextSchema
from quillon.sources import tables
from quillon.sources.judges import LexicalJudge
from quillon.streaming import frozen


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('movie_id,title,year,runtime\n1,"A ""quoted"", title",1999,90\n2,,x,\n,lost,1,1\n')
    schema = EntityTextSchema("movie_id", "tconst", "review", numeric_cols=("year", "runtime"))
    got = sorted(tuple(r) for r in tables.csv_typed(spark, str(p), schema).collect())
    assert got == [("1", 'A "quoted", title', 1999, 90), ("2", "", 0, 0)]
    assert tables.csv_strings(spark, str(p)).where("title = ''").count() == 1
    assert tables.year_slice(tables.csv_strings(spark, str(p)), "year", 1999, ["movie_id"], 5).count() == 1


def test_other_formats(spark, tmp_path):
    t = tmp_path / "b.tsv.gz"
    with gzip.open(t, "wt") as f:
        f.write("tconst\tx\tyear\ntt1\ta\t\\N\ntt2\tb\t1990\n")
    assert [(r.tconst, r.year) for r in tables.tsv_dump(spark, str(t), ["tconst", "year"]).orderBy("tconst").collect()] == [("tt1", None), ("tt2", "1990")]
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n{"id": "2", "text": "y"}\n')
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    for name in ("a.jsonl", "a.json"):
        assert tables.read_any(spark, str(tmp_path / name)).count() == 2
    with pytest.raises(ValueError):
        tables.read_any(spark, "x.doc")


def test_text_rows(spark):
    df = spark.createDataFrame([("1", "a &amp; b<br />c"), ("1", "a &amp; b<br />c"), ("2", " "), ("2", None)], "tconst string, Review string")
    (r,) = tables.text_rows(df).collect()
    assert r.entity_id == "1" and r.text == "a & b c" and len(r.text_id) == 24


def test_entities_alone_go_to_python(spark, monkeypatch):
    import html
    import random

    r, bits = random.Random(5), ["&amp;", "&amp", "&notit;", "&#65;", "&#x1F600", "&#0;", "&", "&&lt;", "&unknown;", "\n", " ", "<", ";", "#", "x" * 40, "\u00e9", "\U0001f600", "&\U0001f600;", "&copy1"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(500)] + ["", "no entity", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.u for x in df.select("i", tables.unescaped(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(500)] == [html.unescape(t) for t in texts[:500]] and [got[i] for i in range(500, 503)] == ["", "no entity", None]
    long = spark.createDataFrame([("1", "a &amp; b " * 5000)], "tconst string, review string")
    plan = tables.text_rows(long)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython [plain(array_distinct(" in plan or "ArrowEvalPython [plain(_" in plan
    (x,) = tables.text_rows(long).collect()
    assert x.text == ("a & b " * 5000).strip()


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 0.5)], "id long, b double")
    tables.write_results([a, b], str(tmp_path / "out"), "id")
    assert set(spark.read.csv(str(tmp_path / "out"), header=True).columns) == {"id", "a", "b"}
    tables.write_metrics({"x": float("inf"), "n": 1}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"x": None, "n": 1}
    (tmp_path / "spec.json").write_text('{"k": 3}')
    assert tables.load_spec(str(tmp_path / "spec.json"), {"k": 1, "z": 2}) == {"k": 3, "z": 2}
    tables.write_suite({"q1": a, "q2": a}, str(tmp_path / "suite"))
    assert spark.read.parquet(str(tmp_path / "suite")).groupBy("question").count().count() == 2


def test_pools(spark):
    df = spark.range(400).withColumn("text", F.when(F.col("id") % 3 == 0, "funny").otherwise("dull"))
    got = suites.pools(df, "id", [("a", F.col("id") < 200, F.col("text") == "funny"), ("b", F.col("id") >= 250, F.col("text") == "funny")], ["id"])
    ids = [r.id for p in got.values() for r in p.collect()]
    assert len(ids) == len(set(ids)) == 200
    assert suites.invariants(got["a"], "id", 100, 10) == [] and suites.invariants(got["a"], "id", 99, 90) != []
    assert sum(suites.sized(100).values()) == 100 and suites.sized(100)[True, True] == 15
    with pytest.raises(ValueError):
        suites.pool(df.limit(20), F.col("id") < 10, F.col("text") == "funny", ["id"], strict=True).count()


def test_corpus(spark):
    reviews = spark.createDataFrame([("t1", "r1"), ("t1", "r2"), ("t9", "r3")], "tconst string, review string")
    basics = spark.createDataFrame([("t1", "Title"), ("t2", "Other")], "tconst string, primaryTitle string")
    crew = spark.createDataFrame([("t1", "n2,n1,n2"), ("t2", None)], "tconst string, directors string")
    names = spark.createDataFrame([("n1", "Ann"), ("n2", "Bo")], "nconst string, primaryName string")
    got = sorted((r.tconst, r.review, r.primaryTitle, r.director) for r in suites.restore_corpus(reviews, basics, crew, names).collect())
    assert got[:2] == [("t1", "r1", "Title", "Bo, Ann"), ("t1", "r2", "Title", "Bo, Ann")] and got[2][3] is None
    assert suites.union_tables([basics, basics], "tconst").count() == 2
    with pytest.raises(ValueError):
        suites.union_tables([basics, spark.createDataFrame([("t1", "X")], basics.schema)], "tconst")


def test_dictionary(spark):
    entry = {"template": "Be fair.", "anchors": [{"term": "fun", "z": 2.0}], "examples": [{"text": "so fun"}], "threshold": None}
    assert dictionary.validate({"a": entry}) == [] and dictionary.validate({"a": entry | {"threshold": 1}, "b": {}}) != []
    assert dictionary.guideline(entry) == "Be fair.\nSigns: fun\nExample: so fun"
    with pytest.raises(KeyError):
        dictionary.guideline(None)
    df = spark.createDataFrame(pd.DataFrame({"id": range(6), "t": ["fun fun day", "fun time", "fun ride", "sad day", "sad time", "sad ride"], "y": [1, 1, 1, 0, 0, 0]}))
    assert dictionary.anchors(df, "t", "y", top=1).first().term == "fun"
    v = dictionary.hashed_embedding(df, "id", "t", 32).first().vector
    assert len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert dictionary.excerpts(df, "t", ["fun"]).first().excerpt == "fun fun day"


def test_stream_with_a_frozen_band(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(1, "hand hand hand"), (2, "nothing"), (3, "hand")], "id long, text string")
    rows.write.parquet(str(src))
    judge = LexicalJudge({"q": ["hand"]})
    stream = frozen.frozen(spark.readStream.schema(rows.schema).parquet(str(src)), "text", "q", judge, judge, Band(accept=2.0, reject=-1.0))
    stream.writeStream.format("memory").queryName("frozen_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(60)
    got = {r.id: (r.route, r.passed) for r in spark.table("frozen_out").collect()}
    assert got == {1: ("accept", True), 2: ("reject", False), 3: ("escalated", True)}


def test_terms_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "TEXTS", 10)
    df = spark.createDataFrame([(f"a{i % 5} b{i % 3} c", i % 2) for i in range(50)], "t string, y int")
    counted = dictionary.document_frequency(df, "t", "y")
    assert "Repartition 6" in counted._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.term, r.pos, r.neg) for r in counted.collect()}
    assert ("c", 25, 25) in want and ("a1 b1", 2, 2) in want and len(want) == 5 + 3 + 1 + 15 + 3 + 15
    for top in (None, 3):
        out = dictionary.anchors(df, "t", "y", top=top)
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < out.count() and {(r.term, r.pos, r.neg) for r in out.collect()} <= want


def test_anchor_terms_are_the_strongest_of_all(spark):
    """The twenty terms are those that a sort of all terms puts first."""
    from quillon import catalog

    at = "/root/testdata/sf0.001"
    out = catalog.QUERIES["anchor_terms"](spark, at)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(f"{at}/documents.parquet").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    every = sorted(dictionary.anchors(docs, "text", "quality", top=None).collect(), key=lambda r: (-r.z, r.term))
    assert [(r.term, r.pos, r.neg) for r in out.collect()] == [(r.term, r.pos, r.neg) for r in every[:20]]
