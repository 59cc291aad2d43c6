import corpus_pipeline as P
from test_decontam import brute as leaks
from test_nearcopies import brute_groups
from test_rules import brute as counted
from test_secrets import brute as spans

D = "/root/testdata/sf0.001"


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / str(i)))
        new = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in new.collect()}
        assert new.count() == len(after) and set(after) <= set(before)
        if i < len(P.STAGES) - 1:
            assert new.columns == docs.columns
        if name == "quality rules":
            assert all(not counted(r.text)[5] for r in after.values()) and len(after) > 0.7 * len(before)
        elif name == "near-dedup":
            assert set(after) == set(brute_groups([(d, r.text) for d, r in before.items()]).values())
        elif name == "decontamination":
            short = [(d, r.text) for d, r in before.items() if len(r.text) < 3000]
            bad = {d for d, _ in leaks(short, items[:12])}
            gone = set(before) - set(after)
            assert bad <= gone and len(gone) < 0.1 * len(before)
        elif name == "secrets":
            assert set(after) == set(before)
            for d, r in after.items():
                base = spans(before[d].text)
                assert not spans(r.text)
                assert (r.text == before[d].text) == (not base) or "[secret]" in r.text
                assert r.n_chars == len(r.text)
        else:
            assert all(r.taken in (0, r.size, 2 * r.size) for r in after.values())
        docs = new


def odd(spark):
    rows = [(None, None), (None, ""), (None, ""), (1, "a b c d e f g h i j k l m n o p"), (1, "a b c d e f g h i j k l m n o p"), (2, "A b c d e f g h i j k l m n o p"), (None, "some other words that say nothing much but go on for a while at least"), (3, "token=abcdefgh123 is in here with words enough to be seen as a text by all")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars", "1 as fp", "2 as component_id", "3 as spans", "4 as size", "5 as node", "6 as key", "7 as row", "8 as bad", "9 as having", "10 as stays", "11 as quality")


def test_odd_rows(spark):
    docs = odd(spark)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, D).columns == docs.columns
    kept = sorted((str(r.doc_id), r.text or "") for r in P.near_dedup(spark, docs, D).collect())
    assert [k[0] for k in kept] == ["1", "3", "None", "None"]
    hidden = {r.doc_id: r.text for r in P.hide_secrets(spark, docs, D).collect()}
    assert hidden[3].startswith("[secret] is in here")
    assert P.mixture(spark, docs, D).count() == docs.count()


def test_empty(spark):
    docs = odd(spark).where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, D).count() == 0
