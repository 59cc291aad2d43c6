"""Registered queries over sources and sinks, parsers, planners and calibration, beside those of quillon.catalog."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from quillon.catalog import _EDGES, CHEAP, EXPENSIVE, WITH_HAND, query, r6, table
from quillon.functions import beta
from quillon.operators import cascade, dictionary, evaluation, joins, semantic, suites
from quillon.plans import dialect, predicates, questionnaire
from quillon.plans.schema import EntityTextSchema, pick_column
from quillon.sources import judges, tables
from quillon.sources.stored import new_path, passing


def _folder(spark, name: str) -> str:
    """A new folder in the shared one; it goes with the driver or the scope that is open."""
    at = new_path(spark, name)
    passing(spark, at)
    return at


# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query("csv_scan", "SELECT p_partkey, coalesce(p_name, '') AS p_name, p_size, coalesce(p_type, '') AS p_type FROM part")
def csv_scan(spark, d):
    """A CSV file as the query path sees it: typed where the schema says so."""
    at = _folder(spark, "csv") + ".csv"
    table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type").write.csv(at, header=True)
    passing(spark, at)
    read = tables.csv_typed(spark, at, EntityTextSchema("p_partkey", "p_partkey", "p_name", numeric_cols=("p_size",)))
    return read.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("csv_texts", "SELECT item_id, coalesce(text, '') AS text FROM benchmark")
def csv_texts(spark, d):
    """Texts with line breaks and quotes survive a CSV file."""
    at = _folder(spark, "csv") + ".csv"
    table(spark, d, "benchmark").select("item_id", "text").write.csv(at, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    passing(spark, at)
    return tables.read_any(spark, at).withColumn("item_id", F.col("item_id").cast("long"))


@query("year_slice", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) = 1995 ORDER BY o_orderkey LIMIT 50")
def year_slice(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return tables.year_slice(o, "year", 1995, ["o_orderkey"], 50)


@query("tsv_dump", "SELECT c_custkey, nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment FROM customer")
def tsv_dump(spark, d):
    """A compressed TSV dump with \\N as null."""
    at = _folder(spark, "tsv") + ".tsv.gz"
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("c_mktsegment"))
    c.write.csv(at, sep="\t", header=True, nullValue="\\N", quote="", compression="gzip")
    passing(spark, at)
    return tables.tsv_dump(spark, at, ["c_custkey", "c_mktsegment"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("read_by_suffix", "SELECT kind, r_regionkey::BIGINT AS r_regionkey, r_name FROM region, (VALUES ('csv'), ('jsonl'), ('parquet'), ('tsv')) AS v(kind)")
def read_by_suffix(spark, d):
    r, out = table(spark, d, "region").select("r_regionkey", "r_name"), []
    for kind in ("csv", "jsonl", "parquet", "tsv"):
        at = f"{_folder(spark, 'by')}.{kind}"
        w = r.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        w.format({"jsonl": "json", "tsv": "csv"}.get(kind, kind)).save(at)
        passing(spark, at)
        out.append(tables.read_any(spark, at).select(F.lit(kind).alias("kind"), F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("written_results", "SELECT p_partkey, p_size, NULL::BIGINT AS s_suppkey FROM part WHERE p_size < 5 UNION ALL SELECT s_suppkey, NULL, s_suppkey FROM supplier")
def written_results(spark, d):
    """Results with different columns in one file."""
    at = _folder(spark, "results")
    a = table(spark, d, "part").where("p_size < 5").select("p_partkey", "p_size")
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_suppkey")
    tables.write_results([a, b], at, "p_partkey", "parquet")
    return spark.read.parquet(at)


@query("comparison_file", "SELECT l_returnflag AS method, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1")
def comparison_file(spark, d):
    """The comparison of methods as a CSV file."""
    at = _folder(spark, "comparison")
    m = evaluation.means(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "method"), ["method"], ["l_quantity", "l_discount"])
    tables.write_results([m], at, "method")
    read = spark.read.csv(at, header=True, inferSchema=True)
    return read.select("method", r6(F.col("l_quantity").cast("double"), "quantity"), r6(F.col("l_discount").cast("double"), "discount"))


@query("column_aliases", "SELECT 'TConst' AS picked UNION ALL SELECT 'review'")
def column_aliases(spark, d):
    names = ["x", "TConst", "review"]
    return spark.createDataFrame([(pick_column(names, "entity_id", "tconst"),), (pick_column(names, "text", "review"),)], "picked string")


@query("map_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS language FROM documents")
def map_lookup(spark, d):
    """A category looked up in a map."""
    entries = F.map_from_arrays(F.array(F.lit("en"), F.lit("de")), F.array(F.lit("English"), F.lit("German")))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.try_element_at(entries, F.col("lang")), F.lit("other")).alias("language"))


# ---- dialect, guard, parsers ---------------------------------------------------------------------------------------


@query("dialect_group_by", "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE length(trim(text)) >= 10 AND regexp_matches(text, '(?i)hand') AND n_chars > 100 GROUP BY lang HAVING count(*) > 1")
def dialect_group_by(spark, d):
    """Groups of what a semantic predicate lets through."""
    q = f"SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE n_chars > 100 AND answer(text, '{WITH_HAND}') = 'Yes' GROUP BY lang HAVING count(*) > 1"
    return semantic.run(spark, q, EXPENSIVE, {"documents": table(spark, d, "documents")})


@query("dialect_distinct", "SELECT DISTINCT lang, source FROM documents WHERE length(trim(text)) >= 10 AND regexp_matches(text, '(?i)hand')")
def dialect_distinct(spark, d):
    return semantic.run(spark, f"SELECT DISTINCT lang, source FROM documents WHERE answer(text, '{WITH_HAND}') = 'Yes' ORDER BY lang NULLS LAST, source DESC", EXPENSIVE, {"documents": table(spark, d, "documents")})


_STATEMENTS = (
    ("a", "SELECT * FROM t WHERE x = 'drop'"),
    ("b", "SELECT * FROM t; DELETE FROM t"),
    ("c", "DROP TABLE t"),
    ("d", "SELECT * FROM u"),
    ("e", "SELECT * FROM t WHERE x IN (SELECT y FROM u)"),
    ("f", "select count(*) from t where \"insert\" = 1"),
)


@query("sql_guard", "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false), ('d', false), ('e', false), ('f', true)) AS v(id, allowed)")
def sql_guard(spark, d):
    def allowed(sql: str) -> bool:
        try:
            return bool(predicates.guard(sql, "t"))
        except ValueError:
            return False

    return spark.createDataFrame([(i, allowed(s)) for i, s in _STATEMENTS], "id string, allowed boolean")


@query("dialect_parts", "SELECT 'n > 3 AND (a = 1 OR b = 2)' AS relational, 'is it good? and is it long?' AS asked, 'Yes,No' AS expected, 'n DESC' AS ordered, 7 AS most")
def dialect_parts(spark, d):
    q = dialect.parse("Here it is:\n```sql\nSELECT id FROM t WHERE n > 3 AND answer(a, 'is it good?') = 'Yes' AND (a = 1 OR b = 2) AND answer(b, 'is it long?') = 'No' ORDER BY n DESC LIMIT 7;\n```")
    row = (q.where, " and ".join(p.question for p in q.predicates), ",".join(p.expected for p in q.predicates), ",".join(q.order), q.limit)
    return spark.createDataFrame([row], "relational string, asked string, expected string, ordered string, most int")


@query("parsed_decisions", "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS decision FROM labels")
def parsed_decisions(spark, d):
    """Decisions read from answers in six wordings; an uncertain one is none."""
    said = F.when(F.col("quality") == 1, "Yes").otherwise("No")
    forms = [F.concat(F.lit('{"decision": "'), said, F.lit('"}')), said, F.concat(F.lit("I think: "), F.lower(said), F.lit(".")), F.concat(F.lit('Sure. {"answer": "'), F.upper(said), F.lit('"} as asked')), F.concat(F.lit("**"), said, F.lit("**")), F.lit("Uncertain")]
    text = reduce(lambda c, i: c.when(F.col("doc_id") % 6 == i, forms[i]), range(1, 6), F.when(F.col("doc_id") % 6 == 0, forms[0]))

    @F.pandas_udf("string")
    def parsed(t: pd.Series) -> pd.Series:
        return t.map(judges.parse_decision)

    return table(spark, d, "labels").select("doc_id", parsed(text).alias("decision"))


# Fixed value: keys in the range of a batch.
_KEYS = 1024


def _batches(customers, nations):
    """n_nationkey, n_name, xs: the customers of a nation (c_custkey, w) in a range of keys, so that a batch doesn't grow with the table."""
    c = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    xs = F.sort_array(F.collect_list(F.struct("c_custkey", "w")))
    return c.groupBy("n_nationkey", "n_name", F.floor(F.col("c_custkey") / _KEYS).alias("range")).agg(xs.alias("xs")).drop("range")


@query("parsed_batches", "SELECT c_custkey, n_name, CASE WHEN c_custkey % 3 = 0 THEN 'YES' WHEN c_custkey % 3 = 1 THEN 'NO' ELSE 'UNCERTAIN' END AS decision FROM customer JOIN nation ON c_nationkey = n_nationkey")
def parsed_batches(spark, d):
    """Decisions of batches of a nation's customers, written as lines or as JSON and read back by number."""
    word = F.when(F.col("c_custkey") % 3 == 0, "match").when(F.col("c_custkey") % 3 == 1, "no").otherwise("unsure")
    rows = _batches(table(spark, d, "customer").withColumn("w", word), table(spark, d, "nation"))
    line = F.array_join(F.transform("xs", lambda x, i: F.concat(F.lit("PAIR_"), (i + 1).cast("string"), F.lit(": "), F.upper(x["w"]))), "\n")
    json = F.concat(F.lit("```json\n["), F.array_join(F.transform("xs", lambda x, i: F.concat(F.lit('{"id": '), (i + 1).cast("string"), F.lit(', "decision": "'), x["w"], F.lit('"}'))), ", "), F.lit("]\n```"))

    @F.pandas_udf("array<string>")
    def parsed(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(judges.parse_batches(t, n))

    got = rows.select("n_name", F.explode(F.arrays_zip(F.col("xs.c_custkey").alias("k"), parsed(F.when(F.col("n_nationkey") % 2 == 0, line).otherwise(json), F.size("xs")).alias("s"))).alias("x"))
    return got.select(F.col("x.k").alias("c_custkey"), "n_name", F.col("x.s").alias("decision"))


@query("parsed_ids", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN 'NO' ELSE 'YES' END AS decision FROM part")
def parsed_ids(spark, d):
    """Decisions by id: with a word, bare, or missing."""
    me = F.concat(F.lit("id"), F.col("p_partkey").cast("string"))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(me, F.lit(": yes"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("["), me, F.lit("]"))).when(F.col("p_partkey") % 4 == 2, F.concat(me, F.lit(' decision: "No"'))).otherwise(F.concat(F.lit("id0"), me))

    @F.pandas_udf("string")
    def parsed(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([judges.parse_ids(x, [i]).get(i) for x, i in zip(t, k)])

    return table(spark, d, "part").select("p_partkey", parsed(text, me).alias("decision"))


@query("log_odds", "SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN ln(0.1::DOUBLE + 0.2::DOUBLE) - ln(0.3::DOUBLE) WHEN 1 THEN ln(0.75::DOUBLE / 0.25::DOUBLE) ELSE NULL END, 6) AS score FROM events")
def log_odds(spark, d):
    import math

    tops = [{"Yes": math.log(0.1), " yes": math.log(0.2), "No.": math.log(0.3)}, {"yes": math.log(0.75), "x": -1.0}, {"x": -1.0}]

    @F.pandas_udf("double")
    def odds(i: pd.Series) -> pd.Series:
        return i.map(lambda k: judges.log_odds(tops[k % 3])).astype("float64")

    return table(spark, d, "events").select("event_id", r6(F.when(F.col("event_id") % 3 != 2, odds("event_id")), "score"))


# ---- batches and joins ---------------------------------------------------------------------------------------------


@query("answer_cache", "SELECT count(DISTINCT text) AS asked, 0::BIGINT AS asked_again, count(*) FILTER (WHERE regexp_matches(text, '(?i)hand')) AS yes, count(*) FILTER (WHERE regexp_matches(text, '(?i)hand')) AS yes_again FROM documents WHERE length(trim(text)) >= 10")
def answer_cache(spark, d):
    """A judge in Python is asked once for each distinct text, and by a second query not at all."""
    docs, remote = table(spark, d, "documents"), judges.InPython(EXPENSIVE)
    cache = semantic.AnswerCache(spark, _folder(spark, "cache"))
    passing(spark, cache.path)
    yes = lambda: semantic.judged(docs, "text", WITH_HAND, remote, "said", cache).agg(F.count(F.when(F.col("said") == "Yes", 1))).first()[0]
    size = lambda: spark.read.parquet(cache.path).count()
    first, n = yes(), size()
    again, m = yes(), size()
    return spark.createDataFrame([(n, m - n, first, again)], "asked long, asked_again long, yes long, yes_again long")


_EN = "FROM documents WHERE lang = 'en'"


def _english(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select("doc_id", "source"), docs.select("doc_id", "text")


@query("adaptive_join", f"SELECT doc_id, source {_EN} AND regexp_matches(text, '(?i)hand')")
def adaptive_join(spark, d):
    """The judge answers ten texts a call at most, so the first blocks overflow and the join adapts."""
    return joins.adaptive_join(*_english(spark, d), "doc_id", "text", WITH_HAND, judges.InPython(EXPENSIVE, most=10), budget=10**6, selectivity=0.05, factor=16.0).rows.select("doc_id", "source")


@query("refused_calls", f"SELECT doc_id, source {_EN} AND regexp_matches(text, '(?i)hand') AND greatest(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')), 1) < 300 - 64")
def refused_calls(spark, d):
    """Blocks of one text: what leaves no budget for a completion is refused, whatever the judge would say."""
    return joins.block_join(*_english(spark, d), "doc_id", "text", WITH_HAND, EXPENSIVE, 10**9, 1, 300).rows.select("doc_id", "source")


@query("halved_batches", "SELECT doc_id AS id, regexp_matches(text, '(?i)hand') AS passed FROM documents")
def halved_batches(spark, d):
    """Calls of more than five texts fail and are halved until they don't."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return cascade.verify_batches(docs, WITH_HAND, judges.InPython(EXPENSIVE, most=5), 32, None).select("id", "passed")


@query("completion_caps", "SELECT p_size, least(least(400, 512), greatest(48, 16 + 16 * p_size))::INT AS cap FROM part GROUP BY 1")
def completion_caps(spark, d):
    @F.pandas_udf("int")
    def cap(n: pd.Series) -> pd.Series:
        return n.map(lambda x: joins.completion_cap(int(x), 400))

    return table(spark, d, "part").select("p_size").distinct().select("p_size", cap("p_size").alias("cap"))


@query("block_sizes", "WITH a AS (SELECT DISTINCT p_size, p_size + 1.0 AS m1, 40.0 AS m2, 0.01 * 8 / ((p_size + 1.0) * 40.0) AS a FROM part), c AS (SELECT *, (-2 + sqrt(4 + 4 * a * (4096 - 64))) / (2 * a) AS cost FROM a) SELECT p_size, greatest(1, floor(cost / m1))::INT AS b1, greatest(1, floor(cost / m2))::INT AS b2 FROM c")
def block_sizes(spark, d):
    @F.pandas_udf("array<int>")
    def sizes(n: pd.Series) -> pd.Series:
        return n.map(lambda x: list(joins.optimal_block(x + 1.0, 40.0, 8.0, 64, 4096, 0.01)))

    got = table(spark, d, "part").select("p_size").distinct().select("p_size", sizes(F.col("p_size").cast("double")).alias("b"))
    return got.select("p_size", F.col("b")[0].alias("b1"), F.col("b")[1].alias("b2"))


@query("packed_batches", "SELECT count(*) AS rows, 0::BIGINT AS over_rows, 0::BIGINT AS over_tokens FROM benchmark")
def packed_batches(spark, d):
    """No batch has too many rows, or several rows and too few tokens left for their completions."""
    from quillon.functions.text import token_count
    from quillon.sources.stored import with_ordinal

    b = with_ordinal(table(spark, d, "benchmark").select("item_id", "text"), "item_id")
    by = joins.packed(b, 400, 5).groupBy("range", "batch").agg(F.count("*").alias("n"), F.sum(token_count(F.col("text"))).alias("t"))
    over = F.when((F.col("n") > 1) & (400 - F.col("t") < 16 * F.col("n")), 1)
    return by.agg(F.sum("n").alias("rows"), F.count(F.when(F.col("n") > 5, 1)).alias("over_rows"), F.count(over).alias("over_tokens"))


# ---- calibration ---------------------------------------------------------------------------------------------------

_SAMPLE = f"""{_EDGES}, a AS (SELECT id, text, score, (SELECT count(*) FROM c WHERE c.score < s.score) AS g FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score, id) - 1 AS r, count(*) OVER (PARTITION BY g) AS m FROM a),
    k AS (SELECT count(DISTINCT g) AS k FROM a), t AS (SELECT DISTINCT g, m, 40 // k.k + (CASE WHEN g >= k.k - 40 % k.k THEN 1 ELSE 0 END) AS t FROM r, k),
    w AS (SELECT g, round_even(i * (m - 1) / (t - 1.0), 0) AS r FROM (SELECT g, m, t, unnest(range(t)) AS i FROM t)),
    l AS (SELECT r.id FROM r JOIN w ON r.g = w.g AND r.r = w.r)"""


def _calibrated(spark, d):
    docs = table(spark, d, "documents").where("length(trim(text)) >= 10")
    return cascade.row_cascade(docs, "doc_id", "text", WITH_HAND, CHEAP, EXPENSIVE, cascade.CascadeConfig(budget=40))


@query("calibration_counts", f"{_SAMPLE} SELECT g AS stratum, count(*) AS size, count(l.id) AS labelled, count(l.id) FILTER (WHERE regexp_matches(text, '(?i)hand')) AS positives FROM a LEFT JOIN l ON a.id = l.id GROUP BY 1")
def calibration_counts(spark, d):
    """What the band of a calibrated cascade is fitted from."""
    b = _calibrated(spark, d).band
    return spark.createDataFrame(list(zip(range(len(b.sizes)), b.sizes, b.labelled, b.positives)), "stratum long, size long, labelled long, positives long")


@query("calibrated_routing", f"{_SAMPLE} SELECT a.id, a.score::DOUBLE AS score, l.id IS NOT NULL AS labelled, CASE WHEN l.id IS NOT NULL THEN regexp_matches(text, '(?i)hand') END AS label, true AS by_band, true AS by_judge FROM a LEFT JOIN l ON a.id = l.id")
def calibrated_routing(spark, d):
    """Each row of a calibrated cascade: whether it was labelled, and that its route and answer are those of its fitted band."""
    out = _calibrated(spark, d)
    low, high, s = F.lit(out.band.reject), F.lit(out.band.accept), F.col("score")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("__id"), predicates.pattern_mask("text", ["hand"]).alias("truth"))
    rows = out.decisions.join(docs, F.col("id") == F.col("__id"))
    labelled = F.col("route") == "label"
    route = F.when(labelled, "label").when(s >= high, "accept").when(s <= low, "reject").otherwise("escalated")
    want = F.when(F.col("route") == "accept", True).when(F.col("route") == "reject", False).otherwise(F.col("truth"))
    return rows.select("id", "score", labelled.alias("labelled"), F.when(labelled, F.col("passed")).alias("label"), (F.col("route") == route).alias("by_band"), (F.col("passed") == want).alias("by_judge"))


@query("beta_bounds", """WITH RECURSIVE b(s, f, n, lo, hi, i) AS (SELECT n_nationkey, n_nationkey * 7 % 11, n_nationkey + n_nationkey * 7 % 11 + 1, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM nation UNION ALL
  SELECT s, f, n, CASE WHEN cdf < 1 - 0.9 THEN mid ELSE lo END, CASE WHEN cdf < 1 - 0.9 THEN hi ELSE mid END, i + 1 FROM
  (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(s::BIGINT + 1, n::BIGINT + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))) AS cdf FROM b WHERE i < 45))
  SELECT s::BIGINT AS s, f::BIGINT AS f, round((lo + hi) / 2, 6) AS bound FROM b WHERE i = 45""")
def beta_bounds(spark, d):
    """The lower bound of a rate from successes and failures."""

    @F.pandas_udf("double")
    def bound(s: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([beta.beta_quantile(int(x), int(y), 0.9) for x, y in zip(s, f)])

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s"), (F.col("n_nationkey") * 7 % 11).cast("long").alias("f"))
    return n.select("s", "f", r6(bound("s", "f"), "bound"))


@query("composed_seeds", "SELECT n_nationkey, 'base:' || n_name || '/cascade:' || n_regionkey AS seed FROM nation")
def composed_seeds(spark, d):
    @F.pandas_udf("string")
    def seed(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([cascade.compose_seed("base", a, "cascade", b) for a, b in zip(q, r)])

    return table(spark, d, "nation").select("n_nationkey", seed("n_name", "n_regionkey").alias("seed"))


@query("disabled_questions", "SELECT doc_id AS id, 'escalated_failure' AS route, regexp_matches(text, '(?i)hand') AS passed FROM documents WHERE length(trim(text)) >= 10")
def disabled_questions(spark, d):
    """A disabled question goes to the expensive judge alone."""
    docs = table(spark, d, "documents").where("length(trim(text)) >= 10")
    return cascade.row_cascade(docs, "doc_id", "text", WITH_HAND, CHEAP, EXPENSIVE, cascade.CascadeConfig(disabled=(WITH_HAND,))).decisions.select("id", "route", "passed")


@query("open_prefilter", "SELECT DISTINCT conv_id AS id FROM conversations")
def open_prefilter(spark, d):
    """Labels that certify no threshold keep every id."""
    c = table(spark, d, "conversations").withColumnRenamed("turn", "ordinal")
    few = c.select(F.col("conv_id").alias("id")).where("id < 3").distinct().withColumn("passed", F.lit(True))
    return cascade.fitted_prefilter(c, "conv_id", "text", WITH_HAND, CHEAP, few)


# ---- pools, dictionaries, evaluation -------------------------------------------------------------------------------

_HAND = "regexp_matches(text, '(?i)hand')"


def _pool_sql(sizes: dict) -> str:
    case = " ".join(f"WHEN structured_match = {s} AND semantic_label = {m} THEN {n}" for (s, m), n in sizes.items())
    return f"SELECT doc_id, structured_match, semantic_label FROM (SELECT *, row_number() OVER (PARTITION BY structured_match, semantic_label ORDER BY doc_id) AS r FROM (SELECT doc_id, lang = 'en' AND n_chars < 2000 AS structured_match, {_HAND} AS semantic_label FROM documents)) WHERE r <= CASE {case} END"


def _pool_query(name: str, sizes: dict):
    @query(name, _pool_sql(sizes))
    def run(spark, d):
        docs = table(spark, d, "documents")
        return suites.pool(docs, (F.col("lang") == "en") & (F.col("n_chars") < 2000), predicates.pattern_mask("text", ["hand"]), ["doc_id"], sizes).select("doc_id", "structured_match", "semantic_label")

    return run


scaled_pool = _pool_query("scaled_pool", suites.scaled(suites.MOVIES, 3))
product_pool = _pool_query("product_pool", suites.PRODUCTS)
sized_pool = _pool_query("sized_pool", suites.sized(60))


@query("seeded_order", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def seeded_order(spark, d):
    return evaluation.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", "7", 100)


@query("evaluation_split", "SELECT doc_id, CASE WHEN ('0x' || left(md5('42:' || doc_id), 8))::BIGINT % 100 < 70 THEN 'dictionary' ELSE 'evaluation' END AS split FROM documents")
def evaluation_split(spark, d):
    return table(spark, d, "documents").select("doc_id", dictionary.split_tag(F.col("doc_id"), "42").alias("split"))


@query("hashed_embedding", r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark),
  g AS (SELECT item_id, unnest(w) AS t FROM w UNION ALL SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
  c AS (SELECT item_id, (('0x' || left(md5(t), 8))::BIGINT % 512)::INT AS i, count(*) AS c FROM g GROUP BY 1, 2)
  SELECT item_id, i, round(c / sqrt(sum(c * c) OVER (PARTITION BY item_id)), 6) AS value FROM c""")
def hashed_embedding(spark, d):
    v = dictionary.hashed_embedding(table(spark, d, "benchmark"), "item_id", "text")
    return v.select("item_id", F.posexplode("vector").alias("i", "value")).where("value != 0").select("item_id", "i", r6(F.col("value"), "value"))


@query("nearest_rows", """WITH c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, embedding AS e FROM embeddings WHERE vec_id < 8),
  f AS (SELECT vec_id, cluster, list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - c.e[i]::DOUBLE) ** 2)) AS far FROM embeddings v, c),
  n AS (SELECT vec_id, arg_min(cluster, round(far, 9) * 1000 + cluster / 1e6) AS cluster, min(far) AS far FROM f GROUP BY 1)
  SELECT cluster::INT AS cluster, arg_min(vec_id, far) AS vec_id FROM n GROUP BY 1""")
def nearest_rows(spark, d):
    """The exemplar of each of eight fixed centres."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = [r.embedding for r in v.where("vec_id < 8").orderBy("vec_id").collect()]
    return dictionary.nearest_rows(v, "vec_id", "embedding", centres)


_COLUMNS = {"kind": "p_type", "year": "p_size", "minutes": "p_size", "person": "p_brand", "title": "p_name"}
_VALUES = {"comedy": "promo", "horror": "economy", "drama": "standard", "action": "small", "adventure": "o", "romance": "large", "thriller": "medium", "mystery": "promo", "music": "economy", "family": "standard", "nolan": "#1", "night": "red", 1999: 19, 2000: 25, 80: 8, 90: 9, 100: 20, 110: 30, 120: 40}
_VALUES |= {w: "ring" for w in ("shoe", "dress", "blanket", "jacket", "hat", "boot", "bag")} | {w: "widget" for w in ("ring", "belt", "shirt", "jeans", "bra", "leggings")}
_OPS = {"eq": "=", "lt": "<", "le": "<=", "ge": ">="}


def _mapped_sql() -> str:
    test = lambda r, op, v: f"{_COLUMNS[r]} ILIKE '%{_VALUES.get(v, v)}%'" if op == "contains" else f"{_COLUMNS[r]} {_OPS[op]} {_VALUES.get(v, v)}"
    where = lambda q: " OR ".join("(" + " AND ".join(test(*t) for t in parts) + ")" for parts in q.structured)
    return " UNION ALL ".join(f"SELECT '{q.name}' AS question, p_partkey FROM part WHERE {where(q)}" for q in questionnaire.QUESTIONS)


@query("question_catalogue", _mapped_sql())
def question_catalogue(spark, d):
    """The structured part of every question of the catalogue, on parts in place of films and products."""
    p = table(spark, d, "part")
    asked = [questionnaire.candidates(p, q, _COLUMNS, _VALUES).select(F.lit(q.name).alias("question"), "p_partkey") for q in questionnaire.QUESTIONS]
    return reduce(lambda a, b: a.unionAll(b), asked)
