"""Every registered query of the engine, with the SQL that an independent engine can run beside it.

Judges are lexical here: a question's patterns stand in for a model, so that SQL can check the answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import cascade, dictionary, evaluation, joins, semantic, suites
from quillon.plans import predicates, questions
from quillon.sources import tables
from quillon.sources.judges import LexicalJudge, LookupJudge
from quillon.streaming import frozen

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WITH_HAND, WITH_REED = "does the text speak of a hand?", "does the text speak of reed?"
PATTERNS = {WITH_HAND: ["hand"], WITH_REED: ["reed", "hehe"]}
CHEAP = LexicalJudge({WITH_HAND: ["hand", "ouwh", "inging"], WITH_REED: ["reed", "hehe"]}, PATTERNS)
EXPENSIVE = LexicalJudge(PATTERNS)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---- structured predicates -----------------------------------------------------------------------------------------


@query("structured_filter", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars < 2000 AND (source = 'src1' OR source = 'src2')")
def structured_filter(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("quillon_documents")
    return spark.sql("SELECT doc_id, lang, n_chars FROM quillon_documents WHERE lang = 'en' AND n_chars < 2000 AND (source = 'src1' OR source = 'src2')")


@query("ilike_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def ilike_contains(spark, d):
    return table(spark, d, "part").where(predicates.like_any_case("p_name", "RED")).select("p_partkey", "p_name")


@query("predicate_list", "SELECT p_partkey, p_brand, p_size FROM part WHERE lower(p_type) IN ('economy', 'promo') AND p_size >= 10 AND p_size < 40 AND lower(p_brand) <> 'brand#4' AND p_name ILIKE '%ring%'")
def predicate_list(spark, d):
    wanted = [
        {"column": "p_type", "op": "in", "value": ["Economy", "PROMO"]},
        {"column": "p_size", "op": "ge", "value": "10"},
        {"column": "p_size", "op": "lt", "value": 40},
        {"column": "p_brand", "op": "ne", "value": "BRAND#4"},
        {"column": "p_name", "op": "contains", "value": "Ring"},
    ]
    return predicates.apply_predicates(table(spark, d, "part"), wanted, numeric=["p_size"]).select("p_partkey", "p_brand", "p_size")


@query("lenient_filters", "SELECT p_partkey FROM part WHERE p_size <= 20")
def lenient_filters(spark, d):
    wanted = [{"column": "p_size", "op": "le", "value": "20"}, {"column": "year", "op": "eq", "value": "1990"}]
    return predicates.apply_predicates(table(spark, d, "part"), wanted, numeric=["p_size"], strict=False).select("p_partkey")


@query("contains_any", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)\b(ring|widget)\b')")
def contains_any(spark, d):
    return predicates.apply_predicates(table(spark, d, "part"), [{"column": "p_name", "op": "contains_any", "value": "ring|widget"}]).select("p_partkey", "p_name")


@query("word_boundary_mask", r"SELECT p_partkey, regexp_matches(p_name, '(?i)\bred\b') AND p_size BETWEEN 5 AND 25 AS matched FROM part")
def word_boundary_mask(spark, d):
    return table(spark, d, "part").select("p_partkey", (predicates.word_match("p_name", "red") & F.col("p_size").between(5, 25)).alias("matched"))


@query("semantic_mask", "SELECT doc_id, regexp_matches(text, '(?i)(hand|reed)') AS matched, regexp_extract(text, '(?i)(hand|reed)') AS evidence FROM documents")
def semantic_mask(spark, d):
    p = ["hand", "reed"]
    return table(spark, d, "documents").select("doc_id", predicates.pattern_mask("text", p).alias("matched"), predicates.pattern_evidence("text", p).alias("evidence"))


@query("question_filters", "SELECT p_partkey, p_size FROM part WHERE p_size > 30 AND p_type ILIKE '%promo%'")
def question_filters(spark, d):
    df, _, _, _ = questions.prune(table(spark, d, "part"), "part", "promo parts of more than 30 minutes", minutes="p_size", vocabulary={"p_type": ("promo", "economy")}, numeric=["p_size"])
    return df.select("p_partkey", "p_size")


@query("range_clip", "SELECT p_partkey, p_size FROM part WHERE p_retailprice BETWEEN 0 AND 1000 AND p_size BETWEEN 1 AND 30")
def range_clip(spark, d):
    return table(spark, d, "part").where("p_retailprice between 0 and 1000 and p_size between 1 and 30").select("p_partkey", "p_size")


# ---- sources and text functions ------------------------------------------------------------------------------------


@query("coerced_scan", "SELECT doc_id, coalesce(try_cast(lang AS DOUBLE)::INT, 0) AS lang, coalesce(n_chars::VARCHAR, '') AS n_chars FROM documents WHERE doc_id IS NOT NULL")
def coerced_scan(spark, d):
    from quillon.plans.schema import EntityTextSchema

    return tables.coerced(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), EntityTextSchema("doc_id", "doc_id", "text", numeric_cols=("lang",)))


@query("prompt_text", r"SELECT doc_id, substring('source=' || source || '; text=' || trim(regexp_replace(regexp_replace(text, '<br\s*/?>', ' ', 'g'), '\s+', ' ', 'g')), 1, 1800) AS text FROM documents")
def prompt_text(spark, d):
    return tables.with_prompt(table(spark, d, "documents"), ["source", "text"], "text").select("doc_id", "text")


@query("strip_tags", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query("content_ids", r"SELECT DISTINCT left(sha256(doc_id::VARCHAR || chr(0) || t), 24) AS text_id, doc_id::VARCHAR AS entity_id, t AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents) WHERE t <> ''")
def content_ids(spark, d):
    rows = table(spark, d, "documents")
    return tables.text_rows(rows.select(F.col("doc_id").alias("entity_id"), "text"))


@query("token_count", r"SELECT item_id, greatest(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')), 1) AS tokens FROM benchmark")
def token_count(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.token_count(F.col("text")).cast("long").alias("tokens"))


@query("price_parse", r"SELECT p_partkey, try_cast(regexp_extract(replace(replace(t, '$', ''), ',', ''), '(\d+(\.\d+)?)', 1) AS DOUBLE) AS price FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE '$' || p_size::VARCHAR || ',' || (100 + p_partkey % 900)::VARCHAR || '.5 - $9' END AS t FROM part)")
def price_parse(spark, d):
    t = F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.concat(F.lit("$"), "p_size", F.lit(","), (100 + F.col("p_partkey") % 900).cast("string"), F.lit(".5 - $9")))
    return table(spark, d, "part").select("p_partkey", tx.price(t).alias("price"))


@query("latest_duplicate", "SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n = 1")
def latest_duplicate(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1").select("l_orderkey", "l_partkey", "l_quantity")


# ---- semantic filters ----------------------------------------------------------------------------------------------

_SHORT_OK = "length(trim(text)) >= 10"


@query("sem_filter_conjunctive", f"SELECT doc_id, n_chars FROM documents WHERE lang ILIKE 'EN' AND n_chars < 3000 AND {_SHORT_OK} AND regexp_matches(text, '(?i)hand')")
def sem_filter_conjunctive(spark, d):
    q = f"SELECT doc_id, n_chars FROM documents WHERE lang ILIKE 'EN' AND n_chars < 3000 AND answer(text, '{WITH_HAND}') = 'yes'"
    return semantic.run(spark, q, EXPENSIVE, {"documents": table(spark, d, "documents")})


@query("sem_filter_two_predicates", f"SELECT doc_id FROM documents WHERE n_chars >= 500 AND {_SHORT_OK} AND regexp_matches(text, '(?i)hand') AND NOT regexp_matches(text, '(?i)(reed|hehe)')")
def sem_filter_two_predicates(spark, d):
    q = f"SELECT doc_id FROM documents WHERE answer(text, '{WITH_HAND}') = 'Yes' AND n_chars >= 500 AND answer(text, '{WITH_REED}') = 'No'"
    return semantic.run(spark, q, EXPENSIVE, {"documents": table(spark, d, "documents")})


@query("sem_order_limit", f"SELECT doc_id, n_chars FROM documents WHERE lang ILIKE 'en' AND n_chars < 5000 AND {_SHORT_OK} AND regexp_matches(text, '(?i)hand') ORDER BY n_chars, doc_id LIMIT 5")
def sem_order_limit(spark, d):
    q = f"SELECT doc_id, n_chars FROM documents WHERE lang ILIKE 'en' AND n_chars < 5000 AND answer(text, '{WITH_HAND}') = 'Yes' ORDER BY n_chars, doc_id LIMIT 5"
    return semantic.run(spark, q, EXPENSIVE, {"documents": table(spark, d, "documents")})


@query("sem_summary", f"SELECT doc_id, trim(regexp_replace(substring(text, 1, 2000), '\\s+', ' ', 'g'))[1:200] AS short FROM documents WHERE lang = 'en' AND n_chars BETWEEN 50 AND 400 AND {_SHORT_OK} AND regexp_matches(text, '(?i)hand')")
def sem_summary(spark, d):
    q = f"SELECT doc_id, summary(text) AS short FROM documents WHERE lang = 'en' AND n_chars BETWEEN 50 AND 400 AND answer(text, '{WITH_HAND}') = 'Yes'"
    return semantic.run(spark, q, EXPENSIVE, {"documents": table(spark, d, "documents")})


@query("frozen_band", f"SELECT doc_id, CASE WHEN h >= 3 THEN 'accept' WHEN h <= 0 THEN 'reject' ELSE 'escalated' END AS route, CASE WHEN h >= 3 THEN true WHEN h <= 0 THEN false ELSE regexp_matches(text, '(?i)hand') END AS passed FROM (SELECT *, len(regexp_extract_all(text, '(?i)(hand|ouwh|inging)')) AS h FROM documents)")
def frozen_band(spark, d):
    from quillon.functions.beta import Band

    return frozen.frozen(table(spark, d, "documents"), "text", WITH_HAND, CHEAP, EXPENSIVE, Band(accept=2.0, reject=-1.0)).select("doc_id", "route", "passed")


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("exact_id_join", "SELECT row_number() OVER (ORDER BY p_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS candidate_id, p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size < 3")
def exact_id_join(spark, d):
    from quillon.sources.stored import with_ordinal

    p = table(spark, d, "part").where("p_size < 3").select("p_partkey")
    j = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return with_ordinal(j, "p_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", name="candidate_id").select("candidate_id", "p_partkey", "l_orderkey", "l_linenumber")


@query("ordered_semi_join", "WITH s AS (SELECT o_custkey AS c_custkey, min(o_orderkey) AS ordinal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, c_name, ordinal FROM customer JOIN s USING (c_custkey)")
def ordered_semi_join(spark, d):
    chosen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("ordinal"))
    return joins.ordered_semi_join(table(spark, d, "customer"), "c_custkey", chosen).select("c_custkey", "c_name", "ordinal")


@query("semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def semi_join(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("anti_join_check", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0 AND o_custkey IS NOT NULL)")
def anti_join_check(spark, d):
    some = table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderkey % 5 = 0")
    return joins.dangling(table(spark, d, "customer"), "c_custkey", some, "o_custkey").select("c_custkey")


@query("left_join_chain", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_join_chain(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c.where("c_acctbal > 0"), o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("o_orderkey", "c_name", "n_name")


@query("inner_merge", "SELECT DISTINCT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_merge(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name").distinct()


@query(
    "list_lookup_join",
    """WITH e AS (SELECT c_custkey, c_nationkey AS a, (c_custkey % 25)::INT AS b FROM customer),
       x AS (SELECT c_custkey, 0 AS pos, a AS id FROM e UNION ALL SELECT c_custkey, 1, b FROM e UNION ALL SELECT c_custkey, 2, 99 FROM e),
       y AS (SELECT c_custkey, n_name, min(pos) AS pos FROM x JOIN nation ON id = n_nationkey GROUP BY 1, 2)
       SELECT c_custkey, string_agg(n_name, ', ' ORDER BY pos) AS names FROM y GROUP BY 1""",
)
def list_lookup_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws(",", "c_nationkey", (F.col("c_custkey") % 25).cast("string"), F.lit("99")).alias("ids"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return joins.lookup_list(c, "c_custkey", "ids", n, "k", "n_name", "names")


def _sides(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select("doc_id", "source"), docs.select("doc_id", "text")


_PAIRS = "FROM documents WHERE lang = 'en'"


@query("dry_run_join", f"SELECT doc_id, source {_PAIRS} AND regexp_matches(text, '(?i)(hand|reed|ouwh)')")
def dry_run_join(spark, d):
    return joins.dry_run_join(*_sides(spark, d), "doc_id", "text", ["hand", "reed", "ouwh"]).select("doc_id", "source")


@query("single_pass_join", f"SELECT doc_id, source {_PAIRS} AND regexp_matches(text, '(?i)hand')")
def single_pass_join(spark, d):
    return joins.single_pass_join(*_sides(spark, d), "doc_id", "text", WITH_HAND, EXPENSIVE).rows.select("doc_id", "source")


@query("block_join", f"SELECT doc_id, source {_PAIRS} AND regexp_matches(text, '(?i)hand')")
def block_join(spark, d):
    return joins.block_join(*_sides(spark, d), "doc_id", "text", WITH_HAND, EXPENSIVE, 200, 300).rows.select("doc_id", "source")


@query("upsert_by_key", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey >= 5 GROUP BY 1, 2 UNION ALL SELECT c_nationkey, c_mktsegment, -count(*) FROM customer WHERE c_nationkey < 5 GROUP BY 1, 2")
def upsert_by_key(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return joins.upsert(g, g.where("c_nationkey < 5").withColumn("n", -F.col("n")), ["c_nationkey", "c_mktsegment"])


# ---- cascade and calibration ---------------------------------------------------------------------------------------

_SCORED = "(SELECT doc_id AS id, text, len(regexp_extract_all(text, '(?i)(hand|ouwh|inging)')) - 1.0 AS score FROM documents WHERE length(trim(text)) >= 10)"


def _scored(spark, d):
    docs = table(spark, d, "documents").where("length(trim(text)) >= 10")
    return docs.select(F.col("doc_id").alias("id"), CHEAP.score_column(F.col("text"), WITH_HAND).alias("score"))


@query("stratum_histogram", f"SELECT score::DOUBLE AS score, count(*) AS n, sum(count(*)) OVER (ORDER BY score)::BIGINT AS upto FROM {_SCORED} GROUP BY score")
def stratum_histogram(spark, d):
    return cascade.histogram(_scored(spark, d))


_EDGES = f"""WITH RECURSIVE s AS {_SCORED}, h AS (SELECT score::DOUBLE AS score, sum(count(*)) OVER (ORDER BY score)::BIGINT AS upto FROM s GROUP BY score),
  e(h, score, upto) AS (SELECT 0, NULL::DOUBLE, 0::BIGINT UNION ALL
    SELECT e.h + 1, x.score, x.upto FROM e, LATERAL (SELECT h2.score, h2.upto FROM h h2 WHERE h2.upto >= greatest(round_even((e.h + 1) * (SELECT max(upto) FROM h) / 4.0, 0), e.upto + 1) ORDER BY h2.upto LIMIT 1) x
    WHERE e.h < 3 AND x.upto < (SELECT max(upto) FROM h)),
  c AS (SELECT score FROM e WHERE score IS NOT NULL)"""


@query("stratum_assign", f"{_EDGES} SELECT (SELECT count(*) FROM c WHERE c.score < s.score) AS stratum, count(*) AS n FROM s GROUP BY 1")
def stratum_assign(spark, d):
    s = _scored(spark, d)
    cuts = cascade.edges(cascade.histogram(s), 4)
    return s.groupBy(cascade.stratum(F.col("score"), cuts).cast("long").alias("stratum")).agg(F.count("*").alias("n"))


@query(
    "stratified_sample",
    f"""{_EDGES}, a AS (SELECT id, score, (SELECT count(*) FROM c WHERE c.score < s.score) AS g FROM s),
    r AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY score, id) - 1 AS r, count(*) OVER (PARTITION BY g) AS m FROM a),
    k AS (SELECT count(DISTINCT g) AS k FROM a), t AS (SELECT DISTINCT g, m, 20 // k.k + (CASE WHEN g >= k.k - 20 % k.k THEN 1 ELSE 0 END) AS t FROM r, k),
    w AS (SELECT g, round_even(i * (m - 1) / (t - 1.0), 0) AS r FROM (SELECT g, m, t, unnest(range(t)) AS i FROM t))
    SELECT r.id FROM r JOIN w ON r.g = w.g AND r.r = w.r""",
)
def stratified_sample(spark, d):
    s = _scored(spark, d)
    cuts = cascade.edges(cascade.histogram(s), 4)
    sizes, _, _ = cascade.counts_by_stratum(s, cuts)
    return cascade.sample(s, cuts, sizes, 20)


@query("route_manual_band", f"SELECT id, CASE WHEN score >= 1 THEN 'accept' WHEN score <= -1 THEN 'reject' ELSE 'escalated' END AS route, CASE WHEN score >= 1 THEN true WHEN score <= -1 THEN false ELSE regexp_matches(text, '(?i)hand') END AS passed FROM {_SCORED}")
def route_manual_band(spark, d):
    docs = table(spark, d, "documents").where("length(trim(text)) >= 10")
    return cascade.row_cascade(docs, "doc_id", "text", WITH_HAND, CHEAP, EXPENSIVE, cascade.CascadeConfig(manual=1.0)).decisions.select("id", "route", "passed")


@query("row_cascade_answers", "SELECT doc_id AS id, length(trim(text)) >= 10 AND regexp_matches(text, '(?i)hand') AS passed FROM documents")
def row_cascade_answers(spark, d):
    """With nothing to calibrate on, all rows escalate: the answers are the expensive judge's."""
    return cascade.row_cascade(table(spark, d, "documents"), "doc_id", "text", WITH_HAND, CHEAP, EXPENSIVE, cascade.CascadeConfig(budget=0)).decisions.select("id", "passed")


@query("row_cascade_certified")
def row_cascade_certified(spark, d):
    """The calibrated cascade; where its band certifies rows depends on posterior draws, which SQL can't repeat."""
    return cascade.row_cascade(table(spark, d, "documents"), "doc_id", "text", WITH_REED, CHEAP, EXPENSIVE, cascade.CascadeConfig(budget=200)).decisions.select("id", "route", "passed")


@query("lookup_cascade", "SELECT doc_id AS id, CASE WHEN n_chars >= 2000 THEN true WHEN n_chars <= 1000 THEN false ELSE quality = 1 END AS passed, CASE WHEN n_chars >= 2000 THEN 'accept' WHEN n_chars <= 1000 THEN 'reject' ELSE 'escalated' END AS route FROM documents JOIN labels USING (doc_id) WHERE length(trim(text)) >= 10")
def lookup_cascade(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("length(trim(text)) >= 10")
    judge = LookupJudge(F.col("quality") == 1, F.col("n_chars") - 1500)
    return cascade.row_cascade(docs, "doc_id", "text", "is it good?", judge, judge, cascade.CascadeConfig(manual=500.0), more=["quality", "n_chars"]).decisions.select("id", "route", "passed")


@query("batch_cascade_rows", "SELECT doc_id AS id, 'label' AS route, regexp_matches(text, '(?i)hand') AS passed FROM documents")
def batch_cascade_rows(spark, d):
    """A budget that covers all rows: each is labelled in a batch of the expensive judge."""
    config = cascade.CascadeConfig(budget=10**9, text_limit=None)
    return cascade.batch_cascade(table(spark, d, "documents"), "doc_id", "text", WITH_HAND, EXPENSIVE, EXPENSIVE, config).decisions.select("id", "route", "passed")


@query("cascade_join", f"SELECT DISTINCT doc_id, source, 'cheap_accept' AS match_source {_PAIRS} AND regexp_matches(text, '(?i)hand')")
def cascade_join(spark, d):
    rows, _ = cascade.cascade_join(*_sides(spark, d), "doc_id", "doc_id", "text", WITH_HAND, EXPENSIVE, EXPENSIVE, cascade.CascadeConfig(manual=1.5, text_limit=None))
    return rows.select("doc_id", "source", "match_source")


@query("cascade_decisions", "SELECT 'label' AS route, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)hand')) AS yes FROM documents WHERE length(trim(text)) >= 10")
def cascade_decisions(spark, d):
    docs = table(spark, d, "documents").where("length(trim(text)) >= 10")
    out = cascade.row_cascade(docs, "doc_id", "text", WITH_HAND, CHEAP, EXPENSIVE, cascade.CascadeConfig(budget=10**9)).decisions
    return out.groupBy("route").agg(F.count("*").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("yes"))


@query("reject_prefilter", "SELECT conv_id AS id FROM (SELECT conv_id, arg_max(len(regexp_extract_all(text, '(?i)(hand|ouwh|inging)')) - 1.0, turn) AS score FROM conversations GROUP BY 1) WHERE score > -0.5")
def reject_prefilter(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("turn", "ordinal")
    return cascade.reject_prefilter(c, "conv_id", "text", WITH_HAND, CHEAP, -0.5)


@query("agreement", "SELECT round(avg(CASE WHEN (score >= 0) = regexp_matches(text, '(?i)hand') THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM " + _SCORED)
def agreement(spark, d):
    docs = table(spark, d, "documents").where("length(trim(text)) >= 10")
    s = docs.select(CHEAP.score_column(F.col("text"), WITH_HAND).alias("score"), predicates.pattern_mask("text", ["hand"]).alias("label"))
    return cascade.agreement(s).select(r6(F.col("agreement"), "agreement"))


@query("profile_thresholds")
def profile_thresholds(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return cascade.profile(docs.select(F.col("lang").alias("question"), CHEAP.score_column(F.col("text"), WITH_HAND).alias("score"), F.col("quality").alias("label")))


@query("band_simulation")
def band_simulation(spark, d):
    return cascade.simulate(spark, 40)


@query("dedup_result", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def dedup_result(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).where("n = 1").select("conv_id", "role", "turn")


@query("batch_assignment", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 8 AS batch FROM part")
def batch_assignment(spark, d):
    from quillon.sources.stored import with_ordinal

    return cascade.batched(with_ordinal(table(spark, d, "part").select("p_partkey"), "p_partkey"), 8).select("p_partkey", "batch")


# ---- pools and dictionaries ----------------------------------------------------------------------------------------

_POOL = """(SELECT *, row_number() OVER (PARTITION BY structured_match, semantic_label ORDER BY doc_id) AS pool_rank FROM
  (SELECT doc_id, text, lang = 'en' AND n_chars < 2000 AS structured_match, regexp_matches(text, '(?i)hand') AS semantic_label FROM documents))
  WHERE pool_rank <= CASE WHEN structured_match AND semantic_label THEN 12 WHEN structured_match THEN 28 ELSE 30 END"""


def _pool(spark, d):
    docs = table(spark, d, "documents")
    return suites.pool(docs, (F.col("lang") == "en") & (F.col("n_chars") < 2000), predicates.pattern_mask("text", ["hand"]), ["doc_id"])


@query("pool_quadrants", f"SELECT doc_id, structured_match, semantic_label, structured_match AND semantic_label AS ground_truth, pool_rank FROM {_POOL}")
def pool_quadrants(spark, d):
    return _pool(spark, d).select("doc_id", "structured_match", "semantic_label", "ground_truth", F.col("pool_rank").cast("long").alias("pool_rank"))


@query("annotations", f"SELECT doc_id, 'pattern' AS annotation_source, substring(text, 1, 240) AS evidence_excerpt, CASE WHEN structured_match AND semantic_label THEN 'both conditions hold' WHEN structured_match THEN 'only the structured condition holds' WHEN semantic_label THEN 'only the text condition holds' ELSE 'neither condition holds' END AS annotation_rationale FROM {_POOL}")
def annotations(spark, d):
    return suites.annotations(_pool(spark, d), "text").select("doc_id", "annotation_source", "evidence_excerpt", "annotation_rationale")


@query("text_concat_by_id", "SELECT conv_id, substring(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), 1, 4000) AS text FROM conversations GROUP BY 1")
def text_concat_by_id(spark, d):
    return suites.joined_texts(table(spark, d, "conversations"), "conv_id", "text", ["turn"])


_LOG_ODDS = r"""
WITH d AS (SELECT quality AS y, lower(text) AS t FROM documents JOIN labels USING (doc_id)),
w AS (SELECT row_number() OVER () AS r, y, regexp_extract_all(t, '[a-z0-9'']+') AS w FROM d),
g AS (SELECT r, y, unnest(w) AS term FROM w
  UNION SELECT r, y, w[i] || ' ' || w[i + 1] FROM (SELECT r, y, w, unnest(range(1, len(w))) AS i FROM w)
  UNION SELECT r, y, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT r, y, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
f AS (SELECT term, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM g GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT sum(pos) AS n1, sum(neg) AS n0 FROM f), a AS (SELECT *, 0.01 * (pos + neg) AS a, 0.01 * (n1 + n0) AS s FROM f, n),
z AS (SELECT term, pos::BIGINT AS pos, neg::BIGINT AS neg, round((ln((pos + a) / (n1 + s - pos - a)) - ln((neg + a) / (n0 + s - neg - a))) / sqrt(1 / (pos + a) + 1 / (neg + a)), 6) AS z FROM a)
SELECT * FROM z WHERE z > 0"""


@query("ngram_log_odds", _LOG_ODDS)
def ngram_log_odds(spark, d):
    """Terms of one to three words of all labelled documents."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    z = dictionary.anchors(docs, "text", "quality", most=3, top=None)
    return z.select("term", "pos", "neg", r6(F.col("z"), "z")).where("z > 0")


@query("anchor_terms", _LOG_ODDS + " ORDER BY z DESC, term LIMIT 20")
def anchor_terms(spark, d):
    """The twenty strongest terms, as a dictionary entry has them."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return dictionary.anchors(docs, "text", "quality", most=3, top=20).select("term", "pos", "neg", r6(F.col("z"), "z"))


_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda x: NOT list_contains(['a','an','and','are','as','at','be','by','do','does','for','from','in','is','it','of','on','or','that','the','this','to','was','with'], x))"


@query("jaccard_concept_match", f"""
WITH c AS (SELECT item_id, text AS phrase, {_TOKENS.format('text')} AS b FROM benchmark),
q AS (SELECT doc_id AS id, text, {_TOKENS.format('text')} AS a FROM documents),
p AS (SELECT id, item_id, contains(lower(text), lower(phrase)) AS inside, len(list_intersect(a, b)) AS i, len(a) + len(b) AS n FROM q, c),
s AS (SELECT id, 'item' || item_id::VARCHAR AS concept, CASE WHEN inside THEN 1.0::DOUBLE ELSE i / (n - i)::DOUBLE END AS j, inside FROM p WHERE i > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY inside DESC, j DESC, concept) AS r FROM s WHERE j >= 0.05::DOUBLE)
SELECT id, concept, round(j, 6) AS similarity FROM r WHERE r = 1""")
def jaccard_concept_match(spark, d):
    c = table(spark, d, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("concept"), F.col("text").alias("phrase"))
    q = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return dictionary.match_concepts(q, c, 0.05).select("id", "concept", r6(F.col("similarity"), "similarity"))


@query("category_match", "SELECT item_id, CASE WHEN contains(lower(text), 'hehe') THEN 'laugh' WHEN contains(lower(text), 'reed') OR contains(lower(text), 'hand') THEN 'nature' END AS category FROM benchmark")
def category_match(spark, d):
    return table(spark, d, "benchmark").select("item_id", dictionary.match_category(F.col("text"), [("laugh", ["hehe"]), ("nature", ["reed", "hand"])]).alias("category"))


@query("proxy_labels", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)hand') THEN 1 WHEN regexp_matches(text, '(?i)(reed|hehe)') THEN 0 END AS label FROM documents")
def proxy_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", dictionary.proxy_labels("text", ["hand"], ["reed", "hehe"]).alias("label"))


@query("first_by_concept", "SELECT doc_id, lang AS concept, quality AS label FROM (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS n FROM documents JOIN labels USING (doc_id)) WHERE n <= 4")
def first_by_concept(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("lang").alias("concept"), F.col("quality").alias("label"))
    return dictionary.first_by_concept(j, ["doc_id"])


@query("exemplars")
def exemplars(spark, d):
    return dictionary.exemplars(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


# ---- evaluation ----------------------------------------------------------------------------------------------------


@query("prf1", """
WITH f AS (SELECT source, doc_id FROM documents WHERE regexp_matches(text, '(?i)hand')), t AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
j AS (SELECT coalesce(f.source, t.source) AS source, f.doc_id AS a, t.doc_id AS b FROM f FULL JOIN t ON f.doc_id = t.doc_id AND f.source = t.source),
c AS (SELECT source, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (WHERE b IS NULL) AS fp, count(*) FILTER (WHERE a IS NULL) AS fn FROM j GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS q FROM c)
SELECT source, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r""")
def prf1(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    t = docs.join(table(spark, d, "labels").where("quality = 1"), "doc_id")
    return evaluation.prf(docs.where(predicates.pattern_mask("text", ["hand"])), t, ["source"], "doc_id").select("source", "tp", "fp", "fn", *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


@query("mean_by_method", "SELECT event_type, user_id % 5 AS g, round(avg(value), 6) AS value, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS high FROM events GROUP BY 1, 2")
def mean_by_method(spark, d):
    e = table(spark, d, "events").withColumns({"g": F.col("user_id") % 5, "high": F.col("value") > 20})
    return evaluation.means(e, ["event_type", "g"], ["value", "high"]).select("event_type", "g", r6(F.col("value"), "value"), r6(F.col("high"), "high"))


@query("two_level_mean_std", "SELECT event_type, round(avg(v), 6) AS value_mean, round(stddev_samp(v), 6) AS value_std FROM (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def two_level_mean_std(spark, d):
    return evaluation.two_level(table(spark, d, "events"), "event_type", "user_id", ["value"]).select("event_type", r6(F.col("value_mean"), "value_mean"), r6(F.col("value_std"), "value_std"))


@query("cost_columns", "SELECT event_id, round(value * (3.0::DOUBLE / 3600), 10) AS cost, round(CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE value * (3.0::DOUBLE / 3600) / (user_id % 4) END, 10) AS cost_per_call, round((CASE WHEN user_id % 3 = 0 THEN value ELSE value / 2 END) * (3.0::DOUBLE / 3600), 10) AS expensive_cost, round(greatest(0, value - 5 - (CASE WHEN user_id % 3 = 0 THEN 0 ELSE value / 2 END)), 10) AS residual FROM events")
def cost_columns(spark, d):
    e = table(spark, d, "events").withColumns({"calls": F.col("user_id") % 4, "expensive_seconds": F.when(F.col("user_id") % 3 != 0, F.col("value") / 2)})
    e = evaluation.costs(e, "value", "calls").withColumn("residual", evaluation.residual(F.col("value"), F.lit(5.0), F.col("expensive_seconds")))
    return e.select("event_id", *(F.round(c, 10).alias(c) for c in ("cost", "cost_per_call", "expensive_cost", "residual")))


@query("pareto_front", "SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def pareto_front(spark, d):
    return evaluation.pareto(table(spark, d, "part"), "p_partkey", "p_retailprice", "p_size").select("p_partkey", "p_retailprice", "p_size")


_RUNS = "(SELECT l_linenumber AS n, l_returnflag AS method, avg(l_quantity) AS v, avg(l_discount) AS f FROM lineitem GROUP BY 1, 2)"


def _runs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("v"), F.avg("l_discount").alias("f"))


@query("crossover", f"SELECT min(o.n) AS crossover FROM {_RUNS} o JOIN {_RUNS} b ON o.n = b.n AND o.method = 'A' AND b.method = 'R' WHERE o.v < b.v AND o.f >= 0.85 * b.f")
def crossover(spark, d):
    return evaluation.crossover(_runs(spark, d), "n", "method", "R", "A", "v", "f")


@query("relative_changes", f"SELECT o.n, round(100 * (o.v - b.v) / b.v, 6) AS v_change FROM {_RUNS} o JOIN {_RUNS} b ON o.n = b.n AND o.method = 'A' AND b.method = 'R'")
def relative_changes(spark, d):
    return evaluation.changes(_runs(spark, d), "n", "method", "R", "A", ["v"]).select("n", r6(F.col("v_change"), "v_change"))


@query("auc_rank", "WITH x AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc FROM x a JOIN x b ON a.y = 1 AND b.y = 0")
def auc_rank(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return evaluation.auc(x, "n_chars", "quality").select(r6(F.col("auc"), "auc"))


@query("wilson_failure_rate", """
WITH g AS (SELECT user_id % 10 AS g, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), p AS (SELECT *, failures / n AS p, 1.959963984540054 AS z FROM g)
SELECT g, n, failures, round(p, 6) AS rate, round(m, 6) AS ratio_mean, lo AS ratio_min, hi AS ratio_max,
 round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS wilson_low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS wilson_high FROM p""")
def wilson_failure_rate(spark, d):
    e = table(spark, d, "events").withColumns({"g": F.col("user_id") % 10, "failed": F.col("event_type") == "error"})
    out = evaluation.failure_rates(e, "g", "failed", "value")
    return out.select("g", "n", "failures", "ratio_min", "ratio_max", *(r6(F.col(c), c) for c in ("rate", "ratio_mean", "wilson_low", "wilson_high")))


@query("percentile_index", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN value END) AS p50, max(CASE WHEN i = floor(0.9 * (n - 1)) THEN value END) AS p90 FROM r GROUP BY 1")
def percentile_index(spark, d):
    return evaluation.index_percentiles(table(spark, d, "events"), "event_type", "value").select("event_type", "n", r6(F.col("mean"), "mean"), "p50", "p90")


@query("routing_share_pivot", "SELECT l_linenumber, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'A') / count(*), 6) AS A, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'N') / count(*), 6) AS N, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS R FROM lineitem GROUP BY 1")
def routing_share_pivot(spark, d):
    return evaluation.routing_shares(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"]).select("l_linenumber", *(r6(F.col(c), c) for c in "ANR"))


@query("pivot_heatmap", "SELECT l_linenumber, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), 6) AS A, round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS R FROM lineitem GROUP BY 1")
def pivot_heatmap(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "R"]).avg("l_discount").select("l_linenumber", r6(F.col("A"), "A"), r6(F.col("R"), "R"))


@query("completeness", "SELECT 'doc_id' AS \"column\", round(100.0 * count(doc_id) / count(*), 6) AS pct FROM (SELECT d.doc_id, q.quality FROM documents d LEFT JOIN labels q USING (doc_id)) UNION ALL SELECT 'quality', round(100.0 * count(quality) / count(*), 6) FROM (SELECT d.doc_id, q.quality FROM documents d LEFT JOIN labels q USING (doc_id))")
def completeness(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return evaluation.completeness(j).select("column", r6(F.col("pct"), "pct"))


@query("decade_histogram", "SELECT (year(o_orderdate) // 10 * 10)::INT AS decade, count(*) AS n FROM orders GROUP BY 1")
def decade_histogram(spark, d):
    return table(spark, d, "orders").groupBy(tx.decade(F.year("o_orderdate")).alias("decade")).agg(F.count("*").alias("n"))


@query("fixed_histogram", "SELECT least(floor((value - 0) / 5.0) + 1, 10)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 50 GROUP BY 1")
def fixed_histogram(spark, d):
    return evaluation.histogram(table(spark, d, "events"), "value", 0, 50, 10)


@query("top_k_groups", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 10")
def top_k_groups(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand", "p_type").limit(10)


@query("distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_orderkey, l_partkey)) AS pairs, count(DISTINCT round(l_discount, 2)) AS discounts FROM lineitem")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey", "l_partkey").alias("pairs"), F.countDistinct(F.round("l_discount", 2)).alias("discounts"))


@query("tradeoff_score", """
WITH g AS (SELECT l_linenumber AS n, l_returnflag AS m, avg(l_discount) AS r, avg(l_quantity) AS s, avg(l_tax) AS c FROM lineitem GROUP BY 1, 2),
t AS (SELECT n, m, 0.6 * r + 0.2 * (1 - s / max(s) OVER (PARTITION BY n)) + 0.2 * (1 - c / max(c) OVER (PARTITION BY n)) AS t FROM g)
SELECT n, arg_max(m, t) AS best, round(max(t), 6) AS tradeoff FROM t GROUP BY 1""")
def tradeoff_score(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("m")).agg(F.avg("l_discount").alias("r"), F.avg("l_quantity").alias("s"), F.avg("l_tax").alias("c"))
    return evaluation.tradeoff(g, "n", "m", "r", "s", "c").select("n", "best", r6(F.col("tradeoff"), "tradeoff"))


@query("rank_marks", "WITH g AS (SELECT event_type, user_id % 7 AS g, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, g) AS n FROM g) SELECT event_type, g, round(v, 4) AS v, CASE n WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark FROM r")
def rank_marks(spark, d):
    g = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("g")).agg(F.sum("value").alias("v"))
    return evaluation.rank_marks(g, "event_type", "g", "v").select("event_type", "g", F.round("v", 4).alias("v"), "mark")


@query("incomplete_runs", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS units FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> 4")
def incomplete_runs(spark, d):
    return evaluation.complete_runs(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 4)


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a.subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query("conflicting_keys", "SELECT text, count(DISTINCT source) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def conflicting_keys(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.countDistinct("source").alias("n")).where("n > 1")



@query("mean_tuple_size", r"SELECT round(avg(greatest(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')), 1)), 6) AS tokens FROM benchmark")
def mean_tuple_size(spark, d):
    return joins.mean_tokens(table(spark, d, "benchmark"), "text").select(r6(F.col("tokens"), "tokens"))


@query("cost_savings", f"SELECT o.n, round(100 * (o.v * 2 - b.v) / b.v, 6) AS cost_change, round(100 * (o.f - b.f) / b.f, 6) AS f_change FROM {_RUNS} o JOIN {_RUNS} b ON o.n = b.n AND o.method = 'N' AND b.method = 'R'")
def cost_savings(spark, d):
    r = _runs(spark, d).withColumn("cost", F.when(F.col("method") == "N", F.col("v") * 2).otherwise(F.col("v")))
    return evaluation.changes(r, "n", "method", "R", "N", ["cost", "f"]).select("n", r6(F.col("cost_change"), "cost_change"), r6(F.col("f_change"), "f_change"))


@query("ordered_methods", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def ordered_methods(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return evaluation.ordered_by(g, "o_orderpriority", ["5-LOW", "1-URGENT"], "o_orderpriority")


@query("question_to_query", "SELECT doc_id FROM documents WHERE n_chars < 900 AND length(trim(text)) >= 10 AND regexp_matches(text, '(?i)hand')")
def question_to_query(spark, d):
    docs = table(spark, d, "documents")
    asked = "texts of less than 900 minutes that speak of a hand"
    sql = semantic.to_query(asked, "documents", docs.columns, minutes="n_chars")
    return semantic.run(spark, sql, LexicalJudge({asked: ["hand"]}), {"documents": docs}).select("doc_id")


@query("value_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def value_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("run_union", "SELECT 'a' AS run, p_partkey AS k FROM part WHERE p_size < 5 UNION ALL SELECT 'b', s_suppkey FROM supplier")
def run_union(spark, d):
    a = table(spark, d, "part").where("p_size < 5").select(F.lit("a").alias("run"), F.col("p_partkey").alias("k"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("b").alias("run"), F.col("s_suppkey").alias("k")))


@query("budget_packing", "SELECT count(*) AS rows, sum(greatest(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')), 1))::BIGINT AS tokens FROM benchmark")
def budget_packing(spark, d):
    """Every row is in one batch; the batches' rows and tokens add up."""
    from quillon.sources.stored import with_ordinal

    b = with_ordinal(table(spark, d, "benchmark").select("item_id", "text"), "item_id")
    packed = joins.packed(b, 400, 10)
    by = packed.groupBy("range", "batch").agg(F.count("*").alias("n"), F.sum(tx.token_count(F.col("text"))).alias("t"))
    return by.agg(F.sum("n").alias("rows"), F.sum("t").alias("tokens"))


from quillon import catalog_parts  # noqa: E402, F401  registers its queries with query()
