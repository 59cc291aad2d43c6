"""Licence scans: TF-IDF cosine of headers and licence files to templates, and inheritance from the nearest directory.

DataFrame functions only. A text with a word that licences use is cut into units: each line with such a word, each block of
lines (a header, a paragraph of a licence) with one, and the whole text. Equal units are one. A unit is a sparse vector of its
terms, weighed by their frequency and their inverse frequency among the templates (a term of none weighs most); its licence
is the template with the largest cosine, if that reaches the threshold. A file has the licence of its best unit: the whole
text first, then the block that it begins with, then the others by cosine times the logarithm of their length, so that a
long match beats a short one. A file speaks for its directory if it has a licence and is named as licence files are, begins with a
licence's title, or stands mostly in units that matched. A file without a licence gets that of the nearest directory above it that has
one; directories, not files, are joined to their ancestors. "All rights reserved" alone is no licence, but such a file inherits none.

Defined results: a null or empty text has no unit; a null path is in no directory; directories with several licence files
take the best unit, then the first licence by name; ties between templates go to the first by name; repeated rows agree; an
empty table gives an empty result; texts are cut whole, however long; other columns are left out.
"""

from __future__ import annotations

import base64
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import WORD, let, settle
from quillon.llm.license_texts import TEMPLATES, TITLES

#: A line or a block with one of these is a unit.
MARKS = r"(?i)licen[cs]e|copyright|rights reserved|public domain|spdx-|redistribut|permission (?:is|to)\b|gnu (?:general|lesser|affero)|creative commons"
RESERVED = r"(?i)all rights reserved"
#: Lines without a letter or digit part blocks.
GAP = r"\n(?:[^\p{L}\p{N}\n]*(?:\n|$))+"
COSINE = 0.75
#: A file is a licence file if this share of its words, in per cent, stands in units that matched.
FILE_SHARE = 50
FILE_NAME = r"(?i)(^|/)(?:un)?(?:licen[cs]e|copying)[^/]*$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9.]*[a-z0-9]"), F.lit(0))


def classified(units: DataFrame, cosine: float = COSINE, templates=TEMPLATES) -> DataFrame:
    """unit, license, score, terms, title for each unit of units (unit, a key, and text) whose best template reaches cosine.

    title: whether the template is one of TITLES.

    Weights depend on the templates alone, a fixed list, so units meet a broadcast and nothing is shuffled by term.
    """
    spark, n = units.sparkSession, len(templates)
    text = lambda t: base64.b64encode(t.encode()).decode()
    rows = ", ".join(f"({k}, '{i}', '{text(t)}')" for k, (i, t) in enumerate(templates))
    model = spark.sql(f"SELECT template, license, decode(unbase64(text), 'UTF-8') AS text FROM VALUES {rows} AS t(template, license, text)")
    count = lambda df, *key: df.select(*key, F.explode(terms(F.col("text"))).alias("term")).groupBy(*key, "term").count()
    theirs = settle(count(model, "template", "license"), "templates")
    rarity = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    idf = theirs.groupBy("term").agg(F.count("*").alias("df")).select("term", rarity.alias("idf"))
    most = math.log(1.0 + n) + 1.0
    weighed = theirs.join(idf, "term").select("template", "license", "term", (F.col("count") * F.col("idf")).alias("w"))
    norm = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    near = settle(weighed.join(norm, "template").join(idf, "term").select("term", "idf", F.struct("template", "license", (F.col("w") / F.col("len")).alias("t")).alias("x")).groupBy("term", "idf").agg(F.collect_list("x").alias("in")), "near")
    # the templates' terms number some hundreds, a fixed list
    mine = count(units, "unit").join(F.broadcast(near), "term", "left").select("unit", (F.col("count") * F.coalesce("idf", F.lit(most))).alias("w"), "count", "in")
    mine = settle(mine, "weights")
    size = mine.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.sum("count").alias("terms"))
    dots = mine.select("unit", "w", F.explode("in").alias("x")).groupBy("unit", "x.template", "x.license").agg(F.sum(F.col("w") * F.col("x.t")).alias("dot"))
    scores = dots.join(size, "unit").select("unit", "template", "license", "terms", F.round(F.col("dot") / F.col("len"), 6).alias("score")).where(F.col("score") >= cosine)
    best = scores.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "template", "terms")).alias("b"))
    title = F.col("b.template").isin([k for k, x in enumerate(templates) if x in TITLES])
    return best.select("unit", "b.license", (-F.col("b.s")).alias("score"), "b.terms", title.alias("title"))


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root, which has none (null)."""
    return F.when(path != "", F.regexp_replace(path, r"/?[^/]*$", ""))


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the nearest first."""

    def cut(parts: Column) -> Column:
        n = F.size(parts)
        return F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(parts, 1, n - k), "/")), F.array(F.lit("")))

    return F.when(directory == "", F.array(F.lit(""))).otherwise(let(F.split(directory, "/"), cut))


WHOLE, BLOCK, LINE = 0, 1, 2


def units(text: Column) -> Column:
    """Structs kind, first, words, text of a text's units: the text, its blocks and its lines, the latter two if they have a mark."""
    clean = lambda x: F.trim(F.regexp_replace(x, r"[\x00-\x20]+", " "))
    unit = lambda x, kind, first: F.struct(F.lit(kind).alias("kind"), first.alias("first"), F.regexp_count(x, F.lit(WORD)).alias("words"), clean(x).alias("text"))
    marked = lambda xs: F.filter(xs, lambda x: x["text"].rlike(MARKS))
    blocks = F.transform(F.split(F.regexp_replace(text, r"^\s+", ""), GAP, -1), lambda x, i: unit(x, BLOCK, i == 0))
    lines = F.transform(F.split(text, "\n", -1), lambda x: unit(x, LINE, F.lit(False)))
    return F.concat(F.array(unit(text, WHOLE, F.lit(False))), marked(blocks), marked(lines))


def scan(files: DataFrame, keys: list[str], cosine: float = COSINE, file_share: int = FILE_SHARE) -> DataFrame:
    """keys, license, score, via and n_notices of every row of files (keys, path, text).

    via: 'notice' (its own), 'directory' (inherited), 'reserved' (it reserves all rights and has no licence) or null; score
    is that of the unit it comes from. n_notices: lines with a word that licences use.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.lit(None).cast("array<struct<kind:int,first:boolean,words:int,text:string>>")
    rows = files.select(*keys, F.col("path").alias("__path"), F.when(t.rlike(MARKS), units(t)).otherwise(none).alias("__units"), t.rlike(RESERVED).alias("__reserved"))
    # texts go no further than their units; the rows are written, so that their numbers stay the same
    digest = lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["words"].alias("words"), F.md5(x["text"]).alias("unit"), x["text"].alias("text"))
    rows = settle(rows.select(F.monotonically_increasing_id().alias("__row"), *keys, "__path", "__reserved", F.transform("__units", digest).alias("__units")), "notices")
    each = rows.where("__units is not null").select("__row", F.explode("__units").alias("u"))
    distinct = each.select("u.unit", "u.text").groupBy("unit").agg(F.first("text").alias("text"))
    known = settle(classified(distinct, cosine), "licenses")
    met = each.select("__row", "u.kind", "u.first", "u.words", "u.unit").join(known, "unit")
    rank = F.struct((F.col("kind") != WHOLE).alias("part"), (~F.col("first")).alias("later"), (-F.col("score") * F.log1p("terms")).alias("far"), "license", "score")
    said = F.greatest(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("words"))), F.lit(0)) for k in (WHOLE, BLOCK, LINE)))
    own = met.groupBy("__row").agg(F.min(rank).alias("own"), said.alias("said"), F.max(F.col("first") & F.col("title")).alias("titled"))
    words = F.coalesce(F.col("__units")[0]["words"], F.lit(0))
    notices = F.coalesce(F.size(F.filter("__units", lambda x: x["kind"] == LINE)), F.lit(0))
    notices = F.when(F.col("__units").isNull(), 0).otherwise(notices)
    flat = rows.select("__row", *keys, parent(F.col("__path")).alias("__dir"), F.col("__path").rlike(FILE_NAME).alias("__named"), "__reserved", words.alias("__words"), notices.cast("long").alias("n_notices"))
    speaks = F.col("own").isNotNull() & (F.coalesce(F.col("__named"), F.lit(False)) | F.col("titled") | (F.col("said") * 100 >= F.col("__words") * file_share))
    judged = settle(flat.join(own, "__row", "left").select(*keys, "__dir", "__reserved", "n_notices", "own", F.coalesce(speaks, F.lit(False)).alias("__speaks")), "judged")
    given = judged.where("__speaks and __dir is not null").groupBy("__dir").agg(F.min("own").alias("given"))
    wanting = judged.where("own is null and not __reserved and __dir is not null").select("__dir").distinct()
    up = wanting.select("__dir", F.posexplode(ancestors(F.col("__dir"))).alias("up", "above"))
    nearest = up.join(given.select(F.col("__dir").alias("above"), "given"), "above").groupBy("__dir").agg(F.min_by("given", "up").alias("given"))
    # written, so that both sides of the join are shuffled as they are and a large directory can be split
    inherited = settle(nearest.withColumnRenamed("__dir", "__at"), "inherited")
    done = judged.join(inherited, (F.col("__dir") == F.col("__at")) & F.col("own").isNull() & ~F.col("__reserved"), "left")
    got = F.coalesce("own", "given")
    via = F.when(F.col("own").isNotNull(), "notice").when(F.col("given").isNotNull(), "directory").when(F.col("__reserved"), "reserved")
    return done.select(*keys, got["license"].alias("license"), got["score"].alias("score"), via.alias("via"), "n_notices")


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    """Each document as a file source/lang/doc_id.txt: doc_id, license, score, via, n_notices; a null text has no notice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"))
    return scan(files, ["doc_id"])
