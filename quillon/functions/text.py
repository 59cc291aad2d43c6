"""Text functions as Columns, and the few plain ones that drivers and backends use."""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text limits in characters.
ROW_SCORE, ANSWER, SUMMARY, BATCH, PROMPT, EXCERPT = 1800, 6000, 2000, 3500, 1800, 240
SHORT = 10


def collapse(text: Column) -> Column:
    """<br /> becomes a space, white space collapses, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<br\s*/?>", " "), r"\s+", " "))


def prompt_text(columns: dict[str, Column], limit: int = PROMPT) -> Column:
    """'name=value; name=value' of the columns, cut to limit; null values are empty."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in columns.items()]
    return F.substring(F.concat_ws("; ", *parts), 1, limit)


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def token_count(text: Column) -> Column:
    """Words and single marks, at least 1."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]")), F.lit(1))


def token_count_py(text: str) -> int:
    return max(1, len(re.findall(r"\w+|[^\w\s]", text or "", re.ASCII)))


def price(text: Column) -> Column:
    """The first number of a price text such as '$1,234.50 - $99'; null if there is none."""
    bare = F.regexp_replace(text, r"[$,]", "")
    return F.regexp_extract(bare, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(text: Column, most: int = 3) -> Column:
    """Lower-case n-grams of 1 to most words, an array. The words are cut once, so the cost is linear in the text."""

    def of(w: Column, n: int) -> Column:
        last = F.size(w) - n + 1
        if n == 1:
            return w
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws(" ", *(F.element_at(w, i + k) for k in range(n))))).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: F.concat(*(of(w, n) for n in range(1, most + 1))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def excerpt(text: str, patterns: list[str], width: int = 300) -> str:
    """width characters at most around the first match of patterns, cut at words, with ellipses; the start without a match."""
    text = re.sub(r"\s+", " ", text or "").strip()
    if len(text) <= width:
        return text
    m = re.search("|".join(f"(?:{p})" for p in patterns), text, re.IGNORECASE) if patterns else None
    room = width - 6
    lo = max(0, min((m.start() + m.end()) // 2 - room // 2, len(text) - room)) if m else 0
    hi = lo + room
    if lo and not text[lo - 1].isspace():
        nxt = text.find(" ", lo)
        lo = nxt + 1 if 0 <= nxt < (m.start() if m else hi) + 1 else lo
    if hi < len(text) and not text[hi].isspace():
        prev = text.rfind(" ", lo, hi)
        hi = prev if prev >= (m.end() if m else lo) else hi
    return ("..." if lo else "") + text[lo:hi].strip() + ("..." if hi < len(text) else "")


def excerpt_column(text: Column, patterns: list[str], width: int = 300) -> Column:
    """excerpt() as a Column: positions come from regexp_instr, so that no row leaves the JVM."""
    room, space = width - 6, F.lit(" ")
    found = "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")" if patterns else None

    def bounds(t: Column) -> Column:
        n = F.length(t)
        if found is None:
            return F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), n.alias("n"))
        at = F.regexp_instr(t, F.lit(found))
        return F.struct(F.when(at > 0, at - 1).alias("s"), F.when(at > 0, at - 1 + F.length(F.regexp_extract(t, found, 0))).alias("e"), n.alias("n"))

    def low(t: Column, b: Column) -> Column:
        middle = F.floor((b["s"] + b["e"]) / 2).cast("int") - room // 2
        lo = F.when(b["s"].isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(middle, b["n"] - room)))

        def moved(lo: Column) -> Column:
            nxt = F.instr(F.substr(t, lo + 1), " ") - 1  # from lo
            inside = (lo > 0) & (F.substr(t, lo, F.lit(1)) != space) & (nxt >= 0) & (lo + nxt < F.coalesce(b["s"], lo + room) + 1)
            return F.struct(F.when(inside, lo + nxt + 1).otherwise(lo).alias("lo"), (lo + room).alias("hi"))

        return let(lo, moved)

    def cut(t: Column, b: Column, x: Column) -> Column:
        part = F.substr(t, x["lo"] + 1, F.greatest(x["hi"] - x["lo"], F.lit(0)))
        prev = x["lo"] + F.length(part) - F.length(F.regexp_extract(part, "[^ ]*$", 0)) - 1
        torn = (x["hi"] < b["n"]) & (F.substr(t, x["hi"] + 1, F.lit(1)) != space) & (prev >= F.coalesce(b["e"], x["lo"])) & part.contains(" ")
        return let(F.when(torn, prev).otherwise(x["hi"]), lambda hi: F.concat(F.when(x["lo"] > 0, "...").otherwise(""), F.trim(F.substr(t, x["lo"] + 1, hi - x["lo"])), F.when(hi < b["n"], "...").otherwise("")))

    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return let(plain, lambda t: F.when(F.length(t) <= width, t).otherwise(let(bounds(t), lambda b: let(low(t, b), lambda x: cut(t, b, x)))))


def unescape(text: str | None) -> str:
    return html.unescape(text or "")


def wilson(failures: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a rate."""
    p, z2 = failures / n, z * z
    mid, root, den = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    return (mid - root) / den, (mid + root) / den


def logsumexp(values: list[float]) -> float:
    m = max(values)
    return m + math.log(sum(math.exp(v - m) for v in values))
