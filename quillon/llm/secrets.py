"""Secret scans: fixed patterns, and formats inferred from the secrets that the patterns label.

The patterns find assignments, access keys and long hexadecimal runs in every text. A bounded sample of what they find, by
kind, is a set of labelled credentials (a caller can add others): a prefix tree of them is folded into a probabilistic
automaton by merging states whose outgoing and ending frequencies a Hoeffding bound can't tell apart (as in ALERGIA). Each
candidate is scored by the mean log-likelihood of its characters under each automaton; it is a secret if that reaches what
nearly all labelled credentials held out of the fit reach. So what is found besides the patterns are formats that credentials
in assignments have, where no assignment, prefix or length gives them away.

A candidate is a run of credential characters with a letter and a digit, as long as the shortest labelled credential at
least, that no pattern's span covers whole; it may contain or overlap one. Runs of letters alone or digits alone are words
and numbers, not candidates.

Texts are read twice, once for the sample and once for the spans. Only offsets are written to disk: a credential's text is
never stored or shuffled; the sample's, at most TRAIN of each kind, go to the driver's memory.

Defined results: a null text is empty and has no spans; without labelled credentials no span is added; an empty table
gives an empty result; rows are judged one by one, so ties and repeated rows agree; very long texts are read whole; other
columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._common import settle

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Labelled credentials of each kind from which the automata are fitted, at most, and characters of one.
TRAIN, LONGEST = 500, 512
ALPHA = 0.05

_TRAIT = bytearray(b" " * 256)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-":
    _TRAIT[_c] = ord("x")
for _c in b"abcdef":
    _TRAIT[_c] = ord("h")
for _c in b"0123456789":
    _TRAIT[_c] = ord("d")
_TRAIT = bytes(_TRAIT)
_LONG_HEX = re.compile(rb"[hd]{32}")


def base_spans(raw: bytes) -> list[tuple]:
    """Tuples kind, start, end, start of the value, of a UTF-8 text; in code points. A value ends with its span."""
    low, trait = raw.lower(), raw.translate(_TRAIT)
    ask, key, hexed = any(x in low for x in NAMES), b"AKIA" in raw, _LONG_HEX.search(trait)
    if not (ask or key or hexed):
        return []
    text = raw.decode()
    spans = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if ask else []
    spans += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]] if key else []
    spans += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]] if hexed else []
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def candidates(raw: bytes, spans: list[tuple], least: int) -> list[tuple[int, int, str]]:
    """Tuples start, end, value of the runs of least characters or more, with a letter and a digit, that no span covers."""
    trait, found = raw.translate(_TRAIT), []
    if b"d" not in trait or not (near := _runs(least).search(trait)):
        return found
    text = raw.decode()
    first = len(raw[: near.start()].decode())  # nothing before the first long run
    at, upto = 0, -1
    for m in RUN.finditer(text, first):
        while at < len(spans) and spans[at][1] <= m.start():
            upto, at = max(upto, spans[at][2]), at + 1
        if upto < m.end() and m.end() - m.start() >= least and _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            found.append((m.start(), m.end(), m[0]))
    return found


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


@cache
def _runs(least: int):
    """The start of a run of least characters or more with a digit among them, in a text's traits; tried at starts of runs only."""
    return re.compile(rb"(?<![xhd])(?=[xhd]{%d})[xh]*d" % least)


_SPAN = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value.encode(), 42) >> 1


def _labels(batches):
    """One row for each base span of a batch, without its value: kind, the value's hash, and the span's number in the text."""
    for batch in batches:
        rows = []
        for i, x in enumerate(batch.column("text").cast(pa.binary())):
            spans = base_spans(raw) if (raw := x.as_py()) else []
            if spans:
                text = raw.decode()
                rows += [(i, s[0], _hash(text[s[3] : s[2]]), n) for n, s in enumerate(spans) if s[2] - s[3] <= LONGEST]
        who, kind, h, n = zip(*rows) if rows else ((), (), (), ())
        take = pa.array(who, pa.int64())
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in kept), pa.array(kind, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int32())], names=[*kept, "kind", "h", "n"])


class Automaton:
    """A probabilistic deterministic automaton; states are numbers, 0 is the start."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.n, self.ends, self.go, self.by = [0], [0], [{}], [defaultdict(int)]
        for w in words:
            at = 0
            for c in w:
                self.n[at] += 1
                self.by[at][c] += 1
                if c not in self.go[at]:
                    self.go[at][c] = len(self.n)
                    self.n.append(0), self.ends.append(0), self.go.append({}), self.by.append(defaultdict(int))
                at = self.go[at][c]
            self.n[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _infer(self) -> None:
        red = [0]
        while True:
            kept = set(red)
            blue = [(q, c, to) for q in red for c, to in sorted(self.go[q].items()) if to not in kept]
            if not blue:
                return
            q, c, to = max(blue, key=lambda x: self.n[x[2]])
            into = next((r for r in red if self._compatible(r, to)), None)
            if into is None:
                red.append(to)
            else:
                self.go[q][c] = into
                self._fold(into, to)

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.n[a], self.n[b]
            if not na or not nb:
                continue
            most = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if most >= 1:  # nothing can tell them apart, nor what comes after the rarer one
                continue
            if abs(self.ends[a] / na - self.ends[b] / nb) > most:
                return False
            for c in {*self.by[a], *self.by[b]}:
                if abs(self.by[a].get(c, 0) / na - self.by[b].get(c, 0) / nb) > most:
                    return False
            stack += [(self.go[a][c], to) for c, to in self.go[b].items() if c in self.go[a] and self.go[a][c] != to]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the counts of the subtree at tree, which nothing else reaches, to the states it runs along with."""
        stack = [(into, tree)]
        while stack:
            a, b = stack.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, k in self.by[b].items():
                self.by[a][c] += k
            for c, to in self.go[b].items():
                if c in self.go[a]:
                    stack.append((self.go[a][c], to))
                else:
                    self.go[a][c] = to

    def table(self) -> list[dict]:
        """For each state: character to (log2 probability, next state)."""
        return [{c: (math.log2(self.by[q][c] / self.n[q]), to) for c, to in self.go[q].items() if self.by[q][c]} for q in range(len(self.n))]

    def reachable(self) -> int:
        seen, stack = {0}, [0]
        while stack:
            for to in self.go[stack.pop()].values():
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
        return len(seen)


#: log2 probability of a character that the state has never seen.
UNSEEN = -14.0


def likelihood(table: list[dict], word: str, enough: float = -math.inf) -> float:
    """Mean log2 probability of the characters of word; once it can't be enough any more, some lower bound of that."""
    at, total, stop = 0, 0.0, enough * len(word)
    for c in word:
        p, at = table[at].get(c, (UNSEEN, at))
        total += p
        if total < stop:
            break
    return total / max(len(word), 1)


def infer(labelled: dict[str, list[str]]) -> dict[str, tuple[list[dict], float]]:
    """kind to (table, least likelihood of a secret). One in five credentials is held out to set the threshold."""
    models = {}
    for kind, words in sorted(labelled.items()):
        held = words[::5] if len(words) >= 10 else words
        fit = [w for i, w in enumerate(words) if i % 5] if len(words) >= 10 else words
        if not fit:
            continue
        table = Automaton(fit).table()
        scores = sorted(likelihood(table, w) for w in held)
        models[kind] = table, scores[len(scores) // 50] - 0.1
    return models


def labelled(docs: DataFrame, most: int = TRAIN) -> dict[str, list[str]]:
    """most different credentials of each kind that the patterns find in docs, those with the least hashes, in that order.

    Hashes and the digests of texts choose them; the chosen texts' values then go straight to the driver.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    each = texts.select(F.unhex(F.sha2("text", 256)).alias("k"), "text").mapInArrow(_labels, "k binary, kind string, h long, n int")
    one = settle(each.groupBy("kind", "h").agg(F.min(F.struct("k", "n")).alias("at")), "labels")
    chosen = []
    for kind in KINDS[:3]:
        chosen += one.where(F.col("kind") == kind).orderBy("h").limit(most).collect()
    if not chosen:
        return {}
    # most of each kind at most
    ids = F.broadcast(docs.sparkSession.createDataFrame(sorted({(bytes(r["at"]["k"]),) for r in chosen}), "k binary"))
    wanted = {(bytes(r["at"]["k"]), r["at"]["n"]) for r in chosen}

    def values(batches):
        seen = set()
        for batch in batches:
            out = []
            for k, x in zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    text = x.decode()
                    out += [(s[0], text[s[3] : s[2]]) for n, s in enumerate(base_spans(x)) if (k, n) in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["kind", "value"])

    held = texts.withColumn("k", F.unhex(F.sha2("text", 256))).join(ids, "k", "left_semi").mapInArrow(values, "kind string, value string").collect()
    found = {kind: sorted({r.value for r in held if r.kind == kind}, key=lambda v: (_hash(v), v)) for kind in KINDS[:3]}
    return {k: v for k, v in found.items() if v}


def scan(docs: DataFrame, keys: list[str], train: int = TRAIN, more: dict[str, list[str]] | None = None) -> DataFrame:
    """keys, base and spans of every row: arrays of structs kind, start, end by start, then kind as in KINDS.

    more: labelled credentials by kind, besides those of the patterns. The automata travel to the executors with the code:
    they have at most train times LONGEST states for each kind.
    """
    known = labelled(docs, train) | (more or {})
    models = list(infer(known).values())
    least = min((len(v) for vs in known.values() for v in vs), default=0)
    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))

    def scored(batches):
        for batch in batches:
            both = []
            for x in batch.column("text").cast(pa.binary()):
                raw = x.as_py() or b""
                base = base_spans(raw)
                hits = [("format", a, b) for a, b, v in (candidates(raw, base, least) if models else ()) if any(likelihood(t, v, at_least) >= at_least for t, at_least in models)]
                spans = sorted([*(s[:3] for s in base), *hits], key=lambda s: (s[1], KINDS.index(s[0])))
                both.append([[dict(zip(("kind", "start", "end"), s)) for s in part] for part in (base, spans)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([x[i] for x in both], _ARROW) for i in (0, 1))], names=[*keys, "base", "spans"])

    schema = T.StructType([rows.schema[k] for k in keys]).add("base", T._parse_datatype_string(_SPAN)).add("spans", T._parse_datatype_string(_SPAN))
    return rows.mapInArrow(scored, schema)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each stretch that spans cover replaced by mark; spans by start."""
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; a null text is empty and has none."""
    done = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
