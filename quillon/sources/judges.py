"""Who decides text predicates: judges that run offline, and one that asks a model server.

A judge answers one text at a time (answer), many (answers), scores (scores) and, for batches, decides several texts in one
call (decide). What a judge can express as a Column, it does: score_column and answer_column; None means Python only.
"""

from __future__ import annotations

import json
import math
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import ANSWER, BATCH, ROW_SCORE, SUMMARY, logsumexp

YES, NO, UNCERTAIN = "YES", "NO", "UNCERTAIN"


class Judge:
    def score_column(self, text: Column, question: str) -> Column | None:
        return None

    def answer_column(self, text: Column, question: str) -> Column | None:
        return None

    def scores(self, texts: list[str], question: str) -> list[float | None]:
        raise NotImplementedError

    def answers(self, texts: list[str], question: str) -> list[str | None]:
        """'Yes' or 'No' for each text; None if the judge failed."""
        raise NotImplementedError

    def decide(self, texts: list[str], question: str) -> dict[int, str]:
        """Position to YES, NO or UNCERTAIN; positions may be missing. One call."""
        return {i: (a or UNCERTAIN).upper() for i, a in enumerate(self.answers(texts, question))}

    def decide_within(self, texts: list[str], question: str, tokens: int) -> dict[int, str]:
        """decide() with this many tokens for the completion; what does not fit is missing."""
        return self.decide(texts, question)

    def summaries(self, texts: list[str]) -> list[str]:
        return [re.sub(r"\s+", " ", (t or "")[:SUMMARY]).strip()[:200] for t in texts]


@dataclass
class LexicalJudge(Judge):
    """Counts matches of a question's patterns: the score is hits minus margin, the answer is whether strict ones match."""

    patterns: dict[str, list[str]]
    strict: dict[str, list[str]] | None = None
    margin: float = 1.0

    def _pattern(self, question: str, strict: bool = False) -> str:
        found = (self.strict if strict and self.strict else self.patterns)[question]
        return "(?i)(?:" + "|".join(f"(?:{p})" for p in found) + ")"

    def score_column(self, text, question):
        return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(self._pattern(question))) - F.lit(self.margin)).cast("double")

    def answer_column(self, text, question):
        return F.when(F.coalesce(text, F.lit("")).rlike(self._pattern(question, True)), "Yes").otherwise("No")

    def scores(self, texts, question):
        p = re.compile(self._pattern(question))
        return [float(len(p.findall(t or ""))) - self.margin for t in texts]

    def answers(self, texts, question):
        p = re.compile(self._pattern(question, True))
        return ["Yes" if p.search(t or "") else "No" for t in texts]


@dataclass
class InPython(Judge):
    """Another judge, asked as a model server is: in Python, batch by batch.

    most: texts of a call beyond which it fails. each: tokens that a decision takes of a completion.
    """

    judge: Judge
    most: int = 10**9
    each: int = 0

    def scores(self, texts, question):
        return self.judge.scores(texts, question)

    def answers(self, texts, question):
        return self.judge.answers(texts, question)

    def decide(self, texts, question):
        return {} if len(texts) > self.most else self.judge.decide(texts, question)

    def decide_within(self, texts, question, tokens):
        fits = tokens // self.each if self.each else len(texts)
        return {i: d for i, d in self.decide(texts, question).items() if i < fits}


@dataclass
class LookupJudge(Judge):
    """Answers and scores that stand in columns beside the texts."""

    answer: Column
    score: Column

    def score_column(self, text, question):
        return self.score.cast("double")

    def answer_column(self, text, question):
        return F.when(self.answer.cast("boolean"), "Yes").otherwise("No")


@dataclass
class ScriptedJudge(Judge):
    """Fixed answers by text, for tests. most: texts in a batch beyond which a call fails."""

    said: dict[str, str]
    scored: dict[str, float | None] = field(default_factory=dict)
    most: int = 10**9
    log: str | None = None

    def _count(self, n):
        if self.log:
            with open(self.log, "a") as f:
                f.write(f"{n}\n")

    def scores(self, texts, question):
        return [self.scored.get(t) for t in texts]

    def answers(self, texts, question):
        self._count(len(texts))
        return [self.said.get(t) for t in texts]

    def decide(self, texts, question):
        self._count(len(texts))
        return {} if len(texts) > self.most else {i: self.said.get(t, NO).upper() for i, t in enumerate(texts)}


def parse_decision(text: str) -> str | None:
    """YES or NO of a free answer: a JSON object's decision or answer, else the first such word; uncertain is None."""
    m = re.search(r"\{.*\}", text or "", re.DOTALL)
    if m:
        try:
            found = json.loads(m[0])
            text = str(found.get("decision", found.get("answer", "")))
        except (ValueError, AttributeError):
            pass
    w = re.search(r"\b(uncertain|yes|no)\b", text or "", re.IGNORECASE)
    return w[1].upper() if w and w[1].lower() != "uncertain" else None


# Words that decision lines use.
SAID = {"yes": YES, "true": YES, "match": YES, "accept": YES, "no": NO, "false": NO, "mismatch": NO, "reject": NO, "uncertain": UNCERTAIN, "unsure": UNCERTAIN, "maybe": UNCERTAIN}


def parse_batch(text: str, n: int) -> dict[int, str]:
    """Decisions of a batch answer: JSON (plain, fenced or inside text) or lines such as 'PAIR_7: YES'; numbers from 1."""
    out = {}
    for m in re.finditer(r"\{.*?\}|\[.*\]", re.sub(r"```\w*", "", text or ""), re.DOTALL):
        try:
            found = json.loads(m[0])
        except ValueError:
            continue
        pairs = found.items() if isinstance(found, dict) else ((x.get("id"), x.get("decision", x.get("answer"))) for x in found if isinstance(x, dict))
        for k, v in pairs:
            d = re.search(r"\d+", str(k))
            if d and str(v).lower() in SAID:
                out.setdefault(int(d[0]) - 1, SAID[str(v).lower()])
    for m in re.finditer(r"(?im)^\W*(?:pair|row|item)?[_ #]*(\d+)\s*[:=\-).]\W*([a-z]+)", text or ""):
        if m[2].lower() in SAID:
            out.setdefault(int(m[1]) - 1, SAID[m[2].lower()])
    return {i: d for i, d in out.items() if 0 <= i < n}


def parse_batches(texts, sizes) -> list[list[str | None]]:
    """parse_batch() of each text, as a list by number; each text is parsed once."""
    return [[said.get(i) for i in range(n)] for said, n in zip(map(parse_batch, texts, sizes), sizes)]


# Where an id may begin, what may not follow it, and the decision after it.
_BEGINS, _GOES_ON = re.compile(r"(?<![\w-])"), re.compile(r"[\w-]")
_DECIDED = re.compile(r"\W{0,12}(?:decision\W{0,6})?([A-Za-z]+)?")


def parse_ids(text: str, known: list[str]) -> dict[str, str]:
    """Decisions by id: known ids followed by a decision word; lists of bare ids mean YES.

    Ids are looked up, the longest first: a pattern made of them would be compiled anew for each text.
    """
    text, ids, out, at = text or "", set(filter(None, known)), {}, 0
    sizes = sorted(set(map(len, ids)), reverse=True)
    for m in _BEGINS.finditer(text):
        start = m.start()
        for n in sizes if start >= at else ():
            i = text[start : start + n]
            if i in ids and not _GOES_ON.match(text, start + len(i)):
                said = _DECIDED.match(text, start + len(i))
                word = (said[1] or "").lower()
                out.setdefault(i, SAID.get(word, YES))
                at = said.end() if word in SAID else start + len(i)  # another word may be the next id
                break
    return out


def log_odds(top: dict[str, float]) -> float | None:
    """Log-odds of yes over no from the log-probabilities of the first token; spellings are pooled.

    One side alone gives its clipped probability against the rest; neither side, None.
    """
    side = {"yes": [], "no": []}
    for token, lp in top.items():
        w = token.strip().strip(".,!\"'").lower()
        if w in side:
            side[w].append(lp)
    y, n = (logsumexp(v) if v else None for v in (side["yes"], side["no"]))
    if y is None and n is None:
        return None
    if y is not None and n is not None:
        return y - n
    p = min(max(math.exp(y if n is None else n), 0.500001), 0.999999)
    odds = math.log(p / (1 - p))
    return odds if n is None else -odds


def fetch(url: str, body: dict, timeout: float = 120, tries: int = 4, wait=time.sleep) -> dict:
    """POST of JSON. Server and transport errors are tried again with a growing pause of 30 s at most; 4xx is raised at once."""
    for i in range(tries):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code < 500 or i == tries - 1:
                raise
        except OSError:
            if i == tries - 1:
                raise
        wait(min(30.0, 2.0 * (i + 1)))
    raise AssertionError


@dataclass
class HttpJudge(Judge):
    """A model server with the chat completions interface, or with a native chat one (native=True)."""

    url: str
    model: str
    native: bool = False

    def _chat(self, prompt: str, **more) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False} | more
        return fetch(self.url + ("/api/chat" if self.native else "/v1/chat/completions"), body)

    def _said(self, prompt: str) -> str:
        r = self._chat(prompt)
        return r["message"]["content"] if self.native else r["choices"][0]["message"]["content"]

    def scores(self, texts, question):
        out = []
        for t in texts:
            r = self._chat(f"Text:\n{(t or '')[:ROW_SCORE]}\n\nQuestion: {question}\nReply with one word, Yes or No.", max_tokens=1, logprobs=True, top_logprobs=10)
            try:
                top = r["logprobs"][0]["top_logprobs"] if self.native else r["choices"][0]["logprobs"]["content"][0]["top_logprobs"]
                out.append(log_odds({x["token"]: x["logprob"] for x in top}))
            except (KeyError, IndexError, TypeError):
                d = parse_decision(json.dumps(r))
                out.append({YES: 2.0, NO: -2.0}.get(d))
        return out

    def answers(self, texts, question):
        out = []
        for t in texts:
            prompt = f"Decide from the text alone.\n\nText:\n{(t or '')[:ANSWER]}\n\nQuestion: {question}\nAnswer Yes or No."
            d = parse_decision(self._said(prompt)) or parse_decision(self._said(prompt + ' Reply only with {"decision": "Yes"} or {"decision": "No"}.'))
            out.append(d and d.capitalize())
        return out

    def decide(self, texts, question):
        rows = "\n\n".join(f"ROW_{i + 1}:\n{(t or '')[:BATCH]}" for i, t in enumerate(texts))
        return parse_batch(self._said(f"{rows}\n\nFor each row: {question}\nOne line a row: ROW_n: YES, NO or UNCERTAIN."), len(texts))

    def summaries(self, texts):
        return [re.sub(r"\s+", " ", self._said(f"Summarise in one sentence:\n{(t or '')[:SUMMARY]}")).strip() for t in texts]
