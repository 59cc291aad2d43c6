import math
import re
from collections import Counter

import pytest

from quillon.llm import license_texts as X
from quillon.llm import licenses as L

MIT, APACHE, GPL = "Released under the MIT License.", "// Licensed under the Apache License, Version 2.0 (the \"License\")", "This work is licensed under the GNU General Public License, version 3."
FILES = [
    ("a/b/one.py", f"print(1)\n{APACHE}\nmore words in here than there are in the line above it\n"),
    ("a/b/two.py", "no notice here"),
    ("a/b/c/d/three.py", "none"),
    ("a/LICENSE", MIT),
    ("a/b/c/LICENSE", f"{GPL}\n"),
    ("z/four.py", "nothing"),
    ("five.py", None),
    (None, "nothing"),
    (None, MIT),
    ("a/x/six.py", "My driving license was lost on a walk through the fields and hills of that large and old country"),
    ("a/x/six.py", ""),
    ("a/b/c/LICENSE2", f"{MIT}\n{MIT}"),
    ("a/x/seven.py", "All rights reserved.\nsome code"),
    ("a/x/eight.py", f"All rights reserved.\n{APACHE}\nsome code\n\n * \n and a block of its own"),
]


def brute(files):
    tok = lambda s: Counter(re.findall(r"[a-z0-9.]*[a-z0-9]", s.lower()))
    mark, n = re.compile(L.MARKS), len(X.TEMPLATES)
    clean = lambda s: re.sub(r"[\x00-\x20]+", " ", s).strip(" ")
    size = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    theirs = [tok(t) for _, t in X.TEMPLATES]
    df = Counter(w for v in theirs for w in v)
    weigh = lambda v: {x: c * (math.log((1 + n) / (1 + df[x])) + 1) for x, c in v.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values())) or 1.0
    model = [(weigh(v), norm(weigh(v))) for v in theirs]

    def best(text):
        w = weigh(tok(text))
        found = [(-round(sum(v * m.get(t, 0) for t, v in w.items()) / norm(w) / l, 6), X.TEMPLATES[k][0], k) for k, (m, l) in enumerate(model)]
        s, name, k = min(found)
        return (name, -s, sum(tok(text).values()), X.TEMPLATES[k] in X.TITLES) if -s >= L.COSINE else None

    own, speaks = [], {}
    for p, t in files:
        t = t or ""
        lines = [x for x in t.split("\n") if mark.search(x)]
        blocks = [(x, i == 0) for i, x in enumerate(re.split(r"\n(?:[^\W_]*(?!.*[^\W_])[^\n]*(?:\n|$))+", t.lstrip())) if mark.search(x)]
        units = [(0, False, t)] * bool(mark.search(t)) + [(1, f, x) for x, f in blocks] + [(2, False, x) for x in lines]
        met = [(k, f, x, b) for k, f, x in units if (b := best(clean(x)))]
        got = min(((k != 0, not f, -b[1] * math.log1p(b[2]), b[0], b[1]) for k, f, x, b in met), default=None)
        own.append((got, len(lines), bool(re.search(L.RESERVED, t))))
        said = max(sum(size(x) for k, _, x, _ in met if k == kind) for kind in (0, 1, 2))
        if got and p is not None and (re.search(L.FILE_NAME, p) or any(f and b[3] for _, f, _, b in met) or 100 * said >= 50 * size(t)):
            d = p.rpartition("/")[0]
            speaks[d] = min(speaks.get(d, got), got)
    out = []
    for (p, _), (got, n_lines, reserved) in zip(files, own):
        via = "notice" if got else "reserved" if reserved else None
        d = None if p is None or reserved else p.rpartition("/")[0]
        while not got and d is not None:
            got = speaks.get(d)
            via = "directory" if got else None
            d = d.rpartition("/")[0] if d else None
        out.append((got[3] if got else None, pytest.approx(got[4], abs=2e-6) if got else None, via, n_lines))
    return out


def found(spark, files):
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "doc_id long, path string, text string").selectExpr("*", "1 as lines", "2 as kind", "3 as own", "4 as said", "5 as unit")
    return [(r.license, r.score, r.via, r.n_notices) for r in sorted(L.scan(df, ["doc_id"]).collect(), key=lambda r: r.doc_id)]


def test_against_brute_force(spark):
    got = found(spark, FILES)
    assert got == brute(FILES)
    assert [got[i][0] for i in (0, 1, 2, 4, 5, 12, 13)] == ["Apache-2.0", "MIT", "GPL-3.0", "GPL-3.0", None, None, "Apache-2.0"]
    assert got[9][2] == "directory" and got[12][2] == "reserved"


HOLDER = "Copyright (c) 2024 Jane Q. Public and the Example Authors"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
REAL = {
    "MIT": ["MIT License\n\n" + HOLDER + "\n\n" + X._MIT + "\n\n" + X._AS_IS, "The MIT License (MIT)\n\n" + HOLDER + "\n\n" + X._MIT],
    "BSD-3-Clause": [f"BSD 3-Clause License\n\n{HOLDER}\nAll rights reserved.\n\n{BSD}", f"{HOLDER}\nAll rights reserved.\n\n{X._BSD}\n{X._BSD_THIRD}\n{X._BSD_END}"],
    "BSD-2-Clause": [f"BSD 2-Clause License\n\n{HOLDER}\nAll rights reserved.\n\n{X._BSD}\n{X._BSD_END}"],
    "Apache-2.0": ["                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"],
    "GPL-3.0": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"],
    "ISC": [f"ISC License\n\n{HOLDER}\n\n{X._ISC}\n\n{X._ISC_END}"],
    "Zlib": [HOLDER + "\n\n" + X._ZLIB],
    "Unlicense": [X._UNLICENSE],
}


def test_real_licence_files_and_their_siblings(spark):
    files, want = [], []
    for name, texts in REAL.items():
        for i, t in enumerate(texts):
            files += [(f"{name}/{i}/LICENSE.txt", t), (f"{name}/{i}/src/main.py", "x = 1\n"), (f"{name}b/{i}/TERMS", t), (f"{name}b/{i}/main.py", "x = 1\n")]
            want += [name] * 4
    got = found(spark, files)
    assert [(f[0], g[0]) for f, g in zip(files, got)] == [(f[0], w) for f, w in zip(files, want)]
    assert all(g[2] == ("directory" if f[0].endswith(".py") else "notice") for f, g in zip(files, got))


def test_headers_of_source_files(spark):
    comment = lambda t, c: "\n".join(f"{c} {x}".rstrip() for x in t.split("\n"))
    code = "\n\n" + "int main() { return 0; }\n" * 40
    files = [
        ("h/a.c", "/*\n" + comment(f"{HOLDER}\n\n{X._APACHE}", " *") + "\n */" + code),
        ("h/b.py", comment(X._ASF, "#") + code),
        ("h/c.py", comment(X._gnu("General Public License", "either version 3"), "#") + code),
        ("h/d.py", comment(X._gnu("Affero General Public License", "either version 3"), "#") + code),
        ("h/e.py", comment(X._gnu("Lesser General Public License", "either version 2.1"), "#") + code),
        ("h/f.rs", "// SPDX-License-Identifier: MIT" + code),
        ("h/g.js", comment(X._MPL, "//") + code),
        ("h/plain.py", code),
    ]
    got = found(spark, files)
    assert [g[0] for g in got] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "MIT", "MPL-2.0", None]


def test_empty_and_very_long(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, path string, text string"), ["doc_id"]).count() == 0
    got = found(spark, [("l/a", "word and more words\n" * 50_000 + MIT + "\n" + "yet more\n" * 50_000), ("l/b", "x")])
    assert got[0][0] == "MIT" and got[1][0] is None


def test_query(spark):
    d = "/root/testdata/sf0.001"
    src = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    want = brute([(f"{r.source}/{r.lang}/{r.doc_id}.txt", r.text) for r in src])
    got = {r.doc_id: (r.license, r.score, r.via, r.n_notices) for r in L.op7_license_scans(spark, d).collect()}
    assert got == {r.doc_id: w for r, w in zip(src, want)}
    assert sum(w[2] in ("notice", "reserved") for w in want) > 3
