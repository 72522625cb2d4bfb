import itertools
import random
import re
import time
from re import _parser

from gleanery.llm.license_rules import BASE, MOST_WORDS, rules
from gleanery.llm.licenses import Scanner, license_scan, suppress


def plain_suppress(found):
    """Each detection against all of higher rank."""
    rank = lambda x: (-x[2], x[0] - x[1], x[0], x[5])
    return sorted(x for x in found if not any(rank(y) < rank(x) and y[0] <= x[0] and x[1] <= y[1] for y in found))


def brute(text):
    raw = (text or "").encode().lower()
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)]
    places, base = set(), set()
    n = 0
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                n += 1
                places.add(i)
                base.add(label)
    whole, found = " ".join(words), []
    for k, r in enumerate(rules()):
        if set(r.keyword.split("|")) & set(words):
            for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", whole):
                named = m.groupdict().get("at")
                start, text = (m.start("at"), named) if named else (m.start(), m[0])
                first = whole.count(" ", 0, start)
                version = None if named else next((g for g in m.groups() if g), None)
                found.append((first, first + text.count(" "), r.priority, f"{r.label}-{version.replace(' ', '.')}" if version else r.label, r.score, k))
    labels = base | {x[3] for x in plain_suppress(set(found))}
    return len(words), n, min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def make():
    r = random.Random(9)
    lines = [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
        "Released under the MIT License.", "All rights reserved.", "ALL RIGHTS\nRESERVED", "cc by", "CC-BY", "accby", "cc\u00e9 by", "Creative Commons Attribution-ShareAlike 4.0",
        "SPDX-License-Identifier: MIT", "all rights are reserved", "Copyright (c) 2019 2020 someone", "general public license", "the 3-clause BSD license", "mozilla public license 2.0 mozilla public license",
    ]
    words = ["the", "of", "license", "Été", "x1", "cc", "by", "all", "rights", "-", "#"]
    out = []
    for i in range(150):
        t = [r.choice(words) for _ in range(r.choice([0, 3, 30, 200]))]
        for _ in range(r.choice([0, 1, 2, 4])):
            t.insert(r.randint(0, len(t)), r.choice(lines))
        out.append((i, " ".join(t)))
    return [*out, (900, None), (901, ""), (902, "..."), (903, "word " * 50000 + lines[0]), (None, lines[1]), (4, "cc by"), (4, "cc by")]


def test_like_brute_force(spark):
    data = make()
    got = license_scan(spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, labels int")).collect()
    want = sorted(((d, *brute(t)) for d, t in data), key=repr)
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_known_lines(spark):
    texts = {"Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3", "All rights reserved.": "reserved", "nothing here": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {list(texts)[r["doc_id"]]: r["labels"] for r in license_scan(df).collect()} == texts
    assert license_scan(df.limit(0)).count() == 0


def test_rules():
    assert len(rules()) >= 200
    for r in rules():
        assert 0 < r.score <= 1 and re.compile(r.pattern)
        assert len(r.pattern.split(" ")) < MOST_WORDS


def test_suppression_keeps_what_is_not_inside():
    a, b, c, d = (0, 5, 90, "a", 1.0, 0), (2, 5, 95, "b", 1.0, 1), (1, 4, 40, "c", 0.5, 2), (4, 7, 40, "d", 0.5, 3)
    assert suppress([a, b, c, d]) == [a, b, d]


def test_suppression_of_many(spark):
    r = random.Random(3)
    some = [(a, a + r.randint(0, 9), r.choice([20, 40, 90]), "x", 0.5, i) for i in range(400) for a in [r.randint(0, 300)]]
    assert suppress(some) == plain_suppress(some)
    many = [(a, a + r.randint(0, 30), r.choice([20, 40, 90]), "x", 0.5, i) for i in range(100_000) for a in [r.randint(0, 10**6)]]
    start = time.monotonic()
    assert 0 < len(suppress(many)) < len(many)
    assert time.monotonic() - start < 20
    got = license_scan(spark.createDataFrame([(1, "MIT license, " * 20_000)], "doc_id long, text string")).first()
    assert got["labels"] == "mit" and len(got["spans"]) == 20_000


#: Texts by hand, with the labels that they are to get.
KNOWN = {
    "SPDX-License-Identifier: MIT": "mit,spdx", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": "apache-2.0,bsd-3-clause,mit,spdx", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later,spdx",
    "SPDX-License-Identifier: ISC": "isc,spdx", "spdx licence identifier none of ours": "spdx", "License: Apache-2.0": "apache-2.0", "licensed GPL-3.0-only": "gpl-3.0-only", "BSD-3-Clause": "bsd-3-clause",
    "GNU GPL v3": "gpl-3", "GPLv2+": "gpl-2", "GPL v2": "gpl-2", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "gnu agpl": "agpl", "apache 2": "apache-2", "ASL 2.0": "apache-2.0", "MPL 2.0": "mpl-2.0", "EPL v1.0": "epl-1.0",
    "new code under a BSD-style license": "bsd", "the 3-clause BSD": "bsd-3-clause", "MIT/X11": "mit", "an MIT-style licence": "mit", "MIT licensed": "mit", "Expat License": "mit", "MIT-0": "mit-0", "Apache-licensed": "apache",
    "CC0-1.0": "cc0-1.0", "https://creativecommons.org/licenses/by-nc/4.0/": "cc-by-nc-4.0", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0", "https://mozilla.org/MPL/2.0/": "mpl-2.0", "CC zero": "cc0",
    "you should have received a copy of the GNU General Public License along with it": "gpl", "distribute and/or modify it": "", "as published by the Free Software Foundation; either version 3 of the License, or": "gpl-3",
    "Redistributions of source code must retain the above copyright notice, this list": "bsd", "The origin of this software must not be misrepresented": "zlib", "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "To the extent possible under law, Jane Doe has waived all copyright": "cc0", "This is free and unencumbered software released into the public domain.": "unlicense", "The Software shall be used for Good, not Evil.": "json",
    "Proprietary and confidential": "proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary", "for non-commercial use only": "noncommercial", "Beerware license": "", "beer-ware license": "beerware",
    "er ging mit dem Hund": "", "the json file or the x11 server, and ruby or vim": "", "zip of the isc mit ruby": "", "apache helicopters": "", "gpl": "", "bsd": "", "licensed under the GPL": "gpl",
}


def test_known_texts(spark):
    df = spark.createDataFrame(list(enumerate(KNOWN)), "doc_id long, text string")
    got = {list(KNOWN)[r["doc_id"]]: r["labels"] for r in license_scan(df).collect()}
    assert {t: x for t, x in got.items() if x != KNOWN[t]} == {}


def examples(parsed):
    """Texts of a pattern that take every branch and every optional part."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append(["1"] if str(arg[0][0]) in ("CATEGORY", "RANGE") else [chr(x) for _, x in arg])
        elif name == "BRANCH":
            parts.append([x for branch in arg[1] for x in examples(branch)])
        elif name == "SUBPATTERN":
            parts.append(examples(arg[-1]))
        elif name == "MAX_REPEAT":
            low, _, inside = arg
            parts.append([x * n for n in (low, low + 1) for x in examples(inside)] if low < 2 else [x * low for x in examples(inside)])
        else:
            assert name == "ASSERT_NOT"
    return sorted({"".join(x) for x in itertools.product(*parts)})


def test_each_rule_finds_its_examples():
    n = 0
    for rule in rules():
        scanner = Scanner((rule,))
        # Of the many ways to say a phrase, each branch is in some of these.
        texts = examples(_parser.parse(rule.pattern))
        for text in texts[:: max(1, len(texts) // 60)]:
            words = text.split(" ")
            hits = [(i, w) for i, w in enumerate(words) if w in rule.keyword.split("|")]
            assert any(label.startswith(rule.label) for _, _, _, label, _, _ in scanner.detect(words, hits)), (rule, text)
            n += 1
    assert n > 1000


def test_lines_that_hold_no_other_keyword(spark):
    texts = {"copyright 2020": "copyright", "Copyright (c) 2019 2020 someone": "copyright", "copyright 2020 x": "copyright", "copyright " + "2001 " * 60: "copyright", "open software license 3.0": "osl-3.0", "Open Database License": "odbl", "open data commons attribution license": "odc-by", "public domain dedication and license": "pddl", "GNU Library General Public License": "gpl,lgpl"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r["doc_id"]]: r for r in license_scan(df).collect()}
    assert {t: r["labels"] for t, r in got.items()} == texts
    assert got["copyright " + "2001 " * 60]["spans"][0]["last"] == 60
