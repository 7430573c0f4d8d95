import re

from pyspark.sql import functions as F

from strataline.llm import licenses
from tests.llm.helpers import awkward_texts, docs_frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    canon = " " + "".join(w + " " for w in words)
    spans = []
    for r in licenses.rules():
        if r.keyword in canon:
            spans += [(m.start(), -m.end(), r.priority, r.score, r.label) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", canon)]
    kept = [s for s in spans if not any(o != s and (o[0] <= s[0] and o[1] <= s[1]) and ((o[0], o[1]) != (s[0], s[1]) or o[2] < s[2]) for o in spans)]
    base = ",".join(sorted(labels))
    score = 1.0 if labels else max([s[3] for s in kept], default=0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels | {s[4] for s in kept})), score, len(kept))


def check(docs):
    rows = licenses.scan(docs).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, len(r.detections)) == plain(r.text), r.text[:200]


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_awkward(spark):
    more = [
        "cc by cc by cc-by-sa 4.0 GNU General Public License, version 3. gnu general public license version 3",
        "This is (CC) BY. Copyright (c) 2020 x. All rights reserved. Licensed under the Apache License, Version 2.0",
        "mit license " * 30, "permission is hereby granted, free of charge, to any person obtaining a copy", "BSD 3-clause licence? three clause bsd license",
        "SPDX-License-Identifier: GPL-2.0 or later; creativecommons.org/licenses/by-nc-sa/4.0/", "general public license general public license",
    ]
    docs = docs_frame(spark, awkward_texts() + more)
    check(docs)
    out = licenses.scan(docs.withColumn("labels", F.lit(1)).withColumn("extra", F.lit(2)))
    names = ("__canon", "__labels", "__base0")
    kept = licenses.scan(docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})).collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names)
    assert "extra" in out.columns and dict(out.dtypes)["labels"] == "string"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_hundreds_of_rules():
    rules = licenses.rules()
    assert len(rules) > 300
    for r in rules:
        re.compile(r.pattern)
        assert any(s in r.keyword or r.keyword in s for s in licenses.STEMS), r


def _matches(parsed):
    """Texts that a pattern matches, with every choice of its branches and optional parts; of larger character sets one."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in arg]
        elif op == "BRANCH":
            more = [x for branch in arg[1] for x in _matches(branch)]
        elif op == "SUBPATTERN":
            more = _matches(arg[3])
        else:
            assert op == "MAX_REPEAT" and arg[1] == 1, (op, arg)
            more = ["", *_matches(arg[2])]
        out = [a + b for a in out for b in more]
    return out


def test_keyword_stem_and_hint_are_in_all_that_a_rule_matches(spark):
    for r in licenses.rules():
        texts = _matches(re._parser.parse(r.pattern))
        assert texts
        for x in texts:
            canon = f" {x} "
            assert r.keyword in canon and r.hint in canon and any(s in canon for s in licenses.STEMS), (r, x)
    row = licenses.scan(docs_frame(spark, ["This tool is released under the WTFPL."])).first()
    assert row.labels == "wtfpl" and row.score == 0.8 and len(row.detections) == 1
