"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes its words (A-Z lower-cased, runs of digits, a-z and characters
beyond ASCII), each with one space around it. Texts without any keyword stem end
there. In the others keywords are looked up first, then, for those that occur, the
longest plain text of each of their rules, and only what is found of these is matched; a detection
that lies inside another one's interval is suppressed, and of two with the same
interval the rule of smaller priority number stays.

Defined cases: a null or empty text has no words and no labels, its score is 0;
rows are scanned one by one, so that ties and repeated rows give equal results;
extra columns pass through unless named like a result, then they are replaced;
an empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm._store import fresh

#: Phrases whose every place counts, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: A text without any of these has no detection; each keyword of a rule contains one of them.
STEMS = ("licen", "right", "gpl", "fdl", "wtfpl", "commons", "cc", "public domain", "warrant", "redistribut", "permission", "spdx", "copyleft", "patent", "confidential", "proprietary", "unauthori", "merchantab")


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str
    score: float

    @property
    def hint(self) -> str:
        """The longest text that stands in every match."""
        return literal(self.pattern)


def literal(pattern: str) -> str:
    """The longest run of plain characters outside groups, classes and optional characters."""
    while True:
        flat = re.sub(r"\((?:\?:)?[^()]*\)[?*+]?", "\0", pattern)
        if flat == pattern:
            break
        pattern = flat
    runs = re.sub(r"\[[^\]]*\][?*+]?|.[?*+]|\\.", "\0", pattern).split("\0")
    return max(runs, key=len)


def _versions(*names: str) -> list[tuple[str, str]]:
    """Version labels and the words that a text has for them."""
    out = []
    for n in names:
        major, _, minor = n.partition(".")
        tail = f" {minor}" if minor not in ("", "0") else "(?: 0)?"
        out.append((n, f"v?(?:er(?:sion)? )?{major}{tail}"))
    return out


def rules() -> tuple[Rule, ...]:
    """The ordered rules, most particular first."""
    found: list[tuple[str, str, str, float]] = []
    add = lambda label, keyword, pattern, score: found.append((label, keyword, pattern, score))
    later = "(?: or(?: \\(?at your option\\)?)?(?: any)? later(?: version)?| or newer| only)?"

    gnu = {
        "gpl": ("(?:gnu )?general public licen[sc]e", "(?:gnu )?gpl", ("1.0", "2.0", "3.0")),
        "lgpl": ("(?:gnu )?(?:lesser|library) general public licen[sc]e", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
        "agpl": ("(?:gnu )?affero general public licen[sc]e", "(?:gnu )?agpl", ("1.0", "3.0")),
        "gfdl": ("(?:gnu )?free documentation licen[sc]e", "(?:gnu )?g?fdl", ("1.1", "1.2", "1.3")),
    }
    for name, (full, short, versions) in gnu.items():
        for v, said in _versions(*versions):
            add(f"{name}-{v}", "licen", f"{full} {said}{later}", 1.0)
            add(f"{name}-{v}", "licen", f"version {said} of the {full}{later}", 1.0)
            add(f"{name}-{v}", "licen", f"{full} as published by the free software foundation (?:either )?version {said}", 1.0)
            add(f"{name}-{v}", short[-3:], f"{short} {said}{later}", 0.9)
            add(f"{name}-{v}", f"{short[-3:]}", f"{short.replace('(?:gnu )?', '')}v{v.replace('.', ' ').removesuffix(' 0')}{later}", 0.9)
            add(f"{name}-{v}", "spdx", f"spdx license identifier {name} {v.replace('.', ' ')}(?: only| or later)?", 1.0)
        add(name, "licen", full, 0.9)
        add(name, "licen", f"licen[sc]ed under (?:the )?(?:terms of the )?{full}", 1.0)
        add(name, short[-3:], f"(?:under|with) (?:the )?{short}", 0.8)

    traits = {
        "by": "attribution",
        "by-sa": "attribution share ?alike",
        "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
        "by-nc": "attribution non ?commercial",
        "by-nc-sa": "attribution non ?commercial share ?alike",
        "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
    }
    for trait, words in traits.items():
        short = trait.replace("-", " ")
        for v, said in _versions("1.0", "2.0", "2.5", "3.0", "4.0"):
            where = "(?: international| unported| generic)?"
            add(f"cc-{trait}-{v}", "commons", f"creative commons {words}{where} (?:licen[sc]e )?{said}{where}(?: (?:public )?licen[sc]e)?", 1.0)
            add(f"cc-{trait}-{v}", "cc ", f"cc {short} {said}{where}", 1.0)
            add(f"cc-{trait}-{v}", "commons", f"creativecommons org licenses {short} {v.replace('.', ' ')}", 1.0)
        add(f"cc-{trait}", "commons", f"creative commons {words}(?: licen[sc]e)?", 0.9)
        add(f"cc-{trait}", "cc ", f"cc {short}", 0.8)
        add(f"cc-{trait}", "commons", f"creativecommons org licenses {short}", 0.9)
    add("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", 0.9)
    add("cc0-1.0", "commons", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", 1.0)
    add("cc", "commons", "creative commons(?: licen[sc]e)?", 0.6)

    named = {
        "apache": ("apache(?: software)? licen[sc]e", ("1.0", "1.1", "2.0")),
        "mpl": ("mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
        "epl": ("eclipse public licen[sc]e", ("1.0", "2.0")),
        "cddl": ("common development and distribution licen[sc]e", ("1.0", "1.1")),
        "eupl": ("european union public licen[sc]e", ("1.0", "1.1", "1.2")),
        "osl": ("open software licen[sc]e", ("1.0", "1.1", "2.0", "2.1", "3.0")),
        "afl": ("academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        "artistic": ("artistic licen[sc]e", ("1.0", "2.0")),
        "ofl": ("sil open font licen[sc]e", ("1.0", "1.1")),
        "bsl": ("boost software licen[sc]e", ("1.0",)),
        "php": ("php licen[sc]e", ("3.0", "3.1")),
        "zpl": ("zope public licen[sc]e", ("1.1", "2.0", "2.1")),
        "lppl": ("latex project public licen[sc]e", ("1.0", "1.2", "1.3")),
        "odbl": ("open (?:data commons open )?database licen[sc]e", ("1.0",)),
        "apsl": ("apple public source licen[sc]e", ("1.0", "1.1", "2.0")),
        "cpl": ("common public licen[sc]e", ("1.0",)),
        "ms-pl": ("microsoft public licen[sc]e", ("1.0",)),
        "psf": ("python software foundation licen[sc]e", ("2.0",)),
        "upl": ("universal permissive licen[sc]e", ("1.0",)),
        "ecl": ("educational community licen[sc]e", ("1.0", "2.0")),
        "cecill": ("cecill (?:free software )?licen[sc]e", ("1.0", "2.0", "2.1")),
        "ipl": ("ibm public licen[sc]e", ("1.0",)),
        "ncsa": ("university of illinois ncsa open source licen[sc]e", ()),
        "qpl": ("q public licen[sc]e", ("1.0",)),
        "rpl": ("reciprocal public licen[sc]e", ("1.1", "1.5")),
        "spl": ("sun public licen[sc]e", ("1.0",)),
        "sspl": ("server side public licen[sc]e", ("1.0",)),
        "busl": ("business source licen[sc]e", ("1.1",)),
        "elastic": ("elastic licen[sc]e", ("2.0",)),
        "ms-rl": ("microsoft reciprocal licen[sc]e", ("1.0",)),
        "mulan-psl": ("mulan permissive software licen[sc]e", ("1.0", "2.0")),
        "nposl": ("non profit open software licen[sc]e", ("3.0",)),
        "nposl-nasa": ("nasa open source agreement licen[sc]e", ("1.3",)),
        "odc-by": ("open data commons attribution licen[sc]e", ("1.0",)),
        "pddl": ("open data commons public domain dedication and licen[sc]e", ("1.0",)),
        "cdla-permissive": ("community data licen[sc]e agreement permissive", ("1.0", "2.0")),
        "cdla-sharing": ("community data licen[sc]e agreement sharing", ("1.0",)),
        "postgresql": ("postgresql licen[sc]e", ()),
        "openssl": ("openssl licen[sc]e", ()),
        "sleepycat": ("sleepycat licen[sc]e", ()),
        "ruby": ("ruby licen[sc]e", ()),
        "vim": ("vim licen[sc]e", ()),
        "x11": ("x11 licen[sc]e", ()),
        "w3c": ("w3c software(?: notice and)? licen[sc]e", ()),
        "freetype": ("freetype(?: project)? licen[sc]e", ()),
        "unicode": ("unicode(?: data files and software)? licen[sc]e", ("3.0",)),
        "openldap": ("openldap public licen[sc]e", ("2.7", "2.8")),
        "hpnd": ("historical permission notice and disclaimer licen[sc]e", ()),
        "opl": ("open publication licen[sc]e", ("1.0",)),
        "free-art": ("free art licen[sc]e", ("1.2", "1.3")),
        "json": ("json licen[sc]e", ()),
        "blue-oak": ("blue oak model licen[sc]e", ("1.0",)),
        "polyform-nc": ("polyform noncommercial licen[sc]e", ("1.0",)),
        "openrail": ("(?:big ?science |creative ml )?open ?rail(?: m)? licen[sc]e", ()),
        "llama": ("llama [23] community licen[sc]e(?: agreement)?", ()),
        "gemma": ("gemma terms of use and licen[sc]e", ()),
    }
    for name, (full, versions) in named.items():
        for v, said in _versions(*versions):
            add(f"{name}-{v}", "licen", f"{full} {said}{later}", 1.0)
            add(f"{name}-{v}", "licen", f"licen[sc]ed under (?:the )?(?:terms of the )?{full} {said}{later}", 1.0)
            add(f"{name}-{v}", "spdx", f"spdx license identifier {name} {v.replace('.', ' ')}", 1.0)
        add(name, "licen", full, 0.8)

    for n, word in (("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{n}-clause", "licen", f"(?:{n}|{word}) clause bsd licen[sc]e", 1.0)
        add(f"bsd-{n}-clause", "licen", f"bsd (?:{n}|{word}) clause (?:licen[sc]e)", 1.0)
        add(f"bsd-{n}-clause", "spdx", f"spdx license identifier bsd {n} clause", 1.0)
    for label, keyword, pattern, score in (
        ("bsd", "licen", "(?:new |modified |simplified |revised )?bsd(?: style)? licen[sc]e", 0.9),
        ("bsd", "redistribut", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
        ("bsd-3-clause", "permission", "without specific prior written permission", 0.7),
        ("mit", "licen", "(?:the )?mit(?: style)? licen[sc]e", 1.0),
        ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
        ("mit", "spdx", "spdx license identifier mit", 1.0),
        ("isc", "licen", "(?:the )?isc licen[sc]e", 1.0),
        ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 1.0),
        ("zlib", "licen", "zlib(?: libpng)? licen[sc]e", 1.0),
        ("unlicense", "licen", "(?:the )?unlicense", 0.8),
        ("wtfpl", "licen", "do what the fuck you want to public licen[sc]e", 1.0),
        ("wtfpl", "wtfpl", "wtfpl(?: licen[sc]e)?", 0.8),
        ("beerware", "licen", "beer ?ware licen[sc]e", 0.9),
        ("public-domain", "public domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 0.9),
        ("public-domain", "public domain", "public domain(?: work| dedication)?", 0.5),
        ("ogl-uk", "licen", "open government licen[sc]e(?: v?(?:ersion )?[123](?: 0)?)?", 1.0),
        ("proprietary", "proprietary", "proprietary and confidential", 0.8),
        ("proprietary", "confidential", "confidential and proprietary", 0.8),
        ("proprietary", "licen", "commercial licen[sc]e", 0.5),
        ("proprietary", "permission", "may not be (?:reproduced|copied|redistributed|distributed) without (?:the )?(?:prior )?(?:written |express )?permission", 0.8),
        ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|redistribution)", 0.7),
        ("reserved", "rights", "all rights (?:are )?reserved", 0.8),
        ("reserved", "rights", "some rights reserved", 0.6),
        ("copyright", "copyright", "copyright (?:c )?(?:©? ?)?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 0.7),
        ("copyright", "copyright", "copyright (?:©|c|by)", 0.5),
        ("no-warranty", "warrant", "without (?:any )?warrant(?:y|ies) of any kind", 0.6),
        ("no-warranty", "warrant", "provided as is without warrant(?:y|ies)", 0.6),
        ("no-warranty", "merchantab", "merchantability (?:or|and) fitness for a particular purpose", 0.6),
        ("patent", "patent", "patent (?:licen[sc]e|grant)", 0.5),
        ("json", "licen", "this licen[sc]e shall be used for good not evil", 0.4),
        ("gpl", "licen", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 1.0),
        ("gpl", "licen", "you should have received a copy of the gnu general public licen[sc]e", 1.0),
        ("lgpl", "licen", "you should have received a copy of the gnu lesser general public licen[sc]e", 1.0),
        ("agpl", "licen", "you should have received a copy of the gnu affero general public licen[sc]e", 1.0),
        ("gfdl", "permission", "permission is granted to copy distribute and or modify this document", 1.0),
        ("apache-2.0", "licen", "you may not use this file except in compliance with the licen[sc]e", 1.0),
        ("apache-2.0", "licen", "distributed under the licen[sc]e is distributed on an as is basis", 0.9),
        ("mpl-2.0", "licen", "this source code form is subject to the terms of the mozilla public licen[sc]e", 1.0),
        ("epl", "licen", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 1.0),
        ("bsl", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy", 1.0),
        ("zlib", "permission", "permission is granted to anyone to use this software for any purpose", 0.9),
        ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 1.0),
        ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose", 0.9),
        ("proprietary", "proprietary", "proprietary(?: software)? licen[sc]e", 0.7),
        ("proprietary", "licen", "end user licen[sc]e agreement", 0.7),
        ("proprietary", "confidential", "strictly confidential", 0.4),
        ("non-commercial", "licen", "non ?commercial(?: use)? licen[sc]e", 0.6),
        ("non-commercial", "permission", "non ?commercial use only (?:with|by) permission", 0.6),
        ("research-only", "licen", "research(?: use)? only licen[sc]e", 0.6),
        ("dual", "licen", "dual licen[sc]ed", 0.5),
        ("royalty-free", "licen", "royalty free(?: non exclusive| perpetual| worldwide)? licen[sc]e", 0.5),
        ("patent", "patent", "patent pending", 0.3),
        ("crown", "copyright", "crown copyright(?: (?:19|20)[0-9][0-9])?", 0.8),
        ("reserved", "rights", "(?:all )?rights (?:not expressly granted )?(?:herein )?are reserved", 0.7),
        ("no-liability", "licen", "in no event shall the licen[sc]ors? be liable", 0.5),
        ("copyleft", "copyleft", "(?:strong |weak )?copyleft(?: licen[sc]e)?", 0.5),
        ("permissive", "licen", "permissive(?: open source)? licen[sc]e", 0.4),
        ("open-source", "licen", "open source licen[sc]e", 0.4),
        ("licensed", "licen", "(?:is|are) licen[sc]ed under", 0.3),
    ):
        add(label, keyword, pattern, score)
    return tuple(Rule(i, *x) for i, x in enumerate(found))


def _spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def canonical(text: Column) -> Column:
    """The words with one space around each; a single space if there are none.

    ``lower`` takes a quarter of the time of ``translate``. It also changes letters beyond ASCII: these stay
    parts of words, and none of them becomes a letter of a phrase but for the Kelvin sign, a k, which no phrase has.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spans(canon: Column, rule: Column) -> Column:
    """All detections of one rule: start, negative end, priority (in sorting order), score, label."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,priority:int,score:double,label:string>>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        stop = start + F.length(part["hit"])
        one = F.struct(start.alias("start"), (-stop).alias("stop"), rule["priority"].alias("priority"), rule["score"].alias("score"), rule["label"].alias("label"))
        return F.struct(stop.alias("at"), F.array_append(acc["found"], one).alias("found"))

    hits, gaps = F.regexp_extract_all(canon, pattern, F.lit(0)), F.split(canon, pattern)
    parts = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(parts, state, step)["found"]


RULE_TABLE = "array<struct<keyword:string,hints:array<struct<hint:string,rules:array<struct<priority:int,label:string,pattern:string,score:double>>>>>>"


def detections(canon: Column, ordered: tuple[Rule, ...]) -> Column:
    """Detections that no other one suppresses, by start."""
    by: dict[str, dict[str, list[Rule]]] = {}
    for r in ordered:
        by.setdefault(r.keyword, {}).setdefault(r.hint, []).append(r)
    each = lambda r: {"priority": r.priority, "label": r.label, "pattern": r.pattern, "score": r.score}
    nested = [{"keyword": k, "hints": [{"hint": h, "rules": [each(r) for r in rs]} for h, rs in hints.items()]} for k, hints in by.items()]
    # one literal, which the optimizer turns into a table before the query runs
    table = F.from_json(F.lit(json.dumps(nested)), RULE_TABLE)
    hints = F.flatten(F.transform(F.filter(table, lambda k: F.contains(canon, k["keyword"])), lambda k: k["hints"]))
    tried = F.flatten(F.transform(F.filter(hints, lambda h: F.contains(canon, h["hint"])), lambda h: h["rules"]))
    found = F.sort_array(F.flatten(F.transform(tried, lambda r: _spans(canon, r))))
    empty = F.array().cast("array<struct<start:int,stop:int,priority:int,score:double,label:string>>")
    # in order of start, longest first: a detection lies inside an earlier one exactly if it ends no later than the furthest end so far
    kept = F.aggregate(
        found,
        F.struct(F.lit(0).alias("far"), empty.alias("kept")),
        lambda acc, d: F.when(-d["stop"] <= acc["far"], acc).otherwise(F.struct((-d["stop"]).alias("far"), F.array_append(acc["kept"], d).alias("kept"))),
    )["kept"]
    return kept


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def scan(docs: DataFrame, text: str = "text", ordered: tuple[Rule, ...] | None = None) -> DataFrame:
    """All columns of ``docs`` and: n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections`` has start and stop (code points in the canonical text), priority, score and label.
    """
    ordered = rules() if ordered is None else ordered
    name, labels, *names = fresh(docs, "__canon", "__labels", *[f"__base{i}" for i in range(len(BASE))])
    canon, gate = F.col(name), F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains(canon, F.lit(stem))
    none = F.array().cast("array<struct<start:int,stop:int,priority:int,score:double,label:string>>")
    places = [F.when(F.contains(canon, F.lit(f" {p} ")), F.split(canon, f"(?<= ){p}(?= )")).otherwise(F.array(canon)) for p, _ in BASE]
    out = docs.drop(*[r for r in RESULTS if r != text]).withColumn(name, canonical(F.col(text))).withColumns(dict(zip(names, places, strict=True)))
    n_words = F.greatest(_spaces(canon) - 1, F.lit(0)).cast("long")
    hit = [F.size(n) > 1 for n in names]
    first = [F.when(h, _spaces(F.col(n)[0]) - 1) for h, n in zip(hit, names, strict=True)]
    last = [F.when(h, F.col("n_words") - (_spaces(F.element_at(n, -1)) - 1) - len(p.split())) for h, n, (p, _) in zip(hit, names, BASE, strict=True)]
    return (
        out.withColumn("n_words", n_words)
        .withColumn("detections", F.when(gate, detections(canon, ordered)).otherwise(none))
        .withColumn("n_base", sum((F.size(n) - 1 for n in names), F.lit(0)).cast("long"))
        .withColumn("first_word", F.least(*first).cast("long"))
        .withColumn("last_word", F.greatest(*last).cast("long"))
        .withColumn(labels, F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(hit, BASE, strict=True)])))
        .withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct(F.col(labels))), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(F.col(labels), F.col("detections.label")))), ","))
        .withColumn("score", F.coalesce(F.when(F.size(F.col(labels)) > 0, F.lit(1.0)), F.array_max(F.col("detections.score")), F.lit(0.0)))
        .withColumn("detections", F.transform("detections", lambda d: d.withField("stop", -d["stop"])))
        .drop(name, labels, *names)
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and places of license phrases in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


def _doubled(text: str) -> str:
    """A pattern for texts whose spaces are doubled, so that two matches can stand side by side without lookaround."""
    return text.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")


def oracle() -> str:
    """The scan in SQL: rules as a table, places from the texts between matches."""
    table = ", ".join(f"({r.priority}, '{r.label}', '{r.keyword}', '{r.hint}', ' (?:{_doubled(r.pattern)}) ', CAST({r.score} AS DOUBLE))" for r in rules())
    stems = " OR ".join(f"contains(c, '{s}')" for s in STEMS)
    found = " UNION ALL ".join(
        f"SELECT r, i - 1 AS i, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in BASE
    )
    return rf"""
        WITH a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS c FROM a),
        rules(priority, label, keyword, hint, pattern, score) AS (VALUES {table}),
        tried AS (SELECT r, replace(c, ' ', '  ') AS t, rules.* FROM (SELECT * FROM c WHERE {stems}) c JOIN rules ON contains(c, keyword) AND contains(c, hint)),
        hits AS (SELECT r, priority, label, score, regexp_extract_all(t, pattern) AS h, string_split_regex(t, pattern) AS g FROM tried),
        each AS (SELECT r, priority, label, score, h, g, unnest(range(1, len(h) + 1)) AS k FROM hits WHERE len(h) > 0),
        spans AS (SELECT r, priority, label, score, list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(h[1:k], lambda x: length(x))) AS stop, length(h[k]) AS n FROM each),
        kept AS (
            SELECT r, label, score FROM (SELECT *, max(stop) OVER (PARTITION BY r ORDER BY stop - n, stop DESC, priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans)
            WHERE far IS NULL OR stop > far
        ), d AS (SELECT r, count(*) AS n, max(score) AS score, list(DISTINCT label) AS labels FROM kept GROUP BY r),
        p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM a),
        b AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM ({found}) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(d.labels, [])))), ',') AS labels,
            CASE WHEN b.n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(d.score, CAST(0 AS DOUBLE)) END AS score, coalesce(d.n, 0) AS n_detections
        FROM a LEFT JOIN b ON b.r = a.r LEFT JOIN d ON d.r = a.r
    """


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {"op4_license_scan": oracle()}
