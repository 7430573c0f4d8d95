import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strataline.llm import graph, neardup
from tests.llm.helpers import DOC_SCHEMA, WORD, awkward_texts, docs_frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """doc_id: (set size, component), by comparing all pairs of sets that share a shingle."""
    sets = {i: shingles(x) for i, x in rows}
    where, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
        for j, c in common.items():
            if j > i and 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in neardup.apply(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_awkward(spark):
    docs = docs_frame(spark, awkward_texts() * 2).withColumn("key", F.lit(1)).withColumn("label", F.lit("x"))
    check(docs)
    assert neardup.groups(docs.limit(0)).count() == 0
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.component_id for r in neardup.groups(none).collect()} == {None} and neardup.apply(none).count() == docs.count()
    twice = docs.unionByName(docs)
    assert neardup.groups(twice).count() == 2 * docs.count()


def test_chains_and_lookalikes(spark, monkeypatch):
    """Chains of near copies, and many texts that share a passage without being near copies."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng, texts = random.Random(3), []
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    for _ in range(25):
        base = list(base)
        base[rng.randrange(120)] = word()
        texts.append(" ".join(base))
    passage = [word() for _ in range(60)]
    for _ in range(60):
        texts.append(" ".join(passage + [word() for _ in range(22)]))
    for n in range(1, 40):
        texts.append(" ".join(base[:n]))
    rng.shuffle(texts)
    check(docs_frame(spark, texts, 100))


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.80, alone and among lookalikes: every one is found."""
    rng, texts, pairs = random.Random(8), [], 0
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    passage = [word() for _ in range(150)]
    for i in range(400):
        # runs of k words changed at the end: k shingles differ on each side
        n = rng.randrange(120, 300)
        body = (passage if i % 4 == 0 else [word() for _ in range(150)]) + [word() for _ in range(n - 150 if n > 150 else 0)]
        size = len(body) - 4
        k = int(size * 0.25 / 1.75)
        other = body[:-k] + [word() for _ in range(k)]
        a, b = shingles(" ".join(body)), shingles(" ".join(other))
        if 0.75 <= len(a & b) / len(a | b) <= 0.80:
            texts += [" ".join(body), " ".join(other)]
            pairs += 1
    assert pairs > 300
    check(docs_frame(spark, texts, 1))


def test_helper_names_in_the_table(spark):
    docs = docs_frame(spark, ["a b c d e f g h", "a b c d e f g h", "x"]).withColumns({n: F.concat(F.lit(n), "doc_id") for n in ("__id", "__gone", "label", "rep")})
    rows = neardup.apply(docs).collect()
    assert {r.doc_id for r in rows} == {0, 2} and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in ("__id", "__gone", "label", "rep"))


def test_signature_is_the_sequential_one():
    """The vectorised signature equals the algorithm run element by element with its histogram of steps."""
    rng = np.random.default_rng(5)
    from strataline.llm import _text as t

    m, step = 16, t.constants(16, 31)
    for n in (1, 2, 7, 40, 400):
        sets = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        h = [neardup.EMPTY] * m
        for e in sets:
            p = list(range(m))
            for j in range(m):
                if max(int(v) >> 32 for v in h) < j:
                    break
                x = int(t.mix(np.array([e + step[j]]))[0])
                k = j + (((x & 0xFFFFFFFF) * (m - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(int(h[p[j]]), (j << 32) | (x >> 32))
        assert neardup.signatures(sets, np.array([0, n]), m)[0].tolist() == [int(v) for v in h]


def test_signature_estimates_similarity():
    rng, off = np.random.default_rng(6), []
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, 250).astype(np.uint64)
        a, b = np.sort(pool[:200]), np.sort(pool[50:])
        sig = neardup.signatures(np.concatenate((a, b)), np.array([0, 200, 400]))
        off.append((sig[0] == sig[1]).mean() - 150 / 250)
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.05


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 1999)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.node: r.label for r in graph.components(df).collect()} == {x: find(x) for x in root}
    assert graph.components(df.limit(0)).count() == 0
    assert DOC_SCHEMA
