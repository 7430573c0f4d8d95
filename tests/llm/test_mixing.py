from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline.llm import mixing
from tests.llm.helpers import WORD, awkward_texts, docs_frame


def plain_targets(sizes):
    """Share by weight, cap, share the excess again, until no target is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target | {s: 2.0 * sizes[s] for s in capped}
        capped |= set(over)


def check(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    size = {k: len(WORD.findall(r.text or "")) for k, r in rows.items()}
    per = Counter()
    for k, r in rows.items():
        per[r.source] += size[k]
    want, taken = plain_targets(per), defaultdict(int)
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        s = rows[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == per[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    longest = Counter()
    for k, r in rows.items():
        longest[r.source] = max(longest[r.source], size[k])
    for s in per:  # a source whose documents are few and long can't come nearer
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * per[s], longest[s]), (s, taken[s], want[s])
    assert {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()} == {r.doc_id: r.taken for r in got}
    return got


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(spark, docs)
    copies = Counter(r.doc_id for r in mixing.apply(docs.withColumn("key", F.lit(1))).collect())
    assert copies == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_plan_by_shuffle(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(mixing, "GROUP", 3)
    check(spark, docs)
    monkeypatch.setattr(mixing, "GROUP", 512)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


def test_hot_length(spark):
    rows = [(i, "a b c d e f g", "en", "big", 1) for i in range(3000)] + [(5000 + i, "a b " * i, "en", f"s{i % 4}", 1) for i in range(40)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_awkward(spark):
    docs = docs_frame(spark, awkward_texts() * 4)
    check(spark, docs)
    same = docs.limit(4).unionByName(docs.limit(4)).withColumn("n", F.lit(1))
    assert mixing.mix(same).count() == 8
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).count() == 0
    clash = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in ("__id", "__COPIES", "__copy", "__match", "hash")})
    kept = mixing.apply(clash).collect()
    assert kept and all(r[n] == f"{n}{r.doc_id}" for r in kept for n in ("__id", "__COPIES", "__copy", "__match", "hash"))
    assert mixing.apply(docs.withColumn("doc_id", F.lit(None).cast("long"))).columns == docs.columns


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.floats(0, 1), st.sampled_from([5, 40, 1 << 16]))
def test_fit_is_exact_where_possible(cells, part, table):
    lengths, counts = np.array(list(cells)), np.array(list(cells.values()))
    budget = int(part * (lengths @ counts))
    old, mixing.TABLE = mixing.TABLE, table
    try:
        take = mixing.fit(lengths, counts, budget)
    finally:
        mixing.TABLE = old
    assert (0 <= take).all() and (take <= counts).all() and take @ lengths <= budget
    share = np.array([n * budget // int(lengths @ counts) for n in counts.tolist()])
    if table == 1 << 16:  # the rest after the shares is closed as far as any choice can
        sums = {0}
        for size, n in zip(lengths.tolist(), (counts - share).tolist()):
            sums = {s + size * i for s in sums for i in range(n + 1)}
        assert take @ lengths == share @ lengths + max(s for s in sums if s <= budget - share @ lengths)
