import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataline.llm import topk


def plain(rows, k=20, every=20):
    rows = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in rows:
        if i % every == 0:
            got = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(got)}
    return out


def frame(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return topk.op2_top_k(spark, str(tmp_path))


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in topk.op2_top_k(spark, sf).collect()} == plain(rows)


def test_ties_and_bad_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(150)] + [(i, [0.5, 0.5, 0.0, 0.0]) for i in range(150, 260)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0]), (340, [float("nan")] * 4), (360, [float("inf"), 0.0, 0.0, 0.0]), (380, [1.0, 2.0]), (381, [3.0, 1.0]), (400, []), (420, [3e7, -3e7, 1.0, 1.0])]
    assert {tuple(r) for r in frame(spark, rows, tmp_path).collect()} == plain(rows)


def test_clustered_is_pruned_and_exact(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-500, 500, (8, 16))
    c = np.concatenate([m + rng.integers(-3, 4, (200, 16)) for m in centres])
    ids = np.arange(len(c))
    at = centres.astype(float)
    i, j, s = topk.search_block(ids[::50], c[::50], topk._table(c[::50], at), ids, c, topk._table(c, at), 20)
    want = c[::50] @ c.T
    for n, q in enumerate(ids[::50]):
        order = sorted((-want[n, x], x) for x in ids if x != q)[:20]
        assert [(-s[x], j[x]) for x in np.flatnonzero(i == n)] == order


def test_clustered_search_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, [float(x) for x in np.round(centres[i % 12] + rng.normal(size=8) / 20, 3)]) for i in range(1800)]
    rows += rows[:40]  # repeated rows are one query and two candidates
    got = frame(spark, rows, tmp_path).collect()
    asked = {r for r in range(0, 1800, 20)}
    exact = [(i, np.array([math.floor(64 * x) for x in v])) for i, v in rows]
    ids, all_v = np.array([i for i, _ in exact]), np.stack([v for _, v in exact])
    for q in asked:
        s = all_v @ all_v[q]
        want = sorted((-int(s[x]), int(ids[x])) for x in range(len(ids)) if ids[x] != q)[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    # most blocks are out of reach of most queries
    v = all_v[:1800].astype(float)
    at = v[:12]
    t = topk._table(v, at)
    cell = t.argmin(1)
    keys = np.array([(8, c, 0) for c in range(12)])
    low, high = (np.stack([f(t[cell == c]) for c in range(12)]) for f in (lambda x: x.min(0), lambda x: x.max(0)))
    most = np.array([(v[cell == c] ** 2).sum(1).max() for c in range(12)])

    class Shared:
        value = (keys, low, high, most)

    least = [int(np.sort(v[cell == cell[i]] @ v[i])[-21]) for i in range(0, 1800, 20)]
    pick = np.arange(0, 1800, 20)
    batch = pa.RecordBatch.from_arrays([pa.array(pick), pa.array([x.astype(int).tolist() for x in v[pick]]), pa.array([x.tobytes() for x in t[pick]]), pa.array(least), pa.array(np.zeros(90, np.int32)), *(pa.array(keys[cell[pick]][:, k]) for k in range(3))], names=["vec_id", "vector", "table", "least", "part", *topk.BLOCK])
    sent = sum(b.num_rows for b in topk._goes_on(Shared)(iter([batch])))
    assert sent < 0.5 * 90 * 11


def test_summaries_in_turns(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(topk, "SUMMARY_BLOCKS", 12)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in topk.op2_top_k(spark, sf).collect()} == plain(rows)


def test_empty(spark, tmp_path):
    assert frame(spark, [], tmp_path).count() == 0
    assert topk.scaled(F.col("x")) is not None
