import random

from pyspark.sql import functions as F

from strataline.llm import quality as q
from tests.llm.helpers import WORD, awkward_texts, docs_frame, quality


def plain_bits(text):
    """All rules on one text, character by character."""
    words = WORD.findall(text)
    want, longest, chars = quality(text), max(map(len, words), default=0), "".join(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(x.isascii() and x.isalpha() or not x.isascii() for x in text)
    n, size, symbols = len(words), len(chars), want["n_symbols"]
    fails = [
        n < 20, 100 * want["n_repeat_words"] > 30 * n, len(lines) >= 4 and 100 * want["n_dup_lines"] > 60 * len(lines), 100 * symbols > 15 * size, n > 0 and size < 2 * n, size > 40 * n, longest > 1000,
        100 * symbols > 30 * n, longest > 1000 and 2 * longest > size and 2 * sum(x.isascii() for x in chars) > size, size > 40 * n and 2 * sum(x.isascii() for x in chars) > size, 2 * sum("A" <= x <= "Z" for x in text) > letters, 100 * letters < 60 * size,
        2 * sum("0" <= x <= "9" for x in text) > size,
    ]
    return sum(1 << i for i, x in enumerate(fails) if x)


def check(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = q.apply_policy(q.apply_policy(q.ledger(docs), "base", 1, "base_kept")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = quality(texts[r.doc_id])
        assert {k: r[k] for k in want if k != "base_failed"} | {"base_failed": not r.base_kept} == want, texts[r.doc_id][:80]
        assert r.kept == (r.fail_bits & q.POLICIES["corpus", 3] == 0) and (r.base_kept or not r.kept)
        assert r.fail_bits == plain_bits(texts[r.doc_id] or ""), texts[r.doc_id][:80]


def test_awkward(spark):
    check(spark, docs_frame(spark, awkward_texts() * 2))


def test_documents(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def test_empty_and_clashing_columns(spark):
    docs = docs_frame(spark, ["a b c", None]).withColumn("n_words", F.lit("x")).withColumn("fail_bits", F.lit("y")).withColumn("extra", F.lit(1))
    out = q.ledger(docs)
    assert sorted(r.n_words for r in out.collect()) == [0, 3] and "extra" in out.columns
    assert q.ledger(docs.limit(0)).count() == 0
    assert q.ablation(q.ledger(docs.limit(0))).count() == 0


def test_ablation(spark, sf):
    rows = q.ledger(spark.read.parquet(f"{sf}/documents.parquet")).persist()
    bits = [r.fail_bits for r in rows.collect()]
    for r in q.ablation(rows).collect():
        bit = q.BITS[r.rule]
        assert r.failed == sum(b & bit > 0 for b in bits)
        assert r.failed_alone == sum(b == bit for b in bits)
        assert r.kept_without == sum(b & ~bit == 0 for b in bits)
    rows.unpersist()


def test_clean_texts_are_kept_however_long(spark):
    prose = " ".join(f"word{chr(97 + i % 26)} of the long and clean text" for i in range(40))
    rng = random.Random(2)
    many = " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(60_000))
    uri = "data:image/png;base64," + "iVBORw0KGgo" * 200
    texts = [many, many[:4000] + " " + uri + " " + many[4000:20_000], "。".join("漢字文章" * 20 + str(i) for i in range(60)) + " " + " ".join(f"漢字{i}" for i in range(30))]
    bad = [prose.upper(), " ".join(["%%%%% a1"] * 1 + [f"{i} 77 12 9 3 88" for i in range(60)]), "x" * 5000 + " " + " ".join(f"w{i}" for i in range(30))]
    rows = {r.doc_id: r.kept for r in q.apply_policy(q.ledger(docs_frame(spark, texts + bad))).collect()}
    assert [rows[i] for i in range(6)] == [True] * 3 + [False] * 3
