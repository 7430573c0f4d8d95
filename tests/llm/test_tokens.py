import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataline.llm import _tok, bpe, rans
from tests.llm.helpers import awkward_texts, docs_frame, sha

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIB = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENC = {p: _tok.WordEncoder(_tok.spec(p)) for p in (WORD, BYTE)}
PIECES = ["'", "s", "'ll", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "a", "Z", "é", "É", "İ", "ß", "ª", "²", "½", "3", "10", "_", "!?", "—", "…", "“", "ŋ", "ǅ", "Σ", "日本", "́", "😀", " ", "　", "<|endoftext|>", "<|endof", "K", "ﬁ"]


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=40))
def test_words_equal_library(path, text):
    want = LIB[path].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENC[path].encode([text])[0], "<u4").tolist() == want


def test_plain_characters_have_the_library_s_classes():
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2028)]):
        for path in (WORD, BYTE):
            for text in (c, f"a{c}b", f"1{c}2", f" {c} {c}", f"{c}\n{c}x", f"{c * 3}!{c}"):
                assert np.frombuffer(ENC[path].encode([text])[0], "<u4").tolist() == LIB[path].encode(text, add_special_tokens=False).ids, ascii(text)


def frames(spark, sf):
    yield docs_frame(spark, awkward_texts() * 2)
    yield spark.read.parquet(f"{sf}/documents.parquet")


def test_bpe(spark, sf):
    for docs in frames(spark, sf):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for size in (1 << 25, 5000):
            rows = bpe.decode(bpe.encode(docs, BYTE, block_bytes=size), BYTE).collect()
            assert len(rows) == len(texts)
            for r in rows:
                want = LIB[BYTE].encode(texts[r.doc_id], add_special_tokens=False).ids
                assert r.ids == want and r.decoded == LIB[BYTE].decode(want, skip_special_tokens=False)


def test_bpe_with_few_buckets_and_small_tables(spark, sf, monkeypatch):
    monkeypatch.setattr(bpe, "BUCKETS", 2)
    monkeypatch.setattr(bpe, "TABLE_WORDS", 60)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80).unionByName(docs_frame(spark, ["same text here"] * 40, 10**6))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode(docs, BYTE, block_bytes=20_000).collect():
        assert r.ids == LIB[BYTE].encode(texts[r.doc_id], add_special_tokens=False).ids


def test_bpe_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op5_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIB[BYTE].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(LIB[BYTE].decode(ids, skip_special_tokens=False))


def test_bpe_empty_and_broken(spark):
    docs = docs_frame(spark, ["a"]).withColumn("block", F.lit("x")).withColumn("ids", F.lit("y"))
    assert bpe.encode(docs, BYTE).collect()[0].ids == LIB[BYTE].encode("a").ids
    assert bpe.decode(bpe.encode(docs.limit(0), BYTE), BYTE).count() == 0
    cut = LIB[BYTE].encode("日😀").ids
    got = bpe.decode(spark.createDataFrame([(1, cut[:1]), (2, None)], "doc_id long, ids array<int>"), BYTE).orderBy("doc_id").collect()
    assert got[0].decoded == LIB[BYTE].decode(cut[:1], skip_special_tokens=False) and got[1].decoded == ""


def want_files(docs):
    at, out = 0, []
    rows = sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    for r in rows:
        ids = np.array([*LIB[WORD].encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_rans_query(spark, sf):
    got = [tuple(r)[:4] for r in rans.op1_token_files(spark, sf).orderBy("start").collect()]
    assert got == want_files(spark.read.parquet(f"{sf}/documents.parquet"))


def test_rans_awkward(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 3000)
    docs = docs_frame(spark, awkward_texts() * 3).withColumn("start", F.lit("x"))
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    rans.write(docs, f"{tmp_path}/a", WORD)
    got = rans.read(spark, f"{tmp_path}/a").select("doc_id", "start", "n_ids", F.crc32("ids")).orderBy("start").collect()
    assert [tuple(r) for r in got] == want_files(docs)
    rans.write(docs.limit(0), f"{tmp_path}/b", WORD)
    assert rans.read(spark, f"{tmp_path}/b").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40).map(lambda x: x * x), max_size=3000), st.integers(1, 70), st.integers(1, 9))
def test_rans_segments(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    model = rans.Model(rans.scaled(np.bincount(ids, minlength=2000)))
    states, places, stream = model.encode(ids, lanes, every)
    for k in range(len(states)):
        part = ids[k * lanes * every : (k + 1) * lanes * every]
        assert np.array_equal(model.decode(len(part), states[k], stream[places[k] :]), part)


def test_scaled_keeps_rare_ids():
    counts = np.array([10**12, 1, 0, 1, 5] + [1] * 50_000)
    f = rans.scaled(counts).astype(int)
    assert f.sum() == 1 << rans.SCALE_BITS and (f[counts > 0] > 0).all() and f[2] == 0


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 5, 10, 17])
def test_ranges_rise_with_the_id(spark, parts):
    ids = [*range(0, 3000, 7), None, -5, 10**15, 10**15 + 1, *([500] * 40)]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    rows = df.select("doc_id", rans._part(df, parts).cast("int").alias("p")).collect()
    known = sorted((r.doc_id, r.p) for r in rows if r.doc_id is not None)
    assert [p for _, p in known] == sorted(p for _, p in known)
    got = {p for _, p in known}  # many rows of one id may span a whole range, which then stays empty
    assert got <= set(range(parts)) and len(got) >= parts - 2
    assert [r.p for r in rows if r.doc_id is None] == [0]


@pytest.mark.parametrize("hot", [77, None])
def test_rows_of_one_id_are_dealt_over_ranges(spark, hot, tmp_path):
    texts = [f"t{i} of many words" for i in range(900)]
    docs = docs_frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(hot)).otherwise(F.col("doc_id")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), rans._part(docs, 12).cast("int").alias("p")).collect()
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r.p for r in ordered] == sorted(r.p for r in rows)
    sizes = np.bincount([r.p for r in rows], minlength=12)
    assert sizes.max() < 300 and sizes.sum() == 900


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_rans_query_with_other_numbers_of_partitions(spark, parts):
    sf, old = "/root/testdata/sf0.01", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [tuple(r)[:4] for r in rans.op1_token_files(spark, sf).orderBy("start").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == want_files(spark.read.parquet(f"{sf}/documents.parquet"))


def test_files_are_in_order_of_doc_id_with_more_ranges_than_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [" ".join(["word"] * int(n)) for n in rng.permutation(np.arange(1, 601) * 3)]
    docs = docs_frame(spark, texts).repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        rans.write(docs, f"{tmp_path}/f", WORD)
        got = rans.read(spark, f"{tmp_path}/f").select("doc_id", "start", "n_ids", F.crc32("ids")).collect()
        assert sorted(map(tuple, got)) == want_files(docs)
        files = sorted((tmp_path / "f" / "blocks").glob("part-*.parquet"))
        assert len(files) > 8
        keys = [np.frombuffer(r.doc_ids, "<i8") for f in files for r in spark.read.parquet(str(f)).collect()]
        assert np.concatenate(keys).tolist() == list(range(600))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
