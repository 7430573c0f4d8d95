from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm.helpers import awkward_texts, docs_frame, quality, sha
from tests.llm.test_neardup import plain as plain_groups
from tests.llm.test_suffix import plain as plain_suffix


def plain_suffix_texts(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def follow(spark, docs):
    """Stage by stage against plain versions, on the rows that the stage before kept."""
    columns = docs.columns
    kept = p.quality_rules(spark, docs, "")
    assert kept.columns == columns
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}
    assert not any(quality(before[i])["base_failed"] for i in after)
    near = p.near_duplicates(spark, kept, "")
    assert near.columns == columns
    left = {r.doc_id: r.text for r in near.collect()}
    assert set(left) == {i for i, (_, c) in plain_groups(list(after.items())).items() if i == c}
    cut = p.suffix_dedup(spark, near, "")
    assert cut.columns == columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    want = plain_suffix_texts(list(left.items()))
    assert texts == {i: (x, len(x)) for i, x in want.items()}
    assert {i: v[1] for i, v in plain_suffix(list(left.items())).items()}.keys() == texts.keys()
    mixed = p.source_mix(spark, cut, "")
    assert mixed.columns == columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(texts) and set(copies.values()) <= {1, 2}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = p.bpe_ids(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in rows) == copies
    for r in rows:
        ids = tok.encode(texts[r.doc_id][0], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id][0]))
    return Counter((r.doc_id, r.ids_sha256) for r in rows)


def test_stages_and_run(spark, sf):
    want = follow(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    assert Counter((r.doc_id, r.ids_sha256) for r in p.run(spark, sf).collect()) == want


def test_columns_named_like_helpers_keep_their_values(spark):
    names = ("n_words", "fail_bits", "kept", "__id", "__spans", "__copies", "row", "label")
    docs = docs_frame(spark, [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(30)]).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2))
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        assert rows and all(r[n].startswith(n) and (r.doc_id is None or r[n] == f"{n}{r.doc_id}") for r in rows for n in names)


def test_awkward(spark):
    docs = docs_frame(spark, awkward_texts() * 2)
    follow(spark, docs)
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0
    assert F is not None and [n for n, _ in p.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "BPE encoding and decoding"]
