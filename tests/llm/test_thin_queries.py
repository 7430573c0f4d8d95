"""The registered queries themselves, on the whole small table, against plain versions; each contract's columns and types."""

import pytest

from strataline.llm import registry
from tests.llm.helpers import WORD, quality
from tests.llm.test_licenses import plain as plain_licenses
from tests.llm.test_mixing import plain_targets
from tests.llm.test_neardup import plain as plain_groups

COLUMNS = {
    "op1": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3": "page_id bigint, url string, text string, n_chars bigint",
    "op4": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op5": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.mark.parametrize("op", COLUMNS)
def test_columns(spark, sf, op):
    (query,) = [f for n, f in registry.queries().items() if n.split("_")[0] == op]
    kinds = dict(query(spark, sf).dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in COLUMNS[op].split(", "))} == dict(x.split() for x in COLUMNS[op].split(", "))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name):
    return {r.doc_id: r for r in registry.queries()[name](spark, sf).collect()}


def test_op4(spark, sf, docs):
    got = rows(spark, sf, "op4_license_scan")
    assert set(got) == set(docs)
    for i, r in got.items():
        assert tuple(r)[1:8] == plain_licenses(docs[i].text)[:7]


def test_op6(spark, sf, docs):
    got = rows(spark, sf, "op6_quality_rules")
    assert set(got) == set(docs)
    for i, r in got.items():
        want = quality(docs[i].text)
        assert {k: r[k] for k in want} == want and (not r.kept or not r.base_failed)


def test_op7(spark, sf, docs):
    want = plain_groups([(i, r.text) for i, r in docs.items()])
    got = rows(spark, sf, "op7_near_duplicates")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_op8(spark, sf, docs):
    got, sizes = rows(spark, sf, "op8_source_mix"), {}
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for i, r in got.items():
        s = docs[i].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * sizes[s] + 1 for s in sizes)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same(spark, sf, name):
    import os

    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    got = registry.queries()[name](spark, sf)
    want = c.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(r[x] for x in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
