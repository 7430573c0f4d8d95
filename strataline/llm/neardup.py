"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct runs of five words (A-Z lower-cased); a text
of fewer words is one run. In SuperMinHash every element meets the slots of the
signature in a random order, with ranks that grow from step to step; a document
stops at the first step after which all its slots are filled, and the slots'
values are less scattered than with independent hashes.

Documents of equal sets are one class, and a class is represented by its
smallest doc_id. Representatives that share a band are candidates. They are
first verified against the smallest one of the bucket; verified links join
them. Members of a bucket that are not joined by then are compared with each
other on their full sets, all of them: blocks of a bucket meet pairwise, and
the shingles that two blocks share give the exact intersection of every pair.
No bucket is capped and no candidate is left out by an estimate.

Defined cases: null and empty texts, and texts without words, have an empty set
and are linked with nothing; rows with null doc_id likewise; repeated rows are
copies of one another; extra columns are dropped by ``groups`` and kept by
``apply`` whatever their names; a text counts whole, however long; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import _text as t
from strataline.llm._store import Stored, fresh, small_batches
from strataline.llm.graph import labelled

SHINGLE, PERCENT = 5, 75
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Members of a bucket are compared in blocks of about so many, and of so many shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: So many ids (8 bytes each) may be broadcast to pick texts; beyond that the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
EMPTY = np.iinfo(np.uint64).max


def shingle_sets(chunk: t.Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's rows, sorted within rows, and the rows' bounds."""
    chunk = t.Chunk(chunk.first, chunk.last, t.ASCII_LOWER[chunk.buf], chunk.offs)
    w = t.words(chunk)
    hashes = t.span_hash(t.prefix_hash(chunk.buf), w.start, w.end)
    grams, bounds = t.gram_starts(w.offs, k)
    row, got = t.row_of(bounds), t.gram_hash(hashes, k)[grams]
    for n in range(1, k):  # texts of fewer words
        short = np.flatnonzero(w.counts == n)
        if len(short):
            row = np.concatenate((row, short))
            got = np.concatenate((got, t.gram_hash(hashes, n, 100 + n)[w.offs[short]]))
    order = np.lexsort((got, row))
    row, got = row[order], got[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
    row, got = row[new], got[new]
    return got, np.searchsorted(row, np.arange(chunk.rows + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row each: step in the high and random rank in the low 32 bits."""
    rows = len(bounds) - 1
    sig = np.full(rows * m, EMPTY, np.uint64)
    step_of = t.constants(m, 31)
    element, row = sets, t.row_of(bounds)
    order: np.ndarray | None = None
    first: np.ndarray | None = None
    for j in range(m):
        if not len(element):
            break
        x = t.mix(element + step_of[j])
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            each = np.arange(len(element))
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(element), 1))
                order[each, first] = 0
                order[:, 0] = first
            slot = order[each, k].astype(np.int64)
            order[each, k] = order[:, j]
            order[:, j] = slot
        np.minimum.at(sig, row * m + slot, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        open_rows = (sig.reshape(rows, m) == EMPTY).any(1)
        stay = open_rows[row]
        if not stay.all():
            element, row = element[stay], row[stay]
            first = first[stay]
            order = None if order is None else order[stay]
    return sig.reshape(rows, m)


def sign(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty) and bands."""
    combine, label = t.constants(ROWS, 41), t.constants(BANDS, 43)
    one, two = t.constants(2, 47)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in t.chunks(b.column(1), 1 << 19):
                sets, bounds = shingle_sets(c)
                n = np.diff(bounds)
                sig = signatures(sets, bounds)
                bands = t.mix((sig.reshape(c.rows, BANDS, ROWS) * combine).sum(2, dtype=np.uint64) + label)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(t.mix(sets * x))))[bounds] for x in (one, two)]
                keys = np.stack([np.diff(s) for s in sums], 1)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(c.first, c.rows),
                        pa.array(n, pa.int64()),
                        pa.array([None if e else k.tobytes() for k, e in zip(keys, none, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(c.rows + 1, dtype=np.int32) * BANDS), pa.array(bands.astype(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "key", "bands"],
                )
        t.release()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key binary, bands array<bigint>")


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """doc_id and its sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in t.chunks(b.column(1)):
                sets, bounds = shingle_sets(c)
                body = [sets[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows), pa.array(body, pa.binary())], names=["doc_id", "set"])
        t.release()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, set binary")


def _sets_of(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """doc_id and set of the documents named in ``ids`` (doc_id)."""
    wanted = ids.distinct()
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return _sets(docs.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi"), text)


def verify(docs: DataFrame, pairs: DataFrame, text: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; each of a and b is a doc_id of ``docs``."""
    sets = _sets_of(docs, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).toDF("doc_id"), text)
    both = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                keep.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = _common(p, q)
    return common > 0 and 100 * common >= percent * (len(p) + len(q) - common)


def _rest(members: DataFrame, docs: DataFrame, text: str, percent: int) -> DataFrame:
    """Links (a, b) between the labels of members (band, rep, n, label) of a bucket that are alike.

    Blocks of a bucket meet pairwise, each pair of blocks in one task, where the sets join last. What
    comes out of a task is a forest, at most a row per label.
    """
    counts = members.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # buckets of several blocks are few: at most a BLOCKth of the members; their members need not meet to learn it
    large = Stored(counts.filter("blocks > 1"), "large").df
    large = F.broadcast(large) if large.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else large
    dealt = members.join(large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "label", "own")
    sets = _sets_of(docs, members.select(F.col("rep").alias("doc_id")), text).withColumnRenamed("doc_id", "rep")

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        label, own = (table.column(c).to_numpy() for c in ("label", "own"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not len(left) or not len(right):
            return out.empty_table()
        # which members of the right block hold a shingle
        shingle = np.concatenate([sets[y] for y in right])
        holder = np.repeat(np.arange(len(right)), n[right])
        order = np.argsort(shingle, kind="stable")
        shingle, holder = shingle[order], holder[order]
        names, root = np.unique(label, return_inverse=True)
        root, parent = root.tolist(), list(range(len(names)))

        def find(p: int) -> int:
            while parent[p] != p:
                parent[p] = p = parent[parent[p]]
            return p

        a, b = [], []
        for x in left.tolist():
            low, high = np.searchsorted(shingle, sets[x], "left"), np.searchsorted(shingle, sets[x], "right")
            times = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
            common = np.bincount(holder[at], minlength=len(right))
            for y in right[100 * common >= percent * (n[x] + n[right] - common)].tolist():
                p, q = find(root[x]), find(root[y])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(int(names[min(p, q)]))
                    b.append(int(names[max(p, q)]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    # the groups are dealt by block pair, not by bucket
    return placed.join(sets, "rep").repartition("band", "i", "j").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id linked with it, itself included) of every row."""
    small_batches(docs.sparkSession)
    signed = Stored(sign(docs, text), "signed")
    some = signed.df.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    # the rows of one key are exact copies: they meet in partial aggregates
    classes = some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = Stored(classes, "classes")
    banded = reps.df.select(F.explode("bands").alias("band"), "rep", "n")
    leads = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1").select("band", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"))
    alike = 100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")
    met = banded.join(leads, "band")
    star = Stored(met.filter((F.col("rep") != F.col("lead")) & alike).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = Stored(verify(docs, star.df, text, percent), "verified")
    star.drop()
    first = labelled(links.df)
    links.drop()
    # buckets whose members are not all joined by now
    label = F.coalesce("label", "rep").alias("label")
    joined = met.select("band", "rep", "n").join(first.df.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n", label)
    mixed = joined.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
    members = Stored(joined.join(mixed, "band").select("band", "rep", "n", "label"), "members")
    named = reps.df.select("key", "rep").join(first.df.withColumnRenamed("node", "rep"), "rep", "left").select("key", label)
    if not members.df.isEmpty():
        more = Stored(_rest(members.df, docs, text, percent), "verified")
        second = labelled(more.df)
        more.drop()
        named = named.join(second.df.toDF("label", "to"), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    members.drop()
    out = signed.df.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def apply(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller doc_id; of rows with one doc_id all stay or go."""
    own, gone = fresh(docs, "__id", "__gone")
    found = groups(docs, text, percent)
    left = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    rows = docs.withColumn(own, F.col("doc_id"))
    return rows.join(left, F.col(own) == F.col(gone), "left_anti").select(*[rows[c] for c in docs.columns])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
#: All pairs that share a shingle; for tables of some thousand documents.
ORACLES = {
    "op7_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
        least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id
    """
}
