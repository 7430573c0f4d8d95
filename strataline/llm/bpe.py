"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

Documents are packed in chunks, and chunks dealt to blocks by a hash. Each block
lists its distinct words, bucketed by word hash; a bucket goes through the lists of
all blocks one by one, encodes each distinct word once and hands every block the ids of
its own words. These join back by position: a document is the run of its words'
ids. Decoding takes each id's piece from the vocabulary by position in a join of
flat arrays, and cuts the pieces' bytes at the documents' bounds.

A block holds about ``BLOCK_BYTES`` of text; the number of blocks follows from the size of the
input, that of buckets does not grow beyond ``BUCKETS``, so that the rows that blocks and
buckets exchange grow with the input, not with its square. A bucket holds one list and
its table of distinct words; a table of more than ``TABLE_WORDS`` words is begun anew.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows and equal ids are encoded row by row; a text longer than a chunk
is a chunk of its own; an empty table gives an empty result; extra columns are
dropped by ``encode`` and ``decode`` (join them back by doc_id).
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import _tok
from strataline.llm._store import small_batches
from strataline.llm._text import release

BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
BUCKETS, TABLE_WORDS = 2048, 2_000_000


def _pack(items: list[bytes]) -> bytes:
    """Byte strings with their lengths, compressed."""
    return zstandard.compress(np.array([len(items), *map(len, items)], "<u4").tobytes() + b"".join(items), 3)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64))) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class _New(dict):
    """What ``found`` gives for a word when it is first met."""

    def __init__(self, found):
        super().__init__()
        self.found = found

    def __missing__(self, word: str):
        out = self[word] = self.found(word)
        return out


def encode(docs: DataFrame, tokenizer: str, text: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row, as the tokenizers library encodes the whole text.

    With ``decoded`` the column of ``decode`` too, from the ids, by the same worker processes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec = _tok.spec(tokenizer)
    width = 2 if _tok.encoder(spec).size < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select("doc_id", F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(n, BUCKETS)
    chunk = min(CHUNK_BYTES, block_bytes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows as one row each, dealt to blocks by a checksum of their doc_ids and texts."""
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            body = _pack(texts)
            block = zlib.crc32(body, zlib.crc32(str(ids).encode())) % n
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.binary())], names=["block", "doc_ids", "texts"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(x or b"")
                size += len(texts[-1])
                if size >= chunk:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()
        release()

    blocks = rows.mapInArrow(packed, "block long, doc_ids array<bigint>, texts binary").repartition(n, "block")

    def words_of(enc: _tok.WordEncoder, column: pa.ChunkedArray) -> Iterator[list[str]]:
        """The words of each text of a block, in the order in which the block's rows come."""
        for x in column:
            for text in _unpack(x.as_py()):
                yield enc.words(text.decode())

    def ordered(table):
        """Rows of a block in one order, wherever they were read from."""
        order = sorted(range(table.num_rows), key=lambda i: (zlib.crc32(table.column("texts")[i].as_py()), table.column("doc_ids")[i].as_py()))
        return table.take(order)

    def distinct(key, table):
        """A block's distinct words by bucket, in the order in which the block has them."""
        enc = _tok.encoder(shared.value, width)
        by: dict[int, list[bytes]] = {}

        def add(word: str) -> None:
            raw = word.encode()
            by.setdefault(zlib.crc32(raw) % buckets, []).append(raw)

        seen = _New(add)
        for w in words_of(enc, ordered(table).column("texts")):
            deque(map(seen.__getitem__, w), maxlen=0)
        del seen, enc
        block = pa.array([key[0].as_py()] * len(by), pa.int64())
        return pa.Table.from_arrays([block, pa.array(by, pa.int64()), pa.array(map(_pack, by.values()), pa.binary())], names=["block", "bucket", "words"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets one after the other: each distinct word is encoded once, each block gets its words' ids."""
        enc = _tok.encoder(shared.value, width)
        known: dict[bytes, bytes] = {}
        last = -1
        for b in batches:
            for block, bucket, packed_words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last or len(known) > TABLE_WORDS:
                    known, last = {}, bucket
                words = _unpack(packed_words)
                new = [w for w in words if w not in known]
                known.update(zip(new, enc.encode_words([w.decode() for w in new]), strict=True))
                body = _pack([known[w] for w in words])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int64()), pa.array([body], pa.binary())], names=["block", "bucket", "ids"])
        enc.pieces_seen.clear()
        del known
        release()

    def joined(key, docs, table):
        """A block: its words' ids join back by position."""
        enc = _tok.encoder(shared.value, width)
        left = {k.as_py(): iter(_unpack(x.as_py())) for k, x in zip(table.column("bucket"), table.column("ids"), strict=True)}
        docs = ordered(docs)
        of = _New(lambda word: next(left[zlib.crc32(word.encode()) % buckets]))
        out = [b"".join(map(of.__getitem__, w)) for w in words_of(enc, docs.column("texts"))]
        flat = np.frombuffer(b"".join(out), f"<u{width}").astype("<i4")
        offsets = np.concatenate(([0], np.cumsum([len(x) // width for x in out], dtype=np.int64))).astype(np.int32)
        del out, of, left
        release()
        doc_ids = pa.chunked_array([x.flatten() for x in docs.column("doc_ids").chunks], pa.int64())
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        if not decoded:
            return pa.Table.from_arrays([doc_ids, ids], names=["doc_id", "ids"])
        return pa.Table.from_arrays([doc_ids, ids, joined_pieces(shared.value, ids)], names=["doc_id", "ids", "decoded"])

    words = blocks.groupBy("block").applyInArrow(distinct, "block long, bucket long, words binary")
    table = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encoded, "block long, bucket long, ids binary")
    return blocks.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(joined, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def pieces(spec: str) -> list[bytes]:
    """The bytes of each id, for byte-level and word-end tokenizers."""
    d = json.loads(spec)
    vocab = dict(d["model"]["vocab"])
    signs = {sign: b for b, sign in _tok.byte_signs().items()}
    suffix = d["model"].get("end_of_word_suffix") or ""
    out = [b""] * (max([*vocab.values(), *(a["id"] for a in d["added_tokens"])]) + 1)
    for piece, i in vocab.items():
        ends = suffix and piece.endswith(suffix)
        body = piece.removesuffix(suffix) if ends else piece
        out[i] = (bytes(signs[c] for c in body) if all(c in signs for c in body) else body.encode()) + (b" " if ends else b"")
    for a in d["added_tokens"]:
        out[a["id"]] = a["content"].encode()
    return out


_pieces: dict[str, pa.Array] = {}


def joined_pieces(spec: str, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids: the ids join the vocabulary's pieces by position."""
    if spec not in _pieces:
        _pieces.clear()
        _pieces[spec] = pa.array(pieces(spec), pa.large_binary())
    texts: list[str] = []
    for i in range(0, len(ids), 500):
        part = ids.slice(i, 500)
        flat, bounds = part.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False))))
        got = _pieces[spec].take(flat)
        offs = np.frombuffer(got.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        view = memoryview(got.buffers()[2] or b"")
        cut = offs[bounds].tolist()
        texts += [str(view[x:y], "utf-8", "replace") for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return pa.array(texts, pa.string())


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """doc_id, ids and decoded text of every row; bytes that are not UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(_tok.spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), joined_pieces(shared.value, pc.fill_null(b.column(1), []))], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents encoded with byte_bpe_50k and decoded again."""
    import public_tokenizers  # only the query needs it: the operators take a path

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
