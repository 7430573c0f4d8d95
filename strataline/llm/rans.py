"""Token ids as files of static range asymmetric numeral system blocks.

``write`` tokenises documents in ascending doc_id order, counts every id of the
whole corpus, scales the counts to one shared frequency table and encodes
blocks of whole documents. Within a block, neighbouring ids go to different
lanes (interleaving); the lanes' states and the place in the word stream are
stored at every checkpoint, each with a checksum of the ids up to the next one,
so that any segment decodes alone. ``read`` gives the ids back.

Files: ``<path>/model`` holds the frequency table, ``<path>/blocks`` a row per
block, in a file per range of doc_ids and in order within it. The columns of
``blocks`` are the format: ``part`` (the range's number, ascending with doc_id) and
``start_in_part`` (ids before the block in its range), ``first_key``, ``n_docs``,
``n_ids``, ``doc_ids`` (little-endian int64, with ``nulls`` as a bit per document),
``lengths`` (uint32), ``states`` (uint64 per checkpoint and lane), ``places`` (uint32 per
checkpoint), ``sums`` (crc32 per checkpoint) and ``stream`` (uint32 words).

Defined cases: a null or empty text has the end id alone; a null doc_id comes
first; documents with equal doc_id are ordered by a hash of the text; repeated
rows are encoded each; a document longer than a block is a block of its own;
an empty table gives an empty file set; extra columns are not written.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm import _tok
from strataline.llm._store import Folder, Stored, small_batches

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
LANES, CHECKPOINT, BLOCK_IDS = 4096, 128, 1 << 20
END_ID = 1
#: A range of doc_ids holds about so many bytes of text.
RANGE_BYTES = 256 << 20
#: Up to so many ranges, their offsets (24 bytes each) are broadcast.
BROADCAST_PARTS = 100_000
BLOCK_SCHEMA = (
    "part long, start_in_part long, first_key long, n_docs long, n_ids long, doc_ids binary, nulls binary, lengths binary,"
    " states binary, places binary, sums binary, stream binary"
)


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of sum 2**bits, at least 1 where an id occurs."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > size:
        raise ValueError("more ids than the frequency table can hold")
    f = np.maximum((counts.astype(np.float64) * (size / total)).astype(np.int64), counts > 0)
    order = np.argsort(-f, kind="stable")
    while (off := int(size - f.sum())) != 0:
        if off > 0:
            f[order[0]] += off
        else:  # take from the largest, never below 1
            take = np.minimum(np.maximum(f[order] - 1, 0), np.maximum(f[order] * -off // int(f.sum()), 1))
            upto = np.cumsum(take)
            take = np.where(upto <= -off, take, np.maximum(take - (upto + off), 0))
            f[order] -= take
    return f.astype(np.uint32)


class Model:
    """Frequencies, their running sums and, for decoding, the id of each slot."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Checkpoint states (checkpoints x lanes), their places in the stream, the stream."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        freq, cum = self.freq[ids], self.cum[ids]
        limit = freq * ((LOW >> self.bits) << WORD_BITS)
        words: list[np.ndarray] = []
        saved: list[tuple[np.ndarray, int]] = []
        for s in range(steps - 1, -1, -1):
            at = slice(s * lanes, (s + 1) * lanes)
            f = freq[at]
            x = state[: len(f)]
            over = np.flatnonzero(x >= limit[at])
            high = x[over]
            words.append(high.astype("<u4"))
            x[over] = high >> WORD_BITS
            q = x // f
            # (q << bits) + x - q * f + cum, in place
            x += (q << self.bits) - q * f + cum[at]
            if s % every == 0:
                saved.append((state.copy(), len(words)))
        sizes = np.cumsum([0, *(len(w) for w in reversed(words))])
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        saved.reverse()
        states = np.stack([s for s, _ in saved]) if saved else np.zeros((0, lanes), np.uint64)
        places = np.array([sizes[len(words) - n] for _, n in saved], "<u4")
        return states, places, stream

    def decode(self, n: int, state: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """n ids from the lanes' states and the stream from a checkpoint's place on."""
        lanes, slots, freq, cum = len(state), self.slots, self.freq, self.cum
        state, out, at = state.copy(), np.empty(n, np.uint32), 0
        mask = np.uint64((1 << int(self.bits)) - 1)
        for i in range(0, n, lanes):
            x = state[: min(lanes, n - i)]
            slot = x & mask
            ids = slots[slot]
            out[i : i + len(x)] = ids
            x = freq[ids] * (x >> self.bits) + slot - cum[ids]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << WORD_BITS) | stream[at : at + len(low)]
            at += len(low)
            state[: len(x)] = x
        return out


def _part(docs: DataFrame, parts: int, text: str = "text") -> Column:
    """The range of doc_ids that a row belongs to, of about as many rows each; null is before all ids.

    The bounds come from the ids alone: a range partitioning of Spark's own would read the texts twice. They
    are searched in two steps of about the square root of their number. An id that is several bounds in a row
    has so many rows that its ranges share them by the hash of the text, in the order that they have in the files.
    """
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))
    bounds = docs.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    if not bounds:
        return F.lit(0)
    m = math.ceil(math.sqrt(len(bounds) + 1))
    groups = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    coarse = F.array(*[F.lit(g[-1] if len(g) == m else math.inf) for g in groups])
    fine = F.array(*[F.array(*[F.lit(b) for b in (g[: m - 1] or [math.inf])]) for g in [*groups, []]])

    def count(below) -> Column:
        """How many bounds are below."""
        c = F.size(F.filter(coarse, lambda b: below(b)))
        return F.transform(F.array(c), lambda i: i * m + F.size(F.filter(F.get(fine, i), lambda b: below(b))))[0]

    low = count(lambda b: b < key)
    ties = sorted({b for b, c in zip(bounds, bounds[1:], strict=False) if b == c and (abs(b) < 2**53 or b == -math.inf)})
    if not ties:  # a bound is the last of its range
        return low
    share = (F.shiftright(F.xxhash64(text), 32).cast("double") + 2**31) / 2**32
    return F.when(key.isin(ties), low + F.floor(share * (count(lambda b: b <= key) - low))).otherwise(low)


def _parts(docs: DataFrame, text: str) -> int:
    """Ranges of about RANGE_BYTES of text, and no fewer than the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES), 1)


def _sorted_tokens(docs: DataFrame, spec: str, end_id: int, text: str, parts: int) -> Stored:
    """part (the range), start (ids before the document in its range), doc_id, n_ids and ids (uint16 where they allow it).

    Each range is written in ascending doc_id order; tasks that read the table may get several ranges, or a piece of one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select(_part(docs, parts, text).cast("int").alias("part"), "doc_id", F.col(text).alias("text"))
    order = ["part", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    width = 2 if max(_tok.encoder(spec).size, end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tok.encoder(shared.value, width)
        tail = np.array([end_id], f"<u{width}").tobytes()
        part, before = -1, 0
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids = [x + tail for x in enc.encode(b.column(2).to_pylist())]
                counts, starts = [len(x) // width for x in ids], []
                for p, n in zip(b.column(0).to_pylist(), counts, strict=True):
                    if p != part:
                        part, before = p, 0
                    starts.append(before)
                    before += n
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), b.column(1), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["part", "start", "doc_id", "n_ids", "ids"])

    made = rows.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).mapInArrow(run, "part int, start long, doc_id long, n_ids long, ids binary")
    return Stored(made, "tokens", compression="zstd")


def _ids_of(column: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """All ids of a batch in one array, on the batch's own buffer."""
    if not len(column):
        return np.zeros(0, "<u2")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2])[ends[0] : ends[-1]]
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * int(lengths.sum()) else "<u4")


def _counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; at most ``size`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_ids_of(b.column(1), b.column(0).to_numpy()), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    got = tokens.select("n_ids", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def _block(model: Model, part: int, start: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> list:
    states, places, stream = model.encode(ids)
    raw = ids.astype("<u4").tobytes()
    segment = 4 * LANES * CHECKPOINT
    sums = np.array([zlib.crc32(raw[i : i + segment]) for i in range(0, len(raw), segment)], "<u4")
    nulls = np.packbits([d is None for d in doc_ids]).tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return [part, start, doc_ids[0], len(doc_ids), len(ids), keys.tobytes(), nulls, np.array(lengths, "<u4").tobytes(), states.astype("<u8").tobytes(), places.tobytes(), sums.tobytes(), stream.tobytes()]


def _arrow(rows: list[list], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), like, strict=True)], schema=like)


_BLOCK_ARROW = pa.schema([(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in (x.split() for x in BLOCK_SCHEMA.split(","))])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, text: str = "text") -> None:
    """Tokenise ``docs`` (doc_id and ``text``) and write them to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = _tok.spec(tokenizer)
    parts = _parts(docs, text)
    tokens = _sorted_tokens(docs, spec, end_id, text, parts)
    size = max(_tok.encoder(spec).size, end_id + 1)
    freq = scaled(_counts(tokens.df, size))
    spark.createDataFrame([(SCALE_BITS, freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{path}/model")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, start, n = Model(shared.value), 0, 0, 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, held, n
            out = _arrow([_block(model, part, start, doc_ids, lengths, np.concatenate(held))], _BLOCK_ARROW)
            doc_ids, lengths, held, n = [], [], [], 0
            return out

        for b in batches:
            counts = b.column(3).to_numpy()
            ids = _ids_of(b.column(4), counts)
            begin = end = 0
            for p, s, key, count in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if doc_ids and (p != part or s != start + n):  # another range, or another piece of it
                    held.append(ids[begin:end])
                    yield block()
                    begin = end
                if not doc_ids:
                    part, start = p, s
                doc_ids.append(key)
                lengths.append(count)
                n += count
                end += count
                if n >= BLOCK_IDS:
                    held.append(ids[begin:end])
                    yield block()
                    begin = end
            held.append(ids[begin:])
        if doc_ids:
            yield block()

    blocks = tokens.df.mapInArrow(run, BLOCK_SCHEMA)
    # a scan hands files out by size: the blocks, a fraction of the texts, go back to their ranges
    blocks = blocks.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "start_in_part")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    tokens.drop()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_ids, ids (little-endian uint32) of each document in the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/model").first()
    shared = spark.sparkContext.broadcast((table.bits, table.freq))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per range
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if before.count() <= BROADCAST_PARTS:
        before = F.broadcast(before)
    made = blocks.join(before, "part").select((F.col("before") + F.col("start_in_part")).alias("start"), "n_ids", "doc_ids", "nulls", "lengths", "states", "places", "sums", "stream")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, freq = shared.value
        model = Model(np.frombuffer(freq, "<u4"), bits)
        for b in batches:
            for start, n, doc_ids, nulls, lengths, states, places, sums, stream in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, counts = np.frombuffer(doc_ids, "<i8"), np.frombuffer(lengths, "<u4").astype(np.int64)
                at, check, words = np.frombuffer(places, "<u4"), np.frombuffer(sums, "<u4"), np.frombuffer(stream, "<u4")
                lanes = np.frombuffer(states, "<u8").reshape(len(at), -1)
                ids, segment = [], LANES * CHECKPOINT
                for k in range(len(at)):
                    got = model.decode(min(segment, n - k * segment), lanes[k], words[at[k] :])
                    if zlib.crc32(got.astype("<u4").tobytes()) != check[k]:
                        raise ValueError(f"checksum of segment {k} of the block at {start} does not match")
                    ids.append(got)
                raw = pa.py_buffer(np.concatenate(ids).astype("<u4").tobytes())
                ends = np.concatenate(([0], np.cumsum(counts)))
                offsets = pa.py_buffer((4 * ends).astype(np.int32).tobytes())
                missing = np.unpackbits(np.frombuffer(nulls, np.uint8))[: len(keys)].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=missing), pa.array(start + ends[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, raw])],
                    names=["doc_id", "start", "n_ids", "ids"],
                )

    return made.mapInArrow(run, "doc_id long, start long, n_ids long, ids binary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through word_bpe_49k into files in the shared folder, and back."""
    import public_tokenizers  # only the query needs it: the operator takes a path

    folder = Folder(spark, "rans")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder.path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder.path).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
