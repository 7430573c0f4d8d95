"""Exact removal of repeated passages with an enhanced suffix array.

Every string of ``length`` bytes belongs to an anchor: the smallest hash among
its ``GRAM``-byte substrings. Strings that follow one another with one anchor
form a piece of text; equal strings have equal anchors, so they meet in the
anchor's group wherever they are. Pieces that are alike as a whole are copies of
their first one. What is left of the groups with different pieces goes through a
suffix array with common-prefix lengths: a stack scan gives the interval tree,
an interval whose occurrences differ in the byte before them is a maximal repeat
(within the piece). ``repeats`` gives these and the repeated pieces with all their
occurrences, those in copies too; groups of more than ``HOT`` pieces are dealt by the
first ``length`` bytes of their suffixes there, and the removal, which needs the later
places alone, deals them by the hash of each string.

Places are ordered by doc_id, then start. Removed is each byte that a string of
``length`` bytes covers which also starts at an earlier place.

Defined cases: a null text is empty; texts shorter than ``length`` keep all
bytes; rows of null doc_id are not compared and keep all bytes; rows that repeat
a doc_id are one document, equal starts in it are the same place; a character
cut at a span's edge loses its other bytes in ``apply``; a text counts whole,
however long; extra columns are kept by ``apply`` whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm import _text as t
from strataline.llm._store import Stored, fresh, small_batches

LENGTH, GRAM = 100, 32
HOT = 4096
#: Positions of a run of bytes that is hashed at once; their numbers fit the low bits of a key.
SEGMENT, LOW_BITS = 1 << 23, 24
#: Bytes of texts that are hashed together.
CHUNK = 1 << 18
#: Pieces of a task that are compared with each other before the shuffle.
HELD = 400_000
#: Bytes of pieces in one suffix array, but for a group that is larger.
ARRAY_BYTES = 1 << 19
PIECE = "anchor long, piece long, doc long, lo int, n int, copy boolean"


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if width > size else keys


def pieces(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of the rows in ``buf``: first string's start, number of strings, anchor hash, hash of the piece."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = t.prefix_hash(buf)
    at = np.arange(len(buf) - gram + 1)
    h = t.span_hash(prefix, at, at + gram)
    low = np.uint64((1 << LOW_BITS) - 1)
    anchor = (_least((h & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int64)
    ends = offs[1:] - length + 1
    some = ends > offs[:-1]
    np.add.at(edge, offs[:-1][some], 1)
    np.add.at(edge, ends[some], -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(start):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    mine = anchor[start]
    first = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (mine[1:] != mine[:-1]))))
    n = np.diff(np.concatenate((first, [len(start)])))
    lo = start[first]
    return lo, n, h[mine[first]], t.span_hash(prefix, lo, lo + n + length - 1)


def _segments(chunk: t.Chunk, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of a chunk that fit the keys; a longer row comes in runs that overlap by a string less a byte."""
    if len(chunk.buf) <= SEGMENT:
        yield 0, chunk.buf, chunk.offs
        return
    for i in range(0, max(1, len(chunk.buf) - length + 1), SEGMENT):
        part = chunk.buf[i : i + SEGMENT + length - 1]
        yield i, part, np.array([0, len(part)])


def _found(docs: DataFrame, text: str, length: int) -> DataFrame:
    """PIECE rows of all documents; those that repeat an earlier piece of the same task are copies already."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, lo, n, anchor, piece = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((lo, doc, piece, anchor))
        doc, lo, n, anchor, piece = (x[order] for x in (doc, lo, n, anchor, piece))
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        copy = (doc != doc[first]) | (lo != lo[first])
        # copies need no company: they are spread evenly
        anchor = np.where(copy, t.mix(doc.astype(np.uint64) * np.uint64(t.BASE) + lo.astype(np.uint64)), anchor)
        keep = new | copy
        cols = (anchor.view(np.int64), piece.view(np.int64), doc, lo.astype(np.int32), n.astype(np.int32), copy)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["anchor", "piece", "doc", "lo", "n", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for c in t.chunks(b.column(1), CHUNK):
                for base, buf, offs in _segments(c, length):
                    lo, n, anchor, piece = pieces(buf, offs, length)
                    row = np.searchsorted(offs, lo, "right") - 1
                    held.append((ids[c.first + row], lo - offs[row] + base, n, anchor, piece))
                    size += len(lo)
                if size >= HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)
        del held
        t.release()

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECE)


def suffix_repeats(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``length`` bytes among pieces [begin, end) of ``buf``.

    Each is (length, places in buf, pieces of these places). Only suffixes whose first ``length``
    bytes occur again enter the array: no other one is in an interval of that depth. The array
    is in the order of a hash of these first bytes, then of the bytes after them.
    """
    counts = end - begin - length + 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(begin)), counts)
    start = np.arange(bounds[-1]) - bounds[owner] + begin[owner]
    head = t.span_hash(t.prefix_hash(buf), start, start + length)
    _, inverse, times = np.unique(head, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    start, owner, head = start[again], owner[again], head[again]
    if not len(start):
        return []
    rest = end[owner] - start - length
    wide = -(-int(rest.max()) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((buf, np.zeros(wide + 1, np.uint8))), max(wide, 1))
    tail = rows[start + length][:, :wide]
    tail[np.arange(wide) >= rest[:, None]] = 0
    words = tail.view(">u8").astype(np.uint64) if wide else np.zeros((len(start), 0), np.uint64)
    order = np.lexsort((rest, *words.T[::-1], head))
    start, owner, head, rest, tail = start[order], owner[order], head[order], rest[order], tail[order]
    differ = np.concatenate((tail[1:] != tail[:-1], np.ones((len(tail) - 1, 1), bool)), 1)
    common = np.minimum(np.minimum(differ.argmax(1), rest[1:]), rest[:-1])
    lcp = np.concatenate(([0], np.where(head[1:] == head[:-1], length + common, 0), [0])).tolist()
    before = np.where(start > begin[owner], buf[np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(start)))
    turns = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))).tolist()
    out, stack = [], []
    for i in range(1, len(lcp)):
        left, now = i - 1, lcp[i]
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            if turns[i - 1] != turns[left]:  # the bytes before the occurrences differ
                out.append((depth, start[left:i], owner[left:i]))
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, left))
    return out


GROUPS = "group long, length int, piece long, inner int"


def _repeats(strings: DataFrame, length: int, by_piece: bool = False) -> DataFrame:
    """group, length, doc, start, first of the maximal repeats among the first places of pieces; strings: anchor, doc, lo, body, in groups by anchor.

    ``by_piece`` gives the piece and the place in it instead of doc, start and first (GROUPS).
    """
    where = [("piece", pa.int64()), ("inner", pa.int32())] if by_piece else [("doc", pa.int64()), ("start", pa.int32()), ("first", pa.bool_())]
    schema = pa.schema([("group", pa.int64()), ("length", pa.int32()), *where])

    def scan(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables)
        body = [x.as_buffer() for x in table.column("body")]
        buf = np.frombuffer(b"".join(body), np.uint8)
        ends = np.cumsum([x.size for x in body])
        begin = ends - [x.size for x in body]
        doc, lo = table.column("doc").to_numpy(), table.column("lo").to_numpy().astype(np.int64)
        found = suffix_repeats(buf, begin, ends, length)
        if not found:
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
        size = np.array([len(x) for _, x, _ in found])
        deep = np.repeat([d for d, _, _ in found], size)
        place, owner = np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found])
        number = np.repeat(np.arange(len(found)), size)
        if by_piece:
            prefix = t.prefix_hash(buf)
            name = t.span_hash(prefix, place, place + deep).view(np.int64)
            piece = t.span_hash(prefix, begin, ends).view(np.int64)[owner]
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(deep.astype(np.int32)), pa.array(piece), pa.array((place - begin[owner]).astype(np.int32))], schema=schema)
        docs, start = doc[owner], lo[owner] + place - begin[owner]
        order = np.lexsort((start, docs, number))
        head = order[np.concatenate(([0], np.cumsum(size)[:-1]))][number]
        first = (docs == docs[head]) & (start == start[head])
        name = t.span_hash(t.prefix_hash(buf), place, place + deep).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(deep.astype(np.int32)), pa.array(docs), pa.array(start.astype(np.int32)), pa.array(first)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for b in (batch.slice(i, 5000) for i in range(0, batch.num_rows, 5000)):
                if size >= ARRAY_BYTES:  # cut where the next group begins
                    anchors = b.column(0).to_numpy()
                    last = held[-1].column(0)[-1].as_py()
                    cut = int(np.argmax(np.append(anchors, last + 1 if last < 2**62 else last - 1) != last))
                    held.append(b.slice(0, cut))
                    if cut < b.num_rows:
                        yield scan(held)
                        held, size = [], 0
                    b = b.slice(cut)
                if b.num_rows:
                    held.append(b)
                    size += b.column(3).nbytes
        if held:
            yield scan(held)
        del held
        t.release()

    return strings.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, GROUPS if by_piece else "group long, length int, doc long, start int, first boolean")


def _hot_repeats(strings: DataFrame, length: int) -> DataFrame:
    """For the removal: string by string, the places of each string of ``length`` bytes that occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 5000) for i in range(0, batch.num_rows, 5000)):
                body = [x.as_buffer() for x in b.column(3)]
                buf = np.frombuffer(b"".join(body), np.uint8)
                size = np.array([x.size for x in body])
                counts = size - length + 1
                begin, bounds = np.cumsum(size) - size, np.concatenate(([0], np.cumsum(counts)))
                owner = np.repeat(np.arange(len(size)), counts)
                inner = np.arange(bounds[-1]) - bounds[owner]
                place = begin[owner] + inner
                name = t.span_hash(t.prefix_hash(buf), place, place + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), pa.array((b.column(2).to_numpy()[owner] + inner).astype(np.int32))], names=["group", "anchor", "doc", "start"])

    each = strings.mapInArrow(run, "group long, anchor long, doc long, start int")
    heads = each.groupBy("group", "anchor").agg(F.min(F.struct("doc", "start")).alias("head"), F.count("*").alias("times")).filter("times > 1")
    first = (F.col("doc") == F.col("head.doc")) & (F.col("start") == F.col("head.start"))
    return each.join(heads, ["group", "anchor"]).select("group", F.lit(length).alias("length"), "doc", "start", first.alias("first"))


def _hot_groups(strings: DataFrame, length: int) -> DataFrame:
    """As _repeats by piece, in groups of suffixes with equal first ``length`` bytes: sorted by Spark, scanned as they come."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                body = [x.as_py() for x in b.column(3)]
                size = np.array([len(x) for x in body])
                counts = size - length + 1
                begin, bounds = np.cumsum(size) - size, np.concatenate(([0], np.cumsum(counts)))
                buf = np.frombuffer(b"".join(body), np.uint8)
                owner = np.repeat(np.arange(len(size)), counts)
                inner = np.arange(bounds[-1]) - bounds[owner]
                place = begin[owner] + inner
                prefix = t.prefix_hash(buf)
                head = t.span_hash(prefix, place, place + length).view(np.int64)
                piece = t.span_hash(prefix, begin, begin + size).view(np.int64)[owner]
                before = np.where(inner > 0, buf[np.maximum(place - 1, 0)].astype(np.int32), -1).astype(np.int32)
                tails = [body[o][i:] for o, i in zip(owner.tolist(), inner.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(head), pa.array(piece), pa.array(inner.astype(np.int32)), pa.array(before), pa.array(tails, pa.binary())], names=["anchor", "head", "piece", "inner", "before", "suffix"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, inners, turns, stack = array("q"), array("i"), array("q"), []
        last, last_before = b"", -1

        def step(now: int, at: int, found: list) -> None:
            i = len(pieces)
            left = i - 1
            while stack and stack[-1][0] > now:
                depth, left = stack.pop()
                if turns[i - 1] != turns[left]:
                    found.append((depth, at, np.array(pieces[left:i]), np.array(inners[left:i])))
            if now and (not stack or stack[-1][0] < now):
                stack.append((now, left))

        def rows(buf: np.ndarray, found: list) -> pa.RecordBatch:
            depth, at = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            size = np.array([len(f[2]) for f in found])
            name = t.span_hash(t.prefix_hash(buf), at, at + depth).view(np.int64)
            cols = [np.repeat(name, size), np.repeat(depth.astype(np.int32), size), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found]).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["group", "length", "piece", "inner"])

        for batch in batches:
            for b in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                body = [last, *(x.as_py() for x in b.column(5))]
                sizes = np.array([len(x) for x in body])
                starts = (np.cumsum(sizes) - sizes).tolist()
                buf = np.frombuffer(b"".join(body), np.uint8)
                wide = int(sizes.max())
                table = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in body), np.uint8).reshape(-1, wide)
                differ = np.concatenate((table[1:] != table[:-1], np.ones((len(table) - 1, 1), bool)), 1)
                lcp = np.minimum(np.minimum(differ.argmax(1), sizes[1:]), sizes[:-1]).tolist()
                found: list = []
                for k, (piece, inner, before) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    now = lcp[k] if lcp[k] >= length else 0
                    step(now, starts[k], found)
                    if not now:
                        del pieces[:], inners[:], turns[:]
                    turns.append((turns[-1] + (before < 0 or before != last_before)) if turns else 0)
                    pieces.append(piece)
                    inners.append(inner)
                    last_before = before
                    if sum(len(f[2]) for f in found[-1:]) > 50_000 or len(found) > 2000:
                        yield rows(buf, found)
                        found = []
                last = body[-1]
                if found:
                    yield rows(buf, found)
        found = []
        step(0, 0, found)
        if found:
            yield rows(np.frombuffer(last, np.uint8), found)
        t.release()

    each = strings.mapInArrow(split, "anchor long, head long, piece long, inner int, before int, suffix binary")
    return each.repartition("anchor", "head").sortWithinPartitions("anchor", "head", "suffix").mapInArrow(scan, GROUPS)


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """All occurrences of the repeats, maximal within a piece: group, length, doc, start (byte), and whether the place is the group's first."""
    found, strings = _marked(docs, text, length, every=True)
    places = found.df.select("piece", "n", "doc", "lo").distinct()
    again = places.groupBy("piece").agg(F.count("*").alias("times")).filter("times > 1").select("piece")
    classes = places.join(again, "piece").select(F.col("piece").alias("group"), (F.col("n") + length - 1).alias("length"), "doc", F.col("lo").alias("start"))
    groups = _repeats(strings.filter(F.col("pieces") <= HOT).drop("pieces"), length, by_piece=True)
    if not found.df.filter((F.col("pieces") > HOT) & F.col("many") & ~F.col("copy")).isEmpty():
        groups = groups.unionByName(_hot_groups(strings.filter(F.col("pieces") > HOT).drop("pieces"), length))
    # a piece stands for its copies
    inside = groups.join(places, "piece").select("group", "length", "doc", (F.col("lo") + F.col("inner")).alias("start"))
    out = Stored(classes.unionByName(inside).distinct(), "repeats").df
    heads = out.groupBy("group").agg(F.min(F.struct("doc", "start")).alias("head"))
    first = (F.col("doc") == F.col("head.doc")) & (F.col("start") == F.col("head.start"))
    return out.join(heads, "group").select("group", "length", "doc", "start", first.alias("first"))


def _marked(docs: DataFrame, text: str, length: int, every: bool = False) -> tuple[Stored, DataFrame]:
    """The pieces, ``every`` one or those that the removal needs, and the texts of first places in groups of different pieces."""
    small_batches(docs.sparkSession)
    class_ = Window.partitionBy("anchor", "piece").orderBy("doc", "lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("anchor")
    marked = (
        _found(docs, text, length)
        .withColumn("head", F.first(F.struct("doc", "lo")).over(class_))
        .withColumn("many", F.min("piece").over(group) != F.max("piece").over(group))
        .withColumn("pieces", F.count("*").over(group))
        .withColumn("copy", F.col("copy") | (F.col("doc") != F.col("head.doc")) | (F.col("lo") != F.col("head.lo")))
    )
    names = ["anchor", "piece", "doc", "lo", "n", "copy", "pieces"]
    found = Stored(marked.select(*names, "many") if every else marked.filter("copy OR many").select(*names), "pieces")
    wanted = found.df.filter("NOT copy AND many" if every else "NOT copy").groupBy("doc").agg(F.collect_list(F.struct("anchor", "piece", "lo", "n", "pieces")).alias("p"))
    rows = docs.select(F.col("doc_id").alias("doc"), F.col(text).alias("text")).join(wanted, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids = b.column(0).to_numpy()
                lists = b.column(2)
                flat, bounds = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                cols = {f: flat.field(f).to_numpy() for f in ("anchor", "piece", "lo", "n", "pieces")}
                row = t.row_of(bounds)
                texts = [x.as_buffer() if x.is_valid else pa.py_buffer(b"") for x in b.column(1).cast(pa.large_binary())]
                sizes = np.array([x.size for x in texts], np.int64)
                base = np.cumsum(sizes) - sizes
                buf = b"".join(texts)
                size = cols["n"].astype(np.int64) + length - 1
                begin = base[row] + cols["lo"]
                # of rows that share a doc_id, those that hold the piece
                fits = cols["lo"] + size <= sizes[row]
                raw = np.frombuffer(buf, np.uint8)
                fits[fits] = t.span_hash(t.prefix_hash(raw), begin[fits], (begin + size)[fits]).view(np.int64) == cols["piece"][fits]
                keep = np.flatnonzero(fits)
                body = [buf[x:y] for x, y in zip(begin[keep].tolist(), (begin + size)[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols["anchor"][keep]), pa.array(ids[row[keep]]), pa.array(cols["lo"][keep]), pa.array(body, pa.binary()), pa.array(cols["pieces"][keep])], names=["anchor", "doc", "lo", "body", "pieces"])
        t.release()

    strings = rows.mapInArrow(cut, "anchor long, doc long, lo int, body binary, pieces long")
    return found, strings


def _later(docs: DataFrame, text: str, length: int) -> DataFrame:
    """doc, start and length of the repeats at later places, for the removal."""
    found, strings = _marked(docs, text, length)
    copies = found.df.filter("copy").select("doc", F.col("lo").alias("start"), (F.col("n") + length - 1).alias("length"))
    later = lambda df: df.filter("NOT first").select("doc", "start", "length")
    out = copies.unionByName(later(_repeats(strings.filter(F.col("pieces") <= HOT).drop("pieces"), length)))
    # only where there are such groups, so that others need no second pass
    if found.df.filter((F.col("pieces") > HOT) & ~F.col("copy")).isEmpty():
        return out
    return out.unionByName(later(_hot_repeats(strings.filter(F.col("pieces") > HOT).drop("pieces"), length)))


def _with_spans(docs: DataFrame, text: str, length: int) -> tuple[DataFrame, str]:
    """``docs`` and a new column, with its name: the repeats at later places, unmerged, by start; null if there are none."""
    doc, own, spans = fresh(docs, "__doc", "__id", "__spans")
    later = _later(docs, text, length).select(F.col("doc").alias(doc), F.struct("start", (F.col("start") + F.col("length")).alias("stop")).alias("s"))
    found = later.distinct().groupBy(doc).agg(F.sort_array(F.collect_list("s")).alias(spans))
    return docs.withColumn(own, F.col("doc_id")).join(found, F.col(own) == F.col(doc), "left").drop(own, doc), spans


def _kept(column: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes, int, int, int]]:
    """Per row: remaining bytes, bytes, removed bytes, maximal removed runs."""
    for x, s in zip(column.cast(pa.large_binary()), spans, strict=True):
        raw = x.as_py() or b""
        if not s.is_valid or not len(s):
            yield raw, len(raw), 0, 0
            continue
        start, stop = (s.values.field(f).to_numpy() for f in ("start", "stop"))
        far = np.maximum.accumulate(stop)
        new = np.concatenate(([True], start[1:] > far[:-1]))
        begin, end = start[new], far[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(far) - 1]))]
        parts = [raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True)]
        yield b"".join(parts), len(raw), int((end - begin).sum()), len(begin)


def apply(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without repeated passages in ``text``; the other columns stay, ``n_chars`` follows the text if there."""
    marked, spans = _with_spans(docs, text, length)
    names = marked.columns
    schema = marked.drop(spans).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index(text)
            old = b.column(at)
            left = [raw.decode("utf-8", "ignore") if gone else None for raw, _, gone, _ in _kept(old, b.column(names.index(spans)))]
            new = pa.array([x if x is not None else o.as_py() for x, o in zip(left, old, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text else c for n, c in zip(names, b.columns, strict=True) if n != spans], names=[n for n in names if n != spans])

    out = marked.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of all documents without repeated passages of 100 bytes and more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, gone, runs, hashlib.sha256(raw).hexdigest()) for raw, n, gone, runs in _kept(b.column(1), b.column(2))]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked, spans = _with_spans(docs, "text", LENGTH)
    return marked.select("doc_id", "text", spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
#: All strings of LENGTH bytes; for tables of some megabytes.
ORACLES = {
    "op10_suffix_dedup": f"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * LENGTH})) AS g, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g, m ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
        runs AS (
            SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
                SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM later)) GROUP BY doc_id, run
        ), gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
        rest AS (SELECT g.doc_id, string_agg(CASE WHEN g.b IS NULL THEN substr(h, 2 * g.a + 1) ELSE substr(h, 2 * g.a + 1, 2 * (g.b - g.a)) END, '' ORDER BY g.a) AS h FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
        gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, coalesce(gone.spans, 0) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
        FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN rest ON rest.doc_id = d.doc_id
    """
}
