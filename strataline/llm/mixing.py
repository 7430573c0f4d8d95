"""Mixing sources to target weights by fitting word budgets.

``targets`` shares the whole budget over the sources by weight; a source's
target stops at a multiple of its size and the excess goes to the others.
``mix`` takes each source whole as often as its target allows and fits the rest:
documents are counted by exact length, each length gives its share, and
bounded-knapsack dynamic programming over what is left closes the remaining
budget to the word where any choice of documents can. Which documents of a
length are taken is decided by a seeded hash, so that reruns agree.

Texts are split into words once: ids, sources and sizes go to a table in the shared
folder. Documents meet the plan of their length by broadcast while the plan has at
most ``BROADCAST_CELLS`` lengths; ranks are taken within groups of a length, and the
groups are what rows are dealt by, so that a length of very many documents is no
task's load. The targets are found among one row per source, in one task.

Defined cases: a null or empty text has size 0 and nothing of it is taken; a
null source is a source of its own, after all others; repeated rows are
documents of their own in ``mix``, while ``apply`` gives rows of one doc_id the
same number of copies; ties in the hash go by doc_id; an empty table gives an
empty mix; extra columns pass through ``apply`` whatever their names and are dropped
by ``mix``; a text counts whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm import _text as t
from strataline.llm._store import Stored, fresh, small_batches

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 17
#: The dynamic programme runs over budgets up to so many words; larger rests are first closed by lengths in seeded order.
TABLE = 1 << 16
#: Documents of one source and length are ranked in groups of about so many.
GROUP = 512
#: Up to so many lengths (some 64 bytes each) the plan is broadcast.
BROADCAST_CELLS = 500_000


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, ``key`` (the source, never null) and size (words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [t.words(c).counts for c in t.chunks(b.column(2))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])
        t.release()

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "source", F.col(text).alias("text")).mapInArrow(run, "doc_id long, source string, size long")
    return rows.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source_size and target of each source, from rows with key, source and size.

    With the sources ordered by cap for a unit of weight, the level to which all
    uncapped ones rise is what is left after the caps before it, for each weight left.
    The windows are over one row per source.
    """
    by = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("limit", "key")
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        by.withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("limit", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("limit"), F.col("level"))).over(every))
        .select("key", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), "cap")).alias("target"))
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length (all above 0) to take so that their words come to ``budget`` or as near below as found."""
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    take = np.array([int(n) * budget // total for n in counts.tolist()], np.int64)
    left, rest = budget - int(take @ lengths), counts - take
    order = np.argsort(t.mix(lengths.astype(np.uint64) + np.uint64(seed)), kind="stable")
    while left > TABLE:
        usable = order[(rest[order] > 0) & (lengths[order] <= left)]
        if not len(usable):
            return take
        fits = usable[np.cumsum(lengths[usable]) <= left]
        chosen = fits if len(fits) else usable[:1]
        take[chosen] += 1
        rest[chosen] -= 1
        left -= int(lengths[chosen].sum())
    # subset sums of what is left: counts split into powers of two, each part used or not
    reach, by = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64)
    reach[0] = True
    parts: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable").tolist():
        n, size, step = int(min(rest[i], left // lengths[i])), int(lengths[i]), 1
        while n > 0 and not reach[left]:
            k = min(step, n)
            new = np.flatnonzero(reach[: left + 1 - k * size]) + k * size
            new = new[~reach[new]]
            reach[new] = True
            by[new] = len(parts)
            parts.append((i, k))
            n -= k
            step *= 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = parts[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) of every row."""
    rows = Stored(sized(docs, text), "sizes").df
    cells = rows.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    per_source = targets(cells.withColumn("size", F.col("size") * F.col("n")), weights, share, most)

    def plan(cell: pa.Table) -> pa.Table:
        """One source: its whole passes, and what each length gives beyond them."""
        cell = cell.sort_by("size")
        size, target = cell.column("source_size")[0].as_py(), cell.column("target")[0].as_py()
        full = min(int(target // size), most) if size else 0
        lengths, counts = (cell.column(c).to_numpy() for c in ("size", "n"))
        some = lengths > 0
        extra = np.zeros(len(lengths), np.int64)
        if full < most and some.any():
            extra[some] = fit(lengths[some], counts[some], round(target - full * size), seed)
        return cell.append_column("full", pa.array([full] * len(extra), pa.int32())).append_column("extra", pa.array(extra))

    plans = cells.join(per_source, "key").select("key", "size", "n", "source_size", "target").groupBy("key").applyInArrow(plan, "key string, size long, n long, source_size long, target double, full int, extra long")
    plans = Stored(plans, "plans").df
    drawn = rows.join(F.broadcast(plans) if plans.count() <= BROADCAST_CELLS else plans, ["key", "size"]).withColumn("hash", F.xxhash64("doc_id", F.lit(seed)))
    drawn = drawn.withColumn("group", F.pmod("hash", F.ceil(F.col("n") / GROUP)))
    drawn = drawn.select("doc_id", "key", "size", "source_size", "target", "full", "extra", "hash", "group")
    groups = drawn.groupBy("key", "size", "group").agg(F.count("*").alias("m"))
    # one row per group, a 512th of a length's documents
    ahead = Window.partitionBy("key", "size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("key", "size", "group", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("offset")).filter("offset > 0")
    rank = F.coalesce("offset", F.lit(0)) + F.row_number().over(Window.partitionBy("key", "size", "group").orderBy("hash", "doc_id"))
    copies = F.when(F.col("size") > 0, F.col("full") + (rank <= F.col("extra")).cast("int")).otherwise(0)
    return (
        drawn.repartition("key", "size", "group")
        .join(offsets, ["key", "size", "group"], "left")
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken."""
    count, own, match, copy = fresh(docs, "__copies", "__id", "__match", "__copy")
    copies = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias(count)).withColumnRenamed("doc_id", match)
    rows = docs.withColumn(own, F.col("doc_id")).join(copies, F.col(own).eqNullSafe(F.col(match)))
    return rows.filter(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*[rows[c] for c in docs.columns])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_source_mix": op8_source_mix}
ORACLES: dict[str, str] = {}
