"""Connected components of links between integers, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm._store import Stored


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node joined to each by these links; nodes joined to none but themselves are left out."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, np.int64)
    while (nxt := root[root]).tolist() != root.tolist():
        root = nxt
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]]


def _forest(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: every run of rows by its own union-find."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            node, root = union_find(p.column(0).to_numpy(), p.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(node, pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of ``links`` (a, b: long, not null)."""
    return labelled(links).df


def labelled(links: DataFrame) -> Stored:
    """As ``components``, as a table that the caller drops.

    Each round thins the links by union-find within partitions, hooks every node to
    its smallest neighbour, follows that once more and contracts the links. The rounds
    end when no link is left; a component of n nodes takes about log n rounds.
    """
    edges = Stored(_forest(links.filter("a <> b")), "links")
    labels: Stored | None = None
    while not edges.df.isEmpty():
        e = edges.df
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("label"))
        step = Stored(hook.join(far, "to").select("node", "label"), "hooks")
        left, right = step.df.toDF("a", "x"), step.df.toDF("b", "y")
        rest = e.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        nxt = Stored(_forest(rest), "links")
        if labels is None:
            labels = step
        else:
            moved = step.df.toDF("label", "to")
            new = Stored(labels.df.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            labels.drop()
            step.drop()
            labels = new
        edges.drop()
        edges = nxt
    if labels is None:
        edges.df = edges.df.select(F.col("a").alias("node"), F.col("b").alias("label"))
        return edges
    edges.drop()
    return labels
