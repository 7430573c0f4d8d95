"""Exact top-k search by inner product with a pivot table.

Every vector's distances to a fixed set of pivots are computed once. For a
query and a candidate the largest difference of their distances to a pivot is
a lower bound on their own distance, hence, with both norms, an upper bound on
the inner product. Candidates of a block are evaluated in the order of that
bound until no later one can reach the k best scores seen.

Candidates are dealt to blocks by their nearest pivot, large cells by hash besides. A
query is answered in its own block first; what it has there is its threshold
everywhere else. A block's smallest and largest distances to each pivot bound all
its candidates at once: a query goes on only to blocks that can reach its threshold.
Tasks hold one block of candidates and one block of queries, so memory does not grow
with the tables, and pass on at most k rows per query.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows of null vec_id; a query's candidates are the rows of other vec_ids and of its own
length; ties go to the smaller vec_id; repeated rows are candidates each, and one query; an
empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm._store import Stored

K, PIVOTS, PIVOT_SAMPLE = 20, 32, 1024
CANDIDATE_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 16
#: So many blocks' bounds (some 300 bytes each) are broadcast at once; more blocks are gone through in turns.
SUMMARY_BLOCKS = 200_000


def scaled(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x, as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: Column) -> Column:
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(ok, F.lit(False))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def pivots(vectors: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots far from each other, from the ``sample`` vectors of smallest hash (any choice gives the same results)."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    lists = [x for x in got.column("vector").to_pylist() if x]
    if not lists:
        return np.zeros((0, 0))
    width = max(map(len, lists))
    pool = np.array([x for x in lists if len(x) == width], np.float64)
    chosen, far = [0], np.full(len(pool), np.inf)
    while len(chosen) < min(n, len(pool)):
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return pool[chosen]


def _table(vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances to the pivots; no columns if the pivots are of another length."""
    if not at.size or at.shape[1] != vectors.shape[1]:
        return np.zeros((len(vectors), 0), np.float32)
    v = vectors.astype(np.float64)
    square = (v * v).sum(1)[:, None] - 2 * v @ at.T + (at * at).sum(1)[None]
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def _slack(*tables: np.ndarray) -> float:
    """More than the error of distances that are rounded to float32."""
    return 1e-5 * (1 + max(float(t.max(initial=0)) for t in tables))


def _reach(q2, c2, distance, slack: float):
    """An upper bound on the inner product of vectors with these squares at no less than this distance."""
    return (q2 + c2 - np.maximum(distance - slack, 0) ** 2) / 2 + 1e-6 * (1 + q2 + c2)


def search_block(q_ids, q, q_table, c_ids, c, c_table, k: int, least=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, candidate number and score of each query's k best candidates in a block.

    Candidates that cannot reach ``least``, each query's k-th score so far, are left out (nan: nothing known).
    """
    # sums that stay below the mantissa's range are exact
    most = float(abs(q).max(initial=0)) * float(abs(c).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    q2, c2 = (q.astype(float) ** 2).sum(1), (c.astype(float) ** 2).sum(1)
    slack = _slack(q_table, c_table)
    rows, hits, scores = [], [], []
    columns = np.ascontiguousarray(c_table.T)
    low, gap = np.empty(len(c), np.float32), np.empty(len(c), np.float32)
    for i in range(len(q)):
        low[:] = 0
        for p in range(len(columns)):
            np.subtract(columns[p], q_table[i, p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        bound = _reach(q2[i], c2, low.astype(np.float64), slack)
        bound[c_ids == q_ids[i]] = -np.inf
        floor = -np.inf if least is None or np.isnan(least[i]) else least[i]
        order = np.flatnonzero((bound >= floor) & (bound > -np.inf))
        order = order[np.argsort(-bound[order])]
        lead, got = order[:0], np.zeros(0, kind)
        at, size = 0, 4 * k
        while at < len(order) and bound[order[at]] >= floor:
            part = order[at : at + size]
            score = c[part] @ q[i]
            good = score >= floor
            lead, got = np.concatenate((lead, part[good])), np.concatenate((got, score[good]))
            best = np.lexsort((c_ids[lead], -got))[:k]
            lead, got = lead[best], got[best]
            if len(got) == k:
                floor = max(floor, got[-1])
            at, size = at + size, min(4 * size, 4096)
        rows.append(np.full(len(lead), i))
        hits.append(lead)
        scores.append(got)
    join = lambda x, d: np.concatenate(x).astype(d) if x else np.zeros(0, d)
    return join(rows, np.int64), join(hits, np.int64), join(scores, np.int64)


BLOCK = ("width", "cell", "sub")
HOME = "query_id long, vec_id long, score long, least long, width int, cell int, sub int, summary binary"
_HOME = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in HOME.split(","))])


def _tables(part) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("table").to_pylist()), np.float32).reshape(part.num_rows, -1)


def _at_home(k: int):
    """For a block: its own queries' k best, a row with each one's k-th score, and the block's bounds."""

    def run(key, block):
        ids, vectors, table = block.column("vec_id").to_numpy(), _matrix(block.column("vector")), _tables(block)
        asks = np.flatnonzero(block.column("query").to_numpy(zero_copy_only=False))
        _, once = np.unique(np.column_stack((ids[asks], vectors[asks])), axis=0, return_index=True)
        asks = asks[once]
        i, j, s = search_block(ids[asks], vectors[asks], table[asks], ids, vectors, table, k)
        full = np.bincount(i, minlength=len(asks)) >= k
        least = np.full(len(asks), np.iinfo(np.int64).max)
        np.minimum.at(least, i, s)
        most = (vectors.astype(float) ** 2).sum(1).max()
        summary = np.concatenate((table.min(0), table.max(0))).astype("<f4").tobytes() + np.float64(most).tobytes()
        # hits, then the queries, then the block
        n = len(i) + len(asks) + 1
        gone = lambda x, before, after: pa.concat_arrays([pa.nulls(before, x.type), x, pa.nulls(after, x.type)])
        cols = [
            gone(pa.array(np.concatenate((ids[asks][i], ids[asks]))), 0, 1),
            gone(pa.array(ids[j]), 0, len(asks) + 1),
            gone(pa.array(s), 0, len(asks) + 1),
            gone(pa.array(least, mask=~full), len(i), 1),
            *(pa.array([x.as_py()] * n, pa.int32()) for x in key),
            gone(pa.array([summary], pa.binary()), n - 1, 0),
        ]
        return pa.Table.from_arrays(cols, schema=_HOME)

    return run


def _goes_on(shared):
    """For queries: a row per block, other than their own, that can reach their threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, low, high, most = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own = np.stack([b.column(n).to_numpy() for n in BLOCK], 1)
            least = b.column("least").cast(pa.float64()).to_numpy(zero_copy_only=False)
            rows, to = [], []
            for i, (vector, table) in enumerate(zip(b.column("vector"), b.column("table").to_pylist(), strict=True)):
                q2 = float((np.asarray(vector.values.to_numpy(zero_copy_only=False), float) ** 2).sum())
                t = np.frombuffer(table, np.float32)
                may = (keys[:, 0] == own[i, 0]) & (keys != own[i]).any(1)
                if len(t) and low.shape[1] == len(t):
                    far = np.maximum(np.maximum(low - t, t - high), 0).max(1).astype(float)
                    reach = _reach(q2, most, far, _slack(t, high[may]))
                    if not np.isnan(least[i]):
                        may &= reach >= least[i]
                rows.append(np.full(int(may.sum()), i))
                to.append(np.flatnonzero(may))
            rows, to = np.concatenate(rows), np.concatenate(to)
            for x in range(0, len(rows), 20_000):
                r, t = pa.array(rows[x : x + 20_000]), keys[to[x : x + 20_000]]
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(r) for n in ("vec_id", "vector", "table", "least", "part")), *(pa.array(t[:, c].astype(np.int32)) for c in range(3))], names=["vec_id", "vector", "table", "least", "part", *BLOCK])

    return run


def _elsewhere(k: int):
    """For a block and queries that may have some of their best in it: their k best there."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left, right):
        if not right.num_rows or not left.num_rows:
            return out.empty_table()
        q_ids, c_ids = right.column("vec_id").to_numpy(), left.column("vec_id").to_numpy()
        least = right.column("least").cast(pa.float64()).to_numpy()
        i, j, s = search_block(q_ids, _matrix(right.column("vector")), _tables(right), c_ids, _matrix(left.column("vector")), _tables(left), k, least)
        return pa.Table.from_arrays([pa.array(q_ids[i]), pa.array(c_ids[j]), pa.array(s)], schema=out)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query row.

    ``vectors`` has vec_id and vector (array of bigint without nulls); ``is_query`` selects the queries.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter("vec_id IS NOT NULL")
    at = spark.sparkContext.broadcast(pivots(vectors, n_pivots))
    flagged = vectors.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("query"))

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            tables: list = [None] * b.num_rows
            cells = np.zeros(b.num_rows, np.int32)
            for w in np.unique(widths):
                mine = np.flatnonzero(widths == w)
                got = _table(_matrix(b.column(1).take(pa.array(mine))), at.value)
                if got.shape[1]:
                    cells[mine] = got.argmin(1)
                for i, row in zip(mine, got, strict=True):
                    tables[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(widths, pa.int32()), pa.array(cells), pa.array(tables, pa.binary())], names=["vec_id", "vector", "query", "width", "cell", "table"])

    rows = Stored(flagged.mapInArrow(tabled, "vec_id long, vector array<bigint>, query boolean, width int, cell int, table binary"), "vectors")
    # a row per length and pivot
    cells = rows.df.groupBy("width", "cell").agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).alias("subs"))
    placed = rows.df.join(F.broadcast(cells), ["width", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "vector"), F.col("subs")).cast("int")).drop("subs")
    home = Stored(placed.repartition(*BLOCK).groupBy(*BLOCK).applyInArrow(_at_home(k), HOME), "home")
    found = home.df.filter("vec_id IS NOT NULL").select("query_id", "vec_id", "score")
    blocks = home.df.filter("summary IS NOT NULL").select(*BLOCK, "summary")
    n, nq = blocks.count(), home.df.filter("query_id IS NOT NULL AND vec_id IS NULL").count()
    turns, groups = max(1, -(-n // SUMMARY_BLOCKS)), max(1, -(-nq // QUERY_BLOCK))
    states = home.df.filter("query_id IS NOT NULL AND vec_id IS NULL").select(F.col("query_id").alias("vec_id"), *BLOCK, "least")
    asking = placed.filter("query").dropDuplicates(["vec_id", "vector"]).join(states, ["vec_id", *BLOCK])
    asking = asking.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(groups)).cast("int"))
    candidates = placed.select("vec_id", "vector", "table", *BLOCK, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    keys = (*BLOCK, "part")
    for turn in range(turns):
        got = blocks.filter(F.pmod(F.xxhash64(*BLOCK), F.lit(turns)) == turn).toArrow() if turns > 1 else blocks.toArrow()
        shared = spark.sparkContext.broadcast(_bounds(got))
        going = asking.select("vec_id", "vector", "table", "least", "part", *BLOCK).mapInArrow(_goes_on(shared), "vec_id long, vector array<bigint>, table binary, least long, part int, width int, cell int, sub int")
        found = found.unionByName(candidates.groupBy(*keys).cogroup(going.groupBy(*keys)).applyInArrow(_elsewhere(k), "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(blocks: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, smallest and largest distances, and largest squares of blocks."""
    keys = np.column_stack([blocks.column(n).to_numpy() for n in BLOCK]) if blocks.num_rows else np.zeros((0, 3), np.int64)
    got = [x.as_py() for x in blocks.column("summary")]
    pivots = max((len(x) - 8 for x in got), default=0) // 8
    low, high = np.zeros((len(got), pivots), np.float32), np.full((len(got), pivots), np.float32(np.inf))
    for i, x in enumerate(got):
        if len(x) - 8 == 8 * pivots:  # a block of another vector length has no distances: nothing is known of it
            low[i], high[i] = np.frombuffer(x, "<f4", 2 * pivots).reshape(2, -1)
    return keys, low, high, np.array([np.frombuffer(x[-8:])[0] for x in got])


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return search(rows.select("vec_id", scaled(F.col("embedding")).alias("vector")), F.col("vec_id") % 20 == 0)


QUERIES = {"op2_top_k": op2_top_k}
ORACLES = {
    "op2_top_k": """
        WITH v AS (
            SELECT vec_id, u.i AS i, CAST(floor(64 * CAST(embedding[u.i] AS DOUBLE)) AS BIGINT) AS x
            FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
            GROUP BY q.vec_id, c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
}
