"""Nearest neighbours by a block matrix join.

Queries and candidates are packed into blocks. A tile multiplies an int8 block of queries with an int8 block of candidates;
with the norms of the quantisation errors, each product gives a lower and an upper bound of the true distance. Pairs whose
lower bound exceeds the query's tenth smallest upper bound, or the tenth distance found so far, can't be neighbours; the
others are computed again from the original vectors in double precision. Each task keeps one heap per query of its group,
and the tasks' heaps are merged in the end. So the search is exact: no neighbour is lost to quantisation.

The blocks form a grid: a cell is one group of queries, of a bounded size, against one group of candidate blocks, and is one
task. The task holds its queries and lets the candidates pass by. Bounds are worked out in units of a power of two near the
blocks' largest component, so that neither huge nor tiny vectors leave the range of doubles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumery.llm.common import materialise, table

QUERY_BLOCK, BLOCK, BLOCK_BYTES = 1024, 2048, 1 << 20
#: A task holds about so many queries, and meets at most about so many candidate blocks.
QUERY_GROUP, CELL_BLOCKS = 16_384, 128


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v array<double>) of rows with an id and a vector that is not null, zero, or with null or non-finite parts."""
    v = F.col("embedding").cast("array<double>")
    return (
        vectors.select("vec_id", v.alias("v"))
        .where("vec_id is not null and v is not null and size(v) > 0")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
        .select("vec_id", F.size("v").alias("dim"), "v")
    )


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack usable() rows into blocks of up to ``size`` vectors (and BLOCK_BYTES) of one dimension: part (the partition's number), seq (the block's
    number there), dim, and ids and vecs as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        part, closed = TaskContext.get().partitionId(), 0

        def close(dim: int) -> pa.RecordBatch:
            nonlocal closed
            own, closed = held.pop(dim), closed + 1
            ids, vecs = np.array([i for i, _ in own], "<i8"), np.array([v for _, v in own], "<f8")
            numbers = [pa.array([x], pa.int32()) for x in (part, closed, dim)]
            return pa.RecordBatch.from_arrays([*numbers, pa.array([ids.tobytes()]), pa.array([vecs.tobytes()])], names=["part", "seq", "dim", "ids", "vecs"])

        for batch in batches:
            values = batch.column(2)
            flat, at = np.asarray(values.flatten()), 0
            for i, dim in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(dim, []).append((i, flat[at : at + dim]))
                at += dim
                if len(held[dim]) >= max(1, min(size, BLOCK_BYTES // (8 * dim))):
                    yield close(dim)
        for dim in list(held):
            yield close(dim)

    return rows.mapInArrow(run, "part int, seq int, dim int, ids binary, vecs binary")


class Quantised:
    """int8 codes with one scale per vector, and the exact norm of what the codes leave out, in units of a power of two."""

    def __init__(self, vecs: np.ndarray):
        self.unit = int(np.frexp(np.abs(vecs).max())[1]) - 1
        vecs = np.ldexp(vecs, -self.unit)  # below 2; what vanishes is too small to count beside the largest
        self.scale = np.abs(vecs).max(1) / 127
        codes = np.clip(np.rint(vecs / np.where(self.scale > 0, self.scale, 1)[:, None]), -127, 127)
        near = codes * self.scale[:, None]
        self.error = np.linalg.norm(vecs - near, axis=1)
        self.norm, self.near_norm = np.linalg.norm(vecs, axis=1), np.linalg.norm(near, axis=1)
        # Products of int8 are whole numbers that float32 holds exactly for some 1000 parts, so the fast product may be used.
        self.codes = codes.astype(np.float32 if vecs.shape[1] * 127 * 127 < 1 << 24 else np.float64)


#: What rounding of numbers below the normal range may take from a square, with much to spare.
TINY = 1e-290


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray, int]:
    """Lower and upper bounds of the squared distances of all pairs of a tile, in units of 2^(2 unit), and unit."""
    unit = max(q.unit, c.unit)
    a, b = float(np.ldexp(1.0, q.unit - unit)), float(np.ldexp(1.0, c.unit - unit))
    dot = (q.codes @ c.codes.T).astype(np.float64) * (q.scale * a)[:, None] * (c.scale * b)[None, :]
    slack = 2 * ((q.error * a)[:, None] * (c.norm * b)[None, :] + (q.near_norm * a)[:, None] * (c.error * b)[None, :])
    squares = ((q.norm * a) ** 2)[:, None] + ((c.norm * b) ** 2)[None, :]
    middle = squares - 2 * dot
    slack += 1e-9 * squares + TINY  # rounding of these sums themselves
    return middle - slack, middle + slack, unit


def distances(query: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed part by part in order; once more in other units where squares leave the range."""
    total = np.zeros(len(vecs))
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for k in range(len(query)):
            d = query[k] - vecs[:, k]
            total += d * d
        out = np.sqrt(total)
        odd = np.flatnonzero(~((total > 1e-280) & (total < np.inf)) & (vecs != query).any(1))
        if len(odd):
            unit = np.maximum(np.abs(vecs[odd]).max(1), np.abs(query).max())
            least = np.abs(query[None, :] / 2 - vecs[odd] / 2).max(1)  # half, as the difference itself may be out of range
            unit = np.where(total[odd] < 1, np.where(least > 0, least, unit), unit)
            d = query[None, :] / unit[:, None] - vecs[odd] / unit[:, None]
            out[odd] = np.sqrt((d * d).sum(1)) * unit
    return out


def search_tile(q_ids, q_vecs, q, c_ids, c_vecs, c, k: int, heaps: dict[int, list]) -> None:
    """Update each query's heap of (-distance, -vec_id) with the candidates of a tile."""
    low, high, unit = bounds(q, c)
    ids, repeated = c_ids, False
    if len(np.unique(c_ids)) < len(c_ids):  # one least upper bound per vec_id
        order, repeated = np.argsort(c_ids, kind="stable"), True
        ids, starts = np.unique(c_ids[order], return_index=True)
        high = np.minimum.reduceat(high[:, order], starts, axis=1)
    for n, own in enumerate(q_ids.tolist()):
        heap = heaps.setdefault(own, [])
        other = c_ids != own
        limit = np.inf
        if len(heap) == k:
            with np.errstate(over="ignore"):
                limit = np.square(np.ldexp(-heap[0][0], -unit)) * (1 + 1e-9) + TINY
        least = high[n][ids != own]
        if len(least) > k:
            limit = min(limit, np.partition(least, k - 1)[k - 1])
        near = np.flatnonzero(other & (low[n] <= limit))
        if not len(near):
            continue
        d = distances(q_vecs[n], c_vecs[near])
        if len(near) > k:
            by_distance = np.lexsort((c_ids[near], d))
            if repeated:  # the nearest row of each vec_id
                by_distance = by_distance[np.sort(np.unique(c_ids[near][by_distance], return_index=True)[1])]
            near = near[by_distance[: k + 1]]
            d = d[by_distance[: k + 1]]
        for dist, i in zip(d.tolist(), c_ids[near].tolist(), strict=True):
            entry = (-dist, -i)
            if any(e[1] == -i for e in heap):
                old = next(e for e in heap if e[1] == -i)
                if entry > old:
                    heap[heap.index(old)] = entry
                    heapq.heapify(heap)
            elif len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, n_tasks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of vectors nearest to each row of queries, ties to the smaller vec_id.

    Both have vec_id and embedding. A query's own vec_id is no candidate of its; vectors of another length aren't either.
    Unusable vectors take no part. A repeated vec_id counts once: the nearest of its vectors as candidate, the smallest as query.
    Fewer candidates than k give fewer rows; an empty table gives none. Each query group is copied to every group of
    candidates and the other way round; nothing is broadcast. A task holds one query group and one candidate block; vectors so long
    that few make BLOCK_BYTES are in blocks of few, of one at least.
    """
    n_tasks = n_tasks or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = materialise(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v"))
    n_queries = max(1, -(-asked.count() // QUERY_GROUP))
    q = blocks(asked.repartition(n_queries, "vec_id"), QUERY_BLOCK).withColumnRenamed("part", "of_queries")
    c = materialise(blocks(usable(vectors), BLOCK))
    n_blocks = c.count()
    n_groups = max(1, min(n_blocks, max(-(-n_tasks // n_queries), -(-n_blocks // CELL_BLOCKS))))
    c = c.withColumn("of_candidates", F.pmod(F.col("part") + F.col("seq"), F.lit(n_groups)))

    def copied(df: DataFrame, name: str, copies: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    block = ["dim", "ids", "vecs"]
    cell = (F.col("of_queries") * F.lit(n_groups) + F.col("of_candidates")).alias("cell")
    grid = copied(materialise(q), "of_candidates", n_groups).select(cell, F.lit(False).alias("passes"), *block)
    grid = grid.unionByName(copied(c, "of_queries", n_queries).select(cell, F.lit(True).alias("passes"), *block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heaps, held = None, {}, []
        for batch in batches:
            for cell, passes, dim, ids, vecs in zip(*(batch.column(n) for n in range(5)), strict=True):
                if cell != at:
                    yield emptied(heaps)
                    at, held = cell, []
                dim, v = dim.as_py(), np.frombuffer(vecs.as_py(), "<f8")
                v = v.reshape(-1, dim)
                own = (np.frombuffer(ids.as_py(), "<i8"), v, Quantised(v))
                if passes.as_py():
                    for query_dim, query in held:
                        if query_dim == dim:
                            search_tile(*query, *own, k, heaps)
                else:
                    held.append((dim, own))
        yield emptied(heaps)

    def emptied(heaps: dict[int, list]) -> pa.RecordBatch:
        rows = [(i, -v, -d) for i, heap in heaps.items() for d, v in heap]
        heaps.clear()
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    dealt = grid.repartitionByRange(n_queries * n_groups, "cell").sortWithinPartitions("cell", "passes")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    # At most k rows of a query come from each group of candidates.
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = {
    "op2_neighbours": r"""
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
}
