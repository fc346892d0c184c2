"""Ranked lexical search: exact inner products of sparse vectors, found in ball trees of documents.

A document is the vector of its terms' scores, an item the vector of its terms' counts; the score is their inner product. Only
terms of the items matter, so a document's vector is cut down to these when its text is read, once, where it lies. Each task
puts runs of documents into ball trees. A node is a ball around its documents' mean, in a metric that measures each term by the
node's largest distance along it, so terms that the node's documents don't have, or all have alike, don't widen it. No document
of a node can score more than the item's product with the mean plus the item's length, in the dual metric, times the radius.
Nodes are taken best bound first, and once the best bound left is below the k-th score found, the tree is done. Bounds are in floating point and rounded up; scores at the leaves are
sums of 64-bit integers, so results are exact and ties are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumery.llm.common import LOWER, UPPER, materialise, small_batches, table

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, LOWER)
#: Bytes of item texts that are searched for in one pass, documents and vector entries of a tree, documents of a leaf.
BLOCK_BYTES, TREE_DOCS, TREE_TERMS, LEAF_DOCS = 16 << 20, 16_384, 2 << 20, 32
NO_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, A-Z lower-cased; null has none."""
    text = text or ""
    return TERM.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """(item_id, text) of items in blocks of about that size, which is measured first; by hash of the text, one read at a time."""
    rows = items.select("item_id", "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // block_bytes) or 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else rows
        yield [tuple(r) for r in own.collect()]


def vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row of docs: all its terms counted, and how often it has those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                for term, tf in Counter(words).items():
                    if (k := number.get(term)) is not None:
                        terms.append(k)
                        tfs.append(tf)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Of vectors(): each term's weight, the number of documents with a term, and all terms of all documents."""
    n_docs, all_terms = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = np.zeros(n_terms, np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most n_terms rows
        w[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return w, int(n_docs), int(all_terms)


# --- ball trees -------------------------------------------------------------------------------------------------------


@dataclass
class Rows:
    """Sparse rows: entries of row k are at starts[k] to starts[k + 1]."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], sizes)
        return Rows(self.ids[rows], starts, self.terms[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Each row's product with a dense vector; no row is empty."""
        return np.add.reduceat(dense[self.terms] * self.values, self.starts[:-1])


class BallTree:
    """Nodes over rows put in such an order that each node is a range of them; parted along the line of two means, from two far rows."""

    def __init__(self, rows: Rows, n_terms: int, leaf_docs: int = LEAF_DOCS) -> None:
        self.ranges: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        radii, centres, order = [], [], []
        squares = np.add.reduceat(rows.values.astype(float) ** 2, rows.starts[:-1])
        todo = [(np.arange(len(rows.ids)), 0, -1)]
        while todo:
            own, at, parent = todo.pop()
            node = len(self.ranges)
            self.ranges.append((at, at + len(own)))
            self.kids.append(None)
            if parent >= 0:
                self.kids[parent] = (*(self.kids[parent] or ()), node)
            part = rows.take(own)
            centre = np.bincount(part.terms, part.values, n_terms) / len(own)
            # Distances are in a metric of the node's own: along a term, by the largest one of its rows.
            off = part.values - centre[part.terms]
            spread = np.where(np.bincount(part.terms, minlength=n_terms) < len(own), centre, 0.0)  # rows without a term are so far off
            np.maximum.at(spread, part.terms, np.abs(off))
            scale = np.divide(1.0, spread, out=np.zeros(n_terms), where=spread > 0)
            base = float(centre**2 @ scale)
            squared = base + np.add.reduceat((off * off - centre[part.terms] ** 2) * scale[part.terms], part.starts[:-1])
            # Differences of squares lose digits; what they may lose is added, so a radius is never too small.
            radii.append(math.sqrt(max(float(squared.max()), 0) + 1e-9 * (base + float(np.abs(squared).max()))))
            some = np.flatnonzero(centre)
            centres.append((some, np.full(len(some), node), centre[some], spread[some]))
            if len(own) <= leaf_docs:
                order.append((at, own))
                continue
            one = self._dense(part, int((squares[own] - 2 * part.dot(centre)).argmax()), n_terms)
            two = self._dense(part, int((squares[own] - 2 * part.dot(one)).argmax()), n_terms)
            along = part.dot(one - two) - (one @ one - two @ two) / 2
            for _ in range(2):  # towards two means
                first = along > 0
                if first.all() or not first.any():
                    break
                one, two = (np.bincount(x.terms, x.values, n_terms) / len(x.ids) for x in (part.take(np.flatnonzero(first)), part.take(np.flatnonzero(~first))))
                along = part.dot(one - two) - (one @ one - two @ two) / 2
            halves = np.argsort(along, kind="stable")
            half = int(np.clip((along <= 0).sum(), len(own) // 8, len(own) - len(own) // 8))  # so it isn't deep
            todo.append((own[halves[:half]], at, node))
            todo.append((own[halves[half:]], at + half, node))
        self.rows = rows.take(np.concatenate([own for _, own in sorted(order, key=lambda x: x[0])]))
        self.radii = np.array(radii)
        terms, self.nodes, self.centres, self.spreads = (np.concatenate(x) for x in zip(*centres, strict=True))
        by_term = np.argsort(terms, kind="stable")
        self.nodes, self.centres, self.spreads = self.nodes[by_term], self.centres[by_term], self.spreads[by_term]
        self.starts = np.searchsorted(terms[by_term], np.arange(n_terms + 1))

    @staticmethod
    def _dense(part: Rows, k: int, n_terms: int) -> np.ndarray:
        out = np.zeros(n_terms)
        own = slice(part.starts[k], part.starts[k + 1])
        out[part.terms[own]] = part.values[own]
        return out

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each node, what no row of it can exceed; rounded up by far more than the sums can lose."""
        out, squares = np.zeros(len(self.radii)), np.zeros(len(self.radii))
        for t, c in zip(terms.tolist(), counts.tolist(), strict=True):
            own = slice(self.starts[t], self.starts[t + 1])
            out[self.nodes[own]] += c * self.centres[own]
            squares[self.nodes[own]] += c * c * self.spreads[own]
        return (out + np.sqrt(squares) * self.radii) * (1 + 1e-9) + 1

    def search(self, terms: np.ndarray, counts: np.ndarray, dense: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Puts rows into best, a heap of (score, -id) of the k first by score and smallest id; how many leaves were scored.

        dense has the item's counts by term.
        """
        bounds = self.bounds(terms, counts).tolist()
        todo, scored = [(-bounds[0], 0)], 0
        while todo:
            bound, node = heappop(todo)
            if len(best) == k and -bound < best[0][0]:
                break
            if (kids := self.kids[node]) is not None:
                for kid in kids:
                    at_most = min(-bound, bounds[kid])
                    if len(best) < k or at_most >= best[0][0]:
                        heappush(todo, (-at_most, kid))
                continue
            scored += 1
            a, b = self.ranges[node]
            first, last = self.rows.starts[a], self.rows.starts[b]
            scores = np.add.reduceat(dense[self.rows.terms[first:last]] * self.rows.values[first:last], self.rows.starts[a:b] - first)
            good = np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1))
            for score, doc_id in zip(scores[good].tolist(), self.rows.ids[a + good].tolist(), strict=True):
                if len(best) < k:
                    heappush(best, (score, -doc_id))
                elif (score, -doc_id) > best[0]:
                    heapreplace(best, (score, -doc_id))
        return scored


def _trees(batches: Iterator[pa.RecordBatch], w: np.ndarray, n_docs: int, all_terms: int) -> Iterator[BallTree]:
    """Ball trees over runs of (doc_id, n, terms, tfs) rows; rows without a scoring term are in none, as they score nothing."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = entries = 0

    def tree() -> BallTree:
        ids, sizes, terms, values = (np.concatenate(x) for x in zip(*held, strict=True))
        return BallTree(Rows(ids, np.concatenate(([0], np.cumsum(sizes))), terms, values), len(w))

    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            ids = part.column(0).fill_null(NO_ID).to_numpy()
            n = part.column(1).to_numpy()
            sizes = np.diff(part.column(2).offsets.to_numpy()).astype(np.int64)
            terms, tfs = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
            m = np.repeat(75 + 25 * n * n_docs // max(all_terms, 1), sizes)
            values = w[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m))
            some = values > 0
            sizes = np.bincount(np.repeat(np.arange(len(part)), sizes)[some], minlength=len(part))
            if some.any():
                held.append((ids[sizes > 0], sizes[sizes > 0], terms[some], values[some]))
                docs += len(held[-1][0])
                entries += len(held[-1][2])
            if docs >= TREE_DOCS or entries >= TREE_TERMS:
                yield tree()
                held, docs, entries = [], 0, 0
    if held:
        yield tree()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k first of each query among what tasks found; first those of a few tasks, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("query", "_of").orderBy(*order)
    every = Window.partitionBy("query").orderBy(*order)
    found = found.withColumn("_of", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return found.drop("_of").withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k first documents of each row of items, with a score above 0.

    Counts are over all documents. Null and empty texts have no terms and are found by none; an item without terms finds nothing;
    items with a repeated id are each ranked by themselves, one with a null id too. Equal scores are ordered by doc_id, a null one
    last; repeated rows each count and rank. Texts of any length are read whole, one at a time; an empty table gives no row.
    Other columns play no part. Items are read in blocks of a measured size, and each block is one pass over the texts.
    """
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, block_bytes):
        queries = [Counter(terms_of(text)) for _, text in block]
        vocabulary = {t: n for n, t in enumerate(sorted({t for q in queries for t in q}))}
        found = materialise(vectors(docs, vocabulary))
        w, n_docs, all_terms = weights(found, len(vocabulary))
        asked = [(np.array([vocabulary[t] for t in q], np.int64), np.array(list(q.values()), np.int64)) for q in queries]
        shared = spark.sparkContext.broadcast((asked, w))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, all_terms=all_terms) -> Iterator[pa.RecordBatch]:
            asked, w = shared.value
            best: list[list[tuple[int, int]]] = [[] for _ in asked]
            dense = np.zeros(len(w), np.int64)
            for tree in _trees(batches, w, n_docs, all_terms):
                for (terms, counts), heap in zip(asked, best, strict=True):
                    if len(terms):
                        dense[terms] = counts
                        tree.search(terms, counts, dense, heap, k)
                        dense[terms] = 0
            for at in range(0, len(best), 1000):
                rows = [(at + q, None if -i == NO_ID else -i, s) for q, heap in enumerate(best[at : at + 1000]) for s, i in heap]
                columns = zip(*rows, strict=True) if rows else ([], [], [])
                arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "score"])

        ranked = _ranked(found.mapInArrow(run, "query int, doc_id long, score long"), k)
        named = StructType([StructField("query", IntegerType()), StructField("item_id", items.schema["item_id"].dataType)])
        ids = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], named)
        ranked = ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")  # ids of a block
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op11_lexical": rf"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, n_docs),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""
}
