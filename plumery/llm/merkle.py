"""A Merkle manifest of a dataset with a witness for every row, built by appends.

Leaves of a tree are appended in order. The appender keeps the open subtrees of each level; when a run of ``fan`` siblings is
complete, it becomes a node one level up, and the witness of every leaf below it is extended by the siblings next to it. So a
witness is partial while its subtree is open and grows with each later completion.

Appends are spread over tasks by aligned blocks of fan ** height leaves, whose subtrees no other leaf enters. What a block gives,
its root, is one further append to a tree of block roots, built in the same way, and so on until one node is left. A leaf's
witness is that of its block's levels, then of its block's place among blocks, then of its tree among all trees. A block's
witnesses are made a second time from its leaves when all above is known, which costs half a hash a leaf, in place of
writing partial witnesses, which are larger than the leaves, and reading them back.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumery.llm.common import crc_of_id, table
from plumery.operators.graph import cut

FAN = 3
#: Levels of a block: 3 ** 7 = 2187 leaves.
HEIGHT = 7
STEP = "array<struct<before: string, after: string>>"


def leaf_of(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields put together, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


class Appender:
    """Leaves appended so far: open nodes (digest, first leaf, last leaf + 1) of each level, and each leaf's witness up to now.

    A witness is a list of steps (digests before, digests after), from the leaf upwards.
    """

    def __init__(self, fan: int, height: int) -> None:
        self.fan, self.height, self.n = fan, height, 0
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(height + 1)]
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        self.open[0].append((digest, self.n, self.n + 1))
        self.witness.append([])
        self.n += 1
        level = 0
        while level < self.height and len(self.open[level]) == self.fan:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        """The open run of a level becomes a node above; every witness below is extended by the run's other digests."""
        run = self.open[level]
        digests = [d for d, _, _ in run]
        for k, (_, first, last) in enumerate(run):
            step = ("".join(digests[:k]), "".join(digests[k + 1 :]))
            for n in range(first, last):
                self.witness[n].append(step)
        self.open[level + 1].append((sha256("".join(digests).encode()).hexdigest(), run[0][1], run[-1][2]))
        self.open[level] = []

    def close(self, lifted: bool) -> str:
        """The root: of what there is if nothing else follows (``lifted`` false), else at the block's full height.

        Runs that are still open are completed with fewer nodes, from below.
        """
        for level in range(self.height):
            if not lifted and not any(self.open[level + 1 :]) and len(self.open[level]) == 1:
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by (tree, block, pos), cut anew into one table a block; a block is small, so it may be put together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(nodes: DataFrame, n_leaves: int) -> DataFrame:
    """nodes with their block as second column, the rows of a block together and in order."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = nodes.select("tree", F.expr(f"pos div {n_leaves}").alias("block"), *[c for c in nodes.columns if c != "tree"])
    return blocked.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "pos").transform(cut)


def _appended(block: pa.Table, fan: int, height: int) -> Appender:
    one = Appender(fan, height)
    for digest in block.column("digest").to_pylist():
        one.append(digest)
    return one


def _roots(blocked: DataFrame, fan: int, height: int) -> DataFrame:
    """(tree, block, alone, lifted) of each block: its root if it is the tree's only one, and as one of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            one = _appended(block, fan, height)
            levels = [list(x) for x in one.open]
            alone = one.close(False)
            one.open = levels
            row = [[block.column(0)[0].as_py()], [block.column(1)[0].as_py()], [alone], [one.close(True)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["tree", "block", "alone", "lifted"])

    return blocked.select("tree", "block", "pos", "digest").mapInArrow(run, "tree string, block long, alone string, lifted string")


def _witnesses(blocked: DataFrame, fan: int, height: int) -> DataFrame:
    """blocked with steps, the witness of each node up to its block's root.

    The first block may be its tree's only one, so its witnesses end where one node is left; were there others, it would be
    full, and that is at the full height as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            one = _appended(block, fan, height)
            one.close(block.column(1)[0].as_py() > 0)
            flat = [s for w in one.witness for s in w]
            pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], names=["before", "after"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(one.n + 1, dtype=np.int32) * len(one.witness[0])), pairs)
            yield from block.append_column("steps", lists).combine_chunks().to_batches()

    steps = blocked.select(F.array().cast(STEP).alias("steps")).schema
    return blocked.mapInArrow(run, StructType([*blocked.schema.fields, *steps.fields]))


def grow(nodes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """(tree, root) of the trees of nodes(tree, pos, digest, ...), and the rounds of appends that attach() needs.

    pos counts from 0 without gaps in each tree. A round has its nodes by blocks, and which trees have several of these.
    """
    rounds, roots, left = [], None, nodes
    while True:
        blocked = _in_blocks(left, fan**height)
        made = _roots(blocked, fan, height).transform(cut)
        several = made.where("block > 0").select("tree").distinct().transform(cut)
        alone = made.join(several, "tree", "left_anti").select("tree", F.col("alone").alias("root"))
        roots = alone if roots is None else roots.unionByName(alone)
        rounds.append((blocked, several))
        if several.isEmpty():
            return roots.transform(cut), rounds
        left = made.join(several, "tree").select("tree", F.col("block").alias("pos"), F.col("lifted").alias("digest"))


def attach(rounds: list[tuple[DataFrame, DataFrame]], tops: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The nodes that grow() was given, with steps up to the top and what tops(tree, steps, ...) has besides.

    tops has one row a tree, with the witness of its root. Going down the rounds, each block gets the witness of its root, and its
    nodes' own witnesses go before that. A block has a bounded number of nodes, so no key of a join is large; a tree's row
    of tops meets the last round's blocks of that tree, one or few.
    """
    extra = [c for c in tops.columns if c not in ("tree", "steps")]
    found = None
    for blocked, several in reversed(rounds):
        facts = tops.join(several, "tree", "left_anti").select("tree", F.lit(0).cast("long").alias("block"), F.col("steps").alias("_above"), *extra)
        if found is not None:
            facts = facts.unionByName(found.select("tree", F.col("pos").alias("block"), F.col("steps").alias("_above"), *extra))
        n = int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        facts = facts.repartition(n, "tree", "block").hint("merge")
        joined = blocked.join(facts, ["tree", "block"]).sortWithinPartitions("tree", "block", "pos")
        found = _witnesses(joined, fan, height).withColumn("steps", F.concat("steps", "_above")).drop("block", "_above")
    return found


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with pos: their number from 0 in their tree by ``order``; no task holds a tree.

    Rows are range-partitioned and sorted by tree and order. Only a partition's first tree can have begun before it, so what is to
    be added is one number a partition.
    """
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).transform(cut)
    counts = ranged.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("_ahead", F.sum("n").over(ahead)).where("_ahead > 0").select("_part", F.col(tree).alias("_tree"), "_ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = (None,), 0  # no tree is named by a tuple
        for batch in batches:
            pos = np.zeros(len(batch), np.int64)
            for k, name in enumerate(batch.column(batch.schema.get_field_index(tree)).to_pylist()):
                if name != last:
                    last, count = name, 0
                pos[k] = count
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos)], names=[*batch.schema.names, "_own"])

    own = ranged.mapInArrow(run, StructType([*ranged.schema.fields, StructField("_own", LongType())]))
    on = (own["_part"] == F.broadcast(begun)["_part"]) & own[tree].eqNullSafe(begun["_tree"])
    placed = own.join(F.broadcast(begun), on, "left")  # at most a row a partition
    return placed.select(*[own[c] for c in rows.columns], (F.col("_own") + F.coalesce("_ahead", F.lit(0))).alias("pos"))


def fold(digest: Column, steps: Column) -> Column:
    """The root that a digest and its witness lead to."""
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256))


def proof(steps: Column) -> Column:
    """All digests of a witness, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """leaves(doc_id, source, leaf) and other columns, with subroot, root and steps, the witness from the leaf to root.

    Leaves of a source are ordered by doc_id (null first), then by leaf; subroots by source, null first, by UTF-8 bytes. An empty
    table gives none. Repeated rows are leaves of their own. A null source is a source like others. The columns tree, pos,
    digest, block, subroot, root and steps of leaves are replaced or left out.
    """
    own = [c for c in leaves.columns if c not in ("source", "tree", "pos", "digest", "block", "subroot", "root", "steps", "_above")]
    # Trees are named without nulls: the order of names is that of sources, null first.
    named = leaves.select(*own, F.coalesce(F.concat(F.lit("."), "source"), F.lit("")).alias("tree"), F.col("leaf").alias("digest"))
    subroots, rounds = grow(numbered(named, "tree", ["doc_id", "digest"]), fan, height)
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    roots, upper = grow(numbered(tops, "tree", ["name"]), fan, height)
    root = roots.select("tree", "root", F.array().cast(STEP).alias("steps"))
    tops = attach(upper, root, fan, height).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source")
    found = attach(rounds, tops.transform(cut), fan, height)
    return found.select(*[source if c == "source" else F.col(c) for c in ["source", *own]], "subroot", "root", "steps")


def verify(found: DataFrame, leaf: str = "leaf") -> DataFrame:
    """found, as manifest() gives it, with folded_root, recomputed from the column ``leaf`` and the witness, and verified."""
    return found.withColumn("folded_root", fold(F.col(leaf), F.col("steps"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of every document, and whether the text as it is now (half of them without \\n) still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_of_id(F.col("doc_id")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", leaf_of(*fields, F.col("text")).alias("leaf"), leaf_of(*fields, tampered).alias("leaf_now"))
    found = verify(manifest(leaves), "leaf_now")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


#: So many levels of a source's leaves and of sources are in the SQL: 3 ** 11 = 177,147 leaves, 3 ** 6 = 729 sources.
LEAF_LEVELS, TOP_LEVELS = 11, 6


def _levels(name: str, n: int) -> str:
    """SQL of n levels above {name}0(tree, pos, d, total) and of the steps at each; a single node goes up as it is."""
    one = """
{name}{k} AS (
  SELECT tree, pos // 3 AS pos, CASE WHEN total = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d, (total + 2) // 3 AS total
  FROM {name}{j} GROUP BY tree, pos // 3, total),
{name}_steps{j} AS (
  SELECT tree, pos, total > 1 AS live,
         coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{j})"""
    return ",".join(one.format(name=name, j=k, k=k + 1) for k in range(n))


def _walk(name: str, n: int) -> str:
    """SQL of {name}_walk{n}: {name}_walk0(tree, pos, f, proof, ...) folded over n levels."""
    one = """
{name}_walk{k} AS (
  SELECT w.* REPLACE (CASE WHEN live THEN sha256(before || f || after) ELSE f END AS f, proof || before || after AS proof)
  FROM {name}_walk{j} w JOIN {name}_steps{j} s ON w.tree = s.tree AND w.pos // {at} = s.pos)"""
    return ",".join(one.format(name=name, j=k, k=k + 1, at=3**k) for k in range(n))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
SQL = {
    "op12_merkle": rf"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT range AS n FROM range(256)))),
texts AS (
  SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text_now FROM documents, crc_table),
rows AS (
  SELECT doc_id, coalesce('.' || source, '') AS tree, sha256({_FIELDS} || {_FIELD.format("text")}) AS leaf, sha256({_FIELDS} || {_FIELD.format("text_now")}) AS leaf_now FROM texts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM rows),
leaf0 AS (SELECT tree, pos, leaf AS d, total FROM placed),{_levels("leaf", LEAF_LEVELS)},
top0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, d, count(*) OVER () AS total FROM leaf{LEAF_LEVELS}),{_levels("top", TOP_LEVELS)},
leaf_walk0 AS (SELECT doc_id, tree, pos, leaf, leaf_now AS f, '' AS proof FROM placed),{_walk("leaf", LEAF_LEVELS)},
top_walk0 AS (
  SELECT '' AS tree, top0.pos, doc_id, leaf, top0.d AS subroot, f, proof FROM leaf_walk{LEAF_LEVELS} w JOIN top0 ON w.tree = top0.name),{_walk("top", TOP_LEVELS)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified
FROM top_walk{TOP_LEVELS}, (SELECT d FROM top{TOP_LEVELS})"""
}
