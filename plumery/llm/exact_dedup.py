"""Exact dedup of whole texts, with tries that own each text.

Each task puts its normalised texts into a compressed radix trie. A terminal node is a class of equal texts: it has the
smallest identifier seen and a count, so copies inside a task leave it once, however many there are. These classes are then
dealt out by length and content hash, and each partition inserts the whole byte strings into a trie of its own, whose terminals
hold the smallest identifier of all and the classes that ended there. A trie that outgrows its bound spills the heaviest
subtree: a task of the first pass closes its classes (an equal text opens another one later), a task of the second
pass hands its terminals on, still open, to a further round over twice as many partitions. Equality is always that of whole
byte strings; hashes only deal out.

A row finds its owner through the class of its own task, so no key of that join has more rows than one task has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.llm.common import materialise, small_batches, table

#: Bytes of edges that a trie may hold before it spills.
TRIE_BYTES = 64 << 20
#: What a node takes besides its edge.
NODE_BYTES = 200
NO_ID = (1, 0)


def normalised(text: Column) -> Column:
    """The text with each run of space, \\t, \\n, \\v, \\f and \\r made one space; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\t-\r]|  "), F.regexp_replace(text, r"[ \t-\r]+", " ")).otherwise(text)


class Node:
    """edge: the bytes that lead here; kids: by first byte of their edges; owner: of a terminal, (no id, id, seq) at least; members: its classes."""

    __slots__ = ("edge", "kids", "owner", "rows", "members")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.kids, self.owner, self.rows, self.members = edge, {}, None, 0, None


def _common(edge: bytes, key: bytes, at: int) -> int:
    """How many bytes of edge key has from ``at`` on; by bisection, as bytes compare fast in slices."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie of byte strings; ``size`` is about what it holds in bytes, ``terminals`` how many strings."""

    def __init__(self) -> None:
        self.root, self.size, self.terminals = Node(b""), 0, 0

    def insert(self, key: bytes, owner: tuple, rows: int) -> Node:
        """The terminal of key, which from now on counts these rows and has the smaller owner."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.size += len(key) - at + NODE_BYTES
                node = kid
                break
            if not key.startswith(kid.edge, at):
                same = _common(kid.edge, key, at)
                fork = node.kids[key[at]] = Node(kid.edge[:same])
                kid.edge = kid.edge[same:]
                fork.kids[kid.edge[0]] = kid
                self.size += NODE_BYTES
                kid = fork
            node, at = kid, at + len(kid.edge)
        if node.owner is None:
            node.owner, node.members = owner, []
            self.terminals += 1
        elif owner < node.owner:
            node.owner = owner
        node.rows += rows
        return node

    @staticmethod
    def below(top: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """(string, terminal) of a subtree whose top is reached by prefix, its own edge included."""
        todo = [(prefix, top)]
        while todo:
            key, node = todo.pop()
            if node.owner is not None:
                yield key, node
            todo.extend((key + kid.edge, kid) for kid in node.kids.values())

    def _weights(self) -> dict[int, tuple[int, int]]:
        """By identity of a node, the bytes and terminals of its subtree; children are summed before their parents."""
        order, todo, found = [], [self.root], {}
        while todo:
            order.append(node := todo.pop())
            todo.extend(node.kids.values())
        for node in reversed(order):
            own = [found[id(k)] for k in node.kids.values()]
            found[id(node)] = len(node.edge) + NODE_BYTES + sum(w for w, _ in own), (node.owner is not None) + sum(n for _, n in own)
        return found

    def spill(self) -> tuple[bytes, list[tuple[bytes, Node]]]:
        """Takes out the heaviest subtree below the first fork: its prefix, and its strings with their terminals."""
        weights, above, prefix = self._weights(), self.root, b""
        while len(above.kids) == 1 and above.owner is None:
            above = next(iter(above.kids.values()))
            prefix += above.edge
        first, top = max(above.kids.items(), key=lambda kid: weights[id(kid[1])])
        del above.kids[first]
        size, terminals = weights[id(top)]
        self.size -= size
        self.terminals -= terminals
        return (prefix := prefix + top.edge), list(self.below(top, prefix))


CLASS = "kind string, doc_id long, seq long, cls long, sha string, n_rows long, n_bytes long, hash long, text binary"


def _class_rows(found: list[tuple[bytes, Node]]) -> Iterator[pa.RecordBatch]:
    """Rows of kind ``class``, a few MB at a time."""
    at = 0
    while at < len(found):
        end, size = at, 0
        while end < len(found) and (end == at or size < 4 << 20):
            size += len(found[end][0])
            end += 1
        part = found[at:end]
        owners = [node.owner for _, node in part]
        arrays = [
            pa.array(["class"] * len(part)),
            pa.array([None if o[0] else o[1] for o in owners], pa.int64()),
            pa.array([o[2] for o in owners], pa.int64()),
            pa.array([node.members[0] for _, node in part], pa.int64()),
            pa.nulls(len(part), pa.string()),
            pa.array([node.rows for _, node in part], pa.int64()),
            pa.array([len(key) for key, _ in part], pa.int64()),
            pa.array([node.members[1] for _, node in part], pa.int64()),
            pa.array([key for key, _ in part], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["kind", "doc_id", "seq", "cls", "sha", "n_rows", "n_bytes", "hash", "text"])
        at = end


def local_classes(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """A row of kind ``row`` for each document, with its class, and of kind ``class`` for each class of equal texts of a task.

    A class is named by the number of the row that opened it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            ids, seqs, hashes, shas = (batch.column(k).to_pylist() for k in range(4))
            classes = []
            for doc_id, seq, hash_, text in zip(ids, seqs, hashes, batch.column(4), strict=True):
                node = trie.insert(text.as_py(), (*((0, doc_id) if doc_id is not None else NO_ID), seq), 1)
                if not node.members:
                    node.members = [seq, hash_]
                classes.append(node.members[0])
                if trie.size > trie_bytes and trie.terminals > 1:
                    yield from _class_rows(trie.spill()[1])
            n = len(batch)
            none = pa.nulls(n, pa.int64())
            arrays = [pa.array(["row"] * n), batch.column(0), batch.column(1), pa.array(classes, pa.int64()), batch.column(3), none, none, none, pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "doc_id", "seq", "cls", "sha", "n_rows", "n_bytes", "hash", "text"])
        yield from _class_rows(list(trie.below(trie.root, b"")))

    text = normalised(F.col("text"))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("seq"), text.alias("text"))
    raw = F.col("text").cast("binary")
    return rows.select("doc_id", "seq", F.xxhash64("text").alias("hash"), F.sha2(raw, 256).alias("sha"), raw.alias("text")).mapInArrow(run, CLASS)


OWNED = "kind string, cls long, keep_id long, keep_seq long, group_size long, doc_id long, seq long, n_rows long, n_bytes long, hash long, text binary, members array<long>"


def _owned(found: list[tuple[bytes, Node]]) -> Iterator[pa.RecordBatch]:
    """Rows of kind ``owned``: for each class that ended in a terminal, whom it belongs to."""
    sizes = np.array([len(node.members) for _, node in found], np.int64)
    if not len(sizes):
        return
    of = np.repeat(np.arange(len(found)), sizes)
    cls = np.concatenate([np.array(node.members, np.int64) for _, node in found])
    keep = pa.array([None if node.owner[0] else node.owner[1] for _, node in found], pa.int64())
    seq, rows = (pa.array(x, pa.int64()) for x in ([node.owner[2] for _, node in found], [node.rows for _, node in found]))
    for at in range(0, len(cls), 50_000):
        own = pa.array(of[at : at + 50_000])
        n = len(own)
        none = pa.nulls(n, pa.int64())
        arrays = [pa.array(["owned"] * n), pa.array(cls[at : at + n]), keep.take(own), seq.take(own), rows.take(own)]
        arrays += [none, none, none, none, none, pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, schema=_OWNED)


def _open(found: list[tuple[bytes, Node]], hashes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows of kind ``open``: terminals that go into another round."""
    for key, node in found:
        one = lambda x: pa.array([x], pa.int64())
        owner = [one(None if node.owner[0] else node.owner[1]), one(node.owner[2])]
        arrays = [pa.array(["open"]), *[one(None)] * 4, *owner, one(node.rows), one(len(key)), one(hashes[id(node)]), pa.array([key], pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([node.members], pa.list_(pa.int64()))], schema=_OWNED)


_OWNED = pa.schema([
    *[(c, pa.string() if c == "kind" else pa.int64()) for c in "kind cls keep_id keep_seq group_size doc_id seq n_rows n_bytes hash".split()],
    ("text", pa.binary()), ("members", pa.list_(pa.int64())),
])


def owners(classes: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(cls, keep_id, keep_seq, group_size) of every class of classes(doc_id, seq, cls, n_rows, n_bytes, hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, spilled, hashes = Trie(), [], {}
        for batch in batches:
            ids, seqs, rows, hash_s, members = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))
            for doc_id, seq, n, hash_, text, own in zip(ids, seqs, rows, hash_s, batch.column(4), members, strict=True):
                node = trie.insert(text.as_py(), (*((0, doc_id) if doc_id is not None else NO_ID), seq), n)
                node.members.extend(own)
                hashes[id(node)] = hash_
                if trie.size > trie_bytes and trie.terminals > 1:
                    prefix, found = trie.spill()
                    spilled.append(prefix)
                    yield from _open(found, hashes)
                    for _, node in found:
                        hashes.pop(id(node))
        found = list(trie.below(trie.root, b""))
        again = tuple(spilled)
        yield from _owned([f for f in found if not f[0].startswith(again)] if again else found)
        if again:
            yield from _open([f for f in found if f[0].startswith(again)], hashes)

    spark = classes.sparkSession
    left = classes.select("doc_id", "seq", "n_rows", "n_bytes", "hash", "text", F.array("cls").alias("members"))
    size = int(classes.agg(F.sum(F.col("n_bytes") + NODE_BYTES)).first()[0] or 0)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // trie_bytes))
    done = None
    while True:
        dealt = left.repartition(n_parts, "n_bytes", F.xxhash64("hash", F.lit(n_parts)))
        out = materialise(dealt.select("doc_id", "seq", "n_rows", "hash", "text", "members").mapInArrow(run, OWNED), "kind")
        found = out.where("kind = 'owned'").select("cls", "keep_id", "keep_seq", "group_size")
        done = found if done is None else done.unionByName(found)
        left = out.where("kind = 'open'").select("doc_id", "seq", "n_rows", "n_bytes", "hash", "text", "members")
        if left.isEmpty():
            return done
        n_parts *= 2


def exact_duplicates(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    Texts are equal if they are the same bytes after normalised(); null is the empty text. Of equal texts the row with the
    smallest doc_id stays, null ids last, and of rows alike in id and text the first one read; keep_id is that row's doc_id.
    text_sha256 is of the normalised text. Each row gives a row; an empty table gives none. Texts of any length go whole into a
    trie, which then holds more than trie_bytes if it has nothing else; other columns of docs play no part.
    """
    found = materialise(local_classes(docs, trie_bytes), "kind")
    owned = owners(found.where("kind = 'class'"), trie_bytes)
    rows = found.where("kind = 'row'").select("doc_id", "seq", "cls", F.col("sha").alias("text_sha256"))
    return rows.join(owned, "cls").select("doc_id", "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row of each group of docs' equal texts, as exact_duplicates() has them, with all its columns as they are.

    A table with rows alike in doc_id and text keeps one of them.
    """
    lead = exact_duplicates(docs, trie_bytes).groupBy(F.col("doc_id").alias("_ed_id"), F.col("text_sha256").alias("_ed_sha"))
    lead = materialise(lead.agg(F.count(F.lit(1)).alias("_ed_rows"), F.max("kept").alias("_ed_kept")).where("_ed_kept"))
    whole = [F.col(c) for c in docs.columns]
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col("_ed_id")) & (sha == F.col("_ed_sha")))

    kept = of(lead.where("_ed_rows = 1")).select(*whole)
    several = lead.where("_ed_rows > 1")
    if several.isEmpty():
        return kept
    return kept.unionByName(of(several).groupBy("_ed_id", "_ed_sha").agg(F.first(F.struct(*whole)).alias("_ed_row")).select("_ed_row.*"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document stays, and the document that stays for it."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op13_exact_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
owned AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM owned"""
}
