"""SimHash near-duplicates, with Golay-code fuzzy hashing to find the fingerprints that differ in a few bits.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the binary [23, 12, 7] Golay code.
Every word lies within 3 bits of exactly one codeword. ``near codewords`` of a word are those within 4 bits: one, or six
where the nearest is 3 bits away. Two words that differ in at most 2 bits share one of them: the word half-way between
them decodes to a codeword within 3 bits, and it is at most one bit from either.

Four differing bits fall on the three segments in one of two ways (pigeonhole):

* a segment is equal; of the other two, one differs in at most 2 bits. Key: the equal segment and a near codeword of the
  other, for each of the six ordered pairs;
* no segment is equal; then two differ in exactly one bit and the third in at most 2. Key: a near codeword of the third
  and, of each of the two others, the half that is equal, for each choice of the third and of the halves.

Fingerprints that share a key meet in one task, sorted by key, where the distance is verified. Only the edges of a spanning
forest leave a run of equal keys, never all its pairs. Keys belong to distinct fingerprints, so a group of copies is one row.

``keep_one`` asks for similar texts instead: sets of five-word shingles with a similarity of 0.8 or more. Such texts differ in
10 of 64 bits on average, out of reach of keys with an equal segment. So it takes two fingerprints of the set, in which a shingle
counts once however often it is repeated, and as keys a near codeword of each of two segments, for each pair of segments:
errors of two segments may be several each. What meets is compared in all 128 bits, and the closest pairs that tie each run
together are verified by their very sets of shingles; texts with equal fingerprints are no exception. There is a round for each
fingerprint, first with the nearest codewords, then with all near ones. What a round has tied counts as tied in the next, so
a large group is asked for few pairs more.

Fingerprints of similar texts may be far apart by chance. So an exact round follows, which leaves out no link: of texts with a
similarity of 0.8 each has at least 0.8 of its shingles in the other; so, if all sets are put into one order, the first fifth of
each and one more have a shingle in common. Frequent shingles come last in that order. What meets at a shingle, isn't tied yet and
may still have enough in common by its places in both orders is verified like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.llm.common import LOWER, UPPER, bucketed, join_skewed, materialise, remove, shuffles_removed, small_batches, table, written
from plumery.llm.components import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
MAX_BITS = 4
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the Golay code

# --- fingerprints -----------------------------------------------------------------------------------------------------

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TO_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between space, \\t, \\n, \\v, \\f and \\r."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).translate(_TO_BLANK)
    return [w for w in raw.split(b" ") if w]


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bits that more than half of the shingles' XXH64 (seed 42) have; 0 for no word."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # a long text is counted piece by piece
        part = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + 4096], ends[at : at + 4096], strict=True)]
        counts += np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row of docs; a null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# --- Golay code -------------------------------------------------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1 == 1, np.int64(GENERATOR) << (bit - 11), 0)
    return words


@cache
def _offsets() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes, the error patterns of weight 4 or less: up to 6, and how many."""
    bits = 1 << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, np.int64)]
    for _ in range(4):
        more = np.unique((patterns[-1][:, None] | bits[None, :]).ravel())
        patterns.append(more[np.bitwise_count(more) == len(patterns)])
    table, counts = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    every = np.concatenate(patterns)
    for s, e in zip(_syndromes(every).tolist(), every.tolist(), strict=True):
        table[s, counts[s]] = e
        counts[s] += 1
    return table, counts


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word, in up to 6 columns, and which columns count."""
    table, counts = _offsets()
    s = _syndromes(words)
    return (words.astype(np.int64)[:, None] ^ table[s]) >> 11, np.arange(6) < counts[s][:, None]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fuzzy keys of distinct uint64 fingerprints: (row, key). Pairs within 4 bits share at least one key."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    rows, keys, kind = [], [], 0

    def add(exact: np.ndarray, j: int) -> None:
        nonlocal kind
        index, valid = near[j]
        key = (np.int64(kind) << 48) | (exact[:, None] << 12) | index
        rows.append(np.nonzero(valid)[0])
        keys.append(key[valid])
        kind += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                add(parts[i], j)
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        for p in range(2):
            for q in range(2):
                halves = [(parts[x] >> (11 if h else 0)) & (0x7FF if not h else 0xFFF) for x, h in ((i, p), (j, q))]
                add(halves[0] << 12 | halves[1], k)
    return np.concatenate(rows), np.concatenate(keys)


# --- candidate pairs --------------------------------------------------------------------------------------------------


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of distinct fingerprints tied within max_bits: each is compared with the unreached only."""
    left, a, b = fps, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            node = todo.pop()
            close = np.bitwise_count(left ^ node) <= max_bits
            if close.any():
                found = left[close]
                left = left[~close]
                a.append(np.full(len(found), node))
                b.append(found)
                todo.extend(found)
    none = np.empty(0, np.uint64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def _edges_of_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys sorted. Short runs are compared at all distances at once, long ones by forest()."""
    cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    sizes = np.diff(cuts)
    a, b = [], []
    short = np.repeat(sizes <= 16, sizes)
    for step in range(1, 16):
        if step >= len(keys):
            break
        hit = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:] & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= MAX_BITS))
        a.append(fps[hit])
        b.append(fps[hit + step])
    for n in np.flatnonzero(sizes > 16):
        x, y = forest(np.unique(fps[cuts[n] : cuts[n + 1]]))
        a.append(x)
        b.append(y)
    a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b))
    keep = a != b
    pairs = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut anew where that changes; a run over many batches is put together once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or (held and held[-1][0][-1] != columns[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns], strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def near_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of fps(fp) that tie all that are linked within 4 bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                own = every[at : at + 4096]
                rows, keys = golay_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows].view(np.int64))], names=["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, own in whole_runs(batches):
            a, b = _edges_of_runs(keys, own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    Rows are linked if their fingerprints differ in at most 4 bits; component_id is the smallest doc_id that links reach,
    the row's own included (rows with a null doc_id get it too; null where no member has an id). Null and blank texts have
    fingerprint 0 and are linked like others. Repeated rows each give a row; other columns of docs play no part. A very long text
    is hashed whole, its bits counted piece by piece.
    """
    prints = materialise(fingerprints(docs, width))
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = connected_components(near_edges(reps.select("fp").repartition(n))).withColumnRenamed("node", "fp")
    rooted = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    facts = materialise(rooted.join(smallest, "root").select("fp", "copies", "component_id"))
    return join_skewed(prints, facts, ["fp"], "copies", prints.count()).select("doc_id", "fp", "component_id")


# --- similar texts ----------------------------------------------------------------------------------------------------

#: The bits of 128 in which two fingerprints may differ: texts of similarity 0.8 differ in 19 on average, others in 64.
MAX_APART = 34
#: Runs of a key above this are tied along sorted orders first; words of the table of distances that is held at once.
SHORT_RUN, TABLE_WORDS = 512, 1 << 20
#: Shingles of so many texts come last in the order of the exact round, the most frequent at its end; so many are put last. Others are
#: in the order of their hashes. Any order gives the same links.
FREQUENT, PUT_LAST = 8, 1 << 20
#: Shingles that a task counts at once, and the parts by first bits that they are counted in.
COUNTED, COUNT_BITS = 1 << 22, 10


def sketch(text: str | None, width: int) -> tuple[int, int, np.ndarray]:
    """Two fingerprints, of the distinct shingles' XXH64 and of the same mixed once more, and the sorted set of 32 bits of each."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0, 0, np.zeros(0, np.uint32)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, ends = np.concatenate(([0], ends[:-1] + 1))[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    every = np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n))
    counts = np.zeros(128, np.int64)
    for at in range(0, len(every), 4096):  # a long text is counted piece by piece
        h = every[at : at + 4096]
        with np.errstate(over="ignore"):
            more = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.unpackbits(np.stack([h, more ^ more >> np.uint64(29)], 1).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    one, two = np.packbits(counts * 2 > len(every), bitorder="little").view(np.uint64).tolist()
    return one, two, np.unique((every >> np.uint64(32)).astype(np.uint32))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, one, two, shingles) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py(), width) for t in batch.column(2)]
            prints = np.array([f[:2] for f in found], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([f[2].tobytes() for f in found], pa.binary())], names=["doc_id", "text_hash", "one", "two", "shingles"]
            )

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), _text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, one long, two long, shingles binary")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pair_keys(fps: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of uint64 fingerprints: a near codeword (or only the nearest) of each of two segments, for the three pairs of segments."""
    near = [near_codewords((fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, keys = [], []
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, good_a, b, good_b = (x[:, :1] if nearest else x for x in (*near[i], *near[j]))  # the first one is the nearest
        key = kind << 24 | a[:, :, None] << 12 | b[:, None, :]
        good = good_a[:, :, None] & good_b[:, None, :]
        rows.append(np.nonzero(good)[0])
        keys.append(key[good])
    return np.concatenate(rows), np.concatenate(keys)


def closest_forest(prints: np.ndarray, trees: np.ndarray | None = None, most: int = MAX_APART) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that tie the rows of prints (n, 2) together, so far as they lie within ``most`` bits, by about the closest pairs.

    trees has what is tied already; by default each row is a tree. Each pass looks for the closest row of another tree, for all
    rows that can have one outside of the largest tree, in tables of bounded size; rows that are far from all others drop
    out after one pass. In a long run rows are first compared with those beside them in four sorted orders, which ties
    most of a large group, so that its rows, being one tree, aren't compared with each other.
    """
    n = len(prints)
    tree = np.arange(n) if trees is None else np.unique(trees, return_inverse=True)[1]
    top, a, b = list(range(int(tree.max()) + 1 if n else 0)), [], []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    def tie(rows: np.ndarray, others: np.ndarray, bits: np.ndarray) -> bool:
        before = len(a)
        order = np.argsort(bits, kind="stable")
        for row, other in zip(rows[order].tolist(), others[order].tolist(), strict=True):
            x, y = find(tree[row]), find(tree[other])
            if x != y:
                top[max(x, y)] = min(x, y)
                a.append(row)
                b.append(other)
        return len(a) > before

    if n > SHORT_RUN:
        for shift in (0, 16, 32, 48):
            turned = prints << np.uint64(shift) | prints >> np.uint64((64 - shift) % 64)
            order = np.lexsort((turned[:, 1], turned[:, 0]))
            bits = np.bitwise_count(prints[order[1:]] ^ prints[order[:-1]]).sum(1)
            near = bits <= most
            tie(order[1:][near], order[:-1][near], bits[near])
    rows = np.arange(n)
    while True:
        label = np.array([find(x) for x in range(len(top))], np.int64)[tree]
        rows = rows[label[rows] != np.bincount(label).argmax()] if n else rows
        if not len(rows):
            break
        others, bits = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.uint8)
        step = max(1, TABLE_WORDS // n)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            apart = np.bitwise_count(prints[own, :1] ^ prints[:, 0]) + np.bitwise_count(prints[own, 1:] ^ prints[:, 1])
            apart[label[own][:, None] == label] = 255
            others[at : at + step] = apart.argmin(1)
            bits[at : at + step] = apart[np.arange(len(own)), others[at : at + step]]
        near = bits <= most
        rows = rows[near]
        if not tie(rows, others[near], bits[near]):
            break
    return np.array(a, np.int64), np.array(b, np.int64)


def candidate_edges(nodes: DataFrame, nearest: bool = False, prints: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Pairs (a, b) of nodes(node, tree, one, two) that tie together what shares a key, is close in all bits and isn't of one tree.

    Keys are of the first fingerprint, the second one or both.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                for kind in prints:
                    rows, keys = pair_keys(part.column(kind + 1).to_numpy().view(np.uint64), nearest)
                    arrays = [pa.array((keys | kind << 26).astype(np.int32)), *(c.take(pa.array(rows)) for c in part.columns)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "node", "tree", "one", "two"])

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, node, tree, one, two in whole_runs(batches):
            bits = np.stack([one, two], 1).view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            sizes = np.diff(cuts)
            run = np.repeat(np.arange(len(sizes)), sizes)
            short = (sizes <= 16)[run]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, min(16, len(keys))):
                hit = np.flatnonzero((run[step:] == run[:-step]) & short[step:] & (tree[step:] != tree[:-step]))
                hit = hit[np.bitwise_count(bits[hit + step] ^ bits[hit]).sum(1) <= MAX_APART]
                a.append(hit)
                b.append(hit + step)
            # A short run with more pairs than a forest has is tied like a long one.
            pairs = np.bincount(run[np.concatenate(a)], minlength=len(sizes))
            many = (pairs >= sizes) | (sizes > 16)
            a, b = ([np.concatenate(x)] for x in (a, b))
            few = ~many[run[a[0]]]
            a, b = ([x[0][few]] for x in (a, b))
            for k in np.flatnonzero(many).tolist():
                x, y = closest_forest(bits[cuts[k] : cuts[k + 1]], tree[cuts[k] : cuts[k + 1]])
                a.append(x + cuts[k])
                b.append(y + cuts[k])
            a, b = node[np.concatenate(a)], node[np.concatenate(b)]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.select("node", "tree", "one", "two").mapInArrow(keyed, "key int, node long, tree long, one long, two long")
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tied, "a long, b long").distinct()


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of sets(shingles) that at least FREQUENT rows have, ascending, and a rank from 1 by the number of rows: at most PUT_LAST."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            ends = np.searchsorted(every >> np.uint32(32 - COUNT_BITS), np.arange(1 << COUNT_BITS), "right")
            own = np.split(every, ends[:-1])
            some = [k for k, x in enumerate(own) if len(x)]
            planes = [own[k].view(np.uint8).reshape(-1, 4).T.tobytes() for k in some]  # byte by byte, for the shuffle's compression
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(planes, pa.binary())], names=["part", "planes"])

        for batch in batches:
            for row in batch.column(0):
                held.append(np.frombuffer(row.as_py(), np.uint32))
                n += len(held[-1])
                if n >= COUNTED:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    def count(table: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for x in table.column("planes")])
        found, n = np.unique(every, return_counts=True)
        often = n >= FREQUENT
        return pa.table({"shingle": found[often].astype(np.int64), "n": n[often].astype(np.int64)})

    with shuffles_removed(sets.sparkSession):
        counts = sets.select("shingles").mapInArrow(parts, "part int, planes binary").groupBy("part").applyInArrow(count, "shingle long, n long")
        found = counts.orderBy(F.desc("n"), "shingle").limit(PUT_LAST).toArrow()
    shingles, n = found.column("shingle").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], np.unique(n, return_inverse=True)[1].ravel()[order].astype(np.int32) + 1


def first_shingles(every: list[np.ndarray], last: np.ndarray, ranks: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Of each ascending set of shingles those, in the common order, of which it shares one with each set of that similarity."""
    sizes = np.fromiter(map(len, every), np.int64, len(every))
    flat = np.concatenate(every) if every else np.zeros(0, np.uint32)
    rank = np.zeros(len(flat), np.int64)
    if len(last):
        at = np.minimum(np.searchsorted(last, flat), len(last) - 1)
        hit = last[at] == flat
        rank[hit] = ranks[at[hit]]
    flat = flat[np.argsort(np.repeat(np.arange(len(sizes)), sizes) << 32 | rank, kind="stable")]
    starts = np.cumsum(sizes) - sizes
    taken = np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1)
    return [flat[a : a + n] for a, n in zip(starts.tolist(), taken.tolist(), strict=True)]


def shared_pairs(run: np.ndarray, tree: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of the same run, sorted by it, and of different trees that may have enough in common.

    Before its place a row has nothing in common with the other one, if that is the first that they share. In a long run all rows
    outside of its largest tree are compared with all others, in tables of bounded size.
    """

    def enough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least = similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6
        return (tree[a] != tree[b]) & (size[a] - place[a] >= least) & (size[b] - place[b] >= least)

    cuts = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]))
    sizes = np.diff(cuts)
    short = np.repeat(sizes <= 16, sizes)
    for step in range(1, min(16, len(run))):
        a = np.flatnonzero((run[step:] == run[:-step]) & short[step:])
        a = a[enough(a, a + step)]
        yield a, a + step
    for k in np.flatnonzero(sizes > 16).tolist():
        own = np.arange(cuts[k], cuts[k + 1])
        of = np.unique(tree[own], return_inverse=True)[1].ravel()
        outside = own[of != np.bincount(of).argmax()]
        step = max(1, TABLE_WORDS // len(own))
        for at in range(0, len(outside), step):
            a, b = outside[at : at + step, None], own[None, :]
            x, y = np.nonzero(enough(a, b))
            yield a[x, 0], own[y]


def sharing_edges(trees: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of trees(node, tree, doc_id, text_hash) among which is each one of that similarity that isn't of one tree.

    sets(doc_id, text_hash, shingles) has the nodes' sets. Each node goes to the shingles by which it may meet others.
    """
    last, ranks = frequent_shingles(sets)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(2)]
            taken = first_shingles(every, last, ranks, similarity)
            sizes, n = pa.array(list(map(len, every)), pa.int32()), np.fromiter(map(len, taken), np.int64, len(taken))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            keys = np.concatenate(taken).view(np.int32) if taken else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(x.take(at) for x in (batch.column(0), batch.column(1), sizes)), pa.array(place.astype(np.int32))], names=["key", "node", "tree", "size", "place"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, node, tree, size, place in whole_runs(batches):
            for x, y in shared_pairs(keys, tree, size, place, similarity):
                pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = sets.select("doc_id", "text_hash", "shingles").join(trees, ["doc_id", "text_hash"]).select("node", "tree", "shingles")
    keys = whole.mapInArrow(keyed, "key int, node long, tree long, size int, place int")
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(met, "a long, b long").distinct()


def similar_edges(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose sets(node, shingles) have a Jaccard similarity of at least that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))
    return edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, n_rows): the leading row of each group of docs' similar texts, and how many rows are like it in both.

    Texts are linked if their sets of shingles of ``width`` words (all words, where there are fewer) have at least that
    similarity; texts without words are linked with each other. Nothing is linked by fingerprints alone, and no link is left out. A group's leader has
    the smallest doc_id, then text_hash. Rows without a doc_id play no part. A very long text is one row with its whole set of
    shingles, four bytes each.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each round asks for sets by doc_id and text_hash: they are dealt out once.
    prints, drop_prints = bucketed(sketches(docs.where(F.col("doc_id").isNotNull()), width).withColumn("of", F.xxhash64("shingles")), n_parts, "doc_id", "text_hash")
    alike = prints.groupBy("one", "two", "of", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    nodes = alike.groupBy("one", "two", "of").agg(F.min(F.struct("doc_id", "text_hash", "n_rows")).alias("lead"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "one", "two", "lead"))
    where = nodes.select("node", F.col("lead.doc_id").alias("doc_id"), F.col("lead.text_hash").alias("text_hash"))
    trees, good, good_at = nodes.withColumn("tree", F.col("node")), None, None
    for nearest, prints_of in ((True, 1), (True, 2), (False, 1), (False, 2), (None, None)):
        if prints_of:
            edges = candidate_edges(trees.repartition(n_parts, "node"), nearest, (prints_of,))
        else:
            edges = sharing_edges(trees.select("node", "tree", "lead.doc_id", "lead.text_hash"), prints, similarity)
        edges, edges_at = written(edges)
        # Sets, which are the larger part of all, are kept for those nodes alone that a pair of the round has.
        wanted = where.join(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "node")
        sets = prints.select("doc_id", "text_hash", "shingles").join(wanted, ["doc_id", "text_hash"]).groupBy("node").agg(F.first("shingles").alias("shingles"))
        sets, sets_at = written(sets)
        found = similar_edges(edges, sets, similarity)
        done = [edges_at, sets_at, *([good_at] if good_at else [])]
        good, good_at = written(found if good is None else good.unionByName(found))
        for path in done:
            remove(docs.sparkSession, path)
        roots = connected_components(good)
        trees = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("tree"), "one", "two", "lead")
    drop_prints()
    return trees.groupBy("tree").agg(F.min("lead").alias("lead")).select("lead.*")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar texts of docs, as similar_groups() has them: the one with the smallest doc_id.

    Of rows alike in doc_id and text one stays; of rows with the same doc_id and texts that aren't similar, each group's leader
    stays. Rows without a doc_id all stay. Columns stay as they are. An empty table gives none.
    """
    lead = materialise(similar_groups(docs, width, similarity).withColumnsRenamed({"doc_id": "_sh_id", "text_hash": "_sh_hash", "n_rows": "_sh_rows"}))
    whole = [F.col(c) for c in docs.columns]

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, (F.col("doc_id") == F.col("_sh_id")) & (_text_hash(F.col("text")) == F.col("_sh_hash")))

    kept = of(lead.where("_sh_rows = 1")).select(*whole).unionByName(docs.where(F.col("doc_id").isNull()))
    several = lead.where("_sh_rows > 1")
    if several.isEmpty():
        return kept
    return kept.unionByName(of(several).groupBy("_sh_id", "_sh_hash").agg(F.first(F.struct(*whole)).alias("_sh_row")).select("_sh_row.*"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by 4-word shingles and 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
