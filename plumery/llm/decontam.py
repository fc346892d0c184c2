"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of one task. Its words are numbered by the test phrases' own vocabulary; all other words
are one separator symbol, which no phrase holds, and stretches shorter than the shortest phrase are left out, as no phrase
fits in them. Over this sequence the shard gets a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet
tree, and sampled suffix positions. All phrases go through backward search together, one word per step; occurrences are
located by walking to the next sampled position, and overlapping spans are merged. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumery.llm.common import LOWER, UPPER, small_batches, table

WINDOW = 10
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


# --- FM-index ---------------------------------------------------------------------------------------------------------


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions in order of suffixes, by prefix doubling; after the first rounds only tied suffixes are sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_ = seq[order]
    heads = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[order] = start
    step = 1
    while True:
        tied = ~(heads & np.append(heads[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        nxt = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        by = np.lexsort((nxt, rank[own]))
        own, nxt, first = own[by], nxt[by], rank[own[by]]
        order[at] = own
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (nxt[1:] != nxt[:-1])))
        heads[at] = new
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros(-(-(self.n + 1) // 64) * 64, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        bit = (at & 63).astype(np.uint64)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Levels of bits, highest first, zeros before ones within each level (a wavelet matrix)."""

    def __init__(self, seq: np.ndarray):
        self.depth = max(1, int(seq.max(initial=0)).bit_length())
        self.levels, self.zeros = [], []
        for bit in range(self.depth - 1, -1, -1):
            ones = (seq >> bit & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(seq) - ones.sum()))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros(len(at), np.int64)
        for n, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = symbols >> (self.depth - 1 - n) & 1 == 1
            r_low, r_at = bits.rank1(low), bits.rank1(at)
            low, at = np.where(one, zeros + r_low, low - r_low), np.where(one, zeros + r_at, at - r_at)
        return at - low

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            ones = bits.rank1(at)
            at = np.where(one, zeros + ones, at - ones)
            out = out << 1 | one
        return out


class FMIndex:
    """Over a sequence of positive symbols and 0 as separator."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        self.seq_len = len(seq)
        whole = np.append(seq + 1, 0)  # 0 ends the sequence, 1 separates
        order = suffix_array(whole)
        bwt = whole[order - 1]
        self.tree = WaveletTree(bwt)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(whole, minlength=int(whole.max()) + 2))))
        marked = order % sample == 0
        self.marked, self.sampled = Bits(marked), order[marked]

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase; phrases are rows of symbols, aligned to the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.seq_len + 1, np.int64)
        top = len(self.counts) - 2
        for n in range(phrases.shape[1]):
            on = np.flatnonzero((n < lengths) & (low < high))
            if not len(on):
                break
            c = phrases[on, -1 - n] + 1
            here = c <= top
            high[on[~here]] = low[on[~here]]
            on, c = on[here], c[here]
            ranks = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.counts[c] + ranks[: len(c)], self.counts[c] + ranks[len(c) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out, steps, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.marked.get(rows[todo])
            hit = todo[done]
            out[hit] = self.sampled[self.marked.rank1(rows[hit])] + steps[hit]
            todo = todo[~done]
            c = self.tree.get(rows[todo])
            rows[todo] = self.counts[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
        return out


# --- test phrases -----------------------------------------------------------------------------------------------------


class Phrases:
    """The distinct windows of a block of test items, as numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[str, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                of.setdefault(tuple(own[at : at + window]), set()).add(item)
        self.lengths = np.array([len(p) for p in of], np.int64)
        self.rows = np.zeros((len(of), window), np.int64)
        for n, p in enumerate(of):
            self.rows[n, window - len(p) :] = p
        self.items = [sorted(x) for x in of.values()]
        self.shortest = int(self.lengths.min(initial=window))


def hits_of(numbers: list[np.ndarray], phrases: Phrases) -> list[tuple[np.ndarray, set[str]]]:
    """For each document of a shard, given as symbols: the merged spans (first word, last word + 1) and the items found."""
    out: list[tuple[np.ndarray, set[str]]] = [(np.empty((0, 2), np.int64), set())] * len(numbers)
    if not phrases.items or not numbers:
        return out
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    bases = np.concatenate(([0], np.cumsum(lengths + 1)))
    flat = np.zeros(int(bases[-1]), np.int64)  # one separator after each document
    for base, own in zip(bases, numbers, strict=False):
        flat[base : base + len(own)] = own
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flat > 0, [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return out
    sizes = ends - starts + 1
    source = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())  # with the separator behind
    index = FMIndex(flat[source])
    low, high = index.find(phrases.rows, phrases.lengths)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    rows = np.repeat(low[found] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    which = np.repeat(found, times)
    at = source[index.locate(rows)]
    by = np.argsort(at, kind="stable")
    at, which = at[by], which[by]
    ends = at + phrases.lengths[which]
    doc = np.searchsorted(bases, at, "right") - 1
    for d in np.unique(doc):
        here = slice(*np.searchsorted(doc, [d, d + 1]))
        s, e = at[here] - bases[d], np.maximum.accumulate(ends[here] - bases[d])
        new = np.concatenate(([True], s[1:] > e[:-1]))
        last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
        out[d] = (np.stack([s[new], e[last]], 1), {i for w in np.unique(which[here]) for i in phrases.items[w]})
    return out


# --- Spark ------------------------------------------------------------------------------------------------------------

#: Benchmarks are searched in blocks of about this many bytes, so what a task holds of them is bounded.
BLOCK_BYTES = 16 << 20
#: Characters of text in a shard, beside its last document.
SHARD_CHARS = 4_000_000


def _search(docs: DataFrame, items: list[tuple[str, str | None]], window: int, columns: list[T.StructField], give) -> DataFrame:
    """docs with added columns; give(words' matches, spans, items) makes them for each document."""
    names = [c.name for c in columns]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + columns)
    kept = [f.name for f in docs.schema.fields if f.name not in names]
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        number, lower = phrases.vocabulary.get, _LOWER
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            at = 0
            while at < len(batch):
                chars, first, numbers, values = 0, at, [], []
                while at < len(batch) and chars < SHARD_CHARS:
                    text = texts[at].as_py() or ""
                    own = WORD.findall(text.translate(lower) if not text.isascii() else text.lower())
                    numbers.append(np.fromiter((number(w, 0) for w in own), np.int64, len(own)))
                    chars += len(text)
                    at += 1
                for n, (spans, found) in enumerate(hits_of(numbers, phrases)):
                    values.append(give(texts[first + n].as_py(), len(numbers[n]), spans, found))
                part = batch.slice(first, at - first)
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                arrays += [pa.array([v[k] for v in values], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(c.dataType) for c in columns]
    return small_batches(docs).mapInArrow(run, schema)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, str | None]]]:
    """The items of a benchmark, which is small by its nature, in blocks; items without words can't occur and are left out.

    The size is measured first, and blocks are read one at a time by hash of the item, so no block goes far beyond block_bytes.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // block_bytes) or 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else rows
        yield [tuple(r) for r in own.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (array of [first word, last word + 1], merged), item_ids (sorted strings), n_hit.

    Windows are runs of ``window`` words of an item; an item of fewer words, but not none, is one window. Null texts have no
    words; items with a null id or text play no part. Several blocks of items are searched one after the other and their
    spans merged. A very long text is a shard of its own. Rows repeat as they come; other columns pass through, those of the names above are replaced.
    """
    spans_type, ids_type = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())
    out = None
    for items in benchmark_blocks(benchmark):
        first = out is None
        fields = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("_dc_spans", spans_type), ("_dc_items", ids_type))]
        found = _search(docs if first else out, items, window, fields, lambda text, n, spans, ids: (n, spans.tolist(), sorted(ids)))
        if first:
            out = found.withColumnsRenamed({"_dc_spans": "spans", "_dc_items": "item_ids"}) if "spans" not in docs.columns else found.drop("spans", "item_ids").withColumnsRenamed({"_dc_spans": "spans", "_dc_items": "item_ids"})
        else:
            both = F.array_sort(F.concat("spans", "_dc_spans"))
            merged = F.aggregate(
                both, F.array().cast(spans_type),
                lambda acc, s: F.when((F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= s[0]),
                    F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.get(F.get(acc, F.size(acc) - 1), F.lit(0)), F.greatest(s[1], F.get(F.get(acc, F.size(acc) - 1), F.lit(1)))))))
                .otherwise(F.concat(acc, F.array(s))),
            )
            out = found.withColumns({"spans": merged, "item_ids": F.array_sort(F.array_union("item_ids", "_dc_items"))}).drop("_dc_spans", "_dc_items")
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0]))


def _without(text: str | None, spans: list[list[int]]) -> str | None:
    """text without what lies from the first to the last word of each span."""
    if not spans:
        return text
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]  # as long as the text itself
    kept, end = [], 0
    for a, b in spans:
        kept.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join([*kept, text[end:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs whose texts have lost every stretch from the first to the last word of a merged span; clean texts don't change.

    A benchmark of one block is searched and cut out by one Python worker of a task: a second one would stay in the executor's
    pool, which later stages take workers from in turn.
    """
    blocks = benchmark_blocks(benchmark)
    items = next(blocks)
    if next(blocks, None) is None:
        return _search(docs, items, window, [docs.schema["text"]], lambda text, n, spans, ids: (_without(text, spans.tolist()),)).select(*docs.columns)
    own = {c: f"_dc_own_{c}" for c in ("n_words", "spans", "item_ids", "n_hit") if c in docs.columns}
    docs = docs.withColumnsRenamed(own)
    found = find_contamination(docs, benchmark, window)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "spans"))
            texts = [_without(t.as_py(), s.as_py()) for t, s in zip(texts, spans, strict=True)]
            arrays = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return found.mapInArrow(cut, schema).withColumnsRenamed({v: k for k, v in own.items()})


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the benchmark's windows hit, and which items these are of."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = {
    "op10_decontamination": r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT item, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS k FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS k
  FROM low, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM doc_windows JOIN windows USING (n, k)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""
}
