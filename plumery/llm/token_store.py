"""Token ids of documents in binary shards with constant-time keyed access.

A shard is one self-contained blob: raw little-endian ids of consecutive documents, their keys and offsets, and a minimal
perfect hash index from key to (fingerprint, row). Documents are range-partitioned by key, text hash and running number, each task
streams its sorted range through the encoder and closes a shard whenever the payload is large enough, be it inside a key. So a
task holds one shard at a time, and neither a frequent key nor the rows without one make a task or a shard large.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumery.llm.common import materialise, shared_dir, small_batches, table

MAGIC = b"PLTK"
HEAD = struct.Struct("<4sHHQQQH")  # magic, version, bytes per id, documents, keys, ids, levels


# --- minimal perfect hash ---------------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 of unsigned keys."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(((salt + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


FINGERPRINT_SALT = 1 << 20


class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of its bit in the first level where no other key shares it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        self.before, base = [], 0
        for c in counts:
            self.before.append(base + np.concatenate(([0], np.cumsum(c))))
            base = int(self.before[-1][-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64."""
        left, levels = keys.view(np.uint64), []
        while len(left):
            bits = 64 * max(1, -(-2 * len(left) // 64))
            at = _mix(left, len(levels)) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that fall through every level (others may get any slot: fingerprints tell)."""
        out, todo, keys = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys.view(np.uint64)
        for n, words in enumerate(self.levels):
            at = (_mix(keys[todo], n) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.before[n][at >> 6] + below)[hit]
            todo = todo[~hit]
        return out


# --- shard blobs ------------------------------------------------------------------------------------------------------


def pack_shard(keys: list[int | None], lengths: list[int], payload: bytes, width: int) -> bytes:
    """keys: ascending, nulls first; rows of the same key are neighbours and the index has the first of them."""
    known = np.array([k is not None for k in keys], bool)
    ids = np.array([k or 0 for k in keys], np.int64)
    first = known & np.concatenate(([True], (ids[1:] != ids[:-1]) | ~known[:-1]))[: len(ids)]
    index = PerfectHash.build(ids[first])
    slots = index.slots(ids[first])
    prints, rows = np.zeros(len(slots), np.uint32), np.zeros(len(slots), np.uint32)
    prints[slots], rows[slots] = _mix(ids[first].view(np.uint64), FINGERPRINT_SALT).astype(np.uint32), np.flatnonzero(first)
    offsets = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
    parts = [HEAD.pack(MAGIC, 1, width, len(ids), len(slots), int(offsets[-1]), len(index.levels))]
    parts += [np.array([len(x) for x in index.levels], np.uint64).tobytes(), *(x.tobytes() for x in index.levels)]
    return b"".join([*parts, prints.tobytes(), rows.tobytes(), known.astype(np.uint8).tobytes(), ids.tobytes(), offsets.tobytes(), payload])


class Shard:
    """Read access to a shard blob."""

    def __init__(self, blob: bytes):
        magic, version, width, n_docs, n_keys, n_ids, n_levels = HEAD.unpack_from(blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        self._at, self._blob = HEAD.size, blob
        sizes = self._take(np.uint64, n_levels)
        self.index = PerfectHash([self._take(np.uint64, int(n)) for n in sizes])
        self.prints, self.rows = self._take(np.uint32, n_keys), self._take(np.uint32, n_keys)
        self.known, self.keys = self._take(np.uint8, n_docs).astype(bool), self._take(np.int64, n_docs)
        self.offsets = self._take(np.int64, n_docs + 1)
        self.ids = self._take(np.uint16 if width == 2 else np.uint32, n_ids)

    def _take(self, kind: type, n: int) -> np.ndarray:
        out = np.frombuffer(self._blob, kind, n, self._at)
        self._at += out.nbytes
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key's first document, or -1 where the fingerprint says that the shard hasn't got it."""
        if not len(self.rows):
            return np.full(len(keys), -1, np.int64)
        slots = self.index.slots(keys)
        right = (slots >= 0) & (self.prints[slots] == _mix(keys.view(np.uint64), FINGERPRINT_SALT).astype(np.uint32))
        return np.where(right, self.rows[slots].astype(np.int64), -1)

    def of(self, row: int) -> np.ndarray:
        return self.ids[self.offsets[row] : self.offsets[row + 1]].astype("<u4")

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, row) of every document of each key, led by the hash to the first of them."""
        first = self.find(keys)
        found = np.flatnonzero(first >= 0)
        found = found[self.keys[first[found]] == keys[found]]  # a fingerprint can be another key's, once in 2^32
        ends = np.append(np.flatnonzero((self.keys[1:] != self.keys[:-1]) | (self.known[1:] != self.known[:-1])) + 1, len(self.keys))
        n = ends[np.searchsorted(ends, first[found], "right")] - first[found]
        return np.repeat(found, n), np.repeat(first[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


# --- encoding ---------------------------------------------------------------------------------------------------------

#: White space beside space and newline, as a pre-tokenizer may see it; texts that hold any are encoded in one piece.
ODD_BLANKS = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(map(chr, range(0x2000, 0x200B)))
PAIRS = ("  ", " \n", "\n ", "\n\n")


def plain_byte_bpe(parts: dict) -> bool:
    """Whether a tokenizer file's parts let words be encoded by themselves: no normaliser, the byte-level cut, a bare BPE model."""
    cut, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    return (
        parts.get("normalizer") is None
        and parts.get("truncation") is None
        and parts.get("padding") is None
        and cut.get("type") == "ByteLevel"
        and cut.get("add_prefix_space") is False
        and cut.get("use_regex", True) is True
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    )


class Encoder:
    """Ids of a byte-level BPE tokenizer of the tokenizers library, as little-endian bytes.

    A single blank between two words always starts a new piece, so words can be encoded by themselves and remembered.
    Texts where that doesn't hold (runs of blanks, other white space, special tokens) go through ``encode`` whole. So do all
    texts where the file declares anything else than a plain byte-level BPE with the usual way to cut words.
    """

    def __init__(self, path: str, remember: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = plain_byte_bpe(json.loads(self.tokenizer.to_str()))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code, self.bpe = "H" if self.width == 2 else "I", self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(256 + n) for n, b in enumerate(rest)}
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.simple = re.compile("[\x20-\u024f]*").fullmatch
        encoder, limit = self, remember

        class Memo(dict):
            def __init__(self, ahead: str):
                self.ahead = ahead

            def __missing__(self, word: str) -> bytes:
                if len(self) >= limit:
                    self.clear()
                piece = self.ahead + word
                if word.isalpha() and encoder.simple(word):
                    ids = encoder.word(piece)
                else:
                    ids = encoder.chunk(piece)
                self[word] = ids
                return ids

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= limit:
                    self.clear()
                found = self[piece] = encoder.word(piece)
                return found

        self.first, self.later, self.pieces = Memo(""), Memo(" "), Pieces()
        self.newline = self.pack(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.end = self.pack([0])

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, piece: str) -> bytes:
        """One piece of the pre-tokenizer."""
        if piece.isascii() and piece.isprintable():
            return array(self.code, [t.id for t in self.bpe(piece.replace(" ", self.letters[32]))]).tobytes()
        return array(self.code, [t.id for t in self.bpe(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def chunk(self, text: str) -> bytes:
        if not text:
            return b""
        if self.simple(text):
            return b"".join(map(self.pieces.__getitem__, self.cut(text)))
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or any(x in text for x in PAIRS) or any(x in text for x in ODD_BLANKS) or any(x in text for x in self.special):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        later, out = self.later.__getitem__, []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.newline)
            head, *words = line.split(" ")
            out.append(self.first[head])
            out.extend(map(later, words))
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


# --- writing and reading ----------------------------------------------------------------------------------------------

STORE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("min_key", pa.int64()), ("max_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())])


def write_token_store(docs: DataFrame, path: str, tokenizer: str, shard_bytes: int = 4 << 20, n_parts: int | None = None) -> None:
    """Encode every whole text of docs (null: empty), end each document with id 0, and write shards in order of doc_id.

    Rows with a null doc_id come first and can be read but not looked up; rows with the same doc_id all stay, in order of
    their texts' hashes, in one or more shards, and look-up finds all. Only doc_id and text are used. An empty table gives an
    empty store. A very long text is encoded whole, and its shard is as large as its ids.
    """
    n_parts = n_parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, lengths, payload, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            known = [k for k in keys if k is not None]
            blob = pack_shard(keys, lengths, b"".join(payload), enc.width)
            row = [part, seq, min(known, default=None), max(known, default=None), len(keys), size // enc.width, blob]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, STORE, strict=True)], schema=STORE)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size >= shard_bytes:
                    yield close()
                    keys, lengths, payload, size, seq = [], [], [], 0, seq + 1
                ids = enc(text.as_py()) + enc.end
                keys.append(key)
                lengths.append(len(ids) // enc.width)
                payload.append(ids)
                size += len(ids)
        if keys:
            yield close()

    order = ["doc_id", "text_hash", "running"]  # the running number only parts rows that are equal
    rows = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("running"))
    (rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, "part int, seq int, min_key long, max_key long, n_docs long, n_ids long, blob binary")
     .write.option("compression", "zstd").partitionBy("part").parquet(path))


SCHEMA = "seq int, min_key long, max_key long, n_docs long, n_ids long, blob binary, part int"


def _store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the store.

    A shard's keys are looked up in its perfect hash, and what is returned is read where the hash leads; only documents
    without a key are read by place. A key that the hash doesn't find is an error.
    """
    store = _store(spark, path)
    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(n) for n in range(3)), strict=True):
                shard = Shard(blob.as_py())
                asked = np.unique(shard.keys[shard.known])
                found, rows = shard.rows_of(asked)
                if len(rows) != shard.known.sum():
                    raise ValueError("a shard's index doesn't lead to its documents")
                bare = np.flatnonzero(~shard.known)
                keys, rows = pa.concat_arrays([pa.nulls(len(bare), pa.int64()), pa.array(asked[found])]), np.concatenate([bare, rows])
                crcs = [zlib.crc32(shard.of(n).tobytes()) for n in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), part.as_py(), np.int32)), pa.array(np.full(len(rows), seq.as_py(), np.int32)),
                        keys, pa.array(shard.offsets[rows]), pa.array(shard.offsets[rows + 1] - shard.offsets[rows]), pa.array(crcs, pa.int64()),
                    ],
                    schema=out,
                )

    sizes = store.select("part", "seq", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before.orderBy("part")), F.lit(0)).alias("base"))  # one row per partition
    inside = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0)).alias("offset"))
    starts = inside.join(F.broadcast(parts), "part")
    rows = store.select("part", "seq", "blob").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids array<long>) of each document of the store whose key is in keys.doc_id; unknown keys give no row.

    Partitions are in order of key: a key's are found by binary search in their bounds, of which there is one pair for each
    partition of the store. Each partition's list of shards is one row, joined on the partition; the document is where the
    shard's perfect hash says. Only partitions that a key leads to are read.
    """
    store = _store(spark, path)
    bounds = sorted((r.low, r.high, r.part) for r in store.where(F.col("min_key").isNotNull()).groupBy("part").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high")).collect())
    low, high, part = (np.array(x, np.int64) for x in (zip(*bounds, strict=True) if bounds else ([], [], [])))
    asked = keys.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull()).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            first, n = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")
            n = np.maximum(n - first, 0)
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n)), pa.array(part[at].astype(np.int32))], names=["doc_id", "part"])

    near = materialise(asked.mapInArrow(route, "doc_id long, part int"))
    wanted = sorted(r.part for r in near.select("part").distinct().collect())
    store = store.where(F.col("part").isin(wanted))
    shards = store.groupBy("part").agg(F.collect_list(F.struct("seq", "min_key", "max_key")).alias("shards"))
    holding = F.filter("shards", lambda s: F.col("doc_id").between(s["min_key"], s["max_key"]))
    near = near.join(shards, "part").select("doc_id", "part", F.explode(F.transform(holding, lambda s: s["seq"])).alias("seq"))

    def run(wanted: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        found = []
        asked = wanted["doc_id"].to_numpy(np.int64)
        for blob in shards["blob"] if len(asked) else []:
            shard = Shard(blob)
            found += [(int(asked[n]), shard.of(row).astype(np.int64)) for n, row in zip(*(x.tolist() for x in shard.rows_of(asked)), strict=True)]
        return pd.DataFrame(found, columns=["doc_id", "ids"])

    blobs = store.select("part", "seq", "blob")
    return near.groupBy("part", "seq").cogroup(blobs.groupBy("part", "seq")).applyInPandas(run, "doc_id long, ids array<long>")


def op3_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Start, number and checksum of every document's token ids, read back from the shards."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = shared_dir(spark)
    write_token_store(table(spark, sf_dir, "documents"), path, tokenizer)
    return read_token_store(spark, path)
