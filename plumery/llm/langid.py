"""Language identification with bit-sliced Bloom filters of letter n-grams.

A language's filter holds the n-grams that are at home in it: those in at least ``min_share`` of its training documents and
not much rarer there than in the language where they are most common. The filters of all languages are stored side by
side: slot i holds one bit per language, so ANDing an n-gram's few slots gives the bitmask of all languages that contain it.
Per-language popcounts over a text, corrected for each filter's false positives, decide; of equal ones, the first in the order
of names. A text whose letters form no n-gram that any filter holds more often than by chance gets the most common training
language, with score 0.

Filters of all n-grams that training ever saw would hold nearly the same ones for every language, as texts quote each other:
held out at sf0.1, whole texts then fall from 1.000 to 0.992 and texts of three words from 0.998 to 0.701 (no least share, but
at home: 1.000 and 0.998, with filters that grow with the training text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.llm.common import crc_of_id, materialise, runs_of, small_batches, table

N = 3
CHUNK_CHARS = 1_000_000
N_HASHES = 4


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter and 0 if not."""
    out = np.zeros(0x110000, np.uint32)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    out[every] = every
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words, with their borders, of several texts: (text's index, 63-bit code), texts in order."""
    lowered = [t.lower() for t in texts]
    flat, sizes = "".join(t + "\n" for t in lowered), np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    points = _letters()[np.frombuffer(flat.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = points > 0
    keep[1:] |= points[:-1] > 0  # one border after each word
    points, owner = np.concatenate(([0], points[keep])).astype(np.uint64), np.concatenate((owner[:1], owner[keep]))
    if len(points) < N:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    code = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    inside = points[1:-1] > 0  # its middle is a letter
    return owner[1:-1][inside], code[inside]


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, docs): the number of training documents (lang, text) of each language that have an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, part in runs_of(texts, CHUNK_CHARS):
                owner, code = grams(part)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                own: dict[str, list[np.ndarray]] = {}
                for n in range(len(part)):
                    own.setdefault(langs[first + n], []).append(np.unique(code[cuts[n] : cuts[n + 1]]))
                for lang, found in own.items():
                    g, c = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "docs"])

    return small_batches(training).select("lang", "text").mapInArrow(run, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


@dataclass
class LanguageFilters:
    langs: list[str]
    slots: np.ndarray  # (planes, slots) of uint64: bit l of plane p is language 64 p + l
    false_rate: np.ndarray
    common: int = 0  # the language with most training documents

    def positions(self, code: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            z = code * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            z ^= z >> np.uint64(32)
        size = np.uint64(self.slots.shape[1] - 1)
        step = z >> np.uint64(32) | np.uint64(1)
        for k in range(N_HASHES):
            with np.errstate(over="ignore"):
                yield (z + np.uint64(k) * step & size).astype(np.int64)

    @classmethod
    def build(cls, langs: list[str], codes: list[np.ndarray], common: int = 0) -> LanguageFilters:
        size = 1 << max(10, int(12 * max(map(len, codes), default=1)).bit_length())
        out = cls(langs, np.zeros((-(-max(1, len(langs)) // 64), size), np.uint64), np.zeros(len(langs)), common)
        for n, code in enumerate(codes):
            for at in out.positions(code):
                out.slots[n // 64, at] |= np.uint64(1 << n % 64)
            fill = np.count_nonzero(out.slots[n // 64] & np.uint64(1 << n % 64)) / size
            out.false_rate[n] = fill**N_HASHES
        return out

    def containing(self, code: np.ndarray) -> np.ndarray:
        """(planes, n-grams): the languages whose filters hold each n-gram."""
        masks = None
        for at in self.positions(code):
            here = self.slots[:, at]
            masks = here if masks is None else masks & here
        return masks

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        owner, code = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        masks = self.containing(code) if len(code) else np.empty((self.slots.shape[0], 0), np.uint64)
        hits = np.stack([np.bincount(owner[(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=len(texts)) for k in range(len(self.langs))] or [np.zeros(len(texts))])
        rate = (self.false_rate if len(self.langs) else np.zeros(1))[:, None]
        true = np.maximum(0, (hits - rate * n) / (1 - rate))
        total = true.sum(0)
        best = np.where(total > 0, true.argmax(0), self.common)
        score = np.where(total > 0, true.max(0) / np.maximum(total, 1e-9), 0.0)
        known = (n > 0) & bool(self.langs)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0).tolist()


def learn(training: DataFrame, min_share: float = 0.02, min_ratio: float = 0.2) -> LanguageFilters:
    """Filters of all languages of training(lang, text); counts are taken over every row.

    What reaches the driver is bounded at any size: a language has at most (mean distinct n-grams of a document) / min_share
    n-grams that are in that share of its documents. The languages' sizes are broadcast, one row for each; a filter has a bit
    for each as well, so they must be few.
    """
    training = training.where("lang is not null and text is not null")
    sizes = training.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    shares = materialise(gram_counts(training).join(F.broadcast(sizes), "lang").select("lang", "gram", (F.col("docs") / F.col("n")).alias("share")).where(F.col("share") >= min_share))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    home = shares.join(top, "gram").where(F.col("share") >= min_ratio * F.col("top"))
    found = {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in home.groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).collect()}
    counts = {r.lang: r.n for r in sizes.collect()}
    langs = sorted(counts)
    common = max(range(len(langs)), key=lambda n: counts[langs[n]], default=0)
    return LanguageFilters.build(langs, [found.get(x, np.empty(0, np.uint64)) for x in langs], common)


def predict_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs, from its text alone; ``und`` with score 0 for texts without a letter.

    A very long text is looked at whole, with about 40 bytes a character for as long as that takes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, part in runs_of([t or "" for t in batch.column(1).to_pylist()], CHUNK_CHARS):
                a, b = shared.value.predict(part)
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns where crc32(doc_id) mod 4 is not 2 (rows with a null doc_id aren't learned from); predicts every row."""
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id(F.col("doc_id")) % 4 == 2
    filters = learn(docs.where(~held).select("lang", "text"))
    return predict_languages(docs, filters).select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
