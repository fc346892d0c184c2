"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; all web text is the unlabelled sample, and no bad label is ever looked at. With
the class prior p, the risk of a linear score g under the logistic loss l is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]): the
second part estimates the risk on the negatives from unlabelled text and is held at zero. Each step sums gradient and
curvature over all rows in Spark. Where the estimate is below zero or would fall below it, the step also goes up the gradient
of that part alone, as the published correction does, until it ends at zero.

The prior is estimated from positives against unlabelled text: a first model is trained to tell half of the positives from
unlabelled text; at a score's threshold, the share of unlabelled text above it over the share of the other half of the
positives above it bounds the prior from above, and the threshold is the one where that share plus its confidence term is
least (best bin estimation).

In the end the constant is moved so that the mean score of unlabelled text is the prior: the floor lets the risk grow
confident of all text alike, which doesn't change the order of scores but their size.

Features of the whole text: symbols and classes of characters, pairs of neighbouring classes, hashed words, repetition, lengths.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.llm.common import crc_of_id, materialise, small_batches, table

SYMBOLS = tuple(chr(c) for c in range(33, 127) if not chr(c).isalnum())
CLASSES = ("lower", "upper", "digit", "blank", "newline", "symbol", "other")
WORD_BUCKETS = 16
CHUNK = 1 << 20


@cache
def _class_of() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, 6, np.uint8)
    for c in range(0x30000):
        x = chr(c)
        if x == "\n":
            out[c] = 4
        elif x.isspace():
            out[c] = 3
        elif x.isdigit():
            out[c] = 2
        elif x.isalpha():
            out[c] = 1 if x.isupper() else 0
        elif x in SYMBOLS:
            out[c] = 5
    return out


FEATURES = (
    "one", *(f"symbol {c}" for c in SYMBOLS), *CLASSES[:3], CLASSES[6], *(f"{a} {b}" for a in CLASSES for b in CLASSES), *(f"word {n}" for n in range(WORD_BUCKETS)),
    "repeated_words", "repeated_pairs", "repeated_neighbours", "repeated_lines", "top_word", "words", "word_length", "line_length", "empty",
)


def features(text: str | None) -> np.ndarray:
    """Of the whole text, as float32; all but the constant and ``empty`` are 0 where there is no word. Shares enter by their roots."""
    out = np.zeros(len(FEATURES), np.float32)
    out[0] = 1
    words = (text or "").split()
    if not words:
        out[-1] = 1
        return out
    n, k = len(text), len(CLASSES)
    pairs, points, last = np.zeros(k * k, np.int64), np.zeros(128, np.int64), None
    for at in range(0, n, CHUNK):
        code = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        points += np.bincount(code[code < 128], minlength=128)
        kind = _class_of()[code]
        if last is not None:
            kind = np.concatenate((last, kind))
        pairs += np.bincount(kind[:-1].astype(np.int64) * k + kind[1:], minlength=k * k)
        last = kind[-1:]
    single = pairs.reshape(k, k).sum(1)
    single[last[0]] += 1
    solid = max(1, int(single.sum() - single[3] - single[4]))
    parts = [np.sqrt(points[list(map(ord, SYMBOLS))] / solid), np.sqrt(single[[0, 1, 2, 6]] / solid), np.sqrt(pairs / max(1, n - 1))]
    counts = Counter(words)
    buckets = np.zeros(WORD_BUCKETS)
    for w, times in counts.items():
        buckets[zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS] += times
    parts.append(np.sqrt(buckets / len(words)))
    # Words repeat more in longer texts, so the share of distinct ones is set against its usual decline.
    usual = max(1.0, len(words) / 100) ** 0.15
    after = len(words) - 1
    lines = text.split("\n")
    parts.append(
        [
            1 - min(1.0, len(counts) / len(words) * usual), 1 - len(set(zip(words, words[1:], strict=False))) / max(1, after), math.sqrt(sum(map(str.__eq__, words, words[1:])) / max(1, after)),
            1 - len(set(lines)) / len(lines), math.sqrt(max(counts.values()) / len(words)), math.log1p(len(words)) / 5, math.log1p(solid / len(words)), math.log1p(n / len(lines)) / 5, 0.0,
        ]
    )
    out[1:] = np.concatenate(parts)
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of text, of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(batch.column(1))], names=["doc_id", "x"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


def _lists(texts: pa.Array) -> pa.Array:
    flat = [features(t.as_py()) for t in texts]
    d = len(FEATURES)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * d), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(FEATURES))


# --- sums over rows ---------------------------------------------------------------------------------------------------

#: Rows are unlabelled text; those with a number are trusted positives as well, dealt into two halves.
UNLABELLED, FIRST, SECOND = 0, 1, 2


def sums_of(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """n, sums of l(g), l(-g), x, s x and (upper triangle) s (1 - s) x x', with g = x theta and s its logistic value."""
    g = x @ theta
    s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
    curve = (x * (s * (1 - s))[:, None]).T @ x
    return np.concatenate([[len(x), np.logaddexp(0, -g).sum(), np.logaddexp(0, g).sum()], x.sum(0), s @ x, curve[np.triu_indices(x.shape[1])]])


class Sums:
    """sums_of() as means, by name."""

    def __init__(self, total: np.ndarray, d: int):
        self.n = total[0]
        mean = total / max(1.0, self.n)
        self.plus, self.minus, self.x, self.sx = mean[1], mean[2], mean[3 : 3 + d], mean[3 + d : 3 + 2 * d]
        self.curve = np.zeros((d, d))
        self.curve[np.triu_indices(d)] = mean[3 + 2 * d :]
        self.curve += np.triu(self.curve, 1).T


def summed(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, trusted: tuple[int, ...]) -> Callable[[np.ndarray], tuple[Sums, Sums]]:
    """The sums over all rows(x, positive), and over those that are trusted, for a given theta.

    Each task sends one array; a few tasks add these up, so that the driver gets a few arrays whatever the number of rows.
    """
    d = len(mean)

    def at(theta: np.ndarray) -> tuple[Sums, Sums]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 3 + 2 * d + d * (d + 1) // 2))
            for batch in batches:
                if len(batch):
                    x = (_matrix(batch.column(0)) - mean) / scale
                    total[0] += sums_of(x, theta)
                    total[1] += sums_of(x[np.isin(batch.column(1).to_numpy(), trusted)], theta)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((np.frombuffer(t.as_py()) for b in batches for t in b.column(0)), np.zeros(2 * (3 + 2 * d + d * (d + 1) // 2)))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

        parts = rows.select("x", "positive").mapInArrow(run, "total binary").repartition(4).mapInArrow(add, "total binary").collect()
        total = sum((np.frombuffer(r.total) for r in parts), np.zeros(2 * (3 + 2 * d + d * (d + 1) // 2))).reshape(2, -1)
        return Sums(total[0], d), Sums(total[1], d)

    return at


# --- learning ---------------------------------------------------------------------------------------------------------


def _newton(gradient: np.ndarray, curve: np.ndarray, theta: np.ndarray, ridge: float, floor: tuple[float, np.ndarray] | None = None) -> np.ndarray:
    """A step downwards, of at most 4 in each part; the constant isn't held back.

    floor is a value and its gradient: where the step would take it below zero, it goes up that gradient as far as needed.
    """
    pull = np.full(len(theta), ridge)
    pull[0] = 1e-9
    held = curve + np.diag(pull + 1e-9)
    step = -np.linalg.solve(held, gradient + pull * theta)
    if floor is not None:
        value, up = floor
        way = np.linalg.solve(held, up)
        step += way * max(0.0, 1e-5 - value - float(up @ step)) / max(float(up @ way), 1e-12)
    return step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))


def tell_apart(at: Callable[[np.ndarray], tuple[Sums, Sums]], d: int, ridge: float, rounds: int = 8) -> np.ndarray:
    """theta of a logistic model that tells trusted positives from unlabelled text, both sides weighing the same."""
    theta = np.zeros(d)
    for _ in range(rounds):
        u, p = at(theta)
        step = _newton(u.sx + p.sx - p.x, u.curve + p.curve, theta, ridge)
        theta = theta + step
        if np.abs(step).max() < 1e-3:
            break
    return theta


def best_bin_prior(unlabelled: np.ndarray, positives: np.ndarray, confidence: float = 0.1, gamma: float = 0.01) -> float:
    """The prior from the numbers of scores in bins, ascending."""
    n_u, n_p = max(1, unlabelled.sum()), max(1, positives.sum())
    above_u, above_p = (x[::-1].cumsum()[::-1] / n for x, n in ((unlabelled, n_u), (positives, n_p)))
    some = above_p > 0
    if not some.any():
        return 0.5
    doubt = sum(math.sqrt(math.log(4 / confidence) / (2 * n)) for n in (n_u, n_p))
    bound = above_u[some] / above_p[some] + (1 + gamma) * doubt / above_p[some]
    k = int(bound.argmin())
    return float(min(0.99, max(0.01, above_u[some][k] / above_p[some][k])))


class NonNegative:
    """The risk and its parts at a theta."""

    def __init__(self, u: Sums, p: Sums, theta: np.ndarray, prior: float, ridge: float):
        self.negative = u.minus - prior * p.minus
        self.risk = prior * p.plus + max(0.0, self.negative) + ridge / 2 * float(theta[1:] @ theta[1:])
        self.choice = self.risk + max(0.0, -self.negative)  # a risk that is low as the floor hides it isn't the best one
        self.gradient = u.sx - prior * p.x  # of both parts, as l(g) - l(-g) = -g
        self.up = u.sx - prior * p.sx  # of the negative part
        self.curve = u.curve


def fit(at: Callable[[np.ndarray], tuple[Sums, Sums]], d: int, prior: float, ridge: float, rounds: int = 15) -> np.ndarray:
    """theta of the least non-negative risk met on the way, what lies below the floor counting against it.

    Steps are Newton's; one that would take the negative part below zero also goes up that part's gradient, as far as it takes
    to end at zero. A step that makes things worse is halved.
    """
    theta = np.zeros(d)
    theta[0] = math.log(prior / (1 - prior))
    best, step = None, np.zeros(d)
    for _ in range(rounds):
        u, p = at(theta)
        if not p.n:
            break
        now = NonNegative(u, p, theta, prior, ridge)
        if best is not None and now.choice > best[0] + 1e-9:
            step = step / 2
        else:
            best = (now.choice, theta)
            step = _newton(now.gradient, now.curve, theta, ridge, (now.negative, now.up))
        theta = best[1] + step
        if np.abs(step).max() < 1e-3:
            break
    return best[1] if best else theta


#: Bins of scores before the logistic function, from -LIMIT to LIMIT.
LIMIT, FINE = 40.0, 8000


def matching_shift(counts: np.ndarray, prior: float) -> float:
    """What to add to g so that the mean of its logistic value is the prior; counts are of g in FINE bins."""
    g, low, high = (np.arange(FINE) + 0.5) * (2 * LIMIT / FINE) - LIMIT, -LIMIT, LIMIT
    if not counts.sum():
        return 0.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if counts @ (1 / (1 + np.exp(-(g + middle)))) > prior * counts.sum() else (middle, high)
    return (low + high) / 2


class QualityModel:
    def __init__(self, theta: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.theta, self.mean, self.scale, self.prior = theta, mean, scale, prior

    def linear(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.linear(x), -500, 500)))


def _binned(rows: DataFrame, bin_of: Callable[[np.ndarray], np.ndarray], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of all rows, and of the second half of the trusted ones, fall into each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, bins), np.int64)
        for batch in batches:
            at = np.clip(bin_of(_matrix(batch.column(0))).astype(np.int64), 0, bins - 1)
            counts[0] += np.bincount(at, minlength=bins)
            counts[1] += np.bincount(at[batch.column(1).to_numpy() == SECOND], minlength=bins)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bin", "u", "p"])

    found = rows.select("x", "positive").mapInArrow(run, "bin long, u long, p long").groupBy("bin").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect()
    out = np.zeros((2, bins))
    for r in found:
        out[:, r.bin] = r.u, r.p
    return out[0], out[1]


BINS = 1000


def learned(rows: DataFrame) -> QualityModel:
    """The model of rows(x, positive). Without trusted positives, or without rows, every score is the prior, a half then."""
    d = len(FEATURES)
    stats = {r.k: r for r in rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    mean, scale = np.zeros(d), np.ones(d)
    for k, r in stats.items():
        if k and r.s and r.s > 1e-6:
            mean[k], scale[k] = r.m, r.s
    trusted = {r.positive: r.n for r in rows.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = trusted.get(FIRST, 0) + trusted.get(SECOND, 0)
    if not n:
        return QualityModel(np.zeros(d), mean, scale, 0.5)
    ridge = max(1e-3, 1 / n)
    prior = 0.5
    if trusted.get(FIRST) and trusted.get(SECOND):
        theta = tell_apart(summed(rows, mean, scale, (FIRST,)), d, ridge)
        model = QualityModel(theta, mean, scale, 0.5)

        prior = best_bin_prior(*_binned(rows, lambda x: model.score(x) * BINS, BINS))
    model = QualityModel(fit(summed(rows, mean, scale, (FIRST, SECOND)), d, prior, ridge), mean, scale, prior)
    model.theta[0] += matching_shift(_binned(rows, lambda x: (np.clip(model.linear(x), -LIMIT, LIMIT) + LIMIT) * (FINE / (2 * LIMIT)), FINE)[0], prior)
    return model


def _fitted(docs: DataFrame, labels: DataFrame, folds: int) -> tuple[DataFrame, QualityModel]:
    """The written rows (doc_id, x, positive) of docs and the model learned from them."""
    crc = crc_of_id(F.col("doc_id"))
    trusted = labels.where((crc % folds != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1")
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.floor(crc / folds) % 2 == 0, FIRST).otherwise(SECOND).alias("half"))
    rows = featured(docs).join(trusted, "doc_id", "left").select("doc_id", "x", F.coalesce("half", F.lit(UNLABELLED)).alias("positive"))
    rows = materialise(rows)
    return rows, learned(rows)


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """docs' doc_id, held_out and score. Labels are learned from where crc32(doc_id) mod folds is not 0.

    Only good labels are used, bad ones never; the class prior is estimated from the texts. A score is made from the text
    alone; empty and null texts get one too, and very long ones are counted piece by piece. Repeated rows repeat; a doc_id
    labelled good and bad isn't trusted; rows with a null doc_id have no label. Texts with equal features tie.
    """
    x, model = _fitted(docs, labels, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    scored = x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % folds == 0, F.lit(False)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """The rows of docs with a score of at least threshold, all columns as they are; learned as in learn_and_score().

    The texts' features are made a second time rather than joined to the texts, which would shuffle all of them.
    """
    _, model = _fitted(docs, labels, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            if len(texts):
                yield batch.filter(pa.array(model.score(_matrix(_lists(texts))) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the score is of a linear model of the text, learned as learn_and_score() says."""
    scored = learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
