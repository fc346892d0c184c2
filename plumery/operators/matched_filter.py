"""Matched filter per detector column: background modes, shrunk covariance, enhancement of each pixel."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumery.operators.graph import cut, cut_dealt

#: Active channels, 1-based and inclusive, by what is sought.
ACTIVE = {"ch4": (351, 422), "co2": (309, 391), "ch4_reflectance": (5, 420)}
PPM_SCALING = 100_000.0
STABILITY = 100.0
#: Spectra of a key that one task may hold; larger keys are cut into parts of at most PART_SPECTRA. Sums of FEW parts are added at a time.
HELD_SPECTRA, PART_SPECTRA, FEW = 50_000, 20_000, 64


def alphas() -> np.ndarray:
    return 10 ** np.arange(-10, 0.05, 0.05)


def whitened(s: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Eigenvalues of a covariance in units of its target, the map of centred spectra to their axes, and the target's log
    determinant; None where the target isn't positive definite."""
    try:
        chol = np.linalg.cholesky(target * STABILITY**2)
        half = np.linalg.inv(chol)
        values, vectors = np.linalg.eigh(half @ (s * STABILITY**2) @ half.T)
    except np.linalg.LinAlgError:
        return None
    return values, STABILITY * half.T @ vectors, 2 * np.log(np.diag(chol)).sum()


def _candidates(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each shrinkage, the share of a left-out spectrum and the eigenvalues of the covariance without it."""
    beta = (1 - alphas()) / (n - 1.0) if n > 1 else np.full(len(alphas()), np.nan)
    return beta, n * beta[:, None] * values + alphas()[:, None]


def left_out(x: np.ndarray, axes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each shrinkage, the sum over zero-mean rows x of what leaving one of them out adds to the likelihood; sums of parts add up."""
    beta, g = _candidates(values, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (x @ axes) ** 2 @ (1 / g).T
        q = 1 - beta * r
        return (np.log(q) + r / q).sum(0)


def shrinkage(sums: np.ndarray, values: np.ndarray, n: int, log_target: float) -> float:
    """The shrinkage of the least negative log likelihood, the first of equals; 0 where none has one."""
    with np.errstate(invalid="ignore", divide="ignore"):
        g = _candidates(values, n)[1]
        nll = 0.5 * (len(values) * np.log(2 * np.pi) + np.log(g).sum(1) + log_target) + sums / (2 * n)
    return float(alphas()[np.nanargmin(nll)]) if not np.isnan(nll).all() else 0.0


def shrunk_covariance(x: np.ndarray, n: int, regulariser: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Covariance of zero-mean rows x, shrunk by leave-one-out likelihood, and the shrinkage.

    With the diagonal as target, whitening by it and one eigendecomposition make every candidate's determinant and quadratic
    forms sums over eigenvalues. Logarithms are summed, so nothing underflows.
    """
    s = np.atleast_2d(np.cov(x, rowvar=False, ddof=1))
    target = np.diag(np.diag(s)) if regulariser is None else np.atleast_2d(np.cov(regulariser, rowvar=False, ddof=1))
    if (found := whitened(s, target)) is None:
        return s, 0.0
    values, axes, log_target = found
    chosen = shrinkage(left_out(x, axes, values, n), values, n, log_target)
    return (1 - chosen) * s + chosen * target, chosen


def modes(x: np.ndarray, k: int, dims: int = 6, least: float | None = None, rounds: int = 25) -> np.ndarray:
    """Background modes 1 .. k of zero-mean rows by k-means on their main components; modes of fewer than ``least`` rows are
    negative. If all would be, none is. Starts are spread along the first component, so results repeat."""
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False)))
    p = x @ vectors[:, np.argsort(values)[::-1][:dims]]
    centres = p[np.argsort(p[:, 0])[((np.arange(k) + 0.5) * len(p) / k).astype(int)]]
    for _ in range(rounds):
        label = ((p[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([p[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    label = label + 1
    if least is not None:
        small = [j for j in range(1, k + 1) if 0 < (label == j).sum() < least]
        if len(small) < len(np.unique(label)):
            label = np.where(np.isin(label, small), -label, label)
    return label


def _weights(c: np.ndarray, mu: np.ndarray, absorption: np.ndarray, reflectance: bool) -> np.ndarray | None:
    """What a centred spectrum is multiplied by to give its enhancement; None for a singular background."""
    target = absorption - mu if reflectance else absorption * mu
    try:
        weights = np.linalg.solve(c, target)
    except np.linalg.LinAlgError:
        return None
    norm = float(target @ weights)
    return weights / norm * (1.0 if reflectance else PPM_SCALING) if norm and np.isfinite(norm) else None


def filter_column(spectra: np.ndarray, absorption: np.ndarray, reflectance: bool = False, model: str = "looshrinkage", n_modes: int = 1, median: bool = False, regularise_full: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Enhancement of each usable spectrum of a column, and its mode. A singular background gives 0."""
    centre = np.median if median else np.mean
    label = np.ones(len(spectra), int) if n_modes == 1 else modes(spectra - centre(spectra, axis=0), n_modes, least=1.2 * spectra.shape[1])
    out = np.zeros(len(spectra))
    for mode in np.unique(label):
        mask = label == mode
        own = spectra[mask if mode >= 0 else label >= 0]
        mu = centre(own, axis=0)
        if len(own) < 2:
            continue
        c = np.atleast_2d(np.cov(own - mu, rowvar=False, ddof=1)) if model == "empirical" else shrunk_covariance(own - mu, len(spectra), spectra - mu if regularise_full and n_modes > 1 else None)[0]
        if (weights := _weights(c, mu, absorption, reflectance)) is not None:
            out[mask] = (spectra[mask] - mu) @ weights
    return out, label


def matched_filter(
    spectra: DataFrame, absorption: list[float], keys: tuple[str, ...] = ("image_id", "col"), pixel: str = "pixel_id", active: tuple[int, int] | None = None,
    held: int = HELD_SPECTRA, **options,
) -> DataFrame:
    """keys, pixel, cmf and mode of every usable pixel of spectra (keys, pixel, spectrum).

    Pixels count if all active bands (1-based, inclusive; default all) are finite and not negative; only those bands are
    shuffled. options go to filter_column(). Keys of up to ``held`` spectra are one task's work each, after one shuffle; larger ones are
    spread over tasks, with the same result but for rounding: see spread_filter(). A centre by medians isn't a sum of parts, so
    with ``median`` every key is one task's. Null keys are a key like others; pixels of a key are distinct.
    """
    s = F.slice("spectrum", active[0], active[1] - active[0] + 1) if active else F.col("spectrum")
    use = spectra.select(*keys, pixel, s.cast("array<double>").alias("s")).where(F.forall("s", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))))
    lib = np.asarray(absorption, float)[slice(active[0] - 1, active[1]) if active else slice(None)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pixel)  # sums don't depend on how rows arrived
        value, mode = filter_column(np.stack(part["s"].to_numpy()), lib, **options)
        return part[[*keys, pixel]].assign(cmf=value, mode=mode)

    fields = [f for f in use.schema.fields if f.name != "s"]
    schema = T.StructType([*fields, T.StructField("cmf", T.DoubleType()), T.StructField("mode", T.LongType())])
    if options.get("median"):
        return use.groupBy(*keys).applyInPandas(run, schema)
    large = use.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > held).withColumn("_gid", F.monotonically_increasing_id()).transform(cut)
    if large.isEmpty():
        return use.groupBy(*keys).applyInPandas(run, schema)
    same = F.lit(True)
    for k in keys:
        same &= use[k].eqNullSafe(large[k])
    few = use.join(large, same, "left_anti").groupBy(*keys).applyInPandas(run, schema)
    rows = use.join(large, same).select("_gid", use[pixel].alias(pixel), "s", "_n")
    spread = spread_filter(rows.withColumnsRenamed({"_gid": "gid", "_n": "n"}), lib, pixel, min(held, PART_SPECTRA), **options)
    named = spread.join(large, spread["gid"] == large["_gid"]).select(*[large[k] for k in keys], spread[pixel], "cmf", "mode")
    return few.unionByName(named)


def _pack(**values) -> bytes:
    return pickle.dumps(values, protocol=5)


class _Spread:
    """Spectra of large keys in parts of a bounded number, and passes over them with a model of each key.

    rows has gid, part, the pixel and s. They are dealt out by (gid, part) once; each pass brings the models, which are small,
    to the parts, and what the parts give is added up by few of them at a time, so no task holds a key's spectra or all its sums.
    """

    def __init__(self, rows: DataFrame, pixel: str, held: int) -> None:
        n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys = rows.groupBy("gid").agg(F.max("n").alias("n")).withColumn("parts", F.ceil(F.col("n") / held).cast("int")).transform(cut)
        self.most = self.keys.agg(F.max("parts")).first()[0]
        dealt = rows.select("gid", F.pmod(F.xxhash64(pixel), F.ceil(F.col("n") / held)).cast("int").alias("part"), pixel, "s")
        self.rows, self.pixel = dealt.repartition(n_parts, "gid", "part").transform(cut_dealt), pixel

    def start(self) -> DataFrame:
        """(gid, model): of each key the number of its spectra."""
        return self.keys.select("gid", F.col("n").alias("n")).mapInPandas(lambda ps: (pd.DataFrame({"gid": p["gid"], "model": [_pack(n=n) for n in p["n"]]}) for p in ps), "gid long, model binary")

    def each(self, models: DataFrame, use, schema: str, rows: DataFrame | None = None) -> DataFrame:
        """What use(rows of a part, its key's model) gives."""
        spread = models.join(self.keys, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "model")
        pixel = self.pixel

        def run(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if not len(part):
                return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
            return use(part.sort_values(pixel), pickle.loads(model["model"].iloc[0]))

        return (self.rows if rows is None else rows).groupBy("gid", "part").cogroup(spread.groupBy("gid", "part")).applyInPandas(run, schema)

    def summed(self, models: DataFrame, use, rows: DataFrame | None = None) -> DataFrame:
        """(gid, model, sums): use(part's rows, model) gives an array, and those of a key are added up."""

        def partial(part: pd.DataFrame, model: dict) -> pd.DataFrame:
            return pd.DataFrame({"gid": part["gid"].iloc[:1], "part": part["part"].iloc[:1], "sums": [use(part, model).tobytes()]})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in group.sort_values("at")["sums"])
            return pd.DataFrame({"gid": group["gid"].iloc[:1], "part": group["part"].iloc[:1], "sums": [total.tobytes()]})

        out, most = self.each(models, partial, "gid long, part int, sums binary", rows), self.most
        while most > 1:
            out = out.select("gid", F.col("part").alias("at"), (F.col("part") / FEW).cast("int").alias("part"), "sums").groupBy("gid", "part").applyInPandas(add, "gid long, part int, sums binary")
            most = -(-most // FEW)
        return models.join(out.select("gid", "sums"), "gid")

    def updated(self, summed: DataFrame, make) -> DataFrame:
        """(gid, model) with what make(model, sums) adds to each model; written, as later passes build on it."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                models = [pickle.loads(m) for m in batch["model"]]
                yield pd.DataFrame({"gid": batch["gid"], "model": [_pack(**m, **make(m, np.frombuffer(s))) for m, s in zip(models, batch["sums"], strict=True)]})

        return summed.select("gid", "model", "sums").mapInPandas(run, "gid long, model binary").transform(cut)


def _x(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["s"].to_numpy())


def _labels(x: np.ndarray, model: dict) -> np.ndarray:
    """Modes 1 .. k of a key's spectra by its centres, negative where a mode is too small; all 1 without centres."""
    if "centres" not in model:
        return np.ones(len(x), int)
    p = (x - model["mean"]) @ model["main"]
    label = ((p[:, None, :] - model["centres"][None]) ** 2).sum(2).argmin(1)
    return model["signs"][label] * (label + 1)


def _groups(label: np.ndarray, model: dict) -> list[np.ndarray]:
    """Masks of the rows of each mode, and last of all rows of modes that are large enough, for those that aren't."""
    return [label == m for m in range(1, model.get("modes", 1) + 1)] + [label >= 0]


def _spread_modes(spread: _Spread, models: DataFrame, k: int, dims: int, rounds: int = 25) -> DataFrame:
    """models with centres and signs of k modes, as modes() finds them."""
    d = len(spread.rows.select("s").first()[0])

    def scatter(part: pd.DataFrame, model: dict) -> np.ndarray:
        x = _x(part) - model["mean"]
        return (x.T @ x).ravel()

    def main(model: dict, sums: np.ndarray) -> dict:
        values, vectors = np.linalg.eigh(sums.reshape(d, d) / (model["n"] - 1))
        return {"cov": sums.reshape(d, d) / (model["n"] - 1), "main": vectors[:, np.argsort(values)[::-1][:dims]], "modes": k}

    models = spread.updated(spread.summed(models, scatter), main)
    n_dims, pixel = min(dims, d), spread.pixel

    def project(part: pd.DataFrame, model: dict) -> pd.DataFrame:
        return part[["gid", "part", pixel]].assign(p=list((_x(part) - model["mean"]) @ model["main"]))

    kind = spread.rows.schema[pixel].dataType.simpleString()
    n_parts = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = spread.each(models, project, f"gid long, part int, {pixel} {kind}, p array<double>").repartition(n_parts, "gid", "part").transform(cut_dealt)
    # Starts: the projections at k even ranks along the first component, found by range partitions and the counts before each.
    first = F.get("p", F.lit(0))
    ranged = p.select("gid", pixel, "p", first.alias("first")).repartitionByRange("gid", "first", pixel).withColumn("at", F.spark_partition_id()).transform(cut)
    ahead = Window.partitionBy("gid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("gid", "at").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    ranks = spread.keys.select("gid", F.explode(F.array(*[F.floor((j + 0.5) * F.col("n") / k) for j in range(k)])).alias("rank")).distinct()
    inside = Window.partitionBy("gid", "at").orderBy("first", pixel)
    placed = ranged.join(before.select("gid", "at", "before"), ["gid", "at"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    starts = placed.join(ranks, ["gid", "rank"]).groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("rank", "p"))).alias("starts"))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            centres = [np.array([r["p"] for r in own]) for own in batch["starts"]]
            yield pd.DataFrame({"gid": batch["gid"], "model": [_pack(**pickle.loads(m), centres=c, signs=np.ones(k, int), done=False) for m, c in zip(batch["model"], centres, strict=True)]})

    models = models.join(starts, "gid").mapInPandas(begin, "gid long, model binary").transform(cut)

    def sums(part: pd.DataFrame, model: dict) -> np.ndarray:
        own = np.stack(part["p"].to_numpy())
        label = ((own[:, None, :] - model["centres"][None]) ** 2).sum(2).argmin(1)
        return np.concatenate([[(label == j).sum(), *own[label == j].sum(0)] for j in range(k)]).astype(float)

    for turn in range(rounds):
        last = turn == rounds - 1

        def move(batches: Iterator[pd.DataFrame], last=last) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for m, v in zip(batch["model"], batch["sums"], strict=True):
                    model, v = pickle.loads(m), np.frombuffer(v).reshape(k, 1 + n_dims)
                    n = v[:, :1]
                    new = np.where(n > 0, v[:, 1:] / np.maximum(n, 1), model["centres"])
                    # Labels are those by the centres before the last move.
                    model["done"] = model["done"] or last or np.allclose(new, model["centres"])
                    model["counts"] = n[:, 0]
                    out.append(_pack(**model | ({} if model["done"] else {"centres": new})))
                yield pd.DataFrame({"gid": batch["gid"], "model": out, "done": [pickle.loads(m)["done"] for m in out]})

        moved = spread.summed(models, sums, p).mapInPandas(move, "gid long, model binary, done boolean").transform(cut)
        models = moved.select("gid", "model")
        if moved.where("not done").isEmpty():
            break

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m in batch["model"]:
                model = pickle.loads(m)
                n = model["counts"]
                small = (n > 0) & (n < 1.2 * d)
                if small.sum() < (n > 0).sum():
                    model["signs"] = np.where(small, -1, 1)
                out.append(_pack(**model))
            yield pd.DataFrame({"gid": batch["gid"], "model": out})

    return models.mapInPandas(sign, "gid long, model binary").transform(cut)


def spread_filter(
    rows: DataFrame, absorption: np.ndarray, pixel: str, held: int, reflectance: bool = False, model: str = "looshrinkage", n_modes: int = 1, regularise_full: bool = False, median: bool = False
) -> DataFrame:
    """(gid, pixel, cmf, mode) of rows(gid, pixel, s, n), n being the number of the key's spectra: filter_column() over many tasks.

    Means, scatter matrices and the likelihoods of all shrinkages are sums over spectra, so each is one pass whose parts add up; what is
    worked out from them is a matrix of bands a mode. k-means takes a pass a round over the projections.
    """
    if median:
        raise ValueError("medians aren't sums of parts")
    d, spread = len(absorption), _Spread(rows, pixel, held)
    models = spread.updated(spread.summed(spread.start(), lambda part, m: _x(part).sum(0)), lambda m, s: {"mean": s / m["n"]})
    if n_modes > 1:
        models = _spread_modes(spread, models, n_modes, 6)

    def by_group(part: pd.DataFrame, m: dict, use) -> np.ndarray:
        x = _x(part)
        return np.concatenate([np.ravel(use(x[mask], k)) for k, mask in enumerate(_groups(_labels(x, m), m))])

    def means(m: dict, sums: np.ndarray) -> dict:
        sums = sums.reshape(-1, d + 1)
        return {"size": sums[:, 0], "mu": sums[:, 1:] / np.maximum(sums[:, :1], 1)}

    models = spread.updated(spread.summed(models, lambda part, m: by_group(part, m, lambda x, k: [len(x), *x.sum(0)]).astype(float)), means)

    def scatter(m: dict, sums: np.ndarray) -> dict:
        covs = [s / max(n - 1, 1) for s, n in zip(sums.reshape(-1, d, d), m["size"], strict=True)]
        targets = [m["cov"] if regularise_full and n_modes > 1 else np.diag(np.diag(c)) for c in covs]
        found = [whitened(c, t) if model == "looshrinkage" and n > 1 else None for c, t, n in zip(covs, targets, m["size"], strict=True)]
        return {"covs": covs, "targets": targets, "white": found}

    models = spread.updated(spread.summed(models, lambda part, m: by_group(part, m, lambda x, k: (x - m["mu"][k]).T @ (x - m["mu"][k]))), scatter)
    n_alphas = len(alphas())

    def likelihood(part: pd.DataFrame, m: dict) -> np.ndarray:
        def one(x: np.ndarray, k: int) -> np.ndarray:
            if (white := m["white"][k]) is None or not len(x):
                return np.zeros(n_alphas)
            return left_out(x - m["mu"][k], white[1], white[0], m["n"])

        return by_group(part, m, one)

    def weigh(m: dict, sums: np.ndarray) -> dict:
        weights = []
        for k, own in enumerate(sums.reshape(-1, n_alphas)):
            c, mu, white = m["covs"][k], m["mu"][k], m["white"][k]
            if white is not None:
                alpha = shrinkage(own, white[0], m["n"], white[2])
                c = (1 - alpha) * c + alpha * m["targets"][k]
            weights.append(_weights(c, mu, absorption, reflectance) if m["size"][k] > 1 else None)
        return {"weights": weights}

    models = spread.updated(spread.summed(models, likelihood), weigh)

    def enhance(part: pd.DataFrame, m: dict) -> pd.DataFrame:
        x = _x(part)
        label, out = _labels(x, m), np.zeros(len(x))
        for mode in np.unique(label):
            k = mode - 1 if mode > 0 else len(m["weights"]) - 1
            if m["weights"][k] is not None:
                mask = label == mode
                out[mask] = (x[mask] - m["mu"][k]) @ m["weights"][k]
        return part[["gid", pixel]].assign(cmf=out, mode=label.astype(np.int64))

    kind = rows.schema[pixel].dataType.simpleString()
    return spread.each(models, enhance, f"gid long, {pixel} {kind}, cmf double, mode long")


def column_statistics(filtered: DataFrame, keys: tuple[str, ...] = ("image_id", "col")) -> DataFrame:
    """Per column: used pixels, mean and population deviation of the enhancement outside rejected modes."""
    kept = F.when(F.col("mode") >= 0, F.col("cmf"))
    return filtered.groupBy(*keys).agg(F.count(F.lit(1)).alias("npix"), F.avg(kept).alias("avg"), F.stddev_pop(kept).alias("std"))


def with_bands(filtered: DataFrame, spectra: DataFrame, bands: tuple[int, int, int] = (60, 42, 24), keys: tuple[str, ...] = ("image_id", "col"), pixel: str = "pixel_id") -> DataFrame:
    """The filter's image: three visible bands of every pixel and its cmf, null where the pixel wasn't usable."""
    rgb = {c: F.get("spectrum", F.lit(b)) for c, b in zip("rgb", bands, strict=True)}
    return spectra.withColumns(rgb).drop("spectrum").join(filtered.select(*keys, pixel, "cmf"), [*keys, pixel], "left")
