"""Linear flux inversion: background, normal equations summed over all observations, and the Bayesian update."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumery.operators.graph import cut

#: Unknowns whose normal matrix the driver may hold and solve; sums of so many parts are added at a time.
MAX_UNKNOWNS, FEW = 5000, 64


def background(obs: DataFrame, q: float = 0.05, pooled: bool = False) -> DataFrame:
    """obs(posix, xch4) with ``back``, the q-th percentile of its time; pooled mixes the time itself into the values."""
    if not pooled:
        per = obs.groupBy("posix").agg(F.percentile("xch4", q).alias("back"))
    else:
        v = obs.select("posix", F.explode(F.array(F.col("xch4").cast("double"), F.col("posix").cast("double"))).alias("v"))
        per = v.groupBy("posix").agg(F.percentile("v", q).alias("back"))
    return obs.join(per, "posix")


def normal_equations(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """H'WH, H'Wy and the number of rows(h array, y, w). Each task sums its share; entries are added up by Spark, not on the driver."""
    n = rows.select(F.max(F.size("h"))).first()[0] or 0
    if n > MAX_UNKNOWNS:
        raise ValueError(f"{n} unknowns; the normal matrix of more than {MAX_UNKNOWNS} isn't solved on one machine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1, n + 1))
        for batch in batches:
            h = np.asarray(batch.column(0).flatten(), float).reshape(-1, n)
            x = np.column_stack([h, np.asarray(batch.column(1), float)])
            total += (x * np.asarray(batch.column(2), float)[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    typed = rows.where("h is not null and y is not null").select(F.col("h").cast("array<double>"), F.col("y").cast("double"), F.col("w").cast("double"))
    total = np.zeros((n + 1) ** 2)
    for r in typed.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toLocalIterator():
        total[r.k] = r.v
    total = total.reshape(n + 1, n + 1)
    return total[:n, :n], total[:n, n], n


def gram(rows: DataFrame) -> DataFrame:
    """(i, j, value) of H'H over rows(h array), i <= j: sums per task first, then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            n = len(lists[0])
            h = np.asarray(lists.flatten(), float).reshape(-1, n)
            total = h.T @ h if total is None else total + h.T @ h
        if total is not None:
            i, j = np.triu_indices(n)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "value"])

    return rows.where("h is not null").select(F.col("h").cast("array<double>")).mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


class _NormalMatrix:
    """H'WH + ridge, known only by its products with a few vectors: rows (h, y, w) stay where they are, and each product is one pass
    in which a task multiplies its rows and adds them up. Vectors of the unknowns are all that the driver has."""

    def __init__(self, rows: DataFrame, ridge: float = 0.0) -> None:
        typed = rows.where("h is not null and y is not null")
        self.rows = typed.select(F.col("h").cast("array<double>"), F.col("y").cast("double"), F.col("w").cast("double")).transform(cut)
        self.n, self.ridge = self.rows.select(F.max(F.size("h"))).first()[0] or 0, ridge

    def _summed(self, use, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of use(h, y, w) over all rows; parts are added up by FEW at a time."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for at in range(0, len(batch), step := max(1, (4 << 20) // max(n, 1))):
                    part = batch.slice(at, step)
                    h = np.asarray(part.column(0).flatten(), float).reshape(-1, n)
                    total += use(h, np.asarray(part.column(1), float), np.asarray(part.column(2), float))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in group.sort_values("part")["sums"])
            return pd.DataFrame({"at": group["at"].iloc[:1], "sums": [total.tobytes()]})

        out = self.rows.mapInArrow(run, "sums binary").withColumn("at", F.spark_partition_id())
        most = self.rows.rdd.getNumPartitions()
        while most > FEW:
            out = out.select(F.col("at").alias("part"), (F.col("at") / FEW).cast("int").alias("at"), "sums").groupBy("at").applyInPandas(add, "at int, sums binary")
            most = -(-most // FEW)
        parts = sorted(((r.at, r.sums) for r in out.select("at", "sums").collect()), key=lambda p: p[0])  # at most FEW vectors
        return sum((np.frombuffer(bytes(x)).reshape(shape) for _, x in parts), np.zeros(shape))

    def right_side(self) -> tuple[np.ndarray, np.ndarray]:
        """H'Wy, and the diagonal of the matrix."""
        sums = self._summed(lambda h, y, w: np.stack([h.T @ (w * y), (h * h).T @ w]), (2, self.n))
        return sums[0], sums[1] + self.ridge

    def times(self, v: np.ndarray) -> np.ndarray:
        """The product with the columns of v (unknowns, columns)."""
        shared = self.rows.sparkSession.sparkContext.broadcast(v)  # a few vectors of the unknowns
        out = self._summed(lambda h, y, w: h.T @ (w[:, None] * (h @ shared.value)), v.shape) + self.ridge * v
        shared.destroy()
        return out


def conjugate_gradients(matrix: _NormalMatrix, b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-13, rounds: int | None = None) -> np.ndarray:
    """x with matrix x = b for the columns of b, each to a residual of ``tolerance`` times its own length; preconditioned by the diagonal.

    All columns share a pass a round. Raises where that many rounds (by default ten times the unknowns) aren't enough.
    """
    if (diagonal <= 0).any():
        raise np.linalg.LinAlgError("an unknown without any observation")
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal[:, None]
    p, rz = z.copy(), (r * z).sum(0)
    least = tolerance * np.sqrt((b * b).sum(0))
    for _ in range(rounds or 10 * len(b) + 10):
        if (np.sqrt((r * r).sum(0)) <= least).all():
            return x
        q = matrix.times(p)
        pq = (p * q).sum(0)
        step = np.divide(rz, pq, out=np.zeros_like(rz), where=pq > 0)
        x += step * p
        r -= step * q
        z = r / diagonal[:, None]
        new = (r * z).sum(0)
        p = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p
        rz = new
    raise np.linalg.LinAlgError("conjugate gradients haven't settled")


def _share_errors(rows: DataFrame, obs_error: float) -> DataFrame:
    """rows(h, xch4, back) with y and its weight; the error of y is a share of it, so y = 0 is an error."""
    y = F.col("xch4") - F.col("back")
    sure = F.when(y == 0, F.raise_error(F.lit("an observation equals its background"))).otherwise(y)
    return rows.select("h", y.alias("y"), (1 / F.pow(obs_error * sure, 2)).alias("w"))


def solve_fluxes(rows: DataFrame, offset: float = 1860.0, direct: int = MAX_UNKNOWNS) -> np.ndarray:
    """Least squares over rows(h, xch4): y = xch4 - offset.

    Up to ``direct`` unknowns the normal matrix is summed and solved; for more, conjugate gradients pass over the rows.
    """
    typed = rows.select("h", (F.col("xch4") - offset).alias("y"), F.lit(1.0).alias("w"))
    if (typed.select(F.max(F.size("h"))).first()[0] or 0) <= direct:
        a, b, _ = normal_equations(typed)
        return np.linalg.solve(a, b)
    matrix = _NormalMatrix(typed)
    b, diagonal = matrix.right_side()
    return conjugate_gradients(matrix, b[:, None], diagonal)[:, 0]


def posterior(rows: DataFrame, prior: float = 10.0, prior_error: float = 0.5, obs_error: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance over rows(h, xch4, back): errors of the prior and of y are shares of them; y = 0 is an error.

    The covariance is a matrix of the unknowns, so these are at most MAX_UNKNOWNS; for more there is posterior_of().
    """
    a, b, n = normal_equations(_share_errors(rows, obs_error))
    information = a + np.eye(n) / (prior_error * prior) ** 2
    covariance = np.linalg.inv(information)
    mean = prior + covariance @ (b - a @ np.full(n, prior))
    return mean, covariance


def posterior_of(
    rows: DataFrame, unknowns: list[int] | None = None, prior: float = 10.0, prior_error: float = 0.5, obs_error: float = 0.1, block: int = 64
) -> tuple[np.ndarray, np.ndarray]:
    """posterior()'s mean, and the covariances of the chosen unknowns with all (a column each), for any number of unknowns.

    Conjugate gradients solve for the mean and for a block of the identity's columns at a time; nothing of the size of the matrix
    is ever made, unless all unknowns are chosen.
    """
    matrix = _NormalMatrix(_share_errors(rows, obs_error), 1 / (prior_error * prior) ** 2)
    b, diagonal = matrix.right_side()
    start = np.full((matrix.n, 1), float(prior))
    mean = prior + conjugate_gradients(matrix, b[:, None] - (matrix.times(start) - matrix.ridge * start), diagonal)[:, 0]
    columns = []
    for at in range(0, len(unknowns or []), block):
        own = unknowns[at : at + block]
        unit = np.zeros((matrix.n, len(own)))
        unit[own, np.arange(len(own))] = 1
        columns.append(conjugate_gradients(matrix, unit, diagonal))
    return mean, np.concatenate(columns, 1) if columns else np.zeros((matrix.n, 0))


def on_grid(spark, values, lats: list[float], lons: list[float]) -> DataFrame:
    """(lat, lon, value) of a vector in row-major order of lats and lons."""
    flat = spark.createDataFrame([(list(map(float, values)), list(map(float, lats)), list(map(float, lons)))], "v array<double>, lats array<double>, lons array<double>")
    at = flat.select("lats", "lons", F.posexplode("v").alias("k", "value"))
    n = F.size("lons")
    return at.select(F.get("lats", F.floor(F.col("k") / n).cast("int")).alias("lat"), F.get("lons", F.col("k") % n).alias("lon"), "value")


def with_background_window(obs: DataFrame, q: float = 0.05) -> DataFrame:
    """The same background as a window over each time, where times are small groups."""
    return obs.withColumn("back", F.percentile("xch4", q).over(Window.partitionBy("posix")))
