"""Neighbourhood work on images: tiles with a halo, so that any tile size gives the result of the whole image."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumery.functions import geo
from plumery.operators.graph import cut
from plumery.operators.regions import whole_groups

Kernel = Callable[[np.ndarray, int, int], np.ndarray]


def map_tiles(pixels: DataFrame, shape: DataFrame, value: str, halo: int, fn: Kernel, tile: int = 256, edge: str = "zero", missing: float = 0.0, carry: list[str] | None = None) -> DataFrame:
    """(image_id, row, col, value) of fn over tiles of pixels with ``halo`` more on each side, and the columns ``carry`` of pixels.

    shape has image_id, nrow and ncol. fn takes the padded array and its upper left place and returns an array of the inner
    tile. Pixels that aren't in the table, or null, are ``missing``; outside the image is 0, or the image mirrored at its
    edge (edge="reflect"; the halo must not exceed a tile). Only pixels of the table come back; only those in reach of a border are
    copied. A task takes its tiles one after the other from sorted batches.
    """
    step = F.sequence(F.lit(-1), F.lit(1)) if halo else F.array(F.lit(0))
    if halo > tile:
        raise ValueError("the halo must not exceed the tile")
    carry = carry or []
    base = pixels.select("image_id", F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("v"), *(F.col(c).alias(f"_k_{c}") for c in carry))
    spread = base.withColumns({"r": F.floor(F.col("row") / tile).cast("int"), "c": F.floor(F.col("col") / tile).cast("int")})
    spread = spread.select("*", F.explode(F.transform(step, lambda d: F.col("r") + d)).alias("tr")).select("*", F.explode(F.transform(step, lambda d: F.col("c") + d)).alias("tc"))
    spread = spread.where(F.col("row").between(F.col("tr") * tile - halo, F.col("tr") * tile + tile + halo - 1) & F.col("col").between(F.col("tc") * tile - halo, F.col("tc") * tile + tile + halo - 1))
    spread = spread.join(shape.select("image_id", "nrow", "ncol"), "image_id")
    kept = [f"_k_{c}" for c in carry]
    spread = spread.select("image_id", "tr", "tc", "row", "col", "v", "nrow", "ncol", *kept)

    def one(tr: int, tc: int, nrow: int, ncol: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
        """fn's values at the rows of a tile that are its own; NaN at the others."""
        r0, c0 = tr * tile - halo, tc * tile - halo
        size = tile + 2 * halo
        a = np.full((size, size), missing)
        r, c = r - r0, c - c0
        own = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        out = np.full(len(r), np.nan)
        if not own.any():
            return out
        a[r, c] = np.where(np.isnan(v), missing, v)
        rows, cols = np.arange(r0, r0 + size), np.arange(c0, c0 + size)
        if edge == "reflect":
            mirror = lambda x, n: np.where(x < 0, -x - 1, np.where(x >= n, 2 * n - 1 - x, x))
            pick = lambda x, n, at: np.clip(mirror(x, n) - at, 0, size - 1)
            a = a[np.ix_(pick(rows, nrow, r0), pick(cols, ncol, c0))]
        else:
            a[(rows < 0) | (rows >= nrow), :] = 0.0
            a[:, (cols < 0) | (cols >= ncol)] = 0.0
        out[own] = fn(a, r0, c0)[r[own] - halo, c[own] - halo]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, code in whole_groups(batches, 3):
            tr, tc, row, col, v, nrow, ncol = (table.column(k).to_numpy() for k in ("tr", "tc", "row", "col", "v", "nrow", "ncol"))
            cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
            out = np.concatenate([one(int(tr[x]), int(tc[x]), int(nrow[x]), int(ncol[x]), row[x:y], col[x:y], v[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
            own = (row // tile == tr) & (col // tile == tc)
            done = table.select(["image_id", "row", "col"]).append_column("value", pa.array(out))
            for k in kept:
                done = done.append_column(k, table.column(k))
            yield from done.filter(pa.array(own)).to_batches()

    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(n, "image_id", "tr", "tc").sortWithinPartitions("image_id", "tr", "tc")
    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in ("image_id", "row", "col")), T.StructField("value", T.DoubleType()), *(T.StructField(k, kinds[k]) for k in kept)])
    return dealt.mapInArrow(run, schema).withColumnsRenamed({f"_k_{c}": c for c in carry})


def _convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of shifted copies along one axis, then the other."""
    h = len(kernel) // 2
    n, m = a.shape
    x = sum(k * a[i : n - 2 * h + i, :] for i, k in enumerate(kernel))
    return sum(k * x[:, i : m - 2 * h + i] for i, k in enumerate(kernel))


def gaussian(pixels: DataFrame, shape: DataFrame, value: str, sigma: float, truncate: float = 1.0, tile: int = 256, carry: list[str] | None = None) -> DataFrame:
    """Gaussian mean with mirrored edges, cut at truncate * sigma."""
    h = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    k /= k.sum()
    return map_tiles(pixels, shape, value, h, lambda a, r, c: _convolved(a, k), max(tile, h), "reflect", carry=carry)


def density_weighted(pixels: DataFrame, shape: DataFrame, sigma: float, low: float = 500.0, high: float = 1500.0, tile: int = 256) -> DataFrame:
    """pixels with ``weighted``: cmf times its image's Gaussian density scaled to 0 .. 1, then clipped between two thresholds."""
    others = [c for c in pixels.columns if c not in ("image_id", "row", "col")]
    dense = gaussian(pixels, shape, "cmf", sigma, tile=tile, carry=others).transform(cut)
    ends = dense.groupBy("image_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    both = dense.join(ends, "image_id")
    w = F.col("cmf") * (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return both.withColumn("weighted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (w - low) / (high - low)))).drop("value", "lo", "hi")


def downsample(pixels: DataFrame, shape: DataFrame, pixel_size: float, resolution: float, tile: int = 256) -> DataFrame:
    """cmf blurred to a coarser resolution and sampled there: (image_id, row, col in new pixels, cmf). Null stays null."""
    sigma = resolution / (2 * math.sqrt(2 * math.log(2))) / pixel_size
    width = math.ceil(resolution * math.sqrt(2) * 2 / pixel_size) | 1
    k = np.exp(-0.5 * (np.arange(-(width // 2), width // 2 + 1) / sigma) ** 2)
    k /= k.sum()
    blurred = map_tiles(pixels, shape, "cmf", width // 2, lambda a, r, c: _convolved(a, k), max(tile, width // 2), carry=["cmf"])
    step = resolution / pixel_size
    kept = blurred.withColumns({"_r": F.floor(F.col("row") / step).cast("int"), "_c": F.floor(F.col("col") / step).cast("int")})
    at = (F.col("row") == F.floor((F.col("_r") + 0.5) * step)) & (F.col("col") == F.floor((F.col("_c") + 0.5) * step))
    return kept.where(at).select("image_id", F.col("_r").alias("row"), F.col("_c").alias("col"), F.when(F.col("cmf").isNotNull(), F.col("value")).alias("cmf"))


def extract_tiles(pixels: DataFrame, corners: DataFrame, size: int, fill: float = 0.0) -> DataFrame:
    """(tile_id, row, col, value) of fixed-size tiles; corners has tile_id, image_id, row0 and col0; outside is ``fill``."""
    at = corners.select("tile_id", "image_id", "row0", "col0", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    at = at.withColumns({"row": F.col("row0") + F.col("i"), "col": F.col("col0") + F.col("j")})
    found = at.join(pixels.select("image_id", "row", "col", "cmf"), ["image_id", "row", "col"], "left")
    return found.select("tile_id", F.col("i").alias("row"), F.col("j").alias("col"), F.coalesce("cmf", F.lit(fill)).alias("value"))


def score_windows(pixels: DataFrame, shape: DataFrame, model: Callable[[np.ndarray], np.ndarray], dim: int, mean: float = 0.0, std: float = 1.0, high: float = 4000.0, batch: int = 256, tile: int = 64) -> DataFrame:
    """A score per pixel: model over the dim x dim window that reaches dim / 2 up and left of it and dim / 2 - 1 down and right.

    model maps (n, dim, dim) to n scores. Values are clamped and scaled first, and 0 stands outside of the image; pixels
    without data get null.
    """
    h = dim // 2
    ready = pixels.withColumn("_v", (F.greatest(F.lit(0.0), F.least(F.lit(high), F.col("cmf"))) - mean) / std)

    def run(a: np.ndarray, r0: int, c0: int) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(a, (dim, dim))[: a.shape[0] - 2 * h, : a.shape[1] - 2 * h]
        out = np.empty(windows.shape[:2])
        for at in range(0, out.size, batch):
            i, j = np.unravel_index(np.arange(at, min(at + batch, out.size)), out.shape)
            out[i, j] = model(windows[i, j])
        return out

    scored = map_tiles(ready, shape, "_v", h, run, max(tile, h), missing=(0.0 - mean) / std, carry=["cmf"])
    return scored.select("image_id", "row", "col", F.when(F.col("cmf").isNotNull(), F.col("value")).alias("score"))


def shift_and_stitch(pixels: DataFrame, shape: DataFrame, model: Callable[[np.ndarray], np.ndarray], scale: int, reach: int, tile: int = 256) -> DataFrame:
    """A score per pixel from a model that shrinks (n, h, w) to (n, h / scale, w / scale): every shift is scored, and the
    results interlaced. reach: how many cells of ``scale`` around its own a result depends on.
    """
    halo = (reach + 1) * scale
    tile = max(-(-tile // scale) * scale, halo)

    def run(a: np.ndarray, r0: int, c0: int) -> np.ndarray:
        # Moved down by t, a pixel's cell of the coarse result is a division's quotient, and t is what its remainder lacks to a whole cell.
        cell, rest = np.divmod(np.arange(halo, halo + tile) + scale // 2, scale)
        t = scale - 1 - rest
        moved = np.stack([np.pad(a, ((down, scale - down), (right, scale - right))) for down in range(scale) for right in range(scale)])
        coarse = np.asarray(model(moved)).reshape(scale, scale, moved.shape[1] // scale, moved.shape[2] // scale)
        return coarse[t[:, None], t[None, :], cell[:, None], cell[None, :]]

    return map_tiles(pixels, shape, "cmf", halo, run, tile).withColumnRenamed("value", "score")


def local_maxima(pixels: DataFrame, shape: DataFrame, radius: int, value: str = "cmf", tile: int = 256) -> DataFrame:
    """(image_id, row, col, value) of peaks: no larger value within 2 * radius in row and column, the first of equal ones in
    raster order, above the image's least value and at least that far from its edges."""
    d = 2 * radius

    def run(a: np.ndarray, r0: int, c0: int) -> np.ndarray:
        n, m = a.shape[0] - 2 * d, a.shape[1] - 2 * d
        own = a[d : d + n, d : d + m]
        peak = np.isfinite(own)
        for i in range(-d, d + 1):
            for j in range(-d, d + 1):
                other = a[d + i : d + i + n, d + j : d + j + m]
                peak &= (own > other) | (((i, j) > (0, 0)) & (own == other)) | ((i, j) == (0, 0))
        return np.where(peak, own, np.nan)

    pixels = pixels.select("image_id", "row", "col", value).transform(cut)  # read twice
    low = pixels.groupBy("image_id").agg(F.min(value).alias("_low"))
    found = map_tiles(pixels, shape, value, d, run, max(tile, d), missing=-np.inf).where(~F.isnan("value"))
    inside = found.join(shape, "image_id").where(F.col("row").between(d, F.col("nrow") - d - 1) & F.col("col").between(d, F.col("ncol") - d - 1))
    return inside.join(low, "image_id").where("value > _low").select("image_id", "row", "col", "value")


def bilinear_place(x: Column, y: Column) -> Column:
    """(a, b): where a place lies in the unit square of a cell; null where there is no such place.

    A cell has columns lat, lon and, with _e, _s and _se, those of the next corner to the right, below and across. Counted from the
    first corner, the place q is a e + b s + a b d, with d the corner across less a parallelogram's. Crossing out a leaves a quadratic
    equation of b, whose root nearer to that of the parallelogram is taken, or the other if only that is in the cell; both in
    the form that loses no digits. Values are bound, not repeated.
    """
    edge = lambda n: {f"{n}x": F.col(f"lon_{n}") - F.col("lon"), f"{n}y": F.col(f"lat_{n}") - F.col("lat")}
    across = {f"d{n}": F.col(f"{c}_se") - F.col(f"{c}_e") - F.col(f"{c}_s") + F.col(c) for n, c in (("x", "lon"), ("y", "lat"))}
    cross = lambda v, p, q: v[f"{p}x"] * v[f"{q}y"] - v[f"{p}y"] * v[f"{q}x"]

    def root(k: Column) -> Column:
        under = k["one"] * k["one"] - 4 * k["two"] * k["zero"]
        return -(k["one"] + F.when(k["one"] < 0, -1).otherwise(1) * F.sqrt(F.when(under >= 0, under))) / 2

    def chosen(r: Column) -> Column:
        near, far = r["k"]["zero"] / F.nullif(r["t"], F.lit(0.0)), r["t"] / F.nullif(r["k"]["two"], F.lit(0.0))
        return geo.let({"near": near, "far": far}, lambda n: F.when(n["near"].between(-1e-9, 1 + 1e-9), n["near"]).otherwise(F.coalesce(n["far"], n["near"])))

    def place(w: Column) -> Column:
        v, b = w["v"], w["b"]
        den = {n: v[f"e{n}"] + b * v[f"d{n}"] for n in "xy"}
        own = {n: (v[f"q{n}"] - b * v[f"s{n}"]) / F.nullif(den[n], F.lit(0.0)) for n in "xy"}
        return F.struct(F.when(F.abs(den["x"]) >= F.abs(den["y"]), own["x"]).otherwise(own["y"]).alias("a"), b.alias("b"))

    def solved(v: Column) -> Column:
        k = {"two": -cross(v, "s", "d"), "one": cross(v, "q", "d") - cross(v, "s", "e"), "zero": cross(v, "q", "e")}
        b = geo.let(k, lambda k: geo.let({"k": k, "t": root(k)}, chosen))
        return geo.let({"v": v, "b": b}, place)

    return geo.let(edge("e") | edge("s") | across | {"qx": x - F.col("lon"), "qy": y - F.col("lat")}, solved)


def regrid(pixels: DataFrame, value: str, step: float = 0.025, fill: float = -9999.9) -> DataFrame:
    """(image_id, lat, lon, value) on a regular grid, between the four pixels around each grid point.

    pixels has image_id, row, col, lat and lon. Within a cell of four pixels, whatever its shape, the bilinear map from the unit
    square to the cell is inverted, and the value is bilinear there. The grid covers all pixels, rounded to the step, and points
    in no cell, or beside a pixel without data, get ``fill``. Cells meet grid points by the rows and columns of the grid that they
    span; a point on a side of two cells takes the first one's value.
    """
    right = Window.partitionBy("image_id", "row").orderBy("col")
    p = pixels.select("image_id", "row", "col", "lat", "lon", F.col(value).alias("v"))
    e = p.withColumns({f"{c}_e": F.lead(c).over(right) for c in ("col", "lat", "lon", "v")}).where("col_e = col + 1").drop("col_e")
    s = p.select("image_id", (F.col("row") - 1).alias("row"), "col", *(F.col(c).alias(f"{c}_s") for c in ("lat", "lon", "v")))
    se = p.select("image_id", (F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), F.col("v").alias("v_se"), F.col("lat").alias("lat_se"), F.col("lon").alias("lon_se"))
    q = e.join(s, ["image_id", "row", "col"]).join(se, ["image_id", "row", "col"])
    lat, lon = ([F.col(x), F.col(f"{x}_e"), F.col(f"{x}_s"), F.col(f"{x}_se")] for x in ("lat", "lon"))
    span = lambda c: F.sequence(F.ceil(F.least(*c) / step), F.greatest(F.floor(F.greatest(*c) / step), F.ceil(F.least(*c) / step)))
    at = q.select("*", F.explode(span(lat)).alias("gy")).select("*", F.explode(span(lon)).alias("gx"))
    place = bilinear_place(F.col("gx") * step, F.col("gy") * step)
    inside = F.filter(F.array(place), lambda p: p["a"].between(-1e-9, 1 + 1e-9) & p["b"].between(-1e-9, 1 + 1e-9))
    at = at.select("*", F.explode(inside).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    mixed = F.col("v") * (1 - a) * (1 - b) + F.col("v_e") * a * (1 - b) + F.col("v_s") * (1 - a) * b + F.col("v_se") * a * b
    found = at.groupBy("image_id", "gy", "gx").agg(F.min_by(mixed, F.struct("row", "col")).alias("value"))
    ends = p.groupBy("image_id").agg(*(F.rint(f(c) / step).cast("long").alias(n) for f, c, n in ((F.min, "lat", "y0"), (F.max, "lat", "y1"), (F.min, "lon", "x0"), (F.max, "lon", "x1"))))
    grid = ends.select("image_id", F.explode(F.sequence("y0", "y1")).alias("gy"), "x0", "x1").select("image_id", "gy", F.explode(F.sequence("x0", "x1")).alias("gx"))
    return grid.join(found, ["image_id", "gy", "gx"], "left").select("image_id", (F.col("gy") * step).alias("lat"), (F.col("gx") * step).alias("lon"), F.coalesce("value", F.lit(fill)).alias("value"))


def absolute_norm(pixels: DataFrame, value: str = "cmf") -> DataFrame:
    """pixels with ``norm``: the range from minus to plus the image's largest absolute value, as 0 .. 1."""
    top = pixels.groupBy("image_id").agg(F.max(F.abs(value)).alias("_m"))
    return pixels.join(top, "image_id").withColumn("norm", (F.col(value) + F.col("_m")) / F.nullif(2 * F.col("_m"), F.lit(0.0))).drop("_m")


def shared_stretch(pixels: DataFrame, bands: list[str], p: float = 0.99) -> DataFrame:
    """pixels with each band scaled by the range that all bands' central shares p have in common."""
    from plumery.operators.triage import extrema

    long = pixels.unpivot(["image_id"], bands, "band", "v")
    ends = extrema(long, ["image_id", "band"], "v", p).groupBy("image_id").agg(F.max("low").alias("_lo"), F.min("high").alias("_hi"))
    scaled = {b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(b) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))) for b in bands}
    return pixels.join(ends, "image_id").withColumns(scaled).drop("_lo", "_hi")


def bilateral(pixels: DataFrame, shape: DataFrame, value: str, diameter: int, sigma_value: float, sigma_space: float, tile: int = 256) -> DataFrame:
    """Mean over a disc, weighted by nearness in place and in value; mirrored edges."""
    h = diameter // 2

    def run(a: np.ndarray, r0: int, c0: int) -> np.ndarray:
        n, m = a.shape[0] - 2 * h, a.shape[1] - 2 * h
        own, top, weight = a[h : h + n, h : h + m], 0.0, 0.0
        for i in range(-h, h + 1):
            for j in range(-h, h + 1):
                if i * i + j * j <= h * h:
                    other = a[h + i : h + i + n, h + j : h + j + m]
                    w = np.exp(-(i * i + j * j) / (2 * sigma_space**2) - (other - own) ** 2 / (2 * sigma_value**2))
                    top, weight = top + w * other, weight + w
        return top / weight

    return map_tiles(pixels, shape, value, h, run, max(tile, h), "reflect")
