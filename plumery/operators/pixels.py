"""Spectral masks of pixels and what they say around candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumery.functions import geo
from plumery.operators import regions as R
from plumery.operators.graph import cut

NO_DATA = -9999


def saturated(spectrum: Column, first: int, last: int, threshold: float = 6.0) -> Column:
    """Any band from index first to last above the threshold."""
    return F.exists(F.slice(spectrum, first + 1, last - first + 1), lambda x: x > threshold)


def specular(is_saturated: Column, spectrum: Column, band: int = 25, threshold: float = 9.0) -> Column:
    return is_saturated & (F.get(spectrum, F.lit(band)) > threshold)


def dark(spectrum: Column, band: int = 352, threshold: float = 0.104) -> Column:
    v = F.get(spectrum, F.lit(band))
    return (v < threshold) & (v > NO_DATA)


def cloudy(spectrum: Column, bands: tuple[int, int, int] = (15, 60, 175), threshold: float = 15.0, require_second_slope: bool = True) -> Column:
    """Bright in the first band, and falling to the second (and from there to the third)."""
    a, b, c = (F.get(spectrum, F.lit(k)) for k in bands)
    out = (a > threshold) & (b < a)
    return out & (c < b) if require_second_slope else out


def bands_between(wavelengths: list[float], low: float = 1945.0, high: float = 2485.0) -> tuple[int, int]:
    """First and last band index of a range of wavelengths."""
    at = [n for n, w in enumerate(wavelengths) if low <= w <= high]
    if not at:
        raise ValueError("no band in that range")
    return at[0], at[-1]


def pixel_masks(spectra: DataFrame, swir: tuple[int, int], bands: dict | None = None) -> DataFrame:
    """spectra with the flags saturated, specular, dark and cloud, in one pass; bands has keyword arguments by flag."""
    s, kw = F.col("spectrum"), bands or {}
    sat = saturated(s, *swir, **kw.get("saturated", {}))
    return spectra.withColumns({"saturated": sat, "specular": specular(sat, s, **kw.get("specular", {})), "dark": dark(s, **kw.get("dark", {})), "cloud": cloudy(s, **kw.get("cloud", {}))})


def flare_mask(masks: DataFrame, radius: float, least: int | None = None, visible: float = 9.0) -> DataFrame:
    """(image_id, row, col, flare): 1 in saturated regions that aren't specular, 2 in the discs around their seeds.

    masks has saturated, specular and visible (radiance near 500 nm). Regions of fewer than ``least`` pixels don't count; seeds
    are pixels whose visible radiance is low. Regions are those of the whole image.
    """
    sat = R.connected_regions(masks.where("saturated").select("image_id", "row", "col", "specular", "visible")).transform(cut)
    big = R.without_small(sat, least) if least else sat
    buffer = R.dilate(big.where(F.col("visible") < visible), R.disc(radius)).withColumn("_b", F.lit(2))
    # Where an image has a region that counts, all its saturated pixels that aren't specular are flares.
    flare = sat.join(big.select("image_id").distinct(), "image_id", "left_semi").where("not specular").select("image_id", "row", "col", F.lit(1).alias("_f"))
    return buffer.join(flare, ["image_id", "row", "col"], "full").select("image_id", "row", "col", F.coalesce("_f", "_b").alias("flare"))


def four_bands(masks: DataFrame, cloud_reach: int, flare_radius: float, least: int | None = None) -> DataFrame:
    """(image_id, row, col, cloud, specular, flare, dark) as 0/1 (flare 0/1/2) for every pixel; -9999 where no_data is true."""
    keys = ["image_id", "row", "col"]
    cloud = R.dilate(masks.where("cloud"), R.diamond(cloud_reach)).withColumn("_c", F.lit(1))
    out = masks.join(cloud, keys, "left").join(flare_mask(masks, flare_radius, least), keys, "left")
    flag = lambda c: F.when(F.col("no_data"), NO_DATA).otherwise(c).cast("smallint")
    return out.select(
        *keys, flag(F.coalesce("_c", F.lit(0))).alias("cloud"), flag(F.col("specular").cast("int")).alias("specular"), flag(F.coalesce("flare", F.lit(0))).alias("flare"), flag(F.col("dark").cast("int")).alias("dark")
    )


def mask_lookup(candidates: DataFrame, masks: DataFrame, bands: list[str], window: int = 3) -> DataFrame:
    """candidates (candidate_id, image_id, line, sample, nline, nsamp) with, per band, 1 if any pixel near is set and has data.

    The window begins at the rounded place less its half and ends, exclusive, at place plus half plus 2, cut to the image, so
    it may be one wider than it says. Candidates of images without a mask are left out. The few candidates are spread to pixels.
    """
    half = window // 2
    low = lambda x, n: F.greatest(F.lit(0), F.least(F.rint(x).cast("int") - half, n - 1))
    high = lambda x, n: F.least((x + half + 2).cast("int"), n - 1)
    l0, l1, s0, s1 = low(F.col("line"), F.col("nline")), high(F.col("line"), F.col("nline")), low(F.col("sample"), F.col("nsamp")), high(F.col("sample"), F.col("nsamp"))
    at = candidates.withColumns({"_l0": l0, "_l1": l1, "_s0": s0, "_s1": s1}).where("_l1 > _l0 and _s1 > _s0")
    at = at.select("candidate_id", "image_id", F.explode(F.sequence("_l0", F.col("_l1") - 1)).alias("row"), "_s0", "_s1").select("candidate_id", "image_id", "row", F.explode(F.sequence("_s0", F.col("_s1") - 1)).alias("col"))
    near = at.join(masks, ["image_id", "row", "col"])
    found = near.groupBy("candidate_id").agg(*(F.max(((F.col(b) != 0) & (F.col(b) != NO_DATA)).cast("int")).alias(b) for b in bands))
    there = candidates.join(masks.select("image_id").distinct(), "image_id", "left_semi")
    return there.join(found, "candidate_id", "left").fillna(0, bands)


def clip_to_rings(pixels: DataFrame, features: DataFrame) -> DataFrame:
    """pixels (image_id, row, col, x, y, ...) inside each feature (feature_id, ring of x, y), with the crop's upper left row and col."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = features.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    size = boxed.agg(F.max(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))).first()[0] or 1.0
    size /= 8  # a pixel meets the rings whose boxes reach its cell, so small cells leave few that miss it
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    cells = boxed.select("feature_id", "ring", F.explode(span("_x0", "_x1")).alias("_cx"), "_y0", "_y1").select("feature_id", "ring", "_cx", F.explode(span("_y0", "_y1")).alias("_cy"))
    at = pixels.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    inside = at.join(cells, ["_cx", "_cy"]).where(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).drop("_cx", "_cy", "ring").transform(cut)  # read twice
    corner = inside.groupBy("feature_id", "image_id").agg(F.min("row").alias("row0"), F.min("col").alias("col0"))
    return inside.join(corner, ["feature_id", "image_id"])
