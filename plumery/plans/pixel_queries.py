"""Queries on pixels: masks, regions, enhancement mass, matched filter and tile work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.operators import matched_filter as M
from plumery.operators import pixels as P
from plumery.operators import regions as R
from plumery.operators import tiles as T
from plumery.operators import triage
from plumery.plans import views as V
from plumery.plans.views import with_views

BANDS = {"specular": {"band": 25, "threshold": 1.1}, "dark": {"band": 52, "threshold": 1.05}, "cloud": {"bands": (15, 30, 45), "threshold": 1.1}, "saturated": {"threshold": 1.25}}


def pixel_masks(spark: SparkSession, d: str) -> DataFrame:
    return P.pixel_masks(V.spectra(spark, d), (40, 63), BANDS).select("pixel_id", "saturated", "specular", "dark", "cloud")


def _four(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of the sparse images with flags by their enhancement."""
    v = F.col("cmf")
    flags = {"cloud": v > 3800, "saturated": v > 3000, "specular": v > 4100, "dark": v < 0, "visible": v / 400, "no_data": F.col("col") == 0}
    return V.grid_pixels(spark, d).withColumns(flags)


def four_band_mask(spark: SparkSession, d: str) -> DataFrame:
    return P.four_bands(_four(spark, d), 1, 1.5, 2).select("image_id", "row", "col", "cloud", "specular", "flare", "dark")


def mask_lookup(spark: SparkSession, d: str) -> DataFrame:
    plumes = V.plumes(spark, d).where("lat is not null")
    at = plumes.select("candidate_id", F.expr(V.candidate_image(spark, d)), F.expr("(row_id % 61) + 0.25D AS line"), F.expr("(row_id % 59) + 0.75D AS sample"), F.lit(64).alias("nline"), F.lit(64).alias("nsamp"))
    masks = _four(spark, d).select("image_id", "row", "col", F.col("saturated").cast("int").alias("bright"), F.when(F.col("no_data"), -9999).otherwise(F.col("dark").cast("int")).alias("dark"))
    return P.mask_lookup(at, masks, ["bright", "dark"]).select("candidate_id", "bright", "dark")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return R.connected_regions(V.grid_pixels(spark, d).where("cmf > 1000"), tile=32)


def region_stats(spark: SparkSession, d: str) -> DataFrame:
    s = R.region_statistics(_regions(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("vmax", "vmin", "med", "mad", "total", "ime")})


def region_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.detections(V.grid_pixels(spark, d), 1000.0, 3500.0, 4).select("image_id", "row", "col", "region_id")


def region_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = R.merged_regions(V.grid_pixels(spark, d).where("cmf > 1000").select("image_id", "row", "col"), 1, tile=32)[1]
    return merged.select("image_id", "merged_id", F.array_join(F.col("originals").cast("array<string>"), ",").alias("originals"))


def region_borders(spark: SparkSession, d: str) -> DataFrame:
    return R.borders(_regions(spark, d)).select("image_id", "row", "col", "region_id")


def thick_borders(spark: SparkSession, d: str) -> DataFrame:
    return R.borders(_regions(spark, d), _shape(spark, d), "thick").select("image_id", "row", "col", "region_id")


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many pixels of an image have each whole value of the enhancement."""
    return triage.value_counts(V.grid_pixels(spark, d).withColumn("value", F.floor(F.col("cmf") / 10)), ["image_id"], "value")


def filled_holes(spark: SparkSession, d: str) -> DataFrame:
    return R.fill_holes(_regions(spark, d)).groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("n"))


def dilated(spark: SparkSession, d: str) -> DataFrame:
    return R.dilate(V.grid_pixels(spark, d).where("cmf > 3000"), R.diamond(2))


def row_extents(spark: SparkSession, d: str) -> DataFrame:
    return R.extents(V.grid_pixels(spark, d).where("cmf > 1000"))


def ime_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Mass above a threshold for each image and quarter of it."""
    from plumery.functions import physics

    at = V.grid_pixels(spark, d).where("cmf > 500").select("image_id", F.expr("(row div 32) * 2 + (col div 32) AS region_id"), "cmf")
    return at.groupBy("image_id", "region_id").agg(F.round(physics.ime_kg(F.sum("cmf"), F.lit(3.1)), 9).alias("ime"), F.count(F.lit(1)).alias("n"))


def matched_filter(spark: SparkSession, d: str) -> DataFrame:
    target = (1 + np.arange(64) % 7 / 10).tolist()
    return M.matched_filter(V.spectra(spark, d), target, keys=("image_id",)).withColumn("cmf", F.round("cmf", 4))


def filter_columns(spark: SparkSession, d: str) -> DataFrame:
    target = (1 + np.arange(64) % 7 / 10).tolist()
    return M.column_statistics(M.matched_filter(V.spectra(spark, d), target, keys=("image_id",), n_modes=2), keys=("image_id",))


def _shape(spark: SparkSession, d: str) -> DataFrame:
    return V.grid_images(spark, d).withColumns({"nrow": F.lit(64), "ncol": F.lit(64)})


def density_filter(spark: SparkSession, d: str) -> DataFrame:
    found = T.density_weighted(V.grid_pixels(spark, d), _shape(spark, d), 2.0, 500.0, 1500.0, tile=32)
    return found.select("image_id", "row", "col", F.round("weighted", 6).alias("weighted"))


def coarse_images(spark: SparkSession, d: str) -> DataFrame:
    return T.downsample(V.grid_pixels(spark, d), _shape(spark, d), 3.0, 12.0, tile=32).select("image_id", "row", "col", F.round("cmf", 6).alias("cmf"))


def window_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by a fixed stand-in for a trained model: a logistic function of the window's mean."""
    model = lambda w: 1 / (1 + np.exp(-(w.mean((1, 2)) * 20 - 1)))
    found = T.score_windows(V.grid_pixels(spark, d), _shape(spark, d), model, 8, 0.0, 4000.0, tile=32)
    return found.select("image_id", "row", "col", F.round("score", 6).alias("score"))


def stitched_scores(spark: SparkSession, d: str) -> DataFrame:
    model = lambda x: x.reshape(len(x), x.shape[1] // 4, 4, x.shape[2] // 4, 4).mean((2, 4))
    found = T.shift_and_stitch(V.grid_pixels(spark, d), _shape(spark, d), model, 4, 1, tile=32)
    return found.select("image_id", "row", "col", F.round("score", 6).alias("score"))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    return T.local_maxima(V.grid_pixels(spark, d), _shape(spark, d), 1, tile=32)


def normalised_images(spark: SparkSession, d: str) -> DataFrame:
    return T.absolute_norm(V.grid_pixels(spark, d)).select("image_id", "row", "col", F.round("norm", 9).alias("norm"))


QUERIES = {
    f.__name__: f
    for f in (
        pixel_masks, four_band_mask, mask_lookup, region_stats, region_filter, region_merge, region_borders, thick_borders, value_counts, filled_holes, dilated, row_extents, ime_by_region, matched_filter, filter_columns, density_filter,
        coarse_images, window_scores, stitched_scores, peaks, normalised_images,
    )
}

ORACLES = {
    "pixel_masks": with_views("spectra", """,
s AS (SELECT pixel_id, spectrum AS s, len(list_filter(spectrum[41:64], lambda x: x > 1.25)) > 0 AS saturated FROM spectra)
SELECT pixel_id, saturated, saturated AND s[26] > 1.1 AS specular, s[53] < 1.05 AND s[53] > -9999 AS dark, s[16] > 1.1 AND s[31] < s[16] AND s[46] < s[31] AS cloud FROM s"""),
    "mask_lookup": with_views("plumes grid_pixels", """,
c AS (SELECT candidate_id, row_id % m.n AS image_id, (row_id % 61)::INTEGER AS l, (row_id % 59)::INTEGER AS s FROM plumes, (SELECT max(l_orderkey // 1000) + 1 AS n FROM lineitem) m WHERE lat IS NOT NULL),
w AS (SELECT *, greatest(0, least(l - 1, 63)) AS l0, least(l + 3, 63) AS l1, greatest(0, least(s + 1 - 1, 63)) AS s0, least(s + 3, 63) AS s1 FROM c WHERE image_id IN (SELECT image_id FROM grid_pixels)),
f AS (SELECT candidate_id, max(CASE WHEN cmf > 3000 THEN 1 ELSE 0 END) AS bright, max(CASE WHEN col <> 0 AND cmf < 0 THEN 1 ELSE 0 END) AS dark
  FROM w JOIN grid_pixels g ON g.image_id = w.image_id AND g.row >= l0 AND g.row < l1 AND g.col >= s0 AND g.col < s1 GROUP BY ALL)
SELECT candidate_id, coalesce(bright, 0)::INTEGER AS bright, coalesce(dark, 0)::INTEGER AS dark FROM w LEFT JOIN f USING (candidate_id)"""),
    "dilated": with_views("grid_pixels", """, o AS (SELECT a.range - 2 AS a, b.range - 2 AS b FROM range(5) a, range(5) b WHERE abs(a.range - 2) + abs(b.range - 2) <= 2)
SELECT DISTINCT image_id, (row + a)::INTEGER AS row, (col + b)::INTEGER AS col FROM grid_pixels, o WHERE cmf > 3000"""),
    "row_extents": with_views("grid_pixels", " SELECT image_id, row, min(col) AS low, max(col) AS high, (min(col) + max(col)) / 2 AS mid FROM grid_pixels WHERE cmf > 1000 GROUP BY ALL"),
    "ime_by_region": with_views("grid_pixels", " SELECT image_id, ((row // 32) * 2 + col // 32)::BIGINT AS region_id, round(sum(cmf) * 3.1 * 3.1 * (1e-6 * 1000 / 22.4 * 0.01604), 9) AS ime, count(*) AS n FROM grid_pixels WHERE cmf > 500 GROUP BY ALL"),
    "value_counts": with_views("grid_pixels", " SELECT image_id, floor(cmf / 10)::BIGINT AS value, count(*) AS n FROM grid_pixels GROUP BY ALL"),
    "normalised_images": with_views("grid_pixels", ", m AS (SELECT image_id, max(abs(cmf)) AS m FROM grid_pixels GROUP BY ALL) SELECT image_id, row, col, round((cmf + m) / (2 * m), 9) AS norm FROM grid_pixels JOIN m USING (image_id)"),
    "peaks": with_views("grid_pixels", """, m AS (SELECT image_id, min(cmf) AS m FROM grid_pixels GROUP BY ALL)
SELECT image_id, row, col, cmf AS value FROM grid_pixels p JOIN m USING (image_id) WHERE cmf > m AND row BETWEEN 2 AND 61 AND col BETWEEN 2 AND 61 AND NOT EXISTS (
  SELECT 1 FROM grid_pixels q WHERE q.image_id = p.image_id AND abs(q.row - p.row) <= 2 AND abs(q.col - p.col) <= 2 AND (q.cmf > p.cmf OR (q.cmf = p.cmf AND (q.row, q.col) < (p.row, p.col))))"""),
}
