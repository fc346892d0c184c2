"""Further operators, one query each: nearness of candidates, hulls, crops, tiles, discs, regridding and view geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.functions import geo
from plumery.operators import evaluation, overlap, pixels, qc, regions, tiles, triage, wind
from plumery.plans import views as V
from plumery.plans.views import with_views


def known_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Reviews whose place and label an even review has as well, within half a unit."""
    at = V.qc_cid(spark, d).selectExpr("row_id", "label", "(row_id % 97) * 0.37D AS x", "(row_id % 29) * 0.41D AS y")
    return overlap.exists_near(at.where("row_id % 2 = 1"), at.where("row_id % 2 = 0")).select("row_id", "label")


def facility_hulls(spark: SparkSession, d: str) -> DataFrame:
    """The corners of each facility's hull, counter-clockwise from the west, in whole steps of 0.0005 degrees."""
    step = lambda c, low: F.rint((F.col(c) - low) * 2000)
    p = V.plumes(spark, d).where("lat is not null").select(F.col("facility").alias("key"), step("lon", -119).alias("x"), step("lat", 34).alias("y"))
    return overlap.convex_hulls(p).select("key", F.posexplode("hull").alias("n", "p")).select("key", "n", F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))


def points_in_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the sparse images, placed on the map, inside each flight line."""
    at = V.grid_pixels(spark, d).selectExpr("image_id", "row", "col", "-119.3D + (col + 0.5D) * 0.0317D AS x", "33.7D + (row + 0.5D) * 0.0313D AS y")
    found = pixels.clip_to_rings(at, V.flightlines(spark, d).withColumnRenamed("flight_run", "feature_id"))
    return found.groupBy("feature_id", "image_id").agg(F.count(F.lit(1)).alias("n"), F.min("row0").alias("row0"), F.min("col0").alias("col0"))


def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the regions that candidates lie in."""
    found = regions.connected_regions(V.grid_pixels(spark, d).where("cmf > 2500"))
    at = V.plumes(spark, d).selectExpr(V.candidate_image(spark, d), "cast(row_id % 61 as int) AS row", "cast(row_id % 59 as int) AS col", "facility AS label").distinct()
    return regions.weak_labels(found, at).select("image_id", "row", "col", "region_id", "label")


def cut_tiles(spark: SparkSession, d: str) -> DataFrame:
    corners = V.plumes(spark, d).where("lat is not null").selectExpr("row_id AS tile_id", V.candidate_image(spark, d), "cast(row_id % 61 as int) - 2 AS row0", "cast(row_id % 59 as int) - 2 AS col0")
    return tiles.extract_tiles(V.grid_pixels(spark, d), corners, 4).groupBy("tile_id").agg(F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


def location_discs(spark: SparkSession, d: str) -> DataFrame:
    at = V.plumes(spark, d).selectExpr(V.candidate_image(spark, d), "cast(row_id % 211 as int) AS row", "cast(row_id % 199 as int) AS col").distinct()
    return regions.distance_discs(at, [1.0, 2.0])


def candidate_mass(spark: SparkSession, d: str) -> DataFrame:
    at = V.plumes(spark, d).selectExpr("row_id AS candidate_id", V.candidate_image(spark, d), "cast(row_id % 61 as int) AS row", "cast(row_id % 59 as int) AS col")
    found = regions.candidate_ime(V.grid_pixels(spark, d), at, 500.0, 4000.0, 4, 1, 3)
    return found.select("candidate_id", "n", F.round("ime", 9).alias("ime"), F.round("ime_per_fetch", 9).alias("ime_per_fetch"))


def regular_wind(spark: SparkSession, d: str) -> DataFrame:
    """Wind of every hour on a regular grid."""
    w = V.wind(spark, d).selectExpr("date_format(valid_time, 'yyyyMMddHH') AS image_id", "cast(grid_id div 20 as int) AS row", "cast(grid_id % 20 as int) AS col", "lat", "lon", "u")
    return tiles.regrid(w, "u", 0.1).select("image_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("value", 6).alias("value"))


def tile_samples(spark: SparkSession, d: str) -> DataFrame:
    at = V.grid_pixels(spark, d).withColumn("label", F.when(F.col("cmf") > 3500, 1).when(F.col("cmf") > 0, 0).otherwise(-1))
    return evaluation.sample_tiles(at, {1: 500, 0: 500, -1: 100}, 16)


def view_outliers(spark: SparkSession, d: str) -> DataFrame:
    obs = V.events(spark, d).selectExpr("user_id % 9 AS image_id", "value AS path_length", "cast(event_id % 37 as double) AS zenith")
    return triage.view_outliers(obs)


def score_detections(spark: SparkSession, d: str) -> DataFrame:
    at = V.grid_pixels(spark, d).withColumn("score", F.col("cmf") / 4200)
    found = regions.score_regions(at)
    return found.select("detection_id", "n", "rmin", "rmax", "cmin", "cmax", "max_row", "max_col", F.round("vmax", 9).alias("vmax"), F.round("cmf_med", 6).alias("cmf_med"))


def wind_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of two heights as columns named as in plume lists; the upper wind is the lower one times 1.5."""
    plumes, low = V.plumes(spark, d), V.wind(spark, d)
    near = wind.nearest_points(plumes.select(F.xxhash64("lat", "lon").alias("place_id"), "lat", "lon").distinct(), low)
    stats = {alt: wind.wind_statistics(wind.wind_of_plumes(plumes, low.withColumns({c: F.col(c) * k for c in "uv"}), neighbours=near)) for alt, k in ((10, 1.0), (80, 1.5))}
    out = wind.wind_columns(plumes.select("candidate_id"), {("HRRR", alt): s for alt, s in stats.items()})
    return out.withColumns({c: F.round(f"`{c}`", 6) for c in out.columns[1:]})


def line_users(spark: SparkSession, d: str) -> DataFrame:
    """Flight lines dealt to 5 users in order of a hash, and how many each has."""
    return qc.assign_users(V.qc_lid(spark, d), 5).groupBy("user").agg(F.count(F.lit(1)).alias("n"))


def images_in_lines(spark: SparkSession, d: str) -> DataFrame:
    """Images, one per plume, of the flight lines that a facility's plumes lie on."""
    p = V.plumes(spark, d)
    images = p.select("row_id", F.concat("lid", F.lit("_ch4mf_v2y1_img")).alias("name"))
    return qc.images_of_lines(images, p.where("facility = 'F1' and row_id % 3 = 0").select("lid"))


def equal_area(spark: SparkSession, d: str) -> DataFrame:
    """Grid points in equal-area metres and their box, with a border of a tenth."""
    at = V.wind(spark, d).select("grid_id", "lat", "lon").distinct().withColumn("p", geo.albers(F.col("lat"), F.col("lon")))
    box = at.groupBy((F.col("grid_id") % 7).alias("part")).agg(*(f(f"p.{c}").alias(n) for f, c, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))))
    b = geo.bounded_box(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), 0.1)
    return box.select("part", *(F.round(b[c], 3).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")))


QUERIES = {
    f.__name__: f
    for f in (known_candidates, facility_hulls, points_in_lines, weak_labels, cut_tiles, location_discs, candidate_mass, regular_wind, tile_samples, view_outliers, score_detections, wind_pivot, line_users, images_in_lines, equal_area)
}

ORACLES = {
    "facility_hulls": with_views("plumes", """,
pts AS (SELECT DISTINCT facility AS key, round((lon + 119) * 2000)::BIGINT AS x, round((lat - 34) * 2000)::BIGINT AS y FROM plumes WHERE lat IS NOT NULL),
ends AS MATERIALIZED (SELECT key, x, unnest([min(y), max(y)]) AS y FROM pts GROUP BY key, x),
e AS MATERIALIZED (SELECT DISTINCT * FROM ends),
side AS (SELECT p.key, p.x, p.y, q.x AS qx, q.y AS qy FROM e p JOIN e q ON p.key = q.key AND (p.x, p.y) <> (q.x, q.y)
  WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.key = p.key AND (
    (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
    OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND ((r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) < 0 OR (r.x - p.x) ** 2 + (r.y - p.y) ** 2 > (q.x - p.x) ** 2 + (q.y - p.y) ** 2))))),
m AS (SELECT key, avg(x) AS mx, avg(y) AS my FROM side GROUP BY key),
w AS (SELECT key, arg_min({'x': x, 'y': y}, (x, y)) AS s FROM side GROUP BY key),
turned AS (SELECT key, x, y, atan2(y - my, x - mx) AS a, atan2(s.y - my, s.x - mx) AS a0 FROM side JOIN m USING (key) JOIN w USING (key))
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY CASE WHEN a >= a0 THEN a ELSE a + 2 * pi() END) - 1)::INTEGER AS n, x, y FROM turned"""),
    "images_in_lines": with_views("plumes", " SELECT row_id, lid || '_ch4mf_v2y1_img' AS name FROM plumes WHERE lid IN (SELECT lid FROM plumes WHERE facility = 'F1' AND row_id % 3 = 0)"),
    "known_candidates": with_views("qc_cid", """, a AS (SELECT row_id, label, (row_id % 97) * 0.37::DOUBLE AS x, (row_id % 29) * 0.41::DOUBLE AS y FROM qc_cid)
SELECT row_id, label FROM a WHERE row_id % 2 = 1 AND EXISTS (SELECT 1 FROM a b WHERE b.row_id % 2 = 0 AND b.label = a.label AND abs(b.x - a.x) < 0.5 AND abs(b.y - a.y) < 0.5)"""),
    "points_in_lines": with_views("grid_pixels flightlines", """, p AS (SELECT image_id, row, col, -119.3::DOUBLE + (col + 0.5::DOUBLE) * 0.0317::DOUBLE AS x, 33.7::DOUBLE + (row + 0.5::DOUBLE) * 0.0313::DOUBLE AS y FROM grid_pixels)
SELECT flight_run AS feature_id, image_id, count(*) AS n, min(row) AS row0, min(col) AS col0 FROM p, flightlines WHERE abs(x - cx) / a + abs(y - cy) / b < 1 GROUP BY ALL"""),
    "cut_tiles": with_views("plumes grid_pixels", """,
t AS (SELECT row_id AS tile_id, row_id % m.n AS image_id, row_id % 61 - 2 + i.range AS row, row_id % 59 - 2 + j.range AS col FROM plumes, range(4) i, range(4) j, (SELECT max(l_orderkey // 1000) + 1 AS n FROM lineitem) m WHERE lat IS NOT NULL)
SELECT tile_id, round(sum(coalesce(cmf, 0)), 6) AS total, count(*) AS n FROM t LEFT JOIN grid_pixels g ON g.image_id = t.image_id AND g.row = t.row AND g.col = t.col GROUP BY ALL"""),
    "location_discs": with_views("plumes", """,
o AS (SELECT a.range - 2 AS a, b.range - 2 AS b, d FROM range(5) a, range(5) b, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) t(d) WHERE pow(a.range - 2, 2) + pow(b.range - 2, 2) <= d * d)
SELECT row_id % m.n AS image_id, (row_id % 211 + a)::INTEGER AS row, (row_id % 199 + b)::INTEGER AS col, max(d) AS distance FROM plumes, o, (SELECT max(l_orderkey // 1000) + 1 AS n FROM lineitem) m GROUP BY ALL"""),
    "view_outliers": """
SELECT user_id % 9 AS image_id, count(*) FILTER (WHERE event_id % 37 > 20) AS n_outside, min(value) FILTER (WHERE event_id % 37 > 20) AS min_outside, max(value) FILTER (WHERE event_id % 37 > 20) AS max_outside,
  min(value) FILTER (WHERE event_id % 37 <= 20) AS min_inside, max(value) FILTER (WHERE event_id % 37 <= 20) AS max_inside FROM events GROUP BY ALL""",
    "line_users": with_views("qc_lid", ", n AS (SELECT count(DISTINCT lid) AS n FROM qc_lid) SELECT range::INTEGER AS user, ((n - range + 4) // 5)::BIGINT AS n FROM range(5), n"),
}
