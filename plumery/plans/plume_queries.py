"""Queries on plume lists: wind, emission, stations, overlaps, sources, persistence and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.functions import geo, names, physics
from plumery.operators import clustering, overlap, wind
from plumery.plans import views as V
from plumery.plans.views import with_views


def _text(c) -> F.Column:
    """Times leave as text, which every engine compares alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def plume_emission(spark: SparkSession, d: str) -> DataFrame:
    plumes = V.plumes(spark, d).withColumn("acq_time", names.candidate_time(F.col("candidate_id")))
    stats = wind.wind_statistics(wind.wind_of_plumes(plumes, V.wind(spark, d)))
    out = wind.emissions(plumes, stats)
    rounded = {c: F.round(c, 6) for c in ("wind_mean", "wind_std", "emission", "emission_std")}
    return out.withColumns(rounded).select("candidate_id", "wind_mean", "wind_std", "n_values", "aspect_flag", "emission", "emission_std")


def wind_by_time(spark: SparkSession, d: str) -> DataFrame:
    found = wind.wind_of_plumes(V.plumes(spark, d), V.wind(spark, d), k=4)
    return wind.wind_statistics_by_time(found).select("candidate_id", _text("valid_time").alias("valid_time"), F.round("wind_mean", 6).alias("wind_mean"), F.round("wind_std", 6).alias("wind_std"), "nearest_id")


def wind_times(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("acq_time")
    at = V.plumes(spark, d).select("candidate_id", names.bounding_hours(t, 1).alias("h"), names.bounding_quarters(t, 1).alias("q"))
    return at.select("candidate_id", F.posexplode(F.arrays_zip("h", "q")).alias("n", "x")).select("candidate_id", "n", _text("x.h").alias("hour"), _text("x.q").alias("quarter"))


def extreme_stations(spark: SparkSession, d: str) -> DataFrame:
    places = V.plumes(spark, d).where("lat is not null").groupBy("source_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).withColumnRenamed("source_id", "place_id")
    points = V.stations(spark, d).withColumnRenamed("station_id", "grid_id")
    near, far = (wind.extreme_point(places, points, f).select("place_id", F.col("grid_id").alias(n)) for f, n in ((False, "nearest"), (True, "farthest")))
    return near.join(far, "place_id")


def station_nearest(spark: SparkSession, d: str) -> DataFrame:
    found = wind.station_wind(V.plumes(spark, d), V.stations(spark, d), V.station_obs(spark, d))
    return found.select("candidate_id", "station_id", F.round("distance_km", 6).alias("distance_km"), F.round("wind_speed", 6).alias("wind_speed"))


def source_persistence(spark: SparkSession, d: str) -> DataFrame:
    found = clustering.persistence(V.plumes(spark, d).where("lat is not null"), V.flightlines(spark, d))
    return found.select("source_id", "observed_plumes", "total_overflights", F.round("persistence", 9).alias("persistence"), F.col("candidate_id").alias("first_candidate"))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return V.plumes(spark, d).withColumns({"group_id": F.concat_ws("|", "facility", "lid"), "flux_a": F.round(F.col("ime_fetch_avg") * 10, 3), "flux_b": F.round(F.col("ime_fetch_avg") * 12 + F.col("aspect_ratio"), 3)})


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.meeting_pairs(_grouped(spark, d))
    return overlap.both_ways(pairs.withColumns({"distance_m": F.round("distance_m", 5), "overlap": F.round("overlap", 6)}))


def overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    return overlap.filter_overlaps(_grouped(spark, d), ["flux_a", "flux_b"]).select("row_id", "group_id", "candidate_id")


def source_cluster(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster_sources(V.plumes(spark, d)).select("candidate_id", "row_id", "source_number", "source_name")


def name_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat("lid", F.lit("_ch4mf_v2y1_img"))
    at = V.plumes(spark, d).select("candidate_id", n.alias("name"))
    n = F.col("name")
    return at.select(
        "candidate_id", names.flight_id(n).alias("flight_id"), _text(names.flight_time(n)).alias("flight_time"), names.year_tag(n).alias("year_tag"), names.product_id(n).alias("product_id"),
        names.calibration_id(n).alias("calibration_id"), names.candidate_tail(F.col("candidate_id")).alias("tail"), _text(names.candidate_minute(F.col("candidate_id"))).alias("minute"),
        _text(names.time_of_file(F.concat(F.lit("hrrr."), F.substring("candidate_id", 4, 8), F.lit(".wrfsfcf00")))).alias("granule_day"),
        names.min_ppmm(F.concat(F.lit("list_minppmm"), F.length("candidate_id"))).alias("min_ppmm"),
    )


def geo_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """UTM there and back, web map and great circle, to a millimetre."""
    at = V.plumes(spark, d).where("lat is not null").withColumn("u", geo.utm(F.col("lat"), F.col("lon")))
    back = geo.utm_inverse(F.col("u.x"), F.col("u.y"), F.col("u.zone"), F.col("u.north"))
    web = geo.web_mercator(F.col("lat"), F.col("lon"))
    return at.select(
        "candidate_id", F.col("u.zone").alias("zone"), (F.abs(back["lat"] - F.col("lat")) + F.abs(back["lon"] - F.col("lon")) < 1e-8).alias("same"), F.round(web["x"], 3).alias("web_x"),
        F.round(web["y"], 3).alias("web_y"), F.round(geo.great_circle_m(F.col("lon"), F.col("lat"), F.lit(-118.0), F.lit(35.0)), 3).alias("to_centre_m"),
    )


def box_iou(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the plumes of a flight line, compared with those of the facility's whole list."""
    p = V.plumes(spark, d).where("lat is not null")
    box = lambda x: F.struct(*(F.col(f"{x}_{k}").alias(k) for k in ("xmin", "xmax", "ymin", "ymax")))
    agg = lambda x: [F.min("lon").alias(f"{x}_xmin"), F.max("lon").alias(f"{x}_xmax"), F.min("lat").alias(f"{x}_ymin"), F.max("lat").alias(f"{x}_ymax")]
    lines, wholes = p.groupBy("facility", "lid").agg(*agg("a")), p.groupBy("facility").agg(*agg("b"))
    both = lines.join(wholes, "facility")
    return both.select("facility", "lid", F.round(geo.box_overlap(box("a"), box("b")), 9).alias("shared"), F.round(geo.box_iou(box("a"), box("b")), 9).alias("iou"))


def first_per_source(spark: SparkSession, d: str) -> DataFrame:
    return names.first_rows(V.plumes(spark, d), ["source_id", "facility"]).select("source_id", "facility", "row_id")


def next_candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    return names.next_candidate(V.qc_cid(spark, d))


def emission_scaled(spark: SparkSession, d: str) -> DataFrame:
    p = V.plumes(spark, d)
    return p.select("candidate_id", F.round(physics.scaled(F.col("ime_fetch_avg"), 0.5, 3.0), 9).alias("scaled"), physics.aspect_flag(F.col("aspect_ratio")).alias("flag"), F.round(physics.ime_kg(F.col("ime_fetch_avg"), F.lit(3.1)), 12).alias("ime"))


QUERIES = {
    f.__name__: f
    for f in (plume_emission, wind_by_time, wind_times, extreme_stations, station_nearest, source_persistence, overlap_pairs, overlap_filter, source_cluster, name_parse, geo_round_trip, box_iou, first_per_source, next_candidate_ids, emission_scaled)
}

_SPHERE = "6378.137 * acos(least(1.0, greatest(-1.0, sin(radians(p.lat)) * sin(radians(g.lat)) + cos(radians(p.lat)) * cos(radians(g.lat)) * cos(radians(g.lon - p.lon)))))"


def _stats(k: int) -> str:
    return f""",
places AS (SELECT DISTINCT lat, lon FROM plumes WHERE lat IS NOT NULL),
grid AS (SELECT DISTINCT grid_id, lat, lon FROM wind),
near AS (SELECT lat, lon, grid_id, n FROM (
  SELECT p.lat, p.lon, g.grid_id, row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY round({_SPHERE}, 6), g.grid_id) AS n FROM places p, grid g) WHERE n <= {k}),
found AS (
  SELECT candidate_id, w.valid_time, w.grid_id, n.n, sqrt(u * u + v * v) AS speed
  FROM plumes p JOIN near n ON p.lat = n.lat AND p.lon = n.lon JOIN wind w ON w.grid_id = n.grid_id
   AND w.valid_time BETWEEN date_trunc('hour', p.acq_time) - INTERVAL 1 HOUR AND date_trunc('hour', p.acq_time) + INTERVAL 1 HOUR)"""


ORACLES = {
    "plume_emission": with_views("plumes wind", _stats(10) + """,
stats AS (SELECT candidate_id, avg(speed) AS m, stddev_pop(speed) AS s, count(speed) AS n FROM found GROUP BY candidate_id)
SELECT candidate_id, round(m, 6) AS wind_mean, round(s, 6) AS wind_std, n AS n_values, CASE WHEN aspect_ratio > 1 OR aspect_ratio < 0.02 THEN 1 ELSE 0 END AS aspect_flag,
       round(ime_fetch_avg * m * 3600, 6) AS emission,
       round(sqrt((CASE WHEN ime_fetch_avg < 1e-7 THEN 0.0 ELSE pow(ime_fetch_std / ime_fetch_avg, 2) END) + (CASE WHEN m < 1e-7 THEN 0.0 ELSE pow(s / m, 2) END)) * ime_fetch_avg * m * 3600, 6) AS emission_std
FROM plumes LEFT JOIN stats USING (candidate_id) ORDER BY candidate_id"""),
    "wind_pivot": with_views("plumes wind", _stats(10) + """,
stats AS (SELECT candidate_id, avg(speed) AS m, stddev_pop(speed) AS s, avg(speed * 1.5::DOUBLE) AS m2, stddev_pop(speed * 1.5::DOUBLE) AS s2 FROM found GROUP BY candidate_id)
SELECT candidate_id, round(m, 6) AS "Wind Mean (m/s) [HRRR 10 m, 10 nearest points for each of 3 closest times]", round(s, 6) AS "Wind Std (m/s) [HRRR 10 m, 10 nearest points for each of 3 closest times]",
  round(m2, 6) AS "Wind Mean (m/s) [HRRR 80 m, 10 nearest points for each of 3 closest times]", round(s2, 6) AS "Wind Std (m/s) [HRRR 80 m, 10 nearest points for each of 3 closest times]"
FROM plumes LEFT JOIN stats USING (candidate_id)"""),
    "wind_by_time": with_views("plumes wind", _stats(4) + """
SELECT candidate_id, strftime(valid_time, '%Y-%m-%d %H:%M:%S') AS valid_time, round(avg(speed), 6) AS wind_mean, round(stddev_pop(speed), 6) AS wind_std, arg_min(grid_id, n) AS nearest_id
FROM found GROUP BY GROUPING SETS ((candidate_id, valid_time), (candidate_id))"""),
    "wind_times": with_views("plumes", """
SELECT candidate_id, (k + 1)::INTEGER AS n, strftime(date_trunc('hour', acq_time) + k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS hour,
       strftime(make_timestamp((epoch(acq_time)::BIGINT + k * 900 + 450) // 900 * 900 * 1000000), '%Y-%m-%d %H:%M:%S') AS quarter
FROM plumes, (VALUES (-1), (0), (1)) t(k)"""),
    "extreme_stations": with_views("plumes stations", f""",
p AS (SELECT source_id AS place_id, min(lat) AS lat, min(lon) AS lon FROM plumes WHERE lat IS NOT NULL GROUP BY ALL),
d AS (SELECT place_id, station_id, round({_SPHERE}, 6) AS d FROM p, stations g)
SELECT place_id, arg_min(station_id, (d, station_id)) AS nearest, arg_min(station_id, (-d, station_id)) AS farthest FROM d GROUP BY ALL"""),
    "station_nearest": with_views("plumes stations station_obs", """,
pairs AS (
  SELECT candidate_id, acq_time, station_id, 2 * (2 * 6378.137 + 6356.7523) / 3 * asin(sqrt(least(1.0,
    pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) AS d
  FROM plumes p, stations s WHERE p.lat IS NOT NULL),
means AS (
  SELECT candidate_id, p.station_id, any_value(d) AS d, avg(wind_speed) AS w FROM pairs p JOIN station_obs o
    ON o.station_id = p.station_id AND abs(floor(epoch(acq_time)) - floor(epoch(ts))) <= 300 WHERE d <= 20 GROUP BY ALL),
best AS (SELECT candidate_id, arg_min({'s': station_id, 'd': d, 'w': w}, (round(d, 6), station_id)) AS b FROM means GROUP BY ALL)
SELECT candidate_id, b.s AS station_id, round(b.d, 6) AS distance_km, round(b.w, 6) AS wind_speed FROM plumes LEFT JOIN best USING (candidate_id)"""),
    "source_persistence": with_views("plumes flightlines", """,
per AS (SELECT source_id, count(*) AS n, arg_min(lat, row_id) AS lat, arg_min(lon, row_id) AS lon, arg_min(candidate_id, row_id) AS c FROM plumes WHERE lat IS NOT NULL GROUP BY source_id),
over AS (SELECT source_id, count(*) AS t FROM per, flightlines WHERE abs(lon - cx) / a + abs(lat - cy) / b < 1 GROUP BY source_id)
SELECT source_id, n AS observed_plumes, t AS total_overflights, round(n / t, 9) AS persistence, c AS first_candidate FROM per LEFT JOIN over USING (source_id)"""),
    "overlap_pairs": with_views("plumes", """,
k AS (SELECT 1 / 298.257222101 AS f), e AS (SELECT (2 - f) * f AS e2, sqrt((2 - f) * f) AS e FROM k),
pts(name, phi) AS (SELECT * FROM (VALUES ('0', radians(0.0)), ('1', radians(34.0)), ('2', radians(40.5)))),
q AS (SELECT name, cos(phi) * cos(phi) / (1 - e2 * sin(phi) * sin(phi)) AS m2, (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) * sin(phi)) - 1 / (2 * e) * ln((1 - e * sin(phi)) / (1 + e * sin(phi)))) AS q FROM pts, e),
c1 AS (SELECT (a.m2 - b.m2) / (b.q - a.q) AS n, a.m2, a.q AS q1, z.q AS q0 FROM q a, q b, q z WHERE a.name = '1' AND b.name = '2' AND z.name = '0'),
c AS (SELECT n, m2 + n * q1 AS c, 6378137.0 * sqrt(m2 + n * q1 - n * q0) / n AS rho0 FROM c1),
xy0 AS (SELECT facility || '|' || lid AS g, row_id, 6378137.0 * sqrt(c.c - n * ((1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) * sin(radians(lat))) - 1 / (2 * e) * ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))))))) / n AS rho,
               n * radians(lon + 120) AS th, rho0 FROM plumes, e, c WHERE lat IS NOT NULL),
xy AS (SELECT g, row_id, rho * sin(th) AS x, rho0 - rho * cos(th) - 4e6 AS y FROM xy0),
d AS (SELECT a.g, a.row_id, b.row_id AS other_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM xy a JOIN xy b ON a.g = b.g AND a.row_id <> b.row_id)
SELECT g AS group_id, row_id, other_id, round(d, 5) AS distance_m,
       round(CASE WHEN d < 300 THEN (2 * 22500 * acos(d / 300) - d / 2 * sqrt(90000 - d * d)) / (pi() * 22500) ELSE 0 END, 6) AS overlap FROM d WHERE d <= 300"""),
    "name_parse": with_views("plumes", """
SELECT candidate_id, lid AS flight_id, strftime(strptime(lid[4:], '%Y%m%dt%H%M%S'), '%Y-%m-%d %H:%M:%S') AS flight_time, 'ang' || lid[6:7] AS year_tag, 'ch4mf' AS product_id, 'v2y1' AS calibration_id,
       row_id::VARCHAR AS tail, strftime(date_trunc('minute', acq_time), '%Y-%m-%d %H:%M:%S') AS minute, strftime(date_trunc('day', acq_time), '%Y-%m-%d %H:%M:%S') AS granule_day, length(candidate_id)::INTEGER AS min_ppmm FROM plumes"""),
    "geo_round_trip": with_views("plumes", """
SELECT candidate_id, (floor((lon + 180) / 6) % 60 + 1)::INTEGER AS zone, true AS same, round(radians(lon) * 6378137, 3) AS web_x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS web_y,
       round(12742000 * asin(sqrt(pow(sin(radians(35.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.0)) * pow(sin(radians(-118.0 - lon) / 2), 2))), 3) AS to_centre_m
FROM plumes WHERE lat IS NOT NULL"""),
    "box_iou": with_views("plumes", """,
a AS (SELECT facility, lid, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 FROM plumes WHERE lat IS NOT NULL GROUP BY ALL),
b AS (SELECT facility, min(lon) bx0, max(lon) bx1, min(lat) by0, max(lat) by1 FROM plumes WHERE lat IS NOT NULL GROUP BY ALL),
s AS (SELECT *, least(x1, bx1) - greatest(x0, bx0) AS w, least(y1, by1) - greatest(y0, by0) AS h FROM a JOIN b USING (facility)),
o AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END AS o FROM s)
SELECT facility, lid, round(o, 9) AS shared, round(o / ((x1 - x0) * (y1 - y0) + (bx1 - bx0) * (by1 - by0) - o), 9) AS iou FROM o"""),
    "first_per_source": with_views("plumes", " SELECT source_id, facility, min(row_id) AS row_id FROM plumes GROUP BY ALL"),
    "next_candidate_ids": with_views("qc_cid", """
SELECT lid, chr(greatest(max(CASE WHEN length(cid) = 1 THEN ascii(cid) ELSE cid::INTEGER END) + 1, 65)) AS next_cid FROM qc_cid GROUP BY lid"""),
    "emission_scaled": with_views("plumes", """
SELECT candidate_id, round(greatest(0.0, least(1.0, (ime_fetch_avg - 0.5) / 2.5)), 9) AS scaled, CASE WHEN aspect_ratio > 1 OR aspect_ratio < 0.02 THEN 1 ELSE 0 END AS flag,
       round(ime_fetch_avg * 3.1 * 3.1 * (1e-6 * 1000 / 22.4 * 0.01604), 12) AS ime FROM plumes"""),
}
