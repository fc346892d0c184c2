"""The domain's tables as views over the given ones: Spark frames, and the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "plumes": """
  SELECT 'ang' || strftime(ts, '%Y%m%dt%H%M%S') || '-' || event_id AS candidate_id, event_id AS row_id,
         date_trunc('second', ts) AS acq_time, 'ang' || strftime(date_trunc('day', ts), '%Y%m%dt%H%M%S') AS lid,
         'S' || user_id AS source_id, 'F' || (user_id % 5) AS facility,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(34 AS DOUBLE) + (user_id % 40) * CAST(0.05 AS DOUBLE) + (event_id % 7) * CAST(0.0005 AS DOUBLE) END AS lat,
         CAST(-119 AS DOUBLE) + ((user_id // 4) % 40) * CAST(0.05 AS DOUBLE) + (event_id % 5) * CAST(0.0005 AS DOUBLE) AS lon,
         value / CAST(100 AS DOUBLE) AS ime_fetch_avg, value / CAST(1000 AS DOUBLE) AS ime_fetch_std, (event_id % 150) / CAST(100 AS DOUBLE) AS aspect_ratio
  FROM events WHERE event_type = 'error'""",
    "wind": """
  SELECT g.range AS grid_id, h.valid_time, CAST(34 AS DOUBLE) + (g.range // 20) * CAST(0.1 AS DOUBLE) + (g.range % 7) * CAST(0.0011 AS DOUBLE) AS lat,
         CAST(-119 AS DOUBLE) + (g.range % 20) * CAST(0.1 AS DOUBLE) + (g.range % 11) * CAST(0.0013 AS DOUBLE) AS lon,
         ((g.range * 31 + hour(h.valid_time) * 17) % 200) / CAST(10 AS DOUBLE) - CAST(10 AS DOUBLE) AS u,
         ((g.range * 13 + day(h.valid_time) * 29) % 200) / CAST(10 AS DOUBLE) - CAST(10 AS DOUBLE) AS v
  FROM range(400) g, (SELECT DISTINCT date_trunc('hour', ts) + k * INTERVAL 1 HOUR AS valid_time FROM events, (VALUES (-1),(0),(1)) t(k)) h""",
    "stations": """
  SELECT s_suppkey AS station_id, s_suppkey % 3 AS network, CAST(34 AS DOUBLE) + (s_suppkey % 10) * CAST(0.2 AS DOUBLE) AS lat,
         CAST(-119 AS DOUBLE) + (s_suppkey // 10) * CAST(0.2 AS DOUBLE) AS lon FROM supplier""",
    "station_obs": "SELECT user_id % 100 AS station_id, ts, value / CAST(50 AS DOUBLE) AS wind_speed FROM events WHERE event_type <> 'error'",
    "flightlines": """
  SELECT 'R' || n_nationkey AS flight_run, CAST(-119 AS DOUBLE) + (n_nationkey % 5) * CAST(0.4 AS DOUBLE) AS cx, CAST(34 AS DOUBLE) + (n_nationkey // 5) * CAST(0.4 AS DOUBLE) AS cy,
         CAST(0.3701 AS DOUBLE) AS a, CAST(0.2903 AS DOUBLE) AS b FROM nation""",
    "col_pixels": """
  SELECT l_suppkey AS image_id, CAST(l_partkey % 30 AS INTEGER) AS col, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_extendedprice / CAST(50 AS DOUBLE) - CAST(200 AS DOUBLE) END AS cmf FROM lineitem""",
    "triage_labels": """
  SELECT s_suppkey AS image_id, CASE s_suppkey % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS score FROM supplier""",
    "grid_pixels": """
  SELECT (l_orderkey // 1000) AS image_id, (l_partkey % 64)::INTEGER AS row, (l_suppkey % 64)::INTEGER AS col, max(l_extendedprice / CAST(25 AS DOUBLE) - CAST(200 AS DOUBLE)) AS cmf
  FROM lineitem GROUP BY ALL""",
    "qc_cid": """
  SELECT user_id % 9 AS uid, 'L' || (user_id % 40) AS lid, CAST(event_id % 25 AS VARCHAR) AS cid, event_id AS row_id,
         CASE event_id % 11 WHEN 0 THEN 'Super Plume' WHEN 1 THEN 'Artifact' WHEN 2 THEN 'Cloud' WHEN 3 THEN 'False Enhancement' WHEN 4 THEN 'Ambiguous' WHEN 5 THEN 'Duplicate'
           WHEN 6 THEN 'Background' WHEN 7 THEN 'Reject' ELSE 'Plume' END AS label
  FROM events""",
    "qc_lid": """
  SELECT DISTINCT user_id % 9 AS uid, 'L' || (user_id % 40) AS lid,
         CASE WHEN (user_id % 9 + user_id % 40) % 6 = 0 THEN 'Severe' WHEN user_id % 2 = 0 THEN 'None' ELSE 'Minor' END AS column_artifacts,
         CASE WHEN (user_id % 40) % 8 = 0 THEN 'Low' ELSE 'Average' END AS data_quality FROM events""",
    "tile_scores": """
  SELECT doc_id AS tile_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN toxic = 1 THEN -1 ELSE 0 END AS label, ((doc_id * 37 + quality * 300) % 1000) / CAST(1000 AS DOUBLE) AS score FROM labels""",
    "inv_obs": "SELECT vec_id AS obs_id, label AS posix, CAST(1860 AS DOUBLE) + (vec_id * 17 % 100) AS xch4, embedding AS h FROM embeddings",
    "spectra": "SELECT vec_id AS pixel_id, label AS image_id, list_transform(embedding, lambda x: abs(x::DOUBLE) + 1) AS spectrum FROM embeddings",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + body


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def plumes(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_trunc("day", "ts")
    stamp = lambda c: F.concat(F.lit("ang"), F.date_format(c, "yyyyMMdd"), F.lit("t"), F.date_format(c, "HHmmss"))
    return events(spark, d).where("event_type = 'error'").select(
        F.concat(stamp(F.col("ts")), F.lit("-"), "event_id").alias("candidate_id"), F.col("event_id").alias("row_id"), F.date_trunc("second", "ts").alias("acq_time"), stamp(day).alias("lid"),
        F.expr("'S' || user_id AS source_id"), F.expr("'F' || (user_id % 5) AS facility"),
        F.expr("CASE WHEN event_id % 97 = 0 THEN NULL ELSE 34D + (user_id % 40) * 0.05D + (event_id % 7) * 0.0005D END AS lat"),
        F.expr("-119D + ((user_id div 4) % 40) * 0.05D + (event_id % 5) * 0.0005D AS lon"),
        F.expr("value / 100D AS ime_fetch_avg"), F.expr("value / 1000D AS ime_fetch_std"), F.expr("(event_id % 150) / 100D AS aspect_ratio"),
    )


def wind(spark: SparkSession, d: str) -> DataFrame:
    hours = events(spark, d).select(F.date_trunc("hour", "ts").alias("h")).distinct()
    hours = hours.select(F.explode(F.expr("array(h - interval 1 hour, h, h + interval 1 hour)")).alias("valid_time")).distinct()
    return hours.select("valid_time", F.explode(F.expr("sequence(0L, 399L)")).alias("grid_id")).select(
        "grid_id", "valid_time", F.expr("34D + (grid_id div 20) * 0.1D + (grid_id % 7) * 0.0011D AS lat"), F.expr("-119D + (grid_id % 20) * 0.1D + (grid_id % 11) * 0.0013D AS lon"),
        F.expr("((grid_id * 31 + hour(valid_time) * 17) % 200) / 10D - 10D AS u"), F.expr("((grid_id * 13 + day(valid_time) * 29) % 200) / 10D - 10D AS v"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").selectExpr("s_suppkey AS station_id", "s_suppkey % 3 AS network", "34D + (s_suppkey % 10) * 0.2D AS lat", "-119D + (s_suppkey div 10) * 0.2D AS lon")


def station_obs(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type <> 'error'").selectExpr("user_id % 100 AS station_id", "ts", "value / 50D AS wind_speed")


def flightlines(spark: SparkSession, d: str) -> DataFrame:
    """Diamonds, as closed rings."""
    base = _t(spark, d, "nation").selectExpr("'R' || n_nationkey AS flight_run", "-119D + (n_nationkey % 5) * 0.4D AS cx", "34D + (n_nationkey div 5) * 0.4D AS cy")
    ring = "array(named_struct('x', cx + 0.3701D, 'y', cy), named_struct('x', cx, 'y', cy + 0.2903D), named_struct('x', cx - 0.3701D, 'y', cy), named_struct('x', cx, 'y', cy - 0.2903D), named_struct('x', cx + 0.3701D, 'y', cy)) AS ring"
    return base.selectExpr("flight_run", ring)


def col_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").selectExpr(
        "l_suppkey AS image_id", "cast(l_partkey % 30 as int) AS col", "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_extendedprice / 50D - 200D END AS cmf"
    )


def triage_labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").selectExpr("s_suppkey AS image_id", "CASE s_suppkey % 4 WHEN 0 THEN 0D WHEN 1 THEN 0.5D WHEN 2 THEN 1D ELSE 2D END AS score")


def grid_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Sparse images of 64 x 64, one pixel per place; places without a pixel hold no data."""
    at = _t(spark, d, "lineitem").selectExpr("l_orderkey div 1000 AS image_id", "cast(l_partkey % 64 as int) AS row", "cast(l_suppkey % 64 as int) AS col", "l_extendedprice / 25D - 200D AS v")
    return at.groupBy("image_id", "row", "col").agg(F.max("v").alias("cmf"))


def grid_images(spark: SparkSession, d: str) -> DataFrame:
    """The images that grid_pixels() has pixels of."""
    return _t(spark, d, "lineitem").selectExpr("l_orderkey div 1000 AS image_id").distinct()


def candidate_image(spark: SparkSession, d: str) -> str:
    """An expression that deals candidates to the sparse images, however many there are."""
    n = _t(spark, d, "lineitem").agg(F.max(F.expr("l_orderkey div 1000"))).first()[0]
    return f"row_id % {(n or 0) + 1} AS image_id"


def qc_cid(spark: SparkSession, d: str) -> DataFrame:
    label = """CASE event_id % 11 WHEN 0 THEN 'Super Plume' WHEN 1 THEN 'Artifact' WHEN 2 THEN 'Cloud' WHEN 3 THEN 'False Enhancement' WHEN 4 THEN 'Ambiguous'
               WHEN 5 THEN 'Duplicate' WHEN 6 THEN 'Background' WHEN 7 THEN 'Reject' ELSE 'Plume' END AS label"""
    return events(spark, d).selectExpr("user_id % 9 AS uid", "'L' || (user_id % 40) AS lid", "cast(event_id % 25 as string) AS cid", "event_id AS row_id", label)


def qc_lid(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr(
        "user_id % 9 AS uid", "'L' || (user_id % 40) AS lid",
        "CASE WHEN (user_id % 9 + user_id % 40) % 6 = 0 THEN 'Severe' WHEN user_id % 2 = 0 THEN 'None' ELSE 'Minor' END AS column_artifacts",
        "CASE WHEN (user_id % 40) % 8 = 0 THEN 'Low' ELSE 'Average' END AS data_quality",
    ).distinct()


def tile_scores(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "labels").selectExpr(
        "doc_id AS tile_id", "CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN toxic = 1 THEN -1 ELSE 0 END AS label", "((doc_id * 37 + quality * 300) % 1000) / 1000D AS score"
    )


def inv_obs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").selectExpr("vec_id AS obs_id", "label AS posix", "1860D + (vec_id * 17 % 100) AS xch4", "embedding AS h")


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").selectExpr("vec_id AS pixel_id", "label AS image_id", "transform(embedding, x -> abs(cast(x as double)) + 1) AS spectrum")
