"""Wind at plumes: nearest grid points, closest times, statistics, station observations and emission rates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumery.functions import geo, names, physics
from plumery.operators.graph import cut

#: The heights in metres that each product has.
ALTITUDES = {"HRRR": (10, 80), "RTMA": (10,)}
KM_PER_DEGREE = geo.EQUATOR_KM * geo.RAD
#: Cubes that hold the sphere's points have sides of 4 (all in one) and halves of it, this many times: down to 60 m.
LEVELS = 19
#: Levels that a place goes down at once: level 1 has at most 8 cubes, and a cube's surface some 64 three levels below.
STEP = 3
#: Chords and spherical distances are rounded by less than this (of the radius).
SLACK = 1e-7


def at_altitude(wind: DataFrame, wind_type: str, alt: int) -> DataFrame:
    """The rows of one product and height; heights that the product lacks are an error."""
    if alt not in ALTITUDES.get(wind_type, ()):
        raise ValueError(f"{wind_type} has no wind at {alt} m")
    return wind.where((F.col("wind_type") == wind_type) & (F.col("alt") == alt))


def _cube(axes: tuple[str, ...], level, reach=None) -> list:
    """The numbers of the cube of a level (side 4 / 2 ** level) that a point of the unit sphere is in; with a reach, of the cubes
    that its surroundings meet along each axis."""
    at = lambda c, d: F.floor((F.col(c) + 1 + d) * F.pow(F.lit(2.0), level) / 4).cast("int")
    return [at(c, F.lit(0)) if reach is None else F.sequence(at(c, -reach), at(c, reach)) for c in axes]


def _in_cubes(rows: DataFrame, axes: tuple[str, ...], level, reach) -> DataFrame:
    """rows once for each cube that they reach."""
    for name, span in zip(("cx", "cy", "cz"), _cube(axes, level, reach), strict=True):
        rows = rows.withColumn(name, F.explode(span))
    return rows


def _nearest(places: DataFrame, points: DataFrame, k: int, key: str, sign: int) -> DataFrame:
    """(place_id, grid_id, distance_km, n): the k points nearest to each place, or (sign -1) to its antipode, so the farthest ones.

    Points are in cubes around the sphere, of sides halved from level to level, and of each place the k with the smallest ids stand
    for all. A place, each once however many ids it has, goes down the levels with the cubes that may hold one of its k nearest: those whose box of points is
    not farther than the k-th point of the others' farthest corners. So it meets few points however far away they are.
    """
    p, g = ("_px", "_py", "_pz"), ("_gx", "_gy", "_gz")
    chord = F.sqrt(sum((F.pow(F.col(a) - F.col(b), 2) for a, b in zip(p, g, strict=True)), F.lit(0.0)))
    named = places.where("lat is not null and lon is not null").select("place_id", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")).distinct().transform(cut)
    at = named.select("p_lon", "p_lat").distinct().withColumn("_p", F.monotonically_increasing_id())
    at = at.withColumns({c: sign * v for c, v in zip(p, geo.unit_vector(F.col("p_lon"), F.col("p_lat")), strict=True)}).transform(cut)
    grid = points.where("lat is not null and lon is not null").select(F.col(key).alias("grid_id"), "lon", "lat").distinct()
    grid = grid.withColumn("_n", F.row_number().over(Window.partitionBy("lon", "lat").orderBy("grid_id"))).where(F.col("_n") <= k).drop("_n")
    grid = grid.withColumns(dict(zip(g, geo.unit_vector(F.col("lon"), F.col("lat")), strict=True))).transform(cut)
    cube = ["cx", "cy", "cz"]
    ends = [f(c).alias(f"{n}{c}") for c in g for f, n in ((F.min, "lo"), (F.max, "hi"))]
    finest = grid.withColumns(dict(zip(cube, _cube(g, F.lit(LEVELS)), strict=True)))
    boxes = {LEVELS: finest.groupBy(*cube).agg(F.count(F.lit(1)).alias("points"), *ends).transform(cut)}
    for level in range(LEVELS - STEP, 0, -STEP):
        up = boxes[level + STEP].withColumns({c: F.shiftright(c, STEP) for c in cube}).groupBy(*cube)
        boxes[level] = up.agg(F.sum("points").alias("points"), *(f(f"{n}{c}").alias(f"{n}{c}") for c in g for f, n in ((F.min, "lo"), (F.max, "hi")))).transform(cut)
    away = [(F.greatest(F.lit(0.0), F.col(f"lo{c}") - F.col(a), F.col(a) - F.col(f"hi{c}")), F.greatest(F.abs(F.col(a) - F.col(f"lo{c}")), F.abs(F.col(a) - F.col(f"hi{c}")))) for a, c in zip(p, g, strict=True)]
    low, high = (F.sqrt(sum((F.pow(x[i], 2) for x in away), F.lit(0.0))) for i in (0, 1))
    upto = F.sum("points").over(Window.partitionBy("_p").orderBy("high", *cube).rowsBetween(Window.unboundedPreceding, 0))
    reach = F.min(F.when(F.col("upto") >= k, F.col("high"))).over(Window.partitionBy("_p"))
    left = None
    for level in range(LEVELS % STEP, LEVELS + 1, STEP):
        box = boxes[level] if left is None else boxes[level].withColumns({f"u{c}": F.shiftright(c, STEP) for c in cube})
        met = at.crossJoin(F.broadcast(box)) if left is None else left.withColumnsRenamed({c: f"u{c}" for c in cube}).join(box, [f"u{c}" for c in cube]).join(at, "_p")
        met = met.select("_p", *cube, "points", low.alias("low"), high.alias("high")).withColumn("upto", upto).withColumn("reach", reach)
        left = met.where(F.col("reach").isNull() | (F.col("low") <= F.col("reach") + SLACK)).select("_p", *cube).transform(cut)
    close = left.join(finest, cube).join(at, "_p").select("_p", "grid_id", chord.alias("chord"), geo.distance(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat")).alias("distance_km"))
    order = Window.partitionBy("_p").orderBy(sign * F.round("distance_km", 6), "grid_id")
    found = close.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("_p", "grid_id", "distance_km", "n")
    return named.join(at.select("_p", "p_lon", "p_lat"), ["p_lon", "p_lat"]).join(found, "_p").select("place_id", "grid_id", "distance_km", "n")


def nearest_points(places: DataFrame, points: DataFrame, k: int = 10) -> DataFrame:
    """(place_id, grid_id, distance_km, n): the k points nearest to each place, n from 1; ties of 1e-6 km go by grid_id.

    places has place_id, lat and lon; points has grid_id, lat and lon, repeated rows count once. Places without coordinates give no
    rows; fewer than k points give all of them. There is no seam at the date line or the poles.
    """
    return _nearest(places, points, k, "grid_id", 1)


def extreme_point(places: DataFrame, points: DataFrame, farthest: bool = False) -> DataFrame:
    """(place_id, grid_id, distance_km) of the nearest or the farthest point, by ties of 1e-6 km the smallest grid_id.

    The farthest point is the one nearest to the place's antipode.
    """
    found = _nearest(places, points, 1, "grid_id", -1 if farthest else 1)
    return found.select("place_id", "grid_id", F.round("distance_km", 6).alias("distance_km"))


def wind_of_plumes(plumes: DataFrame, wind: DataFrame, k: int = 10, n_times: int = 1, quarters: bool = False, neighbours: DataFrame | None = None) -> DataFrame:
    """Each (plume, nearest point, closest time) with its wind speed: candidate_id, grid_id, n, valid_time, distance_km, speed.

    plumes has candidate_id, acq_time, lat and lon; wind has grid_id, valid_time, lat, lon, u and v. The grid is static, so
    the neighbours are found once per place, and then joined on point and time.
    """
    steps = names.bounding_quarters(F.col("acq_time"), n_times) if quarters else names.bounding_hours(F.col("acq_time"), n_times)
    placed = plumes.select("candidate_id", "acq_time", "lat", "lon", F.xxhash64("lat", "lon").alias("place_id"))
    if neighbours is None:
        neighbours = nearest_points(placed.select("place_id", "lat", "lon").distinct(), wind, k)
    return (
        placed.select("candidate_id", "place_id", F.explode(steps).alias("valid_time"))
        .join(neighbours, "place_id")
        .join(wind.select("grid_id", "valid_time", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("speed")), ["grid_id", "valid_time"])
        .select("candidate_id", "grid_id", "n", "valid_time", "distance_km", "speed")
    )


def wind_statistics(found: DataFrame) -> DataFrame:
    """Mean and population deviation of speed over all points and times of each plume, and how many of either there are."""
    return found.groupBy("candidate_id").agg(
        F.avg("speed").alias("wind_mean"), F.stddev_pop("speed").alias("wind_std"), F.count("speed").alias("n_values"), F.count_distinct("valid_time").alias("n_times")
    )


def wind_statistics_by_time(found: DataFrame) -> DataFrame:
    """As wind_statistics, for each time and for all together (valid_time null), with the nearest point."""
    return found.groupingSets([["candidate_id", "valid_time"], ["candidate_id"]], "candidate_id", "valid_time").agg(
        F.avg("speed").alias("wind_mean"), F.stddev_pop("speed").alias("wind_std"),
        F.min_by("grid_id", F.struct("n")).alias("nearest_id"), F.min("distance_km").alias("nearest_km"),
    )


def wind_columns(plumes: DataFrame, stats: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """Statistics of several products and heights as columns, named as in plume lists."""
    out = plumes
    for (kind, alt), s in stats.items():
        tag = f"[{kind} {alt} m, 10 nearest points for each of 3 closest times]"
        out = out.join(s.select("candidate_id", F.col("wind_mean").alias(f"Wind Mean (m/s) {tag}"), F.col("wind_std").alias(f"Wind Std (m/s) {tag}")), "candidate_id", "left")
    return out


def emissions(plumes: DataFrame, stats: DataFrame) -> DataFrame:
    """plumes with wind statistics, aspect flag, emission rate (kg/h) and its uncertainty; null where an input is missing."""
    wind, std, ime = F.col("wind_mean"), F.col("wind_std"), F.col("ime_fetch_avg")
    return plumes.join(stats, "candidate_id", "left").withColumns(
        {
            "aspect_flag": physics.aspect_flag(F.col("aspect_ratio")),
            "emission": physics.emission_kg_h(ime, wind),
            "emission_std": physics.emission_uncertainty(ime, F.col("ime_fetch_std"), wind, std),
        }
    )


def station_wind(plumes: DataFrame, stations: DataFrame, obs: DataFrame, radius_km: float = 20.0, minutes: int = 5, network: int | None = None) -> DataFrame:
    """Each plume's nearest station with an observation near in place and time: station_id, distance_km and mean wind_speed.

    The mean is over the station's observations within ± minutes; without any station the columns are null.
    """
    if network is not None:
        stations = stations.where(F.col("network") == network)
    bucket, seconds = minutes * 60, F.unix_seconds(F.col("acq_time"))
    # By cubes about as wide as the chord of the radius, on the sphere.
    reach = 2 * math.sin(min(math.pi, radius_km * 3 / (2 * geo.EQUATOR_KM + geo.POLE_KM)) / 2) + SLACK
    level = F.lit(min(LEVELS, max(0, math.floor(-math.log2(reach / 4)))))
    p, g, cube = ("_px", "_py", "_pz"), ("_gx", "_gy", "_gz"), ["cx", "cy", "cz"]
    near = plumes.where("lat is not null and lon is not null and acq_time is not null").select("candidate_id", seconds.alias("t"), "lat", "lon")
    near = _in_cubes(near.withColumns(dict(zip(p, geo.unit_vector(F.col("lon"), F.col("lat")), strict=True))), p, level, F.lit(reach))
    placed = stations.select("station_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    placed = placed.withColumns(dict(zip(g, geo.unit_vector(F.col("s_lon"), F.col("s_lat")), strict=True)))
    placed = placed.withColumns(dict(zip(cube, _cube(g, level), strict=True)))
    d = geo.distance(F.col("lon"), F.col("lat"), F.col("s_lon"), F.col("s_lat"), "haversine")
    close = near.join(placed, cube).withColumn("distance_km", d).where(F.col("distance_km") <= radius_km)
    close = close.select("candidate_id", "t", "station_id", "distance_km", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dt")).withColumn("slot", F.floor(F.col("t") / bucket) + F.col("dt"))
    timed = obs.select("station_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "wind_speed").where("wind_speed is not null").withColumn("slot", F.floor(F.col("s") / bucket))
    means = (
        close.join(timed, ["station_id", "slot"]).where(F.abs(F.col("t") - F.col("s")) <= bucket)
        .groupBy("candidate_id", "station_id").agg(F.first("distance_km").alias("distance_km"), F.avg("wind_speed").alias("wind_speed"))
    )
    best = means.groupBy("candidate_id").agg(F.min_by(F.struct("station_id", "distance_km", "wind_speed"), F.struct(F.round("distance_km", 6), "station_id")).alias("s"))
    return plumes.join(best, "candidate_id", "left").select(*(plumes[c] for c in plumes.columns), "s.station_id", "s.distance_km", "s.wind_speed")
