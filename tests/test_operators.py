"""Hand-made and random cases of the domain's operators against plain numpy."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumery.functions import geo, names, physics
from plumery.operators import clustering, evaluation, inversion, matched_filter, overlap, pixels, qc, regions, tiles, triage, wind


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_utm_of_known_places(spark):
    # Published UTM coordinates (zone 31 north, 56 south) of two places.
    a = one(spark, u=geo.utm(F.lit(48.8582), F.lit(2.2945))).u
    assert a.zone == 31 and abs(a.x - 448251.8) < 1 and abs(a.y - 5411932.7) < 1
    b = one(spark, u=geo.utm(F.lit(-33.8568), F.lit(151.2153))).u
    assert b.zone == 56 and not b.north and abs(b.y - 6252000) < 1500
    back = one(spark, p=geo.utm_inverse(F.lit(b.x), F.lit(b.y), F.lit(56), F.lit(False))).p
    assert abs(back.lat + 33.8568) < 1e-9 and abs(back.lon - 151.2153) < 1e-9
    z = one(spark, e=geo.utm_epsg(F.lit(11), F.lit(True)), z=geo.epsg_zone(F.lit(32711)))
    assert (z.e, z.z) == (32611, -11)


def test_pixels_and_map(spark):
    m = F.struct(F.lit(5e5).alias("ulx"), F.lit(4e6).alias("uly"), F.lit(3.1).alias("xps"), F.lit(3.1).alias("yps"), F.lit(17.0).alias("rotation"), F.lit(11).alias("zone"), F.lit("North").alias("hemi"))
    p = geo.pixel_to_map(F.lit(100), F.lit(200), m)
    r = one(spark, back=geo.map_to_pixel(p["x"], p["y"], m), ll=geo.pixel_to_latlon(F.lit(100), F.lit(200), m), box=geo.geo_box(F.lit(36.1), F.lit(-117.0), F.lit(100.0), m))
    assert abs(r.back.sample - 100) < 1e-6 and abs(r.back.line - 200) < 1e-6 and 36 < r.ll.lat < 37
    again = one(spark, p=geo.latlon_to_pixel(F.lit(r.ll.lat), F.lit(r.ll.lon), m)).p
    assert abs(again.sample - 100) < 1e-4 and abs(again.line - 200) < 1e-4
    assert len(r.box) == 4 and abs(math.dist((r.box[0].x, r.box[0].y), (r.box[1].x, r.box[1].y)) - 100) < 1e-6


def test_ring_leaves_out_its_border(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))))
    r = one(spark, a=geo.in_ring(F.lit(1.0), F.lit(1.0), ring), b=geo.in_ring(F.lit(0.0), F.lit(2.0), ring), c=geo.in_ring(F.lit(5.0), F.lit(2.0), ring), d=geo.in_ring(F.lit(4.0), F.lit(4.0), ring))
    assert (r.a, r.b, r.c, r.d) == (True, False, False, False)


def test_names(spark):
    df = spark.createDataFrame([("ang20160922t184215_cmf_v1g_img",), ("f130503t01p00r09_rdn_a_b_x",), ("prm20200906t195820",), ("x",)], "n string")
    n = F.col("n")
    rows = df.select(names.flight_id(n).alias("i"), names.flight_time(n).cast("string").alias("t"), names.product_id(n).alias("p"), names.calibration_id(n).alias("c"), names.year_tag(n).alias("y")).collect()
    assert rows[0] == ("ang20160922t184215", "2016-09-22 18:42:15", "cmf", "v1g", "ang16") and rows[1].c == "a_b" and rows[2].t == "2020-09-06 19:58:20" and rows[3].t is None
    q = one(spark, q=names.bounding_quarters(F.lit("2020-01-01 23:52:30").cast("timestamp"), 1), z=names.bounding_quarters(F.lit("2020-01-01 10:07:29").cast("timestamp"), 0), e=names.bounding_hours(F.lit("2020-01-01").cast("timestamp"), -1))
    assert [f"{x:%d %H:%M}" for x in q.q] == ["01 23:45", "02 00:00", "02 00:15"] and f"{q.z[0]:%H:%M}" == "10:00" and q.e == []
    assert one(spark, t=names.parse_time(F.lit("8/21/2018 18:49:59 UTC")).cast("string")).t == "2018-08-21 18:49:59"
    assert one(spark, m=names.min_ppmm(F.lit("a_minppmm1000.csv"))).m == 1000
    for bad in (names.min_ppmm(F.lit("a.csv")), names.time_of_file(F.lit("x123456.grb"))):
        with pytest.raises(Exception, match="no t"):
            one(spark, m=bad)
    ids = spark.createDataFrame([("a", x) for x in ("2", "4", "5", "A", "F")] + [("b", "12")], "lid string, cid string")
    assert {r.lid: r.next_cid for r in names.next_candidate(ids).collect()} == {"a": "G", "b": "A"}
    assert names.coordinate_columns(["x", "Plume Longitude", "Plume Latitude", "Alat"]) == ("Alat", "Plume Longitude")


def test_emission_guards(spark):
    u = lambda *v: physics.emission_uncertainty(*map(F.lit, v))
    r = one(spark, a=u(0.0, 1.0, 2.0, 1.0), b=u(3.0, 1.0, 2.0, 1.0), c=physics.aspect_flag(F.lit(0.02)), d=physics.aspect_flag(F.lit(1.01)), e=physics.aspect_flag(F.lit(None).cast("double")))
    assert r.a == 0 and abs(r.b - math.sqrt(1 / 9 + 1 / 4) * 3 * 2 * 3600) < 1e-9 and (r.c, r.d, r.e) == (0, 1, None)


def test_nearest_points_widen_and_tie(spark):
    r = np.random.default_rng(1)
    grid = pd.DataFrame({"grid_id": range(200), "lat": r.uniform(30, 40, 200), "lon": r.uniform(-120, -110, 200)})
    grid.loc[5, ["lat", "lon"]] = grid.loc[3, ["lat", "lon"]].to_numpy()
    places = pd.DataFrame({"place_id": range(20), "lat": r.uniform(29, 41, 20), "lon": r.uniform(-121, -109, 20)})
    got = wind.nearest_points(spark.createDataFrame(places), spark.createDataFrame(grid), k=4).collect()
    for p in places.itertuples():
        a, b = np.radians(p.lat), np.radians(grid.lat)
        d = 6378.137 * np.arccos(np.clip(np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(grid.lon - p.lon)), -1, 1))
        want = sorted(zip(d.round(6), grid.grid_id, strict=True))[:4]
        assert [x.grid_id for x in sorted((g for g in got if g.place_id == p.place_id), key=lambda g: g.n)] == [g for _, g in want]


def sphere_km(lat, lon, lats, lons):
    a, b = np.radians(lat), np.radians(lats)
    return 6378.137 * np.arccos(np.clip(np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(lons - lon)), -1, 1))


def test_nearest_and_farthest_points_on_the_sphere(spark):
    """Places at the date line, both poles and elsewhere, a dense crowd of points and few others, against all distances."""
    r = np.random.default_rng(6)
    lat = np.concatenate([r.uniform(-90, 90, 60), r.uniform(-1, 1, 40), [90, -90, 89.99, 0, 0, 0]])
    lon = np.concatenate([r.uniform(-180, 180, 60), 180 - r.uniform(-0.5, 0.5, 40), [0, 0, -170, -179.96, 179.7, 0]])
    lon = np.where(lon > 180, lon - 360, lon)
    crowd = r.normal(0, 0.001, (300, 2)) + [35, -118]
    grid = pd.DataFrame({"grid_id": range(406), "lat": [*lat, *crowd[:, 0]], "lon": [*lon, *crowd[:, 1]]})
    grid.loc[405, ["lat", "lon"]] = grid.loc[200, ["lat", "lon"]].to_numpy()
    at = [(0, 179.95), (0, 180), (0, -180), (90, 12), (-90, 0), (89.9, 10), (-89.95, -170), (35, -118), (-35, 62), (35.01, -118), (0, 0), (60, 179.999)]
    at += [(float(a), float(b)) for a, b in zip(r.uniform(-90, 90, 30), r.uniform(-180, 180, 30), strict=True)]
    places = pd.DataFrame({"place_id": range(len(at)), "lat": [a for a, _ in at], "lon": [b for _, b in at]})
    here, points = spark.createDataFrame(places), spark.createDataFrame(pd.concat([grid, grid.head(50)]))
    for k in (1, 7, 500):
        got = {}
        for x in wind.nearest_points(here, points, k).orderBy("place_id", "n").collect():
            got.setdefault(x.place_id, []).append(x.grid_id)
        for p in places.itertuples():
            want = sorted(zip(sphere_km(p.lat, p.lon, grid.lat, grid.lon).round(6), grid.grid_id, strict=True))[:k]
            assert got[p.place_id] == [g for _, g in want]
    far = {x.place_id: (x.grid_id, x.distance_km) for x in wind.extreme_point(here, points, farthest=True).collect()}
    for p in places.itertuples():
        d = sphere_km(p.lat, p.lon, grid.lat, grid.lon).round(6)
        assert far[p.place_id] == (int(grid.grid_id[d.argmax()]), pytest.approx(d.max()))
    assert wind.nearest_points(here.limit(0), points).count() == 0 and wind.nearest_points(here, points.limit(0)).count() == 0


def test_station_wind_across_the_date_line(spark):
    t = "2024-01-01 12:00:00"
    plumes = spark.createDataFrame([("a", 10.0, 179.98, t), ("b", 10.0, -179.99, t), ("c", 89.99, 5.0, t), ("d", 10.0, 100.0, t)], "candidate_id string, lat double, lon double, at string")
    stations = spark.createDataFrame([(1, 10.0, -179.97), (2, 10.0, 179.8), (3, 89.99, -150.0), (4, 10.0, 100.19)], "station_id long, lat double, lon double")
    obs = spark.createDataFrame([(n, t, float(n)) for n in (1, 2, 3, 4)], "station_id long, t string, wind_speed double").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.candidate_id: r.station_id for r in wind.station_wind(plumes.withColumn("acq_time", F.col("at").cast("timestamp")), stations, obs).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": None}


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters_are_those_of_one_pass(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.uniform(-1, 1, (40, 2)) * [0.05, 0.05] + [35.0, -118.0]
    at = centres[r.integers(0, 40, 250)] + r.normal(0, 0.0008, (250, 2))
    df = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(at)] + [(250, None, 1.0)], "row_id long, lat double, lon double")
    u = df.where("lat is not null").select("row_id", geo.utm(F.col("lat"), F.col("lon")).alias("u")).select("row_id", "u.x", "u.y").toPandas().sort_values("row_id")
    want = [n + 1 for n in clustering.assign(u, 150.0)]
    for parts in (1, 7):
        got = {x.row_id: x.source_number for x in clustering.cluster_sources(df.repartition(parts)).collect()}
        assert [got[n] for n in range(250)] == want and got[250] is None


@pytest.mark.parametrize(("seed", "spread", "tile"), [(0, 900, 40), (1, 3000, 60), (2, 6000, 25), (3, 200, 10)])
def test_clusters_by_reservations(spark, seed, spread, tile):
    """A field without gaps, all of it one component, settled in many rounds of small tiles; two zones side by side."""
    r = np.random.default_rng(seed)
    n = 500
    points = pd.DataFrame({"zone": r.integers(0, 2, n), "row_id": r.permutation(n) * 3, "x": r.uniform(-spread, spread, n), "y": r.uniform(-spread, spread, n)})
    points.loc[: n // 3, ["x", "y"]] = r.normal(0, 60, (n // 3 + 1, 2)) + spread / 3  # a third of all at one place
    want = {}
    for _, own in points.sort_values("row_id").groupby("zone"):
        number = clustering.assign(own, 20.0)
        first = {c: row for c, row in zip(reversed(number), reversed(own["row_id"].tolist()), strict=True)}
        want |= {row: first[c] for row, c in zip(own["row_id"], number, strict=True)}
    df = spark.createDataFrame(points).repartition(5)
    got = {x.row_id: x.first_row for x in clustering.first_rows_of_sources(df, 20.0, tile).collect()}
    assert got == want


def test_registered_clusters_are_those_of_one_pass(spark, small):
    """The registered query, all rows, against one pass written anew."""
    from plumery import plans
    from plumery.plans import views

    at = clustering.placed_points(views.plumes(spark, small)).toPandas().sort_values("row_id")
    want, held = {}, []  # zone, members' places
    for row, zone, x, y in at.itertuples(index=False):
        near = [(np.hypot(*(np.mean(m, axis=0) - (x, y))) if z == zone else np.inf) for z, m in held]
        if not near or min(near) > 150.0:
            held.append((zone, [(x, y)]))
            want[row] = len(held)
        else:
            held[int(np.argmin(near))][1].append((x, y))
            want[row] = int(np.argmin(near)) + 1
    rows = plans.QUERIES["source_cluster"](spark, small).collect()
    assert {r.row_id: r.source_number for r in rows if r.source_number} == want
    assert all(r.source_name == (r.source_number and f"A{r.source_number:08d}") for r in rows)


def test_cluster_rules():
    at = lambda *p: pd.DataFrame(p, columns=["x", "y"])
    assert clustering.assign(at((0, 0), (300, 0), (150, 0)), 150) == [0, 1, 0]  # exactly at the radius joins the first of equals
    assert clustering.assign(at((0, 0), (140, 0), (215, 0)), 150) == [0, 0, 0]
    assert clustering.assign(at((215, 0), (0, 0), (140, 0)), 150) == [0, 1, 0]


@pytest.mark.parametrize("rule", ["first", "largest"])
def test_overlap_of_a_large_group_compares_neighbours_only(rule, monkeypatch):
    r = np.random.default_rng(1)
    n, compared, hypot = 1500, [], np.hypot
    group = pd.DataFrame({"row_id": np.arange(n), "x": r.uniform(0, 6000, n), "y": r.uniform(0, 6000, n), "a": r.uniform(1, 9, n)})
    monkeypatch.setattr(overlap.np, "hypot", lambda x, y: compared.append(np.size(x)) or hypot(x, y))
    kept = overlap.resolve(group, ["a"], rule=rule)
    assert len(kept) < n and sum(compared) < n * n / 4
    x, y = kept["x"].to_numpy(), kept["y"].to_numpy()
    d = hypot(x[:, None] - x, y[:, None] - y) + np.where(np.eye(len(x)), 1e9, 0)
    if rule == "largest":
        assert d.min() > 100


def test_overlap_rules():
    def kept(rows, **kw):
        return overlap.resolve(pd.DataFrame(rows, columns=["row_id", "x", "y", "a", "b"]), ["a", "b"], **kw)["row_id"].tolist()

    assert kept([(0, 0, 0, 5.0, 6.0), (1, 100, 0, 3.0, 9.0)]) == [0]
    assert kept([(0, 0, 0, 5.0, 6.0), (1, 100, 0, None, 9.0)]) == [0]
    assert kept([(0, 0, 0, 5.0, 6.0), (1, 300, 0, 3.0, 9.0)]) == [0, 1]
    assert kept([(0, 0, 0, 5.0, 5.0), (1, 50, 0, 4.0, 4.0), (2, 20, 0, 3.0, 3.0)]) != []


def test_components_match_a_flood(spark):
    r = np.random.default_rng(4)
    mask = r.random((40, 37)) < 0.45
    rows = [(int(a), int(b)) for a, b in zip(*np.nonzero(mask), strict=True)]
    df = spark.createDataFrame([("i", a, b, 1.0) for a, b in rows], "image_id string, row int, col int, cmf double")
    for eight in (True, False):
        left, want, n = set(rows), {}, 0
        for p in rows:
            if p in left:
                n += 1
                todo = [p]
                left.discard(p)
                while todo:
                    q = todo.pop()
                    want[q] = n
                    for a, b in regions.AROUND_8 if eight else regions.AROUND_4:
                        s = (q[0] + a, q[1] + b)
                        if s in left:
                            left.discard(s)
                            todo.append(s)
        for tile in (8, 64):
            assert {(x.row, x.col): x.region_id for x in regions.connected_regions(df, eight, tile).collect()} == want


def test_region_shapes(spark):
    ring = [(a, b) for a in range(5) for b in range(5) if a in (0, 4) or b in (0, 4)]
    df = spark.createDataFrame([("i", a, b, 1, 1.0) for a, b in ring], "image_id string, row int, col int, region_id long, cmf double")
    assert regions.fill_holes(df).count() == 25
    assert regions.borders(df).count() == len(ring)
    assert regions.borders(df, mode="thick").count() == len(ring) + 24 + 9 - 1
    assert regions.dilate(df.where("row = 0 and col = 0"), regions.diamond(2)).count() == 13
    assert regions.opened(df, regions.square(1)).count() == 0
    two = spark.createDataFrame([("i", 0, 0, 1, 1.0), ("i", 0, 3, 2, 1.0), ("i", 0, 9, 3, 1.0)], df.schema)
    assert sorted(tuple(x.originals) for x in regions.merge_regions(two, 1)[1].collect()) == [(1, 2), (3,)]
    sizes = spark.createDataFrame([("i", a, b, 1, 600.0 + 700 * (a == 8)) for a, b in [(r, c) for r in range(3) for c in range(3)] + [(8, 8), (20, 20)]], df.schema)
    assert regions.detections(sizes.drop("region_id")).groupBy("region_id").count().count() == 2


def brute_holes(label):
    """(row, col, region) of each region and what no 4-path around it leads out of."""
    out = set()
    for k in set(label.ravel().tolist()) - {0}:
        free = np.pad(label != k, 1, constant_values=True)
        seen, todo = {(0, 0)}, [(0, 0)]
        while todo:
            r, c = todo.pop()
            for a, b in regions.AROUND_4:
                q = (r + a, c + b)
                if 0 <= q[0] < free.shape[0] and 0 <= q[1] < free.shape[1] and q not in seen and free[q]:
                    seen.add(q)
                    todo.append(q)
        out |= {(r, c, k) for r in range(label.shape[0]) for c in range(label.shape[1]) if (r + 1, c + 1) not in seen}
    return out


def test_holes_of_nested_and_touching_regions(spark):
    """Rings in rings, islands in their holes, random masks, and an image whose regions touch; borders of all of them too."""
    r = np.random.default_rng(8)
    rings = np.zeros((31, 33), bool)
    for k in range(0, 15, 2):
        rings[k : 31 - k, k : 33 - k] = True
        rings[k + 1 : 30 - k, k + 1 : 32 - k] = False
    rings[2, 20] = False  # this ring is open, what lies in it stays in the ring around
    rings[1, 5] = True  # two rings are one region
    masks = {"rings": rings, "a": r.random((24, 24)) < 0.55, "b": r.random((24, 24)) < 0.7, "empty": np.zeros((3, 3), bool), "whole": np.ones((4, 5), bool)}
    rows = [(n, int(i), int(j)) for n, m in masks.items() for i, j in zip(*np.nonzero(m), strict=True)]
    found = regions.connected_regions(spark.createDataFrame(rows, "image_id string, row int, col int"), tile=8)
    labels = {n: np.zeros(m.shape, int) for n, m in masks.items()}
    for x in found.collect():
        labels[x.image_id][x.row, x["col"]] = x.region_id
    labels["touch"] = np.where(r.random((12, 12)) < 0.8, r.integers(1, 4, (12, 12)), 0)
    rows = [(n, int(i), int(j), int(m[i, j])) for n, m in labels.items() for i, j in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int, region_id long").repartition(3)
    got = {}
    for x in regions.fill_holes(df, tile=8).collect():
        got.setdefault(x.image_id, []).append((x.row, x["col"], x.region_id))
    for n, m in labels.items():
        assert sorted(got.get(n, [])) == sorted(brute_holes(m))
    within = regions.containment(df.where("image_id = 'rings'"))[1]
    assert within.groupBy("part").count().agg(F.max("count")).first()[0] >= 6  # so deep are they nested
    shape = spark.createDataFrame([(n, *m.shape) for n, m in labels.items()], "image_id string, nrow int, ncol int")
    for eight in (True, False):
        for mode in ("inner", "outer", "thick"):
            got = {(x.image_id, x.row, x["col"]) for x in regions.borders(df, shape, mode, eight).collect()}
            want = set()
            for n, m in labels.items():
                edge = np.pad(m, 1, mode="edge")
                changes = np.logical_or.reduce([edge[1 + a : edge.shape[0] - 1 + a, 1 + b : edge.shape[1] - 1 + b] != m for a, b in (regions.AROUND_8 if eight else regions.AROUND_4)])
                changes &= {"inner": m > 0, "outer": m == 0, "thick": m >= 0}[mode]
                want |= {(n, int(i), int(j)) for i, j in zip(*np.nonzero(changes), strict=True)}
            assert got == want


def test_value_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", float("nan")), ("a", float("nan")), ("a", None), ("b", 2.0)], "k string, v double")
    got = sorted((x.k, str(x.v), x.n) for x in triage.value_counts(df, ["k"], "v").collect())
    assert got == [("a", "1.0", 2), ("a", "nan", 2), ("b", "2.0", 1)]


@pytest.mark.parametrize("tile", [16, 32, 64])
def test_halo_work_is_that_of_the_whole_image(spark, tile):
    r = np.random.default_rng(2)
    image = r.uniform(0, 3000, (50, 45))
    df = spark.createDataFrame([("i", a, b, float(image[a, b])) for a in range(50) for b in range(45)], "image_id string, row int, col int, cmf double")
    shape = spark.createDataFrame([("i", 50, 45)], "image_id string, nrow int, ncol int")
    h = 3
    k = np.exp(-0.5 * (np.arange(-h, h + 1) / 3.0) ** 2)
    k /= k.sum()
    padded = np.pad(image, h, mode="symmetric")
    want = sum(k[i] * k[j] * padded[i : i + 50, j : j + 45] for i in range(2 * h + 1) for j in range(2 * h + 1))
    got = np.zeros((50, 45))
    for x in tiles.gaussian(df, shape, "cmf", 3.0, tile=tile).collect():
        got[x.row, x.col] = x.value
    assert np.allclose(got, want)
    model = lambda w: w.mean((1, 2))
    padded = np.pad(np.clip(image, 0, 4000) / 4000, ((4, 3), (4, 3)))
    for x in tiles.score_windows(df, shape, model, 8, 0.0, 4000.0, tile=tile).collect():
        assert abs(x.score - padded[x.row : x.row + 8, x.col : x.col + 8].mean()) < 1e-9


def test_stitching_interlaces(spark):
    image = np.arange(12 * 10, dtype=float).reshape(12, 10)
    df = spark.createDataFrame([("i", a, b, float(image[a, b])) for a in range(12) for b in range(10)], "image_id string, row int, col int, cmf double")
    shape = spark.createDataFrame([("i", 12, 10)], "image_id string, nrow int, ncol int")
    first = lambda x: x.reshape(len(x), x.shape[1] // 2, 2, x.shape[2] // 2, 2)[:, :, 1, :, 1]
    got = {(x.row, x.col): x.score for x in tiles.shift_and_stitch(df, shape, first, 2, 1, tile=4).collect()}
    near = {(a, b): image[min(max(a + da, 0), 11), min(max(b + db, 0), 9)] for da in (0,) for db in (0,) for a in range(12) for b in range(10)}
    assert sum(abs(got[p] - near[p]) < 1e-9 for p in near) > 60 or len(set(got.values())) > 60


def test_shrinkage_matches_the_long_way():
    r = np.random.default_rng(7)
    x = r.normal(size=(30, 12)) @ r.normal(size=(12, 12))
    x -= x.mean(0)
    n, best = len(x), None
    big = x * 100
    s = np.cov(big, rowvar=False)
    t = np.diag(np.diag(s))
    for a in matched_filter.alphas():
        beta = (1 - a) / (n - 1)
        g = n * beta * s + a * t
        rk = (big @ np.linalg.inv(g) * big).sum(1)
        q = 1 - beta * rk
        with np.errstate(invalid="ignore"):
            nll = 0.5 * (12 * np.log(2 * np.pi) + np.linalg.slogdet(g)[1]) + (np.log(q) + rk / q).sum() / (2 * n)
        if best is None or nll < best[0]:
            best = (nll, a)
    c, a = matched_filter.shrunk_covariance(x, n)
    assert a == best[1] and np.allclose(c, ((1 - a) * s + a * t) / 1e4)


def test_registered_overlap_filter_by_hand(spark, small):
    """All rows of the registered query, every overlap of a group worked out anew after each drop."""
    from plumery import plans
    from plumery.plans import plume_queries

    rows = plume_queries._grouped(spark, small)
    seen, groups = set(), {}
    at = rows.where("lat is not null").select("group_id", "row_id", "flux_a", "flux_b", geo.albers(F.col("lat"), F.col("lon")).alias("p"))
    null = {r.row_id for r in rows.where("lat is null").collect()}
    flux = {r.row_id: (r.flux_a, r.flux_b) for r in rows.collect()}
    first = set()
    for row in sorted(flux):
        if max(flux[row]) > 1 and flux[row] not in seen:
            seen.add(flux[row])
            first.add(row)
    for r in at.orderBy("row_id").collect():
        if r.row_id in first and r.row_id not in null:
            groups.setdefault(r.group_id, []).append((r.row_id, r.p.x, r.p.y, r.flux_a, r.flux_b))
    want = set()
    for own in groups.values():
        while len(own) > 1:
            v = []
            for row, x, y, _, _ in own:
                met = [d for other, a, b, _, _ in own if other != row and (d := math.hypot(x - a, y - b)) <= 300]
                v.append(round((2 * 150**2 * math.acos(met[0] / 300) - met[0] / 2 * math.sqrt(4 * 150**2 - met[0] ** 2)) / (math.pi * 150**2), 9) if met else 0.0)
            over = [k for k, o in enumerate(v) if o > 0.3]
            if not over:
                break
            least, most = [min(o[3:]) for o in own], [max(o[3:]) for o in own]
            if len(over) > 2:
                gone = {v.index(max(v))}
            elif len(set(v)) < len(v):
                low = {min(least[k], least[v.index(o)]) for k, o in enumerate(v) if v.index(o) < k}
                gone = {k for k, o in enumerate(least) if o in low}
            else:
                gone = {k for k, o in enumerate(most) if o == min(most)}
            own = [o for k, o in enumerate(own) if k not in gone]
        want |= {o[0] for o in own}
    assert {r.row_id for r in plans.QUERIES["overlap_filter"](spark, small).collect()} == want


def test_registered_tile_samples(spark, small):
    """As many as there are cells, up to the wanted number of each class; one of a cell at most, around a pixel of its class; the same again."""
    from plumery import plans
    from plumery.plans import views

    pixels = views.grid_pixels(spark, small).withColumn("label", F.when(F.col("cmf") > 3500, 1).when(F.col("cmf") > 0, 0).otherwise(-1)).collect()
    labels = {(p.image_id, p.row, p["col"]): p.label for p in pixels}
    cells = {}
    for (i, r, c), label in labels.items():
        cells.setdefault(label, set()).add((i, r // 16, c // 16))
    got = [tuple(x) for x in plans.QUERIES["tile_samples"](spark, small).collect()]
    for label, most in {1: 500, 0: 500, -1: 100}.items():
        own = [(i, (r + 8) // 16, (c + 8) // 16) for i, k, r, c in got if k == label]
        assert len(own) == len(set(own)) == min(most, len(cells[label])) and set(own) <= cells[label]
    assert all(labels[i, r + 8, c + 8] == k for i, k, r, c in got)
    assert sorted(got) == sorted(tuple(x) for x in plans.QUERIES["tile_samples"](spark, small).collect())


@pytest.mark.parametrize("rule", ["first", "largest"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_overlaps_of_large_groups_over_tasks(spark, rule, seed):
    """Groups cut into connected parts have the rows that one task leaves: crowded and sparse places, equal overlaps on a lattice,
    fluxes without a least one, a group with no overlap, one with few."""
    r = np.random.default_rng(seed)
    rows = []
    for g, (n, width) in enumerate(((140, 0.03), (120, 0.08), (60, 2.0), (90, 0.2))):
        at = r.uniform(0, width, (n, 2))
        if g == 1:
            at = np.round(at / 0.0015) * 0.0015  # repeated distances
        for k in range(n):
            a, b = (float(x) for x in r.uniform(1.5, 100, 2))
            rows.append((f"g{g}", len(rows), 35 + float(at[k, 0]), -118 + float(at[k, 1]), a, None if seed == 2 and k % 9 == 0 else b))
    df = spark.createDataFrame(rows, "group_id string, row_id long, lat double, lon double, flux_a double, flux_b double").repartition(3)
    whole, parts = ({x.row_id for x in overlap.filter_overlaps(df, ["flux_a", "flux_b"], rule=rule, held=h).collect()} for h in (1000, 20))
    assert whole == parts and 20 < len(whole) < len(rows)


@pytest.mark.parametrize("options", [{}, {"reflectance": True}, {"model": "empirical"}, {"n_modes": 3}, {"n_modes": 3, "regularise_full": True}])
def test_matched_filter_of_large_keys_over_tasks(spark, options):
    """Keys above the bound, cut into parts whose sums are added up, have the values of one task that holds them; small ones beside."""
    r = np.random.default_rng(9)
    rows = []
    for key, n in (("a", 400), ("b", 90), (None, 260), ("few", 25)):
        base = np.repeat([1.0, 3.0, 6.0], [n - n // 3 - 4, n // 3, 4])[:, None]  # the last mode is too small
        spectra = np.abs(base * (1 + np.arange(6) / 10) + r.normal(0, 0.05, (n, 6)) + r.normal(0, 0.2, (n, 1)))
        rows += [(key, int(k), row.tolist()) for k, row in enumerate(spectra)]
    df = spark.createDataFrame(rows, "image_id string, pixel_id long, spectrum array<double>").repartition(5)
    target = (1 + np.arange(6) % 3 / 10).tolist()
    whole, parts = ({(x.image_id, x.pixel_id): (x.cmf, x.mode) for x in matched_filter.matched_filter(df, target, ("image_id",), held=h, **options).collect()} for h in (1000, 40))
    assert len(whole) == len(rows) and whole.keys() == parts.keys()
    assert all(parts[k][1] == m for k, (_, m) in whole.items())
    assert any(m < 0 for _, m in whole.values()) == ("n_modes" in options)
    assert np.allclose([parts[k][0] for k in whole], [v for v, _ in whole.values()], rtol=1e-6, atol=1e-6 * max(abs(v) for v, _ in whole.values()))


def test_matched_filter_adds_many_parts(spark, monkeypatch):
    """More parts than are added at a time."""
    monkeypatch.setattr(matched_filter, "FEW", 3)
    r = np.random.default_rng(10)
    df = spark.createDataFrame([("a", int(k), np.abs(r.normal(5, 1, 4)).tolist()) for k in range(330)], "image_id string, pixel_id long, spectrum array<double>")
    whole, parts = ({x.pixel_id: x.cmf for x in matched_filter.matched_filter(df, [1.0, 1.1, 1.2, 1.0], ("image_id",), held=h).collect()} for h in (1000, 30))
    assert np.allclose([parts[k] for k in whole], list(whole.values()), rtol=1e-7)


def test_registered_filters_against_numpy(spark, small):
    """All rows of the registered queries, by the formulas, with inverses and determinants in place of eigenvalues."""
    from plumery import plans
    from plumery.plans import views

    target = 1 + np.arange(64) % 7 / 10
    spectra = views.spectra(spark, small).toPandas()
    got = {x.pixel_id: x.cmf for x in plans.QUERIES["matched_filter"](spark, small).collect()}
    for _, own in spectra.groupby("image_id"):
        x = np.stack(own["spectrum"])
        mu, n = x.mean(0), len(x)
        s = np.cov(x - mu, rowvar=False)
        best, chosen = np.inf, s
        for a in matched_filter.alphas():
            c = n * (1 - a) / (n - 1) * s + a * np.diag(np.diag(s))
            c *= 1e4
            sign, log_det = np.linalg.slogdet(c)
            rk = np.einsum("ij,jk,ik->i", 100 * (x - mu), np.linalg.inv(c), 100 * (x - mu)) if sign > 0 else np.full(n, np.nan)
            with np.errstate(invalid="ignore"):
                q = 1 - (1 - a) / (n - 1) * rk
                nll = 0.5 * (64 * np.log(2 * np.pi) + log_det) + (np.log(q) + rk / q).sum() / (2 * n)
            if nll < best:
                best, chosen = nll, (1 - a) * s + a * np.diag(np.diag(s))
        inv = np.linalg.inv(chosen)
        want = (x - mu) @ inv @ (target * mu) / ((target * mu) @ inv @ (target * mu)) * 100_000
        assert np.allclose([got[k] for k in own["pixel_id"]], want, rtol=1e-5, atol=1e-3 * np.abs(want).max())
    stats = plans.QUERIES["filter_columns"](spark, small).collect()
    assert {x.image_id for x in stats} == set(spectra["image_id"])
    for x in stats:
        own = np.stack(spectra[spectra["image_id"] == x.image_id].sort_values("pixel_id")["spectrum"])
        value, mode = matched_filter.filter_column(own, target, n_modes=2)
        kept = value[mode >= 0]
        assert x.npix == len(own) and np.allclose([x.avg, x.std], [kept.mean(), kept.std()], rtol=1e-6, atol=1e-6 * np.abs(kept).max())


def test_matched_filter_finds_what_was_added(spark):
    r = np.random.default_rng(8)
    base = r.normal(10, 0.3, (200, 10))
    target = -np.linspace(0.1, 1, 10) * 1e-5
    base[:20] += base[:20] * target * 2000
    rows = [(n, 0, v.tolist()) for n, v in enumerate(base)] + [(900, 0, [-1.0] * 10), (901, 0, [float("nan")] * 10)]
    df = spark.createDataFrame(rows, "pixel_id long, col int, spectrum array<double>").withColumn("image_id", F.lit("i"))
    for parts in (1, 6):
        got = {x.pixel_id: x.cmf for x in matched_filter.matched_filter(df.repartition(parts), target.tolist()).collect()}
        assert len(got) == 200 and np.mean([got[n] for n in range(20)]) > np.mean([got[n] for n in range(20, 200)]) + 3 * np.std([got[n] for n in range(20, 200)]) / 3
    stats = matched_filter.column_statistics(matched_filter.matched_filter(df, target.tolist(), n_modes=2)).first()
    assert stats.npix == 200


def test_inversion_is_the_textbooks(spark):
    r = np.random.default_rng(9)
    h, y = r.normal(size=(60, 5)), r.normal(1875, 5, 60)
    df = spark.createDataFrame([(a.tolist(), float(b), 1860.0) for a, b in zip(h, y, strict=True)], "h array<double>, xch4 double, back double")
    assert np.allclose(inversion.solve_fluxes(df), np.linalg.lstsq(h, y - 1860, rcond=None)[0])
    mean, cov = inversion.posterior(df)
    d = y - 1860
    so, sa = np.diag((0.1 * d) ** 2), np.eye(5) * 25
    gain = sa @ h.T @ np.linalg.inv(h @ sa @ h.T + so)
    assert np.allclose(mean, 10 + gain @ (d - h @ np.full(5, 10))) and np.allclose(cov, sa - gain @ h @ sa)
    with pytest.raises(Exception, match="background"):
        inversion.posterior(df.withColumn("xch4", F.lit(1860.0)))


@pytest.mark.parametrize("n", [1, 2, 11, 19, 20, 21, 31])
def test_nearest_ranks(spark, n):
    df = spark.createDataFrame([("i", 0, float(k + 1)) for k in range(n)] + [("i", 1, -1.0), ("i", 2, None)], "image_id string, col int, cmf double")
    row = triage.column_profile_robust(df).collect()
    low, high = (1 - 0.95) * (n - 1), 0.95 * (n - 1)
    assert len(row) == 1 and row[0].p05 == math.floor(low + 0.5) + 1 and row[0].p95 == round(high) + 1 and row[0].med == (n + 1) / 2


def test_known_triage_counts(spark):
    # A published confusion of 280 flight lines and the labels behind it.
    score = [0] * 120 + [0.5] * 13 + [1] * 83 + [2] * 64
    hit = [0] * 98 + [1] * 22 + [1] * 5 + [0] * 8 + [1] * 59 + [0] * 24 + [1] * 65
    hit = hit[:280]
    df = spark.createDataFrame([(n, int(h), float(s)) for n, (h, s) in enumerate(zip(hit, score, strict=False))], "image_id long, artifacts long, score double")
    c = triage.confusion(df.select("image_id", "artifacts"), df.select("image_id", "score")).first()
    assert (c.strict_clean_right, c.strict_clean_wrong) == (98, 22) and c.strong_hits == 59


@pytest.mark.parametrize(
    ("labels", "want"),
    [(["Plume"], "Plume"), (["Plume", "Reject"], "Reject"), (["Ambiguous", "Duplicate"], "Ambiguous"), (["Plume", "Cloud"], "Ambiguous"), (["Plume", "Background"], "Ambiguous"),
     (["Cloud", "Artifact"], "False Enhancement"), (["Plume", "Super Plume"], "Super Plume"), (["What", "Else"], None), ([None], None)],
)
def test_consensus(spark, labels, want):
    df = spark.createDataFrame([(n, "l", "c", n, x) for n, x in enumerate(labels)], "uid int, lid string, cid string, row_id int, label string")
    assert qc.consensus(df).first().label == want


def test_unknown_flag_is_an_error(spark):
    flags = spark.createDataFrame([(1, "l", "f", "odd")], "uid int, lid string, flag string, value string")
    rules = spark.createDataFrame([("f", "fine", "Accept")], "flag string, value string, decision string")
    with pytest.raises(Exception, match="no rule"):
        qc.flag_decisions(flags, rules).collect()


def test_curve(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (None, 1)], "score double, label int")
    rows = {r.threshold: (r.tp, r.fp) for r in evaluation.precision_recall(df).collect()}
    assert rows == {0.9: (1, 0), 0.8: (2, 1), 0.1: (2, 2)}
    assert evaluation.best_f1(evaluation.precision_recall(df)).first().threshold == 0.8


def test_conjugate_gradients_are_the_direct_solution(spark, monkeypatch):
    """Many unknowns by passes over the rows: the same fluxes, mean and covariances as by the whole matrix."""
    monkeypatch.setattr(inversion, "FEW", 3)
    r = np.random.default_rng(11)
    h = r.random((160, 40))
    x = r.uniform(1, 20, 40)
    y = h @ x + r.normal(0, 0.1, 160)
    df = spark.createDataFrame([(row.tolist(), 1860 + float(v), 1860.0) for row, v in zip(h, y, strict=True)], "h array<double>, xch4 double, back double").repartition(7)
    assert np.allclose(inversion.solve_fluxes(df, direct=10), inversion.solve_fluxes(df), rtol=1e-6)
    mean, covariance = inversion.posterior(df)
    got, columns = inversion.posterior_of(df, [0, 7, 39], block=2)
    assert np.allclose(got, mean, rtol=1e-7) and np.allclose(columns, covariance[:, [0, 7, 39]], rtol=1e-6, atol=1e-9)
    with pytest.raises(np.linalg.LinAlgError):
        inversion.solve_fluxes(df.withColumn("h", F.transform("h", lambda v, k: F.when(k == 3, 0.0).otherwise(v))), direct=10)


def test_fifty_thousand_unknowns(spark):
    """A matrix of 20 GB, never made: rows see a few unknowns each, strongly their own."""
    n = 50_000
    at = F.col("id").cast("int")
    h = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.pmod(k - at, F.lit(40)) == 0, F.when(k % 7 == 0, 3.0).otherwise(2.0)).otherwise(F.lit(0.0)))
    rows = spark.range(40, numPartitions=8).select(h.alias("h"), (F.lit(1860.5) + F.col("id") % 5).alias("xch4"), F.lit(1860.0).alias("back"))
    mean, columns = inversion.posterior_of(rows, [0, 49_999], prior_error=0.5, obs_error=0.1)
    # A row's unknowns are no other row's, so each row has a posterior of its own.
    for row in (0, 13, 39):
        own = np.arange(row, n, 40)
        v = np.where(own % 7 == 0, 3.0, 2.0)
        y = 0.5 + row % 5
        w = 1 / (0.1 * y) ** 2
        want = 10 + (w * (y - 10 * v.sum())) / (1 / 25 + w * v @ v) * v
        assert np.allclose(mean[own], want, rtol=1e-6)
        if row == 0:
            cov = np.eye(len(own)) * 25 - np.outer(v, v) * (25 * 25 * w / (1 + 25 * w * v @ v))
            assert np.allclose(columns[own, 0], cov[0], atol=1e-7)
    assert len(mean) == n and columns.shape == (n, 2)


def test_whole_images_are_labelled_as_tiles_are(spark):
    """Images worked on at once give what tiles give: regions, merged regions and candidates' groups, whatever the batches."""
    r = np.random.default_rng(12)
    rows = [(f"i{n}", int(a) - 5, int(b) - 7, float(r.uniform(0, 4000))) for n in range(6) for a, b in zip(*np.nonzero(r.random((23, 19)) < 0.2 + 0.1 * n), strict=True)]
    df = spark.createDataFrame([*rows, rows[0]], "image_id string, row int, col int, cmf double").repartition(3)
    for eight in (True, False):
        some, tiled = (sorted(map(tuple, regions.connected_regions(df, eight, 8, whole).collect())) for whole in (regions.WHOLE, 0))
        assert some == tiled and len(some) == len(rows) + 1
    found = regions.connected_regions(df.where("cmf > 3000").distinct())
    for distance in (0, 1, 2):
        some, tiled = (sorted((x.image_id, x.merged_id, tuple(x.originals)) for x in regions.merge_regions(found, distance, whole)[1].collect()) for whole in (regions.WHOLE, 0))
        assert some == tiled


def test_whole_groups_are_not_cut(monkeypatch):
    monkeypatch.setattr(regions, "AT_ONCE", 5)
    keys = [1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 4, None, None]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[at : at + 3], pa.int64())}) for at in range(0, len(keys), 3)]
    parts = [(t.column(0).to_pylist(), code.tolist()) for t, code in regions.whole_groups(iter(batches))]
    assert sum((p for p, _ in parts), []) == keys
    assert all(not set(a) & set(b) for (a, _), (b, _) in zip(parts, parts[1:])) and all(len(set(p)) == len(set(c)) for p, c in parts)


def test_candidates_are_many(spark):
    """Twenty thousand candidates are grouped by few tasks' batches, not one by one."""
    px = spark.range(400).selectExpr("cast(0 as long) AS image_id", "cast(id div 20 as int) AS row", "cast(id % 20 as int) AS col", "cast(1000 + id as double) AS cmf")
    at = spark.range(20000).selectExpr("id AS candidate_id", "cast(0 as long) AS image_id", "cast(id % 20 as int) AS row", "cast(id div 20 % 20 as int) AS col")
    found = regions.candidate_ime(px, at, 500.0, 4000.0, 2, 1, 3).agg(F.sum("n"), F.count(F.lit(1))).first()
    want = sum(1 for r in range(20) for c in range(20) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4 and 0 <= r + a < 20 and 0 <= c + b < 20)
    assert tuple(found) == (want * 50, 20000)


def test_nearest_and_farthest_of_points_on_the_other_side(spark):
    """Points far from every place, many at one place and many places alike: as by brute force, ties by the smallest id."""
    r = np.random.default_rng(21)
    at = np.stack([r.uniform(33, 36, 150), r.uniform(-119, -100, 150)], 1)[r.integers(0, 150, 400)]
    there = np.concatenate([np.stack([34 + r.integers(0, 10, 600) * 0.2, r.integers(0, 1800, 600) * 0.2 - 180], 1), np.repeat([[-35.0, 70.0]], 40, 0), np.repeat([[34.0, -110.0]], 40, 0)])
    places = spark.createDataFrame([(f"p{n}", float(a), float(b)) for n, (a, b) in enumerate(at)], "place_id string, lat double, lon double")
    points = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(there)], "grid_id long, lat double, lon double")
    a, b = np.radians(at)[:, None], np.radians(there)[None]
    d = 6378.137 * np.arccos(np.clip(np.sin(a[..., 0]) * np.sin(b[..., 0]) + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.cos(b[..., 1] - a[..., 1]), -1, 1))
    for sign in (1, -1):
        got = sorted((x.place_id, x.n, x.grid_id) for x in wind._nearest(places, points, 5, "grid_id", sign).collect())
        want = sorted((f"p{n}", k + 1, int(g)) for n in range(len(at)) for k, g in enumerate(np.lexsort((np.arange(len(there)), sign * np.round(d[n], 6)))[:5]))
        assert got == want


def test_holes_and_dilations_of_many_images_at_once(spark):
    """Boxes worked on at once give what large images' ways give; labels in two pieces go region by region; dilations cross tiles once."""
    r = np.random.default_rng(31)
    masks = {f"i{n}": r.random((17, 13)) < 0.35 + 0.07 * n for n in range(6)}
    rows = [(n, int(i) - 4, int(j) - 4) for n, m in masks.items() for i, j in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int").repartition(3)
    found = regions.connected_regions(df).cache()
    some, large = (sorted(map(tuple, regions.fill_holes(found, 8, whole).select("image_id", "row", "col", "region_id").collect())) for whole in (regions.WHOLE, 0))
    assert some == large and len(some) > len(rows)
    ring = [(a, b, 1) for a in range(5) for b in range(5) if a in (0, 4) or b in (0, 4)] + [(2, 2, 2), (9, 9, 2)]  # region 2 is in two pieces
    odd = spark.createDataFrame([("i", *x) for x in ring], "image_id string, row int, col int, region_id long")
    assert sorted((x.row, x["col"]) for x in regions.fill_holes(odd).where("region_id = 1").collect()) == [(a, b) for a in range(5) for b in range(5)]
    for tile in (4, 512):
        for steps in (regions.diamond(2), regions.square(1), [(0, 0), (3, -1)]):
            got = sorted(map(tuple, regions.dilate(df, steps, tile).collect()))
            assert got == sorted({(n, i + a, j + b) for n, i, j in rows for a, b in steps})


def test_clips_of_rings_of_any_size(spark):
    """Pixels in cells smaller than a ring meet it once."""
    features = [("big", [(0, 0), (40, 3), (37, 41), (2, 38), (0, 0)]), ("small", [(3, 3), (4.1, 3), (4.1, 4.2), (3, 3)]), ("far", [(90, 90), (91, 90), (91, 91), (90, 90)])]
    rings = spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in p]) for n, p in features], "feature_id string, ring array<struct<x: double, y: double>>")
    px = spark.createDataFrame([("i", r, c, c + 0.5, r + 0.25) for r in range(45) for c in range(45)], "image_id string, row int, col int, x double, y double")
    got = sorted((x.feature_id, x.row, x["col"]) for x in pixels.clip_to_rings(px, rings).collect())

    def inside(x, y, p):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:])) % 2 == 1

    assert got == sorted((n, r, c) for n, p in features for r in range(45) for c in range(45) if inside(c + 0.5, r + 0.25, p))


def test_labelled_and_merged_in_one_pass(spark, monkeypatch):
    """The same regions and merged ones as one after the other, of whole and of large images, with neighbours from a table or by a search."""
    r = np.random.default_rng(23)
    rows = [(f"i{k % 3}", int(a), int(b) - 9) for k, (a, b) in enumerate(r.integers(0, 40, (900, 2)))]
    px = spark.createDataFrame(sorted(set(rows)), "image_id string, row int, col int")
    want = sorted(map(tuple, regions.merge_regions(regions.connected_regions(px), 1)[0].select("image_id", "row", "col", "region_id", "merged_id").collect()))
    assert len({x[-1] for x in want}) > 1
    for whole, dense in ((regions.WHOLE, 16), (regions.WHOLE, 0), (0, 16)):
        monkeypatch.setattr(regions, "DENSE", dense)
        got, named = regions.merged_regions(px, 1, 16, whole)
        assert sorted(map(tuple, got.select("image_id", "row", "col", "region_id", "merged_id").collect())) == want
        assert sum(len(x.originals) for x in named.collect()) == len({(x[0], x[3]) for x in want})


def test_each_meeting_pair_is_found_once(spark):
    """half the pairs are worked out, the others are the same from the other row; places lie on both sides of cells' sides."""
    rows = [("g", n, 35.0 + (n % 9) * 0.0011, -118.0 + (n // 9) * 0.0013) for n in range(81)] + [("g", 99, None, 1.0), ("h", 7, 35.0, -118.0), ("g", 3, 35.0, -118.0)]
    plumes = spark.createDataFrame(rows, "group_id string, row_id long, lat double, lon double")
    once, both = (sorted(tuple(r) for r in f(plumes).collect()) for f in (overlap.meeting_pairs, overlap.overlap_pairs))
    assert len(both) == 2 * len(once) > 100 and sorted(once + [(g, b, a, d, o) for g, a, b, d, o in once]) == both
    xy = geo.albers(F.col("lat"), F.col("lon"))
    at = [tuple(r) for r in plumes.where("lat is not null").select("group_id", "row_id", xy["x"], xy["y"]).collect()]
    want = sorted((g, a, b) for g, a, x, y in at for h, b, u, v in at if g == h and a != b and (x - u) ** 2 + (y - v) ** 2 <= 300.0**2)
    assert [r[:3] for r in both] == want
