"""Operators without a registered query: by hand, or against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumery.functions import geo, names, physics
from plumery.operators import clustering, cover, evaluation, graph, overlap, pixels, qc, regions, selection, tiles, triage, wind
from plumery.sources import lists, rasters


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def image(spark, rows, columns="image_id string, row int, col int, cmf double"):
    return spark.createDataFrame(rows, columns)


def test_detections_have_their_place_and_are_exported_whole(spark, tmp_path):
    px = image(spark, [("a", r, c, 0.9 if (r, c) == (3, 5) else 0.6, 300.0 + r + c) for r in (2, 3) for c in (4, 5)], "image_id string, row int, col int, score double, cmf double")
    m = spark.range(1).select(F.lit("a").alias("image_id"), F.struct(F.lit(5e5).alias("ulx"), F.lit(4e6).alias("uly"), F.lit(3.0).alias("xps"), F.lit(3.0).alias("yps"), F.lit(0.0).alias("rotation"), F.lit(11).alias("zone"), F.lit("North").alias("hemi")).alias("map"))
    found = regions.score_regions(px, images=m)
    r = found.first()
    u = one(spark, u=geo.utm(F.lit(r.lat), F.lit(r.lon), F.lit(11))).u
    assert (r.max_row, r.max_col, r.cmf_max_row) == (3, 5, 3) and abs(u.x - (5e5 + 15)) < 1e-3 and abs(u.y - (4e6 - 9)) < 1e-3 and (r.cmf_lat, r.cmf_lon) == (r.lat, r.lon)
    lists.export_detections(found, str(tmp_path / "out"))
    assert len(spark.read.csv(str(tmp_path / "out"), header=True).columns) == 12
    with pytest.raises(ValueError, match="lat"):
        lists.export_detections(regions.score_regions(px), str(tmp_path / "no"))


def test_funnel_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "l1", "1", "Plume", 1), ("u2", "l1", "1", "Cloud", 2), ("u1", "l2", "1", "Duplicate", 3)], "uid string, lid string, cid string, label string, row_id long")
    lines = spark.createDataFrame([("u1", "l1"), ("u2", "l1")], "uid string, lid string")
    assigned = spark.createDataFrame([("u1", "l1"), ("u1", "l2"), ("u3", "l9")], "uid string, lid string")
    qc.write_funnel(rows, str(tmp_path), lines, assigned)
    n = {x: spark.read.parquet(f"{tmp_path}/{x}").count() for x in ("cid_all", "cid_filt", "cid_nodup", "cid_norej", "cid_noamb", "cid_diff", "lid_all", "todo", "done")}
    assert n == {"cid_all": 3, "cid_filt": 2, "cid_nodup": 1, "cid_norej": 1, "cid_noamb": 1, "cid_diff": 2, "lid_all": 2, "todo": 2, "done": 1}
    assert {(r.uid, r.lid) for r in qc.to_do(assigned, rows, lines).collect()} == {("u1", "l2"), ("u3", "l9")}
    assert qc.user_added(rows, lines.withColumn("cid", F.lit("1"))).select("lid").distinct().collect() == [("l2",)]


def test_images_of_lines(spark):
    images = spark.createDataFrame([("ang20160922t184215_cmf_v1g_img", 1), ("ang20170922t184215_cmf_v1g_img", 2), (None, 3)], "name string, lid int")
    lines = spark.createDataFrame([("ang20160922t184215",), ("ang20160922t184215",), (None,)], "lid string")
    assert [tuple(r) for r in qc.images_of_lines(images, lines).collect()] == [("ang20160922t184215_cmf_v1g_img", 1)]


def test_names_and_candidates(spark):
    r = one(spark, a=names.name_matches(F.lit("xab"), "ab"), b=names.name_matches(F.lit("xab"), "ab", True), c=names.name_matches(F.lit("abc"), "ab|x"))
    assert (r.a, r.b, r.c) == (False, True, True)
    p = spark.createDataFrame([(1, "l1x", "l1x-3", "FP", 34.0, -118.0, 0), (2, "l1x", "l1x-4", "FP", 34.0, -118.0, 0), (3, "l1x", "l1x-5", "TP", 34.0, -118.0, 1), (4, "l1x", "l1x-6", "TP", -9999.0, -9999.0, 1), (5, "zz", "zz-1", "TP", 34.0, -118.0, 1)],
        "row_id long, lid string, candidate_id string, evaluation string, lat double, lon double, class int")
    found = qc.image_candidates(p, "l1").collect()
    assert [(r.row_id, r.cid) for r in found] == [(3, "5"), (1, "3")] and abs(found[0].x + 13135699.9) < 1


def test_scalars(spark):
    w = one(spark, w=geo.web_mercator_inverse(F.lit(-13135699.913606), F.lit(4028802.026134)), b=geo.window_bounds(F.lit(1), 3, F.lit(10)), i=geo.in_box(F.lit(1), F.lit(5), F.struct(*(F.lit(v).alias(k) for k, v in {"xmin": 0, "xmax": 2, "ymin": 5, "ymax": 6}.items()))))
    assert abs(w.w.lat - 34) < 1e-6 and abs(w.w.lon + 118) < 1e-6 and (w.b.low, w.b.high, w.i) == (0, 4, True)
    s = one(spark, a=physics.standardised(F.lit(5000.0), 1000.0, 500.0), c=physics.class_of_label(F.lit("Super Plume")), d=physics.class_of_rgb(F.lit(0), F.lit(255), F.lit(255)), e=physics.rgb_of_class(F.lit(2)), f=physics.viewer_class(F.lit(255), F.lit(0), F.lit(0)), g=physics.viewer_class(F.lit(128), F.lit(128), F.lit(128)), h=physics.viewer_class(F.lit(0), F.lit(0), F.lit(255)))
    assert tuple(s) == (6.0, 1, 3, [0, 0, 255], 1, None, 0)
    assert pixels.bands_between([1000, 1945, 2000, 2485, 2500]) == (1, 3)
    with pytest.raises(ValueError):
        wind.at_altitude(spark.range(1), "RTMA", 80)


def test_labels_profiles_and_splits(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("ang1, 0.5\nang2, 2\n")
    labels = lists.curated_labels(spark, str(tmp_path / "labels.csv")).withColumnRenamed("name", "image_id")
    predicted = spark.createDataFrame([("ang1", 1), ("ang9", 0)], "image_id string, artifacts int")
    assert [r.image_id for r in triage.unlabelled(predicted, labels).collect()] == ["ang9"]
    profile = spark.createDataFrame([("ang20200102t000000", 1, 2.0), ("ang20190102t000000", 0, 1.0)], "image_id string, col int, med double")
    rasters.write_profiles(profile, str(tmp_path / "p"))
    assert [r.med for r in rasters.read_profiles(spark, str(tmp_path / "p")).collect()] == [1.0, 2.0]
    split = spark.createDataFrame([("train", "a")], "part string, lid string")
    assert evaluation.split_tiles(spark.createDataFrame([("a", 1), ("b", 2)], "lid string, n int"), split).select("part", "n").collect() == [("train", 1)]
    bands = spark.createDataFrame([("a", 0, 0, [1.0, 2.0, 3.0])], "image_id string, row int, col int, values array<double>")
    assert rasters.band_columns(bands, {"u": 2, "v": 0}).select("u", "v").first() == (3.0, 1.0)


def test_shapes_against_numpy(spark):
    r = np.random.default_rng(4)
    mask = r.random((14, 17)) < 0.6
    px = image(spark, [("a", int(i), int(j), 1.0) for i, j in zip(*np.nonzero(mask), strict=True)])
    pad = np.pad(mask, 1)
    eroded = np.logical_and.reduce([pad[1 + a : 15 + a, 1 + b : 18 + b] for a, b in regions.diamond(1)])
    assert {(x.row, x.col) for x in regions.erode(px, regions.diamond(1)).collect()} == set(zip(*np.nonzero(eroded), strict=True))
    back = np.logical_or.reduce([np.pad(eroded, 1)[1 + a : 15 + a, 1 + b : 18 + b] for a, b in regions.diamond(1)])
    assert {(x.row, x.col) for x in regions.opened(px, regions.diamond(1)).collect()} == set(zip(*np.nonzero(back), strict=True))
    target = px.where("row = 5")
    got = {(x.row, x.col): x.distance for x in regions.distance_to(px, target, 3).collect()}
    at = [(i, j) for i, j in got if i == 5]
    for (i, j), d in got.items():
        near = min(np.hypot(i - a, j - b) for a, b in at)
        assert (d is None) == (near > 3) and (d is None or abs(d - near) < 1e-9)
    shape = spark.createDataFrame([("a", 14, 17)], "image_id string, nrow int, ncol int")
    grid = image(spark, [("a", i, j, None if (i < 2 or (4 < i < 7 and 4 < j < 7)) else 1.0) for i in range(14) for j in range(17)])
    assert {(x.row, x.col) for x in regions.out_of_bounds(grid, shape, F.col("cmf").isNull()).collect()} == {(i, j) for i in (0, 1) for j in range(17)}


def test_stretch_and_smoothing(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(9, 8, 2))
    px = spark.createDataFrame([("a", i, j, float(v[i, j, 0]), float(v[i, j, 1])) for i in range(9) for j in range(8)], "image_id string, row int, col int, u double, w double")
    got = {(x.row, x.col): (x.u, x.w) for x in tiles.shared_stretch(px, ["u", "w"], 1.0).collect()}
    lo, hi = v.min((0, 1)).max(), v.max((0, 1)).min()
    assert all(np.allclose(got[i, j], np.clip((v[i, j] - lo) / (hi - lo), 0, 1)) for i in range(9) for j in range(8))
    shape = spark.createDataFrame([("a", 9, 8)], "image_id string, nrow int, ncol int")
    smooth = {(x.row, x.col): x["value"] for x in tiles.bilateral(px, shape, "u", 3, 0.5, 1.0, tile=4).collect()}
    wide = np.pad(v[:, :, 0], 1, "symmetric")
    for i in range(9):
        for j in range(8):
            w = {(a, b): np.exp(-(a * a + b * b) / 2 - (wide[1 + i + a, 1 + j + b] - v[i, j, 0]) ** 2 / 0.5) for a in (-1, 0, 1) for b in (-1, 0, 1) if a * a + b * b <= 1}
            assert abs(smooth[i, j] - sum(k * wide[1 + i + a, 1 + j + b] for (a, b), k in w.items()) / sum(w.values())) < 1e-9


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_both_ways(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    r = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))]
    top = list(range(130))
    for a, b in pairs * 130:
        top[a] = top[b] = min(top[a], top[b])
    for struct in (False, True):
        wrap = (lambda c: F.struct(F.lit("z").alias("k"), F.col(c).alias("n"))) if struct else F.col
        edges = spark.createDataFrame(pairs, "a long, b long").select(wrap("a").alias("a"), wrap("b").alias("b"))
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        got = graph.min_labels(spark.range(130).select(wrap("id").alias("node")), edges).collect()
        assert {(x.node.n if struct else x.node): (x.label.n if struct else x.label) for x in got} == dict(enumerate(top))


def test_hulls_against_all_lines(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HELD_POINTS", 20)
    r = np.random.default_rng(8)
    points = [(k, int(x), int(y)) for k in range(3) for x, y in r.integers(0, 12, (50, 2))] + [(7, 1, 1), (8, 0, 0), (8, 2, 2), (8, 1, 1), (None, 5, 5)]
    got = {x.key: [(p.x, p.y) for p in x.hull] for x in overlap.convex_hulls(spark.createDataFrame(points, "key long, x int, y int").repartition(4)).collect()}
    assert set(got) == {0, 1, 2, 7, 8} and got[7] == [(1, 1)] and got[8] == [(0, 0), (2, 2)]
    for k in range(3):
        own = {(x, y) for n, x, y in points if n == k}
        side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        lines = {(a, b) for a in own for b in own if a != b and all(side(a, b, c) > 0 or (side(a, b, c) == 0 and min(a, b) <= c <= max(a, b)) for c in own)}
        assert set(got[k]) == {a for a, _ in lines}
        assert all((a, b) in lines for a, b in zip(got[k], got[k][1:] + got[k][:1], strict=True)) and got[k][0] == min(own)


@pytest.mark.parametrize("seed", range(3))
def test_assignment_compares_as_with_all_centroids(seed):
    r = np.random.default_rng(seed)
    points = pd.DataFrame(np.round(r.uniform(-900, 900, (400, 2)), -1), columns=["x", "y"])  # many equal distances
    start = [[0.0, 0.0, 3], [100.0, -50.0, 1]]
    clusters, want = [list(c) for c in start], []
    for x, y in points.to_numpy():
        d = [(x - a) ** 2 + (y - b) ** 2 for a, b, _ in clusters]
        at = int(np.argmin(d)) if d and min(d) <= 150.0**2 else len(clusters)
        if at == len(clusters):
            clusters.append([x, y, 1])
        else:
            a, b, n = clusters[at]
            clusters[at] = [a + (x - a) / (n + 1), b + (y - b) / (n + 1), n + 1]
        want.append(at)
    own = [list(c) for c in start]
    assert clustering.assign(points, 150.0, own) == want and np.allclose(own, clusters)


def test_sampled_tiles(spark):
    r = np.random.default_rng(7)
    px = spark.createDataFrame(pd.DataFrame({"image_id": r.integers(0, 9, 3000), "row": r.integers(0, 64, 3000).astype("int32"), "col": r.integers(0, 64, 3000).astype("int32"), "label": r.integers(-1, 2, 3000)}))
    got = evaluation.sample_tiles(px, {1: 7, 0: 30, -1: 10**6}, 8)
    n = {x.label: x["count"] for x in got.groupBy("label").count().collect()}
    cells = px.selectExpr("image_id", "label", "row div 8 as r", "col div 8 as c").distinct().groupBy("label").count().collect()
    assert n[1] == 7 and n[0] == 30 and n[-1] == next(x["count"] for x in cells if x.label == -1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evaluation.sample_tiles(px.repartition(7), {1: 7, 0: 30, -1: 10**6}, 8).collect()))


def test_without_a_checkpoint_folder(spark):
    sc, base = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    graph.ensure_checkpoints(spark)
    assert sc.getCheckpointDir() == base


@pytest.mark.parametrize("sorted_at_once", [5, 10_000])
def test_order_statistics_of_large_groups(spark, monkeypatch, sorted_at_once):
    """Refined histograms give the medians, ranks and profiles that sorting gives: many scales, signs, ties, subnormal and infinite values."""
    monkeypatch.setattr(selection, "SORTED", sorted_at_once)
    monkeypatch.setattr(selection, "BINS", 7)
    r = np.random.default_rng(7)
    groups = {
        "normal": r.normal(3, 1, 301), "scales": 10.0 ** r.uniform(-300, 300, 200) * r.choice([-1, 1], 200), "ties": r.integers(0, 3, 250).astype(float),
        "same": np.full(90, 2.5), "ends": np.array([-np.inf, np.inf, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308] * 9), "close": 1 + np.arange(80) * 2.0**-52, None: r.random(70), "few": r.random(9),
    }
    rows = [(k, 1, float(v)) for k, own in groups.items() for v in own] + [("normal", 1, None)]
    df = spark.createDataFrame(rows, "image_id string, col int, cmf double").repartition(4)
    same = lambda x, y: x == y or abs(x - y) <= 1e-12 * abs(y) or (math.isnan(x) and math.isnan(y))
    large = selection.large_groups(df.where("cmf is not null"), ["image_id"], 50)
    got = {x.image_id: x for x in selection.ranks_of_large(df.where("cmf is not null"), ["image_id"], "cmf", large, {"a": lambda n: F.lit(3), "b": lambda n: n - 2}).collect()}
    assert set(got) == set(groups) - {"few"}
    for k, x in got.items():
        own = np.sort(groups[k])
        assert (x.n, x.a, x.b) == (len(own), own[3], own[-2])
    finite = df.where("image_id in ('normal', 'ties', 'same', 'close', 'few')")
    for name, f in (("spread", lambda h: triage.spread(finite, ["image_id"], "cmf", held=h)), ("extrema", lambda h: triage.extrema(finite, ["image_id"], "cmf", 0.9, 0.1, held=h)), ("profile", lambda h: triage.column_profile_robust(finite, held=h))):
        whole, parts = ({x[0]: list(x)[1:] for x in f(h).collect()} for h in (10_000, 50))
        assert whole.keys() == parts.keys() == {"normal", "ties", "same", "close", "few"}, name
        assert all(same(a, b) for k in whole for a, b in zip(parts[k], whole[k], strict=True)), name
    pixels = finite.select("image_id", F.lit(1).alias("region_id"), (F.monotonically_increasing_id() % 1000).alias("row"), "col", "cmf").where("cmf is not null")
    whole, parts = ({x.image_id: x.asDict() for x in regions.region_statistics(pixels, held=h).collect()} for h in (10_000, 50))
    assert whole.keys() == parts.keys() and all(same(parts[k][c], whole[k][c]) for k in whole for c in ("n", "med", "mad", "vmax", "total"))


def even_odd(x, y, rings):
    """Crossings of a ray to the right of each place, for closed rings of numpy corners."""
    inside = np.zeros(len(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            hit = (y1 > y) != (y2 > y)
            if y1 != y2:
                inside ^= hit & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


@pytest.mark.parametrize("cell", [0.03, 0.4, 50.0])
def test_points_in_rings(spark, cell):
    """Stars, boxes on cell borders, holes, an island beside, one ring twice: as by all edges, for any cell."""
    r = np.random.default_rng(12)
    rings = {}
    for k in range(6):
        angle = np.sort(r.uniform(0, 2 * np.pi, 40))
        star = np.stack([np.cos(angle), np.sin(angle)], 1) * r.uniform(0.5, 3, (40, 1)) + r.uniform(-3, 3, 2)
        rings[k] = [np.vstack([star, star[:1]])]
    box = lambda a, b, c, d: np.array([(a, b), (c, b), (c, d), (a, d), (a, b)], float)
    rings[6] = [box(-2, -2, 2, 2), box(-1, -1, 1, 1), box(1.2, 1.2, 1.6, 1.6)]
    rings[7] = [box(-4, -4, -3.2, 4), box(3.2, -4, 4, 4)]
    rings[8] = rings[0]
    corners = lambda ring: [(float(a), float(b)) for a, b in ring]
    point = "struct<x: double, y: double>"
    lines = spark.createDataFrame([(k, corners(v[0]), [corners(h) for h in v[1:]] or None) for k, v in rings.items()] + [(9, [], None), (10, None, None)], f"ring_id long, ring array<{point}>, holes array<array<{point}>>")
    at = np.round(r.uniform(-4.5, 4.5, (700, 2)), 2)
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)] + [(700, None, 1.0)], "point_id long, x double, y double")
    got = sorted((x.point_id, x.ring_id) for x in cover.points_in_rings(points, lines, cell).collect())
    edge = {6: lambda x, y: np.isin(np.maximum(abs(x), abs(y)), [1, 2]) | ((x >= 1.2) & (x <= 1.6) & (y >= 1.2) & (y <= 1.6) & (np.isin(x, [1.2, 1.6]) | np.isin(y, [1.2, 1.6])))}
    edge[7] = lambda x, y: (np.isin(abs(x), [3.2, 4]) & (abs(y) <= 4)) | ((abs(y) == 4) & (abs(x) >= 3.2) & (abs(x) <= 4))
    want = set()
    for k, own in rings.items():
        inside = even_odd(at[:, 0], at[:, 1], own)
        if k in edge:
            inside &= ~edge[k](at[:, 0], at[:, 1])
        want |= {(int(n), k) for n in np.flatnonzero(inside)}
    assert got == sorted(want)


def test_a_large_ring_over_many_cells(spark):
    """100,000 corners over a million cells: what is kept grows with the border, not with the cells inside."""
    n = 100_000
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 480 + 10 * np.sin(37 * angle) + 3 * np.sin(1001 * angle)
    ring = np.stack([500 + radius * np.cos(angle), 500 + radius * np.sin(angle)], 1)
    ring = np.vstack([ring, ring[:1]])
    lines = spark.createDataFrame([(1, ring.tolist())], "ring_id long, c array<array<double>>").select("ring_id", F.transform("c", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))
    bands = cover.banded_edges(lines, 1.0).cache()
    borders = cover.border_cells(bands, 1.0).cache()
    inner = cover.inner_intervals(borders)
    assert bands.count() < 2.5 * n and inner.count() < 12_000  # of some 720,000 cells inside
    at = np.random.default_rng(1).uniform(0, 1000, (3000, 2))
    d, a = np.hypot(at[:, 0] - 500, at[:, 1] - 500), np.arctan2(at[:, 1] - 500, at[:, 0] - 500) % (2 * np.pi)
    edge = 480 + 10 * np.sin(37 * a) + 3 * np.sin(1001 * a)
    sure = abs(d - edge) > 0.05
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "point_id long, x double, y double")
    got = {x.point_id for x in cover.points_in_rings(points, lines, 1.0).collect()}
    assert all((k in got) == (d[k] < edge[k]) for k in np.flatnonzero(sure))


@pytest.mark.parametrize("bend", [0.0, 0.3])
def test_regrid_of_a_turned_and_bent_grid(spark, bend):
    """Cells of any shape: linear fields come out exactly, others as by a numeric inverse of each cell's map; the rest is filled."""
    r = np.random.default_rng(3)
    n, m = 9, 8
    i, j = np.indices((n, m))
    turn = np.radians(25)
    u, w = j + bend * r.uniform(-1, 1, (n, m)) * 0.6, i + 0.4 * j + bend * r.uniform(-1, 1, (n, m)) * 0.6
    lon, lat = 10 + 0.1 * (np.cos(turn) * u - np.sin(turn) * w), 50 + 0.1 * (np.sin(turn) * u + np.cos(turn) * w)
    noise = r.uniform(0, 1, (n, m))
    rows = [("linear", int(a), int(b), float(lat[a, b]), float(lon[a, b]), float(3 * lon[a, b] - 2 * lat[a, b])) for a in range(n) for b in range(m)]
    rows += [("noise", int(a), int(b), float(lat[a, b]), float(lon[a, b]), float(noise[a, b])) for a in range(n) for b in range(m)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int, lat double, lon double, v double").repartition(3)
    got = {}
    for x in tiles.regrid(df, "v", 0.025).collect():
        got.setdefault(x.image_id, {})[round(x.lat / 0.025), round(x.lon / 0.025)] = x.value
    inside = 0
    for (gy, gx), value in got["linear"].items():
        q = np.array([gx * 0.025, gy * 0.025])
        found = None
        for a in range(n - 1):
            for b in range(m - 1):
                p = [np.array([lon[a + k, b + l], lat[a + k, b + l]]) for k in (0, 1) for l in (0, 1)]
                if found is None and (np.min(p, 0) <= q).all() and (q <= np.max(p, 0)).all():
                    s = np.array([0.5, 0.5])
                    for _ in range(60):  # Newton steps
                        here = p[0] * (1 - s[0]) * (1 - s[1]) + p[1] * s[0] * (1 - s[1]) + p[2] * (1 - s[0]) * s[1] + p[3] * s[0] * s[1]
                        slope = np.stack([(p[1] - p[0]) * (1 - s[1]) + (p[3] - p[2]) * s[1], (p[2] - p[0]) * (1 - s[0]) + (p[3] - p[1]) * s[0]], 1)
                        s = np.clip(s - np.linalg.solve(slope, here - q), -2, 3)
                    if (s > -1e-10).all() and (s < 1 + 1e-10).all():
                        found = (a, b, s)
        if found is None:
            assert value == -9999.9 and got["noise"][gy, gx] == -9999.9
            continue
        inside += 1
        a, b, s = found
        v = [noise[a, b], noise[a, b + 1], noise[a + 1, b], noise[a + 1, b + 1]]
        assert abs(value - (3 * q[0] - 2 * q[1])) < 1e-9
        assert abs(got["noise"][gy, gx] - (v[0] * (1 - s[0]) * (1 - s[1]) + v[1] * s[0] * (1 - s[1]) + v[2] * (1 - s[0]) * s[1] + v[3] * s[0] * s[1])) < 1e-8
    assert inside > 500
