"""Files in, files out, and streams, on small folders."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumery.functions import geo
from plumery.operators import clustering
from plumery.sources import lists, rasters
from plumery.streaming import jobs, versions

HEAD = "Candidate ID, Line name, Plume Latitude (deg), Plume Longitude (deg), Minimum Threshold (ppmm), extra"


def test_lists(spark, tmp_path):
    (tmp_path / "a_minppmm500.csv").write_text(f"{HEAD}\nang20200906t195820-A, ang20200906t195820, 35.1, -118.2, 500, x\nang20200906t195820-B, ang20200906t195820, -9999, -9999, 500, #VALUE!\n")
    (tmp_path / "b_minppmm500.csv").write_text(f"{HEAD}\nang20200907t195820-C, ang20200907t195820, 36, -118, NA, y\n")
    raw = lists.read_list(spark, [str(tmp_path / "a_minppmm500.csv"), str(tmp_path / "b_minppmm500.csv")])
    df = lists.normalise(raw)
    rows = {r.candidate_id[-1]: r for r in df.collect()}
    assert rows["A"].lat == 35.1 and rows["B"].extra is None and rows["C"].min_ppmm is None and rows["B"].lat is None or rows["B"].lat == -9999
    assert lists.located(df).count() == 2
    one = lists.with_threshold(spark.read.csv(str(tmp_path / "a_minppmm500.csv"), header=True)).first()
    assert one.min_ppmm == 500
    assert lists.new_files(spark, str(tmp_path), None).count() == 0 and lists.new_files(spark, str(tmp_path), None, r"a_.*\.csv", True).count() == 1
    assert lists.new_files(spark, str(tmp_path), "2001-01-01T00:00:00").count() == 2


def test_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("# Name, v\né, 1\n".encode())
    (tmp_path / "l.csv").write_bytes("# Name, v\né, 2\n".encode("iso-8859-1"))
    rows = lists.read_any_encoding(spark, str(tmp_path), ["Name", "v"]).collect()
    assert sorted((r.Name, r.v) for r in rows) == [("é", "1"), ("é", "2")]


def test_insert_and_versions(spark, tmp_path):
    old, new = spark.createDataFrame([("b", "1"), ("a", "2")], "k string, v string"), spark.createDataFrame([("aa", "3", None), ("c", "4", "odd")], "k string, v string, w string")
    fine, bad = lists.insert(old, new, "k")
    assert [r.k for r in fine.collect()] == ["a", "aa", "b"] and [r.k for r in bad.collect()] == ["c"]
    paths = [lists.write_version(fine, str(tmp_path), 1) for _ in range(2)]
    assert paths[0] != paths[1] and spark.read.csv(paths[0], header=True).count() == 3


def test_sheets_and_footprints(spark):
    auto = spark.createDataFrame([("l-A", "TP"), ("l-B", "FP")], "`#cid` string, evaluation string")
    manual = spark.createDataFrame([("l-C",), ("l-C",)], "cid string")
    rows = {r.cid: r.label for r in lists.two_sheets(auto, manual, truncated=True, dedup=["cid"]).collect()}
    assert rows == {"A": "Plume", "B": "False Enhancement", "C": "Plume"}
    f = lists.footprints(spark.createDataFrame([("run1 x", "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "Name string, wkt string")).first()
    assert f.flight_run == "run1" and len(f.ring) == 4 and f.ring[1].x == 1 and f.holes == []
    wkt = "POLYGON((0 0,9 0, 9 9 ,0 9,0 0), (1 1, 2 1, 2 2, 1 1),(4 4,5 4,5 5,4 4))"
    f = lists.footprints(spark.createDataFrame([("run2", wkt)], "Flight_Run string, wkt string")).first()
    assert len(f.ring) == 5 and [[(p.x, p.y) for p in h] for h in f.holes] == [[(1, 1), (2, 1), (2, 2), (1, 1)], [(4, 4), (5, 4), (5, 5), (4, 4)]]


def test_submissions_rules_and_tiles(spark, tmp_path):
    d = tmp_path / "ann" / "submitted"
    d.mkdir(parents=True)
    (d / "l1_cid.csv").write_text("cid,Label\n1,Plume\n")
    (d / "l1_lid.csv").write_text("flag\nx\n")
    cid, lid = lists.submissions(spark, str(tmp_path))
    assert (cid.first().uid, cid.first().lid, lid.first().lid) == ("ann", "l1", "l1")
    (tmp_path / "rules.json").write_text('{"cloud": {"accept": ["None"], "reject": ["Severe", "Bad"]}}')
    assert {(r.value, r.decision) for r in lists.rules(spark, str(tmp_path / "rules.json")).collect()} == {("None", "Accept"), ("Severe", "Reject"), ("Bad", "Reject")}
    (tmp_path / "split.json").write_text('{"train": ["a", "b"], "test": ["c"]}')
    assert {(r.part, r.lid) for r in lists.line_split(spark, str(tmp_path / "split.json")).collect()} == {("train", "a"), ("train", "b"), ("test", "c")}
    (tmp_path / "tiles.csv").write_text("/x/y/l1/1/t.png, -1\n")
    assert lists.tile_index(spark, str(tmp_path / "tiles.csv")).first() == ("l1/1/t.png", -1)


@pytest.mark.parametrize("interleave", ["bip", "bil", "bsq"])
def test_images(spark, tmp_path, interleave):
    image = np.arange(3 * 4 * 4, dtype="<f4").reshape(3, 4, 4)
    image[1, 2, 3] = -9999
    axes = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}[interleave]
    (tmp_path / "img").write_bytes(image.transpose(axes).tobytes())
    (tmp_path / "img.hdr").write_text(f"ENVI\nsamples = 4\nlines = 3\nbands = 4\ndata type = 4\ninterleave = {interleave}\nbyte order = 0\ndata ignore value = -9999\nband names = {{\n r, g, b, ch4}}\n")
    rows = {(r.row, r.col): r for r in rasters.enhancement_pixels(rasters.read_images(spark, str(tmp_path), partition_bytes=70)).collect()}
    assert len(rows) == 12 and rows[2, 1].cmf == image[2, 1, 3] and rows[1, 2].r is None
    info = rasters.map_info(["UTM", "1", "1", "500000", "4000000", "3.1", "3.1", "11", "North", "WGS-84", "units=Meters", "rotation=17"])
    assert info["zone"] == 11 and info["rotation"] == 17


@pytest.mark.parametrize("interleave", ["bip", "bil", "bsq"])
def test_bands_and_lines_of_images(spark, tmp_path, interleave):
    """Chosen bands in their order, lines by filter, images by name, however the image is cut; null by the last chosen band."""
    r = np.random.default_rng(1)
    axes = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}[interleave]
    images = {}
    for name, lines in (("a", 7), ("b", 1), ("none", 0)):
        images[name] = image = r.integers(-5, 100, (lines, 5, 9)).astype(">i2")
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name).write_bytes(b"HEAD!" + image.transpose(axes).tobytes())
        head = f"ENVI\nsamples = 5\nlines = {lines}\nbands = 9\nheader offset = 5\ndata type = 2\ninterleave = {interleave}\nbyte order = 1\ndata ignore value = -5\n"
        (tmp_path / "sub" / f"{name}.hdr").write_text(head)
    (tmp_path / "alone").write_bytes(b"not an image")
    for size in (64, 1 << 20):
        df = rasters.read_images(spark, str(tmp_path), [8, 0], any_band=False, partition_bytes=size)
        got = {(x.image_id, x.row, x["col"]): x["values"] for x in df.collect()}
        assert got == {
            (name, i, j): None if im[i, j, 0] == -5 else [float(im[i, j, 8]), float(im[i, j, 0])] for name, im in images.items() for i in range(len(im)) for j in range(5)
        }
        some = df.where("image_id = 'a' and row >= 2 and row < 4")
        assert {(x.image_id, x.row) for x in some.collect()} == {("a", 2), ("a", 3)} and some.count() == 10
        assert df.where("image_id in ('b', 'c') and col = 3").count() == 1 and df.where("image_id = 'c'").count() == 0


def test_image_of_more_than_two_gigabytes(spark, tmp_path):
    """A file with holes: 2.4 GB by its size. Many tasks; a few lines are read from where they lie."""
    samples, bands, lines = 600, 400, 5000
    line = samples * bands * 2
    marked = np.arange(samples * bands, dtype="<i2").reshape(samples, bands)
    with open(tmp_path / "big", "wb") as f:
        for at in (0, 2100, 4999):
            f.seek(at * line)
            f.write(marked.tobytes())
    (tmp_path / "big.hdr").write_text(f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {bands}\ndata type = 2\ninterleave = bip\nbyte order = 0\n")
    assert (tmp_path / "big").stat().st_size > 2 << 30
    df = rasters.read_images(spark, str(tmp_path), bands=[3, 399])
    assert df.rdd.getNumPartitions() == -(-lines * line // rasters.PARTITION_BYTES)
    rows = df.where("row >= 2099 and row <= 2100").collect()
    assert len(rows) == 2 * samples
    assert {x["col"]: x["values"] for x in rows if x.row == 2100} == {k: [float(marked[k, 3]), float(marked[k, 399])] for k in range(samples)}
    assert all(x["values"] == [0.0, 0.0] for x in rows if x.row == 2099)


def test_granules(spark, tmp_path):
    whole = b"GRIB" + b"\0" * 4 + struct.pack(">Q", 24) + b"\0" * 4 + b"7777"
    for name, data in (("ok", whole * 2), ("empty", b""), ("cut", whole[:-1])):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.messages, r.status) for r in rasters.granule_health(spark, str(tmp_path)).collect()}
    assert got == {"ok": (2, "ok"), "cut": (0, "failed"), "empty": (0, "failed")}


def test_sources_in_a_state_store(spark, tmp_path):
    """Three runs of a query that starts again each time give the sources of one pass over all plumes, on both sides of a
    square's border too; a batch leaves the state of other squares alone."""
    r = np.random.default_rng(4)
    border = 5 * jobs.SQUARE_KM * 1000.0  # of two squares, in the middle of zone 11: longitude -117
    rows = [(n, 36.1 + float(a), -117.0 + float(b)) for n, (a, b) in enumerate(r.normal(0, 0.004, (120, 2)))]
    rows += [(120 + n, 36.1 + float(a), -115.5) for n, a in enumerate(r.normal(0, 0.001, 20))]
    (src := tmp_path / "in").mkdir()
    schema = "row_id long, lat double, lon double"
    for n, part in enumerate((rows[:50], [*rows[50:90], *rows[120:]], rows[90:120])):
        (src / f"{n}.csv").write_text("h\n" + "".join(",".join(map(str, x)) + "\n" for x in part))
        query = jobs.assign_sources(jobs.plume_stream(spark, str(src), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        updated = sum(o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"])
        assert 0 < updated < 200
    df = spark.createDataFrame(rows, schema)
    at = clustering.placed_points(df).toPandas().sort_values("row_id")
    assert (at["x"] < border).sum() > 30 and (at["x"] > border).sum() > 30 and at["zone"].nunique() == 1
    order = [*range(50), *range(50, 90), *range(120, 140), *range(90, 120)]
    number = clustering.assign(at.set_index("row_id").loc[order], 150.0)
    first = {c: row for c, row in zip(reversed(number), reversed(order), strict=True)}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {x.row_id: x.source_key for x in got} == {row: f"S{first[c]:012d}" for row, c in zip(order, number, strict=True)}
    assert len(got) == len(rows) and all(x.certain for x in got)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "row_id long, candidate_id string, lat double, lon double, ime_fetch_avg double, ime_fetch_std double, aspect_ratio double"
    rows = [(n, f"ang20240101t12{n:02d}00-{n}", 35 + (n % 3) * 0.0006, -118 + (n % 2) * 0.0007, 1.0, 0.1, 0.5) for n in range(12)]
    grid = spark.createDataFrame([(g, 35 + g * 0.01, -118.0, f"2024-01-01 {h}:00:00", 3.0, 4.0) for g in range(12) for h in (11, 12, 13)], "grid_id long, lat double, lon double, t string, u double, v double").withColumn("valid_time", F.col("t").cast("timestamp"))
    out, cp = (str(tmp_path / x) for x in ("out", "cp"))
    for n, part in enumerate((rows[:5], rows[5:])):
        (src / f"{n}.csv").write_text("h\n" + "".join(",".join(map(str, r)) + "\n" for r in part))
        stream = jobs.plume_stream(spark, str(src), schema)
        jobs.upsert_enriched(stream, grid, f"{out}/wind", f"{cp}/wind", k=3).awaitTermination()
        jobs.assign_sources(jobs.plume_stream(spark, str(src), schema), f"{out}/sources", f"{cp}/sources").awaitTermination()
    done = jobs.enriched_list(spark, f"{out}/wind")
    assert done.count() == 12 and done.where("wind_mean = 5").count() == 12
    before = versions.Versions(spark, f"{out}/wind").current()
    (src / "2.csv").write_text("h\n" + ",".join(map(str, (*rows[3][:4], 7.0, *rows[3][5:]))) + "\n" + ",".join(map(str, (99, "ang20240102t120000-99", *rows[3][2:]))) + "\n")
    jobs.upsert_enriched(jobs.plume_stream(spark, str(src), schema), grid, f"{out}/wind", f"{cp}/wind", k=3).awaitTermination()
    done = jobs.enriched_list(spark, f"{out}/wind")  # the plume that came again is replaced, the one of another day added
    assert done.count() == 13 and done.where("candidate_id = '%s' and ime_fetch_avg = 7" % rows[3][1]).count() == 1
    old = versions.Versions(spark, f"{out}/wind").read(manifest=before)  # a reader of the version before still has it whole
    assert old.count() == 12 and old.where("ime_fetch_avg = 7").count() == 0
    u = spark.createDataFrame(rows, schema).select("row_id", geo.utm(F.col("lat"), F.col("lon")).alias("u")).select("row_id", "u.x", "u.y").toPandas().sort_values("row_id")
    want = clustering.assign(u, 150.0)
    got = {r.row_id: r.source_key for r in spark.read.parquet(f"{out}/sources").collect()}
    assert len(got) == 12 and [sorted(got.values()).count(got[n]) for n in range(12)] == [want.count(w) for w in want]

    seen = tmp_path / "seen"
    seen.mkdir()
    (seen / "a.csv").write_text("h\np1,ok\np2,failed\n")
    arrived = spark.readStream.schema("path string, status string").option("header", True).csv(str(seen))
    jobs.completeness(arrived, spark.createDataFrame([("p1",), ("p2",), ("p3",)], "path string"), f"{out}/feed", f"{cp}/feed").awaitTermination()
    assert {r.path for r in jobs.missing_paths(spark, f"{out}/feed").collect()} == {"p2", "p3"}
    (seen / "b.csv").write_text("h\np2,ok\n")
    jobs.completeness(arrived, spark.createDataFrame([("p1",), ("p2",), ("p3",)], "path string"), f"{out}/feed", f"{cp}/feed").awaitTermination()
    assert {r.path for r in jobs.missing_paths(spark, f"{out}/feed").collect()} == {"p3"}


def test_versions_switch_as_a_whole(spark, tmp_path):
    """A batch that fails before its switch changes nothing, two writers can't make the same version, old files go with their versions."""
    root = str(tmp_path / "table")
    table = versions.Versions(spark, root)
    assert table.read("a long").count() == 0
    for n in range(4):
        now = table.current()
        path = table.folder()
        spark.range(n + 1).toDF("a").write.parquet(path)
        table.switch(now | {"parts": now["parts"] | {f"part {n % 3}": path}, "rows": "a long"})
    assert table.current()["version"] == 4 and table.read().count() == 4 + 2 + 3 and table.read(keys=["part 1"]).count() == 2
    stale = now | {"parts": {}}
    with pytest.raises(RuntimeError):
        table.switch(stale)
    spark.range(9).toDF("a").write.parquet(table.folder())  # written, never switched to
    assert table.read().count() == 9
    table.expire(keep=1)
    assert len(list((tmp_path / "table" / "data").iterdir())) == 3 and table.read().count() == 9 and table.current()["version"] == 4


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    """The stream's own account of a batch is lost after the switch: the batch comes again and is passed over. Arrivals are taken out
    of the missing paths in between."""
    monkeypatch.setattr(jobs, "COMPACTED", 3)
    (seen := tmp_path / "seen").mkdir()
    arrived = spark.readStream.schema("path string, status string").option("header", True).csv(str(seen))
    expected = spark.createDataFrame([(f"p{n}",) for n in range(8)], "path string")
    for n in range(6):
        (seen / f"{n}.csv").write_text(f"h\np{n},{'failed' if n == 2 else 'ok'}\n")
        jobs.completeness(arrived, expected, f"{tmp_path}/feed", f"{tmp_path}/cp").awaitTermination()
    want = {"p2", "p6", "p7"}
    assert {r.path for r in jobs.missing_paths(spark, f"{tmp_path}/feed").collect()} == want
    version = versions.Versions(spark, f"{tmp_path}/feed").current()
    assert version["version"] == 6 and len(version["parts"]) <= 3
    commits = sorted(p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    jobs.completeness(arrived, expected, f"{tmp_path}/feed", f"{tmp_path}/cp").awaitTermination()
    assert versions.Versions(spark, f"{tmp_path}/feed").current() == version
    assert {r.path for r in jobs.missing_paths(spark, f"{tmp_path}/feed").collect()} == want
