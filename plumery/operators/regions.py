"""Connected regions of images: labels, statistics, size filters, merging, holes and borders.

An image is a table of pixels (image_id, row, col, ...). Images of at most WHOLE pixels are labelled many at a time in the task that
has them; larger ones tile by tile, and labels that touch across tile borders are merged as a graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumery.functions import geo, physics
from plumery.operators import selection
from plumery.operators.graph import cut, min_labels, saved

TILE = 512
#: Images of more pixels than this are labelled by tiles; rows of whole images that a task works on at once.
WHOLE, AT_ONCE = 1 << 18, 1 << 17
#: Places of boxes that holes are looked for in at once, and those of one image at most beside them.
CELLS = 1 << 20
#: Neighbours are looked up in a table of all places where these are at most so many times the pixels, else by a search.
DENSE = 16
AROUND_8 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
AROUND_4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def label_mask(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels 1 .. n of the components of a mask, by repeated minima along runs; 0 outside."""
    h, w = mask.shape
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        near = np.full((h + 2, w + 2), big)
        near[1:-1, 1:-1] = np.where(mask, lab, big)
        best = near[1:-1, 1:-1].copy()
        for a, b in AROUND_8 if eight else AROUND_4:
            best = np.minimum(best, near[1 + a : h + 1 + a, 1 + b : w + 1 + b])
        new = np.where(mask, best, 0)
        flat = np.concatenate(([0], new.ravel()))
        low = np.arange(h * w + 1)  # pointers: a label points at the smallest label seen next to it
        np.minimum.at(low, lab.ravel(), new.ravel())
        while True:
            jump = low[low]
            if (jump == low).all():
                break
            low = jump
        new = low[flat[1:].reshape(h, w)]
        if (new == lab).all():
            return lab
        lab = new


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about AT_ONCE rows from batches sorted by their first ``key`` columns, and the number of each row's group: no group is cut."""
    held, n = [], 0

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for c in table.columns[:key]:
            at = pa.chunked_array(c.chunks, c.type).combine_chunks().dictionary_encode(null_encoding="encode")
            at = (at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at).indices.to_numpy(zero_copy_only=False)
            new[1:] |= at[1:] != at[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        code = numbers(table)
        done = int(np.searchsorted(code, code[-1]))
        if done:
            yield table.slice(0, done), code[:done]
        held, n = table.slice(done).to_batches(), n - done
    if n:
        table = pa.Table.from_batches(held)
        yield table, numbers(table)


def raster_keys(code: np.ndarray, rows: np.ndarray, cols: np.ndarray, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each place, in the order of code, row and col, and the step to the next row; ``margin`` free places lie around each image.

    Rows are in the order of code.
    """
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    rows, cols = rows.astype(np.int64), cols.astype(np.int64)
    r0, c0 = np.minimum.reduceat(rows, starts), np.minimum.reduceat(cols, starts)
    height = np.maximum.reduceat(rows, starts) - r0 + 1 + 2 * margin
    width = np.maximum.reduceat(cols, starts) - c0 + 1 + 2 * margin
    base = np.concatenate(([0], np.cumsum(height * width)[:-1]))
    at = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(code)]))))
    return base[at] + (rows - r0[at] + margin) * width[at] + cols - c0[at] + margin, width[at]


def tied_numbers(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 .. n - 1 is tied to by the pairs a, b. Larger roots are hung below smaller ones, so rounds are few."""
    top = np.arange(n)
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return top
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = top[top]
            if (jump == top).all():
                break
            top = jump


def linked_rows(code: np.ndarray, rows: np.ndarray, cols: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """For rows sorted by code, row and col: the first row of each one's region, where places a step apart are neighbours."""
    margin = max(max(abs(a), abs(b)) for a, b in steps)
    key, width = raster_keys(code, rows, cols, margin)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    place = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    key, width = key[first], width[first]
    a, b, of = [], [], None
    if (places := int(key[-1] + margin * (width[-1] + 1)) + 1) <= DENSE * len(key):
        of = np.full(places, -1, np.int32)
        of[key] = np.arange(len(key))
    for dr, dc in steps:
        if (dr, dc) <= (0, 0):
            continue  # the step back of another one
        want = key + dr * width + dc
        if of is None:
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero(key[at] == want)
        else:
            at = of[want]
            hit = np.flatnonzero(at >= 0)
        a.append(hit)
        b.append(at[hit])
    return first[tied_numbers(len(key), np.concatenate(a), np.concatenate(b))[place]]


def _numbered_whole(pixels: DataFrame, numbered: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """pixels with the region's number (from 1, in raster order) by each name's steps, of images that a task may have whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, code in whole_groups(batches):
            rows, cols = (table.column(c).to_numpy() for c in ("row", "col"))
            for name, steps in numbered.items():
                lead = linked_rows(code, rows, cols, steps)
                upto = np.cumsum(lead == np.arange(len(lead)))
                ahead = (upto - 1)[np.searchsorted(code, code)]  # regions of the images before
                table = table.append_column(name, pa.array(upto[lead] - ahead, pa.int64()))
            yield from table.to_batches()

    taken = [c for c in pixels.columns if c not in ("image_id", "row", "col")]
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pixels.select("image_id", "row", "col", *taken).repartition(n, "image_id").sortWithinPartitions("image_id", "row", "col")
    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, *(T.StructField(name, T.LongType()) for name in numbered)]))


def _by_size(pixels: DataFrame, whole: int, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``small`` makes of images of at most ``whole`` pixels, and ``large`` of the others."""
    big = selection.large_groups(pixels, ["image_id"], whole)
    if big.isEmpty():
        return small(pixels)
    few, many = (selection.in_groups(pixels, big, ["image_id"], inside) for inside in (False, True))
    return small(few).unionByName(large(many))


def connected_regions(pixels: DataFrame, eight: bool = True, tile: int = TILE, whole: int = WHOLE) -> DataFrame:
    """pixels (image_id, row, col: those of the mask) with region_id from 1 in raster order of each region's first pixel.

    Images of more than ``whole`` pixels are labelled by tiles. Any number of tiles gives the same labels as the whole image at
    once. Repeated pixels get the same label.
    """
    taken = [c for c in pixels.columns if c not in ("image_id", "row", "col")]
    base = pixels.where("image_id is not null").select("image_id", F.col("row").cast("int"), F.col("col").cast("int"), *taken).transform(saved)
    around = AROUND_8 if eight else AROUND_4
    return _by_size(base, whole, lambda few: _numbered_whole(few, {"region_id": around}), lambda many: _by_tiles(many, eight, tile))


def _by_tiles(base: DataFrame, eight: bool, tile: int) -> DataFrame:
    """connected_regions() of large images."""
    taken = [c for c in base.columns if c not in ("image_id", "row", "col")]
    t = base.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows, cols = part["row"].to_numpy(), part["col"].to_numpy()
        r, c = rows - rows.min(), cols - cols.min()
        mask = np.zeros((r.max() + 1, c.max() + 1), bool)
        mask[r, c] = True
        lab = label_mask(mask, eight)[r, c]
        order = np.lexsort((cols, rows))
        found, first = np.unique(lab[order], return_index=True)
        at = order[first][np.searchsorted(found, lab)]
        out = part.drop(columns=["_tr", "_tc"])
        out["lead_row"], out["lead_col"] = rows[at], cols[at]
        return out

    schema = T.StructType([*base.schema.fields, T.StructField("lead_row", T.IntegerType()), T.StructField("lead_col", T.IntegerType())])
    local = t.groupBy("image_id", "_tr", "_tc").applyInPandas(run, schema).transform(cut)
    node = F.struct("image_id", "lead_row", "lead_col")
    edge = local.where(F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1))  # places may be negative
    edge = edge.select("image_id", "row", "col", node.alias("node")).distinct()
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (AROUND_8 if eight else AROUND_4)))
    beside = edge.select("node", "image_id", "row", "col", F.explode(near).alias("s")).select(F.col("node").alias("a"), "image_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    edges = beside.join(edge.withColumnRenamed("node", "b"), ["image_id", "row", "col"]).where("a <> b").select("a", "b").distinct()
    leads = min_labels(local.select(node.alias("node")).distinct(), edges)
    order = Window.partitionBy("label.image_id").orderBy("label.lead_row", "label.lead_col")  # a row per region of an image
    named = leads.select("node", F.dense_rank().over(order).cast("long").alias("region_id"))
    named = named.select("node.*", "region_id")
    return local.join(named, ["image_id", "lead_row", "lead_col"]).select("image_id", "row", "col", *taken, "region_id")


def without_small(regions: DataFrame, least: int = 9) -> DataFrame:
    """Regions of at least ``least`` pixels."""
    size = regions.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return regions.join(size.select("image_id", "region_id"), ["image_id", "region_id"], "left_semi")


def detections(pixels: DataFrame, low: float = 500.0, high: float = 1250.0, least: int = 9) -> DataFrame:
    """Pixels of detected regions, with region_id: cmf at least ``low``, 4-connected regions of at least ``least`` pixels, and
    of the smaller ones those 8-connected groups with a pixel of at least ``high``; labelled anew with 8 neighbours."""
    over = pixels.where(F.col("cmf") >= low)
    four = connected_regions(over, eight=False).transform(saved)
    large = without_small(four, least).drop("region_id")
    small = connected_regions(four.join(large.select("image_id", "row", "col"), ["image_id", "row", "col"], "left_anti").drop("region_id"))
    strong = small.groupBy("image_id", "region_id").agg(F.max("cmf").alias("_m")).where(F.col("_m") >= high)
    back = small.join(strong.select("image_id", "region_id"), ["image_id", "region_id"], "left_semi").drop("region_id")
    return connected_regions(large.unionByName(back))


def region_statistics(regions: DataFrame, value: str = "cmf", pixel_size: float = 3.1, held: int = selection.HELD_ROWS) -> DataFrame:
    """Per region: pixels, box (max exclusive), max, min, median and median absolute deviation, the place of the maximum (whole
    part of the mean of its pixels) and the mass enhancement. Regions of more than ``held`` pixels have their medians by
    refined histograms, over all tasks."""
    keys, v = ["image_id", "region_id"], F.col(value)
    plain = (
        F.count(F.lit(1)).alias("n"), F.min("row").alias("rmin"), (F.max("row") + 1).alias("rmax"), F.min("col").alias("cmin"), (F.max("col") + 1).alias("cmax"),
        F.max(v).alias("vmax"), F.min(v).alias("vmin"), F.sum(v).alias("total"),
    )
    place = lambda c: F.floor(F.avg(F.when(F.col("_v") == F.col("vmax"), F.col(c)))).cast("int").alias(f"max_{c}")
    columns = [*keys, "n", "rmin", "rmax", "cmin", "cmax", "vmax", "vmin", "med", "total", "mad", "max_row", "max_col"]

    def sorted_(few: DataFrame) -> DataFrame:
        g = few.groupBy(*keys).agg(*plain, F.median(v).alias("med"))
        both = few.select(*keys, "row", "col", v.alias("_v")).join(g.select(*keys, "vmax", "med"), keys)
        more = both.groupBy(*keys).agg(F.median(F.abs(F.col("_v") - F.col("med"))).alias("mad"), place("row"), place("col"))
        return g.join(more, keys).select(*columns)

    regions = regions.select(*keys, "row", "col", value).transform(saved)  # read several times
    large = selection.large_groups(regions, keys, held)
    if large.isEmpty():
        out = sorted_(regions)
    else:
        few, many = (selection.in_groups(regions, large, keys, inside) for inside in (False, True))
        g = many.groupBy(*keys).agg(*plain).transform(cut)
        places = many.select(*keys, "row", "col", v.alias("_v")).join(F.broadcast(g.select(*keys, "vmax")), keys).groupBy(*keys).agg(place("row"), place("col"))
        med = selection.medians_of_large(many.where(v.isNotNull() & ~F.isnan(v.cast("double"))), keys, value, large)
        out = sorted_(few).unionByName(g.join(med.drop("n"), keys).join(places, keys).select(*columns))
    return out.withColumn("ime", physics.ime_kg(F.col("total"), F.lit(pixel_size)))


def score_regions(pixels: DataFrame, threshold: float = 0.5, cmf_threshold: float = 250.0, images: DataFrame | None = None) -> DataFrame:
    """Detections of a score map (image_id, row, col, score, cmf): region statistics of the score, and of cmf above its threshold.

    images (image_id, map: a struct with ulx, uly, xps, yps, rotation, zone and hemi) adds lat and lon of the score's maximum,
    and cmf_lat and cmf_lon of that of cmf; images without a map have null there.
    """
    found = connected_regions(pixels.where(F.col("score") > threshold)).transform(cut)
    cmf = region_statistics(found.where(F.col("cmf") > cmf_threshold), "cmf").select("image_id", "region_id", *(F.col(c).alias(f"cmf_{c}") for c in ("vmax", "vmin", "med", "mad", "max_row", "max_col")))
    out = region_statistics(found, "score").join(cmf, ["image_id", "region_id"], "left")
    if images is not None:
        out = out.join(images.select("image_id", F.col("map").alias("_map")), "image_id", "left")
        for tag in ("", "cmf_"):
            at = geo.pixel_to_latlon(F.col(f"{tag}max_col"), F.col(f"{tag}max_row"), F.col("_map"))
            out = out.withColumns({f"{tag}lat": at["lat"], f"{tag}lon": at["lon"]})
        out = out.drop("_map")
    return out.withColumn("detection_id", F.concat_ws("-", "image_id", "region_id"))


def weak_labels(regions: DataFrame, candidates: DataFrame) -> DataFrame:
    """All pixels of the regions that a candidate's pixel (image_id, row, col, label) lies in."""
    hit = regions.join(candidates, ["image_id", "row", "col"]).select("image_id", "region_id", "label").distinct()
    return regions.join(hit, ["image_id", "region_id"])


def dilate(pixels: DataFrame, offsets: list[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """Pixels within reach by any of the offsets, once each. Pixels go to the tiles that they reach, and are spread there."""
    reach = max(max(abs(a), abs(b)) for a, b in offsets)
    ends = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile).cast("int"), F.floor((F.col(c) + reach) / tile).cast("int"))
    at = pixels.select("image_id", "row", "col").select("*", F.explode(ends("row")).alias("tr")).select("image_id", "tr", F.explode(ends("col")).alias("tc"), "row", "col")
    dr, dc = (np.array(x) for x in zip(*offsets, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, code in whole_groups(batches, 3):
            tr, tc, row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("tr", "tc", "row", "col"))
            key, width = raster_keys(code, row, col, reach)
            first = np.unique((key + dr[:, None] * width + dc[:, None]).ravel(), return_index=True)[1]
            step, of = np.divmod(first, len(key))
            r, c = row[of] + dr[step], col[of] + dc[step]
            own = (r // tile == tr[of]) & (c // tile == tc[of])
            images = table.column("image_id").take(pa.array(of[own]))
            yield from pa.table([images, pa.array(r[own]).cast(table.schema.field("row").type), pa.array(c[own]).cast(table.schema.field("col").type)], ["image_id", "row", "col"]).to_batches()

    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = at.where("row is not null and col is not null").repartition(n, "image_id", "tr", "tc").sortWithinPartitions("image_id", "tr", "tc")
    return dealt.mapInArrow(run, T.StructType([dealt.schema[c] for c in ("image_id", "row", "col")]))


def diamond(n: int) -> list[tuple[int, int]]:
    """n dilations by a cross."""
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if abs(a) + abs(b) <= n]


def disc(n: float) -> list[tuple[int, int]]:
    m = int(n)
    return [(a, b) for a in range(-m, m + 1) for b in range(-m, m + 1) if a * a + b * b <= n * n]


def square(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1)]


def erode(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Pixels all of whose offsets are pixels too."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets))
    need = pixels.select("image_id", F.col("row").alias("r"), F.col("col").alias("c"), F.explode(steps).alias("s")).withColumns({"row": F.col("r") + F.col("s.a"), "col": F.col("c") + F.col("s.b")})
    there = need.join(pixels.select("image_id", "row", "col").distinct(), ["image_id", "row", "col"]).groupBy("image_id", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    return there.where(F.col("n") == len(offsets)).select("image_id", F.col("r").alias("row"), F.col("c").alias("col"))


def opened(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(pixels, offsets), offsets)


def _merged(pixels: DataFrame, distance: int, whole: int) -> DataFrame:
    """pixels with merged_id: surroundings that touch are pixels at most 2 * distance + 1 apart, and come in the same order."""

    def by_dilation(many: DataFrame) -> DataFrame:
        wide = connected_regions(dilate(many, square(distance)), whole=whole).withColumnRenamed("region_id", "merged_id")
        return many.join(wide, ["image_id", "row", "col"])

    steps = [s for s in square(2 * distance + 1) if s != (0, 0)]
    base = pixels.where("image_id is not null").transform(saved)
    return _by_size(base, whole, lambda few: _numbered_whole(few, {"merged_id": steps}), by_dilation)


def merged_regions(pixels: DataFrame, distance: int, tile: int = TILE, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """merge_regions() of the connected_regions() of pixels; images of at most ``whole`` pixels are labelled and merged in one pass."""
    steps = [s for s in square(2 * distance + 1) if s != (0, 0)]
    base = pixels.where("image_id is not null").withColumns({c: F.col(c).cast("int") for c in ("row", "col")}).transform(saved)
    out = _by_size(base, whole, lambda few: _numbered_whole(few, {"region_id": AROUND_8, "merged_id": steps}), lambda many: _merged(_by_tiles(many, True, tile), distance, whole))
    return out, _originals(out)


def _originals(merged: DataFrame) -> DataFrame:
    return merged.groupBy("image_id", "merged_id").agg(F.array_sort(F.collect_set("region_id")).alias("originals"))


def merge_regions(regions: DataFrame, distance: int, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Regions whose surroundings, to a chessboard distance, touch become one: pixels with merged_id, and (image_id, merged_id, originals)."""
    out = _merged(regions, distance, whole)
    return out, _originals(out)


def distance_to(pixels: DataFrame, targets: DataFrame, reach: int) -> DataFrame:
    """pixels with the Euclidean distance to the nearest target within ``reach`` pixels, or null."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc(reach)))
    near = targets.select("image_id", "row", "col", F.explode(steps).alias("s")).groupBy("image_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    return pixels.join(near.agg(F.sqrt(F.min(F.col("s.a") * F.col("s.a") + F.col("s.b") * F.col("s.b"))).alias("distance")), ["image_id", "row", "col"], "left")


def borders(regions: DataFrame, shape: DataFrame | None = None, mode: str = "inner", eight: bool = True) -> DataFrame:
    """Pixels at which labels change, with region_id; no region is a label of its own, and the image's edge is no change.

    inner: pixels of a region with a neighbour of another or no region. outer: pixels of no region beside one, once for each.
    thick: both, so two pixels wide; those of no region have a null region_id. ``shape`` has image_id, nrow and ncol, and
    keeps neighbours inside of the image. Neighbours are the eight around, or four.
    """
    if mode not in ("inner", "outer", "thick"):
        raise ValueError(f"no border {mode!r}")
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (AROUND_8 if eight else AROUND_4)))
    near = regions.select("image_id", "region_id", F.col("row").alias("r"), F.col("col").alias("c"), F.explode(around).alias("s"))
    near = near.withColumns({"row": F.col("r") + F.col("s.a"), "col": F.col("c") + F.col("s.b")})
    if shape is not None:
        near = near.join(shape.select("image_id", "nrow", "ncol"), "image_id").where("row between 0 and nrow - 1 and col between 0 and ncol - 1")
    seen = near.join(regions.select("image_id", "row", "col", F.col("region_id").alias("other")), ["image_id", "row", "col"], "left")
    inner = seen.where("other is null or other <> region_id").select("image_id", F.col("r").alias("row"), F.col("c").alias("col"), "region_id")
    if mode == "inner":
        return inner.distinct()
    outer = seen.where("other is null").select("image_id", "row", "col", "region_id")
    if mode == "outer":
        return outer.distinct()
    return inner.unionByName(outer.withColumn("region_id", F.lit(None).cast(regions.schema["region_id"].dataType))).distinct()


def _touching(regions: DataFrame) -> DataFrame:
    """(image_id) of images with pixels of two regions side by side, in eight directions, or of two regions at once."""
    ahead = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(0, 0), *AROUND_8[4:]]))
    near = regions.select("image_id", "region_id", "row", "col", F.explode(ahead).alias("s"))
    near = near.select("image_id", F.col("region_id").alias("other"), (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    return near.join(regions.select("image_id", "row", "col", "region_id"), ["image_id", "row", "col"]).where("other <> region_id").select("image_id").distinct()


def containment(regions: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """What surrounds what in images whose regions are 8-connected and don't touch: a tree of regions and background parts.

    Gives (image_id, row, col, part), the background within the regions' box and a frame around it, in 4-connected parts, and
    (image_id, within, part, region_id): each background part or region (the other is null) with each region around it. The
    background is labelled once; the tree is gone down from the frame, a level of nesting a round.
    """
    box = regions.groupBy("image_id").agg(*(f(c).alias(n) for f, c, n in ((F.min, "row", "r0"), (F.max, "row", "r1"), (F.min, "col", "c0"), (F.max, "col", "c1"))))
    lines = box.select("image_id", "r0", "c0", "c1", F.explode(F.sequence(F.col("r0") - 1, F.col("r1") + 1)).alias("row"))
    cells = lines.select("image_id", "r0", "row", F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("col"))
    free = cells.join(regions.select("image_id", "row", "col"), ["image_id", "row", "col"], "left_anti")
    back = connected_regions(free, eight=False, tile=tile).withColumnRenamed("region_id", "part").transform(cut)
    frame = back.where("row = r0 - 1").select("image_id", "part").distinct()
    back = back.select("image_id", "row", "col", "part")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND_4))
    beside = regions.select("image_id", "region_id", F.col("row").alias("r"), F.col("col").alias("c"), F.explode(steps).alias("s"))
    beside = beside.select("image_id", "region_id", (F.col("r") + F.col("s.a")).alias("row"), (F.col("c") + F.col("s.b")).alias("col"))
    tied = beside.join(back, ["image_id", "row", "col"]).select("image_id", "region_id", "part").distinct().transform(cut)
    long = lambda c: F.lit(None).cast("long").alias(c)
    # Parts of the last level with the regions around them; none around the frame's.
    level, found = frame.withColumn("around", F.array().cast("array<long>")).transform(cut), None
    left = tied
    while True:
        here = left.join(level, ["image_id", "part"]).select("image_id", "region_id", "around").distinct()
        left_now = left.join(level.select("image_id", "part"), ["image_id", "part"], "left_anti")
        below = left_now.join(here, ["image_id", "region_id"])
        next_level = below.select("image_id", "part", F.concat("around", F.array(F.col("region_id").cast("long"))).alias("around")).distinct().transform(cut)
        new = here.select("image_id", F.explode("around").alias("within"), long("part"), F.col("region_id").cast("long").alias("region_id"))
        new = new.unionByName(next_level.select("image_id", F.explode("around").alias("within"), F.col("part").cast("long").alias("part"), long("region_id")))
        found = new if found is None else found.unionByName(new)
        if next_level.isEmpty():
            return back, found.transform(cut)
        left = left_now.join(here.select("image_id", "region_id"), ["image_id", "region_id"], "left_anti").transform(cut)
        level = next_level


def _holes_by_boxes(regions: DataFrame, tile: int) -> DataFrame:
    """Holes of any labels: for each region by itself, what is free in its box and no 4-path leads out of."""
    boxes = regions.groupBy("image_id", "region_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    cells = boxes.select("*", F.explode(F.sequence("r0", "r1")).alias("row")).select("*", F.explode(F.sequence("c0", "c1")).alias("col"))
    free = cells.join(regions.select("image_id", "region_id", "row", "col"), ["image_id", "region_id", "row", "col"], "left_anti")
    free = free.withColumn("_key", F.concat_ws("|", "image_id", "region_id"))
    part = connected_regions(free.select(F.col("_key").alias("image_id"), "row", "col"), eight=False, tile=tile).withColumnRenamed("region_id", "part").withColumnRenamed("image_id", "_key")
    tagged = free.join(part, ["_key", "row", "col"])
    open_ = tagged.where("row in (r0, r1) or col in (c0, c1)").select("_key", "part").distinct()
    return tagged.join(open_, ["_key", "part"], "left_anti").select("image_id", "row", "col", "region_id")


def holes_of(code: np.ndarray, rows: np.ndarray, cols: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, col, label) of the holes in images whose labels are a tree, and the images whose aren't; code counts images from 0."""
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    r0, c0 = np.minimum.reduceat(rows, starts) - 1, np.minimum.reduceat(cols, starts) - 1
    height, width = np.maximum.reduceat(rows, starts) - r0 + 2, np.maximum.reduceat(cols, starts) - c0 + 2
    base = np.concatenate(([0], np.cumsum(height * width)))
    place = base[code] + (rows - r0[code]) * width[code] + cols - c0[code]
    region = np.unique(np.stack([code, labels], 1), axis=0, return_inverse=True)[1].ravel()
    label, image = (np.zeros(region.max() + 1, x.dtype) for x in (labels, code))
    label[region], image[region] = labels, code
    of = np.full(base[-1], -1)
    of[place] = region
    bad = [code[of[place] != region]]  # two labels at a place
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = of[place + dr * width[code] + dc]
        bad.append(code[(other >= 0) & (other != region)])
    cell = np.repeat(np.arange(len(starts)), height * width)
    p = np.flatnonzero(of < 0)
    right, below = p[(p + 1 < base[cell[p] + 1])], p[p + width[cell[p]] < base[cell[p] + 1]]
    right, below = right[of[right + 1] < 0], below[of[below + width[cell[below]]] < 0]
    top = tied_numbers(int(base[-1]), np.concatenate((right, below)), np.concatenate((right + 1, below + width[cell[below]])))
    near = np.concatenate([place + d for d in (1, -1, width[code], -width[code])])
    own = np.tile(region, 4)[of[near] < 0]
    pairs = np.unique(np.stack([own, top[near[of[near] < 0]]], 1), axis=0)
    # A tree has a link less than nodes.
    parts = np.unique(top[p])
    surplus = np.bincount(image[pairs[:, 0]], minlength=len(starts)) + 1 - np.bincount(image, minlength=len(starts)) - np.bincount(cell[parts], minlength=len(starts))
    bad = np.unique(np.concatenate((*bad, np.flatnonzero(surplus))))
    left = pairs[~np.isin(image[pairs[:, 0]], bad)]
    above, around, level = np.full(len(label), -1), np.full(base[-1], -1), np.unique(top[base[:-1]])
    while len(left) and len(level):  # a level of nesting a round; around is of parts, above of regions
        here = np.isin(left[:, 1], level)
        found, left = left[here], left[~here]
        above[found[:, 0]] = around[found[:, 1]]
        inner = np.isin(left[:, 0], found[:, 0])
        around[left[inner, 1]] = left[inner, 0]
        level, left = np.unique(left[inner, 1]), left[~inner]
    at, within = np.concatenate((p, place)), np.concatenate((around[top[p]], above[region]))
    out = []
    while (inside := within >= 0).any():
        at, within = at[inside], within[inside]
        out.append((at, within))
        within = above[within]
    at, within = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    n = cell[at]
    r, c = np.divmod(at - base[n], width[n])
    return n, r + r0[n], c + c0[n], label[within], bad


def _filled_whole(own: DataFrame) -> DataFrame:
    """own(image_id, row, col, region_id) with ``kind``: 0 its pixels, 1 those of holes, 2 a row for each image that isn't a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, code in whole_groups(batches):
            yield from table.append_column("kind", pa.array(np.zeros(len(table), np.int32))).to_batches()
            rows, cols, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "region_id"))
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            size = (np.maximum.reduceat(rows, starts) - np.minimum.reduceat(rows, starts) + 3) * (np.maximum.reduceat(cols, starts) - np.minimum.reduceat(cols, starts) + 3)
            first = np.flatnonzero(np.diff(np.cumsum(size) // CELLS, prepend=-1))  # images whose boxes are worked on at once
            for x, y in zip(starts[first], [*starts[first[1:]], len(code)], strict=True):
                image, r, c, label, bad = holes_of(code[x:y] - code[x], rows[x:y], cols[x:y], labels[x:y])
                image, kind = np.concatenate((image, bad)) + code[x], np.repeat(np.array([1, 2], np.int32), [len(image), len(bad)])
                none = np.zeros(len(bad), np.int64)
                names = table.column("image_id").take(pa.array(starts[image]))
                arrays = [pa.array(np.concatenate((v, none))).cast(table.schema.field(n).type) for n, v in (("row", r), ("col", c), ("region_id", label))]
                yield from pa.table([names, *arrays, pa.array(kind)], ["image_id", "row", "col", "region_id", "kind"]).to_batches()

    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.select("image_id", "row", "col", "region_id").repartition(n, "image_id").sortWithinPartitions("image_id", "row", "col")
    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("kind", T.IntegerType())]))


def fill_holes(regions: DataFrame, tile: int = TILE, whole: int = WHOLE) -> DataFrame:
    """regions and the pixels of their holes: what no 4-path that avoids the region leads out of, other regions included.

    Images whose boxes have at most ``whole`` places are filled many at a time by a task. In larger ones, regions that don't
    touch, as connected_regions() gives them with eight neighbours, are filled by containment(): work goes with the
    pixels of the image's box. Images in which regions touch, where there is no such tree, are filled region by region.
    """
    own = regions.select("image_id", "row", "col", "region_id").distinct().transform(cut)
    box = own.groupBy("image_id").agg(((F.max("row") - F.min("row") + 3).cast("long") * (F.max("col") - F.min("col") + 3)).alias("n"))
    large = box.where(F.col("n") > whole).select("image_id").transform(cut)
    some_large = not large.isEmpty()
    done = _filled_whole(own.join(large, "image_id", "left_anti") if some_large else own).transform(cut)
    odd = done.where("kind = 2").select("image_id").distinct().transform(cut)
    some_odd = not odd.isEmpty()
    out = done.where("kind < 2").drop("kind")
    if some_odd:
        out = out.join(odd, "image_id", "left_anti").unionByName(own.join(odd, "image_id", "left_semi").transform(lambda r: r.unionByName(_holes_by_boxes(r, tile))))
    return out.unionByName(_filled_large(own.join(large, "image_id", "left_semi"), tile)) if some_large else out


def _filled_large(own: DataFrame, tile: int) -> DataFrame:
    """fill_holes() of large images."""
    touching = _touching(own).transform(cut)
    apart = own.join(touching, "image_id", "left_anti")
    back, within = containment(apart, tile)
    kind = own.schema["region_id"].dataType
    parts = back.join(within.where("part is not null").select("image_id", "part", "within"), ["image_id", "part"])
    nested = apart.join(within.where("region_id is not null").select("image_id", "region_id", "within"), ["image_id", "region_id"])
    holes = parts.unionByName(nested, allowMissingColumns=True).select("image_id", "row", "col", F.col("within").cast(kind).alias("region_id"))
    out = own.unionByName(holes)
    if touching.isEmpty():
        return out
    return out.unionByName(_holes_by_boxes(own.join(touching, "image_id", "left_semi"), tile))


def extents(pixels: DataFrame, by: str = "row") -> DataFrame:
    """Least, greatest and middle column of each row of a mask (or the rows of each column)."""
    other = "col" if by == "row" else "row"
    return pixels.groupBy("image_id", by).agg(F.min(other).alias("low"), F.max(other).alias("high")).withColumn("mid", (F.col("low") + F.col("high")) / 2)


def distance_discs(locations: DataFrame, distances: list[float]) -> DataFrame:
    """(image_id, row, col, distance) of discs around locations: where several reach, the larger distance stands."""
    out = None
    for d in sorted(distances):
        one = dilate(locations, disc(d)).withColumn("distance", F.lit(float(d)))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("image_id", "row", "col").agg(F.max("distance").alias("distance"))


def candidate_ime(pixels: DataFrame, candidates: DataFrame, low: float, high: float, fetch: int, merge: int, least: int = 9, pixel_size: float = 3.1) -> DataFrame:
    """(candidate_id, ime, ime_per_fetch, n): enhancement between two thresholds within ``fetch`` pixels of a candidate, in groups
    (merged within a distance, of at least ``least`` pixels), over the candidate's fetch. This definition is ours.

    Candidates are the small side: each is listed by the cells around it, never by all its pixels.
    """
    size = max(1, fetch)
    good = pixels.where(F.col("cmf").between(low, high)).withColumns({"_y": F.floor(F.col("row") / size), "_x": F.floor(F.col("col") / size)})
    step = F.sequence(F.lit(-1), F.lit(1))
    at = candidates.select("candidate_id", "image_id", F.col("row").alias("r"), F.col("col").alias("c"), F.explode(F.transform(step, lambda i: F.floor(F.col("row") / size) + i)).alias("_y"))
    at = at.select("*", F.explode(F.transform(step, lambda i: F.floor(F.col("c") / size) + i)).alias("_x"))
    near = good.join(at, ["image_id", "_y", "_x"]).where(F.pow(F.col("row") - F.col("r"), 2) + F.pow(F.col("col") - F.col("c"), 2) <= fetch * fetch)
    own = near.select(F.col("candidate_id").cast("string").alias("image_id"), "row", "col", "cmf")
    group = _merged(own, merge, WHOLE).groupBy("image_id", "merged_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("cmf").alias("cmf")).where(F.col("_n") >= least)
    total = group.groupBy(F.col("image_id").alias("candidate_id")).agg(F.sum("_n").alias("n"), physics.ime_kg(F.sum("cmf"), F.lit(pixel_size)).alias("ime"))
    return total.withColumn("ime_per_fetch", F.col("ime") / (fetch * pixel_size))


def out_of_bounds(pixels: DataFrame, shape: DataFrame, no_data: Column) -> DataFrame:
    """Pixels without data that a path of such pixels ties to the image's edge."""
    empty = connected_regions(pixels.where(no_data).select("image_id", "row", "col"), eight=False)
    edge = empty.join(shape, "image_id").where("row = 0 or col = 0 or row = nrow - 1 or col = ncol - 1").select("image_id", "region_id").distinct()
    return empty.join(edge, ["image_id", "region_id"], "left_semi").select("image_id", "row", "col")
