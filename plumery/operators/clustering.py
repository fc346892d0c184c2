"""Sources from plumes: order-dependent nearest-centroid clustering, source counts, overflights and persistence.

The clustering rule is sequential: each point joins or opens a source by what the points before it have left. It still runs in
parallel, by deterministic reservations. A point reads and moves only centroids within a radius of it, so two points more than
two radii apart can change places. Hence a point may be settled as soon as no earlier point within two radii is unsettled, and
all such points may be settled at once; the result is that of one pass in order.

A round deals unsettled points to square tiles, with the points of a margin of two radii as reservations, and each task settles a
tile's points in order, passing over those that an earlier unsettled one reserves. Tiles are shifted from round to round, so
what straddles a border in one round lies inside of a tile in the next. Rows stream through a task in order; it holds the
tile's centroids and reserved cells, never its points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumery.functions import geo
from plumery.operators import cover
from plumery.operators.graph import cut, dense_numbers

#: As few unsettled points as this are one tile, so that a task settles them all; a tile of a larger table has about as many.
TILE_POINTS = 100_000
#: Margins are wider than they need be by this share, as coordinates and distances are rounded.
SLACK = 1 + 1e-6


class Sources:
    """Centroids so far, by cells as wide as the radius, and the rule for the next point."""

    def __init__(self, radius: float) -> None:
        self.radius, self.cells, self.changed = radius, {}, set()

    def cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.radius), math.floor(y / self.radius)

    def put(self, key: int, x: float, y: float, members: int) -> None:
        self.cells.setdefault(self.cell(x, y), {})[key] = (x, y, members)

    def add(self, row: int, x: float, y: float) -> int:
        """The source of a point: the nearest within the radius, which moves to the mean of its members (of equally near
        ones that with the smallest key), else a new one, named by the row."""
        i, j = self.cell(x, y)
        best = (math.inf, row)
        for a in (i - 1, i, i + 1):
            for b in (j - 1, j, j + 1):
                for key, (cx, cy, _) in self.cells.get((a, b), {}).items():
                    best = min(best, ((x - cx) ** 2 + (y - cy) ** 2, key))
        if best[0] > self.radius * self.radius:
            self.put(row, x, y, 1)
            self.changed.add(row)
            return row
        key = best[1]
        old = next(c for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) if key in (c := self.cells.get((a, b), {})))
        cx, cy, n = old.pop(key)
        self.put(key, cx + (x - cx) / (n + 1), cy + (y - cy) / (n + 1), n + 1)
        self.changed.add(key)
        return key

    def rows(self) -> list[tuple[int, float, float, int]]:
        return [(key, *c) for held in self.cells.values() for key, c in held.items()]


def assign(points: pd.DataFrame, radius: float, clusters: list[list[float]] | None = None) -> list[int]:
    """The sequential rule in one pass: numbers from 0 by first appearance. points has x and y in order; clusters, lists of x, y
    and count, go before and are updated."""
    clusters, held = [] if clusters is None else clusters, Sources(radius)
    for n, (x, y, members) in enumerate(clusters):
        held.put(n, x, y, members)
    number, out = {n: n for n in range(len(clusters))}, []
    for row, (x, y) in enumerate(zip(points["x"].tolist(), points["y"].tolist(), strict=True), len(clusters)):
        out.append(number.setdefault(held.add(row, x, y), len(number)))
    clusters[:] = [[x, y, n] for _, x, y, n in sorted(held.rows())]
    return out


_OUT = "kind string, zone int, row_id long, x double, y double, members long, first_row long, changed boolean"
_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())


def _settle(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """Rows (zone, tx, ty, kind, row_id, x, y, members), sorted by tile, then centroids (kind 0), then points in order.

    Gives ``settled`` points with their source, points ``left`` for later rounds, and each tile's ``centroid`` rows: all of
    them if it has points left, else what has changed. Points of kind 2 are others' and only reserve.
    """
    tile, out = None, []
    sources, reserved, waiting = Sources(radius), set(), False
    side = 2 * radius * SLACK

    def close() -> None:
        for key, x, y, n in sources.rows():
            if waiting or key in sources.changed:
                out.append(("centroid", tile[0], key, x, y, n, None, key in sources.changed))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(_KINDS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    for batch in batches:
        for zone, tx, ty, kind, row, x, y, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (zone, tx, ty) != tile:
                if tile is not None:
                    close()
                tile = (zone, tx, ty)
                sources, reserved, waiting = Sources(radius), set(), False
            if kind == 0:
                sources.put(row, x, y, members)
                continue
            i, j = math.floor(x / side), math.floor(y / side)
            if kind == 2:
                reserved.add((i, j))
            elif reserved and any((a, b) in reserved for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1)):
                reserved.add((i, j))
                waiting = True
                out.append(("left", zone, row, x, y, None, None, None))
            else:
                out.append(("settled", zone, row, x, y, None, sources.add(row, x, y), None))
        if len(out) >= 10_000:
            yield flush()
    if tile is not None:
        close()
    yield flush()


def _tiles(rows: DataFrame, side: float, shift: tuple[float, float], margin: float) -> DataFrame:
    """rows for each tile (tx, ty) that they lie in or within the margin of; ``own`` is true in theirs."""
    at = lambda c, s, d=0.0: F.floor((F.col(c) + d) / side - s)
    span = lambda c, s: F.sequence(at(c, s, -margin), at(c, s, margin))
    every = rows.select("*", F.explode(span("x", shift[0])).alias("tx")).select("*", F.explode(span("y", shift[1])).alias("ty"))
    return every.withColumn("own", (F.col("tx") == at("x", shift[0])) & (F.col("ty") == at("y", shift[1])))


def first_rows_of_sources(points: DataFrame, radius: float, tile_points: int = TILE_POINTS) -> DataFrame:
    """(row_id, first_row) of points(zone, row_id, x, y): the first row of each one's source, as in one pass in order of row_id.

    Zones are apart. Each round settles at least the first point left; few points left are one tile, settled whole. Tables of a
    round are checkpointed. A place where very many points meet within two radii is sequential by the rule itself: one task
    streams through its points.
    """
    spark = points.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none: Column = F.lit(None)
    left = points.select(F.lit("left").alias("kind"), F.col("zone").cast("int").alias("zone"), F.col("row_id").cast("long").alias("row_id"), "x", "y").transform(cut)
    centroids = left.limit(0).select("zone", "row_id", "x", "y", F.lit(0).cast("long").alias("members"))
    done, turn = None, 0
    while n := left.count():
        least = 16 * radius
        if n <= tile_points:
            own = left.select("zone", F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), F.lit(1).alias("kind"), "row_id", "x", "y", none.cast("long").alias("members"))
            known = centroids.select("zone", F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), F.lit(0).alias("kind"), "row_id", "x", "y", "members")
        else:
            # Occupied cells say how wide a tile may be to have about tile_points; a denser place just has more.
            cells = left.select("zone", F.floor(F.col("x") / least), F.floor(F.col("y") / least)).distinct().count()
            side = least * max(1.0, math.sqrt(tile_points * cells / n))
            shift = (turn % 2 / 2, turn // 2 % 2 / 2)
            placed = _tiles(left.drop("kind"), side, shift, 2 * radius * SLACK)
            own = placed.select("zone", "tx", "ty", F.when(F.col("own"), 1).otherwise(2).alias("kind"), "row_id", "x", "y", none.cast("long").alias("members"))
            known = _tiles(centroids, side, shift, radius * SLACK).select("zone", "tx", "ty", F.lit(0).alias("kind"), "row_id", "x", "y", "members")
            known = known.join(placed.where("own").select("zone", "tx", "ty").distinct(), ["zone", "tx", "ty"], "left_semi")
        dealt = own.unionByName(known).repartition(n_parts, "zone", "tx", "ty").sortWithinPartitions("zone", "tx", "ty", F.col("kind") > 0, "row_id")
        out = cut(dealt.mapInArrow(lambda batches: _settle(batches, radius), _OUT))
        settled = out.where("kind = 'settled'").select("row_id", "first_row")
        done = settled if done is None else done.unionByName(settled)
        left = out.where("kind = 'left'").select("kind", "zone", "row_id", "x", "y")
        # A centroid near a border comes from several tiles, of which at most one has moved it.
        latest = F.max_by(F.struct("x", "y", "members"), "changed").alias("c")
        centroids = out.where("kind = 'centroid'").groupBy("zone", "row_id").agg(latest).select("zone", "row_id", "c.*")
        turn += 1
    return done if done is not None else left.select("row_id", F.col("row_id").alias("first_row"))


def placed_points(plumes: DataFrame, by_zone: bool = True) -> DataFrame:
    """(row_id, zone, x, y) of the plumes that have coordinates, in metres of their zone."""
    u = geo.utm(F.col("lat"), F.col("lon"))
    return plumes.where("lat is not null and lon is not null").select("row_id", (u["zone"] if by_zone else F.lit(0)).alias("zone"), u["x"].alias("x"), u["y"].alias("y"))


def cluster_sources(plumes: DataFrame, radius: float = 150.0, by_zone: bool = True, tile_points: int = TILE_POINTS) -> DataFrame:
    """plumes(row_id, lat, lon, ...) with source_number (from 1, by first appearance) and source_name ``A00000001``.

    The same result as one pass in row order, whatever the size of a tile. Rows without coordinates get nulls; row_id is unique.
    """
    found = first_rows_of_sources(placed_points(plumes, by_zone), radius, tile_points).transform(cut)
    numbers = dense_numbers(found.select("first_row").distinct(), "first_row")
    out = found.join(numbers, "first_row").select("row_id", F.col("number").alias("source_number"))
    named = F.format_string("A%08d", "source_number")
    return plumes.join(out, "row_id", "left").withColumn("source_name", F.when(F.col("source_number").isNotNull(), named))


def plumes_per_source(plumes: DataFrame, members: bool = False) -> DataFrame:
    """Each source's number of plumes and the columns of its first row (by row_id); on request the list of its plumes."""
    rest = [c for c in plumes.columns if c != "source_id"]
    agg = [F.count(F.lit(1)).alias("observed_plumes"), F.min_by(F.struct(*rest), "row_id").alias("first")]
    if members:
        agg.append(F.sort_array(F.collect_list(F.struct("row_id", "candidate_id"))).alias("plumes"))
    return plumes.where("source_id is not null").groupBy("source_id").agg(*agg).select("source_id", "observed_plumes", "first.*", *(["plumes"] if members else []))


def overflights(sources: DataFrame, lines: DataFrame, cell: float = 0.1) -> DataFrame:
    """(source_id, total_overflights, flight_runs): flight lines whose ring holds the source's place, boundary excluded.

    lines has flight_run and ring (closed array of structs x = lon, y = lat), and may have holes, an array of rings; see
    cover.points_in_rings(). Rows of a flight run are areas of their own. Only sources within some ring have a row.
    """
    rings = lines.withColumn("ring_id", F.monotonically_increasing_id()).transform(cut)
    at = sources.select(F.col("source_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    inside = cover.points_in_rings(at, rings, cell).join(rings.select("ring_id", "flight_run"), "ring_id").withColumnRenamed("point_id", "source_id")
    return inside.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_overflights"), F.sort_array(F.collect_list("flight_run")).alias("flight_runs"))


def persistence(plumes: DataFrame, lines: DataFrame) -> DataFrame:
    """Sources with observed plumes, overflights and their ratio (null without an overflight)."""
    per = plumes_per_source(plumes)
    flown = overflights(per, lines).select("source_id", "total_overflights")
    return per.join(flown, "source_id", "left").withColumn("persistence", F.col("observed_plumes") / F.col("total_overflights"))
