"""Points in rings of any size, by a hierarchical cover of each ring.

A ring is cut into its edges, and these into the rows of cells that they cross. Cells that an edge meets are border cells; between
two of them in a row lies a run of cells that are all inside or all outside, which the crossings of the row's middle line to
their left tell. Runs inside are kept as dyadic intervals, few for however many cells. A point in such an interval is inside
without a test; one in a border cell is tested against the edges of its row alone; any other is outside. No ring is copied
to cells, and what is made grows with the length of its border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumery.operators.graph import cut

#: Edges count as meeting cells that they miss by less than this share of a cell, as coordinates are rounded.
SLACK = 1e-6
#: Runs of up to 2 ** LEVELS cells are one interval.
LEVELS = 24


def _edges(rings: DataFrame) -> DataFrame:
    """(ring_id, x1, y1, x2, y2): the edges of each ring and of its holes, where there are any."""
    every = F.array(F.col("ring"))
    if "holes" in rings.columns:
        every = F.concat(every, F.coalesce("holes", F.array().cast(rings.schema["holes"].dataType)))
    one = rings.select("ring_id", F.explode(every).alias("r")).where(F.size("r") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.struct(F.get("r", i).alias("a"), F.get("r", i + 1).alias("b")))
    found = one.select("ring_id", F.explode(pairs).alias("e"))
    return found.select("ring_id", *(F.col(f"e.{p}.{c}").cast("double").alias(f"{c}{n}") for n, p in ((1, "a"), (2, "b")) for c in ("x", "y")))


def _at(y: Column) -> Column:
    """x of an edge at a height."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")


def _crosses(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def banded_edges(rings: DataFrame, cell: float) -> DataFrame:
    """The edges of rings(ring_id, ring, holes), once for each row of cells that they cross."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(F.floor(low / cell - SLACK), F.floor(high / cell + SLACK))
    return _edges(rings).select("*", F.explode(rows).alias("cy"))


def border_cells(bands: DataFrame, cell: float) -> DataFrame:
    """(ring_id, cy, cx, crossings): cells that edges meet, and how often an edge crosses the middle line of the row in them."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    ends = [F.greatest(low, F.least(high, (F.col("cy") + k) * cell)) for k in (0, 1)]
    level = F.col("y1") == F.col("y2")
    xs = [F.when(level, F.col(c)).otherwise(_at(y)) for c, y in zip(("x1", "x2"), ends, strict=True)]
    span = F.sequence(F.floor(F.least(*xs) / cell - SLACK), F.floor(F.greatest(*xs) / cell + SLACK))
    met = bands.select("ring_id", "cy", F.explode(span).alias("cx"), F.lit(0).alias("n"))
    middle = (F.col("cy") + 0.5) * cell
    crossed = bands.where(_crosses(middle)).select("ring_id", "cy", F.floor(_at(middle) / cell).alias("cx"), F.lit(1).alias("n"))
    return met.unionByName(crossed).groupBy("ring_id", "cy", "cx").agg(F.sum("n").alias("crossings"))


def inner_intervals(borders: DataFrame) -> DataFrame:
    """(ring_id, cy, level, at): cells at * 2 ** level to (at + 1) * 2 ** level - 1 of a row are inside of the ring."""
    along = Window.partitionBy("ring_id", "cy").orderBy("cx")
    gaps = borders.withColumns({"next": F.lead("cx").over(along), "odd": F.sum("crossings").over(along.rowsBetween(Window.unboundedPreceding, 0)) % 2})
    runs = gaps.where("odd = 1 and next > cx + 1").select("ring_id", "cy", (F.col("cx") + 1).alias("a"), F.col("next").alias("b"))
    leveled = runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    side = F.pow(F.lit(2.0), "level")
    leveled = leveled.withColumns({"l": F.ceil(F.col("a") / side), "r": F.floor(F.col("b") / side)}).where("l < r")
    last = F.lit(LEVELS) == F.col("level")
    ends = F.when(last, F.sequence("l", F.col("r") - 1)).otherwise(
        F.concat(F.when(F.pmod("l", F.lit(2)) == 1, F.array("l")).otherwise(F.array().cast("array<bigint>")), F.when(F.pmod("r", F.lit(2)) == 1, F.array(F.col("r") - 1)).otherwise(F.array().cast("array<bigint>")))
    )
    return leveled.select("ring_id", "cy", "level", F.explode(ends).alias("at"))


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """(point_id, ring_id): the rings(ring_id, ring, holes) that each of points(point_id, x, y) is in; points on an edge are outside.

    ring is a closed array of structs x, y; holes, if that column is there, an array of such rings. Ids are unique. Points without a
    place, and rings of fewer than two corners, are in nothing. Any cell gives the same result.
    """
    bands = banded_edges(rings, cell).transform(cut)
    borders = border_cells(bands, cell).transform(cut)
    inner = inner_intervals(borders).transform(cut)
    placed = points.where("x is not null and y is not null").select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed = placed.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    levels = [r.level for r in inner.select("level").distinct().collect()]  # at most LEVELS + 1 values
    found = None
    if levels:
        keyed = placed.select("point_id", "cy", "cx", F.explode(F.array(*map(F.lit, levels))).alias("level"))
        keyed = keyed.withColumn("at", F.floor(F.col("cx") / F.pow(F.lit(2.0), "level")))
        found = keyed.join(inner, ["cy", "level", "at"]).select("point_id", "ring_id")
    near = placed.join(borders.select("ring_id", "cy", "cx"), ["cy", "cx"]).join(bands, ["ring_id", "cy"])
    x, y = F.col("x"), F.col("y")
    right = F.coalesce(_crosses(y) & (x < _at(y)), F.lit(False))
    turn = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    touch = (turn == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    tested = near.groupBy("point_id", "ring_id").agg(F.sum(right.cast("int")).alias("n"), F.max(touch).alias("touch"))
    tested = tested.where("n % 2 = 1 and not touch").select("point_id", "ring_id")
    return tested if found is None else found.unionByName(tested)
