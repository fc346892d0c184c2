"""Plumes that overlap on one flight line: pairs, shares and the resolver that drops the weaker ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumery.functions import geo, names
from plumery.operators.graph import cut, min_labels

RADIUS_M = 150.0


def any_flux_above(plumes: DataFrame, flux: list[str], least: float = 1.0) -> DataFrame:
    """Rows with at least one flux above ``least``."""
    return plumes.where(F.exists(F.array(*flux), lambda x: x > least))


def meeting_pairs(plumes: DataFrame, radius: float = RADIUS_M) -> DataFrame:
    """(group_id, row_id, other_id, distance_m, overlap) of plumes of a group whose discs meet, each pair once.

    plumes has group_id, row_id, lat and lon. Cells as wide as two radii keep far pairs apart, so a large group isn't paired whole;
    of two cells that touch, one looks for the other, and in a cell the smaller row_id for the larger.
    """
    xy, size = geo.albers(F.col("lat"), F.col("lon")), 2 * radius
    at = plumes.where("lat is not null and lon is not null").select("group_id", "row_id", xy.alias("p")).select("group_id", "row_id", "p.x", "p.y")
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    left = at.withColumns({"cx": cx, "cy": cy})
    beside = F.array(*(F.struct((cx + i).alias("cx"), (cy + j).alias("cy"), F.lit(i == j == 0).alias("same")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    right = at.select("group_id", F.col("row_id").alias("other_id"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.inline(beside))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    pairs = left.join(right, ["group_id", "cx", "cy"]).where("row_id < other_id or (not same and row_id <> other_id)").withColumn("distance_m", d).where(F.col("distance_m") <= size)
    return pairs.select("group_id", "row_id", "other_id", "distance_m", geo.lens_share(F.col("distance_m"), radius).alias("overlap"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs, and each of them from its other row."""
    ways = F.array(*(F.struct(F.col(a).alias("row_id"), F.col(b).alias("other_id")) for a, b in (("row_id", "other_id"), ("other_id", "row_id"))))
    return pairs.select("group_id", F.inline(ways), "distance_m", "overlap")


def overlap_pairs(plumes: DataFrame, radius: float = RADIUS_M) -> DataFrame:
    """meeting_pairs in both directions."""
    return both_ways(meeting_pairs(plumes, radius))


def overlap_of(plumes: DataFrame, rule: str = "first") -> DataFrame:
    """plumes with ``overlap``: with the first other plume in row order that meets (the default), or the largest; 0 without one."""
    pick = F.min_by("overlap", "other_id") if rule == "first" else F.max("overlap")
    return plumes.join(overlap_pairs(plumes).groupBy("row_id").agg(pick.alias("overlap")), "row_id", "left").fillna(0.0, ["overlap"])


class _Discs:
    """A group's discs by cells as wide as two radii, so that each is compared with those around it only."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float, rule: str):
        self.x, self.y, self.radius, self.rule, self.alive = x, y, radius, rule, np.ones(len(x), bool)
        self.cx, self.cy = (np.floor(v / (2 * radius)).astype(np.int64) for v in (x, y))
        order = np.lexsort((self.cy, self.cx))
        cuts = np.flatnonzero((np.diff(self.cx[order]) != 0) | (np.diff(self.cy[order]) != 0)) + 1
        self.cells = {(int(self.cx[c[0]]), int(self.cy[c[0]])): np.sort(c) for c in np.split(order, cuts) if len(c)}
        self.share, self.partner = np.zeros(len(x)), np.full(len(x), -1)
        self.update(np.arange(len(x)))

    def update(self, rows: np.ndarray) -> None:
        """Overlap of each of these rows with the first or the most overlapping one that is left, and which that is."""
        for n in rows.tolist():
            around = [self.cells.get((int(self.cx[n]) + i, int(self.cy[n]) + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            at = np.sort(np.concatenate([c for c in around if c is not None]))
            at = at[self.alive[at] & (at != n)]
            d = np.hypot(self.x[at] - self.x[n], self.y[at] - self.y[n])
            near = d <= 2 * self.radius
            at, d = at[near], np.minimum(d[near], 2 * self.radius)
            self.share[n], self.partner[n] = 0, -1
            if len(at):
                share = (2 * self.radius**2 * np.arccos(d / (2 * self.radius)) - d / 2 * np.sqrt(4 * self.radius**2 - d * d)) / (math.pi * self.radius**2)
                pick = 0 if self.rule == "first" else int(share.argmax())
                self.share[n], self.partner[n] = round(share[pick], 9), at[pick]

    def drop(self, rows: np.ndarray) -> None:
        """Only rows whose partner went have another overlap now."""
        self.alive[rows] = False
        self.update(np.flatnonzero(self.alive & np.isin(self.partner, rows)))


def _first_above(discs: _Discs, rows: np.ndarray, max_overlap: float) -> tuple[np.ndarray, np.ndarray]:
    v = discs.share[rows]
    return v, np.flatnonzero(v > max_overlap)


def resolve(group: pd.DataFrame, flux: list[str], max_overlap: float = 0.3, radius: float = RADIUS_M, rule: str = "first") -> pd.DataFrame:
    """Drop rows of one group until no overlap is above max_overlap. group has row_id, x, y and flux columns.

    One or two rows above: of rows with equal overlap (zeros included) the one without a smallest flux goes, else those with
    the pair's smaller one; if no overlaps are equal, the rows whose largest flux is the group's smallest go. More than two:
    the row with the largest overlap goes, the first among equals.
    """
    group = group.sort_values("row_id").reset_index(drop=True)
    discs = _Discs(group["x"].to_numpy(), group["y"].to_numpy(), radius, rule)
    least_flux, most_flux = group[flux].min(axis=1, skipna=False).to_numpy(float), group[flux].max(axis=1).to_numpy(float)
    while len(rows := np.flatnonzero(discs.alive)) > 1:
        v, over = _first_above(discs, rows, max_overlap)
        if not len(over):
            break
        drop = np.array([v.argmax()]) if len(over) > 2 else _few_above(v, over, least_flux[rows], most_flux[rows])
        if not len(drop):
            break
        discs.drop(rows[drop])
    return group[discs.alive].reset_index(drop=True)


def _few_above(v: np.ndarray, over: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows of a group go when one or two overlaps are above: by equal overlaps, else by the largest fluxes."""
    _, first, which = np.unique(v, return_index=True, return_inverse=True)
    later = np.setdiff1d(np.arange(len(v)), first)
    if len(later) and np.isnan(least).any():
        return np.flatnonzero(np.isnan(least))[:1]
    if len(later):
        return np.flatnonzero(np.isin(least, np.minimum(least[later], least[first[which[later]]])))
    return np.flatnonzero(most == np.nanmin(most)) if not np.isnan(most).all() else over[:1]


def _drops(part: pd.DataFrame, max_overlap: float, radius: float, rule: str) -> pd.DataFrame:
    """The rows of a connected part that would go, one by one, while the largest overlap of all is the part's own.

    low and late order the parts' rows into one sequence: the group drops the largest overlap that there is, so a part's next row
    waits for the smallest overlap so far (low), and among equal ones for the largest row so far (late). above counts
    the part's overlaps above the bound after the drop; a first row without a drop has the count before.
    """
    part = part.sort_values("row_id")
    ids = part["row_id"].to_numpy()
    discs = _Discs(part["x"].to_numpy(), part["y"].to_numpy(), radius, rule)
    low, late, n, out = math.inf, -1, 0, []
    rows = np.arange(len(ids))
    v, over = _first_above(discs, rows, max_overlap)
    out.append((0, None, math.inf, -1, len(over), len(over)))
    while len(over):
        at = int(v.argmax())
        row, n = int(ids[rows[at]]), n + 1
        if v[at] < low:
            low, late = float(v[at]), row
        elif v[at] == low:
            late = max(late, row)
        before = len(over)
        discs.drop(rows[[at]])
        rows = np.flatnonzero(discs.alive)
        v, over = _first_above(discs, rows, max_overlap)
        out.append((n, row, low, late, len(over), len(over) - before))
    found = pd.DataFrame(out, columns=["seq", "row_id", "low", "late", "above", "change"]).astype({"row_id": "Int64"})
    return found.assign(group_id=part["group_id"].iloc[0])[["group_id", "seq", "row_id", "low", "late", "change"]]


def _largest_first(rows: DataFrame, max_overlap: float, radius: float, rule: str) -> DataFrame:
    """(row_id) of rows(group_id, part, row_id, x, y) that go while more than two overlaps of their group are above the bound.

    Parts that don't meet are worked on side by side; their drops form one ordered sequence of the group, along which the number of
    overlaps above the bound is summed by range partitions, up to where it first is two or less.
    """
    kind = rows.schema["group_id"].dataType.simpleString()
    schema = f"group_id {kind}, seq long, row_id long, low double, late long, change long"
    drops = rows.groupBy("group_id", "part").applyInPandas(lambda part: _drops(part, max_overlap, radius, rule), schema)
    order = ["group_id", F.col("low").desc(), "late", "seq"]
    ranged = drops.repartitionByRange(*order).withColumn("at", F.spark_partition_id()).transform(cut)
    ahead = Window.partitionBy("group_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("group_id", "at").agg(F.sum("change").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    inside = Window.partitionBy("group_id", "at").orderBy(*order[1:])
    upto = ranged.join(before.select("group_id", "at", "before"), ["group_id", "at"])
    upto = upto.withColumn("above", F.col("before") + F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # The counts before any drop come first (low is infinite), so "two or less" counts from the last of these on.
    key = F.struct((-F.col("low")).alias("low"), "late", "seq")
    end = upto.where("above <= 2 and seq > 0").groupBy("group_id").agg(F.min(key).alias("end"))
    begun = ranged.where("seq = 0").groupBy("group_id").agg(F.sum("change").alias("start")).where("start > 2")
    gone = upto.where("seq > 0").join(begun, "group_id").join(end, "group_id")
    return gone.where(key <= F.col("end")).select("row_id")


def _connected(rows: DataFrame, radius: float) -> DataFrame:
    """rows(group_id, row_id, x, y, ...) with part: discs of a group that may meet, by cells as wide as two radii that touch."""
    size = 2 * radius
    celled = rows.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    cells = celled.select("group_id", "cx", "cy").distinct().withColumn("node", F.struct("group_id", "cx", "cy")).transform(cut)
    beside = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = cells.select(F.col("node").alias("a"), "group_id", "cx", "cy", F.explode(beside).alias("s"))
    near = near.select("a", F.struct("group_id", (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy")).alias("b"))
    labels = min_labels(cells, near.join(cells.select(F.col("node").alias("b")), "b", "left_semi"))
    labels = labels.select("node.group_id", "node.cx", "node.cy", F.xxhash64("label.cx", "label.cy").alias("part"))
    return celled.join(labels, ["group_id", "cx", "cy"]).drop("cx", "cy")


#: Discs of a group that one task may hold with all that they meet.
HELD_DISCS = 20_000


def filter_overlaps(
    plumes: DataFrame, flux: list[str], max_overlap: float = 0.3, apply_flux_min: bool = True, rule: str = "first", held: int = HELD_DISCS, radius: float = RADIUS_M
) -> DataFrame:
    """plumes(group_id, row_id, lat, lon, flux columns) without those that overlap stronger ones of their group.

    Rows with equal fluxes count once; rows without coordinates go. Only groups in which plumes meet are worked on. Up to ``held`` rows
    a group is one task's work, by resolve(). In a larger one, connected parts are worked on side by side while more than two
    overlaps are above the bound, which is nearly all of it; what is left then, the rule compares over the whole group: one
    task has a few numbers of each row, and only discs that may meet others as such. The result is that of resolve().
    """
    rows = any_flux_above(plumes, flux) if apply_flux_min else plumes
    rows = names.first_rows(rows, flux).where("lat is not null and lon is not null").transform(cut)
    xy = geo.albers(F.col("lat"), F.col("lon"))
    placed = rows.select("group_id", "row_id", xy["x"].alias("x"), xy["y"].alias("y"), *flux).transform(cut)
    sizes = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > held).select("group_id").transform(cut)
    met = overlap_pairs(rows.join(large, "group_id", "left_anti"), radius).select("group_id").distinct()
    small = placed.join(met, "group_id", "left_semi")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return resolve(part, flux, max_overlap, radius, rule)[["row_id"]]

    kept = small.groupBy("group_id").applyInPandas(run, "row_id long")
    alone = rows.join(met, "group_id", "left_anti").join(large, "group_id", "left_anti").select("row_id")
    kept = kept.unionByName(alone)
    if large.isEmpty():
        return rows.join(kept, "row_id", "left_semi")
    least = F.when(F.exists(F.array(*flux), lambda x: x.isNull() | F.isnan(x)), None).otherwise(F.least(*flux) if len(flux) > 1 else F.col(flux[0]))
    most = F.array_max(F.filter(F.array(*flux), lambda x: x.isNotNull() & ~F.isnan(x)))
    parts = _connected(placed.join(large, "group_id", "left_semi"), radius).transform(cut)
    gone = _largest_first(parts.select("group_id", "part", "row_id", "x", "y"), max_overlap, radius, rule).transform(cut)
    several = parts.groupBy("group_id", "part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("group_id", "part", F.lit(True).alias("meets"))
    left = parts.join(gone, "row_id", "left_anti").join(several, ["group_id", "part"], "left")
    alone = F.col("meets").isNull()
    left = left.select("group_id", "row_id", *(F.when(~alone, F.col(c)).alias(c) for c in ("x", "y")), least.cast("double").alias("least"), most.cast("double").alias("most"))

    def end(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_id")
        ids, least, most = (group[c].to_numpy() for c in ("row_id", "least", "most"))
        near = np.flatnonzero(group["x"].notna())
        discs = _Discs(group["x"].to_numpy()[near], group["y"].to_numpy()[near], radius, rule)
        share, alive = np.zeros(len(ids)), np.ones(len(ids), bool)
        while alive.sum() > 1:
            share[near] = discs.share
            now = np.flatnonzero(alive)
            over = np.flatnonzero(share[now] > max_overlap)
            if not len(over):
                break
            drop = now[[share[now].argmax()]] if len(over) > 2 else now[_few_above(share[now], over, least[now], most[now])]
            if not len(drop):
                break
            alive[drop] = False
            discs.drop(np.flatnonzero(np.isin(near, drop)))
        return pd.DataFrame({"row_id": ids[alive]})

    kept = kept.unionByName(left.groupBy("group_id").applyInPandas(end, "row_id long"))
    return rows.join(kept, "row_id", "left_semi")


def exists_near(candidates: DataFrame, known: DataFrame, reach: float = 0.5) -> DataFrame:
    """Candidates (x, y, label) for which a known one of the same label lies within ``reach`` in x and in y."""
    step = F.sequence(F.lit(-1), F.lit(1))
    k = known.select(F.col("x").alias("kx"), F.col("y").alias("ky"), "label", F.explode(F.transform(step, lambda d: F.floor(F.col("x") / reach) + d)).alias("cx"))
    k = k.select("*", F.explode(F.transform(step, lambda d: F.floor(F.col("ky") / reach) + d)).alias("cy"))
    c = candidates.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    near = (c["label"] == k["label"]) & (c["cx"] == k["cx"]) & (c["cy"] == k["cy"]) & (F.abs(c["x"] - k["kx"]) < reach) & (F.abs(c["y"] - k["ky"]) < reach)
    return c.join(k, near, "left_semi").drop("cx", "cy")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the lowest x (then y); points on its sides are none."""
    p = sorted(set(points))

    def chain(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return chain(p) + chain(p[::-1]) if len(p) > 1 else p


#: Points that a task holds before it passes on the corners it has.
HELD_POINTS = 200_000


def convex_hulls(points: DataFrame) -> DataFrame:
    """(key, hull): the corners of each group's convex hull, counter-clockwise from the lowest x; points has key, x and y.

    Each task reduces what it reads to the corners of its own hulls, so of a large group only corners meet. Null keys or
    places play no part.
    """
    key = points.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[tuple[float, float]]] = {}

        def corners() -> pa.RecordBatch:
            rows = [(k, x, y) for k, own in held.items() for x, y in hull(own)]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], names=["key", "x", "y"])

        n, kind = 0, pa.string()
        for batch in batches:
            kind = batch.column(0).type
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(k, []).append((x, y))
            n += len(batch)
            if n >= HELD_POINTS:
                yield corners()
                n = 0
        if held:
            yield corners()

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        found = hull(list(zip(part["x"].tolist(), part["y"].tolist(), strict=True)))
        return pd.DataFrame({"key": [part["key"].iloc[0]], "hull": [[{"x": x, "y": y} for x, y in found]]})

    places = points.select("key", F.col("x").cast("double"), F.col("y").cast("double")).where("key is not null and x is not null and y is not null")
    ends = places.mapInArrow(run, f"key {key}, x double, y double")
    return ends.groupBy("key").applyInPandas(whole, f"key {key}, hull array<struct<x double, y double>>")
