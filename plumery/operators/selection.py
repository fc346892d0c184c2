"""Exact order statistics of groups of any size, by histograms that are refined around each wanted rank.

A group with few rows is sorted where it is. In a large one the bucket of each wanted rank is looked for: first by sign and binary
exponent, then by equal parts of the range that the bucket's values really have. A pass counts values by bucket with sums in
each task first, so what meets in one place are a few thousand counts a group. Each pass narrows the range by a factor of BINS, so
after at most six the bucket has one value, and mostly after two few enough to sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumery.operators.graph import cut

#: Rows of a group that one task may hold; parts of a range; values of a bucket that are sorted.
HELD_ROWS, BINS, SORTED = 2_000_000, 4096, 10_000


def large_groups(df: DataFrame, keys: list[str], held: int = HELD_ROWS) -> DataFrame:
    """(keys, n) of the groups with more than ``held`` rows: at most one for each ``held`` rows of df, so a small table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held).transform(cut)


def _of(rows: DataFrame, few: DataFrame, keys: list[str]) -> tuple[Column, DataFrame]:
    """The condition that joins rows with a small table of large groups, null keys included, and that table, broadcast."""
    right = F.broadcast(few.withColumnsRenamed({k: f"_k_{k}" for k in keys}))
    same = F.lit(True)
    for k in keys:
        same &= rows[k].eqNullSafe(F.col(f"_k_{k}"))
    return same, right


def in_groups(rows: DataFrame, few: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """The rows that are in one of a few groups, or in none of them."""
    same, right = _of(rows, few.select(*keys), keys)
    return rows.join(right, same, "left_semi" if inside else "left_anti")


def _chosen(counts: DataFrame, targets: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """targets(by, name, rank) with the bucket that has the rank: its least and greatest value, its count, and the rank inside."""
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumnsRenamed({k: f"_k_{k}" for k in by})
    targets = targets.drop("lo", "hi", "c")
    same = F.lit(True)
    for k in by:
        same &= targets[k].eqNullSafe(F.col(f"_k_{k}"))
    hit = targets.join(ranked, same & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    return hit.select(*targets.drop("rank").columns, (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi", "c").transform(cut)


def ranks_of_large(rows: DataFrame, keys: list[str], value: str, groups: DataFrame, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n and a column for each wanted rank) of the few large groups(keys, n) of rows.

    wanted gives, by name, a rank from 0 as a function of the number of the group's rows. Nulls and NaNs of the value must be out.
    """
    v = F.col(value).cast("double")
    rows = in_groups(rows.select(*keys, v.alias("_v")), groups, keys)
    name = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in wanted.items()))).alias("w")
    targets = groups.select(*keys, name).select(*keys, "w.name", "w.rank")
    exponent = F.least(F.lit(2000), F.greatest(F.lit(-2000), F.floor(F.log2(F.abs("_v"))))).cast("int") + 3000
    code = F.when(F.col("_v") == 0, 0).when(F.col("_v") > 0, exponent).otherwise(-exponent)
    stats = (F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    targets = _chosen(rows.groupBy(*keys, code.alias("_b")).agg(*stats), targets, keys, "_b")
    done = None
    while True:
        settled = targets.where("lo = hi").select(*keys, "name", F.col("lo").alias("v"))
        done = settled if done is None else done.unionByName(settled)
        targets = targets.where("lo < hi")
        largest = targets.agg(F.max("c")).first()[0]
        if largest is None:
            break
        same, few = _of(rows, targets, keys)
        near = rows.join(few, same & F.col("_v").between(F.col("lo"), F.col("hi")))
        if largest <= SORTED:
            least = near.groupBy(*keys, "name", "rank").agg(F.sort_array(F.collect_list("_v")).alias("s"))
            done = done.unionByName(least.select(*keys, "name", F.get("s", F.col("rank").cast("int")).alias("v")))
            break
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int")
        counts = near.select(*keys, "name", "_v", part.alias("_b")).groupBy(*keys, "name", "_b").agg(*stats)
        targets = _chosen(counts, targets, [*keys, "name"], "_b")
    columns = [F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in wanted]
    found = done.groupBy(*keys).agg(*columns).withColumnsRenamed({k: f"_f_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= groups[k].eqNullSafe(F.col(f"_f_{k}"))
    return groups.join(found, same).select(*(groups[k] for k in keys), "n", *wanted)


MIDDLE = {"_m1": lambda n: F.floor((n - 1) / 2), "_m2": lambda n: F.floor(n / 2)}


def medians_of_large(rows: DataFrame, keys: list[str], value: str, groups: DataFrame) -> DataFrame:
    """(keys, n, med, mad) of the few large groups(keys, n): the median, and that of the distances from it."""
    med = ranks_of_large(rows, keys, value, groups, MIDDLE).select(*keys, "n", (F.col("_m1") * 0.5 + F.col("_m2") * 0.5).alias("med")).transform(cut)
    same, few = _of(rows, med.select(*keys, "med"), keys)
    off = rows.join(few, same).select(*(rows[k] for k in keys), F.abs(F.col(value).cast("double") - F.col("med")).alias("_off"))
    mad = ranks_of_large(off, keys, "_off", med.select(*keys, "n"), MIDDLE).select(*(F.col(k).alias(f"_f_{k}") for k in keys), (F.col("_m1") * 0.5 + F.col("_m2") * 0.5).alias("mad"))
    same = F.lit(True)
    for k in keys:
        same &= med[k].eqNullSafe(F.col(f"_f_{k}"))
    return med.join(mad, same).select(*keys, "n", "med", "mad")
