"""Column profiles of detector columns, artefact counts and their agreement with curated labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumery.operators import selection


def usable(pixels: DataFrame, value: str = "cmf") -> DataFrame:
    """Pixels with data (not null or NaN) above zero."""
    return pixels.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0))


def column_profile(pixels: DataFrame, value: str = "cmf") -> DataFrame:
    """(image_id, col, npix, avg, std, min, max) of the usable pixels of each column; columns without any have no row."""
    v = F.col(value)
    return usable(pixels, value).groupBy("image_id", "col").agg(F.count(v).alias("npix"), F.avg(v).alias("avg"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def nearest_rank(n: Column, q: float) -> Column:
    """Index from 0 of the nearest rank at share q of n sorted values: halves go up at the low end and to even at the high end."""
    at = (n - 1) * F.lit(q)
    return (F.floor((n - 1) * F.lit(q) + 0.5) if q < 0.5 else F.rint(at)).cast("int")


def column_profile_robust(pixels: DataFrame, value: str = "cmf", exact: bool = True, held: int = selection.HELD_ROWS) -> DataFrame:
    """(image_id, col, npix, med, mad, p05, p95): median, median absolute deviation and nearest-rank percentiles.

    Columns of more than ``held`` pixels are worked out by refined histograms, over all tasks. exact=False takes approximate
    percentiles, which keep a small sketch per column at any size.
    """
    rows, keys, v = usable(pixels, value), ["image_id", "col"], F.col(value)
    if not exact:
        med = rows.groupBy(*keys).agg(F.count(v).alias("npix"), F.percentile_approx(v, 0.5).alias("med"), F.percentile_approx(v, 0.05).alias("p05"), F.percentile_approx(v, 0.95).alias("p95"))
        return rows.join(med, keys).groupBy(*keys, "npix", "med", "p05", "p95").agg(F.percentile_approx(F.abs(v - F.col("med")), 0.5).alias("mad")).select(*keys, "npix", "med", "mad", "p05", "p95")
    large = selection.large_groups(rows, keys, held)
    if not large.isEmpty():
        both = selection.in_groups(rows, large, keys).select(*keys, v.alias("_v"))
        med = selection.medians_of_large(both, keys, "_v", large)
        ends = selection.ranks_of_large(both, keys, "_v", large, {"p05": lambda n: nearest_rank(n, 0.05), "p95": lambda n: nearest_rank(n, 0.95)})
        found = med.join(ends.drop("n"), keys).select(*keys, F.col("n").alias("npix"), "med", "mad", "p05", "p95")
        return column_profile_robust(selection.in_groups(rows, large, keys, inside=False), value).unionByName(found)
    # One count per distinct value first: repeated values of a column travel once.
    counts = rows.groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*keys).orderBy("v")
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"upto": F.sum("c").over(up), "npix": F.sum("c").over(whole)})
    low, high = nearest_rank(F.col("npix"), 0.05), nearest_rank(F.col("npix"), 0.95)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    first = ranked.groupBy(*keys).agg(F.max("npix").alias("npix"), at(F.floor((F.col("npix") - 1) / 2)).alias("m1"), at(F.floor(F.col("npix") / 2)).alias("m2"), at(low).alias("p05"), at(high).alias("p95"))
    first = first.withColumn("med", (F.col("m1") + F.col("m2")) / 2).drop("m1", "m2")
    off = counts.join(first.select(*keys, "npix", "med"), keys).groupBy(*keys, "npix", F.abs(F.col("v") - F.col("med")).alias("d")).agg(F.sum("c").alias("c"))
    off = off.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("d")))
    at_d = lambda k: F.min(F.when(F.col("upto") > k, F.col("d")))
    mads = off.groupBy(*keys).agg(((at_d(F.floor((F.col("npix") - 1) / 2)) + at_d(F.floor(F.col("npix") / 2))) / 2).alias("mad"))
    return first.join(mads, keys).select(*keys, "npix", "med", "mad", "p05", "p95")


def spread(df: DataFrame, keys: list[str], value: str, normal: bool = False, held: int = selection.HELD_ROWS) -> DataFrame:
    """keys, median and median absolute deviation (over 0.6745 where ``normal``).

    Groups of more than ``held`` rows are worked out by refined histograms, over all tasks.
    """
    df = df.select(*keys, F.col(value).alias("_v"))
    scale = 0.6745 if normal else 1.0
    sure = df.where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    large = selection.large_groups(sure, keys, held)
    many = not large.isEmpty()
    few = selection.in_groups(df, large, keys, inside=False) if many else df
    med = few.groupBy(*keys).agg(F.median("_v").alias("med"))
    out = few.join(med, keys).groupBy(*keys, "med").agg((F.median(F.abs(F.col("_v") - F.col("med"))) / scale).alias("mad"))
    if not many:
        return out
    return out.unionByName(selection.medians_of_large(sure, keys, "_v", large).select(*keys, "med", (F.col("mad") / scale).alias("mad")))


def extrema(df: DataFrame, keys: list[str], value: str, p: float = 1.0, buffer: float = 0.0, held: int = selection.HELD_ROWS) -> DataFrame:
    """keys, low and high: the share p of values between nearest ranks, widened by a share of the range.

    All values (p = 1) need no order. Groups of more than ``held`` rows are worked out by refined histograms, over all tasks.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if p >= 1:
        out = rows.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    else:
        large = selection.large_groups(rows, keys, held)
        many = not large.isEmpty()
        few = selection.in_groups(rows, large, keys, inside=False) if many else rows
        ranked = few.withColumns({"_i": F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        at = lambda q: F.min(F.when(F.col("_i") == nearest_rank(F.col("_n"), q), F.col("_v")))
        out = ranked.groupBy(*keys).agg(at(1 - p).alias("low"), at(p).alias("high"))
        if many:
            out = out.unionByName(selection.ranks_of_large(rows, keys, "_v", large, {"low": lambda n: nearest_rank(n, 1 - p), "high": lambda n: nearest_rank(n, p)}).drop("n"))
    wide = (F.col("high") - F.col("low")) * buffer
    return out.select(*keys, (F.col("low") - wide).alias("low"), (F.col("high") + wide).alias("high"))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and n: how often each value occurs. All NaNs are one value; nulls aren't counted. In order of n, then value, the
    rarest come first: ``orderBy("n", value)``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def running_median(profile: DataFrame, value: str, edges: str = "null") -> DataFrame:
    """profile with ``running``: the median of three neighbouring columns; null at the ends, or there the first three's median."""
    w = Window.partitionBy("image_id").orderBy("col")
    near = w.rowsBetween(-1, 1)
    mid = F.when(F.count(value).over(near) == 3, F.percentile(value, 0.5).over(near))
    if edges == "first":
        mid = F.when(F.row_number().over(w) == 1, F.percentile(value, 0.5).over(w.rowsBetween(0, 2))).otherwise(mid)
    return profile.withColumn("running", mid)


def column_artifacts(profile: DataFrame, value: str = "avg", k: float = 1.0, mean_spread: bool = True) -> DataFrame:
    """(image_id, artifacts): columns that exceed their running median by more than k times the image's spread.

    The spread is the mean absolute deviation from the mean, or the median one from the median.
    """
    image = Window.partitionBy("image_id")  # an image's columns are few, and the running median has them together already
    middle = lambda c: (F.avg(c) if mean_spread else F.percentile(c, 0.5)).over(image)
    run = running_median(profile, value).withColumn("_c", middle(F.col(value))).withColumn("spread", middle(F.abs(F.col(value) - F.col("_c"))))
    return run.groupBy("image_id").agg(F.count_if(F.col(value) - F.col("running") > k * F.col("spread")).alias("artifacts"))


def confusion(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of counts: strict (a score of 0.5 counts as artefact), loose (it doesn't), and hits by severity.

    predicted has image_id and artifacts; labels image_id and score 0, 0.5, 1 or 2. Images without a label don't count.
    """
    both = predicted.join(labels, "image_id").select((F.col("artifacts") > 0).alias("hit"), "score")
    hit, s = F.col("hit"), F.col("score")
    return both.agg(
        F.count_if(~hit & (s == 0)).alias("strict_clean_right"), F.count_if(hit & (s == 0)).alias("strict_clean_wrong"),
        F.count_if(hit & (s > 0)).alias("strict_any_right"), F.count_if(~hit & (s > 0)).alias("strict_any_wrong"),
        F.count_if(~hit & (s < 1)).alias("loose_clean_right"), F.count_if(hit & (s < 1)).alias("loose_clean_wrong"),
        F.count_if(hit & (s >= 1)).alias("loose_any_right"), F.count_if(~hit & (s >= 1)).alias("loose_any_wrong"),
        F.count_if(hit & (s == 1)).alias("strong_hits"), F.count_if(hit & (s == 2)).alias("weak_hits"), F.count_if(hit & (s == 0.5)).alias("maybe_hits"),
    )


def unlabelled(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return predicted.join(labels, "image_id", "left_anti")


def view_outliers(obs: DataFrame, limit: float = 20.0) -> DataFrame:
    """Per image, pixels seen at more than ``limit`` degrees and the extremes of path length inside and outside of it.

    obs has image_id, path_length and zenith; null is no data.
    """
    out = F.col("zenith") > limit
    rows = obs.where("zenith is not null and path_length is not null")
    path = F.col("path_length")
    return rows.groupBy("image_id").agg(
        F.count_if(out).alias("n_outside"), F.min(F.when(out, path)).alias("min_outside"), F.max(F.when(out, path)).alias("max_outside"),
        F.min(F.when(~out, path)).alias("min_inside"), F.max(F.when(~out, path)).alias("max_inside"),
    )
