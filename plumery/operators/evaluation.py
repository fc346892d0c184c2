"""Scores against labels: precision and recall by threshold, best F1, class weights and normalisation constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumery.operators.graph import cut


def precision_recall(scored: DataFrame, bins: int | None = None) -> DataFrame:
    """(threshold, tp, fp, precision, recall, f1) for each distinct score, counting scores at or above it; label 1 is positive.

    Counts are summed per score first and then in order, by range partitions and the totals before each. bins rounds scores
    down to that many steps. f1 is null where precision and recall are 0.
    """
    score = F.floor(F.col("score") * bins) / bins if bins else F.col("score")
    per = scored.where("score is not null").groupBy(score.alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    ranged = per.repartitionByRange(F.col("threshold").desc()).withColumn("part", F.spark_partition_id()).transform(cut)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    base = base.select("part", F.coalesce(F.sum("p").over(ahead), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    total = ranged.agg(F.sum("p").alias("positives"))
    down = Window.partitionBy("part").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(F.broadcast(base), "part").select("threshold", (F.col("p0") + F.sum("p").over(down)).alias("tp"), (F.col("n0") + F.sum("n").over(down)).alias("fp")).join(F.broadcast(total))
    run = run.select("threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.nullif("positives", F.lit(0))).alias("recall"))
    return run.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def best_f1(curve: DataFrame) -> DataFrame:
    """The threshold with the largest F1 (the highest such threshold)."""
    return curve.where("f1 is not null").agg(F.max(F.struct("f1", "threshold", "precision", "recall")).alias("b")).select("b.threshold", "b.f1", "b.precision", "b.recall")


def report(scored: DataFrame, threshold: float) -> DataFrame:
    """Per class (1 and 0) precision, recall, f1 and support at score > threshold."""
    hit, pos = F.col("score") > threshold, F.col("label") == 1
    out = None
    for c, h, p in ((1, hit, pos), (0, ~hit, ~pos)):
        one = scored.agg(F.count_if(h & p).alias("t"), F.count_if(h).alias("h"), F.count_if(p).alias("support"))
        one = one.select(F.lit(c).alias("class"), (F.col("t") / F.nullif("h", F.lit(0))).alias("precision"), (F.col("t") / F.nullif("support", F.lit(0))).alias("recall"), "support")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def class_weights(tiles: DataFrame) -> DataFrame:
    """n_pos, n_neg and their weight neg / pos; labels -1 count as 0."""
    return tiles.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") != 1).alias("n_neg")).withColumn("weight", F.col("n_neg") / F.nullif("n_pos", F.lit(0)))


def normalisation(pixels: DataFrame, low: float = 0.0, high: float = 4000.0) -> DataFrame:
    """Per campaign, mean and deviation of clamped enhancement."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col("cmf")))
    return pixels.where("cmf is not null").groupBy("campaign").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def split_tiles(tiles: DataFrame, split: DataFrame) -> DataFrame:
    """tiles(lid, ...) with the part (train, test) of their flight line; lines in no part are left out."""
    return tiles.join(split.select("lid", "part"), "lid")


def sample_tiles(pixels: DataFrame, per_class: dict[int, int], size: int = 256, seed: int = 0) -> DataFrame:
    """Tile corners around sampled label pixels: at most one per tile-sized cell and class, then per_class many of each.

    A class's cells go in order of a hash; the first of each of many parts are found side by side, then the first of all.
    """
    cells = pixels.withColumns({"tr": F.floor(F.col("row") / size), "tc": F.floor(F.col("col") / size)})
    one = cells.groupBy("image_id", "label", "tr", "tc").agg(F.min_by(F.struct("row", "col"), F.xxhash64(F.lit(seed), "image_id", "row", "col")).alias("p"))
    one = one.withColumn("_h", F.xxhash64(F.lit(seed), "image_id", "tr", "tc")).withColumn("_part", F.pmod("_h", F.lit(256)))
    most = F.create_map(*(F.lit(x) for kv in per_class.items() for x in kv))[F.col("label")]
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "image_id", "tr", "tc"))
    few = one.withColumn("_n", first(["label", "_part"])).where(F.col("_n") <= most)
    ranked = few.withColumn("_n", first(["label"])).where(F.col("_n") <= most)
    return ranked.select("image_id", "label", (F.col("p.row") - size // 2).alias("row0"), (F.col("p.col") - size // 2).alias("col0"))
