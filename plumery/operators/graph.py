"""Cutting lineage in the shared folder, dense numbers, and connected components of graphs given as tables of edges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges that one task may tie together: a few MB of them. More go through rounds of star contractions.
LOCAL_EDGES = 200_000


def ensure_checkpoints(spark: SparkSession) -> None:
    """See that there is a folder for checkpoints: the session's own, else, for a local master as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut by columns in Parquet in the shared folder, which take a fraction of a checkpoint's room. Columns need names of their own."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{(spark.sparkContext.getConf().get('spark.checkpoint.dir') or spark.sparkContext.getCheckpointDir()).rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_dealt(df: DataFrame) -> DataFrame:
    """cut(), after which Spark still knows how rows are dealt out and sorted, so that later joins and groups don't deal them anew.

    Adaptive execution hides that of a plan, so it is off while this one is written.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df.select("*"))  # a plan of its own
    finally:
        conf.set(key, before)


def _values(column: pa.Array) -> list:
    """Nodes as values that can be ordered: structs as tuples."""
    if pa.types.is_struct(column.type):
        return list(zip(*(f.to_pylist() for f in column.flatten()), strict=True))
    return column.to_pylist()


def tied(edges: DataFrame) -> DataFrame:
    """(node, label) of few edges, by pointers in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}

        def find(x):
            while (y := top.setdefault(x, x)) != x:
                top[x] = x = top.setdefault(y, y)
            return x

        column = None
        for batch in batches:
            column = batch.column(0)
            for a, b in zip(_values(column), _values(batch.column(1)), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    top[max(a, b)] = min(a, b)
        if column is None:
            return
        nodes = list(top)
        built = []
        for some in (nodes, [find(x) for x in nodes]):
            if pa.types.is_struct(column.type):
                fields = [column.type.field(k) for k in range(column.type.num_fields)]
                built.append(pa.StructArray.from_arrays([pa.array([x[k] for x in some], f.type) for k, f in enumerate(fields)], fields=fields))
            else:
                built.append(pa.array(some, column.type))
        yield pa.RecordBatch.from_arrays(built, names=["node", "label"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, label) by rounds in which every node's neighbours are tied to the smallest of them, larger and smaller ones in turn."""
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = up.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        last = now


def min_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of nodes(node): the smallest node that edges(a, b) lead to; nodes without an edge are their own.

    At most LOCAL_EDGES edges are tied in one task, more by rounds of contractions; the labels are the same.
    """
    edges = cut(edges.select("a", "b").where("a <> b"))
    labels = tied(edges) if edges.count() <= LOCAL_EDGES else _contracted(edges)
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def dense_numbers(keys: DataFrame, key: str) -> DataFrame:
    """(key, number from 1) in key order, by range partitions and the totals before each."""
    ranged = keys.repartitionByRange(key).withColumn("part", F.spark_partition_id()).transform(cut)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").select(key, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(key))).alias("number"))
