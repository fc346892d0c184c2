"""What the operators of this subpackage share: input, the shared folder, written intermediate tables and skew-safe joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.operators.graph import ensure_checkpoints

#: White space of the contracts: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is heavy if it has at least this share of the rows; so there are at most HEAVY_PARTS heavy keys.
HEAVY_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share.

    Only where the setting is missing, as in local tests, a temporary folder takes its place.
    """
    ensure_checkpoints(spark)
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return f"{base.rstrip('/')}/plumery-{uuid.uuid4().hex}"


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, whose texts can be long, with its session handing rows to Python in batches of at most ``rows``.

    The size of a batch is read when a job starts, long after an operator has returned its lazy result; so the session keeps
    the smaller size, for later queries too. It changes how many rows are handed over at once, never a result.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
    return df


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query that is made and run leaves no shuffle files behind, which else stay until the driver's next garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back, and where it is: who has it may remove() it when all that was made of
    it is written."""
    path = shared_dir(df.sparkSession)
    writer = df.write
    with shuffles_removed(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    return written(df, partition_by)[0]


def bucketed(df: DataFrame, n: int, *by: str) -> tuple[DataFrame, Callable[[], None]]:
    """df written as a table in n buckets by those columns and read back, and what drops the table: joins on these columns, with n
    partitions, leave its rows where they are."""
    spark, name, path = df.sparkSession, f"buckets_{uuid.uuid4().hex}", shared_dir(df.sparkSession)
    with shuffles_removed(spark):
        df.repartition(n, *by).write.bucketBy(n, *by).option("path", path).format("parquet").saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)

    return spark.table(name), drop


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of an intermediate table that is no longer read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def runs_of(texts: list[str], chars: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about so many characters, each with the number of its first text."""
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and size < chars:
            size += len(texts[at])
            at += 1
        yield first, texts[first:at]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ASCII strings take the quick way; others are mapped letter by letter."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_of_id(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def join_skewed(rows: DataFrame, facts: DataFrame, on: list[str], n_rows: str, total: int) -> DataFrame:
    """Inner join of rows with one fact row per key, where a few keys may hold a third of the rows.

    facts says in column n_rows how many of the total rows have its key. Keys with at least 1 / HEAVY_PARTS of the
    rows, of which there are at most HEAVY_PARTS, are broadcast; no other key is large enough to overload a task.
    """
    heavy = F.col(n_rows) * HEAVY_PARTS >= F.lit(max(total, 1))
    few = facts.where(heavy)
    return rows.join(F.broadcast(few), on).unionByName(
        rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(facts.where(~heavy), on)
    )
