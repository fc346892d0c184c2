"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

The lines' 128-bit hashes come in batches, documents with the largest ids first. A run is a table of hashes, bucketed
and sorted by hash. Each batch is summed to one row per hash and merge-anti-joined with the runs there are: hashes that no
run knows name their holder, the largest document that has the line; known ones only add to the counts. The batch's rows
become a run of level 0; ``fan_in`` runs of a level are merged into one of the next level. In the end the merged runs say
which lines are shared widely and which document keeps them. All of it is DataFrame work; joins of runs need no shuffle, as
runs share their buckets.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.llm.common import BLANKS, ascii_lower, join_skewed, materialise, remove, shared_dir, table

HASH = ["h1", "h2"]
ROW = ["_ld_r1", "_ld_r2"]


def _lines(docs: DataFrame) -> F.Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(row key, doc_id, pos, h1, h2) of each line whose key, stripped and lower-cased, has at least min_chars code points."""
    key = ascii_lower(F.trim(F.col("line"), F.lit(BLANKS)))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", *_row_key(), F.posexplode(_lines(docs)).alias("pos", "line"))
        .select("doc_id", *ROW, "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", *ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def _row_key() -> list[F.Column]:
    """Documents are told apart by id and text, so repeated ids do no harm."""
    return [F.xxhash64("doc_id", "text").alias(ROW[0]), F.xxhash64(F.lit(1), "text", "doc_id").alias(ROW[1])]


class LineRuns:
    """Levelled sorted runs of line hashes: h1, h2, n_docs, n_lines and the holder of the line."""

    def __init__(self, spark: SparkSession, fan_in: int = 2, n_buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []
        self.written: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_dir(self.spark)
        self.written[name] = path
        (rows.repartition(self.n_buckets, *HASH).write.bucketBy(self.n_buckets, *HASH).sortBy(*HASH)
         .option("path", path).format("parquet").saveAsTable(name))
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)
            self.written.pop(name, None)

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        every = reduce(DataFrame.unionByName, (self.spark.table(name) for name, _ in runs))
        return every.groupBy(*HASH).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.max("holder").alias("holder")
        )

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of line_hashes() whose documents are in no earlier batch and have smaller ids."""
        batch = lines.groupBy(*HASH).agg(
            F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_lines"), F.max("doc_id").alias("holder")
        )
        runs = self.runs()
        if runs:
            summed = self._write(batch)
            rows = fresh = self.spark.table(summed[0])
            for name, _ in runs:
                fresh = fresh.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
            known = fresh.select(*HASH, F.lit(True).alias("fresh"))
            batch = rows.join(known.hint("merge"), HASH, "left").withColumn("holder", F.when(F.col("fresh"), F.col("holder"))).drop("fresh")
            run = self._write(batch)
            self._drop([summed])
        else:
            run = self._write(batch)
        self._push(run, 0)

    def _push(self, run: tuple[str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            up = self._write(self.merged(full))
            self._drop(full)
            self._push(up, level + 1)

    def close(self) -> None:
        self._drop(list(self.written.items()))
        self.levels = []


def shared_lines(lines: DataFrame, min_docs: int = 5, n_batches: int = 4, fan_in: int = 2) -> DataFrame:
    """One row for each line hash found in at least min_docs documents: h1, h2, n_docs, n_lines, holder."""
    spark = lines.sparkSession
    cuts = lines.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / n_batches) for i in range(1, n_batches))), F.lit(1000))).first()[0] or []
    runs = LineRuns(spark, fan_in)
    edges = [None, *sorted(set(cuts)), None]
    try:
        for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("doc_id") > low)
            if high is not None:
                batch = batch.where(F.col("doc_id") <= high)
            runs.add(batch)
        return materialise(runs.merged(runs.runs()).where(F.col("n_docs") >= min_docs))
    finally:  # after an error too, no run stays in the catalog or on disk
        runs.close()


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fan_in: int = 2) -> DataFrame:
    """docs with shared lines removed from ``text``, and the columns n_lines and n_dropped.

    A line's key is the line stripped of blanks and with A-Z lower-cased. A key of at least min_chars code points that at
    least min_docs documents hold is kept in the largest doc_id that has it and dropped elsewhere. A null or empty text is
    one empty line. Documents with a null doc_id aren't counted and lose nothing; rows with the same doc_id count as one
    document, and repeated rows come out as often as they went in. Other columns pass through; n_lines and n_dropped
    replace columns of these names. A very long text is one row's array of lines, and one row for each line of a key.
    """
    lines = materialise(line_hashes(docs, min_chars))
    shared = shared_lines(lines, min_docs, n_batches, fan_in)
    drops = (
        join_skewed(lines, shared, HASH, "n_lines", lines.count())
        .where(F.col("doc_id") != F.col("holder"))
        .groupBy(*ROW)
        .agg(F.collect_set("pos").alias("_ld_drop"))
    )
    out = docs.withColumns(dict(zip(ROW, _row_key(), strict=True))).join(drops, ROW, "left").drop(*ROW)
    every = _lines(out)
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.coalesce("_ld_drop", F.array().cast("array<int>")))
    dropped = F.coalesce(F.size("_ld_drop"), F.lit(0))
    text = F.when(dropped == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n"))
    return out.withColumns({"n_lines": F.size(every).cast("long"), "n_dropped": F.greatest(dropped, F.lit(0)).cast("long"), "text": text}).drop("_ld_drop")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many of them other documents keep, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, holder IS NOT NULL AND holder <> doc_id AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
