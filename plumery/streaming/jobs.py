"""Plume lists and feeds as streams: new files, enrichment and upsert, sources in order of arrival, completeness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumery.functions import geo, names
from plumery.operators import clustering, wind
from plumery.operators.graph import cut
from plumery.streaming.versions import Versions


def plume_stream(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """Rows of plume lists as they appear below a folder; what was read before is known by the query's checkpoint."""
    return spark.readStream.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)


def run_available(df: DataFrame, checkpoint: str, per_batch) -> StreamingQuery:
    """Work off all that is there and stop. A new checkpoint folder starts from the beginning."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(per_batch).trigger(availableNow=True).start()


def upsert_enriched(plumes: DataFrame, wind_table: DataFrame, out: str, checkpoint: str, k: int = 10, keep: int = 2) -> StreamingQuery:
    """Add wind and emission to arriving plumes and put them into the list at ``out``, which is kept by date and in order of
    candidate_id inside: a plume that is there already is replaced. Only the dates that a batch has are read and written.

    Each batch is a version of the list, see versions.Versions: a reader, by enriched_list(), sees the list before or after a batch,
    and a batch that is run again changes nothing. Of several rows of a candidate in one batch, one stays. The last ``keep``
    versions are kept.
    """

    def batch(df: DataFrame, n: int) -> None:
        versions = Versions(df.sparkSession, out)
        old = versions.current()
        if old["batches"].get(checkpoint, -1) >= n:
            return
        timed = df.withColumn("acq_time", names.candidate_time(F.col("candidate_id")))
        done = wind.emissions(timed, wind.wind_statistics(wind.wind_of_plumes(timed, wind_table, k)))
        new = done.withColumn("date", F.coalesce(F.to_date("acq_time").cast("string"), F.lit("none"))).dropDuplicates(["candidate_id"]).transform(cut)
        dates = [r.date for r in new.select("date").distinct().collect()]
        rows = old["rows"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        there = versions.read(rows, dates, old).join(new.select("candidate_id"), "candidate_id", "left_anti")
        path = versions.folder()
        both = new.unionByName(there).withColumn("_date", F.col("date"))
        both.repartition("_date").sortWithinPartitions("_date", "candidate_id").write.partitionBy("_date").parquet(path)
        parts = old["parts"] | {d: f"{path}/_date={d}" for d in dates}
        versions.switch(old | {"parts": parts, "batches": old["batches"] | {checkpoint: n}, "rows": rows})
        versions.expire(keep)

    return run_available(plumes, checkpoint, batch)


def enriched_list(spark: SparkSession, out: str) -> DataFrame:
    """The list that upsert_enriched() keeps, as it was after its last whole batch."""
    return Versions(spark, out).read()


#: Sides of the squares (km) by which sources are kept, and how far beyond its own square (in radii) a key follows plumes.
SQUARE_KM, FOLLOWED = 100, 40


class _SourceState(StatefulProcessor):
    """Sources of one square of a zone, in a state store: centroids by cells as wide as the radius, and doubtful cells.

    A key gets the plumes of its square and of the margin around it, and applies the rule to all in order of row_id. At the margin's
    outer edge it doesn't know what lies beyond; what is within two radii of there, or of an earlier doubtful plume, is
    doubtful. Only plumes of the square itself are put out. A batch reads and writes the cells around its plumes, no others.
    """

    def __init__(self, radius: float) -> None:
        self.radius = radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.centroids = handle.getMapState("centroids", "i long, j long", "key array<long>, x array<double>, y array<double>, members array<long>")
        self.doubtful = handle.getMapState("doubtful", "i long, j long", "row_id long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        zone, sx, sy = key
        side, beyond = SQUARE_KM * 1000.0, FOLLOWED * self.radius
        low, high = (sx * side - beyond, sy * side - beyond), ((sx + 1) * side + beyond, (sy + 1) * side + beyond)
        reach, cell = 2 * self.radius * clustering.SLACK, clustering.Sources(self.radius).cell
        around = (-1, 0, 1)
        read, written, out = {}, set(), []
        sources = clustering.Sources(self.radius)

        def fetch(at: tuple[int, int]) -> None:
            if at not in read:
                read[at] = True
                if self.centroids.containsKey(at):
                    for k, x, y, m in zip(*self.centroids.getValue(at), strict=True):
                        sources.put(k, x, y, m)

        every = pd.concat(list(rows)).sort_values("row_id")
        for row, x, y in zip(every["row_id"].tolist(), every["x"].tolist(), every["y"].tolist(), strict=True):
            i, j = cell(x, y)
            near = [(i + a, j + b) for a in around for b in around]
            for at in near:
                fetch(at)
            source = sources.add(row, x, y)
            written.update(near)  # the centroid was in one of these cells and is in one of them
            wide = [(math.floor(x / reach) + a, math.floor(y / reach) + b) for a in around for b in around]
            doubt = min(x - low[0], y - low[1], high[0] - x, high[1] - y) < reach or any(self.doubtful.containsKey(w) for w in wide)
            if doubt and not self.doubtful.containsKey(wide[4]):
                self.doubtful.updateValue(wide[4], (row,))
            if math.floor(x / side) == sx and math.floor(y / side) == sy:
                out.append((row, f"S{source:012d}", not doubt))
        for at in written:
            held = [(k, *c) for k, c in sorted(sources.cells.get(at, {}).items())]
            if held:
                self.centroids.updateValue(at, tuple(list(c) for c in zip(*held, strict=True)))
            elif self.centroids.containsKey(at):
                self.centroids.removeKey(at)
        yield pd.DataFrame(out, columns=["row_id", "source_key", "certain"]).astype({"row_id": "int64", "certain": "bool"})

    def close(self) -> None:
        pass


def sources_of_stream(plumes: DataFrame, radius: float = 150.0) -> DataFrame:
    """(row_id, source_key, certain) of each arriving plume that has coordinates; the source is named by its first plume.

    The rule is that of the batch job, rows of a batch in order of row_id, later batches after earlier ones. State is kept by squares
    of 100 km, each of which follows the plumes up to 40 radii beyond its sides as well; so a source astride a side is the same on
    both. A chain of influences that might come from beyond that makes ``certain`` false; none does in practice. A batch with a
    null row_id or place leaves these rows out. The session is set to the RocksDB state store, which such state needs.
    """
    spark = plumes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    side, beyond = SQUARE_KM * 1000.0, FOLLOWED * radius
    span = lambda c: F.sequence(F.floor((F.col(c) - beyond) / side), F.floor((F.col(c) + beyond) / side))
    at = clustering.placed_points(plumes).where("row_id is not null")
    at = at.select("*", F.explode(span("x")).alias("sx")).select("*", F.explode(span("y")).alias("sy"))
    return at.groupBy("zone", "sx", "sy").transformWithStateInPandas(
        statefulProcessor=_SourceState(radius), outputStructType="row_id long, source_key string, certain boolean", outputMode="Append", timeMode="None"
    )


def assign_sources(plumes: DataFrame, out: str, checkpoint: str, radius: float = 150.0) -> StreamingQuery:
    """Write each arriving plume's source below ``out``, work off all that is there and stop.

    State is in the query's own checkpoint, one version a batch, old ones removed by the store; a query that starts again goes
    on where it was, and a batch that is run again gives the same rows once.
    """
    rows = sources_of_stream(plumes, radius)
    return rows.writeStream.option("checkpointLocation", checkpoint).format("parquet").outputMode("append").trigger(availableNow=True).start(out)


#: So many batches' arrivals are kept beside the missing paths before they are taken out of them.
COMPACTED = 20


def completeness(arrived: DataFrame, expected: DataFrame, out: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Keep account of which expected paths haven't arrived well, as arrived (path, status) comes in; missing_paths() reads it.

    A batch writes what has arrived well in it, nothing else; after COMPACTED batches these are taken out of the missing paths once.
    Each batch is a version, see versions.Versions, and one that is run again changes nothing.
    """

    def batch(df: DataFrame, n: int) -> None:
        versions = Versions(df.sparkSession, out)
        old = versions.current()
        if old["batches"].get(checkpoint, -1) >= n:
            return
        parts = dict(old["parts"])
        if not old["version"]:
            parts["expected"] = versions.folder()
            expected.select("path").distinct().write.parquet(parts["expected"])
        parts[f"fine {n:012d}"] = versions.folder()
        df.where("status = 'ok'").select("path").distinct().write.parquet(parts[f"fine {n:012d}"])
        if len(parts) > COMPACTED:
            left = versions.folder()
            _missing(versions, old | {"parts": parts}).write.parquet(left)
            parts = {"expected": left}
        versions.switch(old | {"parts": parts, "batches": old["batches"] | {checkpoint: n}, "rows": "path string"})
        versions.expire(keep)

    return run_available(arrived, checkpoint, batch)


def _missing(versions: Versions, manifest: dict) -> DataFrame:
    fine = [k for k in manifest["parts"] if k != "expected"]
    left = versions.read("path string", ["expected"], manifest)
    return left.join(versions.read("path string", fine, manifest), "path", "left_anti") if fine else left


def missing_paths(spark: SparkSession, out: str) -> DataFrame:
    """(path) of what is missing or failed after the last whole batch of completeness()."""
    versions = Versions(spark, out)
    return _missing(versions, versions.current())
