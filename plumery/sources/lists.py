"""Plume lists and other tables in text files: reading, encodings, normal names, inserting and writing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.functions import names

#: What stands for a missing cell, and the lists' headers by our names.
FILLS = ("-9999", "-9999.0", "NA", "#VALUE!", "nan", "NaN", "")
ALIASES = {
    "Candidate ID": "candidate_id", "Candidate identifier": "candidate_id", "Line name": "lid", "# Line name": "lid", "Source identifier": "source_id", "Source ID": "source_id",
    "Nearest facility (best estimate)": "facility", "Plume Latitude (deg)": "lat", "Plume Longitude (deg)": "lon", "Minimum Threshold (ppmm)": "min_ppmm",
    "AvgIMEdivFetch20 (kg/m)": "ime_fetch_avg", "StdIMEdivFetch20 (kg/m)": "ime_fetch_std", "Aspect ratio20": "aspect_ratio", "User ID": "uid", "Label": "label",
}
NUMBERS = {"lat": "double", "lon": "double", "min_ppmm": "int", "ime_fetch_avg": "double", "ime_fetch_std": "double", "aspect_ratio": "double"}


def read_list(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8", row_ids: bool = True) -> DataFrame:
    """CSV files with a header, all cells text, blanks after commas skipped; columns of several files by name.

    row_id follows the order of files and lines in the scan.
    """
    paths = [paths] if isinstance(paths, str) else paths
    out = None
    for p in paths:
        one = spark.read.csv(p, header=True, ignoreLeadingWhiteSpace=True, enforceSchema=False, encoding=encoding)
        one = one.withColumnsRenamed({c: c.strip() for c in one.columns if c != c.strip()})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumn("row_id", F.monotonically_increasing_id()) if row_ids else out


def read_any_encoding(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Files that are UTF-8 or, where that fails, ISO-8859-1, each decided by its whole bytes; a file is a list, so it fits a row.

    Without columns, these are the cells of the first file's first line, and files must agree on them.
    """

    def lines(raw: bytes) -> list[str]:
        try:
            text = raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = raw.decode("iso-8859-1")
        return [x for x in text.splitlines() if x.strip()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lines(x.as_py()) for x in batch.column(1)], pa.list_(pa.string()))], names=["path", "lines"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, lines array<string>")
    head = columns or [c.strip().lstrip("#").strip() for c in next(iter(_csv_cells(files.orderBy("path").first().lines[0])))]
    rows = files.select("path", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("n", "line"))
    return rows.select("path", "n", F.from_csv("line", _ddl(head), {"ignoreLeadingWhiteSpace": "true"}).alias("r")).select("path", "n", "r.*")


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _csv_cells(line: str):
    import csv

    return csv.reader([line], skipinitialspace=True)


def clean(c: Column) -> Column:
    """Null for every fill."""
    return F.when(~F.trim(c).isin(*FILLS), F.trim(c))


def normalise(plumes: DataFrame) -> DataFrame:
    """Our column names and types, fills as null; other columns pass through as text."""
    out = plumes.withColumnsRenamed({c: ALIASES[c] for c in plumes.columns if c in ALIASES})
    cells = {c: clean(F.col(f"`{c}`")) for c, kind in out.dtypes if kind == "string"}
    out = out.withColumns(cells)
    return out.withColumns({c: F.expr(f"try_cast({c} AS {kind})") for c, kind in NUMBERS.items() if c in out.columns})


def located(plumes: DataFrame) -> DataFrame:
    """Rows with coordinates that aren't fills."""
    return plumes.where("lat is not null and lon is not null and lat <> -9999 and lon <> -9999")


def with_threshold(plumes: DataFrame) -> DataFrame:
    """min_ppmm from the file's name; a name without one is an error."""
    return plumes.withColumn("min_ppmm", names.min_ppmm(F.col("_metadata.file_name")))


def new_files(spark: SparkSession, path: str, since: str | None, pattern: str = ".*", force: bool = False) -> DataFrame:
    """(path, modified) of files below a folder that changed after ``since`` (text of a time): none where it is null, all where
    forced. Hidden files and folders are left out."""
    if since is None and not force:
        return spark.createDataFrame([], "path string, modified timestamp")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not force:
        reader = reader.option("modifiedAfter", since)
    found = reader.load(path).select("path", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(name.rlike(f"^(?:{pattern})") & ~F.col("path").rlike(r"/\.[^/]"))


def insert(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Old and new rows in text order of a key, with the old list's columns; and the new rows that fill further columns."""
    extra = [c for c in new.columns if c not in old.columns]
    bad = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in extra)).isNotNull() if extra else F.lit(False)
    fine = old.unionByName(new.where(~bad).drop(*extra), allowMissingColumns=True)
    return fine.orderBy(F.col(f"`{key}`").cast("string")), new.where(bad)


def write_version(df: DataFrame, root: str, n_files: int | None = None) -> str:
    """Write a list as CSV into a new folder below root, beside the older versions, and return its path."""
    path = f"{root}/version-{uuid.uuid4().hex}"
    (df.coalesce(n_files) if n_files else df).write.option("header", True).csv(path)
    return path


def two_sheets(automatic: DataFrame, manual: DataFrame, truncated: bool = False, dedup: list[str] | None = None) -> DataFrame:
    """Automatic and manual candidates as one table: manual ones evaluate as FN; TP and FN are plumes, FP are not."""
    strip = lambda d: d.withColumnsRenamed({c: c.replace("#", "").strip() for c in d.columns})
    out = strip(automatic).unionByName(strip(manual).withColumn("evaluation", F.lit("FN")), allowMissingColumns=True)
    out = out.withColumn("label", F.when(F.col("evaluation").isin("TP", "FN"), "Plume").when(F.col("evaluation") == "FP", "False Enhancement"))
    if truncated:
        out = out.withColumn("cid", names.candidate_tail(F.col("cid")))
    if dedup:
        out = names.first_rows(out.withColumn("_row", F.monotonically_increasing_id()), dedup, "_row").drop("_row")
    return out


def footprints(lines: DataFrame) -> DataFrame:
    """(flight_run, ring, holes): from a name's first word where there is no Flight_Run; of WKT polygons, the outer ring and the others."""
    run = F.col("Flight_Run") if "Flight_Run" in lines.columns else F.split_part("Name", F.lit(" "), F.lit(1))
    number = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), F.lit(k)).cast("double")
    ring = lambda text: F.transform(F.split(text, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    rings = lines.select(run.alias("flight_run"), F.transform(F.regexp_extract_all("wkt", F.lit(r"\(([^()]*)\)"), 1), ring).alias("rings"))
    return rings.select("flight_run", F.get("rings", F.lit(0)).alias("ring"), F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))).alias("holes"))


def submissions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Reviews of candidates and of flight lines, user and line taken from ``<user>/submitted/<line>_{cid,lid}.csv``."""
    out = []
    for kind in ("cid", "lid"):
        df = spark.read.csv(f"{root}/*/submitted/*_{kind}.csv", header=True, ignoreLeadingWhiteSpace=True)
        path = F.col("_metadata.file_path")
        out.append(df.withColumns({"uid": F.regexp_extract(path, r"([^/]+)/submitted/", 1), "lid": F.regexp_extract(path, rf"([^/]+)_{kind}\.csv$", 1)}))
    return out[0], out[1]


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """(tile, label) with tile paths cut to their last three parts, and the flight line in the first of these."""
    df = spark.read.csv(path, schema="path string, label int", ignoreLeadingWhiteSpace=True)
    return df.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("tile"), "label")


def line_split(spark: SparkSession, path: str) -> DataFrame:
    """(part, lid) of a JSON file with a list of flight lines for each part."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("part", "lids")).select("part", F.explode("lids").alias("lid"))


def curated_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="name string, score double", ignoreLeadingWhiteSpace=True)


#: The columns of an exported detection list.
EXPORT = {
    "detection_id": "Candidate ID", "image_id": "Line name", "max_row": "Row", "max_col": "Column", "lat": "Plume Latitude (deg)", "lon": "Plume Longitude (deg)", "vmax": "Max score", "med": "Median score",
    "mad": "MAD score", "cmf_vmax": "Max CMF (ppmm)", "cmf_med": "Median CMF (ppmm)", "n": "Pixels",
}


def export_detections(df: DataFrame, path: str) -> None:
    """Write detections, as score_regions() gives them with maps, under the list's headers; a missing column is an error."""
    if missing := [c for c in EXPORT if c not in df.columns]:
        raise ValueError(f"detections lack {', '.join(missing)}")
    df.select(*(F.col(c).alias(n) for c, n in EXPORT.items())).write.option("header", True).csv(path)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(flag, value, decision) of a JSON map from flag to lists of accepted and rejected values."""
    df = spark.read.json(path, multiLine=True)
    parts = [df.select(F.lit(c).alias("flag"), F.explode(F.array(F.struct(F.lit("Accept").alias("d"), F.col(f"`{c}`.accept").alias("v")), F.struct(F.lit("Reject").alias("d"), F.col(f"`{c}`.reject").alias("v")))).alias("x")) for c in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("flag", F.explode("x.v").alias("value"), F.col("x.d").alias("decision"))

