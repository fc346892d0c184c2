"""Raw images as pixel tables, and checks of received files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

#: The header's data types.
KINDS = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def parse_header(text: str) -> dict:
    """The entries of an ENVI header; lists in braces, numbers as numbers."""
    import re

    out: dict = {}
    for key, value in re.findall(r"^([^=\n]+?)\s*=\s*(\{[^}]*\}|[^\n]*)", text, re.M):
        value = value.strip()
        if value.startswith("{"):
            out[key.strip().lower()] = [x.strip() for x in value[1:-1].split(",")]
        else:
            try:
                out[key.strip().lower()] = float(value) if "." in value else int(value)
            except ValueError:
                out[key.strip().lower()] = value
    return out


def map_info(values: list[str]) -> dict:
    """Projection, upper left, pixel size, zone, hemisphere and rotation of a header's map info."""
    out = {"proj": values[0], "ulx": float(values[3]), "uly": float(values[4]), "xps": float(values[5]), "yps": float(values[6]), "zone": 0, "hemi": "North", "rotation": 0.0}
    if values[0].lower() == "utm":
        out |= {"zone": int(values[7]), "hemi": values[8]}
    for v in values[7:]:
        if v.replace(" ", "").lower().startswith("rotation="):
            out["rotation"] = float(v.split("=")[1])
    return out


#: What one partition and one read of an image take at most, if a line isn't larger.
PARTITION_BYTES, READ_BYTES = 64 << 20, 8 << 20
#: Of an interleave, the axes of a stored image that are line, sample and band.
AXES = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (1, 2, 0)}


@dataclass
class Lines(InputPartition):
    """The part-th of so many runs of lines of an image; how many lines it has, only its header says, which the task reads."""

    path: str
    part: int
    parts: int
    rows: tuple[float, float]


class RawImages(DataSource):
    """``spark.read.format("raw_images").load(folder)``: (image_id, row, col, values) of raw images ``<name>`` with ``<name>.hdr``.

    Options: ``bands`` (numbers from 0, by comma), ``any_band`` (true), ``partition_bytes``. A partition is a run of lines of one image,
    which its task reads by byte ranges, chosen bands alone where the interleave allows; so an image may be of any size, and
    no image is shuffled. Filters on image_id leave images out, filters on row leave lines out. The folder may be in any
    store that pyarrow opens. On the driver, files are listed and none is opened.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_images"

    def schema(self) -> str:
        return "image_id string, row int, col int, values array<double>"

    def reader(self, schema) -> RawImageReader:
        return RawImageReader(self.options)


class RawImageReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.any_band = options.get("any_band", "true") == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.names: set | None = None
        self.rows = (0, math.inf)

    def pushFilters(self, filters: list) -> Iterator:
        """Takes those on image_id; those on row narrow the lines and are left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("image_id",) and isinstance(f, (EqualTo, In, IsNotNull)):
                if not isinstance(f, IsNotNull):
                    own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.names = own if self.names is None else self.names & own
                continue
            if getattr(f, "attribute", None) == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if not isinstance(f, (LessThan, LessThanOrEqual)) else 0
                high = f.value + (not isinstance(f, LessThan)) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else math.inf
                self.rows = (max(self.rows[0], low), min(self.rows[1], high))
            yield f

    def partitions(self) -> list[Lines]:
        files, root = FileSystem.from_uri(self.folder)
        sizes = {f.path: f.size for f in files.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File}
        found = []
        for path, size in sorted(sizes.items()):
            if f"{path}.hdr" in sizes and (self.names is None or path.rsplit("/", 1)[-1] in self.names):
                parts = -(-size // self.partition_bytes) or 1
                found += [Lines(path, k, parts, self.rows) for k in range(parts)]
        return found or [Lines("", 0, 0, self.rows)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        files, _ = FileSystem.from_uri(self.folder)
        with files.open_input_stream(f"{partition.path}.hdr") as head:
            image = _Image(parse_header(head.read().decode("utf-8", "replace")), self.bands)
        first, last = (image.lines * k // partition.parts for k in (partition.part, partition.part + 1))
        first, last = max(first, partition.rows[0]), min(last, partition.rows[1])
        name = partition.path.rsplit("/", 1)[-1]
        with files.open_input_file(partition.path) as file:
            at = first
            while at < last:
                end = int(min(last, at + image.lines_a_read))
                yield _pixels(name, at, image.read(file, at, end), image.ignore, self.any_band)
                at = end


class _Image:
    """Where a raw image's lines are, from its header, and how to read some of them."""

    def __init__(self, head: dict, bands: list[int] | None) -> None:
        self.lines, self.samples, self.n_bands = (int(head[k]) for k in ("lines", "samples", "bands"))
        self.kind = np.dtype(KINDS[int(head["data type"])]).newbyteorder(">" if head.get("byte order") else "<")
        self.interleave, self.offset, self.ignore = str(head["interleave"]).lower(), int(head.get("header offset", 0)), head.get("data ignore value", -9999)
        self.bands = bands if bands is not None else list(range(self.n_bands))
        self.lines_a_read = max(1, READ_BYTES // (self.samples * self.kind.itemsize * (len(self.bands) if self.interleave == "bsq" else self.n_bands)))

    def _values(self, file, at: int, n: int) -> np.ndarray:
        """n values from the at-th on."""
        raw = file.read_at(n * self.kind.itemsize, self.offset + at * self.kind.itemsize)
        if len(raw) < n * self.kind.itemsize:
            raise ValueError(f"an image ends before its header's {self.lines} lines")
        return np.frombuffer(raw, self.kind)

    def read(self, file, first: int, last: int) -> np.ndarray:
        """Lines first to last - 1, samples, chosen bands, as floats."""
        n, m, k = last - first, self.samples, self.n_bands
        if self.interleave == "bsq":  # a band's lines are together
            own = [self._values(file, (b * self.lines + first) * m, n * m).reshape(n, m) for b in self.bands]
            return np.stack(own, 2).astype(float)
        if self.interleave == "bil" and 4 * len(self.bands) < k:  # few bands: each line's rows of samples by themselves
            own = [[self._values(file, ((first + line) * k + b) * m, m) for b in self.bands] for line in range(n)]
            return np.array(own).transpose(0, 2, 1).astype(float)
        raw = self._values(file, first * m * k, n * m * k)
        shape = (n, m, k) if self.interleave == "bip" else (n, k, m)
        return raw.reshape(shape).transpose(AXES[self.interleave])[:, :, self.bands].astype(float)


def _pixels(name: str, first: int, part: np.ndarray, ignore: float, any_band: bool) -> pa.RecordBatch:
    """Rows of an image's lines; values are null where the ignore value is in any band, or in the last."""
    empty = ((part == ignore).any(2) if any_band else part[:, :, -1] == ignore).ravel()
    rows, cols = np.indices(part.shape[:2], dtype=np.int32)
    ends = np.append(0, np.cumsum(np.where(empty, 0, part.shape[2]))).astype(np.int32)
    offsets = pa.array(ends, mask=np.append(empty, False))  # a null offset is a null list
    values = pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1, part.shape[2])[~empty].ravel()))
    names = pa.array([name]).take(pa.array(np.zeros(len(empty), np.int32)))
    return pa.RecordBatch.from_arrays([names, pa.array(rows.ravel() + np.int32(first)), pa.array(cols.ravel()), values], names=["image_id", "row", "col", "values"])


def read_images(spark: SparkSession, path: str, bands: list[int] | None = None, any_band: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(image_id, row, col, values) of raw images ``<name>`` with headers ``<name>.hdr`` below a folder, as RawImages reads them.

    bands are picked by number from 0. A pixel whose chosen bands (any of them, or the last) hold the header's ignore value has
    null values. Registers the source, and lets the session push filters down to it.
    """
    spark.dataSource.register(RawImages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("raw_images").option("any_band", str(any_band).lower()).option("partition_bytes", partition_bytes)
    return (reader if bands is None else reader.option("bands", ",".join(map(str, bands)))).load(path)


def enhancement_pixels(images: DataFrame) -> DataFrame:
    """(image_id, row, col, r, g, b, cmf) of four-band images."""
    v = lambda n: F.get("values", F.lit(n))
    return images.select("image_id", "row", "col", v(0).alias("r"), v(1).alias("g"), v(2).alias("b"), v(3).alias("cmf"))


def band_columns(images: DataFrame, names: dict[str, int]) -> DataFrame:
    """Chosen bands as named columns."""
    return images.select("image_id", "row", "col", *(F.get("values", F.lit(k)).alias(n) for n, k in names.items()))


def granule_health(spark: SparkSession, path: str) -> DataFrame:
    """(path, messages, status) of GRIB2 files: ok, or failed where a message's length or end mark doesn't hold or the file is empty.

    Spark's readers leave empty files out, so these are taken from the listing of the folder.
    """

    def look(raw: memoryview) -> tuple[int, str]:
        at, n = 0, 0
        while at < len(raw):
            if raw[at : at + 4] != b"GRIB" or len(raw) < at + 16:
                return n, "failed"
            size = int.from_bytes(raw[at + 8 : at + 16], "big")
            if size < 20 or at + size > len(raw) or raw[at + size - 4 : at + size] != b"7777":
                return n, "failed"
            at, n = at + size, n + 1
        return n, "ok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [look(memoryview(x.as_buffer())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([s for _, s in found], pa.string())], names=["path", "messages", "status"])

    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, "path string, messages int, status string")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, empty = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while files.hasNext():
        file = files.next()
        if file.getLen() == 0:
            empty.append((file.getPath().toString(), 0, "failed"))
    return whole.unionByName(spark.createDataFrame(empty, "path string, messages int, status string"))


def write_profiles(profile: DataFrame, path: str) -> None:
    profile.write.partitionBy("image_id").mode("overwrite").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of all images, in order of the time in their names."""
    from plumery.functions.names import flight_time

    return spark.read.parquet(path).orderBy(flight_time(F.col("image_id").cast("string")), "image_id", "col")


def missing_granules(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected paths that aren't there."""
    return expected.join(present.select("path"), "path", "left_anti")
