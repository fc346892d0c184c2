"""Tables as versions: immutable folders of files, and one small manifest a version that names those it consists of.

A writer puts new files beside the old ones and then switches to them by one rename of a manifest, which either happens or
doesn't; a reader takes the newest manifest and reads what it names. So a reader sees a version as a whole, before a batch or after
it, and files that a version names are never changed. Versions that are no longer wanted are expired with the files only they name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The versions below a folder of any store that Spark reaches, whose renames must be atomic."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _read(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/manifests/v{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """The newest manifest: version, parts (folder by key), batches (last one of each stream); version 0 has nothing."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else {"version": 0, "parts": {}, "batches": {}, "rows": None}

    def folder(self) -> str:
        """A new folder for files of a version to come."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def switch(self, manifest: dict) -> None:
        """Make this the next version after the one it was made from; raises if another writer has been there before."""
        manifest = manifest | {"version": manifest["version"] + 1}
        name = f"v{manifest['version']:012d}.json"
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        self.fs.mkdirs(self._path(f"{self.root}/manifests"))
        out = self.fs.create(draft, True)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        target = self._path(f"{self.root}/manifests/{name}")
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            raise RuntimeError(f"version {manifest['version']} of {self.root} is there already")

    def expire(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions, and folders that none of these names. Files of a batch that hasn't switched yet
        are of no version, so this belongs to the writer, after it has."""
        numbers = self._numbers()
        wanted = {p.removeprefix(f"{self.root}/data/").split("/")[0] for n in numbers[-keep:] for p in self._read(n)["parts"].values()}
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"{self.root}/manifests/v{n:012d}.json"), False)
        data = self._path(f"{self.root}/data")
        for f in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if f.getPath().getName() not in wanted:
                self.fs.delete(f.getPath(), True)

    def read(self, schema: str | None = None, keys: list[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of the newest version, or of a manifest's, of all parts or some. schema is for a version without any file."""
        manifest = manifest or self.current()
        parts = [p for k, p in sorted(manifest["parts"].items()) if keys is None or k in keys]
        kind = schema or manifest["rows"]
        return self.spark.read.schema(kind).parquet(*parts) if parts else self.spark.createDataFrame([], kind)
