"""Versioned Parquet tables: every change writes a new version, then a pointer to it.

Pointers are numbered files that appear by a rename to a new name; readers follow the one with
the largest number, so at each moment they see a whole version or the one before. A write that
fails leaves a directory that nothing points to. One writer per table at a time: of two that
meet, the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas


POINTER = "CURRENT-"


class Table:
    """A table under ``path`` on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, name: str | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _pointers(self) -> list[str]:
        """Names of the pointers, oldest first."""
        if not self._fs.exists(self._path("")):
            return []
        return sorted(n for s in self._fs.listStatus(self._path("")) if (n := s.getPath().getName()).startswith(POINTER))

    def _pointer(self) -> tuple[str, int, str] | None:
        """(directory, schema version, tag) of the current version."""
        names = self._pointers()
        if not names:
            return None
        stream = self._fs.open(self._path(names[-1]))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        directory, version, *tag = text.rstrip("\n").split(" ", 2)
        return directory, int(version), tag[0] if tag else ""

    def version(self) -> str | None:
        """Name of the current version; changes with every write."""
        found = self._pointer()
        return found and found[0]

    def tag(self) -> str | None:
        """What the writer of the current version noted beside it."""
        found = self._pointer()
        return found and found[2]

    def read(self) -> DataFrame:
        """The current rows; columns that later schema versions added have their defaults."""
        found = self._pointer()
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.parquet(f"{self.path}/{found[0]}")
        if self.name and found[1] < schemas.VERSION:
            df = schemas.migrate(df, self.name, found[1])
        return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema])

    def write(self, df: DataFrame, schema_version: int = schemas.VERSION, tag: str = "") -> str:
        """Make the rows of ``df`` (which may read this table) the current version."""
        before = self._pointers()
        number = int(before[-1].removeprefix(POINTER)) + 1 if before else 0
        name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        keep = [c for c in df.columns if c in self.schema.names]
        df.select(*keep).write.parquet(f"{self.path}/{name}")
        fresh = self._path(f"_{name}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(f"{name} {schema_version} {tag}\n".encode()))
        out.close()
        place = self._path(f"{POINTER}{number:08d}")
        if self._fs.exists(place) or not self._fs.rename(fresh, place):
            raise OSError(f"another version of {self.path} was written meanwhile")
        return name

    def vacuum(self) -> None:
        """Remove all versions but the current one, and their pointers."""
        current = self.version()
        for name in self._pointers()[:-1]:
            self._fs.delete(self._path(name), False)
        for status in self._fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("v") and name != current:
                self._fs.delete(status.getPath(), True)
