"""An index as tables in versioned folders: a build writes the tables that it changes, and a pointer file names, for each
table, the folder that holds it now."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burrow.schema import TABLES

#: Versions that are kept for readers which opened them.
KEPT = 3


class Store:
    """Readers keep the version that they opened; a build becomes visible at once or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        system, path = self._file("CURRENT")
        return system.exists(path)

    def versions(self) -> list[dict[str, str]]:
        """Folder by table, of the current version and those before it."""
        if not self.exists():
            return []
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])

    def _read(self, folder: str | None, name: str) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{folder}/{name}")

    def table(self, name: str) -> DataFrame:
        return self._read(next(iter(self.versions()), {}).get(name), name)

    def commit(self, tables: dict[str, DataFrame | Callable], written: Callable[[str], None] | None = None) -> str:
        """Writes the tables given, keeps the others, and then moves the pointer. A table may be a function of a reader of
        the new version; it sees the tables that come before it in the schema. ``written`` is told each table that was written."""
        new, before = f"v-{uuid.uuid4().hex[:12]}", self.versions()
        now = dict(before[0]) if before else {}
        for name in TABLES:
            if name in tables:
                rows = tables[name]
                rows = rows(lambda other: self._read(now.get(other), other)) if not isinstance(rows, DataFrame) else rows
                wanted = [x.split()[0] for x in TABLES[name].split(", ")]
                rows.select(*wanted).write.mode("overwrite").parquet(f"{self.path}/{new}/{name}")
                now[name] = new
                if written:
                    written(name)
        kept = [now, *before][:KEPT]
        self._point(json.dumps(kept))
        self._expire({folder for v in kept for folder in v.values()})
        return new

    def _point(self, text: str) -> None:
        """Replaces the pointer in one step."""
        jvm = self.spark.sparkContext._jvm
        system, new = self._file(f"CURRENT.{uuid.uuid4().hex}")
        stream = system.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, self._file("CURRENT")[1], options)

    def _expire(self, used: set[str]) -> None:
        system, home = self._file("")
        for found in system.listStatus(home):
            name = found.getPath().getName()
            if name.startswith("v-") and name not in used:
                system.delete(found.getPath(), True)


def default_path(root: str) -> str:
    return os.path.join(root, ".burrow", "index")
