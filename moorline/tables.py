"""Run directories: tables are written beside each other and published at once by a manifest; readers pin one manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

RAW = ("raw", "ingest_manifest", "cells", "link_refs", "review_decisions")


@dataclass(frozen=True)
class Snapshot:
    """The folders of all tables as one manifest names them; later publications don't change it."""

    spark: SparkSession
    version: int
    folders: dict[str, list[str]]

    def table(self, name: str) -> DataFrame:
        if not self.folders.get(name):
            raise LookupError(f"table {name} has not been written")
        return self.spark.read.parquet(*self.folders[name])

    def has(self, name: str) -> bool:
        return bool(self.folders.get(name))


class Store:
    """Tables below one folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state after a version, by default the last."""
        found = self._manifests()
        if not found:
            return Snapshot(self.spark, 0, {})
        version = version or found[-1]
        text = self.spark.read.text(f"{self.root}/manifests/{version:08d}.json", wholetext=True).first()[0]
        return Snapshot(self.spark, version, json.loads(text))

    def publish(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> Snapshot:
        """Writes tables and makes them visible together. Tables of what was ingested can be added to, never replaced."""
        barred = set(replace or {}) & set(RAW)
        if barred:
            raise ValueError(f"refusing to replace what was ingested: {sorted(barred)}")
        old = self.snapshot()
        folders = {k: list(v) for k, v in old.folders.items()}
        run = uuid.uuid4().hex
        for name, table in {**(append or {}), **(replace or {})}.items():
            path = f"{self.root}/runs/{run}/{name}"
            table.write.parquet(path)
            folders[name] = [*folders.get(name, []), path] if name in (append or {}) else [path]
        return self._commit(old.version + 1, folders)

    def clear(self, *names: str) -> Snapshot:
        """Empties derived tables."""
        if set(names) & set(RAW):
            raise ValueError("refusing to clear what was ingested")
        old = self.snapshot()
        return self._commit(old.version + 1, {k: v for k, v in old.folders.items() if k not in names})

    def _commit(self, version: int, folders: dict[str, list[str]]) -> Snapshot:
        """The manifest appears by a rename: if another publication took the version first, this one fails."""
        final, part = (self._path(f"{self.root}/manifests/{version:08d}.{x}") for x in ("json", f"{uuid.uuid4().hex}.tmp"))
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise RuntimeError(f"version {version} was published by someone else meanwhile; run again")
        return Snapshot(self.spark, version, folders)
