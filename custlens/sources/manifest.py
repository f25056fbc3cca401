"""Numbered versions of a small JSON document in a folder: the commit step of loads and report packs.

A version is written aside and renamed to its number, which must be free, so readers see a version whole or not
at all, and of two writers of the same number one fails.  The rename must not replace a file, as on HDFS; an object store
needs a committer with that property.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer committed the version that was to be committed."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def fs(self):
        return self.at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self.at("_manifest", f"{version:012d}.json")

    def read(self, version: int) -> dict | None:
        if not self.fs.exists(self._file(version)):
            return None
        return json.loads(self.spark.read.text(self._file(version).toString(), wholetext=True).first()[0])

    def versions(self) -> list[int]:
        if not self.fs.exists(self.at("_manifest")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.at("_manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def create(self, version: int, content: dict) -> None:
        fs, at, aside = self.fs, self._file(version), self.at("_manifest", f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(aside, at):
            fs.delete(aside, False)
            raise CommitConflict(at.toString())

    def drop(self, version: int) -> None:
        self.fs.delete(self._file(version), False)

    def folders(self, prefix: str) -> list[str]:
        return [n for n in (f.getPath().getName() for f in self.fs.listStatus(self.at())) if n.startswith(prefix)]

    def delete(self, folder: str) -> None:
        self.fs.delete(self.at(folder), True)
