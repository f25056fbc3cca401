"""Sinks (L5-L8): BI exports and report packs.

Files are written by the executors as partitioned datasets (one directory
per output); nothing is collected to the driver.  Excel workbooks and
charts of the reference are single-machine artefacts; their contents are
written as one dataset per sheet instead.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import reports as R
from .manifest import Manifest
from .schemas import CSV_OPTIONS, EXPORT_COLUMNS, EXPORT_SHORT_COLUMNS


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> str:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS)
    w.save(path)
    return path


def export_profile(P: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """The 15-column BI dataset."""
    return _write(P.select(*EXPORT_COLUMNS), path, fmt, mode)


def export_profile_short(P: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """The 12-column BI dataset of the tutorial."""
    return _write(P.select(*EXPORT_SHORT_COLUMNS), path, fmt, mode)


def report_sheets(P: DataFrame, reports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The profile, each named report and the executive summary by sheet name (titled as the reference does)."""
    return {"Customer Data": P, **{name.title()[:31]: df for name, df in reports.items()}, "Executive Summary": R.executive_summary(P)}


def custom_sheets(P: DataFrame) -> dict[str, DataFrame]:
    """Summary, top customers, at-risk customers and segment analysis."""
    return {"Summary": R.custom_summary(P), "Top Customers": R.top_by_spend(P, 20),
            "At Risk Customers": R.at_risk(P), "Segment Analysis": R.segment_engagement(P)}


def write_reports(P: DataFrame, reports: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
                  mode: str = "overwrite") -> dict[str, str]:
    """L7 as one plain dataset per sheet; ``ReportPack`` commits all of them at once."""
    folders = ["customer_data", *reports, "executive_summary"]
    return {sheet: _write(df, f"{out_dir}/{folder}", fmt, mode) for folder, (sheet, df) in zip(folders, report_sheets(P, reports).items())}


def write_custom_pack(P: DataFrame, out_dir: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """L8 as one plain dataset per sheet."""
    return {name: _write(df, f"{out_dir}/{name.lower().replace(' ', '_')}", fmt, mode)
            for name, df in custom_sheets(P).items()}


@dataclass(frozen=True)
class Sheet:
    folder: str
    fmt: str
    schema: str
    rows: int


class ReportPack:
    """A pack of sheets that appears as a whole: readers follow the last committed version.

    ``commit`` writes every sheet into a folder of its own, counts its rows in the same pass, and
    then creates the next version of the manifest.  A run that fails at any sheet leaves the last pack as it was, and its
    files are gone with the next ``keep``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._manifest = spark, path.rstrip("/"), Manifest(spark, path)

    def versions(self) -> list[int]:
        return self._manifest.versions()

    def commit(self, sheets: dict[str, DataFrame], fmt: str = "parquet") -> int:
        """Write the sheets and make them the current pack; the version's number."""
        version = max(self.versions(), default=0) + 1
        folder, done = f"pack-{uuid.uuid4().hex}", {}
        for i, (name, df) in enumerate(sheets.items()):
            seen = Observation()
            _write(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{self.path}/{folder}/{i:03d}", fmt, "errorifexists")
            done[name] = {"folder": f"{folder}/{i:03d}", "fmt": fmt, "schema": df.schema.json(), "rows": seen.get["rows"]}
        self._manifest.create(version, {"folder": folder, "sheets": done})
        return version

    def sheets(self, version: int | None = None) -> dict[str, Sheet]:
        """The sheets of a version (default: the last) by name; none before the first commit."""
        known = self.versions()
        if not known:
            return {}
        return {name: Sheet(**s) for name, s in self._manifest.read(known[-1] if version is None else version)["sheets"].items()}

    def read(self, sheet: str, version: int | None = None) -> DataFrame:
        found = self.sheets(version)[sheet]
        reader = self.spark.read.schema(StructType.fromJson(json.loads(found.schema))).format(found.fmt)
        if found.fmt == "csv":
            reader = reader.options(**CSV_OPTIONS)
        return reader.load(f"{self.path}/{found.folder}")

    def keep(self, last: int = 1) -> list[int]:
        """Remove all versions but the last ones, and files of failed runs; not while a pack is written."""
        if last < 1:
            raise ValueError("the current pack stays")
        known = self.versions()
        gone, stay = known[:-last], known[-last:]
        wanted = {self._manifest.read(v)["folder"] for v in stay}
        for v in gone:
            self._manifest.drop(v)
        for folder in self._manifest.folders("pack-"):
            if folder not in wanted:
                self._manifest.delete(folder)
        return gone
