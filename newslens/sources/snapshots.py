"""Report tables that appear together.

A snapshot is a version folder with one table per part, and a manifest row that is
written last, by one task through Spark's commit protocol.  Readers go by the
manifest: until its row is there, the version before it is the current one, whatever
parts have been written, so a reader never meets one report of today beside another of yesterday.
A failed publication leaves a folder that no manifest row names; `drop_old` removes it.

Folders: `versions/<token>/<part>` and `manifest/v=N` with (version, token, at, parts).  One
publisher at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version int, token string, at string, parts array<string>"


def versions(spark: SparkSession, path: str) -> list[Row]:
    """The manifest rows, latest first; one small row per publication that is kept."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest/*").orderBy(F.col("version").desc()).collect()
    except AnalysisException as e:
        if (e.getCondition() or "") != "PATH_NOT_FOUND":
            raise
        return []


def publish(spark: SparkSession, path: str, at: str, parts: Mapping[str, DataFrame]) -> int:
    """Write all parts (JSON lines, UTF-8) as one new version; its number."""
    if bad := [p for p in parts if not p or "/" in p or p.startswith(("_", "."))]:
        raise ValueError(f"no names of parts: {bad}")
    known = versions(spark, path)
    version, token = (known[0].version + 1 if known else 1), uuid.uuid4().hex
    for name, df in parts.items():
        df.write.option("encoding", "UTF-8").json(f"{path}/versions/{token}/{name}")
    row = spark.createDataFrame([(version, token, at, list(parts))], MANIFEST)
    row.coalesce(1).write.json(f"{path}/manifest/v={version}")
    return version


def read_part(spark: SparkSession, path: str, part: str, schema: str, version: int | None = None) -> DataFrame:
    """A part of the current version, or of an older one that is kept."""
    known = [v for v in versions(spark, path) if version in (None, v.version)]
    if not known or part not in known[0].parts:
        raise LookupError(f"{path} has no {part!r}" + ("" if version is None else f" in version {version}"))
    return spark.read.schema(schema).json(f"{path}/versions/{known[0].token}/{part}")


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the latest versions, manifest rows first, and what failed publications have left.

    Not while one is being published.
    """
    known = versions(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in known[keep:]:
        files.delete(folder(f"{path}/manifest/v={v.version}"), True)
    kept = {v.token for v in known[:keep]}
    if files.exists(folder(f"{path}/versions")):
        for status in files.listStatus(folder(f"{path}/versions")):
            if status.getPath().getName() not in kept:
                files.delete(status.getPath(), True)
