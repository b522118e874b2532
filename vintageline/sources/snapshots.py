"""Versioned Parquet tables: one directory per version and a small manifest written last (SNK2, SRC8).

A version is visible only once its manifest exists, so a failed write leaves readers on the version
before. A manifest is written aside and moved to its place on the cluster's file system, which refuses the move
where another writer was first; so a version has one writer, and readers see whole manifests only.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer published the version first; the table is as that writer left it."""


MANIFEST_SCHEMA = "version bigint, sources string, columns string, data string"


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest/*")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def latest_version(spark: SparkSession, path: str) -> int | None:
    found = _manifests(spark, path)
    return None if found is None else found.agg(F.max("version")).first()[0]


def manifest_row(spark: SparkSession, path: str, version: int):
    """What the manifest of a published version says; an unknown version raises."""
    found = _manifests(spark, path)
    row = None if found is None else found.where(F.col("version") == version).first()
    if row is None:
        raise FileNotFoundError(f"table at {path} has no version {version}")
    return row


def commit_version(spark: SparkSession, path: str, version: int, sources, columns, data) -> int:
    """Publish a version whose manifest holds the given values as JSON; raises ``CommitConflict`` if it exists."""
    return _commit(spark, path, version, json.dumps(sources), json.dumps(columns), json.dumps(data))


def _commit(spark: SparkSession, path: str, version: int, sources: str, columns: str, data: str) -> int:
    row = {"version": version, "sources": sources, "columns": columns, "data": data}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pending = hadoop.Path(f"{path}/manifest/_{uuid.uuid4().hex}")
    target = hadoop.Path(f"{path}/manifest/{version}.json")
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    files = target.getFileSystem(settings)
    files.mkdirs(target.getParent())
    out = files.create(pending, False)
    try:
        out.write(bytearray(json.dumps(row).encode()))
    finally:
        out.close()
    # Readers pass over names with an underscore. Unlike a plain rename, this one fails where the target exists.
    context = hadoop.FileContext.getFileContext(files.getUri(), settings)
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(pending), files.makeQualified(target), options)
    except Py4JJavaError as problem:
        files.delete(pending, False)
        if "FileAlreadyExistsException" in str(problem.java_exception):
            raise CommitConflict(f"version {version} of {path} was published by another writer") from None
        raise
    return version


def _next_version(spark: SparkSession, path: str) -> int:
    before = latest_version(spark, path)
    return 0 if before is None else before + 1


def publish(
    frame: DataFrame,
    path: str,
    sources: Mapping[str, int] | None = None,
    partition_by: tuple[str, ...] = (),
    sort_by: tuple[str, ...] = (),
) -> int:
    """Write the frame as the next version of the table at ``path`` and return that version.

    Of several writers of one version the first to commit wins; the others raise ``CommitConflict``, and the data
    they wrote belongs to no version.
    """
    spark = frame.sparkSession
    version = _next_version(spark, path)
    data = f"{path}/data/v={version}-{uuid.uuid4().hex[:12]}"
    if sort_by:
        frame = frame.sortWithinPartitions(*partition_by, *sort_by)
    frame.write.partitionBy(*partition_by).parquet(data)
    return _commit(spark, path, version, json.dumps(dict(sources or {})), json.dumps(frame.columns), data)


def promote(
    spark: SparkSession, staging: str, staged: int, path: str, sources: Mapping[str, int] | None = None
) -> int:
    """Make a staged version the next version of the table at ``path``: its manifest names the staged
    data, which is neither read nor written again, so staged data in use must be kept."""
    row = _manifests(spark, staging).where(F.col("version") == staged).first()
    version = _next_version(spark, path)
    return _commit(spark, path, version, json.dumps(dict(sources or {})), row["columns"], row["data"])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Read one pinned version, or the newest; a version that was never published raises."""
    if version is not None and version < 0:
        raise ValueError("table versions are not negative")
    found = _manifests(spark, path)
    if found is None:
        raise FileNotFoundError(f"no published table at {path}")
    wanted = found if version is None else found.where(F.col("version") == version)
    row = wanted.orderBy(F.col("version").desc()).first()
    if row is None:
        raise FileNotFoundError(f"table at {path} has no version {version}")
    columns = json.loads(row["columns"])
    return spark.read.parquet(row["data"]).select(*columns)


def read_pinned(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest version together with its number, so that a build can record what it read."""
    version = latest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published table at {path}")
    return read_version(spark, path, version), version


def source_versions(spark: SparkSession, path: str, version: int) -> dict[str, int]:
    row = _manifests(spark, path).where(F.col("version") == version).first()
    return json.loads(row["sources"])


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors share one machine, may go without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once under the shared folder and read it back, cutting its lineage."""
    spark = frame.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(target)
    return spark.read.parquet(target)
