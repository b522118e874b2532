"""Raw text to the append-only Bronze table (SRC2-SRC7, SNK1)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.functions.columns import carry, unfold
from vintageline.sources.contract import (
    DEFAULT_WIDTH,
    DELIMITER,
    SUPPORTED_WIDTHS,
    ContractError,
    fields_of_width,
    raw_schema,
)
from vintageline.sources.snapshots import materialize


PROVENANCE = (
    T.StructField("_source_path", T.StringType()),
    T.StructField("_source_sha256", T.StringType()),
    T.StructField("_source_field_count", T.IntegerType()),
    T.StructField("_ingested_at", T.TimestampType()),
    T.StructField("_source_file", T.StringType()),
)


KNOWN_FOLDER = "_files"
KNOWN_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("rows", T.LongType()),
    ]
)
# New files named to the readers one by one.
MOST_LISTED = 10_000


@dataclass(frozen=True)
class IngestResult:
    files_ingested: int
    files_skipped: int
    rows_written: int
    final_rows: int


def plain_path(uri: Column) -> Column:
    """A file's path without URI escapes; a plus sign stands for itself in paths."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _file_name() -> Column:
    """Name of the file at column path; one delivered in parts under ``quarter=<q>/`` is ``<q>.csv``."""
    quarter = F.regexp_extract("path", r"/quarter=([^/]+)/[^/]+$", 1)
    return F.when(quarter != "", F.concat(quarter, F.lit(".csv"))).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))


def _in_parts() -> Column:
    """Whether the file at column path is a part of one delivered under ``quarter=<q>/``."""
    return F.col("path").rlike(r"/quarter=[^/]+/[^/]+$")


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, file_name, size and modification time of every file, empty ones included; no content is read.

    The reader leaves out empty files. Only where its file index, which is on the driver in any case, has more files
    than it lists are the index's names sent back to find them.
    """
    found = spark.read.format("binaryFile").load(list(paths))
    uri = F.col("_metadata.file_path")
    listed = found.select(
        plain_path(uri).alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        uri.alias("uri"),
    )
    indexed = found.inputFiles()
    if len(indexed) > listed.count():
        every = spark.createDataFrame([(uri,) for uri in indexed], "uri string")
        # The index writes file:/// where the metadata column writes file:/.
        every = every.select(plain_path(F.regexp_replace("uri", "^file:/+", "file:/")).alias("path"), "uri")
        empty = every.join(listed, "path", "left_anti")
        listed = listed.unionByName(empty.withColumns({"size": F.lit(0), "modified": F.lit(None)}))
    return listed.withColumn("file_name", _file_name())


def scan_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file: path, the readers' name of it, file name, line counts by width, and a content fingerprint (SRC4, SRC6).

    The fingerprint is computed from the lines by all tasks: count, total length, and the xor and sum
    of line hashes. Sum and count keep repeated lines from cancelling in the xor. Files without a line
    have no row.
    """
    width = F.size(F.split("value", "\\" + DELIMITER, -1))
    line_hash = F.xxhash64("value")
    per_width = (
        spark.read.text(list(paths))
        .select(F.col("_metadata.file_path").alias("uri"), width.alias("width"), "value")
        .groupBy("uri", "width")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length("value")).alias("chars"),
            F.bit_xor(line_hash).alias("mixed"),
            F.sum(line_hash.cast("decimal(38,0)")).alias("total"),
        )
    )
    # Paths are decoded once per file and width, not per line.
    return per_width.groupBy(plain_path(F.col("uri")).alias("path")).agg(
        F.first("uri").alias("uri"),
        F.array_sort(F.collect_list(F.struct("width", "n"))).alias("widths"),
        F.sum("n").alias("line_count"),
        F.sha2(
            F.concat_ws(
                "|",
                F.sum("n").cast("string"),
                F.sum("chars").cast("string"),
                F.bit_xor("mixed").cast("string"),
                F.sum("total").cast("string"),
            ),
            256,
        ).alias("fingerprint"),
    ).withColumn("file_name", _file_name())


def read_raw(
    spark: SparkSession, paths: Sequence[str], width: int = DEFAULT_WIDTH, mode: str = "FAILFAST"
) -> DataFrame:
    """Headerless delimited text with the contract's all-text schema; a malformed line fails the job.

    Quoting is off because the format has none: a stray quote must not swallow a delimiter.
    """
    return (
        spark.read.schema(raw_schema(width))
        .option("sep", DELIMITER)
        .option("header", "false")
        .option("quote", "")
        .option("mode", mode)
        .csv(list(paths))
    )


def with_provenance(
    raw: DataFrame, files: DataFrame, width: int, ingested_at: datetime
) -> DataFrame:
    """Rows of the listed files, with source name, path, fingerprint, width and load time (SRC3).

    A task's rows come ordered by source name, as a write by source name needs them. The fields are one value until
    then, and the path of a row is compared as the readers give it, so that it is not decoded per line.
    """
    known = files.select(
        "uri",
        F.col("path").alias("_source_path"),
        F.col("file_name").alias("_source_file"),
        F.col("fingerprint").alias("_source_sha256"),
    )
    narrow, fields = carry(raw.withColumn("uri", F.col("_metadata.file_path")), ("uri",))
    rows = narrow.join(known, "uri").drop("uri").sortWithinPartitions("_source_file")
    return unfold(rows, fields, raw.columns).withColumns(
        {
            "_source_field_count": F.lit(width),
            "_ingested_at": F.lit(ingested_at).cast("timestamp"),
        }
    )


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """The Bronze table with the columns of the widest file layout; a missing table raises (SRC7).

    Narrower files leave the columns that they lack NULL, in whatever order the files were loaded.
    """
    schema = T.StructType([*raw_schema(max(SUPPORTED_WIDTHS)).fields, *PROVENANCE])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"no Bronze table at {path}") from problem
        raise


def known_files(spark: SparkSession, bronze_path: str) -> DataFrame | None:
    """What ingest has learnt of files: path, size, modified, file_name, fingerprint and the rows they brought."""
    try:
        return spark.read.schema(KNOWN_FILES).parquet(f"{bronze_path}/{KNOWN_FOLDER}")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def unread_files(listed: DataFrame, known: DataFrame | None) -> DataFrame:
    """Listed files that were never read as they are now, by path, size and time of modification."""
    if known is None:
        return listed
    return listed.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def unseen_files(files: DataFrame, bronze: DataFrame | None, names: Sequence[str] | None = None) -> DataFrame:
    """Files whose (name, fingerprint) is not in Bronze yet (SRC5); ``names`` prunes Bronze to their folders."""
    if bronze is None:
        return files
    if names is not None:
        bronze = bronze.where(F.col("_source_file").isin(list(names)))
    seen = bronze.select(
        F.col("_source_file").alias("file_name"), F.col("_source_sha256").alias("fingerprint")
    ).distinct()
    return files.join(seen, ["file_name", "fingerprint"], "left_anti")


def require_widths(files: DataFrame, width: int) -> None:
    """Refuse any file with a line whose field count is not the declared one."""
    wrong = F.filter("widths", lambda w: w.width != width)
    row = files.select("file_name", wrong.alias("wrong")).where(F.size("wrong") > 0).first()
    if row:
        found = [(w.width, w.n) for w in row.wrong]
        raise ContractError(f"{row.file_name}: lines of (width, count) {found}, expected {width} fields")


def require_lines(listed: DataFrame) -> None:
    """Refuse an empty file, by its path; of a file in parts, one part with content is enough."""
    whole = F.when(_in_parts(), F.regexp_extract("path", "^(.*)/[^/]+$", 1)).otherwise(F.col("path"))
    empty = listed.groupBy(whole.alias("whole")).agg(F.max("size").alias("most")).where("most = 0")
    found = [r.whole for r in empty.limit(5).collect()]
    if found:
        raise ContractError(f"no lines in {found}")


def ingest(
    spark: SparkSession,
    paths: Sequence[str],
    bronze_path: str,
    width: int = DEFAULT_WIDTH,
    ingested_at: datetime | None = None,
) -> IngestResult:
    """Append the files not yet in Bronze; an exact replay is skipped (SNK1).

    A table beside Bronze holds path, size, modification time and fingerprint of every file that was read. A listing
    without content tells which files are new to it, and only those are scanned and loaded, so a delivery costs its own
    bytes however large the archive is. Bronze stays the witness of what is loaded: new files are looked up in
    their own folders of it, so a call that stopped between the two writes is made good by the next one.

    Only counts, examples of faults and the new files' paths reach the driver; with over ``MOST_LISTED`` of them the
    paths are read as a whole instead and joined.
    """
    if not paths:
        raise ValueError("at least one source path is needed")
    fields_of_width(width)
    listed = materialize(list_files(spark, paths), "ingest-listed")
    require_lines(listed)
    known = known_files(spark, bronze_path)
    unread = unread_files(listed, known).where("size > 0")
    fresh = [r.path for r in unread.select("path").limit(MOST_LISTED + 1).collect()]
    before = 0 if known is None else known.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    names = listed.select("file_name").distinct().count()
    if not fresh:
        return IngestResult(0, names, 0, before)
    few = len(fresh) <= MOST_LISTED
    scanned = scan_files(spark, _readable(fresh) if few else paths)
    files = materialize(scanned.join(unread.select("path", "size", "modified"), "path"), "ingest-files")
    try:
        bronze = read_bronze(spark, bronze_path)
    except FileNotFoundError:
        bronze = None
    new_names = [r.file_name for r in files.select("file_name").distinct().collect()] if few else None
    # The same content under two paths is loaded once in a call; equal parts of one file are all its own.
    one = F.when(_in_parts(), F.col("path"))
    first = F.min(F.struct("path", "uri", "widths", "line_count", "size", "modified")).alias("first")
    new = unseen_files(files, bronze, new_names).groupBy("file_name", "fingerprint", one.alias("part")).agg(first)
    load = materialize(new.select("file_name", "fingerprint", "first.*"), "ingest-load")
    require_widths(load, width)
    loaded, rows = load.agg(F.count_distinct("file_name"), F.coalesce(F.sum("line_count"), F.lit(0))).first()
    if loaded:
        # Every file to load has the right width by now; a line that has changed since fails the job.
        chosen = [r.path for r in load.select("path").collect()] if few else list(paths)
        raw = read_raw(spark, _readable(chosen) if few else chosen, width, "FAILFAST" if few else "PERMISSIVE")
        with_provenance(raw, load, width, ingested_at or datetime.now(UTC)).write.mode(
            "append"
        ).partitionBy("_source_file").parquet(bronze_path)
    _remember(files, load, known, bronze_path)
    return IngestResult(loaded, names - loaded, rows, _noted_rows(spark, bronze_path))


def _readable(paths: Sequence[str]) -> list[str]:
    """Paths, without URI escapes, that name one file each: what a glob would read as a pattern is escaped."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in paths]


def _remember(files: DataFrame, load: DataFrame, known: DataFrame | None, bronze_path: str) -> None:
    """Note the files read. Content already noted under another path brings no rows of its own."""
    noted = files.join(load.select("path", F.lit(True).alias("is_new")), "path", "left")
    if known is None:
        brought = F.lit(True)
    else:
        seen = known.where("rows > 0").select("file_name", "fingerprint", F.lit(True).alias("is_noted")).distinct()
        noted = noted.join(seen, ["file_name", "fingerprint"], "left")
        brought = F.col("is_noted").isNull()
    # Content that Bronze has but no note brought its rows in a call that stopped before its note.
    lead = Window.partitionBy("file_name", "fingerprint").orderBy(F.col("is_new").desc_nulls_last(), "path")
    first = F.row_number().over(lead) == 1
    rows = F.when(F.col("is_new") | (brought & first), F.col("line_count")).otherwise(0)
    noted.withColumn("rows", rows).select(*KNOWN_FILES.fieldNames()).coalesce(1).write.mode("append").parquet(
        f"{bronze_path}/{KNOWN_FOLDER}"
    )


def _noted_rows(spark: SparkSession, bronze_path: str) -> int:
    return known_files(spark, bronze_path).agg(F.sum("rows")).first()[0]
