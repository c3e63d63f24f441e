"""Readers of stored posts, checkpoints and saved pages."""

from __future__ import annotations

import csv
import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepost.schemas import CHECKPOINT, POST_JSON

log = logging.getLogger(__name__)


def read_json_posts(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = POST_JSON, lines: bool = False
) -> DataFrame:
    """Files that hold one JSON array of posts; ``lines`` reads JSON Lines, which split.

    What is not valid JSON (a file, or a line) is left out; :func:`unreadable_json` lists it.
    """
    listed = path if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema).option("multiLine", not lines)
    return reader.option("mode", "DROPMALFORMED").json(listed)


CORRUPT = "_corrupt"


def unreadable_json(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = POST_JSON, lines: bool = False
) -> DataFrame:
    """``file, rows``: how many rows of each file :func:`read_json_posts` leaves out."""
    listed = path if isinstance(path, str) else list(path)
    rows = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(listed)
        .withColumn("file", F.input_file_name())
    )
    # Spark refuses to read the corrupt column alone, so a second column is summed as 0.
    one = F.lit(1) + F.pmod(F.xxhash64(schema.fieldNames()[0]), F.lit(1))
    return rows.where(F.col(CORRUPT).isNotNull()).groupBy("file").agg(F.sum(one).alias("rows"))


def stored_count(spark: SparkSession, path: str) -> int:
    """Number of rows of a stored result, of whatever kind."""
    return read_posts(spark, [path]).count()


def read_csv_posts(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV, every column text and named by the header, line breaks in quotes.

    Columns may come in any order; only the header line is read to plan this.
    """
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def csv_header(spark: SparkSession, path: str) -> list[str] | None:
    """Column names of a headed CSV file (or of the first file of a folder); None if its first line does not tell them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(at).isDirectory():
        files = [f.getPath() for f in system.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        if not files:
            return None
        at = min(files, key=lambda f: f.getName())
    if not at.getName().endswith(".csv"):
        return None
    io = spark._jvm.java.io
    reader = io.BufferedReader(io.InputStreamReader(system.open(at), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    names = next(csv.reader([line or ""]), [])
    plain = line is not None and line.count('"') % 2 == 0 and not line.startswith("\ufeff")
    return names if plain and names and all(names) and len({n.lower() for n in names}) == len(names) else None


def read_csv_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Headed CSV files in one scan for each header that occurs, however many files share it; columns united by name."""
    same: dict[tuple[str, ...], list[str]] = {}
    parts = []
    for path in paths:
        names = csv_header(spark, path)
        if names is None:
            parts.append(read_csv_posts(spark, path))
        else:
            same.setdefault(tuple(names), []).append(path)
    for names, files in same.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        parts.append(reader.csv(files))
    return _union(parts)


def typed_posts(rows: DataFrame) -> DataFrame:
    """Stored posts in the types of the post table: times, counts, hashtag list."""
    columns = {}
    for name in ("timestamp", "scraped_at"):
        if name in rows.columns:
            columns[name] = F.try_to_timestamp(name)
    for name in ("replies", "retweets", "likes"):
        if name in rows.columns:
            columns[name] = F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint"))
    if "hashtags" in rows.columns and isinstance(rows.schema["hashtags"].dataType, T.StringType):
        columns["hashtags"] = F.from_json("hashtags", "array<string>")
    return rows.withColumns(columns)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_posts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read each path by its suffix (.json, .jsonl, .csv, .parquet); typed posts.

    A missing path or an unknown suffix is reported and skipped. CSV tables of one header
    are read together.
    """
    readers = {
        ".json": lambda s, p: read_json_posts(s, p),
        ".jsonl": lambda s, p: read_json_posts(s, p, lines=True),
        ".csv": read_csv_files,
        ".parquet": lambda s, p: s.read.parquet(*p),
    }
    grouped: dict[str, list[str]] = {}
    for path in paths:
        suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
        if suffix not in readers:
            log.warning("skipped, unknown kind of file: %s", path)
        elif not _exists(spark, path):
            log.warning("skipped, no such file: %s", path)
        else:
            grouped.setdefault(suffix, []).append(path)
    parts = [typed_posts(readers[suffix](spark, listed)) for suffix, listed in grouped.items()]
    if not parts:
        return typed_posts(spark.createDataFrame([], POST_JSON))
    return _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_result(spark: SparkSession, path: str) -> DataFrame | None:
    """One result file with the columns it has, all as text; None if it is missing, of another kind or without a readable row."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in (".json", ".jsonl", ".csv") or not _exists(spark, path):
        log.warning("skipped, no result file: %s", path)
        return None
    if suffix == ".csv":
        return read_csv_posts(spark, path)
    rows = spark.read.option("multiLine", suffix == ".json").option("mode", "DROPMALFORMED").option("primitivesAsString", True).json(path)
    if not rows.columns:
        log.warning("skipped, no rows can be read: %s", path)
        return None
    # a JSON reader knows no order of columns: alphabetical
    return rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name) for f in rows.schema])


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint files of a folder, one row each, with the ``file`` they came from.

    A file that is not valid JSON is left out.
    """
    corrupt = "_corrupt"
    schema = T.StructType([*CHECKPOINT.fields, T.StructField(corrupt, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("file", F.col("_metadata.file_name"))
        .where(F.col(corrupt).isNull())
        .drop(corrupt)
    )


def read_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Saved pages: ``page_id`` (path), ``html``, ``modified``; one row per file."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.col("path").alias("page_id"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
            F.col("modificationTime").alias("modified"),
        )
    )
