"""Writers of result tables. None of them writes over the path it reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_ready(rows: DataFrame) -> DataFrame:
    """Lists and structs become JSON text, which CSV can hold."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return rows.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, UTF-8, NULL fields kept."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(
    rows: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Headed CSV of the given columns, all in table order if not given."""
    chosen = rows.select(*columns) if columns else rows
    (
        csv_ready(chosen)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_csv_sorted(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headed CSV with the columns in alphabetical order."""
    write_csv(rows, path, sorted(rows.columns), mode)


def write_json_and_csv(rows: DataFrame, json_path: str, csv_path: str) -> None:
    """Both files off one evaluation."""
    kept = rows.persist()
    try:
        write_json(kept, json_path)
        write_csv(kept, csv_path)
    finally:
        kept.unpersist()
