"""Registry of queries and the tables and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.functions.charclass import SPACE, WORD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def posts(spark: SparkSession, folder: str) -> DataFrame:
    return as_posts(documents(spark, folder))


def span_of(rows: DataFrame) -> tuple[str, str]:
    """First day of the posts and the day after their last."""
    span = rows.agg(F.to_date(F.min("ts")).alias("s"), F.date_add(F.to_date(F.max("ts")), 1).alias("e"))
    start, end = map(str, span.first())
    return start, end


def as_posts(docs: DataFrame) -> DataFrame:
    """``documents`` dressed as posts: tags, a mention, a link, a sentiment word."""
    i = F.col("doc_id")
    mood = F.element_at(
        F.array(*[F.lit(w) for w in MOODS]), (i % 5 + 1).cast("int")
    )
    tail = F.concat(
        F.lit(" #"), "lang", F.lit(" #"), "source", F.lit(" @u"), (i % 7).cast("string"),
        F.lit(" http://t.example/"), i.cast("string"), F.lit(" "), mood,
    )
    shared = F.when(i % 4 == 3, i).otherwise(i - i % 4)
    return docs.select(
        i.alias("post_id"),
        F.when(i % 50 == 0, F.lit(" Grok ")).otherwise(F.concat(F.lit("u"), (i % 7).cast("string"))).alias(
            "username"
        ),
        F.concat("text", tail).alias("text"),
        F.when(i % 97 != 0, F.concat(F.lit("https://p.example/"), shared.cast("string"))).alias("url"),
        F.expr("timestampadd(HOUR, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"),
        "lang",
        "source",
        (i % 4 == 0).alias("is_reply"),
        "n_chars",
    )


MOODS = ("Bagus", "korupsi", "lancar tapi rusuh", "", "Terima Kasih, sukses malu")

POSTS = """posts AS (
  SELECT doc_id AS post_id,
         CASE WHEN doc_id % 50 = 0 THEN ' Grok ' ELSE 'u' || (doc_id % 7) END AS username,
         text || ' #' || lang || ' #' || source || ' @u' || (doc_id % 7)
           || ' http://t.example/' || doc_id || ' '
           || ['Bagus','korupsi','lancar tapi rusuh','','Terima Kasih, sukses malu'][doc_id % 5 + 1] AS text,
         CASE WHEN doc_id % 97 <> 0 THEN 'https://p.example/'
           || (CASE WHEN doc_id % 4 = 3 THEN doc_id ELSE doc_id - doc_id % 4 END) END AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS ts,
         lang, source, doc_id % 4 = 0 AS is_reply, n_chars
  FROM documents)"""

#: First day of the posts and the day after their last.
SPAN = "span AS (SELECT CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) + 1 AS e FROM posts)"


def sql_clean(column: str) -> str:
    """SQL form of the text normalisation, without fonts and entities."""
    return (
        f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, "
        f"'http[^{SPACE}]+', '', 'g'), '@[{WORD}]+', '', 'g'), "
        f"'[^{WORD}{SPACE},.:;!?#\"''-]+', '', 'g'), '[{SPACE}]+', ' ', 'g')))"
    )


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_long_enough(column: str) -> str:
    return (
        "length("
        + sql_strip(f"regexp_replace({column}, 'http[^{SPACE}]+', '', 'g')")
        + ") >= 15"
    )


def sql_latin(column: str) -> str:
    return (
        f"length({column}) > 0 AND (length({column}) - length(regexp_replace({column}, "
        f"'[\\x{{0}}-\\x{{24f}}{SPACE}\\p{{Nd}}]+', '', 'g')))::DOUBLE / length({column}) > 0.8"
    )


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
