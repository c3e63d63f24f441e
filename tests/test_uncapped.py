"""Uncapped queries on a table larger than the caps and later than the fixed dates."""

import duckdb
import compare
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidepost.catalog import ORACLES, QUERIES

#: Posts, one an hour; every second has a URL of its own, and the largest cap is 6000.
N = 13000
WHOLE = {
    "search_posts": "search_posts_spanned",
    "standard_job": "standard_job_spanned",
    "expand_job": "expand_job_spanned",
    "fallback_fill": "fallback_fill_uncapped",
    "fallback_fill_plain": "fallback_fill_plain_uncapped",
    "stream_intake": "stream_intake_uncapped",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("large"))
    i = F.col("id")
    text = F.concat(F.lit("some plain words about a thing of number "), F.format_string("%08d", i), F.lit(" and more"))
    docs = spark.range(N).select(
        i.alias("doc_id"), F.concat(F.format_string("%08d ", i), text).alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.length(text).cast("long").alias("n_chars"),
    )
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SMALL}/pages.parquet").write.parquet(f"{at}/pages.parquet")
    # the streams look for a file of the table's name
    flat = str(tmp_path_factory.mktemp("flat"))
    import pathlib
    import shutil

    for name in ("documents", "pages"):
        part = next(pathlib.Path(at, f"{name}.parquet").glob("part-*.parquet"))
        shutil.copy(part, f"{flat}/{name}.parquet")
    return flat


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("capped", sorted(WHOLE))
def test_whole_table_is_read(spark, folder, con, capped):
    rows = QUERIES[WHOLE[capped]](spark, folder)
    columns, found = compare.spark_rows(rows)
    assert (columns, found) == compare.sql_rows(con, ORACLES[WHOLE[capped]])
    own = [r[columns.index("post_id")] for r in found]
    few = QUERIES[capped](spark, folder).select("post_id").collect()
    assert len(few) < len(own)
    assert any(N - 100 <= i < N for i in own)


def test_quota_bites(spark, folder, con):
    cut = compare.spark_rows(QUERIES["standard_job_quota"](spark, folder))
    assert cut == compare.sql_rows(con, ORACLES["standard_job_quota"])
    weeks = -(-N // 168)
    assert 0 < len(cut[1]) <= 20 * weeks < QUERIES["standard_job_spanned"](spark, folder).count()


def test_intake_reads_a_table_of_several_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = compare.spark_rows(QUERIES["stream_intake_uncapped"](spark, SMALL))
    assert wanted[1] and compare.spark_rows(QUERIES["stream_intake_uncapped"](spark, str(tmp_path))) == wanted
