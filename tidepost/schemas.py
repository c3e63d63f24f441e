"""Fixed schemas of the tables the operators read and write."""

from pyspark.sql import types as T

POST = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_clean", T.StringType()),
        T.StructField("hashtags", T.ArrayType(T.StringType())),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("url", T.StringType()),
        T.StructField("replies", T.LongType()),
        T.StructField("retweets", T.LongType()),
        T.StructField("likes", T.LongType()),
        T.StructField("scraped_at", T.TimestampType()),
    ]
)

# Posts as stored in JSON: times as text.
POST_JSON = T.StructType(
    [
        T.StructField(
            f.name,
            T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType,
        )
        for f in POST
    ]
)

SEARCH_ROW = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

CHECKPOINT = T.StructType(
    [
        T.StructField("base_keyword", T.StringType()),
        T.StructField("variations", T.ArrayType(T.StringType())),
        T.StructField("date_chunks", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("all_tweets", T.ArrayType(POST_JSON)),
        T.StructField("seen_urls", T.ArrayType(T.StringType())),
        T.StructField("current_chunk_idx", T.LongType()),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("worker_mode", T.LongType()),
        T.StructField("saved_at", T.StringType()),
    ]
)

JOB_UPDATE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("target_count", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.StringType()),
        T.StructField("result_file", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("worker_mode", T.IntegerType()),
        T.StructField("cancel_requested", T.BooleanType()),
        T.StructField("removed", T.BooleanType()),
    ]
)
