"""Queries over date chunks, work items, quotas and request rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.catalog.posts import KEYWORDS, sql_expand
from tidepost.catalog.registry import POSTS, posts, register, span_of, table
from tidepost.functions import dates as D
from tidepost.operators import limits, rates
from tidepost.operators.discovery import expand_keywords
from tidepost.plans import work
from tidepost.session import through_table


def sql_chunks(start: str, end: str, days: str) -> str:
    """List of chunk numbers of a half-open date range."""
    return f"range(CAST(ceil(greatest(date_diff('day', {start}, {end}), 0) / ({days})) AS BIGINT))"


def sql_exploded(rows: str, key: str, start: str, end: str, days: str) -> str:
    return f"""SELECT {key}, CAST(i AS INTEGER) AS chunk_idx,
      CAST({start} + CAST(i * ({days}) AS INTEGER) AS VARCHAR) AS chunk_start,
      CAST(least({start} + CAST((i + 1) * ({days}) AS INTEGER), {end}) AS VARCHAR) AS chunk_end
    FROM (SELECT *, unnest({sql_chunks(start, end, days)}) AS i FROM {rows})"""


ADAPTIVE = "CASE WHEN date_diff('day', s, e) > 180 THEN 30 WHEN date_diff('day', s, e) > 60 THEN 14 ELSE 7 END"

CUSTOMER_SPANS = """spans AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s,
    CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1)"""


def _customer_spans(spark, folder):
    return (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(
            F.min("o_orderdate").cast("date").alias("s"),
            F.max("o_orderdate").cast("date").alias("e"),
            F.count("*").alias("n_orders"),
        )
    )


def _exploded(rows, key, chunks):
    return rows.select(key, F.explode(chunks).alias("c")).select(
        key,
        "c.chunk_idx",
        F.col("c.chunk_start").cast("string").alias("chunk_start"),
        F.col("c.chunk_end").cast("string").alias("chunk_end"),
    )


ORDER_SPANS = """spans AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % {days} AS INTEGER) AS e FROM orders)"""


def _order_spans(spark, folder, days):
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", F.col("o_orderdate").cast("date").alias("s"))
        .withColumn("e", F.date_add("s", (F.col("o_orderkey") % days).cast("int")))
    )


@register(
    "date_chunks",
    f"WITH {ORDER_SPANS.format(days=60)} {sql_exploded('spans', 'o_orderkey', 's', 'e', '7')}",
)
def date_chunks(spark, folder):
    chunks = D.date_chunks(F.col("s"), F.col("e"), 7)
    return _exploded(_order_spans(spark, folder, 60), "o_orderkey", chunks)


@register(
    "adaptive_chunks",
    f"WITH {CUSTOMER_SPANS} {sql_exploded('spans', 'o_custkey', 's', 'e', ADAPTIVE)}",
)
def adaptive_chunks(spark, folder):
    return _exploded(
        _customer_spans(spark, folder), "o_custkey", D.adaptive_chunks(F.col("s"), F.col("e"))
    )


@register(
    "weekly_chunks",
    f"""WITH {ORDER_SPANS.format(days=30)}
    {sql_exploded('(SELECT * FROM spans WHERE e > s + 7)', 'o_orderkey', 's', 'e', '7')}
    UNION ALL SELECT o_orderkey, 0, CAST(s AS VARCHAR), CAST(e AS VARCHAR) FROM spans WHERE e <= s + 7""",
)
def weekly_chunks(spark, folder):
    chunks = D.weekly_chunks_if_long(F.col("s"), F.col("e"))
    return _exploded(_order_spans(spark, folder, 30), "o_orderkey", chunks)


@register(
    "trailing_chunks",
    f"""WITH spans AS (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) - 120 AS s,
        CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1)
    {sql_exploded('spans', 'o_custkey', 's', 'e', '7')}""",
)
def trailing_chunks(spark, folder):
    return _exploded(_customer_spans(spark, folder), "o_custkey", D.trailing_chunks(F.col("e")))


@register(
    "planned_chunks",
    f"""WITH {CUSTOMER_SPANS}, t AS (SELECT o_custkey, e AS upto,
        CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 11 = 0 THEN '13/2020' ELSE CAST(s AS VARCHAR) END AS a,
        CASE WHEN o_custkey % 13 <> 0 THEN CAST(e AS VARCHAR) END AS b FROM spans),
    kinds AS (SELECT *, CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 'trailing'
        WHEN try_cast(a AS DATE) IS NULL THEN 'raw' ELSE 'given' END AS kind FROM t),
    ranges AS (SELECT o_custkey, CASE kind WHEN 'given' THEN CAST(a AS DATE) ELSE upto - 120 END AS s,
        CASE kind WHEN 'given' THEN CAST(b AS DATE) ELSE upto END AS e, kind FROM kinds WHERE kind <> 'raw')
    {sql_exploded('ranges', 'o_custkey', 's', 'e', f"CASE kind WHEN 'given' THEN {ADAPTIVE} ELSE 7 END")}
    UNION ALL SELECT o_custkey, 0, a, b FROM kinds WHERE kind = 'raw'""",
)
def planned_chunks(spark, folder):
    k = F.col("o_custkey")
    jobs = _customer_spans(spark, folder).select(
        k,
        F.col("e").alias("asof"),
        F.when(k % 7 == 0, "").when(k % 11 == 0, "13/2020").otherwise(F.col("s").cast("string")).alias("a"),
        F.when(k % 13 != 0, F.col("e").cast("string")).alias("b"),
    )
    chunks = D.planned_chunks(F.col("a"), F.col("b"), F.col("asof"))
    return _exploded(jobs, "o_custkey", chunks)


@register(
    "planned_quota",
    f"""WITH {CUSTOMER_SPANS}, n AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1),
    p AS (SELECT o_custkey, CASE o_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN n_orders * 1000 ELSE n_orders * 37 END AS count,
        len({sql_chunks('s', 'e', ADAPTIVE)}) AS n_chunks, o_custkey % 3 > 0 AS has_dates
        FROM spans JOIN n USING (o_custkey)),
    q AS (SELECT *, n_chunks * 6 AS n_items FROM p)
    SELECT o_custkey, CAST(CASE WHEN n_chunks > 0 THEN count // n_chunks END AS BIGINT) AS chunk_quota,
      CAST(CASE WHEN (count = 0 OR count >= 10000) AND has_dates THEN 200
        WHEN n_items = 0 THEN 200
        ELSE greatest(30, least(200, floor((CASE WHEN count > 0 THEN count ELSE 999999 END) * 2.5 / n_items))) END AS BIGINT) AS item_quota
    FROM q""",
)
def planned_quota(spark, folder):
    k, n = F.col("o_custkey"), F.col("n_orders")
    chunks = D.adaptive_chunks(F.col("s"), F.col("e"))
    jobs = _customer_spans(spark, folder).select(
        k,
        F.when(k % 5 == 0, 0).when(k % 5 == 1, n * 1000).otherwise(n * 37).cast("bigint").alias("count"),
        F.size(chunks).alias("n_chunks"),
        (F.size(chunks) * 6).alias("n_items"),
        (k % 3 > 0).alias("has_dates"),
    )
    return work.with_planned_quota(jobs).select("o_custkey", "chunk_quota", "item_quota")


# --- work items over the posts ---------------------------------------------------

ITEMS = f"""{POSTS}, {sql_expand("posts", KEYWORDS)},
    span AS (SELECT CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) + 1 AS e FROM posts),
    chunk AS (SELECT i AS chunk_idx, n, s + CAST(i * d AS INTEGER) AS chunk_start,
        least(s + CAST((i + 1) * d AS INTEGER), e) AS chunk_end
      FROM (SELECT s, e, {ADAPTIVE} AS d, unnest({sql_chunks('s', 'e', ADAPTIVE)}) AS i,
            len({sql_chunks('s', 'e', ADAPTIVE)}) AS n FROM span)),
    items AS (SELECT CAST(variation_idx * n + chunk_idx AS BIGINT) AS work_idx, variation_idx, variation,
        chunk_idx, chunk_start, chunk_end FROM expanded, chunk),
    words AS (SELECT variation_idx, [lower(w) FOR w IN string_split(variation, ' ')
        IF length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')] AS words FROM expanded),
    hits AS (SELECT post_id, variation_idx FROM posts, words
        WHERE len(words) = 0 OR len([w FOR w IN words IF contains(lower(text), w)]) > 0),
    matches AS (SELECT p.post_id, p.url, p.text, p.username, i.work_idx FROM posts p JOIN hits h USING (post_id)
        JOIN items i ON i.variation_idx = h.variation_idx AND p.ts >= i.chunk_start AND p.ts < i.chunk_end)"""

FIRSTS = """firsts AS (SELECT * FROM matches WHERE coalesce(url, '') <> ''
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY work_idx, post_id) = 1),
    yields AS (SELECT work_idx, fetched, coalesce(new_unique, 0) AS new_unique
        FROM (SELECT work_idx, count(*) AS fetched FROM matches GROUP BY 1)
        LEFT JOIN (SELECT work_idx, count(*) AS new_unique FROM firsts GROUP BY 1) USING (work_idx))"""

# the variations are at most this many
VARIATIONS = 60


def _items(spark, folder):
    """Work items of the expanded keywords over the whole time span of the posts."""
    rows = posts(spark, folder)
    start, end = (F.lit(d).cast("date") for d in span_of(rows))  # two dates, read once
    variations = through_table(
        expand_keywords(rows, "post_id", KEYWORDS, limit=VARIATIONS), "variations"
    )
    return rows, through_table(work.work_items(variations, D.adaptive_chunks(start, end)), "work-items")


@register(
    "work_items",
    f"""WITH {ITEMS} SELECT work_idx, variation, CAST(chunk_idx AS INTEGER) AS chunk_idx,
      CAST(chunk_start AS VARCHAR) AS chunk_start, CAST(chunk_end AS VARCHAR) AS chunk_end FROM items""",
)
def work_items(spark, folder):
    _, items = _items(spark, folder)
    return items.select(
        F.col("work_idx").cast("bigint").alias("work_idx"),
        "variation",
        "chunk_idx",
        F.col("chunk_start").cast("string").alias("chunk_start"),
        F.col("chunk_end").cast("string").alias("chunk_end"),
    )


@register(
    "match_posts",
    f"WITH {ITEMS} SELECT work_idx, post_id FROM matches",
)
def match_posts(spark, folder):
    rows, items = _items(spark, folder)
    return work.match_posts(rows, items, keep=["post_id"]).select(
        F.col("work_idx").cast("bigint").alias("work_idx"), "post_id"
    )


@register(
    "work_yield",
    f"WITH {ITEMS}, {FIRSTS} SELECT work_idx, fetched, new_unique FROM yields",
)
def work_yield(spark, folder):
    rows, items = _items(spark, folder)
    return work.work_yield(work.match_posts(rows, items, keep=["url"])).withColumn(
        "work_idx", F.col("work_idx").cast("bigint")
    )


@register(
    "first_matches",
    f"WITH {ITEMS}, {FIRSTS} SELECT work_idx, post_id, url FROM firsts",
)
def first_matches(spark, folder):
    rows, items = _items(spark, folder)
    firsts = work.first_matches(work.match_posts(rows, items, keep=["post_id", "url"]), ["post_id"])
    return firsts.select(F.col("work_idx").cast("bigint").alias("work_idx"), "post_id", "url")


@register(
    "pending_work",
    f"""WITH {ITEMS} SELECT work_idx, variation FROM items
    WHERE work_idx NOT IN (SELECT work_idx FROM matches WHERE post_id % 50 = 7)""",
)
def pending_work(spark, folder):
    rows, items = _items(spark, folder)
    done = work.match_posts(rows.where("post_id % 50 = 7"), items, keep=["post_id"])
    return work.unfinished(items, done).select(
        F.col("work_idx").cast("bigint").alias("work_idx"), "variation"
    )


@register(
    "work_from_index",
    f"""WITH {ITEMS} SELECT work_idx, variation FROM items
    WHERE work_idx >= (SELECT count(*) // 2 FROM items)""",
)
def work_from_index(spark, folder):
    _, items = _items(spark, folder)
    half = items.agg(F.floor(F.count("*") / 2)).scalar()
    return work.from_index(items, half).select(
        F.col("work_idx").cast("bigint").alias("work_idx"), "variation"
    )


TARGET = 400


@register(
    "dynamic_quota",
    f"""WITH {ITEMS}, {FIRSTS}, listed AS (SELECT work_idx, coalesce(new_unique, 0) AS brought
        FROM items LEFT JOIN yields USING (work_idx)),
    run AS (SELECT work_idx, CAST(coalesce(sum(brought) OVER (ORDER BY work_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS collected,
        CAST(row_number() OVER (ORDER BY work_idx DESC) AS INTEGER) AS items_left FROM listed)
    SELECT *, CAST(CASE WHEN {TARGET} - collected <= 0 THEN 0
      ELSE greatest(50, ceil(({TARGET} - collected) / items_left)) END AS BIGINT) AS quota FROM run""",
)
def dynamic_quota(spark, folder):
    rows, items = _items(spark, folder)
    yields = work.work_yield(work.match_posts(rows, items, keep=["url"]))
    return work.dynamic_quota(items, yields, TARGET).withColumn(
        "work_idx", F.col("work_idx").cast("bigint")
    )


@register(
    "chunk_cap",
    f"""WITH {POSTS}, c AS (SELECT post_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INTEGER) AS chunk_idx FROM posts)
    SELECT post_id, chunk_idx FROM c QUALIFY row_number() OVER (PARTITION BY chunk_idx ORDER BY post_id) <= 25""",
)
def chunk_cap(spark, folder):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = posts(spark, folder).select("post_id", F.floor(day / 7).cast("int").alias("chunk_idx"))
    return limits.quota_per_group(rows, "chunk_idx", ["post_id"], 25)


@register(
    "event_cap",
    """SELECT event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <=
      CASE event_type WHEN 'view' THEN 500 WHEN 'error' THEN 0 ELSE 90 END""",
)
def event_cap(spark, folder):
    quota = F.when(F.col("event_type") == "view", 500).when(F.col("event_type") == "error", 0).otherwise(90)
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts", quota.alias("quota"))
    return limits.quota_per_group(rows, "event_type", ["ts", "event_id"], "quota").select(
        "event_id", "event_type"
    )


# --- request rates ------------------------------------------------------------------

def sql_rate(seconds: int, keys: str = "") -> str:
    partition = f"PARTITION BY {keys} " if keys else ""
    listed = f"{keys}, " if keys else ""
    return f"""SELECT DISTINCT {listed}ts, count(*) OVER ({partition}ORDER BY ts
      RANGE BETWEEN INTERVAL '{seconds - 1}.999999 seconds' PRECEDING AND CURRENT ROW) AS requests FROM events"""


LEVEL = "CASE WHEN requests >= 25 THEN 'HOT' WHEN requests >= 20 THEN 'WARM' ELSE 'COOL' END"
COLOR = "CASE WHEN requests >= 25 THEN 'red' WHEN requests >= 20 THEN 'yellow' ELSE 'green' END"


@register(
    "rate_status",
    f"""SELECT ts, requests, {LEVEL} AS status, {COLOR} AS color,
      CAST(least(100, floor(requests / 30 * 100)) AS INTEGER) AS percent FROM ({sql_rate(3600)})""",
)
def rate_status(spark, folder):
    status = rates.rate_status(table(spark, folder, "events"), seconds=3600)
    return status.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("rate_by_type", sql_rate(60, "event_type"))
def rate_by_type(spark, folder):
    counts = rates.trailing_counts(table(spark, folder, "events"), keys=["event_type"])
    return counts.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
