"""The two job kinds end to end, over the posts and the saved pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.catalog.posts import KEYWORDS, sql_expand, sql_term_counts
from tidepost.catalog.registry import POSTS, SPAN, posts, register, span_of, sql_latin, sql_long_enough, table
from tidepost.catalog.state import SEARCH_ORDERED, _search_rows
from tidepost.catalog.work import ADAPTIVE, ITEMS, sql_chunks
from tidepost.functions.charclass import WORD
from tidepost.plans import jobs
from tidepost.plans.fill import concat_rows, fill_to_target
from tidepost.session import scratch_path
from tidepost.sources.readers import read_csv_posts
from tidepost.sources.writers import write_csv, write_json

START, END = "2024-01-01", "2024-09-15"


@register(
    "standard_job",
    f"""WITH {POSTS}, {SEARCH_ORDERED},
    found AS (SELECT * FROM posts WHERE NOT is_reply AND ts >= DATE '{START}' AND ts < DATE '{END}'
      AND (contains(lower(text), 'korupsi') OR contains(lower(text), 'bagus'))),
    chunked AS (SELECT *, date_diff('day', DATE '{START}', CAST(ts AS DATE)) // 7 AS chunk_idx FROM found),
    firsts AS (SELECT * FROM chunked
      QUALIFY row_number() OVER (PARTITION BY chunk_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM firsts
      WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')}),
    capped AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY chunk_idx ORDER BY post_id) <= 5000 // 37),
    uniq AS (SELECT * FROM capped WHERE coalesce(url, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY post_id) = 1),
    filled AS (SELECT 0 AS s, post_id, url, text FROM uniq UNION ALL SELECT 1, post_id, url, text FROM search)
    SELECT post_id, url, text FROM filled ORDER BY s, post_id LIMIT 5000""",
)
def standard_job(spark, folder):
    found = jobs.standard_job(
        posts(spark, folder),
        ["korupsi", "bagus"],
        START,
        END,
        5000,
        top_up=[_search_rows(spark, folder)],
    )
    return found.select("post_id", "url", "text")


@register(
    "expand_job",
    f"""WITH {POSTS}, {SEARCH_ORDERED}, source_posts AS (SELECT * FROM posts WHERE NOT is_reply AND lang = 'en'),
    {sql_expand("source_posts", KEYWORDS)},
    chunk AS (SELECT i AS chunk_idx, n, s + CAST(i * d AS INTEGER) AS chunk_start,
        least(s + CAST((i + 1) * d AS INTEGER), e) AS chunk_end
      FROM (SELECT s, e, {ADAPTIVE} AS d, unnest({sql_chunks('s', 'e', ADAPTIVE)}) AS i,
            len({sql_chunks('s', 'e', ADAPTIVE)}) AS n FROM (SELECT DATE '{START}' AS s, DATE '{END}' AS e))),
    items AS (SELECT variation_idx * n + chunk_idx AS work_idx, variation_idx, chunk_start, chunk_end FROM expanded, chunk),
    words AS (SELECT variation_idx, [lower(w) FOR w IN string_split(variation, ' ')
        IF length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')] AS words FROM expanded),
    hits AS (SELECT post_id, variation_idx FROM source_posts, words
        WHERE len(words) = 0 OR len([w FOR w IN words IF contains(lower(text), w)]) > 0),
    matches AS (SELECT p.*, i.work_idx FROM source_posts p JOIN hits h USING (post_id)
        JOIN items i ON i.variation_idx = h.variation_idx AND p.ts >= i.chunk_start AND p.ts < i.chunk_end),
    sessions AS (SELECT * FROM matches
        QUALIFY row_number() OVER (PARTITION BY work_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM sessions WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')}
        AND {sql_long_enough('text')} AND coalesce(url, '') <> ''),
    firsts AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY url ORDER BY work_idx, post_id) = 1),
    both_ AS (SELECT 0 AS s, work_idx, post_id, url FROM firsts UNION ALL SELECT 1, NULL, post_id, url FROM search),
    uniq AS (SELECT * FROM both_ WHERE coalesce(url, '') <> ''
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, work_idx NULLS FIRST, post_id) = 1)
    SELECT CAST(work_idx AS BIGINT) AS work_idx, post_id, url FROM uniq
    ORDER BY s, work_idx NULLS FIRST, post_id LIMIT 3000""",
)
def expand_job(spark, folder):
    found = jobs.expand_job(
        posts(spark, folder),
        KEYWORDS,
        START,
        END,
        asof=END,
        count=3000,
        lang="en",
        top_up=[_search_rows(spark, folder)],
    )
    return found.selectExpr("CAST(work_idx AS BIGINT) AS work_idx", "post_id", "url")


@register(
    "standard_job_undated",
    f"""WITH {POSTS},
    found AS (SELECT * FROM posts WHERE NOT is_reply
      AND (contains(lower(text), 'korupsi') OR contains(lower(text), 'bagus'))),
    firsts AS (SELECT * FROM found
      QUALIFY row_number() OVER (PARTITION BY text[1:50], length(text) ORDER BY post_id) = 1)
    SELECT post_id, url, text FROM firsts
    WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')}""",
)
def standard_job_undated(spark, folder):
    found = jobs.standard_job(posts(spark, folder), ["korupsi", "bagus"], None, None, None)
    return found.select("post_id", "url", "text")


@register(
    "expand_job_uncapped",
    f"""WITH {POSTS}, source_posts AS (SELECT * FROM posts WHERE NOT is_reply),
    {sql_expand("source_posts", KEYWORDS)},
    chunk AS (SELECT i AS chunk_idx, n, s + CAST(i * d AS INTEGER) AS chunk_start,
        least(s + CAST((i + 1) * d AS INTEGER), e) AS chunk_end
      FROM (SELECT s, e, {ADAPTIVE} AS d, unnest({sql_chunks('s', 'e', ADAPTIVE)}) AS i,
            len({sql_chunks('s', 'e', ADAPTIVE)}) AS n
            FROM (SELECT CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) + 1 AS e FROM posts))),
    items AS (SELECT variation_idx * n + chunk_idx AS work_idx, variation_idx, chunk_start, chunk_end FROM expanded, chunk),
    words AS (SELECT variation_idx, [lower(w) FOR w IN string_split(variation, ' ')
        IF length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')] AS words FROM expanded),
    hits AS (SELECT post_id, variation_idx FROM source_posts, words
        WHERE len(words) = 0 OR len([w FOR w IN words IF contains(lower(text), w)]) > 0),
    matches AS (SELECT p.*, i.work_idx FROM source_posts p JOIN hits h USING (post_id)
        JOIN items i ON i.variation_idx = h.variation_idx AND p.ts >= i.chunk_start AND p.ts < i.chunk_end),
    sessions AS (SELECT * FROM matches
        QUALIFY row_number() OVER (PARTITION BY work_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM sessions WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')}
        AND {sql_long_enough('text')} AND coalesce(url, '') <> '')
    SELECT CAST(work_idx AS BIGINT) AS work_idx, post_id, url FROM good
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY work_idx, post_id) = 1""",
)
def expand_job_uncapped(spark, folder):
    rows = posts(spark, folder)
    start, end = span_of(rows)
    found = jobs.expand_job(rows, KEYWORDS, start, end, asof=end, count=0, unlimited=True)
    return found.selectExpr("CAST(work_idx AS BIGINT) AS work_idx", "post_id", "url")


@register(
    "standard_job_spanned",
    f"""WITH {POSTS}, {SPAN}, {SEARCH_ORDERED},
    found AS (SELECT posts.*, date_diff('day', s, CAST(ts AS DATE)) // 7 AS chunk_idx FROM posts, span
      WHERE NOT is_reply AND ts >= s AND ts < e
      AND (contains(lower(text), 'korupsi') OR contains(lower(text), 'bagus'))),
    firsts AS (SELECT * FROM found
      QUALIFY row_number() OVER (PARTITION BY chunk_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM firsts
      WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')}),
    uniq AS (SELECT * FROM good WHERE coalesce(url, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY post_id) = 1)
    SELECT post_id, url, text FROM uniq UNION ALL SELECT post_id, url, text FROM search""",
)
def standard_job_spanned(spark, folder):
    rows = posts(spark, folder)
    found = jobs.standard_job(rows, ["korupsi", "bagus"], *span_of(rows), None)
    filled = fill_to_target([found, _search_rows(spark, folder)], None, ["post_id"], dedup=False)
    return filled.select("post_id", "url", "text")


# the chunks' quota, small enough that every full week has more
QUOTA = 20


@register(
    "standard_job_quota",
    f"""WITH {POSTS}, {SPAN},
    found AS (SELECT posts.*, date_diff('day', s, CAST(ts AS DATE)) // 7 AS chunk_idx FROM posts, span
      WHERE NOT is_reply AND ts >= s AND ts < e
      AND (contains(lower(text), 'korupsi') OR contains(lower(text), 'bagus'))),
    firsts AS (SELECT * FROM found
      QUALIFY row_number() OVER (PARTITION BY chunk_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM firsts
      WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')}),
    capped AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY chunk_idx ORDER BY post_id) <= {QUOTA})
    SELECT post_id, url, text FROM capped WHERE coalesce(url, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY post_id) = 1""",
)
def standard_job_quota(spark, folder):
    rows = posts(spark, folder)
    found = jobs.standard_job(rows, ["korupsi", "bagus"], *span_of(rows), None, quota=QUOTA)
    return found.select("post_id", "url", "text")


@register(
    "expand_job_spanned",
    f"""WITH {POSTS}, {SEARCH_ORDERED}, source_posts AS (SELECT * FROM posts WHERE NOT is_reply AND lang = 'en'),
    {sql_expand("source_posts", KEYWORDS)}, {SPAN},
    chunk AS (SELECT i AS chunk_idx, n, s + CAST(i * d AS INTEGER) AS chunk_start,
        least(s + CAST((i + 1) * d AS INTEGER), e) AS chunk_end
      FROM (SELECT s, e, {ADAPTIVE} AS d, unnest({sql_chunks('s', 'e', ADAPTIVE)}) AS i,
            len({sql_chunks('s', 'e', ADAPTIVE)}) AS n FROM span)),
    items AS (SELECT variation_idx * n + chunk_idx AS work_idx, variation_idx, chunk_start, chunk_end FROM expanded, chunk),
    words AS (SELECT variation_idx, [lower(w) FOR w IN string_split(variation, ' ')
        IF length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')] AS words FROM expanded),
    hits AS (SELECT post_id, variation_idx FROM source_posts, words
        WHERE len(words) = 0 OR len([w FOR w IN words IF contains(lower(text), w)]) > 0),
    matches AS (SELECT p.*, i.work_idx FROM source_posts p JOIN hits h USING (post_id)
        JOIN items i ON i.variation_idx = h.variation_idx AND p.ts >= i.chunk_start AND p.ts < i.chunk_end),
    sessions AS (SELECT * FROM matches
        QUALIFY row_number() OVER (PARTITION BY work_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM sessions WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')}
        AND {sql_long_enough('text')} AND coalesce(url, '') <> ''),
    firsts AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY url ORDER BY work_idx, post_id) = 1),
    both_ AS (SELECT 0 AS s, work_idx, post_id, url FROM firsts UNION ALL SELECT 1, NULL, post_id, url FROM search),
    uniq AS (SELECT * FROM both_ WHERE coalesce(url, '') <> ''
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, work_idx NULLS FIRST, post_id) = 1)
    SELECT CAST(work_idx AS BIGINT) AS work_idx, post_id, url FROM uniq""",
)
def expand_job_spanned(spark, folder):
    rows = posts(spark, folder)
    start, end = span_of(rows)
    found = jobs.expand_job(rows, KEYWORDS, start, end, asof=end, count=0, lang="en", unlimited=True)
    filled = fill_to_target([found, _search_rows(spark, folder)], None, ["work_idx", "post_id"])
    return filled.selectExpr("CAST(work_idx AS BIGINT) AS work_idx", "post_id", "url")


@register(
    "standard_job_odd_dates",
    f"""WITH {POSTS}, {SPAN},
    found AS (SELECT posts.*, date_diff('day', s, CAST(ts AS DATE)) // 7 AS chunk_idx FROM posts, span
      WHERE NOT is_reply AND ts >= s AND ts < e
      AND (contains(lower(text), 'korupsi') OR contains(lower(text), 'bagus'))),
    firsts AS (SELECT * FROM found
      QUALIFY row_number() OVER (PARTITION BY chunk_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM firsts
      WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')})
    SELECT post_id, url, text FROM good WHERE coalesce(url, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY post_id) = 1""",
)
def standard_job_odd_dates(spark, folder):
    """Dates without leading zeros, as people type them."""
    rows = posts(spark, folder)
    start, end = ("-".join(str(int(part)) for part in day.split("-")) for day in span_of(rows))
    return jobs.standard_job(rows, ["korupsi", "bagus"], start, end, None).select("post_id", "url", "text")


@register(
    "expand_job_undated",
    f"""WITH {POSTS}, source_posts AS (SELECT * REPLACE (CASE WHEN post_id % 13 > 0 THEN ts END AS ts) FROM posts WHERE NOT is_reply),
    {sql_expand("source_posts", KEYWORDS)},
    words AS (SELECT variation_idx, [lower(w) FOR w IN string_split(variation, ' ')
        IF length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')] AS words FROM expanded),
    matches AS (SELECT p.*, variation_idx AS work_idx FROM source_posts p, words
        WHERE len(words) = 0 OR len([w FOR w IN words IF contains(lower(text), w)]) > 0),
    sessions AS (SELECT * FROM matches
        QUALIFY row_number() OVER (PARTITION BY work_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    good AS (SELECT * FROM sessions WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')}
        AND {sql_long_enough('text')} AND coalesce(url, '') <> '')
    SELECT CAST(work_idx AS BIGINT) AS work_idx, post_id, url FROM good
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY work_idx, post_id) = 1""",
)
def expand_job_undated(spark, folder):
    """Dates that can't be read; some posts have no time. Every post is looked at."""
    rows = posts(spark, folder).withColumn("ts", F.when(F.col("post_id") % 13 > 0, F.col("ts")))
    found = jobs.expand_job(rows, KEYWORDS, "last spring", "now", asof=END, count=0, unlimited=True)
    return found.selectExpr("CAST(work_idx AS BIGINT) AS work_idx", "post_id", "url")


@register(
    "smart_job",
    f"""WITH {POSTS},
    seen AS (SELECT * FROM posts WHERE NOT is_reply AND contains(lower(text), 'korupsi')
      QUALIFY row_number() OVER (PARTITION BY text[1:50], length(text) ORDER BY post_id) = 1),
    sample AS (SELECT * FROM seen WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')}
      ORDER BY post_id LIMIT 100),
    counts AS ({sql_term_counts("sample", "post_id", f"regexp_extract_all(lower(text), '#[{WORD}]+')")}),
    tags AS (SELECT term FROM counts ORDER BY n DESC, first LIMIT 10),
    wanted AS (SELECT 'korupsi' AS term UNION ALL SELECT term FROM tags),
    found AS (SELECT * FROM posts p WHERE NOT is_reply AND EXISTS (SELECT 1 FROM wanted w WHERE contains(lower(p.text), w.term))
      QUALIFY row_number() OVER (PARTITION BY text[1:50], length(text) ORDER BY post_id) = 1)
    SELECT post_id, url, text FROM found
    WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')}""",
)
def smart_job(spark, folder):
    found = jobs.standard_job(posts(spark, folder), ["korupsi"], None, None, None, smart=100)
    return found.select("post_id", "url", "text")


QUOTA_TARGET, QUOTA_WORKERS, QUOTA_LEAST = 300, 40, 5


@register(
    "expand_job_quota",
    f"""WITH RECURSIVE {ITEMS},
    sessions AS (SELECT * FROM matches
        QUALIFY row_number() OVER (PARTITION BY work_idx, text[1:50], length(text) ORDER BY post_id) = 1),
    asked AS MATERIALIZED (SELECT post_id, url, work_idx, work_idx // {QUOTA_WORKERS} AS wave,
        row_number() OVER (PARTITION BY work_idx ORDER BY post_id) AS rn FROM sessions
        WHERE lower(trim(username)) <> 'grok' AND {sql_latin('text')} AND {sql_long_enough('text')}),
    size AS (SELECT count(*) AS n FROM items),
    run(wave, quota, urls, fresh) AS (
      SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS STRUCT(u VARCHAR, w BIGINT, p BIGINT)[])
      UNION ALL
      SELECT wave, quota, list_concat(urls, list_transform(fresh, lambda f: f.u)), fresh FROM (
        SELECT s.wave, s.quota, s.urls, coalesce((SELECT list(best) FROM (
            SELECT arg_min({{'u': a.url, 'w': a.work_idx, 'p': a.post_id}}, a.work_idx * 1000000000 + a.post_id) AS best FROM asked a
            WHERE a.wave = s.wave AND a.rn <= s.quota AND coalesce(a.url, '') <> '' AND NOT list_contains(s.urls, a.url) GROUP BY a.url)), []) AS fresh
        FROM (SELECT r.wave + 1 AS wave, r.urls, CAST(greatest({QUOTA_LEAST}, ceil(({QUOTA_TARGET} - len(r.urls)) / (n - (r.wave + 1) * {QUOTA_WORKERS}))) AS BIGINT) AS quota
          FROM run r, size WHERE (r.wave + 1) * {QUOTA_WORKERS} < n AND len(r.urls) < {QUOTA_TARGET}) s))
    SELECT f.p AS post_id, f.u AS url, f.w AS work_idx, CAST(wave AS INTEGER) AS wave FROM (SELECT wave, unnest(fresh) AS f FROM run)""",
)
def expand_job_quota(spark, folder):
    """Forty items at a time, each asked for at least five posts, until three hundred are there."""
    rows = posts(spark, folder)
    start, end = span_of(rows)
    found = jobs.expand_job_in_waves(
        rows.withColumn("is_reply", F.lit(False)), KEYWORDS, start, end, end, QUOTA_TARGET, scratch_path(spark, "waves"),
        workers=QUOTA_WORKERS, least=QUOTA_LEAST,
    )
    return found.select("post_id", "url", F.col("work_idx").cast("bigint").alias("work_idx"), "wave")


@register(
    "batch_job",
    """SELECT 'batch ' || (CAST(substr(source, 4) AS INTEGER) % 3) AS batch_id, doc_id, lang, source FROM documents
    WHERE CAST(substr(source, 4) AS INTEGER) % 3 <> 1""",
)
def batch_job(spark, folder):
    """Each source is a job with a result file; the jobs of one batch of three are not all done."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    root = scratch_path(spark, "results")
    number = F.substring("source", 4, 10).cast("int")
    kinds = {0: "csv", 1: "jsonl"}
    halves = []
    for b, r in ((b, r) for b in range(3) for r in kinds):
        rows = docs.where((number % 3 == b) & (number % 2 == r))
        (write_csv if kinds[r] == "csv" else write_json)(rows, f"{root}/b{b}r{r}.{kinds[r]}")
        halves.append((f"batch {b}", b != 1 or r == 0, f"{root}/b{b}r{r}.{kinds[r]}"))
    done = spark.createDataFrame([*halves, ("batch 9", True, f"{root}/missing.csv"), ("batch 9", True, None)], "batch_id string, done boolean, result_file string")
    merged = jobs.merge_finished_batches(spark, done, f"{root}/merged")
    parts = [read_csv_posts(spark, r.merged_file).select(F.lit(r.batch_id).alias("batch_id"), "*") for r in merged.orderBy("batch_id").collect()]
    return concat_rows(parts).select("batch_id", F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source")
