"""Queries over post text: scalars, filters, dedup, frequencies, sentiment, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.catalog.registry import (
    POSTS,
    SPAN,
    documents,
    posts,
    register,
    span_of,
    sql_clean,
    sql_latin,
    sql_list,
    sql_long_enough,
    sql_strip,
    table,
)
from tidepost.catalog.topic_queries import TOKENS
from tidepost.functions import fixed_values as V
from tidepost.functions import predicates as P
from tidepost.functions import text as X
from tidepost.functions.charclass import SPACE, WORD
from tidepost.operators import dedup, discovery, pages, ranking, sentiment, topics
from tidepost.plans import jobs

STOP = sql_list(V.CONTEXT_STOPWORDS)
W_ONE = f"[{WORD}]+"

FIRST_BY_PREFIX = """SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY text[1:50], length(text) ORDER BY {key}) AS rn
    FROM {rows} WHERE text IS NOT NULL) WHERE rn = 1"""


def sql_term_counts(rows: str, key: str, terms: str, where: str = "TRUE") -> str:
    """``term, n, key, pos`` of every term of ``rows``."""
    return f"""SELECT term, count(*) AS n, min((key, pos)) AS first FROM (
      SELECT {key} AS key, unnest(terms) AS term, unnest(range(len(terms))) AS pos
      FROM (SELECT {key}, {terms} AS terms FROM {rows})) WHERE {where} GROUP BY term"""


# --- top words: the smallest whole job -------------------------------------

@register(
    "top_words",
    f"""WITH firsts AS ({FIRST_BY_PREFIX.format(key="doc_id", rows="documents")}),
    good AS (SELECT doc_id, {sql_clean("text")} AS text FROM firsts
             WHERE {sql_latin("text")} AND {sql_long_enough("text")}),
    counts AS ({sql_term_counts("good", "doc_id", f"regexp_extract_all(lower(text), '{W_ONE}')")})
    SELECT CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank, term AS word, n
    FROM counts ORDER BY rank LIMIT 20""",
)
def top_words(spark, folder):
    clean = jobs.readable(documents(spark, folder), order=["doc_id"]).withColumn(
        "text", X.clean_text(F.col("text"))
    )
    tokens = ranking.explode_terms(clean, X.words(F.col("text")), F.col("doc_id"))
    ranked = ranking.with_rank(ranking.top_terms(ranking.term_counts(tokens), 20))
    return ranked.select("rank", F.col("term").alias("word"), "n")


# --- scalars -----------------------------------------------------------------

@register(
    "clean_text",
    f"WITH {POSTS} SELECT post_id, {sql_clean('text')} AS text_clean FROM posts",
)
def clean_text(spark, folder):
    return posts(spark, folder).select("post_id", X.clean_text(F.col("text")).alias("text_clean"))


BOLD = "".join(styled for styled, _ in X.BOLD_LETTERS)
BOLD_PLAIN = "".join(plain for _, plain in X.BOLD_LETTERS)
ALL_STYLED = "".join(styled for styled, _ in X.STYLED_CHARACTERS)
ALL_PLAIN = "".join(plain for _, plain in X.STYLED_CHARACTERS)
WIDE = "".join(styled for styled, _ in X.STYLED_CHARACTERS[6:])


@register(
    "font_fold",
    f"""WITH styled AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0
          THEN translate(text, '{BOLD_PLAIN}', '{BOLD}')
          ELSE translate(text, '{BOLD_PLAIN}', '{WIDE}') END AS text FROM documents)
    SELECT doc_id, translate(text, '{BOLD}', '{BOLD_PLAIN}') AS folded,
           translate(text, '{ALL_STYLED}', '{ALL_PLAIN}') AS folded_all FROM styled""",
)
def font_fold(spark, folder):
    styled = documents(spark, folder).select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.translate("text", BOLD_PLAIN, BOLD))
        .otherwise(F.translate("text", BOLD_PLAIN, WIDE))
        .alias("text"),
    )
    return styled.select(
        "doc_id",
        X.fold_fonts(F.col("text")).alias("folded"),
        X.fold_fonts(F.col("text"), extended=True).alias("folded_all"),
    )


@register(
    "entity_decode",
    """SELECT page_id, regexp_replace(replace(replace(replace(html, '&copy;', '©'),
         '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS decoded FROM pages""",
)
def entity_decode(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.decode_entities(F.col("html")).alias("decoded")
    )


@register(
    "hashtags",
    f"""WITH {POSTS} SELECT post_id,
        array_to_string(regexp_extract_all(text, '#{W_ONE}'), ' ') AS tags,
        array_to_string(regexp_extract_all(lower(text), '#{W_ONE}'), ' ') AS tags_lower,
        'https://x.example/' || username AS profile,
        coalesce(url, 'https://x.example/' || username) AS link FROM posts""",
)
def hashtags(spark, folder):
    text = F.col("text")
    profile = F.concat(F.lit("https://x.example/"), "username")
    return posts(spark, folder).select(
        "post_id",
        F.array_join(X.hashtags(text), " ").alias("tags"),
        F.array_join(X.hashtags(text, lower=True), " ").alias("tags_lower"),
        profile.alias("profile"),
        X.permalink_of(F.col("url"), X.username_of(profile), "https://x.example/").alias("link"),
    )


LABELS = """labels_of AS (SELECT doc_id, CASE doc_id % 10
    WHEN 0 THEN n_chars || ' replies' WHEN 1 THEN '1,' || lpad((n_chars % 1000)::VARCHAR, 3, '0') || ' likes'
    WHEN 2 THEN n_chars || 'K' WHEN 3 THEN (n_chars % 90) || '.' || (n_chars % 10) || 'K views'
    WHEN 4 THEN (n_chars % 7) || 'M x' WHEN 5 THEN 'Reply' WHEN 6 THEN '' WHEN 7 THEN NULL
    WHEN 8 THEN '  ' || n_chars || chr(9) || 'likes' ELSE n_chars || 'KM' END AS label FROM documents)"""


def sql_parse_count(label: str, point: bool = False) -> str:
    first = f"string_split_regex({sql_strip(label)}, '[{SPACE}]+')[1]"
    digits = f"regexp_replace({first}, '[,.]', '', 'g')"
    source = f"replace({first}, ',', '')" if point else digits
    bare = (
        f"CASE WHEN contains({digits}, 'K') THEN replace({source}, 'K', '') "
        f"WHEN contains({digits}, 'M') THEN replace({source}, 'M', '') ELSE {digits} END"
    )
    scale = f"CASE WHEN contains({digits}, 'K') THEN 1000 WHEN contains({digits}, 'M') THEN 1000000 ELSE 1 END"
    return (
        f"coalesce(CASE WHEN regexp_matches({bare}, '^[+-]?[0-9]+([.][0-9]+)?$') "
        f"THEN CAST(floor(CAST({bare} AS DECIMAL(24,6)) * ({scale})) AS BIGINT) END, 0)"
    )


def _labels(spark, folder):
    n, k = F.col("n_chars"), F.col("doc_id") % 10
    s = n.cast("string")
    label = (
        F.when(k == 0, F.concat(s, F.lit(" replies")))
        .when(k == 1, F.concat(F.lit("1,"), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(" likes")))
        .when(k == 2, F.concat(s, F.lit("K")))
        .when(k == 3, F.concat((n % 90).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("K views")))
        .when(k == 4, F.concat((n % 7).cast("string"), F.lit("M x")))
        .when(k == 5, "Reply")
        .when(k == 6, "")
        .when(k == 8, F.concat(F.lit("  "), s, F.lit("\tlikes")))
        .when(k == 9, F.concat(s, F.lit("KM")))
    )
    return documents(spark, folder).select("doc_id", "n_chars", label.alias("label"))


@register(
    "parse_metric",
    f"""WITH {LABELS} SELECT doc_id, {sql_parse_count('label')} AS count,
        {sql_parse_count('label', True)} AS count_point FROM labels_of""",
)
def parse_metric(spark, folder):
    label = F.col("label")
    return _labels(spark, folder).select(
        "doc_id",
        X.parse_count(label).alias("count"),
        X.parse_count(label, decimal_point=True).alias("count_point"),
    )


@register(
    "metric_fallback",
    f"""WITH {LABELS}, counted AS (SELECT l.*, d.n_chars, {sql_parse_count('label')} AS c
        FROM labels_of l JOIN documents d USING (doc_id))
    SELECT doc_id, CASE WHEN use THEN n_chars ELSE c END AS replies,
           CASE WHEN use THEN 7 ELSE c END AS retweets,
           CASE WHEN use THEN 3000 ELSE 0 END AS likes
    FROM (SELECT *, c = 0 AND doc_id % 3 > 0 AS use FROM counted)""",
)
def metric_fallback(spark, folder):
    labels = [F.concat(F.col("n_chars").cast("string"), F.lit(" a")), F.lit("7 b"), F.lit("3K c")]
    group = F.when(F.col("doc_id") % 3 > 0, F.array(*labels, F.lit("9 d"))).otherwise(F.array(*labels))
    count = X.parse_count(F.col("label"))
    return (
        _labels(spark, folder)
        .withColumns({"group": group, "count": count})
        .select(
            "doc_id",
            *X.with_fallback_counts(
                [F.col("count"), F.col("count"), F.lit(0).cast("bigint")], F.col("group")
            ),
        )
    )


@register(
    "keyword_forms",
    f"""WITH raw AS (SELECT doc_id, source || ' , ' || lang || ' news 2024,, ' || (doc_id % 9) AS raw,
          CASE WHEN doc_id % 4 = 0 THEN '#' || lang ELSE lang || ' ' || source || repeat(' more', doc_id % 3) END AS kw
          FROM documents),
    cut AS (SELECT *, [trim(x) FOR x IN string_split(raw, ',') IF trim(x) <> ''] AS list FROM raw)
    SELECT doc_id, array_to_string(list, ' OR ') AS joined,
      CASE WHEN kw NOT LIKE '#%' THEN '#' || replace(kw, ' ', '') END AS tag_form,
      CASE WHEN kw NOT LIKE '#%' AND doc_id % 3 = 0 THEN 'berita ' || kw || '|update ' || kw ELSE '' END AS prefixed,
      array_to_string([w FOR w IN string_split(list[2], ' ') IF length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')], '|') AS words,
      replace(url_encode(raw || ' ~*é#'), '%20', '+') AS encoded,
      lower(replace(replace('>> ' || kw || ' (Auto)', '>> ', ''), ' (Auto)', '')) AS plain
    FROM cut""",
)
def keyword_forms(spark, folder):
    i = F.col("doc_id")
    raw = F.concat("source", F.lit(" , "), "lang", F.lit(" news 2024,, "), (i % 9).cast("string"))
    keyword = F.when(i % 4 == 0, F.concat(F.lit("#"), "lang")).otherwise(
        F.concat("lang", F.lit(" "), "source", F.repeat(F.lit(" more"), (i % 3).cast("int")))
    )
    listed = X.split_keywords(F.col("raw"))
    return (
        documents(spark, folder)
        .select("doc_id", raw.alias("raw"), keyword.alias("kw"))
        .select(
            "doc_id",
            X.join_keywords(listed).alias("joined"),
            X.hashtag_form(F.col("kw")).alias("tag_form"),
            F.array_join(X.prefixed_forms(F.col("kw")), "|").alias("prefixed"),
            F.array_join(X.filter_words(listed[1]), "|").alias("words"),
            X.form_encode(F.concat("raw", F.lit(" ~*é#"))).alias("encoded"),
            X.job_keyword(
                F.concat(F.lit(">> "), "kw", F.lit(" (Auto)")), (">> ", " (Auto)")
            ).alias("plain"),
        )
    )


# --- filters -----------------------------------------------------------------

MIXED = """mixed AS (SELECT doc_id, text || repeat(['한','漢','カ','ع','Ω'][doc_id % 5 + 1],
    CAST(n_chars * (doc_id % 7) // 20 AS INTEGER)) AS text FROM documents)"""


def _mixed(spark, folder):
    i = F.col("doc_id")
    letter = F.element_at(F.array(*map(F.lit, "한漢カعΩ")), (i % 5 + 1).cast("int"))
    times = F.floor(F.col("n_chars") * (i % 7) / 20).cast("int")
    return documents(spark, folder).select(
        "doc_id", F.concat("text", F.repeat(letter, times)).alias("text")
    )


@register("latin_filter", f"WITH {MIXED} SELECT doc_id FROM mixed WHERE {sql_latin('text')}")
def latin_filter(spark, folder):
    return _mixed(spark, folder).where(P.mostly_latin(F.col("text"))).select("doc_id")


@register(
    "script_filter",
    f"""WITH {MIXED}, counted AS (SELECT doc_id,
        length(text) - length(regexp_replace(text, '[\\x{{0}}-\\x{{24f}}{SPACE}\\p{{Nd}}]+', '', 'g')) AS latin,
        length(text) - length(regexp_replace(text, '[\\x{{ac00}}-\\x{{d7af}}\\x{{1100}}-\\x{{11ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{600}}-\\x{{65f}}\\x{{66a}}-\\x{{6ef}}\\x{{6fa}}-\\x{{6ff}}]+', '', 'g')) AS foreign_n
        FROM mixed WHERE length(text) > 0)
    SELECT doc_id FROM counted WHERE latin + foreign_n = 0 OR foreign_n::DOUBLE / (latin + foreign_n) < 0.2""",
)
def script_filter(spark, folder):
    return _mixed(spark, folder).where(P.few_foreign_letters(F.col("text"))).select("doc_id")


@register("quality_filter", f"SELECT doc_id FROM documents WHERE {sql_long_enough('text')}")
def quality_filter(spark, folder):
    return documents(spark, folder).where(P.long_enough(F.col("text"))).select("doc_id")


BODY = sql_strip(
    f"regexp_replace(regexp_replace(text, 'http[^{SPACE}]+', '', 'g'), '@[{WORD}]+', '', 'g')"
)
SAME = " AND ".join(f"c[i]=c[i+{k}]" for k in range(1, 5))
PAIR = " AND ".join([f"c[i]=c[i+{k}] AND c[i+1]=c[i+{k + 1}]" for k in (2, 4, 6)])


@register(
    "quality_extended",
    f"""WITH drawn AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' haaaaah' WHEN 1 THEN ' jajajaja'
          WHEN 2 THEN ' soooo' WHEN 3 THEN repeat(' 12345', CAST(n_chars % 300 AS INTEGER)) ELSE '' END AS text FROM documents),
    body AS (SELECT doc_id, {BODY} AS b FROM drawn),
    chars AS (SELECT doc_id, b, string_split(b, '') AS c FROM body WHERE length(b) >= 15
        AND (length(b) - length(regexp_replace(b, '\\p{{L}}+', '', 'g')))::DOUBLE / length(b) >= 0.4
        AND length(b) - length(replace(b, chr(10), '')) <= 5)
    SELECT doc_id FROM chars
    WHERE NOT coalesce(list_bool_or([c[i] <> chr(10) AND {SAME} FOR i IN range(1, len(c) - 3)]), FALSE)
      AND NOT coalesce(list_bool_or([c[i] <> chr(10) AND c[i+1] <> chr(10) AND {PAIR}
            FOR i IN range(1, len(c) - 6)]), FALSE)""",
)
def quality_extended(spark, folder):
    i = F.col("doc_id") % 6
    extra = (
        F.when(i == 0, " haaaaah")
        .when(i == 1, " jajajaja")
        .when(i == 2, " soooo")
        .when(i == 3, F.repeat(F.lit(" 12345"), (F.col("n_chars") % 300).cast("int")))
        .otherwise("")
    )
    drawn = documents(spark, folder).select("doc_id", F.concat("text", extra).alias("text"))
    return drawn.where(P.good_quality(F.col("text"))).select("doc_id")


@register(
    "keyword_filter",
    """SELECT doc_id FROM documents WHERE contains(lower(text), 'thing')
       OR contains(lower(text), 'über') OR contains(lower(text), 'mente')""",
)
def keyword_filter(spark, folder):
    return (
        documents(spark, folder)
        .where(P.contains_any(F.col("text"), ["Thing", "Über", "mente"]))
        .select("doc_id")
    )


@register(
    "search_posts",
    f"""WITH {POSTS} SELECT post_id, url FROM posts WHERE NOT is_reply AND lang = 'en'
      AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-06-01'
      AND (contains(lower(text), 'korupsi') OR contains(lower(text), 'bagus'))
      AND coalesce(url, '') <> '' AND lower(trim(username)) <> 'grok'""",
)
def search_posts(spark, folder):
    found = jobs.search(
        posts(spark, folder),
        ["korupsi", "Bagus"],
        F.lit("2024-01-05").cast("date"),
        F.lit("2024-06-01").cast("date"),
        "en",
    )
    kept = found.where(P.has_url(F.col("url")) & P.account_allowed(F.col("username")))
    return kept.select("post_id", "url")


@register(
    "search_posts_spanned",
    f"""WITH {POSTS}, {SPAN} SELECT post_id, url FROM posts, span WHERE NOT is_reply AND lang = 'en'
      AND ts >= s AND ts < e AND (contains(lower(text), 'korupsi') OR contains(lower(text), 'bagus'))
      AND coalesce(url, '') <> '' AND lower(trim(username)) <> 'grok'""",
)
def search_posts_spanned(spark, folder):
    rows = posts(spark, folder)
    start, end = (F.lit(d).cast("date") for d in span_of(rows))
    found = jobs.search(rows, ["korupsi", "Bagus"], start, end, "en")
    kept = found.where(P.has_url(F.col("url")) & P.account_allowed(F.col("username")))
    return kept.select("post_id", "url")


# --- dedup -------------------------------------------------------------------

@register(
    "prefix_dedup",
    f"SELECT doc_id, text FROM ({FIRST_BY_PREFIX.format(key='doc_id', rows='documents')})",
)
def prefix_dedup(spark, folder):
    return dedup.first_by_prefix(documents(spark, folder), ["doc_id"]).select("doc_id", "text")


FIRST_BY_URL = """SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY {key}) AS rn
    FROM {rows} WHERE coalesce(url, '') <> '') WHERE rn = 1"""


@register(
    "url_dedup",
    f"WITH {POSTS} SELECT post_id, url, text FROM ({FIRST_BY_URL.format(key='post_id', rows='posts')})",
)
def url_dedup(spark, folder):
    return dedup.first_by_url(posts(spark, folder), ["post_id"]).select("post_id", "url", "text")


@register(
    "unseen_posts",
    f"""WITH {POSTS} SELECT post_id, url FROM
    ({FIRST_BY_URL.format(key='post_id', rows="(SELECT * FROM posts WHERE lang <> 'en')")})
    WHERE url NOT IN (SELECT url FROM posts WHERE lang = 'en' AND url IS NOT NULL)""",
)
def unseen_posts(spark, folder):
    rows = posts(spark, folder)
    new, seen = rows.where("lang <> 'en'"), rows.where("lang = 'en'")
    return dedup.unseen(new, seen, ["post_id"]).select("post_id", "url")


# --- frequencies and expansion -------------------------------------------------

TAGS = sql_term_counts("posts", "post_id", f"regexp_extract_all(lower(text), '#{W_ONE}')")


def sql_context(rows: str, key: str, base: str) -> str:
    return sql_term_counts(
        rows,
        key,
        f"regexp_extract_all(lower(text), '{W_ONE}')",
        f"term NOT IN ({STOP}) AND length(term) > 3 AND NOT regexp_matches(term, '^\\p{{Nd}}+$') "
        f"AND NOT contains('{base}', term)",
    )


@register(
    "hashtag_top",
    f"""WITH {POSTS}, counts AS ({TAGS}), top AS (SELECT * FROM counts ORDER BY n DESC, first LIMIT 30)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank, term AS tag, n
    FROM top QUALIFY n >= 2""",
)
def hashtag_top(spark, folder):
    top = ranking.top_terms(discovery.tag_counts(posts(spark, folder), "post_id"), 30)
    ranked = ranking.with_rank(top).where("n >= 2")
    return ranked.select("rank", F.col("term").alias("tag"), "n")


@register(
    "context_words",
    f"""WITH counts AS ({sql_context("documents", "doc_id", "that thing")})
    SELECT CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank, term AS word, n
    FROM counts ORDER BY rank LIMIT 20""",
)
def context_words(spark, folder):
    counts = discovery.context_word_counts(documents(spark, folder), "doc_id", "That thing")
    ranked = ranking.with_rank(ranking.top_terms(counts, 20))
    return ranked.select("rank", F.col("term").alias("word"), "n")


@register(
    "related_tags",
    f"""WITH {POSTS}, counts AS ({TAGS}), bare AS (SELECT *, lower(replace(term, '#', '')) AS t FROM counts)
    SELECT term AS tag, n FROM bare WHERE contains(t, 'src1') OR contains('src1', t)
      OR contains(t, 'english') OR contains('english', t)""",
)
def related_tags(spark, folder):
    words = discovery.base_words(["src1 English"])
    counts = discovery.tag_counts(posts(spark, folder), "post_id")
    return counts.where(P.is_related_tag(F.col("term"), words)).select(F.col("term").alias("tag"), "n")


@register(
    "smart_expand",
    f"""WITH {POSTS}, counts AS ({TAGS}), top AS (SELECT * FROM counts ORDER BY n DESC, first LIMIT 10)
    SELECT 'banjir OR ' || string_agg(term, ' OR ' ORDER BY n DESC, first) AS query FROM top""",
)
def smart_expand(spark, folder):
    return discovery.smart_query(posts(spark, folder), "post_id", "banjir")


def sql_expand(rows: str, keywords: list[str], limit: int = 60) -> str:
    """CTEs that end in ``expanded(variation_idx, kind, rank, variation)``."""
    base = " OR ".join(keywords)
    forms = [f for k in keywords for f in ([k] if k.startswith("#") else [k, "#" + k.replace(" ", "")])]
    return f"""tag_counts AS ({sql_term_counts(rows, "post_id", f"regexp_extract_all(lower(text), '#{W_ONE}')")}),
    word_counts AS ({sql_context(rows, "post_id", base.lower())}),
    raw_list AS (
      SELECT 0 AS kind, unnest(range({len(forms)})) AS rank, unnest([{sql_list(forms)}]) AS variation
      UNION ALL SELECT 1, rank, '{base} ' || term FROM (SELECT term, row_number() OVER (ORDER BY n DESC, first) AS rank
        FROM word_counts) WHERE rank <= 20
      UNION ALL SELECT 2, rank, term FROM (SELECT term, n, row_number() OVER (ORDER BY n DESC, first) AS rank
        FROM tag_counts) WHERE rank <= 30 AND n >= 2),
    exact AS (SELECT * FROM raw_list QUALIFY row_number() OVER (PARTITION BY variation ORDER BY kind, rank) = 1),
    folded AS (SELECT * FROM exact QUALIFY kind < 2
      OR row_number() OVER (PARTITION BY lower(variation) ORDER BY kind, rank) = 1),
    expanded AS (SELECT CAST(row_number() OVER (ORDER BY kind, rank) - 1 AS INTEGER) AS variation_idx,
      kind, rank, variation FROM folded ORDER BY kind, rank LIMIT {limit})"""


KEYWORDS = ["korupsi", "lancar tapi"]


@register(
    "auto_expand",
    f"""WITH {POSTS}, {sql_expand("posts", KEYWORDS)}
    SELECT variation_idx, CAST(kind AS INTEGER) AS kind, variation FROM expanded""",
)
def auto_expand(spark, folder):
    return discovery.expand_keywords(posts(spark, folder), "post_id", KEYWORDS).select(
        "variation_idx", "kind", "variation"
    )


@register(
    "related_expand",
    f"""WITH {POSTS}, counts AS ({TAGS}), top AS (SELECT * FROM counts ORDER BY n DESC, first LIMIT 20),
    parts AS (
      SELECT 0 AS kind, unnest(range(4)) AS rank,
        unnest(['src1 en', '#src1en', 'berita src1 en', 'update src1 en']) AS variation
      UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, first), term FROM top
      WHERE n >= 2 AND (contains(term, 'src1') OR contains('src1', term[2:]) OR contains('en', term[2:])))
    SELECT CAST(row_number() OVER (ORDER BY kind, rank) - 1 AS INTEGER) AS variation_idx, variation
    FROM parts ORDER BY kind, rank LIMIT 20""",
)
def related_expand(spark, folder):
    return discovery.expand_keywords(
        posts(spark, folder),
        "post_id",
        ["src1 en"],
        context=0,
        tags=20,
        limit=20,
        related_only=True,
        prefixes=V.KEYWORD_PREFIXES,
    ).select("variation_idx", "variation")


# --- sentiment and topics ------------------------------------------------------

def sql_hits(terms) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{t}')::INTEGER" for t in terms) + ")"


SENTIMENT = """SELECT {key}, CASE WHEN p = n THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS sentiment,
    CASE WHEN p = n THEN 0.5::DOUBLE
         ELSE round_even(greatest(p, n)::DOUBLE / (p + n), 3)::DOUBLE END AS sentiment_score
    FROM ({hits})"""


@register(
    "lexicon_sentiment",
    f"WITH {POSTS} "
    + SENTIMENT.format(
        key="post_id",
        hits=f"SELECT post_id, {sql_hits(V.POSITIVE_TERMS)} AS p, {sql_hits(V.NEGATIVE_TERMS)} AS n FROM posts",
    ),
)
def lexicon_sentiment(spark, folder):
    return sentiment.with_lexicon_sentiment(posts(spark, folder)).select(
        "post_id", "sentiment", "sentiment_score"
    )


# a lexicon over the native limit, built by rule: vowel endings against the rest
LARGE = [a + b + c for a in "abdeghilmnorstu" for b in "aeiou" for c in "aehnrst"]
LARGE_POSITIVE = [t for t in LARGE if t[0] in "aeiou"]
LARGE_NEGATIVE = [t for t in LARGE if t[0] not in "aeiou"]


@register(
    "large_lexicon",
    SENTIMENT.format(
        key="doc_id",
        hits=f"""SELECT doc_id, len([t FOR t IN [{sql_list(LARGE_POSITIVE)}] IF contains(low, t)]) AS p,
          len([t FOR t IN [{sql_list(LARGE_NEGATIVE)}] IF contains(low, t)]) AS n
          FROM (SELECT doc_id, lower(text) AS low FROM documents)""",
    ),
)
def large_lexicon(spark, folder):
    return sentiment.with_lexicon_sentiment(
        documents(spark, folder), positive=LARGE_POSITIVE, negative=LARGE_NEGATIVE
    ).select("doc_id", "sentiment", "sentiment_score")


@register(
    "lexicon_table",
    f"""WITH lexicon AS (SELECT DISTINCT unnest(regexp_extract_all(lower(html), '[a-z]{{4,}}')) AS term FROM pages),
    words AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM documents),
    parts AS (SELECT word, i, unnest(range(4, length(word) - i + 2)) AS n FROM
      (SELECT word, unnest(range(1, length(word) - 2)) AS i FROM (SELECT DISTINCT word FROM words))),
    within AS MATERIALIZED (SELECT DISTINCT word, term FROM (SELECT word, substr(word, i, n) AS term FROM parts WHERE n <= 40) JOIN lexicon USING (term)),
    hits AS (SELECT doc_id, count(DISTINCT term) FILTER (WHERE term[1] IN ('a','e','i','o','u')) AS p,
      count(DISTINCT term) FILTER (WHERE term[1] NOT IN ('a','e','i','o','u')) AS n
      FROM words JOIN within USING (word) GROUP BY doc_id),
    counted AS (SELECT doc_id, coalesce(p, 0) AS p, coalesce(n, 0) AS n FROM documents LEFT JOIN hits USING (doc_id))
    SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
      CASE WHEN p = n THEN 0.5::DOUBLE ELSE round_even(greatest(p, n)::DOUBLE / (p + n), 3)::DOUBLE END AS sentiment_score FROM counted""",
)
def lexicon_table(spark, folder):
    """Every Latin word of the saved pages is a term; its first letter is its side."""
    word = F.explode(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")
    lexicon = table(spark, folder, "pages").select(word).distinct().where(F.length("term") <= 40)
    lexicon = lexicon.withColumn("positive", F.substring("term", 1, 1).isin(*"aeiou"))
    return sentiment.with_lexicon_table(documents(spark, folder), lexicon).select("doc_id", "sentiment", "sentiment_score")


def _load_letter_model():
    """Stand-in for a caller's model: the share of ``e`` among ``a`` and ``e``."""

    def model(texts):
        scored = []
        for text in texts:
            a, e = text.count("a"), text.count("e")
            if a + e == 0:
                raise ValueError("nothing to score")
            label = "LABEL_1" if e > a else "Negatif" if a > e else "other"
            scored.append((label, e / (a + e)))
        return scored

    return model


@register(
    "model_sentiment",
    f"""WITH cut AS (SELECT post_id, text[1:512] AS t FROM (SELECT doc_id AS post_id,
          CASE WHEN doc_id % 11 = 0 THEN 'xyz' WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS text FROM documents)),
    c AS (SELECT post_id, t, length(t) - length(replace(t, 'a', '')) AS a, length(t) - length(replace(t, 'e', '')) AS e FROM cut)
    SELECT post_id,
      CASE WHEN e > a THEN 'positive' WHEN a > e THEN 'negative' ELSE 'neutral' END AS sentiment,
      CASE WHEN a + e = 0 THEN 0.5::DOUBLE ELSE round_even(e::DOUBLE / (a + e), 3)::DOUBLE END AS sentiment_score,
      CASE WHEN a + e = 0 AND {sql_strip('t')} <> '' THEN 'nothing to score' END AS sentiment_error FROM c""",
)
def model_sentiment(spark, folder):
    i = F.col("doc_id")
    text = F.when(i % 11 == 0, "xyz").when(i % 13 == 0, "  ").otherwise(F.col("text"))
    rows = documents(spark, folder).select(i.alias("post_id"), text.alias("text"))
    return sentiment.with_model_sentiment(rows, _load_letter_model).select(
        "post_id", "sentiment", "sentiment_score", "sentiment_error"
    )


@register(
    "frequency_topics",
    f"""WITH counts AS ({sql_term_counts("documents", "doc_id", TOKENS)}),
    ranked AS (SELECT term, row_number() OVER (ORDER BY n DESC, first) AS r FROM counts)
    SELECT CAST((r - 1) // 10 + 1 AS INTEGER) AS id, string_agg(term, ' ' ORDER BY r) AS words,
           count(*) / 10.0::DOUBLE AS weight FROM ranked WHERE r <= 50 GROUP BY 1""",
)
def frequency_topics(spark, folder):
    found = topics.frequency_topics(documents(spark, folder), "doc_id")
    return found.select("id", F.array_join("words", " ").alias("words"), "weight")


# --- saved pages -----------------------------------------------------------------

@register(
    "page_links",
    """SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS link
    FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1) AS l FROM pages)""",
)
def page_links(spark, folder):
    return pages.page_links(table(spark, folder, "pages"), "page_id")


@register(
    "page_records",
    """WITH items AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS url, unnest(t) AS title FROM (
      SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h,
             regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM pages))
    SELECT page_id, CAST(pos AS INTEGER) AS pos, url, title || chr(10) || title AS text FROM items
    WHERE url <> '' AND title <> ''""",
)
def page_records(spark, folder):
    found = pages.search_records(
        table(spark, folder, "pages"), "page_id", containers=("li",), title="a", link="a"
    )
    return found.select("page_id", "pos", "url", X.search_row_text(F.col("title"), F.col("body")).alias("text"))


@register(
    "rejected_records",
    f"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1),
      '&quot;', '"'), '&amp;?', '&', 'g'), '[{SPACE}]+', ' ', 'g')) AS title FROM pages""",
)
def rejected_records(spark, folder):
    found = pages.search_records(
        table(spark, folder, "pages"), "page_id", containers=("article",), title="h1", keep_rejected=True
    )
    return found.select("page_id", "title")


MARKERS = ("UTM", "THE", "quot", "class=\"ad\"", "nicht")


@register(
    "page_markers",
    """WITH h AS (SELECT page_id, html, lower(html) AS low FROM pages)
    SELECT page_id, CAST(octet_length(encode(html)) AS INTEGER) AS size, html[1:500] AS preview,
      array_to_string([p FOR p IN ['Google', 'captcha', 'class="g"', '<html', '<input']
        IF contains(CASE WHEN p IN ('captcha', '<html') THEN low ELSE html END, p)], '|') AS probes,
      array_to_string([m FOR m IN ['UTM', 'THE', 'quot', 'class="ad"', 'nicht'] IF contains(low, lower(m))], '|') AS markers,
      len([m FOR m IN ['UTM', 'THE', 'quot', 'class="ad"', 'nicht'] IF contains(low, lower(m))]) > 0 AS blocked
    FROM h""",
)
def page_markers(spark, folder):
    report = pages.page_report(table(spark, folder, "pages"), "page_id", markers=MARKERS)
    return report.withColumns(
        {"probes": F.array_join("probes", "|"), "markers": F.array_join("markers", "|")}
    )


@register(
    "page_outcome",
    """WITH v AS (SELECT page_id, html, url || CASE page_id % 5 WHEN 0 THEN '/Login' WHEN 1 THEN '/home'
        WHEN 2 THEN '/search?from=home' ELSE '' END AS url FROM pages)
    SELECT page_id, CASE WHEN contains(lower(url), 'login') THEN 'login'
      WHEN contains(lower(url), 'home') AND NOT contains(lower(url), 'search') THEN 'home'
      WHEN contains(html, '&quot;') THEN 'results' WHEN contains(html, 'ing') THEN 'no_results'
      ELSE 'unknown' END AS outcome FROM v""",
)
def page_outcome(spark, folder):
    i = F.col("page_id") % 5
    tail = F.when(i == 0, "/Login").when(i == 1, "/home").when(i == 2, "/search?from=home").otherwise("")
    visited = table(spark, folder, "pages").withColumn("url", F.concat("url", tail))
    return visited.select(
        "page_id", pages.page_outcome(F.col("url"), F.col("html"), "&quot;", "ing").alias("outcome")
    )


CARD = """<html><body><article data-testid="tweet"><div data-testid="User-Name"><a href="https://x.example/u%s">u</a></div>
<div data-testid="tweetText">%s #%s</div>%s%s
<div role="group"><button aria-label="%s a">r</button><button aria-label="7 b">t</button><button>l</button><button>v</button></div>
</article><article data-testid="tweet"><p>no post</p></article></body></html>"""


@register(
    "post_cards",
    """SELECT 'u' || (doc_id % 7) AS username, source || ' text #' || lang AS text, source || ' text #' || lang AS text_clean,
      '#' || lang AS hashtags, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS timestamp,
      CASE WHEN doc_id % 3 = 0 THEN 'https://x.example/p/' || doc_id ELSE 'https://x.com/u' || (doc_id % 7) END AS url,
      CASE WHEN doc_id % 2 = 0 THEN 0 ELSE n_chars END AS replies, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 7 END AS retweets,
      CASE WHEN doc_id % 2 = 0 THEN n_chars * 1000 ELSE 0 END AS likes FROM documents""",
)
def post_cards(spark, folder):
    """Cards drawn from the documents, read back as posts."""
    i = F.col("doc_id")
    time = F.concat(
        F.when(i % 3 == 0, F.concat(F.lit('<a href="https://x.example/p/'), i, F.lit('">'))).otherwise("<b>"),
        F.lit('<time datetime="'),
        F.expr("timestampadd(HOUR, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").cast("string"),
        F.lit('Z">x</time>'),
        F.when(i % 3 == 0, "</a>").otherwise("</b>"),
    )
    like = F.when(
        i % 2 == 0, F.concat(F.lit('<button data-testid="like" aria-label="'), "n_chars", F.lit('K likes">x</button>'))
    ).otherwise("")
    saved = documents(spark, folder).select(
        i.alias("page_id"),
        F.format_string(
            CARD, i % 7, F.concat("source", F.lit(" text")), "lang", time, like, F.col("n_chars")
        ).alias("html"),
    )
    cards = pages.post_cards(saved, "page_id")
    found = pages.posts_from_cards(cards, F.current_timestamp())
    return found.drop("scraped_at").withColumns(
        {"hashtags": F.array_join("hashtags", " "), "timestamp": F.col("timestamp").cast("timestamp_ntz")}
    )
