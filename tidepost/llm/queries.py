"""The operators as queries over the shared tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.llm import centroids, chat, exact, language, licenses, middle, mixing, near, neighbours, packing, substrings, tokens, urls

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Fixed by the contract: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

URL_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES {rules}),
rest AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, n,
  translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
won AS (SELECT n, max_by(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
  max_by(rverdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN won USING (n)
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))


@register("op1_url_filters", URL_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.url_verdicts(table(spark, folder, "pages"), listed)


#: Fixed by the contract: one more conversation, full of control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"
CHAT_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}'),
coded AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), chr(10), '\n') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(head) + 1 + length(body) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
""".replace("{hard}", HARD_TEXT)


@register("op2_chat_formatting", CHAT_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(hard)))


@register("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    )
    model = language.fit(docs.where("NOT held_out"))
    found = language.with_language(docs, model, extra=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@register("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


KNN_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS qn, q.vec_id AS query_id, d.vec_id, d.n, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.n <> d.n WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id, n) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op5_exact_top_k", KNN_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op6_license_scans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(spark, folder, "documents"))


@register("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.with_token_counts(table(spark, folder, "documents"))


@register("op8_mixing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op9_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(table(spark, folder, "documents"))


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS n, length(coalesce(text, '')) AS points,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id, n)
"""


@register("op10_exact_dedup", EXACT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_groups(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _cluster_sql(k: int, rounds: int) -> str:
    """The rounds written out one after the other; sums are exact whole numbers."""
    steps = [
        f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k}))"""
    ]
    near = """
a{i} AS MATERIALIZED (SELECT n, arg_min(cluster, d * 1000 + cluster) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM
  (SELECT n, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY n)"""
    move = """
s{i} AS MATERIALIZED (SELECT cluster, pos, sum(x) AS s, count(*) AS m FROM
  (SELECT cluster, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM a{i} JOIN v USING (n)) GROUP BY cluster, pos),
c{j} AS MATERIALIZED (SELECT cluster, coalesce(m.c, old.c) AS c FROM c{i} old LEFT JOIN
  (SELECT cluster, list(CAST(CASE WHEN s < 0 THEN -((m - 1 - s) // m) ELSE s // m END AS BIGINT) ORDER BY pos) AS c FROM s{i} GROUP BY cluster) m USING (cluster))"""
    for i in range(rounds):
        steps += [near.format(i=i), move.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    return ",".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (n) JOIN c{rounds} USING (cluster)
"""


@register("op11_centroid_clustering", _cluster_sql(40, 5))
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.centroid_clusters(table(spark, folder, "embeddings"))
    digest = centroids.centroid_digest(F.col("centroid")).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


MIDDLE_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
d AS (SELECT *, {digits} FROM h),
k AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""".replace(
    "{digits}",
    ", ".join(
        "CAST(list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', x[{0} + i]) - 1) * CAST(power(16, 8 - i) AS BIGINT)))"
        " AS BIGINT) AS h{1}".format(8 * i, i + 1)
        for i in range(4)
    ),
)


@register("op12_fill_in_middle", MIDDLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = middle.fill_in_middle(table(spark, folder, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
s AS (SELECT n, pos, word, CASE WHEN count(*) OVER f = 35 THEN string_agg(word, ' ') OVER f END AS win
  FROM p WINDOW f AS (PARTITION BY n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT n, pos, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again FROM s),
c AS (SELECT n, pos, word, max(again) OVER (PARTITION BY n ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT n, sum(gone) AS gone, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (n)
"""


@register("op13_substring_dedup", SUBSTRING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
