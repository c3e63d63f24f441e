"""Queries over term vectors and fitted topics; the SQL writes the rounds of the fit out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.catalog.registry import documents, register, sql_list
from tidepost.functions import fixed_values as V
from tidepost.functions.charclass import SPACE, WORD
from tidepost.operators import topics, vectors
from tidepost.session import through_table

TOPICS, ROUNDS, STEPS, SEED = 5, 10, 100, 42

TOKENS = (
    f"[w FOR w IN string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), "
    f"'http[^{SPACE}]+', '', 'g'), '@[{WORD}]+', '', 'g'), '#[{WORD}]+', '', 'g'), '[^{WORD}{SPACE}]', ' ', 'g'), "
    f"'[{SPACE}]+') IF length(w) > 2 AND NOT list_contains([{sql_list(V.TOPIC_STOPWORDS)}], w)]"
)

TFIDF = f"""tokens AS MATERIALIZED (SELECT doc_id, t FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tokens) GROUP BY doc_id, term),
stats AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM tf GROUP BY term),
vocab AS MATERIALIZED (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS i
  FROM (SELECT term, df, n::DOUBLE AS n FROM stats, (SELECT count(*) AS n FROM tokens) WHERE df >= 2 AND df <= 0.95 * n ORDER BY tf DESC, term LIMIT 1000)),
weighted AS MATERIALIZED (SELECT doc_id, term, i, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
  FROM (SELECT doc_id, term, i, tf.tf, df, tf.tf * idf AS w FROM tf JOIN vocab USING (term)))"""


@register("tfidf_terms", f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted")
def tfidf_terms(spark, folder):
    docs = topics.topic_documents(documents(spark, folder), "doc_id")
    # read twice: the texts are tokenised once for it
    terms, idf, _ = vectors.vocabulary(through_table(vectors.term_statistics(docs), "topic-terms"))
    names = F.array(*[F.lit(t) for t in terms])
    found = vectors.tfidf_vectors(docs, terms, idf).select("ord", F.explode(F.arrays_zip("terms", "weights")).alias("t"))
    return found.select(F.col("ord").alias("doc_id"), F.get(names, F.col("t.terms")).alias("term"), F.round("t.weights", 6).alias("weight"))


def _psi(x: str) -> str:
    shifted = " ".join(f"- 1.0::DOUBLE / ({x} + {i})" for i in range(6))
    y = f"({x} + 6)"
    r = f"(1.0::DOUBLE / ({y} * {y}))"
    series = f"{r} * (1.0::DOUBLE / 12 - {r} * (1.0::DOUBLE / 120 - {r} * (1.0::DOUBLE / 252 - {r} * (1.0::DOUBLE / 240 - {r} / 132))))"
    return f"(ln{y} - 0.5::DOUBLE / {y} - {series} {shifted})"


def _lda_sql() -> str:
    each = f"range(1, {TOPICS + 1})"
    psi = _psi("x")
    norm = "(" + " + ".join(f"th[{k}] * {{0}}[{k}]" for k in range(1, TOPICS + 1)) + " + 1e-100)"
    mixture = f"list_transform(list_append(g, list_sum(g)), lambda x: {psi})"
    theta = f"list_transform({each}, lambda k: exp(ps[k] - ps[{TOPICS + 1}]))"
    start = ", ".join(
        "0.8 + 0.4 * list_sum(list_transform(range(1, 9), lambda j: (strpos('0123456789abcdef', "
        f"substr(md5('{SEED}:{k}:' || term), j, 1)) - 1) * power(16::DOUBLE, 8 - j))) / 4294967296.0::DOUBLE"
        for k in range(TOPICS)
    )
    sums = ", ".join(f"sum(l[{k}])" for k in range(1, TOPICS + 1))
    steps = [f"WITH RECURSIVE {TFIDF}", f"l0 AS MATERIALIZED (SELECT i, [{start}]::DOUBLE[] AS l FROM vocab)"]
    for r in range(ROUNDS):
        steps += [
            f"s{r} AS (SELECT list_transform([{sums}], lambda x: {psi}) AS s FROM l{r})",
            f"e{r} AS MATERIALIZED (SELECT i, list_transform({each}, lambda k: exp(p[k] - s[k])) AS e "
            f"FROM (SELECT i, list_transform(l, lambda x: {psi}) AS p FROM l{r}), s{r})",
            f"m{r} AS MATERIALIZED (SELECT doc_id, list(i ORDER BY i) AS ids, list(weight ORDER BY i) AS w, list(e ORDER BY i) AS own "
            f"FROM weighted JOIN e{r} USING (i) GROUP BY doc_id)",
            f"""g{r}(doc_id, step, g, live) AS (
  SELECT doc_id, 0, list_transform({each}, lambda k: 1.0::DOUBLE), true FROM m{r}
  UNION ALL
  SELECT doc_id, step + 1, new, list_sum(list_transform({each}, lambda k: abs(new[k] - g[k]))) / {TOPICS} >= 0.001
  FROM (SELECT doc_id, step, g, list_transform({each}, lambda k: 1.0::DOUBLE / {TOPICS} + th[k] * list_sum(list_transform(list_zip(own, rel), lambda p: p[1][k] * p[2]))) AS new
   FROM (SELECT doc_id, step, g, th, own, list_transform(list_zip(own, w), lambda p: p[2] / {norm.format("p[1]")}) AS rel
    FROM (SELECT doc_id, step, g, own, w, {theta} AS th FROM (SELECT doc_id, step, g, own, w, {mixture} AS ps
     FROM g{r} JOIN m{r} USING (doc_id) WHERE live AND step < {STEPS})))))""",
            f"f{r} AS (SELECT doc_id, own, w, ids, {theta} AS th FROM (SELECT doc_id, own, w, ids, {mixture} AS ps "
            f"FROM (SELECT doc_id, arg_max(g, step) AS g FROM g{r} GROUP BY doc_id) JOIN m{r} USING (doc_id)))",
            f"u{r} AS (SELECT i, list_transform({each}, lambda k: round(th[k] * o[k] * w / {norm.format('o')} * 4294967296.0::DOUBLE)) AS u "
            f"FROM (SELECT th, unnest(ids) AS i, unnest(own) AS o, unnest(w) AS w FROM f{r}))",
            f"l{r + 1} AS MATERIALIZED (SELECT i, ["
            + ", ".join(f"sum(u[{k}]) / 4294967296.0::DOUBLE + 1.0::DOUBLE / {TOPICS}" for k in range(1, TOPICS + 1))
            + f"]::DOUBLE[] AS l FROM u{r} GROUP BY i)",
        ]
    ranked = (
        f"SELECT k AS id, term, l[k] AS x, row_number() OVER (PARTITION BY k ORDER BY l[k] DESC, term DESC) AS r "
        f"FROM l{ROUNDS} JOIN vocab USING (i), (SELECT unnest({each}) AS k)"
    )
    return ",\n".join(steps) + (
        f"\nSELECT CAST(id AS INTEGER) AS id, string_agg(term, ' ' ORDER BY r) AS words, round(sum(x), 2) AS weight FROM ({ranked}) WHERE r <= 10 GROUP BY id"
    )


@register("lda_topics", _lda_sql())
def lda_topics(spark, folder):
    found = topics.lda_topics(documents(spark, folder), "doc_id", TOPICS, iterations=ROUNDS, seed=SEED, steps=STEPS)
    return found.select("id", F.array_join("words", " ").alias("words"), "weight")
