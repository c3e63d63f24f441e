"""Term vectors and the variational topic fit against plain loops; layout must not matter."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidepost.operators import lda, topics, vectors


def tokenised(spark, seed=3, count=80):
    rng = np.random.default_rng(seed)
    themes = [["banjir", "hujan", "sungai", "air"], ["partai", "suara", "debat", "calon"], ["gol", "liga", "tim"]]
    rows = []
    for i in range(count):
        own = themes[i % 3]
        rows.append((i, [str(rng.choice(own)) for _ in range(rng.integers(0, 9))] + (["semua"] if i % 5 else [])))
    rows += [(count, ["satu"]), (count + 1, []), (count + 2, None), (count + 3, ["gol"] * 50)]
    return rows, spark.createDataFrame(rows, "ord long, tokens array<string>")


def plain_tfidf(rows, size, least, share):
    docs = [t for _, t in rows if t is not None]
    df = Counter(w for t in docs for w in set(t))
    tf = Counter(w for t in docs for w in t)
    n = len(rows)
    kept = sorted((w for w in df if least <= df[w] <= share * n), key=lambda w: (-tf[w], w))[:size]
    terms = sorted(kept)
    out = {}
    for i, t in rows:
        own = Counter(w for w in t or [] if w in kept)
        raw = {terms.index(w): c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in own.items()}
        length = math.sqrt(sum(x * x for x in raw.values())) or 1
        out[i] = {k: x / length for k, x in sorted(raw.items())}
    return terms, out


def test_vectors_by_plain_loops(spark):
    rows, docs = tokenised(spark)
    for size in (5, 1000):
        terms, idf, count = vectors.vocabulary(vectors.term_statistics(docs), size, 2, 0.95)
        wanted_terms, wanted = plain_tfidf(rows, size, 2, 0.95)
        assert terms == wanted_terms and count == len(rows)
        found = {r.ord: dict(zip(r.terms, r.weights)) for r in vectors.tfidf_vectors(docs.repartition(3), terms, idf).collect()}
        assert found.keys() == wanted.keys()
        for i, own in found.items():
            assert list(own) == list(wanted[i]) and np.allclose(list(own.values()), list(wanted[i].values()))
    none = docs.where("false")
    assert vectors.vocabulary(vectors.term_statistics(none)) == ([], [], 0)
    assert vectors.tfidf_vectors(none, ["a"], [1.0]).count() == 0


def test_digamma():
    assert np.allclose(lda.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721], atol=1e-10)
    x = np.linspace(0.01, 30, 500)
    assert np.allclose(lda.digamma(x + 1), lda.digamma(x) + 1 / x, atol=1e-9)


def plain_round(docs, table, prior, steps, tolerance):
    """One document and one term at a time."""
    k = len(table)
    shares = [[math.exp(float(lda.digamma(np.array([x]))[0] - lda.digamma(np.array([sum(row)]))[0])) for x in row] for row in table]
    out = np.full((k, len(table[0])), prior)
    for own in docs:
        counts = [1.0] * k
        mixture = lambda: [math.exp(float(lda.digamma(np.array([c]))[0] - lda.digamma(np.array([sum(counts)]))[0])) for c in counts]
        for _ in range(steps):
            theta = mixture()
            new = [prior] * k
            for term, weight in own.items():
                norm = sum(theta[j] * shares[j][term] for j in range(k)) + 1e-100
                for j in range(k):
                    new[j] += theta[j] * shares[j][term] * weight / norm
            moved = sum(abs(a - b) for a, b in zip(new, counts)) / k
            counts = new
            if moved < tolerance:
                break
        theta = mixture()
        for term, weight in own.items():
            norm = sum(theta[j] * shares[j][term] for j in range(k)) + 1e-100
            for j in range(k):
                out[j][term] += theta[j] * shares[j][term] * weight / norm
    return out


def test_a_round_by_plain_loops(spark):
    rows, docs = tokenised(spark)
    terms, idf, _ = vectors.vocabulary(vectors.term_statistics(docs))
    found = vectors.tfidf_vectors(docs, terms, idf)
    first = lda.first_topics(terms, 3, 1)
    plain = [dict(zip(r.terms, r.weights)) for r in found.collect()]
    for steps, tolerance in ((1, 1e-3), (100, 1e-3), (7, 0.0)):
        one = lda.variational_topics(found, terms, 3, rounds=1, steps=steps, tolerance=tolerance, seed=1)
        assert np.allclose(one, plain_round([d for d in plain if d], first, 1 / 3, steps, tolerance), atol=1e-6)


def test_layout_changes_no_bit_of_the_topics(spark):
    _, docs = tokenised(spark, count=300)
    terms, idf, _ = vectors.vocabulary(vectors.term_statistics(docs))
    found = []
    for n, order in ((1, "ord"), (4, "tokens"), (16, "tokens")):
        own = vectors.tfidf_vectors(docs.repartition(n, order), terms, idf)
        found.append(lda.variational_topics(own, terms, 3, rounds=4))
    assert all(np.array_equal(found[0], other) for other in found[1:])
    tops = {terms[int(i)] for i in found[0].argmax(axis=1)}
    assert len(tops) == 3


def test_topics_of_posts_without_ground_for_them(spark):
    posts = spark.createDataFrame([(1, None), (2, ""), (3, "satu dua")], "id long, text string")
    assert topics.lda_topics(posts, "id", 2, 3).collect() == topics.frequency_topics(posts, "id", 2, 3).collect()
    assert topics.lda_topics(posts.where("false"), "id").count() == 0
    same = spark.range(40).select("id", F.lit("kata yang sama terus berulang ulang").alias("text"))
    assert topics.lda_topics(same, "id", 2, 3).count() == topics.frequency_topics(same, "id", 2, 3).count()


def test_tfidf_terms_reads_the_texts_twice_only(spark, monkeypatch):
    from tidepost.catalog import topic_queries

    read = []
    own = topic_queries.vectors.vocabulary
    monkeypatch.setattr(topic_queries.vectors, "vocabulary", lambda statistics, **sizes: read.append(statistics) or own(statistics, **sizes))
    topic_queries.tfidf_terms(spark, "/root/testdata/sf0.001")
    # the vocabulary is cut from a stored table, with no aggregate over texts behind it
    assert "documents.parquet" not in "".join(read[0].inputFiles())


def test_texts_are_tokenised_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(i, f"alpha beta word{i % 7} word{i % 5} extra{i % 3}") for i in range(60)]
    posts = spark.createDataFrame(rows, "id long, text string").select("id", counted("text").alias("text"))
    assert topics.lda_topics(posts, "id", 2, 3).count() == 2
    assert read.value == 60


def test_fitting_in_slices_gives_the_same_bits():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 400, 3, 2 * lda.CELLS, 5, 1, *rng.integers(1, 300, 400)])
    terms = rng.integers(0, 50, sizes.sum())
    weights, shares = rng.random(len(terms)), lda.expected_logs(rng.random((3, 50)) + 0.1)
    slices = list(lda._slices(sizes))
    assert [a for a, _ in slices[1:]] == [b for _, b in slices[:-1]] and slices[0][0] == 0 and slices[-1][1] == len(sizes) and len(slices) > 2
    places = np.concatenate([[0], np.cumsum(sizes)])
    whole = lda.fit_documents(sizes, terms, weights, shares, 1 / 3, 100, 1e-3)
    parts = [lda.fit_documents(sizes[a:b], terms[places[a] : places[b]], weights[places[a] : places[b]], shares, 1 / 3, 100, 1e-3) for a, b in slices]
    for topic in range(3):
        assert np.array_equal(whole[topic], np.concatenate([p[topic] for p in parts]))
    assert list(lda._slices(np.zeros(0, dtype=int))) in ([], [(0, 0)])


def test_null_words_and_rows_are_counted(spark):
    docs = spark.createDataFrame([(1, ["a", "a", None, "b"]), (2, None), (3, []), (4, ["b"])], "ord int, tokens array<string>")
    found = {r.term: (r.tf, r.df) for r in vectors.term_statistics(docs).collect()}
    assert found == {"a": (2, 1), "b": (2, 2), None: (0, 4)}
