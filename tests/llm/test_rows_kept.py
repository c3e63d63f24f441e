"""Stages keep the right rows: null and repeated ids, no labels, junk, clashing names, long words, bounded memos."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_data import HARD, words

import corpus_pipeline
from tidepost.llm import exact, language, mixing, near, packing
from tidepost.llm.encoders import WordIds, default_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["__row_0", "__row_1", "__ROW_2", "__keep_0", "__key_0", "__key_1", "__sha", "__judged", "__uid", "__copy", "__source", "best", "text_hash"]


def copies_of(text, ids):
    """Near copies, each with another last word."""
    return [(i, f"{text} end{n}") for n, i in enumerate(ids)]


def test_near_stage_tells_rows_by_id_and_text(spark):
    rows = copies_of(words(60), [None, None, None]) + copies_of(words(60, 4), [7, 7, 7]) + copies_of(words(60, 9), [3, None])
    rows += [(7, words(60, 20)), (8, words(60, 21)), (8, words(60, 21)), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASH})
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept.collect())
    start = {s: words(60, s)[:5] for s in (0, 4, 9, 20, 21)}
    wanted = [("None", start[0]), ("7", start[4]), ("3", start[9]), ("7", start[20]), ("8", start[21]), ("None", ""), ("9", ""), ("9", "")]
    assert found == sorted(wanted)
    groups = near.near_groups(docs).collect()
    assert sum(r.kept for r in groups) == 8 and len(groups) == len(rows)
    assert {r.class_size for r in groups if r.doc_id == 7} == {3, 1}


@pytest.mark.parametrize("step", [exact.drop_exact_copies, near.drop_near_copies, mixing.mixed])
def test_columns_of_any_name_pass(spark, step):
    docs = spark.createDataFrame(HARD, KIND).withColumns({c: F.lit(c) for c in CLASH})
    out = step(docs)
    assert out.columns == docs.columns and out.count()
    assert all(r[c] == c for r in out.collect() for c in CLASH)


def test_packing_keeps_a_column_of_its_own_name(spark):
    pieces = spark.range(50).selectExpr("id AS `__uid`", "100 AS length")
    out = packing.pack(pieces)
    assert sorted(r["__uid"] for r in out.collect()) == list(range(50))


def test_language_stage_without_labels_keeps_lettered_texts(spark):
    docs = spark.createDataFrame(HARD, KIND).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["4", "5", "6", "6", "7", "None"])
    assert corpus_pipeline.language_stage(spark, docs.where("false"), "").count() == 0


def test_language_stage_drops_random_letters_only(spark):
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").withColumn("__judged", F.lit(1))
    clean = docs.first()["text"][:400]
    rng = np.random.default_rng(0)
    noise = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(30))
    more = [(-1, noise, None), (-2, "中文" * 40, None), (-3, "xq", None), (-4, f"{clean} {noise[:60]}", None), (-5, "A.", None), (-6, "12 34", "en"), (-7, None, "en")]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string").withColumn("__judged", F.lit(1))
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(extra), SMALL)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in docs.collect()} | {-3, -4, -5}


def small_model():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    probs = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.3], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0, 0], [1e-10, 1e-11]])
    return language.Model(["x", "y"], np.log([0.5, 0.5]), pieces, probs)


def test_long_words_neither_tie_nor_overflow():
    model = small_model()
    lattice = language.Lattice(model.pieces)
    for word in ("z" * 40, "a" * 40, "ab" * 20):
        sums = language.segment_sums([word], lattice, model.probs)[0]
        assert np.isfinite(sums).all() and sums[0] != sums[1]
    # the parts of a word over MAX_WORD letters don't begin with a word-start sign
    first, rest = language.words_of("b" * 45)
    assert (first, rest) == ("b" * 40, language.GOES_ON + "b" * 5)
    assert np.allclose(language.segment_sums([rest], lattice, model.probs)[0], 5 * np.log(0.3))


def test_blocks_of_words_change_nothing(monkeypatch):
    model = small_model()
    lattice = language.Lattice(model.pieces)
    own = [w * n for w in ("a", "ab", "bz", "ba") for n in range(1, 9)]
    whole = language.segment_sums(own, lattice, model.probs)
    uses = language.expected_uses(own, np.arange(1, len(own) + 1), lattice, model.probs[:, 0])
    monkeypatch.setattr(language, "CELLS", 20)
    assert np.array_equal(whole, language.segment_sums(own, lattice, model.probs))
    assert np.allclose(uses, language.expected_uses(own, np.arange(1, len(own) + 1), lattice, model.probs[:, 0]))


def test_memo_is_bounded_and_long_chunks_are_not_held(monkeypatch):
    texts = [" ".join(f"a{'b' * (i % 7)}{'ab' * (j % 50)}" for j in range(30)) for i in range(40)] + ["ab" * 500]
    whole = language.Scorer(small_model()).predict(texts)
    monkeypatch.setattr(language, "MEMO_BYTES", 2000)
    scorer = language.Scorer(small_model())
    assert [f for t in texts for f in scorer.predict([t])] == whole
    assert len(scorer.index) <= 31 and max(map(len, scorer.index), default=0) <= language.MEMO_KEY
    import tidepost.llm.encoders as encoders

    path = default_path("word_bpe_49k.json")
    plain = WordIds(path).ids(texts)
    monkeypatch.setattr(encoders, "MEMO_BYTES", 1000)
    coder = WordIds(path)
    assert [x for t in texts for x in coder.ids([t])] == plain
    assert len(coder.memo) <= 60 and max(map(len, coder.memo), default=0) <= encoders.MEMO_KEY


def test_the_directory_decides_which_rows_meet(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('t', id % 130) AS text")
    whole = {r.doc_id: r.keep_id for r in exact.exact_groups(docs, capacity=8).collect()}
    assert whole == {i: i % 130 for i in range(400)}
    plain = exact._directory

    def broken(index, capacity, key_bits):
        directory, depth = plain(index, capacity, key_bits)
        return directory.where("slot % 2 = 0"), depth

    monkeypatch.setattr(exact, "_directory", broken)
    assert 0 < exact.exact_groups(docs, capacity=8).count() < 400


def test_hot_copies_and_collisions_in_them(spark):
    rows = [(i, "the same text " * (1 + i % 2)) for i in range(300)] + [(1000 + i, f"other {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits, most in ((64, exact.HOT_BYTES), (2, exact.HOT_BYTES), (2, 0)):
        exact_bytes, exact.HOT_BYTES = exact.HOT_BYTES, most
        try:
            found = exact.exact_groups(docs, key_bits=bits).collect()
        finally:
            exact.HOT_BYTES = exact_bytes
        assert len(found) == 1000
        of = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found}
        assert all(of[i] == (i % 2, 150, i < 2) for i in range(300)) and all(of[1000 + i] == (1000 + i, 1, True) for i in range(700))
