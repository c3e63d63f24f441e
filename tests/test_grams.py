"""Terms in texts by the gram index, on all its ways, against plain ``in``."""

import random

import duckdb
import pytest

from tidepost.operators import grams, sentiment

WAYS = {"code": {"few": 10**6}, "index": {"few": 0}, "join": {"few": 0, "most_bytes": 0}}


def material(seed=4):
    rng = random.Random(seed)
    letters = "abcé中 .\n😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    terms = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    terms += [texts[0][:30], texts[1], "Ab", "AB", "ab", "", "nowhere", "É"]
    return texts + [None, "", texts[0], "a" * 5000 + "bcé"], terms


@pytest.mark.parametrize("way", WAYS)
def test_found_terms(spark, way):
    texts, terms = material()
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, text string, term int").repartition(3)
    table = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    found = grams.with_found_terms(rows, rows["text"], table, "hits", **WAYS[way])
    assert found.columns == ["id", "text", "term", "hits"]
    known = sorted({t.lower() for t in terms if t})
    for r in found.collect():
        assert r.hits == [t for t in known if t in (r.text or "").lower()]
    assert found.count() == len(texts)
    none = grams.with_found_terms(rows, rows["text"], table.where("false"), "hits", **WAYS[way])
    assert {tuple(r.hits) for r in none.collect()} == {()}
    assert grams.with_found_terms(rows.where("false"), rows["text"], table, "hits", **WAYS[way]).count() == 0


@pytest.mark.parametrize("way", WAYS)
def test_lexicon_table_equals_the_list_form(spark, way):
    texts, terms = material(9)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = [t for t in terms if t]
    good, bad = terms[::2], terms[1::3]
    table = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad] + [("x", None), (None, True)], "term string, positive boolean")
    want = sentiment.with_lexicon_sentiment(rows, positive=good, negative=bad).orderBy("id").collect()
    assert sentiment.with_lexicon_table(rows, table, **WAYS[way]).orderBy("id").collect() == want


def test_work_follows_hits_not_terms():
    terms = [f"term{i:06d}" for i in range(20_000)]
    index = grams.TermIndex(terms)
    tested = 0

    class Counted(list):
        def __iter__(self):
            nonlocal tested
            tested += len(self)
            return super().__iter__()

    index.terms = [Counted(t) for t in index.terms]
    assert index.find(["nothing of interest here " * 50, "some term000123 and term019999"]) == [[], ["term000123", "term019999"]]
    assert tested < 200


def test_terms_that_share_grams_with_a_text_are_not_tested():
    parts = [a + b for a in "bdgklmnprst" for b in "aeiou"]
    index = grams.TermIndex([a + b + c for a in parts[:25] for b in parts[:25] for c in parts[:25]])
    tested = 0

    class Counted(list):
        def __iter__(self):
            nonlocal tested
            tested += len(self)
            return super().__iter__()

    index.terms = [Counted(t) for t in index.terms]
    # every gram of these words is one of a term's, no word is as long as a term
    assert index.find([" ".join(a + b for a in parts[:25] for b in parts[:25])]) == [[]]
    assert tested == 0


def test_a_long_list_of_terms_is_looked_up_not_tested_one_by_one(spark):
    texts, terms = material(5)
    good, bad = [f"{t}é" for t in terms] + terms[:200], terms[100:]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = sentiment.with_lexicon_sentiment(rows, positive=good, negative=bad)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()

    def hits(text, side):
        return sum(t in (text or "").lower() for t in {t.lower() for t in side if t})

    for r in found.collect():
        p, n = hits(r.text, good), hits(r.text, bad)
        assert r.sentiment == ("positive" if p > n else "negative" if n > p else "neutral")
        assert r.sentiment_score == (0.5 if p == n else round(max(p, n) / (p + n), 3))


def test_each_run_of_a_batch_is_hashed_once_however_often_it_stands(monkeypatch):
    hashed, own = 0, grams.Windows.hashes

    def counted(self, starts, sizes):
        nonlocal hashed
        hashed += len(starts)
        return own(self, starts, sizes)

    index = grams.TermIndex(["alpha", "bet", "pha", "gammas", "lph"])
    monkeypatch.setattr(grams.Windows, "hashes", counted)
    assert index.find(["Alpha, alpha beta gamma. 1 " * 200] * 50) == [["alpha", "bet", "lph", "pha"]] * 50
    assert hashed < 200


def test_both_sides_of_a_lexicon_are_found_in_one_look_up(spark):
    rows = spark.createDataFrame([(1, "term001é, a term999"), (2, None), (3, "TERM001 term002"), (4, "term998")], "id long, text string")
    lexicon = spark.range(1000).selectExpr("format_string('term%03d', id) term", "id % 2 = 0 positive")
    lexicon = lexicon.unionByName(spark.createDataFrame([("term002", False), ("TERM998", None)], lexicon.schema))
    found = sentiment.with_lexicon_table(rows, lexicon)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.id: (r.sentiment, r.sentiment_score) for r in found.collect()}
    assert got == {1: ("negative", 1.0), 2: ("neutral", 0.5), 3: ("negative", 0.667), 4: ("positive", 1.0)}


@pytest.mark.parametrize("hashes", ["own", "all alike"])
def test_found_terms_are_exact_in_pieces_of_any_size_and_when_hashes_meet(monkeypatch, hashes):
    texts, terms = material(11)
    texts = ["" if t is None else t.lower() for t in texts] + ["é" * 70, "😀中" * 9, "\n"]
    known = sorted({t.lower() for t in terms if t})
    want = [[k for k in known if k in t] for t in texts]
    if hashes == "all alike":
        monkeypatch.setattr(grams, "_mixed", lambda h: h & grams.np.uint64(3))
    for sizes in ((1 << 23, 1 << 20, 1 << 21), (1 << 10, 7, 20), (64, 7, 1), (1, 1, 1)):
        for name, size in zip(("TEXT_BYTES", "RUN_BYTES", "PAIRS"), sizes):
            monkeypatch.setattr(grams, name, size)
        assert grams.TermIndex(known).find(texts) == want
    assert grams.TermIndex([]).find(texts) == [[] for _ in texts]
    assert grams.TermIndex(known).find([]) == []


def test_scores_round_as_the_sql_does(spark):
    counts = [(203, 197), (197, 203), (9, 7), (1023, 977), (2, 1), (3, 3), (0, 0), (0, 5), (1449, 1351)]
    counts += [(p, n) for p in range(0, 420, 7) for n in range(0, 420, 3)]
    rows = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(counts)], "i int, p int, n int")
    _, score = sentiment.score_hits(rows["p"], rows["n"])
    got = [r.s for r in rows.select("i", score.alias("s")).orderBy("i").collect()]
    share = "CASE WHEN p = n THEN 0.5::DOUBLE ELSE round_even(greatest(p, n)::DOUBLE / (p + n), 3)::DOUBLE END"
    want = duckdb.sql(f"SELECT {share} FROM (SELECT unnest(?) AS p, unnest(?) AS n)", params=[[p for p, _ in counts], [n for _, n in counts]])
    assert got == [s for (s,) in want.fetchall()]
    assert got[:3] == [0.507, 0.507, 0.562]
