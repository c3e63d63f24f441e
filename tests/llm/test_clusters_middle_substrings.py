"""Clusters, fill-in-middle cuts and repeated passages: hard rows, ties and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_data import HARD, words

from tidepost.llm import centroids, middle, substrings
from tidepost.llm.wavelet import WaveletMatrix

KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["cut", "form", "n", "key_1", "key_2", "parts", "first", "windows", "anchor", "print", "output", "v", "cluster"]


@pytest.fixture
def hard(spark):
    return spark.createDataFrame(HARD, KIND).withColumns({c: F.lit(c) for c in CLASH})


def brute_clusters(rows, k, rounds, scale, dims):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, centres)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, k, d in found if k == c) for _, c, _ in found}
    return [(i, c, d, inertia[c], sum(inertia.values()), centres[c]) for i, c, d in found]


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(3, rows[9][1]), (3, rows[9][1]), (None, rows[2][1]), (70, None), (71, [1.0, None, 0.0, 0.0]), (72, [1.0] * 5), (73, [])]
    rows += [(74, [float("nan")] * 4), (75, [float("-inf"), 0.0, 0.0, 0.0]), (76, [0.0] * 4), (77, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in CLASH})
    for k in (7, 100):
        found = centroids.centroid_clusters(table, k=k, dims=4, rounds=3, scale=64).collect()
        wanted = brute_clusters(rows, k, 3, 64, 4)
        order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted([(*r[:5], list(r[5])) for r in found], key=order) == sorted(wanted, key=order)
    none = centroids.centroid_clusters(table.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_an_empty_cluster_keeps_its_centroid(spark):
    table = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [9.0])], "vec_id long, embedding array<float>")
    whole = centroids.whole_vectors(table, "vec_id", "embedding", 1, 1)
    assert centroids.moved(whole, [[0], [0], [50]]) == [[3], [0], [50]]  # ties go to the smaller number
    assert centroids.moved(whole, [[-100], [1000]]) == [[3], [1000]]
    below = spark.createDataFrame([([-1],), ([-2],), ([-2],)], "v array<long>")
    assert centroids.moved(below, [[0]]) == [[-2]]  # the floor, also below zero


def test_wavelet_ranks_and_selects():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 8, n).astype(np.uint8)
        matrix = WaveletMatrix(classes)
        places = np.arange(n + 1)
        for symbol in range(8):
            assert (matrix.rank(symbol, places) == np.concatenate([[0], np.cumsum(classes == symbol)])).all()
        at = np.flatnonzero(np.isin(classes, (1, 6)))
        found = matrix.select((1, 6), np.arange(1, len(at) + 1), np.zeros(len(at), dtype=int), np.full(len(at), n))
        assert (found == at + 1).all()


def brute_boundaries(text, unit):
    """Places where units may part, with both ends."""
    if unit == "char":
        inner = range(1, len(text))
    elif unit == "line":
        inner = [m.end() for m in re.finditer("\n", text) if m.end() < len(text)]
    else:
        inner = [m.start() for m in re.finditer(r"[^\W_]+|(?:_|[^\w\s])+", text)][1:]
    return [0, *inner, len(text)] if text else [0]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_by_brute_force(unit):
    rng = random.Random(2)
    texts = ["", "a", " ", "\n", "\n\n a", "é中\U0001f600 x.", "..a b!", words(50)]
    texts += ["".join(rng.choice("ab é.\n_9") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    draws = [(rng.randrange(1 << 32), rng.randrange(1 << 32)) for _ in texts]
    for text, (a, b), (n, first, second) in zip(texts, draws, middle.cuts(texts, draws, unit)):
        places = brute_boundaries(text, unit)
        assert n == len(places) - 1
        assert [first, second] == sorted([places[a % (n + 1)], places[b % (n + 1)]])


def test_fill_in_middle_cases(spark, hard):
    more = [(100 + i, t, "", "", 0) for i, t in enumerate(["a <P> b", "<S>", "<M", "<" * 30, "P>S>" * 9, "\n", "中" * 77])]
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, KIND))
    docs = docs.withColumns({c: F.lit(c) for c in CLASH})
    for unit in middle.UNITS:
        found = middle.fill_in_middle(docs, unit=unit, percent=100, spm_percent=50)
        rows = found.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == len(HARD) + len(more) and all(r.back == r.text for r in rows)
        assert {r.doc_id for r in rows if r.form == "plain"} == {1, 2, 100, 101}
        assert {r.form for r in rows} == {"plain", "psm", "spm"}
        for r in rows:
            if r.form != "plain":
                text = r.text
                pre, mid, suf = text[: r.prefix_chars], text[r.prefix_chars : r.prefix_chars + r.middle_chars], text[r.prefix_chars + r.middle_chars :]
                assert r.output == (f"<P>{pre}<S>{suf}<M>{mid}" if r.form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")
    assert middle.fill_in_middle(docs.where("false")).count() == 0
    assert middle.fill_in_middle(docs.where("false"), percent=0).columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]


def brute_spans(texts, width):
    parted = [(t or "").encode().split() for t in texts]
    seen = {}
    for i, own in enumerate(parted):
        for s in range(len(own) - width + 1):
            seen.setdefault(tuple(own[s : s + width]), []).append((i, s))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i].update(range(s, s + width))
    return [(len(own), len(g), b" ".join(w for j, w in enumerate(own) if j not in g).decode()) for own, g in zip(parted, gone)]


@pytest.mark.parametrize("width,gram", [(6, 3), (5, 5), (4, 1), (35, 12)])
def test_passages_by_brute_force(spark, width, gram):
    rng = random.Random(width)
    letters = ["a", "b", "c,", "é", "中"]
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    texts += [words(90), "x " + words(90, 3) + "\x0by", words(200, 3), words(60) + " " + words(60), "same " * 80, "a b c " * 40, None, "", " \t\n", "q r " * 36]
    texts += [f"{words(20, i)} {words(40, 77)} {words(20, 50 + i)}" for i in range(12)]
    texts += texts[:3] + [words(10_000, 5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for bits in (8, 26):  # a full filter changes no row
        rows = sorted(substrings.repeated_passages(docs, width=width, gram=gram, filter_bits=bits).collect())
        assert [(r.n_words, r.n_removed, r.kept_text) for r in rows] == brute_spans(texts, width)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)


def test_passage_cases(spark, hard):
    rows = substrings.repeated_passages(hard).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in rows) == sorted(
        (str(r[0]), len((r[1] or "").encode().split()), 0) for r in HARD
    )
    twice = hard.where("doc_id = 5 OR doc_id IS NULL").unionByName(hard.where("doc_id = 5 OR doc_id IS NULL"))
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in substrings.repeated_passages(twice).collect()) == [
        ("5", 9000, ""), ("5", 9000, ""), ("None", 0, "no id here"), ("None", 0, "no id here"),
    ]
    assert substrings.repeated_passages(hard.where("false")).count() == 0
