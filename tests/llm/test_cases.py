"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_data import HARD, words

from tidepost.llm import chat, exact, language, licenses, mixing, near, neighbours, packing, tokens, urls
from tidepost.llm.components import components
from tidepost.llm.shingles import mixed as mix_bits

KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "link", "norm", "size", "taken", "node", "label", "uid", "bands", "__keep_x", "score", "copies"]


@pytest.fixture
def hard(spark):
    rows = spark.createDataFrame(HARD, KIND)
    return rows.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture
def empty(hard):
    return hard.where("false")


def test_exact_cases(spark, hard, empty):
    rows = exact.exact_groups(hard).collect()
    assert len(rows) == len(HARD)
    of = {r.doc_id: r for r in rows if r.doc_id != 6}
    assert {of[i].group_size for i in (1, 2, 3)} == {3} and of[1].keep_id == 3 and of[3].kept
    assert sorted(r.kept for r in rows if r.doc_id == 6) == [False, True] and of[None].kept
    single = exact.drop_exact_copies(hard)
    assert single.columns == hard.columns
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted(["3", "4", "5", "6", "7", "None"])
    assert exact.exact_groups(empty).count() == 0 and exact.drop_exact_copies(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 3])
def test_exact_chains_collisions(spark, bits):
    texts = [f"text {i % 23}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = exact.exact_groups(docs, key_bits=bits, capacity=2).collect()
    assert {r.doc_id: r.keep_id for r in rows} == {i: i % 23 for i in range(200)}
    assert all(r.group_size == texts.count(texts[r.doc_id]) for r in rows)


def test_directory_splits_only_overfull_buckets(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('t', id) AS text")
    entries = exact._keyed(docs, "doc_id", "text", 64)
    index = exact.build_index(entries, 20, 64)
    held = index.groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in held) == 500 and max(r["count"] for r in held) <= 20
    assert len({r.local_depth for r in held}) > 1


def test_token_cases(hard, empty):
    from tokenizers import Tokenizer

    from tidepost.llm.encoders import default_path

    exactly = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    rows = tokens.with_token_counts(hard, split_chars=1000, batch_bytes=3000).collect()
    wanted = [len(exactly.encode(r[1] or "", add_special_tokens=False).ids) for r in HARD]
    assert [r.n_tokens for r in rows] == wanted and tokens.with_token_counts(empty).count() == 0


def test_segments_add_up():
    text = "ab  cd\n\nef gh " * 50
    parts = tokens.segments(text, 7)
    assert "".join(parts) == text and len(parts) > 10


def test_packing_cases(spark, hard, empty):
    rows = packing.pack_documents(hard).collect()
    assert len([r for r in rows if r.doc_id in (1, 2, 3)]) == 3 and len([r for r in rows if r.doc_id == 6]) == 2
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert packing.pack_documents(empty).count() == 0
    # many blocks and rounds: every piece once, close to the bound
    pieces = spark.range(3000).selectExpr("id", "1 + (id * 7919) % 900 AS length")
    out = packing.pack(pieces, block=200).collect()
    assert len({r.id for r in out}) == 3000
    least = -(-sum(r.length for r in out) // 2048)
    assert len({r.sequence_id for r in out}) <= least + 3
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(5000,)], "length long"))


def test_child_keeps_every_piece():
    import random

    rng = random.Random(1)
    lengths = [rng.randint(1, 1500) for _ in range(200)]
    a, b = packing.first_population(lengths, 2048, 2, rng)
    bins, rooms = packing.crossover(a, b, lengths, 2048, 0.6, rng)
    assert sorted(i for own in bins for i in own) == list(range(200))
    assert rooms == [2048 - sum(lengths[i] for i in own) for own in bins] and min(rooms) >= 0


def test_language_cases(spark, hard, empty):
    train = spark.createDataFrame(
        [("the house and the garden", "en"), ("das Haus und der Garten", "de"), (None, "en"), ("odd", None)], "text string, lang string"
    )
    model = language.fit(train)
    rows = {r.doc_id: r for r in language.with_language(hard, model).collect()}
    assert {rows[i].lang_pred for i in (1, 2, 3)} == {"und"} and rows[1].score == 0
    assert rows[6].lang_pred in ("en", "de") and language.with_language(empty, model).count() == 0
    assert language.words_of("x² ² ½ 7 été") == ["x²", "été"]
    nothing = language.fit(train.where("false"))
    assert {r.lang_pred for r in language.with_language(hard, nothing).collect()} == {"und"}
    assert language.judged(hard, model, "__j").drop("__j").columns == hard.columns


def test_forward_sum_is_the_sum_over_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    probs = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.3], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0, 0], [0.01, 0.01]])
    lattice = language.Lattice(pieces)

    def brute(text, k):
        if not text:
            return 1.0
        own = dict(zip(pieces, probs[:-2, k]))
        return sum(
            (own.get(text[:n], probs[-1, k] if n == 1 else 0)) * brute(text[n:], k) for n in range(1, len(text) + 1)
        )

    found = language.segment_sums(["abba", "ab", "xa"], lattice, probs)
    for i, word in enumerate(["abba", "ab", "xa"]):
        assert np.allclose(np.exp(found[i]), [brute("▁" + word, k) for k in range(2)])


def test_mix_cases(spark, hard, empty):
    rows = mixing.mix(hard).collect()
    assert len(rows) == len(HARD) and {r.taken for r in rows if r["size"] == 0} == {0}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(hard).columns == hard.columns
    assert mixing.mix(hard.where("doc_id < 4")).agg(F.sum("taken")).first()[0] == 0


def test_near_cases(spark, hard, empty):
    rows = near.near_groups(hard).collect()
    assert len(rows) == len(HARD) and all(r.class_size == 1 for r in rows if r.doc_id != 6)
    assert sorted(r.kept for r in rows if r.doc_id == 6) == [False, True]
    assert near.near_groups(empty).count() == 0 and near.drop_near_copies(hard).columns == hard.columns


def test_near_group_without_a_centre(spark):
    # a chain: each text is close to the next, ends are far apart
    base = words(100).split()
    rows = [(i, " ".join(base[:0] + [f"n{i}_{j}" for j in range(0)] + base[5 * i : 5 * i + 60])) for i in range(8)]
    rows += [(100 + i, words(60, 5 + i)) for i in range(5)]
    found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), least=0.8).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: 0 for i in range(8)} | {100 + i: 100 + i for i in range(5)}


def test_links_between_classes_in_blocks():
    rng = np.random.default_rng(0)
    base = np.unique(mix_bits(rng.integers(0, 1 << 62, 200).astype(np.uint64)).view(np.int64))
    sets = [np.sort(np.concatenate([base[10 * i : 10 * i + 100], np.arange(i)])) for i in range(6)]
    nodes = np.arange(6)
    found = near.linked_within(nodes, nodes, np.zeros(6, int), sets, 0.8)
    brute = [
        (i, j) for i in range(6) for j in range(i + 1, 6)
        if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    ]
    assert found == brute and len(brute) == 5


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    a = rng.integers(0, 9, 40)
    b = np.maximum(0, a + rng.integers(-3, 4, 40))
    owner = np.repeat([0, 1], [int((a > 0).sum()), int((b > 0).sum())])
    equal = []
    for salt in range(60):
        own = mix_bits(items + np.uint64(salt))
        signed = near.bag_min_hash(owner, np.concatenate([own[a > 0], own[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 128)
        equal.append((signed[0] == signed[1]).mean())
    assert abs(np.mean(equal) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_license_cases(spark, hard, empty):
    assert licenses.find_licenses(hard).count() == 0 and licenses.find_licenses(empty).count() == 0
    text = f"{words(700)} licensed UNDER the Apache license version 2.0 {words(300, 2)}"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "Licensed under the MIT")], "doc_id long, text string")
    rows = licenses.find_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.first_word, r.end_word) for r in rows] == [(1, "Apache-2.0", 700, 708)] * 2


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b.net", "/", "allow")]


def test_url_cases(spark):
    urls_of = [
        None, "", "no scheme", "http://NET", "http://x.net/", "http://example.net/en/a?x", "http://www.EXAMPLE.net/en/",
        "http://badexample.net/en/", "http://q.a.b.net/?", "ftp://u@h.org:8/p#f", "http://net#/", "x" * 5000 + "://net/" + "y" * 90000,
    ]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls_of)] * 2, "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = urls.url_verdicts(pages, rules).collect()
    assert len(rows) == 2 * len(urls_of)
    rule = {r.page_id: r.rule for r in rows}
    assert [rule[i] for i in range(12)] == [
        None, None, None, None, "net/", "example.net/en/", "example.net/en/", "net/", "a.b.net/", None, None, "net/",
    ]
    assert {r.verdict for r in urls.url_verdicts(pages, rules.where("false")).collect()} == {"allow"}
    assert urls.url_verdicts(pages.where("false"), rules).count() == 0


def test_bloom_filter_has_no_false_negatives_at_any_size(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    own = np.array([r.key for r in keys.collect()])
    others = np.array([r.key for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("key")).collect()])
    for size, most in ((1 << 20, 0.05), (640, 1.0)):
        held = urls.bloom_filter(keys, size)
        assert held.nbytes <= max(size, 64) and urls.may_hold(held, own).all()
        assert urls.may_hold(held, others).mean() <= most


def test_chat_cases(spark):
    texts = ["\\", "\\\\", "###", "####", "</turn>", "</turn", "\\h\\e\\n", "### x\n</turn>\n", "", None, "é中\U0001f600 a", "\n\n  x "]
    rows = [(1, i, "assistant" if i % 2 else "us###er\n", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, None, "user", None), (3, 1, "user", "x")]
    turns = spark.createDataFrame(rows + rows[-1:], "conv_id long, turn long, role string, text string")
    for chars in (1, 1 << 20):
        formatted = chat.format_conversations(turns, segment_chars=chars)
        back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
        assert back[1].n_turns == len(texts) and back[3].n_turns == 2 and back[None].n_turns == 1
        assert back[1].loss_chars == sum(len(t or "") for t in texts[1::2])
    parsed = chat.parse(chat.render([("r\n###", t or "") for t in texts])[0])
    assert parsed == [("r\n###", t or "") for t in texts]
    assert chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0
    token = chat.format_conversations(turns.where("conv_id = 1")).first()
    assert len(token.input_ids) == len(token.loss_mask) and any(token.loss_mask) and not all(token.loss_mask)


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(20, rows[3][1]), (901, None), (902, [1.0, None]), (903, [float("nan")]), (904, []), (None, rows[7][1]), (905, [0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.top_k(table, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    whole = []
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, np.pad(np.floor(64 * np.float32(v).astype(float)), (0, 6 - len(v))).astype(int)))
    for at, (i, q) in enumerate(whole):
        if i is None or i % 20 or i == 20:
            continue
        others = [(-int(q @ v), j is None, j) for k, (j, v) in enumerate(whole) if k != at]
        assert [(-s, j) for s, _, j in sorted(others, key=lambda o: (o[0], o[1], o[2] or 0))[:7]] == got[i]
    assert len(got[20]) == 14
    assert neighbours.top_k(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
