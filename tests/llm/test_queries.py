"""Registered queries against their SQL, and what SQL cannot state against brute force."""

import collections
import hashlib
import zlib

import compare
import numpy as np
import pytest
from conftest import SMALL

import __spark_entry__ as contract
import corpus_pipeline
from tidepost.llm import queries

TABLES = compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    columns, rows = compare.spark_rows(queries.QUERIES[name](spark, SMALL))
    wanted_columns, wanted = compare.sql_rows(TABLES, queries.ORACLES[name])
    assert columns == wanted_columns and rows == wanted and rows


def test_all_are_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def documents():
    return TABLES.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    from tidepost.llm.encoders import default_path

    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in queries.op7(spark, SMALL).collect()}
    for doc_id, text, _, _ in documents():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        row = found.pop(doc_id)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 512)
    assert not found


def test_packing_places_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    from tidepost.llm.encoders import default_path

    tokenizer = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    rows = queries.op4(spark, SMALL).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    total = 0
    for doc_id, text, _, _ in documents():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own, row = ids[start : start + 2048], pieces.pop((doc_id, piece))
            assert (row.start, row.length, row.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
    assert not pieces
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert len(sequences) <= -(-total // 2048) + 2


def test_language_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.op3(spark, SMALL).collect()}
    held = [d for d in documents() if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert {k for k, r in rows.items() if r.held_out} == {d[0] for d in held}
    right = [rows[d[0]].lang_pred == d[2] for d in held]
    assert sum(right) >= 0.97 * len(right) and all(0 <= r.score <= 1 for r in rows.values())


def test_mixing_by_brute_force(spark):
    rows = queries.op8(spark, SMALL).collect()
    sizes = {d[0]: len([w for w in __import__("re").split("[ \t-\r]+", d[1] or "") if w]) for d in documents()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    of = collections.defaultdict(int)
    source = {d[0]: d[3] for d in documents()}
    for doc_id, n in sizes.items():
        of[source[doc_id]] += n
    names = sorted(of)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, set(names), 1.5 * sum(of.values())
    while rest:
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 2 * of[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * of[s] for s in over}
        rest -= over
        left -= sum(2 * of[s] for s in over)
    taken = collections.defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == of[s] and abs(r.target - target[s]) < 1e-6 * target[s]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    largest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest for s in names)
    assert sorted(map(tuple, queries.op8(spark, SMALL).collect())) == sorted(map(tuple, rows))


def bags(text):
    import re

    words = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return None
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(docs):
    own = {d[0]: bags(d[1]) for d in docs}
    parent = {k: k for k in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(k for k in own if own[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = sum((own[a] & own[b]).values())
            if both >= 0.8 * (sum(own[a].values()) + sum(own[b].values()) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in own}


def test_near_classes_by_brute_force(spark):
    rows = queries.op9(spark, SMALL).collect()
    wanted = brute_classes(documents())
    assert {r.doc_id: r.class_id for r in rows} == wanted
    sizes = collections.Counter(wanted.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)


def test_licenses_by_plain_search(spark):
    found = {(r.doc_id, r.license) for r in queries.op6(spark, SMALL).collect() if r.containment == 1.0}
    plain = {
        "Apache-2.0": "licensed under the apache license, version 2.0",
        "MIT": "released under the mit license",
        "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
        "GPL-3.0": "this work is licensed under the gnu general public license, version 3",
        "all-rights-reserved": "all rights reserved",
    }
    wanted = {(d[0], k) for d in documents() for k, v in plain.items() if v in (d[1] or "").lower()}
    assert wanted and wanted == found


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    plain = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["language ID"](spark, docs, SMALL)
    kept = {r.doc_id for r in judged.collect()}
    assert kept == {k for k, t in plain.items() if t and any(c.isalpha() for c in t)} and judged.columns == docs.columns
    single = stages["exact dedup"](spark, docs, SMALL)
    digest = {hashlib.sha256("".join(c for c in (t or "") if c not in " \t\n\v\f\r").encode()).digest() for t in plain.values()}
    assert single.count() == len(digest) and single.columns == docs.columns
    near = stages["MinHash near-dedup"](spark, docs, SMALL)
    assert {r.doc_id for r in near.collect()} == set(brute_classes(documents()).values())
    mixed = stages["mixing sources"](spark, docs, SMALL)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken // max(1, r["size"]) for r in queries.op8(spark, SMALL).collect()}
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert times == {k: n for k, n in taken.items() if n}
    assert corpus_pipeline.run(spark, SMALL).count() > 0
