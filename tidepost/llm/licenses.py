"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are whole license texts (``license_texts/``), those of their paragraphs that no other
license has, and the notices and headers that point to a license.

A text's words are cut into blocks of the template's size; two neighbouring blocks make a
window, so every run of words as long as a template lies whole in some window. One row per
band: a window and a template meet in a band if their minima under its hash agree, which
for Jaccard similarity ``s`` misses all ``bands`` with probability (1 - s) ** bands. A template
that is contained to 0.8 in a window of twice its size has s of about 0.36 or more, so
32 bands miss it less than once in a million; where the block is rounded up, once in some
thousands. What bands retrieve is verified on the exact word shingles of the window.

Licenses share most of their words with their relatives. A template that is like one of another
license counts only where at least half of the shingles that tell the two apart are found too,
and where templates of several licenses lie over the same words, the one that explains most
words wins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.shingles import mixed, runs, shingle_hashes, word_hashes

#: Notices that license texts and files carry, by SPDX-style name.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted",),
    "BSD-4-Clause": (
        "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    ),
    "ISC": ("Released under the ISC License.",),
    "CC0-1.0": (
        "has waived all copyright and related or neighboring rights to this work",
        "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under "
        "copyright law, including all related and neighboring rights, to the extent allowed by law",
    ),
    "EPL-1.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v1.0 which accompanies this distribution, and is available at",
        "Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC "
        "LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S "
        "ACCEPTANCE OF THIS AGREEMENT.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at",
        "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC "
        "LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S "
        "ACCEPTANCE OF THIS AGREEMENT.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "all-rights-reserved": ("All rights reserved.",),
}
SHINGLE = 5
LEAST = 0.8
BANDS = 32

#: The GNU licenses with their versions, and the Creative Commons licenses with theirs.
GNU = {
    "GPL": ("GNU General Public License", ("1", "2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "LGPL ": ("GNU Library General Public License", ("2",)),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}
COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
#: Words a paragraph needs to stand for its license, and the share of it that another license may have.
PARAGRAPH = 30
COMMON = 0.5


def family_notices() -> dict[str, list[str]]:
    """Headers and notices of the licenses that come in families, by license; without a version under the bare name."""
    out: dict[str, list[str]] = defaultdict(list)
    terms = "you can redistribute it and/or modify it under the terms of the"
    published = "as published by the Free Software Foundation"
    for short, (full, versions) in GNU.items():
        out[short.strip()].append(f"{terms} {full} {published}")
        for v in versions:
            out[f"{short.strip()}-{v if '.' in v else v + '.0'}"] += [
                f"{terms} {full} {published}; either version {v} of the License, or (at your option) any later version.",
                f"{terms} {full} {published}; version {v} of the License.",
                f"{terms} {full}, version {v}, {published}.",
                f"This work is licensed under the {full}, version {v}.",
                f"Released under the {full}, version {v}.",
            ]
    for short, full in COMMONS.items():
        for v, port in PORTS.items():
            out[f"CC-{short}-{v}"] += [
                f"Licensed under CC {short} {v}.",
                f"This work is licensed under a Creative Commons {full} {v} {port} License.",
                f"This work is licensed under the Creative Commons {full} {v} {port} License.",
                f"by the terms and conditions of this Creative Commons {full} {v} {port} Public License",
            ]
    return out


@lru_cache(1)
def known_templates() -> dict[str, tuple[str, ...]]:
    """All templates by license: texts, paragraphs of their own, notices, headers and SPDX tags."""
    texts = defaultdict(list)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        texts[path.stem.split("~")[0]].append(path.read_text(encoding="utf-8"))
    out = defaultdict(list)
    for source in (TEMPLATES, family_notices(), texts):
        for name, some in source.items():
            out[name] += some
    whole = {name: np.unique(_shingles(" \n\n ".join(some))) for name, some in out.items()}
    for name, some in texts.items():
        for text in some:
            for paragraph in text.split("\n\n"):
                if len(paragraph.split()) < PARAGRAPH:
                    continue
                own = np.unique(_shingles(paragraph))
                if all(np.isin(own, whole[n]).mean() < COMMON for n in whole if n != name):
                    out[name].append(paragraph)
    for name in set(out) - {"all-rights-reserved", "BSD", *(s.strip() for s in GNU)}:
        tags = (name, f"{name}-only", f"{name}-or-later") if "GPL-" in name or "GFDL-" in name else (name,)
        out[name] += [f"SPDX-License-Identifier: {tag}" for tag in tags]
    return {name: tuple(dict.fromkeys(some)) for name, some in out.items()}


def _shingles(text: str) -> np.ndarray:
    words, per_text, _ = word_hashes([text])
    return shingle_hashes(words, per_text, min(SHINGLE, max(1, len(words))))[0]


class Templates:
    """Templates with their exact shingles and band minima, by class of (width, block)."""

    def __init__(self, templates: dict[str, tuple[str, ...]], shingle: int, bands: int, least: float):
        self.salts = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        self.names: list[str] = []
        self.shingles: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.classes: dict[tuple[int, int], list[int]] = {}
        widths: dict[int, list[int]] = {}
        for name, texts in sorted(templates.items()):
            for text in texts:
                words, per_text, _ = word_hashes([text])
                if not len(words):
                    continue
                width = min(shingle, len(words))
                every = shingle_hashes(words, per_text, width)[0]
                step = 8 if len(every) < 256 else 1 << (len(every).bit_length() - 5)
                block = len(every) if len(every) < 8 else -(-len(every) // step) * step
                self.classes.setdefault((width, block), []).append(len(self.names))
                widths.setdefault(width, []).append(len(self.names))
                self.names.append(name)
                self.shingles.append(np.unique(every))
                self.lengths.append(len(every))
        self.minima = {
            key: np.array([[banded(self.shingles[m], salt).min() for m in members] for salt in self.salts])
            for key, members in self.classes.items()
        }
        #: All shingles of a width in order, and which of them the templates of a class have.
        self.known = {w: np.unique(np.concatenate([self.shingles[m] for m in ms])) for w, ms in widths.items()}
        self.of_class = {
            (w, block): np.isin(self.known[w], np.concatenate([self.shingles[m] for m in members]))
            for (w, block), members in self.classes.items()
        }
        #: For each template, what tells it from each like template of another license.
        self.apart: list[list[np.ndarray]] = [[] for _ in self.names]
        for width, members in widths.items():
            owner = np.repeat(members, [len(self.shingles[m]) for m in members])
            every = np.concatenate([self.shingles[m] for m in members])
            by_hash = np.argsort(every, kind="stable")
            every, owner = every[by_hash], owner[by_hash]
            for m in members:
                own = self.shingles[m]
                first, last = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
                shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(first, last)]), minlength=len(self.names))
                for other in np.flatnonzero(shared >= least * len(own)):
                    if self.names[other] != self.names[m] and shared[other] < len(own):
                        self.apart[m].append(np.setdiff1d(own, self.shingles[other], assume_unique=True))

    def held(self) -> dict[int, np.ndarray]:
        """By width, whether any template has a shingle with these first 20 bits."""
        out = {}
        for width, known in self.known.items():
            out[width] = np.zeros(1 << 20, dtype=bool)
            out[width][(known >> np.uint64(44)).astype(np.int64)] = True
        return out


def banded(shingles: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = (shingles ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def scan(
    texts: list[str | None], templates: Templates, least: float, held: dict[int, np.ndarray] | None = None
) -> list[tuple[int, str, float, int, int]]:
    """(text, license, containment, first word, end word): the best match of each license in each text."""
    held = held or templates.held()
    words, per_text, _ = word_hashes(texts)
    first_word = np.cumsum(per_text) - per_text
    matches: dict[int, list[tuple]] = defaultdict(list)
    for width, known in templates.known.items():
        shingles, counts, starts = shingle_hashes(words, per_text, width)
        if not len(shingles):
            continue
        # A window whose minimum equals a template's holds that shingle of the template, so
        # windows without any shingle of the class's templates meet none in any band.
        some = np.flatnonzero(held[width][(shingles >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(known, shingles[some]), len(known) - 1)
        real = known[place] == shingles[some]
        some, place = some[real], place[real]
        firsts = np.cumsum(counts) - counts
        ends = firsts + counts
        for (w, block), members in templates.classes.items():
            hits = some[templates.of_class[w, block][place]] if w == width else some[:0]
            if not len(hits):
                continue
            text_of = np.searchsorted(firsts, hits, side="right") - 1
            own_block = firsts[text_of] + (hits - firsts[text_of]) // block * block
            low = np.concatenate([own_block, own_block - block])
            owner = np.concatenate([text_of, text_of])
            inside_text = low >= firsts[owner]
            low, at = np.unique(low[inside_text], return_index=True)
            owner = owner[inside_text][at]
            high = np.minimum(low + 2 * block, ends[owner])
            # fewer shingles than the smallest template needs can hold none
            needed = least * min(len(templates.shingles[m]) for m in members)
            enough = np.searchsorted(hits, high) - np.searchsorted(hits, low) >= needed
            for begin, end, text in zip(low[enough], high[enough], owner[enough]):
                inside = shingles[begin:end]
                window = banded(inside[None, :], templates.salts[:, None]).min(axis=1)
                for at in np.flatnonzero((window[:, None] == templates.minima[w, block]).any(axis=0)):
                    m = members[at]
                    match = verified(inside, templates, m, least)
                    if match:
                        share, places = match
                        covered = np.unique(starts[begin + places][:, None] - first_word[text] + np.arange(width))
                        matches[int(text)].append((len(covered), share, templates.names[m], covered))
    return [(text, *row) for text in sorted(matches) for row in settled(matches[text])]


def verified(inside: np.ndarray, templates: Templates, m: int, least: float) -> tuple[float, np.ndarray] | None:
    """Containment of a template in a window, and the template's shingles in the run that has most of them."""
    own = templates.shingles[m]
    places = np.flatnonzero(np.isin(inside, own))
    share = len(np.unique(inside[places])) / len(own)
    if share < least:
        return None
    # the run is a quarter longer than the template, so that some inserted words do no harm
    room = templates.lengths[m] + templates.lengths[m] // 4
    last = np.searchsorted(places, places + room)
    best = int(np.argmax(last - np.arange(len(places))))
    places = places[best : last[best]]
    found = inside[places]
    if any(2 * np.isin(apart, found).sum() < len(apart) for apart in templates.apart[m]):
        return None
    return share, places


def settled(matches: list[tuple]) -> list[tuple[str, float, int, int]]:
    """(license, containment, first word, end word) of one text: rivals over the same words give way.

    The match that covers most words stands first, then the more complete one. A match gives way
    if other licenses have taken more than half of its words.
    """
    taken: dict[str, set[int]] = defaultdict(set)
    best: dict[str, tuple[str, float, int, int]] = {}
    for size, share, name, covered in sorted(matches, key=lambda m: (-m[0], -m[1], m[3][0], m[2])):
        own = set(covered.tolist())
        rivals = set().union(*(own & words for rival, words in taken.items() if rival != name))
        if 2 * len(rivals) > size:
            continue
        taken[name] |= own
        best.setdefault(name, (name, share, int(covered[0]), int(covered[-1]) + 1))
    return [best[name] for name in sorted(best)]


def find_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] | DataFrame | None = None,
    shingle: int = SHINGLE,
    least: float = LEAST,
    bands: int = BANDS,
) -> DataFrame:
    """Licenses in each document: doc_id, license, containment, first_word, end_word.

    One row per document and license with a template of which at least ``least`` of
    the distinct ``shingle``-word shingles lie in one window of the text: the place that covers
    most words, then the most complete, then the first. Where licenses lie over the same words, only
    the one that covers most of them is given. Templates shorter than a shingle are one shingle.
    ``templates`` are texts by license, or a table ``license, text`` of them; by default
    ``known_templates``. The list is held in each task, so it must fit there. Words are counted from
    0, in lower case. Null and empty texts match nothing; repeated rows match one for one;
    whole texts are read, however long.
    """
    if isinstance(templates, DataFrame):
        listed = defaultdict(list)
        for row in templates.select("license", "text").dropna().collect():
            listed[row["license"]].append(row["text"])
        templates = {name: tuple(some) for name, some in listed.items()}
    ready = Templates(known_templates() if templates is None else templates, shingle, bands, least)
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = ready.held()
        for batch in batches:
            ids, out = batch["doc_id"].tolist(), []
            for first, run in runs(batch["text"].tolist()):
                out += [(ids[first + m[0]], *m[1:]) for m in scan(run, ready, least, held)]
            yield pd.DataFrame(out, columns=["doc_id", "license", "containment", "first_word", "end_word"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInPandas(
        find, f"doc_id {id_type}, license string, containment double, first_word long, end_word long"
    )
