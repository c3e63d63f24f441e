"""Licenses against their near relatives."""

import pytest

from tidepost.llm import licenses

GNU = (
    "you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; "
    "either version {} of the License, or (at your option) any later version."
)
CASES = {
    GNU.format("GNU General Public License", "1"): {"GPL-1.0"},
    GNU.format("GNU General Public License", "2"): {"GPL-2.0"},
    GNU.format("GNU General Public License", "3"): {"GPL-3.0"},
    GNU.format("GNU Library General Public License", "2"): {"LGPL-2.0"},
    GNU.format("GNU Lesser General Public License", "2.1"): {"LGPL-2.1"},
    GNU.format("GNU Lesser General Public License", "3"): {"LGPL-3.0"},
    GNU.format("GNU Affero General Public License", "3"): {"AGPL-3.0"},
    GNU.format("GNU General Public License", "3").split(";")[0]: {"GPL"},
    "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
    "This work is licensed under the GNU General Public License, version 7.": set(),
    "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-3.0"},
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"CC-BY-4.0"},
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0"},
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": {"CC-BY-SA-3.0"},
    "Licensed under CC BY-NC-ND 4.0.": {"CC-BY-NC-ND-4.0"},
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at https://www.eclipse.org/legal/epl-2.0/": {"EPL-2.0"},
    "SPDX-License-Identifier: MIT-0": {"MIT-0"},
    GNU.format("GNU General Public License", "2") + " Alternatively, "
    + GNU.format("GNU Lesser General Public License", "3"): {"GPL-2.0", "LGPL-3.0"},
}


@pytest.fixture(scope="module")
def found(spark):
    def names(texts, **kw):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = [set() for _ in texts]
        for r in licenses.find_licenses(docs, **kw).collect():
            out[r.doc_id].add(r.license)
        return out

    return names


def test_headers_of_relatives(found):
    assert dict(zip(CASES, found([f"some words before it. {c} some words after it." for c in CASES]))) == CASES


def test_whole_texts_and_bodies(found):
    from pathlib import Path

    texts = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    assert len({t.split("~")[0] for t in texts}) >= 26
    every = found([f"{'word ' * 500}{t} {'other ' * 500}" for t in texts.values()])
    assert dict(zip(texts, every)) == {t: {t.split("~")[0]} for t in texts}
    bodies = {
        # the grant alone, the conditions alone, a text in comment marks with a line of it missing
        "MIT": texts["MIT"].split("\n\n")[0],
        "Apache-2.0": texts["Apache-2.0"][2000:8000],
        "BSD-3-Clause": texts["BSD-3-Clause"].replace("\n", "\n# "),
        "GPL-2.0": texts["GPL-2.0"].replace("\n", "\n * ")[:-2500],
        "MPL-2.0": texts["MPL-2.0"][3000:9000],
    }
    assert found(bodies.values()) == [{name} for name in bodies]


def test_templates_from_a_table(spark, found):
    rows = [("House-1", "Only the house of the seven gables may copy this"), ("House-1", None), (None, "x"), ("House-2", "")]
    table = spark.createDataFrame(rows, "license string, text string")
    texts = ["yes: only the house of the seven gables may copy this.", "Released under the MIT License."]
    assert found(texts, templates=table) == [{"House-1"}, set()]
    assert found(texts, templates=table.where("false")) == [set(), set()]
