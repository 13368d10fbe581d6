"""License scan (operator 10) against exact containment everywhere."""

import random

import pytest

from aeris.llm import licenses
from tests.llm import frames


def plain(text, templates):
    words = licenses._folded(text or "")
    out = []
    for name, body in templates.items():
        t = licenses._folded(body)
        k = min(5, len(t))
        grams = {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
        n = licenses.window_class(len(t) - k + 1)
        here = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
        if any(len(grams & set(here[max(0, i):i + n])) >= 0.8 * len(grams) for i in range(len(here))):
            out.append(name)
    return sorted(out)


def names(spark, rows, templates=None):
    got = licenses.scanned(frames.documents(spark, rows), templates).collect()
    assert all(r["n_licenses"] == len([x for x in r["licenses"].split(",") if x]) for r in got)
    return [(r["doc_id"], [x for x in r["licenses"].split(",") if x]) for r in got]


def test_whole_copies_are_found_and_nothing_else(spark):
    rng = random.Random(0)
    rows = frames.edge_rows()
    for k, body in enumerate(licenses.TEMPLATES.values()):
        for j in range(6):
            rows.append((500 + 10 * k + j, f"{frames.sentence(rng, rng.randrange(90))} {body.upper() if j % 2 else body}\n"
                                           f"{frames.sentence(rng, rng.randrange(90))}"))
    text = dict(rows)
    for doc, found in names(spark, rows):
        if doc is not None and doc >= 500:
            assert found == plain(text[doc], licenses.TEMPLATES)
            assert list(licenses.TEMPLATES)[(doc - 500) // 10] in found
        elif doc is not None:
            assert found == []


def test_near_copies_of_long_templates(spark):
    """One word changed leaves 80 % of a long template's shingles: nearly all are found."""
    rng = random.Random(1)
    rows = []
    for i in range(120):
        name = ("GPL-3.0-header", "MIT-grant", "Apache-2.0-header")[i % 3]
        words = licenses.TEMPLATES[name].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, frames.sentence(rng, rng.randrange(60)) + " " + " ".join(words) + " " + frames.sentence(rng, 30)))
    text = dict(rows)
    wanted = {(d, n) for d, t in rows for n in plain(t, licenses.TEMPLATES)}
    got = {(d, n) for d, found in names(spark, rows) for n in found}
    assert len(got & wanted) >= 0.98 * len(wanted) and text
    assert len(wanted) > 100


def test_templates_of_other_sizes(spark):
    few = {"short": "two words", "none": "?", "same": "a b c d e f"}
    assert dict(names(spark, [(1, "x two, WORDS y"), (2, "two x words"), (3, "A b c d e f"), (4, None)], few)) == {
        1: ["short"], 2: [], 3: ["same"], 4: []}
    assert dict(names(spark, [(1, "x")], {})) == {1: []}


def test_whole_license_texts_and_usual_wordings(spark):
    rng = random.Random(2)
    table = licenses.default_templates()
    texts = [n for n in table if n.endswith("-text")]
    assert {"MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text", "Unlicense-text", "GPL-3.0-text"} <= set(texts)
    rows = []
    for k, name in enumerate(texts):
        words = table[name].split()
        rows.append((10 * k, f"{frames.sentence(rng, 50)} {table[name]} {frames.sentence(rng, 50)}"))
        words[len(words) // 2] = "changed"
        rows.append((10 * k + 1, f"{frames.sentence(rng, 7)} {' '.join(words)}"))
    rows += [(900, "This project is licensed under the MIT License, see there."), (901, "under the terms of the ISC license"),
             (902, "Distributed under the GNU Affero General Public License version 3"), (903, "released under CC BY-SA 4.0"),
             (904, table["LGPL-2.1-header"]), (905, table["BSD-2-Clause-text"] + table["BSD-3-Clause-text"]),
             (906, "This work is licensed under the GNU General Public License, version 3."), (907, "the MIT campus")]
    got = dict(names(spark, rows))
    for k, name in enumerate(texts):
        assert name in got[10 * k] and name in got[10 * k + 1]
        assert {n for n in got[10 * k] if n.endswith("-text")} == {name}
    kinds = {i: {licenses._license_of(n) for n in got[i]} for i in range(900, 908)}
    assert kinds[900] == {"MIT"} and kinds[901] == {"ISC"} and kinds[902] == {"AGPL-3.0"}
    assert kinds[903] == {"CC-BY-SA-4.0"} and "LGPL-2.1-header" in got[904]
    assert got[905] == ["BSD-2-Clause-text", "BSD-3-Clause-text"]
    assert got[906] == ["GPL-3.0"] and got[907] == []


def test_headers_of_one_license_do_not_name_another(spark):
    table = licenses.default_templates()
    rows = [(i, f"some words before {table[n]} and some after it") for i, n in enumerate(
        ["GPL-2.0-header", "AGPL-3.0-header", "LGPL-3.0-header", "LGPL-2.1-header", "GPL-3.0-header", "Apache-2.0-header"])]
    got = dict(names(spark, rows))
    assert [{licenses._license_of(n) for n in got[i]} for i in range(6)] == [
        {"GPL-2.0"}, {"AGPL-3.0"}, {"LGPL-3.0"}, {"LGPL-2.1"}, {"GPL-3.0"}, {"Apache-2.0"}]


def test_identifiers_and_further_wordings(spark):
    rows = [(1, "// SPDX-License-Identifier: MIT\nint main"), (2, "# SPDX-License-Identifier: GPL-3.0"),
            (3, "This project uses the MIT License."), (4, "covered by the MIT license"), (5, "spdx identifier of a license"),
            (6, "/* SPDX-License-Identifier: Apache-2.0 */"), (7, "SPDX-License-Identifier: LGPL-3.0")]
    got = {i: {licenses._license_of(n) for n in found} for i, found in names(spark, rows)}
    assert got == {1: {"MIT"}, 2: {"GPL-3.0"}, 3: {"MIT"}, 4: {"MIT"}, 5: set(), 6: {"Apache-2.0"}, 7: {"LGPL-3.0"}}


@pytest.mark.parametrize("n,size", [(1, 1), (2, 2), (3, 3), (5, 6), (7, 8), (9, 12), (13, 16), (25, 32), (33, 48)])
def test_window_classes(n, size):
    assert licenses.window_class(n) == size


def test_empty(spark):
    assert licenses.scanned(frames.empty(spark)).count() == 0
