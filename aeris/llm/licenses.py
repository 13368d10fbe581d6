"""License scan by MinHash bands over text windows (operator 10, native).

Words are maximal runs of letters, digits and non-ASCII characters after the
A-Z fold; shingles are ``SHINGLE`` words. Every template has a window length:
its number of shingles rounded up to a class of 1, 2, 3, 4, 6, 8, 12, ... A
text is cut into overlapping windows of each class that occurs, an eighth of a
window apart. The signature of a window or a template is its ``BANDS`` least
shingle hashes (a bottom-k MinHash; every value is a band of one row). A window
that shares a band with a template of its class retrieves it.

A template of m shingles of which a share c stands together in a window of
n >= m shingles misses all b bands with a probability of at most (1 - J)^b,
J = c m / (n + (1 - c) m): below 2 % for c = 0.8 and the tightest window with
b = 6, and three or more windows overlap any such place; a whole copy in a
window of its own length shares every band.

Verification is exact: the share of the template's different shingles, as text,
that stand in the window and the stride beside it must reach ``SIMILARITY``.

Templates are a parameter of bounded size and become constants of the plan, so
nothing is joined or shuffled: one row in, one row out, at any size. The default
table is ``TEMPLATES``, the notice wordings of ``notices`` and the whole license
texts in ``license_texts/``. Of the last two a template is left out where another
template that holds it explains the text better (BSD-2-Clause inside BSD-3-Clause).

Defined results: null, empty and short texts match nothing; a template of fewer
words than a shingle is its whole word sequence as one shingle and only
retrieved by windows of that many words; repeated rows stay; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import LOWER, UPPER, folded_words, let, table
from aeris.llm.winnowing import kgram_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 6
# License notices as they are printed.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                         "file except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of "
                      "the GNU General Public License as published by the Free Software Foundation, either version 3 "
                      "of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Titles as notices name them, each with every one of ``WORDINGS``.
TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3.0",
                 "GNU AGPL v3", "AGPL-3.0 License"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2.0", "Apache-2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2 License"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3 License"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"],
    "Unlicense": ["The Unlicense"],
}
WORDINGS = ("licensed under", "released under", "distributed under", "available under", "under the terms of",
            "covered by", "uses")
# Words of the shortest notice: fewer are too likely to stand together by chance.
LEAST_WORDS = 4
# How a source file names its license by identifier.
IDENTIFIER = "SPDX-License-Identifier: {0}"
HEADER = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General "
          "Public License as published by the Free Software Foundation, either version {3} of the License, or (at "
          "your option) any later version.")
HEADERS = {
    "AGPL-3.0-header": HEADER.format("program", ":", "Affero ", "3"),
    "GPL-2.0-header": HEADER.format("program", ";", "", "2"),
    "LGPL-2.1-header": HEADER.format("library", ";", "Lesser ", "2.1"),
    "LGPL-3.0-header": HEADER.format("library", ":", "Lesser ", "3"),
}


def _folded(text: str) -> list[str]:
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def notices() -> dict[str, str]:
    """Usual wordings and identifiers by name; of the same words once, and none that
    ``TEMPLATES`` has."""
    out, seen = dict(HEADERS), {" ".join(_folded(body)) for body in TEMPLATES.values()}
    for license_id, titles in TITLES.items():
        k = 0
        for title in titles:
            for wording in WORDINGS:
                for article in ("", "the ") if not title.startswith("The ") else ("",):
                    body = f"{wording} {article}{title}"
                    words = _folded(body)
                    if len(words) >= LEAST_WORDS and " ".join(words) not in seen:
                        seen.add(" ".join(words))
                        k += 1
                        out[f"{license_id}-notice{k}"] = body
        out[f"{license_id}-identifier"] = IDENTIFIER.format(license_id)
    return out


def default_templates() -> dict[str, str]:
    """The whole template table; its texts are read on the driver."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in
             sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return {**notices(), **texts, **TEMPLATES}


def window_class(shingles: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, 16, ... that is not below ``shingles``."""
    n = 1
    while n < shingles:
        n = 3 * n // 2 if n & (n - 1) == 0 and n > 1 else 4 * n // 3 if n > 1 else 2
    return n


def _signatures(spark: SparkSession, templates: dict[str, str], shingle: int, bands: int):
    """(name, gram, class, shingles, bands) of every template, hashed by Spark's own function."""
    rows = []
    for name, text in sorted(templates.items()):
        words = _folded(text)
        if words:
            k = min(shingle, len(words))
            grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
            rows.append((name, k, window_class(len(grams)), list(dict.fromkeys(grams)), words))
    if not rows:
        return []
    frame = spark.createDataFrame(rows, "name string, k int, class int, grams array<string>, words array<string>")
    out = []
    for k in sorted({r[1] for r in rows}):
        hashes = F.slice(F.sort_array(F.array_distinct(kgram_hashes(F.col("words"), k))), 1, bands)
        out += frame.where(F.col("k") == k).withColumn("bands", hashes).collect()
    return out


FOUND = "array<struct<name:string,share:double>>"


def _literal(grams) -> Column:
    """An array constant: folded from one string, however many shingles there are."""
    return F.split(F.lit("\n".join(grams)), "\n")


def _license_of(name: str) -> str:
    return re.sub("-(?:text|header|grant|identifier|notice[0-9]+)$", "", name)


def _yielding(signed) -> tuple[list[str], list[str]]:
    """Pairs "a>b": notices, headers and whole texts a of which b holds ``SIMILARITY``.
    The first list yields to a greater share of b, the second (one license, the ten of
    ``TEMPLATES`` left out) to the same."""
    own = {t["name"]: set(t["grams"]) for t in signed}
    where: dict[str, list[str]] = {}
    for name, grams in own.items():
        for gram in grams:
            where.setdefault(gram, []).append(name)
    greater, same = [], []
    for name, grams in own.items():
        if re.search("-(?:text|header|notice[0-9]+)$", name):
            shared: dict[str, int] = {}
            for gram in grams:
                for other in where[gram]:
                    shared[other] = shared.get(other, 0) + 1
            for other, n in shared.items():
                if other != name and n >= SIMILARITY * len(grams):
                    greater.append(f"{name}>{other}")
                    larger = (len(own[other]), other) > (len(grams), name)
                    if larger and _license_of(other) == _license_of(name) and name not in TEMPLATES:
                        same.append(f"{name}>{other}")
    return greater, same


def _names(found: Column, greater: list[str], same: list[str]) -> Column:
    """The names of what was found, less what another one explains better."""
    if not greater:
        return F.transform(found, lambda x: x["name"])

    def yields(x: Column) -> Column:
        def to(y: Column) -> Column:
            pair = F.concat_ws(">", x["name"], y["name"])
            out = (y["share"] > x["share"]) & F.array_contains(_literal(greater), pair)
            if same:
                out = out | ((y["share"] == x["share"]) & F.array_contains(_literal(same), pair))
            return out
        return F.exists(found, to)
    return F.transform(F.filter(found, lambda x: ~yields(x)), lambda x: x["name"])


def _retrieved(words: Column, hashes: Column, marks: Column, k: int, size: int, stride: int,
               bands: int, group) -> Column:
    """(name, share) of the templates of one class that a text holds; ``hashes`` are the
    text's shingles of ``k`` words, ``marks`` the places of those that are a band of
    some template. A window without a mark cannot share a band and is passed over."""
    wanted = sorted({b for t in group for b in t["bands"]})
    last = F.floor(F.greatest(F.size(hashes) - size + stride - 1, F.lit(0)) / stride).cast("int")

    def around(p: Column) -> Column:
        first = F.ceil(F.greatest(p - size + 1, F.lit(0)) / stride).cast("int")
        return F.sequence(F.least(first, last), F.least(F.floor(p / stride).cast("int"), last))

    def near(i: Column) -> Column:
        window = F.slice(hashes, i * stride + 1, size)
        least = window if size <= bands else F.slice(F.sort_array(window), 1, bands)
        return F.exists(least, lambda x: x.isin(wanted))

    def verified(i: Column) -> Column:
        # the window and one stride on either side, as shingles of words
        lo = F.greatest(i * stride - stride, F.lit(0))
        hi = F.least(i * stride + size + stride, F.size(hashes))
        text = F.transform(F.sequence(lo, hi - 1), lambda j: F.concat_ws(" ", F.slice(words, j + 1, k)))
        # first what any template of the class has, which is little, then each template
        any_gram = _literal({g: None for t in group for g in t["grams"]})
        least = min(SIMILARITY * len(t["grams"]) for t in group)

        def named(held: Column) -> Column:
            each = [let(F.size(F.array_intersect(held, _literal(t["grams"]))) / len(t["grams"]),  # noqa: B023
                        lambda share: F.when(share >= SIMILARITY, F.struct(  # noqa: B023
                            F.lit(t["name"]).alias("name"), share.alias("share")))) for t in group]  # noqa: B023
            return F.when(F.size(held) >= least, F.filter(F.array(*each), lambda x: x.isNotNull())).otherwise(
                F.array().cast(FOUND))
        return let(F.array_intersect(text, any_gram), named)
    at = F.filter(F.array_distinct(F.flatten(F.transform(marks, around))), near)
    return F.flatten(F.transform(at, verified))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = SHINGLE,
            bands: int = BANDS) -> DataFrame:
    """doc_id, licenses (sorted names) and n_licenses of every document."""
    signed = _signatures(docs.sparkSession, default_templates() if templates is None else templates, shingle,
                         bands)
    pairs = _yielding(signed)
    groups: dict[tuple[int, int], list] = {}
    for t in signed:
        groups.setdefault((t["k"], t["class"]), []).append(t)

    def names(w: Column) -> Column:
        def of_gram(k: int) -> Column:
            own = [(size, group) for (gram, size), group in sorted(groups.items()) if gram == k]
            wanted = sorted({b for _, group in own for t in group for b in t["bands"]})

            def classes(h: Column, marks: Column) -> Column:
                found = [_retrieved(w, h, marks, k, size, max(1, size // 8), bands, group)
                         for size, group in own]
                return F.when(F.size(marks) > 0, F.flatten(F.array(*found))).otherwise(
                    F.array().cast(FOUND))
            return let(kgram_hashes(w, k), lambda h: let(F.filter(
                F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))),
                lambda p: F.coalesce(F.get(h, p).isin(wanted), F.lit(False))), lambda m: classes(h, m)))
        parts = [of_gram(k) for k in sorted({gram for gram, _ in groups})]
        return let(F.flatten(F.array(*parts)), lambda f: F.sort_array(F.array_distinct(_names(f, *pairs))))
    found = let(folded_words(F.col("text")), names) if groups else F.array().cast("array<string>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("names")).select(
        "doc_id", F.array_join("names", ",").alias("licenses"), F.size("names").cast("long").alias("n_licenses"))


def op10_minhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH templates(name, size, stride, body) AS (VALUES
  ('Apache-2.0', 4, 1, 'licensed under the apache license version 2 0'),
  ('Apache-2.0-header', 48, 6, 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0'),
  ('BSD-3-Clause', 16, 2, 'use of this source code is governed by a bsd style license that can be found in the license file'),
  ('CC-BY-4.0', 12, 1, 'this work is licensed under a creative commons attribution 4 0 international license'),
  ('CC-BY-NC-4.0', 3, 1, 'licensed under cc by nc 4 0'),
  ('GPL-3.0', 8, 1, 'this work is licensed under the gnu general public license version 3'),
  ('GPL-3.0-header', 48, 6, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version'),
  ('MIT', 1, 1, 'released under the mit license'),
  ('MIT-grant', 32, 4, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction'),
  ('MPL-2.0', 16, 2, 'this source code form is subject to the terms of the mozilla public license v 2 0')),
tw AS (SELECT name, size, stride, string_split(body, ' ') AS w FROM templates),
ts AS (SELECT DISTINCT name, array_to_string(w[s:s + 4], ' ') AS g
       FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS s FROM tw)),
tn AS (SELECT name, count(*) AS m FROM ts GROUP BY name),
d AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
dg AS (
  SELECT n, s - 1 AS p, len(w) - 4 AS shingles, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT n, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
hit AS (SELECT n, p, shingles, name, g FROM dg JOIN ts USING (g)),
near AS (
  SELECT n, name, g, i FROM (
    SELECT n, name, g, p, size, stride, shingles,
      unnest(range(greatest(0, (p - size - stride) // stride), (p + stride) // stride + 1)) AS i
    FROM hit JOIN tw USING (name))
  WHERE i * stride - stride <= p AND p < i * stride + size + stride
    AND i <= greatest(shingles - size + stride - 1, 0) // stride),
found AS (
  SELECT DISTINCT n, name FROM (
    SELECT n, name, i, count(DISTINCT g) AS c FROM near GROUP BY ALL) JOIN tn USING (name) WHERE c >= 0.8 * m)
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses, count(name) AS n_licenses
FROM d LEFT JOIN found USING (n) GROUP BY n, doc_id
"""
