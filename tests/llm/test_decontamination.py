"""Decontamination (operator 7) against a plain search for every window."""

import hashlib
import random
import re

from aeris.llm import decontamination as dc
from tests.llm import frames


def words_of(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((repr(doc), len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as key", "2 as span")


def check(spark, docs, items):
    got = dc.contamination(frames.documents(spark, docs), frame(spark, items)).collect()
    found = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                   for r in got)
    assert found == plain(docs, items)
    return found


def test_windows_of_all_lengths(spark):
    rng = random.Random(0)
    items = [(i, frames.sentence(rng, n, 50)) for i, n in enumerate([1, 2, 3, 5, 6, 7, 9, 10, 11, 14, 30, 40])]
    items += [(50, items[-1][1]), (50, items[-1][1]), (51, None), (52, "?!"), (None, items[-2][1]), (60, "E É x " * 6)]
    docs = frames.edge_rows()
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        for cut in (0, 1):
            part = " ".join(w[cut:len(w) - cut])
            docs.append((500 + 2 * k + cut, frames.sentence(rng, 30) + "; " + part.upper() + ", " + frames.sentence(rng, 20)))
    docs += [(900 + i, items[10][1]) for i in range(40)]  # copies of one contaminated text
    found = check(spark, docs, items)
    assert sum(r[5] for r in found) > 40


def test_only_long_items(spark):
    rng = random.Random(1)
    items = [(i, frames.sentence(rng, 25)) for i in range(6)]
    docs = [(i, frames.sentence(rng, 20) + " " + " ".join(items[i % 6][1].split()[3:3 + 8 + i % 4])) for i in range(24)]
    found = check(spark, docs, items)
    assert 0 < sum(r[5] for r in found) < len(found)


def test_a_table_of_few_bits_loses_nothing(spark):
    rng = random.Random(4)
    items = [(i, frames.sentence(rng, 30, 60)) for i in range(20)]
    docs = [(i, frames.sentence(rng, 40, 60) + " " + " ".join(items[i % 20][1].split()[:12 * (i % 2)])) for i in range(30)]
    wanted = {r[0] for r in plain(docs, items) if r[5]}
    for bits in (64, 1 << 10, 1 << 22):
        base, found = dc.hits(frames.documents(spark, docs), frame(spark, items), bits=bits)
        got = base.join(found, ["key", "key2"]).select("doc.doc_id", "suspect").collect()
        assert {repr(r["doc_id"]) for r in got} == wanted and all(r["suspect"] for r in got)
        if bits == 1 << 22:  # and a wide one lets hardly any clean text through
            assert base.where("suspect").count() == len(wanted)


def test_texts_that_are_not_suspect_are_not_carried(spark):
    base, _ = dc.hits(frames.smoke(spark), frames.smoke(spark, "benchmark"), carried=["doc_id"])
    assert [f.name for f in base.schema["doc"].dataType] == ["doc_id"] and "text" not in base.columns


def test_empty_tables(spark):
    check(spark, frames.edge_rows(), [])
    check(spark, [], [(1, "a b c")])


def test_contaminated_documents_go(spark):
    rng = random.Random(2)
    items = [(0, frames.sentence(rng, 20))]
    docs = [(1, "x " + items[0][1]), (2, frames.sentence(rng, 50)), (3, None), (2, frames.sentence(rng, 50))]
    df = frames.documents(spark, docs)
    kept = dc.contaminated_removed(df, frame(spark, items))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3]
    assert dc.contaminated_removed(df, frame(spark, [])).count() == 4
