"""Personal data (operator 5) against plain patterns and a plain disclosure count."""

import hashlib
import random
import re

import pytest

from hypothesis import given, settings, strategies as st

from aeris.llm import pii
from tests.llm import frames

# The contract's patterns.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items()
            for m in re.finditer(p, text or "") if holds(k, m.group())]


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in pii.digested(frames.documents(spark, rows)).collect()}
    for i, text in rows:
        wanted = plain_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in wanted) for k in PLAIN]
        assert got[i]["spans"].split(",")[:len(wanted)] == wanted or not wanted


def test_base_spans_on_hard_texts(spark):
    check(spark, [
        None, "", "a@b.c", "a@b.c@d.e", "x.a@b.c_d@e.f-g@h.i", "a@b", "a@b..c", "a@-.-", "é a@b.c. ü b@c.d,",
        "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "001.002.003.0255", "1.2.3.99999999999999999999", "1.2.3",
        "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112", "4111  1111 1111 1111",
        "0 0 0 0 0 0 0 0 0 0 0 0 0", "00000000000000000000", "+1 (017) 555-7713.", "+12 3", "+1+2345678901", "+1-2-3-4-5-6-7-8-9-",
        "é+49 30 123456 ü 4111111111111111 1.1.1.1 q@w.e", "1 " * 4000, "a" * 60_000, "9" * 60_000, "a@" + "b." * 3000 + "c",
        "😀 a@b.c 😀 1.2.3.4", "\x00a@b.c\x7f"])


def test_base_spans_on_random_texts(spark):
    rng = random.Random(0)
    pool = ["a", "B", "1", "23", "4", "@", ".", "-", " ", "+", "(", ")", "_", "%", "é", "\n", "@b.c", "1.2.3.4", "+1 23"]
    check(spark, ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)])


@given(st.text(alphabet="01. +-@a", max_size=40))
@settings(max_examples=300, deadline=None)
def test_rewritten_patterns_match_alike(text):
    for kind in ("ip", "card"):
        plain = [m.span() for m in re.finditer(PLAIN[kind], text)]
        assert [m.span() for m in re.finditer(pii.PATTERNS[kind], text)] == plain


def disclosing_rows():
    """zorblat hardly ever stands without one address; other words do."""
    rng = random.Random(1)
    rows = []
    for i in range(12):
        rows.append((i, f"{frames.sentence(rng, 8)} zorblat k@x.org {frames.sentence(rng, 8)}"))
    rows += [(100 + i, frames.sentence(rng, 40)) for i in range(60)]
    rows += [(200 + i, f"fixed words quuxly right here z@y.org and there it all ends {frames.sentence(rng, 9)}") for i in range(8)]
    return rows + [(300, "the Zorblat alone, quuxly alone"), (301, None)]


def test_words_that_give_an_entity_away(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.digested(frames.documents(spark, disclosing_rows())).collect()}
    assert got[300] == "term:4:11"  # found without its entity, whatever its case
    assert all("term:" in got[i] for i in range(12))
    assert not any("term:" in got[i] for i in range(100, 160))
    assert not any("term:" in got[200 + i] for i in range(8))  # one context, copied
    assert got[301] == ""


def test_copies_add_no_evidence_and_take_none_away(spark):
    rng = random.Random(2)
    copied = f"{frames.sentence(rng, 8)} zorblat k@x.org {frames.sentence(rng, 8)}"
    rows = [(i, f"{frames.sentence(rng, 8)} zorblat k@x.org {frames.sentence(rng, 8)}") for i in range(9)]
    rows += [(1000 + i, copied) for i in range(200)]  # nine contexts and a copied one: ten
    twice = [f"{frames.sentence(rng, 8)} quuxly z@y.org {frames.sentence(rng, 8)}" for _ in range(2)]
    rows += [(2000 + i, twice[i % 2]) for i in range(100)]  # two contexts, copied
    rows += [(3000 + i, frames.sentence(rng, 40)) for i in range(2500)] + [(9000, "zorblat alone, quuxly alone")]
    got = {r["doc_id"]: r["spans"] for r in pii.digested(frames.documents(spark, rows)).collect()}
    assert got[9000] == "term:0:7"
    assert all("term:" in got[i] for i in [*range(9), 1000, 1199])
    assert not any("term:" in got[2000 + i] for i in range(100))


def test_one_document_is_no_evidence(spark):
    rng = random.Random(8)
    beside = [f"{frames.sentence(rng, 8)} zorblat k@x.org {frames.sentence(rng, 8)}" for _ in range(6)]
    rows = [(1, " ".join(beside)), (2, " ".join(beside[:3])), (3, "zorblat alone")]
    rows += [(100 + i, frames.sentence(rng, 40)) for i in range(300)]
    terms, _ = pii.disclosing_terms(df := frames.documents(spark, rows), pii._with_spans(df))
    assert terms.count() == 0
    rows += [(10 + i, beside[i]) for i in range(6)]
    terms, _ = pii.disclosing_terms(df := frames.documents(spark, rows), pii._with_spans(df))
    assert [r["term"] for r in terms.collect()] == ["zorblat"]


def test_long_tokens_do_not_hide_words(spark):
    rng = random.Random(9)
    for size in (130, 5000):
        rows = [(i, f"{frames.sentence(rng, 8)} zorblat {'x' * size}{i} k@x.org") for i in range(6)]
        rows += [(100 + i, frames.sentence(rng, 40)) for i in range(300)]
        terms, _ = pii.disclosing_terms(df := frames.documents(spark, rows), pii._with_spans(df))
        assert [r["term"] for r in terms.collect()] == ["zorblat"]


def plain_disclosure(rows, least=0.75, support=3):
    """The formula, counted document by document."""
    import math
    words_of = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
    near, holds, held = {}, {}, {}
    for i, text in rows:
        text = text or ""
        for w in set(words_of(text)):
            held[w] = held.get(w, 0) + 1
        found = {}
        for m in re.finditer(PLAIN["email"], text):
            beside = words_of(text[:m.start()])[-5:] + words_of(text[m.end():])[:5]
            found.setdefault(f"email:{m.group().lower()}", []).append(beside)
        for e, contexts in found.items():
            holds[e] = holds.get(e, 0) + 1
            for t in {w for c in contexts for w in c}:
                near.setdefault((e, t), {}).setdefault(text, []).extend(
                    sorted({w for w in c if w != t}) for c in contexts if t in c)
                near[e, t].setdefault(("n", i), []).append(1)
    out = {}
    for (e, t), kept in near.items():
        n_both = sum(isinstance(k, tuple) for k in kept)
        apart = [(c, k) for k, cs in kept.items() if isinstance(k, str) for c in cs]
        unlike = 0
        while apart:
            first, key = min(apart)
            unlike += 1
            apart = [(c, k) for c, k in apart if k != key and
                     len(set(c) & set(first)) < 2 / 3 * max(len(c), len(first))]
        information = math.log2(len(rows) / holds[e])
        if unlike >= support and information > 0:
            score = 1 + math.log2(min(1, n_both / held[t])) / information
            if score >= least:
                out[t] = max(out.get(t, 0), score)
    return out


def test_disclosure_equals_the_plain_formula(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        text = frames.sentence(rng, rng.randrange(5, 40), 120)
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            e = rng.randrange(6)
            text += f" {frames.sentence(rng, rng.randrange(6), 60)} tell{e if rng.random() < 0.9 else 9} p{e}@x.org {frames.sentence(rng, 4, 60)}"
        rows.append((i, text))
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(600, None), (601, "tell1 tell2")]
    terms, _ = pii.disclosing_terms(df := frames.documents(spark, rows), pii._with_spans(df))
    got = {r["term"]: r["disclosure"] for r in terms.collect()}
    wanted = plain_disclosure(rows)
    assert len(wanted) > 3 and got == {t: pytest.approx(x) for t, x in wanted.items()}


def test_near_copies_are_one_context(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = "one two three four quuxly five z@y.org six seven eight nine ten".split()
        words[rng.choice([1, 2, 3, 5, 7, 8, 9, 10])] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, frames.sentence(rng, 40)) for i in range(600)]
    terms, _ = pii.disclosing_terms(df := frames.documents(spark, rows), pii._with_spans(df))
    assert terms.count() == 0


def test_a_fixed_neighbour_does_not_merge_contexts(spark):
    rng = random.Random(3)
    for neighbour in ("at", "email", "contact", "write", "ask", "mail"):
        rows = [(i, f"{frames.sentence(rng, 8)} zorblat {' '.join([neighbour] * 3)} k@x.org") for i in range(12)]
        rows += [(100 + i, frames.sentence(rng, 40) + f" {neighbour}") for i in range(100)]
        terms, _ = pii.disclosing_terms(df := frames.documents(spark, rows), pii._with_spans(df))
        assert [r["term"] for r in terms.collect()] == ["zorblat"]


def test_redaction(spark):
    df = frames.documents(spark, disclosing_rows() + [(400, "pay 4111 1111 1111 1111, ask +1 (017) 555-7713"),
                                                      (401, "1.2.3.4 a@b.c 1.1.1.1")])
    out = pii.redacted(df)
    assert out.columns == df.columns
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert text[400] == ("pay [CARD], ask [PHONE]", 23) and text[401][0] == "[IP] [EMAIL] [IP]"
    assert "@x.org" not in text[0][0] and "zorblat" not in text[0][0] and "[EMAIL]" in text[0][0]
    assert text[301] == (None, None)
    rows = dict(disclosing_rows())
    assert all(text[i][0] == rows[i] for i in range(100, 160))


def test_overlapping_spans(spark):
    df = spark.createDataFrame([("abcdef", [("email", 1, 4), ("phone", 2, 5)])],
                               "t string, s array<struct<kind:string,start:int,stop:int>>")
    assert df.select(pii.replaced(df["t"], df["s"])).first()[0] == "a[EMAIL]f"


def test_empty(spark):
    assert pii.digested(frames.empty(spark)).count() == 0
    assert pii.redacted(frames.empty(spark)).count() == 0
