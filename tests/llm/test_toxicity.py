"""Toxicity (operator 9): held-out accuracy, restored words, edge frames."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from aeris.llm import toxicity
from tests.llm import frames

BAD = ["blarghead", "snorkwit", "fuddlenose", "grobbler"]


def corpus(n, seed, disguise=0.0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ta", "re", "in", "so", "mi", "du", "el", "ka"]) for _ in range(rng.randrange(1, 5)))
                  for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            w = rng.choice(BAD)
            if rng.random() < disguise:
                w = rng.choice([w.replace("o", "0").replace("e", "3"), " ".join(w), w.replace("r", "rrrr").replace("d", "dddd")])
            words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "0 as quality", "'x' as text")


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 0, disguise=0.3)
    got = toxicity.scored(frames.documents(spark, docs), label_frame(spark, labels)).collect()
    toxic = dict(labels)
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    found = sum(r["predicted"] for r in held if toxic[r["doc_id"]])
    assert found / sum(toxic[r["doc_id"]] for r in held) > 0.9
    assert sum(r["predicted"] for r in held if not toxic[r["doc_id"]]) == 0


def test_edges(spark):
    docs, labels = corpus(400, 1)
    rows = [(d + 1000, t) for d, t in docs] + frames.edge_rows()
    given = [(d + 1000, y) for d, y in labels] + [(1, None), (None, 1), (2, 0), (2, 0), (4, 7)]
    df = frames.documents(spark, rows)
    got = toxicity.scored(df, label_frame(spark, given)).collect()
    assert len(got) == len(rows)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2, 3, 10) or r["doc_id"] is None}
    assert all(s < 0.7 for s in blank)
    kept = toxicity.toxic_removed(df, label_frame(spark, given))
    assert kept.columns == df.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(2, 1), (4, 1), (5, 1)]])
def test_one_class_or_none(spark, labels):
    got = toxicity.scored(frames.documents(spark, frames.edge_rows()), label_frame(spark, labels)).collect()
    assert len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] < 1
    assert toxicity.scored(frames.empty(spark), label_frame(spark, labels)).count() == 0


def test_restored_words(spark):
    words = "this stupid idiot is a total moron and the clown said nothing to the stupid idiot at noon".split()
    text = " ".join(words * 40)
    model = toxicity.language_model(frames.documents(spark, [(1, text)]))
    restorer = toxicity.Restorer(model)
    assert restorer.words("You 1d10t, 5tup1d M0R0N") == ["you", "idiot", "stupid", "moron"]
    assert restorer.words("s t u p i d") == ["stupid"] and restorer.words("s.t.u.p.i.d!!") == ["stupid"]
    assert restorer.words("stuuuupid idiooot") == ["stupid", "idiot"]
    plain = "Nothing to see here, really. A1 b"
    assert restorer.words("the clown said nothing, at noon.") == ["the", "clown", "said", "nothing", "at", "noon"]
    assert restorer.words(plain)[:4] == ["nothing", "to", "see", "here"]
    assert restorer.words("a" * 50_000 + " x") and restorer.words(None) == []


def random_model(seed):
    rng = np.random.default_rng(seed)
    return rng.random((28, 28, 28)) * 6


def enumerated(token, model):
    """The least total cost over all paths of the lattice."""
    best = np.inf
    for path in itertools.product(*toxicity.lattice(token), [(" ", 0.0)]):
        a = b = 0
        total = 0.0
        for piece, cost in path:
            total += cost
            for c in piece:
                k = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else toxicity.OTHER
                if k or b:
                    total += model[a, b, k]
                    a, b = b, k
        best = min(best, total)
    return best


def path_cost(token, text, model):
    """The least cost of the paths that emit ``text``."""
    best = np.inf
    for path in itertools.product(*toxicity.lattice(token), [(" ", 0.0)]):
        if "".join(p for p, _ in path) == text:
            best = min(best, sum(c for _, c in path))
    plain = re.sub(" +", " ", text).lstrip(" ")
    return best + sum(model[a, b, c] for a, b, c in _trigrams(plain))


def _trigrams(plain):
    codes = [0, 0] + [0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else toxicity.OTHER for c in plain]
    return zip(codes, codes[1:], codes[2:])


@pytest.mark.parametrize("token", ["1d10t", "st**p1d", "a$$", "s-t-u", "b***h", "oo1!ee", "é1a", "x1ñ", "f*ck1ng", "!a.b5", "aabbcc"])
def test_viterbi_equals_enumeration(token):
    for seed in range(3):
        model = random_model(seed)
        found = toxicity.restore(token, model, model.ravel().tolist())
        assert path_cost(token, found, model) == pytest.approx(enumerated(token, model))


def test_long_and_odd_tokens_end_in_seconds():
    rng = random.Random(0)
    restorer = toxicity.Restorer(random_model(0))
    texts = ["a" + "*" * 100_000 + "b", "a1" * 50_000, "aabb" * 25_000, "a*b" * 33_000, "a " * 50_000,
             "".join(rng.choice("ab*1$!e") for _ in range(100_000)), "word**********word " * 5000,
             " ".join(f"{''.join(rng.choices('abcdef', k=3))}***{''.join(rng.choices('abcdef', k=3))}" for _ in range(300))]
    begun = time.time()
    for text in texts:
        assert restorer.words(text)
    assert time.time() - begun < 60


def test_long_star_runs_and_many_masks_are_breaks():
    assert toxicity.masks("b***h") == {1: 3} and toxicity.masks("b****h") == {} and toxicity.masks("***b") == {}
    assert toxicity.masks("a*b*c*d*e*f*g") and toxicity.masks("a*b*c*d*e*f*g*h") == {}
    restorer = toxicity.Restorer(random_model(1))
    assert restorer.words("word**********word") == ["word", "word"]


def test_tokens_one_by_one_equal_the_whole_text():
    """Remembered tokens give what the pattern over the whole text gives."""
    rng = random.Random(5)
    pieces = ["a", "b", "1", "$", "*", ".", "-", " ", "  ", "ss", "word", "5tup", "é", "!", "\n", "x9", "ee"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    model = random_model(2)
    restorer, whole = toxicity.Restorer(model), toxicity.Restorer(model)
    evidence = toxicity.Evidence(np.arange(1 << 12), np.random.default_rng(0).random(1 << 12))
    reader = toxicity.Reader(model, np.arange(1 << 12), np.random.default_rng(0).random(1 << 12))
    for text in texts:
        words = whole.whole_words(text.lower())
        assert restorer.words(text) == words, text
        assert reader.of(text) == pytest.approx(evidence.of(words))


def test_forgetting_tokens_changes_nothing(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("ab1*s", k=rng.randrange(1, 6))) for _ in range(30)) for _ in range(60)]
    reader = lambda: toxicity.Reader(random_model(3), np.arange(1 << 12), np.ones(1 << 12))
    wanted = [reader().of(t) for t in texts]
    monkeypatch.setattr(toxicity, "MEMORY", 20)
    one = reader()
    assert [one.of(t) for t in texts] == wanted


def test_other_disguises_are_restored(spark):
    words = "this stupid idiot is an ass and the clown said nothing at all to the stupid idiot but good".split()
    model = toxicity.language_model(frames.documents(spark, [(1, " ".join(words * 40))]))
    restorer = toxicity.Restorer(model)
    for text in ["id10+", "i  d  i  o  t", "i/d/i/o/t", "iiddiioott", "(i d i o t)", "'i.d.i.o.t'", "id*ot"]:
        assert restorer.words(text) == ["idiot"], text
    for text in ["(5tupid)", '"5tupid', "sstupidd", "(s t u p i d)", "st*pid"]:
        assert restorer.words(text) == ["stupid"], text
    for text in ["a$$", "as5", "a s s", "[a-s-s]"]:
        assert restorer.words(text) == ["ass"], text
    assert restorer.words("all good but the clown!") == ["all", "good", "but", "the", "clown"]


def test_trigrams_grow_with_the_corpus(spark):
    one = toxicity.trigram_counts([b"ab c"])
    assert one.sum() > 0 and toxicity.trigram_counts([b"ab c"] * 3).sum() > 2 * one.sum()
    assert toxicity.trigram_counts(["é".encode()])[(0 * 28 + 27) * 28] == 1


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.allclose(toxicity.fit_logistic(x, y), [0.5, 2, -1], atol=0.2)
