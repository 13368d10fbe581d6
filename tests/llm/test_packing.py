"""Packing (operator 4): an exact round trip against the tokenizer."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from aeris.llm import packing
from tests.llm import frames

PATH = public_tokenizers.path(packing.TOKENIZER)
RANKS = packing.merge_ranks(PATH)
WHOLE = Tokenizer.from_file(PATH)
ENCODER = packing._Encoder(PATH, RANKS)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


def check(spark, rows, length):
    got = packing.pack(frames.documents(spark, rows), PATH, length).collect()
    wanted = sorted(((repr(d), ids_of(t)) for d, t in rows), key=repr)
    pieces = {}
    for r in got:
        pieces.setdefault((repr(r["doc_id"]), r["doc_tokens"], r["sequence_id"] * length + r["offset"] - r["start"]),
                          []).append(r)
    found = []
    for (doc, n, _), parts in pieces.items():
        parts.sort(key=lambda r: r["start"])
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert sum(r["length"] for r in parts) == n
        ids = next(x for d, x in wanted if d == doc and len(x) == n and all(
            zlib.crc32(np.asarray(x[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]
            for r in parts))
        found.append((doc, ids))
    assert sorted(found, key=repr) == wanted
    used = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for sequence, offset, n in used:  # gapless, and only the last sequence is not full
        assert sequence * length + offset == at and offset + n <= length
        at += n


def test_round_trip(spark):
    check(spark, frames.edge_rows(), 64)


def test_round_trip_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in frames.smoke(spark).limit(60).collect()]
    check(spark, rows, packing.SEQUENCE)


def test_empty(spark):
    assert packing.pack(frames.empty(spark), PATH).count() == 0


def test_merge_ranks_hold_for_this_vocabulary():
    assert RANKS is not None


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_cached_words_equal_the_tokenizer(text):
    clean = text.encode("utf-8", "ignore").decode()
    got = np.frombuffer(ENCODER.encode_batch([clean.encode()])[0], ENCODER.dtype).tolist()
    assert got == ids_of(clean)


def test_without_ranks_the_tokenizer_does_the_work():
    plain = packing._Encoder(PATH, None)
    texts = ["It's a test, isn't it?", "<|endoftext|> l'été 123 $$$", "", "İstanbul ŉx"]
    assert plain.encode_batch([t.encode() for t in texts]) == ENCODER.encode_batch([t.encode() for t in texts])


def test_texts_with_added_tokens_equal_the_plain_tokenizer():
    plain = Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> y", "a<|startoftext|>b  c", "<|endoftext|>", " <|endoftext|>\n\n<|endoftext|> ",
             "l'été <|endoftext|> 中文", "<|ENDOFTEXT|> <|endof text|> <|", "no such token"]
    got = ENCODER.encode_batch([t.encode() for t in texts])
    assert [np.frombuffer(x, ENCODER.dtype).tolist() for x in got] == [
        plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert 49407 in np.frombuffer(got[0], ENCODER.dtype)
