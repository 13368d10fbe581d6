"""Byte-level BPE (operator 11) against the tokenizer's own library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from aeris.llm import byte_bpe
from aeris.llm.queries import QUERIES
from tests.conftest import SMOKE_DIR
from tests.llm import frames

PATH = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH),
                             special_tokens={})


def rows_of(df):
    return sorted(((r["doc_id"], list(r["ids"])) for r in df.collect()), key=repr)


def test_documents_and_edges_equal_the_library(spark, own):
    rng = random.Random(3)
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x20000, 0x33000)]))
                    for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    rows = frames.edge_rows() + [(1000 + i, t) for i, t in enumerate(wild)] + [
        (2000, "<|endoftext|> plain \n\n  text\t\t x"), (2001, "\U000323b0a \U0001126b1"), (2002, "don't we'LL 's"),
        (2003, "a" * 30_000 + " " * 5000 + "\r\n\n"), (2004, "\x1c\x1d \u0085 x"), (2005, "ab" * 4000)]
    got = rows_of(byte_bpe.encoded(frames.documents(spark, rows), PATH, public_tokenizers.PATTERN))
    assert got == sorted(((i, own.encode_ordinary(t or "")) for i, t in rows), key=repr)


def test_query_returns_digests_of_ids_and_of_the_round_trip(spark, own):
    docs = frames.smoke(spark).collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_merge_replay"](spark, SMOKE_DIR).collect()}
    assert got.keys() == {d["doc_id"] for d in docs}
    for d in docs:
        ids = own.encode_ordinary(d["text"])
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def plain_merges(word, ranks):
    """The pair of least rank, the leftmost first, again and again."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, k = min(pairs)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def test_ranks_in_any_order_give_the_least_pair_first():
    """A vocabulary whose longer tokens have lower ranks than their parts."""
    rng = random.Random(1)
    for _ in range(60):
        tokens = {bytes([b]) for b in b"abc"}
        while len(tokens) < 25:
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))))
        order = list(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
        assert encoded(words, ranks) == [plain_merges(w, ranks) for w in words]


def encoded(words, ranks):
    rows = byte_bpe.merges(ranks)
    replay = byte_bpe.LeastPairFirst(ranks) if rows is None else byte_bpe.MergeReplay(ranks, rows)
    known = byte_bpe.Dictionary(ranks, replay)
    known.code([w.decode("latin-1") for w in words])
    known.learn()
    return [known.ids(known.code([w.decode("latin-1")])).tolist() for w in words]


def test_ranks_of_merges_are_replayed():
    """Vocabularies made by merging: the table of merges is found, and gives the least pair's ids."""
    rng = random.Random(7)
    regular = 0
    for _ in range(40):
        ranks = {bytes([b]): i for i, b in enumerate(b"abcd")}
        while len(ranks) < 30:
            a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
            ranks.setdefault(a + b, len(ranks))
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        words += [b"a" * 31, b"abab" * 9, b"aab" * 11]
        regular += byte_bpe.merges(ranks) is not None
        assert encoded(words, ranks) == [plain_merges(w, ranks) for w in words]
    assert regular >= 3
    ranks = byte_bpe.read_ranks(PATH)
    rows = byte_bpe.merges(ranks)
    assert rows is not None and len(rows) == len(ranks) - 256


def test_small_blocks_change_nothing(monkeypatch, own):
    import pyarrow as pa
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 40)
    monkeypatch.setattr(byte_bpe, "MEMORY_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "REPLAY_POSITIONS", 16)
    texts = [frames.sentence(random.Random(i), 12, 30) for i in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42), pa.int64()), pa.array(
        [t and t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    run = byte_bpe._encode(PATH, public_tokenizers.PATTERN, byte_bpe.unlike_characters(),
                           byte_bpe.merges(byte_bpe.read_ranks(PATH)))
    got = [ids for out in run(iter([batch])) for ids in out.column(1).to_pylist()]
    assert got == [own.encode_ordinary(t or "") for t in texts]


def test_empty_table_and_null_ids(spark):
    df = byte_bpe.encoded(frames.empty(spark), PATH, public_tokenizers.PATTERN)
    assert df.collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert none.select(byte_bpe.decoded(none["ids"], PATH).alias("b")).first()["b"] is None
