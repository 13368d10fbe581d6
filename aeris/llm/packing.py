"""Packing by concatenate and cut (operator 4).

Pass 1 tokenises every document once and keeps, beside the ids, the tokens that
stand before it in its partition. The partition totals (one row per partition)
are prefix-summed to global offsets. Pass 2 adds the offset and cuts at every
multiple of the sequence length; a document that crosses a cut yields one
boundary record on each side. Nothing is sorted and no task sees more than its
own partition, whatever the document lengths.

Defined results: a null text counts as empty (its only token is the end id); an
empty table gives no pieces; repeated rows are packed as often as they occur;
further columns are ignored. Only the last sequence can be partly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeris.llm.common import scratch_table, table

SEQUENCE = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
# Entries in each generation of a worker's two caches (chunks and words): what a
# full generation did not use again is forgotten with the next one.
CACHE_ENTRIES = 120_000

TOKEN_SCHEMA = "part int, before long, doc_id long, n long, ids binary"
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long")


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The tokenizer's merges as a rank table over bytes, the word end as byte 0.

    Merging the adjacent pair of lowest rank gives the tokenizer's own ids if
    the ids follow the merge order and every token, spelled out and merged
    alone, becomes itself: a pair that spells a token without being its merge
    can then never stand side by side. Both are checked here; None if they do
    not hold, and the tokenizer's model does the work.
    """
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    order, vocabulary = {}, model["vocab"]
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        order[left, right] = rank
    ids = [vocabulary[left + right] for left, right in order]
    if ids != sorted(ids):
        return None
    for left, right in order:
        token = left + right
        ends = token.endswith("</w>")
        parts = list(token[:-4] if ends else token)
        if ends:
            parts[-1] += "</w>"
        while len(parts) > 1:
            rank, k = min((order.get(pair, len(order)), k)
                          for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(order):
                return None
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
    # printable Latin-1 characters stand for their own byte, the others for the rest in order
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    byte_of = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}
    ranks = {}
    for token, i in vocabulary.items():
        ends = token.endswith("</w>")
        spelled = token[:-4] if ends else token
        if all(c in byte_of for c in spelled):
            ranks[bytes(byte_of[c] for c in spelled) + b"\0" * ends] = i
    return ranks


class _Encoder:
    """Ids of whole texts, put together from cached words.

    The tokenizer never joins characters across ASCII white space, so a text's
    ids are those of its white-space chunks in a row. Chunks of plain Latin
    letters and ASCII are cut further by the tokenizer's own split pattern and
    their words merged by ``merge_ranks``; any other chunk is given to the whole
    tokenizer, and so is every text that holds an added token such as the end
    mark, which the tokenizer finds before it splits.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        pattern = given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.added = [t["content"].encode() for t in given.get("added_tokens") or []]
        self.split = regex.compile(pattern + "|\n").findall
        # U+0130 and U+0149 change their length when folded; all others here are stable.
        self.simple = regex.compile("[\n\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*").fullmatch
        vocabulary = self.whole.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.ranked = ranks and tiktoken.Encoding("ranked", pat_str="[^ ]+", mergeable_ranks=ranks,
                                                  special_tokens={})
        self.chunks: dict[bytes, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _whole_ids(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids,
                          dtype=self.dtype).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Many words a call: the ids of each end with a word-end token."""
        known, width = self.words, np.dtype(self.dtype).itemsize
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            if self.ranked:
                ids = np.asarray(self.ranked.encode_ordinary("\0 ".join(part) + "\0"),
                                 dtype=self.dtype)
                cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
                if len(cuts) == len(part):
                    blob = ids.tobytes()
                    known.update((w, blob[lo:hi]) for w, lo, hi in zip(part, [0, *cuts], cuts))
                    continue
            known.update((w, self._whole_ids(w)) for w in part)

    def _learn_chunks(self, chunks: list[bytes]) -> None:
        text = b"\n".join(chunks).decode("utf-8", "replace")
        if not self.simple(text):
            plain = []
            for chunk in chunks:
                one = chunk.decode("utf-8", "replace")
                if self.simple(one):
                    plain.append(chunk)
                else:
                    self.chunks[chunk] = self._whole_ids(one)
            chunks, text = plain, b"\n".join(plain).decode("utf-8", "replace")
        if not chunks:
            return
        words = self.split(text.lower())
        known, old = self.words, self.old_words
        fresh = set(words).difference(known, ("\n",))
        again = {w: old[w] for w in fresh if w in old}
        known.update(again)
        self._learn_words(list(fresh.difference(again)))
        known["\n"] = b""
        lo = 0
        for chunk in chunks:
            hi = lo + 1
            while hi < len(words) and words[hi] != "\n":
                hi += 1
            self.chunks[chunk] = (known[words[lo]] if hi == lo + 1
                                  else b"".join([known[w] for w in words[lo:hi]]))
            lo = hi + 1

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks, self.old_chunks = {}, self.chunks
        if len(self.words) > CACHE_ENTRIES:
            self.words, self.old_words = {}, self.words
        special = {i for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        split = [t.split() if t and i not in special else [] for i, t in enumerate(texts)]
        known, old = self.chunks, self.old_chunks
        fresh = set().union(*split).difference(known)
        again = {c: old[c] for c in fresh if c in old}
        known.update(again)
        if len(again) < len(fresh):
            self._learn_chunks(list(fresh.difference(again)))
        end = np.asarray([END_ID], dtype=self.dtype).tobytes()
        return [(self._whole_ids(texts[i].decode("utf-8", "replace")) if i in special
                 else b"".join(map(known.__getitem__, chunks))) + end for i, chunks in enumerate(split)]


_ENCODERS: dict[str, _Encoder] = {}


def _tokenise(path: str, ranks: dict[bytes, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = _Encoder(path, ranks)
        encoder, before = _ENCODERS[path], 0
        width = np.dtype(encoder.dtype).itemsize
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = encoder.encode_batch(part.column(2).to_pylist())
                counts = np.asarray([len(x) // width for x in ids], dtype=np.int64)
                starts = before + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(starts), part.column(1), pa.array(counts),
                     pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n", "ids"])
    return run


def _cut(length: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                     batch.column(2).to_pylist()):
                ids = np.frombuffer(blob, dtype=dtype).astype("<u4")
                start, n = 0, len(ids)
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(length - offset, n - start)
                    row = (doc, start, take, zlib.crc32(ids[start:start + take].tobytes()), n,
                           sequence, offset)
                    for column, value in zip(out, row):
                        column.append(value)
                    start += take
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str | Column = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(part, before, doc_id, n, ids): each document's ids with the end id, and
    the tokens before it in its partition; written once."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    rows = docs.select(F.spark_partition_id().alias("part"), key.cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    work = _tokenise(tokenizer_path, merge_ranks(tokenizer_path))
    return scratch_table(rows.mapInArrow(work, TOKEN_SCHEMA), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE) -> DataFrame:
    """One row per piece of a document in a sequence of ``length`` tokens."""
    tokens = tokenised(docs, tokenizer_path)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per input partition: the only rows that meet in one task
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")
    return placed.mapInArrow(_cut(length, _id_dtype(tokenizer_path)), PIECE_SCHEMA)


def _id_dtype(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
