"""Byte-level BPE encoding and decoding by merge replay (operator 11).

A task gathers the words (matches of the split pattern) of its documents into a
dictionary of distinct words. The words that are tokens themselves take their
id; all others are laid out as one row of byte tokens. An inverted index leads
from the rank of a mergeable token pair to the positions in these words where
the pair stands. The ranks are replayed in order: a rank is applied at all its
positions at once, and only the two neighbours of a merged position get new
index entries. So a word costs its merges once a block, however often it stands
in it, and the documents are put together from the words' ids. Ranks that are
not those of merges in order (``merges`` checks it) are applied pair by pair.

A block is the documents of one task up to ``BLOCK_BYTES`` of text or
``BLOCK_WORDS`` new words, whichever comes first; a longer text is a block by
itself, and the dictionary is forgotten when it holds ``MEMORY_WORDS``. Nothing
is shuffled: in a corpus whose words hardly repeat a dictionary that all tasks
share would move more than the texts.

Defined results: a null text counts as empty and has no ids; malformed UTF-8 is
read with replacement characters; special tokens in a text are plain text;
repeated rows stay; null ids are kept; an empty table gives no rows; further
columns are ignored. Ids of no token cannot be decoded: that is an error.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 16 << 20
BLOCK_WORDS = 200_000
MEMORY_WORDS = 600_000
# Positions that are replayed together at most (one word may have more).
REPLAY_POSITIONS = 1 << 22

ENCODED_SCHEMA = "doc_id long, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are the ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def unlike_characters() -> dict[str, str]:
    """By class, the ranges of characters that the splitting library here counts in and
    the tokenizer's own library does not (their Unicode versions differ)."""
    import regex
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    out = {}
    for name in ("L", "N"):
        theirs = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
        ours = regex.compile(rf"\p{{{name}}}").findall
        found = ours("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
        known = set()
        for lo in range(0, len(found), 1 << 14):
            part = bytes(theirs.encode_ordinary("".join(found[lo:lo + (1 << 14)])))
            known.update(part.decode("utf-8"))
        unlike = [ord(c) for c in found if c not in known]
        firsts = [c for c, before in zip(unlike, [None, *unlike]) if before != c - 1]
        lasts = [c for c, after in zip(unlike, [*unlike[1:], None]) if after != c + 1]
        out[name] = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts))
    return out


class Splitter:
    """Matches of a split pattern, as the tokenizer's own library finds them."""

    def __init__(self, pattern: str, unlike: dict[str, str]):
        import regex

        self.plain = regex.compile(pattern).findall
        self.odd = self.exact = None
        if any(unlike.values()):
            self.odd = re.compile(f"[{''.join(unlike.values())}]").search
            classes = {name: rf"[\p{{{name}}}--[{chars}]]" if chars else rf"\p{{{name}}}"
                       for name, chars in unlike.items()}
            wide = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{classes['L']}{classes['N']}]")
            for name, chars in classes.items():
                wide = regex.sub(rf"(?<!-)(?<!\[)\\p\{{{name}\}}(?!--)", lambda _, c=chars: c, wide)
            self.exact = regex.compile(wide, regex.VERSION1).findall

    def __call__(self, text: str) -> list[str]:
        if self.odd and not text.isascii() and self.odd(text):
            return self.exact(text)
        return self.plain(text)


class LeastPairFirst:
    """Ids of words by the defining rule: merge the pair whose bytes have the least
    rank, the leftmost first, until no pair is a token. For any table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=0) + 1
        # what separates two words, and what a merge leaves behind: in no pair
        self.gap, self.gone = size, size + 1
        self.shift = (size + 1).bit_length()
        self.single = [ranks.get(bytes([b]), self.gap) for b in range(256)]
        self.rank_of: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.rank_of[left << self.shift | right] = rank
        # the pairs that have been merged, by rank
        self.used: dict[int, set[tuple[int, int]]] = {}

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """All words' tokens in a row, with gaps around the words."""
        token = [self.gap]
        for word in words:
            token.extend([self.single[b] for b in word])
            token.append(self.gap)
        n, shift, rank_of = len(token), self.shift, self.rank_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for at in range(n - 1):
            rank = rank_of(token[at] << shift | token[at + 1])
            if rank is not None:
                index.setdefault(rank, []).append(at)
        order = list(index)
        heapq.heapify(order)
        while order:
            rank = heapq.heappop(order)
            places = sorted(index.pop(rank, ()))
            for at in places:
                right = after[at]
                if rank_of(token[at] << shift | token[right]) != rank:
                    continue  # one of the two has been merged otherwise
                self.used.setdefault(rank, set()).add((token[at], token[right]))
                token[at], token[right] = rank, self.gone
                beyond, left = after[right], before[at]
                after[at], before[beyond] = beyond, at
                least = rank
                for place, pair in ((at, rank << shift | token[beyond]), (left, token[left] << shift | rank)):
                    new = rank_of(pair)
                    if new is not None:
                        if new not in index:
                            heapq.heappush(order, new)
                        index.setdefault(new, []).append(place)
                        least = min(least, new)
                if least < rank:  # a pair that comes first: the rest of this rank waits
                    index.setdefault(rank, []).extend(p for p in places if p > at)
                    heapq.heappush(order, rank)
                    break
        return np.asarray(token, dtype=np.int64)


def merges(ranks: dict[bytes, int]) -> np.ndarray | None:
    """Rows (left, right, rank), one for each token of two bytes or more; None if the
    ranks are not those of merges in order.

    They are if every token, spelled out and merged alone, becomes itself, each rank
    is made of one pair only, and of tokens of lower rank. Two tokens that stand side
    by side in a word and spell a third have then come from the very steps that make
    the third alone, so they are its pair; and no merge can call for an earlier one.
    """
    rule, order = LeastPairFirst(ranks), sorted(ranks, key=ranks.__getitem__)
    found = rule.tokens(order)
    if any(len(t) == 1 for t in order) and found[found < rule.gap].tolist() != sorted(ranks.values()):
        return None
    rows = [(*pair, rank) for rank, pairs in rule.used.items() for pair in pairs]
    regular = len(rows) == len(rule.used) and all(max(a, b) < r for a, b, r in rows)
    return np.asarray(sorted(rows, key=lambda r: r[2]), dtype=np.int64).reshape(-1, 3) if regular else None


class MergeReplay:
    """Ids of many words at once, by replaying merges in rank order."""

    def __init__(self, ranks: dict[bytes, int], rows: np.ndarray):
        self.size = max(ranks.values(), default=0) + 3
        self.gap, self.gone = self.size - 2, self.size - 1
        self.single = np.asarray([*(ranks.get(bytes([b]), self.gap) for b in range(256)), self.gap])
        self.pair_of = {r: (a, b) for a, b, r in rows.tolist()}
        keys = rows[:, 0] * self.size + rows[:, 1]
        by_key = np.argsort(keys)
        self.keys, self.rank_of = keys[by_key], rows[by_key, 2]
        # index entries are sorted by a range of ranks at a time: few ranks where most merges are
        least = int(rows[0, 2]) if len(rows) else 0
        self.ranges = [least + 64]
        while self.ranges[-1] < self.size:
            self.ranges.append(2 * self.ranges[-1] - least)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 for none."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """All words' tokens in a row, with gaps around the words."""
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
        n = int(ends[-1]) + 1 if len(ends) else 1
        octets = np.full(n, 256)
        inside = np.ones(n, dtype=bool)
        inside[0] = inside[ends] = False
        octets[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        token = self.single[octets]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        # the inverted index, still unsorted: ranks of pairs and places of their left tokens
        ranks = self._rank(token[:-1], token[1:])
        places = np.flatnonzero(ranks >= 0)
        later = [(ranks[places], places)]
        for bound in self.ranges:
            ranks, places = (np.concatenate([x[i] for x in later]) for i in range(2))
            near = ranks < bound
            later = [(ranks[~near], places[~near])]
            index: dict[int, list[np.ndarray]] = {}
            order: list[int] = []
            self._insert(index, order, ranks[near], places[near])
            while order:
                rank = heapq.heappop(order)
                at = self._standing(token, after, np.unique(np.concatenate(index.pop(rank))), self.pair_of[rank])
                if not len(at):
                    continue
                right = after[at]
                token[at], token[right] = rank, self.gone
                beyond = after[right]
                after[at], before[beyond] = beyond, at
                left = before[at]
                # the neighbours that a merge has touched: two new pairs each
                new = self._rank(np.concatenate([np.full(len(at), rank), token[left]]),
                                 np.concatenate([token[beyond], np.full(len(at), rank)]))
                where = np.concatenate([at, left])
                soon = (new >= 0) & (new < bound)
                if soon.any():
                    self._insert(index, order, new[soon], where[soon])
                rest = new >= bound
                if rest.any():
                    later.append((new[rest], where[rest]))
        return token

    @staticmethod
    def _insert(index: dict[int, list[np.ndarray]], order: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
        by_rank = np.argsort(ranks, kind="stable")
        ranks, places = ranks[by_rank], places[by_rank]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                rank = int(ranks[lo])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(order, rank)
                index[rank].append(places[lo:hi])

    @staticmethod
    def _standing(token: np.ndarray, after: np.ndarray, at: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
        """The places where the pair still stands; of places that overlap the leftmost."""
        at = at[(token[at] == pair[0]) & (token[after[at]] == pair[1])]
        if pair[0] != pair[1] or len(at) < 2:
            return at
        kept, taken = [], -1
        for place, right in zip(at.tolist(), after[at].tolist()):
            if place != taken:
                kept.append(place)
                taken = right
        return np.asarray(kept)


class Dictionary:
    """Codes of the words met so far, and the ids of every code."""

    def __init__(self, ranks: dict[bytes, int], replay: MergeReplay | LeastPairFirst):
        self.ranks, self.replay = ranks, replay
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.fresh: list[str] = []
        self.flat, self.starts = array("i"), array("q", [0])

    def code(self, words: list[str]) -> np.ndarray:
        known = self.codes
        for word in set(words).difference(known):
            known[word] = len(known)
            self.fresh.append(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))

    def learn(self) -> None:
        """Ids of all words that came since the last call."""
        spelled = [w.encode("utf-8", "replace") for w in self.fresh]
        own = [self.ranks.get(w) for w in spelled]
        counts = np.ones(len(own), dtype=np.int64)
        found: list[np.ndarray] = []
        part, size, where = [], 0, []

        def flush() -> None:
            if part:
                tokens = self.replay.tokens(part)
                kept = tokens < self.replay.gap
                word_of = np.cumsum(tokens == self.replay.gap) - 1
                counts[where] = np.bincount(word_of[kept], minlength=len(part))
                found.append(tokens[kept])
                part.clear(), where.clear()
        for k, (word, rank) in enumerate(zip(spelled, own)):
            if rank is None:
                if size and size + len(word) > REPLAY_POSITIONS:
                    flush()
                    size = 0
                part.append(word), where.append(k)
                size += len(word) + 1
        flush()
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        alone = np.asarray([r is not None for r in own], dtype=bool)
        by_word = np.repeat(alone, counts)
        ids[by_word] = [r for r in own if r is not None]
        if found:
            ids[~by_word] = np.concatenate(found)
        base = self.starts[-1]
        self.flat.frombytes(ids.tobytes())
        self.starts.frombytes((base + ends).astype(np.int64).tobytes())
        self.fresh = []

    def ids(self, codes: np.ndarray) -> np.ndarray:
        flat, starts = np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int64)
        lengths = starts[codes + 1] - starts[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(starts[codes] - ends + lengths, lengths) + np.arange(total)]


def _encode(ranks_path: str, pattern: str, unlike: dict[str, str], rows: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        split = Splitter(pattern, unlike)
        words = Dictionary(ranks, LeastPairFirst(ranks) if rows is None else MergeReplay(ranks, rows))
        doc_ids, coded, size = [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            words.learn()
            for lo in range(0, len(coded), 128):
                ids = [words.ids(codes) for codes in coded[lo:lo + 128]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[lo:lo + 128], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))],
                    ["doc_id", "ids"])
            doc_ids.clear(), coded.clear()
            if len(words.codes) > MEMORY_WORDS:
                words.forget()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer() if text.is_valid else b""
                doc_ids.append(doc_id)
                coded.append(words.code(split(str(raw, "utf-8", "replace"))))
                size += len(raw)
                if size >= BLOCK_BYTES or len(words.fresh) >= BLOCK_WORDS:
                    yield from block()
                    size = 0
        if coded:
            yield from block()
    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document, without special tokens. ``ranks_path`` is
    read by every task, so all machines must have it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    work = _encode(ranks_path, pattern, unlike_characters(), merges(read_ranks(ranks_path)))
    return rows.mapInArrow(work, ENCODED_SCHEMA)


def decoded(ids: Column, ranks_path: str) -> Column:
    """The bytes that a column of ids stands for."""
    @F.arrow_udf("binary")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token_of = {rank: token for token, rank in read_ranks(ranks_path).items()}
        for column in columns:
            yield pa.array([None if x is None else b"".join([token_of[i] for i in x])
                            for x in (None if not v.is_valid else v.values.to_numpy().tolist() for v in column)],
                           pa.binary())
    return decode(ids)


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    found = encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    spelled = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(spelled.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"))
