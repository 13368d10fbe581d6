"""Toxicity of restored texts (operator 9).

1. Language model. Character trigrams are counted over all documents (28
   symbols: word break, a-z, any other letter), so at most 28^3 sums reach the
   driver, whatever the corpus.
2. Noisy channel. Tokens that look disguised (a letter beside a digit or symbol, a
   letter twice in a row, letters spaced out, masked by stars) become a lattice:
   a symbol may stand for a letter or for a break, a run of one letter for one or
   two, a gap between single letters for nothing or for a break, a star for any. The Viterbi path
   of least channel cost plus language-model cost is the restored text. All other
   tokens have one path, themselves. Every distinct token is decided once (a bounded
   memory); only texts with letters spaced over several tokens are read as a whole.
   Stars in a row stand for as many letters if they are at most ``MASK_RUN``, and a
   token has at most ``MASK_MOST`` masked letters: beyond that its stars are breaks.
3. Score. Words of the restored text are looked up by their beginnings (4 to 6
   letters) and as a whole in a lexicon of log-odds learnt from labels, each less
   ``MARGIN`` standard errors, so that chance companions weigh little. A document's
   three strongest words, its total and its share go through a logistic regression
   that is fitted on weights learnt from other documents than the one measured.

Labels are learnt from a bounded sample: ``TRAIN_ROWS`` labelled documents of
least id hash, of which texts that share a shingle minimum (copies, near copies)
count once. The sample's ids are the one thing broadcast by bound. Everything
else reads all documents.

Defined results: null, empty and wordless texts score by the intercept alone;
with labels of one class, or none, every document scores the smoothed share of
label 1. Rows without a label or with a null doc_id are scored but not learnt
from. Repeated rows stay; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import scratch_table, table

TRAIN_ROWS = 40_000
THRESHOLD = 0.7
FEATURE_BITS = 22
MASK_BITS = (1 << FEATURE_BITS) - 1
# Words or tokens that a worker remembers at a time.
MEMORY = 200_000
LEAST_Z = 3.0
LEAST_DOCS = 3
MARGIN = 2.0
BEGINNINGS = range(4, 7)

SYMBOLS = 28
OTHER = SYMBOLS - 1
# Letters that a symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
        "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
# Channel costs in nats.
SUBSTITUTE, BREAK, SHORTEN, SHORTEN_PAIR, JOIN, SEPARATE, MASK = 1.5, 3.0, 0.5, 4.0, 0.2, 2.0, 1.5

_LETTER = "[^\\W\\d_]"
_MARK = "[0-9@$!|+]"
# One to three of what is no letter, digit or line end, between spaced letters.
_GAP = "(?:[^\\w\\n]|_){1,3}"
_ONE = f"(?:{_LETTER}|{_MARK})"
_RUN = rf"(?<![^\W_])(?=(?:{_MARK}{_GAP}){{0,2}}{_LETTER})(?:{_ONE}{_GAP}){{2,}}{_ONE}(?![^\W_])"
_SPACED_RUN = re.compile(_RUN)
DISGUISED = re.compile(
    rf"{_RUN}"
    rf"|(?<!\S)\S*?(?:{_LETTER}(?:{_MARK}|\*+{_LETTER})|{_MARK}{_LETTER}|({_LETTER})\1)\S*")
_SPACED = re.compile(rf"(?:{_ONE}{_GAP})+{_ONE}")
_WORD = re.compile(rf"{_LETTER}+")
_DISGUISED_TOKEN = re.compile(rf"{_LETTER}(?:{_MARK}|\*+{_LETTER})|{_MARK}{_LETTER}|({_LETTER})\1")
# A letter or mark with neither beside it, as in letters spaced out.
_ALONE = re.compile(rf"(?<![^\W_]){_ONE}(?![^\W_])")
_MASKED_RUN = re.compile(rf"(?<={_LETTER})\*+(?={_LETTER})")
MASK_RUN, MASK_MOST = 3, 6
_PAIR = re.compile(rf"({_LETTER})\1")
# Tokens that only a pair of equal letters brings into the lattice.
_PAIRED = re.compile(rf"(?!.*{_MARK}{_LETTER}|.*{_LETTER}(?:{_MARK}|\*)|.*({_LETTER})\1\1)\S+")
# Nats a symbol above which the model finds a word unlikely, and the share of them
# at most that a word without the pairs must have.
UNLIKELY, LIKELIER = 2.5, 0.65


def _symbol_table() -> np.ndarray:
    """Symbol of each byte; 255 for continuation bytes, which are skipped."""
    symbols = np.zeros(256, dtype=np.uint8)
    for k in range(26):
        symbols[ord("a") + k] = symbols[ord("A") + k] = k + 1
    symbols[0x80:0xC0] = 255
    symbols[0xC0:] = OTHER
    return symbols


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of symbol trigrams; breaks in a row are one, texts are broken apart."""
    codes = _symbol_table()[np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)]
    codes = codes[codes != 255]
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])].astype(np.int64)
    grams = (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]
    return np.bincount(grams, minlength=SYMBOLS ** 3)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            total += trigram_counts([t for t in batch.column(0).slice(lo, 1024).to_pylist() if t])
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs -log P(c | a, b) of the corpus, shape (28, 28, 28)."""
    counted = (docs.select(F.col("text").cast("binary")).mapInArrow(_count_trigrams, "gram long, n long")
                   .groupBy("gram").agg(F.sum("n").alias("n")).collect())  # at most 28^3 rows
    counts = np.zeros(SYMBOLS ** 3)
    for row in counted:
        counts[row["gram"]] = row["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(axis=0) + 0.1  # (b, c)
    given_one = pairs / pairs.sum(axis=1, keepdims=True)
    backing = 5.0
    given_two = (counts + backing * given_one[None]) / (counts.sum(axis=2, keepdims=True) + backing)
    return -np.log(given_two)


_CODES = {" ": 0} | {chr(96 + k): k for k in range(1, 27)}


def masks(token: str) -> dict[int, int]:
    """Start and length of the star runs that stand for letters."""
    runs = {m.start(): len(m.group()) for m in _MASKED_RUN.finditer(token)} if "*" in token else {}
    runs = {at: n for at, n in runs.items() if n <= MASK_RUN}
    return runs if sum(runs.values()) <= MASK_MOST else {}


# The slot of a star.
ANY = [*((chr(k), MASK) for k in range(97, 123)), (" ", BREAK)]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Slots of (emitted text, channel cost) for a disguised token."""
    spaced = _SPACED.fullmatch(token) is not None
    masked = masks(token)
    slots: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i + 1
        if c.isalpha():
            while j < len(token) and token[j] == c:
                j += 1
            n = j - i
            if n == 1:
                slots.append([(c, 0.0)])
            elif n == 2:
                slots.append([(c * 2, 0.0), (c, SHORTEN_PAIR)])
            else:
                slots.append([(c, SHORTEN), (c * 2, SHORTEN)])
        elif c in LEET:
            slots.append([(letter, SUBSTITUTE) for letter in LEET[c]] + [(" ", BREAK)])
        elif spaced:
            while not (token[j].isalpha() or token[j] in LEET):
                j += 1
            slots.append([("", JOIN), (" ", SEPARATE)])
        elif i in masked:
            j = i + masked[i]
            slots.extend([ANY] * masked[i])
        else:
            while j < len(token) and not (token[j].isalpha() or token[j] in LEET or j in masked):
                j += 1
            slots.append([(" ", 0.0)])
        i = j
    return slots


def _after_star(states: dict, model: np.ndarray) -> dict:
    """The states after a star, from many states at once."""
    cost = np.full((SYMBOLS, SYMBOLS), np.inf)
    for (a, b), (total, _) in states.items():
        cost[a, b] = total
    step = cost[:, :, None] + model
    step[:, :, 1:27] += MASK
    step[:, :, 0] += BREAK
    step[:, 0, 0] = cost[:, 0] + BREAK  # breaks in a row are one
    step[:, :, OTHER] = np.inf
    first = step.argmin(axis=0)
    out = {}
    for b, c in zip(*(x.tolist() for x in np.nonzero(np.isfinite(step.min(axis=0))))):
        a = int(first[b, c])
        piece = " " if c == 0 else chr(c + 96)
        state = (a, 0) if b == c == 0 else (b, c)
        total = float(step[a, b, c])
        if state not in out or total < out[state][0]:
            out[state] = (total, (piece, states[a, b][1]))
    return out


def restore(token: str, model: np.ndarray, flat: list[float]) -> str:
    """The emitted text of least total cost, breaks at both ends. ``flat``: the model's
    costs in one list."""
    # state: the last two symbols; value: cost and the emitted pieces as a linked list
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*lattice(token), [(" ", 0.0)]]:
        if options is ANY and len(states) > SYMBOLS:
            states = _after_star(states, model)
            continue
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for piece, extra in options:
                x, y, total = a, b, cost + extra
                for c in piece:
                    symbol = _CODES.get(c, OTHER)
                    if symbol == 0 and y == 0:
                        continue  # breaks in a row are one
                    total += flat[(x * SYMBOLS + y) * SYMBOLS + symbol]
                    x, y = y, symbol
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (piece, path))
        states = after
    _, path = min(states.values(), key=lambda s: s[0])
    pieces = []
    while path is not None:
        pieces.append(path[0])
        path = path[1]
    return "".join(reversed(pieces))


def total_cost(words: str, flat: list[float]) -> float:
    """The model's cost of words in a row, breaks at both ends. ``flat``: its costs in one list."""
    a = b = 0
    total = 0.0
    for c in words:
        symbol = _CODES.get(c, OTHER)
        total += flat[(a * SYMBOLS + b) * SYMBOLS + symbol]
        a, b = b, symbol
    return total + flat[(a * SYMBOLS + b) * SYMBOLS]


class Memory:
    """What is known of tokens, forgotten in two generations of ``MEMORY`` entries."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if len(self.new) > MEMORY:
            self.new, self.old = {}, self.new

    def missing(self, tokens: list[str]) -> list[str]:
        """The tokens that are not known, once each; those known go to the new generation."""
        fresh = set(tokens).difference(self.new)
        again = {t: self.old[t] for t in fresh if t in self.old}
        self.new.update(again)
        return list(fresh.difference(again))


class Restorer:
    """Restored words of texts. Tokens are decided one by one and remembered; a text
    in which letters may be spaced out over several tokens is read as a whole."""

    def __init__(self, model: np.ndarray):
        self.model, self.flat = model, model.ravel().tolist()
        self.known: dict[str, str] = {}
        self.told, self.spoken = Memory(), Memory()

    def _restored(self, token: str) -> str:
        if not _PAIRED.fullmatch(token):
            return f" {restore(token, self.model, self.flat)} "
        plain = " ".join(_WORD.findall(token))
        total = total_cost(plain, self.flat)
        if total <= UNLIKELY * (len(plain) + 1):
            return token
        pairs = _PAIR.findall(plain)
        if len(pairs) == 1:  # two paths: with both letters and with one
            short = plain.replace(pairs[0] * 2, pairs[0])
            less = total_cost(short, self.flat)
            out = short if less + SHORTEN_PAIR < total else plain
        else:
            out = " ".join(_WORD.findall(restore(token, self.model, self.flat)))
            less = total_cost(out, self.flat)
        return f" {out} " if less / (len(out) + 1) <= LIKELIER * total / (len(plain) + 1) else token

    def _replace(self, match: re.Match) -> str:
        token = match.group()
        if token not in self.known:
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known[token] = self._restored(token)
        return self.known[token]

    def token_words(self, token: str) -> list[str]:
        """The words of a token (lower case, no white space) that stands by itself."""
        return _WORD.findall(self._restored(token) if _DISGUISED_TOKEN.search(token) else token)

    @staticmethod
    def tell(token: str, n_words: int) -> int:
        """A token as one byte: its number of words (4 bits), of letters and marks that
        stand alone (up to 3); 128 if it does not fit."""
        if n_words > 15:
            return 128
        if len(token) > 2 and token[:-1].isalpha():
            return n_words
        return n_words | min(len(_ALONE.findall(token)), 3) << 4

    @staticmethod
    def spaced(told: np.ndarray, text: str) -> bool:
        """True if the text must be read as a whole: a token says too little, or letters are
        spaced out. These are searched for only if three letters or marks alone may follow
        one another (tokens without word, letter or mark alone may stand between them)."""
        if not (told > 15).any():
            return False
        if (told > 127).any():
            return True
        alone = told[told > 0] >> 4
        two = (alone[1:] > 0) & (alone[:-1] > 0)
        may = (alone > 2).any() or (two & (alone[1:] + alone[:-1] > 2)).any() or (two[1:] & two[:-1]).any()
        return bool(may) and _SPACED_RUN.search(text) is not None

    def whole_words(self, text: str) -> list[str]:
        """The restored words of a text (lower case), read as a whole."""
        return _WORD.findall(DISGUISED.sub(self._replace, text))

    def words(self, text: str | None) -> list[str]:
        """The restored words of a text, in order."""
        text = text.lower() if text else ""
        tokens = text.split()
        for token in self.spoken.missing(tokens):
            words = self.spoken.new[token] = self.token_words(token)
            self.told.new[token] = self.tell(token, len(words))
        spoken, told = self.spoken.new, self.told.new
        told.update((t, self.tell(t, len(spoken[t]))) for t in set(tokens).difference(told))
        codes = np.frombuffer(bytes(map(told.__getitem__, tokens)), dtype=np.uint8)
        out = self.whole_words(text) if self.spaced(codes, text) else [w for t in tokens for w in spoken[t]]
        self.spoken.turn(), self.told.turn()
        return out


def feature_ids(word: str) -> list[int]:
    """Hashed ids of a word's beginnings and of the whole word."""
    parts = [word[:n] for n in BEGINNINGS if n < len(word)]
    return [zlib.crc32(p.encode()) & MASK_BITS for p in parts] + [zlib.crc32((word + "$").encode()) & MASK_BITS]


def _shingle_minimum(words: list[str]) -> int:
    """Least hash of three words in a row: the same for copies, mostly so for near copies."""
    if len(words) < 3:
        return zlib.crc32(" ".join(words).encode())
    codes = np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.uint64, count=len(words))
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
             ^ codes[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return int((mixed ^ mixed >> np.uint64(32)).min() >> np.uint64(1))


def _sample_words(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            words = [restorer.words(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([_shingle_minimum(w) for w in words], pa.int64()),
                 pa.array([" ".join(w) for w in words])], ["doc_id", "toxic", "least", "words"])
    return run


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, feature, documents of label 1, of label 0) of a task's documents."""
    counts = np.zeros((2, 2, 1 << FEATURE_BITS), dtype=np.uint16)  # a sample has fewer rows
    known: dict[str, list[int]] = {}
    for batch in batches:
        for fold, toxic, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids: set[int] = set()
            for word in set(words.split()):
                if word not in known:
                    if len(known) > MEMORY:
                        known.clear()
                    known[word] = feature_ids(word)
                ids.update(known[word])
            counts[fold, toxic, np.fromiter(ids, dtype=np.int64, count=len(ids))] += 1
    for fold in range(2):
        found = np.flatnonzero(counts[fold].any(axis=0))
        for lo in range(0, len(found), 1 << 18):
            part = found[lo:lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), fold, dtype=np.int32)), pa.array(part.astype(np.int32)),
                 pa.array(counts[fold, 1, part].astype(np.int32)),
                 pa.array(counts[fold, 0, part].astype(np.int32))],
                ["fold", "feature", "ones", "zeros"])


def lexicon(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-odds less a margin of the features that are clearly commoner under label 1, else 0."""
    odds = np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))
    error = np.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
    clear = (odds >= LEAST_Z * error) & (ones >= LEAST_DOCS)
    return np.where(clear, odds - MARGIN * error, 0.0).astype(np.float32)


class Evidence:
    """What the words of a text say: the three largest weights (every occurrence of a
    word is one), the log of the total, and the total by length."""

    SIZE = 5

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        held = np.flatnonzero(weights)
        self.weights = dict(zip(np.asarray(features)[held].tolist(), np.asarray(weights)[held].tolist()))
        self.starts: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The largest weight of the word and of its beginnings."""
        if len(word) < BEGINNINGS.stop:
            return max([self.weights.get(i, 0.0) for i in feature_ids(word)])
        start = word[:BEGINNINGS.stop - 1]
        found = self.starts.get(start)
        if found is None:
            if len(self.starts) > MEMORY:
                self.starts.clear()
            # a longer word has all the beginnings
            found = self.starts[start] = max([self.weights.get(i, 0.0) for i in feature_ids(start + "$")[:-1]])
        return max(found, self.weights.get(zlib.crc32(word.encode() + b"$") & MASK_BITS, 0.0))

    def of(self, words: list[str]) -> tuple[float, ...]:
        return self.summed([w for w in map(self.weight, words) if w], len(words))

    @staticmethod
    def summed(found: list[float], n_words: int) -> tuple[float, ...]:
        found.sort(reverse=True)
        total = sum(found)
        first, second, third = (*found[:3], 0.0, 0.0, 0.0)[:3]
        return first, second, third, float(np.log1p(total)), total / (n_words + 20.0)


class Reader:
    """Evidence of texts, from what is remembered of their tokens."""

    def __init__(self, model: np.ndarray, features: np.ndarray, weights: np.ndarray):
        self.restorer, self.evidence = Restorer(model), Evidence(features, weights)
        self.weights: dict[str, list[float]] = {}

    def of(self, text: str | None) -> tuple[float, ...]:
        text = text.lower() if text else ""
        tokens, told = text.split(), self.restorer.told
        weight, weights = self.evidence.weight, self.weights
        for token in told.missing(tokens):
            words = self.restorer.token_words(token)
            told.new[token] = self.restorer.tell(token, len(words))
            found = [w for w in map(weight, words) if w]
            if found:
                weights[token] = found
        codes = np.frombuffer(bytes(map(told.new.__getitem__, tokens)), dtype=np.uint8)
        if self.restorer.spaced(codes, text):
            out = self.evidence.of(self.restorer.whole_words(text))
        else:
            found = [w for t in tokens if t in weights for w in weights[t]]
            out = self.evidence.summed(found, int((codes & 15).sum()))
        if len(told.new) > MEMORY:
            told.turn()
            self.weights = {t: w for t, w in weights.items() if t in told.old}
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on a design of a few columns, scaled; the intercept comes first."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    theta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (p - y) + ridge * np.r_[0, theta[1:]]
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(theta))
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = theta[1:] / deviation
    return np.r_[theta[0] - slopes @ mean, slopes]


def held_out(doc_id: Column) -> Column:
    """True for the rows whose label is never learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measure(features: np.ndarray, weights: list[np.ndarray]):
    """(toxic, evidence) of sampled documents, by the lexicon of the other fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = [Evidence(features, w) for w in weights]
        for batch in batches:
            rows = [list(evidence[1 - fold].of(words.split())) for fold, words in
                    zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])
    return run


@dataclass
class Learnt:
    """A lexicon (features with a weight) and logistic coefficients."""

    features: np.ndarray
    weights: np.ndarray
    theta: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, rows: int = TRAIN_ROWS) -> Learnt:
    """Lexicon and coefficients from at most ``rows`` labelled documents."""
    if not 0 < rows < 1 << 16:
        raise ValueError("rows must be between 1 and 65535")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
                          & ~held_out(F.col("doc_id")))
    picked = (usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
                    .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    # at most ``rows`` ids: bounded by the documented parameter
    sample = (docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
                  .select("doc_id", "toxic", "text")
                  .mapInArrow(_sample_words(model), "doc_id long, toxic int, least long, words string"))
    sample = scratch_table(sample, "toxicity-sample")
    once = sample.groupBy("least").agg(F.min("doc_id").alias("doc_id"))
    sample = (sample.join(once, ["least", "doc_id"])
                    .select((F.col("least") % 2).cast("int").alias("fold"), "toxic", "words"))
    sample = scratch_table(sample, "toxicity-once")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in
             sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n = np.asarray([[sizes.get((f, t), 0) for t in range(2)] for f in range(2)])
    if not n.sum(axis=0).all():  # one class or none
        share = (n[:, 1].sum() + 0.5) / (n.sum() + 1)
        return Learnt(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32),
                      np.r_[np.log(share / (1 - share)), np.zeros(Evidence.SIZE)])
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
            for c in ("ones", "zeros") for f in range(2)]
    # at most 2^FEATURE_BITS rows, and no more than the sample has features
    counted = (sample.mapInArrow(_count_features, "fold int, feature int, ones int, zeros int")
                     .groupBy("feature").agg(*sums).where(F.col("ones0") + F.col("ones1") >= LEAST_DOCS)
                     .toArrow())
    features = counted.column("feature").to_numpy().astype(np.int64)
    ones, zeros = (np.asarray([counted.column(f"{c}{f}").to_numpy() for f in range(2)], dtype=np.float64)
                   for c in ("ones", "zeros"))
    by_fold = [lexicon(ones[f], zeros[f], n[f, 1], n[f, 0]) for f in range(2)]
    measured = sample.mapInArrow(_measure(features, by_fold), "toxic int, x array<double>").toArrow()
    x = np.asarray(measured.column("x").to_pylist(), dtype=np.float64).reshape(-1, Evidence.SIZE)
    theta = fit_logistic(x, measured.column("toxic").to_numpy().astype(float))
    weights = lexicon(ones.sum(axis=0), zeros.sum(axis=0), *n.sum(axis=0)[::-1])
    return Learnt(features[weights > 0], weights[weights > 0], theta)


def score_of(text: Column, model: np.ndarray, learnt: Learnt) -> Column:
    """The probability of label 1 for a text column."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model, learnt.features, learnt.weights)
        for texts in batches:
            x = np.asarray([reader.of(t) for t in texts]).reshape(-1, Evidence.SIZE)
            yield pd.Series(1 / (1 + np.exp(-np.clip(learnt.theta[0] + x @ learnt.theta[1:], -30, 30))))
    return score(text)


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = language_model(docs)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(
        F.col("text"), model, learn(docs, labels, model, rows)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxic_removed(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    model = language_model(docs)
    return docs.where(score_of(F.col("text"), model, learn(docs, labels, model, rows)) < THRESHOLD)


def op9_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
