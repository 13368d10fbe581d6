"""Information-theoretic sanitisation of personal data (operator 5, native).

Base entities (email, ip, card, phone) are found by pattern in every whole text.
The corpus then says which other words give an entity away. For an entity e and
a word t that stands near it,

    disclosure = PMI(t, e) / IC(e) = 1 + log2(n(t, e) / n(t)) / log2(N / n(e)),

with N documents, n(.) of them holding e or t, and n(t, e) with t within
``CONTEXT_WORDS`` words of e: 1 if t never appears without e, 0 if t tells
nothing. Words of at least ``GENERALISE`` are replaced by their class wherever
they stand, words of at least ``REMOVE`` go. Copies of a passage are no evidence, nor
do they take any away: a word and an entity must have contexts in ``SUPPORT`` different
texts, no two of them copies or near copies (``ALIKE`` of their other words shared),
however often each occurs and whatever stands in the others.

All counts are over all documents and combined before the shuffle. Only words
with support are counted in the corpus; they are a written table, so the planner
broadcasts them if there are few. Texts are not shuffled unless they hold such
words and these are many.

Patterns are the plain ones with the same matches, rewritten so that no group
repeats recursively and no start is tried twice: a long run of digits or letters
costs linear time and no stack.

Defined results: a null text is empty; an empty table gives no rows; repeated
rows stay (each counts as a document); offsets are code points; further columns
are ignored. An entity that all documents hold has no information and discloses
nothing.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import fold_case, folded_words, let, scratch_table, table

CONTEXT_WORDS = 5
# Characters beside a span in which its words are looked for first; wider if they hold too few.
CONTEXT_CHARS = (120, 2000)
SUPPORT = 3
ALIKE = 2 / 3
GENERALISE = 0.75
REMOVE = 0.9

KINDS = ("email", "ip", "card", "phone")
# What the patterns match is given by contract.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
WORD_CHAR = r"[0-9a-z\x{80}-\x{10FFFF}]"
SPAN = "struct<kind:string,start:int,stop:int>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def term(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a valid match meets."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "card":
        return text.rlike("[0-9](?:[\\x20-]?[0-9]){12}")
    return text.rlike("[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]")


def _found(text: Column, pattern: Column, valid) -> Column:
    """Array of (start, stop) of the valid matches, in code points.

    The matches and the pieces between them alternate; their lengths add up to
    the offsets. Only valid matches are kept while adding."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def put(pieces: Column, matches: Column):
        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(pieces[i])
            stop = start + F.length(matches[i])
            span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
            return F.struct(stop.alias("at"), F.when(valid(matches[i]), F.concat(s["out"], span))
                            .otherwise(s["out"]).alias("out"))
        return step
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, let(
        F.split(text, pattern, -1), lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(m) - 1), state, put(p, m), lambda s: s["out"]))))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, stop): by kind in the order of ``KINDS``, then start."""
    parts = []
    for kind in KINDS:
        spans = F.when(_may_hold(kind, text), _found(text, F.lit(PATTERNS[kind]), partial(_valid, kind)))
        parts.append(F.coalesce(_tagged(spans, kind), F.array().cast(f"array<{SPAN}>")))
    return F.flatten(F.array(*parts))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _beside(text: Column, s: Column, after: bool) -> Column:
    """The ``CONTEXT_WORDS`` whole words before or after a span: from the first reach that
    holds them, at last from the whole text. A word that a reach cuts does not count."""
    def within(chars: int | None) -> Column:
        if after:
            part = F.substring(text, s["stop"] + 1, F.length(text) if chars is None else F.lit(chars))
            words = folded_words(part)
            cut = F.lit(False) if chars is None else s["stop"] + chars < F.length(text)
            whole = let(words, lambda w: F.when(cut, F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w))
            return F.slice(whole, 1, CONTEXT_WORDS)
        begin = F.lit(0) if chars is None else F.greatest(s["start"] - chars, F.lit(0))
        words = folded_words(F.substring(text, begin + 1, s["start"] - begin))
        whole = let(words, lambda w: F.when(begin > 0, F.slice(w, 2, F.size(w))).otherwise(w))
        return let(whole, lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT_WORDS + 1, F.lit(1)), CONTEXT_WORDS))
    def enough(wider: Column):
        return lambda near: F.when(F.size(near) >= CONTEXT_WORDS, near).otherwise(wider)
    out = within(None)
    for chars in reversed(CONTEXT_CHARS):
        out = let(within(chars), enough(out))
    return out


def _contexts(text: Column, spans: Column) -> Column:
    """Array of (entity, words near it) without repeats."""
    def near(s: Column) -> Column:
        value = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        plain = F.when(s["kind"].isin("card", "phone"), _digits(value)).otherwise(fold_case(value))
        return F.struct(F.concat_ws(":", s["kind"], plain).alias("entity"),
                        F.concat(_beside(text, s, False), _beside(text, s, True)).alias("words"))
    return F.array_distinct(F.transform(spans, near))


def _with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, contexts) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"),
                       let(text, lambda t: let(base_spans(t), lambda s: F.struct(
                           s.alias("spans"), F.when(F.size(s) > 0, _contexts(t, s)).alias("contexts"))))
                       .alias("found"))
    return scratch_table(rows.select("doc_id", "key", "found.*"), "base-spans")


def _disclosure(n_term: str) -> Column:
    """PMI over IC from the columns n_all, n_entity, n_both and the word's count."""
    information = F.log2(F.col("n_all") / F.col("n_entity"))
    share = F.least(F.lit(1.0), F.col("n_both") / F.col(n_term))
    return F.when(information > 0, 1 + F.log2(share) / information)


def _independent(contexts: DataFrame, support: int) -> DataFrame:
    """(entity, term) of (entity, term, key, words) with contexts in ``support`` texts of
    which no two are alike: each round sets one context aside and drops those like it
    and those of its text."""
    pair = ["entity", "term"]
    left = scratch_table(contexts.select(*pair, "key", F.array_sort(F.array_distinct(F.array_remove(
        F.col("words"), F.col("term")))).alias("words")).distinct(), "contexts")
    for _ in range(support - 1):
        first = left.groupBy(pair).agg(F.min(F.struct("words", "key")).alias("first"))
        first = scratch_table(first.select(*pair, F.col("first.words").alias("first"), F.col("first.key").alias("one")),
                              "first-contexts")
        shared = F.size(F.array_intersect("words", "first"))
        alike = shared >= ALIKE * F.greatest(F.size("words"), F.size("first"))
        left = scratch_table(left.join(first, pair).where(~alike & (F.col("key") != F.col("one")))
                                 .drop("first", "one"), "contexts")
    return left.select(*pair).distinct()


def disclosing_terms(docs: DataFrame, base: DataFrame, support: int = SUPPORT,
                     least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """((term, disclosure) of at least ``least``, (key, term) of the texts that hold them)."""
    known = base.where("contexts is not null")
    each = known.select("key", F.explode("contexts").alias("c")).select("key", "c.entity", "c.words")
    entities = known.select(
        F.explode(F.array_distinct(F.transform("contexts", lambda c: c["entity"]))).alias("entity")
    ).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # once for each document, however often the two stand together in it
    beside = F.array_distinct(F.flatten(F.transform("contexts", lambda c: F.transform(
        c["words"], lambda w: F.struct(c["entity"].alias("entity"), w.alias("term"))))))
    pairs = known.select("key", F.explode(beside).alias("p")).groupBy("p.entity", "p.term", "key").agg(F.count("*").alias("n"))
    pairs = (pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"))
                  .where(F.col("texts") >= support))
    total = base.agg(F.count("*").alias("n_all"))
    # documents with the word near any entity: at most n(t), so what fails with
    # this count fails with n(t) and need not be counted in the corpus
    near = base.where("contexts is not null").select(F.explode(F.array_distinct(F.flatten(
        F.transform("contexts", lambda c: c["words"])))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_near"))
    pairs = pairs.join(entities, "entity").withColumn("n_all", total.scalar())
    pairs = scratch_table(pairs.join(near, "term").where(_disclosure("n_near") >= least), "pairs")
    contexts = each.select("key", "entity", "words", F.explode(F.array_distinct("words")).alias("term")).join(
        pairs.select("entity", "term"), ["entity", "term"])
    pairs = scratch_table(pairs.join(_independent(contexts, support), ["entity", "term"]), "supported")
    terms = scratch_table(pairs.select("term").distinct(), "terms")
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.xxhash64(text).alias("key"),
                       F.explode(F.array_distinct(folded_words(F.col("text")))).alias("term"))
    held = scratch_table(held.join(terms, "term").groupBy("key", "term").agg(F.count("*").alias("n")), "held")
    counts = held.groupBy("term").agg(F.sum("n").alias("n_term"))
    scored = pairs.join(counts, "term").withColumn("disclosure", _disclosure("n_term"))
    chosen = (scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
                    .where(F.col("disclosure") >= least))
    chosen = scratch_table(chosen, "disclosing")
    return chosen, held.join(chosen, "term").select("key", "term", "disclosure")


def _term_spans(text: Column, terms: Column) -> Column:
    """(start, stop) of the words ``terms`` in a text."""
    return F.coalesce(_found(fold_case(text), F.lit(f"{WORD_CHAR}++"), lambda word: F.array_contains(terms, word)),
                      F.array().cast("array<struct<start:int,stop:int>>"))


def _apart(terms: Column, base: Column) -> Column:
    """Term spans that touch no base span."""
    return F.filter(terms, lambda t: ~F.exists(
        base, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, terms): base spans and the method's of every document."""
    base = _with_spans(docs)
    _, held = disclosing_terms(docs, base)
    by_text = scratch_table(held.groupBy("key").agg(F.collect_set("term").alias("words")), "term-texts")
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).join(by_text, "key")
    # copies of a text have the same spans: one row per text
    placed = placed.select("key", _term_spans(F.col("text"), F.col("words")).alias("terms"))
    placed = scratch_table(placed.groupBy("key").agg(F.max("terms").alias("terms")), "term-spans")
    out = base.select("doc_id", "key", "spans").join(placed, "key", "left")
    return out.select("doc_id", "spans", F.coalesce(
        _tagged(_apart(F.col("terms"), F.col("spans")), "term"), F.array().cast(f"array<{SPAN}>")).alias("terms"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced in its text (and n_chars following it)."""
    base = _with_spans(docs)
    _, held = disclosing_terms(docs, base)
    by_text = held.groupBy("key").agg(
        F.collect_set(F.when(F.col("disclosure") < REMOVE, F.col("term"))).alias("_general"),
        F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))).alias("_gone"))
    by_text = scratch_table(by_text.withColumnRenamed("key", "_key"), "term-texts")
    known = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(by_text, F.xxhash64(known) == F.col("_key"), "left")
    none = F.array().cast(f"array<{SPAN}>")

    def terms(column: str, kind: str, base: Column) -> Column:
        spans = F.when(F.size(column) > 0, _apart(_term_spans(known, F.col(column)), base))
        return F.coalesce(_tagged(spans, kind), none)
    text = let(base_spans(known), lambda s: replaced(
        known, F.concat(s, terms("_general", "general", s), terms("_gone", "gone", s))))
    text = F.when(docs["text"].isNotNull(), text)
    out = joined.withColumn("_text", text)
    keep = []
    for name in docs.columns:
        if name == "text":
            keep.append(F.col("_text").alias("text"))
        elif name == "n_chars":
            kind = docs.schema["n_chars"].dataType
            keep.append(F.when(docs["text"].eqNullSafe(F.col("_text")), docs["n_chars"])
                         .otherwise(F.length("_text")).cast(kind).alias("n_chars"))
        else:
            keep.append(docs[name])
    return out.select(*keep)


def replaced(text: Column, spans: Column) -> Column:
    """A text with its spans replaced; of spans that overlap the first names the place."""
    def instead(s: Column) -> Column:
        value = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        out = F.when(s["kind"] == "gone", "").when(
            s["kind"] == "general", F.when(value.rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]"))
        for kind, word in PLACEHOLDERS.items():
            out = out.when(s["kind"] == kind, word)
        return out

    def put(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        apart = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"),
                        F.when(apart, F.concat(state["out"], F.array(between, instead(s))))
                         .otherwise(state["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    whole = F.aggregate(ordered, start, put, lambda s: F.concat_ws(
        "", F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.length(text))))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def digested(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    found = found_spans(docs)
    count = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: B023
             for kind in KINDS]
    return found.select("doc_id", *count, F.sha2(_written(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
                        _written(F.concat("spans", "terms")).alias("spans"))


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
