"""Benchmark decontamination by winnowing (operator 7, native).

Words are maximal runs of letters, digits and non-ASCII characters after the
A-Z fold. An item's windows are its spans of ``SPAN`` words; an item of fewer
words is one window. Documents and items are winnowed with k + w - 1 = window
length (short items: once per length that occurs, at most ``SPAN`` - 1
lengths), so a shared window always shares a hash. Hits are extended: around
every hit k-gram of a document all windows that contain it are compared with
the benchmark's windows word by word, so hash collisions drop out.

No text moves before it is known to share a hash. The benchmark's hashes also
mark a bit table of ``BITS`` bits, two bits a hash, that goes to every task (512
KB, whatever the benchmark's size). The first pass winnows each document in its
row and keeps the hashes whose bits are both set: all that the benchmark has, and
of the others about (2n / BITS)^2 for n benchmark hashes. A larger benchmark lets
more documents through, it never loses one. Only the rows that keep a hash carry
their text on; the copies of a text are one row from there (key: two hashes of
it), and all joins are between these rows and the benchmark's written tables.

Defined results: null, empty and wordless texts have no words and no hits; items
without words never occur; null item_ids count and appear as empty strings;
repeated items of one id count once; repeated documents stay; empty tables give
no rows, or documents without hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import folded_words, let, scratch_table, table
from aeris.llm.winnowing import kgram_hashes, split_span, winnowed

SPAN = 10
GRAM = 5
# Bits of the table that is tested before a text moves; a power of two, 64 at least.
BITS = 1 << 22


def _key(text: Column) -> list[Column]:
    """A text's identity: 96 bits of two hashes, null as an empty text."""
    known = F.coalesce(text, F.lit(""))
    return [F.xxhash64(known).alias("key"), F.crc32(known.cast("binary")).alias("key2")]


def _windows(words: Column, starts: Column, span: int) -> Column:
    """Array of (start, span, words) for window starts."""
    return let(words, lambda w: F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.lit(span).alias("span"),
        F.concat_ws(" ", F.slice(w, s + 1, span)).alias("window"))))


def _all_starts(words: Column, span: int) -> Column:
    return F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)).otherwise(
        F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, words, span) of every item that has words."""
    items = benchmark.select("item_id", folded_words(F.col("text")).alias("words"))
    return items.where(F.size("words") > 0).withColumn("span", F.least(F.size("words"), F.lit(span)))


def _places(hash_: Column, span: Column, bits: int) -> list[Column]:
    """The two bits of a hash."""
    mixed = hash_.bitwiseXOR(span.cast("long"))
    return [mixed.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(mixed, 32).bitwiseAND(F.lit(bits - 1))]


def bit_table(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """One row: the bits of all (hash, span) as an array of ``bits`` / 64 longs."""
    place = prints.select(F.explode(F.array(*_places(F.col("hash"), F.col("span"), bits))).alias("p"))
    words = place.select(F.shiftright("p", 6).alias("id"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    words = words.groupBy("id").agg(F.bit_or("bit").alias("bit"))
    # as many rows as the table has longs, whatever the benchmark
    dense = prints.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce(
        "bit", F.lit(0).cast("long")).alias("bit"))
    one = dense.agg(F.array_sort(F.collect_list(F.struct("id", "bit"))).alias("w")).select(F.col("w.bit").alias("bits"))
    return scratch_table(one, "bit-table")


def _all_set(table_: Column, hash_: Column, span: Column, bits: int) -> Column:
    first, second = [F.getbit(F.get(table_, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
                     for p in _places(hash_, span, bits)]
    return first & second


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM,
         bits: int = BITS, carried: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc, key, key2, n_words, suspect) of every document, doc with its ``carried``
    columns (default: all); (key, key2, spans, items) of every text with hits)."""
    items = scratch_table(benchmark_windows(benchmark, span), "items")
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())  # at most ``span``

    def marks(words: Column, n: int) -> Column:
        return winnowed(words, n, gram)
    prints = None
    for n in spans:
        one = items.where(F.col("span") == n).select(F.explode(marks(F.col("words"), n)).alias("hash")) \
                   .select("hash", F.lit(n).alias("span"))
        prints = one if prints is None else prints.unionByName(one)
    text = docs["text"]
    rows = docs.select(F.struct(*[docs[c] for c in carried or docs.columns]).alias("doc"), *_key(text),
                       text.alias("text"), folded_words(text).alias("words"))
    counted = F.size("words").cast("long").alias("n_words")
    if prints is None:
        base = rows.select("doc", "key", "key2", counted, F.lit(False).alias("suspect"))
        return base, base.select("key", "key2", F.array().cast("array<struct<start:int,span:int>>").alias("spans"),
                                 F.array().cast("array<string>").alias("items")).limit(0)
    prints = scratch_table(prints.distinct(), "item-prints")
    # 2^16 longs: bounded by the documented parameter
    rows = rows.withColumn("table", bit_table(prints, bits).select("bits").scalar())

    def tag(n: int) -> Column:
        here = let(F.col("table"), lambda t: F.filter(
            marks(F.col("words"), n), lambda h: _all_set(t, h, F.lit(n), bits)))
        return F.transform(here, lambda h: F.struct(h.alias("hash"), F.lit(n).alias("span")))
    rows = rows.select("doc", "key", "key2", "text", counted,
                       F.flatten(F.array(*[tag(n) for n in spans])).alias("prints"))
    rows = rows.withColumn("suspect", F.size("prints") > 0)
    base = scratch_table(rows.withColumn("text", F.when(F.col("suspect"), F.col("text"))), "doc-prints")
    # of a text's copies one goes on
    texts = base.where("suspect").groupBy("key", "key2").agg(
        F.any_value("prints").alias("prints"), F.any_value("text").alias("text"))
    texts = scratch_table(texts, "suspect-texts")
    # a text's hashes that the benchmark has
    found = texts.select("key", "key2", F.explode("prints").alias("p")).select(
        "key", "key2", F.col("p.hash").alias("hash"), F.col("p.span").alias("span"))
    found = found.join(prints, ["hash", "span"], "left_semi").groupBy("key", "key2").agg(
        F.collect_set(F.struct("hash", "span")).alias("found"))
    found = scratch_table(found, "hit-texts")

    # extension: all windows around a hit k-gram, compared with the benchmark's
    def around(n: int) -> Column:
        k, width = split_span(n, gram)
        wanted = F.transform(F.filter("found", lambda f: f["span"] == n), lambda f: f["hash"])

        def starts(w: Column) -> Column:
            at = let(kgram_hashes(w, k), lambda h: let(wanted, lambda f: F.filter(
                F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))),
                lambda i: (F.size(h) > 0) & F.array_contains(f, F.get(h, i)))))
            near = F.flatten(F.transform(at, lambda p: F.sequence(
                F.greatest(p - (width - 1), F.lit(0)), F.least(p, F.size(w) - n))))
            return F.array_distinct(near)
        return F.when(F.size(wanted) > 0, let(F.col("words"), lambda w: _windows(w, starts(w), n)))
    texts = texts.join(found, ["key", "key2"]).select("key", "key2", "found", folded_words(F.col("text")).alias("words"))
    empty = F.array().cast("array<struct<start:int,span:int,window:string>>")
    near = texts.select("key", "key2", F.explode(F.flatten(F.array(
        *[F.coalesce(around(n), empty) for n in spans]))).alias("w")).select("key", "key2", "w.*").distinct()
    known = None
    for n in spans:
        one = items.where(F.col("span") == n).select(
            "item_id", F.explode(_windows(F.col("words"), _all_starts(F.col("words"), n), n)).alias("w"))
        one = one.select("item_id", "w.span", "w.window")
        known = one if known is None else known.unionByName(one)
    known = known.groupBy("span", "window").agg(
        F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    known = scratch_table(known, "item-windows")
    same = near.join(known, ["span", "window"])
    same = same.groupBy("key", "key2").agg(
        F.collect_list(F.struct("start", "span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return base.select("doc", "key", "key2", "n_words", "suspect"), scratch_table(same, "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN,
                  gram: int = GRAM) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    base, found = hits(docs, benchmark, span, gram, carried=["doc_id"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["span"] - 1)))))
    found = found.select("key", "key2", covered.cast("long").alias("n_hit"),
                         F.size("items").cast("long").alias("n_items"),
                         F.array_join("items", ",").alias("ids"))
    known = base.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "key", "key2", "n_words", "suspect")
    none = F.lit(0).cast("long")
    clean = known.where(~F.col("suspect")).select(
        "doc_id", "n_words", none.alias("n_hit"), none.alias("n_items"), F.lit("").alias("ids"))
    rest = known.where("suspect").join(found, ["key", "key2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("ids", F.lit("")).alias("ids"))
    return clean.unionByName(rest).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def contaminated_removed(docs: DataFrame, benchmark: DataFrame, span: int = SPAN,
                         gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark."""
    base, found = hits(docs, benchmark, span, gram)
    kept = base.where("suspect").join(found.select("key", "key2"), ["key", "key2"], "left_anti")
    return base.where(~F.col("suspect")).select("doc").unionByName(kept.select("doc")).select("doc.*")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT n, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT n, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, m WHERE len(w) >= m)),
hit AS (SELECT n, dw.m, s, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(s, s + m)) AS p FROM hit) GROUP BY n),
items AS (
  SELECT n, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)
"""
