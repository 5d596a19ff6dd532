"""Phrases whose words keep together, found by Toivonen's sampling method.

1. A sample, a fixed fraction of all documents, is counted with a lowered minimum: its frequent phrases S are proposed.
2. One pass over all documents counts, exactly and together, S and its negative border: the phrases whose two
   shorter parts (without the last and without the first word) are in S, whether they are in S themselves or not. Any
   word has no shorter part, so all words are counted.
3. A border phrase that turns out frequent is a failure of the sample: phrases that hold it were not counted. The
   next pass counts those too: every phrase not counted so far whose two shorter parts are each frequent or one of these new
   phrases itself. That takes in whatever further expansion could ask for, so after this pass the result is closed. A
   phrase can only be frequent if its parts are: nothing frequent is left uncounted, whatever the sample was.

S travels as a bitmap of hashes of at most BITS bits, whatever the corpus: a false hit only counts a phrase more. What
the first pass has counted follows from the bitmap alone. That pass counts 64-bit keys, so two phrases of one key can only be
taken for frequent too early; the second counts the phrases of frequent keys, and the new ones, by their words, and its counts
are the result. Tasks add up what a few megabytes of text hold before the shuffle, so a phrase that stands everywhere is a row
per piece of input, not one per occurrence.

Score of a phrase cut after its first k words: floor(2,000,000 * a / (l + r)) with a, l, r the counts of the phrase
and its two parts; the lowest-scoring cut counts, ties to the smallest k. A phrase inside a longer one with
at least 80 % of its count is dropped. Arithmetic is decimal, beyond 64 bits.

Defined results: null text is empty, null lang is `und`; doc_id may be null or repeated; a language without phrases
has no rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyhive.llm.common import discard, flushes, prepare, stored, table

#: Most words of a phrase; least count; most rows a language returns; documents per sampled document.
LONGEST, MINIMUM, ROWS, EVERY = 4, 30, 2000, 4
#: Largest bitmap (32 MB); bytes of text counted together in a task.
BITS, FLUSH = 1 << 28, 4 << 20
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEYS, COUNTS = "key long, words int, a long", "lang string, words int, phrase string, a long"


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of its two parts that are one word shorter."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Part:
    """A stretch of text as word places: number of the word, its hash, and how many more words follow in its piece."""

    def __init__(self, data: np.ndarray, breaks: np.ndarray, langs: np.ndarray, names: list[str]):
        """breaks: the first byte of each text in `data`; langs: each text's place in names."""
        kind = _KIND[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[breaks[breaks < len(data)]] = inside[breaks[breaks < len(data)]]
        starts = np.flatnonzero(first)
        of_text = np.searchsorted(breaks, starts, "right") - 1
        piece = np.cumsum(kind == 2)[starts] + of_text
        bounds = np.append((np.cumsum(inside) - inside)[starts], inside.sum()).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[inside]])])
        words = words.dictionary_encode()
        self._of = (langs[of_text].astype(np.int64), words.indices.to_numpy(), names, words.dictionary.cast(pa.large_string()))
        hashed = lambda values: pd.util.hash_array(np.array(values, object), categorize=False)
        lang, which = self._of[:2]
        first = mixed(hashed(names)[lang], hashed(self._of[3].to_pylist())[which]) if len(which) else np.zeros(0, np.uint64)
        self.hash = [None, first]
        same = piece[1:] == piece[:-1]
        self.fits = [None, np.ones(len(starts), bool), np.append(same, False)[:len(starts)]]
        for n in range(2, LONGEST + 1):
            if n > 2:
                self.fits.append(self.fits[2] & np.append(self.fits[n - 1][1:], False)[:len(starts)])
            self.hash.append(mixed(self.hash[n - 1], np.append(self.hash[n - 1][1:], np.uint64(0))[:len(starts)]))

    @functools.cached_property
    def _numbered(self):
        """Number of the word at each place (the same word of two languages is two), language and spelling by number."""
        lang, which, names, spelled = self._of
        key, word = np.unique(lang * max(1, len(spelled)) + which, return_inverse=True)
        lang, spell = np.divmod(key, max(1, len(spelled)))
        return word, pa.array(names, pa.string()).take(pa.array(lang)), spelled.take(pa.array(spell))

    def totals(self) -> pa.RecordBatch:
        """Words of each language, as a phrase of 0 words."""
        lang, _, names, _ = self._of
        return _rows(pa.array(names, pa.string()), 0, pa.array([""] * len(names)), np.bincount(lang, minlength=len(names)))

    def border(self, n: int, held: np.ndarray | None) -> np.ndarray:
        """Places where a phrase of n words starts whose two shorter parts are held (one bit per place)."""
        if n == 1:
            return self.fits[1]
        inside = held & self.fits[n - 1]
        return self.fits[n] & inside & np.append(inside[1:], False)[:len(inside)]

    def counted(self, n: int, where: np.ndarray) -> pa.RecordBatch:
        """The distinct phrases of n words that start at these places, with their counts."""
        at = np.flatnonzero(where)
        word, lang, spelled = self._numbered
        keys, ids = np.unique(word[at], return_inverse=True)
        shown = [keys]
        for k in range(1, n):
            keys, ids = np.unique(ids * len(spelled) + word[at + k], return_inverse=True)
            shown = [x[keys // len(spelled)] for x in shown] + [keys % len(spelled)]
        texts = [spelled.take(pa.array(x)) for x in shown]
        phrase = texts[0] if n == 1 else pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string()))
        return _rows(lang.take(pa.array(shown[0])), n, phrase, np.bincount(ids, minlength=len(shown[0])))


def _rows(lang, n, phrase, a) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(np.full(len(lang), n, np.int32)), phrase.cast(pa.string()), pa.array(a.astype(np.int64))], names=["lang", "words", "phrase", "a"])


def parts(batches, flush: int = FLUSH):
    """Texts in stretches of about `flush` bytes, cut where a piece ends."""
    for batch in flushes(batches, flush):
        texts, langs = batch.column("text").cast(pa.large_string()), batch.column("lang").dictionary_encode()
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if bounds[0] == bounds[-1]:
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        ends = np.union1d(np.flatnonzero(_KIND[data] == 2) + 1, bounds[1:]) if len(data) > flush else bounds[-1:]
        at = 0
        while at < len(data):
            to = int(ends[min(np.searchsorted(ends, at + flush), len(ends) - 1)])
            i, j = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, to)
            part = Part(data[at:to], np.maximum(bounds[i:j] - at, 0), which[i:j], names)
            if len(part.hash[1]):
                yield part
            at = to


def _keyed(part: Part, n: int, where: np.ndarray) -> pa.RecordBatch:
    key, a = np.unique(part.hash[n][where], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), n, np.int32)), pa.array(a.astype(np.int64))], names=["key", "words", "a"])


def _sampled(batches):
    """Keys and counts of all phrases but the longest."""
    for part in parts(batches):
        for n in range(1, LONGEST):
            yield _keyed(part, n, part.fits[n])


def _border(proposed):
    """Keys and counts of the proposed phrases and their border."""
    def run(batches):
        bitmap = np.frombuffer(proposed.value, np.uint8)
        for part in parts(batches):
            for n in range(1, LONGEST + 1):
                where = part.border(n, has(bitmap, part.hash[n - 1]) if n > 1 else None)
                if where.any():
                    yield _keyed(part, n, where)

    return run


def _by_words(proposed, frequent):
    """Counts by words of the phrases with frequent keys and of those that failures of the sample left out; and as
    phrases of 0 words the words of each language in all."""
    def run(batches):
        before, bitmap = np.frombuffer(proposed.value, np.uint8), np.frombuffer(frequent.value, np.uint8)
        for part in parts(batches):
            yield part.totals()
            hopeful = None
            for n in range(1, LONGEST + 1):
                left_out = part.border(n, hopeful) & ~part.border(n, has(before, part.hash[n - 1])) if n > 1 else False
                hopeful = part.fits[n] & has(bitmap, part.hash[n]) | left_out
                if hopeful.any():
                    yield part.counted(n, hopeful)

    return run


def _not_in(bitmap):
    """Keys that the bitmap does not hold."""
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[~has(bits, keys.view(np.uint64))])], names=["key"])

    return run


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits at hash modulo `bits` of a column `key`, put together by 4 KB blocks in the cluster."""
    bit = F.col("key").bitwiseAND(bits - 1) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(bit).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    found = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in blocks.toLocalIterator():
        found[(row["block"] - 1) * 4096:row["block"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return found[:bits // 8]


def frequent(docs: DataFrame, minimum: int = MINIMUM, every: int = EVERY, largest: int = BITS) -> tuple[DataFrame, int]:
    """lang, words (1 to 4), phrase, a of all phrases with a count of at least `minimum`, and per language a row of 0 words
    with the count of all words; and the number of the sample's failures. docs: doc_id, text, lang."""
    spark = prepare(docs.sparkSession)
    read = lambda some: some.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, picked = read(docs), read(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0))
    expected = minimum / every
    lowered = max(1, math.floor(expected - 1.5 * math.sqrt(expected)))
    summed = lambda counts: counts.groupBy("key", "words").agg(F.sum("a").alias("a"))
    bits_for = lambda n: 1 << max(15, min(largest.bit_length() - 1, (16 * n).bit_length()))
    proposed = stored(summed(picked.mapInArrow(_sampled, KEYS)).where(F.col("a") >= lowered).select("key"), "proposed")
    bits = bits_for(proposed.count())
    bitmap = spark.sparkContext.broadcast(bitmap_of(proposed, bits).tobytes())
    discard(proposed)
    keys = stored(summed(rows.mapInArrow(_border(bitmap), KEYS)).where(F.col("a") >= minimum).select("key", "words"), "keys")
    failures = keys.where(F.col("words") < LONGEST).mapInArrow(_not_in(bitmap), "key long").count()
    sure = spark.sparkContext.broadcast(bitmap_of(keys, bits_for(keys.count())).tobytes())
    counts = rows.mapInArrow(_by_words(bitmap, sure), COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))
    return stored(counts.where((F.col("a") >= minimum) | (F.col("words") == 0)), "frequent"), failures


def collocations(docs: DataFrame, minimum: int = MINIMUM, rows: int = ROWS, every: int = EVERY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words."""
    spark = prepare(docs.sparkSession)
    counts, _ = frequent(docs, minimum, every)
    totals = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    known = counts.where("words > 0").select("lang", "phrase", "a")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("w"))
    joined = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: joined(i, n))))
    longer = candidates.where("words > 2").select("lang", "a", F.explode(F.array_distinct(places)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr("longer is null or cast(100 as decimal(20, 0)) * longer < cast(80 as decimal(20, 0)) * a"))
    kept = kept.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("share"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each share of a language keeps its best rows, so few meet in one task
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= rows)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= rows)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select lang, regexp_extract_all(piece, '[^ \\t]+') w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\f\\r]')) piece from d)),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase from (
        select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (select unnest([1, 2, 3, 4]) k) where len(w) >= k)),
f as (select lang, phrase, k, count(*)::hugeint a from g group by all having count(*) >= 30),
n as (select lang, count(*) n from g where k = 1 group by lang),
c as (select lang, phrase, k, a, string_split(phrase, ' ') w from f where k > 1),
cuts as (select c.lang, c.phrase, c.a, j, x.a l, y.a r, (2000000 * c.a) // (x.a + y.a) score
         from (select *, unnest(range(1, k)) j from c) c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ')
         join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
s as (select lang, phrase, a, l, r, score from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select lang, array_to_string(w[i:i + m - 1], ' ') phrase, max(a) longer from (
             select lang, w, a, m, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from c)) group by all),
kept as (select s.* from s left join inside using (lang, phrase) where longer is null or 100 * longer < 80 * s.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from kept)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from r join n using (lang) where rank <= 2000
"""
