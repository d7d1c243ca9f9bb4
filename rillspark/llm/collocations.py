"""Phrase collocation mining by top-order marginalisation.

Every word starts one window: its own column and those of the words that follow it in its piece (lead columns w1 ... wk, k = longest
phrase), padded where the piece ends. Only these longest windows are counted. Spark's ROLLUP over (lang, w1, ..., wk) then sums them over
successively shorter prefixes: the sum of a prefix of j words is how often the phrase of these j words occurs, and that of lang alone is the number of words.
Phrases of fewer words are never exploded.

Windows end early where no frequent phrase can go on. Two passes before hash n-grams into BUCKETS counters, which tell what is certainly rare: the first
counts words and word pairs, the second longer n-grams all of whose pairs are in buckets that reach the threshold. An n-gram in a light bucket is rarer than
the threshold, and so is every phrase that holds it, so its window is padded there; a word in a light bucket becomes padding itself and counts in the
total only. A task keeps one small counter a bucket (which stops at the threshold) and sends them compressed, in chunks; Spark sums the chunks, and the driver and each
task get one bit a bucket, whatever the size of the corpus. Whatever the buckets say, frequent phrases keep all their windows: the counts are exact, and
with far more n-grams than buckets only the saving goes (more buckets, at a byte each in a task, bring it back). The words of a slice of text are told apart by Arrow's dictionary, the windows are sent
to Spark as columns of strings, and a hot word, pair or passage is summed in each task before it is shuffled.

Scores are decimals of 38 digits, divided exactly. A phrase is dropped if a longer candidate that holds it is as frequent (in the share asked for):
for a share of 100 it is enough to look one word further, since what lies between is as frequent as both.

Results for odd input: null text counts as empty, null lang as `und`; a text without words counts nothing; words of any length are
words; white space other than space and tab (no-break spaces, for instance) is part of words; repeated rows count as often as they stand there; ties go by a, then
by the bytes of the phrase; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import byte_column, scratch, slices, written

#: Counters of a pass, a power of two; and how many of them go together.
BUCKETS, CHUNK = 1 << 25, 1 << 15
#: Bytes of text that a task holds as words at a time.
SLICE = 1_000_000

# The marks that end a piece, and what parts words.
MARKS, GAPS = b".,;:!?\n\v\f\r", b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(MARKS)] = 1, 2
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


class Words:
    """The words of a slice of texts, in order: their codes in a dictionary, their rows, and whether the next word is in the same piece."""

    def __init__(self, texts: pa.Array):
        raw, ends = byte_column(texts)
        data = _LOWER[raw]
        kind = _KIND[data]
        letter = kind == 0
        edge = np.zeros(len(data) + 1, bool)  # texts begin and end pieces
        edge[ends] = True
        before = np.zeros(len(data), bool)
        before[1:] = letter[:-1]
        begins = np.flatnonzero(letter & (edge[:-1] | ~before))
        piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int64)[begins]
        self.row = np.searchsorted(ends, begins, side="right") - 1
        self.joined = np.zeros(len(begins), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(letter, out=letters[1:])
        offsets = np.append(letters[begins], letters[-1])
        del piece, letters, kind, edge, before
        column = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
        coded = column.dictionary_encode()
        self.code, self.dictionary = coded.indices.to_numpy(), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word of the dictionary."""
        data, ends = byte_column(self.dictionary)
        view = memoryview(data)
        return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.uint64, len(self.dictionary))


class Grams:
    """The n-grams that begin at each word of a slice: where they go on, and their buckets."""

    def __init__(self, words: Words, lang: pa.Array, buckets: int):
        self.joined, self.shift = words.joined, np.uint64(64 - buckets.bit_length() + 1)
        known = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lang.dictionary.to_pylist()], np.uint64)
        spoken = lang.indices.to_numpy()[words.row]
        with np.errstate(over="ignore"):
            self.own = words.hashes()[words.code] * _ODD[0] + known[spoken] * _ODD[1] if len(words.code) else np.zeros(0, np.uint64)

    def bucket(self, at: np.ndarray, order: int) -> np.ndarray:
        """The bucket of the n-gram of so many words at each of the places `at`, which must be inside a piece."""
        with np.errstate(over="ignore"):
            mixed = self.own[at]
            for j in range(1, order):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[2] + self.own[at + j] * _ODD[3]
            return ((mixed ^ (mixed >> np.uint64(32))) * _ODD[0] >> self.shift).astype(np.int64)

    def pairs(self, bits: np.ndarray) -> np.ndarray:
        """For each word, whether it and the next are in one piece and in a heavy bucket."""
        out = np.zeros(len(self.own), bool)
        at = np.flatnonzero(self.joined)
        out[at] = _is_heavy(bits, self.bucket(at, 2))
        return out


def _sliced(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[Words, pa.DictionaryArray, Grams]]:
    for part in slices(batches, "text", SLICE):
        words, lang = Words(part.column("text")), part.column("lang").dictionary_encode()
        yield words, lang, Grams(words, lang, buckets)


def _counted(buckets: int, least: int, most: int, pairs: np.ndarray | None):
    """A task's counters, in chunks: of words and pairs; or, given the bits of pairs, of longer n-grams all of whose pairs are heavy."""
    kind = np.dtype(np.uint8 if least <= 255 else np.uint16 if least <= 65535 else np.uint32)

    def entries(words: Words, grams: Grams) -> Iterator[np.ndarray]:
        if pairs is None:
            yield grams.bucket(np.arange(len(words.code)), 1)
            yield grams.bucket(np.flatnonzero(words.joined), 2)
            return
        onward = grams.pairs(pairs)
        at = np.flatnonzero(onward)
        for order in range(3, most + 1):
            at = at[at + order - 2 < len(onward)]
            at = at[onward[at + order - 2]]
            yield grams.bucket(at, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_text = np.zeros(buckets, kind), False
        for words, _, grams in _sliced(batches, buckets):
            for some in entries(words, grams):
                found, n = np.unique(some, return_counts=True)
                counts[found] = np.minimum(counts[found].astype(np.int64) + n, least)
                any_text |= len(found) > 0
        if any_text:
            pack = zstandard.ZstdCompressor(level=1).compress
            for chunk in range(buckets // CHUNK):
                part = counts[chunk * CHUNK : (chunk + 1) * CHUNK]
                if part.any():
                    yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=["chunk", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come sorted, so one is held at a time; of each, one bit a bucket is left."""
        here, total = -1, None

        def bits() -> pa.RecordBatch:
            return pa.record_batch([pa.array([here], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["chunk", "data"])

        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if chunk != here:
                    if total is not None:
                        yield bits()
                    here, total = chunk, np.zeros(CHUNK, np.int64)
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
        if total is not None:
            yield bits()

    return run, summed


def frequent_buckets(texts: DataFrame, least: int, buckets: int, most: int = 2, pairs: np.ndarray | None = None) -> np.ndarray:
    """One bit a bucket, in bytes of eight: whether the n-grams that fall there occur `least` times together."""
    run, summed = _counted(buckets, least, most, pairs)
    chunks = texts.mapInArrow(run, "chunk int, data binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "chunk int, data binary")
    bits = np.zeros(buckets // 8, np.uint8)
    for r in chunks.collect():  # BUCKETS / CHUNK rows of CHUNK / 8 bytes at most
        bits[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["data"], np.uint8)
    return bits


def _is_heavy(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 > 0


def _windows(short: np.ndarray, long: np.ndarray, buckets: int, most: int):
    """Rows of lang, w1 ... and n: windows padded with empty words. Single words are summed for each slice; longer windows are sent as they come."""
    names = ["lang", *(f"w{j}" for j in range(1, most + 1)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, grams in _sliced(batches, buckets):
            if not len(words.code):
                continue
            padding = len(words.dictionary)
            dictionary = pa.concat_arrays([words.dictionary, pa.array([""], pa.large_string())]).cast(pa.string())
            every = np.arange(len(words.code))
            code = np.where(_is_heavy(short, grams.bucket(every, 1)), words.code, padding)
            onward = grams.pairs(short)
            spoken = lang.indices.to_numpy()[words.row].astype(np.int64)
            alone, counts = np.unique(spoken[~onward] * (padding + 1) + code[~onward], return_counts=True)
            columns = [(alone // (padding + 1), [alone % (padding + 1), *[np.full(len(alone), padding)] * (most - 1)], counts)]
            at = np.flatnonzero(onward)
            window = [code[at], code[at + 1]]
            goes = np.arange(len(at))  # of the windows, those that reach this length
            for order in range(3, most + 1):
                goes = goes[at[goes] + order - 2 < len(onward)]
                goes = goes[onward[at[goes] + order - 2]]
                goes = goes[_is_heavy(long, grams.bucket(at[goes], order))]
                window.append(np.full(len(at), padding))
                window[-1][goes] = code[at[goes] + order - 1]
            columns.append((spoken[at], window[:most], np.ones(len(at), np.int64)))
            for tongue, lead, n in columns:
                for a in range(0, len(n), 65536):
                    take = [dictionary.take(pa.array(c[a : a + 65536])) for c in lead]
                    yield pa.record_batch([lang.dictionary.take(pa.array(tongue[a : a + 65536])), *take, pa.array(n[a : a + 65536])], names=names)

    return run


def phrase_counts(docs: DataFrame, least: int, most: int = 5, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """lang, words (array), f: every phrase of 1 to `most` words with f >= least; and a row of no words, whose f counts all words of lang. A written table."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = frequent_buckets(texts, least, buckets)
    long = frequent_buckets(texts, least, buckets, most, short)
    lead = [f"w{j}" for j in range(1, most + 1)]
    schema = f"lang string, {', '.join(f'{w} string' for w in lead)}, n long"
    top = texts.mapInArrow(_windows(short, long, buckets, most), schema).groupBy("lang", *lead).agg(F.sum("n").alias("n"))
    sums = top.rollup("lang", *lead).agg(F.sum("n").alias("f")).where(F.col("lang").isNotNull() & ((F.col("f") >= least) | F.col("w1").isNull()))
    held = F.filter(F.array(*lead), lambda w: w.isNotNull())
    # a prefix that holds padding is no phrase of its length; the row of lang alone has no words
    return written(sums.select("lang", held.alias("words"), "f").where(~F.array_contains("words", "")), "phrases")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = 100, most: int = 5, share: int = 100, factor: int = 1000, first: int = 2000, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `first` phrases of 2 to `most` words of each lang.

    score is the smallest floor(factor * a * n / (l * r)) of the cuts; dropped are phrases inside a longer candidate with 100 * f(longer) >= share * a.
    """
    with scratch(docs.sparkSession):
        return _collocations(phrase_counts(docs, least, most, text_col, lang_col, buckets), most, share, factor, first)


def _collocations(counts: DataFrame, most: int, share: int, factor: int, first: int) -> DataFrame:
    totals = counts.where(F.size("words") == 0).select(F.col("lang").alias("of"), F.col("f").alias("n"))
    parts = counts.where(F.size("words") > 0).select("lang", _phrase(F.col("words")).alias("part"), "f")
    known = counts.where(F.size("words") >= 2).select("lang", "words", _phrase(F.col("words")).alias("phrase"), F.col("f").alias("a"))

    places = F.sequence(F.lit(1), F.size("words") - 1)
    cuts = known.select("lang", "phrase", "words", "a", F.explode(places).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _phrase(F.slice("words", F.lit(1), F.col("k"))).alias("left"), _phrase(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("right"))
    lefts, rights = (parts.select(F.col("lang").alias(f"{x}_lang"), F.col("part").alias(f"{x}_part"), F.col("f").alias(x)) for x in ("l", "r"))
    cuts = cuts.join(lefts.hint("merge"), (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_part"))).join(rights.hint("merge"), (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_part")))
    cuts = cuts.join(totals.hint("merge"), F.col("lang") == F.col("of"))
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", (whole("a", 15) * whole("n", 15) * F.lit(factor).cast("decimal(8,0)")).alias("above"), (whole("l", 19) * whole("r", 19)).alias("below"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r", "n")).alias("cut"))

    # every phrase that is inside a candidate, by one word less at a time; for a share below 100 every length must be looked at
    inner = F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))
    if share < 100:
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.slice("words", at, size))))
        inner = spans
    inside = known.where(F.size("words") > 2).select("lang", F.explode(inner).alias("short"), "a")
    inside = inside.groupBy(F.col("lang").alias("in_lang"), _phrase(F.col("short")).alias("in_phrase")).agg(F.max("a").alias("longest"))
    covered = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")) & (whole("longest", 19) * 100 >= whole("a", 19) * share)
    left = lowest.join(inside.hint("merge"), covered, "left_anti")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    ranked = rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= first)
    return written(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def oracle(least: int = 100, most: int = 5, share: int = 100, factor: int = 1000, first: int = 2000) -> str:
    """The same in SQL, by n-grams of every length."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), texts AS (
  SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM texts GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts CROSS JOIN range(1, {most + 1}) AS r(k))
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}
), known AS (
  SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n, ({factor} * c.a * t.n) // (x.f * y.f) AS score
  FROM (SELECT lang, phrase, size, w, a, unnest(range(1, size)) AS cut FROM known) AS c
  JOIN counts AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.cut], ' ')
  JOIN counts AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
  JOIN totals AS t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM known AS s JOIN known AS b
  ON b.lang = s.lang AND b.size > s.size AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= {share} * s.a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
  FROM lowest ANTI JOIN covered USING (lang, phrase)) WHERE rank <= {first}
"""
