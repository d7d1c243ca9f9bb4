"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, undoes homoglyphs (Cyrillic and Greek look-alikes, full-width letters) and digit or sign substitutions inside
words, and drops zero-width characters. The lexicon is learned from labelled rows: whole words and word beginnings whose share among toxic rows is
far above that among clean rows. Exception phrases (a term with the word before or after it) are learned from clean rows that
hold a term. A text's score is a logistic function of its summed weight and of that sum per word, so that length is taken into account.

At most SAMPLE labelled rows are used for learning (those with the smallest hash of their id), and the model holds at most TERMS terms and
PHRASES exception phrases, those of largest evidence; these are parameters of `learn` (None: all terms and phrases that the sample gives) and bound what goes to the driver and to
each task. Everything else covers all rows.

Results for odd input: null text counts as empty and gets the score of a text without matches; without any labelled row, or
without toxic ones, the lexicon is empty and all scores are low; rows with the same id are scored each for itself; a null id counts as held out, and is scored; rows with null
labels are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import hashed_sample, slices, written

#: Most labelled rows that are used for learning.
SAMPLE = 20_000
#: Most terms that the lexicon is chosen from, and most exception phrases that it has: the size of the model.
TERMS, PHRASES = 5_000, 20_000
#: What a toxic row counts, for each term that it holds, in the choice of further terms.
EXPLAINED = 0.4

# Look-alikes of Latin letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ρ": "p", "ε": "e", "ı": "i"}
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_TABLE = str.maketrans({k: v for k, v in LOOKALIKES.items()} | {c: None for c in ZERO_WIDTH} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)})
_DIGITS = str.maketrans(SUBSTITUTES)
_SIGNS = set(SUBSTITUTES)


def folded(word: str) -> str:
    """One word, folded; a word without letters stays as it is."""
    word = word.lower().translate(_TABLE)
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    word = word.strip(".,;:!?\"'()[]{}*#&%<>-_/\\")
    if not word.isalpha() and any(c.isalpha() for c in word) and not _SIGNS.isdisjoint(word):
        word = word.translate(_DIGITS)
    return word


@dataclasses.dataclass
class Lexicon:
    """weights: term -> weight, where a term is " word " or, for a word beginning, " word"; exceptions: phrases " a b "."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    bias: float = -4.0
    by_sum: float = 2.0
    by_rate: float = 20.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        if len(found):
            found.make_automaton()
        return found


class Scorer:
    """A lexicon's automaton and the foldings of the words seen so far (bounded)."""

    MOST_WORDS = 200_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.matcher = lexicon, lexicon.automaton()
        self.words: dict[str, str] = {}

    def fold(self, words: list[str]) -> str:
        known = self.words
        if len(known) > self.MOST_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = folded(w)
        return "  ".join(map(known.__getitem__, words))

    def measure(self, text: str) -> tuple[float, int, int]:
        """Summed weight, matches and words. A match inside an exception phrase counts nothing; at one place the longest counts."""
        words = text.split()
        if not len(self.matcher) or not words:
            return 0.0, 0, len(words)
        line = f" {self.fold(words)} "
        spared: list[tuple[int, int]] = []
        at: dict[int, tuple[int, float]] = {}
        for end, (n, weight) in self.matcher.iter(line):
            start = end - n + 1
            if weight is None:
                spared.append((start, end))
            elif start not in at or at[start][0] < n:
                at[start] = (n, weight)
        hits = [w for s, (n, w) in at.items() if not any(a <= s and s + n - 1 <= b + 1 for a, b in spared)]
        return math.fsum(hits), len(hits), len(words)

    def score(self, text: str) -> tuple[float, int]:
        total, hits, words = self.measure(text)
        x = self.lexicon.bias + self.lexicon.by_sum * math.log1p(total) + self.lexicon.by_rate * total / (words + 20)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), hits


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, kind, clean, toxic): in how many clean rows each folded word and word beginning occurs, and in which toxic ones."""
    for batch in slices(batches, "text", 8_000_000):
        clean: dict[tuple[str, int], int] = {}
        toxic: dict[tuple[str, int], list[int]] = {}
        for row, text, bad in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "toxic")), strict=True):
            words = {folded(w) for w in (text or "").split()} - {""}
            starts = {w[:n] for w in words for n in range(4, 8) if len(w) > n}
            for kind, terms in enumerate((words, starts)):
                for t in terms:
                    if bad:
                        toxic.setdefault((t, kind), []).append(row)
                    else:
                        clean[t, kind] = clean.get((t, kind), 0) + 1
        keys = list(clean | toxic)
        yield pa.record_batch(
            [pa.array([t for t, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([clean.get(k, 0) for k in keys], pa.int64()), pa.array([toxic.get(k, []) for k in keys], pa.list_(pa.int64()))],
            names=["term", "kind", "clean", "toxic"],
        )


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most `most` labelled rows outside the held-out fifth; those with the smallest hash of their id."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).cast("int").alias(label))
    chosen = written(hashed_sample(rows, id_col, most), "labelled")  # a few bytes a row, `most` rows: a fixed bound for the broadcast
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "doc_id")), "doc_id")


def held_out(id_col: str):
    """Whether a row is in the held-out fifth: crc32 of its id as text, modulo 5, is 0. A null id counts as an empty text, and so as held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, terms: int | None = TERMS, phrases: int | None = PHRASES) -> Lexicon:
    """A lexicon from the labelled rows outside the held-out fifth.

    Rows that share the smallest hash of their long words (copies and near copies, mostly) count once, so that a word that is
    repeated by copying only is no evidence. A term's evidence is the log-likelihood ratio of its share of toxic rows against
    the overall share; it must be out of chance's reach for as many terms as there are. Terms are chosen greedily: a toxic row
    counts less for each chosen term that it holds already.
    """
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    long_words = F.filter(words, lambda w: F.length(w) > 8)
    least = F.array_min(F.transform(F.when(F.size(long_words) > 4, long_words).otherwise(words), lambda w: F.xxhash64(w)))
    sample = labelled(docs, labels, label, most, id_col, text_col).select(F.xxhash64("doc_id").alias("row"), "text", label, least.alias("least"))
    rows = written(sample.dropDuplicates(["least", label]).drop("least"), "sample")
    totals = {bool(r[label]): r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return Lexicon({})
    emitted = rows.select("row", "text", F.col(label).alias("toxic")).mapInArrow(_terms, "term string, kind int, clean long, toxic array<long>")
    summed = emitted.groupBy("term", "kind").agg(F.sum("clean").alias("clean"), F.flatten(F.collect_list("toxic")).alias("rows"))
    counts = written(summed.withColumn("toxic", F.size("rows")).where("clean + toxic >= 3"), "terms")
    base = toxic / (toxic + clean)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    columns = {
        "gain": F.log(share / base),
        "loss": F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0),
        "weight": F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1)),
    }
    chance = math.log(max(2, counts.where("toxic >= 3").count())) + 1
    evidence = F.col("toxic") * F.col("gain") + F.col("loss")
    strong = counts.where("toxic >= 3").withColumns(columns).where("weight >= 2.5").withColumn("evidence", evidence).where(F.col("evidence") >= chance)
    ranked = strong.orderBy(F.desc("evidence"), "kind", "term")
    found = (ranked if terms is None else ranked.limit(terms)).collect()
    first = Lexicon({f" {r['term']}" + " " * (1 - r["kind"]): r["weight"] for r in _chosen(found, chance)})
    return _calibrated(rows, label, dataclasses.replace(first, exceptions=_exceptions(rows, label, first, phrases)))


def _chosen(found: list, chance: float) -> list:
    """The terms that explain toxic rows which the terms before them leave unexplained.

    A word beginning is left out if one longer term holds nearly all of its rows: that term is the surer one.
    """
    covered: dict[str, int] = {}
    for r in found:
        for n in range(4, len(r["term"]) if r["kind"] else len(r["term"]) + 1):
            covered[r["term"][:n]] = max(covered.get(r["term"][:n], 0), r["toxic"])
    found = [r for r in found if not r["kind"] or covered.get(r["term"], 0) < 0.9 * r["toxic"]]
    place = {row: k for k, row in enumerate(dict.fromkeys(row for r in found for row in r["rows"]))}
    held = [np.array([place[row] for row in r["rows"]], np.int32) for r in found]
    everything, starts = (np.concatenate(held), np.r_[0, np.cumsum([len(h) for h in held])[:-1]]) if held else (np.zeros(0, np.int32), np.zeros(0, int))
    gain, loss = (np.array([r[c] for r in found], float) for c in ("gain", "loss"))
    open_rows, chosen = np.ones(len(place), np.float32), []
    while len(chosen) < len(found):
        left = np.add.reduceat(open_rows[everything], starts) * gain + loss
        left[chosen] = -np.inf
        k = int(left.argmax())
        if left[k] < chance:
            break
        chosen.append(k)
        open_rows[held[k]] *= EXPLAINED
    return [found[k] for k in chosen]


def _exceptions(rows: DataFrame, label: str, lexicon: Lexicon, phrases: int | None) -> frozenset[str]:
    """Phrases of a term and a neighbour that occur in clean rows and in no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.automaton()
        for batch in slices(batches, "text", 8_000_000):
            phrases, toxic = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column(label).to_pylist(), strict=True):
                words = [folded(w) for w in (text or "").split()]
                own = set()
                for k, w in enumerate(words):
                    if len(matcher) and any(s == 0 for s in (e - n + 1 for e, (n, _) in matcher.iter(f" {w} "))):
                        own |= {f" {'  '.join(words[a:b])} " for a, b in ((k - 1, k + 1), (k, k + 2)) if a >= 0 and b <= len(words)}
                phrases += own
                toxic += [y] * len(own)
            yield pa.record_batch([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())], names=["phrase", "toxic"])

    found = rows.mapInArrow(run, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).where("bad = 0 AND n >= 2")
    ranked = found.orderBy(F.desc("n"), "phrase")
    return frozenset(r["phrase"] for r in (ranked if phrases is None else ranked.limit(phrases)).collect())


def _calibrated(rows: DataFrame, label: str, lexicon: Lexicon) -> Lexicon:
    """The lexicon with the logistic coefficients fitted on the same bounded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches, "text", 8_000_000):
            seen = [scorer.measure(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([s[0] for s in seen], pa.float64()), pa.array([s[2] for s in seen], pa.int64()), batch.column(label)], names=["total", "words", "y"])

    seen = np.array([tuple(r) for r in rows.mapInArrow(run, "total double, words long, y int").collect()], float).reshape(-1, 3)
    x = np.c_[np.ones(len(seen)), np.log1p(seen[:, 0]), seen[:, 0] / (seen[:, 1] + 20)]
    y, beta, ridge = seen[:, 2], np.zeros(3), np.diag([1e-3, 1e-2, 1e-2]) * max(1, len(seen)) ** 0.5
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return dataclasses.replace(lexicon, bias=float(beta[0]), by_sum=float(beta[1]), by_rate=float(beta[2]))


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1) and the number of matches. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches, "text", 4_000_000):
            found = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], names=["id", "score", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, matches long").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score `threshold` or more; all columns stay, and there is no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches, text_col, 4_000_000):
            yield batch.filter(pa.array([scorer.score(t or "")[0] < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
