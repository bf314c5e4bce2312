"""Operator 7, toxicity by maximum-scoring segments.

A unit is a word or a beginning of words. Its score is its log-odds between toxic and other documents, under an informative
Dirichlet prior (the units' overall frequency). Units whose log-odds are significantly positive are the lexicon, and a word
scores as its most significant unit; any other word has the small negative score that makes the scores of both together a
log-likelihood ratio. All maximal-scoring segments of a text are found in one
linear scan. As the scores are log-odds, a random text's best segment follows an extreme-value distribution with scale 1:
n * K * exp(-S) segments of score S or more are expected by chance, K being fitted to the clean documents. A document's
evidence is the summed excess of its significant segments over what chance gives, or else of its best one; a logistic
fit turns it into a probability.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrysift.llm._common import Scratch, bounded_batches, text_of
from quarrysift.session import spread

#: ASCII letters in lower case, all other ASCII but digits as spaces; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


#: How often a unit of one text counts at most, in training alone: there no single text makes a unit significant.
MOST_IN_TEXT = 3
#: Beginnings of words that are units of their own, in characters.
BEGINNINGS = range(4, 9)


def units(word: bytes) -> list[bytes]:
    """What a word is known by: itself and its beginnings, cut between characters; those end in - and can't be words."""
    if word.isascii():
        return [word, *(word[:k] + b"-" for k in BEGINNINGS if len(word) > k)]
    text = word.decode(errors="replace")
    return [word, *(text[:k].encode() + b"-" for k in BEGINNINGS if len(text) > k)]


@dataclass(frozen=True)
class Model:
    lexicon: dict[bytes, tuple[float, float]]  # unit: (significance, log-odds)
    other: float
    k: float
    slope: float
    intercept: float


def maximal_segments(hits: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, past the last, score) of n words: hits (place, score > 0), all others `other` < 0.

    Linear time: candidates are kept with the sums before and after them; each is merged with the nearest earlier one that
    starts lower, and the search goes on from there.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, at = 0.0, 0
    for place, score in hits:
        total += other * (place - at)
        start, end, low = place, place + 1, total
        total += score
        at, high = place + 1, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


class Scores(dict):
    """Word scores, remembered up to a bound: that of the word's most significant unit in the lexicon, or 0."""

    def __init__(self, lexicon: dict[bytes, tuple[float, float]]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        found = [self.lexicon[u] for u in units(word) if u in self.lexicon]
        score = self[word] = max(found)[1] if found else 0.0
        return score


class Scanner:
    def __init__(self, model: Model):
        self.model, self.scores = model, Scores(model.lexicon)

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Places and scores of all words that have one, however often they occur."""
        return [(i, score) for i, score in enumerate(map(self.scores.__getitem__, words)) if score]

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        return maximal_segments(self.hits(words), len(words), self.model.other)

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        """The evidence and the significant segments (those that chance gives less than once in such a text)."""
        segments = self.segments(words)
        level = chance(len(words), self.model.k)
        return evidence([s[2] for s in segments], level), [s for s in segments if s[2] > level]


def chance(n: int, k: float) -> float:
    """The score that one segment of a text of n words reaches by chance. Short texts aren't rare by being short."""
    return math.log(max(n * k, 1.0))


def evidence(scores: list[float], level: float) -> float:
    """The summed excess of the significant segments, or else what the best one lacks; about its logarithm where it is large,
    so that long texts don't set the slope."""
    over = [s - level for s in scores if s > level]
    return math.asinh(sum(over) if over else max(scores, default=0.0) - level)


def without_near_copies(sample: DataFrame, keys: int = 5, width: int = 2, least: float = 0.8) -> DataFrame:
    """(id, label, text) rows without those that are near copies of a row with a smaller id (as text) and the same label.

    Near copies have word sets with a Jaccard similarity of `least` or more. Rows are compared where they agree in a key of
    `width` MinHash values of their longer words, as near copies almost surely do in one of the keys.
    """
    seeds = [hashlib.blake2b(f"key {i}".encode(), digest_size=8).digest() for i in range(keys * width)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                own = set(fold(text))
                words = {w for w in own if len(w) > 5} or own or {b""}
                h = np.array([zlib.crc32(w) for w in words], np.uint64)
                lows = [int(((h * np.uint64(int.from_bytes(s, "little") | 1)) >> np.uint64(16)).min()) for s in seeds]
                out.append([f"{i} {lows[i : i + width]}" for i in range(0, len(lows), width)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], names=["id", "label", "text", "keys"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stay = None, []
        for b in batches:
            gone = []
            for i, label, text, key in zip(*(c.to_pylist() for c in b.columns)):
                if (label, key) != group:
                    group, stay = (label, key), []
                words = set(fold(text))
                near = lambda other: len(words & other) >= least * len(words | other)
                if any(j != i and near(other) for j, other in stay):
                    gone.append(i)
                else:
                    stay.append((i, words))
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], names=["id"])

    sample = sample.select(F.col("id").cast("string").alias("id"), "label", "text")
    keyed = sample.mapInArrow(sketch, "id string, label int, text binary, keys array<string>").select("id", "label", "text", F.explode("keys").alias("key"))
    gone = keyed.repartition("label", "key").sortWithinPartitions("label", "key", "id").mapInArrow(copies, "id string").distinct()
    return sample.join(F.broadcast(gone), "id", "left_anti")  # ids of a bounded sample


def counted_units(texts: DataFrame) -> DataFrame:
    """unit, y1, y0 (how often it occurs in texts of either label, MOST_IN_TEXT times a text at most), t1 (toxic texts that have it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch is bounded in bytes, so its counts are too
            seen: dict[int, tuple[Counter, Counter]] = {0: (Counter(), Counter()), 1: (Counter(), Counter())}
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                own: Counter = Counter()
                for word, n in Counter(fold(text)).items():
                    for u in units(word):
                        own[u] += n
                times, in_texts = seen[label]
                times.update({u: min(n, MOST_IN_TEXT) for u, n in own.items()})
                in_texts.update(own.keys())
            for label, (times, in_texts) in seen.items():
                if times:
                    yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.binary()), pa.array([label] * len(times), pa.int32()), pa.array(list(times.values()), pa.int64()), pa.array([in_texts[u] for u in times], pa.int64())], names=["unit", "label", "n", "texts"])

    of = lambda label, c: F.sum(F.when(F.col("label") == label, F.col(c)).otherwise(0))
    return texts.select("label", "text").mapInArrow(count, "unit binary, label int, n long, texts long").groupBy("unit").agg(of(1, "n").alias("y1"), of(0, "n").alias("y0"), of(1, "texts").alias("t1"))


def log_odds(counted: DataFrame, prior: float) -> DataFrame:
    """counted with d, the log-odds of each unit between toxic and other texts, and z, these in standard deviations.

    The Dirichlet prior gives a unit `prior` pseudo-counts for each of its occurrences in both, and half a one more; totals are
    sums of the same counts and pseudo-counts over all units.
    """
    total = counted.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), F.sum(F.lit(prior) * (F.col("y1") + F.col("y0")) + 0.5).alias("a")).first()
    n1, n0, all_ = float(total["n1"] or 0), float(total["n0"] or 0), float(total["a"] or 0.0)
    a = F.lit(prior) * (F.col("y1") + F.col("y0")) + 0.5
    odds = lambda y, n: F.log((F.col(y) + a) / (F.lit(n + all_) - F.col(y) - a))
    return counted.withColumn("d", odds("y1", n1) - odds("y0", n0)).withColumn("z", F.col("d") / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a)))


def train(sample: DataFrame, prior: float = 0.02, least_z: float = 3.5, least_odds: float = 1.5, least_docs: int = 4, owner: Scratch | None = None) -> Model:
    """The model from (id, label, text) rows, a bounded sample with ids of any type (labelled_sample). Without both labels, or
    without words in one of them, all scores are near the share of toxic rows.

    Copies and near copies of one label count once, and a unit three times in a text at most, so that no single text makes a unit
    significant.
    """
    scratch = Scratch(sample.sparkSession, owner)
    rows = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    counted = scratch.keep(counted_units(without_near_copies(sample)), "units")
    found = log_odds(counted, prior).where((F.col("t1") >= least_docs) & (F.col("z") >= least_z) & (F.col("d") >= least_odds))
    lexicon = {bytes(r["unit"]): (r["z"], r["d"]) for r in found.select("unit", "z", "d").collect()}  # units of a bounded sample
    if len(rows) < 2 or not lexicon:
        return Model({}, -0.01, 1.0, 0.0, math.log((rows.get(1, 0) + 1e-9) / (rows.get(0, 0) + 1e-9)))

    # Each text's scored words, found once; what follows works on these.
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Model(lexicon, -0.01, 1.0, 1.0, 0.0))
        for b in batches:
            words = [fold(t) for t in b.column("text").to_pylist()]
            hits = [scanner.hits(w) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([len(w) for w in words], pa.int64()), pa.array([[i for i, _ in h] for h in hits], pa.list_(pa.int64())), pa.array([[s for _, s in h] for h in hits], pa.list_(pa.float64()))], names=["label", "n", "places", "scores"])

    hits = scratch.keep(sample.select("label", "text").mapInArrow(scan, "label int, n long, places array<long>, scores array<double>"), "hits")
    # The share of lexicon words in toxic texts gives the others' log-odds; with it, the scores are a likelihood ratio.
    share = hits.where("label = 1").agg(F.sum(F.size("places")).alias("hits"), F.sum("n").alias("n")).first()
    other = math.log1p(-min(0.5, (share["hits"] + 1) / (share["n"] + 2)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, places, scores = (b.column(c).to_pylist() for c in ("n", "places", "scores"))
            found = [[s for *_, s in maximal_segments(list(zip(p, x)), k, other)] for k, p, x in zip(n, places, scores)]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("n"), pa.array(found, pa.list_(pa.float64()))], names=["label", "n", "segments"])

    segments = scratch.keep(hits.mapInArrow(cut, "label int, n long, segments array<double>"), "segments")
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    clean = segments.where("label = 0 AND n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n") * F.exp(-best)).alias("mass")).first()
    k = max((clean["texts"] or 0) / max(clean["mass"] or 0.0, 1e-9), 1e-9)  # most likely for maxima of n scores

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [evidence(s, chance(n, k)) for n, s in zip(b.column("n").to_pylist(), b.column("segments").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.float64())], names=["label", "x"])

    fitted = segments.mapInArrow(weigh, "label int, x double").collect()  # two numbers for each row of a bounded sample
    slope, intercept = logistic(np.array([r["x"] for r in fitted]), np.array([r["label"] for r in fitted], float))
    if owner is None:
        scratch.close()
    return Model(lexicon, other, k, max(slope, 0.0), intercept)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a lightly penalised logistic fit, by Newton steps."""
    scale = max(float(np.std(x)), 1e-9)
    a, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-6])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([ridge, 0.0]) * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score and segments (first word, past the last, score of each significant passage) of each whole text.

    Ids can be of any type. Null and empty texts score as texts without a hit. A text is scored whole, in one task, in time
    linear in its length. Rows are independent: repeated rows and null ids are scored one by one. Extra columns are ignored;
    an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        scanner = Scanner(model)
        for b in batches:
            scores, segments = [], []
            for text in b.column(1).to_pylist():
                x, found = scanner.evidence(fold(text))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * x + model.intercept)))))
                segments.append([{"first": i, "end": j, "score": s} for i, j, s in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(segments, kind)], names=[id_col, "score", "segments"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), text_of(text_col).cast("binary").alias("text"))).mapInArrow(run, f"`{id_col}` {kind}, score double, segments array<struct<first:int,end:int,score:double>>")
