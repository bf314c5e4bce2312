"""Operator 10, a quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a good and a bad document) say which of two documents is better; the chance of that is the logistic
function of the difference of their scores, which are linear in a text's features: surface measures and hashed n-grams of words
and bytes. All pairs of all labelled documents count. The cut between good and bad is the exact
quantile of all labelled documents' scores at their share of bad ones.

A fit is a sequence of passes over the features, a table: what blocks of rows give is added up, one small array for each task.
A document's part in the gradient depends on the distribution of the other label's scores alone, so the pairs are never formed.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, eq
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrysift.llm._common import Scratch, bounded_batches, text_of
from quarrysift.session import spread

_SYMBOLS, _UPPER, _DIGITS, _ENDS = b"#*$%&<>", bytes(range(65, 91)), b"0123456789", b".?:;"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: Hashed features of each kind: words, pairs of words, runs of three and of five bytes.
BUCKETS = 256
KINDS = 4
SURFACE = 12
SIZE = SURFACE + KINDS * BUCKETS
#: The features of so many rows at most (some 30 MB) are passed over on the driver, more by jobs; the steps are the same.
LOCAL_ROWS, BLOCK = 8192, 1024
#: So many tasks' arrays at most come to the driver or to one task that adds them up.
FAN_IN = 64
#: Chances of pairs are known at scores this far apart, and linear in between (off by less than 1e-5).
GRID = 1 / 64
#: A quantile is looked for in so many ranges at once, until one has so few rows.
RANGES = 4096


def surface(text: bytes, words: list[bytes]) -> list[float]:
    """Shares of symbols, separators, exclamation marks, upper case, digits, sentence ends, repeated words, and lengths."""
    n = len(words)
    share = lambda k: math.log1p(20 * k / (n + 5))
    without = lambda chars: len(text) - len(text.translate(None, chars))
    letters = without(_LETTERS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        share(without(_SYMBOLS)),
        share(text.count(b"|")),
        share(text.count(b"!")),
        without(_UPPER) / (letters + 20),
        share(without(_DIGITS)),
        share(without(_ENDS)),
        share(sum(map(eq, words, words[1:]))),
        share(sum(map(eq, words, words[2:]))),
        math.log((len(set(words)) + 5) / (n + 5)),
        share(len(lines) - len(set(lines))),
        math.log1p(n),
        math.log1p((len(text) - n) / (n + 1)),
    ]


def _counts(hashes: np.ndarray) -> np.ndarray:
    """Square roots of bucket counts, of length 1."""
    if not len(hashes):
        return np.zeros(BUCKETS)
    root = np.sqrt(np.bincount((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8), minlength=BUCKETS))
    return root / math.sqrt(len(hashes))


def features(text: bytes) -> np.ndarray:
    """The surface measures, then hashed words, pairs of neighbouring words, and runs of 3 and 5 bytes; all of the whole text."""
    words = text.split()
    own = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    run = lambda k: sum(data[i : len(data) - k + 1 + i] << np.uint64(8 * i) for i in range(k)) if len(data) >= k else data[:0]
    pairs = own[:-1] * np.uint64(1_000_003) + own[1:]
    return np.concatenate([surface(text, words), *map(_counts, (own, pairs, run(3), run(5)))])


@dataclass(frozen=True)
class Model:
    """A linear score of (features - mean) / scale; the weights already hold the scale."""

    weights: np.ndarray
    shift: float
    cut_score: float

    def score(self, x: np.ndarray) -> float:
        raw = float(x @ self.weights) - self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, raw + math.log(self.cut_score / (1 - self.cut_score))))))


def minimum(gradient: Callable[[np.ndarray], np.ndarray], curvature: np.ndarray, steps: int, least: float = 1e-5) -> np.ndarray:
    """Where a strictly convex function is least, from its gradient alone, by quasi-Newton steps (L-BFGS) from zero.

    curvature: about that of each coordinate. A step that goes too far, where the slope along it rises again, is shortened by
    secants. Ends when no coordinate of the gradient is above `least`, or after so many steps.
    """
    w = np.zeros(len(curvature))
    g, past = gradient(w), []
    for _ in range(steps):
        if np.abs(g).max() <= least:
            break
        step, parts = -g, []
        for moved, change in reversed(past):
            parts.append(moved @ step / (moved @ change))
            step = step - parts[-1] * change
        step = step / curvature * (past[-1][0] @ past[-1][1] / (past[-1][1] @ (past[-1][1] / curvature)) if past else 1.0)
        for (moved, change), part in zip(past, reversed(parts)):
            step = step + (part - change @ step / (moved @ change)) * moved
        slope, rate = g @ step, 1.0
        for _ in range(20):
            ahead = gradient(w + rate * step)
            end = ahead @ step
            if end <= -0.9 * slope:
                break
            rate *= slope / (slope - end)
        if (ahead - g) @ step > 0:
            past = [*past[-49:], (rate * step, ahead - g)]
        w, g = w + rate * step, ahead
    return w


def preference_weights(z: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float, steps: int = 200) -> np.ndarray:
    """w that minimises the mean of log(1 + exp(-(z[good] - z[bad]) w)) + ridge / 2 * w w, for given pairs in memory.

    A pair's gradient is that of its two documents' scores, so the differences themselves are never formed.
    """

    def gradient(w: np.ndarray) -> np.ndarray:
        s = z @ w
        p = 1 / (1 + np.exp(np.clip(s[good] - s[bad], -30, 30))) / len(good)
        return (np.bincount(bad, p, len(z)) - np.bincount(good, p, len(z))) @ z + ridge * w

    return minimum(gradient, z.var(axis=0) / 2 + ridge, steps)


# ---- passes over all labelled rows --------------------------------------------------------------------------------------


class Rows:
    """The labels and features of all rows, in blocks: over(f, add) adds up f(labels, features) of all blocks."""

    def __init__(self, table: DataFrame):
        self.table, self.blocks = table, None
        if table.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS:
            rows = sorted(table.collect(), key=lambda r: (r["id"] or "", r["label"], r["text"]))  # in an order that doesn't depend on the tasks
            parts = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            self.blocks = [(np.array([r["label"] for r in part]), np.frombuffer(b"".join(r["x"] for r in part), np.float32).reshape(-1, SIZE)) for part in parts]

    def over(self, f: Callable[[np.ndarray, np.ndarray], Any], add: Callable[[Any, Any], Any] = add) -> Any:
        """None without rows."""
        if self.blocks is not None:
            return reduce(add, (f(y, x.astype(float)) for y, x in self.blocks)) if self.blocks else None

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                labels, values = b.column("label").to_numpy(), b.column("x")
                _, starts, data = values.buffers()
                first = int(np.frombuffer(starts, np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset]) if len(values) else 0
                x = np.frombuffer(data, np.float32, len(values) * SIZE, first).reshape(-1, SIZE) if len(values) else np.zeros((0, SIZE))
                for i in range(0, len(x), BLOCK):
                    part = f(labels[i : i + BLOCK], x[i : i + BLOCK].astype(float))
                    total = part if total is None else add(total, part)
            yield from _sent(total)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for part in map(pickle.loads, b.column("part").to_pylist()):
                    total = part if total is None else add(total, part)
            yield from _sent(total)

        parts, tasks = self.table.select("label", "x").mapInArrow(measure, "part binary"), self.table.rdd.getNumPartitions()
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            parts = parts.repartition(tasks).mapInArrow(join, "part binary")
        found = [pickle.loads(r["part"]) for r in parts.collect()]
        return reduce(add, found) if found else None


def _sent(total: Any) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])


def placed(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last point of the grid that isn't above each score, and how far to the next one the score is."""
    at = np.floor(s / GRID)
    return at.astype(np.int64), s / GRID - at


def spectrum(y: np.ndarray, s: np.ndarray) -> tuple[int, np.ndarray]:
    """The first point of the grid and the scores of bad (row 0) and good documents (row 1) dealt to their two points."""
    at, part = placed(s)
    first = int(at.min())
    at, size = at - first, int(at.max()) - first + 2
    return first, np.stack([np.bincount(at[y == k], 1 - part[y == k], size) + np.bincount(at[y == k] + 1, part[y == k], size) for k in (0, 1)])


def joined(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    first = min(a[0], b[0])
    both = np.zeros((2, max(a[0] + a[1].shape[1], b[0] + b[1].shape[1]) - first))
    for start, counts in (a, b):
        both[:, start - first : start - first + counts.shape[1]] += counts
    return first, both


def lost_pairs(counts: np.ndarray) -> np.ndarray:
    """For a bad (row 0) and a good document (row 1) at each point: the chance to win (lose) against those of the other label,
    summed over them, by the convolution of their scores with the logistic function."""
    n = counts.shape[1]
    kernel = 1 / (1 + np.exp(-np.clip(np.arange(1 - n, n) * GRID, -700, 700)))
    size = 1 << (3 * n).bit_length()
    won = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[:, n - 1 : 2 * n - 1]
    return np.stack([won[1], counts[0].sum() - won[0]])


def all_pairs_weights(rows: Rows, mean: np.ndarray, scale: np.ndarray, curvature: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """preference_weights of z = (features - mean) / scale for each pair of a good and a bad row; two passes for a gradient."""

    def gradient(w: np.ndarray) -> np.ndarray:
        own, base = w / scale, float(mean @ (w / scale))
        first, counts = rows.over(lambda y, x: spectrum(y, x @ own - base), joined)
        pulls = lost_pairs(counts) / counts[0].sum() / counts[1].sum() * np.array([[1.0], [-1.0]])

        def pull(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            at, part = placed(x @ own - base)
            # A score that is rounded otherwise than before can be one point off.
            at = np.clip(at - first, 0, pulls.shape[1] - 2)
            p = pulls[y, at] * (1 - part) + pulls[y, at + 1] * part
            return np.append(p @ x, p.sum())

        total = rows.over(pull)
        return (total[:-1] - mean * total[-1]) / scale + ridge * w

    return minimum(gradient, curvature, steps)


def quantile(rows: Rows, weights: np.ndarray, base: float, share: float, n: int) -> float:
    """numpy's quantile of all n scores (features @ weights - base), exactly: ranges are counted and parted until one has few rows."""
    place = share * (n - 1)
    k = int(place)
    ends = rows.over(lambda y, x: np.array([-(x @ weights).min(), (x @ weights).max()]), np.maximum)
    edges = np.unique(np.linspace(-ends[0] - base, ends[1] - base, RANGES + 1))
    while True:
        counts = rows.over(lambda y, x: np.bincount(np.searchsorted(edges, x @ weights - base, "right"), minlength=len(edges) + 1))  # noqa: B023
        upto = np.cumsum(counts)
        j = max(1, int(np.searchsorted(upto, k, "right")))
        low, high = edges[j - 1], edges[j] if j < len(edges) else np.inf
        if counts[j] <= RANGES or high == np.inf or np.nextafter(low, np.inf) >= high:
            break
        edges = np.unique(np.linspace(low, high, RANGES + 1))

    def values(y: np.ndarray, x: np.ndarray) -> tuple[dict[float, int], float]:
        s = x @ weights - base
        found, times = np.unique(s[(s >= low) & (s < high)], return_counts=True)
        return dict(zip(found.tolist(), times.tolist())), float(s[s >= high].min(initial=np.inf))

    def both(a: tuple[dict[float, int], float], b: tuple[dict[float, int], float]) -> tuple[dict[float, int], float]:
        return {v: a[0].get(v, 0) + b[0].get(v, 0) for v in a[0].keys() | b[0].keys()}, min(a[1], b[1])

    times, after = rows.over(values, both)
    found = sorted(times)
    ordered = np.cumsum([times[v] for v in found])
    at = lambda i: (*found, after)[int(np.searchsorted(ordered, i - int(upto[j - 1]), "right"))]
    return at(k) if place == k else at(k) + (place - k) * (at(k + 1) - at(k))


def train(labelled: DataFrame, ridge: float = 1e-3, cut_score: float = 0.3, steps: int = 100, owner: Scratch | None = None) -> Model:
    """The model from all (id, label, text) rows with ids of any type (labelled_sample). Without both labels all scores are
    cut_score.

    Surface measures are brought to one spread each; hashed ones are only centred, so that rare buckets stay small. The features
    are written once, some 4 KB a row, and gone after the fit.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), BLOCK):
                own = b.slice(i, BLOCK)
                x = [features(t).astype(np.float32).tobytes() for t in texts[i : i + BLOCK]]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), pa.array(map(zlib.crc32, texts[i : i + BLOCK]), pa.int64()), pa.array(x, pa.binary())], names=["id", "label", "text", "x"])

    bounded_batches(labelled.sparkSession)
    scratch = Scratch(labelled.sparkSession, owner)
    rows = Rows(scratch.keep(labelled.select(F.col("id").cast("string").alias("id"), "label", "text").mapInArrow(measure, "id string, label int, text long, x binary"), "features"))
    sums = rows.over(lambda y, x: np.stack([np.append(x.sum(axis=0), [len(y), y.sum()]), np.append((x * x).sum(axis=0), [0, 0])]))
    model = Model(np.zeros(SIZE), 0.0, cut_score)
    if sums is not None and 0 < sums[0, -1] < sums[0, -2]:
        n, good = int(sums[0, -2]), int(sums[0, -1])
        mean, scale = sums[0, :-2] / n, np.ones(SIZE)
        variance = np.maximum(sums[1, :-2] / n - mean**2, 0.0)
        scale[:SURFACE] = np.maximum(np.sqrt(variance[:SURFACE]), 1e-6)
        own = all_pairs_weights(rows, mean, scale, variance / scale**2 / 2 + ridge, ridge, steps) / scale
        base = float(mean @ own)
        model = Model(own, base + quantile(rows, own, base, (n - good) / n, n), cut_score)
    if owner is None:
        scratch.close()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1; cut_score at the cut) of each whole text.

    Ids can be of any type. Null counts as empty, which is scored too. Rows are independent: repeated rows and null ids are scored
    one by one. Extra columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(features(t)) for t in b.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), text_of(text_col).cast("binary").alias("text"))).mapInArrow(run, f"`{id_col}` {kind}, score double")
