"""Operator 1, best-fit packing, in bulk-synchronous rounds.

Pieces go from the longest lengths to the shortest ones, in phases of lengths that differ by a tenth at most. In a round of a phase
all its pieces propose at once to their successor gap (the smallest open one that holds them); where several propose to one
gap, the longest one, then the first in rank, wins and fills it with as many of its kind as fit; gaps are updated, and
the others propose again. Pieces without a successor open sequences. A phase ends when all its pieces have a place.

Best fit asks for sizes alone, of which there are at most `capacity`, so both tables are kept as runs: so many pieces of one
length, so many sequences in a row with one gap. Their rounds run on the driver, over the histogram of lengths. All work on
pieces is distributed: lengths are counted with map-side combining, pieces are range-sorted within their length by a hash key and
ranked by distributed prefix sums, and each finds the match that covers its rank by a successor search.

A bound of the matches, for D lengths: a match that ends before its pieces do takes a whole run of gaps and leaves one run. A match
that ends with its pieces leaves three runs at most, which happens D times, and opening sequences two, D times. So at most 3 D runs
ever begin. A match takes a gap g to less than half of it (what is left of filling g with a length is less than that
length and than the part filled), so a run is matched log2(capacity) times at most. All matches: (3 log2(capacity) + 1) D at
most, for a capacity of 4096 some 150,000 of 48 bytes, whatever the number of pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrysift.operators.prefix import hash_key, range_sums, sums_before

#: Ranks of one length stay below this; lengths and ranks are searched as one number.
_RANKS = 2**46
#: Lengths of one phase differ by this factor at most. A factor of 1 is best-fit decreasing, length by length.
PHASES = (1.1, 1.0)


class Gaps:
    """The gap table: runs (first sequence, how many) of open sequences by their gap, and the gaps in order."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.sizes, gap)
            self.runs[gap].append((first, n))

    def successor(self, length: int) -> int | None:
        at = bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, gap: int) -> list[tuple[int, int]]:
        self.sizes.pop(bisect_left(self.sizes, gap))
        return self.runs.pop(gap)


def match_rounds(histogram: dict[int, int], capacity: int, factor: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Matches (length, first rank, first sequence, offset, how many fit a sequence) and the number of sequences.

    From its first rank on, up to the next match of its length, a match fills sequence after sequence.
    """
    left, placed = dict(histogram), dict.fromkeys(histogram, 0)
    gaps, out, opened = Gaps(), [], 0

    def match(length: int, gap: int, first: int, n: int) -> int:
        """Fills sequences of one run with pieces of one length; how many were used. What is left of them are new gaps."""
        per = gap // length
        used = min(n, -(-left[length] // per))
        took = min(left[length], used * per)
        last = took - (used - 1) * per
        out.append((length, placed[length], first, capacity - gap, per))
        left[length] -= took
        placed[length] += took
        whole = used if last == per else used - 1
        updates.append((gap - per * length, first, whole))
        updates.append((gap - last * length, first + whole, used - whole))
        return used

    remaining = sorted(histogram)
    while remaining:
        low = bisect_left(remaining, remaining[-1] / factor)
        phase, remaining = remaining[low:][::-1], remaining[:low]  # the longest first
        while phase:
            proposals, updates = defaultdict(list), []
            for length in phase:
                proposals[gaps.successor(length)].append(length)
            for gap, lengths in proposals.items():
                if gap is None:  # no successor: new sequences
                    for length in lengths:
                        opened += match(length, capacity, opened, left[length])
                    continue
                runs = gaps.take(gap)
                for length in lengths:  # conflicts are resolved by rank: all pieces of the longest length come first
                    while left[length] and runs:
                        first, n = runs.pop()
                        used = match(length, gap, first, n)
                        if used < n:
                            runs.append((first + used, n - used))
                updates.extend((gap, first, n) for first, n in runs)
            for update in updates:
                gaps.put(*update)
            phase = [length for length in phase if left[length]]
    return out, opened


def best_fit_pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: a place in a sequence of at most capacity tokens, gapless from 0.

    Lengths are from 1 to capacity; others raise an error, null lengths too. pieces is read twice, so it should be a written
    table. Columns of pieces named sequence_id or offset are replaced; all others stay, whatever their names. Repeated rows are
    placed one by one, null keys like any other; an empty table stays empty. Never more sequences than best-fit decreasing
    gives. Deterministic but for swaps of rows with equal key_cols and length.
    """
    counts = pieces.groupBy(F.col(length_col).cast("long").alias("n")).count()
    histogram = {r["n"]: r["count"] for r in counts.limit(capacity + 2).collect()}  # a row for each length, capacity at most
    if bad := [n for n in histogram if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    found, _ = min((match_rounds(histogram, capacity, f) for f in PHASES), key=lambda m: m[1])
    matches = np.array(found, dtype=np.int64).reshape(-1, 5)
    matches = matches[np.lexsort((matches[:, 1], matches[:, 0]))]
    sent = pieces.sparkSession.sparkContext.broadcast((matches, matches[:, 0] * _RANKS + matches[:, 1]))  # bounded, see above

    row, group, key, one, rank = "__row", "__length", "__key", "__one", "__rank"
    rows = pieces.select(F.struct("*").alias(row), F.col(length_col).cast("long").alias(group), hash_key(*[F.col(c) for c in key_cols]).alias(key), F.lit(1).cast("long").alias(one))
    ranked = sums_before(rows, range_sums(rows, group, key, one), group, key, one, [], rank).select(row, group, rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, starts = sent.value
        for batch in batches:
            length, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            m = matches[np.searchsorted(starts, length * _RANKS + r, side="right") - 1] if len(length) else matches[:0]
            nth, in_it = np.divmod(r - m[:, 1], m[:, 4])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m[:, 2] + nth), pa.array(m[:, 3] + in_it * length)], names=[row, "sequence_id", "offset"])

    schema = T.StructType([T.StructField(row, rows.schema[row].dataType), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    own = [F.col(row)[c].alias(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return ranked.mapInArrow(place, schema).select(*own, "sequence_id", "offset")
