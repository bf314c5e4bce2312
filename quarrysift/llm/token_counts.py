"""Operator 5, token counts by offset-mapped attribution.

A text is encoded once, whole. The tokens' byte lengths give their spans, which are joined to the sections' spans by binary
search on both sorted sides. A token that crosses a boundary is allocated by a rule: `first` (to the section of its first
character), `last` (of its last character) or `share` (to each in proportion to its bytes there).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrysift.llm._common import bounded_batches, text_of
from quarrysift.session import spread

RULES = ("first", "last", "share")


class OffsetEncoder:
    """A byte-level BPE whose tokens, one after another, are the bytes of the text."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section [start, stop), in bytes, and how many tokens cross one of its bounds.

    Sections may overlap, nest or leave gaps; each is counted for itself.
    """
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    # A bound is crossed if it lies inside a token.
    inside = lambda at: (np.searchsorted(ends, at, "right") < np.searchsorted(begins, at, "left")).astype(np.int64)
    crossing = inside(starts) + inside(stops)
    if rule == "share":
        at = np.concatenate([[0], ends])
        upto = np.interp(np.concatenate([starts, stops]), at, np.arange(len(at), dtype=float))
        return upto[len(starts) :] - upto[: len(starts)], crossing
    anchor = begins if rule == "first" else ends - 1
    return (np.searchsorted(anchor, stops, "left") - np.searchsorted(anchor, starts, "left")).astype(float), crossing


def joined_fields(columns: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """Several fields as one text, and their spans as sections of it, in order; a null field is empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    spans, at = [], F.lit(0)
    for t in texts:
        spans.append(F.struct(at.alias("start"), (at + F.length(t)).alias("end")))
        at = at + F.length(t) + len(separator)
    return F.concat_ws(separator, *texts), F.array(*spans)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", sections: Column | None = None, id_col: str = "doc_id", text_col: str = "text", outside: bool = False) -> DataFrame:
    """One row for each section of each document: id_col, section (from 0), char_start, char_end, n_tokens, n_crossing.

    sections: an array of (start, end) in characters of the text, clipped to it; by default the lines, each without its
    \\n: a token (or share of one) whose place by the rule is a \\n lies in no line. With outside, each document has one more
    row for these, section -1 over the whole text, so that its counts add up. Empty sections have no tokens. A null text counts
    as empty: one empty line, 0 tokens; a null array gives no rows. Repeated rows are counted one by one; extra columns are
    ignored.
    """
    if outside and sections is not None:
        raise ValueError("outside is for the default lines, which don't overlap")
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    bounded_batches(docs.sparkSession)
    given = sections is not None
    spans = sections.cast("array<struct<start:bigint,end:bigint>>") if given else F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    rows = spread(docs.select(F.col(id_col), text_of(text_col).alias("text"), spans.alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder(ranks_path, pattern)
        for b in batches:
            index, section, first, last, tokens, crossing = ([] for _ in range(6))
            for row, (text, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if given and own is None:
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the byte where each character starts
                if given:
                    chars = np.array([(s["start"] or 0, s["end"] or 0) for s in own], np.int64).reshape(-1, 2).clip(0, len(at) - 1)
                    starts, stops = at[chars[:, 0]], at[np.maximum(chars[:, 0], chars[:, 1])]
                else:
                    breaks = np.flatnonzero(data == 10)
                    starts, stops = np.concatenate([[0], breaks + 1]), np.append(breaks, len(data))
                ends = encoder.ends(text)
                n, cross = attribute(ends, starts, stops, rule)
                k, numbers = len(starts), np.arange(len(starts))
                if outside:
                    k, numbers, starts, stops = k + 1, np.append(numbers, -1), np.append(starts, 0), np.append(stops, len(data))
                    n, cross = np.append(n, len(ends) - n.sum()), np.append(cross, 0)
                index.append(np.full(k, row))
                section.append(numbers)
                first.append(np.searchsorted(at, starts))
                last.append(np.searchsorted(at, stops))
                tokens.append(n)
                crossing.append(cross)
            flat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([b.column(0).take(flat(index, np.int64)), flat(section, np.int32), flat(first, np.int64), flat(last, np.int64), flat(tokens, float), flat(crossing, np.int64)], names=[id_col, "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, section int, char_start long, char_end long, n_tokens double, n_crossing long")
