"""Tokenizing whole texts in Arrow batches, with a bounded cache of words."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrysift.llm._common import bounded_batches, text_of
from quarrysift.session import spread

#: Words, and pieces of words, that a worker remembers in each of two generations. Results don't depend on it.
CACHE_WORDS, CACHE_PIECES, CACHE_BYTES = 250_000, 150_000, 48

_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Words of ASCII and Latin letters and signs: lower case goes letter by letter and no normal form changes them.
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+")
#: How the tokenizer cuts such a word, in lower case.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of whole texts by any tokenizer, as little-endian unsigned 32-bit bytes.

    A tokenizer of the known form (normalizer, cutting pattern, added tokens that start with <| and hold no white space)
    never lets a token cross ASCII white space, so it gives a text the ids of its words one after another, and each word is
    encoded once and remembered: a plain word piece by piece by the tokenizer's model, any other through the whole
    tokenizer. With a tokenizer of another form each text is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words, self.older_words, self.pieces, self.older_pieces = {}, {}, {}, {}
        state = json.loads(self.tokenizer.to_str())
        plain = lambda t: t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not t["lstrip"] and not t["rstrip"]
        self.by_word = all(state[k] == _KNOWN[k] for k in _KNOWN) and all(map(plain, state["added_tokens"]))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if b"<|" in word or not _PLAIN.fullmatch(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out, text, pieces = b"", text.lower(), self.pieces
        for piece in (text,) if word.isalpha() else _PIECES.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.older_pieces.get(piece)
                if ids is None:
                    letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
                    ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
                if len(piece) <= CACHE_BYTES:
                    pieces[piece] = ids
            out += ids
        return out

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        words, known = text.split(), self.words  # bytes are split at ASCII white space only
        found = list(map(known.get, words))
        if None in found:
            older, make = self.older_words.get, self._word
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    found[i] = ids = known.get(word) or older(word) or make(word)
                    if len(word) <= CACHE_BYTES:
                        known[word] = ids
            if len(known) > CACHE_WORDS:
                self.words, self.older_words = {}, known
            if len(self.pieces) > CACHE_PIECES:
                self.pieces, self.older_pieces = {}, self.pieces
        return b"".join(found)


#: The normalizer and the cutting pattern that the way word by word stands for.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@lru_cache(maxsize=2)
def encoder_for(path: str) -> WordEncoder:
    """One encoder for a worker process, with what it remembers, for all its tasks."""
    return WordEncoder(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of at most capacity tokens of each document's ids, with end_id after them.

    Only documents with more than capacity ids are cut, every piece but the last being full. Returns id_col, the columns of
    `more`, piece, start (ids of the document before the piece), length, ids (binary, little-endian unsigned 32-bit). A null
    or empty text is the one id end_id. Repeated rows give repeated pieces; an empty table none; extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = [id_col, *more]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in own]
    schema = T.StructType([*fields, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, most = encoder_for(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            texts = batch.column(len(own)).to_pylist()
            rows, pieces, starts, blobs, held = [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                lengths, at = pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(rows, pa.int64())
                kept = [batch.column(i).take(at) for i in range(len(own))]
                return pa.RecordBatch.from_arrays([*kept, pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), lengths, pa.array(blobs, pa.binary())], names=schema.names)

            for row, text in enumerate(texts):
                whole = encoder.encode(text) + end
                for piece, at in enumerate(range(0, len(whole), most)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    blobs.append(whole[at : at + most])
                held += len(whole)
                if held > 8_000_000:
                    yield flush()
                    rows, pieces, starts, blobs, held = [], [], [], [], 0
            if rows:
                yield flush()

    return spread(docs.select(*own, text_of(text_col).cast("binary").alias("__text"))).mapInArrow(encode, schema)
