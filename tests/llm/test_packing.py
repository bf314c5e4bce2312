import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrysift.llm import packing, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.data(), st.sampled_from(packing.PHASES))
def test_rounds_place_every_piece(capacity, data, factor):
    """Every rank has one place, sequences are gapless, a factor of 1 is best-fit decreasing, the bound of the matches holds."""
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=120))
    counts = Counter(lengths)
    found, opened = packing.match_rounds(dict(counts), capacity, factor)
    sequences = defaultdict(list)
    for n, count in counts.items():
        own = sorted(m for m in found if m[0] == n)
        for rank in range(count):
            _, first_rank, first, offset, per = max((m for m in own if m[1] <= rank), key=lambda m: m[1])
            nth, within = divmod(rank - first_rank, per)
            sequences[first + nth].append((offset + within * n, n))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(sequences) == opened and len(found) <= (3 * math.log2(max(capacity, 2)) + 1) * len(counts)
    if factor == 1:
        assert opened == plain_best_fit(lengths, capacity)


def test_matches_stay_bounded():
    """As many pieces as a very large corpus has, over all lengths: the matches don't grow with them."""
    rng = random.Random(1)
    few = {n: rng.randint(1, 9) for n in range(1, 4097)}
    for factor in packing.PHASES:
        found, opened = packing.match_rounds({n: c * 10**9 + rng.randint(0, 10**6) for n, c in few.items()}, 4096, factor)
        assert len(found) <= 37 * 4096 and opened > 10**9


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark, frame, awkward):
    from tokenizers import Tokenizer

    docs = frame(awkward)
    pieces = tokens.tokenize_pieces(docs, PATH, capacity=512)
    rows = packing.best_fit_pack(pieces, 512).collect()
    assert check_places(rows, 512) <= plain_best_fit([r.length for r in rows], 512)
    plain = Tokenizer.from_file(PATH)
    wanted = Counter()
    for i, text in awkward:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            wanted[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == wanted


def test_hot_length_and_empty(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "CAST(IF(id % 3 = 0, 700, id % 4096 + 1) AS LONG) AS length", "'x' AS sequence_id", "1 AS offset", "id % 2 AS __row", "1 AS __rank", "2 AS key")
    out = packing.best_fit_pack(rows)
    assert out.columns == ["doc_id", "piece", "length", "__row", "__rank", "key", "sequence_id", "offset"]
    packed = out.collect()
    assert len(packed) == 3000 and check_places(packed, 4096) <= plain_best_fit([r.length for r in packed], 4096)
    assert all(r["__row"] == r.doc_id % 2 for r in packed)
    assert packing.best_fit_pack(rows.where("false")).collect() == []
    with pytest.raises(ValueError):
        packing.best_fit_pack(rows.selectExpr("doc_id", "piece", "0L AS length"))


def test_encoder_is_exact():
    encoder = tokens.WordEncoder(PATH)
    rng = random.Random(4)
    letters = "aZé'ÉsStTßİΣσ 0²<|>xt́ \x85\x1c\n½_-.,!#🙂中rvlmd"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    encoder = tokens.WordEncoder(PATH)
    for text in ("one two three four", "five one six, seven's", "one two " + "y" * 100) * 3:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    encoder = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_word and tokens.WordEncoder(PATH).by_word
    for text in ("one two  three\n\nfour", " a\tb ", ""):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
