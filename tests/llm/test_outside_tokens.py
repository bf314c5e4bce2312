"""Tokens in no line have a row of their own, so that the counts of a document add up."""

import pytest

from quarrysift.llm import token_counts as TC

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("rule", TC.RULES)
def test_counts_add_up(spark, frame, awkward, rule):
    rows = [*awkward, (50, "ä\n\n\n  b\n"), (51, "a b\nc d\n\n\n\ne")]
    encoder, want = TC.OffsetEncoder(RANKS, PATTERN), {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len(encoder.ends(t or ""))
    got = TC.token_counts(frame(rows), RANKS, PATTERN, rule, outside=True).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == pytest.approx(want)
