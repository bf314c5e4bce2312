"""The registered queries of this subpackage: against their SQL, their contract's columns and types, and brute force."""

import zlib

import numpy as np
import pytest
from test_near_dedup import brute

import __spark_entry__ as entry
from compare import compare, connect
from quarrysift.llm import queries as Q

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op5_token_counts": "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint",
    "op6_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def get(name):
        if name not in held:
            df = Q.QUERIES[name](spark, SF)
            held[name] = (dict(df.dtypes), df.collect())
        return held[name]

    return get


def test_all_are_registered():
    assert {*Q.QUERIES, "pipeline"} <= set(entry.queries()) and set(Q.QUERIES) == set(CONTRACT)
    assert set(Q.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF), Q.QUERIES[name], Q.SQL[name], SF).startswith("equal")


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(results, documents, name):
    types, rows = results(name)
    wanted = dict(c.split() for c in CONTRACT[name].split(", "))
    assert {c: types.get(c) for c in wanted} == wanted
    if name in ("op2_mixing", "op3_near_dedup", "op6_exact_dedup", "op7_toxicity", "op9_quality_rules", "op10_quality_classifier"):
        assert sorted(r.doc_id for r in rows) == sorted(documents)


def test_op1_against_the_tokenizer(results, documents):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, text in documents.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want |= {(i, piece, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for piece, at in enumerate(range(0, len(ids), 4096))}
    rows = results("op1_packing")[1]
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096


def test_op3_against_brute_force(results, documents):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in results("op3_near_dedup")[1]) == brute(list(documents.items()), 3, 85)


def test_op5_against_plain_bytes(results, documents):
    """Token ends from the bytes of each token, one by one; a token counts for the line that holds its first byte."""
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r.doc_id, r.section): r.n_tokens for r in results("op5_token_counts")[1]}
    for i, text in list(documents.items())[:60]:
        data, lines, outside, at = (text or "").encode(), {}, 0, 0
        for token in encoding.encode_ordinary(text or ""):
            if data[at : at + 1] == b"\n":
                outside += 1
            else:
                n = data[:at].count(b"\n")
                lines[n] = lines.get(n, 0) + 1
            at += len(encoding.decode_single_token_bytes(token))
        assert at == len(data) and got[i, -1] == outside
        assert all(got[i, n] == lines.get(n, 0) for n in range(data.count(b"\n") + 1))


def test_scores_agree_with_labels(spark, results):
    """Held-out rows by crc32; scores within bounds; predicted is the cut of the contract."""
    for name, modulus, rest, cut in (("op7_toxicity", 3, 1, 0.7), ("op10_quality_classifier", 5, 0, 0.3)):
        for r in results(name)[1]:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
