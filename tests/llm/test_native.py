"""Exact dedup, mixing, chat formatting and quality rules against plain Python."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrysift.llm import chat_format as C
from quarrysift.llm import exact_dedup as E
from quarrysift.llm import mixing as M
from quarrysift.llm import quality_rules as Q
from quarrysift.llm._common import SPACES

DROP = str.maketrans("", "", SPACES)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def word_list(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# ---- exact dedup ----------------------------------------------------------------------------------------------------


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(DROP)].append((-len(t or ""), i))
    return sorted((i, min(by[(t or "").translate(DROP)])[1], len(by[(t or "").translate(DROP)])) for i, t in rows)


@pytest.mark.parametrize("digest", [E._sha256, lambda t: F.unhex(F.hex(F.length(t) % 3)), lambda t: F.unhex(F.lit("00"))])
def test_exact_dedup(spark, frame, awkward, digest):
    """Also where digests clash: texts decide."""
    rows = [*awkward, (20, "a  b c"), (21, "abc "), (22, "ab c\n\n"), (23, "abd"), (24, "abc"), (25, "a\u00a0bc"), (26, "ABC")]
    docs = frame(rows)
    got = E.exact_dedup(docs, digest=digest)
    no_python(got)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == groups(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())
    left = E.drop_copies(docs, digest=digest)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({k for _, k, _ in groups(rows)})


def test_exact_dedup_negative_and_large_ids(spark):
    docs = spark.createDataFrame([(-(2**62), "a b"), (2**62, "a b"), (3, "ab"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in E.exact_dedup(docs).collect()) == [(-(2**62), -(2**62)), (3, -(2**62)), (5, 5), (2**62, -(2**62))]
    assert E.exact_dedup(docs.where("false")).count() == 0


# ---- mixing ---------------------------------------------------------------------------------------------------------


def water(sizes, weights, total):
    targets, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
        open_ -= full
    return targets


def test_mixing(spark, frame, awkward, words):
    rows = [*awkward, *((i, words(i % 37)) for i in range(30, 330))]
    docs = frame(rows)
    got = M.mix_sources(docs)
    no_python(got)
    rows_ = got.collect()
    sizes = defaultdict(int)
    for r in rows_:
        sizes[r["row"].source] += r["size"]
        assert r["size"] == len(word_list(r["row"].text or "")) and r.taken <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in order:
        own = [r for r in rows_ if r["row"].source == s]
        assert own[0].target == pytest.approx(targets[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - targets[s]) <= 0.5
    assert Counter((r["row"].doc_id, r.taken) for r in M.mix_sources(docs).collect()) == Counter((r["row"].doc_id, r.taken) for r in rows_)
    copies = M.mixed_documents(docs)
    assert copies.columns == docs.columns
    mixed = defaultdict(int)
    texts = {i: t for i, t in rows}
    for r in copies.collect():
        mixed[r.source] += len(word_list(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert all(abs(mixed[s] - targets[s]) <= 0.5 for s in order)
    assert M.mix_sources(docs.where("false")).count() == 0


def test_mixing_single_and_empty_sources(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, None, "x"), (3, "", "y")], "doc_id long, text string, source string")
    got = {r["row"].doc_id: (r.target, r.taken) for r in M.mix_sources(docs).collect()}
    assert got == {1: (4.5, 5), 2: (0.0, 0), 3: (0.0, 0)}


# ---- chat formatting ------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(3)
    odd = ["", "\\", "<turn user>\n", "\n</turn>\n", "\\l\\b\\g", "<image 1>", "a\U0001f642é", "\\\\<", None]
    rows = [(c, t, rng.choice(["user", "assistant", "a>b<", None]), "".join(rng.choice(odd) or "" for _ in range(rng.randint(0, 5))) if rng.random() < 0.9 else None) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(99, None, "user", "x"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("s", F.lit(2))
    out = C.format_chat(turns)
    no_python(out)
    read = out.select("conv_id", C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in read:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id), key=lambda x: x)
        assert [(x.role, x.text) for x in r.t] == [(role, text) for _, _, role, text in own]
        assert r.loss == "".join(text for _, _, role, text in own if role == "assistant")
    assert C.format_chat(turns.where("false")).count() == 0


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    rows = [(1, 0, "user", [("text", "look <here>", None, None), ("image", None, "a.png", 256), ("sheet", None, "b.xls", None)]), (1, 1, "assistant", [("text", "I ", None, None), ("audio", None, "c.wav", 40), ("text", "see", None, None)]), (1, 2, "user", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    r = C.format_chat(turns, parts=F.col("parts")).first()
    assert r.formatted == "<turn user>\nlook \\lhere\\g<image 1><document 2>\n</turn>\n<turn assistant>\nI <audio 3>see\n</turn>\n<turn user>\n\n</turn>\n"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "a.png", 256), (2, "document", "b.xls", 0), (3, "audio", "c.wav", 40)]
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["I ", "see"]
    assert [r.formatted.encode()[s.byte : s.byte + s.bytes] for s in r.loss_spans] == [b"I ", b"see"]
    back = C.format_chat(turns, parts=F.col("parts")).select(C.read_parts(F.col("formatted"), F.col("attachments")).alias("t")).first().t
    own = [[("text", "look <here>", None, 0), ("image", "", "a.png", 256), ("document", "", "b.xls", 0)], [("text", "I ", None, 0), ("audio", "", "c.wav", 40), ("text", "see", None, 0)], []]
    assert [(x.role, [tuple(p) for p in x.parts]) for x in back] == list(zip(["user", "assistant", "user"], own))


def test_long_conversation(spark):
    """Linear time: 50,000 turns with awkward texts, formatted, read back and masked within a minute."""
    n = 50_000
    turns = spark.range(n).selectExpr("5L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "'é <turn> \\\\ ' || id AS text")
    began = time.perf_counter()
    out = C.format_chat(turns)
    r = out.select(C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert time.perf_counter() - began < 60
    assert [x.text for x in r.t] == [f"é <turn> \\ {i}" for i in range(n)] and r.loss == "".join(f"é <turn> \\ {i}" for i in range(1, n, 2))


# ---- quality rules --------------------------------------------------------------------------------------------------


def measures(text):
    w, lines = word_list(text or ""), [x for x in (text or "").split("\n") if word_list(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("bits", [40, 2])
def test_quality_measures(spark, frame, awkward, words, bits):
    """With two bits of hash unequal windows clash all the time, and the windows' texts decide."""
    rows = [*awkward, *((i, "\n".join(words(i % 9) for _ in range(i % 7)) + " a b a b a b" * (i % 4)) for i in range(30, 150))]
    got = Q.quality_rules(frame(rows), hash_bits=bits)
    no_python(got)
    judged = got.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged) == Counter((i, *measures(t)) for i, t in rows)
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_lines(spark, frame):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    cases = {
        1: (good, True),
        2: (" ".join(f"SHOUT{'AB'[i % 2]}X" * 2 + str(i) for i in range(60)) + ".", False),
        3: (" | ".join(f"cell{i}" for i in range(60)) + ".", False),
        4: ("### " + " ".join(f"w{i}***" for i in range(60)) + ".", False),
        5: (good + "\nClick here for our cookie policy.", True),
        6: (" ".join(f"word{i}" for i in range(60)), False),
        7: ("\n".join(["All rights reserved by one and two and three."] + [f"Line{i} a{i} b{i} c{i}." for i in range(20)]), True),
        8: ("", False),
    }
    docs = frame([(k, t) for k, (t, _) in cases.items()])
    assert {r.doc_id: r.kept for r in Q.quality_rules(docs).collect()} == {k: v for k, (_, v) in cases.items()}
    assert Q.quality_rules(docs).where("doc_id = 5").first().clean_text == good
    left = Q.filter_documents(docs)
    kept = {r.doc_id: r for r in left.collect()}
    assert left.columns == docs.columns and kept.keys() == {k for k, (_, v) in cases.items() if v}
    assert (kept[1].text, kept[5].text, kept[7].text) == (good, good, cases[7][0].partition("\n")[2])
    assert all(r.n_chars == len(r.text) for r in kept.values())
