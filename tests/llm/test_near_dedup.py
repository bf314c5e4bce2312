import random
import re

import pytest

from quarrysift.llm import near_dedup as N
from quarrysift.llm._common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, pct):
    sets, parent = {}, {}
    nodes = [(i, shingles(t, k)) for i, t in rows]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in nodes:
        parent.setdefault(i, i)
    for n, (a, s) in enumerate(nodes):
        for b, t in nodes[n + 1 :]:
            if s and t and 100 * len(s & t) >= pct * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in nodes)


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def cloud(words, n, seed=2):
    """Near copies with few to many edits: some are linked, some only through others, some not."""
    rng, base = random.Random(seed), words(120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, pct", [(3, 85), (5, 80)])
def test_against_brute_force(spark, frame, words, awkward, k, pct):
    texts = cloud(words, 90) + [words(60) for _ in range(40)]
    rows = [*awkward, *enumerate(texts, 100)]
    assert found(N.near_dedup(frame(rows), words=k, threshold_pct=pct)) == brute(rows, k, pct)


def test_blocks(spark, frame, words, monkeypatch):
    """A family of many blocks gives the same groups as one block."""
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 16)
    rows = list(enumerate(cloud(words, 120)))
    assert found(N.near_dedup(frame(rows), words=3, threshold_pct=85)) == brute(rows, 3, 85)
    monkeypatch.setattr(N, "BROADCAST_IDS", -1)
    assert found(N.near_dedup(frame(rows), words=3, threshold_pct=85)) == brute(rows, 3, 85)


def test_chains_cost_what_their_buckets_hold(spark, frame, words):
    """A family that chains through low similarities: rows dealt grow with members and buckets, comparisons with banded pairs."""
    stream, rows, length, step = words(8000).split(), [], 120, 27
    for i in range(280):
        rows.append((i, " ".join(stream[i * step : i * step + length])))
    shingler = N.Shingler(3, N.plan_bands(0.85, 7, 1e-6) * 7)
    bands = [shingler.bands(shingler.signature(shingler.shingles(t.encode())), 7).tolist() for _, t in rows]
    buckets = {}
    for i, own in enumerate(bands):
        for b in own:
            buckets.setdefault(b, set()).add(i)
    held = sum(len(b) for b in buckets.values() if len(b) > 1)
    pairs = {(i, j) for b in buckets.values() for i in b for j in b if i < j}
    assert len(pairs) > 100  # most neighbours are candidates, none is linked
    with Scratch(spark) as own:
        assert found(N.near_dedup(frame(rows), words=3, threshold_pct=85, owner=own)) == brute(rows, 3, 85)
        tasks = spark.read.parquet(f"{own.root}/*/links-stars", f"{own.root}/*/links-rest").selectExpr("sum(compared)", "sum(held)").first()
    assert tasks[0] <= 2 * len(pairs) and tasks[1] <= 2 * len(rows) + held


def test_large_buckets_in_blocks(spark, frame, words, monkeypatch):
    """One bucket for all (a band of a single hash of a common shingle): pairs of blocks lose no link."""
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 8)
    texts = cloud(words, 70, seed=9)
    rows = list(enumerate(texts))
    assert found(N.near_dedup(frame(rows), words=1, threshold_pct=85, rows=1)) == brute(rows, 1, 85)


def test_empty_and_clean(spark, frame, words):
    assert N.near_dedup(frame([])).collect() == []
    rows = [(i, words(40)) for i in range(30)]
    docs = frame(rows)
    assert N.drop_near_copies(docs).count() == 30
    kept = N.drop_near_copies(frame([*rows, (77, rows[3][1]), (78, rows[3][1].translate(str.maketrans("abcde", "ABCDE")))]))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30)) and kept.columns == docs.columns


def test_repeated_id_with_two_texts(spark, frame, words):
    a, b = words(50), words(50)
    rows = [(1, a), (2, b), (9, a), (9, b)]
    assert [(i, c) for i, _, c in found(N.near_dedup(frame(rows)))] == [(1, 1), (2, 1), (9, 1), (9, 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = N.connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark), "t").collect()
    want = {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100), 300: 300, 301: 300}
    assert {r.node: r.component for r in got} == want


def test_bounds():
    v = N.Verifier(85, 252, 28, 1e-6)
    assert all(0 <= least <= 0.85 * n for n, least in v.checks) and v.checks[-1][0] == 252
    bands = N.plan_bands(0.85, 7, 1e-6)
    assert (1 - 0.85**7) ** bands <= 1e-6 < (1 - 0.85**7) ** (bands - 1)
