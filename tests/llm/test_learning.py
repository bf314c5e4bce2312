"""Toxicity and quality against plain versions of what they learn."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrysift.llm import quality_classifier as QC
from quarrysift.llm import toxicity as TX
from quarrysift.llm._common import labelled_sample

TOXIC = ["zzvile", "zznasty", "qqhorrid", "mmfoulé", "kkwretch"]


def corpus(words, gap, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        w = words(60).split()
        if i % 8 == 0:
            for _ in range(5):
                w.insert(rng.randrange(60), rng.choice(TOXIC))
        rows.append((i, int(i % 8 == 0), gap.join(w)))
    return rows


def sample_of(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, text string").selectExpr("id", "label", "cast(text AS binary) AS text")


def plain_units(word):
    text = word.decode()
    return [word, *(text[:k].encode() + b"-" for k in range(4, 9) if len(text) > k)]


def plain_segments(scores):
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((sums[j] - sums[i], -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0.0,))
    if best[0] <= 1e-12:
        return []
    i, j = best[2], best[3]
    return [*plain_segments(scores[:i]), best[0], *plain_segments(scores[j:])]


def plain_model(rows, prior=0.02, z=3.5, odds=1.5, docs=4):
    """Counts, log-odds under the Dirichlet prior, the other words' score and the extreme-value constant, one by one."""
    texts = [(label, TX.fold(text.encode())) for _, label, text in rows]
    y, t1 = {0: Counter(), 1: Counter()}, Counter()
    for label, words in texts:
        own = Counter(u for w in words for u in plain_units(w))
        for u, n in own.items():
            y[label][u] += min(n, 3)
            t1[u] += label
    all_units = {*y[0], *y[1]}
    a = {u: prior * (y[0][u] + y[1][u]) + 0.5 for u in all_units}
    total, n = sum(a.values()), {label: sum(y[label].values()) for label in y}
    lexicon = {}
    for u in all_units:
        of = lambda label: math.log((y[label][u] + a[u]) / (n[label] + total - y[label][u] - a[u]))  # noqa: B023, E731
        d = of(1) - of(0)
        sigma = math.sqrt(1 / (y[1][u] + a[u]) + 1 / (y[0][u] + a[u]))
        if t1[u] >= docs and d / sigma >= z and d >= odds:
            lexicon[u] = (d / sigma, d)
    score = lambda w: max((lexicon[u] for u in plain_units(w) if u in lexicon), default=(0, 0.0))[1]
    scored = [(label, [score(w) for w in words]) for label, words in texts]
    hits, words = (sum(f(s) for label, s in scored if label) for f in (lambda s: sum(x > 0 for x in s), len))
    other = math.log1p(-min(0.5, (hits + 1) / (words + 2)))
    segments = [(label, len(s), plain_segments([x or other for x in s])) for label, s in scored]
    clean = [(n, max(s, default=0.0)) for label, n, s in segments if not label and n]
    k = len(clean) / sum(n * math.exp(-best) for n, best in clean)
    x = []
    for _, n, s in segments:
        level = math.log(max(n * k, 1.0))
        over = [v - level for v in s if v > level]
        x.append(math.asinh(sum(over) if over else max(s, default=0.0) - level))
    slope, intercept = TX.logistic(np.array(x), np.array([label for label, _, _ in segments], float))
    return lexicon, other, k, slope, intercept


def test_toxicity_is_the_plain_model(spark, words):
    rows = corpus(words, " ")
    model = TX.train(sample_of(spark, rows))
    lexicon, other, k, slope, intercept = plain_model(rows)
    assert model.lexicon.keys() == lexicon.keys() and all(model.lexicon[u] == pytest.approx(lexicon[u]) for u in lexicon)
    assert (model.other, model.k, model.slope, model.intercept) == pytest.approx((other, k, slope, intercept), rel=1e-6)


@pytest.mark.parametrize("gap", ["\n", "\t", " \x0b "])
def test_words_need_no_blanks(spark, words, gap):
    """Words parted by any white space: all toxic texts are found, no clean one."""
    rows = corpus(words, gap, 400)
    model = TX.train(sample_of(spark, rows))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    assert {r.doc_id for r in TX.score(docs, model).collect() if r.score >= 0.7} == {i for i, label, _ in rows if label}


def test_all_passages_are_found(spark, words):
    model = TX.train(sample_of(spark, corpus(words, " ")))
    neutral = " ".join(words(500).split())
    text = " ".join(["zzvile zznasty qqhorrid", neutral, "zzvile zznasty qqhorrid " * 2])
    found = TX.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().segments
    assert [(s.first, s.end) for s in found] == [(0, 3), (503, 509)]


def test_shared_beginnings_are_no_evidence(spark, words):
    """Clean words that begin like toxic ones don't score, where clean texts use them."""
    rng, rows = random.Random(2), []
    for i, label, text in corpus(words, " "):
        rows.append((i, label, text if label else text + " " + " ".join(rng.choice(["zzvillage", "zzvilnius", "zznascent"]) for _ in range(4))))
    model = TX.train(sample_of(spark, rows))
    docs = spark.createDataFrame([(1, "zzvillage zzvilnius zznascent " + words(40)), (2, "zzvile zznasty zzvile " + words(40))], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in TX.score(docs, model).collect()}
    assert scores[1] < 0.3 and scores[2] >= 0.7
    assert all(u.decode() for u in model.lexicon)  # no unit is cut inside a character


def test_sample_is_bounded_and_takes_any_id(spark, frame, words):
    docs = frame([(i % 7, words(20)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 3)
    assert sample.count() == 3 and sorted(sample.collect()) == sorted(labelled_sample(docs.repartition(5), labels, "toxic", F.lit(True), 3).collect())
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    for module, label in ((TX, "toxic"), (QC, "quality")):
        model = module.train(labelled_sample(named(docs), named(labels), label, F.lit(True), 100))
        rows = module.score(named(docs), model).collect()
        assert len(rows) == 60 and all(r.doc_id.startswith("id-") and 0 <= r.score <= 1 for r in rows)


def plain_features(text):
    """Bucket counts of words, pairs of words and runs of bytes, by loops over whole numbers."""
    bucket = lambda h: (h * 0x9E3779B97F4A7C15 % 2**64) >> 56
    words = [zlib.crc32(w) for w in text.split()]
    runs = lambda k: [int.from_bytes(text[i : i + k], "little") for i in range(len(text) - k + 1)]
    out = []
    for hashes in (words, [(a * 1_000_003 + b) % 2**64 for a, b in zip(words, words[1:])], runs(3), runs(5)):
        counts = Counter(map(bucket, hashes))
        out += [math.sqrt(counts[b] / len(hashes)) if hashes else 0.0 for b in range(QC.BUCKETS)]
    return out


def test_hashed_features(words):
    for text in (b"", b"a", b"a b", words(50).encode(), ("é " * 30).encode(), b"\xff\xfe  x" * 9):
        assert QC.features(text)[QC.SURFACE :].tolist() == pytest.approx(plain_features(text))


def test_pairwise_fit_is_the_minimum():
    """Against plain gradient steps on the differences themselves."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(40, 5)) + np.outer(np.arange(40) % 2, [1.0, 0, -0.5, 0, 0])
    good, bad = np.flatnonzero(np.arange(40) % 2), np.flatnonzero(np.arange(40) % 2 == 0)
    first, second = rng.choice(good, 300), rng.choice(bad, 300)
    d, w = z[first] - z[second], np.zeros(5)
    for _ in range(20_000):
        w = w - 0.05 * (-(d.T @ (1 / (1 + np.exp(d @ w)))) / 300 + 0.01 * w)
    assert QC.preference_weights(z, first, second, 0.01, 2000) == pytest.approx(w, abs=1e-3)


def test_quality_is_reproducible(spark, words):
    rows = [(i, int(i % 4 > 0), words(40) if i % 4 else " ".join(w + "##" for w in words(40).split())) for i in range(200)]
    a, b = (QC.train(sample_of(spark, rows).repartition(n)) for n in (1, 5))
    assert a.weights == pytest.approx(b.weights) and a.shift == pytest.approx(b.shift)
    texts = [(1, None), (2, ""), (1, words(9)), (None, "x" * 100_000)]
    got = QC.score(spark.createDataFrame(texts, "doc_id long, text string"), a).collect()
    plain = [a.score(QC.features((t or "").encode())) for _, t in texts]
    assert sorted(r.score for r in got) == pytest.approx(sorted(plain))


def measured(spark, rows):
    """A table of features like that which the fit writes, in several files, and the features themselves."""
    x = [QC.features(t.encode()).astype(np.float32) for _, _, t in rows]
    table = spark.createDataFrame([(str(i), y, zlib.crc32(t.encode()), bytearray(v.tobytes())) for (i, y, t), v in zip(rows, x)], "id string, label int, text long, x binary")
    return table.repartition(5), np.array(x, float)


@pytest.mark.parametrize("way", ["driver", "jobs"])
def test_fit_and_cut_are_of_all_pairs_and_rows(spark, words, monkeypatch, way):
    """Against all pairs one by one and numpy's quantile; jobs add up in two levels, and the quantile parts its ranges."""
    monkeypatch.setattr(QC, "LOCAL_ROWS", 1000 if way == "driver" else 10)
    monkeypatch.setattr(QC, "FAN_IN", 2)
    monkeypatch.setattr(QC, "RANGES", 8)
    monkeypatch.setattr(QC, "BLOCK", 7)
    rows = [(i, int(i % 3 > 0), words(20) if i % 3 else " ".join(w + "#" * (i % 2) for w in words(20).split())) for i in range(90)]
    table, x = measured(spark, rows)
    kept = QC.Rows(table)
    assert (kept.blocks is None) == (way == "jobs")
    y, mean, scale = np.array([r[1] for r in rows]), x.mean(axis=0), np.ones(QC.SIZE)
    scale[: QC.SURFACE] = np.maximum(x[:, : QC.SURFACE].std(axis=0), 1e-6)
    good, bad = (a.ravel() for a in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    z = (x - mean) / scale
    want = QC.preference_weights(z, good, bad, 0.05, 500)
    got = QC.all_pairs_weights(kept, mean, scale, z.var(axis=0) / 2 + 0.05, 0.05, 15 if way == "jobs" else 500)
    assert z @ got == pytest.approx(z @ want, abs=0.05 if way == "jobs" else 2e-3)
    for share in (0.0, 1 / 3, 0.5, 1.0) if way == "driver" else (1 / 3,):
        assert QC.quantile(kept, got / scale, float(mean @ (got / scale)), share, 90) == pytest.approx(np.quantile(z @ got, share))
    assert QC.quantile(kept, np.zeros(QC.SIZE), 0.0, 0.3, 90) == 0.0


def test_chances_of_pairs_are_close():
    rng = np.random.default_rng(2)
    s, y = rng.normal(size=400) * 6, rng.integers(0, 2, 400)
    first, counts = QC.joined(QC.spectrum(y[:100], s[:100]), QC.spectrum(y[100:], s[100:]))
    at, part = QC.placed(s)
    table = QC.lost_pairs(counts)
    got = table[y, at - first] * (1 - part) + table[y, at - first + 1] * part
    lost = 1 / (1 + np.exp(-(s[:, None] - s[None, :]) * np.where(y, -1, 1)[:, None])) * (y[:, None] != y[None, :])
    assert got / len(s) == pytest.approx(lost.sum(axis=1) / len(s), abs=1e-5)


def test_quality_learns_from_every_usable_label(spark, monkeypatch):
    """No bound on labels: the fit gets all of them, however many are usable."""
    from quarrysift.llm import queries

    monkeypatch.setattr(queries, "SAMPLE", 20)
    fit, seen = QC.train, []
    monkeypatch.setattr(QC, "train", lambda sample: (seen.append(sorted(r.id for r in sample.collect())), fit(sample))[1])
    where = "/root/testdata/sf0.001"
    queries.op10_quality_classifier(spark, where)
    labels = spark.read.parquet(f"{where}/labels.parquet").join(spark.read.parquet(f"{where}/documents.parquet"), "doc_id")
    usable = [str(r.doc_id) for r in labels.where("quality in (0, 1)").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert seen == [sorted(usable)] and len(usable) > 20
