"""Token counts, toxicity, URL filters and the quality classifier."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrysift.llm import quality_classifier as QC
from quarrysift.llm import token_counts as TC
from quarrysift.llm import toxicity as TX
from quarrysift.llm._common import labelled_sample
from quarrysift.llm import url_filter as U

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# ---- token counts ---------------------------------------------------------------------------------------------------


def test_counts_of_lines(spark, frame, awkward):
    rows = [*awkward, (50, "ä\n\n\n  b\n"), (51, "a 🙂🙂 b\nc d\n\n\n\ne")]
    encoder = TC.OffsetEncoder(RANKS, PATTERN)
    got = TC.token_counts(frame(rows), RANKS, PATTERN)
    want = []
    for i, t in rows:
        t = t or ""
        ends = encoder.ends(t).tolist()
        starts = [0, *ends[:-1]]
        at = 0
        for n, line in enumerate(t.split("\n")):
            b0, b1 = len(t[:at].encode()), len(t[: at + len(line)].encode())
            want.append((i, n, at, at + len(line), sum(b0 <= s < b1 for s in starts), sum(s < b0 < e for s, e in zip(starts, ends)) + sum(s < b1 < e for s, e in zip(starts, ends))))
            at += len(line) + 1
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("rule", TC.RULES)
def test_sections_cover_all_tokens(spark, frame, words, rule):
    text = words(200) + "\n\n\n" + words(50)
    cuts = sorted(random.Random(1).sample(range(1, len(text)), 12))
    spans = list(zip([0, *cuts], [*cuts, len(text)]))
    docs = frame([(1, text)]).withColumn("s", F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans]))
    got = TC.token_counts(docs, RANKS, PATTERN, rule, F.col("s")).collect()
    assert len(got) == 13 and sum(r.n_tokens for r in got) == pytest.approx(len(TC.OffsetEncoder(RANKS, PATTERN).ends(text)))
    assert TC.token_counts(docs, RANKS, PATTERN, rule, F.lit(None)).count() == 0
    assert TC.token_counts(docs.where("false"), RANKS, PATTERN, rule).count() == 0


def test_fields(spark):
    docs = spark.createDataFrame([(1, "a title", None, "the body 🙂 text")], "doc_id long, title string, by string, body string")
    text, sections = TC.joined_fields(["title", "by", "body"])
    got = TC.token_counts(docs.select("doc_id", text.alias("text"), sections.alias("s")), RANKS, PATTERN, "first", F.col("s")).orderBy("section").collect()
    assert [(r.char_start, r.char_end) for r in got] == [(0, 7), (8, 8), (9, 24)] and [r.n_tokens > 0 for r in got] == [True, False, True]


# ---- toxicity -------------------------------------------------------------------------------------------------------


def plain_segments(scores):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=(0,))
    if best[0] <= 1e-12:
        return []
    i, j = best[3], best[4]
    return plain_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 14)
        hits = [(i, rng.choice([0.7, 1.3, 2.9])) for i in range(n) if rng.random() < 0.4]
        scores = [dict(hits).get(i, -0.45) for i in range(n)]
        got = TX.maximal_segments(hits, n, -0.45)
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxicity_learns(spark, frame, words):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = words(60).split()
        if i % 8 == 0:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(["zzvile", "zznasty,", "ZZVILE.", "qqprefix" + rng.choice("abcdefgh") * 3]))
        rows.append((i, " ".join(w)))
    docs = frame([*rows, (900, None), (901, ""), (902, "zzvile " * 3)])
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", F.col("doc_id") % 3 != 1, 1000)
    assert sample.count() == sum(i % 3 != 1 for i in range(400)) and labelled_sample(docs, labels, "toxic", F.lit(True), 50).count() == 50
    scores = {r.doc_id: r for r in TX.score(docs, TX.train(sample)).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert sum((scores[i].score >= 0.7) == (i % 8 == 0) for i in held) >= 0.97 * len(held)
    assert scores[900].score < 0.3 and scores[901].score < 0.3 and scores[902].segments
    assert all(0 <= r.score <= 1 for r in scores.values())


def test_every_occurrence_scores():
    bad = [b"bad%d" % i for i in range(8)]
    scanner = TX.Scanner(TX.Model({w: (5.0, 4.0) for w in bad}, -0.05, 0.01, 1.0, 0.0))
    gap = [b"good"] * 2000
    repeated = [w for _ in range(6) for w in [*bad, *gap]]
    assert [(a, b) for a, b, _ in scanner.evidence(repeated)[1]] == [(i * 2008, i * 2008 + 8) for i in range(6)]
    late = [w for _ in range(3) for b in bad for w in [b, *gap[:200]]] + bad
    assert max(scanner.evidence(late)[1], key=lambda s: s[2]) == (len(late) - 8, len(late), pytest.approx(32.0))


def test_only_near_copies_of_a_label_go(spark):
    one, other = "commonword " + " ".join(f"a{i}" for i in range(40)), "commonword " + " ".join(f"b{i}" for i in range(40))
    rows = [(1, 0, one), (2, 0, other), (3, 0, one + " a99"), (4, 1, one), (5, 1, one), (6, 0, ""), (7, 0, "")]
    sample = spark.createDataFrame(rows, "id long, label int, text string").selectExpr("id", "label", "cast(text as binary) AS text")
    assert {r.id for r in TX.without_near_copies(sample).collect()} == {"1", "2", "4", "6"}


def test_toxicity_without_labels(spark, frame, words):
    docs = frame([(1, words(5)), (2, None)])
    labels = spark.createDataFrame([(1, 0), (2, None), (7, 1)], "doc_id long, toxic int")
    model = TX.train(labelled_sample(docs, labels, "toxic", F.lit(True), 10))
    assert all(r.score < 0.1 for r in TX.score(docs, model).collect())
    assert TX.score(docs.where("false"), model).count() == 0


# ---- URL filters ----------------------------------------------------------------------------------------------------


def odd_urls():
    rng = random.Random(7)
    part = rng.choice
    urls = [f"{part(['http', 'HTTPS', ''])}{part(['://', '://', ':/'])}{part(['', 'www.', 'x', 'sub.'])}{part(['Example.com', 'a.net', 'b.org', 'com', 'net', 'adserver.net'])}{part(['', '/', '/en/', '/EN/', '/es/1', '/xy', '/casino-x', '/casinos', '#f', '?q=poker', '/a/zz', '/Ads/banner-1.GIF', '/click', '/clicks', '/free-x-download/'])}{part(['', '?a#b', '#x?y', '?adurl=1&clickid=2'])}" for _ in range(600)]
    return [*urls, None, "", "://", "a://b://c/d", "http://a.com/e\u017fcort/x", "http://a.com/\u212aeygen", "http://b.org/\nads/bannerx.gif", "http://b.org/ads/banner\n.gif"]


@pytest.mark.parametrize("way", ["list", "table", "join"])
def test_index_agrees_with_all_rules(spark, monkeypatch, way):
    rules = [U.host_rule(*r) for r in [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.net", ""), ("block", "org", "/x")]] + U.DEFAULT_RULES + [U.Rule("any", "block", r"zz$", ()), U.filter_rule("allow", "|www.*/xy|"), U.filter_rule("allow", "||b.org^")]
    urls = odd_urls()
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("?")).withColumn("row", F.lit(2))

    def plain(url):
        url = url or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        query = re.match(r"(\?[^#]*)?", rest[len(host) + len(path) :]).group()
        host = host.translate(str.maketrans(U.UPPER, U.LOWER))
        fits = [r for r in rules if re.search(r.pattern, host + path + (query if r.query else ""), re.S)]
        best = max(fits, key=lambda r: (r.rank, len(r.name), r.verdict == "block", r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    if way == "join":
        monkeypatch.setattr(U, "INDEX_RULES", 3)
    given = rules if way == "list" else U.rules_table(spark, rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(pages, given).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert U.url_filter(pages.where("false"), given).count() == 0 and U.url_filter(pages, []).where("verdict = 'allow'").count() == len(urls)


def test_rules_from_a_table(spark, monkeypatch):
    rows = [("allow", "host", "WWW.Example.com/en/"), ("block", "host", "a.net"), ("block", "word", "poker"), ("block", "filter", "||ads.*/x^")]
    made = U.rules_of(spark.createDataFrame(rows, "verdict string, kind string, rule string")).collect()
    want = [U.host_rule("allow", "www.example.com", "/en/"), U.host_rule("block", "a.net", ""), U.word_rule("block", "poker"), U.filter_rule("block", "||ads.*/x^")]
    assert [(r.name, r.verdict, r.pattern, tuple(r.tokens), r["rank"], r.query) for r in made] == [(r.name, r.verdict, r.pattern, r.tokens, r.rank, r.query) for r in want]
    monkeypatch.setattr(U, "INDEX_RULES", 1)
    monkeypatch.setattr(U, "TOKENLESS_RULES", 1)
    with pytest.raises(ValueError):
        U.url_filter(spark.createDataFrame([(1, "a")], "page_id int, url string"), U.rules_table(spark, [U.Rule("a", "block", "a", ()), U.Rule("b", "block", "b", ())]))


def test_longest_host_rule(spark):
    rules = [U.host_rule("allow", "com", "/"), U.host_rule("block", "example.com", "/en/"), U.host_rule("allow", "www.example.com", "/en/")]
    pages = spark.createDataFrame([(1, "http://m.example.com/en/1"), (2, "http://a.www.example.com/en/"), (3, "http://notexample.com/en/"), (4, "http://example.com")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.url_filter(pages, rules).orderBy("page_id").collect()] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), (None, "allow")]


# ---- quality classifier ---------------------------------------------------------------------------------------------


def test_classifier(spark, frame, words):
    junk = [lambda: " ".join(w + "###" for w in words(60).split()), lambda: (words(60)).upper() + "!!", lambda: " | ".join(words(40).split()), lambda: "spam " * 50]
    rows = [(i, junk[(i // 5 + i // 20) % 4]() if i % 5 == 0 else words(30 + i % 90) + ".") for i in range(500)]
    docs = frame([*rows, (900, None), (901, "")])
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(500)], "doc_id long, quality int")
    model = QC.train(labelled_sample(docs, labels, "quality", F.col("doc_id") % 4 != 0, 1000))
    scores = {r.doc_id: r.score for r in QC.score(docs, model).collect()}
    held = [i for i in range(500) if i % 4 == 0]
    assert sum((scores[i] >= 0.3) == (i % 5 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 502
    flat = QC.train(labelled_sample(docs, labels.where("quality = 1"), "quality", F.lit(True), 100))
    assert all(r.score == pytest.approx(0.3) or 0 <= r.score <= 1 for r in QC.score(docs, flat).collect())
    assert QC.score(docs.where("false"), model).count() == 0
