import sys
import unicodedata
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_native import groups, measures, word_list  # noqa: E402
from test_near_dedup import brute  # noqa: E402

from quarrysift.llm import quality_rules as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


def cleaned(text):
    """The lines that are left, by the rules one by one."""
    out = []
    for line in dict.fromkeys(x for x in (text or "").split("\n") if word_list(x)):
        n, chars = len(word_list(line)), sum(map(len, word_list(line)))
        of = lambda signs: sum(c in signs for c in line)  # noqa: B023, E731
        fails = [
            n >= 8 and not of(".!?…:;"), of("|»›•") >= 3 and of("|»›•") * 4 >= n, of(Q.SYMBOLS) * 2 >= n,
            chars >= 20 and sum(unicodedata.category(c) == "Lu" for c in line) * 2 >= chars, any(p in line.lower() for p in Q.BOILERPLATE),
        ]
        if not any(fails):
            out.append(line)
    return "\n".join(out)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select(*columns).collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows, after = [(r.doc_id, r.text) for r in before], out.collect()
        left = Counter(r.doc_id for r in after)
        if name == "quality_rules":
            failed = {i for i, t in rows if (m := measures(t))[0] < 50 or 100 * m[4] > 50 * m[0]}
            assert not failed & left.keys() and len(left) > 0.7 * len(rows)
            assert {r.doc_id: r.text for r in after} == {i: cleaned(t) for i, t in rows if i in left} and all(r.n_chars == len(r.text) for r in after)
        elif name == "exact_dedup":
            assert left == Counter({k for _, k, _ in groups(rows)})
        elif name == "near_dedup":
            assert left == Counter({c for _, _, c in brute(rows, 5, 80)})
        elif name == "mixing":
            assert left.keys() <= {i for i, _ in rows} and max(left.values()) == 2
            texts = dict(rows)
            assert all(texts[r.doc_id].startswith(r.text) for r in after)
        else:
            assert left.keys() == {i for i, _ in rows} and {"sequence_id", "offset", "length", "piece", "epoch"} <= set(out.columns)
            # Every row of the mix is one epoch, each piece of it once; the shortened one is the last.
            assert len({(r.doc_id, r.epoch, r.piece) for r in after}) == len(after)
            assert {(r.doc_id, r.epoch) for r in after} == {(i, e) for i, n in Counter(i for i, _ in rows).items() for e in range(n)}
            sizes = Counter()
            for r in after:
                sizes[r.doc_id, r.epoch] += r.length
            assert all(sizes[i, 1] <= sizes[i, 0] for i, e in sizes if e == 1) and any(sizes[i, 1] < sizes[i, 0] for i, e in sizes if e == 1)
        if name != "packing":
            assert out.columns == columns
        docs = out


def test_mixing_tells_the_epoch(spark, frame, words):
    docs = frame([(i, words(20)) for i in range(30)])
    rows = corpus_pipeline.mixing.mixed_documents(docs, epoch_col="epoch").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.epoch, len(r.text)))
    assert all([e for e, _ in sorted(x)] == list(range(len(x))) for x in by.values()) and len(rows) > 30
    assert all(sorted(x)[-1][1] <= sorted(x)[0][1] for x in by.values())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_entry_without_these_folders(monkeypatch):
    """The other queries stay when the pipeline or this subpackage is gone."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as entry

    assert "dedup_exact" in entry.queries() and "pipeline" not in entry.queries() and not any(q.startswith("op1_") for q in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
