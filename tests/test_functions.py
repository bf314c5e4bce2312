"""Text functions and operators on awkward values, against Python."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrysift.functions import predicates as P
from quarrysift.functions import text as X
from quarrysift.operators import curate, metrics
from quarrysift.sources import records, writers

TEXTS = ["", " ", "a\r\nb\x0bc\x85", "\u00a0x\u2003", "# all\n\n\n\n\nx # y\n'#'", "a\n", "\x1c\x1dq\x1e\n\n", "tab\tend \t\n\n\n\nz", "ß\u2028K"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_strip_and_lines(texts):
    t = F.col("t")
    assert column(texts, X.strip(t)) == [x.strip() for x in TEXTS]
    assert column(texts, X.rstrip(t)) == [x.rstrip() for x in TEXTS]
    assert column(texts, X.lstrip(t)) == [x.lstrip() for x in TEXTS]
    assert [x for x in column(texts, X.split_lines(t))] == [x.splitlines() or [""] for x in TEXTS]


def test_hashes(texts):
    def normal(code):
        kept = [x.partition("#")[0].strip() for x in code.split("\n")]
        return "\n".join(x for x in kept if x)

    def light(code):
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in code.splitlines()).strip() + "\n")

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert column(texts, X.content_hash(F.col("t"))) == [sha(normal(x)) for x in TEXTS]
    assert column(texts, X.light_hash(F.col("t"))) == [sha(light(x)) for x in TEXTS]


def test_names(spark):
    paths = ["a/b.tar.gz", ".hidden", "x/..", "no", "d.e/f", "q?:.py", "Verified_results-x.json"]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, t string")
    import os

    assert column(df, X.stem(F.col("t"))) == [os.path.splitext(os.path.basename(p))[0] for p in paths]
    assert column(df, X.zfill(F.length("t"), 2)) == [str(len(p)).zfill(2) for p in paths]
    assert column(df, X.infer_transformation(F.col("t")))[-1] == "x"


def test_messages(spark):
    cases = {"A postcondition MIGHT not hold": "Verification", "Unexpected token": "Parser", "undeclared x": "Name/Type Resolution", "old expressions": "Ghost/Spec Context", "assign-such-that": "Determinism", "feature not supported": "Compilation", "unknown switch": "Name/Type Resolution", "not a recognized option": "Command-line", "fine": "Other", None: "Other"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert column(df, X.categorize_message(F.col("t"))) == list(cases.values())


def test_durations_and_costs(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 61.25), (2, 3725.5)], "i int, s double")
    assert column(df, X.format_duration(F.col("s"))) == ["5.00s", "1m 1.3s", "1h 2m 5.5s"] or column(df, X.format_duration(F.col("s")))[1] == "1m 1.2s"
    assert spark.range(1).select(P.calculate_cost(F.lit(" GPT-4.1-Mini "), F.lit(1000), F.lit(2000))).first()[0] == pytest.approx(0.0036)
    assert spark.range(1).select(P.pass_at_k(F.lit(500), F.lit(45), 5)).first()[0] == pytest.approx(1 - __import__("math").prod(1 - 5 / i for i in range(456, 501)))
    assert [r[0] for r in spark.createDataFrame([(3, 0), (3, 3), (10, 0)], "n int, c int").select(P.pass_at_k(F.col("n"), F.col("c"), 5)).collect()] == [1.0, 1.0, 0.0]


def test_index_and_top(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS seq", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS g")
    assert [(r["seq"], r["index"]) for r in curate.with_index(df, "seq").orderBy("seq").collect()] == [(i, i + 1) for i in range(1000)]
    assert curate.per_group_top(df, "g", [F.col("seq")], 4).where("g = 'hot'").count() == 4
    assert curate.with_index(df.where("false"), "seq").count() == 0
    tied = spark.createDataFrame([(None, 1), (2, 5), (2, 4), (None, 0)], "seq int, t int")
    assert [(r["t"], r["index"]) for r in curate.with_index(tied, "seq", ties=("t",)).orderBy("index").collect()] == [(0, 1), (1, 2), (4, 3), (5, 4)]


def test_dedup_rows(spark):
    rows = [(1, "a", "xx"), (2, "a", "xxx"), (3, "b", None), (4, "a", "yyy"), (5, None, "q"), (6, None, "")]
    df = spark.createDataFrame(rows, "seq long, k string, t string")
    pick = lambda *a: sorted((r.seq, r.first_seq) for r in curate.dedup_rows(df, ["k"], "seq", *a).collect())
    assert pick() == [(1, 1), (3, 3), (5, 5)] and pick("last") == [(3, 3), (4, 1), (6, 5)] and pick("longer", "t") == [(2, 1), (3, 3), (5, 5)]
    assert curate.dedup_rows(df, [], "seq").count() == 6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "verified boolean, compilation_success boolean, n_parse_errors int, n_verification_errors int, verification_time double")
    r = metrics.verify_summary(empty).first()
    assert (r.total_files, r.verification_rate, r.average_time) == (0, 0.0, 0.0)
    categories = metrics.category_counts(spark.createDataFrame([], "category string, n long"))
    assert categories.count() == 8 and metrics.severity_counts(categories).count() == 4


def test_plan_reached(spark):
    repos, counts = spark.createDataFrame([("a", 1), ("b", 2)], "repo string, seq int"), spark.createDataFrame([("a", 90)], "repo string, collected int")
    assert curate.plan_batch(repos, counts, 90, 10).count() == 0
    assert [tuple(r)[:4] for r in curate.plan_batch(repos, counts, 95, 10).orderBy("repo").collect()] == [("a", 90, 5, 2), ("b", 0, 5, 2)]


def test_plan_past_the_target_and_null_repo(spark):
    counts = spark.createDataFrame([(None, 120), ("a", 3)], "repo string, collected int")
    repos = spark.createDataFrame([(None, 1), ("a", 2), ("b", None), ("c", 4)], "repo string, seq int")
    plan = lambda target, *a: sorted((tuple(r)[:4] for r in curate.plan_batch(repos, counts, target, 10, *a).collect()), key=str)
    assert plan(100, 10, True) == sorted([(None, 120, -23, 1), ("a", 3, -23, 1), ("b", 0, -23, 1), ("c", 0, -23, 1)], key=str) and plan(100) == []
    assert plan(200, 1) == [("c", 0, 10, 10)] and (None, 120, 10, 2) in plan(200)


def test_planned_query_is_its_sql_past_the_target(spark, tmp_path):
    import __spark_entry__ as entry
    import duckdb

    spark.range(100_300).selectExpr("id AS doc_id", "CASE WHEN id % 14 > 0 THEN 's' || cast(id * id % 14 AS string) END AS source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ("repo", "collected", "batch_size", "per_repo", "status")
    got = entry.catalog.QUERIES["plan_next_batch"](spark, str(tmp_path)).select(*columns).collect()
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.catalog.SQL['plan_next_batch']})").fetchall()
    assert len(want) > 3 and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_container_shapes(spark, tmp_path):
    import json

    shapes = {"list": [{"a": 1}, {"a": 2}], "data": {"data": [{"a": 3}]}, "values": {"p": {"a": 4}, "q": {"a": 5}}, "other": {"n": 1, "zz": [{"a": 6}]}, "single": {"a": 7, "b": "x"}, "entries": {"entries": [{"a": 8}]}}
    for name, value in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=2 if name == "data" else None))
    (tmp_path / "lines.json").write_text('{"a": 9}\nbad\n{"a": 10}\n')
    (tmp_path / "broken.json").write_text("{nope")
    rows = records.load_records(spark, str(tmp_path))
    assert sorted(r[0] for r in rows.select(F.try_variant_get("record", "$.a", "int")).collect()) == list(range(1, 11))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, " x = 1\n"), (2222, "y"), (3, "  ")], "task_id long, code string")
    writers.write_program_files(df, str(tmp_path / "p"))
    assert {p.name: p.read_text() for p in (tmp_path / "p").iterdir()} == {"program_001.py": "x = 1\n", "program_2222.py": "y\n"}
    writers.write_envelope(df, str(tmp_path / "e.json"), {"n": 3})
    assert len(__import__("json").load(open(tmp_path / "e.json"))["results"]) == 3
    assert writers.report_text(df.agg(F.count(F.lit(1)).alias("n"))) == "n: 3\n"
    with pytest.raises(ValueError):
        writers.write_envelope(df, str(tmp_path / "f.json"), {}, most=2)
    writers.write_partitioned(df.withColumn("repo", F.lit("a/b")), str(tmp_path / "r"), "repo")
    assert [p.name for p in (tmp_path / "r").iterdir() if p.is_dir()] == ["__part=a_b"]


def test_repositories_are_read_in_pages(tmp_path, monkeypatch):
    from quarrysift.sources import repos

    for i in range(7):
        (tmp_path / "a" / ("sub" if i % 2 else "")).mkdir(parents=True, exist_ok=True)
        (tmp_path / "a" / ("sub" if i % 2 else "") / f"m{i}.py").write_text(f"x = {i}")
    monkeypatch.setattr(repos, "PAGE_FILES", 3)
    reader = repos.RepoFiles({"root": str(tmp_path), "repos": "a,none"}).reader(None)
    pages = reader.partitions()
    assert [len(p.paths) for p in pages] == [3, 3, 1]
    assert [r[1] for p in pages for r in reader.read(p)] == ["m0.py", "m2.py", "m4.py", "m6.py", "sub/m1.py", "sub/m3.py", "sub/m5.py"]
    assert sum(len(p.paths) for p in repos.RepoFiles({"root": f"file://{tmp_path}", "repos": "a", "max_files": "2"}).reader(None).partitions()) == 2


def test_one_row_for_a_key(spark):
    """Ties, nulls and negative values of the order column; keys that only look alike."""
    rows = [("a", 1, "x"), ("a", 1, "x"), ("b", None, "y"), ("b", None, "yy"), ("c", -5, "long"), ("c", -3, "long"), ("c", None, "longest"), (None, 2, "n"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, seq int, t string")
    got = lambda **kw: {r.k: (r.seq, r.t) for r in curate.dedup_rows(df, ["k"], "seq", **kw).collect()}
    first = got()
    assert first.keys() == {"a", "b", "c", None} and curate.dedup_rows(df, ["k"], "seq").count() == 4
    assert (first["a"], first["c"], first[None]) == ((1, "x"), (-5, "long"), (1, "n")) and first["b"][0] is None
    assert got(prefer="last")["c"] == (-3, "long")
    longer = got(prefer="longer", field="t")
    assert (longer["a"], longer["b"], longer["c"]) == ((1, "x"), (None, "yy"), (None, "longest"))
    pair = spark.createDataFrame([("a§", "b", 1), ("a", "§b", 2), (None, "", 3), ("", "", 4)], "p string, q string, seq int")
    assert curate.dedup_rows(pair, ["p", "q"], "seq").count() == 4 and curate.dedup_rows(pair, ["p", "q"], "seq", joined=True).count() == 2


def test_index_of_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(curate, "RANGE_ROWS", 50)
    df = spark.range(400).selectExpr("id", "IF(id % 4 = 0, NULL, IF(id % 4 = 1, 7, id)) AS seq")
    rows = curate.with_index(df, "seq", ties=("id",)).collect()
    wanted = sorted(range(400), key=lambda i: (-1 if i % 4 == 0 else 7 if i % 4 == 1 else i, i))
    assert [r.id for r in sorted(rows, key=lambda r: r["index"])] == wanted and sorted(r["index"] for r in rows) == list(range(1, 401))
    assert sorted(r["index"] for r in curate.with_index(df.select("seq"), "seq").collect()) == list(range(1, 401))
    assert curate.with_index(df.where("false"), "seq").count() == 0


def test_diverse_is_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(f"r{rng.randint(0, 3)}" if rng.random() < 0.9 else None, f"f{rng.randint(0, rng.choice([3, 9]))}", i) for i in range(400)]
    kept, state = [], {}
    for repo, folder, i in rows:
        seen, taken = state.setdefault(repo, (set(), []))
        if not (len(taken) >= 10 and len(seen) >= 5 and folder in seen):
            seen.add(folder)
            taken.append(i)
            kept.append(i)
    got = curate.diverse(spark.createDataFrame(rows, "repo string, folder string, i int"), "repo", "folder", "i")
    assert sorted(r.i for r in got.collect()) == kept


def test_strip_is_python_s_and_linear(spark):
    texts = [" a\u00a0\x1c", "\u3000\x85b c\t", "", " \n", "x" + " " * 80_000 + "y "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r) for r in df.select(X.strip("t"), X.lstrip("t"), X.rstrip("t")).collect()] == [(t.strip(), t.lstrip(), t.rstrip()) for t in texts]
    began = time.perf_counter()
    spark.createDataFrame([("x" + " " * 400_000 + "y",)], "t string").select(F.length(X.content_hash(F.col("t"))), X.loc(F.col("t"))).collect()
    assert time.perf_counter() - began < 5


def test_prompts(tmp_path):
    from quarrysift.sources.prompts import load_prompts

    for name, text in (("s.txt", " be exact \n"), ("u.txt", "Specify:\n{code}\n"), ("v.txt", "other {code}")):
        (tmp_path / name).write_text(text)
    at = lambda n: str(tmp_path / n)
    assert load_prompts(at("s.txt"), f"file://{at('u.txt')}", {}) == ("be exact", "Specify:\n{code}\n")
    assert load_prompts(at("s.txt"), at("u.txt"), {"PROMPT_TEMPLATE": at("v.txt"), "USER_PROMPT_TEMPLATE": ""})[1] == "other {code}"
    with pytest.raises(FileNotFoundError):
        load_prompts(at("none.txt"), at("u.txt"), {})
