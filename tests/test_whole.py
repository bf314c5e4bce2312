"""Queries over whole tables: what they read grows with the input."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.catalog.QUERIES


def count(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").count()


def test_all_documents_are_loaded_and_scanned(spark):
    n = count(spark, "documents")
    assert {q: QUERIES[q](spark, SF).count() for q in ("load_json_file", "scan_py_dir", "scan_pruned_dirs", "scan_repo_tree")} == {"load_json_file": n, "scan_py_dir": n + 1, "scan_pruned_dirs": n + 1, "scan_repo_tree": n}


def test_all_rows_are_exported_and_counted(spark):
    n = count(spark, "events")
    total = lambda q: QUERIES[q](spark, SF).groupBy().sum("n").first()[0]
    assert QUERIES["build_from_cache"](spark, SF).count() == n
    assert [total(q) for q in ("export_session", "category_counts", "severity_counts")] == [n, n, n]


def test_known_side_is_a_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id", "left_semi").select("doc_id")
    assert QUERIES["add_program"](spark, SF).join(known, "doc_id").count() == known.count()
    assert QUERIES["anti_duplicate"](spark, SF).join(known, "doc_id").count() == 0
    assert QUERIES["migrate_legacy"](spark, SF).count() == docs.count()


def test_report_has_all_rows(spark):
    labels = {str(r.doc_id) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pages = {r.path: r.page for r in QUERIES["report_html"](spark, SF).collect()}
    assert {p for p in pages if p.startswith("detail/")} == {f"detail/{i}.html" for i in labels} and "index.html" in pages
    parts = [p for p in pages if p.startswith("parts/")]
    assert sum(pages[p].count("<tr><td>") for p in parts) == len(labels) and all(p in pages["index.html"] for p in parts)


def test_whole_texts_are_seen(spark):
    longest = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("max(length(trim(text)))").first()[0]
    assert QUERIES["build_regen_input"](spark, SF).selectExpr("max(length(trim(code)))").first()[0] == longest
    assert QUERIES["splitlines"](spark, SF).selectExpr("max(length(trim(low)))").first()[0] == longest
    assert QUERIES["sanitize_name"](spark, SF).selectExpr("max(length(name))").first()[0] > 40
