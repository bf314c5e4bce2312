"""Queries of the sources, sinks, reports, verification and streaming operators. Files go to a scratch folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrysift.functions import text as X
from quarrysift.operators import metrics
from quarrysift.plans.registry import query, table
from quarrysift.scratch import shared_folder
from quarrysift.sources import providers, records, writers
from quarrysift.streaming import incremental


#: The columns of the table that the report shows.
LABELS = ["doc_id", "quality", "toxic"]


def scratch(spark) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/quarrysift/{uuid.uuid4().hex}"


_SHAPE = (
    "CASE event_id % 9 WHEN 0 THEN '[{\"a\": ' || event_id || '}, {\"a\": 2}]' WHEN 1 THEN '{\"data\": [{\"a\": ' || event_id || '}]}' WHEN 2 THEN '{\"programs\": [{\"a\": 5}], \"data\": [{\"a\": ' || event_id || '}]}' WHEN 3 THEN '{\"results\": [{\"a\": ' || event_id || '}, {\"a\": 7}]}' "
    "WHEN 4 THEN '{\"x\": {\"a\": ' || event_id || '}, \"y\": {\"a\": 8}}' WHEN 5 THEN '{\"items\": [{\"a\": ' || event_id || '}]}' WHEN 6 THEN '{\"zz\": [{\"a\": ' || event_id || '}], \"n\": 1}' WHEN 7 THEN '{\"a\": ' || event_id || '}' ELSE '{\"specifications\": [{\"a\": ' || event_id || '}]}' END"
)


@query(
    "SELECT event_id, position, a FROM (SELECT event_id, unnest(CASE event_id % 9 WHEN 0 THEN [event_id, 2] WHEN 3 THEN [event_id, 7] WHEN 4 THEN [event_id, 8] ELSE [event_id] END) AS a, generate_subscripts(CASE event_id % 9 WHEN 0 THEN [event_id, 2] WHEN 3 THEN [event_id, 7] WHEN 4 THEN [event_id, 8] ELSE [event_id] END, 1) - 1 AS position FROM events)"
)
def load_any_json(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", f"parse_json({_SHAPE}) AS j")
    return records.explode_records(rows, "j").select("event_id", F.col("position").cast("long").alias("position"), F.try_variant_get("record", "$.a", "bigint").alias("a"))


@query("SELECT doc_id, lang, source FROM documents")
def load_jsonl(spark, d):
    path = scratch(spark)
    table(spark, d, "documents").select("doc_id", "lang", "source").write.json(path)
    return records.load_jsonl(spark, path, "doc_id long, lang string, source string")


@query("SELECT position, doc_id, lang FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, lang FROM documents)")
def load_json_file(spark, d):
    """All documents in one file, which the loader parses in one task."""
    path = scratch(spark)
    table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").coalesce(1).write.json(path)
    rows = records.load_records(spark, path)
    return rows.select(F.col("position").cast("long").alias("position"), F.try_variant_get("record", "$.doc_id", "bigint").alias("doc_id"), F.try_variant_get("record", "$.lang", "string").alias("lang"))


@query("SELECT source || '.py' AS base, max(doc_id) AS seq, arg_max(lang, doc_id) AS function FROM documents GROUP BY 1")
def load_manifest(spark, d):
    path = scratch(spark)
    table(spark, d, "documents").selectExpr("doc_id AS seq", "'out/' || source || '.py' AS out_path", "lang AS function").write.json(path)
    return records.load_manifest(spark, path, "seq long, out_path string, function string", "seq").select("base", "seq", "function")


def _folder(spark, d):
    """A folder of programs: a file for each document, one in a subfolder, one that a scan prunes."""
    root = f"{scratch(spark)}/programs"
    fixed = spark.createDataFrame([("sub/q.py", "x"), ("venv/lib/r.py", "y")], "path string, text string")
    writers.write_texts(table(spark, d, "documents").selectExpr("'p' || doc_id || '.py' AS path", "lang AS text").unionByName(fixed), root)
    return records.scan_programs(spark, root)


@query("SELECT doc_id::VARCHAR AS task_id, 'p' || doc_id || '.py' AS filename, lang AS code FROM documents UNION ALL SELECT 'sub_q.py', 'q.py', 'x'")
def scan_py_dir(spark, d):
    return _folder(spark, d).where("relative_path NOT LIKE '%venv%'").select("task_id", "filename", "code")


@query("SELECT 'p' || doc_id || '.py' AS relative_path FROM documents UNION ALL SELECT 'sub/q.py'")
def scan_pruned_dirs(spark, d):
    return records.pruned(_folder(spark, d)).select("relative_path")


_TREE = "CASE doc_id % 5 WHEN 0 THEN 'src/a' || doc_id || '.py' WHEN 1 THEN 'Tests/unit/t' || doc_id || '.py' WHEN 2 THEN 'pkg/examples_x/e.py' WHEN 3 THEN 'top' || doc_id || '.py' ELSE 'lib/core/m' || doc_id || '.py' END"


@query(f"SELECT doc_id, p AS relative_path FROM (SELECT doc_id, {_TREE} AS p FROM documents) WHERE doc_id % 5 IN (0, 3, 4)")
def scan_repo_filtered(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_TREE} AS relative_path")
    return records.skip_words(rows)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def scan_repo_resume(spark, d):
    return records.resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents")
def write_json(spark, d):
    path = scratch(spark)
    writers.write_json(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path)
    return spark.read.schema("doc_id long, lang string, n_chars long").json(path)


@query("SELECT doc_id, lang, NULL::VARCHAR AS missing FROM documents")
def write_csv(spark, d):
    path = scratch(spark)
    writers.write_csv(table(spark, d, "documents"), path, ["doc_id", "lang", "missing"])
    return spark.read.option("header", True).schema("doc_id long, lang string, missing string").csv(path)


@query("SELECT doc_id::VARCHAR AS id, lang, NULL::BIGINT AS total_programs FROM documents UNION ALL SELECT 'SUMMARY', NULL, count(*) FROM documents")
def write_csv_summary(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "lang")
    return writers.with_summary(rows, docs.agg(F.lit("SUMMARY").alias("id"), F.count(F.lit(1)).alias("total_programs")))


@query("SELECT 'program_' || CASE WHEN length(doc_id::VARCHAR) < 3 THEN lpad(doc_id::VARCHAR, 3, '0') ELSE doc_id::VARCHAR END || '.py' AS filename, 'x = ' || doc_id || chr(10) AS text FROM documents WHERE doc_id % 4 > 0")
def write_py_files(spark, d):
    return writers.program_files(table(spark, d, "documents").selectExpr("doc_id AS task_id", "CASE WHEN doc_id % 4 > 0 THEN ' x = ' || doc_id || chr(10) ELSE '  ' END AS code"))


@query("SELECT doc_id, 'org_' || source AS part FROM documents")
def write_per_repo(spark, d):
    path = scratch(spark)
    writers.write_partitioned(table(spark, d, "documents").select("doc_id", F.concat(F.lit("org/"), F.col("source")).alias("repo")), path, "repo")
    return spark.read.json(path).select("doc_id", F.col("__part").alias("part"))


@query("SELECT doc_id, lang AS source_json FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def write_split_per_input(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("source_json")).join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id")
    writers.write_partitioned(rows, path, "source_json")
    return spark.read.json(path).select("doc_id", "source_json")


@query("SELECT 'total: ' || count(*) || chr(10) || 'success: ' || count_if(quality = 1) || chr(10) AS report FROM labels")
def report_text(spark, d):
    summary = table(spark, d, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("success"))
    return spark.createDataFrame([(writers.report_text(summary),)], "report string")


_PAGE = "'<html><head><title>' || {0} || '</title></head><body>' || {1} || '</body></html>'"
_CELL = "coalesce({0}::VARCHAR, 'None')"
_FIELDS = " || ".join(f"'<tr><th>{c}</th><td>' || {_CELL.format(c)} || '</td></tr>'" for c in LABELS)
_ROW = "'<tr>' || " + " || ".join(f"'<td>' || {_CELL.format(c)} || '</td>'" for c in LABELS) + " || '<td><a href=\"../detail/' || doc_id || '.html\">page</a></td></tr>'"
_HEAD = "".join(f"<th>{c}</th>" for c in LABELS)
_DETAIL_PAGE = _PAGE.format("doc_id", f"'<a href=\"../index.html\">index</a><table>' || {_FIELDS} || '</table>'")
_PART_PAGE = _PAGE.format("'results'", f"'<table><tr>{_HEAD}<th></th></tr>' || string_agg({_ROW}, '' ORDER BY doc_id) || '</table>'")
_INDEX_PAGE = _PAGE.format("'report'", "'<pre>total: ' || (SELECT count(*) FROM labels) || chr(10) || '</pre><ul>' || coalesce(string_agg('<li><a href=\"' || path || '\">' || replace(path, 'parts/', '') || '</a></li>', '' ORDER BY path), '') || '</ul>'")


@query(f"""WITH p AS (SELECT 'parts/' || lpad(part::VARCHAR, 6, '0') || '.html' AS path, {_PART_PAGE} AS page FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS part FROM labels) GROUP BY part)
SELECT 'detail/' || doc_id || '.html' AS path, {_DETAIL_PAGE} AS page FROM labels UNION ALL SELECT * FROM p UNION ALL SELECT 'index.html', {_INDEX_PAGE} FROM p""")
def report_html(spark, d):
    """All pages of the report: the index, its parts with all labels, and a page for each label."""
    labels, root = table(spark, d, "labels").select(LABELS), f"{scratch(spark)}/report"
    writers.write_report(labels.agg(F.count(F.lit(1)).alias("total")), labels, "doc_id", root)
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), "/report/(.*)$", 1).alias("path"), F.col("value").alias("page"))


@query("SELECT CASE doc_id % 2 WHEN 0 THEN 'ok' ELSE 'failed' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def run_verifier(spark, d):
    """Programs through the stand-in verifier, its logs through the log rules."""
    rows = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'x = ' || doc_id ELSE 'x = = 1' END AS code")
    verifier = providers.SyntaxVerifier()

    def run(batches):
        for b in batches:
            found = verifier.verify(list(b["code"]))
            yield b.assign(exit_code=[c for c, _ in found], output=[o for _, o in found])

    logs = rows.mapInPandas(run, "doc_id long, code string, exit_code int, output string")
    ok = X.verified_flag(F.col("exit_code"), F.col("output")) & X.verified_strict(F.col("output"))
    return logs.groupBy(F.when(ok, "ok").otherwise("failed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'Verification' ELSE 'Parser' END AS category FROM events) GROUP BY 1")
def charts(spark, d):
    """The numbers behind the charts; drawing them is left to plotting tools."""
    rows = table(spark, d, "events").select(X.categorize_message(F.when(F.col("event_id") % 2 == 0, "a postcondition might not hold").otherwise("unexpected end")).alias("category"))
    return metrics.category_counts(rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))).where("n > 0").select("category", "n")


def _stream(spark, d):
    path = scratch(spark)
    table(spark, d, "documents").select("doc_id", "text").repartition(4).write.parquet(path)
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT count(DISTINCT array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(string_split(l, '#')[1])), lambda l: l <> ''), chr(10))) AS programs FROM documents")
def stream_distinct_programs(spark, d):
    out = scratch(spark)
    incremental.collect_once(incremental.distinct_programs(_stream(spark, d)).select("content_hash"), f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").agg(F.count(F.lit(1)).alias("programs"))


@query("SELECT 4::BIGINT AS batches, count(DISTINCT array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(string_split(l, '#')[1])), lambda l: l <> ''), chr(10))) AS added FROM documents")
def execute_batch(spark, d):
    out = scratch(spark)
    incremental.run_batches(_stream(spark, d), spark, f"{out}/index", f"{out}/log", f"{out}/checkpoint", "doc_id")
    log = spark.read.schema("batch_id long, status string, added long").json(f"{out}/log").where("status = 'completed'")
    return log.agg(F.count(F.lit(1)).alias("batches"), F.sum("added").alias("added"))


_REPO_FILE = "'r' || doc_id % 2 AS repo, CASE doc_id % 3 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/' ELSE '' END || 'm' || doc_id || '.py' AS file_path"


def _repos(spark, d, most: int):
    """Two repositories, whose files are made from all documents and written by the executors, read by the data source."""
    from quarrysift.sources import repos

    root = f"{scratch(spark)}/repos"
    writers.write_texts(table(spark, d, "documents").selectExpr("'r' || doc_id % 2 || CASE doc_id % 3 WHEN 0 THEN '/tests/m' WHEN 1 THEN '/src/m' ELSE '/m' END || doc_id || '.py' AS path", "lang AS text"), root)
    repos.register(spark)
    return spark.read.format("repo_files").option("root", root).option("repos", "r0,r1").option("max_files", str(most)).load()


#: More files than any repository has.
_ALL = 2**62


@query(f"SELECT {_REPO_FILE}, lang AS code FROM documents")
def scan_repo_tree(spark, d):
    return _repos(spark, d, _ALL).select("repo", "file_path", "code")


@query(f"SELECT repo, file_path FROM (SELECT {_REPO_FILE} FROM documents) WHERE NOT starts_with(file_path, 'tests/')")
def scan_git_clone(spark, d):
    return records.without_tests(_repos(spark, d, _ALL), "file_path").select("repo", "file_path")
