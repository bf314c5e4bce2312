"""Queries of the scalar, hashing, extraction and log operators over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrysift.functions import predicates as P
from quarrysift.functions import text as X
from quarrysift.operators import curate
from quarrysift.plans.registry import REPO, query, table, template
from quarrysift.session import spread

_HASH = r"sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(string_split(l, '#')[1], '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)))"
_RSTRIPPED = r"array_to_string(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10))"
_LIGHT = rf"regexp_replace(regexp_replace({_RSTRIPPED}, '^\s+|\s+$', '', 'g') || chr(10), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, {_HASH} AS content_hash FROM documents")
def content_hash(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, sha256({_LIGHT}) AS code_sha256 FROM documents")
def normalize_light_hash(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.light_hash(F.col("text")).alias("code_sha256"))


@query(f"SELECT doc_id, 'doc_' || doc_id || '.py::' || substr(sha1({_RSTRIPPED}), 1, 12) AS id FROM documents")
def short_hash_id(spark, d):
    return table(spark, d, "documents").select("doc_id", X.short_hash_id(F.expr("'doc_' || doc_id || '.py'"), F.col("text")).alias("id"))


@query("SELECT doc_id, md5(text) AS code_hash FROM documents")
def md5_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("code_hash"))


@query(f"SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, h AS content_hash FROM (SELECT *, {_HASH} AS h FROM documents) GROUP BY h")
def dedup_exact(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", X.content_hash(F.col("text")).alias("hash"))
    return curate.dedup_exact(docs, F.col("hash"), "doc_id").select("doc_id", "source", "content_hash")


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(trim(l), '#')))::BIGINT AS code_lines FROM documents")
def code_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.code_lines(F.col("text")).alias("code_lines"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))::BIGINT AS loc FROM documents")
def loc(spark, d):
    return table(spark, d, "documents").select("doc_id", X.loc(F.col("text")).alias("loc"))


_N_LINES = "len(string_split(text, chr(10)))"
SIZE_CLASS = f"CASE WHEN {_N_LINES} <= 15 THEN 'simple' WHEN {_N_LINES} <= 30 THEN 'medium' ELSE 'complex' END"


@query(f"SELECT doc_id, {SIZE_CLASS} AS size_class FROM documents")
def size_class(spark, d):
    return table(spark, d, "documents").select("doc_id", P.size_class(F.col("text")).alias("size_class"))


REPO_TYPE = (
    f"CASE WHEN regexp_matches(lower({REPO}), 'django|flask|fastapi|tornado|bottle|falcon') THEN 'web_frameworks' WHEN regexp_matches(lower({REPO}), 'pandas|numpy|scipy|matplotlib|plotly|sklearn') THEN 'data_science' "
    f"WHEN regexp_matches(lower({REPO}), 'garvit244|thealgorithms|kamyu104|leetcode|algorithms') THEN 'algorithms' WHEN regexp_matches(lower({REPO}), 'ansible|fabric|celery|docker|paramiko') THEN 'devops_tools' "
    f"WHEN regexp_matches(lower({REPO}), 'pytest|pylint|mypy|black|flake8') THEN 'testing_quality' WHEN regexp_matches(lower({REPO}), 'click|fire|playwright|requests|pillow') THEN 'utilities' ELSE 'other' END"
)


@query(f"SELECT doc_id, {REPO_TYPE} AS repo_type FROM documents")
def repo_type(spark, d):
    return table(spark, d, "documents").select("doc_id", P.repo_type(F.expr(REPO)).alias("repo_type"))


_FUNCTION = template("def f_{doc_id}(matrix: list) -> int:\n    # one\n    # two\n    # three\n    x = {n_chars}\n    return x\n")
_SOMETIMES = f"CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN {_FUNCTION} ELSE 'import os' || chr(10) || {_FUNCTION} END"
_DOCSTRING = "CASE WHEN doc_id % 2 = 0 THEN lang END"


@query(f"SELECT doc_id, c AS code FROM (SELECT doc_id, {_SOMETIMES} AS c FROM documents) WHERE length(c) BETWEEN 50 AND 3000 AND contains(c, 'def ') AND contains(c, 'return')")
def func_quality_filter(spark, d):
    code = F.col("code")
    return table(spark, d, "documents").selectExpr("doc_id", f"{_SOMETIMES} AS code").where(P.func_quality(code))


QUALITY = """(CASE WHEN n BETWEEN 50 AND 200 THEN 20 WHEN n BETWEEN 20 AND 300 THEN 10 ELSE 0 END + CASE WHEN coalesce(doc, '') <> '' THEN 15 ELSE 0 END
 + CASE WHEN contains(c, ':') AND contains(c, '->') THEN 15 ELSE 0 END
 + CASE WHEN regexp_matches(lower(c), 'algorithm|calculate|compute|solve|optimize|matrix|vector|graph|tree|sort|search') THEN 20 ELSE 0 END
 + CASE WHEN contains(c, 'def ') AND contains(c, 'return ') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(c, 'import requests|import urllib|import os|import sys|subprocess|multiprocessing|threading') THEN 0 ELSE 10 END
 + CASE WHEN length(c) - length(replace(c, '#', '')) >= 3 THEN 10 ELSE 0 END)::BIGINT"""


@query(f"SELECT doc_id, {QUALITY} AS quality_score FROM (SELECT *, len(string_split(c, chr(10))) AS n FROM (SELECT doc_id, {_SOMETIMES} AS c, {_DOCSTRING} AS doc FROM documents))")
def quality_score(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_SOMETIMES} AS code", f"{_DOCSTRING} AS doc")
    return docs.select("doc_id", P.quality_score(F.col("code"), F.col("doc")).alias("quality_score"))


@query(f"SELECT doc_id, score, repo FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, repo, {QUALITY} AS score FROM (SELECT *, len(string_split(c, chr(10))) AS n FROM (SELECT doc_id, {REPO} AS repo, {_SOMETIMES} AS c, {_DOCSTRING} AS doc FROM documents)))) WHERE r <= 7")
def topk_quality(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{REPO} AS repo", f"{_SOMETIMES} AS code", f"{_DOCSTRING} AS doc")
    scored = docs.select("doc_id", P.quality_score(F.col("code"), F.col("doc")).alias("score"), "repo")
    return curate.per_group_top(scored, "repo", [F.desc("score"), F.col("doc_id")], 7)


# ---- names ----------------------------------------------------------------------------------------------------------

_PATH = "'out/' || lang || '/Spec_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '_results.v2' WHEN doc_id % 3 = 1 THEN '-verified:x?' ELSE '' END || '.py'"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\.[^.]*$', ''), '[\\/*?:\"<>|]', '_', 'g') AS name FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def sanitize_filename(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sanitize_filename(F.expr(_PATH)).alias("name"))


@query(rf"SELECT doc_id, regexp_replace({_PATH}, '[\\/*?:\"<>|]', '_', 'g') AS name FROM documents")
def safe_path(spark, d):
    return table(spark, d, "documents").select("doc_id", X.safe_path(F.expr(_PATH)).alias("name"))


@query(r"SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9_]+', '_', 'g'), '_'), ''), 'func') AS name FROM documents")
def sanitize_name(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sanitize_name(F.col("text")).alias("name"))


_STEM = r"regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\.[^.]*$', '')"


@query(rf"SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace({_STEM}, '(?i)(verification|results|output|verified|specs?)', '', 'g'), '[_\-.]+', '_', 'g'), '_'), ''), regexp_extract(p, '([^/]*)$', 1)) AS transformation FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def infer_transformation(spark, d):
    return table(spark, d, "documents").select("doc_id", X.infer_transformation(F.expr(_PATH)).alias("transformation"))


_EXT = r"CASE WHEN regexp_matches(p, '\.[^./]*$') THEN regexp_extract(p, '(\.[^./]*)$', 1) ELSE '.py' END"
_PATH2 = "'in/prog_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END"


@query(f"SELECT doc_id, {_STEM} || '__' || lang || {_EXT} AS output_filename FROM (SELECT doc_id, lang, {_PATH2} AS p FROM documents)")
def label_output_name(spark, d):
    return table(spark, d, "documents").select("doc_id", X.label_output_name(F.expr(_PATH2), F.col("lang")).alias("output_filename"))


@query("SELECT event_id, CASE WHEN length(s) < 3 THEN lpad(s, 3, '0') ELSE s END AS name FROM (SELECT event_id, event_id::VARCHAR AS s FROM events)")
def zfill(spark, d):
    return table(spark, d, "events").select("event_id", X.zfill(F.col("event_id"), 3).alias("name"))


@query("SELECT doc_id, 'task_override' AS transformation_type FROM documents")
def transformation_override(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit("task_override").alias("transformation_type"))


# ---- durations, models, costs ---------------------------------------------------------------------------------------


@query(
    "SELECT event_id, CASE WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%dm %.1fs', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) "
    "ELSE printf('%dh %dm %.1fs', floor(s / 3600)::BIGINT, floor((s - floor(s / 3600) * 3600) / 60)::BIGINT, s - floor(s / 60) * 60) END AS short, "
    "printf('%dh %dm %.1fs', floor(s / 3600)::BIGINT, floor((s - floor(s / 3600) * 3600) / 60)::BIGINT, s - floor(s / 60) * 60) AS long FROM (SELECT event_id, (event_id % 9000)::DOUBLE AS s FROM events)"
)
def format_duration(spark, d):
    s = (F.col("event_id") % 9000).cast("double")
    return table(spark, d, "events").select("event_id", X.format_duration(s).alias("short"), X.format_duration_long(s).alias("long"))


_MODEL = "CASE event_id % 12 WHEN 0 THEN 'GPT-4.1' WHEN 1 THEN 'gpt-4_1-2025-04-14' WHEN 2 THEN 'gpt-4.1-mini' WHEN 3 THEN 'gpt-4.1-nano-x' WHEN 4 THEN 'gpt-4o-2024' WHEN 5 THEN 'gpt-4o-mini' WHEN 6 THEN ' gpt-4-turbo' WHEN 7 THEN 'gpt-4' WHEN 8 THEN 'gpt-5-mini' WHEN 9 THEN 'gpt-5' WHEN 10 THEN 'gpt3.5' ELSE 'llama-3' END"
_CANON = "CASE WHEN contains(m, 'gpt-4_1') OR contains(m, 'gpt-4.1') THEN CASE WHEN contains(m, 'mini') THEN 'gpt-4.1-mini' WHEN contains(m, 'nano') THEN 'gpt-4.1-nano' ELSE 'gpt-4.1' END WHEN contains(m, 'gpt-4o') THEN CASE WHEN contains(m, 'mini') THEN 'gpt-4o-mini' ELSE 'gpt-4o' END WHEN contains(m, 'gpt-4') THEN CASE WHEN contains(m, 'turbo') THEN 'gpt-4-turbo' ELSE 'gpt-4' END WHEN contains(m, 'gpt-5') THEN CASE WHEN contains(m, 'mini') THEN 'gpt-5-mini' WHEN contains(m, 'nano') THEN 'gpt-5-nano' ELSE 'gpt-5' END WHEN contains(m, 'gpt-3.5') OR contains(m, 'gpt3.5') THEN 'gpt-3.5-turbo' ELSE m END"


@query(f"SELECT event_id, {_CANON} AS model FROM (SELECT event_id, lower(trim({_MODEL})) AS m FROM events)")
def normalize_model_name(spark, d):
    return table(spark, d, "events").select("event_id", P.normalize_model_name(F.expr(_MODEL)).alias("model"))


@query(f"SELECT event_id, NOT contains(lower({_MODEL}), 'gpt-5') AS supported FROM events")
def supports_temperature(spark, d):
    return table(spark, d, "events").select("event_id", P.supports_temperature(F.expr(_MODEL)).alias("supported"))


@query(
    f"""WITH p AS (SELECT * FROM (VALUES ('gpt-4.1', 0.002::DOUBLE, 0.008::DOUBLE), ('gpt-4.1-mini', 0.0004, 0.0016), ('gpt-4.1-nano', 0.0001, 0.0004), ('gpt-4o', 0.0025, 0.01), ('gpt-4o-mini', 0.00015, 0.0006), ('gpt-4-turbo', 0.01, 0.03), ('gpt-4', 0.03, 0.06), ('gpt-5-mini', 0.00025, 0.002), ('gpt-5', 0.00125, 0.01), ('gpt-3.5-turbo', 0.0015, 0.002)) AS t(model, i, o))
    SELECT event_id, round(user_id / 1000.0::DOUBLE * coalesce(i, 0.01::DOUBLE) + event_id / 1000.0::DOUBLE * coalesce(o, 0.03::DOUBLE), 8) AS cost_usd FROM (SELECT event_id, user_id, {_CANON} AS model FROM (SELECT *, lower(trim({_MODEL})) AS m FROM events)) LEFT JOIN p USING (model)"""
)
def calculate_cost(spark, d):
    return table(spark, d, "events").select("event_id", F.round(P.calculate_cost(F.expr(_MODEL), F.col("user_id"), F.col("event_id")), 8).alias("cost_usd"))


@query("SELECT event_id, date_diff('day', DATE '2025-08-13', ts::DATE) > 30 AS is_old FROM events")
def pricing_age(spark, d):
    return table(spark, d, "events").select("event_id", P.pricing_is_old(F.col("ts").cast("date")).alias("is_old"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def timestamps(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyyMMdd_HHmmss").alias("stamp"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


_TEMPLATE = "'Code: {{code}} / {code}; text {text}; input {input}; {other}'"


@query(f"SELECT doc_id, replace(replace(replace(replace({_TEMPLATE}, '{{{{code}}}}', lang), '{{code}}', lang), '{{text}}', lang), '{{input}}', lang) AS prompt FROM documents")
def build_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", X.build_prompt(F.expr(_TEMPLATE), F.col("lang")).alias("prompt"))


# ---- fenced blocks --------------------------------------------------------------------------------------------------

#: Answers with one, two, other or no blocks, from conversations.
_ANSWER = (
    "CASE turn % 6 WHEN 0 THEN 'Here: ```dafny' || chr(10) || 'method M' || conv_id || '() { }' || chr(10) || '``` and ```Dafny ' || role || '```' "
    "WHEN 1 THEN '```' || chr(10) || '# head' || chr(10) || 'method **A**' || conv_id || chr(10) || '```' || chr(10) || '```python' || chr(10) || 'class P: pass' || chr(10) || '```' "
    "WHEN 2 THEN 'Look at module X' || conv_id || ' { *a* } then' WHEN 3 THEN '```python' || chr(10) || 'x = ' || turn || chr(10) || '```' "
    "WHEN 4 THEN '  no block, it requires care  ' ELSE 'nothing here' END"
)
_ANS = f"(SELECT conv_id, turn, {_ANSWER} AS a FROM conversations)"
_T = lambda e: rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


@query(
    rf"""SELECT conv_id, turn, CASE WHEN len(own) > 0 THEN array_to_string(list_transform(own, lambda b: {_T("b")}), chr(10) || chr(10))
    ELSE array_to_string(list_transform(list_filter(blocks, lambda b: NOT regexp_matches(b, '^(python|java|csharp)') AND regexp_matches(b, 'method|function|predicate|requires|ensures|class')), lambda b: {_T("b")}), chr(10) || chr(10)) END AS code
    FROM (SELECT conv_id, turn, regexp_extract_all(a, '(?s)```(?:dafny|Dafny)(.*?)```', 1) AS own, regexp_extract_all(a, '(?s)```(.*?)```', 1) AS blocks FROM {_ANS})"""
)
def extract_blocks(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.extract_blocks(F.expr(_ANSWER)).alias("code"))


_LONGEST = "list_reduce(list_prepend('', {0}), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
_CLEAN = lambda e: _T(rf"regexp_replace(regexp_replace(regexp_replace({_T(e)}, '(?m)^#.*$', '', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g')")


@query(
    rf"""SELECT conv_id, turn, CASE WHEN len(p1) > 0 THEN {_CLEAN(_LONGEST.format("p1"))} WHEN len(p2) > 0 THEN {_CLEAN(_LONGEST.format("p2"))} WHEN len(p3) > 0 THEN {_CLEAN(_LONGEST.format("p3"))}
    WHEN regexp_matches(a, 'module|method|function|requires|ensures') THEN {_T("a")} END AS code
    FROM (SELECT conv_id, turn, a, regexp_extract_all(a, '(?is)```dafny\s*\n(.*?)\n```', 1) AS p1, regexp_extract_all(a, '(?is)```\s*\n(.*?)\n```', 1) AS p2, regexp_extract_all(a, '(?is)module\s+\w+\s*\{{.*?\}}') AS p3 FROM {_ANS})"""
)
def extract_longest(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.extract_longest(F.expr(_ANSWER)).alias("code"))


@query(rf"SELECT conv_id, turn, CASE WHEN len(b) > 0 THEN {_T('b[1]')} ELSE {_T('a')} END AS code FROM (SELECT conv_id, turn, a, regexp_extract_all(a, '(?is)```(?:python|py)?\s*(.*?)```', 1) AS b FROM {_ANS})")
def extract_python_block(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.extract_python_block(F.expr(_ANSWER)).alias("code"))


_BROKEN = template("foreach x{doc_id} in s; sum i: int {:trigger f(i)} :: a; var g{doc_id} := new bool[n][m]; a[i][j] := {n_chars};") + " || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'ensures valid(x)' ELSE '' END"
_FIXED = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, 'foreach\s+(\w+)\s+in\s+', 'for \1 in ', 'g'), 'sum\s+(\w+):\s+int\s+\{:trigger\s+(.*?)\}\s+::', 'sum(\1: int | \2 :: ', 'g'), "
    r"'var\s+(\w+)\s*:=\s*new\s+bool\[(\w+)\]\[(\w+)\]', 'var \1 := new bool[\2, \3]', 'g'), '(\w+)\[(\w+)\]\[(\w+)\]', '\1[\2, \3]', 'g')"
)


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(f, 'ensures.*\w+\(.*\)|requires.*\w+\(.*\)') THEN '{X.WARNING}' || chr(10) || f || chr(10) || '{X.NOTE}' ELSE f END AS code FROM (SELECT doc_id, {_FIXED} AS f FROM (SELECT doc_id, {_BROKEN} AS c FROM documents))")
def fix_common_errors(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fix_common_errors(F.expr(_BROKEN)).alias("code"))


@query(f"SELECT doc_id, '{X.HEADER[0]}' || {_PATH} || chr(10) || '// Generated from ChatGPT spec with automatic syntax fixes' || chr(10) || chr(10) || lang AS code FROM documents")
def add_header(spark, d):
    return table(spark, d, "documents").select("doc_id", X.add_header(F.expr(_PATH), F.col("lang")).alias("code"))


# ---- logs -----------------------------------------------------------------------------------------------------------

#: A log line for each event, and logs of one user's lines.
LOG_LINE = (
    "CASE event_id % 8 WHEN 0 THEN 'f' || user_id || '.dfy(' || event_id || ',7): Error: a postcondition might not hold' WHEN 1 THEN 'g.dfy(3,' || user_id || '): some error text ' || event_type "
    "WHEN 2 THEN 'Error: undeclared ' || event_type WHEN 3 THEN 'f.dfy(1,2): Warning: odd' WHEN 4 THEN 'Warning: ' || event_type WHEN 5 THEN event_id % 5 || ' parse errors detected in f.dfy' "
    "WHEN 6 THEN 'Dafny program verifier finished with ' || user_id % 4 || ' verified, ' || event_id % 3 || ' errors' ELSE '   ' END"
)
_DETAIL = r"""CASE WHEN regexp_matches(l, '(?i)(.+?)\((\d+),(\d+)\):\s*Error:\s*(.+)') THEN {'type': 'parse_error', 'm': regexp_extract(l, '(?i)(.+?)\((\d+),(\d+)\):\s*Error:\s*(.+)', ['f', 'l', 'c', 'm'])}
WHEN regexp_matches(l, '(?i)(.+?)\((\d+),(\d+)\):\s*(.+?error.+)') THEN {'type': 'verification_error', 'm': regexp_extract(l, '(?i)(.+?)\((\d+),(\d+)\):\s*(.+?error.+)', ['f', 'l', 'c', 'm'])}
WHEN regexp_matches(l, '(?i)Error:\s*(.+)') THEN {'type': 'generic_error', 'm': {'f': NULL, 'l': NULL, 'c': NULL, 'm': regexp_extract(l, '(?i)Error:\s*(.+)', 1)}}
WHEN regexp_matches(l, '(?i)(.+?)\((\d+),(\d+)\):\s*Warning:\s*(.+)') THEN {'type': 'warning', 'm': regexp_extract(l, '(?i)(.+?)\((\d+),(\d+)\):\s*Warning:\s*(.+)', ['f', 'l', 'c', 'm'])}
WHEN regexp_matches(l, '(?i)Warning:\s*(.+)') THEN {'type': 'generic_warning', 'm': {'f': NULL, 'l': NULL, 'c': NULL, 'm': regexp_extract(l, '(?i)Warning:\s*(.+)', 1)}} END"""


@query(
    f"""SELECT user_id, n, x.type AS type, x.m.f AS file, x.m.l::BIGINT AS line, x.m.c::BIGINT AS col, trim(x.m.m) AS message, trim(l) AS raw_line FROM (
    SELECT user_id, n, l, {_DETAIL} AS x FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS n, {LOG_LINE} AS l FROM events)) WHERE x IS NOT NULL"""
)
def parse_log(spark, d):
    logs = table(spark, d, "events").selectExpr("user_id", "event_id", f"{LOG_LINE} AS l").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "l"))), lambda s: s["l"]), "\n").alias("log"))
    found = logs.select("user_id", F.explode(X.parse_log(F.col("log"))).alias("e"))
    return found.select("user_id", "e.n", "e.d.type", "e.d.file", "e.d.line", F.col("e.d.column").alias("col"), "e.d.message", "e.raw_line")


@query(f"SELECT event_id, (regexp_extract(l, '(\\d+)', 1)::BIGINT)::VARCHAR || ' parse errors detected' AS message FROM (SELECT event_id, {LOG_LINE} AS l FROM events) WHERE contains(l, 'parse errors detected')")
def count_messages(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(X.count_messages(F.expr(LOG_LINE))).alias("message"))


@query(f"SELECT event_id, user_id % 3 = 0 AND (contains(lower(l), 'verified') OR contains(l, '0 errors')) AS verified FROM (SELECT *, {LOG_LINE} AS l FROM events)")
def verified_flag(spark, d):
    return table(spark, d, "events").select("event_id", X.verified_flag(F.col("user_id") % 3, F.expr(LOG_LINE)).alias("verified"))


@query(f"SELECT event_id, contains(l, 'Dafny program verifier finished with') AND user_id % 4 > 0 AND event_id % 3 = 0 AS verified FROM (SELECT *, {LOG_LINE} AS l FROM events)")
def verified_flag_strict(spark, d):
    return table(spark, d, "events").select("event_id", X.verified_strict(F.expr(LOG_LINE)).alias("verified"))


@query("SELECT event_id, event_id % 4 > 0 AND user_id % 3 = 0 AS compiled FROM events")
def compilation_flag(spark, d):
    return table(spark, d, "events").select("event_id", X.compilation_flag(F.col("user_id") % 3, F.expr(LOG_LINE), F.when(F.col("event_id") % 4 > 0, 0).otherwise(1)).alias("compiled"))


#: A message for each event, one of each category and one of none.
MESSAGE = (
    "CASE event_id % 9 WHEN 0 THEN 'A postcondition might not hold at line ' || user_id WHEN 1 THEN 'unexpected token \"' || event_type || '\" in /tmp/a/' || user_id WHEN 2 THEN 'undeclared identifier x' || user_id % 7 "
    "WHEN 3 THEN 'a ghost variable is not allowed here, col 12' WHEN 4 THEN 'nondeterministic if forbidden' WHEN 5 THEN 'this cannot be compiled' WHEN 6 THEN 'unknown option ' || user_id % 5 WHEN 7 THEN 'a  b 12:34' ELSE 'all is   well' END"
)


def _normal(e: str) -> str:
    out = rf"lower(regexp_replace({e}, '^\s+|\s+$', '', 'g'))"
    for pattern, to in X.MESSAGE_REWRITES:
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return out


def _category(m: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({m}, '(?i)" + "|".join(f"(?:{p})" for p in patterns) + f"') THEN '{name}'" for name, patterns in X.MESSAGE_RULES)
    return f"CASE {cases} ELSE 'Other' END"


@query(f"SELECT event_id, {_normal(MESSAGE)} AS message FROM events")
def normalize_message(spark, d):
    return table(spark, d, "events").select("event_id", X.normalize_message(F.expr(MESSAGE)).alias("message"))


CATEGORIZED = f"(SELECT event_id, {_category('m')} AS category FROM (SELECT event_id, {_normal(MESSAGE)} AS m FROM events))"


@query(f"SELECT event_id, category FROM {CATEGORIZED}")
def categorize_message(spark, d):
    return spread(table(spark, d, "events").select("event_id", F.expr(MESSAGE).alias("message"))).select("event_id", X.categorize_message(F.col("message")).alias("category"))


@query(f"SELECT event_id, CASE category WHEN 'Verification' THEN 'Critical' WHEN 'Parser' THEN 'High' WHEN 'Name/Type Resolution' THEN 'High' WHEN 'Compilation' THEN 'High' WHEN 'Ghost/Spec Context' THEN 'Medium' WHEN 'Determinism' THEN 'Medium' ELSE 'Low' END AS severity FROM {CATEGORIZED}")
def severity(spark, d):
    return table(spark, d, "events").select("event_id", X.severity(X.categorize_message(F.expr(MESSAGE))).alias("severity"))


@query("SELECT doc_id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))::BIGINT AS n, regexp_replace('  ' || text || ' ', '^\\s+|\\s+$', '', 'g') AS stripped, lower(text) AS low FROM documents")
def splitlines(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.size(X.split_lines(F.col("text"))).cast("long").alias("n"), X.strip(F.concat(F.lit("  "), F.col("text"), F.lit(" "))).alias("stripped"), F.lower("text").alias("low"))


@query("SELECT event_id, round(value, 2) AS rounded, printf('%.1f%%', round(value, 1)) AS percent FROM events WHERE value IS NOT NULL")
def rounding(spark, d):
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", F.round("value", 2).alias("rounded"), F.format_string("%.1f%%", F.round("value", 1)).alias("percent"))
