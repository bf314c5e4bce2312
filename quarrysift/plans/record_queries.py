"""Queries over records of unknown shape: VARIANT on one side, JSON functions on the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrysift.functions import predicates as P
from quarrysift.functions.text import strip
from quarrysift.plans.registry import query, table

#: A JSON record for each event; its fields come and go.
RECORD = (
    "CASE event_id % 8 WHEN 0 THEN '{\"verified\": \"Yes\", \"file_path\": \"a' || user_id || '.py\"}' WHEN 1 THEN '{\"verified\": 0, \"meta\": {\"task_id\": \"t' || user_id || '\"}}' "
    "WHEN 2 THEN '{\"verification\": {\"status\": \" Verified \"}, \"metadata\": {\"filename\": \"m.py\"}}' WHEN 3 THEN '{\"status\": \"failed\", \"verified_count\": ' || user_id % 3 || '}' "
    "WHEN 4 THEN '{\"verifier_status\": \"OK\", \"text\": \"  \", \"code\": \" c' || user_id || ' \"}' WHEN 5 THEN '{\"specification\": \"\", \"dafny_code\": \"d\", \"type\": \"x\", \"result\": {\"content\": \"inner' || user_id || '\"}}' "
    "WHEN 6 THEN '{\"program_specification\": \"p\", \"transformation\": \"tt\", \"program\": {\"program_id\": \"9\"}, \"verifies\": true}' ELSE '{\"is_verified\": \"maybe\", \"text\": \"T' || user_id || '\", \"result\": \"flat\"}' END"
)


def records(spark, d, *columns):
    return table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", f"parse_json({RECORD}) AS r", f"{RECORD} AS j", *columns)


def _s(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


_SRC = f"(SELECT event_id, user_id, event_type, {RECORD} AS j FROM events)"
_WORDS = "('true','1','yes','y','ok','passed','pass','success','succeeded','verified','verifies')"
_STATUS = "('verified','success','passed','ok','true')"
_FLAGS = " OR ".join(f"coalesce(lower(trim({_s(k)})) IN {_WORDS}, false)" for k in P.FLAG_FIELDS)
_SAID = " OR ".join(f"coalesce(lower(trim({_s(k)})) IN {_STATUS}, false)" for k in ["verification.status", *P.STATUS_FIELDS])
_VERIFIED = f"({_FLAGS} OR {_SAID} OR coalesce(try_cast({_s('verified_count')} AS BIGINT) > 0, false))"


@query(f"SELECT event_id, CASE WHEN v IN {_WORDS} THEN true WHEN v IN ('false','0','no','n','fail','failed','error') THEN false WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN try_cast(v AS DOUBLE) <> 0 END AS flag FROM (SELECT event_id, lower(trim(CASE event_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FAILED' WHEN 2 THEN '0.0' WHEN 3 THEN '17' WHEN 4 THEN 'perhaps' END)) AS v FROM events)")
def to_boolish(spark, d):
    v = F.expr("CASE event_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FAILED' WHEN 2 THEN '0.0' WHEN 3 THEN '17' WHEN 4 THEN 'perhaps' END")
    return table(spark, d, "events").select("event_id", P.to_boolish(v).alias("flag"))


@query(f"SELECT event_id, {_VERIFIED} AS verified, coalesce(lower(trim({_s('status')})) = 'failed', false) AS forced FROM {_SRC}")
def record_verified(spark, d):
    r = F.col("r")
    return records(spark, d).select("event_id", P.record_verified(r).alias("verified"), P.record_verified(r, "status", "failed").alias("forced"))


@query(f"SELECT event_id FROM {_SRC} WHERE {_VERIFIED}")
def filter_verified(spark, d):
    return records(spark, d).where(P.record_verified(F.col("r"))).select("event_id")


@query(f"SELECT event_id FROM {_SRC} WHERE NOT {_VERIFIED}")
def filter_rejected(spark, d):
    return records(spark, d).where(~P.record_verified(F.col("r"))).select("event_id")


@query(f"SELECT event_id, coalesce({_s('verification.status')}, {_s('result.content')}, 'none') AS value FROM {_SRC}")
def nested_get(spark, d):
    r = F.col("r")
    return records(spark, d).select("event_id", F.coalesce(P.field(r, "verification.status"), P.field(r, "result.content"), F.lit("none")).alias("value"))


_ALTERNATES = ["specification", "dafny", "dafny_code", "program", "code", "text"]


def _first_text(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' AND trim({_s(k)}) <> '' THEN {_s(k)} END" for k in keys) + ")"


def _texts(r, keys):
    """Fields that are texts; a field that holds an object or a number is none."""
    return [F.when(F.expr(f"schema_of_variant(try_variant_get(r, '$.{k}', 'variant'))") == "STRING", P.field(r, k)) for k in keys]


@query(f"SELECT event_id, {_first_text(['regenerated', *_ALTERNATES])} AS text FROM {_SRC}")
def choose_text(spark, d):
    return records(spark, d).select("event_id", P.first_text(*_texts(F.col("r"), ["regenerated", *_ALTERNATES])).alias("text"))


@query(f"SELECT event_id, trim({_first_text(['input_text', 'code', 'original_spec', 'specification', 'dafny_code', 'text'])}) AS code FROM {_SRC}")
def pick_code_field(spark, d):
    return records(spark, d).select("event_id", strip(P.first_text(*_texts(F.col("r"), ["input_text", "code", "original_spec", "specification", "dafny_code", "text"]))).alias("code"))


_SPEC = ["program_specification", "dafny_specification", "specification", "content", "code"]
_INNER = ["program_specification", "dafny_specification", "specification", "content"]


def _present(keys: list[str], prefix: str = "") -> str:
    return "coalesce(" + ", ".join(_s(prefix + k) for k in keys) + ")"


@query(f"SELECT event_id, coalesce(nullif({_present(_SPEC)}, ''), {_present(_INNER, 'result.')}, CASE WHEN json_type(j, '$.result') = 'VARCHAR' THEN {_s('result')} END, '') AS spec FROM {_SRC}")
def pick_spec_text(spark, d):
    """The first key that is there, even if empty; where that is empty, the nested result."""
    r = F.col("r")
    own = F.coalesce(*[P.field(r, k) for k in _SPEC])
    inner = F.coalesce(*[P.field(r, "result." + k) for k in _INNER], *_texts(r, ["result"]))
    return records(spark, d).select("event_id", F.coalesce(F.nullif(own, F.lit("")), inner, F.lit("")).alias("spec"))


@query(
    f"""SELECT event_id, coalesce({_s("file_path")}, {_s("filename")}, {_s("source_file")}, 'program_' || CASE WHEN event_id < 100 THEN lpad(event_id::VARCHAR, 3, '0') ELSE event_id::VARCHAR END || '.py') AS file_path,
    coalesce({_s("task_id")}, {_s("specification_index")}, event_id::VARCHAR) AS task_id, coalesce({_s("type")}, {_s("transformation")}, 'unknown') AS transformation_type FROM {_SRC}"""
)
def coalesce_identity(spark, d):
    from quarrysift.functions.text import zfill

    f = lambda k: P.field(F.col("r"), k)
    return records(spark, d).select(
        "event_id",
        F.coalesce(f("file_path"), f("filename"), f("source_file"), F.concat(F.lit("program_"), zfill(F.col("event_id"), 3), F.lit(".py"))).alias("file_path"),
        F.coalesce(f("task_id"), f("specification_index"), F.col("event_id").cast("string")).alias("task_id"),
        F.coalesce(f("type"), f("transformation"), F.lit("unknown")).alias("transformation_type"),
    )


@query(
    "SELECT event_id, "
    + ", ".join(f"coalesce({_s(k)}, {_s('meta.' + k)}, {_s('metadata.' + k)}, {_s('program.' + k)}) AS {k}" for k in P.IDENTITY_KEYS)
    + f", coalesce({_s('transformation')}, event_type) AS transformation, 'in.json' AS source_json FROM {_SRC}"
)
def normalize_record(spark, d):
    f = lambda k: P.field(F.col("r"), k)
    lifted = [F.coalesce(*[f(p + k) for p in ("", "meta.", "metadata.", "program.")]).alias(k) for k in P.IDENTITY_KEYS]
    return records(spark, d).select("event_id", *lifted, F.coalesce(f("transformation"), F.col("event_type")).alias("transformation"), F.lit("in.json").alias("source_json"))


@query("SELECT 'p' || event_id AS file_path, event_type AS transformation, user_id, value FROM events")
def select_fields(spark, d):
    """The wanted fields, and the identity fields and transformation that the rows have."""
    rows = table(spark, d, "events").selectExpr("'p' || event_id AS file_path", "event_type AS transformation", "user_id", "value", "ts")
    wanted = {"user_id", "value", *P.IDENTITY_KEYS, "transformation"}
    return rows.select(*[c for c in rows.columns if c in wanted])


@query("SELECT page_id FROM pages WHERE contains(url, 'example.com') OR contains(html, 'example.com')")
def filter_by_pattern(spark, d):
    return table(spark, d, "pages").where(P.matches_pattern("*example.com*", F.col("url"), F.col("html"))).select("page_id")


@query("SELECT event_id, code FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'x' || event_id END AS code FROM events) WHERE trim(code) <> ''")
def skip_empty(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'x' || event_id END AS code")
    return rows.where(strip(F.col("code")) != "")
