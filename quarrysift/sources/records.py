"""Sources: JSON containers of any shape, JSON lines, manifests, folders of programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrysift.functions.text import basename

#: Keys under which a container may hold its records, in order.
CONTAINER_KEYS = ["results", "data", "programs", "items", "specifications", "entries", "cases"]


def records_of(container: Column, keys: list[str] = tuple(CONTAINER_KEYS)) -> Column:
    """The records, as an array of VARIANT, of a VARIANT container.

    A list as it is; an object's first given key that holds a list; an object of objects, its values; an object with some
    list, the first one by name; any other object, itself.
    """
    as_list = lambda path: F.try_variant_get(container, path, "array<variant>")
    fields = F.map_values(F.try_variant_get(container, "$", "map<string,variant>"))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    lists = F.filter(fields, lambda v: F.schema_of_variant(v).startswith("ARRAY"))
    return F.coalesce(
        as_list("$"),
        *[as_list(f"$.{k}") for k in keys],
        F.when((F.size(fields) > 0) & F.forall(fields, is_object), fields),
        F.when(F.size(lists) > 0, F.try_variant_get(F.get(lists, F.lit(0)), "$", "array<variant>")),
        F.when(container.isNotNull(), F.array(container)),
    )


def explode_records(df: DataFrame, container: str, keys: list[str] = tuple(CONTAINER_KEYS)) -> DataFrame:
    """df's other columns with position (from 0) and record of each record of a VARIANT column."""
    others = [c for c in df.columns if c != container]
    return df.select(*others, F.posexplode(records_of(F.col(container), keys)).alias("position", "record"))


def load_records(spark: SparkSession, path: str, keys: list[str] = tuple(CONTAINER_KEYS)) -> DataFrame:
    """source_json, position, record of JSON files of any container shape. A text that isn't one JSON value is read as lines.

    A file is parsed whole, in one task, as its shape is only known then; files that are no JSON at all give no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_json"), F.col("value"))
    whole = F.try_parse_json("value")
    texts = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    lines = F.filter(F.transform(texts, lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    # Several lines of which the first is a value of its own: JSON lines. The parser alone would stop after that value.
    several = (F.size(texts) > 1) & F.try_parse_json(F.get(texts, F.lit(0))).isNotNull()
    records = F.when(several | whole.isNull(), lines).otherwise(records_of(whole, keys))
    return files.select("source_json", F.posexplode(records).alias("position", "record"))


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a known schema; bad lines go. Files are split, so large ones are read by many tasks."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def load_manifest(spark: SparkSession, path: str, schema: str, seq: str) -> DataFrame:
    """A manifest's last entry for each file name, by an order column."""
    rows = load_jsonl(spark, path, schema).withColumn("base", basename(F.col("out_path")))
    return rows.groupBy("base").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "base"]), seq).alias("m")).select("base", "m.*")


def task_id_of(relative: Column) -> Column:
    """The digits of a path, or the path with _ for its separators."""
    return F.coalesce(F.nullif(F.regexp_replace(relative, "[^0-9]", ""), F.lit("")), F.regexp_replace(relative, r"[/\\]", "_"))


#: Folders that a scan of a local tree passes over.
PRUNED = ["__pycache__", ".git", ".venv", "venv", ".mypy_cache", ".pytest_cache"]
#: Words of folders that a scan of a repository passes over, and those of its earlier form.
SKIPPED_WORDS = ["test", "tests", "docs", "doc", "examples", "example", "vendor", "node_modules", "__pycache__", ".git"]
SKIPPED_WORDS_V1 = ["test", "docs", "example", "vendor"]


def scan_programs(spark: SparkSession, root: str) -> DataFrame:
    """task_id, filename, code of each .py file under a folder, one row for a file."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
    path = F.col("_metadata.file_path")
    relative = F.regexp_replace(path, r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(task_id_of(relative).alias("task_id"), basename(path).alias("filename"), relative.alias("relative_path"), F.col("value").alias("code"))


def pruned(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Without files in tool and hidden folders, and hidden files."""
    names = "|".join(p.replace(".", r"\.") for p in PRUNED)
    return files.where(~F.col(path).rlike(rf"(^|/)({names})/|(^|/)\.[^/]"))


def skip_words(files: DataFrame, path: str = "relative_path", words: list[str] = tuple(SKIPPED_WORDS), ignore_case: bool = True) -> DataFrame:
    """Without files in folders whose path has one of the words."""
    folder = F.regexp_extract(path, "^(.*)/", 1)
    folder, skip = F.lower(folder) if ignore_case else folder, F.lit(False)
    for w in words:
        skip = skip | folder.contains(w)
    return files.where(~skip)


def resume(files: DataFrame, done: DataFrame, on: str = "relative_path") -> DataFrame:
    """Files that an earlier run has not processed."""
    return files.join(done.select(on), on, "left_anti")


def without_tests(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Without __init__ files and whatever has `test` in its path."""
    return files.where(~F.lower(F.col(path)).contains("test") & (basename(F.col(path)) != "__init__.py"))
