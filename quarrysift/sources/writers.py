"""Sinks: JSON, CSV, one file a row, partitions by repository or input, text and HTML reports."""

from __future__ import annotations

import html
import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrysift.functions.text import strip, zfill
from quarrysift.operators.curate import with_index
from quarrysift.sources.files import Folder


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_envelope(df: DataFrame, path: str, metadata: dict, most: int = 100_000) -> None:
    """One pretty JSON file {metadata, results} in a folder that the driver reaches, for results that are read as a whole.

    More than `most` rows are an error: they are for write_json.
    """
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_json")
    folder, name = path.rsplit("/", 1)
    Folder(folder).write(name, json.dumps({"metadata": metadata, "results": [json.loads(r) for r in rows]}, indent=2, ensure_ascii=False).encode())


def csv_columns(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, else all by name; a kept one that is missing is empty."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in keep or sorted(df.columns)])


def write_csv(df: DataFrame, path: str, keep: list[str] | None = None) -> None:
    csv_columns(df, keep).write.mode("overwrite").option("header", True).csv(path)


def with_summary(df: DataFrame, summary: DataFrame) -> DataFrame:
    """The rows and then the summary's row, over the columns of both."""
    return df.unionByName(summary, allowMissingColumns=True)


def program_files(df: DataFrame, task_id: str = "task_id", code: str = "code") -> DataFrame:
    """filename and text of each program with code."""
    return df.where(strip(F.col(code)) != "").select(F.concat(F.lit("program_"), zfill(F.col(task_id), 3), F.lit(".py")).alias("filename"), F.concat(strip(F.col(code)), F.lit("\n")).alias("text"))


def write_texts(df: DataFrame, folder: str, path: str = "path", text: str = "text") -> None:
    """A file for each row, written by the executors to a folder that all of them share; paths are relative to it."""

    def write(rows) -> None:
        to = Folder(folder)
        for r in rows:
            to.write(r[0], r[1].encode())

    df.select(path, text).foreachPartition(write)


def write_program_files(df: DataFrame, folder: str) -> None:
    """One file for each program with code, as write_texts."""
    write_texts(program_files(df), folder, "filename")


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a column, / in it as _; null has a folder of its own.

    Rows are brought together by value; adaptive execution splits the values that are larger than a task should be.
    """
    df.withColumn("__part", F.regexp_replace(F.col(by), "/", "_")).hint("rebalance", F.col("__part")).write.mode("overwrite").partitionBy("__part").json(path)


def report_text(summary: DataFrame) -> str:
    row = summary.first().asDict()
    return "\n".join(f"{k}: {v}" for k, v in row.items()) + "\n"


def write_report(summary: DataFrame, detail: DataFrame, key: str, folder: str, rows_a_part: int = 1000) -> None:
    """A page for each row, detail/KEY.html, and all rows in order of the key in index parts, by the executors; index.html links the parts.

    folder is shared by all executors. Keys are unique and fit a file name. The driver holds the names of the parts alone.
    """
    columns = detail.columns
    page = lambda title, body: f"<html><head><title>{html.escape(title)}</title></head><body>{body}</body></html>".encode()
    text = lambda v: html.escape(str(v))

    def write(rows) -> None:
        to, head = Folder(folder), "".join(f"<th>{text(c)}</th>" for c in columns)
        for part, own in itertools.groupby(rows, lambda r: (r["__at"] - 1) // rows_a_part):
            lines = []
            for r in own:
                name, values = str(r[key]), [r[c] for c in columns]
                fields = "".join(f"<tr><th>{text(c)}</th><td>{text(v)}</td></tr>" for c, v in zip(columns, values))
                to.write(f"detail/{name}.html", page(name, f'<a href="../index.html">index</a><table>{fields}</table>'))
                cells = "".join(f"<td>{text(v)}</td>" for v in values)
                lines.append(f'<tr>{cells}<td><a href="../detail/{text(name)}.html">page</a></td></tr>')
            to.write(f"parts/{part:06d}.html", page("results", f"<table><tr>{head}<th></th></tr>{''.join(lines)}</table>"))

    numbered = with_index(detail, key, "__at")
    numbered.repartition(F.floor((F.col("__at") - 1) / rows_a_part)).sortWithinPartitions("__at").foreachPartition(write)
    to = Folder(folder)
    links = "".join(f'<li><a href="parts/{p}">{p}</a></li>' for p, _ in to.list("parts"))
    to.write("index.html", page("report", f"<pre>{text(report_text(summary))}</pre><ul>{links}</ul>"))
