"""Summaries of verification, generation and collection. Aggregates only, all with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrysift.functions.text import SEVERITY, SEVERITY_LEVELS, categorize_message


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def verify_summary(results: DataFrame) -> DataFrame:
    """One row over (verified, compilation_success, n_parse_errors, n_verification_errors, verification_time)."""
    n, if_ = F.count(F.lit(1)), F.count_if
    ok, compiled = if_(F.col("verified")), if_(F.col("compilation_success"))
    return results.agg(
        n.alias("total_files"), ok.alias("verified_files"), compiled.alias("compiled_files"), (n - compiled).alias("failed_files"),
        if_(F.col("n_parse_errors") > 0).alias("parse_error_files"), if_(F.col("n_verification_errors") > 0).alias("verification_error_files"),
        _rate(ok, n).alias("verification_rate"), _rate(compiled, n).alias("compilation_rate"), F.coalesce(F.avg("verification_time"), F.lit(0.0)).alias("average_time"),
    )


def histogram(df: DataFrame, messages: str, out: str = "message") -> DataFrame:
    """How often each message of an array column occurs, the most frequent first."""
    return df.select(F.explode(messages).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), out)


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """Sums of (message, n) over all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("message").agg(F.sum("n").cast("long").alias("n"))


def categorized(df: DataFrame, message: str) -> DataFrame:
    """(category, n) rows of messages: equal messages are counted first, so that the rules run once for each."""
    distinct = df.groupBy(F.col(message).alias("message")).agg(F.count(F.lit(1)).alias("n"))
    return distinct.select(categorize_message(F.col("message")).alias("category"), "n").groupBy("category").agg(F.sum("n").alias("n"))


def category_counts(categorized: DataFrame) -> DataFrame:
    """Every category with count, severity and percent of all; (category, n) rows of these categories in."""
    named = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity")) for c, s in SEVERITY.items()])
    dimension = categorized.sparkSession.range(1).select(F.explode(named).alias("c")).select("c.*")
    sums = categorized.groupBy("category").agg(F.sum("n").alias("n"))
    n, total = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce(F.sum("n").over(Window.partitionBy()), F.lit(0))  # a row for each category
    joined = sums.join(F.broadcast(dimension), "category", "right").withColumn("total", total)
    return joined.select("category", "severity", n.alias("n"), F.when(F.col("total") > 0, F.round(n * 100 / F.col("total"), 1)).otherwise(0.0).alias("percent"))


def severity_counts(categories: DataFrame) -> DataFrame:
    levels = categories.sparkSession.createDataFrame([(s,) for s in SEVERITY_LEVELS], "severity string")
    return levels.join(categories.groupBy("severity").agg(F.sum("n").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def failure_categories(results: DataFrame) -> DataFrame:
    return results.where("status = 'failed'").groupBy(F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def csv_summary(results: DataFrame) -> DataFrame:
    """Counters over (verified, error_type): the first of verified, parse, compile and verification that fits."""
    et = F.lower(F.coalesce("error_type", F.lit("")))
    ok = F.coalesce(F.col("verified"), F.lit(False)) | F.coalesce("error_type", F.lit("")).isin("verified", "success", "ok", "passed")
    kind = F.when(ok, "v").when(et.contains("parse"), "p").when(et.contains("compile"), "c").when(et.contains("verification"), "e")
    n, count = F.count(F.lit(1)), lambda k: F.count_if(kind == k)
    return results.agg(
        F.lit("SUMMARY").alias("id"), n.alias("total_programs"), count("v").alias("verified_count"), count("p").alias("parse_error_count"), count("c").alias("compile_error_count"),
        count("e").alias("verification_error_count"), (n - count("v")).alias("failed_count"), F.round(_rate(count("v"), n), 3).alias("verification_rate"),
    )


def session_rollup(usage: DataFrame, session: str = "session_id") -> DataFrame:
    """Sums and averages of (duration, input_tokens, output_tokens, cost) by session."""
    tokens = F.sum(F.col("input_tokens") + F.col("output_tokens"))
    return usage.groupBy(session).agg(
        F.count(F.lit(1)).alias("total_programs"), F.round(F.sum("duration"), 4).alias("total_duration"), F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"), tokens.cast("long").alias("total_tokens"), F.round(F.sum("cost"), 6).alias("total_cost"),
        F.round(F.avg("duration"), 4).alias("avg_duration"), F.round(F.avg(F.col("input_tokens") + F.col("output_tokens")), 4).alias("avg_tokens"),
        F.round(F.avg("cost"), 8).alias("avg_cost"), F.round(F.when(tokens > 0, F.sum("cost") / tokens).otherwise(0.0), 10).alias("cost_per_token"),
    )


def generation_stats(usage: DataFrame) -> DataFrame:
    """One row over (duration, input_tokens, output_tokens, cost, ok, cached): only requests that were made count as such."""
    n, made, ok = F.count(F.lit(1)), F.count_if(~F.col("cached")), F.count_if(F.col("ok"))
    return usage.agg(
        n.alias("total_programs"), made.alias("api_requests"), (n - made).alias("cached_results"), (n - ok).alias("errors"),
        F.format_string("%.1f%%", F.when(n > 0, ok * 100 / n).otherwise(0.0)).alias("success_rate"),
        F.round(F.sum("duration"), 3).alias("total_seconds"), F.round(F.sum("duration") / made, 3).alias("average_seconds"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("total_tokens"),
        F.round(F.sum(F.col("input_tokens") + F.col("output_tokens")) / made, 1).alias("average_tokens"),
        F.round(F.sum("cost"), 6).alias("total_cost"), F.round(F.sum("cost") / made, 8).alias("average_cost"),
    )


def progress(done: DataFrame, everything: DataFrame) -> DataFrame:
    """completed, remaining, percent of two tables' row counts."""
    both = done.agg(F.count(F.lit(1)).alias("completed")).crossJoin(everything.agg(F.count(F.lit(1)).alias("total")))
    return both.select("completed", "total", (F.col("total") - F.col("completed")).alias("remaining"), F.when(F.col("total") > 0, F.round(F.col("completed") * 100 / F.col("total"), 1)).otherwise(0.0).alias("percent"))
