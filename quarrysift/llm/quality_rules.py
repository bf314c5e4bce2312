"""Operator 9, quality rules: line-first cleaning. Native expressions only; one pass over the rows, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrysift.functions.text import once
from quarrysift.llm._common import WORD, text_of, without_spaces, words_of
from quarrysift.session import spread

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate, matched in lower case.
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "subscribe to our newsletter", "lorem ipsum"]
NAVIGATION = "[|»›•]"
SENTENCE_END = "[.!?…:;]"


def _line_fails(line: Column, boilerplate: Column, navigation: Column, symbols: Column) -> Column:
    """Whether a line with a word breaks one of the rules. The flags tell what its whole text holds at all; a rule whose
    characters or phrases the text doesn't have is not tried on its lines. Cheap rules come first."""
    low = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | low.contains(p)

    def rules(n: Column) -> Column:
        chars = F.length(without_spaces(line))
        separators = lambda: F.regexp_count(line, F.lit(NAVIGATION))
        return (
            ((n >= 8) & ~line.rlike(SENTENCE_END))  # punctuation: a long line without any sentence end
            | (navigation & (separators() >= 3) & (separators() * 4 >= n))
            | (symbols & (F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) * 2 >= n))
            | (boilerplate & phrase)
            | ((chars >= 20) & (F.regexp_count(line, F.lit(r"\p{Lu}")) * 2 >= chars))  # upper case
        )

    return once(F.regexp_count(line, F.lit(WORD)), rules)


def total_chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_lost_pct: int = 50, hash_bits: int = 40, payload: Column | None = None) -> DataFrame:
    """Measures of each document, the text that is left after line cleaning, and a verdict.

    Lines are cut at \\n. A line with a word goes if it repeats an earlier line or breaks a rule: eight words or more without
    a sentence end, navigation separators, symbols, upper case, boilerplate phrases. A document is kept unless it fails the
    base rules (too few words, or too many words in repeated 3-word windows) or more than max_lost_pct percent of its word
    lines' characters went.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, line_chars,
    clean_text, kept, and payload as `row` if given. Null and empty texts: all counts 0, base_failed. Rows are independent:
    repeated rows, null ids and extra columns don't matter. Windows of equal hash are compared word by word; should
    unequal ones share a hash, the document's windows are sorted as text instead.
    """
    base = spread(docs).select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"), *([payload.alias("__row")] if payload is not None else []))
    carry = ["__id", "__text", *(["__row"] if payload is not None else [])]
    c = F.col
    low, flag = F.lower(c("__text")), F.lit(False)
    for phrase in BOILERPLATE:
        flag = flag | low.contains(phrase)
    has = F.struct(flag.alias("boilerplate"), c("__text").rlike(NAVIGATION).alias("navigation"), c("__text").rlike(f"[{SYMBOLS}]").alias("symbols"))
    split = base.select(*carry, words_of(c("__text")).alias("__w"), F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"))
    n = F.size("__w")
    word = lambda i: F.get("__w", i)
    # Each window as one number: bits of its hash, then its place. Sorted, equal windows are neighbours.
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.shiftright(F.xxhash64(word(i), word(i + 1), word(i + 2)), 64 - hash_bits), 24).bitwiseOR(i.cast("long"))))
    once_each = F.array_distinct("__lines")
    split = split.select(*carry, "__w", F.size("__lines").alias("__n_lines"), total_chars(c("__lines")).alias("__line_chars"), once_each.alias("__first"))
    good = once(has, lambda h: F.filter("__first", lambda x: ~_line_fails(x, h["boilerplate"], h["navigation"], h["symbols"])))
    measures = F.struct(c("__line_chars").alias("line_chars"), (c("__n_lines") - F.size("__first")).cast("long").alias("n_dup_lines")).alias("__lines")
    hashed = split.select(*carry, "__w", measures, F.when(n >= 3, packed).alias("__p"), good.alias("__good"))
    hash_at = lambda of, j: F.shiftright(F.get(of, j), 24)
    near = F.filter("__p", lambda x, j: F.coalesce(F.shiftright(x, 24) == hash_at("__p", j + 1), F.lit(False)) | F.coalesce(F.shiftright(x, 24) == hash_at("__p", j - 1), F.lit(False)))
    placed = hashed.select(*carry, "__w", "__lines", "__good", near.alias("__c"))
    place = lambda x: x.bitwiseAND(F.lit(2**24 - 1)).cast("int")
    differ = lambda i, j: (word(i) != word(j)) | (word(i + 1) != word(j + 1)) | (word(i + 2) != word(j + 2))
    clash = F.exists(F.transform("__c", lambda x, j: F.struct(x.alias("x"), F.get("__c", j + 1).alias("y"))), lambda p: (F.shiftright(p["x"], 24) == F.shiftright(p["y"], 24)) & differ(place(p["x"]), place(p["y"])))
    placed = placed.select(*carry, "__w", "__lines", "__good", "__c", F.when(n >= 2**24, F.lit(True)).otherwise(F.coalesce(clash, F.lit(False))).alias("__clash"))
    # Unequal windows of one hash, or too many places: sort the windows themselves.
    window = lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2))
    plain = F.when(F.col("__clash"), F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("g"), i.alias("i")))))
    placed = placed.select(*carry, "__w", "__lines", "__good", "__c", plain.alias("__s"))
    same = lambda x, j: F.coalesce(F.get("__s", j)["g"] == x["g"], F.lit(False))
    repeated = F.when(F.col("__s").isNull(), F.transform("__c", place)).otherwise(F.transform(F.filter("__s", lambda x, j: same(x, j + 1) | same(x, j - 1)), lambda x: x["i"]))
    symbols = c("__text")
    for s in SYMBOLS:
        symbols = F.replace(symbols, F.lit(s), F.lit(""))
    counts = [
        F.size("__w").cast("long").alias("n_words"),
        F.length(without_spaces(c("__text"))).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(symbols)).cast("long").alias("n_symbols"),
        c("__lines.n_dup_lines").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(i, i + 1, i + 2))))), F.lit(0)).cast("long").alias("n_repeat_words"),
        c("__lines.line_chars").alias("line_chars"),
        total_chars(c("__good")).alias("__kept_chars"),
        F.array_join("__good", "\n").alias("clean_text"),
    ]
    # A generator of one row: filters on the counts stay above it. Pushed below, they would repeat the lambdas.
    counted = placed.select(*carry, F.explode(F.array(F.struct(*counts))).alias("__m")).select(*carry, "__m.*")
    failed = (c("n_words") < min_words) | (c("n_repeat_words") * 100 > c("n_words") * max_repeat_pct)
    lost = c("line_chars") - c("__kept_chars")
    return counted.select(
        c("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), lost.alias("lost_chars"), "line_chars", "clean_text",
        (~failed & (lost * 100 <= c("line_chars") * max_lost_pct)).alias("kept"), *([c("__row").alias("row")] if payload is not None else []),
    )


def filter_documents(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs and the cleaned text in place of the text.

    Where docs have a column n_chars it follows the text. Rows with a null or empty text fail the base rules and go; repeated
    rows stay repeated; other columns are as they were, nulls included; an empty table stays empty.
    """
    kept = quality_rules(docs, text_col=text_col, payload=F.struct("*"), **params).where("kept")
    changed = {text_col: F.col("clean_text")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        changed["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
