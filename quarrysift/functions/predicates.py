"""Row predicates and derived fields over program and result records. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrysift.functions.text import n_lines, strip

#: Words that mean yes and no, fields that may say whether a record is verified, and what they then say.
TRUE_WORDS = ["true", "1", "yes", "y", "ok", "passed", "pass", "success", "succeeded", "verified", "verifies"]
FALSE_WORDS = ["false", "0", "no", "n", "fail", "failed", "error"]
FLAG_FIELDS = ["verified", "is_verified", "verification_passed", "verifies"]
STATUS_FIELDS = ["status", "verification", "verify_status", "verifier_status", "verification_status"]
STATUS_WORDS = ["verified", "success", "passed", "ok", "true"]
IDENTITY_KEYS = ["source_file", "file_path", "filename", "task_id", "program_id", "specification_index"]


def field(record: Column, path: str, kind: str = "string") -> Column:
    """A dotted field of a VARIANT record, null where it is missing or of another type."""
    return F.try_variant_get(record, "$." + path, kind)


def to_boolish(text: Column) -> Column:
    """True, false or null of a value given as text."""
    t = F.lower(strip(text))
    number = F.expr("try_cast(NULL AS DOUBLE)") if text is None else t.try_cast("double")
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False).when(number.isNotNull(), number != 0)


def record_verified(record: Column, key: str | None = None, value: str | None = None) -> Column:
    """Whether a VARIANT record says that it is verified: by a given field, else by flags, nested status, status words, a count."""
    if key:
        got = field(record, key)
        if value is not None:
            return F.coalesce(F.lower(strip(got)) == value.strip().lower(), F.lit(False))
        return F.coalesce(to_boolish(got), F.coalesce(got, F.lit("")) != "")
    said = lambda name: F.coalesce(F.lower(strip(field(record, name))).isin(STATUS_WORDS), F.lit(False))
    out = said("verification.status")
    for name in FLAG_FIELDS:
        out = out | F.coalesce(to_boolish(field(record, name)), F.lit(False))
    for name in STATUS_FIELDS:
        out = out | said(name)
    return out | F.coalesce(field(record, "verified_count", "long") > 0, F.lit(False))


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, as it is."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def size_class(code: Column) -> Column:
    n = n_lines(code)
    return F.when(n <= 15, "simple").when(n <= 30, "medium").otherwise("complex")


#: Kinds of repositories in order, each with its keywords.
REPO_TYPES = [
    ("web_frameworks", ["django", "flask", "fastapi", "tornado", "bottle", "falcon"]),
    ("data_science", ["pandas", "numpy", "scipy", "matplotlib", "plotly", "sklearn"]),
    ("algorithms", ["garvit244", "thealgorithms", "kamyu104", "leetcode", "algorithms"]),
    ("devops_tools", ["ansible", "fabric", "celery", "docker", "paramiko"]),
    ("testing_quality", ["pytest", "pylint", "mypy", "black", "flake8"]),
    ("utilities", ["click", "fire", "playwright", "requests", "pillow"]),
]


def repo_type(repo: Column) -> Column:
    low, out = F.lower(F.coalesce(repo, F.lit(""))), None
    for name, words in REPO_TYPES:
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


#: Words and imports that a function's quality score looks for.
MATH_WORDS = ["algorithm", "calculate", "compute", "solve", "optimize", "matrix", "vector", "graph", "tree", "sort", "search"]
AVOIDED = ["import requests", "import urllib", "import os", "import sys", "subprocess", "multiprocessing", "threading"]


def quality_score(code: Column, docstring: Column) -> Column:
    n, low = n_lines(code), F.lower(code)
    points = lambda test, p: F.when(test, p).otherwise(0)
    return (
        F.when(n.between(50, 200), 20).when(n.between(20, 300), 10).otherwise(0)
        + points(F.coalesce(docstring, F.lit("")) != "", 15)
        + points(code.contains(":") & code.contains("->"), 15)
        + points(low.rlike("|".join(MATH_WORDS)), 20)
        + points(code.contains("def ") & code.contains("return "), 10)
        + points(~code.rlike("|".join(AVOIDED)), 10)
        + points(F.regexp_count(code, F.lit("#")) >= 3, 10)
    ).cast("long")


def func_quality(code: Column) -> Column:
    return F.length(code).between(50, 3000) & code.contains("def ") & code.contains("return")


def matches_pattern(pattern: str, *columns: Column) -> Column:
    """Whether one of the columns holds the pattern without its asterisks."""
    needle, out = pattern.replace("*", ""), F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.contains(needle), F.lit(False))
    return out


# ---- models and costs -----------------------------------------------------------------------------------------------

#: USD for 1000 input and output tokens by model; the last for any other.
PRICES = {
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4.1": (0.002, 0.008),
    "gpt-4_1-2025-04-14": (0.002, 0.008),
    "gpt-4.1-mini": (0.0004, 0.0016),
    "gpt-4.1-nano": (0.0001, 0.0004),
    "gpt-3.5-turbo": (0.0015, 0.002),
    "gpt-5": (0.00125, 0.01),
    "gpt-5-mini": (0.00025, 0.002),
    "gpt-5-nano": (0.00005, 0.0004),
}
OTHER_PRICE = (0.01, 0.03)
PRICES_DATE = "2025-08-13"


def normalize_model_name(model: Column) -> Column:
    m = F.lower(strip(model))
    sub = lambda base, *kinds: _first([(m.contains(k), F.lit(f"{base}-{k}")) for k in kinds], F.lit(base))
    families = [
        (m.contains("gpt-4_1") | m.contains("gpt-4.1"), sub("gpt-4.1", "mini", "nano")),
        (m.contains("gpt-4o"), sub("gpt-4o", "mini")),
        (m.contains("gpt-4"), sub("gpt-4", "turbo")),
        (m.contains("gpt-5"), sub("gpt-5", "mini", "nano")),
        (m.contains("gpt-3.5") | m.contains("gpt3.5"), F.lit("gpt-3.5-turbo")),
    ]
    return _first(families, m)


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def supports_temperature(model: Column) -> Column:
    return ~F.lower(strip(model)).contains("gpt-5")


def calculate_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    name = normalize_model_name(model)
    price = lambda i: _first([(name == m, F.lit(p[i])) for m, p in PRICES.items()], F.lit(OTHER_PRICE[i]))
    return input_tokens / 1000 * price(0) + output_tokens / 1000 * price(1)


def pricing_is_old(today: Column, updated: str = PRICES_DATE, days: int = 30) -> Column:
    return F.datediff(today, F.lit(updated).cast("date")) > days


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The chance that one of k samples out of n, c of them right, is right; exact, as a product."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (F.lit(1.0) - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - miss)
