"""Column expressions over program and log texts. Native functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and Python have it.
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def once(value: Column, then) -> Column:
    """then(value), with the value computed once for a row however often `then` uses it. A null value is passed on."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it; in linear time."""
    return F.btrim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def split_lines(c: Column) -> Column:
    """Lines at any line break; a break at the end starts no further line."""
    parts = F.split(c, _BREAK, -1)
    return F.when(c.rlike(f"({_BREAK})\\z"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalized_code(c: Column) -> Column:
    """Lines cut at the first #, stripped, without the empty ones. A # inside a string cuts too."""
    return F.array_join(F.filter(F.transform(lines(c), lambda x: strip(F.substring_index(x, "#", 1))), lambda x: x != ""), "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(normalized_code(c), 256)


def light_code(c: Column) -> Column:
    """Lines without trailing white space, no blank edges, one line break at the end, at most one blank line in a row."""
    joined = strip(F.array_join(F.transform(split_lines(c), rstrip), "\n"))
    return F.regexp_replace(F.concat(joined, F.lit("\n")), "\n{3,}", "\n\n")


def light_hash(c: Column) -> Column:
    return F.sha2(light_code(c), 256)


def short_hash_id(name: Column, c: Column) -> Column:
    return F.concat(name, F.lit("::"), F.substring(F.sha1(F.array_join(F.transform(split_lines(c), rstrip), "\n")), 1, 12))


def code_lines(c: Column) -> Column:
    """Lines that are neither blank nor a comment."""
    return F.size(F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.startswith("#"))).cast("long")


def loc(c: Column) -> Column:
    return F.size(F.filter(F.transform(split_lines(c), strip), lambda x: x != "")).cast("long")


def n_lines(c: Column) -> Column:
    return F.size(lines(c)).cast("long")


def zfill(c: Column, width: int) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    """A file's name without folder and extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(c), r"(?<=[^.])\.[^.]*\z", "")


def sanitize_filename(c: Column) -> Column:
    return F.regexp_replace(stem(c), r'[\\/*?:"<>|]', "_")


def safe_path(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/*?:"<>|]', "_")


def sanitize_name(c: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("func"))


def infer_transformation(c: Column) -> Column:
    name = F.regexp_replace(stem(c), "(?i)(verification|results|output|verified|specs?)", "")
    name = F.btrim(F.regexp_replace(name, r"[_\-.]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), basename(c))


def label_output_name(path: Column, kind: Column) -> Column:
    base = stem(path)
    extension = F.substring(basename(path), F.length(base) + 1, F.length(path))
    return F.concat(base, F.lit("__"), kind, F.coalesce(F.nullif(extension, F.lit("")), F.lit(".py")))


#: Rewrites of a message, in order.
MESSAGE_REWRITES = [
    ('".*?"', '""'),
    ("'[^']*'", "''"),
    (r"\bline\s*\d+\b", "line N"),
    (r"\bcol(?:umn)?\s*\d+\b", "col N"),
    (r"\b\d+:\d+\b", "N:N"),
    (r"\b\d+\b", "N"),
    (r"\b[A-Za-z]:[/\\][^\s:]+", "<PATH>"),
    (r"[/\\][^\s:]+", "<PATH>"),
    (r"\s+", " "),
]

#: Categories in order, each with its patterns.
MESSAGE_RULES = [
    ("Verification", [r"\b(post|pre)[ -]?condition.*might not hold", r"\b(assert|ensures|requires).*might not hold", r"\binvariant.*might not (hold|be maintained)", r"\bcould not be (proved|proven)", r"\b(decreases|termination|well[- ]?founded)", r"\breads\b|\bmodifies\b|\bframe\b"]),
    ("Parser", [r"\b(expected|unexpected)\b", r"\binvalid (token|statement|expression|unaryexpression|whilestmt|forspec|ifstmt|block)\b", r"paren|bracket|brace|semicolon|comma|verticalbar", r"\bsyntax error\b|\bparse error\b"]),
    ("Name/Type Resolution", [r"\b(undeclared|unknown|not (found|declared))\b", r"\b(member .* does not exist|no such (member|field|method))\b", r"\bwrong number of (arguments|type arguments)|arity\b", r"\btype (mismatch|incompatible|convert|cast|assignable)\b", r"\bexpect(s|ed) type\b|\bcommon supertype\b|\bco/contra-?variant\b", r"\bbitvector\b|\bordinal\b|\bnat\b", r"\barray selection requires\b|\bmap .* expects\b|\belement selection requires\b", r"\barguments must have comparable types\b"]),
    ("Ghost/Spec Context", [r"\bold\b|\bfresh\b|\bunchanged\b.*only in specification", r"\bghost\b.*not allowed\b|\bprint statement .* ghost\b", r"\bexpression is not allowed to invoke a method\b|\bmethod call .* not allowed in expression\b", r"\bmatch expression .* ghost constructor\b"]),
    ("Determinism", [r"\benforce-determinism\b|\bnondeterministic (assignment|if|loop)\b|assign-such-that"]),
    ("Compilation", [r"\bfeature not supported\b|\bcannot be compiled\b|\babstract type .* cannot be compiled\b", r"\bunable to start target\b|\bprocess .* exit code\b|\bunsupportedfeatures\b"]),
    ("Command-line", [r"\bunknown (switch|option)\b|\bnot a recognized option\b", r"\bno dafny source files\b|\bfilename extension .* is not supported\b", r"\bonly one \.dfy file\b|\bmodelview file must be specified\b|\bcannot be formatted in place\b"]),
]
#: How severe a category is.
SEVERITY = {"Verification": "Critical", "Parser": "High", "Name/Type Resolution": "High", "Compilation": "High", "Ghost/Spec Context": "Medium", "Determinism": "Medium", "Command-line": "Low", "Other": "Low"}
SEVERITY_LEVELS = ["Critical", "High", "Medium", "Low"]


def normalize_message(c: Column) -> Column:
    m = F.lower(strip(F.coalesce(c, F.lit(""))))
    for pattern, to in MESSAGE_REWRITES:
        m = F.regexp_replace(m, pattern, to)
    return m


def categorize_message(c: Column) -> Column:
    """The first category one of whose patterns is in the normalized message, else Other."""

    def rules(m: Column) -> Column:
        out = None
        for category, patterns in MESSAGE_RULES:
            hit = m.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
            out = F.when(hit, category) if out is None else out.when(hit, category)
        return out.otherwise("Other")

    # Never null, so that no null check of a join on it is pushed below an aggregate of the messages.
    return F.coalesce(once(normalize_message(c), rules), F.lit("Other"))


def severity(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[category]


def format_duration(seconds: Column) -> Column:
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    rest = seconds - minutes * 60
    return (
        F.when(seconds < 60, F.format_string("%.2fs", seconds))
        .when(seconds < 3600, F.format_string("%dm %.1fs", minutes, rest))
        .otherwise(F.format_string("%dh %dm %.1fs", hours, F.floor((seconds - hours * 3600) / 60), rest))
    )


def format_duration_long(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600)
    return F.format_string("%dh %dm %.1fs", hours, F.floor((seconds - hours * 3600) / 60), seconds - F.floor(seconds / 60) * 60)


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """{{key}} and {key} replaced by the values, one key after another."""
    for key, value in values.items():
        template = F.replace(F.replace(template, F.lit("{{" + key + "}}"), value), F.lit("{" + key + "}"), value)
    return template


def build_prompt(template: Column, code: Column) -> Column:
    return render_template(template, dict.fromkeys(("code", "spec", "text", "input"), code))


# ---- fenced blocks --------------------------------------------------------------------------------------------------

#: Languages of blocks that are passed over, and words one of which a block without a language must have.
OTHER_LANGUAGES = ["python", "java", "csharp"]
BLOCK_WORDS = ["method", "function", "predicate", "requires", "ensures", "class"]
TEXT_WORDS = ["module", "method", "function", "requires", "ensures"]


def _any(c: Column, words: list[str], how: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | getattr(c, how)(w)
    return out


def extract_blocks(c: Column) -> Column:
    """All blocks of the language, else the unmarked ones that look like it, joined by a blank line, else an empty text."""
    own = F.transform(F.regexp_extract_all(c, F.lit("(?s)```(?:dafny|Dafny)(.*?)```"), F.lit(1)), strip)
    blocks = F.regexp_extract_all(c, F.lit("(?s)```(.*?)```"), F.lit(1))
    likely = F.transform(F.filter(blocks, lambda b: ~_any(b, OTHER_LANGUAGES, "startswith") & _any(b, BLOCK_WORDS, "contains")), strip)
    return F.when(F.size(own) > 0, F.array_join(own, "\n\n")).otherwise(F.array_join(likely, "\n\n"))


#: Patterns of code in a text, in order, with the group that is the code; headings and emphasis to take out of it.
CODE_PATTERNS = [(r"(?is)```dafny\s*\n(.*?)\n```", 1), (r"(?is)```\s*\n(.*?)\n```", 1), (r"(?is)module\s+\w+\s*\{.*?\}", 0)]
MARKUP = [("(?m)^#.*$", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1")]


def extract_longest(c: Column) -> Column:
    """The longest match of the first pattern that matches, without headings and emphasis; else the text if it has a keyword."""
    out = None
    for pattern, group in CODE_PATTERNS:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
        longest = F.aggregate(found, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))
        code = strip(longest)
        for mark, to in MARKUP:
            code = F.regexp_replace(code, mark, to)
        code = strip(code)
        out = F.when(F.size(found) > 0, code) if out is None else out.when(F.size(found) > 0, code)
    return out.when(_any(c, TEXT_WORDS, "contains"), strip(c))


def extract_python_block(c: Column) -> Column:
    """The first fenced block, a Python tag or none before it, else the text; null gives an empty text."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)```(?:python|py)?\s*(.*?)```"), F.lit(1))
    return F.coalesce(F.when(F.size(found) > 0, strip(F.get(found, F.lit(0)))).otherwise(strip(c)), F.lit(""))


#: Rewrites of a specification, in order, and what calls in conditions look like.
CODE_FIXES = [
    (r"foreach\s+(\w+)\s+in\s+", "for $1 in "),
    (r"sum\s+(\w+):\s+int\s+\{:trigger\s+(.*?)\}\s+::", "sum($1: int | $2 :: "),
    (r"var\s+(\w+)\s*:=\s*new\s+bool\[(\w+)\]\[(\w+)\]", "var $1 := new bool[$2, $3]"),
    (r"(\w+)\[(\w+)\]\[(\w+)\]", "$1[$2, $3]"),
]
CALL_IN_CONDITION = r"ensures.*\w+\(.*\)|requires.*\w+\(.*\)"


def fix_common_errors(c: Column) -> Column:
    """foreach to for, sum triggers, two-dimensional arrays; a warning around texts that may call methods in conditions."""
    code = c
    for pattern, to in CODE_FIXES:
        code = F.regexp_replace(code, pattern, to)
    warned = lambda x: F.concat(F.lit(WARNING + "\n"), x, F.lit("\n" + NOTE))
    return once(code, lambda x: F.when(x.rlike(CALL_IN_CONDITION), warned(x)).otherwise(x))


#: The comments that fix_common_errors and add_header write.
WARNING = "// WARNING: This spec may use methods in ensures/requires clauses, which is not allowed."
NOTE = "// NOTE: You should convert methods to functions when used in specifications."
HEADER = ("// Auto-generated Dafny file for ", "\n// Generated from ChatGPT spec with automatic syntax fixes\n\n")


def add_header(path: Column, code: Column) -> Column:
    return F.concat(F.lit(HEADER[0]), path, F.lit(HEADER[1]), code)


# ---- verifier logs --------------------------------------------------------------------------------------------------

#: Patterns of a log line in order, with the type of what they find.
LOG_PATTERNS = [
    (r"(?i)(.+?)\((\d+),(\d+)\):\s*Error:\s*(.+)", "parse_error"),
    (r"(?i)(.+?)\((\d+),(\d+)\):\s*(.+?error.+)", "verification_error"),
    (r"(?i)Error:\s*(.+)", "generic_error"),
    (r"(?i)(.+?)\((\d+),(\d+)\):\s*Warning:\s*(.+)", "warning"),
    (r"(?i)Warning:\s*(.+)", "generic_warning"),
]


def parse_log_line(c: Column) -> Column:
    """struct(type, file, line, column, message) of one log line; null where no pattern fits.

    A pattern is tried on lines that have its word, and its closing bracket, alone. Its first match is searched once and cut into
    its groups once (no group can hold a line break, which parts them).
    """

    def found(pattern: str, kind: str) -> Column:
        groups = re.compile(pattern).groups
        has = F.lower(c).contains("warning" if "warning" in kind else "error")
        has = has & c.contains("):") if groups == 4 else has
        parted = F.transform(
            F.filter(F.array(F.regexp_extract(c, pattern, 0)), lambda m: m != ""),
            lambda m: F.split(F.regexp_replace(m, pattern, "\n".join(f"${g}" for g in range(1, groups + 1))), "\n", -1),
        )
        placed = groups == 4

        def fields(g: Column) -> Column:
            part = lambda i, kind: F.get(g, F.lit(i)).cast(kind) if placed else F.lit(None).cast(kind)
            return F.struct(F.lit(kind).alias("type"), part(0, "string").alias("file"), part(1, "long").alias("line"), part(2, "long").alias("column"), strip(F.get(g, F.lit(groups - 1))).alias("message"))

        return F.when(has, F.get(F.transform(parted, fields), F.lit(0)))

    return F.coalesce(*[found(p, k) for p, k in LOG_PATTERNS])


def parse_log(c: Column) -> Column:
    """An array of what the non-blank lines of a log say, in order, with their place and text."""
    found = F.transform(lines(c), lambda x, i: F.struct(i.cast("long").alias("n"), parse_log_line(x).alias("d"), strip(x).alias("raw_line")))
    return F.filter(found, lambda x: x["d"].isNotNull() & (x["raw_line"] != ""))


#: The lines that count errors.
PARSE_COUNT, VERIFY_COUNT = r"(?i)(\d+)\s+parse\s+errors?\s+detected", r"(?i)(\d+)\s+verification\s+errors?"


def count_messages(c: Column) -> Column:
    """Messages of the lines that count errors."""
    parse, verify = F.regexp_extract(c, PARSE_COUNT, 1), F.regexp_extract(c, VERIFY_COUNT, 1)
    low = F.lower(c)
    return F.array_compact(
        F.array(
            F.when(low.contains("parse errors detected") & (parse != ""), F.concat(parse.cast("long").cast("string"), F.lit(" parse errors detected"))),
            F.when(low.contains("verification errors") & (verify != ""), F.concat(verify.cast("long").cast("string"), F.lit(" verification errors"))),
        )
    )


def verified_flag(exit_code: Column, output: Column) -> Column:
    return F.coalesce((exit_code == 0) & (F.lower(output).contains("verified") | output.contains("0 errors")), F.lit(False))


def verified_strict(output: Column) -> Column:
    """Whether some were verified and none failed, by the verifier's closing line."""
    count = lambda g: F.regexp_extract(output, r"(\d+) verified, (\d+) errors", g).cast("long")
    return F.coalesce(output.contains("Dafny program verifier finished with") & (count(1) > 0) & (count(2) == 0), F.lit(False))


def compilation_flag(exit_code: Column, output: Column, parse_errors: Column) -> Column:
    return F.coalesce((parse_errors == 0) & ((exit_code == 0) | F.lower(output).contains("program parsed successfully")), F.lit(False))
