"""Operator 8, URL filters: pattern rules indexed by their rarest literal token.

A url's tokens fetch its candidate rules, and only those run their regular expressions. Rules come from a list or from a table; up
to INDEX_RULES of them go to the workers as one index, more meet the urls in a join by token.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrysift.llm._common import Scratch, bounded_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[a-z0-9]+")
_FOLD = str.maketrans(UPPER, LOWER)
#: Up to so many rules (some 50 MB) are sent to the workers as one index; rules without a token must be so few.
INDEX_RULES, TOKENLESS_RULES = 100_000, 1000
RULE = "name string, verdict string, pattern string, tokens array<string>, rank int, query boolean"


@lru_cache(INDEX_RULES)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.S)


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path (and the query part from its ?, if `query`), with literal tokens (runs of a-z0-9, A-Z folded)
    that every url it fits holds whole.

    Of the rules that fit, the highest rank wins, then the longest name, then block, then the name.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0
    query: bool = False

    @property
    def order(self) -> tuple:
        return self.rank, len(self.name), self.verdict == "block", self.name

    def fits(self, host: str, path: str, query: str) -> bool:
        return compiled(self.pattern).search(host + path + query if self.query else host + path) is not None


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """The host and all its subdomains, where the path starts so."""
    literal = f"{host}{path}"
    found = list(_TOKEN.finditer(literal.translate(_FOLD)))
    whole = tuple(m.group() for m in found if m.end() < len(literal))  # a last token could go on in the url
    return Rule(literal, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path else '(?:/|$)'}", whole, 1)


def word_rule(verdict: str, word: str) -> Rule:
    """Urls with this word between other characters than letters and digits of ASCII, in host or path."""
    return Rule(word, verdict, rf"(?ai:(?<![a-z0-9]){re.escape(word)}(?![a-z0-9]))", (word,))


def filter_rule(verdict: str, text: str) -> Rule:
    """A filter over host, path and query, A-Z folded: literal parts with * for any run and ^ for a separator (anything but
    letters, digits and _ - . %, or the end); || at the start of a label of the host, | at the very start or the end."""
    body, start, end = text, "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    signs = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
    pattern = start + "".join(signs.get(c) or re.escape(c) for c in body) + end
    whole = lambda m: (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and start) and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and end)
    return Rule(text, verdict, f"(?ai:{pattern})", tuple(m.group() for m in _TOKEN.finditer(body.translate(_FOLD)) if whole(m)), 0, True)


#: The words and filters of the default block list.
BLOCK_WORDS = ["casino", "poker", "betting", "gambling", "viagra", "cialis", "porn", "xxx", "escort", "warez", "keygen", "torrent", "phishing", "malware"]
BLOCK_FILTERS = ["||adserver.*/click^", "/ads/banner*.gif", "/affiliate/*/redirect^", "?adurl=*&clickid=", "/wp-login.php^", "/free-*-download/"]
DEFAULT_RULES = [word_rule("block", w) for w in BLOCK_WORDS] + [filter_rule("block", f) for f in BLOCK_FILTERS]


def rules_of(table: DataFrame) -> DataFrame:
    """Rules from a table of (verdict, kind, rule): kind host (host and path, cut at the first /), word or filter."""
    makers = {"word": word_rule, "filter": filter_rule, "host": lambda v, t: host_rule(v, *(t.partition("/")[0].translate(_FOLD), "".join(t.partition("/")[1:])))}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [makers[kind](verdict, rule) for verdict, kind, rule in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, astuple(r))) for r in made], schema=schema)

    names = ["name", "verdict", "pattern", "tokens", "rank", "query"]
    schema = pa.schema([("name", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()), ("tokens", pa.list_(pa.string())), ("rank", pa.int32()), ("query", pa.bool_())])
    return table.select("verdict", "kind", "rule").mapInArrow(make, RULE)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.rank, r.query) for r in rules], RULE)


def parts_of(url: Column) -> tuple[Column, Column, Column]:
    """Host, in lower case, path, and query part with its ?, of a url; all empty without a scheme."""
    url = F.coalesce(url, F.lit(""))
    part = lambda more, group: F.regexp_extract(url, rf"^(?s:.*?)://{more}", group)
    return F.translate(part("([^/?#]*)", 1), UPPER, LOWER), part("[^/?#]*([^?#]*)", 1), part(r"[^/?#]*[^?#]*(\?[^#]*)?", 1)


def _tokens(columns: list[str]) -> Column:
    return F.array_distinct(F.split(F.translate(F.concat(*columns), UPPER, LOWER), "[^a-z0-9]+"))


def token_frequency(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, n): in how many urls each token of the rules occurs, over all urls (host, path, query)."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    return urls.select(F.explode(_tokens(["host", "path", "query"])).alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


class Index:
    """Rules by their rarest token; those without a token are tried on every url."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token, self.always = defaultdict(list), []
        for rule in rules:
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))].append(rule)
            else:
                self.always.append(rule)

    def winner(self, host: str, path: str, query: str) -> Rule | None:
        best = None
        seen = set(_TOKEN.findall((host + path + query).translate(_FOLD)))
        for rules in (self.always, *[self.by_token[t] for t in seen if t in self.by_token]):
            for rule in rules:
                if (best is None or rule.order > best.order) and rule.fits(host, path, query):
                    best = rule
        return best


def _joined(urls: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """urls with `best`, the winner of the rules that have tokens, found by a join of urls and rules by token."""
    rarest = rules.withColumn("token", F.explode("tokens")).join(frequency, "token", "left")
    rarest = rarest.groupBy("name", "verdict", "pattern", "rank", "query").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")).alias("token"))
    found = urls.select("row", "host", "path", F.col("query").alias("rest"), F.explode(_tokens(["host", "path", "query"])).alias("token")).join(rarest, "token")

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("host", "path", "rest", "pattern", "query")))
            yield b.filter(pa.array([compiled(p).search(h + a + r if q else h + a) is not None for h, a, r, p, q in rows], pa.bool_())).select(["row", "name", "verdict", "rank"])

    fits = found.select("row", "host", "path", "rest", "name", "verdict", "pattern", "rank", "query").mapInArrow(fitting, "row long, name string, verdict string, rank int")
    order = F.struct("rank", F.length("name"), F.col("verdict") == "block", "name")
    best = fits.groupBy("row").agg(F.max_by(F.struct("name", "verdict", "rank"), order).alias("best"))
    return urls.join(best, "row", "left")


def url_filter(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", frequency: DataFrame | None = None, owner: Scratch | None = None) -> DataFrame:
    """id_col, host, path, rule (the winner's name or null), rank, verdict of each url.

    rules: a list, or a table (rules_of, rules_table). frequency: token_frequency of an earlier run, else it is counted over all
    urls. Both ways to find candidates, the index and the join, give the same rows. Null urls and urls without a scheme have an
    empty host and path. Repeated rows and null ids are judged one by one, urls of any length whole; extra columns are
    ignored; an empty table gives no rows.
    """
    spark, names = pages.sparkSession, [id_col, "host", "path", "rule", "rank", "verdict"]
    bounded_batches(spark)
    scratch = Scratch(spark, owner)
    table = rules_table(spark, rules) if isinstance(rules, list) else scratch.keep(rules, "rules")
    host, path, query = parts_of(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), query.alias("query"))
    frequency = token_frequency(urls, table) if frequency is None else frequency
    large = not isinstance(rules, list) and table.count() > INDEX_RULES
    sent = table.where("size(tokens) = 0").limit(TOKENLESS_RULES + 1).collect() if large else table.collect()  # both bounded
    if large and len(sent) > TOKENLESS_RULES:
        raise ValueError(f"more than {TOKENLESS_RULES} rules without a literal token, which would be tried on every url")
    counts = {} if large else {r["token"]: r["n"] for r in frequency.collect()}  # tokens of INDEX_RULES rules at most
    held = spark.sparkContext.broadcast(([Rule(r["name"], r["verdict"], r["pattern"], tuple(r["tokens"]), r["rank"], r["query"]) for r in sent], counts))
    if large:
        numbered = scratch.keep(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
        urls = _joined(numbered, table.where("size(tokens) > 0"), scratch.keep(frequency, "frequency")).select("id", "host", "path", "query", "best.*")
    else:
        urls = urls.select("*", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("rank"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*held.value)
        for b in batches:
            out = []
            for h, p, q, *other in zip(*(b.column(i).to_pylist() for i in range(1, 7))):
                best = Rule(other[0], other[1], "", (), other[2]) if other[0] is not None else None
                mine = index.winner(h, p, q)
                out.append(max((r for r in (best, mine) if r), key=lambda r: r.order, default=None))
            columns = [pa.array([r and r.name for r in out], pa.string()), pa.array([r and r.rank for r in out], pa.int32()), pa.array([r.verdict if r else default for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], names=names)

    kind = pages.schema[id_col].dataType.simpleString()
    return urls.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, rank int, verdict string")
