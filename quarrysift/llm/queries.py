"""The queries of this folder's operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrysift.llm import chat_format, exact_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, tokens, toxicity, url_filter
from quarrysift.llm._common import Scratch, labelled_sample, table


#: Toxicity learns from at most so many labelled documents, drawn by a hash of their id.
SAMPLE = 12_000


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.tokenize_pieces(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    pieces = Scratch(spark).keep(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.best_fit_pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), payload=F.struct("doc_id"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=3, threshold_pct=85)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat_format.format_chat(turns.unionByName(extra))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outside=True)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = Scratch(spark).keep(labelled_sample(docs, labels, "toxic", _remainder(3) != 1, SAMPLE), "sample")
    scored = toxicity.score(docs, toxicity.train(sample))
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The host rules of the query, longest match first to win.
HOST_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(*r) for r in HOST_RULES] + url_filter.DEFAULT_RULES
    judged = url_filter.url_filter(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict", F.when(F.col("rank") == 0, F.col("rule")).alias("pattern"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = labelled_sample(docs, labels, "quality", _remainder(5) != 0, None)
    scored = quality_classifier.score(docs, quality_classifier.train(labelled))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_near_dedup, op4_chat_formatting, op5_token_counts, op6_exact_dedup, op7_toxicity, op8_url_filters, op9_quality_rules, op10_quality_classifier)}

#: ASCII white space as a DuckDB pattern.
_WS = r"[\x20\x09-\x0D]"

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key, md5('17:' || doc_id::VARCHAR) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY 1
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap) AS final FROM l
), t AS (
  SELECT source_key, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f
), p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget, CASE WHEN t.source_size > 0 THEN floor(t.target + 0.5)::BIGINT // t.source_size ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY source_key ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t USING (source_key)
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM p
"""

OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<>]')) + 17)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_FAILS = r"""(
  (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 8 AND NOT regexp_matches(x, '[.!?…:;]'))
  OR (len(regexp_extract_all(x, '[|»›•]')) >= 3 AND len(regexp_extract_all(x, '[|»›•]')) * 4 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
  OR len(regexp_extract_all(x, '[#*$%&|<>]')) * 2 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
  OR (length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) >= 20 AND len(regexp_extract_all(x, '\p{Lu}')) * 2 >= length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))
  OR regexp_matches(lower(x), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|click here|subscribe to our newsletter|lorem ipsum')
)"""

OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1
), li AS (
  SELECT r, unnest(lines) AS x FROM d
), ch AS (
  SELECT r, sum(length(x))::BIGINT AS line_chars FROM li GROUP BY 1
), good AS (
  SELECT r, sum(length(x))::BIGINT AS good_chars FROM (SELECT DISTINCT r, x FROM li) WHERE NOT {_FAILS} GROUP BY 1
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(good_chars, 0) AS good_chars
  FROM d LEFT JOIN cov USING (r) LEFT JOIN ch USING (r) LEFT JOIN good USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (line_chars - good_chars) * 100 <= line_chars * 50 AS kept FROM b
"""

OP8_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query FROM pages
), r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rhost, rpath, rverdict)
), w AS (
  SELECT w AS name, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)' AS regex, false AS with_query FROM (VALUES ('casino'), ('poker'), ('betting'), ('gambling'), ('viagra'), ('cialis'), ('porn'), ('xxx'), ('escort'), ('warez'), ('keygen'), ('torrent'), ('phishing'), ('malware')) AS t(w)
  UNION ALL SELECT name, regex, true FROM (VALUES
    ('||adserver.*/click^', '^([^/]*[.])?adserver[.].*/click([^a-z0-9_.%-]|$)'), ('/ads/banner*.gif', '/ads/banner.*[.]gif'), ('/affiliate/*/redirect^', '/affiliate/.*/redirect([^a-z0-9_.%-]|$)'),
    ('?adurl=*&clickid=', '[?]adurl=.*&clickid='), ('/wp-login.php^', '/wp-login[.]php([^a-z0-9_.%-]|$)'), ('/free-*-download/', '/free-.*-download/')) AS t(name, regex)
), m AS (
  SELECT u.*, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(host || path || query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low_query,
         (SELECT max_by(struct_pack(name := rhost || rpath, verdict := rverdict), length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit FROM u
), p AS (
  SELECT m.*, (SELECT name FROM w WHERE regexp_matches(CASE WHEN with_query THEN low_query ELSE low END, regex, 's') ORDER BY length(name) DESC, name DESC LIMIT 1) AS word FROM m
)
SELECT page_id, host, path, hit.name AS rule, CASE WHEN hit IS NOT NULL THEN hit.verdict WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN hit IS NULL THEN word END AS pattern FROM p
"""

SQL = {"op8_url_filters": OP8_SQL, "op2_mixing": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op9_quality_rules": OP9_SQL}
