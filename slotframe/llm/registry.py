"""The queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, lines, minhash, mixing, quality, substring, suffix, tokens
from .common import WORD_RE, new_dir

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark, sf_dir):
    return lines.fuzzy_line_classes(documents(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    predicted = langid.identify_language(documents(spark, sf_dir), ~held_out)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_mix_sources(spark, sf_dir):
    plan = mixing.plan_mix(documents(spark, sf_dir))
    # the draws as the splitting tree's leaves give them: a shard for each copy
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"), shards.alias("shards"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix.dedup_suffixes(documents(spark, sf_dir))


def op5_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_conversations(rows.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text"))))
    return chat.digest_conversations(formatted).drop("attached_tokens")


def op6_quality_rules(spark, sf_dir):
    scored = quality.score_quality(documents(spark, sf_dir))
    return scored.drop("dup_line_share", "dup_line_char_share", "dup_ngram_excess")


def op7_token_output(spark, sf_dir):
    manifest = tokens.write_tokens(documents(spark, sf_dir), tokenizer_path(), new_dir(spark, "tokens"))
    return tokens.read_documents(spark, manifest)


def op8_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_substring_dedup(spark, sf_dir):
    return substring.dedup_substrings(documents(spark, sf_dir)).drop("n_spans")


def op10_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, array_slice(b, i, i + 99) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
ord AS (SELECT doc_id, i, max(i) OVER w AS far, min(i) OVER (PARTITION BY doc_id ORDER BY i) AS one FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
isl AS (SELECT doc_id, i, sum(CASE WHEN far IS NULL OR i > far + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ord),
gone AS (SELECT doc_id, g, min(i) AS a, max(i) + 99 AS z FROM isl GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM gone),
part AS (SELECT doc_id, p + 1 AS s, a - 1 AS e FROM cut UNION ALL SELECT doc_id, max(z) + 1, NULL FROM cut GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(array_slice(b, s, coalesce(e, octet_length(b)))), '' ORDER BY s) AS h FROM part JOIN d USING (doc_id) WHERE coalesce(e, octet_length(b)) >= s GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n.doc_id IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '[^\\<]', '', 'g')) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS escapes FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + escapes + length('<|turn|><|body|><|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS w FROM documents),
size AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
lx AS (SELECT doc_id, length(line) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM l WHERE regexp_matches(line, '{WORD_RE}')),
la AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, sum(chars) AS chars,
  coalesce(sum(chars) FILTER (again), 0) AS dup_chars FROM lx GROUP BY doc_id),
g AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([5, 6, 7, 8, 9, 10]) AS n))),
gx AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) > 1 AS again,
  count(*) OVER (PARTITION BY doc_id, n, gram) > 1 AS twice FROM g),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM gx, (SELECT unnest(range(5)) AS k)
  WHERE n = 5 AND twice GROUP BY doc_id),
cov AS (SELECT DISTINCT gx.doc_id, n, i + k AS i FROM gx, (SELECT unnest(range(10)) AS k) WHERE again AND k < n),
cc AS (SELECT cov.doc_id, n, sum(length(w[i])) AS chars FROM cov JOIN d USING (doc_id) GROUP BY cov.doc_id, n),
bad AS (SELECT DISTINCT cc.doc_id FROM cc JOIN size USING (doc_id)
  WHERE CAST(cc.chars AS DOUBLE) / greatest(word_chars, 1) - (CASE n WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.10 END)::DOUBLE > 0),
base AS (SELECT s.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
  CAST(coalesce(n_dup_lines, 0) AS DOUBLE) / greatest(coalesce(n_lines, 0), 1) <= 0.3::DOUBLE
    AND CAST(coalesce(dup_chars, 0) AS DOUBLE) / greatest(coalesce(chars, 0), 1) <= 0.2::DOUBLE AS lines_ok
  FROM size s LEFT JOIN la USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND lines_ok AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM base
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(50)) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_language_id, op3_mix_sources, op4_suffix_dedup, op5_chat_format, op6_quality_rules, op7_token_output, op8_decontaminate, op9_substring_dedup, op10_near_dedup)
}
SQL: dict[str, str] = {"op4_suffix_dedup": OP4_SQL, "op5_chat_format": OP5_SQL, "op6_quality_rules": OP6_SQL, "op9_substring_dedup": OP9_SQL}
