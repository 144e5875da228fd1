"""The queries of this package, with production parameters, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.chat_format import conversation_digests, format_turns
from siftstone.llm.columns import read, shared_checkpoint
from siftstone.llm.conversation_trie import numbered_turns, prefix_trie, with_shared_heads
from siftstone.llm.decontaminate import find_leaks
from siftstone.llm.lm_score import score_held_out
from siftstone.llm.near_dedup import near_duplicates
from siftstone.llm.personal_data import KINDS, PersonalData, span_text
from siftstone.llm.quality_model import SubwordClassifier
from siftstone.llm.quality_rules import QualityCascade
from siftstone.llm.sentencepiece_lattice import MERGES, PieceTable, encode_digests
from siftstone.llm.suffix_dedup import repeated_bytes
from siftstone.llm.token_pack import read_tokens, shared_path, write_tokens
from siftstone.llm.url_filter import RULE_SCHEMA, judge_urls
from siftstone.llm.vector_codes import VectorCodec, with_group_error

#: Host, path and action of each rule that op4 applies (fixed values).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
CONTROL = "<|im_end|><|im_start|>assistant ok"
QUALITY_THRESHOLD = 0.7


def held_out(parts: int) -> Column:
    """crc32(doc_id as text) mod parts is 2; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == 2, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scored = score_held_out(read(spark, sf_dir, "documents"), held_out(7))
    return scored.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # which rule says no first depends on measured times, so it is no part of the result
    return QualityCascade.fit(docs).apply(docs).drop("rejected_by", "rules_run")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return conversation_digests(shared_checkpoint(format_turns(turns.union(control))))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULE_SCHEMA)).drop("component")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read(spark, sf_dir, "documents"))


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").filter(~held_out(4)).select("doc_id", F.col("quality").alias("label"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = SubwordClassifier.fit(docs, training_labels(spark, sf_dir)).score(docs)
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def pieces() -> PieceTable:
    return PieceTable.load(public_tokenizers.path("piece_bpe_32k.model"), MERGES)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), pieces())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie(*with_shared_heads(numbered_turns(read(spark, sf_dir, "conversations")), head, conv - F.pmod(conv, F.lit(5)), 8))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = PersonalData.fit(docs).find(docs)
    counts = [F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("found").alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    codec = VectorCodec.fit(vectors)
    coded = shared_checkpoint(codec.encode(vectors, keep="label"))
    return with_group_error(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256"))


OP3_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP4_SQL = """
WITH rules(rule_host, rule_path, action) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.action, 'allow') AS verdict
FROM parts LEFT JOIN LATERAL (
  SELECT rule_host || rule_path AS rule, action FROM rules
  WHERE (parts.host = rule_host OR suffix(parts.host, '.' || rule_host)) AND starts_with(parts.path, rule_path)
  ORDER BY length(rule_host || rule_path) DESC, action, rule DESC LIMIT 1) AS fit ON true
""".format(rules=", ".join(map(str, URL_RULES)))

#: The checksum of an id's digits is folded bit by bit: DuckDB has no function for it. -1 in a list is a shift.
OP11_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n, conv_id - (conv_id % 5 + 5) % 5 AS donor,
    xor(4294967295, list_reduce(flatten(list_transform(range(length(CAST(conv_id AS VARCHAR)) + 1), lambda i:
      CASE WHEN i = 0 THEN [4294967295] ELSE [CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] END)),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS head
  FROM turns GROUP BY conv_id),
plan AS (SELECT o.*, least(o.head, coalesce(d.n, 0)) AS given FROM own o LEFT JOIN own d ON d.conv_id = o.donor),
rebuilt AS (
  SELECT conv_id, pos - head + given AS pos, role, text FROM turns JOIN plan USING (conv_id) WHERE pos > head
  UNION ALL SELECT p.conv_id, t.pos, role, text FROM plan p JOIN turns t ON t.conv_id = p.donor AND t.pos <= p.given),
places AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS path, 0 AS size, given + greatest(n - head, 0) AS total FROM plan
  UNION ALL SELECT r.conv_id, pos, string_agg(sha256(role || ':' || text), '') OVER (PARTITION BY r.conv_id ORDER BY pos), strlen(text), given + greatest(n - head, 0) FROM rebuilt r JOIN plan p USING (conv_id)),
node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, count(*) FILTER (total > depth) = 0 AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
  FROM places GROUP BY path, depth)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, count(*) FILTER (b.depth = a.depth + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves,
  CAST(sum(b.saved) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM node a JOIN node b ON starts_with(b.path, a.path) LEFT JOIN node p ON a.depth > 0 AND p.path = a.path[:64 * (a.depth - 1)]
GROUP BY ALL
"""

OP13_SQL = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, CAST(p AS INT) AS part, v[len(v) // 16 * p + 1 : len(v) // 16 * (p + 1)] AS x FROM kept, range(16) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
book0 AS (SELECT part, entry, x FROM parts JOIN first USING (vec_id)),
{rounds}
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""
_NEAR = """near{k} AS (SELECT vec_id, label, part, x, entry, far FROM (
  SELECT vec_id, label, p.part, p.x, entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM parts p JOIN book{k} b USING (part))
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1),
"""
_MOVE = """mean{k} AS (SELECT part, entry, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY place) AS x
  FROM (SELECT part, entry, place, sum(x[place]) AS s, count(*) AS n FROM near{k}, range(1, len(x) + 1) t(place) GROUP BY ALL) GROUP BY part, entry),
book{next} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)),
"""
OP13_SQL = OP13_SQL.format(rounds="".join(_NEAR.format(k=k) + (_MOVE.format(k=k, next=k + 1) if k < 2 else "") for k in range(3)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_chat_format, op4_url_filter, op5_suffix_dedup, op6_token_packing, op7_quality_classifier, op8_simhash_near_dedup, op9_sentencepiece, op10_decontamination, op11_conversation_trie, op12_personal_data, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """op4's SQL has no aliases: it holds for tables whose pages give no redirect and no canonical link."""
    return {"op3_chat_format": OP3_SQL, "op4_url_filter": OP4_SQL, "op11_conversation_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}
