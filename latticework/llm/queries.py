"""The ten operators bound to their tables, one query each, with SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import joined_safely
from ..session import tune
from .chat import format_chats, read_back, text_parts
from .decontaminate import decontaminate
from .jaccard import jaccard_components
from .licenses import scan as scan_licences
from .mixing import mix
from .pii import KINDS as PERSONAL_KINDS
from .pii import find_personal_data
from .positive import score_quality
from .ppm import lm_scores
from .quality import assess
from .repair import damage, digests, repair
from .secrets import BASE as SECRET_KINDS
from .secrets import find_secrets, span_text
from .sharding import shard
from .whitening import fit, whiten

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(tune(spark), sf_dir)

    LLM_QUERIES[build.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, 8, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return assess(docs, _table(spark, sf_dir, "labels")).drop("text")


@_query
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    listed = F.transform("licences", lambda p: F.concat_ws(":", p["paragraph"], p["family"]))
    return found.select("doc_id", "n_paragraphs", "n_candidates", F.size("licences").cast("long").alias("n_licences"),
                        F.concat_ws(",", listed).alias("licences"), "licence")


def _count(kind: str, spans: str = "spans"):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _base(kinds: tuple[str, ...]):
    """Digest of the spans of the base rules."""
    return F.sha2(span_text(F.filter("base", lambda s: s["kind"].isin(*kinds))), 256).alias("base_sha256")


@_query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.withColumn("base", F.col("spans")).select(
        "doc_id", *[_count(k) for k in SECRET_KINDS], _base(SECRET_KINDS), span_text(F.col("spans")).alias("spans"))


@_query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.withColumn("base", F.filter("spans", lambda s: s["rule"])).select(
        "doc_id", *[_count(k, "base") for k in PERSONAL_KINDS], _base(PERSONAL_KINDS), span_text(F.col("spans")).alias("spans"))


@_query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                 F.lit("</s>[INST] ok [/INST]"))
    messages = turns.union(more).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    read = read_back(format_chats(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')"
LLM_ORACLES["op9_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 23) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


@_query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    found = whiten(rows, model, keep=["vec_id"])
    n, error, shares = (0, 0.0, []) if model is None else (model.n, model.identity_error, (model.values / model.trace).tolist())
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(float(v)) for v in shares]).cast("array<double>"), F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, reports = repair(damage(rows))
    found = joined_safely(rows.select("conv_id").distinct(), reports, ["conv_id"], "left")
    found = joined_safely(found, digests(turns), ["conv_id"], "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# The same repair as a shortest path over (row, role state): each step keeps the best path to each of four states.
LLM_ORACLES["op12_conversation_repair"] = """
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''),
             lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f
           FROM keyed, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hashed WHERE f <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM hashed WHERE f = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
told AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
m AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM told),
ins(st, st1, c1, a1, s1) AS (VALUES
  ('0', '0', 0, '', ''), ('S', 'S', 0, '', ''), ('U', 'U', 0, '', ''), ('A', 'A', 0, '', ''),
  ('0', 'U', 2, 'I', chr(10) || 'user:'), ('S', 'U', 2, 'I', chr(10) || 'user:'), ('A', 'U', 2, 'I', chr(10) || 'user:'),
  ('U', 'A', 2, 'I', chr(10) || 'assistant:'), ('0', 'A', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('S', 'A', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edit(st1, r, st2, a2, c2, said) AS (VALUES
  ('0', 's', 'S', 'K', 0, NULL), ('0', 'u', 'U', 'K', 0, NULL), ('S', 'u', 'U', 'K', 0, NULL), ('U', 'a', 'A', 'K', 0, NULL),
  ('A', 'u', 'U', 'K', 0, NULL), ('0', NULL, 'U', 'R', 2, 'user'), ('S', NULL, 'U', 'R', 2, 'user'),
  ('A', NULL, 'U', 'R', 2, 'user'), ('U', NULL, 'A', 'R', 2, 'assistant'), ('0', NULL, '0', 'D', 3, NULL),
  ('S', NULL, 'S', 'D', 3, NULL), ('U', NULL, 'U', 'D', 3, NULL), ('A', NULL, 'A', 'D', 3, NULL)),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '0' AS st, 0 AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL
  SELECT conv_id, pos, st, cost, audit, said FROM (
    SELECT n.*, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, m.pos, e.st2 AS st, p.cost + i.c1 + e.c2 + CASE WHEN m.fault = 't' AND e.a2 <> 'D' THEN 1 ELSE 0 END AS cost,
             p.audit || i.a1 || e.a2 AS audit,
             p.said || i.s1 || CASE WHEN e.a2 = 'D' THEN '' ELSE chr(10) || coalesce(e.said, m.role) || ':' || m.text END AS said
      FROM path p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.pos = p.pos + 1
      JOIN ins i ON i.st = p.st JOIN edit e ON e.st1 = i.st1
      WHERE (e.a2 = 'D' OR m.fault NOT IN ('b', 'd')) AND (e.r IS NULL OR e.r = m.r)) n) WHERE best = 1),
stats AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM m GROUP BY conv_id),
ended AS (
  SELECT p.conv_id, p.cost + i.c1 AS cost, p.audit || i.a1 AS audit, p.said || i.s1 AS said,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + i.c1, p.audit || i.a1) AS best
  FROM path p JOIN stats s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.pos
  JOIN ins i ON i.st = p.st WHERE i.st1 IN ('0', 'A'))
SELECT o.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(substr(e.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM ended WHERE best = 1) e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


@_query
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
