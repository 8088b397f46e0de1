"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numbra.llm.chat import answer_tool, conversation_calls, link_tool_calls
from numbra.llm.decontaminate import decontaminate
from numbra.llm.exact_dedup import exact_dedup
from numbra.llm.packing import pack_documents
from numbra.llm.pii import find_pii
from numbra.llm.secrets import find_secrets
from numbra.llm.simhash import simhash_components
from numbra.llm.substring_dedup import remove_repeats
from numbra.llm.toxicity import toxicity
from numbra.llm.warc import archive_round_trip

#: Vocabulary files are looked up by this name through their own package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = link_tool_calls(conversation_calls(turns), answer_tool(turns))
    return out.withColumn("json_sha256", F.sha2("json", 256))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=0)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=4, limit=4, seed=42)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_pack": op6_pack,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # the same messages from plain JSON functions; a user turn is a call with valid arguments, one below the call two turns before
    "op3_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, role, CAST(to_json(text) AS VARCHAR) AS content, CAST(to_json(role) AS VARCHAR) AS who,
                   CASE role WHEN 'user' THEN 'call_' || conv_id || '_' || turn
                             WHEN 'assistant' THEN 'call_' || conv_id || '_' || (turn - 1) END AS call_id
            FROM conversations
        ), islands AS (
            SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
            FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')
        ), chains AS (
            SELECT 'call_' || conv_id || '_' || turn AS call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth
            FROM islands
        ), sides AS (
            SELECT conv_id, call_id, bool_or(role = 'user') AS has_call, bool_or(role = 'assistant') AS has_result
            FROM t WHERE call_id IS NOT NULL GROUP BY ALL
        ), m AS (
            SELECT t.conv_id, t.turn, CAST(2 * coalesce(depth, 0) + CASE WHEN role = 'assistant' AND has_call THEN 1 ELSE 0 END AS INT) AS level,
                   CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS part, t.call_id,
                   CASE role WHEN 'user' THEN has_result WHEN 'assistant' THEN has_call END AS linked,
                   CASE WHEN role = 'user' THEN text_known END AS valid,
                   CASE role
                       WHEN 'user' THEN '{"content":null,"role":"user","tool_calls":[{"arguments":{"text":' || content || ',"turn":' || t.turn
                            || '},"id":"' || t.call_id || '","name":"answer"}]}'
                       WHEN 'assistant' THEN '{"content":' || content || CASE WHEN has_call THEN ',"name":"answer"' ELSE '' END
                            || ',"role":"assistant","tool_call_id":"' || t.call_id || '"}'
                       ELSE '{"content":' || content || ',"role":' || who || '}' END AS json
            FROM (SELECT *, content <> 'null' AS text_known FROM t) t LEFT JOIN sides USING (conv_id, call_id) LEFT JOIN chains USING (call_id)
        )
        SELECT *, sha256(json) AS json_sha256 FROM m
    """,
    # windows by list functions; each one but the first of its name removes its words
    "op9_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents
        ), windows AS (
            SELECT doc_id, start, sha256(array_to_string(words[start : start + 19], ' ')) AS name
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM d)
        ), later AS (
            SELECT doc_id, list(start) AS starts FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, start) AS nth FROM windows)
            WHERE nth > 1 GROUP BY doc_id
        ), gone AS (
            SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 20)))) AS places FROM later
        ), each AS (
            SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM d
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(places) AS place FROM gone
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(words[place], ' ' ORDER BY place) AS text
            FROM each ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op10_warc": """
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to
        FROM (SELECT *, strlen(coalesce(html, '')) >= 1000 AND page_id <> owner AS again
              FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages))
    """,
}
