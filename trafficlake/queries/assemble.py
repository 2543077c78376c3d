"""Stream assembly over chunk streams cut from the assistant turns, and stream latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, with_views
from ..operators import assemble as A
from . import query

CHUNKS = with_views("sse_chunks")
CONV = "conv_id * 100 + turn AS request_id"
_ASSISTANT = "FROM conversations WHERE role = 'assistant'"


@query(
    "assemble_chat",
    f"""SELECT {CONV}, concat('c', CAST(conv_id AS STRING)) AS id, concat('model-', CAST(conv_id % 5 AS STRING)) AS model, 1700000000 + conv_id AS created,
  'assistant' AS role, text AS content, CASE WHEN turn % 2 = 1 THEN 'length' ELSE 'stop' END AS finish_reason, conv_id AS prompt_tokens,
  CAST(len(regexp_extract_all(text, ' ')) + 1 AS BIGINT) AS n_chunks {_ASSISTANT}""",
)
def _(t: Tables):
    return A.assemble_chat(t.chat_chunks).select(
        "request_id", "id", "model", "created", "role", "content", "finish_reason", F.col("usage.prompt_tokens").alias("prompt_tokens"), "n_chunks"
    )


COMPLETION_CHUNKS = """SELECT request_id, CAST(pos AS BIGINT) AS seq, to_json(named_struct('id', concat('k', pos), 'model', concat('m', conv_id % 3), 'created', 100 + pos,
      'choices', CASE WHEN pos = 0 THEN array(named_struct('index', 0, 'text', piece, 'finish_reason', NULL), named_struct('index', 1, 'text', translate(piece, 'e', '3'), 'finish_reason', NULL))
                      ELSE array(named_struct('index', 0, 'text', piece, 'finish_reason', CASE WHEN pos = n - 1 THEN 'stop' END),
                                 named_struct('index', 1, 'text', translate(piece, 'e', '3'), 'finish_reason', NULL),
                                 named_struct('index', 7, 'text', 'stray', 'finish_reason', NULL)) END,
      'usage', CASE WHEN pos = n - 1 THEN named_struct('prompt_tokens', 1, 'completion_tokens', n, 'total_tokens', n + 1) END)) AS chunk
  FROM (SELECT conv_id * 100 + turn AS request_id, conv_id, posexplode(split(text, '(?<= )')) AS (pos, piece), size(split(text, '(?<= )')) AS n
        FROM {c} WHERE role = 'assistant')"""


@query(
    "assemble_completions",
    f"""WITH a AS (SELECT {CONV}, conv_id, text, CAST(len(regexp_extract_all(text, ' ')) + 1 AS BIGINT) AS n {_ASSISTANT})
  SELECT request_id, choice, concat('k', CAST(n - 1 AS STRING)) AS id, concat('m', CAST(conv_id % 3 AS STRING)) AS model, 99 + n AS created,
    n AS completion_tokens, CASE choice WHEN 0 THEN text ELSE translate(text, 'e', '3') END AS text, CASE WHEN choice = 0 AND n > 1 THEN 'stop' END AS finish_reason
  FROM a, (VALUES (0), (1)) AS c(choice)""",
)
def _(t: Tables):
    return A.assemble_completions(t.sql(COMPLETION_CHUNKS, c=t.conversations)).select(
        "request_id", "choice", "id", "model", "created", F.col("usage.completion_tokens").alias("completion_tokens"), "text", "finish_reason"
    )


RESPONSE_EVENTS = """SELECT conv_id * 100 + turn AS request_id, pos AS seq, data FROM {c} LATERAL VIEW posexplode(array(
    to_json(named_struct('type', 'response.created', 'response', named_struct('id', 'x'))),
    to_json(named_struct('type', 'response.output_text.delta', 'delta', text)),
    to_json(named_struct('type', 'response.completed', 'response', named_struct('id', 'x', 'model', 'r-1', 'text', text,
      'output', array(named_struct('type', 'message', 'role', 'assistant', 'content', array(named_struct('type', 'output_text', 'text', text)))),
      'usage', named_struct('input_tokens', turn + 1, 'output_tokens', 2, 'total_tokens', turn + 3)))))) p AS pos, data
  WHERE role = 'assistant'"""


@query("assemble_responses", f"SELECT {CONV}, text {_ASSISTANT}")
def _(t: Tables):
    events = t.sql(RESPONSE_EVENTS, c=t.conversations)
    return A.assemble_responses(events).select("request_id", F.get_json_object("response_body", "$.text").alias("text"))


MESSAGE_EVENTS = """SELECT request_id, CAST(pos AS BIGINT) AS seq, data FROM (
    SELECT conv_id * 100 + turn AS request_id, conv_id, turn, text FROM {c} WHERE role = 'assistant')
  LATERAL VIEW posexplode(array(
    to_json(named_struct('type', 'message_start', 'message', named_struct('id', concat('m', conv_id), 'model', 'claude-x', 'role', 'assistant', 'usage', named_struct('input_tokens', turn, 'output_tokens', 1)))),
    to_json(named_struct('type', 'content_block_start', 'index', 0, 'content_block', named_struct('type', 'thinking', 'thinking', ''))),
    to_json(named_struct('type', 'content_block_delta', 'index', 0, 'delta', named_struct('thinking', substr(text, 1, 10)))),
    to_json(named_struct('type', 'content_block_delta', 'index', 0, 'delta', named_struct('signature', concat('sig', conv_id)))),
    to_json(named_struct('type', 'content_block_stop', 'index', 0)),
    to_json(named_struct('type', 'content_block_start', 'index', 1, 'content_block', named_struct('type', 'text', 'text', ''))),
    to_json(named_struct('type', 'content_block_delta', 'index', 1, 'delta', named_struct('text', substr(text, 1, 50)))),
    to_json(named_struct('type', 'content_block_delta', 'index', 1, 'delta', named_struct('text', substr(text, 51)))),
    to_json(named_struct('type', 'content_block_stop', 'index', 1)),
    to_json(named_struct('type', 'content_block_start', 'index', 2, 'content_block', named_struct('type', 'tool_use', 'id', concat('t', conv_id), 'name', 'lookup'))),
    to_json(named_struct('type', 'content_block_delta', 'index', 2, 'delta', named_struct('partial_json', '{{"turn":'))),
    to_json(named_struct('type', 'content_block_delta', 'index', 2, 'delta', named_struct('partial_json', concat(turn, CASE WHEN turn % 3 = 0 THEN '' ELSE '}}' END)))),
    to_json(named_struct('type', 'content_block_stop', 'index', 2)),
    to_json(named_struct('type', 'message_delta', 'delta', named_struct('stop_reason', 'tool_use'), 'usage', named_struct('output_tokens', length(text)))),
    to_json(named_struct('type', 'message_stop')))) p AS pos, data"""


@query(
    "assemble_messages",
    f"""SELECT {CONV}, concat('m', CAST(conv_id AS STRING)) AS id, turn AS input_tokens, CAST(length(text) AS BIGINT) AS output_tokens, 'tool_use' AS stop_reason,
  substr(text, 1, 10) AS thinking, concat('sig', CAST(conv_id AS STRING)) AS signature, text, 'lookup' AS tool_name,
  CASE WHEN turn % 3 <> 0 THEN concat('{{"turn":', CAST(turn AS STRING), '}}') END AS tool_input {_ASSISTANT}""",
)
def _(t: Tables):
    m = A.assemble_messages(t.sql(MESSAGE_EVENTS, c=t.conversations))
    return m.select(
        "request_id", "id", "input_tokens", "output_tokens", "stop_reason",
        F.col("content")[0]["thinking"].alias("thinking"), F.col("content")[0]["signature"].alias("signature"),
        F.col("content")[1]["text"].alias("text"), F.col("content")[2]["tool_name"].alias("tool_name"),
        F.col("content")[2]["tool_input"].alias("tool_input"),
    )


LATENCY_SQL = (
    CHUNKS
    + """, s AS (SELECT request_id, min(recv_ms) / 1000.0 AS ttft, max(recv_ms) FILTER (WHERE seq > 0 AND end_of_stream) / 1000.0 AS e, max(output_tokens) FILTER (WHERE seq > 0) AS k FROM sse_chunks GROUP BY 1)"""
)


@query(
    "stream_latency",
    LATENCY_SQL
    + """ SELECT request_id, round(CAST(ttft AS DOUBLE), 12) AS ttft_s, round(CASE WHEN k > 1 THEN (CAST(e AS DOUBLE) - CAST(ttft AS DOUBLE)) / (k - 1) END, 12) AS tpot_s,
  CAST(floor(round(CAST(ttft AS DOUBLE) * 1000, 6)) AS BIGINT) AS ttft_ms FROM s""",
)
def _(t: Tables):
    return A.stream_latency(t.sse_chunks).select(
        "request_id", F.round("ttft_s", 12).alias("ttft_s"), F.round("tpot_s", 12).alias("tpot_s"), "ttft_ms"
    )
