"""Trace attributes over bodies built from conversations, documents, embeddings and MCP calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, with_views
from ..operators import traces as J
from ..operators.filtering import apply_trace_visibility
from ..operators.parse import parse_jsonrpc
from . import query
from .assemble import COMPLETION_CHUNKS, MESSAGE_EVENTS, RESPONSE_EVENTS
from .parse import mcp_raw
from .vectors import RERANK_SQL, _encode, rerank_bodies

CONV = "conv_id * 100 + turn AS request_id"
MCP = with_views("mcp_calls")
REQ = with_views("llm_requests")


def at(key: str, name: str, attributes: str = "attributes"):
    return F.try_element_at(attributes, F.lit(key)).alias(name)


def size():
    return F.size("attributes").cast("bigint").alias("n")


@query(
    "chat_request_attrs",
    f"""SELECT {CONV}, CAST(CASE turn % 4 WHEN 1 THEN CASE WHEN role = 'user' THEN 13 ELSE 11 END WHEN 2 THEN 12 ELSE 10 END AS BIGINT) AS n, 'LLM' AS kind, concat('model-', CAST(conv_id % 5 AS STRING)) AS model,
  role AS role1, CASE WHEN turn % 4 <> 1 THEN text END AS content1, CASE WHEN turn % 4 = 1 THEN text END AS part10,
  CASE WHEN turn % 4 = 1 AND role = 'user' THEN concat('https://img.example/', CAST(conv_id AS STRING)) END AS image11,
  concat('{{"model":"model-', CAST(conv_id % 5 AS STRING), '","stream":', CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END,
    CASE WHEN conv_id % 4 = 0 THEN ',"stream_options":{{"include_usage":true}}' ELSE '' END, ',"temperature":0.5}}') AS params
  FROM conversations WHERE turn % 4 <> 3""",
)
def _(t: Tables):
    a = J.chat_request_attrs(t.chat_requests.where("turn % 4 <> 3"))
    m = "llm.input_messages.1.message"
    return a.select(
        "request_id", size(), at(J.SPAN_KIND, "kind"), at(J.MODEL, "model"), at(f"{m}.role", "role1"), at(f"{m}.content", "content1"),
        at(f"{m}.contents.0.message_content.text", "part10"), at(f"{m}.contents.1.message_content.image.image.url", "image11"), at(J.PARAMETERS, "params"),
    )


@query(
    "chat_response_attrs",
    f"""SELECT {CONV}, CAST(CASE WHEN turn % 3 = 2 THEN 13 ELSE 8 END AS BIGINT) AS n, concat('model-', CAST(conv_id % 5 AS STRING)) AS model,
  CASE WHEN turn % 3 <> 2 THEN text END AS content0, CASE WHEN turn % 3 = 2 THEN 'lookup' END AS call0, CASE WHEN turn % 3 = 2 THEN concat('b', CAST(conv_id AS STRING)) END AS call1,
  CAST(length(text) AS STRING) AS prompt, CAST(turn AS STRING) AS completion FROM conversations WHERE role = 'assistant'""",
)
def _(t: Tables):
    a = J.chat_response_attrs(t.chat_responses)
    m = "llm.output_messages.0.message"
    return a.select(
        "request_id", size(), at(J.MODEL, "model"), at(f"{m}.content", "content0"), at(f"{m}.tool_calls.0.tool_call.function.name", "call0"),
        at(f"{m}.tool_calls.1.tool_call.id", "call1"), at(J.TOKENS_PROMPT, "prompt"), at(J.TOKENS_COMPLETION, "completion"),
    )


@query(
    "embeddings_attrs",
    """SELECT e.vec_id AS request_id, CAST(CASE e.vec_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 13 ELSE 11 END AS BIGINT) AS n, 'embed-x' AS model,
  CASE WHEN e.vec_id % 3 < 2 THEN d.source END AS text0, CASE WHEN e.vec_id % 3 = 1 THEN d.lang END AS text1,
  round(CAST(e.embedding[1] AS DOUBLE), 6) AS head, '{"model":"embed-x","dimensions":64}' AS params FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id""",
)
def _(t: Tables):
    x = t.embeddings.withColumn("enc", _encode("embedding")).join(t.documents, F.col("vec_id") == F.col("doc_id")).selectExpr(
        "vec_id AS request_id",
        """concat('{"model":"embed-x","dimensions":64,"input":', CASE vec_id % 3 WHEN 0 THEN concat('"', source, '"') WHEN 1 THEN to_json(array(source, lang)) ELSE '[1,2,3]' END, '}') AS request_body""",
        """concat('{"model":"embed-x","data":[{"embedding":"', enc, '"},{"embedding":[0.5,0.25]}],"usage":{"prompt_tokens":3,"total_tokens":3}}') AS response_body""",
    )
    a = J.embeddings_attrs(x)
    v = F.from_json(F.try_element_at("attributes", F.lit("embedding.embeddings.0.embedding.vector")), "array<double>")
    return a.select(
        "request_id", size(), at(J.EMBEDDING_MODEL, "model"), at("embedding.embeddings.0.embedding.text", "text0"), at("embedding.embeddings.1.embedding.text", "text1"),
        F.round(v[0], 6).alias("head"), at(J.EMBEDDING_PARAMETERS, "params"),
    )


@query(
    "completions_attrs",
    """SELECT doc_id AS request_id, CAST(CASE doc_id % 3 WHEN 0 THEN 14 WHEN 1 THEN 15 ELSE 13 END AS BIGINT) AS n, CASE WHEN doc_id % 3 < 2 THEN text END AS prompt0,
  CASE WHEN doc_id % 3 = 1 THEN source END AS prompt1, source AS choice0, text AS choice1, '{"max_tokens":5,"model":"c"}' AS params FROM documents""",
)
def _(t: Tables):
    x = t.documents.selectExpr(
        "doc_id AS request_id",
        """CASE doc_id % 3 WHEN 0 THEN to_json(named_struct('model', 'c', 'prompt', text, 'max_tokens', 5)) WHEN 1 THEN to_json(named_struct('model', 'c', 'prompt', array(text, source), 'max_tokens', 5))
           ELSE '{"model":"c","prompt":[1,2],"max_tokens":5}' END AS request_body""",
        "to_json(named_struct('model', 'c', 'choices', array(named_struct('text', source), named_struct('text', text)), 'usage', named_struct('prompt_tokens', 1, 'completion_tokens', 2, 'total_tokens', 3))) AS response_body",
    )
    a = J.completions_attrs(x)
    params = F.from_json(F.try_element_at("attributes", F.lit(J.PARAMETERS)), "max_tokens int, model string")
    return a.select(
        "request_id", size(), at("llm.prompts.0.prompt.text", "prompt0"), at("llm.prompts.1.prompt.text", "prompt1"), at("llm.choices.0.completion.text", "choice0"),
        at("llm.choices.1.completion.text", "choice1"), F.to_json(params).alias("params"),
    )


@query(
    "responses_attrs",
    f"""SELECT {CONV}, CAST(CASE turn % 3 WHEN 0 THEN 22 ELSE 33 END AS BIGINT) AS n, 'be kind' AS system0, CASE turn % 3 WHEN 0 THEN text END AS user1,
  CASE WHEN turn % 3 <> 0 THEN text END AS part1, CASE WHEN turn % 3 <> 0 THEN 'lookup' END AS call2, CASE WHEN turn % 3 <> 0 THEN concat('"', CAST(conv_id AS STRING), '"') END AS answer3,
  CASE WHEN turn % 3 <> 0 THEN 'thinking' END AS thought4, text AS out0, 'send' AS out_call1, CAST(turn + 1 AS STRING) AS prompt FROM conversations""",
)
def _(t: Tables):
    x = t.sql(
        """SELECT conv_id * 100 + turn AS request_id,
             CASE WHEN turn % 3 = 0 THEN to_json(named_struct('model', 'm', 'instructions', 'be kind', 'temperature', 1, 'input', text)) ELSE
               concat('{{"model":"m","instructions":"be kind","temperature":1,"input":[', concat_ws(',',
                 to_json(named_struct('type', 'message', 'role', 'user', 'content', array(named_struct('type', 'input_text', 'text', text)))),
                 to_json(named_struct('type', 'function_call', 'call_id', concat('c', conv_id), 'name', 'lookup', 'arguments', '{{}}')),
                 to_json(named_struct('type', 'function_call_output', 'call_id', concat('c', conv_id), 'output', CAST(conv_id AS STRING))),
                 to_json(named_struct('type', 'reasoning', 'summary', array(named_struct('type', 'summary_text', 'text', 'thinking')))),
                 to_json(named_struct('type', 'mcp_call', 'id', 'ignored'))), ']}}') END AS request_body,
             concat('{{"model":"m-1","output":[', concat_ws(',',
                 to_json(named_struct('type', 'message', 'role', 'assistant', 'content', array(named_struct('type', 'output_text', 'text', text)))),
                 to_json(named_struct('type', 'function_call', 'call_id', 'k', 'name', 'send', 'arguments', '{{}}'))), '],"usage":{{"input_tokens":', turn + 1, ',"output_tokens":2,"total_tokens":', turn + 3, '}}}}') AS response_body
           FROM {c}""",
        c=t.conversations,
    )
    a = J.responses_attrs(x)
    i, o = "llm.input_messages", "llm.output_messages"
    return a.select(
        "request_id", size(), at(f"{i}.0.message.content", "system0"), at(f"{i}.1.message.content", "user1"), at(f"{i}.1.message.contents.0.message_content.text", "part1"),
        at(f"{i}.2.message.tool_calls.0.tool_call.function.name", "call2"), at(f"{i}.3.message.content", "answer3"),
        at(f"{i}.4.message.contents.0.message_content.text", "thought4"), at(f"{o}.0.message.contents.0.message_content.text", "out0"),
        at(f"{o}.1.message.tool_calls.0.tool_call.function.name", "out_call1"), at(J.TOKENS_PROMPT, "prompt"),
    )


def message_bodies(t: Tables):
    return t.sql(
        """SELECT conv_id * 100 + turn AS request_id, 'messages' AS operation,
             CASE WHEN turn % 2 = 0 THEN to_json(named_struct('model', 'claude-x', 'max_tokens', 9, 'messages', array(named_struct('role', 'user', 'content', text))))
                  ELSE to_json(named_struct('model', 'claude-x', 'max_tokens', 9, 'messages', array(named_struct('role', 'user', 'content', array(
                         named_struct('type', 'image', 'text', NULL), named_struct('type', 'text', 'text', text)))))) END AS request_body,
             to_json(named_struct('model', 'claude-y', 'role', 'assistant', 'content', array(named_struct('type', 'text', 'text', text, 'id', NULL, 'name', NULL, 'input', NULL),
                     named_struct('type', 'tool_use', 'text', NULL, 'id', 't1', 'name', 'lookup', 'input', named_struct('turn', turn))),
                     'usage', named_struct('input_tokens', turn, 'output_tokens', 2, 'cache_read_input_tokens', 3))) AS response_body,
             CASE WHEN conv_id % 5 = 0 THEN 429 ELSE 200 END AS status, map('x-tenant', CAST(conv_id AS STRING)) AS headers
           FROM {c}""",
        c=t.conversations,
    )


@query(
    "messages_attrs",
    f"""SELECT {CONV}, CAST(CASE WHEN turn % 2 = 0 THEN 21 ELSE 22 END AS BIGINT) AS n, 'anthropic' AS system, 'claude-y' AS model, CASE WHEN turn % 2 = 0 THEN text END AS content0,
  CASE WHEN turn % 2 = 1 THEN text END AS part01, text AS out0, concat('{{"turn":', CAST(turn AS STRING), '}}') AS out1, CAST(turn + 3 AS STRING) AS prompt, CAST(turn + 5 AS STRING) AS total,
  '{{"max_tokens":9,"model":"claude-x"}}' AS params FROM conversations""",
)
def _(t: Tables):
    a = J.messages_attrs(message_bodies(t))
    i, o = "llm.input_messages", "llm.output_messages"
    params = F.from_json(F.try_element_at("attributes", F.lit(J.PARAMETERS)), "max_tokens int, model string")
    return a.select(
        "request_id", size(), at(J.SYSTEM, "system"), at(J.MODEL, "model"), at(f"{i}.0.message.content", "content0"), at(f"{i}.0.message.contents.1.message_content.text", "part01"),
        at(f"{o}.0.message.content", "out0"), at(f"{o}.1.message.tool_calls.0.tool_call.function.arguments", "out1"), at(J.TOKENS_PROMPT, "prompt"), at(J.TOKENS_TOTAL, "total"),
        F.to_json(params).alias("params"),
    )


@query(
    "rerank_attrs",
    f"""WITH {RERANK_SQL}, a AS (SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE part <> '') AS full_parts, arg_min(part, i) AS doc0, arg_min(score, i) AS score0 FROM s GROUP BY 1)
  SELECT a.doc_id AS request_id, 11 + c + full_parts AS n, nullif(doc0, '') AS doc0, CAST(score0 AS DOUBLE) AS score0, CAST(n_chars AS STRING) AS prompt, CAST(n_chars + 2 AS STRING) AS total FROM a JOIN documents USING (doc_id)""",
)
def _(t: Tables):
    a = J.rerank_attrs(rerank_bodies(t))
    return a.select(
        "request_id", size(), at("reranker.input_documents.0.document.content", "doc0"),
        at("reranker.output_documents.0.document.score", "s").cast("double").alias("score0"), at(J.TOKENS_PROMPT, "prompt"), at(J.TOKENS_TOTAL, "total"),
    )


@query(
    "image_speech_attrs",
    f"""SELECT {CONV}, CASE WHEN turn % 2 = 0 THEN 5 ELSE 6 END AS n, CASE WHEN turn % 2 = 1 THEN 'tts' END AS model, text AS shown, CASE WHEN turn % 2 = 1 THEN 'alloy' END AS voice FROM conversations""",
)
def _(t: Tables):
    x = t.sql(
        """SELECT conv_id * 100 + turn AS request_id, CASE WHEN turn % 2 = 0 THEN 'image_generation' ELSE 'speech' END AS operation,
             CASE WHEN turn % 2 = 0 THEN to_json(named_struct('model', 'img', 'prompt', text)) ELSE to_json(named_struct('model', 'tts', 'input', text, 'voice', 'alloy')) END AS request_body FROM {c}""",
        c=t.conversations,
    )
    a = J.image_speech_attrs(x)
    value = F.try_element_at("attributes", F.lit(J.INPUT_VALUE))
    return a.select(
        "request_id", F.size("attributes").alias("n"), at(J.MODEL, "model"),
        F.coalesce(F.get_json_object(value, "$.prompt"), F.get_json_object(value, "$.input")).alias("shown"), F.get_json_object(value, "$.voice").alias("voice"),
    )


@query(
    "mcp_attrs",
    MCP
    + """SELECT call_id, CASE call_id % 5 WHEN 0 THEN 5 ELSE CASE WHEN duration_ms <> 0 THEN 4 ELSE 3 END END AS n, CASE WHEN call_id % 5 = 0 THEN full_tool_name END AS tool,
  CASE WHEN call_id % 5 = 3 AND duration_ms <> 0 THEN CAST(duration_ms AS DOUBLE) END AS progress FROM mcp_calls WHERE call_id % 5 IN (0, 3)""",
)
def _(t: Tables):
    m = parse_jsonrpc(mcp_raw(t)).where("kind IN ('request', 'notification')")
    a = J.mcp_attrs(m)
    return a.select(
        "call_id", F.size("attributes").alias("n"), at("mcp.tool.name", "tool"), at("mcp.notifications.progress", "p").cast("double").alias("progress")
    )


@query(
    "build_spans",
    f"""SELECT {CONV}, 'Message' AS span_name, CASE WHEN conv_id % 5 = 0 THEN 'Error' ELSE 'Ok' END AS span_status, CAST(conv_id AS STRING) AS tenant,
  CASE WHEN conv_id % 5 = 0 THEN 'claude-x' ELSE 'claude-y' END AS model, CASE WHEN conv_id % 5 = 0 THEN 'RateLimitError' END AS exception_type FROM conversations""",
)
def _(t: Tables):
    s = J.build_spans(message_bodies(t), ["messages", "chat"], {"x-tenant": "tenant.id"})
    return s.select("request_id", "span_name", "span_status", at("tenant.id", "tenant"), at(J.MODEL, "model"), "exception_type")


STREAM_KINDS = ("chat", "completion", "responses", "messages")


def stream_requests(t: Tables):
    """One streamed request of each kind per assistant turn; every fifth conversation fails after its first chunks."""
    return t.sql(
        """SELECT (conv_id * 100 + turn) * 4 + k AS request_id, operation, to_json(named_struct('model', 'asked')) AS request_body,
             CASE WHEN conv_id % 5 = 0 THEN 'overloaded' END AS response_body, CASE WHEN conv_id % 5 = 0 THEN 429 ELSE 200 END AS status,
             map('x-tenant', CAST(conv_id AS STRING)) AS headers
           FROM {c} LATERAL VIEW posexplode(array('chat', 'completion', 'responses', 'messages')) o AS k, operation WHERE role = 'assistant'""",
        c=t.conversations,
    )


def stream_chunks(t: Tables):
    kinds = [t.chat_chunks.select("request_id", "seq", "chunk"), t.sql(COMPLETION_CHUNKS, c=t.conversations)]
    kinds += [t.sql(sql, c=t.conversations).withColumnRenamed("data", "chunk") for sql in (RESPONSE_EVENTS, MESSAGE_EVENTS)]
    parts = [
        df.selectExpr(f"request_id * 4 + {k} AS request_id", f"'{name}' AS operation", "CAST(seq AS BIGINT) AS seq", "chunk", "CAST(seq * 10 + 7 AS BIGINT) AS recv_ms")
        for k, (name, df) in enumerate(zip(STREAM_KINDS, kinds, strict=True))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_STREAMED = f"""WITH a AS (SELECT {CONV}, conv_id, turn, text, CAST(len(regexp_extract_all(text, ' ')) + 1 AS BIGINT) AS n, conv_id % 5 <> 0 AS ok FROM conversations WHERE role = 'assistant'),
  r AS (SELECT request_id * 4 AS request_id, conv_id, ok, 'ChatCompletion' AS span_name, concat('model-', CAST(conv_id % 5 AS STRING)) AS model, text AS text0, CAST(NULL AS STRING) AS text1,
      CAST(NULL AS STRING) AS call2, nullif(conv_id, 0) AS prompt, n AS completion, NULL AS done_ms FROM a
    UNION ALL SELECT request_id * 4 + 1, conv_id, ok, 'Completion', concat('m', CAST(conv_id % 3 AS STRING)), text, translate(text, 'e', '3'), NULL, 1, n, NULL FROM a
    UNION ALL SELECT request_id * 4 + 2, conv_id, ok, 'Responses', 'r-1', text, NULL, NULL, turn + 1, 2, 27 FROM a
    UNION ALL SELECT request_id * 4 + 3, conv_id, ok, 'Message', 'claude-x', NULL, text, CASE WHEN turn % 3 <> 0 THEN concat('{{"turn":', CAST(turn AS STRING), '}}') END, turn, length(text), NULL FROM a)
  SELECT request_id, span_name, CASE WHEN ok THEN 'Ok' ELSE 'Error' END AS span_status, CAST(conv_id AS STRING) AS tenant, CASE WHEN ok THEN model ELSE 'asked' END AS model,
    CASE WHEN ok THEN text0 END AS text0, CASE WHEN ok THEN text1 END AS text1, CASE WHEN ok THEN call2 END AS call2, CASE WHEN ok THEN CAST(prompt AS STRING) END AS prompt,
    CASE WHEN ok THEN CAST(completion AS STRING) END AS completion, CASE WHEN ok THEN 'First Token Stream Event' END AS event0, CASE WHEN ok THEN 7 END AS at0,
    CASE WHEN ok THEN done_ms END AS done_ms, CASE WHEN NOT ok THEN 'RateLimitError' END AS exception_type, CASE WHEN NOT ok THEN 'Error code: 429 - overloaded' END AS exception_message FROM r"""


@query("build_stream_spans", _STREAMED)
def _(t: Tables):
    s = J.build_stream_spans(stream_requests(t), stream_chunks(t), STREAM_KINDS, {"x-tenant": "tenant.id"})
    o, c = "llm.output_messages", "llm.choices"

    def either(*keys):
        return F.coalesce(*[F.try_element_at("attributes", F.lit(k)) for k in keys])

    return s.select(
        "request_id", "span_name", "span_status", at("tenant.id", "tenant"), at(J.MODEL, "model"),
        either(f"{o}.0.message.content", f"{c}.0.completion.text", f"{o}.0.message.contents.0.message_content.text").alias("text0"),
        either(f"{o}.1.message.content", f"{c}.1.completion.text").alias("text1"), at(f"{o}.2.message.tool_calls.0.tool_call.function.arguments", "call2"),
        at(J.TOKENS_PROMPT, "prompt"), at(J.TOKENS_COMPLETION, "completion"),
        F.get("events", F.lit(0))["name"].alias("event0"), F.get("events", F.lit(0))["at_ms"].cast("int").alias("at0"),
        F.get(F.filter("events", lambda e: e["name"] == "Response Completed Event"), F.lit(0))["at_ms"].cast("int").alias("done_ms"),
        "exception_type", "exception_message",
    )


@query(
    "build_mcp_spans",
    MCP
    + """, m AS (SELECT call_id, 'tools/call' AS method, full_tool_name AS tool, CASE WHEN error_code IS NULL THEN 'Ok' ELSE 'Error' END AS span_status,
    CASE error_code WHEN -32602 THEN 'invalid_param' WHEN -32601 THEN 'unsupported_method' WHEN -32700 THEN 'invalid_json_rpc' WHEN -32603 THEN 'internal_error' END AS exception_type FROM mcp_calls)
  SELECT call_id, 'CallTool' AS span_name, tool, span_status, exception_type FROM m""",
)
def _(t: Tables):
    calls = t.mcp_calls.selectExpr("call_id", "CAST(call_id AS STRING) AS id", "'tools/call' AS method", "to_json(named_struct('name', full_tool_name)) AS params", "CAST(error_code AS BIGINT) AS error_code")
    return J.build_mcp_spans(calls, ["call_id"]).select("call_id", "span_name", at("mcp.tool.name", "tool"), "span_status", "exception_type")


@query(
    "unflatten_attrs",
    f"""SELECT {CONV}, 'input' AS side, 0 AS msg_idx, 'message' AS "group", CAST(NULL AS INT) AS sub_idx, 'role' AS field, 'user' AS value FROM conversations
  UNION ALL SELECT {CONV}, 'input', 0, 'message', NULL, 'content', text FROM conversations WHERE turn % 2 = 0
  UNION ALL SELECT {CONV}, 'input', 0, 'contents', 1, 'text', text FROM conversations WHERE turn % 2 = 1
  UNION ALL SELECT {CONV}, 'input', 0, 'contents', 1, 'type', 'text' FROM conversations WHERE turn % 2 = 1
  UNION ALL SELECT {CONV}, 'output', 0, 'message', NULL, 'role', 'assistant' FROM conversations
  UNION ALL SELECT {CONV}, 'output', 0, 'message', NULL, 'content', text FROM conversations
  UNION ALL SELECT {CONV}, 'output', 1, 'message', NULL, 'role', 'assistant' FROM conversations
  UNION ALL SELECT {CONV}, 'output', 1, 'tool_calls', 0, 'id', 't1' FROM conversations
  UNION ALL SELECT {CONV}, 'output', 1, 'tool_calls', 0, 'function.name', 'lookup' FROM conversations
  UNION ALL SELECT {CONV}, 'output', 1, 'tool_calls', 0, 'function.arguments', concat('{{"turn":', CAST(turn AS STRING), '}}') FROM conversations""",
)
def _(t: Tables):
    return J.unflatten_attrs(J.messages_attrs(message_bodies(t)))


@query(
    "apply_trace_visibility",
    f"""SELECT {CONV}, '__REDACTED__' AS shown, '__REDACTED__' AS out0, CAST(NULL AS STRING) AS role0, CAST(turn + 3 AS STRING) AS prompt, CAST(NULL AS STRING) AS params,
  'lookup' AS call1 FROM conversations""",
)
def _(t: Tables):
    a = apply_trace_visibility(
        J.messages_attrs(message_bodies(t)), hide_inputs=True, hide_output_text=True, hide_invocation_parameters=True
    )
    o = "llm.output_messages"
    return a.select(
        "request_id", at(J.INPUT_VALUE, "shown"), at(f"{o}.0.message.content", "out0"), at("llm.input_messages.0.message.role", "role0"), at(J.TOKENS_PROMPT, "prompt"),
        at(J.PARAMETERS, "params"), at(f"{o}.1.message.tool_calls.0.tool_call.function.name", "call1"),
    )
