"""Parsing and classification over derived requests, bodies and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, with_views
from ..operators import parse as P
from . import query

REQ = with_views("llm_requests")
MCP = with_views("mcp_calls")
FILT = with_views("filter_calls")
CONV = "conv_id * 100 + turn AS request_id"


@query(
    "classify_endpoint",
    """
SELECT operation, count(*) AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'chat' WHEN 'view' THEN 'embeddings' WHEN 'purchase' THEN 'messages'
              WHEN 'signup' THEN 'rerank' ELSE CASE event_id % 2 WHEN 0 THEN 'unsupported' ELSE 'models' END END AS operation
  FROM events) GROUP BY 1""",
)
def _(t: Tables):
    paths = t.sql(
        """SELECT event_id, concat(CASE event_type WHEN 'click' THEN '/v1/chat/completions' WHEN 'view' THEN '/v1/embeddings'
               WHEN 'purchase' THEN '/anthropic/v1/messages' WHEN 'signup' THEN '/cohere/v2/rerank'
               ELSE CASE event_id % 2 WHEN 0 THEN '/v1/files' ELSE '/v1/models' END END,
               CASE WHEN event_id % 3 = 0 THEN '?beta=true' ELSE '' END) AS path FROM {events}""",
        events=t.events,
    )
    return P.classify_endpoint(paths).groupBy("operation").agg(F.count("*").alias("n"))


@query(
    "parse_request",
    f"""
SELECT {CONV}, CASE WHEN turn % 4 <> 3 THEN concat('model-', CAST(conv_id % 5 AS STRING)) END AS model,
       turn % 4 <> 3 AND conv_id % 2 = 0 AS stream, turn % 4 <> 3 AND conv_id % 4 = 0 AS include_usage,
       CAST(CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN 3 ELSE 2 END AS BIGINT) AS n_messages,
       turn % 4 = 3 AS malformed, CASE WHEN turn % 4 = 3 THEN 'malformed_request' END AS error
FROM conversations""",
)
def _(t: Tables):
    return P.parse_request(t.chat_requests).select(
        "request_id", "model", "stream", "include_usage", "n_messages", "malformed", "error"
    )


@query(
    "flag_usage_bypass",
    f"SELECT {CONV}, turn % 4 <> 3 AND conv_id % 4 = 2 AS needs_include_usage FROM conversations",
)
def _(t: Tables):
    return P.flag_usage_bypass(P.parse_request(t.chat_requests)).select("request_id", "needs_include_usage")


@query(
    "classify_union_input",
    """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'string[]' WHEN 2 THEN 'int[]' WHEN 3 THEN 'int[][]'
                   WHEN 4 THEN 'object[]' ELSE 'invalid' END AS kind,
       CAST(CASE doc_id % 6 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 0 ELSE 1 END AS BIGINT) AS n_inputs
FROM documents""",
)
def _(t: Tables):
    inputs = t.sql(
        """SELECT doc_id, CASE doc_id % 6
             WHEN 0 THEN get_json_object(to_json(array(to_json(named_struct('x', text)))), '$')
             WHEN 1 THEN to_json(array(text, source))
             WHEN 2 THEN to_json(array(doc_id, n_chars))
             WHEN 3 THEN to_json(array(array(doc_id), array(n_chars, 1), array(2)))
             WHEN 4 THEN to_json(array(named_struct('content', text)))
             ELSE to_json(array(named_struct('content', '')))
           END AS input FROM {docs}""",
        docs=t.documents,
    ).withColumn(
        "input",
        # A lone JSON string is the element of a one-element array without its brackets.
        F.when(F.col("doc_id") % 6 == 0, F.expr("substring(input, 2, length(input) - 2)")).otherwise(F.col("input")),
    )
    return P.classify_union_input(inputs, "input").select("doc_id", "kind", "n_inputs")


@query(
    "explode_messages",
    f"""
SELECT {CONV}, 0 AS msg_idx, 'system' AS role, 'be brief' AS plain FROM conversations WHERE turn % 4 <> 3
UNION ALL SELECT {CONV}, 1, role, CASE WHEN turn % 4 <> 1 THEN text END FROM conversations WHERE turn % 4 <> 3
UNION ALL SELECT {CONV}, 2, 'assistant', NULL FROM conversations WHERE turn % 4 = 2""",
)
def _(t: Tables):
    m = P.explode_messages(t.chat_requests)
    plain = F.get_json_object("content_json", "$.content")
    return m.select(
        "request_id", "msg_idx", "role",
        F.when(~((F.col("request_id") % 100 % 4 == 1) & (F.col("msg_idx") == 1)), plain).alias("plain"),
    )


@query(
    "explode_content_parts",
    f"""
SELECT {CONV}, 0 AS msg_idx, 'system' AS role, 0 AS part_idx, 'text' AS part_type, 'be brief' AS text, NULL AS url
FROM conversations WHERE turn % 4 <> 3
UNION ALL SELECT {CONV}, 1, role, 0, 'text', text, NULL FROM conversations WHERE turn % 4 <> 3
UNION ALL SELECT {CONV}, 1, role, 1, 'image', NULL, concat('https://img.example/', CAST(conv_id AS STRING)) FROM conversations WHERE turn % 4 = 1""",
)
def _(t: Tables):
    return P.explode_content_parts(P.explode_messages(t.chat_requests))


@query(
    "explode_tool_calls",
    f"""
SELECT {CONV}, 0 AS choice, 0 AS call_idx, concat('a', CAST(conv_id AS STRING)) AS id, 'lookup' AS name
FROM conversations WHERE role = 'assistant' AND turn % 3 = 2
UNION ALL SELECT {CONV}, 0, 1, concat('b', CAST(conv_id AS STRING)), 'send' FROM conversations WHERE role = 'assistant' AND turn % 3 = 2""",
)
def _(t: Tables):
    return P.explode_tool_calls(t.chat_responses).drop("arguments")


@query(
    "explode_tools",
    f"SELECT {CONV}, 0 AS tool_idx, concat('tool_', CAST(turn AS STRING)) AS name FROM conversations WHERE turn % 4 = 2",
)
def _(t: Tables):
    return P.explode_tools(t.chat_requests).select(
        "request_id", "tool_idx", F.get_json_object("tool_json", "$.function.name").alias("name")
    )


@query(
    "normalize_messages",
    f"""
SELECT {CONV}, 0 AS msg_idx, 0 AS part_idx, 'system' AS role, 'text' AS part_type, 'be kind' AS text, NULL AS error FROM conversations
UNION ALL
SELECT {CONV}, 1, 0, CASE WHEN role = 'system' AND conv_id % 4 = 3 THEN 'system' ELSE CASE role WHEN 'system' THEN 'user' ELSE role END END, 'text',
       CASE WHEN conv_id % 4 = 3 AND role = 'system' THEN NULL ELSE text END,
       CASE WHEN conv_id % 4 = 3 AND role = 'system' THEN 'invalid role system' END FROM conversations
UNION ALL
SELECT {CONV}, 1, 1, CASE role WHEN 'system' THEN 'user' ELSE role END, 'tool_result', concat('out ', CAST(turn AS STRING)), NULL FROM conversations
WHERE conv_id % 4 = 3 AND role <> 'system'""",
)
def _(t: Tables):
    bodies = t.sql(
        """SELECT conv_id * 100 + turn AS request_id,
             CASE conv_id % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'GCPVertexAI' WHEN 2 THEN 'AWSBedrock' ELSE 'Anthropic' END AS api_schema,
             CASE conv_id % 4
               WHEN 0 THEN to_json(named_struct('messages', array(
                  named_struct('role', 'system', 'content', 'be kind'),
                  named_struct('role', CASE role WHEN 'system' THEN 'user' ELSE role END, 'content', text))))
               WHEN 1 THEN to_json(named_struct('systemInstruction', named_struct('parts', array(named_struct('text', 'be kind'))),
                  'contents', array(named_struct('role', CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END, 'parts', array(named_struct('text', text))))))
               WHEN 2 THEN to_json(named_struct('system', array(named_struct('text', 'be kind')),
                  'messages', array(named_struct('role', CASE role WHEN 'system' THEN 'user' ELSE role END, 'content', array(named_struct('text', text))))))
               ELSE to_json(named_struct('system', 'be kind', 'messages', array(named_struct('role', role, 'content', array(
                     named_struct('type', 'text', 'text', text, 'content', NULL),
                     named_struct('type', 'tool_result', 'text', NULL, 'content', array(named_struct('type', 'text', 'text', concat('out ', turn)))))))))
             END AS request_body FROM {c}""",
        c=t.conversations,
    )
    return P.normalize_messages(bodies)


@query(
    "parse_sse",
    f"""
SELECT {CONV}, 0 AS event_idx, 0 AS data_idx, 'message' AS event, CAST(turn AS STRING) AS id, text FROM conversations
UNION ALL SELECT {CONV}, 1, 0, NULL, NULL, 'tail' FROM conversations""",
)
def _(t: Tables):
    payloads = t.sql(
        """SELECT conv_id * 100 + turn AS request_id,
             concat('event: message', nl, 'id: ', turn, nl, 'data: ', to_json(named_struct('text', text)), nl, nl,
                    'data: ', to_json(named_struct('text', 'tail')), nl, nl, 'data: [DONE]', nl) AS payload
           FROM (SELECT *, CASE turn % 3 WHEN 0 THEN '\\n' WHEN 1 THEN '\\r\\n' ELSE '\\r' END AS nl FROM {c})""",
        c=t.conversations,
    )
    return P.parse_sse(payloads).select(
        "request_id", "event_idx", "data_idx", "event", "id", F.get_json_object("data", "$.text").alias("text")
    )


def mcp_raw(t: Tables):
    """Raw JSON-RPC lines of the MCP calls: requests, responses, errors, notifications, junk."""
    return t.sql(
        """SELECT call_id, start_us, route, CASE call_id % 5
             WHEN 0 THEN to_json(named_struct('jsonrpc', '2.0', 'id', call_id, 'method', 'tools/call',
                                 'params', named_struct('name', full_tool_name)))
             WHEN 1 THEN concat('  ', to_json(named_struct('jsonrpc', '2.0', 'id', call_id, 'result', named_struct('isError', is_error))))
             WHEN 2 THEN to_json(named_struct('jsonrpc', '2.0', 'id', call_id, 'error',
                                 named_struct('code', coalesce(error_code, -32603), 'message', 'failed')))
             WHEN 3 THEN to_json(named_struct('jsonrpc', '2.0', 'method', 'notifications/progress',
                                 'params', named_struct('progress', duration_ms)))
             ELSE concat('{{"id":', call_id) END AS raw
           FROM {m}""",
        m=t.mcp_calls,
    )


@query(
    "parse_jsonrpc",
    MCP
    + """SELECT call_id, CASE call_id % 5 WHEN 0 THEN 'request' WHEN 1 THEN 'response' WHEN 2 THEN 'response' WHEN 3 THEN 'notification' ELSE 'invalid' END AS kind,
  CASE WHEN call_id % 5 < 3 THEN CAST(call_id AS STRING) END AS id,
  CASE call_id % 5 WHEN 0 THEN 'tools/call' WHEN 3 THEN 'notifications/progress' END AS method,
  CAST(CASE WHEN call_id % 5 = 2 THEN coalesce(error_code, -32603) END AS BIGINT) AS error_code,
  CASE WHEN call_id % 5 = 2 THEN 'failed' END AS error_message FROM mcp_calls""",
)
def _(t: Tables):
    return P.parse_jsonrpc(mcp_raw(t)).select("call_id", "kind", "id", "method", "error_code", "error_message")


@query(
    "split_tool_name",
    MCP
    + """SELECT call_id, CASE WHEN instr(full_tool_name, '__') > 0 THEN split_part(full_tool_name, '__', 1) END AS backend,
  CASE WHEN instr(full_tool_name, '__') > 0 THEN substr(full_tool_name, instr(full_tool_name, '__') + 2) END AS tool,
  instr(full_tool_name, '__') > 0 AS valid FROM mcp_calls""",
)
def _(t: Tables):
    return P.split_tool_name(t.mcp_calls).select("call_id", "backend", "tool", "valid")


@query(
    "split_resource_uri",
    """SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN concat('b', CAST(page_id % 3 AS STRING)) END AS backend,
  CASE WHEN page_id % 7 <> 0 THEN url END AS uri, page_id % 7 <> 0 AS valid FROM pages""",
)
def _(t: Tables):
    uris = t.sql(
        "SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN concat('b', page_id % 3, '+', url) ELSE replace(url, '+', '') END AS full_uri FROM {p}",
        p=t.table("pages"),
    )
    return P.split_resource_uri(uris).select("page_id", "backend", "uri", "valid")


HEADERS = """SELECT event_id, event_type, user_id, map_from_arrays(
    array('agent-session-id', 'x-tenant-id', 'accept'),
    array(CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('s', user_id % 40) END, CAST(user_id AS STRING), 'application/json')) AS headers
  FROM {e}"""


@query(
    "project_header_attributes",
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN concat('s', CAST(user_id % 40 AS STRING)) END AS session_id,
  CAST(user_id AS STRING) AS tenant_id FROM events""",
)
def _(t: Tables):
    return P.project_header_attributes(
        t.sql(HEADERS, e=t.events), "agent-session-id:session.id,x-tenant-id:tenant.id"
    ).select("event_id", "session_id", "tenant_id")


@query(
    "meta_or_header",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('m', CAST(user_id AS STRING))
       WHEN event_id % 4 <> 0 THEN concat('s', CAST(user_id % 40 AS STRING)) END AS session_id FROM events""",
)
def _(t: Tables):
    calls = t.sql(HEADERS, e=t.events).withColumn(
        "meta",
        F.expr(
            "CASE WHEN event_id % 3 = 0 THEN map('Agent-Session-ID', concat('m', user_id), 'agent-session-id', 'later')"
            " ELSE map('other', 'x') END"
        ),
    )
    return P.meta_or_header(calls, "agent-session-id:session.id").select("event_id", "session_id")


@query(
    "provider_name",
    REQ
    + """SELECT CASE api_schema WHEN 'OpenAI' THEN 'openai' WHEN 'AzureOpenAI' THEN 'azure.openai' WHEN 'GCPVertexAI' THEN 'gcp.vertex_ai'
  WHEN 'Anthropic' THEN 'anthropic' WHEN 'AWSAnthropic' THEN 'aws.anthropic' END AS provider, count(*) AS n FROM llm_requests GROUP BY 1""",
)
def _(t: Tables):
    return P.provider_name(t.llm_requests).groupBy("provider").agg(F.count("*").alias("n"))


@query(
    "resolve_models",
    REQ
    + """SELECT request_id, original_model, coalesce(model_override, original_model) AS request_model,
  CASE WHEN api_schema = 'GCPVertexAI' THEN coalesce(model_override, original_model)
       WHEN request_id % 3 = 0 THEN concat(original_model, '-2025') ELSE coalesce(model_override, original_model) END AS response_model
  FROM llm_requests""",
)
def _(t: Tables):
    r = t.llm_requests.withColumn(
        "body_model", F.expr("CASE WHEN request_id % 3 = 0 THEN concat(original_model, '-2025') WHEN request_id % 3 = 1 THEN '' END")
    )
    return P.resolve_models(r).select("request_id", "original_model", "request_model", "response_model")


@query(
    "parse_backend_ref",
    """SELECT event_id, CASE WHEN event_id % 9 > 0 THEN 'default' END AS namespace,
  CASE WHEN event_id % 9 > 0 THEN concat('b', CAST(event_id % 4 AS STRING)) END AS backend,
  CASE WHEN event_id % 9 > 0 THEN concat('r', CAST(user_id % 3 AS STRING)) END AS route,
  CASE WHEN event_id % 9 > 0 THEN event_id % 5 END AS rule_idx, CASE WHEN event_id % 9 > 0 THEN event_id % 2 END AS ref_idx FROM events""",
)
def _(t: Tables):
    refs = t.sql(
        """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'not-a-ref' ELSE
           concat('default/b', event_id % 4, '/route/r', user_id % 3, '/rule/', event_id % 5, '/ref/', event_id % 2) END AS backend_ref FROM {e}""",
        e=t.events,
    )
    return P.parse_backend_ref(refs).select("event_id", "namespace", "backend", "route", "rule_idx", "ref_idx")


SESSIONS = """SELECT event_id AS session_key, CASE WHEN event_id % 10 = 9 THEN 'broken' ELSE
     concat('route-', user_id % 3, '@user', user_id, '@corp@github:', base64(CAST(concat('sid', event_id) AS BINARY)), ':',
            lower(lpad(hex(event_id % 512), 3, '0')), ',jira:') END AS session FROM {e}"""


@query(
    "decode_session_id",
    """
SELECT event_id AS session_key, concat('route-', CAST(user_id % 3 AS STRING)) AS route, concat('user', CAST(user_id AS STRING), '@corp') AS subject,
       'github' AS backend, concat('sid', CAST(event_id AS STRING)) AS backend_session, CAST(event_id % 512 AS INT) AS caps, NULL AS error FROM events WHERE event_id % 10 <> 9
UNION ALL SELECT event_id, concat('route-', CAST(user_id % 3 AS STRING)), concat('user', CAST(user_id AS STRING), '@corp'), 'jira', '', 511, NULL FROM events WHERE event_id % 10 <> 9
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, 'missing ''@'' separator' FROM events WHERE event_id % 10 = 9""",
)
def _(t: Tables):
    return P.decode_session_id(t.sql(SESSIONS, e=t.events))


@query(
    "decode_capabilities",
    """
WITH b AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 511 ELSE event_id % 512 END AS bits FROM events)
SELECT event_id, bits & 1 <> 0 AS tools, bits & 3 = 3 AS tools_list_changed, bits & 4 <> 0 AS prompts, bits & 12 = 12 AS prompts_list_changed,
  bits & 16 <> 0 AS logging, bits & 32 <> 0 AS resources, bits & 96 = 96 AS resources_list_changed, bits & 160 = 160 AS resources_subscribe,
  bits & 256 <> 0 AS completions FROM b""",
)
def _(t: Tables):
    caps = t.sql(
        "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'zz' ELSE lower(lpad(hex(event_id % 512), 3, '0')) END AS caps FROM {e}",
        e=t.events,
    )
    return P.decode_capabilities(caps).drop("caps")


TOKENS = """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'Basic abc' ELSE concat(
      CASE WHEN event_id % 2 = 0 THEN 'Bearer ' ELSE 'bearer ' END,
      'eyJhbGciOiJub25lIn0.',
      replace(translate(base64(CAST(to_json(named_struct('sub', concat('user', user_id), 'scope', CASE WHEN event_id % 3 = 0 THEN 'read write' END,
           'scp', CASE WHEN event_id % 3 = 1 THEN array('admin', event_type) END, 'tenant', CAST(user_id % 5 AS STRING))) AS BINARY)), '+/', '-_'), '=', ''),
      '.sig') END AS authorization, user_id, event_type
  FROM {e}"""


@query(
    "decode_jwt_claims",
    """SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN concat('user', CAST(user_id AS STRING)) END AS sub,
  CASE WHEN event_id % 6 = 5 THEN '' WHEN event_id % 3 = 0 THEN 'read write' WHEN event_id % 3 = 1 THEN concat('admin ', event_type) ELSE '' END AS scopes,
  CASE WHEN event_id % 6 <> 5 THEN CAST(user_id % 5 AS STRING) END AS tenant FROM events""",
)
def _(t: Tables):
    return P.decode_jwt_claims(t.sql(TOKENS, e=t.events)).select(
        "event_id", "sub", F.array_join("scopes", " ").alias("scopes"),
        F.try_element_at("claims", F.lit("tenant")).alias("tenant"),
    )


@query(
    "declared_models",
    REQ
    + """SELECT original_model AS model, CASE WHEN tenant_group = 0 THEN 'team-a' ELSE 'platform' END AS owned_by, first_us AS created FROM (
  SELECT original_model, CAST(tenant AS BIGINT) % 2 AS tenant_group, min(start_us) AS first_us FROM llm_requests GROUP BY 1, 2)""",
)
def _(t: Tables):
    rules = t.sql(
        """SELECT explode(array(
             named_struct('match_type', CAST(NULL AS STRING), 'header_name', 'x-ai-eg-model', 'header_value', original_model,
                          'owned_by', CASE WHEN g = 0 THEN 'team-a' END, 'created', first_us),
             named_struct('match_type', 'RegularExpression', 'header_name', 'x-ai-eg-model', 'header_value', original_model, 'owned_by', 'x', 'created', first_us),
             named_struct('match_type', 'Exact', 'header_name', 'x-tenant', 'header_value', original_model, 'owned_by', 'x', 'created', first_us))) AS r
           FROM (SELECT original_model, CAST(tenant AS BIGINT) % 2 AS g, min(start_us) AS first_us FROM {r} GROUP BY 1, 2)""",
        r=t.llm_requests,
    ).select("r.*")
    return P.declared_models(rules, default_owner="platform")


@query(
    "normalize_finish_reason",
    REQ
    + """, x AS (SELECT api_schema, CASE request_id % 4 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'tool_use' ELSE 'weird' END AS a,
         CASE request_id % 3 WHEN 0 THEN 'STOP' WHEN 1 THEN 'MAX_TOKENS' ELSE 'SAFETY' END AS g, request_id FROM llm_requests),
  y AS (SELECT api_schema, CASE WHEN api_schema IN ('Anthropic', 'AWSAnthropic') THEN CASE a WHEN 'end_turn' THEN 'stop' WHEN 'max_tokens' THEN 'length' WHEN 'tool_use' THEN 'tool_calls' ELSE 'error' END
     WHEN api_schema = 'GCPVertexAI' THEN CASE g WHEN 'STOP' THEN CASE WHEN request_id % 2 = 0 THEN 'tool_calls' ELSE 'stop' END WHEN 'MAX_TOKENS' THEN 'length' ELSE 'content_filter' END
     ELSE a END AS finish_reason FROM x)
  SELECT api_schema, finish_reason, CASE finish_reason WHEN 'stop' THEN 'end_turn' WHEN 'length' THEN 'max_tokens' WHEN 'tool_calls' THEN 'tool_use' WHEN 'content_filter' THEN 'refusal' ELSE 'end_turn' END AS anthropic_reason,
         count(*) AS n FROM y GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    r = t.llm_requests.withColumn(
        "reason",
        F.expr(
            """CASE WHEN api_schema = 'GCPVertexAI' THEN CASE request_id % 3 WHEN 0 THEN 'STOP' WHEN 1 THEN 'MAX_TOKENS' ELSE 'SAFETY' END
               ELSE CASE request_id % 4 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'tool_use' ELSE 'weird' END END"""
        ),
    ).withColumn("has_tools", F.col("request_id") % 2 == 0)
    return (
        P.normalize_finish_reason(r).groupBy("api_schema", "finish_reason", "anthropic_reason").agg(F.count("*").alias("n"))
    )


@query(
    "classify_http_error",
    REQ
    + """SELECT request_id, status BETWEEN 200 AND 299 AS success,
  CASE status WHEN 200 THEN NULL WHEN 400 THEN 'BadRequestError' WHEN 429 THEN 'RateLimitError' WHEN 500 THEN 'InternalServerError' END AS error_type,
  CASE WHEN status <> 200 THEN concat('Error code: ', CAST(status AS STRING), CASE WHEN request_id % 2 = 0 THEN ' - slow down' ELSE '' END) END AS error_message
  FROM llm_requests""",
)
def _(t: Tables):
    r = t.llm_requests.drop("success").withColumn("body", F.expr("CASE WHEN request_id % 2 = 0 THEN 'slow down' ELSE '' END"))
    return P.classify_http_error(r, body="body").select("request_id", "success", "error_type", "error_message")


@query(
    "classify_mcp_error",
    MCP
    + """SELECT CASE error_code WHEN -32602 THEN 'invalid_param' WHEN -32601 THEN 'unsupported_method' WHEN -32700 THEN 'invalid_json_rpc'
   WHEN -32603 THEN 'internal_error' END AS mcp_error_type, count(*) AS n FROM mcp_calls GROUP BY 1""",
)
def _(t: Tables):
    return P.classify_mcp_error(t.mcp_calls).groupBy("mcp_error_type").agg(F.count("*").alias("n"))


@query(
    "classify_joined_mcp_errors",
    MCP
    + """, f AS (SELECT route, call_id - call_id % 100 AS batch, call_id,
      CASE error_code WHEN -32602 THEN 'invalid_param' WHEN -32601 THEN 'unsupported_method' WHEN -32700 THEN 'invalid_json_rpc' ELSE 'internal_error' END AS label
      FROM mcp_calls WHERE error_code IS NOT NULL)
   SELECT route, batch, coalesce(arg_min(label, call_id) FILTER (WHERE label <> 'internal_error'), 'internal_error') AS mcp_error_type FROM f GROUP BY 1, 2""",
)
def _(t: Tables):
    errors = t.mcp_calls.where("error_code IS NOT NULL").withColumn("batch", F.expr("call_id - call_id % 100"))
    return P.classify_joined_mcp_errors(errors, ["route", "batch"], order="call_id")


METHODS = """CASE event_type WHEN 'click' THEN 'tools/call' WHEN 'view' THEN 'tools/list' WHEN 'purchase' THEN 'resources/read'
    WHEN 'signup' THEN 'initialize' ELSE 'x/custom' END"""


@query(
    "mcp_span_name",
    """SELECT CASE event_type WHEN 'click' THEN 'CallTool' WHEN 'view' THEN 'ListTools' WHEN 'purchase' THEN 'ReadResource'
    WHEN 'signup' THEN 'Initialize' ELSE 'x/custom' END AS span_name, count(*) AS n FROM events GROUP BY 1""",
)
def _(t: Tables):
    m = t.events.withColumn("method", F.expr(METHODS))
    return P.mcp_span_name(m).groupBy("span_name").agg(F.count("*").alias("n"))


@query(
    "validate_filter_config",
    FILT
    + """SELECT call_id, concat_ws('; ', CASE WHEN call_id % 6 = 0 THEN 'url is required' WHEN call_id % 6 = 1 THEN 'url must start with http:// or https://' END,
       CASE WHEN call_id % 5 = 0 THEN 'at least one scope is required' WHEN call_id % 5 = 1 THEN 'unknown scope' END,
       CASE WHEN call_id % 4 = 3 THEN 'unknown failure policy' END, CASE WHEN call_id % 7 = 2 THEN 'unknown mode' END,
       CASE WHEN sample_permille + call_id % 3 > 1000 THEN 'sample rate out of range' END) AS errors
  FROM filter_calls WHERE call_id % 6 < 2 OR call_id % 5 < 2 OR call_id % 4 = 3 OR call_id % 7 = 2 OR sample_permille + call_id % 3 > 1000""",
)
def _(t: Tables):
    conf = t.filter_calls.selectExpr(
        "call_id",
        "CASE call_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'ftp://x' WHEN 2 THEN 'http://x' ELSE 'https://x' END AS url",
        "CASE call_id % 5 WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array('Request', 'Other') ELSE array('Request', 'Response') END AS scopes",
        "CASE call_id % 4 WHEN 3 THEN 'Maybe' WHEN 2 THEN 'PassThrough' ELSE failure_policy END AS failure_policy",
        "CASE call_id % 7 WHEN 2 THEN 'Dry' ELSE mode END AS mode",
        "sample_permille + call_id % 3 AS sample_permille",
    )
    return P.validate_filter_config(conf).select("call_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "canonical_forward_headers",
    "SELECT event_id, concat('X-Tenant-Id,', upper(substr(event_type, 1, 1)), substr(event_type, 2)) AS forward_headers FROM events",
)
def _(t: Tables):
    h = t.events.selectExpr(
        "event_id", "array(' x-tenant-id ', '', 'X-TENANT-ID', event_type, upper(event_type)) AS forward_headers"
    )
    return P.canonical_forward_headers(h).select("event_id", F.array_join("forward_headers", ",").alias("forward_headers"))
