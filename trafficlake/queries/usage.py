"""Usage normalisation over response bodies and stream events derived from the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, with_views
from ..operators import usage as U
from . import query

REQ = with_views("llm_requests")
CHUNKS = with_views("sse_chunks")
OUT = ["request_id", *U.USAGE]

CHAT_USAGE = """named_struct('prompt_tokens', input_tokens, 'completion_tokens', output_tokens,
    'total_tokens', input_tokens + coalesce(output_tokens, 0),
    'prompt_tokens_details', CASE WHEN cached_input_tokens IS NOT NULL THEN named_struct('cached_tokens', cached_input_tokens, 'cache_creation_input_tokens', cache_creation_input_tokens) END,
    'completion_tokens_details', CASE WHEN reasoning_tokens IS NOT NULL THEN named_struct('reasoning_tokens', reasoning_tokens) END)"""
RESPONSES_USAGE = """named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens, 'total_tokens', input_tokens + coalesce(output_tokens, 0),
    'input_tokens_details', named_struct('cached_tokens', cached_input_tokens, 'cache_creation_input_tokens', cache_creation_input_tokens),
    'output_tokens_details', named_struct('reasoning_tokens', reasoning_tokens))"""
ANTHROPIC_USAGE = """named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens,
    'cache_read_input_tokens', cached_input_tokens, 'cache_creation_input_tokens', cache_creation_input_tokens)"""
BEDROCK_USAGE = """named_struct('inputTokens', input_tokens, 'outputTokens', output_tokens, 'totalTokens', 0,
    'cacheReadInputTokens', cached_input_tokens, 'cacheWriteInputTokens', cache_creation_input_tokens)"""
GEMINI_USAGE = """named_struct('promptTokenCount', input_tokens, 'candidatesTokenCount', output_tokens, 'totalTokenCount', input_tokens + coalesce(output_tokens, 0),
    'cachedContentTokenCount', cached_input_tokens, 'thoughtsTokenCount', reasoning_tokens)"""


def bodies(t: Tables, usage: str, field: str = "usage", where: str = "true"):
    return t.llm_requests.where(where).selectExpr(
        "request_id", "operation", "api_schema", "stream", f"to_json(named_struct('id', 'x', '{field}', {usage})) AS response_body"
    )


_NONE = "CAST(NULL AS BIGINT)"


def expected(inp: str, out: str, total: str, cached: str, creation: str, reasoning: str, source: str = "llm_requests") -> str:
    return (
        f"SELECT request_id, {inp} AS input_tokens, {out} AS output_tokens, {total} AS total_tokens, {cached} AS cached_input_tokens, "
        f"{creation} AS cache_creation_input_tokens, {reasoning} AS reasoning_tokens FROM {source}"
    )


_CHAT_EXPECTED = expected(
    "input_tokens", "coalesce(output_tokens, 0)", "input_tokens + coalesce(output_tokens, 0)", "cached_input_tokens",
    "CASE WHEN cached_input_tokens IS NOT NULL THEN coalesce(cache_creation_input_tokens, 0) END", "reasoning_tokens",
)


@query("usage_openai_chat", REQ + _CHAT_EXPECTED)
def _(t: Tables):
    return U.usage_openai_chat(bodies(t, CHAT_USAGE)).select(*OUT)


@query(
    "usage_completions",
    REQ
    + expected(
        "CASE WHEN request_id % 6 <> 0 THEN CASE WHEN request_id % 6 <> 1 THEN input_tokens END END",
        "CASE WHEN request_id % 6 <> 0 THEN coalesce(output_tokens, 0) END",
        "CASE WHEN request_id % 6 <> 0 THEN input_tokens + coalesce(output_tokens, 0) END",
        "CASE WHEN request_id % 6 <> 0 THEN cached_input_tokens END",
        "CASE WHEN request_id % 6 <> 0 AND cached_input_tokens IS NOT NULL THEN coalesce(cache_creation_input_tokens, 0) END",
        "CASE WHEN request_id % 6 <> 0 THEN reasoning_tokens END",
    ),
)
def _(t: Tables):
    usage = CHAT_USAGE.replace("'prompt_tokens', input_tokens", "'prompt_tokens', CASE WHEN request_id % 6 = 1 THEN -1 ELSE input_tokens END")
    return U.usage_completions(bodies(t, f"CASE WHEN request_id % 6 <> 0 THEN {usage} END")).select(*OUT)


@query(
    "usage_embeddings",
    REQ + expected("input_tokens", _NONE, "input_tokens", _NONE, _NONE, _NONE) + " WHERE operation = 'embeddings'",
)
def _(t: Tables):
    return U.usage_embeddings(
        bodies(t, "named_struct('prompt_tokens', input_tokens, 'total_tokens', input_tokens)", where="operation = 'embeddings'")
    ).select(*OUT)


@query(
    "usage_responses",
    REQ
    + expected(
        "input_tokens", "coalesce(output_tokens, 0)", "input_tokens + coalesce(output_tokens, 0)", "coalesce(cached_input_tokens, 0)",
        "coalesce(cache_creation_input_tokens, 0)", "coalesce(reasoning_tokens, 0)",
    ),
)
def _(t: Tables):
    return U.usage_responses(bodies(t, RESPONSES_USAGE)).select(*OUT)


@query(
    "usage_responses_stream",
    REQ
    + expected(
        "input_tokens", "coalesce(output_tokens, 0)", "input_tokens + coalesce(output_tokens, 0)", "coalesce(cached_input_tokens, 0)",
        "CAST(0 AS BIGINT)", "coalesce(reasoning_tokens, 0)",
    ),
)
def _(t: Tables):
    events = t.llm_requests.selectExpr(
        "*", "explode(array('response.created', 'response.output_text.delta', 'response.completed')) AS event_type"
    ).selectExpr(
        "request_id",
        "event_type",
        f"""to_json(named_struct('type', event_type, 'response',
            CASE WHEN event_type = 'response.completed' THEN named_struct('usage', {RESPONSES_USAGE}) END)) AS response_body""",
    )
    return U.usage_responses(events, event_type="event_type").select(*OUT)


_CACHED_IN = "input_tokens + coalesce(cached_input_tokens, 0) + coalesce(cache_creation_input_tokens, 0)"


@query(
    "usage_anthropic",
    REQ
    + expected(
        _CACHED_IN, "coalesce(output_tokens, 0)", f"{_CACHED_IN} + coalesce(output_tokens, 0)", "coalesce(cached_input_tokens, 0)",
        "coalesce(cache_creation_input_tokens, 0)", _NONE,
    ),
)
def _(t: Tables):
    return U.usage_anthropic(bodies(t, ANTHROPIC_USAGE)).select(*OUT)


_BEDROCK_EXPECTED = expected(
    _CACHED_IN, "coalesce(output_tokens, 0)", f"{_CACHED_IN} + coalesce(output_tokens, 0)", "cached_input_tokens",
    "cache_creation_input_tokens", _NONE,
)


@query("usage_bedrock", REQ + _BEDROCK_EXPECTED)
def _(t: Tables):
    return U.usage_bedrock(bodies(t, BEDROCK_USAGE)).select(*OUT)


@query(
    "usage_gemini",
    REQ
    + """SELECT request_id, CASE WHEN stream THEN 'stream' ELSE 'body' END AS mode,
  CASE WHEN keep THEN input_tokens END AS input_tokens,
  CASE WHEN keep THEN coalesce(output_tokens, 0) + CASE WHEN stream THEN 0 ELSE coalesce(reasoning_tokens, 0) END END AS output_tokens,
  CASE WHEN keep THEN input_tokens + coalesce(output_tokens, 0) END AS total_tokens,
  CASE WHEN keep THEN coalesce(cached_input_tokens, 0) END AS cached_input_tokens,
  CAST(NULL AS BIGINT) AS cache_creation_input_tokens,
  CASE WHEN keep THEN coalesce(reasoning_tokens, 0) END AS reasoning_tokens
  FROM (SELECT *, NOT stream OR input_tokens > 0 AS keep FROM llm_requests)""",
)
def _(t: Tables):
    return U.usage_gemini(bodies(t, GEMINI_USAGE, "usageMetadata")).select("mode", *OUT)


@query(
    "usage_gemini_embeddings",
    REQ
    + expected("input_tokens + duration_ms", _NONE, "input_tokens + duration_ms", _NONE, _NONE, _NONE),
)
def _(t: Tables):
    b = t.llm_requests.selectExpr(
        "request_id",
        """to_json(named_struct('predictions', array(
             named_struct('embeddings', named_struct('values', array(0.1D), 'statistics', named_struct('token_count', input_tokens))),
             named_struct('embeddings', named_struct('values', array(0.2D), 'statistics', named_struct('token_count', duration_ms)))))) AS response_body""",
    )
    return U.usage_gemini_embeddings(b).select(*OUT)


@query(
    "usage_rerank",
    """SELECT event_id AS request_id, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) END AS input_tokens,
  CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN CAST(floor(value / 2) AS BIGINT) END AS output_tokens,
  CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) + CASE WHEN event_id % 3 = 0 THEN CAST(floor(value / 2) AS BIGINT) ELSE 0 END END AS total_tokens,
  CAST(NULL AS BIGINT) AS cached_input_tokens, CAST(NULL AS BIGINT) AS cache_creation_input_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens FROM events""",
)
def _(t: Tables):
    b = t.events.selectExpr(
        "event_id AS request_id",
        """to_json(named_struct('results', array(), 'meta', CASE WHEN event_id % 4 <> 0 THEN named_struct('tokens',
             named_struct('input_tokens', value, 'output_tokens', CASE WHEN event_id % 3 = 0 THEN value / 2 END)) END)) AS response_body""",
    )
    return U.usage_rerank(b).select(*OUT)


@query(
    "usage_image",
    REQ
    + expected(
        "CASE WHEN request_id % 2 = 0 THEN input_tokens END", "CASE WHEN request_id % 2 = 0 THEN coalesce(output_tokens, 0) END",
        "CASE WHEN request_id % 2 = 0 THEN input_tokens + coalesce(output_tokens, 0) END", _NONE, _NONE, _NONE,
    ),
)
def _(t: Tables):
    return U.usage_image(bodies(t, f"CASE WHEN request_id % 2 = 0 THEN {RESPONSES_USAGE} END")).select(*OUT)


@query(
    "usage_latest",
    CHUNKS
    + """SELECT request_id, arg_max(output_tokens, seq) FILTER (WHERE output_tokens IS NOT NULL) AS output_tokens,
  arg_max(CAST(recv_ms AS BIGINT), seq) AS input_tokens FROM sse_chunks GROUP BY 1""",
)
def _(t: Tables):
    c = t.sse_chunks.withColumn("output_tokens", F.col("output_tokens").cast("bigint")).withColumn("input_tokens", F.col("recv_ms"))
    return U.usage_latest(c, ["request_id"])


STREAM_EVENTS = """SELECT c.request_id, c.seq,
    CASE WHEN c.seq = 0 AND c.request_id % 11 <> 0 THEN 'message_start' WHEN c.end_of_stream OR c.seq % 2 = 1 THEN 'message_delta' ELSE 'ping' END AS event_type,
    CASE WHEN c.seq = 0 THEN r.input_tokens END AS input_tokens, CAST(c.output_tokens AS BIGINT) AS output_tokens,
    CASE WHEN c.seq % 2 = 0 THEN r.cached_input_tokens ELSE r.request_id % 3 END AS cached_input_tokens,
    CASE WHEN c.seq = 0 THEN r.cache_creation_input_tokens END AS cache_creation_input_tokens
  FROM {chunks} c JOIN {requests} r ON c.request_id = r.request_id"""
_DUCK_STREAM = CHUNKS + ", e AS (" + STREAM_EVENTS.replace("{chunks}", "sse_chunks").replace("{requests}", "llm_requests") + ")\n"


def stream_events(t: Tables):
    return t.sql(STREAM_EVENTS, chunks=t.sse_chunks, requests=t.llm_requests)


@query(
    "usage_anthropic_stream",
    _DUCK_STREAM
    + """, s AS (SELECT request_id, arg_max(i, seq) FILTER (WHERE event_type = 'message_start') AS i,
         arg_max(c, seq) FILTER (WHERE event_type = 'message_start') AS c, arg_max(w, seq) FILTER (WHERE event_type = 'message_start') AS w,
         arg_max(o, seq) FILTER (WHERE event_type IN ('message_start', 'message_delta')) AS o
       FROM (SELECT *, coalesce(input_tokens, 0) + coalesce(cached_input_tokens, 0) + coalesce(cache_creation_input_tokens, 0) AS i,
                    coalesce(cached_input_tokens, 0) AS c, coalesce(cache_creation_input_tokens, 0) AS w, coalesce(output_tokens, 0) AS o FROM e) GROUP BY 1)
  SELECT request_id, CASE WHEN o IS NOT NULL THEN coalesce(i, 0) ELSE i END AS input_tokens, o AS output_tokens,
    CASE WHEN o IS NOT NULL THEN coalesce(i, 0) + o END AS total_tokens, CASE WHEN o IS NOT NULL THEN coalesce(c, 0) ELSE c END AS cached_input_tokens,
    CASE WHEN o IS NOT NULL THEN coalesce(w, 0) ELSE w END AS cache_creation_input_tokens FROM s""",
)
def _(t: Tables):
    return U.usage_anthropic_stream(stream_events(t), ["request_id"])


@query(
    "usage_anthropic_stream_translated",
    _DUCK_STREAM
    + """, s AS (SELECT request_id,
         max(coalesce(input_tokens, 0) + coalesce(cached_input_tokens, 0) + coalesce(cache_creation_input_tokens, 0)) FILTER (WHERE event_type = 'message_start') AS i,
         max(coalesce(cached_input_tokens, 0)) FILTER (WHERE event_type = 'message_start') AS c,
         max(coalesce(cache_creation_input_tokens, 0)) FILTER (WHERE event_type = 'message_start') AS w,
         CAST(sum(coalesce(output_tokens, 0)) FILTER (WHERE event_type = 'message_delta') AS BIGINT) AS o,
         CAST(sum(coalesce(cached_input_tokens, 0)) FILTER (WHERE event_type = 'message_delta') AS BIGINT) AS dc,
         CAST(sum(coalesce(cache_creation_input_tokens, 0)) FILTER (WHERE event_type = 'message_delta') AS BIGINT) AS dw
       FROM e GROUP BY 1)
  SELECT request_id, CASE WHEN coalesce(i, dc, dw) IS NOT NULL THEN coalesce(i, 0) + coalesce(dc, 0) + coalesce(dw, 0) END AS input_tokens,
    o AS output_tokens, coalesce(i, 0) + coalesce(dc, 0) + coalesce(dw, 0) + coalesce(o, 0) AS total_tokens,
    CASE WHEN coalesce(c, dc) IS NOT NULL THEN coalesce(c, 0) + coalesce(dc, 0) END AS cached_input_tokens,
    CASE WHEN coalesce(w, dw) IS NOT NULL THEN coalesce(w, 0) + coalesce(dw, 0) END AS cache_creation_input_tokens FROM s""",
)
def _(t: Tables):
    return U.usage_anthropic_stream_translated(stream_events(t), ["request_id"])


@query(
    "usage_unpivot",
    REQ
    + """SELECT token_type, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (
     SELECT 'input' AS token_type, input_tokens AS value FROM llm_requests UNION ALL SELECT 'cached_input', cached_input_tokens FROM llm_requests
     UNION ALL SELECT 'cache_creation_input', cache_creation_input_tokens FROM llm_requests UNION ALL SELECT 'output', output_tokens FROM llm_requests
     UNION ALL SELECT 'reasoning', reasoning_tokens FROM llm_requests) WHERE value IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    return (
        U.usage_unpivot(t.llm_requests, ["request_id"]).groupBy("token_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )


def mixed_bodies(t: Tables):
    """One response body per request in the shape its operation and backend schema answer with."""
    usage = f"""CASE WHEN operation = 'messages' THEN to_json(named_struct('model', original_model, 'usage', {ANTHROPIC_USAGE}))
      WHEN operation = 'responses' THEN to_json(named_struct('model', original_model, 'usage', {RESPONSES_USAGE}))
      WHEN api_schema = 'GCPVertexAI' AND operation = 'embeddings' THEN to_json(named_struct('predictions', array(named_struct('embeddings', named_struct('statistics', named_struct('token_count', input_tokens))))))
      WHEN api_schema = 'GCPVertexAI' THEN to_json(named_struct('usageMetadata', {GEMINI_USAGE}))
      ELSE to_json(named_struct('model', original_model, 'usage', {CHAT_USAGE})) END"""
    return t.llm_requests.selectExpr(
        "request_id", "operation", "api_schema", "tenant", "original_model", "success", "status", f"{usage} AS response_body"
    )


@query(
    "normalize_usage",
    REQ
    + f""", k AS (SELECT *, CASE WHEN operation = 'messages' THEN 'a' WHEN operation = 'responses' THEN CASE WHEN api_schema = 'OpenAI' THEN 'r' END
        WHEN operation = 'embeddings' THEN CASE WHEN api_schema = 'GCPVertexAI' THEN 'ge' ELSE 'e' END WHEN api_schema = 'GCPVertexAI' THEN 'g' ELSE 'c' END AS k,
        {_CACHED_IN} AS ci, coalesce(output_tokens, 0) AS o, coalesce(reasoning_tokens, 0) AS rs, coalesce(cached_input_tokens, 0) AS cc, coalesce(cache_creation_input_tokens, 0) AS cw FROM llm_requests)
  SELECT request_id, CASE WHEN k = 'a' THEN ci WHEN k IS NOT NULL THEN input_tokens END AS input_tokens,
    CASE k WHEN 'a' THEN o WHEN 'r' THEN o WHEN 'g' THEN o + rs WHEN 'c' THEN o END AS output_tokens,
    CASE k WHEN 'a' THEN ci + o WHEN 'ge' THEN input_tokens WHEN 'e' THEN input_tokens + o WHEN 'r' THEN input_tokens + o WHEN 'g' THEN input_tokens + o WHEN 'c' THEN input_tokens + o END AS total_tokens,
    CASE k WHEN 'a' THEN cc WHEN 'r' THEN cc WHEN 'g' THEN cc WHEN 'c' THEN cached_input_tokens END AS cached_input_tokens,
    CASE k WHEN 'a' THEN cw WHEN 'r' THEN cw WHEN 'c' THEN CASE WHEN cached_input_tokens IS NOT NULL THEN cw END END AS cache_creation_input_tokens,
    CASE k WHEN 'r' THEN rs WHEN 'g' THEN rs WHEN 'c' THEN reasoning_tokens END AS reasoning_tokens,
    CASE WHEN k IS NULL THEN concat('unsupported pair ', operation, '/', api_schema) END AS usage_error FROM k""",
)
def _(t: Tables):
    return U.normalize_usage(mixed_bodies(t)).select(*OUT, "usage_error")
