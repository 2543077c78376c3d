"""Metric tables over the request log, chunk streams, MCP calls and filter calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, with_views
from ..operators import metrics as M
from ..operators.assemble import stream_latency
from ..operators.filtering import filter_status
from ..operators.parse import provider_name, resolve_models, split_tool_name
from . import query
from .assemble import LATENCY_SQL

REQ = with_views("llm_requests")
MCP = with_views("mcp_calls")
FILT = with_views("filter_calls")
HOUR_US = 3_600_000_000


def duck_buckets(value: str, bounds) -> str:
    """``le`` string of bucket counts in DuckDB, upper bounds inclusive."""
    idx = "CASE " + " ".join(f"WHEN {value} <= {float(b)} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"
    return idx


def duck_hist(by: str, value: str, bounds, source: str) -> str:
    n = len(bounds) + 1
    counts = ", ',', ".join(f"CAST(count(*) FILTER (WHERE i = {i}) AS STRING)" for i in range(n))
    return (
        f"SELECT {by}, count(*) AS count, round(sum(v), 6) AS sum, concat({counts}) AS buckets "
        f"FROM (SELECT *, {duck_buckets('v', bounds)} AS i FROM (SELECT *, CAST({value} AS DOUBLE) AS v FROM {source}) WHERE v IS NOT NULL) GROUP BY ALL"
    )


def shown(h):
    return h.withColumn("sum", F.round("sum", 6)).withColumn("buckets", F.array_join(F.transform("bucket_counts", lambda c: c.cast("string")), ",")).drop("bucket_counts")


PROVIDER = """CASE api_schema WHEN 'OpenAI' THEN 'openai' WHEN 'AzureOpenAI' THEN 'azure.openai' WHEN 'GCPVertexAI' THEN 'gcp.vertex_ai'
  WHEN 'Anthropic' THEN 'anthropic' WHEN 'AWSAnthropic' THEN 'aws.anthropic' END AS provider"""
ATTRS = f"operation, {PROVIDER}, original_model, coalesce(model_override, original_model) AS request_model, coalesce(model_override, original_model) AS response_model"


def attributed(t: Tables):
    return resolve_models(provider_name(t.llm_requests).withColumn("body_model", F.lit("")))


@query(
    "hist_token_usage",
    REQ
    + f""", u AS (SELECT {ATTRS}, 'input' AS token_type, input_tokens AS value FROM llm_requests WHERE success
  UNION ALL SELECT {ATTRS}, 'cached_input', cached_input_tokens FROM llm_requests WHERE success UNION ALL SELECT {ATTRS}, 'cache_creation_input', cache_creation_input_tokens FROM llm_requests WHERE success
  UNION ALL SELECT {ATTRS}, 'output', output_tokens FROM llm_requests WHERE success UNION ALL SELECT {ATTRS}, 'reasoning', reasoning_tokens FROM llm_requests WHERE success)
  """
    + duck_hist("operation, provider, original_model, request_model, response_model, token_type", "value", M.TOKEN_BOUNDS, "u"),
)
def _(t: Tables):
    return shown(M.hist_token_usage(attributed(t)))


@query(
    "hist_request_duration",
    REQ
    + f", u AS (SELECT {ATTRS}, CASE WHEN NOT success THEN '_OTHER' END AS error_type, duration_ms / 1000.0 AS value FROM llm_requests) "
    + duck_hist("operation, provider, original_model, request_model, response_model, error_type", "value", M.DURATION_BOUNDS, "u"),
)
def _(t: Tables):
    return shown(M.hist_request_duration(attributed(t), seconds=F.col("duration_ms") / 1000.0))


def latency(t: Tables):
    chunks = t.sse_chunks.join(t.llm_requests.select("request_id", "operation", "original_model"), "request_id")
    return stream_latency(chunks, ["request_id", "operation", "original_model"])


_LAT = LATENCY_SQL + """, l AS (SELECT operation, original_model, CAST(ttft AS DOUBLE) AS ttft_s,
   CASE WHEN k > 1 THEN (CAST(e AS DOUBLE) - CAST(ttft AS DOUBLE)) / (k - 1) END AS tpot_s FROM s JOIN llm_requests USING (request_id)) """


@query("hist_ttft", _LAT + duck_hist("operation, original_model", "ttft_s", M.TTFT_BOUNDS, "l"))
def _(t: Tables):
    return shown(M.hist_ttft(latency(t), ["operation", "original_model"]))


@query("hist_tpot", _LAT + duck_hist("operation, original_model", "tpot_s", M.TPOT_BOUNDS, "l"))
def _(t: Tables):
    return shown(M.hist_tpot(latency(t), ["operation", "original_model"]))


_MCP_LABEL = """CASE error_code WHEN -32602 THEN 'invalid_param' WHEN -32601 THEN 'unsupported_method' WHEN -32700 THEN 'invalid_json_rpc' WHEN -32603 THEN 'internal_error' END AS error_type"""
_BACKEND = "CASE WHEN instr(full_tool_name, '__') > 0 THEN split_part(full_tool_name, '__', 1) END AS backend"


@query(
    "hist_mcp_duration",
    MCP + f", u AS (SELECT {_BACKEND}, {_MCP_LABEL}, duration_ms / 1000.0 AS value FROM mcp_calls) " + duck_hist("backend, error_type", "value", M.MCP_BOUNDS, "u"),
)
def _(t: Tables):
    return shown(M.hist_mcp_duration(split_tool_name(t.mcp_calls), F.col("duration_ms") / 1000.0))


@query(
    "mcp_method_count",
    MCP
    + f"""SELECT method, status, backend, count(*) AS count FROM (SELECT CASE WHEN call_id % 13 = 0 THEN '' WHEN call_id % 2 = 0 THEN 'tools/call' ELSE 'tools/list' END AS method,
   CASE WHEN error_code IS NOT NULL THEN 'error' WHEN is_error THEN 'failed' ELSE 'success' END AS status, {_BACKEND} FROM mcp_calls) WHERE method <> '' GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    c = split_tool_name(t.mcp_calls).withColumn("method", F.expr("CASE WHEN call_id % 13 = 0 THEN '' WHEN call_id % 2 = 0 THEN 'tools/call' ELSE 'tools/list' END"))
    return M.mcp_method_count(c)


@query(
    "mcp_capability_count",
    """WITH s AS (SELECT event_id, event_id % 2 = 0 AS c FROM events)
  SELECT * FROM (
    SELECT 'experimental' AS type, 'client' AS side, CAST(count(*) FILTER (WHERE event_id % 3 = 0) * 2 AS BIGINT) AS count FROM s WHERE c
    UNION ALL SELECT 'roots', 'client', count(*) FILTER (WHERE event_id % 5 = 0) FROM s WHERE c
    UNION ALL SELECT 'sampling', 'client', count(*) FILTER (WHERE event_id % 7 = 0) FROM s WHERE c
    UNION ALL SELECT 'elicitation', 'client', count(*) FROM s WHERE c
    UNION ALL SELECT 'tools', 'server', count(*) FROM s WHERE NOT c
    UNION ALL SELECT 'prompts', 'server', count(*) FILTER (WHERE event_id % 3 = 0) FROM s WHERE NOT c
    UNION ALL SELECT 'logging', 'server', count(*) FILTER (WHERE event_id % 5 = 0) FROM s WHERE NOT c
    UNION ALL SELECT 'experimental', 'server', count(*) FILTER (WHERE event_id % 7 = 0) FROM s WHERE NOT c) WHERE count > 0""",
)
def _(t: Tables):
    s = t.sql(
        """SELECT CASE WHEN event_id % 2 = 0 THEN 'client' ELSE 'server' END AS side,
             CASE WHEN event_id % 2 = 0 THEN to_json(named_struct(
                    'experimental', CASE WHEN event_id % 3 = 0 THEN map('x', map('k', 1), 'y', map('k', 2)) END,
                    'roots', named_struct('listChanged', event_id % 5 = 0), 'sampling', CASE WHEN event_id % 7 = 0 THEN map('k', 1) END, 'elicitation', map('k', 1)))
                  ELSE to_json(named_struct('tools', named_struct('listChanged', true), 'prompts', CASE WHEN event_id % 3 = 0 THEN map('k', 1) END,
                    'logging', CASE WHEN event_id % 5 = 0 THEN map('k', 1) END, 'experimental', CASE WHEN event_id % 7 = 0 THEN map('z', map('k', 1)) END)) END AS capabilities
           FROM {e}""",
        e=t.events,
    )
    return M.mcp_capability_count(s)


SERVER_MESSAGES = """SELECT call_id, route, CASE call_id % 6 WHEN 0 THEN 'notifications/progress' WHEN 1 THEN 'roots/list' WHEN 2 THEN 'sampling/createMessage'
   WHEN 3 THEN 'notifications/odd' WHEN 4 THEN 'elicitation/create' ELSE 'x/unknown' END AS method FROM mcp_calls"""


def server_messages(t: Tables):
    return t.sql(SERVER_MESSAGES.replace("mcp_calls", "{m}"), m=t.mcp_calls)


@query(
    "mcp_progress_count",
    MCP + f"SELECT route, count(*) AS count FROM ({SERVER_MESSAGES}) WHERE method = 'notifications/progress' GROUP BY 1",
)
def _(t: Tables):
    return M.mcp_progress_count(server_messages(t), ["route"])


@query(
    "unsupported_server_methods",
    MCP
    + f"SELECT method, CASE WHEN method IN ('notifications/odd', 'x/unknown') THEN 'error' ELSE 'success' END AS status, count(*) AS count FROM ({SERVER_MESSAGES}) GROUP BY 1, 2",
)
def _(t: Tables):
    return M.unsupported_server_methods(server_messages(t))


@query(
    "filter_decision_count",
    FILT + "SELECT route, coalesce(nullif(backend, ''), '-') AS backend, scope, outcome AS action, count(*) AS count FROM filter_calls GROUP BY 1, 2, 3, 4",
)
def _(t: Tables):
    return M.filter_decision_count(t.filter_calls.withColumnRenamed("outcome", "action"))


from .filtering import STATUS_SQL, status_input  # noqa: E402


@query(
    "filter_status_count",
    FILT + f"SELECT route, coalesce(nullif(backend, ''), '-') AS backend, status, count(*) AS count FROM (SELECT *, {STATUS_SQL} AS status FROM filter_calls) GROUP BY 1, 2, 3",
)
def _(t: Tables):
    return M.filter_status_count(filter_status(status_input(t)))


@query(
    "inflight_gauge",
    FILT
    + """, m AS (SELECT route, start_us AS at_us, 1 AS d FROM filter_calls UNION ALL SELECT route, start_us + duration_ms * 60000000, -1 FROM filter_calls),
   n AS (SELECT route, at_us, sum(d) AS d FROM m GROUP BY 1, 2)
   SELECT route, at_us, CAST(sum(d) OVER (PARTITION BY route ORDER BY at_us) AS BIGINT) AS inflight FROM n""",
)
def _(t: Tables):
    calls = t.filter_calls.withColumn("end_us", F.col("start_us") + F.col("duration_ms") * 60_000_000)
    return M.inflight_gauge(calls, ["route"], "start_us", "end_us")


@query(
    "cardinality_guard",
    FILT
    + """, f AS (SELECT route, backend, scope, min(call_id) AS first FROM filter_calls GROUP BY 1, 2, 3), a AS (SELECT * FROM f ORDER BY first LIMIT 12)
   SELECT CASE WHEN a.first IS NULL THEN '_overflow_' ELSE c.route END AS route, CASE WHEN a.first IS NULL THEN '_overflow_' ELSE c.backend END AS backend,
     CASE WHEN a.first IS NULL THEN '_overflow_' ELSE c.scope END AS scope, count(*) AS count, count(*) FILTER (WHERE a.first IS NULL) AS overflowed
   FROM filter_calls c LEFT JOIN a ON c.route = a.route AND c.backend = a.backend AND c.scope = a.scope GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    g = M.cardinality_guard(t.filter_calls.select("call_id", "route", "backend", "scope"), ["route", "backend", "scope"], "call_id", 12)
    return g.groupBy("route", "backend", "scope").agg(F.count("*").alias("count"), F.count(F.when(F.col("overflowed"), 1)).alias("overflowed"))


@query(
    "metric_temporality",
    REQ
    + f""", d AS (SELECT tenant, CAST(floor(start_us / {HOUR_US}) AS BIGINT) * {HOUR_US} AS interval_us, sum(input_tokens) AS v FROM llm_requests GROUP BY 1, 2)
   SELECT tenant, interval_us, CAST(v AS BIGINT) AS delta, CAST(sum(v) OVER (PARTITION BY tenant ORDER BY interval_us) AS BIGINT) AS cumulative FROM d""",
)
def _(t: Tables):
    args = (["tenant"], "start_us", "input_tokens", HOUR_US)
    d = M.metric_temporality(t.llm_requests, *args).withColumnRenamed("value", "delta")
    c = M.metric_temporality(t.llm_requests, *args, temporality="cumulative").withColumnRenamed("value", "cumulative")
    return d.join(c, ["tenant", "interval_us"])


def audit_events(t: Tables):
    return t.filter_calls.selectExpr(
        "call_id", "route", "outcome", "start_us", "outcome = 'error' AS fail_open",
        "map_filter(map('EMAIL', call_id % 3, 'PHONE', call_id % 2, 'SSN', CASE WHEN outcome = 'redact' THEN 1L ELSE 0L END), (k, v) -> v > 0) AS stats",
    )


@query(
    "audit_rollup",
    FILT
    + """, x AS (SELECT route, outcome, 'EMAIL' AS category, call_id % 3 AS n FROM filter_calls UNION ALL SELECT route, outcome, 'PHONE', call_id % 2 FROM filter_calls
     UNION ALL SELECT route, outcome, 'SSN', CASE WHEN outcome = 'redact' THEN 1 ELSE 0 END FROM filter_calls)
   SELECT route, outcome, category, CAST(sum(n) AS BIGINT) AS redactions, count(*) FILTER (WHERE outcome <> 'error') AS scrubbed_events,
     count(*) FILTER (WHERE outcome = 'error') AS fail_open_events FROM x WHERE n > 0 GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return M.audit_rollup(audit_events(t))


@query(
    "silent_routes",
    """WITH r AS (SELECT concat('user-', CAST(user_id AS STRING)) AS route, epoch_us(ts) AS at_us FROM events), n AS (SELECT max(at_us) AS now FROM r)
   SELECT DISTINCT route FROM r WHERE route NOT IN (SELECT route FROM r, n WHERE at_us > now - 24 * 3600000000)""",
)
def _(t: Tables):
    audit = t.sql("SELECT concat('user-', user_id) AS route, {us} AS at_us FROM {e}", e=t.events)
    return M.silent_routes(audit.select("route").distinct(), audit, "at_us", 24)


@query(
    "shadow_vs_enforce",
    FILT
    + """, x AS (SELECT *, call_id % 100 AS ic, call_id % 37 AS oc, mode = 'Shadow' AS s FROM filter_calls)
   SELECT route, count(*) FILTER (WHERE s) AS shadow_calls, round(count(*) FILTER (WHERE s AND outcome = 'redact') / count(*) FILTER (WHERE s), 9) AS shadow_redact_rate,
     round(count(*) FILTER (WHERE s AND outcome = 'reject') / count(*) FILTER (WHERE s), 9) AS shadow_reject_rate, CAST(sum(ic) FILTER (WHERE s) AS BIGINT) AS shadow_input_chars,
     CAST(sum(oc) FILTER (WHERE s) AS BIGINT) AS shadow_output_chars, count(*) FILTER (WHERE NOT s) AS enforce_calls,
     round(count(*) FILTER (WHERE NOT s AND outcome = 'redact') / count(*) FILTER (WHERE NOT s), 9) AS enforce_redact_rate,
     round(count(*) FILTER (WHERE NOT s AND outcome = 'reject') / count(*) FILTER (WHERE NOT s), 9) AS enforce_reject_rate,
     CAST(sum(ic) FILTER (WHERE NOT s) AS BIGINT) AS enforce_input_chars, CAST(sum(oc) FILTER (WHERE NOT s) AS BIGINT) AS enforce_output_chars FROM x GROUP BY 1""",
)
def _(t: Tables):
    c = t.filter_calls.withColumns({"input_chars": F.col("call_id") % 100, "output_chars": F.col("call_id") % 37})
    out = M.shadow_vs_enforce(c)
    return out.select(*[F.round(x, 9).alias(x) if x.endswith("rate") else F.col(x) for x in out.columns])


@query(
    "content_duplicates",
    "SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS count, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def _(t: Tables):
    return M.content_duplicates(t.documents, "text", "doc_id")


@query(
    "prompt_cache_efficiency",
    REQ
    + """SELECT original_model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
   CAST(sum(cache_creation_input_tokens) AS BIGINT) AS cache_creation_input_tokens, round(sum(cached_input_tokens) / sum(input_tokens), 9) AS cached_share FROM llm_requests GROUP BY 1""",
)
def _(t: Tables):
    return M.prompt_cache_efficiency(t.llm_requests, ["original_model"]).withColumn("cached_share", F.round("cached_share", 9))


@query(
    "session_usage",
    REQ
    + "SELECT session_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM llm_requests GROUP BY 1",
)
def _(t: Tables):
    return M.session_usage(t.llm_requests)


@query(
    "merge_capabilities",
    """WITH m AS (SELECT user_id, CAST(bit_or(event_id % 64) AS INT) AS caps FROM events GROUP BY 1)
   SELECT user_id, caps, caps & 1 <> 0 AS tools, caps & 3 = 3 AS tools_list_changed, caps & 4 <> 0 AS prompts, caps & 12 = 12 AS prompts_list_changed, caps & 16 <> 0 AS logging,
     caps & 32 <> 0 AS resources, caps & 96 = 96 AS resources_list_changed, caps & 160 = 160 AS resources_subscribe, caps & 256 <> 0 AS completions FROM m""",
)
def _(t: Tables):
    return M.merge_capabilities(t.events.selectExpr("user_id", "CAST(event_id % 64 AS INT) AS caps"), ["user_id"])
