"""Routing, mutation, catalog, authorization and pairing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import BACKENDS, Tables, with_views
from ..operators import routing as H
from ..operators.parse import parse_jsonrpc
from . import query
from .parse import TOKENS

REQ = with_views("llm_requests")
MCP = with_views("mcp_calls")
TOOLS = with_views("tools")


@query(
    "match_route",
    REQ
    + """SELECT request_id, CASE WHEN original_model = 'model-0' AND operation = 'chat' THEN 0 WHEN original_model IN ('model-1', 'model-2') THEN 1
   WHEN operation = 'messages' AND CAST(tenant AS BIGINT) % 2 = 0 THEN 2 WHEN original_model = 'model-0' THEN 3 END AS rule_idx FROM llm_requests""",
)
def _(t: Tables):
    spark = t.spark
    rules = spark.createDataFrame(
        [
            (0, 0, "model-0", {"x-op": "chat"}), (1, 0, "model-1", {}), (1, 1, "model-2", {}),
            (2, 0, None, {"x-op": "messages", "x-half": "0"}), (3, 0, "model-0", {}),
        ],
        "rule_idx int, match_idx int, model string, headers map<string,string>",
    )
    r = t.llm_requests.selectExpr(
        "request_id", "original_model AS model", "map('x-op', operation, 'x-half', CAST(CAST(tenant AS BIGINT) % 2 AS STRING)) AS headers"
    )
    return H.match_route(r, rules).select("request_id", "rule_idx")


@query(
    "weighted_backend",
    REQ
    + """SELECT request_id, CASE WHEN CAST('0x' || substr(sha256(CAST(request_id AS STRING)), 1, 8) AS BIGINT) % 4 < 3 THEN 'pt-east' ELSE 'pt-west' END AS selected_backend FROM llm_requests""",
)
def _(t: Tables):
    refs = [H.BackendRef(b, p, w) for b, _s, p, w in BACKENDS]
    return H.weighted_backend(t.llm_requests.select("request_id"), refs)


ROUTE_REFS = [
    ("route-0", "pt-east", 0, 3), ("route-0", "pt-west", 0, 1), ("route-0", "on-demand", 1, 9), ("route-1", "alone", 2, None), ("route-1", "never", 0, 0), ("route-1", "later", 3, 5),
    ("route-2", "a", None, 2), ("route-2", "b", 0, 0), ("route-2", "c", 0, 5), ("route-3", "never", 0, 0),
]


@query(
    "weighted_backend_by_route",
    REQ
    + """, r AS (SELECT request_id, request_id % 5 AS k, CAST('0x' || substr(sha256(CAST(request_id AS STRING)), 1, 8) AS BIGINT) AS h FROM llm_requests)
  SELECT request_id, CASE k WHEN 0 THEN CASE WHEN h % 4 < 3 THEN 'pt-east' ELSE 'pt-west' END WHEN 1 THEN 'alone' WHEN 2 THEN CASE WHEN h % 7 < 2 THEN 'a' ELSE 'c' END END AS selected_backend FROM r""",
)
def _(t: Tables):
    refs = t.spark.createDataFrame(ROUTE_REFS, "route string, backend string, priority int, weight int")
    requests = t.llm_requests.selectExpr("request_id", "concat('route-', request_id % 5) AS route")
    return H.weighted_backend_by_route(requests, refs).select("request_id", "selected_backend")


ATTEMPTS = """SELECT request_id, attempt, concat('b', attempt) AS backend, success AND attempt = 1 + request_id % 3 AS success
  FROM {r} LATERAL VIEW explode(sequence(1, 1 + CAST(request_id % 3 AS INT))) a AS attempt"""


@query(
    "fallback_outcome",
    REQ
    + "SELECT request_id, CASE WHEN success THEN concat('b', CAST(1 + request_id % 3 AS STRING)) END AS serving_backend, 1 + request_id % 3 AS attempts, request_id % 3 > 0 AS retried FROM llm_requests",
)
def _(t: Tables):
    return H.fallback_outcome(t.sql(ATTEMPTS, r=t.llm_requests))


@query(
    "apply_model_override",
    REQ + "SELECT request_id, CASE api_schema WHEN 'AWSAnthropic' THEN 'claude-aws' WHEN 'GCPVertexAI' THEN 'gemini-x' ELSE original_model END AS request_model FROM llm_requests",
)
def _(t: Tables):
    refs = t.spark.createDataFrame([("AWSAnthropic", "claude-aws"), ("GCPVertexAI", "gemini-x"), ("OpenAI", "")], "api_schema string, model_override string")
    return H.apply_model_override(t.llm_requests, refs, backend="api_schema").select("request_id", "request_model")


_MUT_ROUTE = "SELECT user_id AS backend, CASE WHEN event_id % 2 = 0 THEN 'set' ELSE 'remove' END AS kind, concat('X-H', CAST(event_id % 7 AS STRING)) AS name, CASE WHEN event_id % 2 = 0 THEN concat('r', CAST(event_id % 5 AS STRING)) END AS value FROM {e} WHERE event_type = 'click'"
_MUT_BACKEND = "SELECT user_id AS backend, CASE WHEN event_id % 2 = 0 THEN 'set' ELSE 'remove' END AS kind, concat('x-h', CAST(event_id % 11 AS STRING)) AS name, CASE WHEN event_id % 2 = 0 THEN concat('b', CAST(event_id % 5 AS STRING)) END AS value FROM {e} WHERE event_type = 'view'"


@query(
    "merge_mutations",
    f"""WITH r AS (SELECT backend, kind, lower(name) AS name, max(value) AS v FROM ({_MUT_ROUTE.replace('{e}', 'events')}) GROUP BY 1, 2, 3),
  b AS (SELECT backend, kind, lower(name) AS name, max(value) AS v FROM ({_MUT_BACKEND.replace('{e}', 'events')}) GROUP BY 1, 2, 3)
  SELECT backend, kind, name, coalesce(r.v, b.v) AS value FROM r FULL JOIN b USING (backend, kind, name)""",
)
def _(t: Tables):
    return H.merge_mutations(t.sql(_MUT_ROUTE, e=t.events), t.sql(_MUT_BACKEND, e=t.events), ["backend"])


@query(
    "apply_header_mutation",
    """SELECT event_id, ':m' AS method, 'new' AS x_a, CASE WHEN event_id % 2 = 0 THEN 'orig' ELSE event_type END AS x_b, CASE WHEN event_id % 2 = 1 THEN 'added' END AS x_c,
  CAST(NULL AS STRING) AS x_d, 'kept' AS x_eg FROM events""",
)
def _(t: Tables):
    h = t.events.selectExpr(
        "event_id", "event_id % 2 = 0 AS on_retry",
        "map(':method', ':m', 'x-a', 'old', 'x-b', event_type, 'x-c', 'added', 'x-d', 'drop', 'x-ai-eg-model', 'kept') AS headers",
        "map('x-a', 'old', 'x-b', 'orig', 'x-d', 'drop') AS original_headers",
        "map('x-a', 'new', ':method', 'no', 'x-ai-eg-model', 'no') AS sets", "array('x-d', 'X-Envoy-Original-Path', 'x-ai-eg-model') AS removes",
    )
    m = H.apply_header_mutation(h)
    g = lambda k, n: F.try_element_at("headers", F.lit(k)).alias(n)
    return m.select("event_id", g(":method", "method"), g("x-a", "x_a"), g("x-b", "x_b"), g("x-c", "x_c"), g("x-d", "x_d"), g("x-ai-eg-model", "x_eg"))


@query(
    "apply_body_mutation",
    """SELECT conv_id * 100 + turn AS request_id, CASE WHEN turn % 4 <> 3 THEN 'tier-' || CAST(conv_id % 3 AS STRING) END AS tier,
  CASE WHEN turn % 4 <> 3 THEN CAST(turn AS STRING) END AS max_tokens, CAST(NULL AS STRING) AS temperature, CASE WHEN turn % 4 NOT IN (1, 3) THEN text END AS text FROM conversations""",
)
def _(t: Tables):
    r = t.chat_requests.selectExpr(
        "request_id", "turn", "request_body", "map('tier', concat('tier-', conv_id % 3), 'max_tokens', CAST(turn AS STRING)) AS body_sets", "array('temperature', 'absent') AS body_removes"
    )
    m = H.apply_body_mutation(r)
    g = lambda p: F.get_json_object("request_body", p)
    return m.select(
        "request_id", g("$.tier").alias("tier"), g("$.max_tokens").alias("max_tokens"), g("$.temperature").alias("temperature"),
        F.when(F.col("turn") % 4 != 1, g("$.messages[1].content")).alias("text"),
    )


@query(
    "resolve_filter_policy",
    """WITH b AS (SELECT DISTINCT user_id % 7 AS route, event_id % 5 AS backend FROM events)
  SELECT concat('r', CAST(route AS STRING)) AS route, concat('b', CAST(backend AS STRING)) AS backend,
    CASE WHEN route % 3 = 0 AND backend = 1 THEN NULL WHEN backend = 1 THEN 'section' WHEN route % 3 = 0 THEN 'wide' WHEN backend = 2 THEN 'inline' END AS policy,
    CASE WHEN route % 3 = 0 AND backend = 1 THEN 'multiple standalone policies' END AS error FROM b""",
)
def _(t: Tables):
    b = t.events.selectExpr("concat('r', user_id % 7) AS route", "concat('b', event_id % 5) AS backend").distinct()
    routes = b.select("route").distinct()
    standalone = routes.where("CAST(substr(route, 2) AS INT) % 3 = 0").selectExpr("route", "CAST(NULL AS STRING) AS section", "'wide' AS policy").unionByName(
        routes.selectExpr("route", "'b1' AS section", "'section' AS policy")
    )
    inline = b.where("backend = 'b2'").selectExpr("route", "backend", "'inline' AS policy")
    return H.resolve_filter_policy(b, standalone, inline)


def selectors(t: Tables):
    return t.spark.createDataFrame(
        [
            ("github", ["click_0", "view_1", "signup_2"], ["view_1"], ["^nothing$"], []),
            ("jira", [], ["error_3"], ["^(click|view)_", "_2$"], ["_0$"]),
        ],
        "backend string, include array<string>, exclude array<string>, include_regex array<string>, exclude_regex array<string>",
    )


_ALLOWED = """CASE backend WHEN 'github' THEN tool IN ('click_0', 'signup_2') WHEN 'jira' THEN tool <> 'error_3' AND NOT tool LIKE '%\\_0' ESCAPE '\\' AND
   (regexp_matches(tool, '^(click|view)_') OR regexp_matches(tool, '_2$')) ELSE true END"""


@query("select_tools", TOOLS + f"SELECT backend, tool FROM tools WHERE {_ALLOWED}")
def _(t: Tables):
    return H.select_tools(t.tools, selectors(t))


@query(
    "validate_tool_selectors",
    "SELECT event_type, concat(event_type, '(?=x)') AS bad FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('click', 'view')",
)
def _(t: Tables):
    s = t.events.select("event_type").distinct().selectExpr(
        "event_type", "CASE WHEN event_type IN ('click', 'view') THEN array('ok', concat(event_type, '(?=x)')) ELSE array(event_type) END AS include_regex",
        "CAST(NULL AS ARRAY<STRING>) AS exclude_regex",
    )
    return H.validate_tool_selectors(s).select("event_type", F.array_join("bad_patterns", ",").alias("bad"))


@query("merge_tool_catalog", TOOLS + f"SELECT backend, tool, concat(backend, '__', tool) AS name FROM tools WHERE backend <> 'docs' AND {_ALLOWED}")
def _(t: Tables):
    caps = t.tools.select("backend").distinct().selectExpr("backend", "CASE backend WHEN 'docs' THEN 4 ELSE 3 END AS caps")
    return H.merge_tool_catalog(t.tools, caps, selectors(t))


@query(
    "merge_resource_catalogs",
    """SELECT 'resource' AS kind, concat('b', CAST(page_id % 3 AS STRING)) AS backend, concat('b', CAST(page_id % 3 AS STRING), '__p', CAST(page_id AS STRING)) AS name,
    concat('b', CAST(page_id % 3 AS STRING), '+', url) AS uri FROM pages
  UNION ALL SELECT 'template', 'b9', concat('b9__t', CAST(page_id AS STRING)), concat('b9+', url, '/{id}') FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT 'prompt', 'b8', concat('b8__q', CAST(page_id AS STRING)), NULL FROM pages WHERE page_id % 5 = 0""",
)
def _(t: Tables):
    p = t.table("pages")
    return H.merge_resource_catalogs(
        p.selectExpr("concat('b', page_id % 3) AS backend", "concat('p', page_id) AS name", "url AS uri"),
        p.where("page_id % 2 = 0").selectExpr("'b9' AS backend", "concat('t', page_id) AS name", "concat(url, '/{id}') AS uri"),
        p.where("page_id % 5 = 0").selectExpr("'b8' AS backend", "concat('q', page_id) AS name"),
    )


AUTH_RULES = [
    H.AuthRule("Deny", condition="event_type = 'error'"),
    H.AuthRule("Allow", targets=(("github", "click"),), claims=(H.ClaimRule("tenant", ("1", "2")),), scopes=("read", "write")),
    H.AuthRule("Allow", scopes=("admin", "signup")),
    H.AuthRule("Allow", targets=(("github", "view"), ("jira", "view")), source=True),
    H.AuthRule("Allow", claims=(H.ClaimRule("sub", ("user7",)),), scopes=("read",)),
]


def auth_calls(t: Tables):
    return t.sql(TOKENS, e=t.events).withColumns(
        {"backend": F.expr("CASE event_id % 2 WHEN 0 THEN 'github' ELSE 'jira' END"), "tool": F.col("event_type")}
    )


_AUTH = """WITH c AS (SELECT event_id, event_type, user_id, CASE event_id % 2 WHEN 0 THEN 'github' ELSE 'jira' END AS backend, event_id % 6 <> 5 AS tok FROM events),
  s AS (SELECT *, tok AND event_id % 3 = 0 AS rw, tok AND event_id % 3 = 1 AS adm, tok AND user_id % 5 IN (1, 2) AS ten, tok AND user_id = 7 AS u7 FROM c),
  d AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 WHEN backend = 'github' AND event_type = 'click' AND ten AND rw THEN 1 WHEN adm AND event_type = 'signup' THEN 2
     WHEN event_type = 'view' THEN 3 WHEN u7 AND rw THEN 4 END AS rule_idx FROM s)
"""


@query("authorize_calls", _AUTH + "SELECT event_id, rule_idx, coalesce(rule_idx > 0, false) AS allowed FROM d")
def _(t: Tables):
    return H.authorize_calls(auth_calls(t), AUTH_RULES).select("event_id", "rule_idx", "allowed")


@query(
    "scope_challenge",
    _AUTH
    + """SELECT event_id, CASE WHEN rule_idx IS NULL THEN concat('Bearer error="insufficient_scope", scope="', CASE WHEN u7 THEN 'read'
     WHEN backend = 'github' AND event_type = 'click' AND ten THEN 'read write' ELSE 'admin signup' END, '", error_description="The token is missing required scopes"') END AS scope_challenge FROM d""",
)
def _(t: Tables):
    return H.authorize_calls(auth_calls(t), AUTH_RULES).select("event_id", "scope_challenge")


def rule_rows(rules, route):
    """Rules as rows of a table."""
    return [
        (route, i, r.action, r.condition, [list(x) for x in r.targets] or None, [(c.path, list(c.values), c.kind) for c in r.claims] or None, list(r.scopes) or None)
        for i, r in enumerate(rules)
    ]


_RULE_SCHEMA = "route string, " + ", ".join(f"{c} {k}" for c, k in H.RULE_COLUMNS.items())
OTHER_RULES = [H.AuthRule("Allow", condition="to_date(concat('2024-', event_id % 20, '-01')) IS NOT NULL AND element_at(split(event_type, 'i'), 2) = 'ew'"), H.AuthRule("Deny", scopes=("read",))]


@query(
    "authorize_calls_by_route",
    _AUTH
    + """, e AS (SELECT *, event_id % 4 AS k, event_type = 'view' AND event_id % 20 BETWEEN 1 AND 12 AS dated FROM d),
  f AS (SELECT event_id, k, CASE k WHEN 0 THEN rule_idx WHEN 1 THEN CASE WHEN dated THEN 0 WHEN rw THEN 1 END END AS rule_idx, event_type, backend, u7, ten FROM e)
  SELECT event_id, rule_idx, CASE k WHEN 0 THEN coalesce(rule_idx > 0, false) WHEN 1 THEN coalesce(rule_idx = 0, true) ELSE k = 3 END AS allowed,
    CASE WHEN k = 0 AND rule_idx IS NULL THEN concat('Bearer error="insufficient_scope", scope="', CASE WHEN u7 THEN 'read'
     WHEN backend = 'github' AND event_type = 'click' AND ten THEN 'read write' ELSE 'admin signup' END, '", error_description="The token is missing required scopes"') END AS scope_challenge FROM f""",
)
def _(t: Tables):
    rules = t.spark.createDataFrame(rule_rows(AUTH_RULES, "r0") + rule_rows(OTHER_RULES, "r1"), _RULE_SCHEMA)
    defaults = t.spark.createDataFrame([("r0", "Deny"), ("r1", "Allow"), ("r2", "Deny")], "route string, default_action string")
    calls = auth_calls(t).withColumn("route", F.expr("concat('r', event_id % 4)"))
    return H.authorize_calls_by_route(calls, rules, defaults).select("event_id", "rule_idx", "allowed", "scope_challenge")


@query(
    "authorize_failing_condition",
    """WITH e AS (SELECT event_id, event_type, user_id FROM events)
   SELECT event_id, CASE WHEN user_id % 4 = 1 AND user_id > 30 THEN 0 WHEN user_id % 4 >= 2 AND 1000 // (user_id % 4 - 1) > 500 THEN 1 END AS rule_idx,
     coalesce(CASE WHEN user_id % 4 = 1 AND user_id > 30 THEN true WHEN user_id % 4 >= 2 AND 1000 // (user_id % 4 - 1) > 500 THEN false END, false) AS allowed FROM e""",
)
def _(t: Tables):
    calls = t.sql(
        """SELECT event_id, 'b' AS backend, event_type AS tool, '' AS authorization, user_id % 4 AS part,
             CASE WHEN user_id % 4 = 1 THEN CAST(user_id AS STRING) ELSE event_type END AS arg FROM {e}""",
        e=t.events,
    )
    rules = [H.AuthRule("Allow", condition="CAST(arg AS INT) > 30"), H.AuthRule("Deny", condition="part > 0 AND 1000 DIV (part - 1) > 500")]
    return H.authorize_calls(calls, rules).select("event_id", "rule_idx", "allowed")


@query(
    "pair_repeated_ids",
    MCP
    + """, m AS (SELECT route AS session, CAST(call_id % 3 AS STRING) AS id, start_us AS t0, call_id FROM mcp_calls),
   q AS (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY t0, call_id) AS n FROM m)
   SELECT session, id, t0 AS requested_us, CASE WHEN n % 2 = 0 THEN t0 END AS answered_us, n % 2 = 0 AS answered,
     CASE WHEN n % 2 = 0 THEN concat('{"n":', CAST(call_id AS STRING), '}') END AS result FROM q""",
)
def _(t: Tables):
    return H.pair_jsonrpc(repeated_ids(t), keys=("session",)).select("session", "id", "requested_us", "answered_us", "answered", "result")


def repeated_ids(t: Tables):
    """Messages whose ids come again in a session; every second request is answered at once, some twice."""
    return t.sql(
        """SELECT session, id, at + CASE WHEN x.result LIKE '%late%' THEN 1 ELSE 0 END AS at_us, x.kind, CASE WHEN x.kind = 'request' THEN 'tools/call' END AS method,
             CASE WHEN x.kind = 'request' THEN lpad(call_id, 12, '0') END AS params, x.result, CAST(NULL AS BIGINT) AS error_code, CAST(NULL AS STRING) AS error_message
           FROM (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY at, call_id) AS n FROM
             (SELECT route AS session, CAST(call_id % 3 AS STRING) AS id, start_us AS at, call_id FROM {m}))
           LATERAL VIEW explode(CASE WHEN n % 2 = 0 THEN array(struct('request' AS kind, CAST(NULL AS STRING) AS result), struct('response' AS kind, to_json(named_struct('n', call_id)) AS result),
             struct('response' AS kind, to_json(named_struct('n', call_id, 'late', 1)) AS result)) ELSE array(struct('request' AS kind, CAST(NULL AS STRING) AS result)) END) e AS x""",
        m=t.mcp_calls,
    )


def mcp_messages(t: Tables):
    """Requests of all calls and responses of most of them, as parsed JSON-RPC."""
    raw = t.sql(
        """SELECT route AS session, backend, start_us + k * duration_ms AS at_us, CASE k
             WHEN 0 THEN to_json(named_struct('jsonrpc', '2.0', 'id', call_id, 'method', 'tools/call', 'params', named_struct('name', full_tool_name)))
             ELSE CASE WHEN error_code IS NOT NULL THEN to_json(named_struct('jsonrpc', '2.0', 'id', call_id, 'error', named_struct('code', error_code, 'message', 'failed')))
               ELSE to_json(named_struct('jsonrpc', '2.0', 'id', call_id, 'result', named_struct('isError', is_error, 'content', array(
                 named_struct('type', 'text', 'text', concat('m', call_id), 'mimeType', NULL), named_struct('type', 'image', 'text', NULL, 'mimeType', 'image/png'))))) END END AS raw
           FROM (SELECT *, coalesce(CASE WHEN instr(full_tool_name, '__') > 0 THEN split_part(full_tool_name, '__', 1) END, 'none') AS backend FROM {m})
           LATERAL VIEW explode(CASE WHEN call_id % 10 = 0 THEN array(0) ELSE array(0, 1) END) x AS k""",
        m=t.mcp_calls,
    )
    return parse_jsonrpc(raw)


@query(
    "pair_jsonrpc",
    MCP
    + """SELECT route AS session, CAST(call_id AS STRING) AS id, 'tools/call' AS method, start_us AS requested_us, CASE WHEN call_id % 10 <> 0 THEN start_us + duration_ms END AS answered_us,
   call_id % 10 <> 0 AS answered, CAST(CASE WHEN call_id % 10 <> 0 THEN error_code END AS BIGINT) AS error_code FROM mcp_calls""",
)
def _(t: Tables):
    return H.pair_jsonrpc(mcp_messages(t)).select("session", "id", "method", "requested_us", "answered_us", "answered", "error_code")


@query(
    "tool_errors",
    MCP
    + """SELECT CAST(call_id AS STRING) AS id, full_tool_name AS tool_name, concat('tool returned isError=true: m', CAST(call_id AS STRING), '; [image: image/png]') AS error_text
   FROM mcp_calls WHERE is_error AND call_id % 10 <> 0""",
)
def _(t: Tables):
    return H.tool_errors(H.pair_jsonrpc(mcp_messages(t))).select("id", "tool_name", "error_text")


@query(
    "broadcast_outcome",
    MCP
    + """, r AS (SELECT call_id - call_id % 4 AS request_id, error_code IS NOT NULL AS err, call_id % 7 = 3 AS bad FROM mcp_calls)
   SELECT request_id, count(*) AS backends, count(*) FILTER (WHERE NOT err AND NOT bad) AS merged, count(*) FILTER (WHERE err) AS failed,
     count(*) FILTER (WHERE NOT err AND bad) AS dropped, CASE WHEN bool_or(err) THEN 'error' ELSE 'success' END AS status FROM r GROUP BY 1""",
)
def _(t: Tables):
    r = t.mcp_calls.selectExpr("call_id - call_id % 4 AS request_id", "error_code", "CASE WHEN call_id % 7 = 3 THEN '{bad' ELSE '{\"tools\":[]}' END AS result")
    return H.broadcast_outcome(r)


BATCH_IN = """SELECT to_json(named_struct('custom_id', concat('item-', request_id), 'method', 'POST', 'url', '/v1/chat/completions',
    'body', named_struct('model', original_model, 'max_tokens', output_tokens))) AS value FROM {r}"""
BATCH_OUT = """SELECT to_json(named_struct('id', concat('batch-', request_id), 'custom_id', concat('item-', request_id),
    'response', CASE WHEN success THEN named_struct('status_code', status, 'request_id', concat('q', request_id), 'body', named_struct('model', original_model, 'usage',
        named_struct('prompt_tokens', input_tokens, 'completion_tokens', output_tokens, 'total_tokens', input_tokens))) END,
    'error', CASE WHEN NOT success THEN named_struct('code', 'failed', 'message', concat('status ', status)) END)) AS value FROM {r} WHERE request_id % 6 <> 0"""


@query(
    "join_batch",
    REQ
    + """SELECT original_model AS model, count(*) AS total, count(*) FILTER (WHERE request_id % 6 <> 0 AND success) AS completed, count(*) FILTER (WHERE request_id % 6 <> 0 AND NOT success) AS failed,
   count(*) FILTER (WHERE request_id % 6 = 0) AS missing FROM llm_requests GROUP BY 1""",
)
def _(t: Tables):
    from ..sources.batch import parse_batch_input, parse_batch_output

    i = parse_batch_input(t.sql(BATCH_IN, r=t.llm_requests)).withColumn("model", F.get_json_object("body", "$.model"))
    o = parse_batch_output(t.sql(BATCH_OUT, r=t.llm_requests))
    return H.batch_progress(H.join_batch(i, o), ["model"])


_CFG = "SELECT DISTINCT concat('route-', CAST(user_id % 3 AS STRING)) AS route, CASE event_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'jira' ELSE 'docs' END AS backend, 'include' AS kind, event_type AS value FROM {e} WHERE {w}"


@query(
    "config_diff",
    f"""WITH o AS ({_CFG.replace('{e}', 'events').replace('{w}', "event_type <> 'view'")}), n AS ({_CFG.replace('{e}', 'events').replace('{w}', "event_type <> 'error' AND event_id % 3 < 2")})
  SELECT *, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""",
)
def _(t: Tables):
    old = t.sql(_CFG.replace("{w}", "event_type <> 'view'"), e=t.events)
    new = t.sql(_CFG.replace("{w}", "event_type <> 'error' AND event_id % 3 < 2"), e=t.events)
    return H.config_diff(old, new)


@query(
    "route_unsupported",
    REQ
    + "SELECT operation, api_schema, count(*) AS requests FROM llm_requests WHERE operation = 'responses' AND api_schema <> 'OpenAI' GROUP BY 1, 2",
)
def _(t: Tables):
    return H.route_unsupported(t.llm_requests)
