"""Rate limits and quotas over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import BACKENDS, Tables, with_views
from ..operators import quota as Q
from . import query

REQ = with_views("llm_requests")
HOUR = "CAST(floor(start_us / 3600000000) AS BIGINT) * 3600000000"
DAY = "CAST(floor(start_us / 86400000000) AS BIGINT) * 86400000000"
COSTED = "SELECT *, input_tokens + coalesce(output_tokens, 0) AS total_tokens FROM llm_requests"
_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def costed(t: Tables):
    return t.llm_requests.withColumn("total_tokens", F.expr("input_tokens + coalesce(output_tokens, 0)"))


@query(
    "fixed_window_limit",
    REQ
    + f""", w AS (SELECT *, {DAY} AS window_us FROM ({COSTED})),
  u AS (SELECT *, CAST(coalesce(sum(total_tokens) OVER (PARTITION BY tenant, window_us ORDER BY start_us, request_id {_EARLIER}), 0) AS BIGINT) AS used FROM w)
  SELECT request_id, tenant, window_us, used, used >= 100 AS refused, CASE WHEN used >= 100 THEN 429 ELSE 200 END AS status FROM u""",
)
def _(t: Tables):
    r = Q.fixed_window_limit(costed(t), ["tenant"], "start_us", "request_id", "total_tokens", 100, "Day")
    return r.select("request_id", "tenant", "window_us", "used", "refused", "status")


@query(
    "client_selectors",
    "SELECT concat('[\"', user_id, '\"]') AS client, count(*) AS n FROM (SELECT CAST(user_id AS STRING) AS user_id FROM events WHERE event_type = 'click' AND event_id % 4 <> 0) GROUP BY 1",
)
def _(t: Tables):
    r = t.sql(
        """SELECT event_id, map_filter(map('x-tenant-id', CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS STRING) END, 'x-kind', event_type), (k, v) -> v IS NOT NULL) AS headers FROM {e}""",
        e=t.events,
    )
    sel = Q.client_selectors(r, [Q.ClientSelector("x-tenant-id"), Q.ClientSelector("x-kind", "Exact", "click")])
    return sel.groupBy(F.col("client_key").alias("client")).agg(F.count("*").alias("n"))


@query(
    "multi_rule_limit",
    REQ
    + f""", w AS (SELECT *, {DAY} AS window_us FROM ({COSTED})),
  u AS (SELECT *, coalesce(sum(input_tokens) OVER p, 0) AS ui, coalesce(sum(output_tokens) OVER p, 0) AS uo, coalesce(sum(total_tokens) OVER p, 0) AS ut FROM w
        WINDOW p AS (PARTITION BY tenant, window_us ORDER BY start_us, request_id {_EARLIER}))
  SELECT request_id, CAST(ui AS BIGINT) AS used_input, CAST(uo AS BIGINT) AS used_output, CAST(ut AS BIGINT) AS used_total, ui >= 60 OR uo >= 70 AS refused,
    concat_ws(',', CASE WHEN ui >= 60 THEN 'input' END, CASE WHEN uo >= 70 THEN 'output' END, CASE WHEN ut >= 50 THEN 'total' END) AS exhausted FROM u""",
)
def _(t: Tables):
    rules = [Q.LimitRule("input", "input_tokens", 60), Q.LimitRule("output", "output_tokens", 70), Q.LimitRule("total", "total_tokens", 50, shadow=True)]
    r = Q.multi_rule_limit(costed(t), rules, ["tenant"], "start_us", "request_id", "Day")
    return r.select("request_id", "used_input", "used_output", "used_total", "refused", F.array_join("exhausted", ",").alias("exhausted"))


@query(
    "budget_report",
    REQ
    + f"""SELECT tenant, {HOUR} AS window_us, CAST(sum(input_tokens) AS BIGINT) AS used, CAST(40 AS BIGINT) AS "limit", CAST(greatest(40 - sum(input_tokens), 0) AS BIGINT) AS remaining
  FROM llm_requests GROUP BY 1, 2""",
)
def _(t: Tables):
    return Q.budget_report(t.llm_requests, ["tenant"], "start_us", "input_tokens", 40)


@query(
    "parse_duration",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN user_id * 60 WHEN 3 THEN user_id * 3600 END AS seconds FROM events""",
)
def _(t: Tables):
    d = t.sql("SELECT event_id, concat(user_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' ELSE 'd' END) AS duration FROM {e}", e=t.events)
    return Q.parse_duration(d).select("event_id", "seconds")


def _fold_sql(limit: int, span_us: int) -> str:
    """Row-by-row admission per tenant as a recursive query (state: admitted rows in the window)."""
    return f""", o AS (SELECT tenant, request_id, start_us, total_tokens AS c, row_number() OVER (PARTITION BY tenant ORDER BY start_us, request_id) AS rn FROM ({COSTED})),
  f AS (SELECT tenant, request_id, rn, true AS allowed, CASE WHEN c > 0 THEN [{{'a': start_us, 'c': c}}] ELSE [] END AS q FROM o WHERE rn = 1
    UNION ALL
    SELECT o.tenant, o.request_id, o.rn, coalesce(list_sum(list_transform(list_filter(f.q, lambda x: x.a > o.start_us - {span_us}), lambda x: x.c)), 0) < {limit},
      CASE WHEN o.c > 0 AND coalesce(list_sum(list_transform(list_filter(f.q, lambda x: x.a > o.start_us - {span_us}), lambda x: x.c)), 0) < {limit}
           THEN list_append(list_filter(f.q, lambda x: x.a > o.start_us - {span_us}), {{'a': o.start_us, 'c': o.c}})
           ELSE list_filter(f.q, lambda x: x.a > o.start_us - {span_us}) END
    FROM f JOIN o ON o.tenant = f.tenant AND o.rn = f.rn + 1)
  SELECT request_id, allowed FROM f"""


@query("sliding_window_quota", REQ.replace("WITH ", "WITH RECURSIVE ", 1) + _fold_sql(150, 86_400_000_000))
def _(t: Tables):
    r = Q.sliding_window_quota(costed(t).select("request_id", "tenant", "start_us", "total_tokens"), ["tenant"], "start_us", "request_id", "total_tokens", 150, 86_400)
    return r.select("request_id", "allowed")


BUCKETS = [
    Q.Bucket("chat", 120, 43_200, "operation = 'chat'"),
    Q.Bucket("stream", 80, 86_400, "stream"),
    Q.Bucket("default", 200, 86_400),
]


def _bucketed(t: Tables, mode: str):
    r = costed(t).select("request_id", "original_model", "tenant", "operation", "stream", "start_us", "total_tokens")
    return Q.bucket_mode(r, BUCKETS, mode, ["tenant", "original_model"], "start_us", "request_id", "total_tokens").select("request_id", "allowed")


def _bucket_sql(mode: str) -> str:
    """The same buckets as a recursive query: admitted rows of the last day with their marks."""
    def used(cond: str, span_us: int) -> str:
        return f"coalesce(list_sum(list_transform(list_filter(f.q, lambda x: x.a > o.start_us - {span_us} AND {cond}), lambda x: x.c)), 0)"

    if mode == "Shared":
        chat, stream, default = used("x.k", 43_200_000_000), used("x.s", 86_400_000_000), used("true", 86_400_000_000)
        ok = f"(NOT o.k OR {chat} < 120) AND (NOT o.s OR {stream} < 80) AND {default} < 200"
    else:
        chat, stream, default = used("x.k", 43_200_000_000), used("x.s", 86_400_000_000), used("NOT x.k AND NOT x.s", 86_400_000_000)
        ok = f"CASE WHEN o.k OR o.s THEN (o.k AND {chat} < 120) OR (o.s AND {stream} < 80) ELSE {default} < 200 END"
    row = "{'a': o.start_us, 'c': o.c, 'k': o.k, 's': o.s}"
    first = row.replace("o.", "")
    kept = "list_filter(f.q, lambda x: x.a > o.start_us - 86400000000)"
    return f""", o AS (SELECT tenant, original_model, request_id, start_us, total_tokens AS c, operation = 'chat' AS k, stream AS s,
      row_number() OVER (PARTITION BY tenant, original_model ORDER BY start_us, request_id) AS rn FROM ({COSTED})),
  f AS (SELECT tenant, original_model, request_id, rn, true AS allowed, CASE WHEN c > 0 THEN [{first}] ELSE [] END AS q FROM o WHERE rn = 1
    UNION ALL SELECT o.tenant, o.original_model, o.request_id, o.rn, {ok}, CASE WHEN o.c > 0 AND ({ok}) THEN list_append({kept}, {row}) ELSE {kept} END
    FROM f JOIN o ON o.tenant = f.tenant AND o.original_model = f.original_model AND o.rn = f.rn + 1)
  SELECT request_id, allowed FROM f"""


@query("bucket_mode", REQ.replace("WITH ", "WITH RECURSIVE ", 1) + _bucket_sql("Exclusive"))
def _(t: Tables):
    return _bucketed(t, "Exclusive")


@query("bucket_mode_shared", REQ.replace("WITH ", "WITH RECURSIVE ", 1) + _bucket_sql("Shared"))
def _(t: Tables):
    return _bucketed(t, "Shared")


@query(
    "quota_shadow_rule",
    REQ
    + f""", w AS (SELECT *, {DAY} AS window_us FROM llm_requests),
  u AS (SELECT *, coalesce(sum(input_tokens) OVER (PARTITION BY tenant, window_us ORDER BY start_us, request_id {_EARLIER}), 0) AS used FROM w)
  SELECT request_id, used >= 30 AS over_limit, false AS refused FROM u""",
)
def _(t: Tables):
    return Q.quota_shadow_rule(t.llm_requests, ["tenant"], "start_us", "request_id", "input_tokens", 30, "Day").select("request_id", "over_limit", "refused")


@query(
    "quota_resolution",
    REQ
    + """, m AS (SELECT DISTINCT api_schema, original_model FROM llm_requests WHERE original_model IN ('model-1', 'model-2') AND api_schema <> 'OpenAI')
  SELECT r.request_id, CASE WHEN m.api_schema IS NOT NULL THEN CASE r.original_model WHEN 'model-1' THEN 100 ELSE 200 END WHEN r.api_schema <> 'AWSAnthropic' THEN 1000 END AS quota_limit,
    CASE WHEN m.api_schema IS NOT NULL THEN '5m' WHEN r.api_schema <> 'AWSAnthropic' THEN '1h' END AS quota_duration,
    CASE WHEN m.api_schema IS NOT NULL AND r.original_model = 'model-2' THEN 'input_tokens' ELSE 'total_tokens' END AS quota_expression
  FROM llm_requests r LEFT JOIN m ON r.api_schema = m.api_schema AND r.original_model = m.original_model""",
)
def _(t: Tables):
    r = t.llm_requests.select("request_id", F.col("api_schema").alias("backend"), F.col("original_model").alias("model"))
    per_model = r.where("model IN ('model-1', 'model-2') AND backend <> 'OpenAI'").select("backend", "model").distinct().selectExpr(
        "backend", "model", "CASE model WHEN 'model-1' THEN 100 ELSE 200 END AS limit", "'5m' AS duration", "CASE model WHEN 'model-2' THEN 'input_tokens' END AS expression"
    )
    service = r.where("backend <> 'AWSAnthropic'").select("backend").distinct().selectExpr(
        "backend", "1000 AS limit", "'1h' AS duration", "CAST(NULL AS STRING) AS expression"
    )
    return Q.quota_resolution(r, per_model, service).select("request_id", "quota_limit", "quota_duration", "quota_expression")


@query(
    "quota_aware_route",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'pt-east' WHEN event_id % 3 = 0 THEN 'pt-west' WHEN event_id % 5 <> 0 THEN 'on-demand' END AS selected_backend,
  CASE WHEN event_id % 2 <> 0 AND event_id % 3 <> 0 AND event_id % 5 = 0 THEN 429 ELSE 200 END AS status FROM events""",
)
def _(t: Tables):
    r = t.events.selectExpr(
        "event_id",
        "array_compact(array(CASE WHEN event_id % 2 <> 0 THEN 2 END, CASE WHEN event_id % 3 <> 0 THEN 3 END, CASE WHEN event_id % 5 = 0 THEN 4 END)) AS violated",
    )
    return Q.quota_aware_route(r, [(b, p, i + 2) for i, (b, _s, p, _w) in enumerate(BACKENDS)]).select("event_id", "selected_backend", "status")


@query(
    "quota_aware_route_by_policy",
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 6 < 5 THEN user_id % 6 END AS tenant, event_type AS model, event_id % 3 AS k FROM events),
  v AS (SELECT DISTINCT tenant, model FROM e WHERE tenant = 1 OR tenant IS NULL), u AS (SELECT DISTINCT tenant, model FROM e WHERE model = 'view')
  SELECT event_id, CASE k WHEN 0 THEN CASE WHEN v.model IS NULL THEN 'pt-west' WHEN u.model IS NULL THEN 'pt-east' ELSE 'on-demand' END
      WHEN 1 THEN CASE WHEN u.model IS NULL THEN 'pt-east' END END AS selected_backend,
    CASE WHEN k = 2 OR (k = 1 AND u.model IS NOT NULL) THEN 429 ELSE 200 END AS status
  FROM e LEFT JOIN v ON e.tenant IS NOT DISTINCT FROM v.tenant AND e.model = v.model LEFT JOIN u ON e.tenant IS NOT DISTINCT FROM u.tenant AND e.model = u.model""",
)
def _(t: Tables):
    calls = t.events.selectExpr("event_id", "CASE WHEN user_id % 6 < 5 THEN user_id % 6 END AS tenant", "event_type AS model", "concat('r', event_id % 3) AS route")
    rows = [("r0", "on-demand", 1, 0), ("r0", "pt-west", 0, 1), ("r0", "pt-east", 0, 2), ("r1", "pt-east", 4, 0)]
    backends = t.spark.createDataFrame(rows, "route string, backend string, priority int, listed int")
    out = calls.where("tenant = 1 OR tenant IS NULL").selectExpr("tenant", "model", "'pt-west' AS backend")
    out = out.union(calls.where("model = 'view'").selectExpr("tenant", "model", "'pt-east' AS backend"))
    return Q.quota_aware_route_by_policy(calls, backends, out).select("event_id", "selected_backend", "status")


@query(
    "charge_at_completion",
    REQ
    + f""", e AS (SELECT tenant, request_id, start_us AS at_us, 1 AS kind, 0 AS c FROM llm_requests UNION ALL SELECT tenant, request_id, start_us + duration_ms * 60000000, 0, input_tokens FROM llm_requests),
  w AS (SELECT *, CAST(floor(at_us / 86400000000) AS BIGINT) * 86400000000 AS window_us FROM e),
  u AS (SELECT *, CAST(coalesce(sum(c) OVER (PARTITION BY tenant, window_us ORDER BY at_us, kind, request_id {_EARLIER}), 0) AS BIGINT) AS used FROM w)
  SELECT request_id, window_us, used, used >= 20 AS refused FROM u WHERE kind = 1""",
)
def _(t: Tables):
    r = t.llm_requests.withColumn("end_us", F.col("start_us") + F.col("duration_ms") * 60_000_000)
    return Q.charge_at_completion(r, ["tenant"], "start_us", "end_us", "request_id", "input_tokens", 20, "Day").select("request_id", "window_us", "used", "refused")


POLICY_QUOTAS = [
    ("OpenAI", "model-1", "Shared", None, 400, "12h"),
    ("OpenAI", "model-2", "Exclusive", "input_tokens + output_tokens * 2", 100, "86400"),
    ("AzureOpenAI", "model-3", "Exclusive", None, None, None),
    ("AzureOpenAI", None, None, "input_tokens", 500, "1440m"),
]
POLICY_RULES = [
    ("OpenAI", "model-1", 0, [("x-operation", "Exact", "chat")], 150, "6h", False),
    ("OpenAI", "model-1", 1, [("x-tenant-id", "Distinct", None)], 60, "1440m", None),
    ("OpenAI", "model-1", 2, [("x-stream", "Exact", "true")], 100, "3600s", True),
    ("OpenAI", "model-2", 0, [("x-tenant-id", "Distinct", None), ("x-operation", "Exact", "chat")], 40, "12h", False),
    ("OpenAI", "model-2", 1, [("x-stream", "Exact", "true")], 200, "24h", False),
    ("AzureOpenAI", "model-3", 5, None, 300, "2h", False),
]


def _policy_sql() -> str:
    """The same policy as a recursive query; state are the admitted requests of the last day with the buckets they drew on."""
    def bucket(name: str, rule: int, limit: int, seconds: int, shadow: str = "false") -> str:
        return f"{{'id': {name}, 'r': {rule}, 'lim': {limit}, 'span': {seconds}000000, 'sh': {shadow}}}"

    used = "coalesce(list_sum(list_transform(list_filter(f.q, lambda x: x.a > o.t - b.span AND list_contains(x.ids, b.id)), lambda x: x.c)), 0)"
    day = "list_filter(q, lambda x: x.a > t - 86400000000)"
    return f""", m AS (SELECT request_id, start_us AS t, tenant AS cl, operation = 'chat' AS k, stream AS s, request_id % 4 <> 0 AS known, input_tokens, coalesce(output_tokens, 0) AS output_tokens,
      CASE WHEN api_schema = 'OpenAI' AND original_model = 'model-1' THEN 1 WHEN api_schema = 'OpenAI' AND original_model = 'model-2' THEN 2
           WHEN api_schema = 'AzureOpenAI' AND original_model = 'model-3' THEN 3 WHEN api_schema = 'AzureOpenAI' THEN 4 END AS g FROM llm_requests),
  c AS (SELECT request_id, g, t, CAST(CASE g WHEN 2 THEN input_tokens + output_tokens * 2 WHEN 4 THEN input_tokens ELSE input_tokens + output_tokens END AS BIGINT) AS c,
      CASE g WHEN 1 THEN [CASE WHEN k THEN {bucket("'0'", 0, 150, 21600)} END, CASE WHEN known THEN {bucket("'1' || cl", 1, 60, 86400)} END,
             CASE WHEN s THEN {bucket("'2'", 2, 100, 3600, "true")} END, {bucket("'d'", -1, 400, 43200)}]
           WHEN 2 THEN [CASE WHEN k AND known THEN {bucket("'0' || cl", 0, 40, 43200)} END, CASE WHEN s THEN {bucket("'1'", 1, 200, 86400)} END,
             CASE WHEN NOT s AND NOT (k AND known) THEN {bucket("'d'", -1, 100, 86400)} END]
           WHEN 3 THEN [{bucket("'5'", 5, 300, 7200)}] ELSE [{bucket("'d'", -1, 500, 86400)}] END AS listed FROM m WHERE g IS NOT NULL),
  o AS (SELECT *, list_filter(listed, lambda b: b IS NOT NULL) AS bs, row_number() OVER (PARTITION BY g ORDER BY t, request_id) AS rn FROM c),
  f AS (SELECT g, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS cost, true AS allowed, CAST('' AS VARCHAR) AS exhausted,
      CAST([] AS STRUCT(a BIGINT, c BIGINT, ids VARCHAR[])[]) AS q FROM (SELECT DISTINCT g FROM o)
    UNION ALL
    SELECT g, rn, request_id, c, ok, out, CASE WHEN ok AND c > 0 THEN list_append({day}, {{'a': t, 'c': c, 'ids': list_transform(bs, lambda b: b.id)}}) ELSE {day} END FROM (
      SELECT *, CASE WHEN g IN (1, 4) THEN NOT list_contains(room, false) ELSE list_contains(room, true) END AS ok FROM (
        SELECT o.g, o.rn, o.request_id, o.c, o.t, o.bs, f.q, list_transform(o.bs, lambda b: b.sh OR {used} < b.lim) AS room,
          array_to_string(list_transform(list_filter(o.bs, lambda b: {used} >= b.lim), lambda b: b.r), ',') AS out
        FROM f JOIN o ON o.g = f.g AND o.rn = f.rn + 1)))
  SELECT m.request_id, CASE m.g WHEN 1 THEN 'model-1' WHEN 2 THEN 'model-2' WHEN 3 THEN 'model-3' END AS quota_model, f.cost AS quota_cost, coalesce(f.allowed, true) AS allowed,
    coalesce(f.exhausted, '') AS exhausted, CASE WHEN f.allowed THEN 200 WHEN m.g IS NULL THEN 200 ELSE 429 END AS status
  FROM m LEFT JOIN f ON f.request_id = m.request_id"""


@query("quota_policy_limit", REQ.replace("WITH ", "WITH RECURSIVE ", 1) + _policy_sql())
def _(t: Tables):
    quotas = t.spark.createDataFrame(POLICY_QUOTAS, "backend string, model string, mode string, expression string, limit long, duration string")
    rules = t.spark.createDataFrame(
        POLICY_RULES, "backend string, model string, rule int, selectors array<struct<header: string, kind: string, value: string>>, limit long, duration string, shadow boolean"
    )
    headers = F.expr("map('x-tenant-id', CASE WHEN request_id % 4 <> 0 THEN tenant END, 'x-operation', operation, 'x-stream', CAST(stream AS STRING))")
    calls = costed(t).withColumn("headers", headers)
    r = Q.quota_policy_limit(calls, quotas, rules, "start_us", "request_id", "api_schema", "original_model", keep=["request_id"])
    return r.select("request_id", "quota_model", "quota_cost", "allowed", F.array_join(F.col("exhausted").cast("array<string>"), ",").alias("exhausted"), "status")
