"""Cost over the request log and over batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import COST_RULES, Tables, with_views
from ..operators import cost as C
from ..operators.parse import provider_name, resolve_models
from ..operators.usage import usage_unpivot
from . import query
from .usage import mixed_bodies

REQ = with_views("llm_requests")
RULES = [C.CostRule(k, c) for _, k, c in COST_RULES]
TOTALLED = "SELECT *, input_tokens + coalesce(output_tokens, 0) AS total_tokens FROM llm_requests"
EXPR = "CASE WHEN model = 'model-1' THEN (input_tokens - cached_input_tokens - cache_creation_input_tokens) * output_tokens ELSE total_tokens END"


def priced(t: Tables):
    return t.llm_requests.withColumns(
        {
            "total_tokens": F.expr("input_tokens + coalesce(output_tokens, 0)"),
            "model": F.coalesce("model_override", "original_model"),
            "backend": F.lower("api_schema"),
        }
    )


@query(
    "cost_by_type",
    REQ
    + f"""SELECT request_id, r.rule_idx, r.metadata_key, CASE r.cost_type WHEN 'InputToken' THEN input_tokens WHEN 'OutputToken' THEN coalesce(output_tokens, 0) ELSE total_tokens END AS cost
  FROM ({TOTALLED}), (VALUES (0,'llm_input_token','InputToken'),(1,'llm_output_token','OutputToken'),(2,'llm_total_token','TotalToken'),(3,'llm_input_token','OutputToken')) AS r(rule_idx, metadata_key, cost_type)""",
)
def _(t: Tables):
    return C.cost_by_type(priced(t), RULES, ["request_id"])


@query(
    "cost_expression",
    REQ
    + f""", v AS (SELECT request_id, CASE WHEN coalesce(model_override, original_model) = 'model-1'
        THEN nullif(greatest(input_tokens - coalesce(cached_input_tokens, 0) - coalesce(cache_creation_input_tokens, 0), -1), -1) * coalesce(output_tokens, 0)
        ELSE total_tokens END AS c FROM ({TOTALLED}))
  SELECT request_id, c AS cost, CASE WHEN c IS NULL THEN 'negative result' END AS cost_error FROM v""",
)
def _(t: Tables):
    return C.cost_expression(priced(t), EXPR).select("request_id", "cost", "cost_error")


@query(
    "cost_expression_errors",
    REQ
    + f""", u AS (SELECT request_id, input_tokens AS i, coalesce(output_tokens, 0) AS o, total_tokens AS t FROM ({TOTALLED})),
  c AS (SELECT request_id, i, CASE WHEN i > 50 THEN o // (i - 50) END AS divided, CASE WHEN i >= 60 THEN i - 60 + 100 END AS less,
    CASE WHEN t <= 922 THEN t * 10000000000000000 END AS large, CASE WHEN i % 3 <> 0 THEN CAST(7 AS BIGINT) END AS cast_ FROM u)
  SELECT * EXCLUDE (i), CASE WHEN i < 50 THEN 'negative result' WHEN i = 50 THEN 'no result' END AS divided_error, CASE WHEN less IS NULL THEN 'negative result' END AS less_error,
    CASE WHEN large IS NULL THEN 'no result' END AS large_error, CASE WHEN cast_ IS NULL THEN 'no result' END AS cast_error FROM c""",
)
def _(t: Tables):
    out = priced(t)
    for name, expr in (
        ("divided", "output_tokens DIV (input_tokens - 50)"), ("less", "(input_tokens - 60) + 100"), ("large", "total_tokens * 10000000000000000"),
        ("cast_", "CAST(CASE WHEN input_tokens % 3 = 0 THEN model || 'x' ELSE '7' END AS BIGINT)"),
    ):
        out = C.expression_cost(out, expr, name, f"{name.rstrip('_')}_error")
    return out.select("request_id", "divided", "less", "large", "cast_", "divided_error", "less_error", "large_error", "cast_error")


@query(
    "cost_metadata",
    REQ
    + f"""SELECT request_id, CASE WHEN success THEN input_tokens END AS llm_input_token, CASE WHEN success THEN coalesce(output_tokens, 0) END AS llm_output_token,
  CASE WHEN success THEN total_tokens END AS llm_total_token, CASE WHEN success THEN coalesce(model_override, original_model) END AS model,
  CASE WHEN success THEN lower(api_schema) END AS backend FROM ({TOTALLED})""",
)
def _(t: Tables):
    r = C.cost_metadata(priced(t).withColumn("response_model", F.lit("")), RULES)
    return r.select(
        "request_id", *[F.try_element_at("cost", F.lit(k)).alias(k) for k in ("llm_input_token", "llm_output_token", "llm_total_token")],
        "model", "backend",
    )


@query(
    "cost_rollup",
    REQ
    + """SELECT tenant, coalesce(model_override, original_model) AS request_model, token_type, CAST(sum(value) AS BIGINT) AS value, count(*) AS requests FROM (
     SELECT *, 'input' AS token_type, input_tokens AS value FROM llm_requests UNION ALL SELECT *, 'cached_input', cached_input_tokens FROM llm_requests
     UNION ALL SELECT *, 'cache_creation_input', cache_creation_input_tokens FROM llm_requests UNION ALL SELECT *, 'output', output_tokens FROM llm_requests
     UNION ALL SELECT *, 'reasoning', reasoning_tokens FROM llm_requests) WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    r = resolve_models(t.llm_requests.withColumn("body_model", F.lit(None).cast("string")))
    return C.cost_rollup(usage_unpivot(r, ["tenant", "request_model"]), ["tenant", "request_model", "token_type"], ["value"])


@query(
    "cost_by_provider",
    REQ
    + f"""SELECT CASE api_schema WHEN 'OpenAI' THEN 'openai' WHEN 'AzureOpenAI' THEN 'azure.openai' WHEN 'GCPVertexAI' THEN 'gcp.vertex_ai'
  WHEN 'Anthropic' THEN 'anthropic' WHEN 'AWSAnthropic' THEN 'aws.anthropic' END AS provider, original_model, CAST(sum(c) AS BIGINT) AS cost, count(*) AS requests
  FROM (SELECT *, total_tokens * 2 AS c FROM ({TOTALLED})) GROUP BY 1, 2""",
)
def _(t: Tables):
    r = C.cost_expression(provider_name(priced(t)), "total_tokens * 2")
    return C.cost_rollup(r, ["provider", "original_model"], ["cost"])


@query(
    "batch_usage",
    REQ
    + """SELECT concat('item-', CAST(request_id AS STRING)) AS custom_id, CASE WHEN success THEN input_tokens END AS input_tokens,
  CASE WHEN success THEN coalesce(output_tokens, 0) END AS output_tokens, CASE WHEN success THEN input_tokens + coalesce(output_tokens, 0) END AS cost
  FROM llm_requests WHERE operation = 'chat' AND api_schema IN ('OpenAI', 'AzureOpenAI')""",
)
def _(t: Tables):
    results = mixed_bodies(t).where("operation = 'chat' AND api_schema IN ('OpenAI', 'AzureOpenAI')").selectExpr(
        "concat('item-', request_id) AS custom_id", "operation", "api_schema", "status AS status_code",
        "CASE WHEN NOT success THEN 'failed' END AS error", "response_body AS body",
    )
    return C.batch_usage(results, C.CostRule("total", "TotalToken")).select("custom_id", "input_tokens", "output_tokens", "cost")
