"""Filter decisions and redaction over filter calls, conversations and documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import Tables, with_views
from ..operators import filtering as R
from . import query

FILT = with_views("filter_calls")
CONV = "conv_id * 100 + turn AS request_id"


def duck_mask(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN '' ELSE concat('[REDACTED LENGTH=', CAST(strlen({c}) AS STRING), ' HASH=', substr(sha256({c}), 1, 16), ']') END"


ROLL = "CAST('0x' || substr(sha256(CAST(call_id AS STRING)), 1, 8) AS BIGINT) % 1000"
SAMPLED = f"CASE WHEN mode = 'Shadow' THEN {ROLL} < CASE WHEN sample_permille <= 0 THEN 1000 ELSE sample_permille END ELSE true END"
STATUS_SQL = """CASE WHEN NOT configured THEN 'off' WHEN coalesce(global_disable, false) OR NOT coalesce(enabled, true) THEN 'disabled' WHEN mode = 'Shadow' THEN 'pass'
   WHEN outcome = 'error' THEN CASE WHEN failure_policy = 'Fail' THEN 'unavailable' ELSE 'failed-open' END WHEN outcome = 'reject' THEN 'reject'
   WHEN outcome = 'pass' OR call_id % 17 = 0 THEN 'pass' WHEN call_id % 19 = 0 THEN 'unavailable' ELSE 'redact' END"""
ACTION_SQL = f"""CASE WHEN NOT configured THEN NULL WHEN coalesce(global_disable, false) OR NOT coalesce(enabled, true) THEN 'disabled' WHEN mode <> 'Shadow' THEN NULL
   WHEN NOT ({SAMPLED}) THEN 'shadow_sampled_out' WHEN outcome = 'error' THEN 'shadow_would_fail' WHEN outcome = 'reject' THEN 'shadow_would_reject'
   WHEN outcome = 'pass' OR call_id % 17 = 0 THEN 'shadow_would_pass' ELSE 'shadow_would_redact' END"""


def status_input(t: Tables):
    return R.shadow_sample(t.filter_calls).withColumns(
        {"body_equal": F.col("call_id") % 17 == 0, "replacement_valid": F.col("call_id") % 19 != 0}
    )


@query("redact_string", f"SELECT doc_id, {duck_mask('text')} AS text FROM documents")
def _(t: Tables):
    return R.redact_string(t.documents, "text").select("doc_id", "text")


@query(
    "redact_requests",
    f"""SELECT {CONV}, CASE WHEN turn % 4 <> 3 THEN {duck_mask('text')} END AS text,
  CASE WHEN turn % 4 = 1 THEN {duck_mask("concat('https://img.example/', CAST(conv_id AS STRING))")} END AS url,
  CASE WHEN turn % 4 = 2 THEN {duck_mask("concat('tool_', CAST(turn AS STRING))")} END AS call_name,
  CASE WHEN turn % 4 = 2 THEN {duck_mask("substr(text, 1, 20)")} END AS tool_description,
  CASE WHEN turn % 4 = 2 THEN concat('REDACTED LENGTH=16 HASH=', substr(sha256('map[type:object]'), 1, 16)) END AS tool_parameters FROM conversations""",
)
def _(t: Tables):
    r = R.redact_requests(t.chat_requests)
    g = lambda p: F.get_json_object("request_body", p)
    return r.select(
        "request_id",
        F.when(F.col("turn") % 4 == 1, g("$.messages[1].content[0].text")).otherwise(g("$.messages[1].content")).alias("text"),
        g("$.messages[1].content[1].image_url.url").alias("url"),
        g("$.messages[2].tool_calls[0].function.name").alias("call_name"),
        g("$.tools[0].function.description").alias("tool_description"),
        g("$.tools[0].function.parameters._redacted").alias("tool_parameters"),
    )


@query(
    "redact_responses",
    f"""SELECT {CONV}, CASE WHEN turn % 3 <> 2 THEN {duck_mask('text')} END AS content, CASE WHEN turn % 3 = 2 THEN {duck_mask("'lookup'")} END AS call_name
  FROM conversations WHERE role = 'assistant'""",
)
def _(t: Tables):
    r = R.redact_responses(t.chat_responses)
    g = lambda p: F.get_json_object("response_body", p)
    return r.select(
        "request_id", g("$.choices[0].message.content").alias("content"), g("$.choices[0].message.tool_calls[0].function.name").alias("call_name")
    )


@query("redact_messages", f"SELECT conv_id, turn, role, {duck_mask('text')} AS text FROM conversations")
def _(t: Tables):
    return R.redact_messages(t.conversations)


@query(
    "redact_headers",
    "SELECT event_id, '[REDACTED]' AS authorization, '[REDACTED]' AS api_key, event_type AS kind FROM events",
)
def _(t: Tables):
    h = t.events.selectExpr("event_id", "map('Authorization', concat('Bearer ', user_id), 'x-api-key', CAST(user_id AS STRING), 'x-kind', event_type) AS headers")
    r = R.redact_headers(h)
    pick = lambda k: F.try_element_at("headers", F.lit(k))
    return r.select("event_id", pick("Authorization").alias("authorization"), pick("x-api-key").alias("api_key"), pick("x-kind").alias("kind"))


@query(
    "trim_base64_images",
    """SELECT doc_id, CASE WHEN strlen(text) + 23 > 2000 AND doc_id % 2 = 0 THEN '__REDACTED__' WHEN doc_id % 2 = 0 THEN concat('data:image/png;base64,', 'x', text) ELSE concat('https://x/', text) END AS url
  FROM documents""",
)
def _(t: Tables):
    d = t.documents.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN concat('data:image/png;base64,', 'x', text) ELSE concat('https://x/', text) END AS url")
    return R.trim_base64_images(d, max_length=2000)


@query("shadow_sample", FILT + f"SELECT call_id, {SAMPLED} AS sampled FROM filter_calls")
def _(t: Tables):
    return R.shadow_sample(t.filter_calls).select("call_id", "sampled")


@query("filter_status", FILT + f"SELECT call_id, {STATUS_SQL} AS status FROM filter_calls")
def _(t: Tables):
    return R.filter_status(status_input(t)).select("call_id", "status")


@query("shadow_verdict", FILT + f"SELECT call_id, {ACTION_SQL} AS action FROM filter_calls")
def _(t: Tables):
    return R.shadow_verdict(status_input(t)).select("call_id", "action")


def length_policy(pdf: pd.DataFrame) -> pd.DataFrame:
    """A sample policy: reject toxic documents, mask digits of long ones, pass the rest."""
    long = pdf["n_chars"] > 1500
    toxic = pdf["toxic"] == 1
    action = pd.Series("pass", index=pdf.index).mask(long, "redact").mask(toxic, "reject").mask(pdf["doc_id"] % 31 == 0, "explode")
    return pd.DataFrame(
        {"action": action, "body": pdf["body"].str.replace("e", "*", regex=False).where(long), "reason": action.where(action != "pass")}
    )


@query(
    "run_content_filter",
    """WITH d AS (SELECT d.doc_id, d.text, d.n_chars > 1500 AS long, coalesce(l.toxic, 0) = 1 AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  s AS (SELECT *, CASE WHEN doc_id % 31 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'unavailable' ELSE 'failed-open' END WHEN toxic THEN 'reject'
                       WHEN long AND replace(text, 'e', '*') <> text THEN 'redact' ELSE 'pass' END AS status FROM d)
  SELECT doc_id, status, CASE status WHEN 'redact' THEN sha256(replace(text, 'e', '*')) WHEN 'reject' THEN NULL WHEN 'unavailable' THEN NULL ELSE sha256(text) END AS body_hash FROM s""",
)
def _(t: Tables):
    labels = t.labels.select("doc_id", "toxic")
    d = t.documents.join(labels, "doc_id", "left").selectExpr(
        "doc_id", "text AS body", "n_chars", "coalesce(toxic, 0) AS toxic", "true AS configured", "false AS global_disable", "true AS enabled",
        "'Enforce' AS mode", "0 AS sample_permille", "CASE WHEN doc_id % 2 = 0 THEN 'Fail' END AS failure_policy",
    )
    return R.run_content_filter(d, length_policy, id_col="doc_id").select("doc_id", "status", F.sha2("new_body", 256).alias("body_hash"))


@query(
    "build_audit_events",
    FILT
    + f"""SELECT call_id, action AS outcome, true AS fail_open, route, backend, 'content_filter:shadow' AS pii_context,
   CASE WHEN action = 'shadow_would_reject' THEN 'policy' END AS reason, CAST(CASE WHEN action = 'shadow_would_reject' THEN 1 END AS BIGINT) AS n
  FROM (SELECT *, {ACTION_SQL} AS action FROM filter_calls) WHERE action IS NOT NULL""",
)
def _(t: Tables):
    d = R.shadow_verdict(status_input(t)).withColumns(
        {
            "tool": F.lit("t"), "input_chars": F.col("call_id") % 100, "output_chars": F.lit(0),
            "reason": F.when(F.col("action") == "shadow_would_reject", "policy"),
        }
    )
    return R.build_audit_events(d).select(
        "call_id", "outcome", "fail_open", "route", "backend", "pii_context",
        F.try_element_at(F.map_keys("stats"), F.lit(1)).alias("reason"), F.try_element_at(F.map_values("stats"), F.lit(1)).alias("n"),
    )
