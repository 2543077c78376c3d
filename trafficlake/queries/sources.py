"""Sources and sinks: logs and batch files are written by Spark from the tables, then read back."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import Tables, with_views
from ..operators.filtering import shadow_verdict, build_audit_events
from ..session import scratch_path
from ..sources.access_log import read_access_log, read_mcp_access_log, stream_access_log
from ..sources.batch import read_batch_input, read_batch_output
from ..sources.bodies import concat_body_chunks, decode_bodies
from ..sources.sinks import export_nonempty, write_audit_events
from . import query
from .filtering import ACTION_SQL, FILT, status_input
from .routing import BATCH_IN, BATCH_OUT

REQ = with_views("llm_requests")
MCP = with_views("mcp_calls")

LOG_LINES = """SELECT to_json(named_struct('gen_ai.request.model', original_model, 'gen_ai.response.model', coalesce(model_override, original_model),
    'gen_ai.provider.name', concat('default/b', request_id % 4, '/route/r/rule/0/ref/0'),
    'gen_ai.usage.input_tokens', CASE WHEN request_id % 3 = 0 THEN '-' ELSE CAST(input_tokens AS STRING) END, 'gen_ai.usage.output_tokens', output_tokens,
    'session.id', CASE WHEN request_id % 5 = 0 THEN '-' ELSE session_id END, 'start_time', date_format(start_ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    'response_code', status, 'duration', duration_ms, 'x-envoy-upstream-service-time', CAST(duration_ms AS STRING), 'x-request-id', CAST(request_id AS STRING),
    'response_flags', '-', ':authority', 'api.example'), map('ignoreNullFields', 'false')) AS value FROM {r}"""


def write_lines(t: Tables, lines, label: str) -> str:
    path = scratch_path(t.spark, label)
    lines.write.text(path)
    return path


_LOG_EXPECTED = """SELECT CAST(request_id AS STRING) AS request_id, original_model AS request_model, coalesce(model_override, original_model) AS response_model,
  CASE WHEN request_id % 3 <> 0 THEN input_tokens END AS input_tokens, output_tokens, CASE WHEN request_id % 5 <> 0 THEN session_id END AS session_id,
  start_us, status AS response_code, duration_ms AS upstream_service_ms, CAST(NULL AS STRING) AS response_flags FROM llm_requests"""
_LOG_COLS = ["request_id", "request_model", "response_model", "input_tokens", "output_tokens", "session_id", "response_code", "upstream_service_ms", "response_flags"]


@query("read_access_log", REQ + _LOG_EXPECTED)
def _(t: Tables):
    log = read_access_log(t.spark, write_lines(t, t.sql(LOG_LINES, r=t.llm_requests), "access-log"))
    return log.select(*_LOG_COLS, F.unix_micros("start_time").alias("start_us"))


@query("stream_access_log", REQ + _LOG_EXPECTED.replace("start_us, ", ""))
def _(t: Tables):
    path = write_lines(t, t.sql(LOG_LINES, r=t.llm_requests), "access-log-stream")
    out = scratch_path(t.spark, "access-log-table")
    q = (
        stream_access_log(t.spark, path).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(t.spark, "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.parquet(out).select(*_LOG_COLS)


@query(
    "read_mcp_access_log",
    MCP
    + """SELECT CAST(call_id AS STRING) AS jsonrpc_id, CASE WHEN call_id % 4 <> 0 THEN route END AS mcp_session_id, 'tools/call' AS mcp_method, duration_ms FROM mcp_calls""",
)
def _(t: Tables):
    lines = t.sql(
        """SELECT to_json(named_struct('jsonrpc.request.id', call_id, 'mcp.session.id', CASE WHEN call_id % 4 = 0 THEN '-' ELSE route END,
             'mcp.method.name', 'tools/call', 'duration', CAST(duration_ms AS STRING))) AS value FROM {m}""",
        m=t.mcp_calls,
    )
    log = read_mcp_access_log(t.spark, write_lines(t, lines, "mcp-log"))
    return log.select("jsonrpc_id", "mcp_session_id", "mcp_method", "duration_ms")


@F.pandas_udf(T.BinaryType())
def _gzip(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: gzip.compress(b.encode(), mtime=0))


@query(
    "decode_bodies",
    """SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE sha256(text) END AS text_hash,
  CASE doc_id % 5 WHEN 2 THEN 'unsupported_encoding' WHEN 3 THEN 'truncated_gzip' END AS decode_error FROM documents""",
)
def _(t: Tables):
    whole = t.documents.withColumn("gz", _gzip("text")).selectExpr(
        "doc_id", "CASE doc_id % 5 WHEN 0 THEN 'identity' WHEN 2 THEN 'br' ELSE 'gzip' END AS content_encoding",
        "CASE doc_id % 5 WHEN 0 THEN CAST(text AS BINARY) WHEN 3 THEN substring(gz, 1, octet_length(gz) - 6) ELSE gz END AS bytes",
    )
    chunks = whole.selectExpr(
        "doc_id", "content_encoding", "explode(sequence(0, CAST(octet_length(bytes) DIV 500 AS INT))) AS seq", "bytes"
    ).selectExpr("doc_id", "content_encoding", "seq", "substring(bytes, seq * 500 + 1, 500) AS body")
    bodies = concat_body_chunks(chunks, ["doc_id", "content_encoding"])
    return decode_bodies(bodies).select("doc_id", F.sha2("text", 256).alias("text_hash"), "decode_error")


@query(
    "read_batch_input",
    REQ + "SELECT concat('item-', CAST(request_id AS STRING)) AS custom_id, '/v1/chat/completions' AS url, original_model AS model, output_tokens AS max_tokens FROM llm_requests",
)
def _(t: Tables):
    b = read_batch_input(t.spark, write_lines(t, t.sql(BATCH_IN, r=t.llm_requests), "batch-in"))
    g = lambda p: F.get_json_object("body", p)
    return b.select("custom_id", "url", g("$.model").alias("model"), g("$.max_tokens").cast("bigint").alias("max_tokens"))


@query(
    "read_batch_output",
    REQ
    + """SELECT concat('item-', CAST(request_id AS STRING)) AS custom_id, CASE WHEN success THEN status END AS status_code, CASE WHEN success THEN input_tokens END AS prompt_tokens,
  CASE WHEN NOT success THEN concat('status ', CAST(status AS STRING)) END AS error FROM llm_requests WHERE request_id % 6 <> 0""",
)
def _(t: Tables):
    b = read_batch_output(t.spark, write_lines(t, t.sql(BATCH_OUT, r=t.llm_requests), "batch-out"))
    return b.select(
        "custom_id", "status_code", F.get_json_object("body", "$.usage.prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.get_json_object("error", "$.message").alias("error"),
    )


@query(
    "write_audit_events",
    FILT
    + f"""SELECT concat('{{"timestamp":', CAST(start_us AS STRING), ',"outcome":"', action, '","fail_open":true,"route":"', route, '","backend":"', backend,
    '","tool":"t","pii_context":"content_filter:shadow","input_chars":', CAST(call_id % 100 AS STRING), ',"output_chars":0,"elapsed":', CAST(duration_ms * 1000 AS STRING),
    CASE WHEN action = 'shadow_would_reject' THEN ',"stats":{{"policy":1}}' ELSE '' END, '}}') AS value
  FROM (SELECT *, {ACTION_SQL} AS action FROM filter_calls) WHERE action IS NOT NULL""",
)
def _(t: Tables):
    d = shadow_verdict(status_input(t)).withColumns(
        {
            "tool": F.lit("t"), "input_chars": F.col("call_id") % 100, "output_chars": F.lit(0),
            "reason": F.when(F.col("action") == "shadow_would_reject", "policy"),
        }
    )
    elapsed = t.filter_calls.select("call_id", (F.col("duration_ms") * 1000).alias("elapsed"))
    audit = build_audit_events(d).join(elapsed, "call_id").withColumn("timestamp", F.col("start_us"))
    path = scratch_path(t.spark, "audit")
    write_audit_events(audit, path)
    return t.spark.read.text(path)


@query(
    "export_nonempty",
    REQ + "SELECT tenant, count(*) AS n FROM llm_requests WHERE NOT success GROUP BY 1",
)
def _(t: Tables):
    path = write_lines(t, t.llm_requests.selectExpr("to_json(struct(tenant, success)) AS value"), "export-in")
    out = scratch_path(t.spark, "export-out")
    stream = t.spark.readStream.schema("tenant string, success boolean").json(path).where("NOT success")
    q = (
        export_nonempty(stream, lambda batch, _id: batch.write.mode("append").parquet(out))
        .option("checkpointLocation", scratch_path(t.spark, "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema("tenant string, success boolean").parquet(out).groupBy("tenant").agg(F.count("*").alias("n"))
