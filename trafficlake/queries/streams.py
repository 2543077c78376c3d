"""Streams over the tables: a file stream runs to its end into a written table, which is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import VIEWS, Tables, with_views
from ..operators.cost import expression_cost, validate_cost_expression
from ..session import scratch_path
from ..streaming import traffic as S
from . import query

REQ = with_views("llm_requests")
CHUNKS = with_views("sse_chunks")
FILT = with_views("filter_calls")


def request_stream(t: Tables) -> DataFrame:
    """The request log as a stream with a TIMESTAMP event time."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    return t.sql(VIEWS["llm_requests"], events=events).withColumn("at", F.timestamp_micros("start_us"))


def run_to_table(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    out = scratch_path(t.spark, label)
    q = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(t.spark, "cp")).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


HOUR = 3_600_000_000


@query(
    "stream_usage",
    REQ
    + f""", m AS (SELECT max(start_us) // 1000 * 1000 - 600000000 AS wm FROM llm_requests),
  w AS (SELECT CAST(floor(start_us / {HOUR}) AS BIGINT) * {HOUR} AS window_us, tenant, original_model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, count(*) AS requests FROM llm_requests GROUP BY 1, 2, 3)
  SELECT w.* FROM w, m WHERE window_us + {HOUR} <= wm""",
)
def _(t: Tables):
    s = S.stream_usage(request_stream(t), "at", ["tenant", "original_model"], ["input_tokens"])
    return run_to_table(t, s, "stream-usage").select(F.unix_micros("window_start").alias("window_us"), "tenant", "original_model", "input_tokens", "requests")


@query(
    "stream_rate_limit",
    REQ
    + """, w AS (SELECT *, CAST(floor(start_us / 86400000000) AS BIGINT) * 86400000000 AS window_us FROM llm_requests)
  SELECT request_id, CAST(coalesce(sum(input_tokens) OVER p, 0) AS BIGINT) AS used, coalesce(sum(input_tokens) OVER p, 0) >= 30 AS refused FROM w
  WINDOW p AS (PARTITION BY tenant, window_us ORDER BY start_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(t: Tables):
    s = S.stream_rate_limit(request_stream(t), ["tenant"], "at", "input_tokens", 30, "Day")
    return run_to_table(t, s, "stream-limit").select("request_id", "used", "refused")


@query(
    "stream_latency_state",
    CHUNKS
    + """, s AS (SELECT request_id, min(recv_ms) / 1000.0 AS ttft, max(recv_ms) FILTER (WHERE seq > 0 AND end_of_stream) / 1000.0 AS e, max(output_tokens) FILTER (WHERE seq > 0) AS k FROM sse_chunks GROUP BY 1)
  SELECT request_id, round(CAST(ttft AS DOUBLE), 12) AS ttft_s, round(CASE WHEN k > 1 THEN (CAST(e AS DOUBLE) - CAST(ttft AS DOUBLE)) / (k - 1) END, 12) AS tpot_s FROM s""",
)
def _(t: Tables):
    requests = request_stream(t)
    chunks = requests.where("stream").selectExpr(
        "request_id", "at", "duration_ms", "output_tokens AS final_tokens", "explode(sequence(0, CAST(request_id % 5 AS INT))) AS seq"
    ).selectExpr(
        "request_id", "at", "seq", "(seq + 1) * CAST(floor(duration_ms / 10) AS BIGINT) AS recv_ms", "seq = request_id % 5 AS end_of_stream",
        "CASE WHEN seq = request_id % 5 THEN final_tokens WHEN seq % 2 = 1 THEN seq END AS output_tokens",
    )
    out = run_to_table(t, S.stream_latency_state(chunks, "at"), "stream-latency")
    return out.select("request_id", F.round("ttft_s", 12).alias("ttft_s"), F.round("tpot_s", 12).alias("tpot_s"))


@query(
    "stream_session_usage",
    REQ
    + """, g AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER (PARTITION BY session_id ORDER BY start_us) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM llm_requests),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start_us) AS n FROM g),
  s AS (SELECT session_id, min(start_us) AS start_us, max(start_us) + 1800000000 AS end_us, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, count(*) AS requests FROM i GROUP BY session_id, n)
  SELECT * FROM s WHERE end_us <= (SELECT max(start_us) // 1000 * 1000 - 600000000 FROM llm_requests)""",
)
def _(t: Tables):
    s = S.stream_session_usage(request_stream(t), "at", "session_id", ["input_tokens"])
    return run_to_table(t, s, "stream-sessions").select(
        "session_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "input_tokens", "requests"
    )


@query("dedupe_attempts", REQ + "SELECT request_id, tenant FROM llm_requests")
def _(t: Tables):
    attempts = request_stream(t).selectExpr("request_id", "tenant", "at", "explode(sequence(1, 1 + CAST(request_id % 3 AS INT))) AS attempt")
    return run_to_table(t, S.dedupe_attempts(attempts, "at"), "stream-dedupe").select("request_id", "tenant")


@query("stream_with_live_config", REQ + "SELECT request_id, input_tokens * 2 AS cost FROM llm_requests")
def _(t: Tables):
    out = scratch_path(t.spark, "live-config")
    conf = S.cost_expression_config(t.spark, lambda: "input_tokens * 2")
    q = (
        S.stream_with_live_config(
            request_stream(t).select("request_id", "input_tokens"), conf,
            lambda batch, expr: expression_cost(batch, expr).select("request_id", "cost"),
            lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"),
        ).option("checkpointLocation", scratch_path(t.spark, "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema("request_id bigint, cost bigint").parquet(out).select("request_id", "cost")


CONFIGS = """SELECT version, lo + (hi - lo) * part DIV 4 AS effective_us, value FROM (SELECT min(start_us) AS lo, max(start_us) AS hi FROM {r}),
  (VALUES (1, 1, 'input_tokens * 2'), (2, 2, 'input_tokens +'), (3, 3, 'input_tokens + 100'), (4, 3, 'no_such_counter')) AS v(version, part, value)"""


@query(
    "stream_with_versions",
    REQ
    + """, m AS (SELECT min(start_us) AS lo, max(start_us) AS hi FROM llm_requests)
  SELECT request_id, CASE WHEN start_us >= lo + (hi - lo) * 3 // 4 THEN input_tokens + 100 ELSE input_tokens * 2 END AS cost,
    CAST(CASE WHEN start_us >= lo + (hi - lo) * 3 // 4 THEN 3 ELSE 1 END AS BIGINT) AS config_version
  FROM llm_requests, m WHERE start_us >= lo + (hi - lo) // 4""",
)
def _(t: Tables):
    out = scratch_path(t.spark, "versions")
    conf = S.VersionedConfig(lambda: t.sql(CONFIGS, r=t.llm_requests), lambda expr: validate_cost_expression(t.spark, expr))
    requests = request_stream(t).select("request_id", "start_us", "input_tokens")
    q = S.stream_with_versions(requests, conf, "start_us", expression_cost, out)
    q.option("checkpointLocation", scratch_path(t.spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("request_id bigint, cost bigint, config_version bigint").parquet(out).select("request_id", "cost", "config_version")


@query(
    "stream_inflight",
    FILT
    + """, m AS (SELECT route, start_us AS at_us, 1 AS d FROM filter_calls UNION ALL SELECT route, start_us + duration_ms * 60000000, -1 FROM filter_calls),
   n AS (SELECT route, at_us, sum(d) AS d FROM m GROUP BY 1, 2), w AS (SELECT max(at_us) // 1000 * 1000 - 600000000 AS wm FROM m),
   g AS (SELECT route, at_us, CAST(sum(d) OVER (PARTITION BY route ORDER BY at_us) AS BIGINT) AS inflight FROM n)
   SELECT g.* FROM g, w WHERE at_us <= wm""",
)
def _(t: Tables):
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    calls = t.sql(VIEWS["filter_calls"], events=events)
    moves = calls.selectExpr(
        "route", "explode(array(named_struct('at_us', start_us, 'delta', 1L), named_struct('at_us', start_us + duration_ms * 60000000, 'delta', -1L))) AS m"
    ).select("route", "m.*")
    return run_to_table(t, S.stream_inflight(moves, ["route"]), "stream-inflight")
