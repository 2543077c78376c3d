"""Metric tables: explicit-bucket histograms, counters, gauges, label guards, audit rollups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_index, content_hash, exploded
from ..plans.running import HOT_ROWS, prior_totals
from .parse import capability_flags, mcp_error_label
from .usage import TOKEN_TYPES

# Histogram bounds.
TOKEN_BOUNDS = [4**i for i in range(14)]
DURATION_BOUNDS = [0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64, 1.28, 2.56, 5.12, 10.24, 20.48, 40.96, 81.92]
TTFT_BOUNDS = [
    0.001, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0,
]
TPOT_BOUNDS = [0.01, 0.025, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 2.5]
MCP_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]

# Requests and notifications a server may send to a client.
SERVER_TO_CLIENT_METHODS = [
    "notifications/prompts/list_changed",
    "notifications/resources/list_changed",
    "notifications/resources/updated",
    "notifications/progress",
    "notifications/message",
    "notifications/tools/list_changed",
    "roots/list",
    "sampling/createMessage",
    "elicitation/create",
]
PROGRESS_METHOD = "notifications/progress"

# Labels used when there is nothing better to report.
ERROR_OTHER = "_OTHER"
EMPTY_LABEL = "-"
OVERFLOW_LABEL = "_overflow_"

REQUEST_ATTRS = ["operation", "provider", "original_model", "request_model", "response_model"]


def histogram(df: DataFrame, by: Sequence[str], value: str | Column, bounds: Sequence[float]) -> DataFrame:
    """``count, sum, bucket_counts`` per attribute set; everything combines before the shuffle."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("_v"), bucket_index(v, bounds).alias("_i")).where("_v IS NOT NULL")
    counts = [F.count(F.when(F.col("_i") == i, 1)) for i in range(len(bounds) + 1)]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.sum("_v").alias("sum"), F.array(*counts).alias("bucket_counts")
    )


def hist_token_usage(usage: DataFrame, attrs: Sequence[str] = REQUEST_ATTRS, success: str = "success") -> DataFrame:
    """Token usage of successful requests by attributes and token type; unset counters record nothing."""
    wide = usage.where(F.col(success)).select(
        *attrs, *[F.col(c).cast("double").alias(t) for c, t in TOKEN_TYPES.items()]
    )
    long = wide.unpivot(list(attrs), list(TOKEN_TYPES.values()), "token_type", "value")
    return histogram(long, [*attrs, "token_type"], "value", TOKEN_BOUNDS)


def hist_request_duration(
    df: DataFrame, attrs: Sequence[str] = REQUEST_ATTRS, seconds: str | Column = "duration_s", success: str = "success"
) -> DataFrame:
    """Request duration; failures carry ``error_type`` ``_OTHER``, successes none."""
    v = F.col(seconds) if isinstance(seconds, str) else seconds
    rows = df.withColumn("_s", v).withColumn("error_type", F.when(~F.col(success), F.lit(ERROR_OTHER)))
    return histogram(rows, [*attrs, "error_type"], "_s", DURATION_BOUNDS)


def hist_ttft(latency: DataFrame, attrs: Sequence[str] = REQUEST_ATTRS) -> DataFrame:
    return histogram(latency, attrs, "ttft_s", TTFT_BOUNDS)


def hist_tpot(latency: DataFrame, attrs: Sequence[str] = REQUEST_ATTRS) -> DataFrame:
    return histogram(latency, attrs, "tpot_s", TPOT_BOUNDS)


def hist_mcp_duration(calls: DataFrame, seconds: str | Column = "duration_s", backend: str = "backend") -> DataFrame:
    """MCP request duration by backend and error label (also fits initialization durations)."""
    v = F.col(seconds) if isinstance(seconds, str) else seconds
    rows = calls.withColumn("_s", v).withColumn("error_type", mcp_error_label(F.col("error_code")))
    return histogram(rows, [backend, "error_type"], "_s", MCP_BOUNDS)


def mcp_method_count(calls: DataFrame, method: str = "method", backend: str = "backend") -> DataFrame:
    """Calls by method, status and backend: ``error`` beats ``failed`` (tool said isError) beats success."""
    status = (
        F.when(F.col("error_code").isNotNull(), "error").when(F.col("is_error"), "failed").otherwise("success")
    )
    named = calls.where(F.coalesce(F.col(method), F.lit("")) != "")
    return named.groupBy(method, status.alias("status"), backend).agg(F.count(F.lit(1)).alias("count"))


def mcp_capability_count(sessions: DataFrame, capabilities: str = "capabilities", side: str = "side") -> DataFrame:
    """Negotiated capabilities by type and side, from the capabilities JSON of either side."""
    c = F.from_json(
        F.col(capabilities),
        "experimental map<string,string>, roots struct<listChanged: boolean>, sampling string, elicitation string, "
        "completions string, logging string, prompts string, resources string, tools string",
    )
    tmp = sessions.select(F.col(side).alias("side"), c.alias("_c"))

    def given(name: str) -> Column:
        return F.when(F.col(f"_c.{name}").isNotNull(), 1)

    def experimental() -> Column:
        return F.struct(F.lit("experimental").alias("type"), F.coalesce(F.size(F.col("_c.experimental")), F.lit(0)).alias("n"))

    def one(name: str, n: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), F.coalesce(n, F.lit(0)).alias("n"))

    client = F.array(
        experimental(), one("roots", F.when(F.col("_c.roots.listChanged"), 1)),
        one("sampling", given("sampling")), one("elicitation", given("elicitation")),
    )
    server = F.array(
        experimental(), *[one(n, given(n)) for n in ("completions", "logging", "prompts", "resources", "tools")]
    )
    rows = exploded(tmp, ["side"], F.when(F.col("side") == "client", client).otherwise(server), "_i", "_t")
    return (
        rows.select("side", F.col("_t.type").alias("type"), F.col("_t.n").alias("_n"))
        .where("_n > 0").groupBy("type", "side").agg(F.sum("_n").alias("count"))
    )


def mcp_progress_count(messages: DataFrame, by: Sequence[str] = ("backend",), method: str = "method") -> DataFrame:
    return messages.where(F.col(method) == PROGRESS_METHOD).groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def unsupported_server_methods(messages: DataFrame, method: str = "method") -> DataFrame:
    """Server-to-client methods with their status: unknown ones count as errors."""
    known = F.col(method).isin(*SERVER_TO_CLIENT_METHODS)
    return messages.where(F.col(method).isNotNull()).groupBy(
        method, F.when(known, "success").otherwise("error").alias("status")
    ).agg(F.count(F.lit(1)).alias("count"))


def _label(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(EMPTY_LABEL)).alias(name)


def filter_decision_count(decisions: DataFrame, by: Sequence[str] = ("route", "backend", "scope", "action")) -> DataFrame:
    """Decisions by label set; empty labels read ``-``."""
    return decisions.groupBy(*[_label(b) for b in by]).agg(F.count(F.lit(1)).alias("count"))


def filter_status_count(statuses: DataFrame, by: Sequence[str] = ("route", "backend", "status")) -> DataFrame:
    return filter_decision_count(statuses, by)


def inflight_gauge(
    calls: DataFrame, by: Sequence[str], start_us: str, end_us: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Calls in flight after each instant a call starts or ends.

    Starts and ends at the same instant are netted before the running total, so no order among them
    matters; the running total splits hot label sets (see ``prior_totals``).
    """
    moves = calls.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col(start_us).alias("at_us"), F.lit(1).cast("bigint").alias("delta")),
                F.struct(F.col(end_us).alias("at_us"), F.lit(-1).cast("bigint").alias("delta")),
            )
        ).alias("_m"),
    ).select(*by, "_m.*")
    net = moves.groupBy(*by, "at_us").agg(F.sum("delta").alias("delta"))
    run = prior_totals(net, list(by), "at_us", [], {"_before": "delta"}, hot_rows)
    return run.select(*by, "at_us", (F.col("_before") + F.col("delta")).alias("inflight"))


def cardinality_guard(df: DataFrame, labels: Sequence[str], order: str, cap: int) -> DataFrame:
    """Replace label sets past the first ``cap`` (by first appearance) with the overflow label.

    Ordering runs over distinct label sets, not rows; equal first appearances are ordered by the labels. The admitted
    sets are at most ``cap``; Spark broadcasts them when their size allows it.
    """
    cap = max(cap, 1)
    admitted = (
        df.groupBy(*labels).agg(F.min(order).alias("_first")).orderBy("_first", *labels).limit(cap)
        .select(*[F.col(x).alias(f"_a_{x}") for x in labels], F.lit(True).alias("_ok"))
    )
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_a_{x}")) for x in labels])
    joined = df.join(admitted, same, "left")
    over = F.col("_ok").isNull()
    guarded = {x: F.when(over, F.lit(OVERFLOW_LABEL)).otherwise(F.col(x)) for x in labels}
    return joined.withColumn("_over", over).withColumns(guarded).select(*df.columns, F.col("_over").alias("overflowed"))


def metric_temporality(
    df: DataFrame, by: Sequence[str], at_us: str, value: str, interval_us: int, temporality: str = "delta"
) -> DataFrame:
    """Counter points per interval: ``delta`` per interval or ``cumulative`` running totals.

    The running total goes over interval sums, never over rows.
    """
    if temporality not in ("delta", "cumulative"):
        raise ValueError(f"unknown temporality {temporality!r}")
    start = (F.floor(F.col(at_us) / interval_us) * interval_us).cast("bigint").alias("interval_us")
    deltas = df.groupBy(*by, start).agg(F.sum(value).alias("value"))
    if temporality == "delta":
        return deltas
    run = prior_totals(deltas, list(by), "interval_us", [], {"_before": "value"})
    return run.select(*by, "interval_us", (F.col("_before") + F.col("value")).alias("value"))


def audit_rollup(audit: DataFrame, by: Sequence[str] = ("route", "outcome"), stats: str = "stats") -> DataFrame:
    """Redactions per category, with the events that really scrubbed against those that fell open."""
    rows = audit.select(*by, "fail_open", F.explode(stats).alias("category", "_n"))
    return rows.groupBy(*by, "category").agg(
        F.sum("_n").alias("redactions"),
        F.count(F.when(~F.col("fail_open"), 1)).alias("scrubbed_events"),
        F.count(F.when(F.col("fail_open"), 1)).alias("fail_open_events"),
    )


def silent_routes(routes: DataFrame, audit: DataFrame, at_us: str, hours: float, now_us: int | None = None) -> DataFrame:
    """Routes without an audit event in the trailing hours before ``now_us``, or before the latest event.

    One aggregation gives each route's last event; the latest of all is their maximum.
    """
    events = audit if now_us is None else audit.where(F.col(at_us) <= now_us)
    last = events.groupBy("route").agg(F.max(at_us).alias("_last"))
    now = last.agg(F.max("_last").alias("_now")) if now_us is None else audit.sparkSession.range(1).select(F.lit(now_us).alias("_now"))
    recent = last.join(F.broadcast(now), F.col("_last") > F.col("_now") - int(hours * 3_600_000_000))  # one row
    return routes.join(recent.select("route"), "route", "left_anti")


def shadow_vs_enforce(calls: DataFrame, by: Sequence[str] = ("route",)) -> DataFrame:
    """Redact and reject rates of shadow decisions next to enforced ones, with body sizes."""
    shadow = F.col("mode") == "Shadow"
    redact, reject = F.col("outcome") == "redact", F.col("outcome") == "reject"

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    aggs = []
    for name, cond in (("shadow", shadow), ("enforce", ~shadow)):
        aggs += [
            n(cond).alias(f"{name}_calls"),
            F.try_divide(n(cond & redact), n(cond)).alias(f"{name}_redact_rate"),
            F.try_divide(n(cond & reject), n(cond)).alias(f"{name}_reject_rate"),
            F.sum(F.when(cond, F.col("input_chars"))).alias(f"{name}_input_chars"),
            F.sum(F.when(cond, F.col("output_chars"))).alias(f"{name}_output_chars"),
        ]
    return calls.groupBy(*by).agg(*aggs)


def content_duplicates(df: DataFrame, text: str, at: str) -> DataFrame:
    """Contents seen more than once, by hash: how often, first and last time."""
    return (
        df.groupBy(content_hash(text).alias("content_hash"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
        .where("count > 1")
    )


def prompt_cache_efficiency(usage: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Cached and cache-writing tokens against all input tokens."""
    return usage.groupBy(*by).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("cached_input_tokens").alias("cached_input_tokens"),
        F.sum("cache_creation_input_tokens").alias("cache_creation_input_tokens"),
        F.try_divide(F.sum("cached_input_tokens"), F.sum("input_tokens")).alias("cached_share"),
    )


def session_usage(usage: DataFrame, session: str = "session_id") -> DataFrame:
    return usage.where(F.col(session).isNotNull()).groupBy(session).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def merge_capabilities(sessions: DataFrame, keys: Sequence[str], bits: str = "caps") -> DataFrame:
    """Capabilities of a session: any backend's capability counts."""
    merged = sessions.groupBy(*keys).agg(F.bit_or(F.col(bits)).alias("caps"))
    return merged.withColumns(capability_flags(F.col("caps")))
