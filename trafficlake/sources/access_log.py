"""Access-log JSON lines as typed tables, in batch and as a file-landing stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Log keys, the column each becomes, and its type.
COMMON_FIELDS = [
    ("start_time", "start_time", "timestamp"),
    ("method", "http_method", "string"),
    ("request.path", "request_path", "string"),
    ("x-envoy-origin-path", "origin_path", "string"),
    ("protocol", "protocol", "string"),
    ("response_code", "response_code", "int"),
    ("response_flags", "response_flags", "string"),
    ("response_code_details", "response_code_details", "string"),
    ("connection_termination_details", "connection_termination_details", "string"),
    ("upstream_transport_failure_reason", "upstream_transport_failure_reason", "string"),
    ("bytes_received", "bytes_received", "bigint"),
    ("bytes_sent", "bytes_sent", "bigint"),
    ("duration", "duration_ms", "bigint"),
    ("x-envoy-upstream-service-time", "upstream_service_ms", "bigint"),
    ("x-forwarded-for", "forwarded_for", "string"),
    ("user-agent", "user_agent", "string"),
    ("x-request-id", "request_id", "string"),
    (":authority", "authority", "string"),
    ("upstream_host", "upstream_host", "string"),
    ("upstream_cluster", "upstream_cluster", "string"),
    ("upstream_local_address", "upstream_local_address", "string"),
    ("downstream_local_address", "downstream_local_address", "string"),
    ("downstream_remote_address", "downstream_remote_address", "string"),
    ("requested_server_name", "requested_server_name", "string"),
    ("route_name", "route_name", "string"),
]
LLM_FIELDS = [
    ("gen_ai.request.model", "request_model", "string"),
    ("gen_ai.response.model", "response_model", "string"),
    ("gen_ai.request.model_override", "model_override", "string"),
    ("gen_ai.provider.name", "backend_ref", "string"),
    ("gen_ai.usage.input_tokens", "input_tokens", "bigint"),
    ("gen_ai.usage.output_tokens", "output_tokens", "bigint"),
    ("gen_ai.usage.total_tokens", "total_tokens", "bigint"),
    ("session.id", "session_id", "string"),
]
MCP_FIELDS = [
    ("jsonrpc.request.id", "jsonrpc_id", "string"),
    ("mcp.session.id", "mcp_session_id", "string"),
    ("mcp.method.name", "mcp_method", "string"),
    ("mcp.provider.name", "mcp_backend", "string"),
]
# Fixed value: what the log writes for an unset field.
UNSET = "-"

Fields = list[tuple[str, str, str]]


def raw_schema(fields: Fields) -> T.StructType:
    """Every field is read as text first: loggers write numbers, numeric text, ``-`` or null."""
    return T.StructType([T.StructField(key, T.StringType()) for key, _, _ in fields])


def _typed(key: str, name: str, kind: str) -> Column:
    text = F.nullif(F.col(f"`{key}`"), F.lit(UNSET))
    return (text if kind == "string" else text.try_cast(kind)).alias(name)


def typed(raw: DataFrame, fields: Fields) -> DataFrame:
    return raw.select(*[_typed(*f) for f in fields])


def _extra(fields: Fields, extra: dict[str, str] | None) -> Fields:
    return fields + [(k, v, "string") for k, v in (extra or {}).items()]


def read_access_log(spark: SparkSession, path: str | list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """LLM access log. ``extra`` maps further log keys (header attributes) to column names."""
    fields = _extra(LLM_FIELDS + COMMON_FIELDS, extra)
    return typed(spark.read.schema(raw_schema(fields)).json(path), fields)


def read_mcp_access_log(spark: SparkSession, path: str | list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """MCP access log."""
    fields = _extra(MCP_FIELDS + COMMON_FIELDS, extra)
    return typed(spark.read.schema(raw_schema(fields)).json(path), fields)


def stream_access_log(
    spark: SparkSession, folder: str, extra: dict[str, str] | None = None, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The LLM access log as a stream of landing files."""
    fields = _extra(LLM_FIELDS + COMMON_FIELDS, extra)
    reader = spark.readStream.schema(raw_schema(fields))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed(reader.json(folder), fields)
