"""Projection and parsing operators over requests, responses, MCP messages and configuration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    base64_bytes,
    base64url_text,
    computed_once,
    exploded,
    json_object_ok,
    json_text,
    let,
    map_case,
    non_empty,
    parse_struct,
)
from .config import endpoint_paths, parse_header_mapping

# Separators in composed tool names and resource URIs.
TOOL_SEPARATOR = "__"
URI_SEPARATOR = "+"

# Provider label per backend API schema.
PROVIDERS = {
    "OpenAI": "openai",
    "AzureOpenAI": "azure.openai",
    "AWSBedrock": "aws.bedrock",
    "AWSAnthropic": "aws.anthropic",
    "GCPVertexAI": "gcp.vertex_ai",
    "GCPAnthropic": "gcp.anthropic",
    "Anthropic": "anthropic",
    "Cohere": "cohere",
}

# Capability bits, lowest bit first.
CAPABILITY_BITS = [
    "tools",
    "tools_list_changed",
    "prompts",
    "prompts_list_changed",
    "logging",
    "resources",
    "resources_list_changed",
    "resources_subscribe",
    "completions",
]
ALL_CAPABILITIES = (1 << len(CAPABILITY_BITS)) - 1

# Finish reasons of each provider in chat-completion terms, and the way back.
ANTHROPIC_FINISH = {
    "end_turn": "stop",
    "stop_sequence": "stop",
    "pause_turn": "stop",
    "max_tokens": "length",
    "tool_use": "tool_calls",
    "refusal": "content_filter",
}
BEDROCK_FINISH = {
    "stop_sequence": "stop",
    "end_turn": "stop",
    "max_tokens": "length",
    "content_filtered": "content_filter",
    "tool_use": "tool_calls",
}
OPENAI_TO_ANTHROPIC_FINISH = {
    "stop": "end_turn",
    "length": "max_tokens",
    "tool_calls": "tool_use",
    "content_filter": "refusal",
}

# Exception names by HTTP status.
HTTP_ERRORS = {
    400: "BadRequestError",
    401: "AuthenticationError",
    403: "PermissionDeniedError",
    404: "NotFoundError",
    429: "RateLimitError",
    500: "InternalServerError",
    502: "InternalServerError",
    503: "InternalServerError",
}

# MCP error labels by JSON-RPC code.
JSONRPC_ERRORS = {
    -32602: "invalid_param",
    -32601: "unsupported_method",
    -32600: "invalid_json_rpc",
    -32700: "invalid_json_rpc",
}

# Span name per MCP method.
MCP_SPAN_NAMES = {
    "initialize": "Initialize",
    "tools/list": "ListTools",
    "tools/call": "CallTool",
    "prompts/list": "ListPrompts",
    "prompts/get": "GetPrompt",
    "resources/list": "ListResources",
    "resources/read": "ReadResource",
    "resources/subscribe": "Subscribe",
    "resources/unsubscribe": "Unsubscribe",
    "resources/templates/list": "ListResourceTemplates",
    "logging/setLevel": "SetLoggingLevel",
    "completion/complete": "Complete",
    "ping": "Ping",
}

# Fixed value: the request header that carries the model name.
MODEL_HEADER = "x-ai-eg-model"


# --- requests -------------------------------------------------------------------------------------


def classify_endpoint(df: DataFrame, path_col: str = "path", prefixes: str = "", root: str = "/") -> DataFrame:
    """Add ``operation`` from the request path (query string ignored, exact match, else unsupported)."""
    path = F.substring_index(F.col(path_col), "?", 1)
    return df.withColumn(
        "operation", map_case(path, endpoint_paths(prefixes, root), F.lit("unsupported"))
    )


_REQUEST_DDL = (
    "model string, stream boolean, stream_format string, "
    "stream_options struct<include_usage: boolean>, messages array<string>, _bad string"
)


def parse_request(df: DataFrame, body: str = "request_body", operation: str = "operation") -> DataFrame:
    """Add ``model, stream, include_usage, n_messages, malformed, error`` read from the body once."""
    parsed = F.from_json(F.col(body), _REQUEST_DDL, {"columnNameOfCorruptRecord": "_bad"})
    op = F.col(operation)
    tmp = df.withColumn("_req", parsed)
    malformed = ~json_object_ok(body) | F.col("_req._bad").isNotNull()
    stream = (
        F.when(op.isin("embeddings", "image_generation", "rerank"), F.lit(False))
        .when(op == "speech", F.coalesce(F.col("_req.stream_format") == "sse", F.lit(False)))
        .otherwise(F.coalesce(F.col("_req.stream"), F.lit(False)))
    )
    tmp = tmp.withColumn("_bad", malformed)
    bad, named = F.col("_bad"), non_empty("_req.model")
    return computed_once(
        tmp,
        {
            "malformed": bad,
            "model": F.when(~bad, named),
            "stream": ~bad & stream,
            "include_usage": ~bad & F.coalesce(F.col("_req.stream_options.include_usage"), F.lit(False)),
            "n_messages": F.when(~bad, F.coalesce(F.size("_req.messages"), F.lit(0))).cast("bigint"),
            "error": F.when(bad, F.lit("malformed_request")).when(
                (op == "messages") & named.isNull(), F.lit("model_required")
            ),
        },
    ).drop("_req", "_bad")


def flag_usage_bypass(df: DataFrame, cost_configured: bool = True) -> DataFrame:
    """Streaming chat whose usage would be lost: costs are configured but usage was not asked for."""
    return df.withColumn(
        "needs_include_usage",
        F.coalesce(
            (F.col("operation") == "chat")
            & F.col("stream")
            & F.lit(cost_configured)
            & ~F.col("include_usage"),
            F.lit(False),
        ),
    )


def classify_union_input(df: DataFrame, json_col: str, allow_objects: bool = True) -> DataFrame:
    """Add ``kind`` and ``n_inputs`` for a prompt or embedding input given as JSON text.

    Kinds: string, string[], int[], int[][], object, object[]; anything else is invalid. An empty
    array counts as string[]. Objects need a non-empty ``content``.
    """
    raw = F.col(json_col)
    shape = F.schema_of_variant(F.try_parse_json(raw))
    n = F.json_array_length(raw)
    items = F.from_json(raw, "array<struct<content: string>>")
    filled = F.coalesce(F.forall(items, lambda x: F.coalesce(x["content"] != "", F.lit(False))), F.lit(False))
    one_filled = F.coalesce(json_text(raw, "$.content") != "", F.lit(False))
    kind = (
        F.when(shape == "STRING", "string")
        .when((n == 0) | (shape == "ARRAY<STRING>"), "string[]")
        .when(shape == "ARRAY<BIGINT>", "int[]")
        .when(shape.isin("ARRAY<ARRAY<BIGINT>>", "ARRAY<ARRAY<VOID>>"), "int[][]")
    )
    if allow_objects:
        kind = kind.when(shape.startswith("OBJECT<") & one_filled, "object").when(
            shape.startswith("ARRAY<OBJECT<") & filled, "object[]"
        )
    kind = kind.otherwise("invalid")
    return df.withColumn("kind", kind).withColumn(
        "n_inputs",
        F.when(F.col("kind").isin("string", "int[]", "object"), F.lit(1).cast("bigint"))
        .when(F.col("kind") == "invalid", F.lit(0).cast("bigint"))
        .otherwise(n.cast("bigint")),
    )


def explode_messages(df: DataFrame, body: str = "request_body", key: str = "request_id") -> DataFrame:
    """One row per chat message: ``(key, msg_idx, role, content_json)``."""
    messages = parse_struct(body, "messages array<string>")["messages"]
    return exploded(df, [key], messages, "msg_idx", "content_json").select(
        key, "msg_idx", json_text("content_json", "$.role").alias("role"), "content_json"
    )


_PART_DDL = (
    "array<struct<type: string, text: string, refusal: string, image_url: struct<url: string>, "
    "input_audio: struct<format: string>, file: struct<file_id: string>>>"
)


def explode_content_parts(messages: DataFrame, content: str = "content_json") -> DataFrame:
    """One row per content part; plain string content is one text part, audio and files carry no text."""
    parts = parse_struct(content, f"content {_PART_DDL}")["content"]
    plain = json_text(content, "$.content")
    text_part = F.array(
        F.struct(
            F.lit("text").alias("type"), plain.alias("text"), F.lit(None).cast("string").alias("url")
        )
    )
    listed = F.transform(
        parts,
        lambda p: F.struct(
            map_case(
                p["type"], {"image_url": "image", "input_audio": "audio", "file": "file"}, p["type"]
            ).alias("type"),
            F.when(p["type"] == "text", p["text"]).alias("text"),
            F.when(p["type"] == "image_url", p["image_url"]["url"]).alias("url"),
        ),
    )
    keep = [c for c in messages.columns if c != content]
    chosen = F.when(parts.isNotNull(), listed).when(plain.isNotNull(), text_part)
    return exploded(messages, keep, chosen, "part_idx", "_p").select(
        *keep, "part_idx", F.col("_p.type").alias("part_type"), F.col("_p.text").alias("text"), F.col("_p.url").alias("url")
    )


def explode_tool_calls(df: DataFrame, body: str = "response_body", key: str = "request_id") -> DataFrame:
    """Assistant tool calls of a chat response: ``(key, choice, call_idx, id, name, arguments)``."""
    ddl = (
        "choices array<struct<message: struct<tool_calls: array<struct<id: string, "
        "function: struct<name: string, arguments: string>>>>>>"
    )
    choices = exploded(df, [key], parse_struct(body, ddl)["choices"], "choice", "_c")
    return exploded(choices, [key, "choice"], F.col("_c.message.tool_calls"), "call_idx", "_t").select(
        key,
        "choice",
        "call_idx",
        F.col("_t.id").alias("id"),
        F.col("_t.function.name").alias("name"),
        F.col("_t.function.arguments").alias("arguments"),
    )


def explode_tools(df: DataFrame, body: str = "request_body", key: str = "request_id") -> DataFrame:
    """Declared tools: ``(key, tool_idx, tool_json)``."""
    return exploded(df, [key], parse_struct(body, "tools array<string>")["tools"], "tool_idx", "tool_json")


def _entry(role: Column, kind: Column | str, text: Column, error: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        role.alias("role"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("part_type"),
        text.alias("text"),
        (none if error is None else error).alias("error"),
    )


def _blocks_text(blocks: Column) -> Column:
    return F.array_join(
        F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), ""
    )


# A content field is text or a list of blocks. Read with the list type it is NULL for text, so both
# readings are zipped and the list one wins.
def _text_or_blocks(body: Column, block_ddl: str) -> Column:
    as_text = parse_struct(body, "messages array<struct<role: string, content: string>>")["messages"]
    as_list = parse_struct(
        body, f"messages array<struct<role: string, content: array<{block_ddl}>>>"
    )["messages"]
    return F.zip_with(
        as_text,
        as_list,
        lambda t, b: F.struct(t["role"].alias("role"), t["content"].alias("text"), b["content"].alias("blocks")),
    )


def _openai_entries(body: Column) -> Column:
    def one(m: Column) -> Column:
        listed = F.transform(
            m["blocks"], lambda p: _entry(m["role"], p["type"], F.when(p["type"] == "text", p["text"]))
        )
        plain = F.array(_entry(m["role"], "text", m["text"]))
        return F.when(m["blocks"].isNotNull(), listed).when(m["text"].isNotNull(), plain)

    none = F.expr("cast(array() AS array<struct<role: string, part_type: string, text: string, error: string>>)")
    calls = parse_struct(body, "messages array<struct<role: string, tool_calls: array<struct<function: struct<name: string>>>>>")["messages"]
    said = F.transform(_text_or_blocks(body, "struct<type: string, text: string>"), one)

    def with_calls(rows: Column, m: Column) -> Column:
        used = F.transform(m["tool_calls"], lambda c: _entry(m["role"], F.lit("tool_use"), c["function"]["name"]))
        return F.concat(F.coalesce(rows, none), F.coalesce(used, none))

    return F.zip_with(said, calls, with_calls)


def _anthropic_entries(body: Column) -> Column:
    sys_blocks = parse_struct(body, "system array<struct<type: string, text: string>>")["system"]
    sys_text = F.when(sys_blocks.isNotNull(), _blocks_text(sys_blocks)).otherwise(json_text(body, "$.system"))
    no_rows = F.lit(None).cast(
        "array<array<struct<role: string, part_type: string, text: string, error: string>>>"
    )
    system = F.when(
        F.coalesce(sys_text != "", F.lit(False)), F.array(F.array(_entry(F.lit("system"), "text", sys_text)))
    ).otherwise(F.coalesce(no_rows, F.expr("array()")))

    def block(role: Column, b: Column, plain: Column) -> Column:
        result = F.when(b["content"].isNotNull(), _blocks_text(b["content"])).otherwise(plain["content"])
        return _entry(
            role,
            b["type"],
            F.when(b["type"] == "text", b["text"])
            .when(b["type"] == "tool_result", result)
            .when(b["type"] == "tool_use", b["name"]),
        )

    def one(m: Column) -> Column:
        known = F.coalesce(m["role"].isin("user", "assistant"), F.lit(False))
        bad = F.array(
            _entry(
                m["role"], "text", F.lit(None).cast("string"),
                F.concat(F.lit("invalid role "), F.coalesce(m["role"], F.lit(""))),
            )
        )
        plain = F.from_json(m["text"], "array<struct<content: string>>")
        listed = F.zip_with(m["blocks"], plain, lambda b, t: block(m["role"], b, t))
        return (
            F.when(~known, bad)
            .when(m["blocks"].isNotNull(), listed)
            .otherwise(F.array(_entry(m["role"], "text", m["text"])))
        )

    msgs = _text_or_blocks(
        body, "struct<type: string, text: string, name: string, content: array<struct<type: string, text: string>>>"
    )
    return F.concat(system, F.coalesce(F.transform(msgs, one), F.expr("array()")))


def _gemini_entries(body: Column) -> Column:
    parts = "parts: array<struct<text: string, functionCall: struct<name: string>>>"
    ddl = f"systemInstruction struct<{parts}>, contents array<struct<role: string, {parts}>>"

    def lines(role: Column, ps: Column) -> Column:
        return F.transform(
            ps,
            lambda p: _entry(
                role,
                F.when(p["functionCall"].isNotNull(), F.lit("tool_use")).otherwise(F.lit("text")),
                F.coalesce(p["text"], p["functionCall"]["name"]),
            ),
        )

    def build(req: Column) -> Column:
        system = F.when(
            req["systemInstruction"]["parts"].isNotNull(),
            F.array(lines(F.lit("system"), req["systemInstruction"]["parts"])),
        ).otherwise(F.expr("array()"))
        turns = F.transform(
            req["contents"],
            lambda c: lines(F.when(c["role"] == "model", F.lit("assistant")).otherwise(F.coalesce(c["role"], F.lit("user"))), c["parts"]),
        )
        return F.concat(system, F.coalesce(turns, F.expr("array()")))

    return let(parse_struct(body, ddl), build)


def _bedrock_entries(body: Column) -> Column:
    ddl = (
        "system array<struct<text: string>>, messages array<struct<role: string, "
        "content: array<struct<text: string, toolUse: struct<name: string>, toolResult: struct<content: array<struct<text: string>>>>>>>"
    )

    def one(m: Column) -> Column:
        return F.transform(
            m["content"],
            lambda c: _entry(
                m["role"],
                F.when(c["toolUse"].isNotNull(), F.lit("tool_use"))
                .when(c["toolResult"].isNotNull(), F.lit("tool_result"))
                .otherwise(F.lit("text")),
                F.coalesce(c["text"], c["toolUse"]["name"], _blocks_text(c["toolResult"]["content"])),
            ),
        )

    def build(req: Column) -> Column:
        system = F.when(
            req["system"].isNotNull(),
            F.array(F.transform(req["system"], lambda s: _entry(F.lit("system"), "text", s["text"]))),
        ).otherwise(F.expr("array()"))
        return F.concat(system, F.coalesce(F.transform(req["messages"], one), F.expr("array()")))

    return let(parse_struct(body, ddl), build)


def normalize_messages(
    df: DataFrame, schema: str = "api_schema", body: str = "request_body", key: str = "request_id"
) -> DataFrame:
    """Provider bodies to one canonical message table, in a single pass over the requests.

    Output ``(key, msg_idx, part_idx, role, part_type, text, error)``; system prompts come first.
    Tool calls of an assistant are ``tool_use`` parts with the function's name, after its text. A schema without a known
    form gives one row with an error.
    """
    s, b = F.col(schema), F.col(body)
    entries = (
        F.when(s.isin("OpenAI", "AzureOpenAI"), _openai_entries(b))
        .when(s.isin("Anthropic", "AWSAnthropic", "GCPAnthropic"), _anthropic_entries(b))
        .when(s == "GCPVertexAI", _gemini_entries(b))
        .when(s == "AWSBedrock", _bedrock_entries(b))
        .otherwise(F.array(F.array(_entry(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat(F.lit("no message form for schema "), F.coalesce(s, F.lit("")))))))
    )
    messages = exploded(df, [key], entries, "msg_idx", "_parts")
    return exploded(messages, [key, "msg_idx"], F.col("_parts"), "part_idx", "_e").select(
        key, "msg_idx", "part_idx", "_e.*"
    )


# --- wire formats ---------------------------------------------------------------------------------


def parse_sse(df: DataFrame, payload: str = "payload", key: str = "request_id") -> DataFrame:
    """Server-sent events of a whole payload: ``(key, event_idx, data_idx, event, id, data)``.

    Line ends are normalised, a blank line ends an event, the last event may lack one. Data that is
    not JSON (such as the ``[DONE]`` marker) gives no row.
    """
    text = F.regexp_replace(F.col(payload), "\r\n|\r", "\n")
    lines = F.split(F.col("_block"), "\n")

    def last_of(prefix: str) -> Column:
        hits = F.filter(lines, lambda x: x.startswith(prefix))
        return F.trim(F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 2**31 - 1))

    data = F.transform(
        F.filter(lines, lambda x: x.startswith("data: ")), lambda x: F.trim(F.substring(x, 7, 2**31 - 1))
    )
    events = exploded(df, [key], F.split(text, "\n\n"), "event_idx", "_block")
    named = [key, "event_idx", non_empty(last_of("event: ")).alias("event"), non_empty(last_of("id: ")).alias("id")]
    return (
        exploded(events, named, data, "data_idx", "data")
        .where(F.try_parse_json("data").isNotNull())
        .select(key, "event_idx", "data_idx", "event", "id", "data")
    )


def parse_jsonrpc(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``kind, id, method, params, result, error_code, error_message`` of a JSON-RPC 2.0 message."""
    trimmed = F.call_function("btrim", F.col(raw), F.lit(" \t\n\r\f\v"))
    bare = F.when(trimmed.startswith("\ufeff"), F.substring(trimmed, 2, 2**31 - 1)).otherwise(trimmed)
    text = F.col("_text")
    msg = F.from_json(
        text,
        "jsonrpc string, id string, method string, params string, result string, "
        "error struct<code: bigint, message: string>",
    )
    tmp = df.withColumn("_text", bare).withColumn("_m", msg)
    ok = json_object_ok(text) & F.coalesce(F.col("_m.jsonrpc") == "2.0", F.lit(False))
    has_method = F.coalesce(F.col("_m.method") != "", F.lit(False))
    answered = F.col("_m.result").isNotNull() | F.col("_m.error").isNotNull()
    kind = (
        F.when(~ok, "invalid")
        .when(has_method & F.col("_m.id").isNotNull(), "request")
        .when(has_method, "notification")
        .when(F.col("_m.id").isNotNull() & answered, "response")
        .otherwise("invalid")
    )
    valid = F.col("_kind") != "invalid"
    fields = {"id": "id", "method": "method", "params": "params", "result": "result",
              "error_code": "error.code", "error_message": "error.message"}
    return computed_once(
        tmp.withColumn("_kind", kind),
        {"kind": F.col("_kind"), **{out: F.when(valid, F.col(f"_m.{src}")) for out, src in fields.items()}},
    ).drop("_m", "_kind", "_text")


def _split_first(df: DataFrame, source: str, sep: str, right: str) -> DataFrame:
    at = F.instr(F.col(source), sep)
    found = F.coalesce(at > 0, F.lit(False))
    return (
        df.withColumn("backend", F.when(found, F.expr(f"substring(`{source}`, 1, instr(`{source}`, '{sep}') - 1)")))
        .withColumn(right, F.when(found, F.expr(f"substring(`{source}`, instr(`{source}`, '{sep}') + {len(sep)})")))
        .withColumn("valid", found)
    )


def split_tool_name(df: DataFrame, source: str = "full_tool_name") -> DataFrame:
    """``backend__tool`` at the first separator; names without one are invalid."""
    return _split_first(df, source, TOOL_SEPARATOR, "tool")


def split_resource_uri(df: DataFrame, source: str = "full_uri") -> DataFrame:
    """``backend+uri`` at the first plus sign."""
    return _split_first(df, source, URI_SEPARATOR, "uri")


# --- headers, attributes, labels ------------------------------------------------------------------


def attribute_columns(mapping: dict[str, str], headers: str = "headers", keep_empty: bool = False) -> dict[str, Column]:
    out = {}
    for header, attribute in mapping.items():
        value = F.try_element_at(F.col(headers), F.lit(header))
        out[attribute.replace(".", "_")] = value if keep_empty else non_empty(value)
    return out


def project_header_attributes(
    df: DataFrame, mapping: dict[str, str] | str, headers: str = "headers", keep_empty: bool = False
) -> DataFrame:
    """Request headers as attribute columns (dots in attribute names become underscores).

    Access logs skip empty values; metrics keep whatever is present (``keep_empty``).
    """
    if isinstance(mapping, str):
        mapping = parse_header_mapping(mapping)
    return df.withColumns(attribute_columns(mapping, headers, keep_empty))


def meta_or_header(
    df: DataFrame, mapping: dict[str, str] | str, meta: str = "meta", headers: str = "headers"
) -> DataFrame:
    """Attribute from the message ``_meta`` (any key case, first alphabetically), else from the header."""
    if isinstance(mapping, str):
        mapping = parse_header_mapping(mapping)

    def lookup(source: str, name: str) -> Column:
        keys = F.filter(F.map_keys(source), lambda k: F.lower(k) == name.lower())
        return non_empty(F.try_element_at(F.col(source), F.array_min(keys)))

    return df.withColumns(
        {a.replace(".", "_"): F.coalesce(lookup(meta, n), lookup(headers, n)) for n, a in mapping.items()}
    )


def provider_name(df: DataFrame, schema: str = "api_schema", backend: str = "backend") -> DataFrame:
    """Provider label of the backend schema; other schemas report the backend name."""
    fallback = F.col(backend) if backend in df.columns else F.lit(None).cast("string")
    return df.withColumn("provider", map_case(schema, PROVIDERS, fallback))


def resolve_models(df: DataFrame, body_model: str = "body_model") -> DataFrame:
    """Original, request and response model; unset names read ``unknown``.

    The request model is the override or the original. The response model is the one the body names,
    except for providers and operations whose bodies never name one.
    """
    original = non_empty("original_model")
    request = F.coalesce(non_empty("model_override"), original)
    silent = F.col("api_schema").isin("AWSBedrock", "GCPVertexAI") | F.col("operation").isin(
        "rerank", "speech", "image_generation"
    )
    response = F.when(F.coalesce(silent, F.lit(False)), request).otherwise(F.coalesce(non_empty(body_model), request))
    unknown = F.lit("unknown")
    return df.withColumns(
        {
            "original_model": F.coalesce(original, unknown),
            "request_model": F.coalesce(request, unknown),
            "response_model": F.coalesce(response, unknown),
        }
    )


def parse_backend_ref(df: DataFrame, source: str = "backend_ref") -> DataFrame:
    """``ns/name/route/R/rule/i/ref/j`` to its five parts; NULLs when the shape differs."""
    shape = F.col(source).rlike(r"^[^/]+/[^/]+/route/[^/]+/rule/[0-9]+/ref/[0-9]+$")

    def part(n: int) -> Column:
        return F.when(shape, F.split_part(F.col(source), F.lit("/"), F.lit(n)))

    return df.withColumns(
        {
            "namespace": part(1),
            "backend": part(2),
            "route": part(4),
            "rule_idx": part(6).cast("bigint"),
            "ref_idx": part(8).cast("bigint"),
        }
    )


def capability_bits(hex_digits: Column) -> Column:
    """Capability bitmask; text that is no 16-bit hex number means everything."""
    ok = hex_digits.rlike("^0*[0-9a-fA-F]{1,4}$")
    return F.when(F.coalesce(ok, F.lit(False)), F.conv(hex_digits, 16, 10).cast("int")).otherwise(
        F.lit(ALL_CAPABILITIES)
    )


def capability_flags(bits: Column) -> dict[str, Column]:
    """Nine booleans; list-changed and subscribe flags need their parent capability."""
    has = {n: bits.bitwiseAND(F.lit(1 << i)) != 0 for i, n in enumerate(CAPABILITY_BITS)}
    for child, parent in [
        ("tools_list_changed", "tools"), ("prompts_list_changed", "prompts"),
        ("resources_list_changed", "resources"), ("resources_subscribe", "resources"),
    ]:
        has[child] = has[child] & has[parent]
    return has


def decode_capabilities(df: DataFrame, source: str = "caps") -> DataFrame:
    """Hex capability mask to nine boolean columns."""
    return df.withColumns(capability_flags(capability_bits(F.col(source))))


def decode_session_id(df: DataFrame, source: str = "session", key: str = "session_key") -> DataFrame:
    """Composite session id to one row per backend, or one row with ``error`` when malformed.

    Shape ``route@subject@backend:base64:caps,...``: the first and the last ``@`` delimit. The
    capability field may be missing (everything), the session part may be empty.
    """
    s = F.col(source)
    shape = r"(?s)^([^@]*)@(.*)@([^@]*)$"
    parts = F.transform(
        F.split(F.regexp_extract(s, shape, 3), ","),
        lambda p: F.struct(
            F.split(p, ":", 3)[0].alias("backend"),
            F.try_element_at(F.split(p, ":", 3), F.lit(2)).alias("encoded"),
            F.try_element_at(F.split(p, ":", 3), F.lit(3)).alias("caps"),
        ),
    )
    rows = F.transform(
        parts,
        lambda p: F.struct(
            p["backend"].alias("backend"),
            base64_bytes(p["encoded"]).cast("string").alias("backend_session"),
            capability_bits(p["caps"]).alias("caps"),
            F.when(p["encoded"].isNull(), F.lit("missing separator in backend part"))
            .when(p["backend"] == "", F.lit("empty backend name"))
            .when(base64_bytes(p["encoded"]).isNull(), F.lit("undecodable backend session"))
            .alias("error"),
        ),
    )
    shaped = s.rlike(shape)

    def failed(message: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(None).cast("string").alias("backend"),
                F.lit(None).cast("string").alias("backend_session"),
                F.lit(None).cast("int").alias("caps"),
                message.alias("error"),
            )
        )

    def last_entries(all_rows: Column) -> Column:
        # A backend named twice keeps its last entry.
        return F.filter(
            all_rows,
            lambda r, i: ~F.exists(
                F.slice(all_rows, i + F.lit(2), F.size(all_rows)), lambda q: q["backend"] == r["backend"]
            ),
        )

    def checked(all_rows: Column) -> Column:
        first_error = F.try_element_at(F.filter(all_rows, lambda r: r["error"].isNotNull()), F.lit(1))["error"]
        return let(first_error, lambda e: F.when(e.isNotNull(), failed(e)).otherwise(last_entries(all_rows)))

    out = F.when(~shaped, failed(F.lit("missing '@' separator"))).otherwise(let(rows, checked))
    named = df.withColumns(
        {"route": F.when(shaped, F.regexp_extract(s, shape, 1)), "subject": F.when(shaped, F.regexp_extract(s, shape, 2))}
    )
    return exploded(named, [key, "route", "subject"], out, "_i", "_r").select(key, "route", "subject", "_r.*")


def bearer_token(header: Column) -> Column:
    return non_empty(F.trim(F.regexp_extract(header, r"(?is)^bearer (.*)$", 1)))


def jwt_payload(header: Column) -> Column:
    """Unverified token payload as JSON text; NULL for a missing or undecodable token."""
    token = bearer_token(header)
    pieces = F.split(token, r"\.")
    return let(
        pieces,
        lambda p: F.when(
            F.size(p) == 3, let(base64url_text(F.get(p, F.lit(1))), lambda text: F.when(json_object_ok(text), text))
        ),
    )


def scopes_of(payload: Column) -> Column:
    """Scopes from ``scope`` and ``scp``: whitespace-separated text or an array of strings."""

    def both(lists: Column, texts: Column) -> Column:
        def one(name: str) -> Column:
            words = F.filter(F.split(texts[name], r"\s+"), lambda w: w != "")
            return F.coalesce(F.filter(lists[name], lambda w: w != ""), words, F.expr("array()"))

        return F.concat(one("scope"), one("scp"))

    lists = F.from_json(payload, "scope array<string>, scp array<string>")
    texts = F.from_json(payload, "scope string, scp string")
    return let(lists, lambda a: let(texts, lambda b: both(a, b)))


def decode_jwt_claims(df: DataFrame, header: str = "authorization") -> DataFrame:
    """Add ``sub``, ``scopes`` and ``claims`` (raw JSON per top-level claim) of a bearer token."""
    tmp = df.withColumn("_payload", jwt_payload(F.col(header)))
    payload = F.col("_payload")
    claims = F.from_json(payload, "map<string,string>")
    tmp = tmp.withColumn("_claims", claims)
    return computed_once(
        tmp,
        {
            "sub": F.try_element_at("_claims", F.lit("sub")),
            "scopes": F.when(payload.isNotNull(), scopes_of(payload)).otherwise(F.expr("cast(array() as array<string>)")),
            "claims": F.map_filter("_claims", lambda k, v: ~k.isin("scope", "scp")),
        },
    ).drop("_payload", "_claims")


def declared_models(route_rules: DataFrame, default_owner: str, default_created: Column | None = None) -> DataFrame:
    """Models a gateway declares: exact matches on the model header (duplicates are kept)."""
    exact = F.coalesce(F.col("match_type"), F.lit("Exact")) == "Exact"
    created = F.col("created") if default_created is None else F.coalesce(F.col("created"), default_created)
    return route_rules.where(exact & (F.col("header_name") == MODEL_HEADER)).select(
        F.col("header_value").alias("model"),
        F.coalesce(F.col("owned_by"), F.lit(default_owner)).alias("owned_by"),
        created.alias("created"),
    )


def normalize_finish_reason(
    df: DataFrame, reason: str = "reason", schema: str = "api_schema", has_tools: str = "has_tools"
) -> DataFrame:
    """Provider stop reason to a chat finish reason, plus the reverse in ``anthropic_reason``."""
    r, s = F.col(reason), F.col(schema)
    anthropic = map_case(r, ANTHROPIC_FINISH, F.lit("error"))
    bedrock = map_case(r, BEDROCK_FINISH, F.lit("stop"))
    gemini = (
        F.when((r == "STOP") & F.col(has_tools), "tool_calls")
        .when(r == "STOP", "stop")
        .when(r == "MAX_TOKENS", "length")
        .when(F.coalesce(r, F.lit("")) == "", "")
        .otherwise("content_filter")
    )
    out = (
        F.when(s.isin("Anthropic", "AWSAnthropic", "GCPAnthropic"), anthropic)
        .when(s == "AWSBedrock", bedrock)
        .when(s == "GCPVertexAI", gemini)
        .otherwise(r)
    )
    return df.withColumn("finish_reason", out).withColumn(
        "anthropic_reason", map_case("finish_reason", OPENAI_TO_ANTHROPIC_FINISH, F.lit("end_turn"))
    )


def http_error_type(status: Column) -> Column:
    out: Column | None = None
    for code, name in HTTP_ERRORS.items():
        out = F.when(status == code, F.lit(name)) if out is None else out.when(status == code, F.lit(name))
    assert out is not None
    return out.otherwise(F.lit("Error"))


def http_error_message(status: Column, body: Column) -> Column:
    head = F.concat(F.lit("Error code: "), status.cast("string"))
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(head, F.lit(" - "), body)).otherwise(head)


def classify_http_error(df: DataFrame, status: str = "status", body: str | None = None) -> DataFrame:
    """Add ``success`` (2xx), ``error_type`` and ``error_message``."""
    st = F.col(status)
    ok = F.coalesce((st >= 200) & (st < 300), F.lit(False))
    text = F.col(body) if body else F.lit("")
    return df.withColumns(
        {
            "success": ok,
            "error_type": F.when(~ok, http_error_type(st)),
            "error_message": F.when(~ok, http_error_message(st, text)),
        }
    )


def mcp_error_label(code: Column) -> Column:
    out: Column | None = None
    for c, name in JSONRPC_ERRORS.items():
        out = F.when(code == c, F.lit(name)) if out is None else out.when(code == c, F.lit(name))
    assert out is not None
    return F.when(code.isNotNull(), out.otherwise(F.lit("internal_error")))


def classify_mcp_error(df: DataFrame, code: str = "error_code") -> DataFrame:
    """Add ``mcp_error_type`` of a JSON-RPC error code."""
    return df.withColumn("mcp_error_type", mcp_error_label(F.col(code)))


def classify_joined_mcp_errors(df: DataFrame, keys: list[str], code: str = "error_code", order: str = "err_idx") -> DataFrame:
    """Joined errors: the first label that is not internal, else internal."""
    # Codes, not labels, go through the aggregate: fixed-width values need no sort.
    specific = F.col(code).isin(*JSONRPC_ERRORS)
    first = F.min_by(F.when(specific, F.col(code)), F.when(specific, F.col(order)))
    agg = df.groupBy(*keys).agg(first.alias("_code"), F.count(F.col(code)).alias("_n"))
    return agg.select(
        *keys,
        F.when(F.col("_code").isNotNull(), mcp_error_label(F.col("_code")))
        .when(F.col("_n") > 0, "internal_error")
        .alias("mcp_error_type"),
    )


def mcp_span_name(df: DataFrame, method: str = "method") -> DataFrame:
    """Span name of an MCP method; unknown methods keep their name."""
    return df.withColumn("span_name", map_case(method, MCP_SPAN_NAMES, F.col(method)))


# --- configuration rows ---------------------------------------------------------------------------


def validate_filter_config(df: DataFrame) -> DataFrame:
    """Rows of a content-filter configuration with their ``errors``; valid rows are left out."""
    url = F.coalesce(F.col("url"), F.lit(""))
    scopes = F.coalesce(F.col("scopes"), F.expr("cast(array() as array<string>)"))
    policy, mode = F.coalesce(F.col("failure_policy"), F.lit("")), F.coalesce(F.col("mode"), F.lit(""))
    rate = F.coalesce(F.col("sample_permille"), F.lit(0))
    checks = [
        (url == "", "url is required"),
        ((url != "") & ~url.startswith("http://") & ~url.startswith("https://"), "url must start with http:// or https://"),
        (F.size(scopes) == 0, "at least one scope is required"),
        (F.exists(scopes, lambda x: ~x.isin("Request", "Response")), "unknown scope"),
        (~policy.isin("", "PassThrough", "Fail"), "unknown failure policy"),
        (~mode.isin("", "Enforce", "Shadow"), "unknown mode"),
        ((rate < 0) | (rate > 1000), "sample rate out of range"),
    ]
    errors = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in checks]), lambda e: e.isNotNull())
    return df.withColumn("errors", errors).where(F.size("errors") > 0)


def canonical_header(name: Column) -> Column:
    """``x-tenant-id`` to ``X-Tenant-Id``."""
    return F.array_join(
        F.transform(
            F.split(name, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**31 - 1)))
        ),
        "-",
    )


def canonical_forward_headers(df: DataFrame, source: str = "forward_headers") -> DataFrame:
    """Trim, drop blanks, canonical case, first of each name."""
    cleaned = F.filter(F.transform(F.col(source), lambda h: F.trim(h)), lambda h: h != "")
    return df.withColumn(source, F.array_distinct(F.transform(cleaned, canonical_header)))
