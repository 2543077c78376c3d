"""Token-usage normalisation: provider bodies and stream events to six nullable BIGINT counters.

NULL means "not reported" and is kept apart from zero: cost treats NULL as zero, metrics skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parse_struct

USAGE = [
    "input_tokens",
    "output_tokens",
    "total_tokens",
    "cached_input_tokens",
    "cache_creation_input_tokens",
    "reasoning_tokens",
]

# Metric token types; the total is never one of them.
TOKEN_TYPES = {
    "input_tokens": "input",
    "cached_input_tokens": "cached_input",
    "cache_creation_input_tokens": "cache_creation_input",
    "output_tokens": "output",
    "reasoning_tokens": "reasoning",
}

_COUNTS = (
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint, "
    "prompt_tokens_details: struct<cached_tokens: bigint, cache_creation_input_tokens: bigint>, "
    "completion_tokens_details: struct<reasoning_tokens: bigint>, "
    "input_tokens: bigint, output_tokens: bigint, "
    "input_tokens_details: struct<cached_tokens: bigint, cache_creation_input_tokens: bigint>, "
    "output_tokens_details: struct<reasoning_tokens: bigint>, "
    "cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, "
    "inputTokens: bigint, outputTokens: bigint, cacheReadInputTokens: bigint, cacheWriteInputTokens: bigint>"
)
_GEMINI = (
    "usageMetadata struct<promptTokenCount: bigint, candidatesTokenCount: bigint, totalTokenCount: bigint, "
    "cachedContentTokenCount: bigint, thoughtsTokenCount: bigint>"
)
_VECTORS = "predictions array<struct<embeddings: struct<statistics: struct<token_count: bigint>>>>"
_RERANK = "meta struct<tokens: struct<input_tokens: double, output_tokens: double>>"
BODY_DDL = f"{_COUNTS}, {_GEMINI}, {_VECTORS}, {_RERANK}"

Counters = dict[str, Column]


def _long(v: int | None) -> Column:
    return F.lit(v).cast("bigint")


def _zero(c: Column) -> Column:
    return F.coalesce(c, _long(0))


def _counters(**known: Column) -> Counters:
    return {name: known.get(name, _long(None)) for name in USAGE}


def explicit_caching(inp: Column, out: Column, read: Column, creation: Column) -> Counters:
    """Input includes cache reads and cache writes; total is input plus output."""
    full = _zero(inp) + _zero(creation) + _zero(read)
    return _counters(
        input_tokens=full,
        output_tokens=_zero(out),
        total_tokens=full + _zero(out),
        cached_input_tokens=read,
        cache_creation_input_tokens=creation,
    )


def chat_counters(u: Column, stream: bool = False) -> Counters:
    """Chat usage; cache counters only with prompt details, reasoning only with completion details."""
    present = u.isNotNull() if stream else F.lit(True)
    pd, cd = u["prompt_tokens_details"], u["completion_tokens_details"]
    return _counters(
        input_tokens=F.when(present, _zero(u["prompt_tokens"])),
        output_tokens=F.when(present, _zero(u["completion_tokens"])),
        total_tokens=F.when(present, _zero(u["total_tokens"])),
        cached_input_tokens=F.when(pd.isNotNull(), _zero(pd["cached_tokens"])),
        cache_creation_input_tokens=F.when(pd.isNotNull(), _zero(pd["cache_creation_input_tokens"])),
        reasoning_tokens=F.when(cd.isNotNull(), _zero(cd["reasoning_tokens"])),
    )


def completions_counters(u: Column) -> Counters:
    """As chat, only with a usage object, and negative numbers are ignored."""
    return {k: F.when(c >= 0, c) for k, c in chat_counters(u, stream=True).items()}


def embeddings_counters(u: Column) -> Counters:
    return _counters(input_tokens=_zero(u["prompt_tokens"]), total_tokens=_zero(u["total_tokens"]))


def responses_counters(u: Column, stream: Column | bool = False) -> Counters:
    """Responses usage; streams never report cache writes (forced to zero)."""
    s = F.lit(stream) if isinstance(stream, bool) else stream
    given = u.isNotNull() | s
    creation = F.when(s, _long(0)).otherwise(_zero(u["input_tokens_details"]["cache_creation_input_tokens"]))
    values = dict(
        input_tokens=_zero(u["input_tokens"]),
        output_tokens=_zero(u["output_tokens"]),
        total_tokens=_zero(u["total_tokens"]),
        cached_input_tokens=_zero(u["input_tokens_details"]["cached_tokens"]),
        cache_creation_input_tokens=creation,
        reasoning_tokens=_zero(u["output_tokens_details"]["reasoning_tokens"]),
    )
    return _counters(**{k: F.when(given, v) for k, v in values.items()})


def anthropic_counters(u: Column, native: bool = True) -> Counters:
    """Messages usage. The native path reports absent cache counters as zero."""
    read, creation = u["cache_read_input_tokens"], u["cache_creation_input_tokens"]
    if native:
        read, creation = _zero(read), _zero(creation)
    return explicit_caching(u["input_tokens"], u["output_tokens"], read, creation)


def bedrock_counters(u: Column) -> Counters:
    """Converse usage; the provider's own total is ignored."""
    c = explicit_caching(u["inputTokens"], u["outputTokens"], u["cacheReadInputTokens"], u["cacheWriteInputTokens"])
    return {k: F.when(u.isNotNull(), v) for k, v in c.items()}


def gemini_counters(m: Column, stream: Column) -> Counters:
    """Gemini usage. Output counts thoughts only outside streams; streams need a prompt count."""
    kept = ~stream | F.coalesce(m["promptTokenCount"] > 0, F.lit(False))
    details = m.isNotNull() | stream
    out = F.when(stream, _zero(m["candidatesTokenCount"])).otherwise(
        _zero(m["candidatesTokenCount"]) + _zero(m["thoughtsTokenCount"])
    )
    return _counters(
        input_tokens=F.when(kept, _zero(m["promptTokenCount"])),
        output_tokens=F.when(kept, out),
        total_tokens=F.when(kept, _zero(m["totalTokenCount"])),
        cached_input_tokens=F.when(kept & details, _zero(m["cachedContentTokenCount"])),
        reasoning_tokens=F.when(kept & details, _zero(m["thoughtsTokenCount"])),
    )


def gemini_embeddings_counters(predictions: Column) -> Counters:
    counts = F.transform(predictions, lambda p: _zero(p["embeddings"]["statistics"]["token_count"]))
    total = _zero(F.aggregate(counts, _long(0), lambda a, x: a + x))
    return _counters(input_tokens=total, total_tokens=total)


def rerank_counters(meta: Column) -> Counters:
    """Fractional tokens are cut to whole ones; the total is their sum."""
    tokens = meta["tokens"]
    inp = F.floor(tokens["input_tokens"]).cast("bigint")
    out = F.floor(tokens["output_tokens"]).cast("bigint")
    return _counters(
        input_tokens=inp,
        output_tokens=out,
        total_tokens=F.when(tokens.isNotNull(), _zero(inp) + _zero(out)),
    )


def image_counters(u: Column) -> Counters:
    values = dict(
        input_tokens=_zero(u["input_tokens"]), output_tokens=_zero(u["output_tokens"]), total_tokens=_zero(u["total_tokens"])
    )
    return _counters(**{k: F.when(u.isNotNull(), v) for k, v in values.items()})


def _with(df: DataFrame, body: str, ddl: str, build) -> DataFrame:
    out = df.withColumn("_body", parse_struct(body, ddl))
    return out.withColumns(build(F.col("_body"))).drop("_body")


def usage_openai_chat(df: DataFrame, body: str = "response_body", stream: bool = False) -> DataFrame:
    return _with(df, body, _COUNTS, lambda b: chat_counters(b["usage"], stream))


def usage_completions(df: DataFrame, body: str = "response_body") -> DataFrame:
    return _with(df, body, _COUNTS, lambda b: completions_counters(b["usage"]))


def usage_embeddings(df: DataFrame, body: str = "response_body") -> DataFrame:
    return _with(df, body, _COUNTS, lambda b: embeddings_counters(b["usage"]))


def usage_responses(df: DataFrame, body: str = "response_body", event_type: str | None = None) -> DataFrame:
    """Plain bodies, or stream events when ``event_type`` names that column (only completion counts)."""
    if event_type is None:
        return _with(df, body, _COUNTS, lambda b: responses_counters(b["usage"]))
    done = df.where(F.col(event_type) == "response.completed")
    return _with(done, body, f"response struct<{_COUNTS.replace('usage struct', 'usage: struct', 1)}>",
                 lambda b: responses_counters(b["response"]["usage"], stream=True))


def usage_anthropic(df: DataFrame, body: str = "response_body", native: bool = True) -> DataFrame:
    return _with(df, body, _COUNTS, lambda b: anthropic_counters(b["usage"], native))


def usage_bedrock(df: DataFrame, body: str = "response_body") -> DataFrame:
    return _with(df, body, _COUNTS, lambda b: bedrock_counters(b["usage"]))


def usage_gemini(df: DataFrame, body: str = "response_body", stream: str = "stream") -> DataFrame:
    """Adds ``mode`` because streams and plain bodies count output differently."""
    out = _with(df, body, _GEMINI, lambda b: gemini_counters(b["usageMetadata"], F.col(stream)))
    return out.withColumn("mode", F.when(F.col(stream), "stream").otherwise("body"))


def usage_gemini_embeddings(df: DataFrame, body: str = "response_body") -> DataFrame:
    return _with(df, body, _VECTORS, lambda b: gemini_embeddings_counters(b["predictions"]))


def usage_rerank(df: DataFrame, body: str = "response_body") -> DataFrame:
    return _with(df, body, _RERANK, lambda b: rerank_counters(b["meta"]))


def usage_image(df: DataFrame, body: str = "response_body") -> DataFrame:
    return _with(df, body, _COUNTS, lambda b: image_counters(b["usage"]))


# --- streams --------------------------------------------------------------------------------------


def usage_latest(chunks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Cumulative chunks: per counter the last reported value wins. Order-free, so it combines map-side."""

    def last(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order))).alias(name)

    return chunks.groupBy(*keys).agg(*[last(c) for c in USAGE if c in chunks.columns])


def _last_of(value: Column, cond: Column, order: Column) -> Column:
    return F.max_by(value, F.when(cond & value.isNotNull(), order))


def usage_anthropic_stream(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Native message stream: the start event sets every counter, each delta replaces the output.

    Input columns: ``event_type`` and the raw ``input_tokens, output_tokens, cached_input_tokens,
    cache_creation_input_tokens`` of the event. Counters still missing once there is output become 0.
    """
    o, kind = F.col(order), F.col("event_type")
    start, delta = kind == "message_start", kind == "message_delta"
    c = explicit_caching(
        F.col("input_tokens"), F.col("output_tokens"),
        _zero(F.col("cached_input_tokens")), _zero(F.col("cache_creation_input_tokens")),
    )
    agg = events.groupBy(*keys).agg(
        _last_of(c["input_tokens"], start, o).alias("_in"),
        _last_of(c["cached_input_tokens"], start, o).alias("_cached"),
        _last_of(c["cache_creation_input_tokens"], start, o).alias("_creation"),
        _last_of(F.when(start | (delta & (c["output_tokens"] >= 0)), c["output_tokens"]), start | delta, o).alias("_out"),
    )
    has_out = F.col("_out").isNotNull()

    def fill(name: str) -> Column:
        return F.when(has_out, _zero(F.col(name))).otherwise(F.col(name))

    return agg.select(
        *keys,
        fill("_in").alias("input_tokens"),
        F.col("_out").alias("output_tokens"),
        F.when(has_out, fill("_in") + F.col("_out")).alias("total_tokens"),
        fill("_cached").alias("cached_input_tokens"),
        fill("_creation").alias("cache_creation_input_tokens"),
    )


def usage_anthropic_stream_translated(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Translated message stream: delta counters add up, delta cache tokens also raise the input.

    A stream has one start event and it comes first; its output count is not used.
    """
    o, kind = F.col(order), F.col("event_type")
    start, delta = kind == "message_start", kind == "message_delta"
    read, creation = _zero(F.col("cached_input_tokens")), _zero(F.col("cache_creation_input_tokens"))
    full = _zero(F.col("input_tokens")) + read + creation

    def delta_sum(v: Column) -> Column:
        return F.sum(F.when(delta, v))

    agg = events.groupBy(*keys).agg(
        _last_of(full, start, o).alias("_in"),
        _last_of(read, start, o).alias("_cached"),
        _last_of(creation, start, o).alias("_creation"),
        delta_sum(_zero(F.col("output_tokens"))).alias("_out"),
        delta_sum(read).alias("_dread"),
        delta_sum(creation).alias("_dcreation"),
    )

    def plus(a: str, *more: str) -> Column:
        parts = [F.col(a), *[F.col(m) for m in more]]
        total = _zero(parts[0])
        for p in parts[1:]:
            total = total + _zero(p)
        return F.when(F.coalesce(*parts).isNotNull(), total)

    inp = plus("_in", "_dread", "_dcreation")
    return agg.select(
        *keys,
        inp.alias("input_tokens"),
        F.col("_out").alias("output_tokens"),
        (_zero(inp) + _zero(F.col("_out"))).alias("total_tokens"),
        plus("_cached", "_dread").alias("cached_input_tokens"),
        plus("_creation", "_dcreation").alias("cache_creation_input_tokens"),
    )


# --- shapes ---------------------------------------------------------------------------------------


def usage_unpivot(df: DataFrame, ids: list[str]) -> DataFrame:
    """Long rows ``(ids, token_type, value)``; unset counters give no row, the total is no metric."""
    wide = df.select(*ids, *[F.col(c).cast("bigint").alias(t) for c, t in TOKEN_TYPES.items()])
    return wide.unpivot(ids, list(TOKEN_TYPES.values()), "token_type", "value").where("value IS NOT NULL")


_OPENAI_LIKE = ("OpenAI", "AzureOpenAI")
_ANTHROPIC_LIKE = ("Anthropic", "AWSAnthropic", "GCPAnthropic")

# Fixed values: (operation, backend schema) pairs that can be served, with the usage shape of the reply.
SUPPORTED = {
    ("chat", "OpenAI"): "chat",
    ("chat", "AzureOpenAI"): "chat",
    ("chat", "AWSBedrock"): "bedrock",
    ("chat", "AWSAnthropic"): "anthropic",
    ("chat", "GCPAnthropic"): "anthropic",
    ("chat", "GCPVertexAI"): "gemini",
    ("completion", "OpenAI"): "completions",
    ("embeddings", "OpenAI"): "embeddings",
    ("embeddings", "AzureOpenAI"): "embeddings",
    ("embeddings", "GCPVertexAI"): "gemini_embeddings",
    ("responses", "OpenAI"): "responses",
    ("messages", "Anthropic"): "anthropic",
    ("messages", "AWSAnthropic"): "anthropic",
    ("messages", "GCPAnthropic"): "anthropic",
    ("messages", "OpenAI"): "chat",
    ("rerank", "Cohere"): "rerank",
    ("speech", "OpenAI"): "none",
    ("image_generation", "OpenAI"): "image",
}


def supported_pair(operation: Column, schema: Column) -> Column:
    """Usage shape of a served pair, NULL for an unsupported one."""
    out: Column | None = None
    for (op, sc), shape in SUPPORTED.items():
        cond = (operation == op) & (schema == sc)
        out = F.when(cond, F.lit(shape)) if out is None else out.when(cond, F.lit(shape))
    assert out is not None
    return out


def normalize_usage(
    df: DataFrame,
    body: str = "response_body",
    operation: str = "operation",
    schema: str = "api_schema",
    stream: str | None = None,
) -> DataFrame:
    """Six counters for any response body: one parse, then a CASE by (operation, backend schema).

    Unsupported pairs get ``usage_error`` and no counters.
    """
    s = F.coalesce(F.col(stream), F.lit(False)) if stream else F.lit(False)
    out = df.withColumn("_body", parse_struct(body, BODY_DDL)).withColumn(
        "_shape", supported_pair(F.col(operation), F.col(schema))
    )
    b, shape = F.col("_body"), F.col("_shape")
    by_shape = {
        "chat": chat_counters(b["usage"]),
        "bedrock": bedrock_counters(b["usage"]),
        "anthropic": anthropic_counters(b["usage"]),
        "gemini": gemini_counters(b["usageMetadata"], s),
        "completions": completions_counters(b["usage"]),
        "embeddings": embeddings_counters(b["usage"]),
        "gemini_embeddings": gemini_embeddings_counters(b["predictions"]),
        "responses": responses_counters(b["usage"], s),
        "rerank": rerank_counters(b["meta"]),
        "image": image_counters(b["usage"]),
    }
    cols: Counters = {}
    for name in USAGE:
        case: Column | None = None
        for label, counters in by_shape.items():
            cond = shape == label
            case = F.when(cond, counters[name]) if case is None else case.when(cond, counters[name])
        assert case is not None
        cols[name] = case
    error = F.when(
        shape.isNull(), F.concat(F.lit("unsupported pair "), F.col(operation), F.lit("/"), F.col(schema))
    )
    return out.withColumns({**cols, "usage_error": error}).drop("_body", "_shape")
