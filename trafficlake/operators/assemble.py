"""Stream assembly: chunk rows to one row per response, and stream latency.

Text is concatenated in two levels - blocks of consecutive chunks first, then the blocks of a
response - so that no task holds all chunk rows of a very long stream at once. Everything that is not
text (roles, finish reasons, usage) uses order-free aggregates that combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import computed_once, exploded, non_empty, parse_struct

BLOCK = 4096

# Names of span events.
FIRST_TOKEN = "First Token Stream Event"
COMPLETED = "Response Completed Event"


def joined_text(order: str, text: str) -> Column:
    """Group aggregate: texts joined in order, NULLs skipped."""
    rows = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order), F.col(text)))))
    return F.array_join(F.transform(rows, lambda r: r[text]), "")


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: str, out: str = "text", block: int = BLOCK) -> DataFrame:
    """Concatenate ``text`` per key in ``order``, block by block."""
    blocks = (
        df.select(*keys, F.col(order).alias("_o"), F.col(text).alias("_t"))
        .withColumn("_b", F.floor(F.col("_o") / block))
        .groupBy(*keys, "_b")
        .agg(joined_text("_o", "_t").alias("_t"))
    )
    return blocks.groupBy(*keys).agg(joined_text("_b", "_t").alias(out))


def _last(value: Column, order: str) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


_USAGE = "struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>"
_CHAT_USAGE = (
    "struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint, "
    "prompt_tokens_details: struct<audio_tokens: bigint, cached_tokens: bigint, cache_creation_input_tokens: bigint>, "
    "completion_tokens_details: struct<audio_tokens: bigint, reasoning_tokens: bigint>>"
)
_CHAT_DDL = (
    "id string, model string, created bigint, service_tier string, system_fingerprint string, obfuscation string, "
    "choices array<struct<index: int, finish_reason: string, delta: struct<role: string, content: string, "
    f"annotations: array<string>>>>, usage {_CHAT_USAGE}"
)


def assemble_chat(chunks: DataFrame, key: str = "request_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Chat chunks to one response row.

    Content of the first choice is joined in order; role, finish reason, usage and obfuscation are the
    last ones set; id, model and creation time come from the first chunk; annotations are appended; the
    finish reason defaults to ``stop``.
    """
    c = chunks.select(key, F.col(order).alias("_o"), parse_struct(chunk, _CHAT_DDL).alias("_c"))
    first = F.try_element_at(F.col("_c.choices"), F.lit(1))
    rows = c.select(
        key,
        "_o",
        F.floor(F.col("_o") / BLOCK).alias("_b"),
        first["delta"]["content"].alias("_text"),
        non_empty(first["delta"]["role"]).alias("_role"),
        non_empty(first["finish_reason"]).alias("_finish"),
        first["delta"]["annotations"].alias("_ann"),
        F.col("_c.usage").alias("_usage"),
        non_empty("_c.obfuscation").alias("_obf"),
        F.struct(
            "_c.id", "_c.model", "_c.created", "_c.service_tier", "_c.system_fingerprint"
        ).alias("_meta"),
    )
    blocks = rows.groupBy(key, "_b").agg(
        joined_text("_o", "_text").alias("_text"),
        _last(F.col("_role"), "_o").alias("_role"),
        _last(F.col("_finish"), "_o").alias("_finish"),
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.size("_ann") > 0, F.struct("_o", "_ann")))), lambda x: x["_ann"]
            )
        ).alias("_ann"),
        _last(F.col("_usage"), "_o").alias("_usage"),
        _last(F.col("_obf"), "_o").alias("_obf"),
        F.min_by("_meta", "_o").alias("_meta"),
        F.count(F.lit(1)).alias("_n"),
    )
    whole = blocks.groupBy(key).agg(
        joined_text("_b", "_text").alias("content"),
        _last(F.col("_role"), "_b").alias("role"),
        _last(F.col("_finish"), "_b").alias("_finish"),
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.size("_ann") > 0, F.struct("_b", "_ann")))), lambda x: x["_ann"]
            )
        ).alias("annotations"),
        _last(F.col("_usage"), "_b").alias("usage"),
        _last(F.col("_obf"), "_b").alias("obfuscation"),
        F.min_by("_meta", "_b").alias("_meta"),
        F.sum("_n").alias("n_chunks"),
    )
    return whole.select(
        key, "_meta.id", "_meta.model", "_meta.created", "_meta.service_tier", "_meta.system_fingerprint",
        "role", "content", F.coalesce("_finish", F.lit("stop")).alias("finish_reason"),
        "annotations", "obfuscation", "usage", "n_chunks",
    )


def _completions(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """Per response ``_h`` (metadata, usage and choices of the first chunk) and ``_parts`` (text and finish reason by choice)."""
    ddl = (
        f"id string, model string, created bigint, usage {_USAGE}, "
        "choices array<struct<index: int, text: string, finish_reason: string>>"
    )
    c = chunks.select(key, F.col(order).alias("_o"), parse_struct(chunk, ddl).alias("_c"))
    number = lambda x: F.coalesce(x["index"], F.lit(0))
    none = F.lit(None).cast("string")
    # One pass: each chunk gives a row for its own fields (choice -1) and one per choice it carries.
    own = F.struct(
        F.lit(-1).alias("choice"), none.alias("text"), none.alias("finish"),
        F.struct("_c.id", "_c.model", "_c.created").alias("meta"), F.col("_c.usage").alias("usage"),
        F.transform("_c.choices", number).alias("choices"),
    )
    empty = F.lit(None)
    carried = F.transform(
        "_c.choices",
        lambda x: F.struct(
            number(x).alias("choice"), x["text"].alias("text"), non_empty(x["finish_reason"]).alias("finish"),
            empty.cast("struct<id: string, model: string, created: bigint>").alias("meta"),
            empty.cast(_USAGE).alias("usage"), empty.cast("array<int>").alias("choices"),
        ),
    )
    rows = exploded(c, [key, "_o"], F.concat(F.array(own), F.coalesce(carried, F.expr("array()"))), "_i", "_x").select(
        key, "_o", F.floor(F.col("_o") / BLOCK).alias("_b"), "_x.*"
    )

    def combine(df: DataFrame, by: list[str], pos: str) -> DataFrame:
        return df.groupBy(*by).agg(
            joined_text(pos, "text").alias("text"),
            _last(F.col("finish"), pos).alias("finish"),
            _last(F.col("meta"), pos).alias("meta"),
            _last(F.col("usage"), pos).alias("usage"),
            F.min_by("choices", F.when(F.col("choice") < 0, F.col(pos))).alias("choices"),
        )

    per_choice = combine(combine(rows, [key, "choice", "_b"], "_o"), [key, "choice"], "_b")
    head = F.when(F.col("choice") < 0, F.lit(1))
    return per_choice.groupBy(key).agg(
        F.max_by(F.struct("meta", "usage", "choices"), head).alias("_h"),
        F.collect_list(F.when(F.col("choice") >= 0, F.struct("choice", "text", "finish"))).alias("_parts"),
    )


def _part(choice: Column) -> Column:
    return F.get(F.filter("_parts", lambda p: p["choice"] == choice), F.lit(0))


def assemble_completions(chunks: DataFrame, key: str = "request_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Completion chunks to one row per choice of the first chunk.

    Text and finish reason per choice index (0 when absent); id, creation time, model and usage are
    those of the last chunk (usage: last one given).
    """
    whole = _completions(chunks, key, order, chunk)
    return exploded(whole, [key, "_h", "_parts"], F.col("_h.choices"), "_i", "choice").select(
        key, "choice", "_h.meta.id", "_h.meta.model", "_h.meta.created", "_h.usage", _part(F.col("choice")).alias("_p"),
    ).select(
        key, "choice", "id", "model", "created", "usage", F.coalesce("_p.text", F.lit("")).alias("text"),
        F.col("_p.finish").alias("finish_reason"),
    )


def assemble_responses(events: DataFrame, key: str = "request_id", order: str = "seq", data: str = "data") -> DataFrame:
    """The completion event of a responses stream carries the whole response."""
    done = events.where(F.get_json_object(data, "$.type") == "response.completed")
    return done.groupBy(key).agg(F.max_by(F.get_json_object(data, "$.response"), F.col(order)).alias("response_body"))


def assemble_messages(events: DataFrame, key: str = "request_id", order: str = "seq", data: str = "data") -> DataFrame:
    """Message stream events to one row per response with its ordered content blocks.

    A block starts with its start event; text, tool input and thinking pieces are appended, the last
    signature is kept, and tool input is only taken when it is valid JSON at the block's end.
    """
    ddl = (
        "type string, index int, message struct<id: string, model: string, role: string, "
        "usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>, "
        "content_block struct<type: string, text: string, id: string, name: string, thinking: string, signature: string>, "
        "delta struct<text: string, partial_json: string, thinking: string, signature: string, "
        "stop_reason: string, stop_sequence: string>, usage struct<output_tokens: bigint>"
    )
    e = computed_once(events.select(key, F.col(order).alias("_o"), F.col(data).alias("_d")), {"_e": parse_struct("_d", ddl)})
    kind = F.col("_e.type")
    start, delta = kind == "message_start", kind == "message_delta"
    # One pass: message events are block -1, content events belong to their block.
    rows = e.where(start | delta | kind.startswith("content_block_")).select(
        key,
        F.when(start | delta, F.lit(-1)).otherwise(F.coalesce(F.col("_e.index"), F.lit(0))).alias("idx"),
        "_o",
        F.floor(F.col("_o") / BLOCK).alias("_b"),
        F.when(start, F.col("_e.message")).alias("_m"),
        F.when(delta, F.coalesce(F.col("_e.usage.output_tokens"), F.lit(0))).alias("_out"),
        F.when(delta, F.col("_e.delta.stop_reason")).alias("_reason"),
        F.when(kind == "content_block_start", F.col("_e.content_block")).alias("_start"),
        F.coalesce("_e.content_block.text", "_e.delta.text").alias("_text"),
        F.col("_e.delta.partial_json").alias("_json"),
        F.coalesce("_e.content_block.thinking", "_e.delta.thinking").alias("_think"),
        non_empty(F.coalesce("_e.delta.signature", "_e.content_block.signature")).alias("_sig"),
        (kind == "content_block_stop").alias("_stop"),
    )

    def combine(df: DataFrame, by: list[str], pos: str) -> DataFrame:
        return df.groupBy(*by).agg(
            *[joined_text(pos, c).alias(c) for c in ("_text", "_json", "_think")],
            *[_last(F.col(c), pos).alias(c) for c in ("_m", "_out", "_reason", "_start", "_sig")],
            F.bool_or("_stop").alias("_stop"),
        )

    kind_of = F.col("_start.type")
    block = F.struct(
        "idx",
        kind_of.alias("type"),
        F.when(kind_of == "text", F.col("_text")).alias("text"),
        F.col("_start.id").alias("tool_id"),
        F.col("_start.name").alias("tool_name"),
        F.when(F.col("_stop") & F.try_parse_json("_json").isNotNull(), F.col("_json")).alias("tool_input"),
        F.when(kind_of == "thinking", F.col("_think")).alias("thinking"),
        F.when(kind_of == "thinking", F.col("_sig")).alias("signature"),
    )
    head = F.when(F.col("idx") < 0, F.lit(1))
    whole = combine(combine(rows, [key, "idx", "_b"], "_o"), [key, "idx"], "_b").groupBy(key).agg(
        F.max_by(F.struct("_m", "_out", "_reason"), head).alias("_h"),
        F.array_sort(F.collect_list(F.when((F.col("idx") >= 0) & kind_of.isNotNull(), block))).alias("content"),
    )
    return whole.where("_h IS NOT NULL").select(
        key,
        F.col("_h._m.id").alias("id"),
        F.col("_h._m.model").alias("model"),
        F.col("_h._m.role").alias("role"),
        F.col("_h._m.usage.input_tokens").alias("input_tokens"),
        F.coalesce("_h._out", "_h._m.usage.output_tokens").alias("output_tokens"),
        F.col("_h._m.usage.cache_read_input_tokens").alias("cache_read_input_tokens"),
        F.col("_h._m.usage.cache_creation_input_tokens").alias("cache_creation_input_tokens"),
        F.col("_h._reason").alias("stop_reason"),
        "content",
    )


# --- folded streams as response bodies --------------------------------------------------------------


def _chat_body(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    message = F.struct("role", "content", F.when(F.size("annotations") > 0, F.col("annotations")).alias("annotations"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.col("finish_reason"))
    return assemble_chat(chunks, key, order, data).select(
        key,
        F.to_json(
            F.struct(
                "id", F.lit("chat.completion.chunk").alias("object"), "created", "model", "service_tier", "system_fingerprint", "obfuscation",
                F.array(choice).alias("choices"), "usage",
            )
        ).alias("response_body"),
    )


def _completion_body(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    def choice(n: Column) -> Column:
        return F.struct(n.alias("index"), F.coalesce(_part(n)["text"], F.lit("")).alias("text"), _part(n)["finish"].alias("finish_reason"))

    return _completions(chunks, key, order, data).select(
        key, F.to_json(F.struct("_h.meta.id", "_h.meta.created", "_h.meta.model", F.transform("_h.choices", choice).alias("choices"), "_h.usage")).alias("response_body")
    )


def _messages_body(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    def block(i: Column) -> Column:
        # An index without a start is an empty block, so that later ones keep their place.
        b = F.get(F.filter("content", lambda x: x["idx"] == i), F.lit(0))
        return F.struct(
            b["type"].alias("type"), b["text"].alias("text"), b["thinking"].alias("thinking"), b["signature"].alias("signature"),
            b["tool_id"].alias("id"), b["tool_name"].alias("name"), F.try_parse_json(b["tool_input"]).alias("input"),
        )

    last = F.array_max(F.transform("content", lambda x: x["idx"]))
    content = F.when(last.isNotNull(), F.transform(F.sequence(F.lit(0), last), block))
    usage = F.struct("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    return assemble_messages(chunks, key, order, data).select(
        key, F.to_json(F.struct("id", "model", "role", content.alias("content"), "stop_reason", usage.alias("usage"))).alias("response_body")
    )


_BODIES = {"chat": _chat_body, "completion": _completion_body, "responses": assemble_responses, "messages": _messages_body}
STREAM_OPERATIONS = tuple(_BODIES)


def stream_bodies(
    chunks: DataFrame, key: str = "request_id", order: str = "seq", data: str = "chunk", operation: str = "operation",
    operations: Sequence[str] = STREAM_OPERATIONS,
) -> DataFrame:
    """Chunk streams of several operations folded to ``(key, response_body)``, the body an unstreamed answer would have.

    Each operation in ``operations`` is one branch that reads its own chunks only (a table partitioned by operation is read
    once in all); other chunks give no row. A responses stream that never completed has no body.
    """
    parts = [_BODIES[name](chunks.where(F.col(operation) == name), key, order, data) for name in operations]
    return reduce(DataFrame.unionByName, parts)


def stream_events(
    chunks: DataFrame, key: str = "request_id", order: str = "seq", data: str = "chunk", operation: str = "operation", recv_ms: str = "recv_ms"
) -> DataFrame:
    """Events of each stream's span: ``(key, events)``, an array of ``(name, at_ms)`` by time.

    The first chunk of any kind is an event, and so is the completion of a responses stream.
    """
    done = (F.col(operation) == "responses") & (F.get_json_object(data, "$.type") == "response.completed")
    # Only responses chunks are looked into, before the aggregation, so that a union by operation does not build the others' data.
    chunks = chunks.where(F.col(operation).isin(*STREAM_OPERATIONS)).select(key, F.col(order), F.col(recv_ms), F.when(done, F.col(recv_ms)).alias("_done_ms"))
    first = F.array(F.struct(F.lit(FIRST_TOKEN).alias("name"), F.col("_first").alias("at_ms")))
    completed = F.transform(F.array_sort("_done"), lambda x: F.struct(F.lit(COMPLETED).alias("name"), x.alias("at_ms")))
    grouped = chunks.groupBy(key).agg(F.min_by(recv_ms, order).alias("_first"), F.collect_list("_done_ms").alias("_done"))
    return grouped.select(key, F.concat(first, completed).alias("events"))


def stream_latency(
    chunks: DataFrame, keys: list[str] | None = None, order: str = "seq", recv_ms: str = "recv_ms",
    tokens: str = "output_tokens", end: str = "end_of_stream",
) -> DataFrame:
    """Time to first token and time per output token of each stream.

    ``recv_ms`` counts from the request start and chunks are numbered from 0. The first chunk of any
    kind sets TTFT and its tokens are not looked at; at the end of the stream the remaining time is
    divided by one less than the highest cumulative token count, if that exceeds one. The millisecond
    view truncates TTFT to whole milliseconds and keeps the inter-token latency as it is.
    """
    keys = keys or ["request_id"]
    later = F.col(order) > 0
    agg = chunks.groupBy(*keys).agg(
        (F.min(recv_ms) / 1000.0).alias("ttft_s"),
        (F.max(F.when(later & F.col(end), F.col(recv_ms))) / 1000.0).alias("_end_s"),
        F.max(F.when(later, F.col(tokens))).alias("_tokens"),
    )
    tpot = F.when(F.col("_tokens") > 1, (F.col("_end_s") - F.col("ttft_s")) / (F.col("_tokens") - 1))
    return agg.select(
        *keys,
        "ttft_s",
        tpot.alias("tpot_s"),
        F.floor(F.round(F.col("ttft_s") * 1000, 6)).cast("bigint").alias("ttft_ms"),
        (tpot * 1000).alias("itl_ms"),
    )
