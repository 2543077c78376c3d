"""Trace attributes: bodies to flat, indexed attribute maps, spans, and the way back.

A request's messages, parts and tools sit in its own row, so the maps are built by array transforms in
place: no explode, no regrouping, no shuffle. Visibility flags are applied afterwards
(``filtering.apply_trace_visibility``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exploded, json_text, let, map_case, non_empty, parse_struct
from .assemble import STREAM_OPERATIONS, stream_bodies, stream_events
from .filtering import MAX_IMAGE_URL, TRACE_PLACEHOLDER, trimmed_image
from .parse import MCP_SPAN_NAMES, http_error_message, http_error_type, mcp_error_label
from .vectors import decode_embedding_list

# Attribute keys.
SPAN_KIND = "openinference.span.kind"
SYSTEM = "llm.system"
MODEL = "llm.model_name"
PARAMETERS = "llm.invocation_parameters"
INPUT_VALUE, INPUT_MIME = "input.value", "input.mime_type"
OUTPUT_VALUE, OUTPUT_MIME = "output.value", "output.mime_type"
INPUT_MESSAGES, OUTPUT_MESSAGES = "llm.input_messages", "llm.output_messages"
TOOLS, PROMPTS, CHOICES = "llm.tools", "llm.prompts", "llm.choices"
EMBEDDING_MODEL = "embedding.model_name"
EMBEDDING_PARAMETERS = "embedding.invocation_parameters"
EMBEDDINGS = "embedding.embeddings"
RERANK_IN, RERANK_OUT = "reranker.input_documents", "reranker.output_documents"
TOKENS_PROMPT, TOKENS_COMPLETION, TOKENS_TOTAL = (
    "llm.token_count.prompt",
    "llm.token_count.completion",
    "llm.token_count.total",
)
TOKENS_CACHE_READ = "llm.token_count.prompt_details.cache_read"
TOKENS_CACHE_WRITE = "llm.token_count.prompt_details.cache_creation"
TOKENS_PROMPT_AUDIO = "llm.token_count.prompt_details.audio"
TOKENS_REASONING = "llm.token_count.completion_details.reasoning"
TOKENS_COMPLETION_AUDIO = "llm.token_count.completion_details.audio"
JSON_MIME = "application/json"
# Span name per operation, MCP protocol constants.
SPAN_NAMES = {
    "chat": "ChatCompletion",
    "completion": "Completion",
    "embeddings": "CreateEmbeddings",
    "responses": "Responses",
    "messages": "Message",
    "rerank": "Rerank",
    "image_generation": "ImagesResponse",
    "speech": "AudioSpeech",
}
MCP_PROTOCOL_VERSION, MCP_TRANSPORT = "2025-06-18", "http"

_ENTRY = "array<struct<key: string, value: string>>"


def _name(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _kv(key: str | Column, value: str | Column) -> Column:
    k = F.lit(key) if isinstance(key, str) else key
    v = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.struct(k.alias("key"), v.alias("value"))


def _none() -> Column:
    return F.expr("array()").cast(_ENTRY)


def _all(nested: Column) -> Column:
    """Flatten entries per item; a missing list gives none."""
    return F.coalesce(F.flatten(nested), _none())


def as_map(*groups: Column) -> Column:
    """Attribute map of all entries that have a value."""
    entries = F.filter(F.concat(*[F.coalesce(g, _none()) for g in groups]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def merge_maps(base: Column, extra: Column) -> Column:
    """Attributes set later win."""
    return F.when(extra.isNull(), base).otherwise(
        F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    )


def without_keys(body: Column, *names: str) -> Column:
    """JSON object text without some top-level keys."""
    fields = F.from_json(body, "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(*names)))


def _positive(key: str, value: Column) -> Column:
    return _kv(key, F.when(value > 0, value))


def _head(kind: str, system: str | None, body: Column) -> list[Column]:
    out = [_kv(SPAN_KIND, kind), _kv(INPUT_VALUE, body), _kv(INPUT_MIME, JSON_MIME)]
    return out + ([_kv(SYSTEM, system)] if system else [])


def _tools(tools: Column) -> Column:
    return F.transform(tools, lambda t, i: _kv(_name(f"{TOOLS}.", i, ".tool.json_schema"), t))


def _part_pair(prefix: str, i: Column, j: Column, field: str, value: Column, kind: str) -> Column:
    base = _name(f"{prefix}.", i, ".message.contents.", j, ".message_content.")
    return F.array(_kv(F.concat(base, F.lit(field)), value), _kv(F.concat(base, F.lit("type")), F.when(value.isNotNull(), kind)))


def _messages_attrs(body: Column, images: bool, max_image: int = MAX_IMAGE_URL) -> Column:
    """Roles and contents of request messages; the content is text or a list of parts."""
    as_text = parse_struct(body, "messages array<struct<role: string, content: string>>")["messages"]
    as_list = parse_struct(
        body,
        "messages array<struct<role: string, content: array<struct<type: string, text: string, image_url: struct<url: string>>>>>",
    )["messages"]

    def parts(m: Column, i: Column) -> Column:
        def one(p: Column, j: Column) -> Column:
            text = _part_pair(INPUT_MESSAGES, i, j, "text", p["text"], "text")
            out = F.when(p["type"] == "text", text)
            if images:
                url = trimmed_image(non_empty(p["image_url"]["url"]), max_image)
                shown = (p["type"] == "image_url") & (m["role"] == "user")
                out = out.when(shown, _part_pair(INPUT_MESSAGES, i, j, "image.image.url", url, "image"))
            return out.otherwise(_none())

        return _all(F.transform(m["content"], one))

    def one(pair: Column, i: Column) -> Column:
        plain, listed = pair["t"], pair["l"]
        text = F.when(listed["content"].isNull(), non_empty(plain["content"]))
        return F.concat(
            F.array(
                _kv(_name(f"{INPUT_MESSAGES}.", i, ".message.role"), plain["role"]),
                _kv(_name(f"{INPUT_MESSAGES}.", i, ".message.content"), text),
            ),
            parts(listed, i),
        )

    pairs = F.zip_with(as_text, as_list, lambda t, b: F.struct(t.alias("t"), b.alias("l")))
    return _all(F.transform(pairs, one))


# --- requests -------------------------------------------------------------------------------------


def chat_request(body: Column) -> Column:
    def build(req: Column) -> Column:
        return as_map(
            F.array(*_head("LLM", "openai", body), _kv(MODEL, req["model"]), _kv(PARAMETERS, without_keys(body, "messages", "tools"))),
            _messages_attrs(body, images=True),
            _tools(req["tools"]),
        )

    return let(parse_struct(body, "model string, tools array<string>"), build)


def _texts(body: Column, name: str, plain: Column) -> Column:
    """A text or a list of texts as a list; lists of token ids give none."""
    many = F.from_json(body, f"{name} array<string>")[name]
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant"))
    return let(many, lambda m: F.when(m.isNull(), F.array(plain)).when(kind == "ARRAY<STRING>", m))


def embeddings_request(body: Column) -> Column:
    def build(req: Column) -> Column:
        texts = _texts(body, "input", req["input"])
        params = F.to_json(
            F.struct(*[req[c].alias(c) for c in ("model", "encoding_format", "dimensions", "user")])
        )
        return as_map(
            F.array(*_head("EMBEDDING", None, body), _kv(EMBEDDING_PARAMETERS, params)),
            F.transform(texts, lambda x, i: _kv(_name(f"{EMBEDDINGS}.", i, ".embedding.text"), x)),
        )

    return let(parse_struct(body, "model string, encoding_format string, dimensions int, user string, input string"), build)


def completions_request(body: Column) -> Column:
    def build(req: Column) -> Column:
        texts = _texts(body, "prompt", req["prompt"])
        return as_map(
            F.array(*_head("LLM", "openai", body), _kv(MODEL, req["model"]), _kv(PARAMETERS, without_keys(body, "prompt"))),
            F.transform(texts, lambda x, i: _kv(_name(f"{PROMPTS}.", i, ".prompt.text"), x)),
        )

    return let(parse_struct(body, "model string, prompt string"), build)


_ITEM = (
    "type string, role string, id string, call_id string, name string, arguments string, input string, content string, "
    "summary array<struct<type: string, text: string>>"
)
_ITEM_PARTS = "array<struct<type: string, text: string, refusal: string, image_url: string>>"


def _item_attrs(item: Column, i: Column, output: bool) -> Column:
    """Attributes of one typed item of a responses request (input) or response (output)."""
    prefix = OUTPUT_MESSAGES if output else INPUT_MESSAGES

    def build(p: Column, parts: Column) -> Column:
        kind = F.coalesce(p["type"], F.when(p["role"].isNotNull(), F.lit("message")))

        def field(suffix: str, value: str | Column) -> Column:
            return _kv(_name(f"{prefix}.", i, f".{suffix}"), value)

        def call(identity: Column, name: Column | None = None, arguments: Column | None = None) -> list[Column]:
            base = "message.tool_calls.0.tool_call."
            out = [field(base + "id", identity)]
            if name is not None:
                out.append(field(base + "function.name", name))
            if arguments is not None:
                out.append(field(base + "function.arguments", arguments))
            return out

        assistant, tool = field("message.role", "assistant"), field("message.role", "tool")
        output_json = F.to_json(F.try_variant_get(F.try_parse_json(item), "$.output", "variant"))
        answer = F.array(tool, field("tool_call.id", p["call_id"]), field("message.content", output_json))

        def part(x: Column, j: Column) -> Column:
            return (
                F.when(x["type"].isin("input_text", "output_text"), _part_pair(prefix, i, j, "text", x["text"], "text"))
                .when(x["type"] == "refusal", _part_pair(prefix, i, j, "text", x["refusal"], "text"))
                .when(
                    (x["type"] == "input_image") & F.lit(not output),
                    _part_pair(prefix, i, j, "image.image.url", x["image_url"], "image"),
                )
                .otherwise(_none())
            )

        # Replayed and produced assistant messages with plain text count as one text part.
        produced = F.lit(output) | (p["id"].isNotNull() & (p["role"] == "assistant"))
        plain = F.when(
            produced, _part_pair(prefix, i, F.lit(0), "text", p["content"], "text")
        ).otherwise(F.array(field("message.content", p["content"])))
        message = F.concat(
            F.array(field("message.role", p["role"])),
            F.when(parts.isNotNull(), _all(F.transform(parts, part))).otherwise(plain),
        )
        thoughts = p["summary"] if output else F.transform(
            p["summary"], lambda s: F.when(s["type"] == "summary_text", s)
        )
        reasoning = _all(F.transform(thoughts, lambda s, j: _part_pair(prefix, i, j, "text", s["text"], "text")))
        if not output:
            reasoning = F.concat(F.array(assistant), reasoning)
        wrapped = F.to_json(F.struct(p["input"].alias("input")))
        computer = F.array(
            assistant, field("message.tool_calls.0.message.role", "tool"), *call(p["call_id"])
        )
        out = (
            F.when(kind == "message", message)
            .when(kind.isin("file_search_call", "web_search_call"), F.array(assistant, *call(p["id"], p["type"])))
            .when(kind == "computer_call", computer)
            .when(kind == "function_call", F.array(assistant, *call(p["call_id"], p["name"], p["arguments"])))
            .when(kind == "custom_tool_call", F.array(assistant, *call(p["call_id"], p["name"], wrapped)))
            .when(kind == "reasoning", reasoning)
        )
        if not output:
            out = out.when(
                kind.isin("function_call_output", "computer_call_output", "custom_tool_call_output"), answer
            )
        return out.otherwise(_none())

    parts_of = F.from_json(item, f"content {_ITEM_PARTS}")["content"]
    return let(F.from_json(item, _ITEM), lambda p: let(parts_of, lambda parts: build(p, parts)))


def responses_request(body: Column, max_image: int = MAX_IMAGE_URL) -> Column:
    def build(req: Column) -> Column:
        items = F.from_json(body, "input array<string>")["input"]
        said = non_empty(req["instructions"])
        first = F.when(said.isNotNull(), 1).otherwise(0)
        system = F.when(
            said.isNotNull(),
            F.array(_kv(f"{INPUT_MESSAGES}.0.message.role", "system"), _kv(f"{INPUT_MESSAGES}.0.message.content", said)),
        )
        plain = F.array(
            _kv(_name(f"{INPUT_MESSAGES}.", first, ".message.role"), F.lit("user")),
            _kv(_name(f"{INPUT_MESSAGES}.", first, ".message.content"), req["input"]),
        )
        listed = _all(F.transform(items, lambda x, i: _item_attrs(x, i + first, output=False)))
        # Long inline images are replaced in the recorded body as well.
        shown = F.regexp_replace(
            body, '"data:image/[^",]*base64[^"]{' + str(max_image) + ',}"', f'"{TRACE_PLACEHOLDER}"'
        )
        return as_map(
            F.array(
                *_head("LLM", "openai", shown), _kv(MODEL, non_empty(req["model"])),
                _kv(PARAMETERS, without_keys(body, "input", "tools", "instructions")),
            ),
            system,
            F.when(items.isNotNull(), listed).when(req["input"].isNotNull(), plain),
            _tools(req["tools"]),
        )

    return let(parse_struct(body, "model string, instructions string, input string, tools array<string>"), build)


def messages_request(body: Column) -> Column:
    def build(req: Column) -> Column:
        return as_map(
            F.array(*_head("LLM", "anthropic", body), _kv(MODEL, req["model"]), _kv(PARAMETERS, without_keys(body, "messages", "tools"))),
            _messages_attrs(body, images=False),
            _tools(req["tools"]),
        )

    return let(parse_struct(body, "model string, tools array<string>"), build)


def rerank_request(body: Column) -> Column:
    def build(req: Column) -> Column:
        return as_map(
            F.array(
                *_head("RERANKER", "cohere", body),
                _kv("reranker.model_name", non_empty(req["model"])),
                _kv("reranker.top_k", req["top_n"]),
                _kv("reranker.query", non_empty(req["query"])),
            ),
            F.transform(req["documents"], lambda d, i: _kv(_name(f"{RERANK_IN}.", i, ".document.content"), non_empty(d))),
        )

    return let(parse_struct(body, "model string, query string, top_n int, documents array<string>"), build)


def image_request(body: Column) -> Column:
    return as_map(F.array(*_head("LLM", "openai", body), _kv(PARAMETERS, body)))


def speech_request(body: Column) -> Column:
    def build(req: Column) -> Column:
        shown = F.to_json(
            F.struct(*[req[c].alias(c) for c in ("input", "instructions", "response_format", "speed", "voice")]),
            {"ignoreNullFields": "false"},
        )
        return as_map(F.array(*_head("LLM", "openai", shown), _kv(MODEL, non_empty(req["model"])), _kv(PARAMETERS, body)))

    return let(parse_struct(
        body, "model string, input string, voice string, response_format string, speed double, instructions string"
    ), build)


# --- responses ------------------------------------------------------------------------------------


def chat_response(body: Column) -> Column:
    def build(r: Column) -> Column:
        def choice(c: Column, i: Column) -> Column:
            def call(t: Column, j: Column) -> Column:
                base = _name(f"{OUTPUT_MESSAGES}.", i, ".message.tool_calls.", j, ".tool_call.")
                return F.array(
                    _kv(F.concat(base, F.lit("id")), t["id"]),
                    _kv(F.concat(base, F.lit("function.name")), t["function"]["name"]),
                    _kv(F.concat(base, F.lit("function.arguments")), t["function"]["arguments"]),
                )

            m = c["message"]
            return F.concat(
                F.array(
                    _kv(_name(f"{OUTPUT_MESSAGES}.", i, ".message.role"), m["role"]),
                    _kv(_name(f"{OUTPUT_MESSAGES}.", i, ".message.content"), non_empty(m["content"])),
                ),
                _all(F.transform(m["tool_calls"], call)),
            )

        u = r["usage"]
        pd, cd = u["prompt_tokens_details"], u["completion_tokens_details"]
        with_pd, with_cd = (u["prompt_tokens"] > 0) & pd.isNotNull(), (u["completion_tokens"] > 0) & cd.isNotNull()

        def detail(key: str, cond: Column, value: Column) -> Column:
            return _kv(key, F.when(cond, F.coalesce(value, F.lit(0))))

        return as_map(
            F.array(
                _kv(MODEL, r["model"]), _kv(OUTPUT_MIME, JSON_MIME), _kv(OUTPUT_VALUE, body),
                _positive(TOKENS_PROMPT, u["prompt_tokens"]), _positive(TOKENS_COMPLETION, u["completion_tokens"]),
                _positive(TOKENS_TOTAL, u["total_tokens"]),
                detail(TOKENS_PROMPT_AUDIO, with_pd, pd["audio_tokens"]), detail(TOKENS_CACHE_READ, with_pd, pd["cached_tokens"]),
                detail(TOKENS_CACHE_WRITE, with_pd, pd["cache_creation_input_tokens"]),
                detail(TOKENS_COMPLETION_AUDIO, with_cd, cd["audio_tokens"]), detail(TOKENS_REASONING, with_cd, cd["reasoning_tokens"]),
            ),
            _all(F.transform(r["choices"], choice)),
        )

    return let(parse_struct(
        body,
        "model string, choices array<struct<message: struct<role: string, content: string, tool_calls: array<struct<id: string, "
        "function: struct<name: string, arguments: string>>>>>>, usage struct<prompt_tokens: bigint, completion_tokens: bigint, "
        "total_tokens: bigint, prompt_tokens_details: struct<audio_tokens: bigint, cached_tokens: bigint, cache_creation_input_tokens: bigint>, "
        "completion_tokens_details: struct<audio_tokens: bigint, reasoning_tokens: bigint>>",
    ), build)


def embeddings_response(body: Column) -> Column:
    r = parse_struct(
        body, "model string, data array<struct<embedding: string>>, usage struct<prompt_tokens: bigint, total_tokens: bigint>"
    )
    vectors = decode_embedding_list(F.transform(r["data"], lambda d: d["embedding"]))
    return as_map(
        F.array(
            _kv(EMBEDDING_MODEL, r["model"]), _kv(OUTPUT_MIME, JSON_MIME), _kv(OUTPUT_VALUE, body),
            _positive(TOKENS_PROMPT, r["usage"]["prompt_tokens"]), _positive(TOKENS_TOTAL, r["usage"]["total_tokens"]),
        ),
        F.transform(vectors, lambda v, i: _kv(_name(f"{EMBEDDINGS}.", i, ".embedding.vector"), F.when(F.size(v) > 0, F.to_json(v)))),
    )


def completions_response(body: Column) -> Column:
    def build(r: Column) -> Column:
        u = r["usage"]
        return as_map(
            F.array(
                _kv(MODEL, r["model"]), _kv(OUTPUT_MIME, JSON_MIME), _kv(OUTPUT_VALUE, body),
                _positive(TOKENS_PROMPT, u["prompt_tokens"]), _positive(TOKENS_COMPLETION, u["completion_tokens"]),
                _positive(TOKENS_TOTAL, u["total_tokens"]),
            ),
            F.transform(r["choices"], lambda c, i: _kv(_name(f"{CHOICES}.", i, ".completion.text"), c["text"])),
        )

    return let(parse_struct(
        body,
        "model string, choices array<struct<text: string>>, usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>",
    ), build)


def responses_response(body: Column) -> Column:
    def build(r: Column) -> Column:
        u = r["usage"]
        return as_map(
            F.array(
                _kv(OUTPUT_MIME, JSON_MIME), _kv(MODEL, non_empty(r["model"])), _kv(OUTPUT_VALUE, body),
                _positive(TOKENS_PROMPT, u["input_tokens"]), _positive(TOKENS_COMPLETION, u["output_tokens"]),
                _positive(TOKENS_TOTAL, u["total_tokens"]),
                _positive(TOKENS_CACHE_READ, u["input_tokens_details"]["cached_tokens"]),
                _positive(TOKENS_CACHE_WRITE, u["input_tokens_details"]["cache_creation_input_tokens"]),
                _positive(TOKENS_REASONING, u["output_tokens_details"]["reasoning_tokens"]),
            ),
            _all(F.transform(r["output"], lambda x, i: _item_attrs(x, i, output=True))),
        )

    return let(parse_struct(
        body,
        "model string, output array<string>, usage struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, "
        "input_tokens_details: struct<cached_tokens: bigint, cache_creation_input_tokens: bigint>, "
        "output_tokens_details: struct<reasoning_tokens: bigint>>",
    ), build)


def messages_response(body: Column) -> Column:
    def build(r: Column) -> Column:
        def block(b: Column, i: Column) -> Column:
            call = _name(f"{OUTPUT_MESSAGES}.", i, ".message.tool_calls.0.tool_call.")
            tool = b["type"] == "tool_use"
            return F.array(
                _kv(_name(f"{OUTPUT_MESSAGES}.", i, ".message.role"), r["role"]),
                _kv(_name(f"{OUTPUT_MESSAGES}.", i, ".message.content"), F.when(b["type"] == "text", b["text"])),
                _kv(F.concat(call, F.lit("id")), F.when(tool, b["id"])),
                _kv(F.concat(call, F.lit("function.name")), F.when(tool, b["name"])),
                _kv(F.concat(call, F.lit("function.arguments")), F.when(tool, b["input"])),
            )

        def n(c: str) -> Column:
            return F.coalesce(r["usage"][c], F.lit(0))

        read, creation = n("cache_read_input_tokens"), n("cache_creation_input_tokens")
        prompt = n("input_tokens") + read + creation
        return as_map(
            F.array(
                _kv(MODEL, r["model"]), _kv(OUTPUT_MIME, JSON_MIME), _kv(OUTPUT_VALUE, body),
                _kv(TOKENS_PROMPT, prompt), _kv(TOKENS_CACHE_READ, read), _kv(TOKENS_CACHE_WRITE, creation),
                _kv(TOKENS_COMPLETION, n("output_tokens")), _kv(TOKENS_TOTAL, prompt + n("output_tokens")),
            ),
            _all(F.transform(r["content"], block)),
        )

    return let(parse_struct(
        body,
        "model string, role string, content array<struct<type: string, text: string, id: string, name: string, input: string>>, "
        "usage struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>",
    ), build)


def rerank_response(body: Column) -> Column:
    def build(r: Column) -> Column:
        inp, out = (F.floor(r["meta"]["tokens"][c]).cast("bigint") for c in ("input_tokens", "output_tokens"))
        total = F.coalesce(inp, F.lit(0)) + F.coalesce(out, F.lit(0))
        return as_map(
            F.array(
                _kv(OUTPUT_MIME, JSON_MIME), _kv(OUTPUT_VALUE, body), _kv(TOKENS_PROMPT, inp), _positive(TOKENS_TOTAL, total)
            ),
            F.transform(r["results"], lambda x, i: _kv(_name(f"{RERANK_OUT}.", i, ".document.score"), x["relevance_score"])),
        )

    return let(parse_struct(
        body,
        "results array<struct<relevance_score: double>>, meta struct<tokens: struct<input_tokens: double, output_tokens: double>>",
    ), build)


# --- DataFrame operators --------------------------------------------------------------------------


def _attrs(df: DataFrame, request, response, request_body: str, response_body: str | None, out: str) -> DataFrame:
    attrs = request(F.col(request_body)) if request else None
    if response_body is not None and response_body in df.columns and response:
        extra = F.when(F.col(response_body).isNotNull(), response(F.col(response_body)))
        tmp = df.withColumn("_extra", extra)
        return tmp.withColumn(out, F.col("_extra") if attrs is None else merge_maps(attrs, F.col("_extra"))).drop("_extra")
    return df.withColumn(out, attrs)


def chat_request_attrs(df: DataFrame, body: str = "request_body", out: str = "attributes") -> DataFrame:
    return df.withColumn(out, chat_request(F.col(body)))


def chat_response_attrs(df: DataFrame, body: str = "response_body", out: str = "attributes") -> DataFrame:
    return df.withColumn(out, chat_response(F.col(body)))


def embeddings_attrs(df: DataFrame, request: str = "request_body", response: str = "response_body", out: str = "attributes") -> DataFrame:
    """Texts only for string inputs; token ids are never decoded, vectors are."""
    return _attrs(df, embeddings_request, embeddings_response, request, response, out)


def completions_attrs(df: DataFrame, request: str = "request_body", response: str = "response_body", out: str = "attributes") -> DataFrame:
    return _attrs(df, completions_request, completions_response, request, response, out)


def responses_attrs(df: DataFrame, request: str = "request_body", response: str = "response_body", out: str = "attributes") -> DataFrame:
    return _attrs(df, responses_request, responses_response, request, response, out)


def messages_attrs(df: DataFrame, request: str = "request_body", response: str = "response_body", out: str = "attributes") -> DataFrame:
    return _attrs(df, messages_request, messages_response, request, response, out)


def rerank_attrs(df: DataFrame, request: str = "request_body", response: str = "response_body", out: str = "attributes") -> DataFrame:
    return _attrs(df, rerank_request, rerank_response, request, response, out)


def image_speech_attrs(df: DataFrame, body: str = "request_body", operation: str = "operation", out: str = "attributes") -> DataFrame:
    b = F.col(body)
    return df.withColumn(
        out,
        F.when(F.col(operation) == "image_generation", image_request(b)).when(F.col(operation) == "speech", speech_request(b)),
    )


def mcp_attrs(df: DataFrame, method: str = "method", params: str = "params", request_id: str = "id", out: str = "attributes") -> DataFrame:
    """Attributes of an MCP request: protocol constants plus the fields its method defines."""
    m = F.col(method)

    def p(path: str) -> Column:
        return json_text(params, path)

    def when(methods: Sequence[str], value: Column) -> Column:
        return F.when(m.isin(*methods), value)

    uri = ["resources/read", "resources/subscribe", "resources/unsubscribe"]
    progress = p("$.progress").try_cast("double")
    init = F.when((m == "initialize") & p("$.clientInfo").isNotNull(), F.lit(True))

    def client(field: str) -> Column:
        return F.when(init, F.coalesce(p(f"$.clientInfo.{field}"), F.lit("")))

    return df.withColumn(
        out,
        as_map(
            F.array(
                _kv("mcp.protocol.version", MCP_PROTOCOL_VERSION), _kv("mcp.transport", MCP_TRANSPORT),
                _kv("mcp.request.id", F.col(request_id)), _kv("mcp.method.name", m),
                *[_kv(f"mcp.client.{f}", client(f)) for f in ("name", "title", "version")],
                _kv("mcp.tool.name", when(["tools/call"], p("$.name"))),
                _kv("mcp.prompt.name", when(["prompts/get"], p("$.name"))),
                _kv("mcp.logging.level", when(["logging/setLevel"], p("$.level"))),
                _kv("mcp.resource.uri", when(uri, p("$.uri"))),
                _kv("mcp.notifications.progress", when(["notifications/progress"], F.when(progress != 0, progress))),
                _kv("mcp.notifications.progress.token", when(["notifications/progress"], p("$.progressToken"))),
                _kv("mcp.notifications.progress.message", when(["notifications/progress"], non_empty(p("$.message")))),
                _kv("mcp.complete.argument.name", when(["completion/complete"], non_empty(p("$.argument.name")))),
                _kv("mcp.complete.argument.value", when(["completion/complete"], non_empty(p("$.argument.value")))),
            )
        ),
    )


_REQUESTS = {
    "chat": chat_request, "completion": completions_request, "embeddings": embeddings_request, "responses": responses_request,
    "messages": messages_request, "rerank": rerank_request, "image_generation": image_request, "speech": speech_request,
}
_RESPONSES = {
    "chat": chat_response, "completion": completions_response, "embeddings": embeddings_response, "responses": responses_response,
    "messages": messages_response, "rerank": rerank_response,
}


_EVENTS = "array<struct<name: string, at_ms: bigint>>"


def build_spans(
    df: DataFrame, operations: Sequence[str] = tuple(_REQUESTS), header_mapping: dict[str, str] | None = None,
    headers: str = "headers", ids: Sequence[str] = ("request_id",),
) -> DataFrame:
    """One span row per request: name, attributes, status and the exception of a failed one.

    Reads ``operation, request_body, response_body, status``. Request attributes, header attributes
    and, for successes, response attributes are merged; later ones win, also among headers mapped to one attribute.
    """
    op, status = F.col("operation"), F.col("status")
    ok = F.coalesce(status.between(200, 299), F.lit(False))

    def by_operation(builders: dict, body: str) -> Column:
        case: Column | None = None
        for name in operations:
            if name in builders:
                built = builders[name](F.col(body))
                case = F.when(op == name, built) if case is None else case.when(op == name, built)
        return F.lit(None).cast("map<string,string>") if case is None else case

    sources: dict[str, list[str]] = {}  # attribute to its headers, the last mapping first
    for h, a in (header_mapping or {}).items():
        sources.setdefault(a, []).insert(0, h)
    extra = F.array(
        *[_kv(a, F.coalesce(*[F.try_element_at(F.col(headers), F.lit(h)) for h in hs])) for a, hs in sources.items()]
    ).cast(_ENTRY)
    tmp = df.withColumns(
        {
            "_request": by_operation(_REQUESTS, "request_body"),
            "_headers": as_map(extra),
            "_response": F.when(ok & F.col("response_body").isNotNull(), by_operation(_RESPONSES, "response_body")),
        }
    )
    return tmp.select(
        *ids,
        map_case(op, SPAN_NAMES, op).alias("span_name"),
        merge_maps(merge_maps(F.col("_request"), F.col("_headers")), F.col("_response")).alias("attributes"),
        F.when(ok, "Ok").otherwise("Error").alias("span_status"),
        F.when(~ok, http_error_type(status)).alias("exception_type"),
        F.when(~ok, http_error_message(status, F.col("response_body"))).alias("exception_message"),
    )


def build_stream_spans(
    requests: DataFrame, chunks: DataFrame, operations: Sequence[str] = tuple(_REQUESTS), header_mapping: dict[str, str] | None = None,
    headers: str = "headers", key: str = "request_id", order: str = "seq", data: str = "chunk", operation: str = "operation", recv_ms: str = "recv_ms",
) -> DataFrame:
    """``build_spans`` for answers that came as chunk streams, with the span's ``events``.

    ``requests`` is what ``build_spans`` reads; ``chunks`` holds ``(key, operation, order, data, recv_ms)``. A request's chunks
    are folded to the body of its answer; a request without chunks keeps its own ``response_body`` and has no events. A failed
    request has neither events nor response attributes, whatever arrived before. Chunks without a request give no row.
    """
    streamed = [name for name in operations if name in STREAM_OPERATIONS]
    spans = requests.withColumn("_own", F.col("response_body") if "response_body" in requests.columns else F.lit(None).cast("string")).drop("response_body")
    bodies = stream_bodies(chunks, key, order, data, operation, streamed) if streamed else None
    if bodies is not None:
        events = stream_events(chunks, key, order, data, operation, recv_ms)
        spans = spans.join(bodies, key, "left").join(events, key, "left")
    else:
        spans = spans.withColumns({"response_body": F.lit(None).cast("string"), "events": F.lit(None).cast(_EVENTS)})
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    body = F.when(ok & F.col("events").isNotNull(), F.col("response_body")).otherwise(F.col("_own"))
    spans = spans.withColumns({"response_body": body, "events": F.when(ok, F.coalesce("events", F.array().cast(_EVENTS))).otherwise(F.array().cast(_EVENTS))})
    return build_spans(spans, operations, header_mapping, headers, (key, "events"))


def build_mcp_spans(calls: DataFrame, ids: Sequence[str] = ("id",)) -> DataFrame:
    """Spans of paired MCP calls: name by method, attributes, error label."""
    code = F.col("error_code")
    return mcp_attrs(calls).select(
        *ids,
        map_case("method", MCP_SPAN_NAMES, F.col("method")).alias("span_name"),
        "attributes",
        F.when(code.isNull(), "Ok").otherwise("Error").alias("span_status"),
        mcp_error_label(code).alias("exception_type"),
    )


def unflatten_attrs(spans: DataFrame, ids: Sequence[str] = ("request_id",), attributes: str = "attributes") -> DataFrame:
    """Indexed attributes back to rows: ``(ids, side, msg_idx, group, sub_idx, field, value)``.

    ``group`` is message, contents or tool_calls; ``sub_idx`` counts parts or calls (NULL for the
    message's own fields).
    """
    shape = r"^llm\.(input|output)_messages\.([0-9]+)\.(?:message\.(?:(contents|tool_calls)\.([0-9]+)\.(?:message_content|tool_call|message)\.)?|(?=tool_call\.))(.+)$"
    entries = exploded(spans, list(ids), F.map_entries(attributes), "_i", "_e")
    rows = entries.select(*ids, F.col("_e.key").alias("key"), F.col("_e.value").alias("value")).where(F.col("key").rlike(shape))

    def g(n: int) -> Column:
        return F.regexp_extract("key", shape, n)

    return rows.select(
        *ids,
        g(1).alias("side"),
        g(2).cast("int").alias("msg_idx"),
        F.when(g(3) == "", "message").otherwise(g(3)).alias("group"),
        non_empty(g(4)).cast("int").alias("sub_idx"),
        g(5).alias("field"),
        "value",
    )
