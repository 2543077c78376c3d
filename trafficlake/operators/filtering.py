"""Content filtering and redaction: placeholders, JSON walks, sampling, the filter's decision table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import content_hash, hash_roll

# Names in redacted headers and traces, size limits.
SENSITIVE_HEADERS = ["authorization", "x-api-key"]
HEADER_PLACEHOLDER = "[REDACTED]"
TRACE_PLACEHOLDER = "__REDACTED__"
MAX_IMAGE_URL = 32000
MAX_FILTER_REPLY_BYTES = 2 * 1024 * 1024

# Trace visibility switches.
HIDE_FLAGS = [
    "hide_invocation_parameters",
    "hide_inputs",
    "hide_outputs",
    "hide_input_messages",
    "hide_output_messages",
    "hide_input_images",
    "hide_input_text",
    "hide_output_text",
    "hide_embeddings_text",
    "hide_embeddings_vectors",
    "hide_prompts",
    "hide_choices",
]


# --- placeholders ---------------------------------------------------------------------------------


def redacted(c: str | Column) -> Column:
    """``[REDACTED LENGTH=<bytes> HASH=<16 hex>]``; empty stays empty, NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "", F.lit("")).when(
        c.isNotNull(),
        F.concat(F.lit("[REDACTED LENGTH="), F.octet_length(c).cast("string"), F.lit(" HASH="), content_hash(c), F.lit("]")),
    )


def redact_string(df: DataFrame, source: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or source, redacted(source))


def redact_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Relational form over message or content-part rows: structure stays, text goes."""
    return df.withColumn(text, redacted(text))


def redact_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Hide credentials in a header map (names in any case)."""
    return df.withColumn(
        headers,
        F.transform_values(
            headers, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_HEADERS), F.lit(HEADER_PLACEHOLDER)).otherwise(v)
        ),
    )


def _digest(text: str) -> tuple[int, str]:
    raw = text.encode()
    return len(raw), hashlib.sha256(raw).hexdigest()[:16]


def _mask(v):
    if not isinstance(v, str) or v == "":
        return v
    return "[REDACTED LENGTH=%d HASH=%s]" % _digest(v)


def _plain(v) -> str:
    """Space-separated rendering of decoded JSON, the text whose length and hash stand for a schema."""
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{_plain(v[k])}" for k in sorted(v)) + "]"
    if isinstance(v, list):
        return "[" + " ".join(_plain(x) for x in v) + "]"
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        x = float(v)
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        return repr(x)
    return v


def _mask_fields(obj: dict, *names: str) -> None:
    for n in names:
        if n in obj:
            obj[n] = _mask(obj[n])


def _mask_content(content):
    if isinstance(content, str):
        return _mask(content)
    parts = content if isinstance(content, list) else [content] if isinstance(content, dict) else []
    for p in parts:
        if not isinstance(p, dict):
            continue
        _mask_fields(p, "text", "refusal")
        for holder, name in (("image_url", "url"), ("input_audio", "data"), ("file", "file_data")):
            if isinstance(p.get(holder), dict):
                _mask_fields(p[holder], name)
    return content


def _mask_calls(msg: dict) -> None:
    for call in msg.get("tool_calls") or []:
        if isinstance(call, dict) and isinstance(call.get("function"), dict):
            _mask_fields(call["function"], "name", "arguments")


def _schema_mark(v) -> dict:
    text = json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    return {"_redacted": "[REDACTED LENGTH=%d HASH=%s]" % _digest(text)}


def _mask_request(body: dict) -> dict:
    for m in body.get("messages") or []:
        if isinstance(m, dict):
            if "content" in m:
                m["content"] = _mask_content(m["content"])
            if m.get("role") == "assistant":
                _mask_calls(m)
    for tool in body.get("tools") or []:
        fn = tool.get("function") if isinstance(tool, dict) else None
        if isinstance(fn, dict):
            _mask_fields(fn, "description")
            if fn.get("parameters") is not None:
                fn["parameters"] = {"_redacted": "REDACTED LENGTH=%d HASH=%s" % _digest(_plain(fn["parameters"]))}
    if isinstance(body.get("prediction"), dict) and "content" in body["prediction"]:
        body["prediction"]["content"] = _mask_content(body["prediction"]["content"])
    fmt = body.get("response_format")
    if isinstance(fmt, dict) and isinstance(fmt.get("json_schema"), dict):
        inner = fmt["json_schema"]
        _mask_fields(inner, "name", "description")
        if inner.get("schema") is not None:
            inner["schema"] = _schema_mark(inner["schema"])
    if body.get("guided_json") is not None:
        body["guided_json"] = _schema_mark(body["guided_json"])
    return body


def _mask_reasoning(msg: dict) -> None:
    """Reasoning is plain text or nested blocks that end in ``reasoningText``; signatures stay."""
    _mask_fields(msg, "reasoning_content")
    node = msg.get("reasoning_content")
    while isinstance(node, dict):
        if isinstance(node.get("reasoningText"), dict):
            _mask_fields(node["reasoningText"], "text")
        node = node.get("reasoningContent")


def _mask_response(body: dict) -> dict:
    for choice in body.get("choices") or []:
        msg = choice.get("message") if isinstance(choice, dict) else None
        if isinstance(msg, dict):
            _mask_fields(msg, "content")
            _mask_calls(msg)
            if isinstance(msg.get("audio"), dict):
                _mask_fields(msg["audio"], "data", "transcript")
            _mask_reasoning(msg)
    return body


def _json_walk(walk: Callable[[dict], dict]):
    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series) -> pd.Series:
        def one(text):
            try:
                body = json.loads(text)
            except (TypeError, ValueError):
                return None
            if not isinstance(body, dict):
                return None
            return json.dumps(walk(body), separators=(",", ":"), ensure_ascii=False)

        return bodies.map(one, na_action="ignore").astype(object)

    return run


def redact_requests(df: DataFrame, body: str = "request_body", operation: str = "operation") -> DataFrame:
    """Chat requests with all text, media, tool calls, tool schemas and response schemas masked.

    Structure is kept. Other operations pass unchanged; an undecodable chat body becomes NULL.
    """
    masked = _json_walk(_mask_request)(F.when(F.col(operation) == "chat", F.col(body)))
    return df.withColumn(body, F.when(F.col(operation) == "chat", masked).otherwise(F.col(body)))


def redact_responses(df: DataFrame, body: str = "response_body") -> DataFrame:
    """Chat responses with choice content, tool calls and audio masked."""
    return df.withColumn(body, _json_walk(_mask_response)(F.col(body)))


def trim_base64_images(df: DataFrame, url: str = "url", max_length: int = MAX_IMAGE_URL) -> DataFrame:
    """Inline base64 images above the length limit are replaced by the trace placeholder."""
    return df.withColumn(url, trimmed_image(F.col(url), max_length))


def trimmed_image(url: Column, max_length: int = MAX_IMAGE_URL) -> Column:
    inline = url.startswith("data:image/") & url.contains("base64")
    return F.when(inline & (F.octet_length(url) > max_length), F.lit(TRACE_PLACEHOLDER)).otherwise(url)


def apply_trace_visibility(df: DataFrame, attributes: str = "attributes", **flags: bool) -> DataFrame:
    """Apply the hide flags to an attribute map.

    Hidden values read as the placeholder, hidden messages, images and vectors are dropped, token
    counts always stay.
    """
    unknown = set(flags) - set(HIDE_FLAGS)
    if unknown:
        raise ValueError(f"unknown visibility flags {sorted(unknown)}")
    on = {f: bool(flags.get(f)) for f in HIDE_FLAGS}
    k_in, k_out = "^llm\\.input_messages\\.", "^llm\\.output_messages\\."
    drop: list[str] = []
    mask: list[str] = []
    if on["hide_invocation_parameters"]:
        drop += ["^llm\\.invocation_parameters$", "^embedding\\.invocation_parameters$"]
    if on["hide_inputs"]:
        mask.append("^input\\.value$")
        drop += ["^input\\.mime_type$", k_in, "^llm\\.prompts\\.", "\\.embedding\\.text$", "^reranker\\.input_documents\\."]
    if on["hide_outputs"]:
        mask.append("^output\\.value$")
        drop += ["^output\\.mime_type$", k_out, "^llm\\.choices\\.", "\\.embedding\\.vector$", "^reranker\\.output_documents\\."]
    if on["hide_input_messages"]:
        drop.append(k_in)
    if on["hide_output_messages"]:
        drop.append(k_out)
    if on["hide_input_text"]:
        mask += [k_in + "[0-9]+\\.message\\.content$", k_in + ".*message_content\\.text$"]
    if on["hide_output_text"]:
        mask += [k_out + "[0-9]+\\.message\\.content$", k_out + ".*message_content\\.text$"]
    if on["hide_embeddings_text"]:
        drop.append("\\.embedding\\.text$")
    if on["hide_embeddings_vectors"]:
        drop.append("\\.embedding\\.vector$")
    if on["hide_prompts"]:
        drop.append("^llm\\.prompts\\.")
    if on["hide_choices"]:
        drop.append("^llm\\.choices\\.")
    out = F.col(attributes)
    if on["hide_input_images"]:
        # An image part is its url and its type entry: both go.
        images = F.transform(
            F.filter(F.map_keys(out), lambda k: k.rlike(k_in + ".*message_content\\.image\\.image\\.url$")),
            lambda k: F.regexp_replace(k, "\\.image\\.image\\.url$", ""),
        )
        out = F.map_filter(
            out,
            lambda k, v: ~k.rlike("message_content\\.image\\.image\\.url$")
            & ~(k.rlike("message_content\\.type$") & F.array_contains(images, F.regexp_replace(k, "\\.type$", ""))),
        )
    if drop:
        out = F.map_filter(out, lambda k, v: ~k.rlike("|".join(drop)))
    if mask:
        out = F.transform_values(
            out, lambda k, v: F.when(k.rlike("|".join(mask)), F.lit(TRACE_PLACEHOLDER)).otherwise(v)
        )
    return df.withColumn(attributes, out)


# --- the filter's gates and verdicts --------------------------------------------------------------


def sampled_in(df_mode: Column, rate: Column, roll: Column, zero_means_all: bool = True) -> Column:
    """Shadow calls are sampled per mille; other modes always run.

    A rate of zero means everything, as the running filter treats it; ``zero_means_all=False`` takes
    it literally.
    """
    bounded = F.coalesce(rate, F.lit(0))
    if zero_means_all:
        bounded = F.when(bounded <= 0, 1000).otherwise(bounded)
    return F.when(df_mode == "Shadow", roll < bounded).otherwise(F.lit(True))


def shadow_sample(
    df: DataFrame, id_col: str = "call_id", mode: str = "mode", rate: str = "sample_permille", zero_means_all: bool = True
) -> DataFrame:
    """Add ``sampled``. The roll is a hash of the call id, so it repeats and spreads evenly."""
    return df.withColumn(
        "sampled", sampled_in(F.coalesce(F.col(mode), F.lit("")), F.col(rate), hash_roll(id_col, 1000), zero_means_all)
    )


def filter_status(df: DataFrame) -> DataFrame:
    """Add ``status`` of a filter call.

    Reads ``configured, global_disable, enabled, mode, sampled, outcome, failure_policy`` and the
    optional ``body_equal`` and ``replacement_valid``. Outcomes: pass, redact, reject, error.
    """
    body_equal = F.coalesce(F.col("body_equal"), F.lit(False)) if "body_equal" in df.columns else F.lit(False)
    valid = F.coalesce(F.col("replacement_valid"), F.lit(True)) if "replacement_valid" in df.columns else F.lit(True)
    o = F.col("outcome")
    status = (
        F.when(~F.col("configured"), "off")
        .when(F.coalesce(F.col("global_disable"), F.lit(False)) | ~F.coalesce(F.col("enabled"), F.lit(True)), "disabled")
        .when(F.coalesce(F.col("mode"), F.lit("")) == "Shadow", "pass")
        .when((o == "error") & (F.coalesce(F.col("failure_policy"), F.lit("")) == "Fail"), "unavailable")
        .when(o == "error", "failed-open")
        .when(o == "reject", "reject")
        .when((o == "pass") | body_equal, "pass")
        .when(~valid, "unavailable")
        .otherwise("redact")
    )
    return df.withColumn("status", status)


def shadow_verdict(df: DataFrame) -> DataFrame:
    """Add ``action`` recorded for shadow and disabled calls (NULL for enforced ones)."""
    body_equal = F.coalesce(F.col("body_equal"), F.lit(False)) if "body_equal" in df.columns else F.lit(False)
    o = F.col("outcome")
    disabled = F.coalesce(F.col("global_disable"), F.lit(False)) | ~F.coalesce(F.col("enabled"), F.lit(True))
    action = (
        F.when(~F.col("configured"), None)
        .when(disabled, "disabled")
        .when(F.coalesce(F.col("mode"), F.lit("")) != "Shadow", None)
        .when(~F.col("sampled"), "shadow_sampled_out")
        .when(o == "error", "shadow_would_fail")
        .when(o == "reject", "shadow_would_reject")
        .when((o == "pass") | body_equal, "shadow_would_pass")
        .otherwise("shadow_would_redact")
    )
    return df.withColumn("action", action.cast("string"))


_POLICY_SCHEMA = "policy_action string, policy_body string, policy_reason string"
_POLICY_COLUMNS = ("policy_action", "policy_body", "policy_reason")
#: Bytes of payload that a policy sees at once; one larger payload is a batch alone.
POLICY_BATCH_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch, body: str, most: int = POLICY_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch, without copying, where the payloads would exceed ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(body)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _policy_frame(part: pa.RecordBatch) -> pd.DataFrame:
    """The rows as pandas, times without zone (local to the session) as in Spark's own pandas batches."""
    pdf = part.to_pandas(maps_as_pydicts="strict")
    for c in pdf.columns:
        if isinstance(pdf[c].dtype, pd.DatetimeTZDtype):
            pdf[c] = pdf[c].dt.tz_localize(None)
    return pdf


def _texts(values: object, n: int) -> pa.Array:
    """One column of a policy's reply as texts, by position; what is missing is NULL."""
    column = pd.Series(values.to_numpy() if isinstance(values, pd.Series) else values, dtype=object)
    if len(column) != n:
        raise ValueError(f"a policy replied with {len(column)} rows to {n}")
    return pa.Array.from_pandas(column.where(column.notna(), None).map(lambda v: v if v is None or isinstance(v, str) else str(v)), type=pa.string())


def run_content_filter(
    df: DataFrame, policy: Callable[[pd.DataFrame], pd.DataFrame], body: str = "body", id_col: str = "call_id"
) -> DataFrame:
    """Run a user policy over payload batches, then decide each call's status.

    ``policy`` gets the rows as pandas batches of at most ``POLICY_BATCH_BYTES`` of payload (they reach Python in batches of
    rows, whatever their length; a worker holds such a batch once, undecoded) and returns ``action`` (pass, redact, reject), ``body``
    and ``reason`` columns. An unknown action, a redaction without body, or a reply above 2 MiB is an
    error, which the failure policy turns into fail-open or fail-closed. Adds ``outcome, status,
    new_body, reason``.
    """
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(_POLICY_SCHEMA).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, body):
                reply = policy(_policy_frame(part))
                said = [_texts(reply[c], part.num_rows) if c in reply else pa.nulls(part.num_rows, pa.string()) for c in ("action", "body", "reason")]
                yield pa.RecordBatch.from_arrays([*part.columns, *said], names=[*part.schema.names, *_POLICY_COLUMNS])

    r = df.mapInArrow(run, schema)
    too_big = F.coalesce(F.octet_length("policy_body"), F.lit(0)) > MAX_FILTER_REPLY_BYTES
    empty = F.coalesce(F.col("policy_body"), F.lit("")) == ""
    outcome = (
        F.when(too_big, "error")
        .when(F.col("policy_action") == "pass", "pass")
        .when(F.col("policy_action") == "reject", "reject")
        .when((F.col("policy_action") == "redact") & ~empty, "redact")
        .otherwise("error")
    )
    r = r.withColumns(
        {
            "outcome": outcome,
            "body_equal": F.coalesce(F.col("policy_body") == F.col(body), F.lit(False)),
        }
    )
    r = filter_status(shadow_sample(r, id_col))
    return r.withColumns(
        {
            "new_body": F.when(F.col("status") == "redact", F.col("policy_body")).when(
                F.col("status").isin("reject", "unavailable"), None
            ).otherwise(F.col(body)),
            "reason": F.when(F.col("outcome").isin("reject", "redact"), F.col("policy_reason")),
        }
    ).drop("policy_action", "policy_body", "policy_reason", "body_equal")


def build_audit_events(decisions: DataFrame) -> DataFrame:
    """Audit events of shadow and disabled calls: never scrubbed, the reason as a one-entry count map."""
    return decisions.where(F.col("action").isNotNull()).select(
        "start_us",
        F.col("action").alias("outcome"),
        F.lit(True).alias("fail_open"),
        "route",
        "backend",
        "tool",
        F.lit("content_filter:shadow").alias("pii_context"),
        F.coalesce("input_chars", F.lit(0)).alias("input_chars"),
        F.coalesce("output_chars", F.lit(0)).alias("output_chars"),
        F.when(F.coalesce(F.col("reason"), F.lit("")) != "", F.create_map(F.col("reason"), F.lit(1).cast("bigint"))).alias("stats"),
        *[c for c in ("call_id",) if c in decisions.columns],
    )
