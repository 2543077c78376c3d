import hashlib
import itertools
import json

import pandas as pd
import pytest

from trafficlake.operators import filtering as R


def mark(text):
    raw = text.encode()
    return f"[REDACTED LENGTH={len(raw)} HASH={hashlib.sha256(raw).hexdigest()[:16]}]"


def test_redact_counts_bytes(spark, rows):
    df = spark.createDataFrame([("é",), ("",), (None,)], "t string")
    assert [r["t"] for r in rows(R.redact_string(df, "t"))] == [mark("é"), "", None]


def test_request_walk(spark, rows):
    body = {
        "model": "m",
        "messages": [
            {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}, {"type": "input_audio", "input_audio": {"data": "d", "format": "wav"}}, {"type": "file", "file": {"file_data": "f", "filename": "n"}}]},
            {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "fn", "arguments": "{}"}}]},
            {"role": "tool", "content": "result", "tool_call_id": "1"},
        ],
        "tools": [{"type": "function", "function": {"name": "fn", "description": "desc", "parameters": {"b": [1, 2.5, True, None], "a": {"x": "y"}}}}],
        "response_format": {"type": "json_schema", "json_schema": {"name": "s", "schema": {"k": 1}}},
    }
    df = spark.createDataFrame([("chat", json.dumps(body)), ("completion", '{"prompt":"p"}'), ("chat", "bad")], "operation string, request_body string")
    out = [r["request_body"] for r in rows(R.redact_requests(df))]
    got = json.loads(out[0])
    parts = got["messages"][0]["content"]
    assert parts[0]["text"] == mark("a") and parts[1]["image_url"]["url"] == mark("u") and parts[2]["input_audio"] == {"data": mark("d"), "format": "wav"}
    assert parts[3]["file"] == {"file_data": mark("f"), "filename": "n"}
    assert got["messages"][1]["tool_calls"][0]["function"] == {"name": mark("fn"), "arguments": mark("{}")}
    assert got["messages"][2]["content"] == mark("result")
    text = "map[a:map[x:y] b:[1 2.5 true <nil>]]"
    fn = got["tools"][0]["function"]
    assert fn["name"] == "fn" and fn["description"] == mark("desc")
    assert fn["parameters"]["_redacted"] == f"REDACTED LENGTH={len(text)} HASH={hashlib.sha256(text.encode()).hexdigest()[:16]}"
    assert got["response_format"]["json_schema"] == {"name": mark("s"), "schema": {"_redacted": mark('{"k":1}')}}
    assert out[1] == '{"prompt":"p"}' and out[2] is None


def test_response_walk(spark, rows):
    nested = {"reasoningContent": {"reasoningText": {"text": "t", "signature": "s"}}}
    body = {"choices": [{"message": {"content": "c", "audio": {"data": "d", "transcript": "x", "id": "i"}, "reasoning_content": "r"}}, {"message": {"content": None, "reasoning_content": nested}}]}
    df = spark.createDataFrame([(json.dumps(body),)], "response_body string")
    first, second = [c["message"] for c in json.loads(rows(R.redact_responses(df))[0]["response_body"])["choices"]]
    assert first == {"content": mark("c"), "audio": {"data": mark("d"), "transcript": mark("x"), "id": "i"}, "reasoning_content": mark("r")}
    assert second["reasoning_content"]["reasoningContent"]["reasoningText"] == {"text": mark("t"), "signature": "s"}


def test_status_truth_table(spark, rows):
    cases = list(itertools.product([True, False], [None, True, False], [True, False], ["Shadow", "Enforce", ""], ["pass", "redact", "reject", "error"], [None, "Fail", "PassThrough"], [True, False], [True, False]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, configured boolean, enabled boolean, global_disable boolean, mode string, outcome string, failure_policy string, body_equal boolean, replacement_valid boolean")

    def want(configured, enabled, off, mode, outcome, policy, equal, valid):
        if not configured:
            return "off"
        if off or enabled is False:
            return "disabled"
        if mode == "Shadow":
            return "pass"
        if outcome == "error":
            return "unavailable" if policy == "Fail" else "failed-open"
        if outcome == "reject":
            return "reject"
        if outcome == "pass" or equal:
            return "pass"
        return "redact" if valid else "unavailable"

    assert [r["status"] for r in rows(R.filter_status(df), "i")] == [want(*c) for c in cases]


def test_sampling(spark, rows):
    df = spark.range(5000).selectExpr("id AS call_id", "'Shadow' AS mode", "250L AS sample_permille")
    share = R.shadow_sample(df).where("sampled").count() / 5000
    assert abs(share - 0.25) < 0.03
    zero = df.selectExpr("call_id", "mode", "0L AS sample_permille")
    assert R.shadow_sample(zero).where("sampled").count() == 5000
    assert R.shadow_sample(zero, zero_means_all=False).where("sampled").count() == 0
    enforced = zero.selectExpr("call_id", "'Enforce' AS mode", "sample_permille")
    assert R.shadow_sample(enforced, zero_means_all=False).where("sampled").count() == 5000


def test_policy_outcomes(spark, rows):
    def policy(pdf: pd.DataFrame) -> pd.DataFrame:
        big = "x" * (R.MAX_FILTER_REPLY_BYTES + 1)
        table = {"pass": ("pass", None), "redact": ("redact", "new"), "empty": ("redact", None), "same": ("redact", "same"), "reject": ("reject", None), "odd": ("odd", None), "big": ("redact", big)}
        picked = [table[b] for b in pdf["body"]]
        return pd.DataFrame({"action": [a for a, _ in picked], "body": [b for _, b in picked], "reason": "why"})

    names = ["pass", "redact", "empty", "same", "reject", "odd", "big"]
    df = spark.createDataFrame([(i, b, True, False, True, "", 0, p) for i, (b, p) in enumerate((b, p) for b in names for p in ("Fail", None))],
                               "call_id int, body string, configured boolean, global_disable boolean, enabled boolean, mode string, sample_permille int, failure_policy string")
    out = rows(R.run_content_filter(df, policy), "call_id")
    got = [(r["body"], r["status"], r["new_body"]) for r in out]
    assert got[0::2] == [("pass", "pass", "pass"), ("redact", "redact", "new"), ("empty", "unavailable", None), ("same", "pass", "same"), ("reject", "reject", None), ("odd", "unavailable", None), ("big", "unavailable", None)]
    assert [s for _, s, _ in got[1::2]] == ["pass", "redact", "failed-open", "pass", "reject", "failed-open", "failed-open"]


def test_visibility(spark, rows):
    attrs = {
        "input.value": "i", "input.mime_type": "m", "output.value": "o", "llm.input_messages.0.message.role": "user", "llm.input_messages.0.message.content": "c",
        "llm.input_messages.1.message.contents.0.message_content.type": "image", "llm.input_messages.1.message.contents.0.message_content.image.image.url": "u",
        "llm.output_messages.0.message.content": "r", "llm.token_count.prompt": "1", "llm.invocation_parameters": "{}", "llm.prompts.0.prompt.text": "p",
    }
    df = spark.createDataFrame([(attrs,)], "attributes map<string,string>")
    show = lambda **f: rows(R.apply_trace_visibility(df, **f))[0]["attributes"]
    assert show() == attrs
    hidden = show(hide_inputs=True)
    assert hidden["input.value"] == "__REDACTED__" and "input.mime_type" not in hidden and not any(k.startswith("llm.input") for k in hidden) and hidden["llm.token_count.prompt"] == "1"
    assert show(hide_input_text=True)["llm.input_messages.0.message.content"] == "__REDACTED__"
    images = show(hide_input_images=True)
    assert not any("contents.0" in k for k in images) and "llm.input_messages.0.message.content" in images
    assert show(hide_output_text=True)["llm.output_messages.0.message.content"] == "__REDACTED__"
    assert "llm.prompts.0.prompt.text" not in show(hide_prompts=True) and "llm.invocation_parameters" not in show(hide_invocation_parameters=True)
    with pytest.raises(ValueError):
        show(hide_everything=True)


def test_policy_sees_bounded_payloads(spark, rows):
    def policy(pdf):
        seen = str(pdf["body"].str.len().sum())
        return pd.DataFrame({"action": ["redact"] * len(pdf), "body": ["x"] * len(pdf), "reason": [seen] * len(pdf)})

    df = spark.range(0, 120, 1, 1).selectExpr(
        "id AS call_id", "CASE WHEN id = 7 THEN NULL WHEN id = 50 THEN repeat('b', 6000000) ELSE repeat('a', 100000) END AS body", "TIMESTAMP'2024-01-01 10:00:00' AS at",
        "IF(id % 2 = 0, id, NULL) AS n", "map('k', id) AS m", "true AS configured", "false AS global_disable", "true AS enabled", "'Enforce' AS mode", "0 AS sample_permille", "'Fail' AS failure_policy",
    )
    out = rows(R.run_content_filter(df, policy).select("call_id", "n", "m", "reason", "status"), "call_id")
    assert [(r["call_id"], r["n"], r["m"], r["status"]) for r in out] == [(i, None if i % 2 else i, {"k": i}, "redact") for i in range(120)]
    assert max(float(r["reason"]) for r in out if r["call_id"] != 50) <= R.POLICY_BATCH_BYTES and float(out[50]["reason"]) == 6_000_000
