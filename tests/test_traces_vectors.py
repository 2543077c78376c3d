import base64
import json
import struct

import pytest

from trafficlake.operators import traces as J
from trafficlake.operators import vectors as K


def frame(spark, request=None, response=None, **extra):
    data = {"request_id": 1, "request_body": None if request is None else json.dumps(request), "response_body": None if response is None else json.dumps(response), **extra}
    ddl = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in data.items())
    return spark.createDataFrame([tuple(data.values())], ddl)


def attrs(df):
    return df.first()["attributes"]


def test_chat_request_skips_media(spark):
    a = attrs(J.chat_request_attrs(frame(spark, {"model": "m", "messages": [
        {"role": "user", "content": [{"type": "input_audio", "input_audio": {}}, {"type": "text", "text": "t"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64," + "x" * 40000}}]},
        {"role": "assistant", "content": ""}, {"role": "developer", "content": "d"}]})))
    m = "llm.input_messages"
    assert a[f"{m}.0.message.contents.1.message_content.text"] == "t" and f"{m}.0.message.contents.0.message_content.type" not in a
    assert a[f"{m}.0.message.contents.2.message_content.image.image.url"] == "__REDACTED__"
    assert f"{m}.1.message.content" not in a and a[f"{m}.1.message.role"] == "assistant" and a[f"{m}.2.message.content"] == "d"
    assert json.loads(a["llm.invocation_parameters"]) == {"model": "m"}


def test_chat_response_details_only_with_counts(spark):
    usage = {"prompt_tokens": 3, "completion_tokens": 0, "total_tokens": 3, "prompt_tokens_details": {"cached_tokens": 1}, "completion_tokens_details": {"reasoning_tokens": 5}}
    a = attrs(J.chat_response_attrs(frame(spark, None, {"model": "m", "choices": [], "usage": usage})))
    assert a["llm.token_count.prompt_details.cache_read"] == "1" and a["llm.token_count.prompt_details.audio"] == "0"
    assert "llm.token_count.completion" not in a and "llm.token_count.completion_details.reasoning" not in a


@pytest.mark.parametrize("prompt,texts", [("p", ["p"]), (["a", "b"], ["a", "b"]), ([1, 2], []), ([[1], [2]], [])])
def test_prompts_never_decode_tokens(spark, prompt, texts):
    a = attrs(J.completions_attrs(frame(spark, {"model": "m", "prompt": prompt})))
    assert [v for k, v in sorted(a.items()) if k.startswith("llm.prompts.")] == texts


def test_responses_items(spark):
    items = [
        {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "t"}, {"type": "input_image", "image_url": "u"}]},
        {"role": "user", "content": "easy"},
        {"type": "message", "id": "m1", "role": "assistant", "content": [{"type": "refusal", "refusal": "no"}]},
        {"type": "web_search_call", "id": "w"}, {"type": "computer_call", "call_id": "cc"}, {"type": "custom_tool_call", "call_id": "ct", "name": "n", "input": "in"},
        {"type": "function_call_output", "call_id": "f", "output": {"k": [1]}}, {"type": "reasoning", "summary": [{"type": "summary_text", "text": "s"}, {"type": "other", "text": "o"}]},
        {"type": "item_reference", "id": "zz"},
    ]
    a = attrs(J.responses_attrs(frame(spark, {"model": "m", "input": items})))
    p = "llm.input_messages"
    assert a[f"{p}.0.message.contents.1.message_content.image.image.url"] == "u" and a[f"{p}.1.message.content"] == "easy"
    assert a[f"{p}.2.message.contents.0.message_content.text"] == "no"
    assert a[f"{p}.3.message.tool_calls.0.tool_call.function.name"] == "web_search_call" and a[f"{p}.3.message.tool_calls.0.tool_call.id"] == "w"
    assert a[f"{p}.4.message.tool_calls.0.message.role"] == "tool" and a[f"{p}.4.message.tool_calls.0.tool_call.id"] == "cc"
    assert a[f"{p}.5.message.tool_calls.0.tool_call.function.arguments"] == '{"input":"in"}'
    assert a[f"{p}.6.message.role"] == "tool" and a[f"{p}.6.tool_call.id"] == "f" and a[f"{p}.6.message.content"] == '{"k":[1]}'
    assert a[f"{p}.7.message.contents.0.message_content.text"] == "s" and f"{p}.7.message.contents.1.message_content.text" not in a
    assert not any(k.startswith(f"{p}.8.") for k in a)


def test_failed_span(spark):
    df = frame(spark, {"model": "m", "messages": []}, {"error": "x"}, operation="chat", status=429)
    s = J.build_spans(df).first()
    assert (s["span_name"], s["span_status"], s["exception_type"]) == ("ChatCompletion", "Error", "RateLimitError")
    assert s["exception_message"] == 'Error code: 429 - {"error": "x"}' and "output.value" not in s["attributes"]


def test_speech_input_is_rebuilt(spark):
    a = attrs(J.image_speech_attrs(frame(spark, {"model": "tts", "input": "hi", "voice": "v"}, operation="speech")))
    assert json.loads(a["input.value"]) == {"input": "hi", "instructions": None, "response_format": None, "speed": None, "voice": "v"}
    assert json.loads(a["llm.invocation_parameters"]) == {"model": "tts", "input": "hi", "voice": "v"}


def test_round_trip(spark):
    df = frame(spark, {"model": "m", "messages": [{"role": "user", "content": "q"}]})
    out = J.unflatten_attrs(J.chat_request_attrs(df)).collect()
    assert {(r["side"], r["msg_idx"], r["group"], r["field"]): r["value"] for r in out} == {("input", 0, "message", "role"): "user", ("input", 0, "message", "content"): "q"}


def test_mcp_attributes(spark, rows):
    cases = [("initialize", {"clientInfo": {"name": "c", "version": "1"}}), ("prompts/get", {"name": "p"}), ("completion/complete", {"argument": {"name": "a", "value": ""}}), ("resources/read", {"uri": "u"})]
    df = spark.createDataFrame([(str(i), m, json.dumps(p)) for i, (m, p) in enumerate(cases)], "id string, method string, params string")
    out = [r["attributes"] for r in rows(J.mcp_attrs(df), "id")]
    assert out[0]["mcp.client.name"] == "c" and out[0]["mcp.client.title"] == "" and out[1]["mcp.prompt.name"] == "p"
    assert out[2]["mcp.complete.argument.name"] == "a" and "mcp.complete.argument.value" not in out[2] and out[3]["mcp.resource.uri"] == "u"


def test_vectors(spark, rows):
    raw = struct.pack("<3f", 1.0, -2.5, 0.25)
    cases = ["[1.5, 2]", json.dumps(base64.b64encode(raw).decode()), base64.b64encode(raw + b"zz").decode(), "!!", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, embedding string")
    assert [r["vector"] for r in rows(K.decode_vectors(df), "i")] == [[1.5, 2.0], [1.0, -2.5, 0.25], [1.0, -2.5, 0.25], None, None]


def test_rerank_ties_and_limits(spark, rows):
    df = frame(spark, {"documents": ["a", "b", "c"], "top_n": 2}, {"results": [{"index": 2, "relevance_score": 0.5}, {"index": 0, "relevance_score": 0.5}, {"index": 1, "relevance_score": 0.9}]})
    assert [(r["rank"], r["index"], r["document"]) for r in rows(K.rerank_topn(df), "rank")] == [(1, 1, "b"), (2, 0, "a")]
    assert len(rows(K.rerank_topn(df, top_n=10))) == 3 and rows(K.rerank_topn(df, top_n=0)) == []
