import base64
import json

import pytest
from pyspark.sql import functions as F

from trafficlake.operators import config as C
from trafficlake.operators import parse as P


def test_endpoint_prefixes(spark, rows):
    assert C.parse_endpoint_prefixes("openai:/oai, cohere:/c")["openai"] == "/oai"
    assert C.endpoint_paths("openai:/oai")["/oai/v1/chat/completions"] == "chat"
    assert C.endpoint_paths("", "/root")["/root/anthropic/v1/messages"] == "messages"
    for bad in ("openai", "openai:/,", "other:/x"):
        with pytest.raises(ValueError):
            C.parse_endpoint_prefixes(bad)
    df = spark.createDataFrame([("/v1/responses?x=1",), ("/v1/chat/completions/",), (None,)], "path string")
    assert [r["operation"] for r in rows(P.classify_endpoint(df))] == ["responses", "unsupported", "unsupported"]


def test_header_mappings():
    for bad in ("a", "a:", ":b", "a:b,"):
        with pytest.raises(ValueError):
            C.parse_header_mapping(bad)
    got = C.resolve_header_mappings("x:base", metrics="x:other", log="")
    assert got["span"] == {"x": "base", "agent-session-id": "session.id"}
    assert got["metrics"] == {"x": "other"}
    assert got["log"] == {"x": "base"}
    assert C.format_header_mapping({"b": "2", "a": "1"}) == "a:1,b:2"


def test_parse_request_variants(spark, rows):
    cases = [
        (0, "chat", '{"model":"m","stream":true,"messages":[{},{}]}'),
        (1, "embeddings", '{"model":"m","stream":true}'),
        (2, "speech", '{"model":"m","stream_format":"sse"}'),
        (3, "messages", '{"messages":[]}'),
        (4, "chat", '{"model":'),
        (5, "chat", '{"model":"m","stream":"yes"}'),
        (6, "chat", "[1]"),
        (7, "chat", None),
    ]
    df = spark.createDataFrame(cases, "i int, operation string, request_body string")
    out = rows(P.parse_request(df), "i")
    assert [r["stream"] for r in out] == [True, False, True, False, False, False, False, False]
    assert [r["malformed"] for r in out] == [False, False, False, False, True, True, True, True]
    assert out[0]["n_messages"] == 2 and out[3]["error"] == "model_required" and out[4]["error"] == "malformed_request"


def test_union_kinds(spark, rows):
    cases = {
        '"a"': ("string", 1), "[]": ("string[]", 0), '["a","b"]': ("string[]", 2), "[1,2]": ("int[]", 1), "[[1],[2]]": ("int[][]", 2),
        '{"content":"x"}': ("object", 1), '[{"content":"x"}]': ("object[]", 1), "[1.5]": ("invalid", 0), "5": ("invalid", 0), "nope": ("invalid", 0),
        '{"content":""}': ("invalid", 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r["j"]: (r["kind"], r["n_inputs"]) for r in rows(P.classify_union_input(df, "j"))} == cases
    prompts = {r["j"]: r["kind"] for r in rows(P.classify_union_input(df, "j", allow_objects=False))}
    assert prompts['{"content":"x"}'] == "invalid" and prompts['"a"'] == "string"


def test_text_that_looks_like_parts_stays_text(spark, rows):
    body = json.dumps({"messages": [{"role": "user", "content": '[{"type":"text","text":"x"}]'}]})
    df = spark.createDataFrame([(1, "OpenAI", body)], "request_id int, api_schema string, request_body string")
    assert rows(P.normalize_messages(df))[0]["text"] == '[{"type":"text","text":"x"}]'
    part = rows(P.explode_content_parts(P.explode_messages(df)))[0]
    assert (part["part_type"], part["text"]) == ("text", '[{"type":"text","text":"x"}]')


def test_normalize_anthropic(spark, rows):
    body = {
        "system": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}],
        "messages": [
            {"role": "user", "content": [{"type": "tool_result", "content": "plain"}, {"type": "tool_result", "content": [{"type": "text", "text": "t"}]}]},
            {"role": "assistant", "content": [{"type": "tool_use", "name": "look", "input": {}}]},
            {"role": "robot", "content": "x"},
        ],
    }
    df = spark.createDataFrame([(1, "Anthropic", json.dumps(body))], "request_id int, api_schema string, request_body string")
    got = [(r["role"], r["part_type"], r["text"], r["error"]) for r in rows(P.normalize_messages(df), "msg_idx", "part_idx")]
    assert got == [
        ("system", "text", "ab", None), ("user", "tool_result", "plain", None), ("user", "tool_result", "t", None),
        ("assistant", "tool_use", "look", None), ("robot", "text", None, "invalid role robot"),
    ]


def test_sse_line_ends_and_tail(spark, rows):
    text = "event: m\r\nid: 5\r\ndata: {\"a\":1}\r\n\r\ndata: [DONE]\n\ndata: {\"b\":2}\rdata: {\"c\":3}"
    out = rows(P.parse_sse(spark.createDataFrame([(1, text)], "request_id int, payload string")), "event_idx", "data_idx")
    assert [(r["event_idx"], r["data_idx"], r["event"], r["id"], r["data"]) for r in out] == [
        (0, 0, "m", "5", '{"a":1}'), (2, 0, None, None, '{"b":2}'), (2, 1, None, None, '{"c":3}'),
    ]


def test_jsonrpc_kinds(spark, rows):
    cases = [
        (0, ' ﻿{"jsonrpc":"2.0","id":1,"method":"ping"}', "request"), (1, '{"jsonrpc":"2.0","method":"n"}', "notification"),
        (2, '{"jsonrpc":"2.0","id":"x","result":{}}', "response"), (3, '{"jsonrpc":"2.0","id":"x","error":{"code":-1,"message":"m"}}', "response"),
        (4, '{"jsonrpc":"1.0","id":"x","result":{}}', "invalid"), (5, "[]", "invalid"), (6, "x", "invalid"),
    ]
    df = spark.createDataFrame([(i, r) for i, r, _ in cases], "i int, raw string")
    assert [r["kind"] for r in rows(P.parse_jsonrpc(df), "i")] == [k for _, _, k in cases]


def test_session_ids(spark, rows):
    sessions = ["r@u@x@gh:YWI=:1ff,j::001", "r@gh", "r@s@gh", "r@s@:YQ==", "r@s@a:!!", "r@s@a:YQ==,a:Yg==:zz"]
    df = spark.createDataFrame(list(enumerate(sessions)), "session_key int, session string")
    out = rows(P.decode_session_id(df), "session_key")
    assert [(r["backend"], r["backend_session"], r["caps"]) for r in out[:2]] == [("gh", "ab", 511), ("j", "", 1)]
    assert out[0]["route"] == "r" and out[0]["subject"] == "u@x"
    assert [r["error"] is not None for r in out[2:]] == [True, True, True, True, False]
    assert (out[6]["backend_session"], out[6]["caps"]) == ("b", 511)


def token(payload, scheme="Bearer"):
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{scheme} {enc({'alg': 'none'})}.{enc(payload)}.sig"


def test_jwt_claims(spark, rows):
    heads = [token({"sub": "me", "scope": " a  b ", "scp": ["c", ""], "x": {"y": 1}}, "bEARER"), "Bearer x", None, "Basic abc", token({"sub": "q?>~"})]
    df = spark.createDataFrame(list(enumerate(heads)), "i int, authorization string")
    out = rows(P.decode_jwt_claims(df), "i")
    assert [r["sub"] for r in out] == ["me", None, None, None, "q?>~"]
    assert out[0]["scopes"] == ["a", "b", "c"] and out[0]["claims"] == {"sub": "me", "x": '{"y":1}'}
    assert out[1]["scopes"] == []


def test_jwt_claims_with_line_breaks(spark, rows):
    def wrapped(payload):
        head, body, sig = token(payload).split(".")
        return ".".join([head, "\r\n".join(body[i : i + 76] for i in range(0, len(body), 76)), sig])

    subs = ["u" * n for n in range(40, 160)]
    df = spark.createDataFrame([(i, wrapped({"sub": s, "scp": ["a"]})) for i, s in enumerate(subs)], "i int, authorization string")
    out = rows(P.decode_jwt_claims(df), "i")
    assert [r["sub"] for r in out] == subs and all(r["scopes"] == ["a"] for r in out)


def test_finish_reasons_and_errors(spark, rows):
    df = spark.createDataFrame(
        [(0, "AWSBedrock", "weird", False), (1, "AWSBedrock", None, False), (2, "GCPVertexAI", "", False), (3, "GCPVertexAI", "STOP", True), (4, "Anthropic", "pause_turn", False), (5, "OpenAI", "length", False)],
        "i int, api_schema string, reason string, has_tools boolean",
    )
    assert [r["finish_reason"] for r in rows(P.normalize_finish_reason(df), "i")] == ["stop", "stop", "", "tool_calls", "stop", "length"]
    codes = spark.createDataFrame([(s,) for s in (204, 401, 403, 404, 503, 418)], "status int")
    assert [r["error_type"] for r in rows(P.classify_http_error(codes), "status")] == [
        None, "AuthenticationError", "PermissionDeniedError", "NotFoundError", "Error", "InternalServerError",
    ]


def test_meta_before_header(spark, rows):
    df = spark.createDataFrame(
        [(0, {"X-Tenant": "b", "x-tenant": "c"}, {"x-tenant": "h"}), (1, {"X-TENANT": ""}, {"X-Tenant": "h"}), (2, {}, {})],
        "i int, meta map<string,string>, headers map<string,string>",
    )
    assert [r["tenant_id"] for r in rows(P.meta_or_header(df, "x-tenant:tenant.id"), "i")] == ["b", "h", None]


def test_filter_above_parsed_columns_is_not_copied(spark):
    df = spark.createDataFrame([("{}",)], "raw string")
    plan = P.parse_jsonrpc(df).where(F.col("kind") == "request").select("id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_tool_calls_and_unknown_schemas_give_rows(spark, rows):
    body = '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null,"tool_calls":[{"id":"c1","function":{"name":"look","arguments":"{}"}}]}]}'
    df = spark.createDataFrame([(1, "OpenAI", body), (2, "Other", body)], "request_id int, api_schema string, request_body string")
    out = [(r["request_id"], r["msg_idx"], r["part_type"], r["text"], r["error"] is not None) for r in rows(P.normalize_messages(df), "request_id", "msg_idx")]
    assert out == [(1, 0, "text", "hi", False), (1, 1, "tool_use", "look", False), (2, 0, None, None, True)]
