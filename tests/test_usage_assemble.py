import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trafficlake.operators import assemble as A
from trafficlake.operators import usage as U


def body(spark, *bodies):
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "request_id int, response_body string")


def counters(r):
    return tuple(r[c] for c in U.USAGE)


def test_chat_without_usage_is_zero_but_stream_is_unset(spark, rows):
    df = body(spark, {"model": "m"})
    assert counters(rows(U.usage_openai_chat(df))[0]) == (0, 0, 0, None, None, None)
    assert counters(rows(U.usage_openai_chat(df, stream=True))[0]) == (None,) * 6


def test_anthropic_native_fills_cache_counters(spark, rows):
    df = body(spark, {"usage": {"input_tokens": 5, "output_tokens": 2}}, {"usage": {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 4}})
    assert [counters(r) for r in rows(U.usage_anthropic(df), "request_id")] == [(5, 2, 7, 0, 0, None), (12, 2, 14, 3, 4, None)]
    assert counters(rows(U.usage_anthropic(df, native=False), "request_id")[0]) == (5, 2, 7, None, None, None)


def test_rerank_floors(spark, rows):
    df = body(spark, {"meta": {"tokens": {"input_tokens": 7.9}}}, {"meta": {}}, {})
    assert [counters(r)[:3] for r in rows(U.usage_rerank(df), "request_id")] == [(7, None, 7), (None, None, None), (None, None, None)]


def test_unsupported_pair_is_an_error_row(spark, rows):
    df = spark.createDataFrame([("rerank", "OpenAI", "{}"), ("speech", "OpenAI", "{}")], "operation string, api_schema string, response_body string")
    out = rows(U.normalize_usage(df), "operation")
    assert out[0]["usage_error"] == "unsupported pair rerank/OpenAI" and out[1]["usage_error"] is None
    assert counters(out[1]) == (None,) * 6


def test_latest_usage_ignores_row_order(spark, rows):
    data = [(1, i, None if i % 3 else i * 10, i) for i in range(20)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "request_id int, seq int, input_tokens long, output_tokens long").repartition(3)
        got = rows(U.usage_latest(df, ["request_id"]))
        want = want or got
        assert got == want
    assert want == [{"request_id": 1, "input_tokens": 180, "output_tokens": 19}]


def test_anthropic_stream_variants(spark, rows):
    events = [
        (1, 0, "message_start", 10, 1, 2, 3), (1, 1, "message_delta", None, 5, 1, None), (1, 2, "message_delta", None, 9, None, 1),
        (2, 0, "message_delta", None, 4, None, None), (3, 0, "message_start", 7, None, None, None),
    ]
    df = spark.createDataFrame(events, "request_id int, seq int, event_type string, input_tokens long, output_tokens long, cached_input_tokens long, cache_creation_input_tokens long")
    native = {r["request_id"]: (r["input_tokens"], r["output_tokens"], r["total_tokens"], r["cached_input_tokens"], r["cache_creation_input_tokens"]) for r in rows(U.usage_anthropic_stream(df, ["request_id"]))}
    assert native == {1: (15, 9, 24, 2, 3), 2: (0, 4, 4, 0, 0), 3: (7, 0, 7, 0, 0)}
    added = {r["request_id"]: (r["input_tokens"], r["output_tokens"], r["total_tokens"], r["cached_input_tokens"], r["cache_creation_input_tokens"]) for r in rows(U.usage_anthropic_stream_translated(df, ["request_id"]))}
    assert added[1] == (17, 14, 31, 3, 4)
    assert added[2] == (0, 4, 4, 0, 0)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_ordered_concat_blocks(spark, rows, block):
    df = spark.createDataFrame([(i % 2, i, str(i) + ",") for i in range(50)], "k int, seq int, piece string").repartition(4)
    out = {r["k"]: r["text"] for r in rows(A.ordered_concat(df, ["k"], "seq", "piece", block=block))}
    assert out == {k: "".join(f"{i}," for i in range(50) if i % 2 == k) for k in (0, 1)}


def test_assemble_chat_details(spark, rows):
    chunks = [
        (0, {"id": "first", "model": "a", "choices": [{"delta": {"role": "assistant", "content": "He"}}]}),
        (1, {"id": "x", "model": "b", "choices": [{"delta": {"content": "llo", "annotations": [{"u": 1}]}}]}),
        (2, {"choices": [{"delta": {"annotations": [{"u": 2}]}, "finish_reason": "length"}, {"delta": {"content": "other choice"}}]}),
        (3, {"choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}, "obfuscation": "zz"}),
    ]
    df = spark.createDataFrame([(1, i, json.dumps(c)) for i, c in chunks], "request_id int, seq int, chunk string")
    r = rows(A.assemble_chat(df))[0]
    assert (r["id"], r["model"], r["role"], r["content"], r["finish_reason"]) == ("first", "a", "assistant", "Hello", "length")
    assert r["annotations"] == ['{"u":1}', '{"u":2}'] and r["usage"]["total_tokens"] == 5 and r["obfuscation"] == "zz"


def test_latency_cases(spark, rows):
    chunks = [
        (1, 0, 10, False, 5), (1, 1, 20, False, 10), (1, 2, 60, True, 11),
        (2, 0, 7, True, 9),
        (3, 0, 10, False, 0), (3, 1, 30, True, 1),
        (4, 0, 10, False, 100), (4, 1, 30, True, None),
    ]
    df = spark.createDataFrame(chunks, "request_id int, seq int, recv_ms long, end_of_stream boolean, output_tokens long")
    out = {r["request_id"]: (r["ttft_ms"], None if r["tpot_s"] is None else round(r["tpot_s"], 9)) for r in rows(A.stream_latency(df))}
    assert out == {1: (10, 0.005), 2: (7, None), 3: (10, None), 4: (10, None)}


def test_messages_invalid_tool_json_is_dropped(spark, rows):
    ev = [
        {"type": "message_start", "message": {"id": "m", "model": "c", "role": "assistant"}},
        {"type": "content_block_start", "index": 0, "content_block": {"type": "tool_use", "id": "t", "name": "f"}},
        {"type": "content_block_delta", "index": 0, "delta": {"partial_json": "{\"a\":"}},
        {"type": "content_block_stop", "index": 0},
        {"type": "message_delta", "delta": {"stop_reason": "tool_use"}, "usage": {"output_tokens": 3}},
    ]
    df = spark.createDataFrame([(1, i, json.dumps(e)) for i, e in enumerate(ev)], "request_id int, seq int, data string")
    r = rows(A.assemble_messages(df))[0]
    assert r["content"][0]["tool_name"] == "f" and r["content"][0]["tool_input"] is None and r["output_tokens"] == 3


def test_tables_of_texts_are_dealt_out_by_rows(spark, tmp_path):
    from trafficlake.fixtures import TEXT_ROWS_PER_TASK, Tables

    table = pa.table({"conv_id": pa.array(range(60_000), pa.int64()), "turn": pa.array([1] * 60_000, pa.int64()), "role": ["assistant"] * 60_000, "text": ["a b"] * 60_000})
    pq.write_table(table, tmp_path / "conversations.parquet")  # one row group
    sizes = Tables(spark, str(tmp_path)).conversations.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 60_000 and max(r["count"] for r in sizes) <= 1.1 * TEXT_ROWS_PER_TASK["conversations"]


def test_stream_events_build_no_data_but_that_of_responses(spark):
    part = "SELECT id AS request_id, '{0}' AS operation, id AS seq, to_json(named_struct('type', 'response.completed', '{0}', id)) AS chunk, id AS recv_ms FROM range(3)"
    chunks = spark.sql(" UNION ALL ".join(part.format(o) for o in ("chat", "responses", "messages")))
    out = A.stream_events(chunks)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("StructsToJson") == 1
    assert [sorted(e["name"] for e in r["events"]) for r in out.collect()] == [sorted([A.FIRST_TOKEN, A.COMPLETED])] * 3
