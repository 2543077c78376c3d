import gzip
import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficlake.operators import quota as Q
from trafficlake.operators.assemble import stream_latency
from trafficlake.operators.cost import expression_cost, validate_cost_expression
from trafficlake.session import scratch_path, shared_folder
from trafficlake.sources import access_log, batch, bodies, sinks
from trafficlake.streaming import traffic as S

HOUR = 3_600_000_000


def test_access_log_values(spark, rows, tmp_path):
    lines = [
        {"gen_ai.request.model": "m", "gen_ai.usage.input_tokens": 12, "gen_ai.usage.output_tokens": "7", "start_time": "2025-12-10T16:10:05.123Z", "response_code": 200, "response_flags": "-", "x-tenant": "t"},
        {"gen_ai.request.model": "-", "gen_ai.usage.input_tokens": "-", "gen_ai.usage.output_tokens": None, "duration": "oops", "upstream_host": None},
    ]
    path = tmp_path / "log.json"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    out = rows(access_log.read_access_log(spark, str(path), {"x-tenant": "tenant"}))
    assert (out[0]["request_model"], out[0]["input_tokens"], out[0]["output_tokens"], out[0]["response_flags"], out[0]["tenant"]) == ("m", 12, 7, None, "t")
    assert out[0]["start_time"].microsecond == 123000
    assert out[1]["request_model"] is None and out[1]["input_tokens"] is None and out[1]["duration_ms"] is None
    assert len(out) == 3 and out[2]["request_model"] is None


def test_bodies(spark, rows):
    gz = gzip.compress(b"hello world")
    data = [(0, 0, "gzip", gz[:9]), (0, 1, "gzip", gz[9:]), (1, 0, "gzip", gz[:-4]), (2, 0, "gzip", b"junk"), (3, 0, "br", b"x"), (4, 0, None, b"plain"), (5, 0, "gzip", gz + gzip.compress(b"!"))]
    df = spark.createDataFrame(data, "id int, seq int, content_encoding string, body binary").repartition(3)
    out = rows(bodies.decode_bodies(bodies.concat_body_chunks(df, ["id", "content_encoding"])), "id")
    assert [(r["text"], r["decode_error"]) for r in out] == [
        ("hello world", None), (None, "truncated_gzip"), (None, "undecodable_gzip"), (None, "unsupported_encoding"), ("plain", None), ("hello world!", None),
    ]


def test_batch_lines(spark, rows, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text('{"id":"i","custom_id":"c","response":{"status_code":200,"request_id":"r","body":{"a":1}},"error":null}\n\n{bad\n')
    out = batch.read_batch_output(spark, str(p)).orderBy(F.col("custom_id").isNull()).collect()
    assert [(r["custom_id"], r["body"], r["bad_line"]) for r in out] == [("c", '{"a":1}', None), (None, None, "{bad")]


def test_audit_lines(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "ok", False, "r", "b", "t", "p", 1, 2, 3, {"EMAIL": 2}), (1, "ok", False, "r", "b", "t", "p", 1, 2, 3, {})],
                               "timestamp long, outcome string, fail_open boolean, route string, backend string, tool string, pii_context string, input_chars int, output_chars int, elapsed long, stats map<string,long>")
    lines = [r["value"] for r in sinks.audit_lines(df).collect()]
    assert list(json.loads(lines[0])) == sinks.AUDIT_KEYS + ["stats"] and json.loads(lines[0])["stats"] == {"EMAIL": 2}
    assert "stats" not in json.loads(lines[1])


def test_shared_folder_comes_from_the_session(spark):
    assert os.path.isdir(shared_folder(spark))

    class Session:
        """A session started with the cluster's shared folder."""

        class conf:
            get = staticmethod(lambda key, default=None: "/shared/x/" if key == "spark.checkpoint.dir" else default)

    assert scratch_path(Session, "a").startswith("/shared/x/a-")


def land(spark, df, folder, parts, by):
    """Write ``parts`` files in time order, so that each becomes its own micro-batch."""
    os.makedirs(folder, exist_ok=True)
    cuts = ",".join(str(i / parts) for i in range(1, parts))
    bounds = df.selectExpr(f"percentile({by}, array({cuts})) AS p").first()["p"]
    lo = None
    for n, hi in enumerate([*bounds, None]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(by) > lo)
        if hi is not None:
            cond = cond & (F.col(by) <= hi)
        df.where(cond).toPandas().to_parquet(f"{folder}/{n:03d}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{n:03d}.parquet", (time.time() - 1000 + n * 10,) * 2)
        lo = hi


def run(spark, stream, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def requests(spark, n=400):
    return spark.range(n).selectExpr(
        "id AS request_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 4) END AS tenant", f"{24 * HOUR} + id * {HOUR} DIV 60 + id % 7 AS at_us", "id % 5 AS cost"
    ).withColumn("at", F.timestamp_micros("at_us"))


@pytest.mark.parametrize("kind", ["fixed", "trailing"])
def test_stream_limit_equals_batch(spark, rows, tmp_path, kind):
    df = requests(spark)
    land(spark, df, str(tmp_path / "in"), 4, "at_us")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if kind == "fixed":
        got = run(spark, S.stream_rate_limit(src, ["tenant"], "at", "cost", 20, "Hour"), tmp_path)
        want = Q.fixed_window_limit(df, ["tenant"], "at_us", "request_id", "cost", 20)
        assert {r["request_id"]: (r["used"], r["refused"]) for r in got.collect()} == {r["request_id"]: (r["used"], r["refused"]) for r in want.collect()}
    else:
        got = run(spark, S.stream_rate_limit(src, ["tenant"], "at", "cost", 20, None, 1800), tmp_path)
        want = Q.sliding_window_quota(df, ["tenant"], "at_us", "request_id", "cost", 20, 1800)
        verdicts = {r["request_id"]: not r["allowed"] for r in want.collect()}
        assert {r["request_id"]: r["refused"] for r in got.collect()} == verdicts and any(verdicts.values())


def test_stream_latency_equals_batch(spark, rows, tmp_path):
    df = spark.range(60).selectExpr("id AS request_id", "explode(sequence(0, CAST(id % 5 AS INT))) AS seq").selectExpr(
        "request_id", "seq", "CAST(10 + seq * 7 AS BIGINT) AS recv_ms", "CAST(seq * 3 AS BIGINT) AS output_tokens", "seq = request_id % 5 AS end_of_stream", f"{HOUR} + seq * 1000000L + request_id AS at_us"
    ).withColumn("at", F.timestamp_micros("at_us"))
    land(spark, df, str(tmp_path / "in"), 3, "at_us")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["request_id"]: (r["ttft_s"], r["tpot_s"]) for r in run(spark, S.stream_latency_state(src, "at"), tmp_path).collect()}
    want = {r["request_id"]: (r["ttft_s"], r["tpot_s"]) for r in stream_latency(df).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_stream_windows_drop_late_rows(spark, rows, tmp_path):
    df = requests(spark, 300)
    late = df.where("request_id = 0").withColumn("request_id", F.lit(999).cast("bigint"))
    land(spark, df, str(tmp_path / "in"), 3, "at_us")
    late.toPandas().to_parquet(str(tmp_path / "in" / "900.parquet"), coerce_timestamps="us")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = rows(run(spark, S.stream_usage(src, "at", [], ["cost"]), tmp_path), "window_start")
    assert got[0]["requests"] == df.where(f"at_us < {25 * HOUR}").count()


def test_live_config_keeps_last_valid(spark, rows, tmp_path):
    df = requests(spark, 90)
    land(spark, df, str(tmp_path / "in"), 3, "at_us")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).selectExpr("request_id", "cost AS input_tokens")
    versions = iter(["input_tokens", "broken +", "input_tokens + 100"])
    conf = S.cost_expression_config(spark, lambda: next(versions))
    seen = []
    S.stream_with_live_config(
        src, conf, lambda b, e: expression_cost(b, e).withColumn("expr", F.lit(e)), lambda b, i: seen.extend(b.select("expr").distinct().collect())
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r["expr"] for r in seen] == ["input_tokens", "input_tokens", "input_tokens + 100"] and conf.rejected == 1


def test_nonempty_export(spark, tmp_path):
    df = requests(spark, 90)
    land(spark, df, str(tmp_path / "in"), 3, "at_us")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).where("request_id < 10")
    calls = []
    sinks.export_nonempty(src, lambda b, i: calls.append(b.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert calls == [10]


def test_late_rows_draw_on_their_own_window(spark, tmp_path):
    hour = 3_600_000_000
    files = [[(1, 10, 1)], [(2, hour + 5, 9)], [(3, 20, 5)], [(4, 30, 5)]]  # id, at_us, cost: the third comes late
    for i, rows_ in enumerate(files):
        spark.createDataFrame([("k", r, a, c) for r, a, c in rows_], "k string, request_id long, at_us long, cost long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, request_id long, at_us long, cost long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("at", F.timestamp_micros("at_us"))
    q = S.stream_rate_limit(stream, ["k"], "at", "cost", 8, delay="2 hours").writeStream.format("memory").queryName("late_rows")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["request_id"]: (r["used"], r["refused"]) for r in spark.table("late_rows").collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (1, False), 4: (6, False)}


def shuffled(spark, df, folder, parts=8):
    """Rows dealt over files at random; each file is a micro-batch."""
    os.makedirs(folder, exist_ok=True)
    for n in range(parts):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == n).toPandas().to_parquet(f"{folder}/{n:03d}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{n:03d}.parquet", (time.time() - 1000 + n * 10,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def chunk_rows(spark):
    return spark.range(120).selectExpr("id AS request_id", "explode(sequence(0, CAST(id % 9 AS INT))) AS seq").selectExpr(
        "request_id", "seq", "CAST(10 + seq * 7 AS BIGINT) AS recv_ms", "CAST(seq * 3 AS BIGINT) AS output_tokens", "seq = request_id % 9 AS end_of_stream",
        f"{HOUR} + seq * 1000000L + request_id AS at_us",
    ).withColumn("at", F.timestamp_micros("at_us"))


def test_stream_latency_does_not_depend_on_arrival(spark, tmp_path):
    df = chunk_rows(spark)
    got = run(spark, S.stream_latency_state(shuffled(spark, df, str(tmp_path / "in")), "at"), tmp_path).collect()
    want = {r["request_id"]: (r["ttft_s"], r["tpot_s"]) for r in stream_latency(df).collect()}
    assert len(got) == len(want)
    for r in got:
        assert (r["ttft_s"], r["tpot_s"]) == pytest.approx(want[r["request_id"]])


def test_a_stream_with_a_lost_chunk_waits_for_the_watermark(spark, tmp_path):
    df = chunk_rows(spark)
    lost = df.where("NOT (request_id % 9 = 5 AND seq = 3)")
    later = df.where("request_id = 0").withColumns({"request_id": F.lit(5000).cast("bigint"), "at": F.col("at") + F.expr("INTERVAL 1 DAY")})
    src = shuffled(spark, lost, str(tmp_path / "in"))
    later.toPandas().to_parquet(str(tmp_path / "in" / "900.parquet"), coerce_timestamps="us")
    got = {r["request_id"]: (r["ttft_s"], r["tpot_s"]) for r in run(spark, S.stream_latency_state(src, "at"), tmp_path).collect()}
    want = {r["request_id"]: (r["ttft_s"], r["tpot_s"]) for r in stream_latency(lost.union(later)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_stream_inflight_follows_event_time(spark, tmp_path):
    calls = spark.range(300).selectExpr("id", "concat('r', id % 3) AS route", f"{24 * HOUR} + (id * 7919) % 3000 * 1000000 AS start_us", "id % 50 * 1000000 AS width")
    moves = calls.selectExpr("id", "route", "explode(array(named_struct('at_us', start_us, 'delta', 1L), named_struct('at_us', start_us + width, 'delta', -1L))) AS m").select("id", "route", "m.*")
    last = spark.range(1).selectExpr("999L AS id", "'later' AS route", f"{72 * HOUR} AS at_us", "1L AS delta")
    src = shuffled(spark, moves, str(tmp_path / "in"))
    last.toPandas().to_parquet(str(tmp_path / "in" / "900.parquet"))
    got = run(spark, S.stream_inflight(src, ["route"], "2 hours"), tmp_path).collect()
    net = {}
    for r in moves.collect():
        net[r["route"], r["at_us"]] = net.get((r["route"], r["at_us"]), 0) + r["delta"]
    want, gauge = set(), {}
    for (route, at), d in sorted(net.items()):
        gauge[route] = gauge.get(route, 0) + d
        want.add((route, at, gauge[route]))
    assert len(got) == len(want) and {(r["route"], r["at_us"], r["inflight"]) for r in got} == want


def test_inflight_state_of_a_hot_label_set_is_dealt_out(spark, tmp_path):
    moves = spark.range(60_000).selectExpr("'hot' AS route", f"{24 * HOUR} + id * 1000 AS at_us", "1L AS delta")
    run(spark, S.stream_inflight(shuffled(spark, moves, str(tmp_path / "in"), 2), ["route"], "10 days", 16), tmp_path).collect()
    state = spark.read.format("statestore").option("stateVarName", "held").option("operatorId", 1).load(str(tmp_path / "cp"))
    sizes = [r["n"] for r in state.groupBy("key").agg(F.sum(F.length("user_map_value.data")).alias("n")).collect()]
    assert len(sizes) == 16 and sum(sizes) > 16 * 60_000 and max(sizes) < sum(sizes) / 8


def test_inflight_drops_late_moves_beside_others(spark, tmp_path):
    """Two label sets (one NULL); the third file has late moves, an instant known already, and a new label set with both kinds."""
    minute, t0 = 60_000_000, 24 * HOUR
    files = [
        [("a", t0, 1), (None, t0 + 1, 2), ("a", t0 + 60 * minute, 1), ("a", t0 + 60 * minute, None), ("a", None, 1)],
        [("b", t0 + 58 * minute, 1)],
        [("a", t0 + 40 * minute, 5), ("a", t0 + 60 * minute, -2), (None, t0 + 49 * minute, 7), (None, t0 + 51 * minute, -1), ("new", t0, 3), ("new", t0 + 55 * minute, 1)],
        [("later", t0 + 500 * minute, 1)],
    ]
    os.makedirs(folder := str(tmp_path / "in"))
    for i, rows_ in enumerate(files):
        pd.DataFrame(rows_, columns=["route", "at_us", "delta"]).astype({"at_us": "Int64", "delta": "Int64"}).to_parquet(f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (time.time() - 1000 + i * 10,) * 2)
    src = spark.readStream.schema("route string, at_us long, delta long").option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r["route"], r["at_us"], r["inflight"]) for r in run(spark, S.stream_inflight(src, ["route"]), tmp_path).collect()}
    assert got == {("b", t0 + 58 * minute, 1), ("a", t0, 1), ("a", t0 + 60 * minute, 0), (None, t0 + 1, 2), (None, t0 + 51 * minute, 1), ("new", t0 + 55 * minute, 1)}


def test_gauge_blocks_are_put_in_order_a_few_at_a_time(monkeypatch):
    """Blocks of several buckets in no order: frames stay small, whatever the label set holds."""
    monkeypatch.setattr(S, "_BLOCK", 8)
    monkeypatch.setattr(S, "_BLOCKS", 16)
    monkeypatch.setattr(S, "_SPOOL", 1000)
    rng = np.random.default_rng(3)
    at, delta = np.sort(rng.choice(1_000_000, 5000, replace=False)), rng.integers(-3, 4, 5000)
    owner = rng.integers(0, 10, 5000)
    blocks = [b for k in range(10) for b in S._blocks(at[owner == k], delta[owner == k])]
    rng.shuffle(blocks)

    class State:
        value = (100,)
        exists = staticmethod(lambda: True)
        get = staticmethod(lambda: State.value)
        update = staticmethod(lambda value: setattr(State, "value", value))

    gauge = S._Gauge()
    gauge.state = State
    frames = list(gauge.handleInputRows(("a",), iter([pd.DataFrame({"packed_moves": blocks})]), None))
    assert max(map(len, frames)) <= (16 + 10) * 8
    out = pd.concat(frames)
    assert out["at_us"].tolist() == at.tolist() and out["inflight"].tolist() == (100 + delta.cumsum()).tolist() and State.value == (100 + int(delta.sum()),)


def test_versions_by_event_time_and_no_second_copy_of_a_batch(spark, tmp_path):
    df = requests(spark, 120).withColumnRenamed("cost", "input_tokens")
    first = 24 * HOUR
    table = [(1, first, "input_tokens"), (2, first + 30 * 60_000_000, "broken +"), (3, first + 60 * 60_000_000, "input_tokens + 100")]
    conf = S.VersionedConfig(lambda: spark.createDataFrame(table, "version long, effective_us long, value string"), lambda e: validate_cost_expression(spark, e))
    out = str(tmp_path / "out")
    for attempt in range(2):  # the second run begins anew and writes its batches in place of the first one's
        folder = str(tmp_path / "in")
        src = shuffled(spark, df, folder, 3) if not attempt else spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = S.stream_with_versions(src.select("request_id", "at_us", "input_tokens"), conf, "at_us", expression_cost, out)
        q.option("checkpointLocation", str(tmp_path / f"cp{attempt}")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["request_id"], r["cost"], r["config_version"]) for r in spark.read.parquet(out).collect())
    want = [(r["request_id"], r["input_tokens"] + 100 * (r["at_us"] >= table[2][1]), 3 if r["at_us"] >= table[2][1] else 1) for r in df.collect()]
    assert got == sorted(want)
