import pytest
from pyspark.sql import functions as F

from trafficlake.operators import cost as C
from trafficlake.operators import metrics as M

USAGE = "model string, backend string, input_tokens long, output_tokens long, total_tokens long, cached_input_tokens long, cache_creation_input_tokens long, reasoning_tokens long"


def test_expression_validation(spark):
    C.validate_cost_expression(spark, "input_tokens * output_tokens")
    for bad in ("nope + 1", "sum(input_tokens)", "input_tokens * 0.5", "input_tokens - 1", "'x'", "1 / 0", "row_number() over (order by model)"):
        with pytest.raises(ValueError):
            C.validate_cost_expression(spark, bad)


def test_expression_rows(spark, rows):
    df = spark.createDataFrame([("cool", "b", 200, 2, 3, 100, 1, None), ("other", "b", 200, 2, 3, 100, 1, None), ("cool", "b", 1, 2, 3, 100, 1, None)], USAGE)
    expr = "CASE WHEN model = 'cool' THEN (input_tokens - cached_input_tokens - cache_creation_input_tokens) * output_tokens ELSE total_tokens END"
    out = [(r["cost"], r["cost_error"]) for r in rows(C.cost_expression(df, expr))]
    assert sorted(out, key=str) == sorted([(198, None), (3, None), (None, "negative result")], key=str)


def test_expression_sees_only_usage_columns(spark):
    df = spark.createDataFrame([("m", "b", 1, 1, 1, 1, 1, 1)], USAGE).withColumn("secret", F.lit(9))
    with pytest.raises(ValueError):
        C.cost_expression(df, "secret + 1")


def test_metadata_first_rule_wins(spark, rows):
    df = spark.createDataFrame([("m", "b", 5, None, 6, None, None, None)], USAGE).withColumns({"success": F.lit(True), "response_model": F.lit("r")})
    rules = [C.CostRule("a", "InputToken"), C.CostRule("a", "TotalToken"), C.CostRule("o", "OutputToken"), C.CostRule("x", "Expression", "total_tokens * 2")]
    assert rows(C.cost_metadata(df, rules))[0]["cost"] == {"a": 5, "o": 0, "x": 12}
    with pytest.raises(ValueError):
        C.effective_rules([C.CostRule(str(i), "InputToken") for i in range(37)])
    with pytest.raises(ValueError):
        C.counter_cost("Nope")


def test_histogram_bounds_are_inclusive(spark, rows):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 4.0, 5.0, None)], "v double")
    r = rows(M.histogram(df, [], "v", [1, 4]))[0]
    assert r["bucket_counts"] == [2, 2, 1] and r["count"] == 5 and r["sum"] == 11.5


@pytest.mark.parametrize("cap,admitted", [(0, 1), (2, 2), (10, 4)])
def test_guard_admits_first_seen(spark, rows, cap, admitted):
    data = [(i, "abcd"[i % 4] if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(data, "n int, label string")
    out = rows(M.cardinality_guard(df, ["label"], "n", cap))
    assert len(out) == 40
    kept = {r["label"] for r in out if not r["overflowed"]}
    assert kept == set([None, "b", "c", "d"][:admitted])
    assert all(r["label"] == "_overflow_" for r in out if r["overflowed"])
    assert sum(r["overflowed"] for r in out) == 40 - 10 * admitted


def test_temporality(spark, rows):
    df = spark.createDataFrame([("a", 0, 1), ("a", 5, 2), ("a", 12, 4), ("b", 3, 8)], "k string, at long, v long")
    assert [r["value"] for r in rows(M.metric_temporality(df, ["k"], "at", "v", 10), "k", "interval_us")] == [3, 4, 8]
    assert [r["value"] for r in rows(M.metric_temporality(df, ["k"], "at", "v", 10, "cumulative"), "k", "interval_us")] == [3, 7, 8]
    with pytest.raises(ValueError):
        M.metric_temporality(df, ["k"], "at", "v", 10, "gauge")


@pytest.mark.parametrize("hot_rows", [10**9, 5])
def test_inflight(spark, rows, hot_rows):
    df = spark.createDataFrame([("r", i, i + 3) for i in range(20)], "route string, s long, e long")
    out = {r["at_us"]: r["inflight"] for r in rows(M.inflight_gauge(df, ["route"], "s", "e", hot_rows))}
    for at in range(23):
        assert out[at] == sum(1 for i in range(20) if i <= at < i + 3)


def test_capabilities(spark, rows):
    df = spark.createDataFrame(
        [("client", '{"experimental":{"a":{},"b":{}},"roots":{"listChanged":true}}'), ("client", '{"roots":{}}'), ("server", '{"tools":{},"logging":{}}'), ("server", "{}")],
        "side string, capabilities string",
    )
    assert {(r["type"], r["side"]): r["count"] for r in rows(M.mcp_capability_count(df))} == {
        ("experimental", "client"): 2, ("roots", "client"): 1, ("tools", "server"): 1, ("logging", "server"): 1,
    }
