import json

import pytest
from pyspark.sql import functions as F

from tests.test_parse import token
from trafficlake.operators import routing as H


def calls(spark, *items):
    return spark.createDataFrame(
        [(i, a, b, t) for i, (a, b, t) in enumerate(items)], "i int, authorization string, backend string, tool string"
    )


def test_no_rules(spark, rows):
    df = calls(spark, (None, "b", "t"))
    assert rows(H.authorize_calls(df, None))[0]["allowed"] is True
    assert rows(H.authorize_calls(df, [], "Deny"))[0]["allowed"] is False
    assert rows(H.authorize_calls(df, [], "Allow"))[0]["allowed"] is True


def test_rule_order_targets_and_claims(spark, rows):
    rules = [
        H.AuthRule("Deny", targets=(("b", "secret"),)),
        H.AuthRule("Allow", claims=(H.ClaimRule("org.team", ("x", "y")), H.ClaimRule("groups", ("g1",), "StringArray")), scopes=("read",)),
    ]
    good = {"org": {"team": "x"}, "groups": ["g0", "g1"], "scope": "read"}
    df = calls(
        spark,
        (token(good), "b", "tool"), (token(good), "b", "secret"), (token({**good, "org": {"team": "z"}}), "b", "tool"),
        (token({**good, "groups": "g1"}), "b", "tool"), (token({**good, "org": {"team": 5}}), "b", "tool"), (None, "b", "tool"), ("Bearer junk", "b", "tool"),
    )
    assert [r["allowed"] for r in rows(H.authorize_calls(df, rules), "i")] == [True, False, False, True, False, False, False]


def test_claims_cannot_name_scopes(spark, rows):
    rules = [H.AuthRule("Allow", claims=(H.ClaimRule("scope", ("read",)),))]
    assert rows(H.authorize_calls(calls(spark, (token({"scope": "read"}), "b", "t")), rules))[0]["allowed"] is False


def test_condition_null_is_no_match(spark, rows):
    rules = [H.AuthRule("Allow", condition="tool = 't'"), H.AuthRule("Allow", condition="try_divide(1, 0) > 0")]
    assert [r["allowed"] for r in rows(H.authorize_calls(calls(spark, (None, "b", "t"), (None, "b", None)), rules), "i")] == [True, False]


def test_scope_challenge_is_the_smallest_gap(spark, rows):
    rules = [H.AuthRule("Allow", scopes=("a", "b", "c")), H.AuthRule("Allow", scopes=("d", "e")), H.AuthRule("Allow", scopes=("f", "g")), H.AuthRule("Deny", scopes=("z",))]
    out = rows(H.authorize_calls(calls(spark, (token({"scope": "a b"}), "b", "t"), (token({"scope": "d e"}), "b", "t")), rules, resource_metadata="https://m"), "i")
    assert out[0]["scope_challenge"] == H.scope_challenge(("d", "e"), "https://m")
    assert 'scope="d e", resource_metadata="https://m"' in out[0]["scope_challenge"]
    assert out[1]["allowed"] is True and out[1]["scope_challenge"] is None


def test_default_allow_still_shows_the_challenge(spark, rows):
    out = rows(H.authorize_calls(calls(spark, (None, "b", "t")), [H.AuthRule("Allow", scopes=("a",))], "Allow"))[0]
    assert out["allowed"] is True and out["scope_challenge"].startswith("Bearer ")


def test_weights(spark):
    refs = [H.BackendRef("a", 0, 3), H.BackendRef("b", 0, 1), H.BackendRef("zero", 0, 0), H.BackendRef("low", 1, 9)]
    df = spark.range(4000).withColumnRenamed("id", "request_id")
    got = {r[0]: r[1] for r in H.weighted_backend(df, refs).groupBy("selected_backend").count().collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] / 4000 - 0.75) < 0.03
    again = {r[0]: r[1] for r in H.weighted_backend(df.repartition(7), refs).groupBy("selected_backend").count().collect()}
    assert again == got
    assert H.weighted_backend(df, [H.BackendRef("a", 0, 0)]).first()["selected_backend"] is None


def test_route_needs_all_headers(spark, rows):
    rules = spark.createDataFrame(
        [(0, 0, "m", {"a": "1", "b": "2"}), (1, 0, None, {"c": "3"}), (2, 0, "m", {}), (1, 1, "m", {"d": "4"})],
        "rule_idx int, match_idx int, model string, headers map<string,string>",
    )
    reqs = [(0, "m", {"a": "1", "b": "2"}), (1, "m", {"a": "1"}), (2, "m", {"c": "3"}), (3, "x", {"c": "3"}), (4, "x", {}), (5, "m", {"d": "4"}), (6, None, {})]
    df = spark.createDataFrame(reqs, "i int, model string, headers map<string,string>")
    assert [r["rule_idx"] for r in rows(H.match_route(df, rules), "i")] == [0, 2, 1, 1, None, 1, None]


def test_header_mutation(spark, rows):
    base = {":path": "/", "x-ai-eg-k": "v", "a": "1", "b": "2", "new": "n"}
    df = spark.createDataFrame(
        [(0, base, {"a": "1", "b": "0", "c": "3"}, {"b": "set", ":path": "no"}, ["a", "x-ai-eg-k"], retry) for retry in (False, True)],
        "i int, headers map<string,string>, original_headers map<string,string>, sets map<string,string>, removes array<string>, on_retry boolean",
    )
    first, again = [r["headers"] for r in H.apply_header_mutation(df).orderBy("on_retry").collect()]
    assert first == {":path": "/", "x-ai-eg-k": "v", "b": "set", "new": "n"}
    assert again == {":path": "/", "x-ai-eg-k": "v", "b": "set", "c": "3"}


def test_body_mutation_values(spark, rows):
    sets = {"num": "12.5", "txt": "hello", "obj": '{"a":[1]}', "quoted": '"q"', "flag": "true", "minus": "-x"}
    df = spark.createDataFrame([('{"keep":1,"drop":2}', sets, ["drop", ""]), ("nope", sets, [])], "request_body string, body_sets map<string,string>, body_removes array<string>")
    out = rows(H.apply_body_mutation(df))
    assert json.loads(out[0]["request_body"]) == {"keep": 1, "num": 12.5, "txt": "hello", "obj": {"a": [1]}, "quoted": "q", "flag": True, "minus": "-x"}
    assert out[1]["request_body"] is None


def test_merge_mutations(spark, rows):
    s = "b string, kind string, name string, value string"
    route = spark.createDataFrame([("x", "set", "X-A", "route"), ("x", "remove", "X-C", None)], s)
    backend = spark.createDataFrame([("x", "set", "x-a", "backend"), ("x", "set", "x-b", "backend"), ("x", "remove", "x-c", None)], s)
    assert {(r["kind"], r["name"]): r["value"] for r in rows(H.merge_mutations(route, backend, ["b"]))} == {("set", "x-a"): "route", ("set", "x-b"): "backend", ("remove", "x-c"): None}
    assert len(rows(H.merge_mutations(route, backend, ["b"], case_sensitive=True))) == 5


@pytest.mark.parametrize(
    "selector,want",
    [
        (dict(include=["a"], exclude=[], include_regex=["b"], exclude_regex=[]), {"a"}),
        (dict(include=[], exclude=["a"], include_regex=["^[ab]$"], exclude_regex=[]), {"b"}),
        (dict(include=["a", "b"], exclude=[], include_regex=[], exclude_regex=["b"]), {"a"}),
        (dict(include=[], exclude=[], include_regex=[], exclude_regex=[]), {"a", "b", "c"}),
    ],
)
def test_tool_selection(spark, selector, want):
    tools = spark.createDataFrame([("k", t) for t in "abc"] + [("other", "z")], "backend string, tool string")
    s = spark.createDataFrame([("k", selector["include"], selector["exclude"], selector["include_regex"], selector["exclude_regex"])],
                              "backend string, include array<string>, exclude array<string>, include_regex array<string>, exclude_regex array<string>")
    got = {(r["backend"], r["tool"]) for r in H.select_tools(tools, s).collect()}
    assert got == {("k", t) for t in want} | {("other", "z")}


def test_pairing_and_tool_errors(spark, rows):
    msgs = [
        ("s", "b", 1, "1", "request", "tools/call", '{"name":"t"}', None, None, None),
        ("s", "b", 9, "1", "response", None, None, '{"isError":true,"content":[{"type":"text","text":"x"},{"type":"image","mimeType":"image/png"},{"type":"audio"}]}', None, None),
        ("s", "b", 2, "2", "request", "ping", None, None, None, None), ("s", "b", 3, None, "notification", "n", None, None, None, None),
        ("s", "c", 4, "1", "response", None, None, "{}", None, None), ("s", "b", 5, "3", "request", "tools/call", '{"name":"u"}', None, None, None),
        ("s", "b", 6, "3", "response", None, None, '{"isError":true}', None, None),
    ]
    df = spark.createDataFrame(msgs, "session string, backend string, at_us long, id string, kind string, method string, params string, result string, error_code long, error_message string")
    pairs = H.pair_jsonrpc(df)
    assert [(r["id"], r["answered"], r["answered_us"]) for r in rows(pairs, "id")] == [("1", True, 9), ("2", False, None), ("3", True, 6)]
    assert [(r["tool_name"], r["error_text"]) for r in rows(H.tool_errors(pairs), "id")] == [
        ("t", 'tool returned isError=true: x; [image: image/png]; {"type":"audio"}'), ("u", "tool returned isError=true"),
    ]


def test_policy_conflicts(spark, rows):
    b = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "a")], "route string, backend string")
    standalone = spark.createDataFrame([("r", None, "wide"), ("r", "a", "own")], "route string, section string, policy string")
    inline = spark.createDataFrame([("r", "b", "inline"), ("q", "a", "inline")], "route string, backend string, policy string")
    out = {(r["route"], r["backend"]): (r["policy"], r["error"] is not None) for r in rows(H.resolve_filter_policy(b, standalone, inline))}
    assert out == {("r", "a"): (None, True), ("r", "b"): ("wide", False), ("q", "a"): ("inline", False)}


def test_config_diff_empty_when_reordered(spark):
    a = spark.createDataFrame([("x", "1"), ("x", "2")], "k string, v string")
    assert H.config_diff(a, a.orderBy(F.desc("v"))).isEmpty()


def test_repeated_ids_pair_by_occurrence(spark, rows):
    schema = "session string, backend string, id string, kind string, at_us long, method string, params string, result string, error_code long, error_message string"
    m = [("s", "b", "1", k, at, "ping" if k == "request" else None, None, r, None, None) for k, at, r in (("request", 1, None), ("request", 5, None), ("response", 6, "x"), ("response", 9, "y"))]
    out = rows(H.pair_jsonrpc(spark.createDataFrame(m, schema)), "requested_us")
    assert [(r["requested_us"], r["answered_us"], r["result"]) for r in out] == [(1, None, None), (5, 6, "x")]


def test_hot_repeated_id_pairs_in_slices(spark, rows):
    schema = "session string, backend string, id string, kind string, at_us long, method string, params string, result string, error_code long, error_message string"
    m, want = [], []
    for i in range(300):
        name, at = ("1" if i % 3 else f"r{i}"), 10 * i
        m.append(("s", "b", name, "request", at, "ping", None, None, None, None))
        m += [("s", "b", name, "response", at + d, None, None, f"{i}:{d}", None, None) for d in (0, 4) if i % 2]
        want.append((name, at, f"{i}:0" if i % 2 else None))
    m.append(("s", "b", "1", "response", 10**9, None, None, "stray", None, None))
    last = max(i for i in range(300) if i % 3)
    want = [(n, at, "stray" if at == 10 * last and r is None else r) for n, at, r in want]
    out = H.pair_jsonrpc(spark.createDataFrame(m, schema).repartition(5), hot_rows=50, rows_per_slice=20)
    assert sorted((r["requested_us"], r["id"], r["result"]) for r in rows(out, "requested_us")) == sorted((at, n, r) for n, at, r in want)


def test_header_patterns_of_routes(spark, rows):
    schema = "rule_idx int, match_idx int, model string, headers map<string,string>, header_patterns map<string,string>"
    rules = spark.createDataFrame([(0, 0, None, {"a": "1"}, {"b": "x[0-9]+"}), (1, 0, None, None, {"b": "x.*"})], schema)
    reqs = spark.createDataFrame([(1, "m", {"a": "1", "b": "x12"}), (2, "m", {"a": "1", "b": "x12y"}), (3, "m", {"b": "ax1"})], "id int, model string, headers map<string,string>")
    assert [(r["id"], r["rule_idx"]) for r in rows(H.match_route(reqs, rules), "id")] == [(1, 0), (2, 1), (3, None)]


def test_bad_values_keep_the_body(spark, rows):
    schema = "id int, request_body string, body_sets map<string,string>, body_removes array<string>"
    df = spark.createDataFrame([(1, '{"a":1,"b":null}', {"t": "1-2"}, ["a"]), (2, '{"a":1,"b":null}', {"t": "null"}, None), (3, "[1]", {}, []), (4, '{"a":1}', None, ["a"])], schema)
    out = [(r["request_body"], r["mutation_error"] is None) for r in rows(H.apply_body_mutation(df), "id")]
    assert out == [('{"a":1,"b":null}', False), ('{"a":1,"b":null,"t":null}', True), (None, False), ("{}", True)]


def test_rules_of_each_route_decide_as_the_single_list_does(spark):
    rules = {
        "a": [
            H.AuthRule("Deny", condition="tool = 'drop'"),
            H.AuthRule("Allow", targets=(("b", "t"),), claims=(H.ClaimRule("org.unit", ("x", "y")),), scopes=("read", "write")),
            H.AuthRule("Allow", scopes=("admin",)),
            H.AuthRule("Deny", claims=(H.ClaimRule("groups", ("ops",), "StringArray"),)),
        ],
        "b": [H.AuthRule("Allow", claims=(H.ClaimRule("scope", ("read",)),)), H.AuthRule("Allow", condition="CAST(tool AS INT) > 3"), H.AuthRule("Allow", scopes=("q", "r", "s"))],
        "c": [],
    }
    defaults = {"a": "Deny", "b": "Allow", "c": "Deny"}
    bodies = [None, {}, {"scope": "read write", "org": {"unit": "x"}}, {"scope": ["admin"]}, {"groups": ["dev", "ops"]}, {"groups": "ops", "scp": "read"}, {"org": {"unit": 3}}]
    rows = [(r, token(b) if b is not None else None, t[0], t[1]) for r in "abcd" for b in bodies for t in (("b", "t"), ("b", "drop"), ("z", "7"), (None, None))]
    calls_ = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, route string, authorization string, backend string, tool string")
    table = [
        (r, i, x.action, x.condition, [list(t) for t in x.targets] or None, [(c.path, list(c.values), c.kind) for c in x.claims] or None, list(x.scopes) or None)
        for r, xs in rules.items() for i, x in enumerate(xs)
    ]
    schema = "route string, " + ", ".join(f"{c} {k}" for c, k in H.RULE_COLUMNS.items())
    got = H.authorize_calls_by_route(
        calls_, spark.createDataFrame(table, schema), spark.createDataFrame(list(defaults.items()), "route string, default_action string"), resource_metadata="https://m"
    )
    assert {"i", "route", "allowed", "rule_idx", "scope_challenge"} <= set(got.columns) and not [c for c in got.columns if c.startswith("_")]
    want = {}
    for r in "abcd":
        one = H.authorize_calls(calls_.where(F.col("route") == r), rules.get(r), defaults.get(r, "Deny"), resource_metadata="https://m")
        want |= {x["i"]: (x["allowed"], x["rule_idx"], x["scope_challenge"]) for x in one.collect()}
    assert {x["i"]: (x["allowed"], x["rule_idx"], x["scope_challenge"]) for x in got.collect()} == want


def test_routes_weigh_as_their_own_list_does(spark):
    refs = {"a": [("x", 0, 3), ("y", 0, 2), ("z", 1, 9)], "b": [("m", 5, 1), ("n", 2, 0)], "c": [("n", 0, 0)]}
    requests = spark.range(400).selectExpr("id AS request_id", "element_at(array('a', 'b', 'c', 'd'), CAST(1 + id % 4 AS INT)) AS route")
    table = spark.createDataFrame([(r, *x) for r, xs in refs.items() for x in xs], "route string, backend string, priority int, weight int")
    got = {r["request_id"]: r["selected_backend"] for r in H.weighted_backend_by_route(requests, table).collect()}
    want = {}
    for r in "abcd":
        one = H.weighted_backend(requests.where(F.col("route") == r), [H.BackendRef(*x) for x in refs.get(r, [])])
        want |= {x["request_id"]: x["selected_backend"] for x in one.collect()}
    assert got == want and {"x", "y", "m", None} == set(got.values())


@pytest.mark.parametrize(
    "condition",
    ["to_date(arg) IS NOT NULL", "to_timestamp(arg) > TIMESTAMP'2020-01-01 00:00:00'", "element_at(split(arg, ','), 3) = 'c'", "int(arg) > 3", "to_number(arg, '99') = 3", "mod(n, n) = 0"],
)
def test_conditions_that_fail_are_no_match(spark, condition):
    df = spark.createDataFrame([(1, None, "b", "t", "a,b", 0)], "i int, authorization string, backend string, tool string, arg string, n int")
    out = H.authorize_calls(df, [H.AuthRule("Allow", condition=condition)]).collect()[0]
    assert out["allowed"] is False and out["rule_idx"] is None


@pytest.mark.parametrize("condition", ["raise_error('x') IS NULL", "split(arg, ',')[5] = 'a'", "pmod(n, 0) = 1", "assert_true(false) IS NULL", "arg RLIKE backend", "regexp_like(arg, tool)", "sequence(1, n)[3] = 1"])
def test_conditions_that_could_end_a_job_are_refused_when_read(spark, condition):
    df = spark.createDataFrame([(1, None, "b", "t", "a,b", 0)], "i int, authorization string, backend string, tool string, arg string, n int")
    with pytest.raises(ValueError, match="can end the job"):
        H.authorize_calls(df, [H.AuthRule("Allow", condition=condition)])
