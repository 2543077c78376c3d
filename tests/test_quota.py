import random

import pytest

from trafficlake.operators import quota as Q
from trafficlake.plans.running import prior_totals, time_slices

HOUR = 3_600_000_000


def log(spark, seed=1, n=600, keys=("hot", "hot", "hot", "a", None)):
    rnd = random.Random(seed)
    data = [(i, rnd.choice(keys), rnd.randrange(0, 6 * HOUR) if i % 5 else 7 * HOUR, rnd.choice([None, 0, 1, 3, 20])) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, k string, at long, cost long").repartition(5)


def serial_prior(data):
    used, out = {}, {}
    for i, k, at, c in sorted(data, key=lambda r: (r[2], r[0])):
        out[i] = used.get(k, 0)
        used[k] = used.get(k, 0) + (c or 0)
    return out


@pytest.mark.parametrize("hot_rows,per_slice", [(10**9, 10), (50, 10), (0, 3), (50, 10**6)])
def test_running_total_is_the_same_with_hot_groups_split(spark, hot_rows, per_slice):
    data, df = log(spark)
    got = prior_totals(df, ["k"], "at", ["id"], {"u": "cost"}, hot_rows, per_slice)
    assert {r["id"]: r["u"] for r in got.collect()} == serial_prior(data)


def test_a_stray_time_leaves_the_slices_of_a_hot_key_small(spark):
    rnd = random.Random(5)
    data = [(i, "hot", rnd.randrange(0, HOUR), 1) for i in range(6000)] + [(6000, "hot", 10**17, 1), (6001, "hot", -(10**15), 1), (6002, "cold", 5, 1)]
    df = spark.createDataFrame(data, "id long, k string, at long, cost long").repartition(5)
    every, hot, slices = time_slices(df, ["k"], "at", 1000, 100)
    sizes = [r["count"] for r in every.where("k = 'hot'").groupBy(*slices).count().collect()]
    assert sum(sizes) == 6002 and max(sizes) < 200 and hot.count() == 6002
    got = prior_totals(df, ["k"], "at", ["id"], {"u": "cost"}, 1000, 100)
    assert {r["id"]: r["u"] for r in got.collect()} == serial_prior(data)


def test_fixed_window_crossing_request_passes(spark, rows):
    df = spark.createDataFrame([("u", i, i, c) for i, c in enumerate([0, 20, 10000, 0])], "k string, id long, at long, cost long")
    out = rows(Q.fixed_window_limit(df, ["k"], "at", "id", "cost", 1000), "id")
    assert [r["status"] for r in out] == [200, 200, 200, 429]
    at_limit = spark.createDataFrame([("u", 0, 0, 10), ("u", 1, 1, 0)], "k string, id long, at long, cost long")
    assert [r["refused"] for r in rows(Q.fixed_window_limit(at_limit, ["k"], "at", "id", "cost", 10), "id")] == [False, True]
    assert [r["refused"] for r in rows(Q.fixed_window_limit(at_limit, ["k"], "at", "id", "cost", 10, strict=True), "id")] == [False, False]
    assert [r["over_limit"] for r in rows(Q.quota_shadow_rule(at_limit, ["k"], "at", "id", "cost", 10), "id")] == [False, True]


def test_durations(spark, rows):
    df = spark.createDataFrame([(x,) for x in ("30", "30s", "5m", "1h", "x", "", "1d")], "duration string")
    assert {r["duration"]: r["seconds"] for r in rows(Q.parse_duration(df))} == {"30": 30, "30s": 30, "5m": 300, "1h": 3600, "x": None, "": None, "1d": None}
    assert Q.duration_seconds("2m") == 120
    with pytest.raises(ValueError):
        Q.duration_seconds("5d")


def serial_buckets(data, buckets, matches, mode):
    """Straight re-computation: every request looks at all admitted ones."""
    admitted, out = {}, {}
    for i, k, at, c in sorted(data, key=lambda r: (r[2], r[0])):
        mine = admitted.setdefault(k, [])

        def used(b):
            return sum(cost for t, cost, hit in mine if b in hit and t > at - buckets[b].duration_s * 1_000_000)

        ruled = [b for b, x in enumerate(buckets) if x.when is not None and matches(i, b)]
        default = [b for b, x in enumerate(buckets) if x.when is None]
        room = lambda b: buckets[b].shadow or used(b) < buckets[b].limit
        if mode == "Shared":
            charged = ruled + default
            ok = all(room(b) for b in charged)
        else:
            charged = ruled or default
            ok = not charged or any(room(b) for b in charged)
        out[i] = ok
        if ok:
            mine.append((at, c or 0, set(charged)))
    return out


BUCKETS = [Q.Bucket("even", 15, 1800, "id % 2 = 0"), Q.Bucket("third", 25, 3600, "id % 3 = 0"), Q.Bucket("seen", 5, 600, "id % 5 = 0", shadow=True), Q.Bucket("default", 40, 2400)]


@pytest.mark.parametrize("mode", ["Shared", "Exclusive"])
@pytest.mark.parametrize("seed", [1, 2])
def test_buckets_against_brute_force(spark, mode, seed):
    data, df = log(spark, seed)
    want = serial_buckets(data, BUCKETS, lambda i, b: i % (2, 3, 5)[b] == 0, mode)
    got = Q.bucket_mode(df, BUCKETS, mode, ["k"], "at", "id", "cost")
    assert {r["id"]: r["allowed"] for r in got.collect()} == want
    assert not all(want.values()) and any(want.values())


@pytest.mark.parametrize("limit", [5, 60, 10**6])
def test_trailing_window_against_brute_force(spark, limit):
    data, df = log(spark, 3)
    want = serial_buckets(data, [Q.Bucket("q", limit, 900)], None, "Shared")
    got = Q.sliding_window_quota(df, ["k"], "at", "id", "cost", limit, 900)
    assert {r["id"]: r["allowed"] for r in got.collect()} == want


def test_stretches_split_a_key(spark):
    _, df = log(spark, 4, keys=("one",))
    cut = Q.independent_stretches(df, ["k"], "at", "cost", 10**6, 900_000_000)
    assert cut.select("_stretch").distinct().count() > 10
    assert cut.count() == df.count()


def test_charge_at_completion(spark, rows):
    df = spark.createDataFrame([("u", 0, 0, 100, 50), ("u", 1, 50, 60, 1), ("u", 2, 100, 200, 1)], "k string, id long, s long, e long, cost long")
    out = rows(Q.charge_at_completion(df, ["k"], "s", "e", "id", "cost", 50), "id")
    assert [(r["used"], r["refused"]) for r in out] == [(0, False), (0, False), (51, True)]


def test_multi_rule_refuses_when_any_is_out(spark, rows):
    df = spark.createDataFrame([("u", i, i, 1, 5) for i in range(4)], "k string, id long, at long, a long, b long")
    rules = [Q.LimitRule("a", "a", 3), Q.LimitRule("b", "b", 10), Q.LimitRule("s", "b", 1, shadow=True)]
    out = rows(Q.multi_rule_limit(df, rules, ["k"], "at", "id"), "id")
    assert [r["refused"] for r in out] == [False, False, True, True]
    assert [r["exhausted"] for r in out] == [[], ["s"], ["b", "s"], ["a", "b", "s"]]


def test_selectors_and_routing(spark, rows):
    with pytest.raises(ValueError):
        Q.client_selectors(spark.createDataFrame([({"a": "b"},)], "headers map<string,string>"), [Q.ClientSelector("a", "Regex")])
    df = spark.createDataFrame([(0, [2]), (1, [2, 3]), (2, [2, 3, 4]), (3, [])], "i int, violated array<int>")
    out = rows(Q.quota_aware_route(df, [("od", 1, 4), ("east", 0, 2), ("west", 0, 3)]), "i")
    assert [(r["selected_backend"], r["status"]) for r in out] == [("west", 200), ("od", 200), (None, 429), ("east", 200)]


POLICY_QUOTAS = "backend string, model string, mode string, expression string, limit long, duration string"
POLICY_RULES = "backend string, model string, rule int, selectors array<struct<header: string, kind: string, value: string>>, limit long, duration string, shadow boolean"
QUOTA_ROWS = [("a", "m", "Shared", None, 90, "1h"), ("a", "x", "Exclusive", "input_tokens * 2", 30, "1800"), ("a", None, None, None, 60, "40m"), ("b", "m", "Exclusive", None, None, None)]
RULE_ROWS = [
    ("a", "m", 0, [("team", "Distinct", None)], 9, "30m", None),
    ("a", "m", 3, [("tier", "Exact", "free"), ("team", "Distinct", None)], 10, "1h", True),
    ("a", "x", 0, [("team", "Distinct", None)], 40, "20m", False),
    ("a", "x", 1, [("tier", "Exact", "free")], 12, "60m", False),
    ("b", "m", 0, None, 70, "600s", False),
]


def serial_policy(data):
    """Straight re-computation: every request looks at all charges made before it."""
    seconds = {"1h": 3600, "1800": 1800, "40m": 2400, "30m": 1800, "20m": 1200, "60m": 3600, "600s": 600}
    quotas = {(b, m): (mode or "Shared", e, limit, d) for b, m, mode, e, limit, d in QUOTA_ROWS}
    charges, out = {}, {}
    for i, b, m, at, cost, headers in sorted(data, key=lambda r: (r[3], r[0])):
        key = (b, m) if (b, m) in quotas else (b, None)
        if key not in quotas:
            out[i] = (True, [])
            continue
        mode, expression, limit, duration = quotas[key]
        drawn = []
        for rb, rm, rule, selectors, rlimit, rduration, shadow in RULE_ROWS:
            have = [(headers or {}).get(h) for h, _, _ in selectors or []]
            if (rb, rm) == key and all(v is not None if s[1] == "Distinct" else v == s[2] for v, s in zip(have, selectors or [])):
                drawn.append(((rule, tuple(v for v, s in zip(have, selectors or []) if s[1] == "Distinct")), rlimit, seconds[rduration], bool(shadow)))
        if limit is not None and (mode == "Shared" or not drawn):
            drawn.append(((-1, ()), limit, seconds[duration], False))
        mine = charges.setdefault(key, [])
        full = [sum(c for t, c, names in mine if name in names and t > at - span * 1_000_000) >= lim for name, lim, span, _ in drawn]
        room = [d[3] or not f for d, f in zip(drawn, full)]
        ok = not room or (all(room) if mode == "Shared" else any(room))
        if ok:
            mine.append((at, (cost or 0) * (2 if expression else 1), [d[0] for d in drawn]))
        out[i] = (ok, [d[0][0] for d, f in zip(drawn, full) if f])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_policy_of_many_quotas_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = []
    for i in range(900):
        headers = {h: v for h, v in (("team", rnd.choice(["r", "g", "b", None])), ("tier", rnd.choice(["free", "paid"]))) if v}
        at = rnd.randrange(0, 4 * HOUR) if i % 7 else 5 * HOUR
        data.append((i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice(["m", "m", "x", "y", None]), at, rnd.choice([None, 0, 1, 3, 8]), headers if i % 11 else None))
    # columns named like those that the operator uses or adds
    df = spark.createDataFrame([(*r, r[0], "old", r[4]) for r in data], "id long, backend string, model string, at long, input_tokens long, headers map<string,string>, _row long, status string, total_tokens long").repartition(5)
    got = Q.quota_policy_limit(df, spark.createDataFrame(QUOTA_ROWS, POLICY_QUOTAS), spark.createDataFrame(RULE_ROWS, POLICY_RULES), "at", "id")
    assert got.columns == ["id", "backend", "model", "at", "input_tokens", "headers", "_row", "total_tokens", "quota_model", "quota_cost", "allowed", "exhausted", "status"]
    want = serial_policy(data)
    found = {r["id"]: (r["allowed"], r["exhausted"]) for r in got.collect()}
    assert found == want
    refused = {r for ok, out in want.values() if not ok for r in out}
    assert {0, 1, -1} <= refused and any(ok and 3 in out for ok, out in want.values())


def test_policy_keeps_named_columns(spark, rows):
    df = spark.range(50).selectExpr("id", "'a' AS backend", "'m' AS model", "id AS at", "3L AS input_tokens", "3L AS total_tokens", "map('team', 'r') AS headers", "repeat('x', id) AS wide")
    tables = spark.createDataFrame(QUOTA_ROWS, POLICY_QUOTAS), spark.createDataFrame(RULE_ROWS, POLICY_RULES)
    got = Q.quota_policy_limit(df, *tables, "at", "id", keep=["id"])
    assert got.columns == ["id", "quota_model", "quota_cost", "allowed", "exhausted", "status"]
    assert rows(got, "id") == rows(Q.quota_policy_limit(df, *tables, "at", "id").select(got.columns), "id")
    assert "AS wide" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_policy_without_requests_or_entries(spark, rows):
    df = spark.createDataFrame([(1, "a", "m", 0, 5, None), (2, None, None, 1, None, {"team": "r"})], "id long, backend string, model string, at long, total_tokens long, headers map<string,string>")
    quotas, rules = spark.createDataFrame(QUOTA_ROWS, POLICY_QUOTAS), spark.createDataFrame(RULE_ROWS, POLICY_RULES)
    assert Q.quota_policy_limit(df.limit(0), quotas, rules, "at", "id").collect() == []
    free = rows(Q.quota_policy_limit(df, quotas.limit(0), rules.limit(0), "at", "id"), "id")
    assert [(r["allowed"], r["exhausted"], r["quota_cost"], r["status"]) for r in free] == [(True, [], None, 200)] * 2


@pytest.mark.parametrize("quota, rule", [
    (("a", "m", "Other", None, 1, "1s"), None), ((None, "m", "Shared", None, 1, "1s"), None), (("a", "m", "Shared", None, -1, "1s"), None),
    (("a", "m", "Shared", None, 1, "1d"), None), (("a", "m", "Shared", "input_tokens +", 1, "1s"), None), (("a", "m", "Shared", None, 1, "1s"), ("a", "n", 0, None, 1, "1s", None)),
    (("a", "m", "Shared", None, 1, "1s"), ("a", "m", 0, [("h", "Regex", "x")], 1, "1s", None)), (("a", "m", "Shared", None, 1, "1s"), ("a", "m", 0, None, None, "1s", None)),
    (("a", "m", "Shared", None, 1, "1s"), ("a", "m", None, None, 1, "1s", None)),
])
def test_a_policy_that_cannot_be_carried_out_is_refused(spark, quota, rule):
    df = spark.createDataFrame([(1, "a", "m", 0, {"h": "x"})], "id long, backend string, model string, at long, headers map<string,string>")
    with pytest.raises(ValueError):
        Q.quota_policy_limit(df, spark.createDataFrame([quota], POLICY_QUOTAS), spark.createDataFrame([rule] if rule else [], POLICY_RULES), "at", "id")


def test_forgotten_buckets_keep_no_state():
    fold = Q.PolicyFold()
    for i in range(5000):
        fold.admit(i, 1, [(f"c{i}", 0, 10, 100, False)], True)
    assert len(fold.open) < 2500
    assert fold.admit(5000, 1, [("c4999", 0, 1, 100, False)], True) == (False, [0])
