"""Rate limits and quotas.

Inside one fixed window use never falls, so every request after the crossing is refused whatever the
refused ones would have cost: the running total over *all* earlier requests gives the verdict. That is
a skew-safe running total (``prior_totals``). Trailing windows and buckets that share requests are
truly sequential; they are folded over sorted rows, cut into independent stretches first.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import computed_once
from ..plans.running import HOT_ROWS, prior_totals
from .cost import cost_expression
from .usage import USAGE

# Seconds per duration suffix (no suffix means seconds) and per limit unit.
DURATION_SECONDS = {"s": 1, "m": 60, "h": 3600}
UNIT_SECONDS = {"Second": 1, "Minute": 60, "Hour": 3600, "Day": 86400}

# Fixed value: cost of a request when a quota gives no expression.
DEFAULT_QUOTA_EXPRESSION = "total_tokens"

ALLOWED_STATUS, REFUSED_STATUS = 200, 429


def parse_duration(df: DataFrame, source: str = "duration", out: str = "seconds") -> DataFrame:
    """``30``, ``30s``, ``5m``, ``1h`` to seconds; anything else is NULL."""
    number = F.regexp_extract(F.col(source), r"^([0-9]+)([smh]?)$", 1)
    suffix = F.regexp_extract(F.col(source), r"^([0-9]+)([smh]?)$", 2)
    factor = F.when(suffix == "m", 60).when(suffix == "h", 3600).otherwise(1)
    return df.withColumn(out, number.try_cast("bigint") * factor)


def duration_seconds(text: str) -> int:
    """The same for one configured duration."""
    digits, suffix = (text[:-1], text[-1]) if text and text[-1] in DURATION_SECONDS else (text, "s")
    if not digits.isdigit():
        raise ValueError(f"bad duration {text!r}")
    return int(digits) * DURATION_SECONDS[suffix]


def window_start(at_us: Column, unit: str) -> Column:
    width = UNIT_SECONDS[unit] * 1_000_000
    return (F.floor(at_us / width) * width).cast("bigint")


def _out_of_budget(used: Column, limit: Column, strict: bool) -> Column:
    return (used > limit) if strict else (used >= limit)


def fixed_window_limit(
    df: DataFrame, keys: Sequence[str], at_us: str, tie: str, cost: str, limit: int | Column, unit: str = "Hour",
    strict: bool = False, shadow: bool = False, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``window_us, used, refused, status`` of an aligned fixed-window limit.

    A request costs nothing up front and its cost counts once it is answered: it is refused when use
    has reached the limit before it (``strict``: exceeded it), so the request that crosses passes.
    A ``shadow`` rule counts but never refuses.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    w = df.withColumn("window_us", window_start(F.col(at_us), unit))
    run = prior_totals(w, [*keys, "window_us"], at_us, [tie], {"used": cost}, hot_rows)
    over = _out_of_budget(F.col("used"), limit, strict)
    refused = F.lit(False) if shadow else over
    return run.withColumns(
        {
            "over_limit": over,
            "refused": refused,
            "status": F.when(refused, REFUSED_STATUS).otherwise(ALLOWED_STATUS),
        }
    )


@dataclass(frozen=True)
class ClientSelector:
    """One header condition: ``Distinct`` values partition the budget, ``Exact`` ones select requests."""

    header: str
    kind: str = "Distinct"
    value: str | None = None


def client_selectors(df: DataFrame, selectors: Sequence[ClientSelector], headers: str = "headers") -> DataFrame:
    """Keep the requests a rule applies to and add ``client_key``, the budget they draw on.

    The key is the JSON list of the distinguishing header values, so no two lists of values share a budget.
    """
    parts, cond = [], F.lit(True)
    for s in selectors:
        value = F.try_element_at(F.col(headers), F.lit(s.header))
        if s.kind == "Exact":
            cond = cond & F.coalesce(value == s.value, F.lit(False))
        elif s.kind == "Distinct":
            cond = cond & value.isNotNull()
            parts.append(value)
        else:
            raise ValueError(f"unknown selector kind {s.kind!r}")
    return df.where(cond).withColumn("client_key", F.to_json(F.array(*parts)) if parts else F.lit("[]"))


@dataclass(frozen=True)
class LimitRule:
    name: str
    cost: str
    limit: int
    shadow: bool = False


def multi_rule_limit(
    df: DataFrame, rules: Sequence[LimitRule], keys: Sequence[str], at_us: str, tie: str, unit: str = "Hour",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Several rules over the same key and window: refused when any enforced one is exhausted.

    All running totals share one shuffle and one sort.
    """
    w = df.withColumn("window_us", window_start(F.col(at_us), unit))
    run = prior_totals(
        w, [*keys, "window_us"], at_us, [tie], {f"used_{r.name}": r.cost for r in rules}, hot_rows
    )
    over = {r.name: F.col(f"used_{r.name}") >= r.limit for r in rules}
    refused = F.lit(False)
    for r in rules:
        if not r.shadow:
            refused = refused | over[r.name]
    exhausted = F.array_compact(F.array(*[F.when(over[r.name], F.lit(r.name)) for r in rules]))
    return run.withColumns({"exhausted": exhausted, "refused": refused})


def budget_report(df: DataFrame, keys: Sequence[str], at_us: str, cost: str, limit: int, unit: str = "Hour") -> DataFrame:
    """Use, limit and what remains per key and window (a plain aggregate)."""
    used = df.groupBy(*keys, window_start(F.col(at_us), unit).alias("window_us")).agg(
        F.coalesce(F.sum(cost), F.lit(0)).alias("used")
    )
    return used.withColumns(
        {"limit": F.lit(limit).cast("bigint"), "remaining": F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("bigint")}
    )


def quota_resolution(requests: DataFrame, per_model: DataFrame, service: DataFrame, backend: str = "backend", model: str = "model") -> DataFrame:
    """Quota that applies to each request: the model's own one, else the backend's service quota."""
    m = per_model.select(
        backend, model, F.col("limit").alias("_ml"), F.col("duration").alias("_md"), F.col("expression").alias("_me"),
        F.lit(True).alias("_own"),
    )
    s = service.select(
        backend, F.col("limit").alias("_sl"), F.col("duration").alias("_sd"), F.col("expression").alias("_se")
    )
    j = requests.join(m, [backend, model], "left").join(s, [backend], "left")
    own = F.coalesce(F.col("_own"), F.lit(False))

    def pick(a: str, b: str) -> Column:
        return F.when(own, F.col(a)).otherwise(F.col(b))

    return j.select(
        *requests.columns,
        pick("_ml", "_sl").alias("quota_limit"),
        pick("_md", "_sd").alias("quota_duration"),
        F.coalesce(pick("_me", "_se"), F.lit(DEFAULT_QUOTA_EXPRESSION)).alias("quota_expression"),
    )


def quota_aware_route(
    requests: DataFrame, backends: Sequence[tuple[str, int, int]], violated: str = "violated"
) -> DataFrame:
    """First backend by priority (then listing order) whose quota index is not violated; none is a 429.

    ``backends`` lists ``(name, priority, quota_index)``; ``violated`` is an array of quota indexes.
    """
    ranked = sorted(enumerate(backends), key=lambda x: (x[1][1], x[0]))
    choice: Column | None = None
    for _, (name, _priority, index) in ranked:
        free = ~F.array_contains(F.col(violated), F.lit(index))
        choice = F.when(free, F.lit(name)) if choice is None else choice.when(free, F.lit(name))
    assert choice is not None
    return requests.withColumn("selected_backend", choice).withColumn(
        "status", F.when(F.col("selected_backend").isNull(), REFUSED_STATUS).otherwise(ALLOWED_STATUS)
    )


def quota_aware_route_by_policy(
    requests: DataFrame, backends: DataFrame, violations: DataFrame, route: str = "route", keys: Sequence[str] = ("tenant", "model")
) -> DataFrame:
    """First backend of a request's route, by priority then listing order, whose quota its ``keys`` do not violate; none is a 429.

    ``backends`` holds ``(route, backend, priority, listed)``, ``violations`` ``(keys, backend)`` with a row per quota that is
    used up, repeated ones and NULL keys included. Both are collected per key into one row, so requests are joined once with each
    and never multiplied. A route without backends is a 429, too.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("priority", F.lit(0)).alias("priority"), "listed", "backend")))
    order = backends.groupBy(route).agg(listed.alias("_order"))
    key = F.to_json(F.struct(*keys))
    out = violations.select(key.alias("_key"), "backend").groupBy("_key").agg(F.collect_set("backend").alias("_out"))
    joined = requests.withColumn("_key", key).join(order, route, "left").join(out, "_key", "left")
    used_up = F.coalesce("_out", F.array().cast("array<string>"))
    free = F.get(F.filter("_order", lambda b: ~F.array_contains(used_up, b["backend"])), F.lit(0))
    routed = joined.withColumn("selected_backend", free["backend"]).drop("_key", "_order", "_out")
    return routed.withColumn("status", F.when(F.col("selected_backend").isNull(), REFUSED_STATUS).otherwise(ALLOWED_STATUS))


def charge_at_completion(
    df: DataFrame, keys: Sequence[str], start_us: str, end_us: str, tie: str, cost: str, limit: int, unit: str = "Hour",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Check at request start against what was *charged* by then: requests in flight do not count yet.

    Each request is a check at its start and a charge at its end, each in the window of its own time;
    a charge at the very instant of a check counts.
    """
    events = df.select(
        *keys, F.col(tie).alias("_id"),
        F.explode(
            F.array(
                F.struct(F.col(start_us).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_cost")),
                F.struct(F.col(end_us).alias("_at"), F.lit(0).alias("_kind"), F.coalesce(F.col(cost), F.lit(0)).cast("bigint").alias("_cost")),
            )
        ).alias("_e"),
    ).select(*keys, "_id", "_e.*").withColumn("window_us", window_start(F.col("_at"), unit))
    run = prior_totals(events, [*keys, "window_us"], "_at", ["_kind", "_id"], {"used": "_cost"}, hot_rows)
    checks = run.where("_kind = 1")
    return checks.select(
        *keys, F.col("_id").alias(tie), F.col("_at").alias(start_us), "window_us", "used",
        (F.col("used") >= limit).alias("refused"),
    )


# --- trailing windows and buckets: sequential per key ---------------------------------------------


@dataclass(frozen=True)
class Bucket:
    """A trailing-window budget; ``when`` is a SQL condition on the request (None: default bucket)."""

    name: str
    limit: int
    duration_s: int
    when: str | None = None
    shadow: bool = False


def independent_stretches(
    df: DataFrame, keys: Sequence[str], at_us: str, cost: str, limit: int | Column, duration_us: int | Column
) -> DataFrame:
    """Add ``_stretch``: runs of time slices whose verdicts depend on nothing before the run.

    Time is cut into slices as long as the trailing window. If the costs of a slice and of the one
    before it stay below the limit, nothing in the slice can be refused, whatever came earlier; the
    next slice then sees only admitted requests of this one. So a fold may start fresh at such a slice,
    and after an empty one. Slice totals combine map-side. Limit and duration may be columns that are the
    same in all rows of a key.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(at_us) / duration_us).cast("bigint"))
    least = F.min(limit) if isinstance(limit, Column) else F.lit(limit)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(F.coalesce(F.col(cost), F.lit(0))).alias("_total"), least.alias("_least"))
    by_time = Window.partitionBy(*keys).orderBy("_slice")
    before = F.when(F.lag("_slice").over(by_time) == F.col("_slice") - 1, F.lag("_total").over(by_time))
    marked = totals.withColumn(
        "_fresh", F.when(before.isNull() | (before + F.col("_total") < F.col("_least")), F.col("_slice"))
    )
    stretches = marked.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_s"),
        F.max("_fresh").over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("_stretch"),
    )
    cond = F.col("_slice") == F.col("_s")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return sliced.join(stretches, cond).select(*df.columns, "_stretch")


class TrailingFold:
    """Admission over one stretch, row by row in time order; state is what is inside the windows."""

    def __init__(self, buckets: Sequence[Bucket], mode: str, strict: bool = False):
        self.buckets, self.mode, self.strict = list(buckets), mode, strict
        self.reset()

    def reset(self) -> None:
        self.queues = [deque() for _ in self.buckets]
        self.used = [0] * len(self.buckets)

    def _below(self, i: int, used: int) -> bool:
        return used <= self.buckets[i].limit if self.strict else used < self.buckets[i].limit

    def _room(self, i: int) -> bool:
        return self.buckets[i].shadow or self._below(i, self.used[i])

    def _expire(self, i: int, at_us: int) -> None:
        q, edge = self.queues[i], at_us - self.buckets[i].duration_s * 1_000_000
        while q and q[0][0] <= edge:
            self.used[i] -= q.popleft()[1]

    def _closed_until(self, at_us: int) -> float | None:
        """When every request passes one enforced default bucket that is full: the time it has room."""
        for i, b in enumerate(self.buckets):
            if self.mode == "Shared" and b.when is None and not b.shadow:
                self._expire(i, at_us)
                used = self.used[i]
                if self._below(i, used):
                    continue
                for t, c in self.queues[i]:
                    used -= c
                    if self._below(i, used):
                        return t + b.duration_s * 1_000_000
                return math.inf
        return None

    def run(self, at: np.ndarray, cost: np.ndarray, matches: list[Sequence[bool]]) -> np.ndarray:
        """Verdicts of consecutive requests. While the default bucket is full, all refused ones are skipped at once."""
        allowed, i, times, costs = np.zeros(len(at), dtype=bool), 0, at.tolist(), cost.tolist()
        while i < len(times):
            opens = self._closed_until(times[i])
            if opens is not None:
                i = len(times) if opens == math.inf else i + int(np.searchsorted(at[i:], opens, "left"))
                continue
            allowed[i] = self.admit(times[i], costs[i], matches[i])
            i += 1
        return allowed

    def admit(self, at_us: int, cost: int, matches: Sequence[bool]) -> bool:
        for i in range(len(self.buckets)):
            self._expire(i, at_us)
        ruled = [i for i, b in enumerate(self.buckets) if b.when is not None and matches[i]]
        default = [i for i, b in enumerate(self.buckets) if b.when is None]
        if self.mode == "Shared":
            charged = ruled + default
            ok = all(self._room(i) for i in charged)
        else:
            charged = ruled or default
            ok = not charged or any(self._room(i) for i in charged)
        if ok and cost > 0:
            for i in charged:
                self.queues[i].append((at_us, cost))
                self.used[i] += cost
        return ok


def _fold_sorted(buckets: Sequence[Bucket], mode: str, strict: bool, group: list[str], match_cols: list[str]):
    def run(batches):
        fold, current = TrailingFold(buckets, mode, strict), None
        for pdf in batches:
            # NULL keys read back as NaN, which never equals itself
            groups = list(zip(*[[None if v != v else v for v in pdf[g].tolist()] for g in group]))
            flags = list(zip(*[pdf[m].tolist() for m in match_cols]))
            at, cost = pdf["_at"].to_numpy(), pdf["_cost"].to_numpy()
            allowed, start = np.zeros(len(pdf), dtype=bool), 0
            while start < len(groups):
                end = start + 1
                while end < len(groups) and groups[end] == groups[start]:
                    end += 1
                if groups[start] != current:
                    fold.reset()
                    current = groups[start]
                allowed[start:end] = fold.run(at[start:end], cost[start:end], flags[start:end])
                start = end
            yield pdf.drop(columns=["_at", "_cost", *match_cols]).assign(allowed=allowed)

    return run


def bucket_mode(
    df: DataFrame, buckets: Sequence[Bucket], mode: str, keys: Sequence[str], at_us: str, tie: str, cost: str,
    strict: bool = False,
) -> DataFrame:
    """Trailing-window quota buckets per key; refused requests are not charged.

    ``Exclusive``: the matching rule buckets, else the default one, and only refused when all of them
    are out. ``Shared``: matching rules and the default must all have room. Adds ``allowed``.

    Verdicts are sequential, so rows are cut into independent stretches, hashed by (key, stretch),
    sorted, and streamed through a fold whose state is one window's admitted requests. A group is never
    collected. A key that never leaves its limit stays one stretch; there nearly all requests are
    refused, and while the default bucket is full the fold jumps over them by binary search.
    """
    if mode not in ("Exclusive", "Shared"):
        raise ValueError(f"unknown bucket mode {mode!r}")
    enforced = [b.limit for b in buckets if not b.shadow]
    widest = max(b.duration_s for b in buckets) * 1_000_000
    keys = list(keys)
    cut = independent_stretches(df, keys, at_us, cost, min(enforced, default=2**62), widest)
    match_cols = [f"_m{i}" for i in range(len(buckets))]
    prepared = cut.withColumns(
        {
            "_at": F.col(at_us),
            "_cost": F.coalesce(F.col(cost), F.lit(0)).cast("bigint"),
            **{m: F.coalesce(F.expr(b.when), F.lit(False)) if b.when else F.lit(True) for m, b in zip(match_cols, buckets)},
        }
    )
    group = [*keys, "_stretch"]
    ordered = prepared.repartition(*group).sortWithinPartitions(*group, at_us, tie)
    schema = T.StructType([*[f for f in cut.schema.fields], T.StructField("allowed", T.BooleanType())])
    fold = _fold_sorted(list(buckets), mode, strict, group, match_cols)
    return ordered.mapInPandas(fold, schema).drop("_stretch")


def sliding_window_quota(
    df: DataFrame, keys: Sequence[str], at_us: str, tie: str, cost: str, limit: int, duration_s: int, strict: bool = False
) -> DataFrame:
    """Limit over the trailing duration; refused requests are not charged. Adds ``allowed``."""
    return bucket_mode(df, [Bucket("quota", limit, duration_s)], "Shared", keys, at_us, tie, cost, strict)


def quota_shadow_rule(
    df: DataFrame, keys: Sequence[str], at_us: str, tie: str, cost: str, limit: int, unit: str = "Hour"
) -> DataFrame:
    """A shadow rule: use is counted and ``over_limit`` shown, nothing is refused."""
    return fixed_window_limit(df, keys, at_us, tie, cost, limit, unit, shadow=True)


# --- a policy table: quotas per backend and model, with rules for clients ---------------------------

#: Columns of a quota table; all but ``backend`` may be NULL or missing.
QUOTA_COLUMNS = {"backend": "string", "model": "string", "mode": "string", "expression": "string", "limit": "bigint", "duration": "string"}
#: Columns of its rule table; ``model``, ``selectors`` and ``shadow`` may be NULL or missing.
QUOTA_RULE_COLUMNS = {
    "backend": "string", "model": "string", "rule": "int", "selectors": "array<struct<header: string, kind: string, value: string>>",
    "limit": "bigint", "duration": "string", "shadow": "boolean",
}
#: Number of a quota's default bucket among the exhausted ones.
DEFAULT_BUCKET = -1


def _policy_table(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    typed = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
    keyed = parse_duration(df.select(*typed), "duration", "_seconds")
    return keyed.withColumn("_key", F.to_json(F.struct("backend", "model")))


def _check_policy(quotas: DataFrame, rules: DataFrame) -> None:
    """Refuse a policy that cannot be carried out, naming one of its faults."""
    unlimited = "`limit` < 0 OR (`limit` IS NOT NULL AND coalesce(_seconds, 0) <= 0)"
    fault = F.expr(
        f"""CASE WHEN backend IS NULL THEN 'no backend' WHEN mode NOT IN ('Exclusive', 'Shared') THEN 'an unknown mode'
        WHEN {unlimited} THEN 'a bad limit or duration' WHEN count(*) OVER (PARTITION BY _key) > 1 THEN 'a second entry' END"""
    )
    rule_fault = F.expr(
        f"""CASE WHEN backend IS NULL OR rule IS NULL OR rule < 0 THEN 'no backend or no number' WHEN `limit` IS NULL OR {unlimited} THEN 'a bad limit or duration'
        WHEN exists(selectors, s -> s.header IS NULL OR s.kind IS NULL OR s.kind NOT IN ('Exact', 'Distinct') OR (s.kind = 'Exact' AND s.value IS NULL)) THEN 'a bad selector'
        WHEN count(*) OVER (PARTITION BY _key, rule) > 1 THEN 'a second entry' END"""
    )
    orphans = rules.join(quotas.select("_key"), "_key", "left_anti").select("_key", F.lit("rules but no quota").alias("_fault"))
    found = quotas.select("_key", fault.alias("_fault")).union(rules.select("_key", rule_fault.alias("_fault"))).union(orphans)
    bad = found.where("_fault IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"quota policy of {bad[0]['_key']} has {bad[0]['_fault']}")


class PolicyFold:
    """Admission over one stretch of a quota; every request brings the buckets it draws on."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.open: dict[str, list] = {}
        self.until_sweep = 1024

    def _use(self, bucket: str, at_us: int, span_us: int) -> int:
        state = self.open.get(bucket)
        if state is None:
            return 0
        spent, edge = state[0], at_us - span_us
        while spent and spent[0][0] <= edge:
            state[1] -= spent.popleft()[1]
        return state[1]

    def _sweep(self, at_us: int) -> None:
        """Forget buckets that nothing was charged to within their span, so that state stays one window."""
        self.open = {k: s for k, s in self.open.items() if s[0] and s[0][-1][0] > at_us - s[2]}
        self.until_sweep = max(1024, 2 * len(self.open))

    def admit(self, at_us: int, cost: int, buckets: Sequence[tuple], every: bool) -> tuple[bool, list[int]]:
        """``buckets`` are ``(id, rule, limit, span_us, shadow)``; ``every``: all of them must have room, else one of them."""
        full = [self._use(name, at_us, span) >= limit for name, _rule, limit, span, _shadow in buckets]
        room = [b[4] or not f for b, f in zip(buckets, full)]
        allowed = not room or (all(room) if every else any(room))
        if allowed and cost > 0:
            for name, _rule, _limit, span, _shadow in buckets:
                state = self.open.setdefault(name, [deque(), 0, span])
                state[0].append((at_us, cost))
                state[1] += cost
            self.until_sweep -= 1
            if self.until_sweep <= 0:
                self._sweep(at_us)
        return allowed, [b[1] for b, f in zip(buckets, full) if f]


def _packed(rule: Column, limit: Column, span: Column, shadow: Column, client: Column) -> Column:
    """A bucket as one text, its id as well; rows that wait to be sorted hold several."""
    return F.concat_ws(":", rule, limit, span, F.when(shadow, "1").otherwise("0"), client)


def _unpacked(name: str) -> tuple[str, int, int, int, bool]:
    rule, limit, span, shadow, _client = name.split(":", 4)
    return name, int(rule), int(limit), int(span), shadow == "1"


def _fold_policy(batches):
    fold, current = PolicyFold(), None
    for batch in batches:
        charged = batch.column("_charged")
        buckets = [_unpacked(name) for name in charged.flatten().to_pylist()]
        counts = pc.list_value_length(charged).to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("_group", "_stretch", "_at", "_charge", "_every")]
        allowed, exhausted, at = [], [], 0
        for group, stretch, time, cost, every, n in zip(*columns, counts):
            if (group, stretch) != current:
                fold.reset()
                current = (group, stretch)
            ok, out = fold.admit(time, cost, buckets[at : at + n], every)
            at += n
            allowed.append(ok)
            exhausted.append(out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("quota_model"), batch.column("quota_cost"), pa.array(allowed, pa.bool_()), pa.array(exhausted, pa.list_(pa.int32()))],
            names=["_row", "quota_model", "quota_cost", "allowed", "exhausted"],
        )


def quota_policy_limit(
    requests: DataFrame, quotas: DataFrame, rules: DataFrame, at_us: str, tie: str, backend: str = "backend", model: str = "model",
    headers: str = "headers", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Trailing-window quotas of a whole policy: backends, models, clients, limits and durations are rows of two tables.

    ``quotas`` holds ``QUOTA_COLUMNS``: a row with a model is that model's own quota, one without is the backend's quota for all
    models that have none; its limit and duration are the default bucket (no limit: no such bucket), its expression prices requests
    (none: ``total_tokens``). ``rules`` holds ``QUOTA_RULE_COLUMNS``: each is a bucket for the requests whose headers meet all its
    selectors, one per list of ``Distinct`` header values; a rule without selectors meets every request. ``Exclusive`` draws on the
    rules met, or on the default bucket if there are none, and refuses when all of those are used up; ``Shared`` (also where no mode
    is given) draws on both and refuses when one is. A shadow rule counts and never refuses. Refused requests are not charged.

    Adds ``quota_model`` (model of the quota that applied, NULL for a backend's), ``quota_cost`` (NULL where the expression has no
    result: charged as zero), ``allowed``, ``exhausted`` (numbers of the buckets without room, shadow ones included,
    ``DEFAULT_BUCKET`` for the default one) and ``status``; columns of these names are replaced. Requests without a quota or
    headers for a rule are allowed, or draw on what remains. A policy with an unknown mode or selector kind, a bad limit, duration
    or expression, a repeated entry or rules without a quota is refused when read. ``keep`` names the request's columns to return
    (all, if not given): rows of a quota that stays at its limit are sorted in one task, so its memory follows their width.

    The policy (a configuration) is joined as one row per quota, so requests are never multiplied, and each distinct expression is
    compiled once. Rows are cut into stretches that cannot depend on each other, by the smallest limit and the longest duration of
    their own quota, hashed by (quota, stretch), sorted and streamed through a fold that holds one window of charges.
    """
    q, r = _policy_table(quotas, QUOTA_COLUMNS), _policy_table(rules, QUOTA_RULE_COLUMNS)
    _check_policy(q, r)
    priced_by = F.coalesce("expression", F.lit(DEFAULT_QUOTA_EXPRESSION))
    expressions = sorted(x[0] for x in q.select(priced_by).distinct().collect())

    span = (F.col("_seconds") * 1_000_000).alias("span")
    entry = F.struct("rule", "limit", span, F.coalesce("shadow", F.lit(False)).alias("shadow"), F.coalesce("selectors", F.array().cast(QUOTA_RULE_COLUMNS["selectors"])).alias("selectors"))
    listed = r.groupBy("_key").agg(F.array_sort(F.collect_list(entry)).alias("_rules"), F.min("limit").alias("_least"), F.max(span).alias("_widest"))
    number = F.lit(None).cast("int")
    for i, e in enumerate(expressions):
        number = F.when(priced_by == e, i).otherwise(number)
    policy = q.join(listed, "_key", "left").select(
        "_key",
        F.struct(
            F.col("_key").alias("key"), F.col("model").alias("model"), (F.coalesce("mode", F.lit("Shared")) == "Shared").alias("every"), number.alias("price"),
            F.coalesce("_rules", F.array()).alias("rules"),
            F.when(F.col("limit").isNotNull(), _packed(F.lit(DEFAULT_BUCKET), F.col("limit"), span, F.lit(False), F.lit(""))).alias("default"),
            F.least("limit", "_least").alias("least"), F.greatest(span, "_widest").alias("widest"),
        ).alias("_p"),
    )

    added = ["quota_model", "quota_cost", "allowed", "exhausted", "status"]
    kept = [c for c in (requests.columns if keep is None else keep) if c not in added]
    rows = requests.select(
        F.struct(*kept).alias("_row"), F.col(backend).alias("backend"), F.col(model).alias("model"), F.col(headers).alias("_headers"),
        F.col(at_us).alias("_at"), F.col(tie).alias("_tie"), *[c for c in USAGE if c in requests.columns],
    )
    for i, e in enumerate(expressions):
        rows = cost_expression(rows, e, f"_cost{i}", f"_error{i}")
    costs = F.array(*[f"_cost{i}" for i in range(len(expressions))]).cast("array<bigint>")
    keyed = rows.withColumns({"_own_key": F.to_json(F.struct("backend", "model")), "_all_key": F.to_json(F.struct("backend")), "_costs": costs})
    own = policy.select(F.col("_key").alias("_own_key"), F.col("_p").alias("_own"))
    whole = policy.select(F.col("_key").alias("_all_key"), F.col("_p").alias("_all"))
    joined = keyed.join(own, "_own_key", "left").join(whole, "_all_key", "left").withColumn("_p", F.coalesce("_own", "_all"))

    def value(s: Column) -> Column:
        return F.try_element_at("_headers", s["header"])

    def met(x: Column) -> Column:
        return F.forall(x["selectors"], lambda s: F.when(s["kind"] == "Exact", F.coalesce(value(s) == s["value"], F.lit(False))).otherwise(value(s).isNotNull()))

    def bucket(x: Column) -> Column:
        client = F.transform(F.filter(x["selectors"], lambda s: s["kind"] == "Distinct"), value)
        return _packed(x["rule"], x["limit"], x["span"], x["shadow"], F.to_json(client))

    kind = "array<string>"
    by_rule = F.coalesce(F.transform(F.filter("_p.rules", met), bucket).cast(kind), F.array().cast(kind))
    default = F.array_compact(F.array(F.col("_p.default"))).cast(kind)
    matched = computed_once(joined, {"_matched": by_rule})
    every = F.coalesce("_p.every", F.lit(True))
    ready = matched.select(
        "_row", "_at", "_tie", F.col("_p.model").alias("quota_model"), F.get("_costs", F.col("_p.price")).alias("quota_cost"),
        F.col("_p.key").alias("_group"), every.alias("_every"),
        F.when(~every & (F.size("_matched") > 0), F.col("_matched")).otherwise(F.concat("_matched", default)).alias("_charged"),
        F.coalesce(F.get("_costs", F.col("_p.price")), F.lit(0).cast("bigint")).alias("_charge"),
        F.coalesce("_p.least", F.lit(2**62)).alias("_min_limit"), F.coalesce("_p.widest", F.lit(3_600_000_000)).alias("_max_span"),
    )
    cut = independent_stretches(ready, ["_group"], "_at", "_charge", F.col("_min_limit"), F.col("_max_span"))
    ordered = cut.drop("_min_limit", "_max_span").repartition("_group", "_stretch").sortWithinPartitions("_group", "_stretch", "_at", "_tie")
    fields = [cut.schema[c] for c in ("_row", "quota_model", "quota_cost")]
    schema = T.StructType([*fields, T.StructField("allowed", T.BooleanType()), T.StructField("exhausted", T.ArrayType(T.IntegerType()))])
    status = F.when(F.col("allowed"), ALLOWED_STATUS).otherwise(REFUSED_STATUS)
    return ordered.mapInArrow(_fold_policy, schema).select("_row.*", *added[:-1], status.alias("status"))
