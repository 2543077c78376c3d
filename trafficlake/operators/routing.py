"""Route matching, backend choice, mutations, tool catalogs, authorization, message pairing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import computed_once, hash_roll, json_text
from ..functions.tolerant import tolerant
from ..plans.running import HOT_ROWS, ROWS_PER_SLICE, prior_totals
from .parse import (
    CAPABILITY_BITS,
    TOOL_SEPARATOR,
    URI_SEPARATOR,
    jwt_payload,
    scopes_of,
)
from .usage import supported_pair

# Headers no mutation may touch.
PROTECTED_PREFIXES = [":", "x-ai-eg-"]
PROTECTED_HEADER = "x-envoy-original-path"

ANY_MODEL = "*"


# --- routes and backends --------------------------------------------------------------------------


def match_route(requests: DataFrame, rules: DataFrame, model: str = "model", headers: str = "headers") -> DataFrame:
    """Add ``rule_idx`` of the first matching route rule (NULL: none).

    ``rules`` holds ``(rule_idx, match_idx, model, headers)`` and, if wanted, ``header_patterns`` (regular expressions
    that the whole value must match): every header of a match must hold, any match of a rule suffices, a NULL model matches all. The rules are first collected per model (that
    is configuration, a few rows), so requests are joined once and never multiplied.
    """
    none = F.expr("cast(array() AS array<struct<key:string,value:string>>)")
    patterns = F.coalesce(F.map_entries("header_patterns"), none) if "header_patterns" in rules.columns else none
    entry = F.struct("rule_idx", "match_idx", F.coalesce(F.map_entries("headers"), F.expr("array()")).alias("headers"), patterns.alias("patterns"))
    per_model = rules.groupBy(F.coalesce("model", F.lit(ANY_MODEL)).alias("_model")).agg(
        F.array_sort(F.collect_list(entry)).alias("_rules")
    )
    named = per_model.where(F.col("_model") != ANY_MODEL)
    general = per_model.where(F.col("_model") == ANY_MODEL).select("_rules").scalar()
    joined = requests.join(named, F.col(model) == F.col("_model"), "left").withColumn("_general", general)

    def first_hit(rule_list: Column) -> Column:
        hits = F.filter(
            rule_list,
            lambda r: F.forall(
                r["headers"], lambda h: F.coalesce(F.try_element_at(F.col(headers), h["key"]) == h["value"], F.lit(False))
            ) & F.forall(
                r["patterns"],
                lambda h: F.coalesce(F.regexp_like(F.try_element_at(F.col(headers), h["key"]), F.concat(F.lit("^(?:"), h["value"], F.lit(")$"))), F.lit(False)),
            ),
        )
        return F.try_element_at(hits, F.lit(1))["rule_idx"]

    return joined.withColumn(
        "rule_idx", F.least(first_hit(F.col("_rules")), first_hit(F.col("_general")))
    ).drop("_model", "_rules", "_general")


@dataclass(frozen=True)
class BackendRef:
    name: str
    priority: int = 0
    weight: int = 1


def weighted_backend(requests: DataFrame, backends: Sequence[BackendRef], id_col: str = "request_id") -> DataFrame:
    """Pick a backend of the top priority by weight; weight 0 is never picked.

    The roll is a hash of the request id, so a request keeps its backend when the job is rerun.
    """
    usable = [b for b in backends if b.weight > 0]
    if not usable:
        return requests.withColumn("selected_backend", F.lit(None).cast("string"))
    top = [b for b in usable if b.priority == min(b.priority for b in usable)]
    roll = hash_roll(id_col, sum(b.weight for b in top))
    upper, choice = 0, None
    for b in top:
        upper += b.weight
        choice = F.when(F.col("_roll") < upper, b.name) if choice is None else choice.when(F.col("_roll") < upper, b.name)
    return requests.withColumn("_roll", roll).withColumn("selected_backend", choice).drop("_roll")


def weighted_backend_by_route(requests: DataFrame, refs: DataFrame, route: str = "route", id_col: str = "request_id") -> DataFrame:
    """Pick a backend of the top priority by weight, each route by its own rows of ``refs``.

    ``refs`` holds ``(route, backend, priority, weight)``; a NULL weight is 1, a NULL priority 0, weight 0 is never picked, and
    a route without a usable backend gives NULL. Backends of a route are summed up into one row of cumulative weights, so
    requests are joined once and never multiplied; the roll is the hash of the request id, as in ``weighted_backend``.
    """
    weight, priority = F.coalesce("weight", F.lit(1)).cast("bigint"), F.coalesce("priority", F.lit(0))
    usable = refs.select(route, "backend", weight.alias("weight"), priority.alias("priority")).where("weight > 0")
    ranked = usable.groupBy(route).agg(F.array_sort(F.collect_list(F.struct("priority", "backend", "weight"))).alias("_all"))
    top = F.filter("_all", lambda b: b["priority"] == F.get("_all", F.lit(0))["priority"])

    def cumulated(_: Column, i: Column) -> Column:
        upper = F.aggregate(F.slice("_top", 1, i + 1), F.lit(0).cast("bigint"), lambda total, b: total + b["weight"])
        return F.struct(upper.alias("upper"), F.get("_top", i)["backend"].alias("backend"))

    table = ranked.select(route, top.alias("_top")).select(route, F.transform("_top", cumulated).alias("_ranges"))
    joined = requests.join(table, route, "left")
    total = F.get("_ranges", F.size("_ranges") - 1)["upper"]
    rolled = joined.withColumn("_roll", F.when(F.col("_ranges").isNotNull(), hash_roll(id_col, total)))
    chosen = F.get(F.filter("_ranges", lambda b: F.col("_roll") < b["upper"]), F.lit(0))["backend"]
    return rolled.withColumn("selected_backend", chosen).drop("_ranges", "_roll")


def fallback_outcome(attempts: DataFrame, keys: Sequence[str] = ("request_id",), order: str = "attempt") -> DataFrame:
    """Per request: serving backend (first success), number of attempts, whether it was retried."""
    ok = F.col("success")
    return attempts.groupBy(*keys).agg(
        F.min_by(F.when(ok, F.col("backend")), F.when(ok, F.col(order))).alias("serving_backend"),
        F.count(F.lit(1)).alias("attempts"),
        (F.max(order) > 1).alias("retried"),
    )


def apply_model_override(requests: DataFrame, refs: DataFrame, backend: str = "backend", model: str = "original_model") -> DataFrame:
    """``request_model``: the override of the backend reference, else the original model."""
    o = refs.select(backend, F.nullif(F.col("model_override"), F.lit("")).alias("_override"))
    return requests.join(o, backend, "left").withColumn("request_model", F.coalesce("_override", model)).drop("_override")


# --- mutations ------------------------------------------------------------------------------------


def merge_mutations(route_level: DataFrame, backend_level: DataFrame, keys: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """Merge route- and backend-level mutations ``(keys, kind, name, value)``.

    Sets of the route win, removes are unioned. Header names are lower-cased, body fields are not.
    """

    def prepared(df: DataFrame, tag: str) -> DataFrame:
        name = F.col("name") if case_sensitive else F.lower("name")
        return df.groupBy(*keys, "kind", name.alias("name")).agg(F.max("value").alias(tag), F.lit(True).alias(f"_{tag}"))

    r, b = prepared(route_level, "route_value"), prepared(backend_level, "backend_value")
    on = [*keys, "kind", "name"]
    merged = r.join(b, on, "full_outer")
    value = F.when(F.col("_route_value"), F.col("route_value")).otherwise(F.col("backend_value"))
    return merged.select(*on, F.when(F.col("kind") == "set", value).alias("value"))


def _protected(name: Column) -> Column:
    cond = F.lower(name) == PROTECTED_HEADER
    for p in PROTECTED_PREFIXES:
        cond = cond | name.startswith(p)
    return cond


def apply_header_mutation(
    df: DataFrame, headers: str = "headers", sets: str = "sets", removes: str = "removes", original: str = "original_headers",
    on_retry: str = "on_retry",
) -> DataFrame:
    """Headers after set and remove mutations.

    Protected names are left alone. On a retry the other headers go back to their original values and
    additions are dropped, before sets and removes apply.
    """
    usable = F.map_filter(F.coalesce(F.col(sets), F.expr("map()").cast("map<string,string>")), lambda k, v: ~_protected(k))
    gone = F.filter(F.coalesce(F.col(removes), F.expr("array()").cast("array<string>")), lambda k: ~_protected(k))

    def untouched(k: Column) -> Column:
        return ~F.array_contains(gone, k) & ~F.map_contains_key(usable, k)

    first_try = F.map_concat(
        F.map_filter(headers, lambda k, v: _protected(k) | untouched(k)), usable
    )
    retry = F.map_concat(
        F.map_filter(headers, lambda k, v: _protected(k)),
        F.map_filter(original, lambda k, v: ~_protected(k) & untouched(k)),
        usable,
    )
    return df.withColumn(headers, F.when(F.col(on_retry), retry).otherwise(first_try))


_LOOKS_JSON = r'^(?s)(".*"|\{.*\}|\[.*\]|true|false|null|[0-9+-][0-9.eE+-]*)$'


def apply_body_mutation(df: DataFrame, body: str = "request_body", sets: str = "body_sets", removes: str = "body_removes") -> DataFrame:
    """Top-level removes, then sets; a value that looks like JSON is set as JSON, else as a string.

    Adds ``mutation_error``. Where a value looks like JSON and is none, the body stays as it was; a body that is no JSON
    object becomes NULL. Both are errors of the row. Empty names are ignored.
    """
    fields = F.from_json(F.col(body), "map<string,variant>")
    gone = F.coalesce(F.col(removes), F.expr("cast(array() AS array<string>)"))
    new = F.coalesce(F.map_filter(F.col(sets), lambda k, v: (k != "") & v.isNotNull()), F.expr("cast(map() AS map<string,string>)"))
    raw = F.transform_values(new, lambda k, v: F.when(F.trim(v).rlike(_LOOKS_JSON), F.try_parse_json(F.trim(v))).otherwise(v.cast("variant")))
    tmp = computed_once(df, {"_fields": fields, "_new": raw})
    bad = F.exists(F.map_values("_new"), lambda v: v.isNull())
    kept = F.map_filter("_fields", lambda k, v: ~F.array_contains(gone, k) & ~F.map_contains_key("_new", k))
    changed = F.to_json(F.map_concat(kept, "_new"))
    error = F.when(F.col("_fields").isNull(), "body is not a JSON object").when(bad, "value is not JSON")
    shown = F.when(F.col("_fields").isNotNull(), F.when(bad, F.col(body)).otherwise(changed))
    return tmp.withColumns({body: shown, "mutation_error": error}).drop("_fields", "_new")


# --- policies, tools, catalogs --------------------------------------------------------------------


def resolve_filter_policy(backends: DataFrame, standalone: DataFrame, inline: DataFrame) -> DataFrame:
    """Content-filter policy of each ``(route, backend)``.

    A standalone policy (route-wide, or for one section) beats the inline one; two standalone policies
    for the same backend are an error row.
    """
    per_section = standalone.groupBy("route", F.col("section").alias("_section")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("policy").alias("_p")
    )
    wide = per_section.where("_section IS NULL").select("route", F.col("_n").alias("_wn"), F.col("_p").alias("_wp"))
    own = per_section.where("_section IS NOT NULL").select(
        "route", F.col("_section").alias("backend"), F.col("_n").alias("_sn"), F.col("_p").alias("_sp")
    )
    inl = inline.select("route", "backend", F.col("policy").alias("_inline"))
    j = backends.join(wide, "route", "left").join(own, ["route", "backend"], "left").join(inl, ["route", "backend"], "left")
    n = F.coalesce("_wn", F.lit(0)) + F.coalesce("_sn", F.lit(0))
    return j.select(
        *backends.columns,
        F.when(n <= 1, F.coalesce("_sp", "_wp", "_inline")).alias("policy"),
        F.when(n > 1, F.lit("multiple standalone policies")).alias("error"),
    )


UNPORTABLE_REGEX = r"\(\?[=!<]|\\[1-9]|\\k<"


def validate_tool_selectors(selectors: DataFrame) -> DataFrame:
    """Selector rows whose patterns use lookaround or backreferences, which linear-time engines refuse."""
    patterns = F.concat(*[F.coalesce(c, F.expr("array()").cast("array<string>")) for c in ("include_regex", "exclude_regex")])
    bad = F.filter(patterns, lambda p: p.rlike(UNPORTABLE_REGEX))
    return selectors.withColumn("bad_patterns", bad).where(F.size("bad_patterns") > 0)


def select_tools(tools: DataFrame, selectors: DataFrame, keys: Sequence[str] = ("backend",), tool: str = "tool") -> DataFrame:
    """Tools a selector lets through.

    Excludes first (exact, then patterns); then, if there are exact includes, only those; else the
    include patterns; with neither everything passes. Tools of backends without selector pass.
    """
    none = F.expr("array()").cast("array<string>")
    s = selectors.select(
        *keys, *[F.coalesce(c, none).alias(f"_{c}") for c in ("include", "exclude", "include_regex", "exclude_regex")]
    )
    j = tools.join(s, list(keys), "left")
    name = F.col(tool)

    def hits(c: str) -> Column:
        return F.exists(F.col(c), lambda p: F.call_function("rlike", name, p))

    allowed = (
        F.when(F.col("_exclude").isNull(), True)
        .when(F.array_contains("_exclude", name) | hits("_exclude_regex"), False)
        .when(F.size("_include") > 0, F.array_contains("_include", name))
        .when(F.size("_include_regex") > 0, hits("_include_regex"))
        .otherwise(True)
    )
    return j.where(allowed).select(*tools.columns)


def merge_tool_catalog(catalog: DataFrame, capabilities: DataFrame, selectors: DataFrame) -> DataFrame:
    """One catalog over the backends that offer tools: selected tools under prefixed names."""
    bit = 1 << CAPABILITY_BITS.index("tools")
    offering = capabilities.where(F.col("caps").bitwiseAND(F.lit(bit)) != 0).select("backend").distinct()
    return select_tools(catalog.join(offering, "backend", "left_semi"), selectors).withColumn(
        "name", F.concat("backend", F.lit(TOOL_SEPARATOR), "tool")
    )


def merge_resource_catalogs(resources: DataFrame, templates: DataFrame, prompts: DataFrame) -> DataFrame:
    """Resources, templates and prompts of all backends with prefixed names and URIs."""

    def kind(df: DataFrame, label: str) -> DataFrame:
        uri = F.col("uri") if "uri" in df.columns else F.lit(None).cast("string")
        return df.select(
            F.lit(label).alias("kind"),
            "backend",
            F.concat("backend", F.lit(TOOL_SEPARATOR), "name").alias("name"),
            F.concat("backend", F.lit(URI_SEPARATOR), uri).alias("uri"),
        )

    return kind(resources, "resource").unionByName(kind(templates, "template")).unionByName(kind(prompts, "prompt"))


# --- authorization --------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClaimRule:
    """A claim (dotted path) that must be one of ``values``; ``kind`` is String or StringArray."""

    path: str
    values: tuple[str, ...]
    kind: str = "String"


@dataclass(frozen=True)
class AuthRule:
    """``condition`` is a SQL predicate on the call; ``targets`` are (backend, tool) pairs."""

    action: str = "Allow"
    condition: str | None = None
    targets: tuple[tuple[str, str], ...] = ()
    claims: tuple[ClaimRule, ...] = ()
    scopes: tuple[str, ...] = ()
    source: bool = field(default=False)

    @property
    def has_source(self) -> bool:
        return self.source or bool(self.claims or self.scopes)


def _claim_holds(c: ClaimRule) -> Column:
    if c.path.split(".")[0] in ("scope", "scp"):
        return F.lit(False)
    path = "$." + c.path
    value = F.try_variant_get(F.col("_claims"), path, "variant")
    kind = F.schema_of_variant(value)
    text = json_text("_payload", path)
    is_text = (kind == "STRING") & text.isin(*c.values)
    if c.kind == "String":
        return F.coalesce(is_text, F.lit(False))
    if c.kind != "StringArray":
        return F.lit(False)
    listed = F.arrays_overlap(F.from_json(text, "array<string>"), F.array(*[F.lit(v) for v in c.values]))
    return F.coalesce(is_text | (kind.startswith("ARRAY") & listed), F.lit(False))


def authorize_calls(
    calls: DataFrame, rules: Sequence[AuthRule] | None, default_action: str = "Deny", header: str = "authorization",
    resource_metadata: str = "",
) -> DataFrame:
    """Add ``allowed``, ``rule_idx`` and ``scope_challenge``.

    Rules are compiled into one CASE, so authorizing is a projection: no join, no shuffle. In each rule
    condition, target, claims and scopes must hold; the first full match decides. Without a rule list
    everything is allowed. A token that cannot be read has no claims; a failing condition is no match.
    When nothing decides, the default applies and the challenge names the smallest scope set among the
    Allow rules that failed on scopes only.
    """
    if rules is None:
        return calls.withColumns(
            {"allowed": F.lit(True), "rule_idx": F.lit(None).cast("int"), "scope_challenge": F.lit(None).cast("string")}
        )
    tmp = calls.withColumn("_payload", F.coalesce(jwt_payload(F.col(header)), F.lit("{}")))
    tmp = computed_once(tmp, {"_scopes": scopes_of(F.col("_payload")), "_claims": F.try_parse_json("_payload")})
    decided_by: Column | None = None
    gaps: list[tuple[int, int, AuthRule, Column]] = []
    for i, r in enumerate(rules):
        applies = F.coalesce(F.expr(tolerant(calls.sparkSession, r.condition)), F.lit(False)) if r.condition else F.lit(True)
        if r.targets:
            on_target = F.lit(False)
            for backend, tool in r.targets:
                on_target = on_target | ((F.col("backend") == backend) & (F.col("tool") == tool))
            applies = applies & F.coalesce(on_target, F.lit(False))
        for c in r.claims:
            applies = applies & _claim_holds(c)
        scopes_ok = F.lit(True)
        for s in r.scopes:
            scopes_ok = scopes_ok & F.array_contains("_scopes", s)
        hit = applies & scopes_ok
        decided_by = F.when(hit, F.lit(i)) if decided_by is None else decided_by.when(hit, F.lit(i))
        if r.scopes and r.action == "Allow":
            gaps.append((len(r.scopes), i, r, applies & ~scopes_ok))
    default = F.lit(default_action == "Allow")
    out = tmp.withColumn("rule_idx", decided_by if decided_by is not None else F.lit(None).cast("int"))
    allowed = default
    if rules:
        allowing = [i for i, r in enumerate(rules) if r.action == "Allow"]
        allowed = F.when(F.col("rule_idx").isNotNull(), F.col("rule_idx").isin(*allowing) if allowing else F.lit(False)).otherwise(default)
    challenge: Column | None = None
    for _, _, r, gap in sorted(gaps, key=lambda g: (g[0], g[1])):
        text = scope_challenge(r.scopes, resource_metadata)
        challenge = F.when(gap, F.lit(text)) if challenge is None else challenge.when(gap, F.lit(text))
    shown = F.lit(None).cast("string") if challenge is None else F.when(F.col("rule_idx").isNull(), challenge)
    return out.withColumns({"allowed": allowed, "scope_challenge": shown}).drop("_payload", "_scopes", "_claims")


#: Columns of a rule table besides its route; all but ``rule_idx`` may be NULL.
RULE_COLUMNS = {
    "rule_idx": "int", "action": "string", "condition": "string", "targets": "array<struct<backend: string, tool: string>>",
    "claims": "array<struct<path: string, values: array<string>, kind: string>>", "scopes": "array<string>",
}


def authorize_calls_by_route(
    calls: DataFrame, rules: DataFrame, defaults: DataFrame, route: str = "route", header: str = "authorization", resource_metadata: str = ""
) -> DataFrame:
    """``authorize_calls`` with the rules of each call's own route.

    ``rules`` holds ``route`` and ``RULE_COLUMNS``, ``defaults`` holds ``(route, default_action)``; a route in neither has no rule
    list and allows everything, one in ``defaults`` alone has an empty list. The rules of a route are collected into one row, so
    calls are joined once. Distinct conditions and claim paths are compiled once (a configuration has few) and looked up by number;
    each call then walks its route's rules as an array.
    """
    spark = calls.sparkSession
    table = rules.select(route, *[(F.col(c) if c in rules.columns else F.lit(None)).cast(k).alias(c) for c, k in RULE_COLUMNS.items()])
    conditions = sorted(r[0] for r in table.where("condition IS NOT NULL").select("condition").distinct().collect())
    paths = sorted(r[0] for r in table.select(F.explode("claims.path")).distinct().collect())
    number = F.create_map(*[x for i, c in enumerate(conditions) for x in (F.lit(c), F.lit(i))]) if conditions else None
    place = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p), F.lit(i))]) if paths else None
    none = F.lit(None).cast("int")

    def claim(c: Column) -> Column:
        at = none if place is None else F.try_element_at(place, c["path"])
        return F.struct(at.alias("at"), c["values"].alias("values"), F.coalesce(c["kind"], F.lit("String")).alias("kind"))

    entry = F.struct(
        "rule_idx", (F.coalesce("action", F.lit("Allow")) == "Allow").alias("allow"),
        F.when(F.col("condition").isNotNull(), none if number is None else F.try_element_at(number, F.col("condition"))).alias("condition"),
        "targets", F.transform("claims", claim).alias("claims"), F.coalesce("scopes", F.array().cast("array<string>")).alias("scopes"),
    )
    by_route = table.groupBy(route).agg(F.array_sort(F.collect_list(entry), lambda a, b: a["rule_idx"] - b["rule_idx"]).alias("_rules"))
    policy = defaults.select(route, (F.col("default_action") == "Allow").alias("_default")).join(by_route, route, "full_outer")
    policy = policy.select(route, F.coalesce("_default", F.lit(False)).alias("_default"), F.coalesce("_rules", F.array()).alias("_rules"))

    tmp = calls.join(policy, route, "left").withColumn("_payload", F.coalesce(jwt_payload(F.col(header)), F.lit("{}")))
    tmp = computed_once(tmp, {"_scopes": scopes_of(F.col("_payload")), "_claims": F.try_parse_json("_payload")})
    holds = [F.coalesce(F.expr(tolerant(spark, c)).cast("boolean"), F.lit(False)) for c in conditions]

    def value(path: str) -> Column:
        """Kind, text and list of a claim; scope claims are never compared as values."""
        if path.split(".")[0] in ("scope", "scp"):
            return F.struct(F.lit("").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("list"))
        text = json_text("_payload", "$." + path)
        kind = F.schema_of_variant(F.try_variant_get(F.col("_claims"), "$." + path, "variant"))
        return F.struct(kind.alias("kind"), text.alias("text"), F.when(kind.startswith("ARRAY"), F.from_json(text, "array<string>")).alias("list"))

    tmp = computed_once(tmp, {"_holds": F.array(*holds).cast("array<boolean>"), "_values": F.array(*[value(p) for p in paths] or [value("scope")])})

    def claim_holds(c: Column) -> Column:
        v = F.get("_values", c["at"])
        text = (v["kind"] == "STRING") & F.array_contains(c["values"], v["text"])
        listed = (c["kind"] == "StringArray") & F.arrays_overlap(v["list"], c["values"])
        return c["kind"].isin("String", "StringArray") & (F.coalesce(text, F.lit(False)) | F.coalesce(listed, F.lit(False)))

    def applies(r: Column) -> Column:
        on_target = F.exists(r["targets"], lambda x: F.coalesce((x["backend"] == F.col("backend")) & (x["tool"] == F.col("tool")), F.lit(False)))
        return (
            F.when(r["condition"].isNull(), True).otherwise(F.coalesce(F.get("_holds", r["condition"]), F.lit(False)))
            & F.when(F.coalesce(F.size(r["targets"]), F.lit(0)) <= 0, True).otherwise(on_target)
            & F.coalesce(F.forall(r["claims"], claim_holds), F.lit(True))
        )

    scopes_ok = lambda r: F.forall(r["scopes"], lambda s: F.array_contains("_scopes", s))
    out = computed_once(tmp, {"_open": F.filter("_rules", applies)})
    hit = F.get(F.filter("_open", scopes_ok), F.lit(0))
    gaps = F.filter("_open", lambda r: r["allow"] & (F.size(r["scopes"]) > 0) & ~scopes_ok(r))
    gap = F.get(F.array_sort(F.transform(gaps, lambda r: F.struct(F.size(r["scopes"]).alias("n"), r["rule_idx"].alias("i"), r["scopes"].alias("scopes")))), F.lit(0))
    before, after = scope_challenge(["\0"], resource_metadata).split("\0")
    challenge = F.when(gap.isNotNull(), F.concat(F.lit(before), F.array_join(gap["scopes"], " "), F.lit(after)))
    open_ = F.col("_rules").isNull()
    return out.withColumns(
        {
            "rule_idx": hit["rule_idx"],
            "allowed": F.when(open_, True).when(hit.isNotNull(), hit["allow"]).otherwise(F.col("_default")),
            "scope_challenge": F.when(~open_ & hit.isNull(), challenge),
        }
    ).drop("_payload", "_scopes", "_claims", "_holds", "_values", "_open", "_rules", "_default")


# The scheme and texts of the challenge header.
_CHALLENGE = 'Bearer {}'
_CHALLENGE_ERROR = "insufficient_scope"
_CHALLENGE_TEXT = "The token is missing required scopes"


def scope_challenge(scopes: Sequence[str], resource_metadata: str = "") -> str:
    """Header text naming the scopes a token lacks; parameters without a value are left out."""
    shown = {"error": _CHALLENGE_ERROR, "scope": " ".join(scopes), "resource_metadata": resource_metadata, "error_description": _CHALLENGE_TEXT}
    return _CHALLENGE.format(", ".join(f'{name}="{value}"' for name, value in shown.items() if value or name == "scope"))


# --- messages, batches, configuration -------------------------------------------------------------


def pair_jsonrpc(
    messages: DataFrame, keys: Sequence[str] = ("session", "backend"), order: str = "at_us", hot_rows: int = HOT_ROWS, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Requests with their responses by (session, backend, id); unanswered ones keep NULLs.

    A repeated id pairs by occurrence in time: an answer belongs to the latest request of its id that came before it,
    and of several answers to one request the first counts. Every request gives one row. Requests at the same time are
    told apart by method and parameters. Occurrences are running totals, so an id that a client reuses for more than
    ``hot_rows`` messages is counted in time slices, and only the pairs are grouped afterwards.
    """
    asked = F.col("kind") == "request"
    steps = messages.where(F.col("kind").isin("request", "response")).withColumns({"_asked": asked.cast("int"), "_reply": (~asked).cast("int")})
    counted = prior_totals(steps, [*keys, "id"], order, ["_reply", "method", "params"], {"_turn": "_asked"}, hot_rows, rows_per_slice)
    turn = counted.withColumn("_turn", F.col("_turn") + F.col("_asked"))
    cols = ["result", "error_code", "error_message"]
    answer = F.when(~asked, F.struct(order, *cols))
    question = F.max(F.when(asked, F.struct(order, "method", "params")))
    pairs = turn.where("_turn > 0").groupBy(*keys, "id", "_turn").agg(question.alias("_q"), F.min(answer).alias("_a"))
    return pairs.select(
        *keys, "id", "_q.method", "_q.params",
        F.col(f"_q.{order}").alias("requested_us"),
        F.col(f"_a.{order}").alias("answered_us"),
        "_a.result", "_a.error_code", "_a.error_message",
        F.col("_a").isNotNull().alias("answered"),
    )


def tool_errors(pairs: DataFrame) -> DataFrame:
    """Tool calls whose result says ``isError``: tool name and the joined error text."""
    parsed = F.from_json("result", "isError boolean, content array<string>")
    rows = computed_once(pairs.where(F.col("method") == "tools/call"), {"_r": parsed}).where("_r.isError")

    def text(c: Column) -> Column:
        kind = json_text(c, "$.type")
        return (
            F.when(kind == "text", F.coalesce(json_text(c, "$.text"), F.lit("")))
            .when(kind == "image", F.concat(F.lit("[image: "), F.coalesce(json_text(c, "$.mimeType"), F.lit("")), F.lit("]")))
            .otherwise(c)
        )

    joined = F.array_join(F.transform("_r.content", text), "; ")
    message = F.when(F.size("_r.content") > 0, F.concat(F.lit("tool returned isError=true: "), joined)).otherwise(
        "tool returned isError=true"
    )
    return rows.withColumns({"tool_name": json_text("params", "$.name"), "error_text": message}).drop("_r")


def broadcast_outcome(replies: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Fan-out requests: backends merged, failed and dropped; any backend error fails the request.

    A reply whose result cannot be decoded is dropped from the merge and counted as an error status,
    but does not fail the request.
    """
    error = F.col("error_code").isNotNull()
    usable = ~error & F.try_parse_json("result").isNotNull()
    return replies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("backends"),
        F.count(F.when(usable, 1)).alias("merged"),
        F.count(F.when(error, 1)).alias("failed"),
        F.count(F.when(~error & ~usable, 1)).alias("dropped"),
        F.when(F.bool_or(error), F.lit("error")).otherwise("success").alias("status"),
    )


def join_batch(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Batch items with their results by custom id; ``state`` is completed, failed or missing."""
    o = outputs.select("custom_id", "status_code", "error", F.col("body").alias("response_body"), F.lit(True).alias("_seen"))
    ok = F.col("error").isNull() & F.col("status_code").between(200, 299)
    return (
        inputs.join(o, "custom_id", "left")
        .withColumn("state", F.when(F.col("_seen").isNull(), "missing").when(ok, "completed").otherwise("failed"))
        .drop("_seen")
    )


def batch_progress(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of completed, failed and missing items."""
    states = [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("completed", "failed", "missing")]
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *states)


def config_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries only one side has, order-free; no rows means the exposed tools did not change."""
    return (
        old.exceptAll(new).withColumn("change", F.lit("removed"))
        .unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))
    )


def route_unsupported(requests: DataFrame, operation: str = "operation", schema: str = "api_schema") -> DataFrame:
    """(operation, backend schema) pairs in the traffic that no translator serves, with request counts."""
    return (
        requests.where(supported_pair(F.col(operation), F.col(schema)).isNull())
        .groupBy(operation, schema).agg(F.count(F.lit(1)).alias("requests"))
    )
