"""Request cost from usage: counter types, SQL expressions, metadata maps, rollups, batch files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tolerant import tolerant
from .usage import USAGE, normalize_usage

# Cost types and the counter each one reads.
COST_TYPES = {
    "InputToken": "input_tokens",
    "CachedInputToken": "cached_input_tokens",
    "CacheCreationInputToken": "cache_creation_input_tokens",
    "OutputToken": "output_tokens",
    "TotalToken": "total_tokens",
    "ReasoningToken": "reasoning_tokens",
}
# Fixed value: most cost entries one route may have.
MAX_RULES = 36

EXPRESSION_COLUMNS = ["model", "backend", *USAGE]


@dataclass(frozen=True)
class CostRule:
    metadata_key: str
    cost_type: str
    expr: str | None = None


def counter_cost(cost_type: str) -> Column:
    """The counter of a cost type, unset counting as zero."""
    if cost_type not in COST_TYPES:
        raise ValueError(f"unknown cost type {cost_type!r}")
    return F.coalesce(F.col(COST_TYPES[cost_type]).cast("bigint"), F.lit(0).cast("bigint"))


def cost_by_type(df: DataFrame, rules: Sequence[CostRule], ids: list[str]) -> DataFrame:
    """Long rows ``(ids, rule_idx, metadata_key, cost)``: one per request and rule."""
    entries = [
        F.struct(
            F.lit(i).alias("rule_idx"), F.lit(r.metadata_key).alias("metadata_key"), counter_cost(r.cost_type).alias("cost")
        )
        for i, r in enumerate(rules)
    ]
    return df.select(*ids, F.explode(F.array(*entries)).alias("_r")).select(*ids, "_r.*")


def validate_cost_expression(spark: SparkSession, expr: str) -> None:
    """Reject an expression at plan time: unknown names, aggregates, non-integer results, failure on zeros."""
    try:
        zeros = [F.lit(0).cast("bigint").alias(c) for c in USAGE]
        probe = spark.range(1).select(F.lit("dummy").alias("model"), F.lit("dummy").alias("backend"), *zeros)
        tolerant(spark, expr)
        probe.where(F.expr(expr).isNotNull())  # aggregates and windows are not allowed in a filter
        result = probe.select(F.expr(expr).alias("cost"))
        kind = result.schema["cost"].dataType
        if not isinstance(kind, T.IntegralType):
            raise ValueError(f"cost expression {expr!r} gives {kind.simpleString()}, not an integer")
        value = result.first()["cost"]
    except PySparkException as e:
        raise ValueError(f"cost expression {expr!r} is invalid: {e}") from e
    if value is None or value < 0:
        raise ValueError(f"cost expression {expr!r} fails on zero usage")


def expression_cost(df: DataFrame, expr: str, out: str = "cost", error: str = "cost_error") -> DataFrame:
    """Evaluate ``expr`` with unset counters as zero; a negative or missing result is a row error.

    The expression sees only ``model, backend`` and the six counters, whatever else ``df`` holds. What fails in a row
    (division by zero, a cast, an overflow, a difference below zero) is NULL there and ends no job.
    """
    zeroed = {
        c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")) if c in df.columns else F.lit(0).cast("bigint")
        for c in USAGE
    }
    texts = {c: F.col(c) if c in df.columns else F.lit("") for c in ("model", "backend")}
    closed = df.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in {**texts, **zeroed}.items()])
    spark = df.sparkSession
    value = closed.withColumns(
        {"_v": F.expr(tolerant(spark, expr, unsigned=True)).try_cast("bigint"), "_signed": F.expr(tolerant(spark, expr)).try_cast("bigint")}
    )
    below = (F.col("_v") < 0) | (F.col("_v").isNull() & F.col("_signed").isNotNull())
    bad = F.col("_v").isNull() | below
    return value.select(
        "_row.*",
        F.when(~bad, F.col("_v")).alias(out),
        F.when(below, "negative result").when(bad, "no result").alias(error),
    )


def cost_expression(df: DataFrame, expr: str, out: str = "cost", error: str = "cost_error") -> DataFrame:
    validate_cost_expression(df.sparkSession, expr)
    return expression_cost(df, expr, out, error)


def effective_rules(rules: Sequence[CostRule]) -> list[CostRule]:
    """First rule of each key wins."""
    seen: dict[str, CostRule] = {}
    for r in rules:
        seen.setdefault(r.metadata_key, r)
    if len(seen) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} cost rules, got {len(seen)}")
    return list(seen.values())


def cost_metadata(df: DataFrame, rules: Sequence[CostRule], success: str = "success") -> DataFrame:
    """Add ``cost`` (map of key to cost) for successful requests, plus final model and backend names.

    Expects ``model`` (after overrides), ``backend``, ``response_model`` and the counters. A failing
    expression leaves the map NULL and sets ``cost_error``.
    """
    keep = effective_rules(rules)
    out, entries, errors = df, [], []
    for i, r in enumerate(keep):
        if r.cost_type == "Expression":
            out = cost_expression(out, r.expr or "", f"_cost{i}", f"_err{i}")
            errors.append(F.col(f"_err{i}"))
        else:
            out = out.withColumn(f"_cost{i}", counter_cost(r.cost_type))
        entries += [F.lit(r.metadata_key), F.col(f"_cost{i}")]
    error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    done = F.col(success)
    out = out.withColumn("cost_error", F.when(done, error))
    out = out.withColumn("cost", F.when(done & F.col("cost_error").isNull(), F.create_map(*entries)))
    for name in ("model", "backend", "response_model"):
        out = out.withColumn(name, F.when(done, F.nullif(F.col(name), F.lit(""))))
    return out.drop(*[c for c in out.columns if c.startswith(("_cost", "_err"))])


def cost_rollup(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Sums of cost or token columns by any attribute set (partial sums before the shuffle)."""
    return df.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("requests"))


def batch_usage(results: DataFrame, rule: CostRule, operation: str = "operation", schema: str = "api_schema") -> DataFrame:
    """Usage and cost of retrieved batch results; failed items carry none."""
    ok = F.col("error").isNull() & F.col("status_code").between(200, 299)
    priced = normalize_usage(results, "body", operation, schema)
    cols = {c: F.when(ok, F.col(c)) for c in USAGE}
    return priced.withColumns(cols).withColumn("cost", F.when(ok, counter_cost(rule.cost_type)))
