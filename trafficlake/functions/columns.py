"""Small Column builders: JSON access, hashing, base64, bucket indexes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and build an expression from it (a one-element transform)."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters read as values.

    A filter above a plain projection is pushed below it with the column's expression copied in, so a
    parsed body would be parsed again for every mention. A one-row ``inline`` keeps the filter above.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def exploded(df: DataFrame, keep: Sequence[str | Column], items: Column, pos: str, item: str) -> DataFrame:
    """``posexplode`` without the inferred ``size(items) > 0`` filter, which would parse the body twice."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def json_text(c: str | Column, path: str) -> Column:
    return F.get_json_object(col(c), path)


def json_long(c: str | Column, path: str) -> Column:
    return F.get_json_object(col(c), path).try_cast("bigint")


def json_double(c: str | Column, path: str) -> Column:
    return F.get_json_object(col(c), path).try_cast("double")


def parse_struct(c: str | Column, ddl: str) -> Column:
    """``from_json`` with an explicit schema; undecodable input gives a struct of NULLs."""
    return F.from_json(col(c), ddl)


def json_object_ok(c: str | Column) -> Column:
    """True when the text is one well-formed JSON object."""
    c = col(c)
    return F.coalesce(
        F.try_parse_json(c).isNotNull() & c.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False)
    )


def non_empty(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def content_hash(c: str | Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def hash_roll(c: str | Column, modulus: int | Column) -> Column:
    """Deterministic roll in ``[0, modulus)`` from the first 32 hash bits of an id."""
    m = modulus if isinstance(modulus, Column) else F.lit(modulus)
    head = F.substring(F.sha2(col(c).cast("string"), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % m.cast("bigint")


def base64_bytes(c: str | Column) -> Column:
    """Base64 to binary; NULL when it does not decode."""
    return F.call_function("try_to_binary", col(c), F.lit("base64"))


def base64url_text(c: str | Column) -> Column:
    """Unpadded URL-safe base64 to text; NULL when it does not decode. Line breaks (after 76 characters in MIME form) do not count."""
    std = F.translate(col(c), "-_\r\n", "+/")
    pad = F.repeat(F.lit("="), ((F.lit(4) - F.length(std) % 4) % 4).cast("int"))
    return base64_bytes(F.concat(std, pad)).cast("string")


def bucket_index(value: str | Column, bounds: Sequence[float]) -> Column:
    """Index of the explicit histogram bucket; a bound belongs to the bucket below it."""
    value = col(value).cast("double")
    out: Column | None = None
    for i, b in enumerate(bounds):
        cond = value <= F.lit(float(b))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    assert out is not None
    return F.when(value.isNotNull(), out.otherwise(F.lit(len(bounds))))


def map_case(c: str | Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Literal lookup as a CASE expression (stays inside whole-stage codegen)."""
    c = col(c)
    out: Column | None = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    assert out is not None
    return out.otherwise(default) if default is not None else out
