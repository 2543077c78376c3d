"""Captured bodies: chunk concatenation and content decoding."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.assemble import BLOCK


def _joined_bytes(order: str, data: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.hex(data).alias("_h"))))
    return F.unhex(F.array_join(F.transform(rows, lambda r: r["_h"]), ""))


def concat_body_chunks(chunks: DataFrame, keys: list[str], order: str = "seq", data: str = "body") -> DataFrame:
    """Body bytes per key, joined in order: blocks of chunks first, then the blocks."""
    blocks = chunks.groupBy(*keys, F.floor(F.col(order) / BLOCK).alias("_b")).agg(_joined_bytes(order, data).alias(data))
    return blocks.groupBy(*keys).agg(_joined_bytes("_b", data).alias(data))


def _gunzip(raw: bytes | None) -> tuple[bytes | None, str | None]:
    if raw is None:
        return None, None
    out, rest = b"", bytes(raw)
    while rest:
        d = zlib.decompressobj(31)
        try:
            out += d.decompress(rest)
        except zlib.error:
            return None, "undecodable_gzip"
        if not d.eof:
            return None, "truncated_gzip"
        rest = d.unused_data
    return out, None


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())]))
def _gunzip_series(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_gunzip(b) for b in bodies], columns=["data", "error"], dtype=object)


def decode_bodies(df: DataFrame, body: str = "body", encoding: str = "content_encoding", out: str = "text") -> DataFrame:
    """Add the decoded text and ``decode_error``.

    gzip bodies are decompressed in Arrow batches; a cut-off or broken stream is flagged, brotli is
    flagged as unsupported, every other encoding passes through.
    """
    enc = F.lower(F.coalesce(F.col(encoding), F.lit("")))
    tmp = df.withColumn("_gz", _gunzip_series(F.when(enc == "gzip", F.col(body).cast("binary"))))
    return (
        tmp.withColumn(
            out,
            F.when(enc == "gzip", F.col("_gz.data").cast("string")).when(enc != "br", F.col(body).cast("string")),
        )
        .withColumn(
            "decode_error",
            F.when(enc == "gzip", F.col("_gz.error")).when(enc == "br", F.lit("unsupported_encoding")),
        )
        .drop("_gz")
    )
