"""Rerank results and embedding vectors."""

from __future__ import annotations

import base64
import binascii

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import exploded, parse_struct


def rerank_topn(
    df: DataFrame, key: str = "request_id", request: str = "request_body", response: str = "response_body", top_n: int | None = None
) -> DataFrame:
    """Best results per request with their documents: ``(key, rank, index, relevance_score, document)``.

    ``top_n`` defaults to the request's own number. Results, documents and limit of a request sit in
    one row, so ranking needs no shuffle.
    """
    req = parse_struct(request, "documents array<string>, top_n int")
    res = parse_struct(response, "results array<struct<index: int, relevance_score: double>>")
    tmp = df.select(key, req.alias("_q"), res.alias("_a"))
    ranked = F.array_sort(
        F.transform(
            "_a.results",
            lambda r: F.struct((-r["relevance_score"]).alias("neg"), r["index"].alias("index"), r["relevance_score"].alias("score")),
        )
    )
    limit = F.lit(top_n) if top_n is not None else F.coalesce("_q.top_n", F.size("_a.results"))
    best = F.slice(ranked, F.lit(1), F.greatest(limit, F.lit(0)))
    return exploded(tmp, [key, "_q"], best, "_pos", "_r").select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_r.index").alias("index"),
        F.col("_r.score").alias("relevance_score"),
        F.get(F.col("_q.documents"), F.col("_r.index")).alias("document"),
    )


def _decode(text: str | None):
    if text is None:
        return None
    try:
        raw = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None
    return np.frombuffer(raw[: len(raw) // 4 * 4], dtype="<f4").astype("float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _decode_series(encoded: pd.Series) -> pd.Series:
    return pd.Series([_decode(t) for t in encoded], dtype=object)


def decode_vectors(df: DataFrame, source: str = "embedding", out: str = "vector") -> DataFrame:
    """Embedding JSON values to double arrays.

    Number arrays are read natively; base64 texts of little-endian 32-bit floats are decoded in Arrow
    batches, trailing bytes ignored; undecodable text is NULL.
    """
    plain = F.from_json(source, "array<double>")
    is_list = F.ltrim(source).startswith("[")
    text = F.regexp_replace(F.trim(source), '^"|"$', "")
    return df.withColumn(out, F.when(is_list, plain).otherwise(_decode_series(F.when(~is_list, text))))


def explode_embeddings(df: DataFrame, body: str = "response_body", key: str = "request_id") -> DataFrame:
    """Vectors of an embeddings response: ``(key, index, vector, truncated)``."""
    data = parse_struct(body, "data array<struct<index: int, embedding: string, truncated: boolean>>")["data"]
    rows = exploded(df, [key], data, "_pos", "_d").select(
        key, F.coalesce("_d.index", "_pos").alias("index"), F.col("_d.embedding").alias("_e"),
        F.coalesce("_d.truncated", F.lit(False)).alias("truncated"),
    )
    return decode_vectors(rows, "_e").select(key, "index", "vector", "truncated")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _decode_lists(rows: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else [None if x is None else _decode(x) for x in r] for r in rows], dtype=object)


def decode_embedding_list(embeddings: Column) -> Column:
    """Array of embedding texts (JSON numbers or base64) to an array of vectors.

    Number lists are read natively; only base64 texts go to Arrow batches.
    """
    listed = F.transform(embeddings, lambda e: F.when(F.ltrim(e).startswith("["), F.from_json(e, "array<double>")))
    encoded = F.transform(embeddings, lambda e: F.when(~F.ltrim(e).startswith("["), e))
    decoded = _decode_lists(F.when(F.exists(encoded, lambda e: e.isNotNull()), encoded))
    return F.when(decoded.isNull(), listed).otherwise(F.zip_with(listed, decoded, lambda a, b: F.coalesce(a, b)))
