"""Batch job files: JSON lines of requests and of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INPUT = "custom_id string, method string, url string, body string"
_OUTPUT = "id string, custom_id string, response struct<status_code: int, request_id: string, body: string>, error string"


def parse_batch_input(lines: DataFrame, value: str = "value") -> DataFrame:
    p = F.from_json(value, _INPUT)
    return lines.where(F.trim(value) != "").select(
        p["custom_id"].alias("custom_id"), p["method"].alias("method"), p["url"].alias("url"), p["body"].alias("body"),
        F.when(p["custom_id"].isNull(), F.col(value)).alias("bad_line"),
    )


def parse_batch_output(lines: DataFrame, value: str = "value") -> DataFrame:
    p = F.from_json(value, _OUTPUT)
    return lines.where(F.trim(value) != "").select(
        p["id"].alias("id"), p["custom_id"].alias("custom_id"), p["response"]["status_code"].alias("status_code"),
        p["response"]["request_id"].alias("request_id"), p["response"]["body"].alias("body"), p["error"].alias("error"),
        F.when(p["custom_id"].isNull(), F.col(value)).alias("bad_line"),
    )


def read_batch_input(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``custom_id, method, url, body``; undecodable lines keep their text in ``bad_line``."""
    return parse_batch_input(spark.read.text(path))


def read_batch_output(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``id, custom_id, status_code, request_id, body, error``."""
    return parse_batch_output(spark.read.text(path))
