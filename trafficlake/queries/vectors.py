"""Rerank and embedding queries over documents and embeddings."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import Tables
from ..operators import vectors as K
from . import query


@F.pandas_udf(T.StringType())
def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode())


def rerank_bodies(t: Tables):
    return t.sql(
        """SELECT doc_id AS request_id, to_json(named_struct('model', 'rerank-x', 'query', source, 'top_n', 3, 'documents', parts)) AS request_body,
             to_json(named_struct('results', transform(parts, (p, i) -> named_struct('index', i, 'relevance_score', CAST((length(p) * 7 + i * 13) % 100 AS DOUBLE) / 100)),
                                  'meta', named_struct('tokens', named_struct('input_tokens', n_chars + 0.5D, 'output_tokens', 2.0D)))) AS response_body
           FROM (SELECT *, split(text, '[.] ') AS parts FROM {d})""",
        d=t.documents,
    )


RERANK_SQL = """p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)),
  s AS (SELECT *, CAST((length(part) * 7 + i * 13) % 100 AS DOUBLE) / 100 AS score FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM s)"""


@query(
    "rerank_topn",
    f"WITH {RERANK_SQL} SELECT doc_id AS request_id, CAST(rank AS INT) AS rank, CAST(i AS INT) AS index, score AS relevance_score, part AS document FROM k WHERE rank <= 3",
)
def _(t: Tables):
    return K.rerank_topn(rerank_bodies(t))


@query(
    "decode_vectors",
    "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
)
def _(t: Tables):
    e = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, _encode("embedding")).otherwise(F.to_json(F.col("embedding").cast("array<double>"))))
    return K.decode_vectors(e).select(
        "vec_id", F.size("vector").cast("bigint").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total")
    )


@query(
    "explode_embeddings",
    """SELECT vec_id AS request_id, 0 AS index, round(CAST(embedding[1] AS DOUBLE), 6) AS head, CAST(len(embedding) AS BIGINT) AS dims, vec_id % 3 = 0 AS truncated FROM embeddings
  UNION ALL SELECT vec_id, 1, 0.5, 2, false FROM embeddings""",
)
def _(t: Tables):
    b = t.embeddings.withColumn("enc", _encode("embedding")).selectExpr(
        "vec_id AS request_id",
        """concat('{"data":[{"index":0,"truncated":', vec_id % 3 = 0, ',"embedding":',
              CASE WHEN vec_id % 2 = 0 THEN concat('"', enc, '"') ELSE to_json(CAST(embedding AS ARRAY<DOUBLE>)) END, '},{"embedding":[0.5,0.25]}]}') AS response_body""",
    )
    return K.explode_embeddings(b).select(
        "request_id", "index", F.round(F.get("vector", F.lit(0)), 6).alias("head"), F.size("vector").cast("bigint").alias("dims"), "truncated"
    )
