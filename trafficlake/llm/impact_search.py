"""Exact top-k inner products from an impact-ordered score-at-a-time index.

Each dimension's postings are cut into segments by quantised value. A query takes the segments of all dimensions by
falling impact, keeps a lower and an upper bound of every row's score, and stops when the bounds prove that few rows
can still be among the k best; those are scored exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .near_vectors import finite

LEVELS = 32
BLOCK = 4096
QUERIES = 512
#: Values up to which sums of products are exact in double precision (times the number of dimensions).
_SAFE = 1 << 50
_LONG = (1 << 63) - 1


@dataclass
class Block:
    """Postings of up to ``BLOCK`` rows: per dimension row numbers in order of level, and where each level begins."""

    ids: np.ndarray
    values: np.ndarray  # rows x dimensions, int64
    low: np.ndarray
    width: np.ndarray
    postings: np.ndarray  # dimensions x rows
    begins: np.ndarray  # dimensions x (LEVELS + 1)

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray, levels: int = LEVELS) -> Block:
        low, high = values.min(axis=0), values.max(axis=0)
        width = (high - low) // levels + 1
        level = (values - low) // width
        postings = np.argsort(level, axis=0, kind="stable").T.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        begins = np.stack([np.searchsorted(np.sort(level[:, d]), np.arange(levels + 1)) for d in range(values.shape[1])])
        return cls(ids, values, low, width, np.ascontiguousarray(postings), begins)

    def top(self, query: np.ndarray, own: int, k: int, chunk: int = 300) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (score, id) of the rows other than ``own``, ties to the smaller id; and segments processed."""
        n, dims = self.values.shape
        if not self._safe(query):
            at = np.flatnonzero(self.ids != own)
            exact = [sum(int(x) * int(y) for x, y in zip(self.values[i], query, strict=True)) for i in at]
            exact = [max(-_LONG, min(_LONG, s)) for s in exact]
            return sorted(((s, int(self.ids[i])) for s, i in zip(exact, at, strict=True)), key=lambda x: (-x[0], x[1]))[:k], 0
        levels = self.begins.shape[1] - 1
        start = self.low[:, None] + self.width[:, None] * np.arange(levels)
        first, last = query[:, None] * start, query[:, None] * (start + self.width[:, None] - 1)
        upper = np.maximum(first, last)
        # A segment's impact is the most it adds over the least of its dimension; no row has less than that minus error.
        impact = (upper - np.minimum(first, last).min(axis=1)[:, None]).ravel()
        error = float((np.abs(query) * (self.width - 1)).sum())
        order = np.flatnonzero((self.begins[:, 1:] > self.begins[:, :-1]).ravel())
        order = order[np.argsort(-impact[order], kind="stable")]
        unit = 1 << int(dims).bit_length()  # sums of impacts and the number of segments met, in one number
        met = np.zeros(n)
        mine = np.flatnonzero(self.ids == own)
        others = possible = np.flatnonzero(self.ids != own)
        goal = max(16, 4 * k, n // 8)
        done = 0
        while done < len(order) and len(possible) > goal:
            part = order[done : done + chunk]
            done += len(part)
            d, level = part // levels, part % levels
            size = self.begins[d, level + 1] - self.begins[d, level]
            rows = np.concatenate([self.postings[i, self.begins[i, v] : self.begins[i, v + 1]] for i, v in zip(d.tolist(), level.tolist(), strict=True)])
            met += np.bincount(rows, weights=np.repeat(impact[part] * unit + 1.0, size), minlength=n)
            total = np.floor(met / unit)
            # What a row has not met yet lies in segments of at most the next one's impact.
            rest = (dims - (met - total * unit)) * (impact[order[done]] if done < len(order) else 0)
            total[mine] = -np.inf
            sure = np.partition(total, n - k)[n - k] - error if len(others) > k else -1.0
            possible = np.flatnonzero(total + rest >= sure)
        exact = self.values[possible] @ query
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return [(int(exact[i]), int(self.ids[possible[i]])) for i in best], done

    def _safe(self, query: np.ndarray) -> bool:
        most = max(abs(int(self.values.max())), abs(int(self.values.min())), 1) + int(self.width.max())
        return 2 * most * max(1, int(np.abs(query).max())) * len(query) ** 2 < _SAFE


def quantise(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component; values beyond 62 bits are held at that bound."""
    return np.clip(np.floor(256.0 * v), -(2.0**62), 2.0**62).astype(np.int64)


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the index over ``vectors`` (id, v): block, dims, payload. Every row is in one block."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dims: int) -> pd.DataFrame:
            nonlocal seq
            rows = held.pop(dims)
            index = Block.build(np.array([i for i, _ in rows], dtype=np.int64), quantise(np.array([v for _, v in rows], dtype=np.float64)))
            out = pd.DataFrame({"block": [part + seq], "dims": [dims], "payload": [pickle.dumps(index, protocol=5)]})
            seq += 1
            return out

        for f in frames:
            for i, v in zip(f["id"].tolist(), f["v"], strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= block:
                    yield flush(len(v))
        for dims in list(held):
            yield flush(dims)

    return vectors.select("id", "v").mapInPandas(build, "block long, dims int, payload binary")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """For each row of ``embeddings`` (vec_id, embedding) whose id is divisible by ``every``: its ``k`` best others.

    Columns: query_id, rank (from 1), vec_id, score: integer inner product of floor(256 * x), ties to the smaller vec_id;
    fewer rows where there are fewer others of the same length. Rows without id and vectors that are null, empty or hold
    null or non-finite components take no part. Rows that repeat an id are each a query and a candidate of other ids;
    scores beyond a long are held at its bounds; a query's repeated rows give one answer, and a repeated candidate can fill several ranks. No queries give no rows.

    Every group of queries meets every block of the index once; a task holds one of each.
    """
    good = finite("embedding") & F.col("vec_id").isNotNull()
    vectors = embeddings.where(good).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    spread = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20))
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    index = materialize(build_index(vectors.repartition(blocks, spread)), "index")
    queries = vectors.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"])
    groups = max(1, -(-n // every // QUERIES))
    queries = queries.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups))).withColumn("dims", F.size("v"))
    packed = materialize(queries.groupBy("g", "dims").agg(F.collect_list(F.struct("id", "v")).alias("queries")), "queries")
    met = packed.join(index.select("block", "dims"), "dims").join(index, ["block", "dims"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for payload, queries in zip(f["payload"], f["queries"], strict=True):
                index = pickle.loads(payload)
                out = [(q["id"], i, s) for q in queries for s, i in index.top(quantise(np.asarray(q["v"], dtype=np.float64)), q["id"], k)[0]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = met.select("payload", "queries").mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
