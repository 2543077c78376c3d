"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Most bytes of a side that is hinted for broadcast; larger sides take a shuffle join.
BROADCAST_BYTES = 16 << 20


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and later stages reread files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, limit: int, seed: int, *keys: str) -> DataFrame:
    """At most ``limit`` rows of distinct ``keys``, those of smallest seeded hash; the same on every run.

    A bound on the hash, taken from the number of rows, leaves about twice as many rows before they are ordered.
    """
    n = df.count()
    rows = df.select(*keys).withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    if n > 4 * limit:
        rows = rows.where(F.shiftrightunsigned("_h", 16) < F.lit(int((1 << 48) * 2 * limit / n)))
    return rows.distinct().orderBy("_h", *keys).limit(limit).select(*keys)


def broadcast_if_small(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """Hint a broadcast when the measured size of a written table is within the bound.

    ``row_bytes`` estimates one row. The sum runs on executors; one number reaches the driver.
    """
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def crc32_of(name: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def text_of(name: str = "text") -> Column:
    """The text; null is empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of one Arrow batch where rows hold whole texts; Spark's default of 10,000 can take hundreds of megabytes.
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session small enough for whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def release_memory() -> None:
    """Hand freed memory back to the system.

    A worker serves one task after another, and what its allocators keep of earlier groups counts as the executor's
    memory. C libraries without ``malloc_trim`` keep theirs.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_groups(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = 1_500_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that one group holds about ``chars`` characters (one longer text is a group alone).

    Memory that is free goes back to the system before each batch and after the last one.
    """
    for frame in frames:
        release_memory()
        if not len(frame):
            continue
        ends = np.cumsum(frame[column].str.len().to_numpy())
        for _, rows in frame.groupby(ends // chars, sort=True):
            yield rows
    release_memory()


# --- words of many texts at once -----------------------------------------------------------------------------------

_LOWER = bytes(c + 32 if 0x41 <= c < 0x5B else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64, grown by doubling and kept."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of ``(byte + 1) * base**i``: ``span_hash`` takes any substring's hash from them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:stop]``, independent of its place."""
    raw = (prefix[stop] - prefix[start]) * powers(_UNBASE, len(prefix))[start]
    return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Hashes(dict):
    """Keyed 64-bit hashes of byte strings, kept per worker; no texts are known that make two of them equal."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _Hashes()
#: Words whose hashes a worker keeps.
_KEPT_WORDS = 150_000


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    if len(_HASHES) > _KEPT_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def forget_words() -> None:
    """Free the kept hashes at the end of a task; the worker may go on with work that needs its memory."""
    _HASHES.clear()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and where each text's words end."""
    words: list[bytes] = []
    ends = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words += text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        ends[i] = len(words)
    return hash_words(words), ends


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Per text its distinct ``size``-word shingles as sorted 64-bit hashes.

    Fewer words make one shingle of the whole sequence; a text without words has none.
    """
    words, ends = word_hashes(texts)
    out, begin = [], 0
    rolled = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + len(rolled)])
    for end in ends:
        n = end - begin
        if n >= size:
            out.append(np.unique(rolled[begin : end - size + 1]))
        elif n:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(begin, end):
                one = mix(one * np.uint64(0x9FB21C651E98DF25) + words[k : k + 1])
            out.append(mix(one + np.uint64(n)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        begin = end
    return out


def crc32_ids(ids: bytes) -> int:
    """Unsigned crc32 of little-endian unsigned 32-bit ids."""
    return zlib.crc32(ids) & 0xFFFFFFFF


def gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    """``span_hash`` of every ``gram`` neighbouring bytes."""
    raw = (prefix[gram:] - prefix[:-gram]) * powers(_UNBASE, len(prefix) - gram)
    return mix(raw + np.uint64(gram) * np.uint64(0xD6E8FEB86659FD93))


# --- connected components ------------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each id that has a link: ``(id, component_id)``.

    Rounds of pointing every node at the smallest neighbour of its smaller neighbours, then at its own smallest
    one, until nothing moves. Each round is written to the shared folder; ids are never collected. Aggregations
    combine before the shuffle, and a hub's rows meet only in joins that adaptive execution can split. Nulls and
    links of a node with itself are ignored; no links give no rows.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialize(edges.select(hi.alias("u"), lo.alias("v")).distinct(), "components")

    def state(e: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(e.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.max(h), F.min(h)).first())

    seen = state(edges)
    while seen[0]:
        parent = edges.groupBy("u").agg(F.min("v").alias("m"))
        up = edges.join(parent.select(F.col("u").alias("v"), F.col("m").alias("g")), "v", "left")
        up = up.select("u", F.coalesce("g", "v").alias("v")).distinct()
        parent = up.groupBy("u").agg(F.min("v").alias("m"))
        both = up.join(parent, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = materialize(both.select("e.u", "e.v").where("u <> v").distinct(), "components")
        now = state(edges)
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(own.distinct())


class Forest:
    """Union-find over positions 0..n-1 that keeps the smallest member as the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
