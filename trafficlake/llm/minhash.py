"""Near-duplicate documents by HyperMinHash sketches.

A sketch has one register per bucket. Each bucket hashes all shingles by its own function and stores the smallest
hash as its count of leading zeros and the mantissa bits that follow, so that small sets fill every register, too.
Documents that agree on a whole band of registers are candidates; a Jaccard estimate corrected for chance collisions
of compressed registers goes before the exact comparison of the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, broadcast_if_small, components, forget_words, in_groups, materialize, mix, shingle_sets, text_batches, text_of

BUCKETS = 128
ROWS = 4
MANTISSA = 10
_SEEDS = np.random.default_rng(20240607).integers(0, 1 << 63, size=(2, BUCKETS), dtype=np.uint64)
_FACTORS, _OFFSETS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1] * np.uint64(2)
#: Members of one tile when a group is compared in full.
TILE = 2048


def compress(smallest: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the mantissa of 64-bit minima, as 16-bit registers."""
    v = smallest >> np.uint64(11)
    exponent = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    zeros = 53 - exponent
    down, up = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64), np.maximum(1 + MANTISSA - exponent, 0).astype(np.uint64)
    return (zeros << MANTISSA | (((v >> down) << up) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)).astype("<u2")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; empty sets have rows of zeros."""
    out = np.zeros((len(sets), BUCKETS), dtype="<u2")
    full = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
    smallest = np.empty((BUCKETS, len(full)), dtype=np.uint64)
    for k in range(BUCKETS):
        smallest[k] = np.minimum.reduceat(flat * _FACTORS[k] + _OFFSETS[k], starts)
    out[full] = compress(smallest).T
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ``ROWS`` registers."""
    packed = np.ascontiguousarray(registers).view("<u8")
    return mix(packed + np.arange(packed.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@cache
def _collisions() -> np.ndarray:
    """``collision_rate`` of sizes 2 ** (i / 8) and 2 ** (j / 8)."""
    sizes = 2.0 ** (np.arange(256) / 8)
    return collision_rate(np.repeat(sizes, 256), np.tile(sizes, 256)).reshape(256, 256)


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that the registers of two sets of these sizes agree though their smallest hashes differ."""
    edge = 2.0 ** -np.arange(54)
    out = np.zeros(len(n_a))
    for lo, hi in zip(edge[1:], edge[:-1], strict=True):
        a = np.power(1 - lo, n_a) - np.power(1 - hi, n_a)
        out += a * (np.power(1 - lo, n_b) - np.power(1 - hi, n_b))
    return out / (1 << MANTISSA)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers."""
    a, b = (np.minimum(np.rint(8 * np.log2(n)).astype(np.int64), 255) for n in (n_a, n_b))
    c = _collisions()[a, b]
    return (equal / BUCKETS - c) / (1 - c)


def reaching(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, floor: float) -> np.ndarray:
    """Places whose estimate is at least ``floor``; the correction only lowers the plain share, which goes first."""
    at = np.flatnonzero(equal >= floor * BUCKETS)
    return at[estimate(equal[at], n_a[at], n_b[at]) >= floor]


def _floor(similarity: float) -> float:
    """Five standard errors below the threshold: nothing above it is dropped by the estimate in practice."""
    return similarity - 5 * float(np.sqrt(similarity * (1 - similarity) / BUCKETS))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """Components of documents linked where ``100 * intersection >= percent * union`` of their shingle sets.

    ``docs`` (doc_id, text) gives per row doc_id, n_shingles, component_id (the smallest linked doc_id) and kept. Words
    are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer words than ``shingle`` make one shingle, no words none, and
    an empty set is linked with nothing. Rows of one doc_id are one document; null ids are linked with nothing (null
    component, kept). An empty table gives no rows.

    Equal sets are one class from the start. The members of a band's group are first compared with one of them: the one
    that shares most groups with others, as an original does with its copies, then the one that shares fewest. Only groups
    of more than three whose members are still in different components are compared in full, tile by tile; a tile gives
    links that join components, not pairs. Every link comes from full sets.
    """
    floor = _floor(percent / 100)
    text_batches(docs.sparkSession)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in in_groups(frames):
            sets = shingle_sets(f["text"].tolist(), shingle)
            out = pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n": [len(s) for s in sets]})
            both = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64)
            out["s1"], out["s2"] = both.reshape(-1, 2).T
            out["sketch"] = [r.tobytes() for r in sketches(sets)]
            yield out
        forget_words()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = materialize(texts.mapInPandas(measure, "doc_id long, n long, s1 long, s2 long, sketch binary"), "sketches")
    same = ["n", "s1", "s2"]
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch"))
    classes = materialize(classes, "classes")

    def bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                keys = band_keys(np.frombuffer(b"".join(f["sketch"]), dtype="<u2").reshape(len(f), BUCKETS))
                yield pd.DataFrame({"key": keys.ravel(), "id": np.repeat(f["id"].to_numpy(), keys.shape[1])})

    entries = classes.select("id", "sketch").mapInPandas(bands, "key long, id long")
    shared = entries.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    groups = materialize(entries.join(shared, "key"), "groups")
    met = groups.groupBy("id").agg(F.sum("k").alias("met"))
    groups = materialize(groups.join(met, "id"), "met")

    def set_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in in_groups(frames):
            yield pd.DataFrame({"id": f["doc_id"], "set": [s.tobytes() for s in shingle_sets(f["text"].tolist(), shingle)]})
        forget_words()

    members = materialize(groups.select(F.col("id").alias("doc_id")).distinct(), "members")
    wanted = texts.join(broadcast_if_small(members, 16), "doc_id", "left_semi")
    full = wanted.mapInPandas(set_of, "id long, set binary")
    # Rows of one id may have several texts: links are looked for from each class's own set.
    measured = classes.select("id", "n", "sketch")
    full = materialize(full.withColumn("n", (F.length("set") / 8).cast("long")), "sets")

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            a, b = (np.frombuffer(b"".join(f[c]), dtype="<u2").reshape(len(f), BUCKETS) for c in ("sketch_a", "sketch_b"))
            na, nb = f["na"].to_numpy(), f["nb"].to_numpy()
            f, equal = f[["a", "b", "na", "nb"]], np.where(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb), (a == b).sum(axis=1), 0)
            yield f.iloc[reaching(equal, na, nb, floor)]

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            linked = []
            for x, y in zip(f["set_a"], f["set_b"], strict=True):
                linked.append(similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent))
            yield f.loc[np.array(linked, dtype=bool), ["a", "b"]]

    def side(df: DataFrame, name: str, value: str) -> DataFrame:
        return df.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col(value).alias(f"{value}_{name}"))

    def verify(pairs: DataFrame) -> DataFrame:
        guess = pairs.join(side(measured, "a", "sketch"), "a").join(side(measured, "b", "sketch"), "b")
        guess = guess.mapInPandas(likely, "a long, b long, na long, nb long")
        both = guess.join(side(full, "a", "set"), ["a", "na"]).join(side(full, "b", "set"), ["b", "nb"])
        return both.select("a", "b", "set_a", "set_b").mapInPandas(exact, "a long, b long")

    def stars(entries: DataFrame, order, apart: bool) -> DataFrame:
        centre = entries.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("c"), *([F.col("comp").alias("cc")] if apart else []))).alias("m"))
        pairs = entries.join(centre, "key").where(F.col("id") != F.col("m.c"))
        if apart:
            pairs = pairs.where(F.col("comp") != F.col("m.cc"))
        return pairs.select(F.least("id", "m.c").alias("a"), F.greatest("id", "m.c").alias("b")).distinct()

    def unresolved(found: DataFrame, met_all: int) -> tuple[DataFrame, DataFrame]:
        """Components so far, and the groups whose members are in several of them. Groups of up to ``met_all`` members
        have had all their pairs compared and are left out."""
        comps = materialize(components(found), "found")
        entries = groups.join(comps, "id", "left").select("key", "id", "met", F.coalesce("component_id", "id").alias("comp"))
        apart = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where(f"lo < hi AND k > {met_all}").select("key", "k")
        return comps, materialize(entries.join(apart, "key"), "apart")

    links = materialize(verify(stars(groups, F.struct(-F.col("met"), F.col("id")), False)), "links")
    comps, open_ = unresolved(links, 2)
    if open_.limit(1).count():  # from the other end of the same order, so that the centre is another member
        links = materialize(links.union(verify(stars(open_, F.struct(F.col("met"), -F.col("id")), True))), "links")
        comps, open_ = unresolved(links, 3)
    if open_.limit(1).count():
        links = links.union(_tiles(open_.join(measured, "id").join(full, ["id", "n"]), percent, floor))
        comps = components(links)

    reach = classes.select(*same, "id").join(comps, "id", "left").select(*same, F.coalesce("component_id", "id").alias("reach"))
    out = rows.select("doc_id", *same).join(reach, same, "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("reach")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets."""
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets: products of 0/1 matrices, some elements at a time."""
    element, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    shared = np.bincount(code, minlength=len(element)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(code, [first, first + columns])
        m = np.zeros((len(left) + len(right), columns), dtype=np.float32)
        m[owner[a:b], code[a:b] - first] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _tiles(members: DataFrame, percent: int, floor: float) -> DataFrame:
    """Links a, b that join components inside one group (key, k, id, n, sketch, set, comp).

    A group is cut into tiles by a hash; each pair of tiles is a group of its own with at most about ``2 * TILE`` rows.
    Rows with a likely partner in another component, by sketches, are compared on their full sets.
    """
    n_tiles = F.ceil(F.col("k") / TILE).cast("int")
    tiled = members.withColumn("t", F.pmod(F.xxhash64("id"), n_tiles).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), n_tiles - 1)))
    tiled = tiled.select("key", "id", "n", "sketch", "set", "comp", "t", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        f = f.sort_values("id", ignore_index=True)
        lo, hi = (np.flatnonzero(f["t"].to_numpy() == f[c].iloc[0]) for c in ("lo", "hi"))
        ids, n, comp = f["id"].to_numpy(), f["n"].to_numpy(), np.unique(f["comp"], return_inverse=True)[1]
        sketch = np.frombuffer(b"".join(f["sketch"]), dtype="<u2").reshape(len(f), BUCKETS)
        likely = np.zeros((len(lo), len(hi)), dtype=bool)
        for r, i in enumerate(lo.tolist()):
            j = np.flatnonzero((comp[hi] != comp[i]) & (100 * np.minimum(n[hi], n[i]) >= percent * np.maximum(n[hi], n[i])))
            likely[r, j[reaching((sketch[hi[j]] == sketch[i]).sum(axis=1), n[hi[j]], np.full(len(j), n[i]), floor)]] = True
        rows, cols = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        if not len(rows):
            return none
        sets = [np.frombuffer(s, dtype=np.uint64) for s in f["set"]]
        left, right = lo[rows], hi[cols]
        common = intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
        linked = likely[np.ix_(rows, cols)] & (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common))
        forest = Forest(int(comp.max()) + 1)
        pairs = [(ids[left[i]], ids[right[j]]) for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True) if forest.union(comp[left[i]], comp[right[j]])]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64") if pairs else none

    return tiled.groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without documents that are not the first of their component; rows of one id stay or go together."""
    gone = near_duplicates(docs, shingle, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
