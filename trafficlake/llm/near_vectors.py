"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of one label are cut into tiles along their first principal direction; tiles too far apart on it are never
met. Inside a pair of tiles inner products are summed over leading principal dimensions first, and a pair is given up
when the sum plus the product of the norms of what is left cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize

#: Vectors that fit the principal directions (an order of work only; results do not depend on it).
FIT_ROWS = 8192
TILE = 1024
_LEAD_BINS = 512
_SLACK = 1e-9
_STEPS = (8, 16, 32)


def finite(name: str) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    ok = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(name) > 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (first by their largest component, against overflow)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling share of the unit vectors' second moment."""
    u = unit(vectors)
    _, directions = np.linalg.eigh(u.T @ u)
    return np.ascontiguousarray(directions[:, ::-1])


def linked_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Boolean matrix: cosine of row i of ``a`` and row j of ``b`` is at least ``threshold``."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ rotation, ub @ rotation
    rest_a, rest_b = (np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1])) for r in (ra, rb))
    out = np.zeros((len(a), len(b)), dtype=bool)
    dims = ra.shape[1]
    total, done = np.zeros((len(a), len(b))), 0
    for stop in [s for s in _STEPS if s < dims] + [dims]:
        total += ra[:, done:stop] @ rb[:, done:stop].T
        done = stop
        if done == dims:
            break
        alive = total + rest_a[:, done, None] * rest_b[None, :, done] >= threshold - _SLACK
        if same:
            alive &= np.tri(len(a), k=-1, dtype=bool).T
        if not alive.any():
            return out
        i, j = np.nonzero(alive)
        if len(i) * 20 < alive.size:  # few are left: finish them one by one
            value = total[i, j] + np.einsum("ij,ij->i", ra[i, done:], rb[j, done:])
            out[i, j] = value >= threshold
            _settle(out, ua, ub, i, j, value, threshold)
            return out | out.T if same else out
    if same:
        np.fill_diagonal(total, -1)
    out = total >= threshold
    i, j = np.nonzero(np.abs(total - threshold) <= _SLACK)
    _settle(out, ua, ub, i, j, total[i, j], threshold)
    return out


def _settle(out: np.ndarray, ua: np.ndarray, ub: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray, threshold: float) -> None:
    """Pairs at the threshold are decided on the vectors as they were given, not on the rotated ones."""
    at = np.abs(value - threshold) <= _SLACK
    out[i[at], j[at]] = np.einsum("ij,ij->i", ua[i[at]], ub[j[at]]) >= threshold


def link_vectors(embeddings: DataFrame, threshold: float = 0.93, tile: int = TILE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Links between rows of ``embeddings`` (vec_id, embedding, label) of equal, non-null label and equal length.

    Per row: vec_id, n_links (other rows with cosine >= ``threshold``), component_id (smallest vec_id reachable), kept.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, link with nothing.
    Equal vectors of one label are one class that counts as often as it occurs; classes meet, copies do not. Only
    link counts and each tile pair's spanning links leave a task. An empty table gives no rows.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    good = finite("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(good, F.lit(False)).alias("good"), "embedding")
    rows = rows.withColumn("s1", F.xxhash64(F.lit(1), "embedding")).withColumn("s2", F.xxhash64(F.lit(2), "embedding"))
    same = ["label", "s1", "s2"]
    classes = rows.where("good").groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("v"))
    classes = materialize(classes.select(*same, "id", "n", F.transform("v", lambda x: x.cast("double")).alias("v")), "vectors")

    sample = classes.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toPandas()["v"]
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    rotations = {d: principal_directions(np.array(x)) for d, x in by_size.items()}

    def rotation(d: int) -> np.ndarray:
        return rotations.get(d, np.eye(d))

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                out = f[["label", "id", "n"]].copy()
                out["dims"] = [len(v) for v in f["v"]]
                out["lead"] = [float((unit(v[None, :]) @ rotation(len(v))[:, :1])[0, 0]) for v in f["v"]]
                out["v"] = [v.tobytes() for v in f["v"]]
                yield out

    kind = embeddings.schema["label"].dataType.simpleString()
    led = classes.select("label", "id", "n", "v").mapInPandas(lead, f"label {kind}, id long, n long, dims int, lead double, v binary")
    led = led.withColumn("bin", F.floor(F.col("lead") * (_LEAD_BINS // 2)).cast("int"))
    led = materialize(led, "led")

    group = ["label", "dims"]
    bins = led.groupBy(*group, "bin").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy(*group).orderBy("bin")) - F.col("k")
    bins = bins.select(*group, "bin", F.floor(before / tile).alias("t"), F.ceil(F.col("k") / tile).alias("parts"))
    tiled = led.join(bins, [*group, "bin"])
    # A bin above the tile size is cut by a hash into tiles of its own (1, 2, ...), others share tile 0 of their stretch.
    part = F.when(F.col("parts") > 1, F.concat_ws("-", F.col("bin"), F.pmod(F.xxhash64("id"), F.col("parts")))).otherwise(F.lit(""))
    tiled = materialize(tiled.select(*group, F.concat_ws("/", "t", part).alias("tile"), "id", "n", "lead", "v"), "tiles")
    stats = tiled.groupBy(*group, "tile").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    stats = materialize(stats, "stats")
    other = stats.select(*group, F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = stats.join(other, group).where((F.col("tile") <= F.col("tile2")) & (F.col("lo2") - F.col("hi") <= reach) & (F.col("lo") - F.col("hi2") <= reach))
    sides = F.explode(F.when(F.col("tile") == F.col("tile2"), F.array("tile")).otherwise(F.array("tile", "tile2")))
    pairs = pairs.select(*group, F.col("tile").alias("a"), F.col("tile2").alias("b"), sides.alias("tile"))
    met = tiled.join(pairs, [*group, "tile"])

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        same_tile = bool((f["a"] == f["b"]).iloc[0])
        f = f.sort_values("id")
        a = f[f["tile"] == f["a"]]
        b = a if same_tile else f[f["tile"] == f["b"]]
        empty = pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")
        if not len(a) or not len(b):
            return empty
        va, vb = (np.frombuffer(b"".join(x["v"]), dtype=np.float64).reshape(len(x), -1) for x in (a, b))
        m = linked_pairs(va, vb, rotation(va.shape[1]), threshold, same_tile)
        if not m.any():
            return empty
        ida, idb = a["id"].to_numpy(), b["id"].to_numpy()
        links_a, links_b = m @ b["n"].to_numpy(), m.T @ a["n"].to_numpy()
        big = np.iinfo(np.int64).max
        root_a, root_b = ida.copy(), idb.copy()
        while True:  # smallest id over the links of this pair of tiles
            new_b = np.minimum(root_b, np.where(m, root_a[:, None], big).min(axis=0))
            new_a = np.minimum(root_a, np.where(m, new_b[None, :], big).min(axis=1))
            if same_tile:
                new_a = new_b = np.minimum(new_a, new_b)
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        out = pd.DataFrame({"id": ida, "links": links_a, "root": root_a})
        if not same_tile:
            out = pd.concat([out, pd.DataFrame({"id": idb, "links": links_b, "root": root_b})])
        return out[out["links"] > 0]

    found = met.groupBy(*group, "a", "b").applyInPandas(compare, "id long, links long, root long")
    found = materialize(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = classes.select(*same, "id", "n").join(links, "id", "left").join(comps, "id", "left")
    per_class = per_class.select(*same, F.col("id").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_id", "id").alias("component"))
    out = rows.select("vec_id", "good", *same).join(per_class, same, "left")
    return out.select(
        "vec_id",
        F.when(F.col("good"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
