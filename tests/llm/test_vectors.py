"""Near vectors and exact search against brute force."""

import numpy as np
import pytest

from trafficlake.llm import impact_search, near_vectors

from .helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, links long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x") for i, v, l in rows], SCHEMA)


def clustered(seed, n=300, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    v = (centres[rng.integers(12, size=n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.25, 1.0], size=(n, 1))).astype(np.float32)
    v[5] = v[3]
    v[9] = v[3] * 2
    return [(i * 5, v[i].tolist(), None if i % 50 == 49 else int(rng.integers(3))) for i in range(n)]


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [None] + [1.0] * 23, 1), (9005, [float("nan")] + [1.0] * 23, 1), (9006, [float("inf")] + [1.0] * 23, 1), (None, [1.0] * 24, 1), (9050, [1.0, 2.0], 1)]


@pytest.mark.parametrize("tile", [16, 1024])
def test_links_match_brute_force(spark, tile):
    rows = clustered(tile)
    v = np.array([x for _, x, _ in rows], dtype=np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = [x for _, _, x in rows]
    linked = [[i != j and label[i] is not None and label[i] == label[j] and u[i] @ u[j] >= 0.93 for j in range(len(rows))] for i in range(len(rows))]
    reach = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if linked[i][j]])
    want = [(r[0], sum(linked[i]), rows[reach[i]][0], reach[i] == i) for i, r in enumerate(rows)]
    got = near_vectors.link_vectors(frame(spark, rows + ODD), 0.93, tile, fit_rows=100).collect()
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None and r["vec_id"] < 9000) == want
    odd = [tuple(r)[1:] for r in got if r["vec_id"] is None or r["vec_id"] >= 9000]
    assert len(odd) == len(ODD) and all(n == 0 and kept for n, _, kept in odd)


def test_copies_count_without_being_paired(spark):
    rows = [(i, [1.0, 0.0, 0.5], 1) for i in range(500)] + [(600, [1.0, 0.01, 0.5], 1), (601, [1.0, 0.0, 0.5], 2), (602, [2.0, 0.0, 1.0], 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors.link_vectors(frame(spark, rows), tile=64).collect()}
    assert got[0] == (501, 0, True) and got[600] == (501, 0, False) and got[601] == (0, 601, True) and got[602] == (501, 0, False)


def test_no_vectors(spark):
    assert near_vectors.link_vectors(frame(spark, [])).count() == 0
    assert impact_search.top_k(frame(spark, [])).count() == 0
    assert impact_search.top_k(frame(spark, ODD)).count() == 0


def brute(rows, k=5, every=50):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v, _ in rows]
    out = []
    for q, x in good:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    rows = clustered(8)
    ties = [(i, [0.25] * 24, 0) for i in range(5000, 5100, 3)]
    got = impact_search.top_k(frame(spark, rows + ties + ODD[:-2])).collect()
    assert sorted(tuple(r) for r in got) == brute(rows + ties)
    monkeypatch.setattr(impact_search, "BLOCK", 40)
    monkeypatch.setattr(impact_search, "QUERIES", 3)
    got = impact_search.top_k(frame(spark, rows + ties)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows + ties)
    few = [(0, [0.5, -0.5], 1), (1, [0.1, 0.1], 1), (2, [-1e30, 3e30], 1)]
    assert [(r["rank"], r["vec_id"]) for r in impact_search.top_k(frame(spark, few)).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_search_stops_before_the_last_segment():
    rng = np.random.default_rng(0)
    v = rng.integers(-40, 40, size=(4000, 32))
    q = rng.integers(-40, 40, size=32)
    v[17] = q * 2
    index = impact_search.Block.build(np.arange(4000), v)
    best, done = index.top(q, -1, 1)
    assert best == [(int(v[17] @ q), 17)] and done < 32 * impact_search.LEVELS
