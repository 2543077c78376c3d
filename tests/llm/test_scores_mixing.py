"""Toxicity, quality and mixing on small tables, and the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from trafficlake.llm import mixing, packing, quality, toxicity

from .helpers import WORD, docs_frame, odd_rows


def scored(seed=1, n=900, share=0.25):
    """Texts of which some hold one of a few bad words, some are rows of marks; labels for half of them."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        parts = [rnd.choice(words) for _ in range(rnd.randrange(20, 200))]
        toxic, good = int(rnd.random() < share), int(rnd.random() < 0.7)
        if toxic:
            for _ in range(3):
                parts.insert(rnd.randrange(len(parts)), rnd.choice(["Vile!", "awful", "nasty."]))
        if not good:
            parts = [p + rnd.choice([" |", "###"]) for p in parts]
        docs.append((i, " ".join(parts), f"s{i % 3}"))
        if i % 2:
            labels.append((i, good, toxic))
    return docs, labels


def test_nnpu_finds_the_words(spark):
    docs, labels = scored()
    toxic = {i: t for i, _, t in labels}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs_frame(spark, docs), marks).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.95
    again = toxicity.score_toxicity(docs_frame(spark, docs[::-1]), marks).collect()
    assert sorted(got) == sorted(again)


@pytest.mark.parametrize("share", [0.1, 0.25, 0.32, 0.4, 0.5])
def test_recall_holds_at_any_toxic_share(spark, share):
    docs, labels = scored(7, 1500, share)
    toxic = {i: t for i, _, t in labels}
    got = toxicity.score_toxicity(docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p for t, p in held if t]) > 0.9 and np.mean([not p for t, p in held if not t]) > 0.95


def test_fits_hold_their_bounds_with_one_id_on_most_rows(spark, monkeypatch):
    docs, labels = scored(4, 600)
    docs += [(1, f"again {i} and again", "s1") for i in range(3000)]
    frame, marks = docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = {}
    fit, fit_nnpu = quality.fit, toxicity.fit_nnpu
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.setdefault("quality", len(x)) and fit(x, y))
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda p, u, *a: seen.update(p=len(p), u=len(u)) or fit_nnpu(p, u, *a))
    quality.score_quality(frame, marks, max_labelled=120)
    toxicity.score_toxicity(frame, marks, max_positive=20, max_unlabelled=200)
    assert 60 <= seen["quality"] <= 120 and seen["p"] <= 20 and 100 <= seen["u"] <= 200


def test_non_negative_risk_does_not_fit_unlabelled_positives():
    rng = np.random.default_rng(0)
    positive = [np.array([0, *rng.integers(1, 50, 3)]) for _ in range(200)]
    unlabelled = [np.array([0, *rng.integers(1, 50, 3)]) if i < 60 else rng.integers(1, 50, 4) for i in range(300)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 50, 0.2, 1)
    hit = np.array([w[x].sum() + b > 0 for x in unlabelled])
    assert w[0] > 1 and b < 0 and hit[:60].mean() > 0.9 and hit[60:].mean() < 0.05


def test_additive_model_scores_held_out_rows(spark):
    docs, labels = scored(2)
    good = {i: q for i, q, _ in labels}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs_frame(spark, docs), marks).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in good]
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in held]) > 0.95


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert model.pairs[0] == (0, 1) and ((model.scores(x) > 0.5) == (y > 0)).mean() > 0.9


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_of_odd_rows(spark, score):
    rows = odd_rows()
    for labels in ([], [(1, None, None), (None, 1, 1)], [(5, 1, 1), (5, 0, 0), (7, 1, 0)]):
        got = score(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert score(docs_frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def slow_targets(sizes):
    """Water-filling over sources in order."""
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        free = sum(w for k, w in enumerate(weights) if k not in capped)
        left = total - sum(2 * sizes[k] for k in capped)
        level = left / free if free else 0
        new = {k for k in range(len(sizes)) if k not in capped and weights[k] * level > 2 * sizes[k]}
        if not new:
            return [2 * s if k in capped else weights[k] * level for k, s in enumerate(sizes)]
        capped |= new


def test_targets_and_takes(spark):
    rnd = random.Random(5)
    names = ["B", "a", "é", "", None, "z", "\U0001f600", "￮"]
    rows = [(i, "w " * rnd.randrange(1, 60), names[min(7, int(rnd.expovariate(0.5)))]) for i in range(3000)]
    got = mixing.mix_sources(docs_frame(spark, rows)).collect()
    text = {i: (t, s) for i, t, s in rows}
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(t)) for _, t, s in rows if s == name) for name in order]
    want = dict(zip(order, slow_targets(sizes), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in got:
        t, s = text[r["doc_id"]]
        assert r["size"] == len(WORD.findall(t)) and r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[order.index(s)]
        assert r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in order)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs_frame(spark, rows[::-1])).collect()))


def test_mixing_of_odd_rows(spark):
    got = mixing.mix_sources(docs_frame(spark, odd_rows()), keep=("text", "length")).collect()
    assert len(got) == len(odd_rows()) and all(r["taken"] <= 2 * r["size"] for r in got) and "length" in got[0].asDict()
    assert mixing.mix_sources(docs_frame(spark, [])).count() == 0
    blank = mixing.mix_sources(docs_frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, labels = scored(4, 400)
    docs += [(1000 + i, docs[i][1] + " more", docs[i][2]) for i in range(0, 40)]
    docs_frame(spark, docs).select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, str(tmp_path))
        if k < 4:
            assert table.columns == corpus_pipeline.COLUMNS
            table.write.parquet(str(tmp_path / name))
            table = spark.read.parquet(str(tmp_path / name))
        sizes.append(table.count())
    assert sizes[0] < len(docs) and sizes[1] <= sizes[0] and sizes[2] < sizes[1]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == sizes[4] and "sequence_id" in out.columns


def test_public_names():
    assert packing.CAPACITY == 4096 and mixing.WEIGHTS == (3.0, 1.0, 2.0)
