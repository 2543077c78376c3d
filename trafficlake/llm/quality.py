"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in turn on binned features and add up to one lookup table per feature,
then to one per chosen pair. A score is a sum of table entries, so scoring is a few array additions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc32_of, in_groups, text_batches, text_of

#: Bound of the fit: labelled rows.
MAX_LABELLED = 20_000

_KINDS = {
    "lower": bytes(range(0x61, 0x7B)),
    "upper": bytes(range(0x41, 0x5B)),
    "digit": b"0123456789",
    "blank": b" \t\n\r\v\f",
    "stops": b".,;:?'\"-()",
    "wide": bytes(range(0x80, 0x100)),
}
FEATURES = [
    "chars", "words", "word_length", "longest_word", *_KINDS, "marks", "bangs", "bars", "distinct_words", "top_word", "same_next", "distinct_pairs",
    "stop_ends", "line_words", "repeated_lines", "capital_words",
]


def features(text: str) -> list[float]:
    """Shape of a text, as numbers that do not depend on its language; an empty text is all zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    share = [1 - len(raw.translate(None, chars)) / n for chars in _KINDS.values()]
    marks = 1 - sum(share)
    words = text.split()
    k = len(words)
    if not k:
        return [np.log1p(len(text)), 0.0, 0.0, 0.0, *share, marks, *[0.0] * (len(FEATURES) - 5 - len(share))]
    counts = Counter(words)
    following = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(text)), np.log1p(k), sum(map(len, counts)) / len(counts), float(np.log1p(max(map(len, counts)))), *share, marks,
        raw.count(b"!") / k, raw.count(b"|") / k, len(counts) / k, max(counts.values()) / k, sum(a == b for a, b in following) / k,
        len(set(following)) / k, sum(c for w, c in counts.items() if w[-1] in ".!?") / k, np.log1p(k / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), sum(c for w, c in counts.items() if w[0].isupper()) / k,
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Additive:
    """Cut points and tables: score = logistic(intercept + tables of single features + tables of pairs)."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), dtype=int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best cut of a histogram of gradients: gain, and the first bin of its right side."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree with at most ``leaves`` leaves, grown by the best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b], ridge), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """One cut of the rows of a two-way histogram and one cut of the columns on each side: gain and values."""
    best_gain, best = 0.0, np.zeros_like(g)
    top_g, top_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for r in range(1, len(g)):
        gain, table = -whole, np.empty_like(g)
        for rows, cg, ch in ((slice(0, r), top_g[r - 1], top_h[r - 1]), (slice(r, None), top_g[-1] - top_g[r - 1], top_h[-1] - top_h[r - 1])):
            _, k = _split(cg, ch, ridge)
            for cols in (slice(0, k), slice(k, None)):
                gs, hs = cg[cols].sum(), ch[cols].sum()
                gain += gs**2 / (hs + ridge)
                table[rows, cols] = gs / (hs + ridge)
        if gain > best_gain:
            best_gain, best = gain, table
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.1, ridge: float = 5.0) -> Additive:
    """Boost on rows ``x`` with labels 0/1. One class only gives a constant, no rows give 0.5.

    Every fifth row is left out of the fit; of both phases the round that does best on those rows is kept.
    """
    if not len(y):
        return Additive(0.0)
    base = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(base / (1 - base))))
    if y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    b, z = model.bins(x), np.full(len(y), model.intercept)
    test = np.arange(len(y)) % 5 == 4
    fit_rows = ~test

    def loss() -> float:
        return float(np.logaddexp(0, np.where(y[test] > 0, -z[test], z[test])).mean()) if test.any() else 0.0

    def slopes(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z[fit_rows], -30, 30)))
        i = index[fit_rows]
        return np.bincount(i, weights=y[fit_rows] - p, minlength=size), np.bincount(i, weights=p * (1 - p), minlength=size)

    best = (loss(), [t.copy() for t in model.tables])
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            step = rate * shallow_tree(*slopes(b[:, j], len(t)), 3, ridge)
            t += step
            z += step[b[:, j]]
        if (now := loss()) <= best[0]:
            best = (now, [t.copy() for t in model.tables])
    model.tables = best[1]
    z = model.intercept + sum(t[b[:, j]] for j, t in enumerate(model.tables))

    def flat(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        return b[:, i] * shape[1] + b[:, j], shape

    found = []
    for i in range(len(model.cuts)):
        for j in range(i + 1, len(model.cuts)):
            index, shape = flat(i, j)
            g, h = (s.reshape(shape) for s in slopes(index, shape[0] * shape[1]))
            found.append((pair_tree(g, h, ridge)[0], i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(found, reverse=True)[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    best = (loss(), [t.copy() for t in model.pair_tables])
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            index, shape = flat(i, j)
            g, h = (s.reshape(shape) for s in slopes(index, shape[0] * shape[1]))
            step = rate * pair_tree(g, h, ridge)[1]
            t += step
            z += step[b[:, i], b[:, j]]
        if (now := loss()) <= best[0]:
            best = (now, [t.copy() for t in model.pair_tables])
    model.pair_tables = best[1]
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_labelled: int = MAX_LABELLED, seed: int = 5) -> Additive:
    """Fit on a seeded sample of at most ``max_labelled`` labelled rows outside the held-out fold; equal rows are learnt once."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where(F.pmod(crc32_of("doc_id"), F.lit(folds)) != held_out)
    chosen = F.broadcast(marks.join(bounded_sample(marks, max_labelled, seed, "doc_id"), "doc_id"))  # at most max_labelled ids
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.xxhash64("text")).join(chosen, "doc_id")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in in_groups(frames):
            yield pd.DataFrame({"doc_id": f["doc_id"], "digest": f["digest"], "quality": f["quality"], "x": list(feature_matrix(f["text"].tolist()))})

    measured = rows.mapInPandas(measure, "doc_id long, digest long, quality int, x array<double>").dropDuplicates(["doc_id", "digest"])
    seen = measured.orderBy(F.xxhash64(F.lit(seed), "doc_id", "digest"), "doc_id", "digest").limit(max_labelled).drop("digest").toPandas()
    if not len(seen):
        return Additive(0.0)
    x = np.stack(seen["x"].to_numpy())
    order = np.lexsort((*x.T, seen["doc_id"].to_numpy()))  # the same rows in the same order on every run
    mixed = order[np.random.default_rng(seed).permutation(len(order))]
    return fit(x[mixed], seen["quality"].to_numpy(dtype=float)[mixed])


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, max_labelled: int = MAX_LABELLED, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (score >= ``threshold``), ``keep``.

    Labels (doc_id, quality) are learnt outside the held-out fold only (crc32(doc_id) mod ``folds`` is not
    ``held_out``); of several labels of an id the smallest counts. Null text is empty, null ids are scored but never
    learnt from, every row gives one row, an empty table none. Without labels every score is 0.5.
    """
    text_batches(docs.sparkSession)
    model = learn(docs, labels, folds, held_out, max_labelled)
    fold = F.pmod(crc32_of("doc_id"), F.lit(folds)) == held_out
    own = [k for k in keep if k != "doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"), fold.alias("held_out"), *own)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in in_groups(frames, "_text"):
            s = model.scores(feature_matrix(f["_text"].tolist()))
            out = f[["doc_id", "held_out", *own]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["score"], out["predicted"] = s, (s >= threshold).astype(np.int32)
            yield out

    schema = "doc_id long, held_out boolean, " + "".join(f"`{k}` {kinds[k]}, " for k in own) + "score double, predicted int"
    return rows.mapInPandas(score, schema).select("doc_id", "held_out", "score", "predicted", *own)
