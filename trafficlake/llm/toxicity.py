"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc32_of, hash_words, in_groups, materialize, text_batches, text_of

#: Bounds of the fit: confirmed examples, unlabelled texts, words of the vocabulary.
MAX_POSITIVE = 8_000
MAX_UNLABELLED = 24_000
MAX_WORDS = 20_000

#: Letters with A-Z lower-cased; every other byte is a blank.
_LETTERS = bytes(c + 32 if 0x41 <= c < 0x5B else c if 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in range(256))


def words_present(texts: list[str], vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, word) without repeats, by text: words are hashes of runs of letters. With a sorted vocabulary the word is
    its place there, others are left out."""
    words: list[bytes] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = set(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split())
        words += own
        sizes[i] = len(own)
    owner, word = np.repeat(np.arange(len(texts)), sizes), hash_words(words)
    if vocabulary is not None:
        at = np.searchsorted(vocabulary, word)
        hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == word if len(vocabulary) else np.zeros(len(word), dtype=bool)
        owner, word = owner[hit], at[hit]
    order = np.lexsort((word, owner))
    return owner[order], word[order]


@dataclass
class Model:
    """Word weights by sorted word hash; a text's score averages the classifiers' logistic outputs."""

    vocabulary: np.ndarray
    weights: np.ndarray  # classifiers x words
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, word = words_present(texts, self.vocabulary)
        out = np.zeros(len(texts))
        for w, b in zip(self.weights, self.bias, strict=True):
            z = np.bincount(owner, weights=w[word], minlength=len(texts)) + b
            out += 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out / max(1, len(self.bias))


def _sums(rows: list[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, dtype=np.int64)
    return np.bincount(np.repeat(np.arange(len(rows)), lens), weights=w[flat], minlength=len(rows)) + b


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], n_words: int, prior: float, seed: int, epochs: int = 40, batches: int = 16, rate: float = 0.05, decay: float = 1e-4
) -> tuple[np.ndarray, float]:
    """One linear classifier on word presence by the non-negative risk with logistic loss.

    risk = prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)). The second term estimates the negatives' risk; where a
    batch makes it negative, the step goes the other way on that term alone, which stops it from fitting the
    unlabelled positives. Adam steps on batches that hold a share of both sets.
    """
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(n_words + 1), np.zeros(n_words + 1), 0

    def gradient(rows: list[np.ndarray], label: int, scale: float, out: np.ndarray) -> float:
        """Adds scale * gradient of the mean loss of ``rows`` under ``label``; returns the mean loss."""
        z = label * _sums(rows, w, b)
        d = -label / (1 + np.exp(np.clip(z, -30, 30))) * scale / len(rows)
        lens = np.array([len(r) for r in rows])
        out[:n_words] += np.bincount(np.concatenate(rows), weights=np.repeat(d, lens), minlength=n_words)
        out[n_words] += d.sum()
        return float(np.logaddexp(0, -z).mean())

    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(batches):
            p = [positive[i] for i in p_order[k::batches]] or [positive[i] for i in p_order[:1]]
            u = [unlabelled[i] for i in u_order[k::batches]] or [unlabelled[i] for i in u_order[:1]]
            plus, minus = np.zeros(n_words + 1), np.zeros(n_words + 1)
            gradient(p, 1, prior, plus)
            risk = gradient(u, -1, 1.0, minus) - prior * gradient(p, -1, -prior, minus)
            g = plus + minus if risk >= 0 else -minus
            g[:n_words] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w = np.maximum(w - step[:n_words], 0)  # words were chosen as evidence for the class; none speaks against it
            b -= float(step[n_words])
    return w, b - _cut(_sums(unlabelled, w, b), prior)


def _cut(values: np.ndarray, prior: float) -> float:
    """Where the class begins: the widest gap among unlabelled values whose rank is within a tenth of the prior's share.

    Logistic outputs of short steps stay on the side of the larger class; the prior says how many belong to the other.
    """
    ordered = np.sort(values)[::-1]
    first, last = int(0.9 * prior * len(ordered)), int(np.ceil(1.1 * prior * len(ordered)))
    gaps = ordered[first : last - 1] - ordered[first + 1 : last]
    if not len(gaps) or gaps.max() <= 1e-6:
        return 0.0
    k = first + int(gaps.argmax())
    return float((ordered[k] + ordered[k + 1]) / 2)


def fit(positive_texts: DataFrame, unlabelled_texts: DataFrame, prior: float, classifiers: int = 3, min_z: float = 4.0, min_lift: float = 3.0) -> Model:
    """Fit on two bounded tables with a ``text``.

    The vocabulary is the words whose share of confirmed texts is above their share of unlabelled ones by ``min_z``
    standard errors, and above the share among negatives that the prior implies ``min_lift`` times (counted on executors); only these and each text's few words of them reach the driver. Without
    confirmed texts or such words the score is the prior.
    """
    both = positive_texts.select("text", F.lit(1).alias("p")).union(unlabelled_texts.select("text", F.lit(0).alias("p")))
    both = materialize(both, "toxicity")
    n = dict.fromkeys((0, 1), 0) | {r["p"]: r["n"] for r in both.groupBy("p").agg(F.count("*").alias("n")).collect()}
    prior = min(max(prior, 1e-3), 0.9)
    flat = Model(np.empty(0, dtype=np.uint64), np.zeros((1, 0)), np.array([np.log(prior / (1 - prior))]))
    if not n[0] or not n[1]:
        return flat

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in in_groups(frames):
            owner, word = words_present(rows["text"].tolist())
            uniq, code = np.unique(word, return_inverse=True)
            p = np.bincount(code, weights=rows["p"].to_numpy()[owner], minlength=len(uniq)).astype(np.int64)
            yield pd.DataFrame({"word": uniq.view(np.int64), "np": p, "nu": np.bincount(code, minlength=len(uniq)) - p})

    counts = both.mapInPandas(count, "word long, np long, nu long").groupBy("word").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
    share = (F.col("np") + F.col("nu") + 1) / (n[0] + n[1] + 2)
    z = (F.col("np") / n[1] - F.col("nu") / n[0]) / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    # Unlabelled texts hold the positives, too: what is left of a word's share without them is the negatives'.
    negatives = F.greatest((F.col("nu") / n[0] - prior * F.col("np") / n[1]) / (1 - prior), F.lit(0.0))
    lifted = F.col("np") / n[1] >= min_lift * negatives
    found = counts.where((F.col("np") >= 3) & lifted).withColumn("z", z).where(F.col("z") >= min_z).orderBy(F.desc("z"), "word").limit(MAX_WORDS).select("word").collect()
    vocabulary = np.sort(np.array([r["word"] for r in found], dtype=np.int64).view(np.uint64))
    if not len(vocabulary):
        return flat

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in in_groups(frames):
            owner, word = words_present(rows["text"].tolist(), vocabulary)
            parts = np.split(word, np.searchsorted(owner, np.arange(1, len(rows))))
            yield pd.DataFrame({"p": rows["p"].to_numpy(), "words": [x.tolist() for x in parts]})

    seen = both.mapInPandas(look_up, "p int, words array<int>").toPandas()
    by = {k: sorted((np.asarray(x, dtype=np.int64) for x in seen["words"][seen["p"] == k]), key=lambda x: (len(x), x.tolist())) for k in (0, 1)}
    fitted = [fit_nnpu(by[1], by[0], len(vocabulary), prior, seed) for seed in range(classifiers)]
    return Model(vocabulary, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, seed: int = 11
) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (score >= 0.5).

    Labels (doc_id, toxic) are learnt outside the held-out fold only: rows whose crc32(doc_id) mod ``folds`` is
    ``held_out``. Confirmed examples are texts labelled 1 (of several labels of an id, the largest), unlabelled ones any
    texts outside the fold, labels not looked at; both are seeded samples of at most the given numbers of rows of different
    id or text (equal rows are learnt once). The class prior
    is the share of 1 among labels outside the fold. Null text is empty, null ids are scored but never learnt from, and
    every row gives one row. With no labels the score is the smallest prior.
    """
    text_batches(docs.sparkSession)
    fold = F.pmod(crc32_of("doc_id"), F.lit(folds)) == held_out
    rows = docs.select(F.col("doc_id"), text_of().alias("text"), fold.alias("held_out"))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~fold)
    prior = marks.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    known = rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()).withColumn("digest", F.xxhash64("text"))
    confirmed = bounded_sample(marks.where("toxic = 1"), max_positive, seed, "doc_id")
    confirmed = known.join(F.broadcast(confirmed), "doc_id", "left_semi")  # at most max_positive ids, of any number of rows

    def sampled(part: DataFrame, limit: int) -> DataFrame:
        keys = materialize(bounded_sample(part, limit, seed, "doc_id", "digest"), "toxicity-sample")
        return known.join(F.broadcast(keys), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])  # at most limit keys

    positive, unlabelled = sampled(confirmed, max_positive), sampled(known, max_unlabelled)
    model = fit(positive, unlabelled, prior)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in in_groups(frames):
            s = model.scores(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "held_out": f["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")
