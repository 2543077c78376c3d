"""Spelling variants by pivotal grams.

Bigrams of a word are ordered by how few words hold them. Of a word's rarest bigrams (its prefix) dynamic programming
chooses two that do not overlap and are rarest together (its pivots). One edit leaves one of two disjoint bigrams whole,
and of two near words the one whose prefix ends first has its pivots among the other's prefix; so near words meet
where a pivot of one equals a prefix gram of the other. The edit lies on one side of that gram, so the gram's distance
from the other end of the word, and the text up to that end, are equal. Pairs that meet are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 100_000

#: Letters a word can hold after lower-casing A-Z; there are at most ``LETTERS ** 2`` different bigrams.
_ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
LETTERS = len(_ALPHABET)
_CODE = np.zeros(0x100, dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(LETTERS)


def damaged(doc_id: object, run: str, rate: int) -> str:
    """The run, without one letter where the hash of its document and itself says so."""
    if rate and (h := zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())) % rate == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def count_words(docs: DataFrame, shortest: int = 6, rate: int = 199) -> DataFrame:
    """Words of at least ``shortest`` letters of all texts with their occurrences: (word, n).

    Occurrences are summed per document, then per task, before they are shuffled.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"word": list(held.keys()), "n": list(held.values())}).astype({"n": "int64"})
            held.clear()
            return frame

        for f in frames:
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                    if len(run) >= shortest and len(word := damaged(doc_id, run, rate)) >= shortest:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    texts = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams(word: str) -> np.ndarray:
    """Codes of the bigrams of a word in order of position."""
    code = _CODE[np.frombuffer(word.encode("latin-1"), dtype=np.uint8)]
    return code[:-1] * LETTERS + code[1:]


def pivots(cost: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Positions of the two disjoint bigrams of least total cost among those marked in ``prefix``: words x 2.

    ``cost`` and ``prefix`` are words x positions. Over positions from left to right, ``one`` is the best single bigram that
    begins two or more places before, ``two`` the best pair so far; equal totals keep the earlier ones.
    """
    m, width = cost.shape
    cost = np.where(prefix, cost, np.inf)
    one, one_at = np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    two, two_at = np.full(m, np.inf), np.zeros((m, 2), dtype=np.int64)
    for i in range(width):
        if i >= 2:
            better = cost[:, i - 2] < one
            one, one_at = np.where(better, cost[:, i - 2], one), np.where(better, i - 2, one_at)
        total = one + cost[:, i]
        better = total < two
        two = np.where(better, total, two)
        two_at[better, 0], two_at[better, 1] = one_at[better], i
    return two_at


def side_keys(word: str, at: int) -> tuple[int, int]:
    """What is left whole by an edit to the right, and to the left, of the bigram at ``at``, as 64-bit numbers."""
    raw, end = word.encode("latin-1"), len(word)
    return xxhash.xxh3_64_intdigest(raw[: at + 2], 1) - (1 << 63), xxhash.xxh3_64_intdigest(raw[at:end], 2) - (1 << 63)


def index_words(words: DataFrame) -> DataFrame:
    """Index rows of distinct ``words`` (word, n): key, length, pivot, word, n, letters (a bit per letter).

    The table of bigram frequencies has at most ``LETTERS ** 2`` rows, so every task may hold it.
    """
    pair = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2))))).alias("g")
    seen = words.select(pair).groupBy("g").count().collect()
    frequency = np.zeros(LETTERS**2)
    for g, n in seen:
        frequency[grams(g)[0]] = n
    rank = np.empty(LETTERS**2, dtype=np.int64)
    rank[np.lexsort((np.arange(LETTERS**2), frequency))] = np.arange(LETTERS**2)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for length, same in f.groupby(f["word"].str.len()):
                for begin in range(0, len(same), max(1, 1_000_000 // length)):
                    part = same.iloc[begin : begin + max(1, 1_000_000 // length)]
                    codes = np.stack([grams(w) for w in part["word"]])
                    order = rank[codes]
                    # All bigrams up to the third rarest; other places of that very bigram are in the prefix, too.
                    prefix = order <= np.partition(order, 2, axis=1)[:, 2:3]
                    chosen = pivots(frequency[codes], prefix)
                    out = []
                    for word, n, places, two in zip(part["word"], part["n"], prefix, chosen.tolist(), strict=True):
                        letters = 0
                        for c in set(word):
                            letters |= 1 << (ord(c) & 63)
                        letters -= (letters >> 63) << 64
                        out += [(key, length, False, word, n, letters) for at in np.flatnonzero(places).tolist() for key in side_keys(word, at)]
                        out += [(key, length + d, True, word, n, letters) for at in two for key in side_keys(word, at) for d in (-1, 0, 1)]
                    yield pd.DataFrame(out, columns=["key", "length", "pivot", "word", "n", "letters"])

    return words.mapInPandas(index, "key long, length int, pivot boolean, word string, n long, letters long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of distinct ``words`` (word, n; three letters at least) that differ by exactly one edit: a, n_a, b, n_b with a < b, once each."""
    index = materialize(index_words(words), "grams")
    pivot = index.where("pivot").select("key", "length", F.col("word").alias("p"), F.col("n").alias("n_p"), F.col("letters").alias("letters_p"))
    prefix = index.where("NOT pivot").select("key", "length", F.col("word").alias("q"), F.col("n").alias("n_q"), F.col("letters").alias("letters_q"))
    # One edit changes at most two letters' bits; levenshtein with a bound gives -1 beyond it.
    near = F.expr("p <> q AND bit_count(letters_p ^ letters_q) <= 2 AND levenshtein(p, q, 1) = 1")
    met = pivot.join(prefix, ["key", "length"]).where(near)
    first = F.col("p") < F.col("q")
    pair = [F.least("p", "q").alias("a"), F.when(first, F.col("n_p")).otherwise(F.col("n_q")).alias("n_a")]
    pair += [F.greatest("p", "q").alias("b"), F.when(first, F.col("n_q")).otherwise(F.col("n_p")).alias("n_b")]
    return met.select(*pair).dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the last word reached by following forms.

    Forms lead to words of larger count, so there are no rings. Each round doubles the steps taken, until none leads on.
    """
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = materialize(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def group_spellings(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, rate: int = 199) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with the spelling they are a variant of: word, n, n_near, form, form_n, root.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of at least ``shortest`` letters and ``least``
    occurrences in all texts; one in ``rate`` pairs of document and run loses a letter first (``rate=0``: none). Near words differ by
    exactly one inserted, deleted or replaced letter. ``form`` is the near word of largest ``n`` (ties: first in code-point
    order) if that is at least ``factor`` times the word's own, else null; ``root`` follows forms to the last.

    Null texts have no words; a null id counts as the empty text; repeated rows count as often as they stand; words of any length
    are compared whole; other columns are not read; no words give no rows. ``shortest`` is 4 or more (three bigrams).
    """
    if shortest < 4:
        raise ValueError("words need at least three bigrams")
    words = materialize(count_words(docs, shortest, rate).where(F.col("n") >= least), "words")
    pairs = near_pairs(words)
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_of_near"), F.col("n_a").alias("own")),
                F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_of_near"), F.col("n_b").alias("own")),
            )
        ).alias("e")
    ).select("e.*")
    best = F.min(F.struct((-F.col("n_of_near")).alias("less"), F.col("near").alias("near"))).alias("best")
    stats = both.groupBy("word").agg(F.count("*").alias("n_near"), best, F.first("own").alias("own"))
    leads = -F.col("best.less") >= factor * F.col("own")
    stats = materialize(stats.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "near")
    last = roots(stats.where("form IS NOT NULL").select("word", "form"))
    out = words.join(stats, "word", "left").join(last, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
