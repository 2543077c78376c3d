"""Ranked lexical search by best-first document intervals over range-maximum tables.

Texts are turned into blocks of posting lists of the terms that are asked for. In a block, every posting list has a sparse
table of where the largest impact of any range lies. A query starts with the whole block as one interval; the bound of an
interval is the sum of its terms' range maxima. The intervals of highest bound are split at the document of the largest
impact inside, that document is scored, and both rests get their own bounds, until no bound reaches the k-th best score.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Documents and postings of a block, whichever is reached first.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
#: Bytes of item texts whose terms are searched for in one pass; more items take more passes.
ITEM_BYTES = 8 << 20
#: Intervals split at once.
WIDTH = 64

_FOLD = bytearray(range(256))
for _c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
    _FOLD[_c] = 0x20
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32
_FOLD = bytes(_FOLD)


def terms_of(text: str) -> list[bytes]:
    """Terms in order, as UTF-8; every byte of a character beyond U+007F belongs to a term."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Block:
    """Posting lists of up to ``BLOCK_DOCS`` documents, one after another by term, each in order of document."""

    ids: np.ndarray
    known: np.ndarray  # False where the id is null
    sizes: np.ndarray  # terms of each document
    terms: np.ndarray  # terms with postings, ascending
    begins: np.ndarray  # where each one's list begins, and the end
    docs: np.ndarray
    tf: np.ndarray

    @classmethod
    def build(cls, ids: list[tuple[int, bool]], sizes: list[int], owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Block:
        # Documents in order of length: neighbours have similar impacts, so range maxima stay close to them.
        order = np.argsort(np.array(sizes, dtype=np.int64), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        owner = place[owner]
        by = np.lexsort((owner, term))
        terms, first = np.unique(term[by], return_index=True)
        begins = np.append(first, len(by))
        known = np.array([k for _, k in ids], dtype=bool)[order]
        return cls(np.array([i for i, _ in ids], dtype=np.int64)[order], known, np.array(sizes, dtype=np.int64)[order], terms, begins, owner[by].astype(np.int32), tf[by].astype(np.int32))

    def ready(self, weights: np.ndarray, n: int, total: int) -> Searcher:
        """The block with impacts and range-maximum tables for the weights of all terms."""
        m = 50 + (50 * self.sizes * n) // total
        tf = self.tf.astype(np.int64)
        weight = np.repeat(weights[self.terms], np.diff(self.begins))
        return Searcher(self, weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs])))


class Searcher:
    """Impacts of a block's postings and, per power of two, where the largest impact of each range of that length lies."""

    def __init__(self, block: Block, impact: np.ndarray):
        self.block, self.impact = block, impact
        longest = int(np.diff(block.begins).max()) if len(block.terms) else 1
        self.table = [np.arange(len(impact), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            right = np.concatenate((last[half:], last[-half:]))
            self.table.append(np.where(impact[last] >= impact[right], last, right))
        self.table = np.stack(self.table)
        # One ascending number per posting: which list, then which document.
        lists = np.repeat(np.arange(len(block.terms), dtype=np.int64), np.diff(block.begins))
        self.keys = lists * len(block.ids) + block.docs

    def largest(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact of each range of postings and where it lies; 0 for an empty range."""
        length = end - begin
        some = length > 0
        level = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
        a = self.table[level, np.where(some, begin, 0)]
        b = self.table[level, np.where(some, end - (1 << level), 0)]
        x, y = self.impact[a], self.impact[b]
        return np.where(some, np.maximum(x, y), 0), np.where(x >= y, a, b)

    def top(self, terms: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best documents (all ties of the last one) with scores of at least ``floor``: documents, scores, how many were scored."""
        n = len(self.block.ids)
        at = np.searchsorted(self.block.terms, terms)
        lists = at[(at < len(self.block.terms)) & (self.block.terms[np.minimum(at, max(0, len(self.block.terms) - 1))] == terms)] if len(self.block.terms) else at[:0]
        found: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        best = np.zeros(0, dtype=np.int64)
        begin, end = self.block.begins[lists][None, :], self.block.begins[lists + 1][None, :]
        bound, split = self._bounds(begin, end)
        scored = 0
        while True:
            open_ = bound >= floor
            if not open_.all():
                begin, end, bound, split = begin[open_], end[open_], bound[open_], split[open_]
            if not len(bound):
                break
            if len(bound) > WIDTH:
                take = np.zeros(len(bound), dtype=bool)
                take[np.argpartition(bound, len(bound) - WIDTH)[len(bound) - WIDTH :]] = True
            else:
                take = np.ones(len(bound), dtype=bool)
            b, e, doc = begin[take], end[take], split[take]
            place = np.searchsorted(self.keys, lists[None, :] * n + doc[:, None])
            held = (place < e) & (self.block.docs[np.minimum(place, len(self.keys) - 1)] == doc[:, None])
            score = np.where(held, self.impact[np.minimum(place, len(self.keys) - 1)], 0).sum(axis=1)
            scored += len(doc)
            good = score >= floor
            found.append(doc[good])
            scores.append(score[good])
            best = np.concatenate((best, score[good]))
            if len(best) > k:
                best = np.partition(best, len(best) - k)[len(best) - k :]
            if len(best) == k:
                floor = max(floor, int(best.min()))
            halves_b, halves_e = np.concatenate((b, place + held)), np.concatenate((place, e))
            more, where = self._bounds(halves_b, halves_e)
            keep = more >= floor
            rest = ~take
            begin, end = np.concatenate((begin[rest], halves_b[keep])), np.concatenate((end[rest], halves_e[keep]))
            bound, split = np.concatenate((bound[rest], more[keep])), np.concatenate((split[rest], where[keep]))
        docs = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        score = np.concatenate(scores) if scores else np.empty(0, dtype=np.int64)
        good = score >= floor
        return docs[good], score[good], scored

    def _bounds(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval and the document of its largest single impact."""
        if not begin.shape[1]:
            return np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        impact, at = self.largest(begin, end)
        widest = impact.argmax(axis=1)
        return impact.sum(axis=1), self.block.docs[at[np.arange(len(at)), widest]].astype(np.int64)


def build_index(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Blocks over all rows of ``docs`` (id, known, text) for the given terms: n_docs and n_terms (of all texts), terms, df, payload.

    Rows stay in the partition they were read from.
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = terms.get
        ids: list[tuple[int, bool]] = []
        sizes: list[int] = []
        counts: list[Counter] = []
        seen = [0, 0, 0]  # documents, terms, postings

        def flush() -> pd.DataFrame:
            owner = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            term = np.fromiter((t for c in counts for t in c), dtype=np.int32, count=seen[2])
            tf = np.fromiter((n for c in counts for n in c.values()), dtype=np.int64, count=seen[2])
            block = Block.build(ids, sizes, owner, term, tf)
            row = (seen[0], seen[1], block.terms.tolist(), np.diff(block.begins).tolist(), pickle.dumps(block, protocol=5) if ids else None)
            for x in (ids, sizes, counts):
                x.clear()
            seen[:] = 0, 0, 0
            return pd.DataFrame([row], columns=["n_docs", "n_terms", "terms", "df", "payload"])

        for f in frames:
            for i, known, text in zip(f["id"].tolist(), f["known"].tolist(), f["text"], strict=True):
                words = terms_of(text)
                if not words:
                    continue
                seen[0] += 1
                seen[1] += len(words)
                hits = Counter(map(get, words))
                hits.pop(None, None)
                if hits:
                    ids.append((i, known))
                    sizes.append(len(words))
                    counts.append(hits)
                    seen[2] += len(hits)
                    if len(ids) >= BLOCK_DOCS or seen[2] >= BLOCK_POSTINGS:
                        yield flush()
        if seen[0]:
            yield flush()

    return docs.mapInPandas(build, "n_docs long, n_terms long, terms array<int>, df array<long>, payload binary")


def _search_group(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """Best documents of a bounded group of items: (item, id, score); at most a few more than ``k`` per item and task."""
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    index = materialize(build_index(docs, vocabulary), "ranked")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).groupBy(F.col("e.terms").alias("t")).agg(F.sum("e.df").alias("df"))
    for t, count in pairs.collect():  # one row per term of this group of items
        df[t] = count
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    asked = [(i, np.array(sorted({vocabulary[t] for t in terms}), dtype=np.int32)) for i, terms in items]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for f in frames:
            for payload in f["payload"]:
                searcher = pickle.loads(payload).ready(weights, n, total)
                for item, terms in asked:
                    have = best.get(item)
                    floor = int(have[0].min()) if have is not None and len(have[0]) >= k else 1
                    doc, score, _ = searcher.top(terms, k, floor)
                    if not len(doc):
                        continue
                    rows = score, searcher.block.known[doc], searcher.block.ids[doc]
                    if have is not None:
                        rows = tuple(np.concatenate(x) for x in zip(have, rows, strict=True))
                    keep = np.lexsort((rows[2], rows[1], -rows[0]))[:k]
                    best[item] = tuple(x[keep] for x in rows)
        for item, (score, known, ids) in best.items():
            yield pd.DataFrame({"item": item, "id": ids, "known": known, "score": score})

    found = index.where("payload IS NOT NULL").select("payload").mapInPandas(search, "item long, id long, known boolean, score long")
    return found.select("item", F.when(F.col("known"), F.col("id")).alias("id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of letters and digits and of characters beyond U+007F, only A-Z lower-cased; scores are integers, those above 0
    count, equal ones go by ascending doc_id (null first). Null and empty texts have no terms: such documents are in no count and
    no result, such items have no rows. Rows that repeat a doc_id are documents of their own and can fill several ranks; rows that
    repeat an item_id are one item of all their terms (null is an item_id, too). Texts are read whole; other columns are not read;
    an empty table gives no rows.

    Items are taken in groups of about ``ITEM_BYTES`` of text, each against all documents; what a task holds of a group is so
    bounded. A block meets every item of its group once, and a task starts each block from the scores it has already found.
    """
    texts = docs.where(docs["text"].isNotNull()).select(F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"), docs["doc_id"].isNotNull().alias("known"), docs["text"].cast("string").alias("text"))
    asked = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-size // ITEM_BYTES))
    found = None
    for g in range(groups):
        rows: dict[int | None, set[bytes]] = {}
        for item_id, text in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toLocalIterator():
            rows.setdefault(item_id, set()).update(terms_of(text))
        names = list(rows)
        part = _search_group(texts, [(i, list(rows[x])) for i, x in enumerate(names)], k)
        named = docs.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", T.LongType())]))
        part = part.join(named, "item").select("item", "item_id", "id", "score")
        found = part if found is None else found.union(part.withColumn("item", F.col("item") + F.lit(g << 40)))
    # Tasks' candidates meet in two steps, so that no item gathers those of all tasks in one place.
    order = [F.desc("score"), F.asc_nulls_first("id")]
    few = found.withColumn("_s", F.pmod(F.xxhash64("id", "score"), F.lit(64)))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_s").orderBy(*order))).where(F.col("_r") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    ranked = few.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
