"""Exact repeated byte strings across documents, from Burrows-Wheeler transforms of the places that can hold them.

Every ``length``-byte string contains an anchor: the ``GRAM``-byte gram with the smallest hash among those inside it.
Equal strings have equal anchors at equal offsets, so only anchors that occur twice matter, and the strings of one
anchor are compared with each other alone. The bytes around such anchors (a context) are gathered by anchor; each
group of contexts gets a Burrows-Wheeler transform, and threshold-bounded interval expansion derives its common
prefixes by increasing value up to ``length``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import gram_hashes, in_groups, materialize, prefix_hash, span_hash, text_batches, text_of

LENGTH = 400
GRAM = 128
#: An anchor with more bytes of contexts than this is counted string by string.
TRANSFORM_BYTES = 2 << 20
#: Bytes of contexts that anchors share a transform up to: its arrays stay in a core's cache.
SHARED_BYTES = 256 << 10
_POSITION_BITS = 31


# --- common prefixes from a transform ------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` (0: the end of a string, each end different from all others) in order of at least their
    first ``depth`` symbols.

    Keys of 8 symbols are sorted first; then groups that are still tied are sorted by the ranks of what follows, which
    triples the depth every round (doubles it, where three ranks do not fit a key).
    """
    n = len(codes)
    ends = np.flatnonzero(codes == 0)
    to_end = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)).astype(np.int32)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((codes, np.zeros(7, dtype=np.uint8))), 8)
    key = np.ascontiguousarray(wide).view(">u8").ravel().astype(np.uint64)
    near = np.flatnonzero(to_end < 8)  # what follows an end does not count
    key[near] &= ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * to_end[near].astype(np.uint64)) % np.uint64(64)) - np.uint64(1))
    key[ends] = 0
    order = np.argsort(key).astype(np.int32)
    cut = np.flatnonzero(to_end[order] < 8)  # equal keys that hold an end: in order of their place
    some = order[cut]
    order[cut] = some[np.lexsort((some, key[some]))]
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) | (to_end[order] < 8)
    slots = np.arange(n, dtype=np.int32)
    rank = np.empty(n, dtype=np.int32)
    first = np.maximum.accumulate(np.where(new, slots, 0))
    rank[order] = first
    h = 8
    bits = 21 if n <= 1 << 21 else 32
    while h < depth:
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            break
        some = order[slots]
        key = rank[some].astype(np.int64) << bits | rank[some + h]
        if bits == 21:  # what follows an end that stands before it does not count: the second rank is no other's
            key = key << bits | rank[np.minimum(some + 2 * h, n - 1)]
        h *= 3 if bits == 21 else 2
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[slots] = some
        new = np.concatenate(([True], key[1:] != key[:-1])) | (to_end[some] < h)
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[some] = first
    return order


def repeated_starts(strings: list[bytes], length: int, times: np.ndarray | None = None) -> list[np.ndarray]:
    """Per string, the places where a substring of ``length`` bytes starts that also starts elsewhere in ``strings``.

    ``times`` tells how often each string counts (default: once); one that counts twice repeats everywhere. Intervals of the transform are extended backwards breadth first: in round ``v`` the right borders that are reached
    for the first time have common prefix ``v``. After ``length`` rounds every border not reached has one of at least
    ``length``, and the suffixes on both sides of it repeat.
    """
    data = np.frombuffer(b"\0".join([*strings, b""]), dtype=np.uint8)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    used = np.zeros(256, dtype=bool)
    used[data] = True
    begins = np.concatenate(([0], ends[:-1] + 1))
    is_end = np.zeros(len(data), dtype=bool)
    is_end[ends] = True
    codes = np.cumsum(used).astype(np.uint8)[data]  # 1, 2, ... in byte order; UTF-8 never uses all 256 values
    codes[is_end] = 0
    n = len(codes)
    order = suffix_order(codes, length)
    before = codes[order - 1]  # 0 at the first symbol of a string
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    extended = np.empty(n, dtype=np.int32)  # the row of a row's suffix with the symbol before it in front
    extended[by_symbol] = np.arange(n, dtype=np.int32)
    # An end is never put in front: those rows map to the first rows, which are the ends themselves.
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    previous, following = np.full(n, -1, dtype=np.int32), np.full(n, n, dtype=np.int32)
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    counts = np.bincount(codes)
    blocks = np.concatenate(([0], np.cumsum(counts)))
    m = int(counts[0])
    left = np.concatenate((np.arange(m), blocks[1:-1][counts[1:] > 0]))
    right = np.concatenate((np.arange(1, m + 1), blocks[2:][counts[1:] > 0]))
    open_ = np.ones(n + 1, dtype=bool)  # borders whose common prefix is not known yet
    open_[[0, n]] = False
    open_[right] = False
    for _ in range(1, length):
        size = right - left
        total = np.cumsum(size)
        if not len(total):
            break
        at = np.repeat(left - (total - size), size) + np.arange(total[-1])
        real = before[at] > 0
        first = real & (previous[at] < np.repeat(left, size))
        last = real & (following[at] >= np.repeat(right, size))
        # Intervals of different strings do not overlap, so sorted left and right borders belong together.
        left, right = np.sort(extended[at[first]]), np.sort(extended[at[last]]) + 1
        fresh = open_[right]
        left, right = left[fresh], right[fresh]
        open_[right] = False
    border = np.flatnonzero(open_)
    hit = np.zeros(n, dtype=bool)
    hit[order[border - 1]] = hit[order[border]] = True
    if times is not None:  # rows of a suffix that stands for several
        for a, b in zip(begins[times > 1], ends[times > 1] - length + 1, strict=True):
            hit[a : max(a, b)] = True
    return [np.flatnonzero(hit[a:b]) for a, b in zip(begins, ends, strict=True)]


# --- anchors -------------------------------------------------------------------------------------------------------


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from running minima of blocks of ``w`` in both directions."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, dtype=v.dtype)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(blobs: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes inside each blob: blob, hash, hash of the context, its start in the
    blob and its number of strings. A context is the bytes of the neighbouring strings that share an anchor."""
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    data = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    if len(data) < length:
        return none
    ends = np.cumsum([len(b) for b in blobs])
    prefix = prefix_hash(data)
    places = np.arange(len(data) - gram + 1)
    hashes = gram_hashes(prefix, gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    best = (sliding_min((hashes & ~low) | places.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    start = np.arange(len(best))
    blob = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])[: len(start)]
    inside = start + length <= ends[blob]
    start, best, blob = start[inside], best[inside], blob[inside]
    if not len(start):
        return none
    # The same anchor can serve strings of two blobs only if it lies in both, which it cannot.
    new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (blob[1:] != blob[:-1]))))
    last = np.append(new[1:], len(start)) - 1
    lo, hi, owner = start[new], start[last], blob[new]
    where = np.uint64(0x9E3779B97F4A7C15) * (best[new] - lo).astype(np.uint64)
    context = span_hash(prefix, lo, hi + length) ^ where
    begins = np.concatenate(([0], ends[:-1]))
    return owner, hashes[best[new]].view(np.int64), context.view(np.int64), lo - begins[owner], hi - lo + 1


def runs(starts: np.ndarray) -> list[int]:
    """Neighbouring places as [first, after last, first, after last, ...]."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return np.stack((starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + 1), axis=1).ravel().tolist()


def covered(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes covered by strings whose starts are given as (first, after last) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    first, stop = spans[:, 0], np.maximum.accumulate(spans[:, 1] + length - 1)
    new = np.flatnonzero(np.append(True, first[1:] > stop[:-1]))
    return np.stack((first[new], stop[np.append(new[1:], len(first)) - 1]), axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, transform_bytes: int = TRANSFORM_BYTES, keep_text: bool = False) -> DataFrame:
    """Remove every byte of a text (UTF-8; null: empty) covered by a ``length``-byte string that also starts elsewhere.

    ``docs`` (doc_id, text) gives per row doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the
    remaining bytes put together); with ``keep_text`` also ``kept`` (those bytes) and ``spans``. All occurrences go, in the
    same row or another; strings never cross rows and are judged on the input. Texts below ``length`` bytes keep all. Null
    and repeated ids are rows like others; an empty table gives no rows.

    A text that stands in two rows goes as a whole. Equal contexts are looked at once: they enter the transform once, and
    count once there if only copies of one text hold them and twice else, since further copies add no new answer.
    """
    gram = min(GRAM, max(1, length // 3))
    text_batches(docs.sparkSession)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        pack = zstandard.ZstdCompressor(level=1)
        for f in in_groups(frames):
            blobs = [t.encode("utf-8", "surrogatepass") for t in f["text"]]
            owner, gram_hash, context, lo, k = anchors(blobs, length, gram)
            cut = np.searchsorted(owner, np.arange(1, len(blobs)))
            out = pd.DataFrame({"row": np.arange(row, row + len(blobs)), "doc_id": f["doc_id"].astype("Int64").to_numpy(), "n_bytes": [len(b) for b in blobs]})
            out["sha"] = [hashlib.sha256(b).hexdigest() for b in blobs]
            out["packed"] = [pack.compress(b) for b in blobs]
            for name, x in (("h", gram_hash), ("c", context), ("lo", lo), ("k", k)):
                out[name] = np.split(x, cut)
            row += len(blobs)
            yield out

    schema = "row long, doc_id long, n_bytes long, sha string, packed binary, h array<long>, c array<long>, lo array<int>, k array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = materialize(texts.mapInPandas(measure, schema), "anchors")
    copied = rows.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    copies = materialize(rows.select("row", "sha").join(copied, "sha").select("row"), "copies")
    text = F.xxhash64("sha").alias("t")
    each = rows.select("row", text, F.explode(F.arrays_zip("h", "c", "lo", "k")).alias("a")).select("row", "t", "a.h", "a.c", "a.lo", "a.k")
    classes = each.groupBy("h", "c").agg(F.min(F.struct("t", "lo", "row", "k")).alias("at"), F.max(F.struct("t", "lo")).alias("z"))
    once = (F.col("at.t") == F.col("z.t")) & (F.col("at.lo") == F.col("z.lo"))
    classes = materialize(classes.select("h", "c", F.when(once, 1).otherwise(2).cast("long").alias("times"), "at.row", "at.lo", "at.k"), "contexts")
    size = (F.col("k") + length).cast("long")
    groups = classes.groupBy("h").agg(F.sum("times").alias("n"), F.sum(size).alias("bytes")).where("n > 1")
    live = materialize(classes.join(groups.select("h", (F.col("bytes") > transform_bytes).alias("hot"), "bytes"), "h"), "live")
    total = live.where("NOT hot").agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-total // min(SHARED_BYTES, transform_bytes)))

    def cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, held, size = zstandard.ZstdDecompressor(), [], 0
        for f in frames:
            for packed, places in zip(f["packed"], f["places"], strict=True):
                text = unpack.decompress(packed)
                held += [(p["h"], p["c"], p["times"], text[p["lo"] : p["lo"] + p["k"] + length - 1]) for p in places]
                size += sum(p["k"] + length for p in places)
                if size > transform_bytes:
                    yield pd.DataFrame(held, columns=["h", "c", "times", "context"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["h", "c", "times", "context"])

    def extract(part: DataFrame) -> DataFrame:
        places = part.groupBy("row").agg(F.collect_list(F.struct("h", "c", "times", "lo", "k")).alias("places"))
        return rows.select("row", "packed").join(places.hint("shuffle_hash"), "row").select("packed", "places").mapInPandas(cut_out, "h long, c long, times long, context binary")

    def transform(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["h", "c"])
        out = f[["h", "c"]].copy()
        out["starts"] = [runs(x) for x in repeated_starts(list(f["context"]), length, f["times"].to_numpy())]
        return out[out["starts"].str.len() > 0]

    bucket = F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")
    marks = extract(live.where("NOT hot")).select("h", "c", "times", "context", bucket).groupBy("bucket").applyInPandas(transform, "h long, c long, starts array<int>")

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for h, c, times, context in f.itertuples(index=False):
                prefix = prefix_hash(np.frombuffer(context, dtype=np.uint8))
                at = np.arange(len(context) - length + 1)
                w = span_hash(prefix, at, at + length).view(np.int64)
                yield pd.DataFrame({"w": w, "h": h, "c": c, "times": times, "at": at})

    hot = live.where("hot")
    if hot.limit(1).count():  # the exact way for anchors with too many contexts: their strings one by one
        single = materialize(extract(hot).mapInPandas(strings, "w long, h long, c long, times long, at int"), "strings")
        twice = single.groupBy("h", "w").agg(F.sum("times").alias("n")).where("n > 1").select("h", "w")
        pairs = single.join(twice, ["h", "w"]).groupBy("h", "c").agg(F.collect_list("at").alias("at"))
        spans = F.flatten(F.transform(F.array_sort("at"), lambda x: F.array(x, x + 1)))
        marks = marks.unionByName(pairs.select("h", "c", spans.alias("starts")))
    marks = materialize(marks, "marks")

    found = each.select("row", "h", "c", "lo").join(marks, ["h", "c"]).groupBy("row").agg(F.collect_list(F.transform("starts", lambda x: x + F.col("lo"))).alias("starts"))
    found = materialize(found.join(copies, "row", "left_anti"), "starts")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for f in frames:
            out = []
            for doc_id, packed, starts in zip(f["doc_id"], f["packed"], f["starts"], strict=True):
                text = unpack.decompress(packed)
                spans = covered(np.concatenate([np.asarray(s, dtype=np.int64) for s in starts]).reshape(-1, 2), length)
                edges = np.concatenate(([0], spans.ravel(), [len(text)])).tolist()
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, spans.ravel().tolist()) if keep_text else row)
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    kinds = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    if keep_text:
        kinds |= {"kept": "binary", "spans": "array<long>"}
    names = list(kinds)

    def tail(gone: bool) -> list:
        if not keep_text:
            return []
        if gone:
            return [F.lit(b"").alias("kept"), F.array(F.lit(0), F.col("n_bytes")).cast("array<long>").alias("spans")]
        return [F.pandas_udf(_unpack, BinaryType())(F.col("packed")).alias("kept"), F.array().cast("array<long>").alias("spans")]

    cut = rows.select("row", "doc_id", "packed").join(found.hint("shuffle_hash"), "row").select("doc_id", "packed", "starts")
    cut = cut.mapInPandas(apply, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    zero, all_ = F.lit(0).cast("long"), F.col("n_bytes")
    untouched = rows.join(found.select("row").union(copies), "row", "left_anti").select("doc_id", all_, zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), *tail(False))
    whole = rows.join(copies, "row").select("doc_id", all_, all_.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), *tail(True))
    return cut.unionByName(untouched).unionByName(whole)


def _unpack(packed: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor()
    return packed.map(unpack.decompress)
