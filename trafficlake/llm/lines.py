"""Repeated runs of lines, by winnowing over line hashes.

A stretch is the shortest run of whole lines from a line on with at least ``stretch_words`` words. In every window (the
shortest run from a line on with at least ``window_words`` words) the stretch with the smallest hash is a fingerprint,
so any run of lines with that many words that stands in two places shares one. A fingerprint's later places are
joined with its first place, and also with the first place of each window around them: where the fingerprint's first place
stands alone, that of the window holds the rest. The match is extended line by line both ways, and the later run goes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_groups, materialize, text_batches, text_of

STRETCH_WORDS = 25
WINDOW_WORDS = 50
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split_lines(text: str) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """All lines; of those with words their places, 64-bit hashes (without white space around) and numbers of words."""
    lines = text.split("\n")
    places, hashes, words = [], [], []
    for i, line in enumerate(lines):
        line = line.strip(" \t\r\v\f")
        if line:
            places.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))
            words.append(len(_WORD.findall(line)))
    return lines, places, np.array(hashes, dtype=np.uint64).view(np.int64), np.array(words, dtype=np.int64)


def fingerprints(hashes: np.ndarray, words: np.ndarray, stretch_words: int, window_words: int) -> list[tuple[int, bytes, list[int]]]:
    """(first line, 128-bit hash, 64-bit hashes of windows) of each window's smallest stretch, the first of equals.

    The windows are those the stretch is the smallest of and the shortest runs up to a line with at least
    ``window_words`` words that begin with such a window: every line of a run with that many words is in one of either
    kind inside the run. A text with less than ``window_words`` words is one window, whose hash is not taken.
    """
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(hashes)
    stop = np.searchsorted(total, total[:-1] + stretch_words)  # lines [i, stop) are the stretch at i; n + 1: none
    count = int((stop <= n).sum())
    if not count:
        return []
    raw = hashes.tobytes()
    prints = [xxhash.xxh3_128_digest(raw[8 * i : 8 * e]) for i, e in enumerate(stop[:count].tolist())]
    window = np.searchsorted(total, total[:-1] + window_words)
    # Runs [i, e) by their first line: the window at i and the longer ones that are the shortest up to a line.
    back = np.searchsorted(total, total[1:] - window_words, side="right") - 1
    ends: dict[int, list[int]] = {}
    for e, i in enumerate(back.tolist(), 1):
        if i >= 0 and window[i] < e:
            ends.setdefault(i, []).append(e)
    chosen: dict[int, list[int]] = {}
    best = -1
    for i in range(max(1, int((window <= n).sum()))):
        # Stretches inside the window end no later than it does.
        last = int(np.searchsorted(stop[:count], min(int(window[i]), n), side="right")) - 1
        if best < i:
            best = min(range(i, last + 1), key=lambda s: (prints[s], s))
        else:
            for s in range(previous + 1, last + 1):
                if prints[s] < prints[best]:
                    best = s
        previous = last
        hashed = chosen.setdefault(best, [])
        if window[i] <= n:
            hashed += [xxhash.xxh3_64_intdigest(raw[8 * i : 8 * e]) for e in (int(window[i]), *ends.get(i, ()))]
    return [(at, prints[at], hashed) for at, hashed in chosen.items()]


def extend(own: np.ndarray, first: np.ndarray, shift: int, places: list[int]) -> list[tuple[int, int]]:
    """Runs [a, b) of ``own`` around the places in which own[i] equals first[i - shift]."""
    lo, hi = max(0, shift), min(len(own), len(first) + shift)
    equal = np.zeros(len(own) + 1, dtype=bool)
    equal[lo:hi] = own[lo:hi] == first[lo - shift : hi - shift]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal)).astype(np.int8)))
    a, b = edges[::2], edges[1::2]
    return [(int(a[k]), int(b[k])) for k in np.unique(np.searchsorted(a, places, side="right") - 1)]


def remove_repeated_lines(docs: DataFrame, stretch_words: int = STRETCH_WORDS, window_words: int = WINDOW_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Delete later copies of runs of lines from ``docs`` (doc_id, text).

    Per row: doc_id, n_lines, n_removed, n_runs (maximal removed runs, white lines between them not counted),
    kept_sha256 (of the text that stays), ``text`` (that text) and the columns named by ``keep``. Places are ordered by
    doc_id (null last), rows of one id in any fixed order, then line. A later place of a fingerprint goes with the lines
    around it that equal those around its first place or around the first place of a window it is the fingerprint of; every
    removed line stands earlier somewhere. Every window that also stands earlier goes whole, and so does every
    longer run. What has less than ``stretch_words`` words stays. Lines without words are not counted as lines, match
    nothing and stay, except for those next to a removed line after it. Null text is empty; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    own = [k for k in keep if k not in ("doc_id", "text")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        pack = zstandard.ZstdCompressor(level=1)
        for f in in_groups(frames):
            out = f[["doc_id", *own]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["row"] = np.arange(row, row + len(f))
            row += len(f)
            packed, hashes, prints = [], [], []
            for text in f["text"]:
                _, _, h, words = split_lines(text)
                packed.append(pack.compress(text.encode("utf-8", "surrogatepass")))
                hashes.append(h)
                found = fingerprints(h, words, stretch_words, window_words)
                prints.append([{"at": at, "f": digest, "w": np.array(w, dtype=np.uint64).view(np.int64)} for at, digest, w in found])
            out["packed"], out["lines"], out["prints"] = packed, hashes, prints
            yield out

    extra = "".join(f"`{k}` {kinds[k]}, " for k in own)
    schema = f"doc_id long, {extra}row long, packed binary, lines array<long>, prints array<struct<at:int,f:binary,w:array<bigint>>>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *own)
    rows = materialize(texts.mapInPandas(measure, schema), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("p.at").alias("at"))
    places = rows.select("doc_id", "row", F.explode("prints").alias("p")).select("row", F.col("p.f").alias("f"), F.col("p.at").alias("at"), F.col("p.w").alias("w"), order.alias("o"))
    first = places.groupBy("f").agg(F.min("o").alias("first"), F.count("*").alias("k")).where("k > 1")
    shared = materialize(places.join(first.drop("k"), "f"), "places")
    windows = shared.withColumn("w", F.explode("w"))
    # Only windows that begin elsewhere than their fingerprint; the others are met by its first place.
    heads = windows.groupBy("f", "w").agg(F.min("o").alias("head"), F.count("*").alias("k"), F.min("first").alias("first"))
    heads = heads.where((F.col("k") > 1) & (F.col("head") != F.col("first"))).select("f", "w", "head")
    inner = windows.drop("first").join(heads.withColumnRenamed("head", "first"), ["f", "w"])
    later = shared.select("row", "at", "o", "first").union(inner.select("row", "at", "o", "first")).where(F.col("o") != F.col("first"))
    later = later.select("row", F.col("first.r").alias("first_row"), (F.col("at") - F.col("first.at")).alias("shift"), "at")
    diagonals = later.groupBy("row", "first_row", "shift").agg(F.collect_set("at").alias("places"))
    diagonals = materialize(diagonals, "diagonals")
    lines = rows.select("row", "lines")
    met = diagonals.join(lines.withColumnRenamed("row", "first_row").withColumnRenamed("lines", "first_lines"), "first_row").join(lines, "row")

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [extend(np.asarray(a), np.asarray(b), int(s), list(p)) for a, b, s, p in zip(f["lines"], f["first_lines"], f["shift"], f["places"], strict=True)]
            yield pd.DataFrame({"row": f["row"], "spans": [[x for ab in spans for x in ab] for spans in found]})

    spans = met.select("row", "lines", "first_lines", "shift", "places").mapInPandas(match, "row long, spans array<int>")
    spans = materialize(spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "runs")

    def delete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for f in frames:
            for part in (f.iloc[i : i + 500] for i in range(0, len(f), 500)):
                out = part[["doc_id", *own]].copy()
                out["doc_id"] = out["doc_id"].astype("Int64")
                result = [drop(unpack.decompress(p).decode("utf-8", "surrogatepass"), s) for p, s in zip(part["packed"], part["spans"], strict=True)]
                for k, name in enumerate(("n_lines", "n_removed", "n_runs", "kept_sha256", "text")):
                    out[name] = [r[k] for r in result]
                yield out

    joined = rows.select("row", "doc_id", *own, "packed").join(spans.hint("shuffle_hash"), "row", "left").drop("row")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<int>")))
    return joined.mapInPandas(delete, f"doc_id long, {extra}n_lines long, n_removed long, n_runs long, kept_sha256 string, text string")


def drop(text: str, spans: list[int]) -> tuple[int, int, int, str, str]:
    """Numbers of lines, removed lines and removed runs, the hash of what stays, and what stays."""
    lines, places, _, _ = split_lines(text)
    gone = np.zeros(len(places) + 1, dtype=bool)
    for a, b in np.asarray(spans, dtype=np.int64).reshape(-1, 2).tolist():
        gone[a:b] = True
    n = int(gone.sum())
    if n:
        after = [*places[1:], len(lines)]
        stay = np.ones(len(lines), dtype=bool)
        for i in np.flatnonzero(gone).tolist():
            stay[places[i] : after[i]] = False
        text = "\n".join(line for line, s in zip(lines, stay.tolist(), strict=True) if s)
    runs = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum())
    return len(places), n, runs, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text
