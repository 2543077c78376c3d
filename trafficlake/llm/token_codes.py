"""Token-id files as directly addressable codes.

Ids are split into chunk levels of whole bytes. Level 0 holds the lowest chunk of every id and one bit that says
whether the id goes on; level 1 holds the next chunk of those that do, and so on. A rank directory counts the set
bits before every 512th position, so any id is found without decoding others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import crc32_ids, in_groups, text_batches, text_of
from .tokens import encoder

MAGIC = b"DACTOK1\0"
_HEAD = struct.Struct("<8sqqqqB7x")
_BLOCK = 512


class Level:
    """Chunks of one level, the bits of those ids that continue, and set bits before every block."""

    def __init__(self, chunks: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.chunks, self.words, self.ranks = chunks, words, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, goes_on: np.ndarray) -> Level:
        bits = np.zeros(-(-len(goes_on) // _BLOCK) * _BLOCK, dtype=bool)
        bits[: len(goes_on)] = goes_on
        words = np.packbits(bits, bitorder="little").view("<u8")
        per_block = np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.int64)
        return cls(chunks, words, np.concatenate(([0], np.cumsum(per_block))).astype("<u4"))

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, word = i // _BLOCK, i >> 6
        out = self.ranks[block].astype(np.int64)
        for k in range(_BLOCK // 64):
            w = np.minimum(block * (_BLOCK // 64) + k, len(self.words) - 1)
            out += np.where(block * (_BLOCK // 64) + k < word, np.bitwise_count(self.words[w]), 0)
        part = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.where(i & 63 > 0, np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & part), 0)


class TokenFile:
    """One file: documents in order and their ids, read in place from its bytes."""

    def __init__(self, part: int, seq: int, doc_ids: np.ndarray, is_null: np.ndarray, ends: np.ndarray, levels: list[Level], widths: list[int]):
        self.part, self.seq, self.doc_ids, self.is_null, self.ends, self.levels, self.widths = part, seq, doc_ids, is_null, ends, levels, widths

    @classmethod
    def encode(cls, part: int, seq: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, widths: tuple[int, ...]) -> TokenFile:
        """``widths``: bytes of a chunk by level; the last level must hold what is left of any id."""
        rest, levels = ids.astype("<u8"), []
        for k, width in enumerate(widths):
            chunk = (rest & np.uint64((1 << 8 * width) - 1)).astype(f"<u{width}")
            rest = rest >> np.uint64(8 * width)
            goes_on = rest > 0
            if k == len(widths) - 1 and goes_on.any():
                raise ValueError(f"an id needs more than {8 * sum(widths)} bits")
            levels.append(Level.of(chunk, goes_on))
            rest = rest[goes_on]
        null = np.array([d is None for d in doc_ids], dtype=np.uint8)
        numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
        return cls(part, seq, numbers, null, np.cumsum(lengths, dtype="<i8"), levels, list(widths))

    def to_bytes(self) -> bytes:
        out = [_HEAD.pack(MAGIC, self.part, self.seq, len(self.ends), len(self.levels[0].chunks), len(self.levels))]
        out += [self.doc_ids.tobytes(), self.is_null.tobytes(), self.ends.astype("<i8").tobytes()]
        for width, level in zip(self.widths, self.levels, strict=True):
            out += [struct.pack("<qq", width, len(level.chunks)), level.chunks.tobytes(), level.words.tobytes(), level.ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenFile:
        magic, part, seq, docs, _, n_levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        doc_ids, null, ends = take("<i8", docs), take("u1", docs), take("<i8", docs)
        levels, widths = [], []
        for _ in range(n_levels):
            width, n = take("<i8", 2).tolist()
            blocks = -(-n // _BLOCK)
            levels.append(Level(take(f"<u{width}", n), take("<u8", blocks * (_BLOCK // 64)), take("<u4", blocks + 1)))
            widths.append(width)
        return cls(part, seq, doc_ids, null, ends, levels, widths)

    def __len__(self) -> int:
        return len(self.levels[0].chunks)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at any positions."""
        at = np.asarray(at, dtype=np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self)):
            raise IndexError("position outside the file")
        out, shift, which = np.zeros(len(at), dtype=np.uint64), 0, np.arange(len(at))
        for level, width in zip(self.levels, self.widths, strict=True):
            if not len(at):
                break
            out[which] |= level.chunks[at].astype(np.uint64) << np.uint64(shift)
            shift += 8 * width
            on = level.bit(at)
            which, at = which[on], level.rank(at[on])
        return out.astype("<u4")

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids of ``[start, stop)``: on each level they are neighbours, so two ranks find the next level's part."""
        out, shift, which = np.zeros(stop - start, dtype=np.uint64), 0, np.arange(stop - start)
        for level, width in zip(self.levels, self.widths, strict=True):
            if start >= stop:
                break
            out[which] |= level.chunks[start:stop].astype(np.uint64) << np.uint64(shift)
            shift += 8 * width
            bits = np.unpackbits(level.words[start >> 6 : (stop + 63) >> 6].view(np.uint8), bitorder="little")[start & 63 :][: stop - start]
            which = which[bits.astype(bool)]
            start = int(level.rank(np.array([start]))[0])
            stop = start + len(which)
        return out.astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, place of the first token in this file, and token ids of each document."""
        begin, ids = 0, self.span(0, len(self))
        for number, null, end in zip(self.doc_ids.tolist(), self.is_null.tolist(), self.ends.tolist(), strict=True):
            yield None if null else number, begin, ids[begin:end]
            begin = end


def _store(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, widths: tuple[int, ...] = (1, 1, 2), tokens_per_file: int = 2_000_000
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending ``doc_id`` order to token files in ``folder``; the files' table.

    Texts are dealt out by ranges of ``doc_id`` and each task writes its own files, so nothing passes through one
    place. A file is written under a name of its attempt and then moved to its own name; a repeated task writes the
    same bytes again. Null text is empty, null ids come first, rows of equal id are ordered by text, and a document
    is never cut: one longer than ``tokens_per_file`` has a file alone. ``folder`` must be shared by all executors.
    A special token's text is its id, as in the tokenizer as loaded.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        part, attempt, seq = task.partitionId(), task.taskAttemptId(), 0
        store, base = _store(folder)
        tokens = encoder(tokenizer)
        names, lengths, held, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal names, lengths, held, size, seq
            data = TokenFile.encode(part, seq, names, np.array(lengths, dtype=np.int64), np.concatenate(held), widths).to_bytes()
            name = f"part-{part:06d}-{seq:06d}.dac"
            with store.open_output_stream(f"{base}/_{attempt}-{name}") as f:
                f.write(data)
            store.move(f"{base}/_{attempt}-{name}", f"{base}/{name}")
            row = pd.DataFrame({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(names)], "n_tokens": [size], "n_bytes": [len(data)]})
            names, lengths, held, size, seq = [], [], [], 0, seq + 1
            return row

        store.create_dir(base, recursive=True)
        for rows in in_groups(frames, chars=2_500_000):
            for doc_id, null, ids in zip(rows["doc_id"], rows["no_id"], tokens.encode_each(rows["text"].tolist()), strict=True):
                if size and size + len(ids) + 1 > tokens_per_file:
                    yield flush()
                names.append(None if null else int(doc_id))
                lengths.append(len(ids) + 1)
                held += [ids, np.array([end_id], dtype="<u4")]
                size += len(ids) + 1
        if names:
            yield flush()

    spark = docs.sparkSession
    text_batches(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    )
    files = ordered.mapInPandas(encode, "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long")
    files.write.parquet(f"{folder}/_files")
    return spark.read.schema(files.schema).parquet(f"{folder}/_files")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Running totals take two steps, over parts and over the files of a part, so that no task holds all files.
    """
    files = spark.read.parquet(f"{folder}/_files")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    first = files.select("part", "seq", own.alias("own")).join(before, "part").select("part", "seq", (F.col("before") + F.col("own")).alias("first"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                f = TokenFile.from_bytes(content)
                rows = [(f.part, f.seq, d, at, len(ids), crc32_ids(ids.tobytes())) for d, at, ids in f.documents()]
                out = pd.DataFrame(rows, columns=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    contents = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder).select("content")
    docs = contents.mapInPandas(decode, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids to files in the shared folder and return what the files hold.

    An empty table gives no file and no row; repeated rows are repeated; columns beyond doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    if not write_tokens(docs, folder, tokenizer, end_id).limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder)
