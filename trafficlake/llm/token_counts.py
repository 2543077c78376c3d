"""Token counts by public tokenizers: batch encoding inside Arrow functions that give lengths only.

Texts are cut at safe boundaries into pieces of bounded size and encoded in batches of about equal bytes, whatever the
number of rows they come from. Only ids of one batch exist at a time; a text's pieces add up to its count. With vocabularies
whose splitting is known (``tokens``), the library encodes a batch's distinct chunks that the worker has not met, and a text's
count is put together from theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import release_memory
from .tokens import encoder

#: Bytes of text that one encoder call takes.
BATCH_BYTES = 256 << 10
#: The same where distinct chunks are encoded; a larger batch repeats more of them.
CHUNKED_BYTES = 2 << 20
#: Bytes beyond which a text is cut.
PIECE_BYTES = 64 << 10
#: Rows turned into Python strings at once.
ROWS = 512

#: One blank between two letters or digits. Neither merges, special tokens, contractions nor combining marks reach across it.
_EDGE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_OPEN: dict[str, "Counter"] = {}


class Counter:
    """Lengths of encoded texts; opened once per worker from a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in self.library.encode(texts, num_threads=1)]
        else:
            chunked = encoder(path)
            self.library = chunked.tokenizer
            self.library.no_truncation()
            self.library.no_padding()
            self.lengths = lambda texts: [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        self.skip = self._blank_at_cuts()
        self.batch = BATCH_BYTES
        if not path.endswith(".model") and chunked.cuts:
            self.batch, self.lengths = CHUNKED_BYTES, chunked.lengths

    def _blank_at_cuts(self) -> int | None:
        """1 where the blank at a cut belongs to neither side, 0 where it opens the right one, None where cuts change counts."""
        probes = ["a b", "the quick brown 7 foxes of 1999", "É à über año 東京 9", "x" * 40 + " " + "y" * 40]
        if not self._keeps_special_apart():
            return None
        for skip in (1, 0):
            parts = [[p for p in self._cut(text, 1, skip)] for text in probes]
            if all(self.lengths([text])[0] == sum(self.lengths(p)) for text, p in zip(probes, parts, strict=True)):
                return skip
        return None

    def _keeps_special_apart(self) -> bool:
        """Whether no added token holds, or takes, the blanks around it, and no piece goes on after a blank."""
        if hasattr(self.library, "id_to_piece"):
            pieces = (self.library.id_to_piece(i).strip("▁") for i in range(self.library.get_piece_size()))
            return not any("▁" in p for p in pieces)
        added = self.library.get_added_tokens_decoder().values()
        return not any(t.lstrip or t.rstrip or " " in t.content for t in added)

    @staticmethod
    def _cut(text: str, least: int, skip: int) -> Iterator[str]:
        begin = 0
        while len(text) - begin > least and (edge := _EDGE.search(text, begin + least)):
            yield text[begin : edge.start()]
            begin = edge.start() + skip
        yield text[begin:]

    def pieces(self, text: str, n_bytes: int, most: int) -> list[str]:
        """The text in pieces of about ``most`` bytes; whole where no boundary is safe."""
        if n_bytes <= most or self.skip is None:
            return [text]
        return list(self._cut(text, max(1, most * len(text) // n_bytes), self.skip))

    def count(self, texts: list[str], sizes: list[int], batch: int | None = None, piece: int = PIECE_BYTES) -> np.ndarray:
        """Tokens of each text; an encoder call takes pieces until they hold ``batch`` bytes."""
        batch = batch or self.batch
        out = np.zeros(len(texts), dtype=np.int64)
        owners: list[int] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                np.add.at(out, owners, self.lengths(held))
            owners.clear()
            held.clear()
            size = 0

        for i, (text, n) in enumerate(zip(texts, sizes, strict=True)):
            if not n:
                continue
            parts = self.pieces(text, n, piece)
            share = n // len(parts) + 1
            for part in parts:
                owners.append(i)
                held.append(part)
                size += share
                if size >= batch:
                    flush()
        flush()
        return out


def counter(path: str) -> Counter:
    """The worker's counter of a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = Counter(path)
    return _OPEN[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``vocabulary`` is a ``.json`` file of tokenizers or a ``.model`` file of sentencepiece that every executor can read. Counts
    equal those of the library for the text in one piece, without added tokens, truncation or padding; special tokens written in
    a text count as the library's default does. A null text is empty and has no tokens; a null id and repeated rows stay as they
    are, one row each; an empty table gives no rows; other columns are not read. Texts of any length are counted whole: a long
    one is cut only where both sides encode on their own, and one without such a place is encoded in one piece.

    No shuffle: rows stay in the partition they were read from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            release_memory()
            texts = pc.fill_null(b.column("text"), "")
            sizes = pc.binary_length(texts).cast(pa.int64())
            n = counter(vocabulary).count(texts.to_pylist(), sizes.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
