"""Best-fit packing of token pieces into fixed-length sequences.

Pieces are packed by length only: the length histogram has at most ``capacity`` entries however many documents
there are. A covering linear program over configurations (multisets of lengths that fit a sequence) is solved on it
by multiplicative weights, priced by knapsack dynamic programming, and rounded; pieces then look up their place by
their rank among the pieces of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_ids, in_groups, materialize, text_batches, text_of
from .tokens import encoder

CAPACITY = 4096


def best_values(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best weight for every capacity and the item taken last (-1: none, one unit is left).

    ``lengths`` ascend.
    """
    best = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gain = best[c - lengths[: fits[c]]] + weights[: fits[c]]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], item[c] = gain[k], k
    return best, item


def unwind(item: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration behind a capacity: item index to number of times."""
    out: dict[int, int] = {}
    while capacity > 0:
        k = int(item[capacity])
        if k < 0:
            capacity -= 1
        else:
            out[k] = out.get(k, 0) + 1
            capacity -= int(lengths[k])
    return out


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float = 0.5, rounds: int = 120, per_round: int = 48) -> list[tuple[dict[int, int], float]]:
    """Fractional cover of ``counts`` by configurations: ``[(configuration, amount)]``.

    Each length has a weight, at first its share of a sequence. A round prices by one dynamic program, then takes the
    configurations of greatest weight that start with different lengths. Each is used until ``step`` of the scarcest
    of its lengths is covered, and the weights of its lengths fall by ``exp(-step * covered share)``. Lengths that are
    covered leave the program.
    """
    log_weight = np.zeros(len(lengths))
    left = counts.astype(float)
    out: list[tuple[dict[int, int], float]] = []
    for _ in range(rounds):
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            break
        own = lengths[open_]
        weights = own / capacity * np.exp(log_weight[open_])
        best, item = best_values(weights, own, capacity)
        value = weights + best[capacity - own]
        for first in np.argsort(-value, kind="stable")[:per_round].tolist():
            config = unwind(item, own, capacity - int(own[first]))
            config[first] = config.get(first, 0) + 1
            taken = {int(open_[k]): a for k, a in config.items()}
            amount = min(left[k] / a for k, a in taken.items())
            if amount <= 1e-9:
                continue
            scarce = min(counts[k] / a for k, a in taken.items())
            amount = min(amount, max(step * scarce, 1.0))
            for k, a in taken.items():
                left[k] -= amount * a
                log_weight[k] -= step * amount * a / counts[k]
            out.append((taken, amount))
    return out


@dataclass
class Plan:
    """Groups of equal sequences: per length, which ranks go to which sequence and offset."""

    capacity: int
    n_sequences: int = 0
    by_length: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)

    def add(self, config: dict[int, int], copies: int) -> None:
        """``copies`` sequences that each hold ``config`` (length to times)."""
        offset = 0
        for length in sorted(config, reverse=True):
            rank = self.used.get(length, 0)
            self.by_length.setdefault(length, []).append((rank, self.n_sequences, config[length], offset))
            self.used[length] = rank + copies * config[length]
            offset += length * config[length]
        self.n_sequences += copies

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted keys ``length << 40 | first rank`` and, beside them, sequence, times and offset."""
        rows = sorted(((n << 40) | r, r, s, a, o) for n, entries in self.by_length.items() for r, s, a, o in entries)
        return tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.empty(0, dtype=np.int64) for _ in range(5))


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram; sequences of equal content are kept as one group with a number of copies."""
    space: dict[int, list[list]] = {}
    done: list[tuple[dict[int, int], int]] = []

    def put(config: dict[int, int], copies: int, room: int) -> None:
        if copies:
            (done.append((config, copies)) if room == 0 else space.setdefault(room, []).append([config, copies]))

    for i in np.argsort(-lengths, kind="stable").tolist():
        length, n = int(lengths[i]), int(counts[i])
        for room in sorted(r for r in space if r >= length):
            at = room
            while n and space.get(at):
                config, copies = space[at].pop()
                each = min(at // length, n)
                use = min(copies, n // each)
                put(config, copies - use, at)
                n -= use * each
                put({**config, length: config.get(length, 0) + each}, use, at - each * length)
                if at - each * length >= length and n:  # fewer were left than fit
                    break
            if not space.get(at, True):
                del space[at]
            if not n:
                break
        each = capacity // length
        put({length: each}, n // each, capacity - each * length)
        if n % each:
            put({length: n % each}, 1, capacity - (n % each) * length)
    return done + [(config, copies) for groups in space.values() for config, copies in groups]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan for all pieces of ``histogram`` (length to count; lengths from 1 to ``capacity``).

    Rounding: configurations by falling amount, each as often as its amount rounded up and what is left allow; the
    pieces that remain go by best fit, longest first. That also packs small inputs, where amounts are below one. Amounts
    below a limit are left to the best fit instead; the limit that needs the fewest sequences is kept.
    """
    lengths = np.array(sorted(n for n in histogram if n < capacity and histogram[n]), dtype=np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.int64)
    solved = sorted(solve_configurations(lengths, counts, capacity), key=lambda x: -x[1]) if len(lengths) else []
    return min((_rounded(histogram, lengths, counts, solved, capacity, limit) for limit in (0.0, 1.0, 8.0, np.inf)), key=lambda p: p.n_sequences)


def _rounded(histogram: dict[int, int], lengths: np.ndarray, counts: np.ndarray, solved: list, capacity: int, limit: float) -> Plan:
    """Plan from fractional amounts; those below ``limit`` are not rounded up to sequences."""
    plan = Plan(capacity)
    if histogram.get(capacity):
        plan.add({capacity: 1}, histogram[capacity])
    left = counts.copy()
    for config, amount in solved:
        copies = min(int(np.ceil(amount)), *(int(left[k] // a) for k, a in config.items())) if amount >= limit else 0
        if copies > 0 and sum(int(lengths[k]) * a for k, a in config.items()) >= capacity - capacity // 512:
            for k, a in config.items():
                left[k] -= copies * a
            plan.add({int(lengths[k]): a for k, a in config.items()}, copies)
    some = left > 0
    for config, copies in best_fit(lengths[some], left[some], capacity):
        plan.add(config, copies)
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and the batch and its rank by length in it."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, batch = encoder(tokenizer), TaskContext.get().partitionId() << 32
        for rows in in_groups(frames, chars=500_000):
            out = []
            for at, ids in enumerate(tokens.encode_each(rows["text"].tolist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((at, piece, start, len(part), crc32_ids(part.tobytes())))
            frame = pd.DataFrame(out, columns=["at", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = rows["doc_id"].astype("Int64").to_numpy()[frame.pop("at").to_numpy()]
            frame["batch"] = batch
            frame["rank"] = frame.groupby("length").cumcount()
            yield frame
            batch += 1

    text_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, batch long, rank long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(cut, schema)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written ``pieces`` (length, batch, rank: from 0 in each batch and length)."""
    counts = pieces.groupBy("length", "batch").agg(F.count("*").alias("n"))
    plan = pack_histogram({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    keys, first, sequence, times, offset = plan.arrays()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("batch")) - F.col("n")
    ranked = pieces.join(counts.select("length", "batch", before.alias("before")), ["length", "batch"])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), (f["before"] + f["rank"]).to_numpy()
            k = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            nth = rank - first[k]
            f["sequence_id"] = sequence[k] + nth // times[k]
            f["offset"] = offset[k] + nth % times[k] * length
            yield f[[*names, "sequence_id", "offset"]]

    names = [c for c in pieces.columns if c not in ("batch", "rank")]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank", "before").mapInPandas(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pack all ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty (one piece, the end id); documents longer than ``capacity`` are cut into pieces of it, the last
    one may be shorter. Null and repeated ids are packed as rows of their own; an empty table gives no rows. Only the
    histogram (at most ``capacity`` rows) reaches the driver; the plan's size depends on it, not on the number of rows.
    A special token's text is its id, as in the tokenizer as loaded.
    """
    return place_pieces(materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
