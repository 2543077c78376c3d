"""Streams over captured traffic.

Windows and de-duplication use Spark's own operators. Admission, latency and gauges keep keyed state in
``transformWithStateInPandas``; their state is one small record (or one trailing window) per key and is
dropped by timers. A gauge's moves wait in buckets of instants, which all tasks share.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain, islice
from tempfile import SpooledTemporaryFile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.cost import validate_cost_expression
from ..operators.quota import Bucket, TrailingFold, UNIT_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IN_MEMORY = "HDFSBackedStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keyed state needs the RocksDB store: replaces the in-memory default, keeps any other choice."""
    if _IN_MEMORY in spark.conf.get(_PROVIDER, _IN_MEMORY):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def stream_usage(
    stream: DataFrame, at: str, by: Sequence[str], measures: Sequence[str], window: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Usage or cost per tumbling window; windows are emitted once the watermark passes them."""
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, window), *by)
        .agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *measures, "requests")
    )


def stream_session_usage(
    stream: DataFrame, at: str, session: str, measures: Sequence[str], gap: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Usage per session id, a session ending after an inactivity gap."""
    return (
        stream.where(F.col(session).isNotNull())
        .withWatermark(at, delay)
        .groupBy(F.session_window(at, gap), session)
        .agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("requests"))
        .select(
            session, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"),
            *measures, "requests",
        )
    )


def dedupe_attempts(stream: DataFrame, at: str, key: str = "request_id", delay: str = "10 minutes") -> DataFrame:
    """One row per request id although every retry is logged again."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def _sorted_rows(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """One key's rows of one micro-batch in order (bounded by the trigger's file limit)."""
    frames = list(rows)
    return pd.concat(frames).sort_values(by, kind="stable") if len(frames) > 1 else frames[0].sort_values(by, kind="stable")


def _drop_timers(handle: StatefulProcessorHandle) -> None:
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)


_BUCKET = "_bucket"
#: Buckets of keys per shuffle partition, so that partitions hold about the same number of them.
_SHARE = 4


def _bucket_count(stream: DataFrame) -> int:
    return _SHARE * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(stream: DataFrame, keys: Sequence[str], buckets: int | None) -> DataFrame:
    """Groups of many keys share one state call per micro-batch, which costs far more than its rows.

    Without a number there are as many as the session's shuffle partitions ask for; a stream that is restarted with
    another number of partitions must name the one it began with, as a key's state lies in its bucket.
    """
    return stream.withColumn(_BUCKET, F.pmod(F.hash(*keys), F.lit(buckets or _bucket_count(stream))))


class _Blob:
    """One value of any shape per group, read and written once per micro-batch."""

    def __init__(self, handle: StatefulProcessorHandle, empty: Callable[[], object]):
        self.state, self.empty = handle.getValueState("held", "data binary"), empty

    def read(self):
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.empty()

    def write(self, value) -> None:
        if value:
            self.state.update((pickle.dumps(value, protocol=5),))
        elif self.state.exists():
            self.state.clear()


class _Pieces:
    """As :class:`_Blob`, in pieces: a state call carries a bounded number of bytes, however large the value is."""

    SIZE = 1 << 18

    def __init__(self, handle: StatefulProcessorHandle, empty: Callable[[], object]):
        self.state, self.empty = handle.getMapState("held", "piece int", "data binary"), empty

    def _stored(self) -> Iterator[bytes]:
        n = 0
        while (piece := self.state.getValue((n,))) is not None:
            yield bytes(piece[0])
            n += 1

    def read(self):
        data = b"".join(self._stored())
        return pickle.loads(data) if data else self.empty()

    def write(self, value) -> None:
        data = memoryview(pickle.dumps(value, protocol=5))
        n = -(-len(data) // self.SIZE)
        for i in range(n):
            self.state.updateValue((i,), (bytes(data[i * self.SIZE : (i + 1) * self.SIZE]),))
        while self.state.containsKey((n,)):
            self.state.removeKey((n,))
            n += 1


def _schema_of(stream: DataFrame, names: Sequence[str], ddl: str = "") -> T.StructType:
    fields = [T.StructField(n, stream.schema[n].dataType) for n in names]
    return T.StructType(fields + (T.StructType.fromDDL(ddl).fields if ddl else []))


def _plain(values) -> tuple:
    """State keys as plain Python values (NULLs read back as NaN)."""
    return tuple(None if v != v else v.item() if hasattr(v, "item") else v for v in values)


class _FixedWindow(StatefulProcessor):
    """State of a bucket: the cost used per key and open window. Windows go once the watermark has passed their end, so a
    late row draws on the window it belongs to."""

    def __init__(self, limit: int, width_us: int, keys: list[str]):
        self.limit, self.width, self.keys = limit, width_us, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = _Blob(handle, dict)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted_rows(rows, ["at_us", "request_id"])
        pdf["_w"] = pdf["at_us"] // self.width * self.width
        by = [*self.keys, "_w"]
        owner = pdf.groupby(by, dropna=False, sort=False).ngroup()
        names = [_plain(row) for row in pdf.loc[~owner.duplicated(), by].itertuples(index=False)]
        used = self.used.read()
        carried = np.array([used.get(n, 0) for n in names], dtype=np.int64)
        before = pdf.groupby(owner.to_numpy())["cost"].cumsum() - pdf["cost"] + carried[owner]
        spent = np.zeros(len(names), dtype=np.int64)
        np.add.at(spent, owner.to_numpy(), pdf["cost"].to_numpy())
        used.update(zip(names, (carried + spent).tolist()))
        self._keep(used, timerValues.getCurrentWatermarkInMs() * 1000)
        pdf["used"], pdf["refused"] = before, before >= self.limit
        yield pdf[[*self.keys, "request_id", "at_us", "used", "refused"]]

    def _keep(self, used: dict, now_us: int) -> None:
        """Write the windows that are still open and set the timer of the one that ends first."""
        used = {k: n for k, n in used.items() if k[-1] + self.width > now_us}
        self.used.write(used)
        _drop_timers(self.handle)
        if used:
            self.handle.registerTimer((min(k[-1] for k in used) + self.width) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self.used.read(), timerValues.getCurrentWatermarkInMs() * 1000)
        return iter([])

    def close(self) -> None:
        pass


class _TrailingWindow(StatefulProcessor):
    """State: the admitted requests inside the trailing window, as two parallel lists."""

    def __init__(self, limit: int, duration_s: int):
        self.bucket = Bucket("quota", limit, duration_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("admitted", "at_us long, cost long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold = TrailingFold([self.bucket], "Shared")
        known = self.state.exists()
        if known:
            for at, cost in self.state.get():
                fold.queues[0].append((at, cost))
                fold.used[0] += cost
        pdf = _sorted_rows(rows, ["at_us", "request_id"])
        out = []
        for rid, at, cost in zip(pdf["request_id"], pdf["at_us"], pdf["cost"]):
            allowed = fold.admit(int(at), int(cost), [True])
            out.append((rid, int(at), int(fold.used[0]), not allowed))
        if fold.queues[0]:
            self.state.put([(int(a), int(c)) for a, c in fold.queues[0]])
        elif known:
            self.state.clear()
        last = int(pdf["at_us"].iloc[-1])
        if known:
            _drop_timers(self.handle)
        self.handle.registerTimer((last + self.bucket.duration_s * 1_000_000) // 1000 + 1)
        yield pd.DataFrame(out, columns=["request_id", "at_us", "used", "refused"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_rate_limit(
    stream: DataFrame, keys: Sequence[str], at: str, cost: str, limit: int, unit: str | None = "Hour",
    duration_s: int | None = None, request_id: str = "request_id", delay: str = "10 minutes", buckets: int | None = None,
) -> DataFrame:
    """Fixed-window limit per key (``unit``), or a trailing one (``duration_s``), over a stream.

    Output ``(keys, request_id, at_us, used, refused)``. Rows of a key are judged in time order within
    a micro-batch, and micro-batches in arrival order. ``used`` is use before the request (fixed) or
    after it (trailing).
    """
    use_rocksdb(stream.sparkSession)
    keys = list(keys)
    rows = stream.withWatermark(at, delay).select(
        *keys, at, F.col(request_id).alias("request_id"), F.unix_micros(at).alias("at_us"),
        F.coalesce(F.col(cost), F.lit(0)).cast("bigint").alias("cost"),
    )
    result = "request_id long, at_us long, used long, refused boolean"
    if duration_s:
        grouped, processor = rows.groupBy(*keys), _Keyed(_TrailingWindow(limit, duration_s), keys)
    else:
        grouped = _bucketed(rows, keys, buckets).groupBy(_BUCKET)
        processor = _FixedWindow(limit, UNIT_SECONDS[unit] * 1_000_000, keys)
    return grouped.transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=_schema_of(stream, keys, result), outputMode="Append", timeMode="EventTime"
    )


class _Keyed(StatefulProcessor):
    """Puts the key columns in front of what the wrapped processor yields."""

    def __init__(self, inner: StatefulProcessor, keys: list[str]):
        self.inner, self.names = inner, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def _stamp(self, key, frames) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, (n, v) in enumerate(zip(self.names, key)):
                pdf.insert(i, n, v)
            yield pdf

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._stamp(key, self.inner.handleInputRows(key, rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._stamp(key, self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def close(self) -> None:
        self.inner.close()


class _Latency(StatefulProcessor):
    """State of a bucket: per unfinished stream its first chunk time, time of its end, highest token count, last event time,
    number of its end chunk and the numbers seen (how many from 0 on, and those beyond a gap).

    Chunks combine without order. A stream is complete when all numbers up to its end have been seen; one with a gap waits
    for it until the watermark has passed its last chunk, and one without an end is forgotten after a silence.
    """

    _BEST = {"first": "min", "end": "max", "tokens": "max", "last": "max", "end_seq": "max", "seq": "nunique"}

    def __init__(self, key: str, timeout_ms: int):
        self.key, self.timeout_ms = key, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = _Blob(handle, dict)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for pdf in rows:
            later, ends = pdf["seq"] > 0, pdf["end_of_stream"].fillna(False).astype(bool)
            part = {
                "id": pdf[self.key], "first": pdf["recv_ms"], "end": pdf["recv_ms"].where(later & ends), "tokens": pdf["output_tokens"].where(later),
                "last": pdf["at_ms"], "end_seq": pdf["seq"].where(ends), "seq": pdf["seq"],
            }
            parts.append(pd.DataFrame(part).astype({c: "float64" for c in ("first", "end", "tokens", "end_seq")}))
        pdf = pd.concat(parts)
        got = pdf.groupby("id").agg(self._BEST)
        held = self.open.read()
        ids = [_plain((i,))[0] for i in got.index]
        whole = (got["seq"] == got["end_seq"] + 1).to_numpy() & ~np.array([i in held for i in ids], dtype=bool)
        done = {i: v for i, v, w in zip(ids, got[["first", "end", "tokens"]].itertuples(index=False), whole) if w}
        numbers = pdf[pdf["id"].isin(got.index[~whole])].groupby("id")["seq"].agg(set)
        for i, row, w in zip(ids, got.itertuples(index=False), whole):
            if not w:
                old = held.get(i, (np.inf, np.nan, np.nan, row.last, np.nan, 0, frozenset()))
                prefix, beyond = old[5], {n for n in old[6] | numbers[i] if n >= old[5]}
                while prefix in beyond:
                    beyond.remove(prefix)
                    prefix += 1
                best = (np.fmax(old[1], row.end), np.fmax(old[2], row.tokens), max(old[3], int(row.last)), np.fmax(old[4], row.end_seq))
                held[i] = (min(old[0], row.first), *best, prefix, frozenset(beyond))
        yield from self._settle(done, held, timerValues.getCurrentWatermarkInMs())

    def _settle(self, done: dict, held: dict, now: int) -> Iterator[pd.DataFrame]:
        """Emit what is complete or can wait no longer, forget what stays silent, keep the rest and set the next timer."""
        done = {**done, **{k: v for k, v in held.items() if v[5] > v[4] or (v[4] == v[4] and v[3] <= now)}}
        kept = {k: v for k, v in held.items() if k not in done and (v[4] == v[4] or v[3] + self.timeout_ms > now)}
        self.open.write(kept)
        _drop_timers(self.handle)
        if kept:
            self.handle.registerTimer(min(v[3] if v[4] == v[4] else v[3] + self.timeout_ms for v in kept.values()))
        if done:
            first, end, tokens = (np.array([v[i] for v in done.values()], dtype=np.float64) for i in range(3))
            with np.errstate(invalid="ignore", divide="ignore"):
                tpot = np.where(tokens > 1, (end - first) / 1000.0 / (tokens - 1), np.nan)
            yield pd.DataFrame({self.key: list(done), "ttft_s": first / 1000.0, "tpot_s": pd.array(tpot, dtype="Float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle({}, self.open.read(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_latency_state(
    chunks: DataFrame, at: str, key: str = "request_id", timeout: int = 600, delay: str = "10 minutes", buckets: int | None = None
) -> DataFrame:
    """TTFT and time per output token of each chunk stream, emitted once its chunks, numbered from 0, are all there up to the end.

    Chunks may arrive in any order within ``delay`` and come once each; a stream whose gap is not filled by then is emitted
    without it. One without an end that stays silent for ``timeout`` seconds of event time is forgotten.
    """
    use_rocksdb(chunks.sparkSession)
    rows = chunks.withWatermark(at, delay).select(
        key, at, F.col("seq").cast("bigint").alias("seq"), F.col("recv_ms").cast("bigint").alias("recv_ms"), F.col("output_tokens").cast("bigint").alias("output_tokens"),
        "end_of_stream", F.unix_millis(at).alias("at_ms"),
    )
    return _bucketed(rows, [key], buckets).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=_Latency(key, timeout * 1000),
        outputStructType=_schema_of(chunks, [key], "ttft_s double, tpot_s double"),
        outputMode="Append",
        timeMode="EventTime",
    )


#: Instants of a block: an Arrow batch takes thousands of rows, whatever their size.
_BLOCK = 64
#: Blocks put in order at a time, and handed over in one frame.
_BLOCKS = 256
#: Moves that a task packs at a time.
_PACK = 1 << 18
#: Bytes of a label set's blocks kept in memory until they are in order; more of them wait in a temporary file.
_SPOOL = 16 << 20


def _netted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct instants in order, and the net move of each."""
    at, delta = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    at, delta = at[order], delta[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(delta, first)


def _blocks(at: np.ndarray, delta: np.ndarray) -> Iterator[bytes]:
    """Net moves in order, cut into blocks: the bytes of some instants, then of their moves."""
    for i in range(0, len(at), _BLOCK):
        yield at[i : i + _BLOCK].tobytes() + delta[i : i + _BLOCK].tobytes()


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    at, delta = np.frombuffer(block, np.int64).reshape(2, -1)
    return at, delta


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, _BLOCKS)):
        yield pd.DataFrame(some, columns=columns)


class _Pack:
    """Nets a task's moves per label set and bucket, and cuts them into blocks. State calls take rows one by one, so few of
    them reach the state. Every bucket gets a block, maybe an empty one: a bucket must have seen the watermark to tell late
    instants from others."""

    def __init__(self, labels: list[str], buckets: int):
        self.labels, self.buckets = labels, buckets

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _framed(self._rows(frames), [*self.labels, _BUCKET, "packed_moves", "last_us"])

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        known, parts, waiting, greet = {}, [], 0, range(self.buckets)
        for pdf in chain(frames, [None]):
            if pdf is not None and len(pdf):
                owner = pdf.groupby(self.labels, dropna=False, sort=False).ngroup()
                names = pdf.loc[~owner.duplicated(), self.labels].itertuples(index=False)
                codes = np.array([known.setdefault(_plain(n), len(known)) for n in names])
                parts.append((codes[owner.to_numpy()], *(pdf[c].to_numpy("int64") for c in (_BUCKET, "at_us", "delta"))))
                waiting += len(pdf)
            if parts and (pdf is None or waiting >= _PACK):
                code, bucket, at, delta = (np.concatenate(x) for x in zip(*parts))
                last = int(at.max())
                yield from ((*(None for _ in self.labels), b, b"", last) for b in greet)
                order = np.lexsort((bucket, code))
                code, bucket, at, delta = code[order], bucket[order], at[order], delta[order]
                ends = np.flatnonzero(np.r_[(code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1]), True]) + 1
                names = list(known)
                for i, end in zip([0, *ends[:-1]], ends):
                    for block in _blocks(*_netted([(at[i:end], delta[i:end])])):
                        yield (*names[code[i]], int(bucket[i]), block, int(_unpacked(block)[0][-1]))
                known, parts, waiting, greet = {}, [], 0, ()


class _NetMoves(StatefulProcessor):
    """State of a bucket: the watermark it has seen, and the net moves of the instants after it, per label set.

    A label set's instants are dealt over all buckets, so what a bucket holds follows the number of buckets, not the label
    set. A block can hold late instants beside others, which are dropped here; for that a timer wakes every bucket whenever
    the watermark moves.
    """

    def __init__(self, labels: list[str]):
        self.labels = labels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = _Pieces(handle, lambda: (0, {}))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, held = self.held.read()
        parts = {names: [part] for names, part in held.items()}
        waiting, room = 0, _PACK
        for pdf in rows:
            for *names, block in pdf[[*self.labels, "packed_moves"]].itertuples(index=False):
                if block:
                    at, delta = _unpacked(block)
                    late = int(np.searchsorted(at, seen * 1000, side="right"))
                    if late < len(at):
                        parts.setdefault(_plain(names), []).append((at[late:], delta[late:]))
                        waiting += len(at) - late
            if waiting > room:  # only distinct instants are kept
                parts = {names: [_netted(p)] for names, p in parts.items()}
                waiting, room = 0, max(room, sum(len(p[0][0]) for p in parts.values()))
        yield from self._emit({names: _netted(p) for names, p in parts.items()}, timerValues.getCurrentWatermarkInMs())

    def _emit(self, net: dict, now_ms: int) -> Iterator[pd.DataFrame]:
        passed = {names: int(np.searchsorted(at, now_ms * 1000, side="right")) for names, (at, _) in net.items()}
        rest = {names: (at[passed[names] :], delta[passed[names] :]) for names, (at, delta) in net.items() if passed[names] < len(at)}
        self.held.write((now_ms, rest))
        _drop_timers(self.handle)
        self.handle.registerTimer(now_ms + 1)
        blocks = ((*names, block) for names, (at, delta) in net.items() for block in _blocks(at[: passed[names]], delta[: passed[names]]))
        yield from _framed(blocks, [*self.labels, "packed_moves"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._emit(self.held.read()[1], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class _Gauge(StatefulProcessor):
    """State of a label set: the gauge at the last instant emitted.

    The blocks of a micro-batch are later than those of all before it, but come in no order. They wait in a file until all
    are there, and are read back by their first instant, a few at a time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gauge", "inflight long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gauge = int(self.state.get()[0]) if self.state.exists() else 0
        with SpooledTemporaryFile(_SPOOL) as file:
            firsts, sizes = array("q"), array("q")
            for pdf in rows:
                for block in pdf["packed_moves"]:
                    firsts.append(int(_unpacked(block)[0][0]))
                    sizes.append(file.write(block))
            for at, delta in self._in_order(file, np.array(firsts), np.array(sizes)):
                values = delta.cumsum() + gauge
                gauge = int(values[-1])
                yield pd.DataFrame({"at_us": at, "inflight": values})
        if gauge:
            self.state.update((gauge,))
        elif self.state.exists():
            self.state.clear()

    @staticmethod
    def _in_order(file, firsts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Moves by instant. What lies at or after the next block's first instant waits for that block; as the blocks of a
        bucket follow each other, that is one block a bucket at most."""
        starts, order = sizes.cumsum() - sizes, np.argsort(firsts, kind="stable")
        later = []
        for i in range(0, len(order), _BLOCKS):
            for n in order[i : i + _BLOCKS]:
                file.seek(starts[n])
                later.append(_unpacked(file.read(sizes[n])))
            at, delta = _netted(later)
            end = np.searchsorted(at, firsts[order[i + _BLOCKS]]) if i + _BLOCKS < len(order) else len(at)
            if end:
                yield at[:end], delta[:end]
            later = [(at[end:], delta[end:])]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter([])

    def close(self) -> None:
        pass


def stream_inflight(moves: DataFrame, by: Sequence[str], delay: str = "10 minutes", buckets: int | None = None) -> DataFrame:
    """Running gauge over a stream of ``(labels, at_us, delta)`` moves, +1 at start and -1 at end.

    Instants are emitted in order once the watermark, ``delay`` behind the latest move, has passed them; moves that come
    later than that are dropped, as in every stream of this module. Moves are packed, wait and are netted over all tasks, in
    buckets of instants; a label set's task only puts the packed net moves in order and adds them up.
    """
    use_rocksdb(moves.sparkSession)
    by = list(by)
    labels = [f"label_{i}" for i in range(len(by))]
    fields = T.StructType([T.StructField(n, moves.schema[b].dataType) for n, b in zip(labels, by)])
    rows = moves.where(F.col("at_us").isNotNull()).select(
        *(F.col(b).alias(n) for n, b in zip(labels, by)), F.col("at_us").cast("bigint").alias("at_us"), F.coalesce(F.col("delta").cast("bigint"), F.lit(0)).alias("delta")
    )
    n = buckets or _bucket_count(moves)
    packed = _bucketed(rows, [*labels, "at_us"], n).mapInPandas(
        _Pack(labels, n), T.StructType([*fields, *T.StructType.fromDDL(f"{_BUCKET} int, packed_moves binary, last_us long")])
    )
    net = packed.withColumn("last_at", F.timestamp_micros("last_us")).drop("last_us").withWatermark("last_at", delay).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=_NetMoves(labels), outputStructType=T.StructType([*fields, T.StructField("packed_moves", T.BinaryType())]), outputMode="Append", timeMode="EventTime"
    )
    return net.groupBy(*labels).transformWithStateInPandas(
        statefulProcessor=_Keyed(_Gauge(), by), outputStructType=_schema_of(moves, by, "at_us long, inflight long"), outputMode="Append", timeMode="None"
    )


class LiveConfig:
    """A configuration re-read before every micro-batch; a version that does not validate is ignored."""

    def __init__(self, load: Callable[[], object], validate: Callable[[object], None]):
        self.load, self.validate = load, validate
        self.current: object | None = None
        self.rejected = 0

    def refresh(self) -> object:
        try:
            candidate = self.load()
            self.validate(candidate)
            self.current = candidate
        except Exception:
            self.rejected += 1
            if self.current is None:
                raise
        return self.current


def stream_with_live_config(
    stream: DataFrame, config: LiveConfig, apply: Callable[[DataFrame, object], DataFrame], sink: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    """Each micro-batch is processed with the newest valid configuration."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(apply(batch, config.refresh()), batch_id)

    return stream.writeStream.foreachBatch(run)


def cost_expression_config(spark, load: Callable[[], str]) -> LiveConfig:
    """Live configuration holding one cost expression."""
    return LiveConfig(load, lambda expr: validate_cost_expression(spark, expr))


class VersionedConfig:
    """Versions of a configuration table ``(version, effective_us, value)``; each row takes the one in force at its time.

    The table is read before every micro-batch. A version that does not validate is left out, so the one before it stays in
    force. A row's version depends on its own time alone: a micro-batch that is run again gives the same rows.
    """

    def __init__(self, load: Callable[[], DataFrame], validate: Callable[[str], None]):
        self.load, self.validate = load, validate
        self.known: dict[tuple, bool] = {}

    def versions(self) -> list[tuple[int, int, str]]:
        """Valid versions by time; a configuration has few of them."""
        rows = self.load().select("version", "effective_us", "value").collect()
        return sorted((tuple(r) for r in rows if self._valid(tuple(r))), key=lambda r: (r[1], r[0]))

    def _valid(self, row: tuple) -> bool:
        if row not in self.known:
            try:
                self.validate(row[2])
                self.known[row] = True
            except ValueError:
                self.known[row] = False
        return self.known[row]

    def assign(self, batch: DataFrame, at_us: str, out: str = "config_version") -> tuple[DataFrame, list[tuple[int, int, str]]]:
        """``batch`` with the version of each row (NULL before the first), and the versions."""
        versions = self.versions()
        chosen = F.lit(None).cast("bigint")
        for version, since, _ in versions:
            chosen = F.when(F.col(at_us) >= since, F.lit(version).cast("bigint")).otherwise(chosen)
        return batch.withColumn(out, chosen), versions


def stream_with_versions(
    stream: DataFrame, config: VersionedConfig, at_us: str, apply: Callable[[DataFrame, str], DataFrame], path: str, out: str = "config_version"
) -> DataStreamWriter:
    """Each row is processed by the configuration in force at its time and written below ``path``.

    A micro-batch is written to ``batch=<id>`` in place of what is there, so one that is run again leaves no second copy.
    Rows before the first version are left out.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows, versions = config.assign(batch, at_us, out)
        parts = [apply(rows.where(F.col(out) == version), value) for version, _, value in versions]
        done = reduce(DataFrame.unionByName, parts) if parts else None
        if done is not None:
            done.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run)
