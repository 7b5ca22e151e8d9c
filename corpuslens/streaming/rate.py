"""A fixed-window rate limit whose windows begin with a client's first request, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType, TimestampNTZType

from corpuslens.sources.stored import materialise

_PLACED = StructType([
    StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("part", IntegerType()), StructField("head", BooleanType()),
    StructField("window_start", TimestampNTZType()), StructField("nth", LongType()),
    StructField("ends", ArrayType(StructType([StructField(n, LongType()) for n in ("upto", "start", "row")]))), StructField("rows", LongType()),
])


#: Waiting events of one element of a user's list.
_RUN = 4096


def _windows(ts: np.ndarray, step: int, start: int | None, row: int) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """The start and the number in its window of each of a user's sorted times, given the open window and its first row (negative: before these)."""
    opened, nth, at = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64), 0
    while at < len(ts):
        if start is None or ts[at] >= start + step:
            start, row = int(ts[at]), at
        end = at + int(np.searchsorted(ts[at:], start + step))
        opened[at:end], nth[at:end] = start, np.arange(at, end) - row + 1
        at = end
    return opened, nth, start, row


def _ends(ts: np.ndarray, step: int) -> list[dict[str, int]]:
    """Which window is open at the end of sorted times, for each row that may open the first one in them, by the time up to which such rows lead there.

    A window that is open before closes less than ``step`` after the first time, so the row after that is the last that may be next.
    """
    follows = np.searchsorted(ts, ts + step)
    now = np.arange(min(len(ts), int(np.searchsorted(ts, ts[0] + step)) + 1))
    while (moving := follows[now] < len(ts)).any():
        now[moving] = follows[now[moving]]
    last = np.flatnonzero(np.r_[now[1:] != now[:-1], True])
    return [{"upto": int(ts[i]), "start": int(ts[now[i]]), "row": int(now[i])} for i in last]


def _first_pass(step: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part = to_arrow_schema(_PLACED), TaskContext.get().partitionId()
        user, seen, first, kept, start, row = None, 0, True, [], None, 0

        def filled(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def summary() -> pa.RecordBatch:
            ends = _ends(np.concatenate(kept), step) if first else [{"upto": 0, "start": start, "row": row}]
            return filled(1, user_id=[user], part=[part], head=[first], ends=[ends], rows=[seen])

        for batch in batches:
            ids, null = batch["user_id"].fill_null(0).to_numpy(zero_copy_only=False), batch["user_id"].is_null().to_numpy(zero_copy_only=False)
            ts = batch["ts"].cast(pa.int64()).to_numpy(zero_copy_only=False)
            opened, nth, head = np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
            cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
            for lo, hi in zip(cuts, [*cuts[1:], len(ts)], strict=True):
                own = None if null[lo] else int(ids[lo])
                if seen and own != user:
                    if first:
                        yield summary()
                    first, seen, start = False, 0, None
                user = own
                if first:
                    head[lo:hi] = True
                    kept.append(ts[lo:hi])
                else:
                    opened[lo:hi], nth[lo:hi], start, at = _windows(ts[lo:hi], step, start, row - seen)
                    row = at + seen
                seen += hi - lo
            yield filled(len(ts), user_id=batch["user_id"], event_id=batch["event_id"], ts=batch["ts"], part=np.full(len(ts), part, np.int32), head=head, window_start=pa.array(opened, mask=head).cast(schema.field("window_start").type), nth=pa.array(nth, mask=head))
        if seen:
            yield summary()

    return place


def _fold(step: int):
    """What is open before each part of a user whose events span parts: the window's start and how many rows lie between its first and the part."""

    def fold(summaries: pd.DataFrame) -> pd.DataFrame:
        out, start, row, before = [], None, 0, 0
        for s in summaries.sort_values("part").itertuples():
            if s.head:
                out.append((s.user_id, s.part, start, before - row))
                ways = [e for e in s.ends if start is None or e["upto"] >= start + step]
                if ways:
                    start, row = ways[0]["start"], before + ways[0]["row"]
            else:
                start, row = s.ends[0]["start"], before + s.ends[0]["row"]
            before += s.rows
        frame = pd.DataFrame(out, columns=["user_id", "part", "open", "since"], dtype=object)
        return frame.astype({"part": "int32", "since": "int64"})

    return fold


def _second_pass(step: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, start, row, seen = None, None, 0, 0
        for batch in batches:
            part = batch["part"].to_numpy(zero_copy_only=False)
            ts = batch["ts"].cast(pa.int64()).to_numpy(zero_copy_only=False)
            opened, nth = np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for lo, hi in zip(cuts, [*cuts[1:], len(ts)], strict=True):
                if part[lo] != of:
                    of, start, row, seen = part[lo], batch["open"][lo].as_py(), -(batch["since"][lo].as_py() or 0), 0
                opened[lo:hi], nth[lo:hi], start, at = _windows(ts[lo:hi], step, start, row - seen)
                row = at + seen
                seen += hi - lo
            yield pa.RecordBatch.from_arrays([batch["user_id"], batch["event_id"], batch["ts"], pa.array(opened).cast(batch["ts"].type), pa.array(nth)], names=["user_id", "event_id", "ts", "window_start", "nth"])

    return place


def rate_windows(events: DataFrame, seconds: int = 3600, budget: int = 600, parts: int | None = None) -> DataFrame:
    """Each event (user_id, event_id, ts) with its window, its number there and whether it is within the budget.

    A window opens with the first event after the last one closed. Events are put in ranges of user and time, so a hot user
    is many parts. In the first pass a part places the events of all users but its first, whose open window it can't know;
    of that one it says which window would be open at its end, for each row that might open the next. What is open before
    each part of a user follows from these alone; then the second pass places the rest. Events without a time are left out.
    """
    step = int(seconds) * 1_000_000
    n = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts")).where("ts is not null")
    order = [F.asc_nulls_first("user_id"), F.col("ts"), F.col("event_id")]
    placed = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_first_pass(step), _PLACED), "rate-parts")
    opened = placed.where("ends is not null").select("user_id", "part", "head", "ends", "rows").groupBy("user_id").applyInPandas(_fold(step), "user_id long, part int, open long, since long")
    # as many rows as parts at most: the first user of each
    opened = F.broadcast(opened.select("part", "open", "since"))
    columns = ["user_id", "event_id", "ts", "window_start", "nth"]
    known = placed.where("ends is null and not head").select(columns)
    rest = placed.where("ends is null and head").join(opened, "part", "left").select("user_id", "event_id", "ts", "part", "open", "since")
    rest = rest.repartition("part").sortWithinPartitions("part", "ts", "event_id").mapInArrow(_second_pass(step), "user_id long, event_id long, ts timestamp_ntz, window_start timestamp_ntz, nth long")
    return known.unionByName(rest).withColumn("allowed", F.col("nth") <= budget)


class RateWindows(StatefulProcessor):
    """Windows of one user, whose events wait in the state until event time has passed them.

    What comes in a batch is appended to the list of waiting events as it is, with one timer at its earliest instant. When
    a timer fires, all that event time has passed is placed at once, in order of time, so events that came late, but not
    later than the watermark, are placed as if they had come in order. What still waits is written back, with a timer at its
    earliest instant. So a user takes a few calls of the state in each batch, however many events it has; its waiting
    events are held as two numbers each. The state beside them is the open window's start and count, which a timer drops
    when the window has closed.
    """

    def __init__(self, seconds: int, budget: int):
        self.step, self.budget = int(seconds) * 1_000_000, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        number = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.waiting = handle.getListState("waiting", "runs array<struct<us:bigint,event_id:bigint>>")
        self.open = handle.getValueState("open", number("us", "count"))

    def _wait(self, us: np.ndarray, event_id: list, keep) -> None:
        keep([(list(zip(us[lo : lo + _RUN].tolist(), event_id[lo : lo + _RUN], strict=True)),) for lo in range(0, len(us), _RUN)])
        self.handle.registerTimer(int(us.min()) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self._wait(_micros(frame["ts"]).to_numpy(), [None if pd.isna(e) else int(e) for e in frame["event_id"]], self.waiting.appendList)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        start, count = self.open.get() if self.open.exists() else (None, 0)
        waiting = sorted(((e[0], e[1]) for run in self.waiting.get() for e in run[0]), key=lambda e: (e[0], e[1] is not None, e[1]))
        us = np.array([e[0] for e in waiting], np.int64)
        due = int(np.searchsorted(us // 1000, passed))
        if due:
            opened, nth, start, row = _windows(us[:due], self.step, start, -count)
            count = due - row
            if due < len(us):
                self._wait(us[due:], [e[1] for e in waiting[due:]], self.waiting.put)
            else:
                self.waiting.clear()
            self.open.update((start, count))
            self.handle.registerTimer((start + self.step) // 1000 + 2)
            ids = pd.array([e[1] for e in waiting[:due]], "Int64")
            yield pd.DataFrame({"user_id": key[0], "event_id": ids, "ts": us[:due].view("datetime64[us]"), "window_start": opened.view("datetime64[us]"), "nth": nth, "allowed": nth <= self.budget})
        elif start is not None and passed * 1000 >= start + self.step:
            self.open.clear()

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def rate_stream(events: DataFrame, seconds: int = 3600, budget: int = 600, late: str = "0 seconds") -> DataFrame:
    """The rows of rate_windows over a stream; an event may come as much later than others as ``late`` says, and is placed once time has passed it.

    Maps and timers need the RocksDB state store, which the session names in spark.sql.streaming.stateStore.providerClass.
    """
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), F.col("ts").cast("timestamp_ntz").alias("ts")).where("ts is not null")
    grouped = rows.withWatermark("at", late).groupBy("user_id")
    return grouped.transformWithStateInPandas(RateWindows(seconds, budget), "user_id long, event_id long, ts timestamp_ntz, window_start timestamp_ntz, nth long, allowed boolean", "Append", "EventTime")
