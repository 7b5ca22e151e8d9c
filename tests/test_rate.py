"""Rate windows against going through each user's events one after another."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.streaming.rate import RateWindows, rate_stream, rate_windows

BEGAN = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp_ntz"


def plain(events, seconds, budget):
    want, open_ = {}, {}
    for user, event, ts in sorted((e for e in events if e[2]), key=lambda e: (e[2], e[1])):
        start, n = open_.get(user, (None, 0))
        start, n = (ts, 0) if start is None or ts >= start + dt.timedelta(seconds=seconds) else (start, n)
        open_[user] = start, n + 1
        want[event] = (user, start, n + 1, n < budget)
    return want


@pytest.mark.parametrize("parts, span", [(1, 2000), (7, 2000), (40, 2000), (7, 200), (40, 50), (25, 20_000)])
def test_windows_across_parts_and_batches(spark, parts, span):
    rng = random.Random(span)
    events = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3]), i, BEGAN + dt.timedelta(seconds=rng.randrange(span))) for i in range(300)] + [(1, 900, None)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.event_id: (r.user_id, r.window_start, r.nth, r.allowed) for r in rate_windows(spark.createDataFrame(events, SCHEMA), 60, 3, parts).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == plain(events, 60, 3)
    assert rate_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_user_is_many_parts(spark):
    """With half of the events of one user, no part has more than a few times the usual rows."""
    events = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("user_id"), F.col("id").alias("event_id"), (F.lit(BEGAN) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id"))).cast("timestamp_ntz").alias("ts"))
    order = [F.asc_nulls_first("user_id"), F.col("ts"), F.col("event_id")]
    sizes = [r.n for r in events.repartitionByRange(8, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 500
    rows = rate_windows(events, 100, 5, parts=8)
    assert rows.count() == 4000 and rows.where("user_id = 0").agg(F.countDistinct("window_start")).first()[0] == 40


def test_stream_stopped_and_taken_up_again_gives_the_batch_rows(spark, tmp_path):
    rng = random.Random(1)
    events = [(rng.choice([1, 1, 2, 3]), i, BEGAN + dt.timedelta(milliseconds=rng.randrange(400_000))) for i in range(240)]
    events.sort(key=lambda e: e[2])
    for i in range(0, 240, 40):  # events of a file in any order, one of them late by less than the watermark allows
        part = [*events[i : i + 40], (9, 1000 + i, events[i][2])]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events += [(9, 1000 + i, events[i][2]) for i in range(0, 240, 40)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def start():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return rate_stream(source, 60, 3, "5 seconds").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")

    run = start()
    while run.isActive and (run.lastProgress is None or run.lastProgress["batchId"] < 2):
        run.awaitTermination(0.2)
    run.stop()
    spark.createDataFrame([(None, 5000, BEGAN + dt.timedelta(days=2))], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start().awaitTermination(600)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == len(events)
    assert {r.event_id: (r.user_id, r.window_start, r.nth, r.allowed) for r in rows} == plain(events, 60, 3)


def test_a_user_takes_few_calls_of_the_state():
    """Two batches of one user's events, with a state that counts how often it is called."""
    calls, timers, at = [], [], {}

    class State:
        def __init__(self):
            self.value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("exists", "containsKey"):
                    return self.value is not None
                if name in ("update", "put"):
                    self.value = args[0]
                elif name == "appendList":
                    self.value = [*(self.value or []), *args[0]]
                elif name == "clear":
                    self.value = None
                return iter(self.value or []) if name == "get" and not isinstance(self.value, tuple) else self.value

            return call

    handle = SimpleNamespace(registerTimer=lambda ms: (calls.append("timer"), timers.append(ms)), getListState=lambda *a: State(), getValueState=lambda *a: State(), getMapState=lambda *a: State())
    rate = RateWindows(60, 3)
    rate.init(handle)
    events = [(1, i, BEGAN + dt.timedelta(seconds=i)) for i in range(2000)]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: at["ms"])
    out = []
    for own, passed in ((events[:1200], events[1000]), (events[1200:], (1, 0, BEGAN + dt.timedelta(days=1)))):
        list(rate.handleInputRows((1,), iter([pd.DataFrame(own, columns=["user_id", "event_id", "ts"])]), now))
        at["ms"] = int((passed[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        for ms in sorted({t for t in timers if t <= at["ms"]}):
            timers.remove(ms)
            out += [frame for frame in rate.handleExpiredTimer((1,), now, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))]
    got = {r.event_id: (r.user_id, r.window_start.to_pydatetime(), r.nth, r.allowed) for f in out for r in f.itertuples()}
    assert got == plain(events, 60, 3) and len(calls) < 40
