"""Registered queries over events in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.plans.registry import query
from corpuslens.sources.stored import shared_path
from corpuslens.sources.tables import table
from corpuslens.streaming.rate import rate_stream, rate_windows

_DAY, _BUDGET = 86_400, 3
_WINDOWS = """with recursive w(user_id, window_start) as (select user_id, min(ts) from events group by 1 union all select user_id, n from (select w.user_id, (select min(e.ts) from events e where e.user_id = w.user_id and e.ts >= w.window_start + interval 1 day) as n from w) where n is not null),
p as (select e.user_id, e.event_id, e.ts, max(w.window_start) as window_start from events e join w on w.user_id = e.user_id and w.window_start <= e.ts group by 1, 2, 3)
select *, row_number() over (partition by user_id, window_start order by ts, event_id) as nth, row_number() over (partition by user_id, window_start order by ts, event_id) <= 3 as allowed from p"""


@query("sx02_rate_windows", _WINDOWS)
def sx02(spark, folder):
    return rate_windows(table(spark, folder, "events").select("user_id", "event_id", "ts"), _DAY, _BUDGET)


@query("sx02_rate_stream", _WINDOWS)
def sx02_stream(spark, folder):
    """The same as a stream: events arrive in four files, the stream stops after two, and is taken up again from its checkpoint."""
    events, path = table(spark, folder, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts")), shared_path(spark, "stream")
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).agg(F.percentile_approx("at", [0.25, 0.5, 0.75], 1000)).first()[0] or [0, 0, 0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slices = [at <= cuts[0], *[(at > a) & (at <= b) for a, b in zip(cuts, cuts[1:])], at > cuts[-1]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run() -> None:
        source = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        placed = rate_stream(source, _DAY, _BUDGET)
        placed.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()

    for half in (slices[:2], slices[2:]):
        for part in half:
            events.where(part).write.mode("append").parquet(f"{path}/in")
            run()
    # a client that comes when all windows have closed moves time past the last events
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 2 days")).cast("timestamp_ntz").alias("ts"))
    end.write.mode("append").parquet(f"{path}/in")
    run()
    return spark.read.schema("user_id long, event_id long, ts timestamp_ntz, window_start timestamp_ntz, nth long, allowed boolean").parquet(f"{path}/out").where("event_id is not null")
