"""Request windows: against a loop, with one client that makes most requests, and as a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from plenum.streaming import rate_limit as R

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)
SCHEMA = "event_id long, client long, ts timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def by_loop(requests, seconds, most):
    out, window = {}, {}
    for event, client, ts in sorted((r for r in requests if r[2] is not None), key=lambda r: (r[2], r[0])):
        start, n = window.get(client, (None, 0))
        if start is None or ts >= start + datetime.timedelta(seconds=seconds):
            start, n = ts, 0
        window[client] = (start, n + 1)
        out[event] = (client, start.replace(tzinfo=None), n + 1, n + 1 > most)
    return out


def found(df):
    return {r.event_id: (r.client, r.fonster_start, r.i_fonster, r.nekad) for r in df.collect()}


def test_windows_start_at_the_first_request(spark):
    rows = [(i, 1, at(s)) for i, s in enumerate([0, 10, 59, 60, 61, 200, 230, 261])] + [(99, 2, at(30))]
    got = found(R.limited(spark.createDataFrame(rows, SCHEMA), 60, 2))
    assert [got[i][2:] for i in range(8)] == [(1, False), (2, False), (3, True), (1, False), (2, False), (1, False), (2, False), (1, False)] and got[99][2:] == (1, False)


@pytest.mark.parametrize("seed", range(3))
def test_windows_by_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([at(rng.uniform(0, 4000)), at(rng.randrange(400) * 10)])) for k in range(900)]
    rows += [(1000, 7, at(-86_400)), (1001, 7, at(90_000)), (1002, 8, None), (1003, 1, rows[0][2])]
    assert found(R.limited(spark.createDataFrame(rows, SCHEMA), 60, 3)) == by_loop(rows, 60, 3)


def test_no_requests(spark):
    assert R.limited(spark.createDataFrame([], SCHEMA), 60, 2).count() == 0


def test_one_client_is_worked_on_by_many_tasks(spark):
    """A single client's windows, a long chain: no task sees more than a block's rows of it, and few rounds find them."""
    rows = [(k, 5, at(k * 7)) for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = R.limited(df, 60, 4)
    assert found(out) == by_loop(rows, 60, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
    times = df.select("client", F.unix_micros("ts").alias("at"))
    starts = R.window_starts(times, 60_000_000)
    assert starts.count() == len({s for _, s, _, _ in by_loop(rows, 60, 4).values()}) == 667
    most = starts.groupBy(F.floor(F.col("at") / 60_000_000)).count().agg(F.max("count")).first()[0]
    assert most == 1  # a window starts in a block at most once


def test_stream_keeps_the_open_window(spark, tmp_path):
    rows = [(i, 1, at(s)) for i, s in enumerate([0, 10, 59, 60, 61, 200, 230, 261])] + [(99, 2, at(30))]
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = str(tmp_path / "in")
        for part in (rows[:2] + rows[-1:], rows[2:5], rows[5:8]):  # windows stay open from batch to batch
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        requests = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "1 minute")
        stream = R.limited_stream(requests, 60, 2).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp"))
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
        assert found(spark.table("limits")) == by_loop(rows, 60, 2)
    finally:
        spark.conf.set(STORE, before)
