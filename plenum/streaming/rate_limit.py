"""Requests per client in fixed windows that start at the client's first request after the last window ended.

Not aligned to the clock, so no window() of Spark: the start of a window depends on the one before.  In batch a client's windows are
found in parallel, by pointer doubling over "the first request a window later"; in a stream the open window is the client's state.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plenum.sources.shared import kept

RESULT = "event_id long, client long, fonster_start timestamp, i_fonster long, nekad boolean"


def _requests(requests: DataFrame) -> DataFrame:
    rows = requests.select(F.col("event_id").cast("long").alias("event_id"), F.col("client").cast("long").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.filter("ts is not null")


def successors(times: DataFrame, micros: int) -> DataFrame:
    """Distinct (client, at) with ``next``, the client's first time at least ``micros`` later; null if there is none.

    Time is cut into blocks as long as a window.  What is a window later lies in the next block, or else is the first time of the
    client's next block that has any.  So times meet only within a client's block, however many requests the client makes.
    """
    blocked = times.withColumn("block", F.floor(F.col("at") / micros))
    of_client = Window.partitionBy("client").orderBy("block")
    firsts = blocked.groupBy("client", "block").agg(F.min("at").alias("first"))
    firsts = firsts.select("client", "block", F.lead("block").over(of_client).alias("after"), F.lead("first").over(of_client).alias("first_after"))
    # The first of a block's own times at or after each time, moved on by a window, of the block before.
    own = blocked.select("client", "block", F.col("at").alias("when"), F.lit(None).cast("long").alias("asks"))
    moved = blocked.select("client", (F.col("block") + 1).alias("block"), (F.col("at") + micros).alias("when"), F.col("at").alias("asks"))
    later = Window.partitionBy("client", "block").orderBy("when").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = own.unionByName(moved).withColumn("next", F.min(F.when(F.col("asks").isNull(), F.col("when"))).over(later))
    near = both.filter("asks is not null").select("client", F.col("asks").alias("at"), (F.col("block") - 1).alias("block"), "next")
    # The block after that is not the next one, or whose times are all too early, leaves the choice to the block behind it.
    joined = near.join(firsts, ["client", "block"]).join(firsts.select("client", F.col("block").alias("after"), F.col("first_after").alias("first_then")), ["client", "after"], "left")
    beyond = F.when(F.col("after") > F.col("block") + 1, F.col("first_after")).otherwise(F.col("first_then"))
    return joined.select("client", "at", F.coalesce("next", beyond).alias("next"))


def window_starts(times: DataFrame, micros: int) -> DataFrame:
    """(client, at) of the distinct ``times`` at which a window starts: all that is reachable from the client's first by ``next``.

    Round k adds what is 2 ** k windows behind a start that is known, and joins the steps with themselves; clients without so many
    windows have no rows left by then.  There are as many rounds as the longest chain of windows has binary digits.
    """
    steps = kept(successors(times, micros).filter("next is not null"))
    starts = kept(times.groupBy("client").agg(F.min("at").alias("at")))
    while not steps.isEmpty():
        starts = kept(starts.unionByName(starts.join(steps, ["client", "at"]).select("client", F.col("next").alias("at"))))
        twice = steps.select("client", F.col("at").alias("next"), F.col("next").alias("then"))
        steps = kept(steps.join(twice, ["client", "next"]).select("client", "at", F.col("then").alias("next")))
    return starts


def limited(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """Requests (event_id, client, ts) with their window's start, their place in it, and whether they are refused.

    Rows without a time are left out; requests of a null client are one client's; equal times go by event_id.
    """
    micros = seconds * 1_000_000
    rows = _requests(requests).select("event_id", F.coalesce(F.col("client").cast("string"), F.lit("-")).alias("who"), "client", F.unix_micros("ts").alias("at"))
    starts = window_starts(rows.select(F.col("who").alias("client"), "at").distinct(), micros)
    # At most one window starts in a block, and the one a request lies in starts in its block or the one before.
    starts = kept(starts.select(F.col("client").alias("who"), F.floor(F.col("at") / micros).alias("block"), F.col("at").alias("start")))
    rows = rows.withColumn("block", F.floor(F.col("at") / micros))
    rows = rows.join(starts.withColumnRenamed("start", "here"), ["who", "block"], "left")
    rows = rows.join(starts.select("who", (F.col("block") + 1).alias("block"), F.col("start").alias("before")), ["who", "block"], "left")
    start = F.when(F.col("here") <= F.col("at"), F.col("here")).otherwise(F.col("before"))
    place = F.row_number().over(Window.partitionBy("who", "start").orderBy("at", "event_id")).cast("long")
    rows = rows.withColumn("start", start).withColumn("i_fonster", place)
    return rows.select("event_id", "client", F.timestamp_micros("start").alias("fonster_start"), "i_fonster", (F.col("i_fonster") > most).alias("nekad"))


class OpenWindow(StatefulProcessor):
    """A client's open window (start, requests so far) as state, with a timer that drops it once the watermark is past its end."""

    def __init__(self, seconds: int, most: int) -> None:
        self.span, self.most = pd.Timedelta(seconds=seconds), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.window.get() if self.window.exists() else None
        start, n = (pd.Timestamp(found[0], unit="us"), found[1]) if found else (None, 0)
        arrived = pd.concat([*rows]).sort_values(["ts", "event_id"])
        out = []
        for r in arrived.itertuples(index=False):
            if start is None or r.ts >= start + self.span:
                start, n = r.ts, 0
            n += 1
            out.append((r.event_id, key[0], start, n, n > self.most))
        self.window.update((start.value // 1000, n))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((start + self.span).value // 1_000_000))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """The same for a stream with a watermark on ts; needs the RocksDB state store.

    Requests later than the watermark are not seen; a batch's requests of one client are taken in order of time.
    """
    rows = requests.select("event_id", "client", "ts").filter("ts is not null")
    return rows.groupBy("client").transformWithStateInPandas(OpenWindow(seconds, most), RESULT, "Append", "EventTime")
