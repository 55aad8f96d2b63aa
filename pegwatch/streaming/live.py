"""The same rules on streams: hourly prices, an episode monitor and alert sessions.

Jobs run with AvailableNow over files or continuously; state and progress live in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pegwatch.rules import Rules
from pegwatch.session import shared_folder


def run_to_table(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Processes what is there in micro-batches and returns the table written so far. With the ``base`` of an earlier run it
    goes on from that run's state and progress, as after a restart."""
    spark: SparkSession = stream.sparkSession
    base = base or new_base(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/progress")
        .option("path", f"{base}/rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def new_base(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def hourly(samples: DataFrame, late: str = "2 hours") -> DataFrame:
    """Median price and count per asset and hour; rows later than the watermark are dropped."""
    return (
        samples.withWatermark("time", late)
        .groupBy("symbol", F.window("time", "1 hour").alias("w"))
        .agg(F.percentile("price", 0.5).alias("price"), F.count("*").alias("n"))
        .select("symbol", F.unix_seconds("w.start").alias("ts"), "price", "n")
    )


EVENTS = "symbol string, kind string, ts long, t0 long, t1 long, confirmed_at long, hours_below long, min_dev double, n long"
STATE = "last_ts long, run_len long, run_start long, open int, t0 long, confirmed_at long, hours_below long, min_dev double, last_bad long, good long"


def monitor(dev: DataFrame, rules: Rules, late: str = "2 hours") -> DataFrame:
    """The episode rule on a stream, with one small state per asset. Events by ``kind``: ``confirm`` and ``close`` of an episode; ``open`` after
    every batch that leaves one open (``open_episodes`` takes the last); ``late`` with the number ``n`` of samples of a
    batch that came at or before the last one seen for their asset and so were left out.

    ``dev``: symbol, time, ts, dev_obs, theta with known samples only. What a sample means to the rule is decided before the state sees it.
    """
    min_run, recovery = rules.min_run, rules.recovery
    cols = ["symbol", "kind", "ts", "t0", "t1", "confirmed_at", "hours_below", "min_dev", "n"]

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last_ts, run_len, run_start, is_open, t0, conf, below, low, last_bad, good) = (
            state.get if state.exists else (-1, 0, -1, 0, -1, -1, 0, 0.0, -1, 0))
        batch = pd.concat(list(chunks)).sort_values(["ts", "dev_obs"], ascending=[True, False])  # of one time the largest counts
        fresh = batch[(batch["ts"] > last_ts) & ~batch["ts"].duplicated()]
        out = []
        for ts, x, hit, deep, bad in zip(fresh["ts"], fresh["dev_obs"], fresh["hit"], fresh["deep"], fresh["bad"], strict=True):
            last_ts = int(ts)
            if not is_open:
                run_start = (last_ts if run_len == 0 else run_start) if hit else -1
                run_len = run_len + 1 if hit else 0
                if hit and (run_len >= min_run or deep):
                    is_open, t0, conf, below, low, last_bad, good = 1, run_start, last_ts, run_len, float(x), last_ts, 0
                    out.append((key[0], "confirm", last_ts, t0, None, conf, below, low, None))
                continue
            below, low = below + int(hit), min(low, float(x))
            if bad:
                good, last_bad = 0, last_ts
                continue
            good += 1
            if good >= recovery:
                out.append((key[0], "close", last_ts, t0, last_bad, conf, below, low, None))
                is_open, run_len, run_start, good = 0, 0, -1, 0
        if is_open:
            out.append((key[0], "open", last_ts, t0, last_bad, conf, below, low, None))
        if len(fresh) < len(batch):
            out.append((key[0], "late", last_ts, None, None, None, None, None, len(batch) - len(fresh)))
        state.update((last_ts, run_len, run_start, is_open, t0, conf, below, low, last_bad, good))
        if not out:
            return
        frame = pd.DataFrame(out, columns=cols)
        for c in ("ts", "t0", "t1", "confirmed_at", "hours_below", "n"):
            frame[c] = frame[c].astype("Int64")
        yield frame

    x, theta = F.col("dev_obs"), F.col("theta")
    rows = dev.withWatermark("time", late).select(
        "symbol", "ts", "dev_obs", (x <= -theta).alias("hit"), (x <= -rules.severe).alias("deep"), (x <= -theta * rules.band_frac).alias("bad"))
    return rows.groupBy("symbol").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def open_episodes(events: DataFrame) -> DataFrame:
    """Episodes of a monitor's table that are still open: their last state, unless a close follows."""
    last = events.filter("kind in ('open', 'close')").groupBy("symbol", "t0").agg(
        F.max_by(F.struct("kind", "ts", "t1", "confirmed_at", "hours_below", "min_dev"), F.struct("ts", F.col("kind") == "close")).alias("e"))
    return last.filter("e.kind = 'open'").select("symbol", "t0", "e.ts", "e.t1", "e.confirmed_at", "e.hours_below", "e.min_dev")


def late_samples(events: DataFrame) -> DataFrame:
    """Samples left out as late, by asset."""
    return events.filter("kind = 'late'").groupBy("symbol").agg(F.sum("n").alias("late"))


def sessions(alerts: DataFrame, late: str = "2 hours", gap: str = "1 hour") -> DataFrame:
    """Runs of alerted hours per asset as session windows."""
    return (
        alerts.withWatermark("time", late).groupBy("symbol", F.session_window("time", gap).alias("w"))
        .agg(F.count("*").alias("hours"), F.max("y").alias("y"))
        .select("symbol", F.unix_seconds("w.start").alias("start"), "hours", "y")
    )
