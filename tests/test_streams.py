"""The episode monitor on a stream: restarts, open episodes and late samples."""

from pyspark.sql import functions as F

from pegwatch.rules import HOUR, Rules
from pegwatch.streaming import live

RULES = Rules(min_run=2, severe=0.5, band_frac=0.5, recovery=2)


def run(spark, tmp_path, slices):
    path, base, out = f"{tmp_path}/in", live.new_base(spark, "test"), None
    for rows in slices:
        spark.createDataFrame([(s, h * HOUR, x, 0.1) for s, h, x in rows], "symbol string, ts long, dev_obs double, theta double").write.mode("append").parquet(path)
        rows = spark.readStream.schema("symbol string, ts long, dev_obs double, theta double").parquet(path).withColumn("time", F.timestamp_seconds("ts"))
        out = live.run_to_table(live.monitor(rows, RULES), "test", base)
    return out


def test_an_episode_spans_restarts_and_an_open_one_comes_out(spark, tmp_path):
    out = run(spark, tmp_path, [[("a", 1, -0.2), ("a", 2, -0.3), ("b", 1, 0.0)], [("a", 3, -0.15), ("a", 4, 0.0), ("b", 2, -0.2)], [("a", 5, 0.0), ("b", 3, -0.4), ("b", 4, -0.12)]])
    closed = [tuple(r) for r in out.filter("kind = 'close'").select("symbol", "t0", "t1", "confirmed_at", "hours_below", "min_dev").collect()]
    assert closed == [("a", HOUR, 3 * HOUR, 2 * HOUR, 3, -0.3)]
    still = [tuple(r) for r in live.open_episodes(out).select("symbol", "t0", "confirmed_at", "hours_below", "min_dev").collect()]
    assert still == [("b", 2 * HOUR, 3 * HOUR, 3, -0.4)]
    assert live.late_samples(out).count() == 0


def test_late_samples_are_counted_and_change_nothing(spark, tmp_path):
    out = run(spark, tmp_path, [[("a", 10, 0.0), ("a", 11, 0.0)], [("a", 5, -0.9), ("a", 11, -0.9), ("a", 12, 0.0), ("a", 12, -0.9)], [("b", 1, 0.0)]])
    assert out.filter("kind in ('confirm', 'open', 'close')").count() == 0
    assert [tuple(r) for r in live.late_samples(out).collect()] == [("a", 3)]
