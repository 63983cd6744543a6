"""Causal variants on streams: fills from a static climatology, horizon scores, outages,
last-value fills and stuck-sensor runs. State is bounded by the number of series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def climatology_fill(stream: DataFrame, climatology: DataFrame, keys: list[str], day: str = "doy") -> DataFrame:
    """Stream-static join: ``value``, or the climatology's ``pred`` of the series and day."""
    static = climatology.select(*keys, day, "pred")
    return stream.join(static, [*keys, day], "left").withColumn("filled", F.coalesce("value", "pred"))


def daily_scores(stream: DataFrame, keys: list[str], truth: str, pred: str, delay: str | None = None) -> DataFrame:
    """n, sum of |error| and of squares by key and day. With ``delay``, for an endless stream that
    appends closed days, rows later than it are dropped; without, for ``run_to_end``, none is."""
    e = F.col(pred) - F.col(truth)
    g = (stream.withWatermark("ts", delay) if delay else stream).groupBy(*keys, F.window("ts", "1 day"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("abs_error"), F.sum(e * e).alias("sq_error")).select(*keys, F.col("window.start").alias("day"), "n", "abs_error", "sq_error")


def activity(stream: DataFrame, keys: list[str], gap: str, delay: str | None = "1 hour") -> DataFrame:
    """Stretches without a pause of ``gap``; between two of them lies an outage. With ``delay``, for an
    endless stream that appends stretches once they are closed; without, for ``run_to_end``, those
    still open at the end of the input are there too."""
    g = (stream.withWatermark("ts", delay) if delay else stream).groupBy(*keys, F.session_window("ts", gap))
    return g.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


def last_value_fill(stream: DataFrame, key: str) -> DataFrame:
    """Each row with the last value seen before it in its series, and that value's age in seconds;
    rows older than the state don't overwrite it."""

    def step(k, frames, state):
        last = state.get if state.exists else (0, float("nan"))
        f, out = pd.concat(list(frames)).sort_values("ts"), []
        for ts, v in zip(f["ts"], f["value"], strict=True):
            us = ts.value // 1000
            known = last[1] == last[1]
            out.append((k[0], ts, v if v == v else None, last[1] if known else None, (us - last[0]) // 1_000_000 if known else None))
            if v == v and us >= last[0]:
                last = (us, float(v))
        state.update(last)
        yield pd.DataFrame(out, columns=["entity", "ts", "value", "previous", "age_seconds"])

    return stream.select(F.col(key).cast("string").alias("entity"), "ts", "value").groupBy("entity").applyInPandasWithState(
        step, "entity string, ts timestamp, value double, previous double, age_seconds long", "us long, value double", "append", GroupStateTimeout.NoTimeout
    )


def stuck_runs(stream: DataFrame, key: str, least: int) -> DataFrame:
    """An alarm row each time a series has shown one value ``least`` times in a row."""

    def step(k, frames, state):
        value, n = state.get if state.exists else (float("nan"), 0)
        out = []
        f = pd.concat(list(frames)).sort_values("ts")
        for ts, v in zip(f["ts"], f["value"], strict=True):
            n = n + 1 if v == value else 1
            value = v
            if n == least:
                out.append((k[0], ts, v, n))
        state.update((float(value), n))
        yield pd.DataFrame(out, columns=["entity", "ts", "value", "run"])

    return stream.select(F.col(key).cast("string").alias("entity"), "ts", "value").groupBy("entity").applyInPandasWithState(
        step, "entity string, ts timestamp, value double, run long", "value double, n long", "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(out: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything available now, into Parquet, once."""
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_to_end(out: DataFrame, sink: str, checkpoint: str) -> str | None:
    """An aggregate of everything available now, groups still open included: its last whole state, as
    Parquet. For sums whose groups (keys by days) are few against the rows; none is ever closed. A
    batch that is run again writes its own folder anew; the last one's is returned, None if there was none."""
    done = []

    def write(batch, i):
        batch.write.mode("overwrite").parquet(f"{sink}/{i}")
        done.append(i)

    out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return f"{sink}/{done[-1]}" if done else None
