"""Streaming operators over an event file stream.

* ``stream_price_locf`` - per-conversation last-price carry across
  micro-batches with ``applyInPandasWithState`` (state = each speaker's last
  price), equal to the batch ``price_locf`` on the same files.
* ``stream_window_stats`` - event-time tumbling windows with a watermark
  (late rows beyond it are dropped by Spark), append mode.
* ``stream_final_outcome``, ``stream_mean_reward`` - per event-time session of
  a conversation.
* ``run_available_now`` - drive a stream to completion into a parquet sink
  in the shared scratch folder and read the result back; ``run_to_end`` also
  closes what is still open at the end of a finite input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.io import scratch_path


def event_stream(spark: SparkSession, sf_dir: str, *, max_files: int = 1) -> DataFrame:
    """The events table as a file stream: one file, or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir}/events.parquet*"))


LOCF_OUT = "conv_id long, event_id long, speaker int, price decimal(12,2), price_filled decimal(12,2)"
LOCF_STATE = "buyer_last decimal(12,2), seller_last decimal(12,2)"


def event_price():
    """The price an event states, as in the batch adapter; NULL on errors."""
    return F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.lit(500.0) + F.col("value") * 10.0).cast("decimal(12,2)")


FORGET_MS = 90 * 24 * 3600 * 1000   # a conversation silent for 90 days starts anew


def _locf_fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = list(state.get) if state.exists else [None, None]
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
    filled = pdf.groupby("speaker")["price"].ffill()
    for speaker in (0, 1):
        own = pdf["speaker"] == speaker
        if last[speaker] is not None:
            filled = filled.where(~own | filled.notna(), last[speaker])
        stated = filled[own].dropna()
        if len(stated):
            last[speaker] = stated.iloc[-1]
    state.update(tuple(last))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(pdf["ts"].max().timestamp() * 1000)) + FORGET_MS)
    yield pd.DataFrame({"conv_id": pdf["conv_id"], "event_id": pdf["event_id"], "speaker": pdf["speaker"],
                        "price": pdf["price"], "price_filled": filled.astype(object).where(filled.notna(), None)})


def stream_price_locf(events: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Event stream -> (conv_id, event_id, speaker, price, price_filled) with
    each speaker's last stated price carried across micro-batches (rows of a
    batch are ordered by (ts, event_id) inside the group).  State is one row
    per conversation and is dropped after FORGET_MS of event-time silence;
    events later than ``delay`` are dropped by Spark."""
    e = events.select(F.col("user_id").alias("conv_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                      (F.col("event_id") % 2).cast("int").alias("speaker"), event_price().alias("price"))
    return e.withWatermark("ts", delay).groupBy("conv_id").applyInPandasWithState(
        _locf_fn, LOCF_OUT, LOCF_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_window_stats(events: DataFrame, *, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Per event-time window and event type: count and mean value; windows
    are emitted once the watermark passes their end (``run_to_end`` gives the
    last ones of a finite input too)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))   # event time must be zoned
    return (e.withWatermark("ts", delay)
            .groupBy(F.window("ts", window).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean_value"))


def run_available_now(df: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Process everything available, write parquet + checkpoint under the
    shared scratch folder, return the written table."""
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"{name}_out"), scratch_path(spark, f"{name}_ckpt")
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


END_OF_TIME = "9000-01-01 00:00:00"   # event time of the marker that ends an input


def with_end(events: DataFrame) -> tuple[DataFrame, str]:
    """(the event stream with a second source beside it, the folder of that source).  The
    folder is empty until ``run_to_end`` puts the end marker there: a row whose only value is
    an event time after all others, which moves the watermark past every open window."""
    spark = events.sparkSession
    marks = scratch_path(spark, "end_marks")
    spark.createDataFrame([], events.schema).write.parquet(marks)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(marks)), marks


def run_to_end(events: DataFrame, operator, name: str) -> DataFrame:
    """``operator(events)`` over a finite event stream, its last windows included: first
    everything available, then the same query, from its checkpoint, with the end
    marker.  The marker's own window stays open, so it gives no row.  Events
    that come afterwards are late: the stream has ended."""
    spark = events.sparkSession
    stream, marks = with_end(events)
    out, ckpt = scratch_path(spark, f"{name}_out"), scratch_path(spark, f"{name}_ckpt")

    def run():
        (operator(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out).awaitTermination())

    run()
    marker = [F.lit(END_OF_TIME).cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
              for f in events.schema.fields]
    spark.range(1).select(*marker).write.mode("append").parquet(marks)
    run()
    return spark.read.parquet(out)


def stream_final_outcome(events: DataFrame, *, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Negotiation outcome per session of a conversation: event-time session
    windows (a new session after ``gap`` of silence) with a watermark; the
    last turn decides (buyer last -> Reject, seller last -> Accept) and its
    integer price is the final price (the batch adapter's price, so stream
    and batch agree).  Sessions are emitted once the watermark passes their
    end; ``run_to_end`` also gives each conversation's last one."""
    e = events.select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                      (F.col("event_id") % 2).cast("int").alias("speaker"),
                      F.floor(event_price()).cast("long").alias("price"))
    last = F.max_by(F.struct("speaker", "price"), F.struct("ts", "event_id"))
    return (e.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap).alias("s"), "conv_id")
            .agg(F.count(F.lit(1)).alias("n"), last.alias("_l"))
            .select("conv_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), "n",
                    F.when(F.col("_l.speaker") == 0, "Reject").otherwise("Accept").alias("outcome"),
                    F.col("_l.price").alias("final_price")))


def stream_mean_reward(events: DataFrame, *, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Mean logged reward (the event's value) and number of samples per session of a
    conversation, as :func:`stream_final_outcome` cuts them."""
    e = events.select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("reward"))
    return (e.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "conv_id")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))
            .select("conv_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), "n", "mean_reward"))
