"""Audio as a table of frames (path, channel, frame_idx, rms, n, n_quiet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def speech_activity(frames: DataFrame, prompt_frames: int = 0, least_rms: float = 0.01) -> DataFrame:
    """Share of speech frames per recording and channel after the prompt, with why there is none: too short or not stereo."""
    late = F.col("frame_idx") >= prompt_frames
    by = frames.groupBy("path").agg(
        F.count_distinct("channel").alias("channels"), F.count_if(late).alias("late"),
        *(F.avg(F.when(late & (F.col("channel") == c), (F.col("rms") > least_rms).cast("int"))).alias(f"share_{c}") for c in (0, 1)),
    )
    why = F.when(F.col("channels") != 2, "not stereo").when(F.col("late") == 0, "too short")
    return by.select("path", F.when(why.isNull(), F.col("share_0")).alias("share_0"), F.when(why.isNull(), F.col("share_1")).alias("share_1"), why.alias("reason"))


def silence_ratio(frames: DataFrame) -> DataFrame:
    """Share of quiet samples per recording."""
    return frames.groupBy("path").agg((F.sum("n_quiet") / F.sum("n")).alias("silence_ratio"))


def decibels(frames: DataFrame) -> DataFrame:
    return frames.withColumn("db", 20 * F.log10(F.sqrt(F.col("rms") * F.col("rms") + 1e-10)))


def cutoffs(frames: DataFrame, drop_db: float = -18.0, over_db: float = 6.0, history: int = 30) -> DataFrame:
    """Frames that fall by 18 dB or more from a frame 6 dB over the quiet tenth of the last 30 frames (this one included, the first frame of all not)."""
    order = Window.partitionBy("path", "channel").orderBy("frame_idx")
    d = decibels(frames).withColumn("last", F.lag("db").over(order)).withColumn("pos", F.row_number().over(order))
    late = F.when(F.col("pos") > 1, F.col("db"))
    d = d.withColumn("quiet", F.percentile(late, F.lit(0.1)).over(order.rowsBetween(-(history - 1), 0)))
    return d.where((F.col("db") - F.col("last") <= drop_db) & (F.col("last") >= F.col("quiet") + over_db)).select("path", "channel", "frame_idx", "db", "last")


def loudness(frames: DataFrame) -> DataFrame:
    """Mean and sample deviation of decibels per recording and channel."""
    return decibels(frames).groupBy("path", "channel").agg(F.avg("db").alias("mean_db"), F.stddev_samp("db").alias("std_db"))


def speech_start(frames: DataFrame, frame_seconds: float = 0.25, least_rms: float = 0.01) -> DataFrame:
    """Seconds of the frame before the first speech frame, else 0."""
    first = F.min(F.when(F.col("rms") > least_rms, F.col("frame_idx")))
    return frames.groupBy("path", "channel").agg((F.greatest(F.coalesce(first - 1, F.lit(0)), F.lit(0)) * frame_seconds).alias("start"))
