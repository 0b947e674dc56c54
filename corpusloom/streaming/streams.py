"""Windows over event streams; the same functions take a batch table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events of each type in fixed windows; a stream drops rows later than `late`."""
    events = events.withWatermark("ts", late) if late else events
    counted = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    counted = events.groupBy(F.window("ts", width, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "user_id", "n")


def rate_limited(events: DataFrame, client: str, width: str, limit: int, late: str | None = None) -> DataFrame:
    """(client, start, n, refused): requests of a client (named by a hash) in fixed windows, and those beyond the limit."""
    events = events.withWatermark("ts", late) if late else events
    name = F.substring(F.sha2(F.col(client).cast("string"), 256), 1, 16)
    counted = events.groupBy(F.window("ts", width).alias("w"), name.alias("client")).agg(F.count("*").alias("n"))
    return counted.select("client", F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("refused"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of a user without a pause of `gap`."""
    events = events.withWatermark("ts", late) if late else events
    counted = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")


def first_of_key(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """A stream without repeats of a key inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def anti_join_batches(stream: DataFrame, known_path: str, key: str, checkpoint: str):
    """A running query that appends each micro-batch's unknown keys to a Parquet table; a replayed batch adds nothing."""

    def step(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(known_path).select(key), key, "left_anti")
        except Exception as error:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
        fresh.write.mode("append").parquet(known_path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
