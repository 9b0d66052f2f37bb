"""Event topics: options of Spark's Kafka connector, reading and writing, and the same over files where it is not installed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.consumer import FIELDS

#: Streams read a topic from its beginning unless a checkpoint says otherwise.
START = "earliest"


def read_options(servers: str, topic: str, group: str | None = None, most: int | None = None) -> dict[str, str]:
    """Options of the source. Offsets are kept in the query's checkpoint and advance after a batch is done, which is what
    committing by hand after processing comes to; `most` bounds a batch."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": START, "failOnDataLoss": "true"}
    if group:
        out["kafka.group.id"] = group
    if most is not None:
        out["maxOffsetsPerTrigger"] = str(most)
    return out


def read_topic(spark: SparkSession, servers: str, topic: str, group: str | None = None, most: int | None = None) -> DataFrame:
    """A stream with the message's value as `value`; needs the connector on the class path."""
    return spark.readStream.format("kafka").options(**read_options(servers, topic, group, most)).load().select("key", "value", "offset", "partition")


def read_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The same stream from files of a JSON message a line, `most` files a batch."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", most) if most is not None else reader).load(path)


def drain(stream: DataFrame, write_batch, checkpoint: str, name: str | None = None) -> None:
    """Consumes all that is there now, in bounded batches, and returns: each batch is processed before its offsets are
    committed, and a restart goes on behind the last committed one."""
    query = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (query.queryName(name) if name else query).start().awaitTermination()


def poll(stream: DataFrame, write_batch, checkpoint: str, most: int | None = None, idle_seconds: float = 5.0, warm_up: int = 5, every: float = 0.5) -> dict:
    """Consumes as messages come and returns {messages, batches}: stops once `most` messages are processed, or none has come
    for idle_seconds after the first, or (warm_up looks, idle_seconds apart) none has come at all.

    A batch's offsets are committed after write_batch is done with it; a batch that the stop interrupts is processed again
    by the next run. `most` is met to a batch, which the source's own bound (read_topic, read_files) keeps small."""
    query = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).start()
    rows: dict[int, int] = {}
    last = began = time.monotonic()
    try:
        while query.isActive:
            before = sum(rows.values())
            rows |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]}
            n, now = sum(rows.values()), time.monotonic()
            last = now if n > before else last
            if most is not None and n >= most or n and now - last >= idle_seconds or not n and now - began >= warm_up * idle_seconds:
                break
            time.sleep(every)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return {"messages": sum(rows.values()), "batches": len(rows)}


def messages(events: DataFrame) -> DataFrame:
    """key (the item, not the user, so that an item's events stay in order) and value (JSON) of each event."""
    return events.select(F.col("item_id").cast("string").alias("key"), F.to_json(F.struct(*[F.col(c) for c in FIELDS])).alias("value"))


def write_topic(events: DataFrame, servers: str, topic: str) -> None:
    """Batch write in the order of the events within each key; the broker creates an absent topic if it is set to."""
    messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_files(events: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """Messages in log order into `files` files, as many batches for read_files with most=1."""
    ordered = events.repartitionByRange(files, *order).sortWithinPartitions(*order)
    messages(ordered).select("value").write.mode("append").text(path)


def write_slices(events: DataFrame, path: str, by: str, slices: int, pause: float = 0.0) -> None:
    """Messages of slice 0, 1, ... (a column) one after another, `pause` seconds apart: a stream that reads the folder meets
    them in this order. The broker's sink does the same with write_topic."""
    for i in range(slices):
        if i and pause:
            time.sleep(pause)
        messages(events.where(F.col(by) == i)).select("value").write.mode("append").text(path)


def topic_command(topic: str, partitions: int = 1, replication: int = 1) -> list[str]:
    """Arguments of the broker's own tool that creates a topic unless it exists."""
    return ["--create", "--if-not-exists", "--topic", topic, "--partitions", str(partitions), "--replication-factor", str(replication)]
