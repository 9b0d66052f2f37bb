"""Interaction-log views over the star-schema tables, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, category, subcategory, title, abstract (null)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"),
        F.col("p_name").alias("title"), F.lit(None).cast("string").alias("abstract"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (impression, item): impression_id, user_id, time, item_id, clicked. Lines are shuffled once, by their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("r")).repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("r").alias("clicked"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("time"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"), "time", F.col("l_partkey").alias("item_id"), "clicked"
    )


def behaviors(log: DataFrame) -> DataFrame:
    """The encoded form: one row per impression with 'item-clicked' words and the history of earlier clicks (null if none).

    Histories are gathered per user, whose impressions are few; they are built before any join to candidates."""
    shown = log.groupBy("impression_id", "user_id", "time").agg(
        F.array_sort(F.collect_list(F.struct("item_id", "clicked"))).alias("c"),
    )
    seen = Window.partitionBy("user_id").orderBy("time", "impression_id").rowsBetween(Window.unboundedPreceding, -1)
    clicked = F.transform(F.filter("c", lambda x: x["clicked"] == 1), lambda x: x["item_id"].cast("string"))
    past = F.flatten(F.collect_list(clicked).over(seen))
    words = F.array_join(F.transform("c", lambda x: F.concat_ws("-", x["item_id"].cast("string"), x["clicked"].cast("string"))), " ")
    return shown.select(
        "impression_id", "user_id", "time", F.when(F.size(past) > 0, F.array_join(past, " ")).alias("history"), words.alias("impressions")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type (impression, click, skip), user_id, item_id, ts, of the events table."""
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "click").otherwise("skip")
    return table(spark, sf_dir, "events").select(
        "event_id", kind.alias("event_type"), "user_id", F.get_json_object("props", "$.k").alias("item_id"), F.col("ts").cast("timestamp_ntz").alias("ts")
    )
