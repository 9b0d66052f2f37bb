"""Impressions: exploding, splitting, counting, profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def explode_impressions(behaviors: DataFrame) -> DataFrame:
    """One row per candidate: impression_id, user_id, time, pos, item_id, clicked (byte). Words are parted by any white
    space, item and label at the last dash."""
    words = F.split(F.trim("impressions"), r"\s+")
    return behaviors.select("impression_id", "user_id", "time", F.posexplode(words).alias("pos", "w")).select(
        "impression_id", "user_id", "time", "pos", F.regexp_extract("w", "^(.*)-([^-]*)$", 1).alias("item_id"), F.substring_index("w", "-", -1).cast("byte").alias("clicked")
    )


def explode_sql_style(behaviors: DataFrame) -> DataFrame:
    """The other splitter: at single spaces, then the first and second part between dashes."""
    parts = F.split("w", "-")
    return behaviors.select("impression_id", F.explode(F.split("impressions", " ")).alias("w")).select(
        "impression_id", F.get(parts, 0).alias("item_id"), F.get(parts, 1).try_cast("int").alias("clicked")
    )


def ctr_by_category(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """category, impressions, clicks, ctr (4 digits), ctr_rank (by the unrounded ratio). Items meet their category
    after they are counted: the shuffle carries a row per item and task at most, and the join one per item."""
    per_item = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("shown"), F.sum("clicked").alias("clicked"))
    by = per_item.join(catalog.select("item_id", "category"), "item_id").groupBy("category")
    ratio = by.agg(F.sum("shown").alias("impressions"), F.sum("clicked").alias("clicks")).withColumn("r", F.col("clicks") / F.col("impressions"))
    rank = F.rank().over(Window.orderBy(F.desc("r")))  # over one row per category
    return ratio.select("category", "impressions", F.col("clicks").cast("long").alias("clicks"), F.round("r", 4).alias("ctr"), rank.cast("long").alias("ctr_rank"))


def time_split(df: DataFrame, validation_days: int = 1, time: str = "time") -> DataFrame:
    """df with split: 'validation' from midnight of the last day minus (days - 1), else 'train'."""
    last = df.agg(F.date_trunc("DAY", F.max(time)).cast("timestamp_ntz").alias("day"))
    cutoff = last.select((F.col("day") - F.make_dt_interval(F.lit(validation_days - 1))).alias("cutoff"))
    return df.crossJoin(F.broadcast(cutoff)).withColumn("split", F.when(F.col(time) < F.col("cutoff"), "train").otherwise("validation")).drop("cutoff")


def split_report(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("users"), F.min("time").alias("first"), F.max("time").alias("last"))


def popularity(log: DataFrame) -> DataFrame:
    """Clicks of every shown item, 0 included."""
    return log.groupBy("item_id").agg(F.sum("clicked").cast("long").alias("popularity"))


def first_seen(log: DataFrame) -> DataFrame:
    return log.groupBy("item_id").agg(F.min("time").alias("first_seen"))


def item_statistics(log: DataFrame) -> DataFrame:
    """popularity and first_seen from one pass over the log."""
    return log.groupBy("item_id").agg(F.sum("clicked").cast("long").alias("popularity"), F.min("time").alias("first_seen"))


def profile(behaviors: DataFrame) -> DataFrame:
    """One row: counts, repeats, null rate, history lengths."""
    n = F.size(F.filter(F.split(F.coalesce("history", F.lit("")), r"\s+"), lambda w: w != ""))
    return behaviors.withColumn("n", n).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("users"), (F.count("impression_id") - F.countDistinct("impression_id")).alias("repeated_ids"),
        F.round(F.avg(F.col("history").isNull().cast("int")), 4).alias("null_history"), F.min("n").alias("min_history"), F.max("n").alias("max_history"),
        F.round(F.avg("n"), 4).alias("mean_history"), F.percentile("n", F.lit(0.5)).alias("median_history"), F.min("time").alias("first"), F.max("time").alias("last"),
    )


def exposure_share(log: DataFrame) -> DataFrame:
    """Shares of all exposures that the most shown item and the ten most shown have."""
    shown = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    total = shown.agg(F.sum("c").alias("t"))
    top = shown.orderBy(F.desc("c"), "item_id").limit(10)
    return top.crossJoin(F.broadcast(total)).agg(F.round(F.max("c") / F.first("t"), 6).alias("top1_share"), F.round(F.sum("c") / F.first("t"), 6).alias("top10_share"))


def history_ids(column: str = "history") -> F.Column:
    """Null or empty: no ids; else the words."""
    return F.filter(F.split(F.trim(F.coalesce(column, F.lit(""))), r"\s+"), lambda w: w != "")


def last_n(array, n: int = 20) -> F.Column:
    """The last n entries, all if fewer."""
    a = F.col(array) if isinstance(array, str) else array
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def ingest_report(behaviors: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: rows of both tables, null histories, first and last time."""
    b = behaviors.agg(F.count(F.lit(1)).alias("behaviors"), F.count_if(F.col("history").isNull()).alias("null_histories"), F.min("time").alias("first"), F.max("time").alias("last"))
    return b.crossJoin(catalog.agg(F.count(F.lit(1)).alias("items"))).select("behaviors", "items", "null_histories", "first", "last")


def scale_factors(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, ratio (2 digits): rows of the first table over rows of the second, null if that is empty."""
    out = None
    for name, (large, small) in pairs.items():
        both = large.agg(F.count(F.lit(1)).alias("a")).crossJoin(small.agg(F.count(F.lit(1)).alias("b")))
        one = both.select(F.lit(name).alias("name"), F.round(F.try_divide("a", "b"), 2).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out


def ctr_over_files(spark: SparkSession, behaviors: str, news: str) -> DataFrame:
    """category, impressions, clicks, ctr, ctr_rank by one SQL statement over the Parquet files; only the columns that it
    names are read."""
    return spark.sql(
        """WITH shown AS (SELECT explode(split(impressions, ' ')) AS word FROM parquet.`{behaviors}`),
             parts AS (SELECT regexp_extract(word, '^(.*)-[01]$', 1) AS item_id, cast(right(word, 1) AS int) AS clicked FROM shown),
             counts AS (SELECT item_id, count(*) AS impressions, sum(clicked) AS clicks FROM parts GROUP BY item_id),
             rates AS (SELECT category, sum(impressions) AS impressions, sum(clicks) AS clicks FROM counts JOIN parquet.`{news}` AS n ON counts.item_id = cast(n.item_id AS string) GROUP BY category)
           SELECT category, impressions, clicks, round(clicks / impressions, 4) AS ctr, rank() OVER (ORDER BY clicks / impressions DESC) AS ctr_rank FROM rates""".format(behaviors=behaviors, news=news)
    )


def in_list_order(lists: DataFrame, table: DataFrame, key: str, ids: str = "ids", item: str = "item_id") -> DataFrame:
    """lists (key, ids: array) -> key, pos, item, and the columns of table in the order of the list, repeats included. An id
    that the table lacks raises."""
    rows = lists.select(key, F.posexplode(ids).alias("pos", item)).join(table.withColumn("__known", F.lit(True)), item, "left")
    missing = F.raise_error(F.concat(F.lit("not in the table: "), F.col(item).cast("string"))).cast("boolean")
    return rows.where(F.coalesce("__known", missing)).select(key, "pos", item, *[c for c in table.columns if c != item])
