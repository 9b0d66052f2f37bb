"""Ranking positions, top-k and metrics per impression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def positions(df: DataFrame, score: str, group: str = "impression_id", item: str = "item_id") -> DataFrame:
    """df with rn: place by score, highest first, ties by the smaller id."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), item)))


def top_k(df: DataFrame, score: str, k: int, group: str = "impression_id", item: str = "item_id") -> DataFrame:
    """The first k of each group; tasks cut groups to k before the shuffle."""
    return positions(df, score, group, item).where(F.col("rn") <= k)


def metrics(ranked: DataFrame, k: int = 10, group: str | list[str] = "impression_id", true_total: str | None = None, items: str | None = None) -> DataFrame:
    """hit, recall, ndcg at k and the reciprocal rank over the whole list, per group, of rows with rn and clicked.
    true_total names a column with the number of clicks if the list does not hold them all; items one whose first k values
    come along (shown)."""
    keys = [group] if isinstance(group, str) else group
    inside = F.when(F.col("rn") <= k, F.col("clicked")).otherwise(0)
    total = F.max(true_total) if true_total else F.sum("clicked")
    dcg = F.sum(inside / F.log2(F.col("rn") + 1))
    shown = [F.collect_list(F.when(F.col("rn") <= k, F.col(items))).alias("shown")] if items else []
    out = ranked.groupBy(*keys).agg(
        F.max(inside).cast("double").alias("hit"), F.sum(inside).cast("double").alias("found"), total.cast("long").alias("total"), dcg.alias("dcg"),
        F.coalesce(1 / F.min(F.when(F.col("clicked") == 1, F.col("rn"))), F.lit(0.0)).alias("mrr"), *shown,
    )
    best = F.least("total", F.lit(k)).cast("int")
    ideal = F.when(best > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))).otherwise(0.0)
    return out.select(
        *keys, "hit", F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(0.0).alias("recall"),
        F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), "mrr", "total", *(["shown"] if items else []),
    )


def evaluations(scored: DataFrame, scores: list[str], catalog_size: DataFrame, k: int = 10) -> DataFrame:
    """A row per score (scored_by): macro means of the metrics and the share of the catalog within the first k; catalog_size
    has one row, n. The rows are shuffled once for all scores; what is written is a row per impression and score."""
    rows = scored.select("impression_id", "item_id", "clicked", *scores)
    for i, score in enumerate(scores):
        rows = rows.withColumn(f"__{i}", F.row_number().over(Window.partitionBy("impression_id").orderBy(F.desc(score), "item_id")))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("by"), F.col(f"__{i}").alias("rn")) for i, s in enumerate(scores)]))
    ranked = rows.select("impression_id", "item_id", "clicked", each.alias("x")).select("impression_id", "item_id", "clicked", F.col("x.by").alias("scored_by"), "x.rn")
    per = written(metrics(ranked, k, ["impression_id", "scored_by"], items="item_id"), "metrics")
    means = per.groupBy("scored_by").agg(*[F.avg(m).alias(m) for m in ("hit", "recall", "ndcg", "mrr")], F.count(F.lit(1)).alias("impressions"))
    shown = per.select("scored_by", F.explode("shown").alias("item_id")).groupBy("scored_by").agg(F.countDistinct("item_id").alias("shown"))
    names = scored.sparkSession.createDataFrame([(s,) for s in scores], "scored_by string")
    both = names.join(means, "scored_by", "left").join(shown, "scored_by", "left").crossJoin(F.broadcast(catalog_size))
    share = F.when(F.col("n") > 0, F.coalesce("shown", F.lit(0)) / F.col("n")).otherwise(0.0)
    return both.select("scored_by", "hit", "recall", "ndcg", "mrr", share.alias("coverage"), F.coalesce("impressions", F.lit(0)).alias("impressions"))


def evaluation(scored: DataFrame, score: str, catalog_size: DataFrame, k: int = 10) -> DataFrame:
    """The one row of evaluations for one score."""
    return evaluations(scored, [score], catalog_size, k).drop("scored_by")


def overlap_share(exact: DataFrame, approximate: DataFrame, query: str, item: str, n: int) -> DataFrame:
    """Mean share of each query's n exact neighbours that the approximate ones hold."""
    both = exact.select(query, item).join(approximate.select(query, item), [query, item], "left_semi").groupBy(query).agg(F.count(F.lit(1)).alias("c"))
    per = exact.select(query).distinct().join(both, query, "left").select(query, (F.coalesce("c", F.lit(0)) / n).alias("recall"))
    return per.agg(F.avg("recall").alias("recall"))
