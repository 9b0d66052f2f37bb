"""Recommending over a table of requests, falling back, explaining, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import rolling, running_total

#: Least content similarity that counts as evidence.
GROUNDED = 0.05


def popular_fallback(requests: DataFrame, popularity: DataFrame, most: int = 50) -> DataFrame:
    """user_id, rank, item_id, score: the most popular items; the score is over the greatest of the user's own slate."""
    top = popularity.orderBy(F.desc("popularity"), "item_id").limit(most)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("popularity"), "item_id")))
    out = requests.crossJoin(F.broadcast(ranked)).where(F.col("rank") <= F.col("num_candidates"))
    best = F.max("popularity").over(Window.partitionBy("user_id"))
    return out.select("user_id", "rank", "item_id", F.when(best > 0, F.col("popularity") / best).otherwise(0.0).alias("score"))


def explain(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """items (user_id, item_id, category_match, content_similarity) -> with category, abstract (300 characters), refused,
    evidence and explanation. Refused without evidence; an item missing from the catalog raises."""
    rows = items.join(catalog.select("item_id", "category", "abstract", F.lit(True).alias("known")), "item_id", "left")
    missing = F.raise_error(F.concat(F.lit("item missing from the catalog: "), F.col("item_id").cast("string")))
    return explain_known(rows.withColumn("category", F.when(F.coalesce("known", missing.cast("boolean")), F.col("category"))))


def explain_known(rows: DataFrame) -> DataFrame:
    """explain for rows that bring their item's category and abstract."""
    similar = F.col("content_similarity") >= GROUNDED
    match = F.col("category_match")
    clauses = F.array_compact(F.array(
        F.when(match, F.concat(F.lit("it matches your interest in "), F.col("category"))),
        F.when(similar, F.lit("its content closely resembles articles you've read before")),
    ))
    refused = ~(match | similar)
    evidence = F.array_compact(F.array(F.when(match, F.lit("category_match")), F.when(similar, F.lit("content_similarity"))))
    return rows.select(
        "user_id", "item_id", "category", F.substring(F.coalesce("abstract", F.lit("")), 1, 300).alias("abstract"), refused.alias("refused"), evidence.alias("evidence"),
        F.when(refused, "").otherwise(F.concat(F.lit("Recommended because "), F.array_join(clauses, " and "), F.lit("."))).alias("explanation"),
    )


def keep_faithful(explained: DataFrame, rewritten: str) -> DataFrame:
    """Takes the rewritten text where it still names the category that it must, else the template's."""
    lost = F.array_contains("evidence", "category_match") & ~F.contains(F.lower(rewritten), F.lower("category"))
    return explained.withColumn("explanation", F.when(F.col("refused"), "").when(lost, F.col("explanation")).otherwise(F.col(rewritten)))


def explanation_report(explained: DataFrame) -> DataFrame:
    """One row over explained rows (refused, evidence, category, explanation, and template: what the explanation is without
    a rewriting): total, refused, refusal_rate, attempted, faithful, faithfulness_rate, model_used, template_used,
    model_contribution_rate, mean_length, distinct_texts. Rates of what was attempted are null if nothing was."""
    given = ~F.col("refused")
    faithful = ~F.array_contains("evidence", "category_match") | F.contains(F.lower("explanation"), F.lower("category"))
    model = F.col("explanation") != F.col("template")
    out = explained.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("refused").alias("refused"), F.count_if(given & faithful).alias("faithful"), F.count_if(given & model).alias("model_used"),
        F.avg(F.when(given, F.length("explanation"))).alias("mean_length"), F.countDistinct(F.when(given, F.col("explanation"))).alias("distinct_texts"),
    )
    attempted = F.col("total") - F.col("refused")
    share = lambda c: F.when(attempted > 0, F.col(c) / attempted)
    return out.select(
        "total", "refused", F.when(F.col("total") > 0, F.col("refused") / F.col("total")).otherwise(0.0).alias("refusal_rate"), attempted.alias("attempted"), "faithful",
        share("faithful").alias("faithfulness_rate"), "model_used", (attempted - F.col("model_used")).alias("template_used"), share("model_used").alias("model_contribution_rate"), "mean_length", "distinct_texts",
    )


def explanation_statistics(explained: DataFrame) -> DataFrame:
    given = ~F.col("refused")
    faithful = ~F.array_contains("evidence", "category_match") | F.contains(F.lower("explanation"), F.lower("category"))
    return explained.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("refused").cast("int")).alias("refusal_rate"), F.avg(F.when(given, faithful.cast("int"))).alias("faithfulness"),
        F.avg(F.when(given, F.length("explanation"))).alias("mean_length"), F.countDistinct(F.when(given, F.col("explanation"))).alias("distinct_texts"),
    )


def latency_percentiles(samples: DataFrame, value: str) -> DataFrame:
    """The four ways in use: interpolated; sorted[min(int(n p), n - 1)]; sorted[n // 2]; sorted[int(.99 n) - 1].

    Ranks come from counts of distinct values, so no list of all values is gathered."""
    by = samples.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    total = by.agg(F.sum("c").alias("n"))
    upto = running_total(by, value, "c").crossJoin(F.broadcast(total))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))

    def between(p):  # the two ranks around p (n - 1)
        x = (F.col("n") - 1) * p
        return [at(F.floor(x)).alias(f"lo{p}"), at(F.ceil(x)).alias(f"hi{p}")]

    ranks = upto.agg(
        F.first("n").alias("n"), at(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).alias("p95_index"), at(F.floor(F.col("n") / 2)).alias("p50_half"),
        at(F.floor(F.col("n") * 0.99) - 1).alias("p99_before"), *[c for p in (0.5, 0.95, 0.99) for c in between(p)],
    )
    share = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    mid = [(F.col(f"`lo{p}`") + (F.col(f"`hi{p}`") - F.col(f"`lo{p}`")) * share(p)).alias(k) for p, k in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return ranks.select(*mid, "p95_index", "p50_half", "p99_before")


def rolling_quality(responses: DataFrame, last: int = 500) -> DataFrame:
    """Mean of score over each response and the last-1 before it; responses: seq (numeric, distinct), score. Runs in blocks."""
    return rolling(responses, "seq", last, mean_score=F.avg("score"))


def histogram(samples: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of values at or below each bound."""
    row = samples.agg(*[F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.*")


def stage_deltas(runs: DataFrame, stages: list[str], metrics: list[str]) -> DataFrame:
    """Runs in the order of stages with the change of each metric from the stage before, null for the first."""
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    ordered = runs.withColumn("stage_no", F.try_element_at(order, F.col("run_name"))).where("stage_no is not null")
    w = Window.orderBy("stage_no")
    return ordered.select("stage_no", "run_name", *metrics, *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in metrics])
