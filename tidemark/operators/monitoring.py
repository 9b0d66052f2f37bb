"""Quality signals, dashboard ratios, counters and load summaries over tables of served responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, TOP = 500, 10


def quality_snapshot(slots: DataFrame, catalog_size: int, last: int = WINDOW, top: int = TOP) -> DataFrame:
    """One row over recommended slots (seq of the response, item_id, score, category): score_mean, score_p50 and
    score_p90 (sorted[n // 2], sorted[int(.9 n)]) over the last 10 * `last` slots, mean_diversity over the last `last`
    responses, catalog_coverage and top_n_concentration over all; null without data.

    The frames are bounded, so their windows hold at most that many rows; all slots are only counted by item."""
    newest = slots.orderBy(F.desc("seq"), F.desc("item_id")).limit(last * 10)
    place = F.row_number().over(Window.orderBy("score")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    scores = newest.select("score", place.alias("i"), n.alias("n")).agg(
        F.avg("score").alias("score_mean"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("score"))).alias("score_p50"),
        F.max(F.when(F.col("i") == F.floor(F.col("n") * 0.9), F.col("score"))).alias("score_p90"),
    )
    kinds = slots.groupBy("seq").agg(F.countDistinct("category").alias("d")).orderBy(F.desc("seq")).limit(last)
    per_item = slots.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    best = per_item.orderBy(F.desc("c"), "item_id").limit(top).agg(F.sum("c").alias("top"))
    all_ = per_item.agg(F.count(F.lit(1)).alias("items"), F.sum("c").alias("total")).crossJoin(best)
    rates = all_.select(
        F.when(F.lit(catalog_size > 0) & (F.col("total") > 0), F.col("items") / F.lit(catalog_size)).alias("catalog_coverage"), F.try_divide("top", "total").alias("top_n_concentration")
    )
    return scores.crossJoin(kinds.agg(F.avg("d").alias("mean_diversity"))).crossJoin(rates)


def counters(responses: DataFrame) -> DataFrame:
    """One row of counts over responses (outcome 'success' or 'error', latency_seconds, n_items, is_fallback,
    durable_used, recent_used): what a service adds up request by request; errors count as such only."""
    ok = F.col("outcome") == "success"
    return responses.agg(
        F.count_if(ok).alias("success"), F.count_if(~ok).alias("error"), F.coalesce(F.sum(F.when(ok, F.col("latency_seconds"))), F.lit(0.0)).alias("latency_sum"),
        F.count_if(ok & (F.col("n_items") == 0)).alias("empty"), F.count_if(ok & F.col("is_fallback")).alias("fallback"),
        F.count_if(ok & F.col("durable_used")).alias("durable_hit"), F.count_if(ok & ~F.col("durable_used")).alias("durable_miss"),
        F.count_if(ok & F.col("recent_used")).alias("recent_hit"), F.count_if(ok & ~F.col("recent_used")).alias("recent_miss"),
    )


def dashboard(counted: DataFrame) -> DataFrame:
    """Ratios of the counters; null where the denominator is 0."""
    total = F.col("success") + F.col("error")
    return counted.select(
        total.alias("total_requests"), F.try_divide("error", total).alias("error_rate"), (F.try_divide("latency_sum", "success") * 1000).alias("mean_latency_ms"),
        F.try_divide("fallback", total).alias("fallback_rate"), F.try_divide("empty", total).alias("empty_response_rate"),
        F.try_divide("durable_hit", F.col("durable_hit") + F.col("durable_miss")).alias("durable_cache_hit_rate"),
        F.try_divide("recent_hit", F.col("recent_hit") + F.col("recent_miss")).alias("recent_cache_hit_rate"),
    )


def load_summary(requests: DataFrame, elapsed_seconds: float) -> DataFrame:
    """requests, errors, error_rate, throughput, and the 50th, 95th and 99th percentile of the latencies of requests
    without error as sorted[min(int(n p / 100), n - 1)]; requests: latency_ms, failed."""
    from ..functions.ordering import running_total

    good = requests.where(~F.col("failed")).groupBy("latency_ms").agg(F.count(F.lit(1)).alias("c"))
    upto = running_total(good, "latency_ms", "c").crossJoin(F.broadcast(good.agg(F.sum("c").alias("n"))))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("latency_ms")))
    marks = upto.agg(*[at(p).alias(f"p{p}_ms") for p in (50, 95, 99)])
    totals = requests.agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"))
    totals = totals.select("requests", "errors", F.try_divide("errors", "requests").alias("error_rate"), F.try_divide(F.col("requests"), F.lit(float(elapsed_seconds))).alias("throughput"))
    return totals.crossJoin(marks)


def latest_gauges(snapshots: DataFrame, names: list[str], order: str = "seq") -> DataFrame:
    """One row: each gauge's last value that is not null; a snapshot without a value leaves the gauge where it was."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order)))
    return snapshots.agg(*[last(c).alias(c) for c in names])


def loss_checkpoints(losses: DataFrame, every: int = 500) -> DataFrame:
    """(step from 1, loss) -> step, mean_loss: at every `every`-th step the mean of the `every` losses up to it."""
    block = F.ceil(F.col("step") / every) * every
    return losses.groupBy(block.alias("step")).agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n")).where(F.col("n") == every).drop("n")


def exposition(counted: DataFrame, prefix: str = "recommend") -> DataFrame:
    """Counters as lines of the text exposition format: name, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in counted.columns])
    return counted.select(F.explode(pairs).alias("x")).select(F.concat(F.lit(f"{prefix}_"), F.col("x.k"), F.lit("_total "), F.col("x.v").cast("string")).alias("line"))


def dashboard_html(board: DataFrame) -> str:
    """The dashboard's one row as a page; null shows as a dash."""
    row = board.first().asDict()
    cells = "".join(f"<tr><td>{k.replace('_', ' ')}</td><td>{'&mdash;' if v is None else f'{v:.3f}'}</td></tr>" for k, v in row.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Service status</title></head><body><table>{cells}</table></body></html>"
