"""User and item features, click model, factors, calibration, negative sampling."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles, numbered, running_total
from ..sources.scratch import written
from .factors import truncated_svd
from .vectors import BATCH_BYTES, arrow_batches


def dominant_category(histories: DataFrame, catalog: DataFrame, key: str = "user_id") -> DataFrame:
    """key, dominant_category: most frequent category of known ids (key, item_id), ties to the smallest; else absent."""
    return histories.join(catalog.select("item_id", "category"), "item_id").groupBy(key).agg(F.mode("category", True).alias("dominant_category"))


def latest_history(behaviors: DataFrame) -> DataFrame:
    """user_id, history: the last that is not null by (time, impression_id); users without any have null."""
    last = F.max(F.when(F.col("history").isNotNull(), F.struct("time", "impression_id", "history")))
    return behaviors.groupBy("user_id").agg(last["history"].alias("history"))


def durable_features(behaviors: DataFrame, catalog: DataFrame) -> DataFrame:
    """user_id, dominant_category (null without known clicks), lifetime_click_count."""
    from .log import history_ids

    last = latest_history(behaviors).withColumn("ids", history_ids())
    ids = last.select("user_id", F.explode("ids").alias("item_id"))
    return last.select("user_id", F.size("ids").alias("lifetime_click_count")).join(dominant_category(ids, catalog), "user_id", "left").select("user_id", "dominant_category", "lifetime_click_count")


def online_lookup(users: DataFrame, durable: DataFrame, recent: DataFrame, use_recent: bool = True) -> DataFrame:
    """Two left joins and flags for what is missing; use_recent=False makes every recent lookup a miss."""
    recent = recent.withColumn("_r", F.lit(True)).where(F.lit(use_recent))
    out = users.join(durable.withColumn("_d", F.lit(True)), "user_id", "left").join(recent, "user_id", "left")
    return out.withColumns({"durable_missing": F.col("_d").isNull(), "recent_missing": F.col("_r").isNull()}).drop("_d", "_r")


def ranking_rows(log: DataFrame, histories: DataFrame, catalog: DataFrame, item_stats: DataFrame, item_similarity: DataFrame, retrieval: DataFrame) -> DataFrame:
    """The six features of each candidate. histories: impression_id, item_id, one row per earlier click; the history is
    reduced to a row per impression before candidates join it."""
    lengths = histories.groupBy("impression_id").agg(F.count(F.lit(1)).cast("int").alias("user_history_length"))
    dominant = dominant_category(histories, catalog, "impression_id")
    rows = log.join(lengths, "impression_id", "left").join(dominant, "impression_id", "left")
    rows = rows.join(catalog.select("item_id", "category"), "item_id", "left").join(item_stats.select("item_id", "popularity"), "item_id", "left")
    rows = rows.join(item_similarity, ["impression_id", "item_id"], "left").join(retrieval, ["impression_id", "item_id"], "left")
    known = F.coalesce(F.col("category"), F.raise_error(F.concat(F.lit("candidate missing from the catalog: "), F.col("item_id").cast("string"))))
    return rows.select(
        "impression_id", "item_id", "clicked", F.coalesce("retrieval_score", F.lit(0.0)).alias("retrieval_score"), F.log1p(F.coalesce("popularity", F.lit(0))).alias("popularity"),
        F.when(known == F.col("dominant_category"), 1.0).otherwise(0.0).alias("category_match"), F.coalesce("similarity", F.lit(0.0)).alias("content_similarity"),
        F.coalesce("user_history_length", F.lit(0)).alias("user_history_length"), F.hour("time").alias("hour_of_day"),
    )


def fit_click_model(rows: DataFrame, columns: list[str], label: str = "clicked", c: float = 1.0):
    """L2 logistic regression on columns scaled by their population deviation (constant: 1); gives (scales, model).
    A penalty of ||w||^2 / 2 against the summed loss is regParam = 1 / (c n) against the mean loss."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in columns], *[F.stddev_pop(x).alias(f"s_{x}") for x in columns]).first()
    scales = {x: (stats[f"m_{x}"], stats[f"s_{x}"] or 1.0) for x in columns}
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * stats["n"]), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9)
    return scales, model.fit(_scaled(rows, scales).withColumn(label, F.col(label).cast("double")))


def _scaled(rows: DataFrame, scales: dict) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.array(*[((F.col(x).cast("double") - m) / s) for x, (m, s) in scales.items()])))


def click_probability(rows: DataFrame, fitted) -> DataFrame:
    scales, model = fitted
    out = model.transform(_scaled(rows, scales))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def log_loss_auc(scored: DataFrame, label: str = "clicked", p: str = "p") -> DataFrame:
    """log_loss, auc (mean ranks of tied scores): scores are counted first, then ranked in parts."""
    eps = 1e-15
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = scored.agg(F.avg(-(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q))).alias("log_loss"))
    by = scored.groupBy(p).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    auc = running_total(by, p, "neg", "below").withColumn("below", F.col("below") - F.col("neg")).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    return loss.crossJoin(auc)


def calibration_bins(scored: DataFrame, n: int = 10, label: str = "clicked", p: str = "p") -> DataFrame:
    """bin, mean_predicted, observed, n of equal-frequency bins, right-closed; equal edges are one, empty bins vanish."""
    counts = scored.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.sum(label).alias("positive"))
    return calibration_bins_of_counts(written(counts, "counts"), n, p)


def calibration_bins_of_counts(counts: DataFrame, n: int = 10, p: str = "p") -> DataFrame:
    """calibration_bins of rows counted by score: p, n, labelled (rows with a label), positive (their labels' sum); a score may
    have several rows. Edges and means come from the counts, so what is scored is read once."""
    edges = exact_quantiles(counts, p, [i / n for i in range(n + 1)], "n").select(F.array_distinct("quantiles").alias("edges"))
    b = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(p))) - 1, F.lit(0))
    mean = F.sum(F.col(p) * F.col("n")) / F.nullif(F.sum(F.when(F.col(p).isNotNull(), F.col("n"))), F.lit(0))
    return counts.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(mean.alias("mean_predicted"), (F.sum("positive") / F.nullif(F.sum("labelled"), F.lit(0))).alias("observed"), F.sum("n").alias("n"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r: Pearson's correlation of every two columns, x <= y in their order, rounded to 4 places; null where one
    doesn't vary. One pass with a sum per pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    typed = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    one = typed.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    r = lambda i, a, b: F.round(F.col(f"c{i}") / F.nullif(F.col(f"s_{a}") * F.col(f"s_{b}"), F.lit(0.0)), 4)
    each = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r(i, a, b).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(each).alias("c")).select("c.*")


def column_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean, std (population), low, high."""
    one = rows.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop, F.min, F.max)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{c}").alias(k) for f, k in (("avg", "mean"), ("stddev_pop", "std"), ("min", "low"), ("max", "high"))]) for c in columns])
    return one.select(F.explode(each).alias("c")).select("c.*")


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def collaborative_factors(clicks: DataFrame, k: int = 20):
    """Truncated SVD of the user x item click counts (duplicates add up): (user_id, u = U S), (item_id, v)."""
    counts = clicks.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    u, v, _ = truncated_svd(counts, "user_id", "item_id", "n", k)
    with arrow_batches(clicks.sparkSession, BATCH_BYTES):
        return written(u, "u"), written(v, "v")


def collaborative_scores(log: DataFrame, u: DataFrame, v: DataFrame, popularity: DataFrame) -> DataFrame:
    """log with score and fallback: unknown users are ranked by popularity, unknown items come last (-inf). A candidate
    carries its user's vector to its item in single precision."""
    from .vectors import dot

    out = log.join(u.select("user_id", F.col("u").cast("array<float>").alias("u")), "user_id", "left").join(v, "item_id", "left").join(popularity, "item_id", "left")
    score = F.when(F.col("u").isNull(), F.coalesce("popularity", F.lit(0)).cast("double")).when(F.col("v").isNull(), F.lit(float("-inf"))).otherwise(dot("u", "v"))
    return out.select(*log.columns, score.alias("score"), F.col("u").isNull().alias("fallback"))


def sample_negatives(positives: DataFrame, catalog: DataFrame, clicked: DataFrame, n: int = 4, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """positives (user_id, item_id, and what keep names) with n negatives each, uniform over the catalog with replacement, never the positive
    nor one that the user clicked; a user who clicked all of the catalog gets none.

    The k-th free item of a user is found without listing the free ones: the user's taken places, sorted, are shifted by
    their own rank, and a draw among the free places moves past as many of them as it reaches. So every draw counts,
    however much of the catalog the user clicked; taken places and draws are put in order together, once a user. Draws are
    hashes of (user, item, number, seed), so reruns agree."""
    numbers = numbered(catalog.select("item_id").distinct(), "item_id")
    size = catalog.agg(F.countDistinct("item_id").alias("size"))
    taken = clicked.select("user_id", "item_id").unionByName(positives.select("user_id", "item_id")).distinct()
    own = Window.partitionBy("user_id").orderBy("place")
    taken = taken.join(numbers, "item_id").select("user_id", (F.col("place") - F.row_number().over(own) + 1).alias("at"))
    held = taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("own"))
    draws = positives.join(held, "user_id", "left").crossJoin(F.broadcast(size)).withColumn("free", F.col("size") - F.coalesce("own", F.lit(0))).where("free > 0")
    draws = draws.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draw = F.pmod(F.xxhash64(*keep, "user_id", "item_id", "t", F.lit(seed)), F.col("free"))
    both = draws.select("user_id", draw.alias("at"), F.struct(*keep, "item_id").alias("of")).unionByName(taken.select("user_id", "at"), allowMissingColumns=True)
    order = Window.partitionBy("user_id").orderBy("at", F.col("of").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("place", F.col("at") + F.count_if(F.col("of").isNull()).over(order)).where("of is not null")
    out = placed.join(numbers.withColumnRenamed("item_id", "negative_id"), "place")
    return out.select(*[F.col(f"of.{c}").alias(c) for c in keep], "user_id", F.col("of.item_id").alias("item_id"), "negative_id")
