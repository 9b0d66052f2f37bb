"""Checks that raise, each one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import BEHAVIOR_COLUMNS, NEWS_COLUMNS


class SchemaError(ValueError):
    pass


def _columns(df: DataFrame, names) -> None:
    if tuple(df.columns) != tuple(names):
        raise SchemaError(f"columns are {df.columns}, not {list(names)}")


def violations(df: DataFrame, required, unique: str | None = None) -> DataFrame:
    """One row: rows, nulls of each required column, repeats of the unique one."""
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]]
    if unique:
        aggs.append((F.count(unique) - F.countDistinct(unique)).alias(f"repeated_{unique}"))
    return df.agg(*aggs)


def _check(df: DataFrame, required, unique=None) -> DataFrame:
    bad = {k: v for k, v in violations(df, required, unique).first().asDict().items() if k != "rows" and v}
    if bad:
        raise SchemaError(str(bad))
    return df


def valid_news(df: DataFrame) -> DataFrame:
    _columns(df, NEWS_COLUMNS)
    return _check(df, ("news_id", "title"), "news_id")


def valid_behaviors(df: DataFrame) -> DataFrame:
    _columns(df, BEHAVIOR_COLUMNS)
    return _check(df, ("impression_id", "user_id", "time", "impressions"))


def assert_ordered(*splits: DataFrame, time: str = "time") -> None:
    """Each split must end before the next begins."""
    spans = [s.agg(F.min(time), F.max(time)).first() for s in splits]
    for i, (a, b) in enumerate(zip(spans, spans[1:], strict=False)):
        if a[1] is not None and b[0] is not None and a[1] >= b[0]:
            raise ValueError(f"split {i} reaches {a[1]}, split {i + 1} begins at {b[0]}")


def valid_requests(df: DataFrame) -> DataFrame:
    """Flags requests: a user id of a character or more, 1 to 50 candidates (10 if null)."""
    n = F.coalesce("num_candidates", F.lit(10))
    return df.withColumn("num_candidates", n).withColumn("valid", (F.length("user_id") >= 1) & (n > 0) & (n <= 50))


def valid_responses(df: DataFrame) -> DataFrame:
    """Flags responses: a score from 0 to 1 and a rank above 0; null or not-a-number is neither."""
    score = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & (F.col("score") >= 0) & (F.col("score") <= 1)
    return df.withColumn("valid", score & F.coalesce(F.col("rank") > 0, F.lit(False)))


def assert_valid(flagged: DataFrame) -> DataFrame:
    """flagged, as it is; raises with the number of rows that are not valid."""
    bad = flagged.where(~F.coalesce("valid", F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rows break the contract")
    return flagged


def require_runs(runs: DataFrame, names: list[str]) -> DataFrame:
    spark = runs.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "run_name string")
    missing = [r[0] for r in wanted.join(runs, "run_name", "left_anti").collect()]
    if missing:
        raise ValueError(f"runs missing: {missing}")
    return runs
