"""Readers and writers of the log's files."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEWS_COLUMNS = ("news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")
BEHAVIOR_COLUMNS = ("impression_id", "user_id", "time", "history", "impressions")
TIME_FORMAT = "M/d/yyyy h:mm:ss a"


def _tsv(spark: SparkSession, path: str, columns) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    # only the empty field is null; quotes wrap fields and are doubled inside them
    return spark.read.csv(path, sep="\t", schema=schema, nullValue="", quote='"', escape='"', mode="FAILFAST")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Header-less tab-separated catalog, all strings; checked on the way."""
    from ..operators.validation import valid_news

    return valid_news(_tsv(spark, path, NEWS_COLUMNS))


def read_behaviors(spark: SparkSession, path: str) -> DataFrame:
    """Header-less tab-separated impressions; a time of another form raises."""
    from ..operators.validation import valid_behaviors

    raw = _tsv(spark, path, BEHAVIOR_COLUMNS)
    typed = raw.select(F.col("impression_id").cast("long").alias("impression_id"), "user_id", F.to_timestamp_ntz("time", F.lit(TIME_FORMAT)).alias("time"), "history", "impressions")
    return valid_behaviors(typed)


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """One directory per split, so that readers of one prune the others."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == name).drop("split")


def load_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of every split is that of the training split: what is new later is unknown to all evaluations."""
    return read_split(spark, f"{root.rstrip('/')}/news", "train")


def load_split(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """A split's behaviors, and the catalog they are evaluated with."""
    return read_split(spark, f"{root.rstrip('/')}/behaviors", name), load_catalog(spark, root)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run log, a JSON object a line: run_name, logged_at, git_commit, params, metrics, notes; blank lines are skipped.

    The maps keep every key; runs_wide makes columns of them. A missing file gives no rows."""
    schema = "run_name string, logged_at string, git_commit string, params map<string,string>, metrics map<string,double>, notes string"
    try:
        lines = spark.read.text(path)
        lines.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def runs_wide(runs: DataFrame, metrics: list[str]) -> DataFrame:
    return runs.select("run_name", "logged_at", *[F.col("metrics").getItem(m).alias(m) for m in metrics])


def append_run(path: str, run_name: str, params: dict, metrics: dict, notes: str = "") -> None:
    """Appends one run with time and commit (null outside of a repository). Driver-side: a log line, not data."""
    got = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    commit = got.stdout.strip() if got.returncode == 0 else None
    row = {"run_name": run_name, "logged_at": datetime.now(UTC).isoformat(), "git_commit": commit, "params": params, "metrics": metrics, "notes": notes}
    with Path(path).open("a") as f:
        f.write(json.dumps(row) + "\n")


def numeric_leaves(report: dict) -> dict:
    """Top-level numbers of a report, without booleans."""
    return {k: v for k, v in report.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def save_latest(features: DataFrame, path: str, version: int, now=None) -> None:
    """Key-value sink: a batch's records become one version of the store, with saved_at. A record replaces the whole of its
    key's earlier one; keys that are absent keep theirs. Nothing that is there is read or rewritten, the version appears
    when Spark commits it, and a batch that is run again puts the same version in the place of its first try."""
    saved = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    features.withColumn("saved_at", saved).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={int(version)}")


def latest(spark: SparkSession, path: str, key: str = "user_id", upto: int | None = None) -> DataFrame:
    """The newest record of each key (of the versions up to `upto`), with version and saved_at. Records are reduced to one
    a key before they are shuffled, so a key that was written often costs no more than another."""
    store = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(path)
    store = store if upto is None else store.where(F.col("version") <= upto)
    others = [F.col(f"`{c}`") for c in store.columns if c != key]
    return store.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("__r")).select(key, "__r.*")


def compact(spark: SparkSession, path: str, to: str, key: str = "user_id", ttl_seconds: int | None = None, now=None) -> None:
    """The newest records of a store as the first version of another, without those whose time to live is over."""
    rows = alive(latest(spark, path, key), ttl_seconds, now).drop("version")
    rows.write.mode("overwrite").parquet(f"{to.rstrip('/')}/version=0")


def alive(store: DataFrame, ttl_seconds: int | None, now=None) -> DataFrame:
    """The records that were saved at most ttl_seconds before now; all without a time to live."""
    if ttl_seconds is None:
        return store
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return store.where(F.unix_micros(at) - F.unix_micros("saved_at") <= ttl_seconds * 1_000_000)


def lookup(store: DataFrame, keys: DataFrame, key: str = "user_id", ttl_seconds: int | None = None, now=None) -> DataFrame:
    """Left join of keys to the newest records (latest); those whose time to live is over are absent like unknown ones."""
    return keys.join(alive(store, ttl_seconds, now), key, "left")
