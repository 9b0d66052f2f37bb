"""Archives, ranking frames, fitted models, key-value records, names and addresses."""

from __future__ import annotations

import json
import uuid
import zipfile
from pathlib import Path
from urllib.parse import quote, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespace of deterministic event ids.
NAMESPACE = uuid.UUID("6f1c3f0e-3f3b-5e57-9f2f-6c0c6c1d2a11")
RECORD = "user_id string, recent array<string>, impressions bigint, clicks bigint, last_event_time string"
STALE_SECONDS = 24 * 3600


def extract_checked(archive: str, target: str) -> list[str]:
    """Extracts a ZIP file after checking the sums of all members; a damaged one raises and nothing is written. Driver-side:
    a download, not a table. Members that would leave the target raise as well."""
    with zipfile.ZipFile(archive) as z:
        bad = z.testzip()
        if bad is not None:
            raise ValueError(f"{archive}: {bad} is damaged")
        root = Path(target).resolve()
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{archive}: {name} leaves the target")
        z.extractall(root)
        return z.namelist()


def write_ranking_frame(rows: DataFrame, path: str, split: str) -> None:
    """Feature rows of one split; other splits under path stay."""
    rows.write.mode("overwrite").parquet(f"{path}/split={split}")


def read_ranking_frame(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{path}/split={split}")


def save_click_model(fitted, path: str) -> None:
    """Scales as one JSON line and Spark's own model beside them."""
    scales, model = fitted
    spark = model._java_obj and SparkSession.active()
    spark.createDataFrame([(json.dumps(scales),)], "scales string").coalesce(1).write.mode("overwrite").text(f"{path}/scales")
    model.write().overwrite().save(f"{path}/model")


def load_click_model(spark: SparkSession, path: str):
    from pyspark.ml.classification import LogisticRegressionModel

    scales = json.loads(spark.read.text(f"{path}/scales").first()[0])
    return {k: tuple(v) for k, v in scales.items()}, LogisticRegressionModel.load(f"{path}/model")


def to_records(features: DataFrame) -> DataFrame:
    """key, value: the JSON record of each user's recent features."""
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    return features.select(F.concat(F.lit("recent_features:"), F.col("user_id").cast("string")).alias("key"), F.to_json(F.struct(*names)).alias("value"))


def from_records(records: DataFrame) -> DataFrame:
    return records.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def event_id(*columns: str) -> F.Column:
    """An id in the form of a UUID that follows from the columns, so that a replay gives the same ids."""
    h = F.sha2(F.concat_ws("|", F.lit(str(NAMESPACE)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def with_credentials(url: str, user: str | None, password: str | None) -> str:
    """url with credentials, quoted, in front of its host; as it is if either is missing or it has some already."""
    parts = urlsplit(url)
    if not user or not password or "@" in parts.netloc:
        return url
    return urlunsplit(parts._replace(netloc=f"{quote(user, safe='')}:{quote(password, safe='')}@{parts.netloc}"))


def durable_cache(features: DataFrame, now) -> DataFrame:
    """Durable features stamped with the time of the job that made them."""
    return features.withColumn("built_at", F.lit(now).cast("timestamp_ntz"))


def is_stale(cache: DataFrame, now, seconds: int = STALE_SECONDS) -> DataFrame:
    """One row, stale: older than the limit, or empty."""
    age = F.timestamp_diff("SECOND", F.max("built_at"), F.lit(now).cast("timestamp_ntz"))
    return cache.agg(F.coalesce(age > seconds, F.lit(True)).alias("stale"))


def refreshed(cache: DataFrame, rebuild, now, seconds: int = STALE_SECONDS) -> DataFrame:
    """The cache, or what rebuild() gives, stamped, if it is stale."""
    return durable_cache(rebuild(), now) if is_stale(cache, now, seconds).first()["stale"] else cache
