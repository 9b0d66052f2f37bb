"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a local folder only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df as a table that was written and is read again, so that what follows neither recomputes it nor keeps its plan."""
    path = scratch_path(df.sparkSession, name)
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
