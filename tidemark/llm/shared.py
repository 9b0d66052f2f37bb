"""Helpers that the corpus operators share: scratch tables, words, hashes, joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters (space and \x09-\x0D).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes up to which a keyed side table may be broadcast; beyond them the join is shuffled.
BROADCAST_BYTES = 8 << 20

_LOCAL: dict[str, str] = {}
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
        base = _LOCAL[app]
    return base.rstrip("/")


class Scratch:
    """Tables written in the shared folder, so that a lost executor costs no earlier step."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)

    def settle(self, *names: str) -> None:
        """Drops tables, and lets Spark remove the shuffle files of finished steps, which else wait for the driver's garbage:
        a first collection finds the plans, a second the shuffles that they held."""
        self.drop(*names)
        gc.collect()
        for _ in range(2):
            self.spark._jvm.System.gc()
            time.sleep(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table) with a broadcast hint if its rows take at most `limit` bytes, else as it is, for a shuffled join."""
    size = F.lit(16)
    for f in df.schema:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        wide = F.octet_length(col) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(col))) if kind in ("array", "map", "struct") else F.lit(0)
        size = size + 16 + F.coalesce(wide.cast("long"), F.lit(0))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def lean(run, keep: bool = False):
    """run (batches -> batches) for workers that serve one task after another: frees first what encoding tasks keep from
    task to task (unless keep), and gives freed buffers back to the system when the task ends."""

    def wrapped(batches):
        held = sys.modules.get("_tidemark_worker")
        if held is not None and not keep:
            held.__dict__.pop("encoders", None)
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Gives freed buffers of a worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Arrow batches of so many rows for what is executed inside: whole texts of the usual 10,000 take much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def one_row_reads(spark: SparkSession):
    """Parquet and Arrow batches of few rows for what is executed inside: rows that hold megabytes each."""
    new = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "250"}
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class WordHash(dict):
    """64-bit hashes of words; emptied when it has grown beyond its bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def blobs(batch: pa.RecordBatch, name: str) -> list:
    """A string column as bytes (UTF-8), nulls as None."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case. bytes.lower and bytes.split touch ASCII only, as WORD and the contracts do."""
    return text.lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes], k: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    span = min(k, n)
    h = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        h = mix(h * _M1 + w[i : n - span + 1 + i])
    return np.unique(h)
