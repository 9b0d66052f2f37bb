"""Vector search: exact inner-product neighbours and cell-pruned ones."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Bytes of pairs of blocks that a Python worker is handed at once: two or three pairs of 2,048 vectors of 64 numbers.
BATCH_BYTES = 4 << 20
#: Tasks that an exact search is dealt to at least, where its blocks allow; found pairs that a task keeps before it cuts them.
TASKS, PAIRS = 64, 1 << 18


@contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """While it lasts, an Arrow batch for Python workers ends once it has `size` bytes, not 64 MB: a worker holds two of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> F.Column:
    return F.sqrt(dot(a, a))


def _blocks(df: DataFrame, key: str, vector: str, size: int, by: str | None = None) -> DataFrame:
    """Blocks of about `size` rows by a hash of the key: keys, flat (the vectors one after another), block (its number). With
    by, each of its values has blocks of its own, as many as its rows need, and no numbers."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), *([by] if by else [])).where("k is not null and v is not null")
    return _gathered(rows, "k", key, size, by)


def _gathered(rows: DataFrame, hashed: str, key: str, size: int, by: str | None) -> DataFrame:
    if by:
        counts = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        rows = rows.join(F.broadcast(counts), by)  # a row per cell
        block = [by, F.pmod(F.xxhash64(hashed), F.col("parts")).alias("block")]
    else:
        block = [F.pmod(F.xxhash64(hashed), F.lit(-(-rows.count() // size) or 1)).alias("block")]
    lists = rows.groupBy(*block).agg(F.collect_list(F.struct("k", F.col("v").cast("array<double>").alias("v"))).alias("x"))
    keys, flat = F.transform("x", lambda e: e["k"]).alias(f"{key}_keys"), F.flatten(F.transform("x", lambda e: e["v"])).alias(f"{key}_flat")
    return lists.select(by, keys, flat) if by else lists.select(keys, flat, F.col("block").cast("int").alias("block"))


def shared(items: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """k (the n smallest ids that share a vector, in order), v, and by: a row per distinct vector, written. Items with the same
    vector score alike, so a search for n needs no more of them; tasks cut the ids to n before they meet."""
    keys = [*([by] if by else []), "v"]
    rows = items.select("item_id", *keys).where("item_id is not null and v is not null")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("item_id"))).where(F.col("rn") <= n)
    return written(first.groupBy(*keys).agg(F.array_sort(F.collect_list("item_id")).alias("k")).select("k", *keys), "shared")


def _item_blocks(items: DataFrame, n: int, size: int, by: str | None = None) -> DataFrame:
    return _gathered(shared(items, n, by), "k", "item_id", size, by)


class Shelf:
    """Vectors in an array, each with the ids that share it; best gives a query's n best ids."""

    def __init__(self, ids: pa.ListArray, v: np.ndarray):
        self.v, self.lengths = v, ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts, flat = np.cumsum(self.lengths) - self.lengths, ids.flatten()
        self.ids = flat.to_numpy(zero_copy_only=False)
        if not np.issubdtype(self.ids.dtype, np.integer):  # places in the order of the ids stand for them
            self.names = np.array(sorted(self.ids.tolist()), dtype=object)
            at = {x: i for i, x in enumerate(self.names)}
            self.ids = np.array([at[x] for x in self.ids], np.int64)
        else:
            self.names = None

    def best(self, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the n best, by score and then id, where score has one entry per vector."""
        edge = np.partition(score, len(score) - n)[len(score) - n] if n < len(score) else -np.inf
        at = np.flatnonzero(score >= edge)
        at = at[np.argsort(-score[at], kind="stable")]
        enough = int(np.searchsorted(np.cumsum(self.lengths[at]), n))
        if enough < len(at):
            at = at[score[at] >= score[at[enough]]]
        n_of = self.lengths[at]
        ends = np.cumsum(n_of)
        ids = self.ids[np.repeat(self.starts[at] - (ends - n_of), n_of) + np.arange(ends[-1] if len(ends) else 0)]
        scores = np.repeat(score[at], n_of)
        order = np.lexsort((ids, -scores))[:n]
        return ids[order], scores[order]

    def named(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.names is None else self.names[ids]

    def search(self, queries: np.ndarray, n: int):
        """best of each query; what queries of zeros get is found once."""
        none = None
        for a in range(0, len(queries), 256):
            part = queries[a : a + 256]
            for score, any_ in zip(part @ self.v.T, part.any(axis=1), strict=True):
                if any_:
                    yield self.best(score, n)
                else:
                    none = none or self.best(np.zeros(len(self.v)), n)
                    yield none


class _Running:
    """The n best of each query of a block over all the blocks of items that it meets, by score and then id."""

    def __init__(self, names: pa.Array, q: np.ndarray, n: int):
        some = q.any(axis=1)
        self.n, self.q, self.names, self.zeros = n, q[some], names.filter(pa.array(some)), names.filter(pa.array(~some))
        self.edge, self.first = np.full(len(self.q), -np.inf), np.zeros(0, np.int64)  # what a score must reach; the ids that zeros get
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def meet(self, shelf: Shelf) -> None:
        if len(self.zeros):
            self.first = np.sort(np.concatenate([self.first, shelf.ids]))[: self.n]
        for a in range(0, len(self.q), 256):
            score = self.q[a : a + 256] @ shelf.v.T
            edge, open_ = self.edge[a : a + 256], np.isneginf(self.edge[a : a + 256])
            if open_.any() and self.n < score.shape[1]:
                edge[open_] = np.partition(score[open_], score.shape[1] - self.n, axis=1)[:, score.shape[1] - self.n]
            row, at = np.nonzero(score >= edge[:, None])
            k = shelf.lengths[at]
            ends = np.cumsum(k)
            ids = shelf.ids[np.repeat(shelf.starts[at] - (ends - k), k) + np.arange(ends[-1] if len(ends) else 0)]
            self.held.append((np.repeat(row + a, k), ids, np.repeat(score[row, at], k)))
            if sum(len(x[0]) for x in self.held[1:]) > PAIRS:
                self.cut()

    def cut(self) -> None:
        who, ids, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, who))
        n_of = np.bincount(who, minlength=len(self.q))
        order = order[np.arange(len(who)) - np.repeat(np.cumsum(n_of) - n_of, n_of) < self.n]
        self.held = [(who[order], ids[order], score[order])]
        ends = np.cumsum(np.minimum(n_of, self.n))
        full = n_of >= self.n
        self.edge[full] = self.held[0][2][ends[full] - 1]

    def rows(self, types):
        self.cut()
        who, ids, score = self.held[0]
        for a in range(0, len(who), 100_000):
            s = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(who[s])), pa.array(ids[s], types[1]), pa.array(score[s], types[2])], ["query_id", "item_id", "score"])
        some = max(1, 100_000 // max(len(self.first), 1))
        for a in range(0, len(self.zeros), some):
            names = self.zeros.slice(a, some)
            who = names.take(pa.array(np.repeat(np.arange(len(names)), len(self.first))))
            yield pa.RecordBatch.from_arrays([who, pa.array(np.tile(self.first, len(names)), types[1]), pa.array(np.zeros(len(who)), types[2])], ["query_id", "item_id", "score"])


def _best(both: DataFrame, n: int, kinds: tuple[str, str]) -> DataFrame:
    """query_id, item_id, score, rn of pairs of blocks: a task multiplies two blocks and keeps n per query of the product;
    where the blocks of queries are numbered, n per query of all the products that it makes.
    Written at once, for the size of the batches counts when they are made; what is written is n rows per query."""
    numbers = "block" in both.columns and kinds[1] in ("tinyint", "smallint", "int", "bigint")

    def running(batches):
        found, types = {}, None
        for batch in batches:
            types = batch.column(2).type.value_type, batch.column(0).type.value_type.value_type, pa.float64()
            for i in range(batch.num_rows):
                ids, flat, names, q = (batch.column(c)[i].values for c in range(4))
                v, q = (x.to_numpy().reshape(k, -1) for x, k in ((flat, len(ids)), (q, len(names))))
                block = batch.column(4)[i].as_py()
                if block not in found:
                    found[block] = _Running(pa.concat_arrays([names]), q.copy(), n)
                found[block].meet(Shelf(ids, v))
        for x in found.values():
            yield from x.rows(types)

    def run(batches):
        for batch in batches:
            types = batch.column(2).type.value_type, batch.column(0).type.value_type.value_type, pa.float64()
            for i in range(batch.num_rows):
                ids, flat, names, q = (batch.column(c)[i].values for c in range(4))
                v, q = (x.to_numpy().reshape(k, -1) for x, k in ((flat, len(ids)), (q, len(names))))
                shelf = Shelf(ids, v)
                got = list(shelf.search(q, n))
                if got:
                    found = [np.concatenate(x) for x in zip(*got)]
                    who = names.take(pa.array(np.repeat(np.arange(len(names)), [len(x) for x, _ in got])))
                    yield pa.RecordBatch.from_arrays([who, pa.array(shelf.named(found[0]), types[1]), pa.array(found[1], types[2])], ["query_id", "item_id", "score"])

    pairs = both.mapInArrow(running if numbers else run, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    with arrow_batches(both.sparkSession, BATCH_BYTES):
        return written(pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n), "best")


def _kinds(queries: DataFrame, items: DataFrame) -> tuple[str, str]:
    return queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()


def exact_top_n(queries: DataFrame, items: DataFrame, n: int, size: int = 2048) -> DataFrame:
    """query_id, item_id, score, rn: the n greatest inner products of each query (query_id, q) among items (item_id, v).

    The stated query set meets all distinct vectors block by block. Neither side is broadcast or gathered. A block of queries lies
    in as many tasks as TASKS asks for, in one where there are many blocks, and the items' blocks pass it, read from where they
    were written; so n rows per query and task are shuffled, however many items there are. Ties go to the smaller id, null vectors
    are left out."""
    asked = written(_blocks(queries, "query_id", "q", size), "asked")
    blocks = written(_item_blocks(items, n, size).drop("block"), "blocks")
    parts = max(asked.count(), 1)
    wide = max(1, min(blocks.count(), -(-TASKS // parts)))
    passed = blocks.repartition(wide) if wide > 1 else blocks.coalesce(1)
    return _best(passed.crossJoin(asked.repartitionById(parts, "block").hint("shuffle_replicate_nl")), n, _kinds(queries, items))


def build_cells(items: DataFrame, cells: int, seed: int = 7, sample: int = 50_000):
    """k-means over at most `sample` items (those with the least hash of their id); all items get a cell."""
    some = items.orderBy(F.xxhash64("item_id")).limit(sample).select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(some)
    found = model.clusterCenters()
    # a table of Arrow, for rows would start Python workers that then stay idle beside those of the search
    centres = items.sparkSession.createDataFrame(pa.table({"cell": pa.array(range(len(found)), pa.int32()), "centre": pa.array([c.tolist() for c in found], pa.list_(pa.float64()))}))
    indexed = model.transform(items.withColumn("features", array_to_vector("v"))).select("item_id", "v", F.col("prediction").alias("cell"))
    return indexed, centres


def save_index(indexed: DataFrame, centres: DataFrame, path: str) -> None:
    """The index as an artefact: items in a folder per cell, and the centres."""
    indexed.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    centres.write.mode("overwrite").parquet(f"{path}/centres")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/centres")


def _probed(queries: DataFrame, centres: DataFrame, probes: int) -> DataFrame:
    near = exact_top_n(queries, centres.select(F.col("cell").alias("item_id"), F.col("centre").alias("v")), probes)
    return near.select("query_id", F.col("item_id").alias("cell"))


def cell_top_n(queries: DataFrame, indexed: DataFrame, centres: DataFrame, n: int, probes: int, size: int = 2048) -> DataFrame:
    """As exact_top_n, but a query meets only the items of the `probes` cells whose centres it scores best. Blocks of a
    cell's items meet blocks of the queries that probe it, so neither a large cell nor a popular one lies in one task."""
    to = queries.join(_probed(queries, centres, probes), "query_id")
    both = _item_blocks(indexed, n, size, "cell").join(_blocks(to, "query_id", "q", size, "cell"), "cell").drop("cell")
    return _best(both, n, _kinds(queries, indexed))


def pruned_top_n(queries: DataFrame, indexed: DataFrame, centres: DataFrame, n: int, probes: int = 2, size: int = 2048) -> DataFrame:
    """As exact_top_n, and as exact, but without the pairs that cannot matter: a first search of `probes` cells gives each
    query a score that its n-th best must reach; a cell whose bound (the product with its centre, plus the query's length
    times the cell's radius) stays below it is left out. A query that found fewer than n meets every cell."""
    floor = cell_top_n(queries, indexed, centres, n, probes, size).where(F.col("rn") == n).select("query_id", F.col("score").alias("floor"))
    gap = F.zip_with("v", "centre", lambda x, y: x.cast("double") - y)
    reach = indexed.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.max(norm(gap)).alias("radius"))  # a row per cell
    near = exact_top_n(queries, centres.select(F.col("cell").alias("item_id"), F.col("centre").alias("v")), 1 << 30)
    near = near.select("query_id", F.col("item_id").alias("cell"), F.col("score").alias("middle"))
    asked = near.join(F.broadcast(reach), "cell").join(floor, "query_id", "left").join(queries, "query_id")
    bound = F.col("middle") + norm("q") * F.col("radius")
    asked = asked.where(F.col("floor").isNull() | (bound * (1 + F.signum(bound) * 1e-9) + 1e-9 >= F.col("floor"))).select("query_id", "q", "cell")
    both = _item_blocks(indexed, n, size, "cell").join(_blocks(asked, "query_id", "q", size, "cell"), "cell").drop("cell")
    return _best(both, n, _kinds(queries, indexed))


def probe_sweep(queries: DataFrame, indexed: DataFrame, centres: DataFrame, n: int, probes: list[int]) -> DataFrame:
    """A row per number of probes: recall (mean share of a query's exact n best that is found) and scanned (share of all
    items that a query's probed cells hold, the cost of a search)."""
    items = indexed.select("item_id", "v")
    exact = exact_top_n(queries, items, n).select("query_id", "item_id")
    near = exact_top_n(queries, centres.select(F.col("cell").alias("item_id"), F.col("centre").alias("v")), max(probes))
    near = near.select("query_id", F.col("item_id").alias("cell"), F.col("rn").alias("at"))
    # an exact neighbour is found as soon as its cell is probed
    met = exact.join(indexed.select("item_id", "cell"), "item_id").join(near, ["query_id", "cell"], "left")
    sizes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    cost = near.join(F.broadcast(sizes), "cell").crossJoin(F.broadcast(sizes.agg(F.sum("held").alias("all"))))
    found = met.groupBy("query_id").agg(*[F.avg((F.coalesce("at", F.lit(1 << 30)) <= p).cast("int")).alias(f"r{p}") for p in probes]).agg(*[F.avg(f"r{p}").alias(f"r{p}") for p in probes])
    read = cost.groupBy("query_id").agg(*[F.sum(F.when(F.col("at") <= p, F.col("held") / F.col("all"))).alias(f"s{p}") for p in probes]).agg(*[F.avg(f"s{p}").alias(f"s{p}") for p in probes])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("probes"), F.col(f"r{p}").alias("recall"), F.col(f"s{p}").alias("scanned")) for p in probes]))
    return found.crossJoin(F.broadcast(read)).select(rows.alias("x")).select("x.*")


def probes_for(sweep: DataFrame, recall: float = 0.9) -> int:
    """The fewest probes of a sweep that reach the recall."""
    return sweep.where(F.col("recall") >= recall).agg(F.min("probes").alias("p")).first()["p"]


def mean_vectors(members: DataFrame, items: DataFrame, key: str = "user_id") -> DataFrame:
    """key, v: mean vector of each key's items (members: key, item_id), repeats counted; without any known item absent.
    A sum per place of the vector, so that a task sends a row per key, however many items it has."""
    width = (items.agg(F.max(F.size("v")).alias("n")).first()["n"]) or 0
    return members.join(items, "item_id").groupBy(key).agg(F.array(*[F.avg(F.col("v")[i]) for i in range(width)]).alias("v"))


def vocabulary(items: DataFrame, column: str) -> DataFrame:
    """Distinct values, numbered from 1 in binary order; 0 is left for padding and unknown ones."""
    values = items.select(column).where(F.col(column).isNotNull()).distinct()
    return values.select(column, F.dense_rank().over(Window.orderBy(column)).alias("idx"))
