"""Two towers over categories: encoding of histories, vectors, training, evaluation of retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranking import metrics
from .vectors import Shelf, exact_top_n, shared, vocabulary

HISTORY, DIM = 20, 32
#: Bytes of distinct item vectors and their ids up to which tasks search them in place.
SHELF_BYTES = 64 << 20


def item_codes(catalog: DataFrame) -> DataFrame:
    """item_id, cat, subcat: places of the values in binary order, from 1; 0 stands for padding and unknown ones."""
    cats, subs = vocabulary(catalog, "category").withColumnRenamed("idx", "cat"), vocabulary(catalog, "subcategory").withColumnRenamed("idx", "subcat")
    out = catalog.select("item_id", "category", "subcategory").join(F.broadcast(cats), "category", "left").join(F.broadcast(subs), "subcategory", "left")
    return out.select("item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cat", "subcat")])


def encode_histories(histories: DataFrame, codes: DataFrame, key: str = "impression_id", last: int = HISTORY) -> DataFrame:
    """(key, ids: array) -> key, codes: array of (cat, subcat, mask) of the last `last` ids, in order; unknown ids keep
    their place with mask 0, so the cut comes before the look-up. Empty histories give an empty array."""
    ids = F.slice("ids", F.greatest(F.size("ids") - last + 1, F.lit(1)), F.lit(last))
    placed = histories.select(key, F.posexplode_outer(ids).alias("pos", "item_id"))
    met = placed.join(codes, "item_id", "left")
    one = F.struct("pos", F.coalesce("cat", F.lit(0)).alias("cat"), F.coalesce("subcat", F.lit(0)).alias("subcat"), F.col("cat").isNotNull().cast("int").alias("mask"))
    rows = met.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), one))).alias("c"))  # at most `last`
    return rows.select(key, F.transform("c", lambda x: F.struct(x["cat"].alias("cat"), x["subcat"].alias("subcat"), x["mask"].alias("mask"))).alias("codes"))


class TwoTowers:
    """Item vector: (category vector, subcategory vector) through one linear layer; user vector: mean of the item vectors
    of the known history, zero if there is none; logit: their product plus one bias."""

    def __init__(self, cats: int, subs: int, dim: int = DIM, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"c": r.normal(size=(cats + 1, dim)), "s": r.normal(size=(subs + 1, dim)), "w": r.uniform(-1, 1, (2 * dim, dim)) / np.sqrt(2 * dim), "b": np.zeros(dim), "bias": np.zeros(1)}
        self.dim = dim

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The layer is linear, so an item's vector is the sum of a row for its category and one for its subcategory."""
        return self.p["c"] @ self.p["w"][: self.dim], self.p["s"] @ self.p["w"][self.dim :] + self.p["b"]

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """cat, a and subcat, s: the two summands; a row per value of the vocabularies."""
        a, s = self.parts()
        return tuple(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{k} int, {n} array<double>") for m, k, n in ((a, "cat", "a"), (s, "subcat", "s")))

    def item_vectors(self, codes: DataFrame) -> DataFrame:
        """item_id, v."""
        a, s = self.tables(codes.sparkSession)
        out = codes.join(F.broadcast(a), "cat").join(F.broadcast(s), "subcat")
        return out.select("item_id", F.zip_with("a", "s", lambda x, y: x + y).alias("v"))

    def user_vectors(self, encoded: DataFrame, key: str = "impression_id") -> DataFrame:
        """key, q: the masked mean of the history; zeros without a known item."""
        a, s = self.parts()

        def run(batches):
            for batch in batches:
                of, h = _flat(batch.column(1))
                known = h["mask"] > 0
                of, v = of[known], (a[h["cat"]] + s[h["subcat"]])[known]
                q = np.zeros((batch.num_rows, a.shape[1]))
                if len(of):
                    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    q[of[heads]] = np.add.reduceat(v, heads, axis=0) / np.diff(np.r_[heads, len(of)])[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "q"])

        return encoded.select(key, "codes").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, q array<double>")

    def gradient(self, sets: DataFrame) -> dict | None:
        """Mean loss and gradient over training_sets, each task giving sums per vocabulary value: what reaches the driver is
        as large as the parameters, not the data. A batch is worked through by whole arrays; an impression's history
        is summed up once for all its candidates."""
        a, s = self.parts()
        bias, dim = float(self.p["bias"][0]), self.dim

        def run(batches):
            ga, gs, total = np.zeros_like(a), np.zeros_like(s), np.zeros(3)  # bias, loss, examples
            for batch in batches:
                (of_h, h), (of_c, c) = (_flat(batch.column(i)) for i in range(2))
                known = h["mask"] > 0
                of_h, hc, hs = of_h[known], h["cat"][known], h["subcat"][known]
                size = np.maximum(np.bincount(of_h, minlength=batch.num_rows), 1)[:, None]
                u = _sums(of_h, a[hc] + s[hs], batch.num_rows) / size
                v, y = a[c["cat"]] + s[c["subcat"]], c["label"].astype(float)
                z = np.einsum("ij,ij->i", u[of_c], v) + bias
                g = 1 / (1 + np.exp(-z)) - y
                du = _sums(of_c, g[:, None] * v, batch.num_rows)
                own, past = g[:, None] * u[of_c], (du / size)[of_h]
                for grad, cand, seen in ((ga, c["cat"], hc), (gs, c["subcat"], hs)):
                    grad += _sums(cand, own, len(grad)) + _sums(seen, past, len(grad))
                total += (g.sum(), (np.logaddexp(0, z) - y * z).sum(), len(y))
            flat = np.concatenate([ga.ravel(), gs.ravel(), total])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["i", "x"])

        sums = sets.select("codes", "shown").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
        flat = np.zeros(a.size + s.size + 3)
        for r in sums.collect():
            flat[r["i"]] = r["x"]
        n = flat[-1]
        if not n:
            return None
        ga, gs = flat[: a.size].reshape(a.shape) / n, flat[a.size : a.size + s.size].reshape(s.shape) / n
        w = self.p["w"]
        grad = {"c": ga @ w[:dim].T, "s": gs @ w[dim:].T, "w": np.concatenate([self.p["c"].T @ ga, self.p["s"].T @ gs]), "b": gs.sum(0), "bias": flat[-3:-2] / n}
        return {"loss": flat[-2] / n, "n": int(n), "grad": grad}

    def train(self, sets: DataFrame, epochs: int = 1, rate: float = 1e-3) -> list[dict]:
        """Adam on the mean log loss: an epoch takes every part of sets once, a distributed gradient each, so it reads every
        example. sets: training_sets with a part (in_parts), partitioned by it. Gives step, epoch, loss, n (examples)."""
        m, v2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        parts, log = [r["part"] for r in sets.select("part").distinct().orderBy("part").collect()], []  # as many as in_parts was told
        turn = np.random.default_rng(11)
        for epoch in range(1, epochs + 1):
            for part in turn.permutation(parts).tolist():
                got = self.gradient(sets.where(F.col("part") == part))
                if got is None:
                    continue
                t = len(log) + 1
                log.append({"step": t, "epoch": epoch, "loss": float(got["loss"]), "n": got["n"]})
                for k, g in got["grad"].items():
                    m[k], v2[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)
        return log

    def save(self, spark, path: str) -> None:
        """The parameters as a table: name, row, values."""
        rows = [(k, i, [float(x) for x in np.atleast_1d(r)]) for k, p in self.p.items() for i, r in enumerate(np.atleast_2d(p))]
        spark.createDataFrame(rows, "name string, row int, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> TwoTowers:
        got: dict = {}
        for r in spark.read.parquet(path).orderBy("name", "row").collect():
            got.setdefault(r["name"], []).append(r["v"])
        out = cls(1, 1, 1)
        out.p = {k: np.array(v) if k in "csw" else np.array(v[0]) for k, v in got.items()}
        out.dim = len(out.p["b"])
        return out


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of the rows that go to each place; a column at a time, for np.add.at adds row by row."""
    return np.stack([np.bincount(at, x, n) for x in np.ascontiguousarray(rows.T)], axis=1)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of arrays of structs: the row of each element, and the fields of all elements."""
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    items = column.flatten()
    return rows, {f.name: items.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(items.type)}


def examples(log: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """impression_id, item_id, label, sampled: shown candidates with their clicks, and negatives (impression_id, negative_id)
    with label 0."""
    rows = log.select("impression_id", "item_id", F.col("clicked").cast("int").alias("label"), F.lit(False).alias("sampled"))
    if negatives is not None:
        rows = rows.unionByName(negatives.select("impression_id", F.col("negative_id").alias("item_id"), F.lit(0).alias("label"), F.lit(True).alias("sampled")))
    return rows


def training_sets(rows: DataFrame, encoded: DataFrame, codes: DataFrame) -> DataFrame:
    """A row per impression: codes (of its history) and shown (array of cat, subcat, label of its examples). The history is
    joined once an impression, not once an example; an impression's examples are few."""
    met = rows.join(codes, "item_id").groupBy("impression_id").agg(F.collect_list(F.struct("cat", "subcat", "label")).alias("shown"))
    return met.join(encoded, "impression_id").select("impression_id", "codes", "shown")


def in_parts(sets: DataFrame, parts: int = 8, seed: int = 7) -> DataFrame:
    """sets with part, by a hash of the impression, written in a folder per part: a step of training reads its own only."""
    return written(sets.withColumn("part", F.pmod(F.xxhash64("impression_id", F.lit(seed)), F.lit(parts)).cast("int")), "training", ["part"])


def clicked_sets(log: DataFrame) -> DataFrame:
    """impression_id, clicked_ids (a sorted set; impressions without clicks are absent)."""
    return log.where("clicked = 1").groupBy("impression_id").agg(F.array_sort(F.collect_set("item_id")).alias("clicked_ids"))


def evaluate_retrieval(users: DataFrame, items: DataFrame, log: DataFrame, catalog_size: DataFrame, n: int = 100) -> DataFrame:
    """One row: macro means over all impressions (users: query_id = impression, q) of the metrics of their n best items
    of the whole catalog (item_id, v) against the items clicked, known in number; and coverage.

    Distinct vectors are a row per pair of codes at most: where they fit in SHELF_BYTES, tasks search them in place and send
    sums and the items shown instead of n rows an impression; beyond that the lists are joined to the clicks."""
    vectors = shared(items, n)
    weight = vectors.agg(F.sum(8 * (F.size("v") + F.size("k"))).alias("b")).first()["b"] or 0
    if 0 < weight <= SHELF_BYTES:
        return _evaluate_in_place(users, vectors, items.schema["item_id"].dataType.simpleString(), log, catalog_size, n)
    top = exact_top_n(users, items, n).withColumnRenamed("query_id", "impression_id")
    clicks = log.where("clicked = 1").select("impression_id", "item_id").distinct()
    true = clicks.groupBy("impression_id").agg(F.count(F.lit(1)).alias("true_total"))
    marked = top.join(clicks.withColumn("c", F.lit(1)), ["impression_id", "item_id"], "left").join(true, "impression_id", "left")
    marked = marked.select("impression_id", "item_id", "rn", F.coalesce("c", F.lit(0)).alias("clicked"), F.coalesce("true_total", F.lit(0)).alias("true_total"))
    means = metrics(marked, n, true_total="true_total").agg(*[F.avg(m).alias(m) for m in ("hit", "recall", "ndcg", "mrr")], F.count(F.lit(1)).alias("impressions"))
    return _with_coverage(means, top.agg(F.countDistinct("item_id").alias("distinct_items")), catalog_size)


def _with_coverage(means: DataFrame, shown: DataFrame, catalog_size: DataFrame) -> DataFrame:
    both = means.crossJoin(F.broadcast(shown)).crossJoin(F.broadcast(catalog_size))
    return both.select("hit", "recall", "ndcg", "mrr", F.when(F.col("n") > 0, F.col("distinct_items") / F.col("n")).otherwise(0.0).alias("coverage"), "distinct_items", "impressions")


def _evaluate_in_place(users: DataFrame, vectors: DataFrame, kind: str, log: DataFrame, catalog_size: DataFrame, n: int) -> DataFrame:
    got = vectors.select("k", F.col("v").cast("array<double>").alias("v")).toArrow().combine_chunks()
    ids, flat = got["k"].combine_chunks(), got["v"].combine_chunks()
    shelf = users.sparkSession.sparkContext.broadcast(Shelf(ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)))
    gains = 1 / np.log2(np.arange(n) + 2)
    rows = users.where("q is not null").join(clicked_sets(log).withColumnRenamed("impression_id", "query_id"), "query_id", "left").select("q", "clicked_ids")

    def run(batches):
        s, sums, shown = shelf.value, np.zeros(5), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            clicked, before = batch.column(1).to_pylist(), None
            for (best, _), mine in zip(s.search(q, n), clicked, strict=True):
                if best is not before:
                    shown.update(best.tolist())
                before, total = best, len(mine or ())
                at = np.flatnonzero(np.isin(s.named(best), mine)) if mine else ()
                sums[4] += 1
                if len(at):
                    sums[:4] += 1.0, len(at) / total, gains[at].sum() / gains[: min(total, n)].sum(), 1 / (at[0] + 1)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64())), pa.nulls(1, ids.type.value_type)], ["sums", "item_id"])
        if shown:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(shown), pa.list_(pa.float64())), pa.array(s.named(np.array(sorted(shown))), ids.type.value_type)], ["sums", "item_id"])

    out = written(rows.mapInArrow(run, f"sums array<double>, item_id {kind}"), "found")
    count = F.sum(F.col("sums")[4])
    means = out.agg(*[(F.sum(F.col("sums")[i]) / F.nullif(count, F.lit(0.0))).alias(m) for i, m in enumerate(("hit", "recall", "ndcg", "mrr"))], F.coalesce(count, F.lit(0.0)).cast("long").alias("impressions"))
    return _with_coverage(means, out.agg(F.countDistinct("item_id").alias("distinct_items")), catalog_size)
