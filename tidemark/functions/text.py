"""Text scalars and TF-IDF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def joined_text(title: str = "title", abstract: str = "abstract") -> F.Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def tokens(column) -> F.Column:
    """Lower-case words of two word characters or more."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"(?U)(\b\w\w+\b)"), 1)


def html_escape(column) -> F.Column:
    out = F.col(column) if isinstance(column, str) else column
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def short_hash(column, n: int = 16) -> F.Column:
    return F.substring(F.sha2(F.col(column).cast("string") if isinstance(column, str) else column, 256), 1, n)


def english_stop_words(spark: SparkSession) -> list[str]:
    """Spark's own list, lower-case words; a list of one's own may stand in its place."""
    from pyspark.ml.feature import StopWordsRemover

    return [w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()]


def _occurrences(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, number of the term and count of each distinct term of each row, and the terms."""
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return key // size, key % size, n, coded.dictionary


def _totals(batches):
    for batch in batches:
        _, term, n, names = _occurrences(batch.column(0))
        totals = np.bincount(term, n, len(names)).astype(np.int64), np.bincount(term, minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([names, *map(pa.array, totals)], ["term", "total", "df"])


def packed_tfidf(texts: DataFrame, terms: int = 5000, stop_words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(item_id, text) -> (item_id, terms: array of numbers, weights), a row per item with any of the `terms` most frequent
    terms, smooth idf ln((1+n)/(1+df)) + 1, unit rows; and (idx, term), what the numbers stand for.

    Ties in frequency go to the smaller term. A text's words are counted where it lies, so only ids, and a row per term and
    batch, are shuffled. Rows that share an item_id make one item: they alone are counted by (item, term) over a shuffle."""
    spark, n = texts.sparkSession, texts.count()
    repeated = written(texts.groupBy("item_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("item_id").alias("__id")), "repeated")
    words = tokens("text")
    if stop_words:
        words = F.filter(words, lambda t: ~t.isin(stop_words))
    alone, tf = texts, None
    if not repeated.isEmpty():
        same = F.col("item_id").eqNullSafe(F.col("__id"))
        alone = texts.join(repeated, same, "left_anti")
        tf = texts.join(repeated, same, "left_semi").select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = alone.select(words.alias("w")).mapInArrow(_totals, "term string, total long, df long")
    if tf is not None:
        counts = counts.unionByName(tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")))
    stats = counts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    kept = stats.orderBy(F.desc("total"), "term").limit(terms).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect()  # at most `terms` rows
    names, idf = pa.array([r["term"] for r in kept], pa.string()), np.array([r["idf"] for r in kept], float)

    def weigh(batches):
        for batch in batches:
            row, term, tf, found = _occurrences(batch.column(1))
            idx = pc.index_in(found, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[term] if len(found) else term
            row, idx, tf = row[idx >= 0], idx[idx >= 0], tf[idx >= 0]
            w = tf * idf[idx]
            w /= np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            size = np.bincount(row, minlength=batch.num_rows)
            ends = pa.array(np.r_[0, np.cumsum(size[size > 0])].astype(np.int32))
            ids = batch.column(0).filter(pa.array(size > 0))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))], ["item_id", "terms", "weights"])

    vocabulary = spark.createDataFrame([(i, r["term"], r["idf"]) for i, r in enumerate(kept)], "idx int, term string, idf double")
    out = alone.select("item_id", words.alias("w")).mapInArrow(weigh, f"item_id {texts.schema['item_id'].dataType.simpleString()}, terms array<int>, weights array<double>")
    if tf is not None:
        raw = tf.join(F.broadcast(vocabulary), "term").groupBy("item_id").agg(F.collect_list(F.struct("idx", (F.col("tf") * F.col("idf")).alias("w"))).alias("x"))
        length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
        out = out.unionByName(raw.withColumn("n", length).select("item_id", F.transform("x", lambda e: e["idx"]).alias("terms"), F.transform("x", lambda e: e["w"] / F.col("n")).alias("weights")))
    return out, vocabulary.select("idx", "term")


def tfidf(texts: DataFrame, terms: int = 5000, stop_words: list[str] | None = None) -> DataFrame:
    """packed_tfidf in long form: (item_id, term, w)."""
    rows, names = packed_tfidf(texts, terms, stop_words)
    each = rows.select("item_id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("item_id", F.col("x.terms").alias("idx"), F.col("x.weights").alias("w"))
    return each.join(F.broadcast(names), "idx").select("item_id", "term", "w")


def profiles(members: DataFrame, weights: DataFrame, key: str = "user_id") -> DataFrame:
    """key, term, w: mean of the members' vectors, repeats counted, scaled to length 1."""
    known = members.join(weights.select("item_id").distinct(), "item_id", "left_semi")
    n = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sums = known.join(weights, "item_id").groupBy(key, "term").agg(F.sum("w").alias("s")).join(n, key).withColumn("w", F.col("s") / F.col("n"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return sums.select(key, "term", (F.col("w") / length).alias("w"))


def similarity(pairs: DataFrame, profile: DataFrame, weights: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, item_id) -> with similarity, 0 where they share no term."""
    score = pairs.select(key, "item_id").distinct().join(weights, "item_id").join(profile.withColumnRenamed("w", "p"), [key, "term"]).groupBy(key, "item_id").agg(F.sum(F.col("w") * F.col("p")).alias("similarity"))
    return pairs.join(score, [key, "item_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def packed_profiles(members: DataFrame, packed: DataFrame, terms: int, key: str = "user_id") -> DataFrame:
    """As profiles, of packed rows: key, profile (array of `terms` weights). A task sends a row per key and term."""
    each = members.join(packed, "item_id").select(key, F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    sums = each.groupBy(key, F.col("x.terms").alias("idx")).agg(F.sum("x.weights").alias("s"))
    rows = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))  # at most `terms`
    weight = F.transform(F.sequence(F.lit(0), F.lit(terms - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("length"))
    return rows.select(key, weight.alias("profile"))


def packed_similarity(pairs: DataFrame, profile: DataFrame, packed: DataFrame, key: str = "user_id") -> DataFrame:
    """As similarity, of packed rows and profiles; a pair meets its item's terms and its key's profile in its own row."""
    met = pairs.join(packed, "item_id", "left").join(profile, key, "left")
    product = F.aggregate(F.zip_with("terms", "weights", lambda t, w: w * F.get("profile", t)), F.lit(0.0), lambda a, x: a + x)
    return met.select(*pairs.columns, F.coalesce(product, F.lit(0.0)).alias("similarity"))
