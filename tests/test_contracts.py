"""Contracts of requests and responses, splits with their catalog, rows in list order, reports, negatives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import log, models, serving, validation
from tidemark.sources import files


def test_response_bounds(spark):
    rows = [(0.0, 1), (1.0, 50), (1.01, 1), (-0.1, 1), (0.5, 0), (None, 1), (0.5, None), (float("nan"), 2)]
    flagged = validation.valid_responses(spark.createDataFrame(rows, "score double, rank int"))
    assert [r["valid"] for r in flagged.collect()] == [True, True, False, False, False, False, False, False]
    with pytest.raises(ValueError, match="6 rows"):
        validation.assert_valid(flagged)
    assert validation.assert_valid(flagged.where("valid")).count() == 2
    requests = validation.valid_requests(spark.createDataFrame([("u", None), ("", 3), (None, 3), ("u", 0), ("u", 51), ("u", 50)], "user_id string, num_candidates int"))
    assert [(r["num_candidates"], bool(r["valid"])) for r in requests.collect()] == [(10, True), (3, False), (3, False), (0, False), (51, False), (50, True)]


def test_all_splits_have_the_training_catalog(spark, tmp_path):
    root = str(tmp_path)
    files.write_split(spark.createDataFrame([("a", "train"), ("b", "validation")], "item_id string, split string"), f"{root}/news")
    files.write_split(spark.createDataFrame([(1, "train"), (2, "validation"), (3, "validation")], "impression_id long, split string"), f"{root}/behaviors")
    behaviors, catalog = files.load_split(spark, root, "validation")
    assert sorted(r[0] for r in behaviors.collect()) == [2, 3] and [r["item_id"] for r in catalog.collect()] == ["a"]


def test_rows_in_list_order(spark):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "item_id int, title string")
    lists = spark.createDataFrame([("x", [3, 1, 3, 0]), ("y", [])], "key string, ids array<int>")
    got = log.in_list_order(lists, table, "key").orderBy("key", "pos").collect()
    assert [(r["key"], r["pos"], r["title"]) for r in got] == [("x", 0, "t3"), ("x", 1, "t1"), ("x", 2, "t3"), ("x", 3, "t0")]
    with pytest.raises(Exception, match="not in the table: 9"):
        log.in_list_order(spark.createDataFrame([("x", [9])], "key string, ids array<int>"), table, "key").collect()


def test_rates_over_files(spark, tmp_path):
    spark.createDataFrame([("a-1 b-0 x-y-1",), ("a-0",)], "impressions string").write.parquet(f"{tmp_path}/b")
    spark.createDataFrame([("a", "c"), ("b", "c"), ("x-y", "d")], "item_id string, category string").write.parquet(f"{tmp_path}/n")
    got = {r["category"]: (r["impressions"], r["clicks"], r["ctr"], r["ctr_rank"]) for r in log.ctr_over_files(spark, f"{tmp_path}/b", f"{tmp_path}/n").collect()}
    assert got == {"c": (3, 1, 0.3333, 2), "d": (1, 1, 1.0, 1)}


def test_explanation_report(spark):
    rows = [(False, ["category_match"], "Food", "about food", "t"), (False, ["category_match"], "Food", "t", "t"), (False, ["content_similarity"], "News", "u", "t"), (True, [], "News", "", "")]
    e = spark.createDataFrame(rows, "refused boolean, evidence array<string>, category string, explanation string, template string")
    r = serving.explanation_report(e).first()
    assert (r["total"], r["refused"], r["attempted"], r["faithful"], r["model_used"], r["template_used"], r["distinct_texts"]) == (4, 1, 3, 2, 2, 1, 3)
    assert r["model_contribution_rate"] == pytest.approx(2 / 3) and r["refusal_rate"] == 0.25
    none = serving.explanation_report(e.where("refused")).first()
    assert (none["attempted"], none["faithfulness_rate"], none["model_contribution_rate"], none["mean_length"]) == (0, None, None, None)
    assert serving.explanation_report(e.where("false")).first()["refusal_rate"] == 0


def test_rolling_quality(spark):
    v = np.random.default_rng(0).random(900)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "seq long, score double")
    got = {r["seq"]: r["mean_score"] for r in serving.rolling_quality(df).collect()}
    assert all(np.isclose(got[i], v[max(0, i - 499) : i + 1].mean()) for i in range(900))


def test_negatives_against_listing_the_free_items(spark):
    clicked = spark.createDataFrame([(u, i) for u in range(4) for i in range(12) if (u * 7 + i * 5) % 3 == 0], "user_id long, item_id long")
    cat = spark.createDataFrame([(i,) for i in range(12)], "item_id long")
    place = {r["item_id"]: r["place"] for r in models.numbered(cat, "item_id").collect()}
    own = {}
    for r in clicked.collect():
        own.setdefault(r["user_id"], set()).add(r["item_id"])
    with_visit = clicked.crossJoin(spark.range(2).withColumnRenamed("id", "visit"))
    draws = models.sample_negatives(with_visit, cat, clicked, n=3, keep=("visit",)).groupBy("visit", "user_id", "item_id").agg(F.sort_array(F.collect_list("negative_id")).alias("x")).collect()
    assert len(draws) == 2 * clicked.count()
    for r in draws:
        free = sorted((i for i in range(12) if i not in own[r["user_id"]]), key=place.get)
        rows = spark.range(1, 4).select(F.pmod(F.xxhash64(*[F.lit(r[c]).cast("long") for c in ("visit", "user_id", "item_id")], F.col("id").cast("int"), F.lit(7)), F.lit(len(free))).alias("d"))
        if r["user_id"] == 0:
            assert r["x"] == sorted(free[x["d"]] for x in rows.collect())
        assert not set(r["x"]) & own[r["user_id"]]


def test_stop_words_take_no_place(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog"), (2, "the the bird")], "item_id int, text string")
    assert {r["term"] for r in text.tfidf(docs, 3, text.english_stop_words(spark)).collect()} == {"cat", "dog", "bird"}
    assert {r["term"] for r in text.tfidf(docs, 1).collect()} == {"the"}
