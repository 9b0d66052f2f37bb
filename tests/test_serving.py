import datetime as dt
import zipfile

import numpy as np
import pytest

from tidemark.functions import ordering
from tidemark.operators import models, monitoring, recommend, serving, slates, towers, vectors
from tidemark.sources import artefacts, kafka
from tidemark.streaming import consumer

NOON = dt.datetime(2023, 5, 4, 12)


@pytest.mark.parametrize("n", [0, 1, 700])
def test_numbers_and_totals(spark, n):
    df = spark.range(n).selectExpr("id * 7 as k", "cast(pmod(id * 13, 101) as double) + id / 1000 as x", "id % 5 as a")
    assert sorted(r["place"] for r in ordering.numbered(df, "k").collect()) == list(range(n))
    rows = sorted((r["x"], r["a"], r["upto"]) for r in ordering.running_total(df, "x", "a", parts=9).collect())
    assert [u for _, _, u in rows] == np.cumsum([a for _, a, _ in rows]).tolist()


def test_blocks_give_the_exact_neighbours(spark):
    r = np.random.default_rng(2)
    v = r.integers(-2, 3, size=(90, 4)).astype(float)  # many ties
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    q = items.where("item_id % 20 = 0").selectExpr("item_id as query_id", "v as q")
    got = {(x["query_id"], x["rn"]): x["item_id"] for x in vectors.exact_top_n(q, items, 7, size=16).collect()}
    for i in range(0, 90, 20):
        want = sorted(range(90), key=lambda j: (-float(v[i] @ v[j]), j))[:7]
        assert [got[i, k + 1] for k in range(7)] == want
    assert vectors.exact_top_n(q.where("false"), items, 3).count() == 0


def test_search_hands_workers_small_batches(spark, monkeypatch):
    """a batch ends once it has BATCH_BYTES, however many pairs of blocks a task has; the session's bound stays."""
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 16))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    q = e.where("item_id % 20 = 0").selectExpr("item_id as query_id", "v as q")
    kind, key = type(e), "spark.sql.execution.arrow.maxBytesPerBatch"
    handed, was = kind.mapInArrow, spark.conf.get(key)

    def watched(self, func, schema, *more, **named):
        def run(batches):
            def seen():
                for batch in batches:
                    if batch.nbytes > 80_000:  # a pair of blocks has some 18,000 bytes
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    yield batch

            yield from func(seen())

        return handed(self, run, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    monkeypatch.setattr(vectors, "BATCH_BYTES", 40_000, raising=False)
    found = vectors.exact_top_n(q, e, 4, size=64)
    got = {(x["query_id"], x["rn"]): x["item_id"] for x in found.collect()}
    assert len(got) == 600 and all(got[i, k + 1] == j for i in range(0, 3000, 20) for k, j in enumerate(np.argsort(-(v @ v[i]), kind="stable")[:4]))
    assert spark.conf.get(key) == was


def test_a_search_sends_n_rows_per_query(spark, monkeypatch):
    """what a task finds is cut to n per query over all the blocks that it meets, however many they are."""
    r, sent = np.random.default_rng(5), spark.sparkContext.accumulator(0)
    v = r.integers(-2, 3, size=(600, 5)).astype(float)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    q = e.where("item_id % 15 = 0").selectExpr("item_id as query_id", "v as q")
    kind = type(e)
    handed = kind.mapInArrow

    def watched(self, func, schema, *more, **named):
        def run(batches):
            for batch in func(batches):
                sent.add(batch.num_rows)
                yield batch

        return handed(self, run, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    monkeypatch.setattr(vectors, "TASKS", 1, raising=False)
    monkeypatch.setattr(vectors, "PAIRS", 50, raising=False)
    got = {(x["query_id"], x["rn"]): x["item_id"] for x in vectors.exact_top_n(q, e, 3, size=16).collect()}
    for i in range(0, 600, 15):
        assert [got[i, k + 1] for k in range(3)] == sorted(range(600), key=lambda j: (-float(v[i] @ v[j]), j))[:3]
    assert sent.value == len(got) == 120


def test_negatives_of_users_near_the_whole_catalog(spark):
    cat = spark.createDataFrame([(i,) for i in range(30)], "item_id long")
    clicked = spark.createDataFrame([(1, i) for i in range(29)] + [(2, 4)] + [(3, i) for i in range(30)], "user_id long, item_id long")
    got = models.sample_negatives(clicked, cat, clicked).collect()
    by = {u: [r["negative_id"] for r in got if r["user_id"] == u] for u in (1, 2, 3)}
    assert by[1] == [29] * (29 * 4) and len(by[2]) == 4 and 4 not in by[2] and by[3] == []
    even = models.sample_negatives(clicked.where("user_id = 2"), cat, clicked, n=2900).groupBy("negative_id").count().collect()
    assert len(even) == 29 and min(r["count"] for r in even) > 60


def context(spark):
    """Twelve items of three categories with vectors along their category."""
    catalog = spark.createDataFrame([(i, "abc"[i % 3], f"s{i % 2}", f"w{i % 3} w{i} common", None) for i in range(12)], "item_id long, category string, subcategory string, title string, abstract string")
    train = spark.createDataFrame([(1, 1, dt.datetime(2023, 5, 1), i, int(i % 4 == 0)) for i in range(12)], "impression_id long, user_id long, time timestamp_ntz, item_id long, clicked int")
    vec = catalog.selectExpr("item_id", "transform(sequence(0, 2), k -> if(k = item_id % 3, 1.0D + item_id / 100, 0D)) as v")
    return recommend.Context(train, catalog, vec), catalog, train


class Weights:
    """A click model that is given, not fitted: the probability grows with the retrieval score alone."""


def test_recommend_against_steps_by_hand(spark, monkeypatch):
    from pyspark.sql import functions as F

    x, _, _ = context(spark)
    monkeypatch.setattr(models, "click_probability", lambda rows, fitted: rows.withColumn("p", F.round(1 / (1 + F.exp(-F.col("retrieval_score"))), 9)))
    requests = spark.createDataFrame([(1, 4, NOON), (2, 3, NOON)], "user_id long, num_candidates int, request_time timestamp_ntz")
    durable = spark.createDataFrame([(1, "a", 9)], "user_id long, dominant_category string, lifetime_click_count int")
    recent = spark.createDataFrame([(1, ["0", "3", "99"])], "user_id long, recent array<string>")
    rows = sorted(recommend.recommend(requests, durable, recent, x, Weights()).collect(), key=lambda r: (r["user_id"], r["rank"]))
    one, two = [r for r in rows if r["user_id"] == 1], [r for r in rows if r["user_id"] == 2]
    # user 1: mean of items 0 and 3 lies along category a: 9, 6, 3, 0 by length; three of one category at most, and texts
    # of one category share a word, so those alike are passed over until places are left
    assert [r["rank"] for r in one] == [1, 2, 3, 4] and one[0]["item_id"] == 9 and one[0]["category_match"] == 1.0 and one[0]["user_history_length"] == 9
    assert one[0]["durable_used"] and one[0]["recent_used"] and one[0]["content_similarity"] > 0 and [r["score"] for r in one] == sorted((r["score"] for r in one), reverse=True)
    # user 2 is unknown: all products are 0, so ids decide
    assert len(two) == 3 and two[0]["item_id"] == 0 and not two[0]["durable_used"] and not two[0]["recent_used"] and {r["score"] for r in two} == {0.5}
    asked = recommend.explanation_requests(recommend.recommend(requests, durable, recent, x, Weights()))
    assert asked.count() == 7 and asked.where("category_match").count() >= 1
    down, errors = recommend.safe_recommend(requests, durable, recent, x, Weights(), available=False, on_fallback=(errors := []).append), errors
    got = down.orderBy("user_id", "rank").collect()
    assert len(errors) == 1 and all(r["is_fallback"] for r in got) and [r["item_id"] for r in got] == [0, 4, 8, 1, 0, 4, 8] and got[0]["score"] == 1.0
    with pytest.raises(Exception, match="no signals"):
        recommend.explanation_requests(down).collect()


def test_requests_that_are_alike_are_answered_once(spark, monkeypatch):
    """candidates are made for each distinct request, and each user still has their own answer and flags."""
    from pyspark.sql import functions as F

    x, _, _ = context(spark)
    asked, search = [], recommend.exact_top_n
    monkeypatch.setattr(models, "click_probability", lambda rows, fitted: rows.withColumn("p", F.round(1 / (1 + F.exp(-F.col("retrieval_score"))), 9)))
    monkeypatch.setattr(recommend, "exact_top_n", lambda q, *more: asked.append(q.count()) or search(q, *more))
    requests = spark.createDataFrame([(i, 2 + i % 2, NOON) for i in range(40)], "user_id long, num_candidates int, request_time timestamp_ntz")
    durable = spark.createDataFrame([(i, None, None) for i in range(20)], "user_id long, dominant_category string, lifetime_click_count int")
    recent = spark.createDataFrame([(7, ["0", "3"]), (9, ["0", "3"]), (11, [])], "user_id long, recent array<string>")
    rows = recommend.recommend(requests, durable, recent, x, Weights()).collect()
    assert asked == [3]  # two or three places without recent clicks, three with the two clicks
    by = {i: sorted((r for r in rows if r["user_id"] == i), key=lambda r: r["rank"]) for i in range(40)}
    for i, mine in by.items():
        assert [r["rank"] for r in mine] == list(range(1, 3 + i % 2))
        assert {(r["durable_used"], r["recent_used"]) for r in mine} == {(i < 20, i in (7, 9, 11))}
        assert mine[0]["item_id"] == (9 if i in (7, 9) else 0)


def test_missing_item_raises_when_explained(spark):
    _, catalog, _ = context(spark)
    items = spark.createDataFrame([(1, 77, True, 0.5)], "user_id long, item_id long, category_match boolean, content_similarity double")
    with pytest.raises(Exception, match="missing from the catalog"):
        serving.explain(items, catalog).collect()


def test_reranking_counts_clicks_outside_the_slate(spark):
    rows = [(1, i, float(9 - i), "a" if i < 4 else "b", None, 3.0, int(i in (1, 4))) for i in range(6)]
    c = spark.createDataFrame(rows, "impression_id long, item_id long, score double, category string, vec map<string,double>, age_days double, clicked int")
    size = spark.createDataFrame([(10,)], "n long")
    got = {r["variant"]: r for r in recommend.evaluate_reranking(c, size, k=3, cap=2).collect()}
    assert got["ranked_only"]["recall"] == 0.5 and got["ranked_only"]["mrr"] == 0.5 and got["ranked_only"]["categories"] == 1
    assert got["reranked"]["recall"] == 1.0 and got["reranked"]["most_of_one"] == 2 and got["reranked"]["coverage"] == 0.3
    assert got["reranked"]["below_quota_share"] == 1.0


def test_quota_swaps_and_keeps(spark):
    s = spark.createDataFrame([(1, 1, 10, 5.0, 9.0), (1, 2, 11, 4.0, 9.0), (2, 1, 10, 1.0, 0.1), (2, 2, 12, 3.0, 0.2)], "impression_id long, place int, item_id long, score double, age_days double")
    c = spark.createDataFrame([(1, 10, 5.0, 9.0), (1, 11, 4.0, 9.0), (1, 13, 0.5, 0.1), (1, 14, 0.7, 0.0), (1, 15, 0.1, 0.0), (2, 10, 1.0, 0.1), (2, 12, 3.0, 0.2)], "impression_id long, item_id long, score double, age_days double")
    got = sorted((r["impression_id"], r["place"], r["item_id"]) for r in slates.freshness_quota(s, c).collect())
    assert got == [(1, 1, 14), (1, 2, 13), (2, 1, 10), (2, 2, 12)]


def test_towers_learn_and_encode(spark, tmp_path):
    _, catalog, _ = context(spark)
    codes = towers.item_codes(catalog)
    h = spark.createDataFrame([(1, [0, 99, 3]), (2, []), (3, list(range(12)) * 3)], "impression_id long, ids array<long>")
    e = {r["impression_id"]: [tuple(x) for x in r["codes"]] for r in towers.encode_histories(h, codes).collect()}
    assert e[1] == [(1, 1, 1), (0, 0, 0), (1, 2, 1)] and e[2] == [] and len(e[3]) == 20
    log = spark.createDataFrame([(i, j, int(j % 3 == 0)) for i in (1,) for j in range(12)], "impression_id long, item_id long, clicked int")
    encoded = towers.encode_histories(h, codes).cache()
    extra = spark.createDataFrame([(3, 5), (2, 7)], "impression_id long, negative_id long")
    data = towers.training_sets(towers.examples(log, extra), encoded, codes).cache()
    model = towers.TwoTowers(3, 2, dim=4)
    # the gradient against differences of the loss
    got, eps = model.gradient(data), 1e-5
    for name, at in (("c", (1, 2)), ("s", (2, 0)), ("w", (3, 1)), ("b", (2,)), ("bias", (0,))):
        model.p[name][at] += eps
        up = model.gradient(data)["loss"]
        model.p[name][at] -= 2 * eps
        low = model.gradient(data)["loss"]
        model.p[name][at] += eps
        assert np.isclose((up - low) / (2 * eps), got["grad"][name][at], atol=1e-6), name
    parts = towers.in_parts(data, 3)
    assert parts.count() == 3 and parts.select(*data.columns).exceptAll(data).count() == 0
    losses = model.train(parts, 20, rate=0.05)
    by_epoch = [sum(x["n"] for x in losses if x["epoch"] == e) for e in range(1, 21)]
    assert by_epoch == [14] * 20 and [x["step"] for x in losses] == list(range(1, len(losses) + 1))
    assert model.gradient(data)["loss"] < 0.5 * got["loss"]
    model.save(spark, str(tmp_path / "towers"))
    again = towers.TwoTowers.load(spark, str(tmp_path / "towers"))
    assert np.allclose(again.parts()[0], model.parts()[0])
    users = {r["impression_id"]: r["q"] for r in model.user_vectors(encoded).collect()}
    a, s = model.parts()
    assert users[2] == [0.0] * 4 and np.allclose(users[1], ((a[1] + s[1]) + (a[1] + s[2])) / 2)
    assert towers.TwoTowers(3, 2).gradient(data.where("false")) is None


def test_monitoring_without_data(spark):
    none = spark.createDataFrame([], "outcome string, latency_seconds double, n_items int, is_fallback boolean, durable_used boolean, recent_used boolean")
    board = monitoring.dashboard(monitoring.counters(none))
    assert board.first().asDict() == {"total_requests": 0, **dict.fromkeys(board.columns[1:])}
    assert "&mdash;" in monitoring.dashboard_html(board)
    slots = spark.createDataFrame([], "seq long, item_id string, score double, category string")
    assert set(monitoring.quality_snapshot(slots, 10).first().asDict().values()) == {None}
    lines = [r["line"] for r in monitoring.exposition(monitoring.counters(none)).collect()]
    assert "recommend_success_total 0.0" in lines
    g = spark.createDataFrame([(1, 0.5, 2.0), (2, None, 3.0)], "seq long, a double, b double")
    assert tuple(monitoring.latest_gauges(g, ["a", "b"]).first()) == (0.5, 3.0)
    losses = spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "step long, loss double")
    assert sorted(tuple(r) for r in monitoring.loss_checkpoints(losses, 3).collect()) == [(3, 2.0), (6, 5.0)]


def test_topic_options_and_files(spark, tmp_path):
    o = kafka.read_options("host:9092", "events", "g", 50)
    assert o["startingOffsets"] == "earliest" and o["subscribe"] == "events" and o["maxOffsetsPerTrigger"] == "50" and o["kafka.group.id"] == "g"
    assert "--if-not-exists" in kafka.topic_command("events")
    log = spark.createDataFrame([(1, 5, NOON, 7, 1), (2, 6, NOON + dt.timedelta(hours=1), 8, 0)], "impression_id long, user_id long, time timestamp_ntz, item_id long, clicked int")
    events = consumer.replay_events(log)
    assert {r["key"] for r in kafka.messages(events).collect()} == {"7", "8"}
    kafka.write_files(events, str(tmp_path / "in"), ["timestamp", "impression_id", "step"])
    seen = []
    for _ in range(2):  # the second run finds nothing behind the committed offset
        kafka.drain(kafka.read_files(spark, str(tmp_path / "in"), 1), lambda b, i: seen.extend(r["ok"] for r in consumer.parse(b).collect()), str(tmp_path / "check"))
    assert seen == [True] * 4


def test_artefacts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/data.tsv", "content " * 50)
    assert artefacts.extract_checked(str(tmp_path / "a.zip"), str(tmp_path / "out")) == ["x/data.tsv"] and (tmp_path / "out/x/data.tsv").exists()
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[45] ^= 1
    (tmp_path / "b.zip").write_bytes(bytes(raw))
    with pytest.raises((ValueError, zipfile.BadZipFile)):
        artefacts.extract_checked(str(tmp_path / "b.zip"), str(tmp_path / "out2"))
    assert artefacts.with_credentials("redis://h:1/0", "u", "p@") == "redis://u:p%40@h:1/0" and artefacts.with_credentials("redis://h:1/0", None, "p") == "redis://h:1/0"
    f = spark.createDataFrame([("7", ["1", "2"], 3, 2, "2023-05-04T12:00:00")], artefacts.RECORD)
    kv = artefacts.to_records(f)
    assert kv.first()["key"] == "recent_features:7" and artefacts.from_records(kv).collect() == f.collect()
    ids = spark.range(5).select(artefacts.event_id("id").alias("e"))
    assert ids.distinct().count() == 5 and ids.collect() == ids.collect() and len(ids.first()["e"]) == 36
    cache = artefacts.durable_cache(f.select("user_id"), NOON)
    assert not artefacts.is_stale(cache, NOON + dt.timedelta(hours=24)).first()["stale"]
    assert artefacts.is_stale(cache, NOON + dt.timedelta(hours=24, seconds=1)).first()["stale"] and artefacts.is_stale(cache.where("false"), NOON).first()["stale"]
    later = NOON + dt.timedelta(days=2)
    assert artefacts.refreshed(cache, lambda: f.select("user_id"), later).first()["built_at"] == later
    artefacts.write_ranking_frame(f, str(tmp_path / "rank"), "train")
    assert artefacts.read_ranking_frame(spark, str(tmp_path / "rank"), "train").count() == 1
    data = spark.createDataFrame([(float(i % 7), i % 2) for i in range(60)], "a double, clicked int")
    fitted = models.fit_click_model(data, ["a"])
    artefacts.save_click_model(fitted, str(tmp_path / "model"))
    both = [[round(r["p"], 9) for r in models.click_probability(data, m).collect()] for m in (fitted, artefacts.load_click_model(spark, str(tmp_path / "model")))]
    assert both[0] == both[1]


def test_parity_of_state_and_log(spark):
    e = [(i, ("impression", "click")[i % 2], i % 3, f"n{i}", NOON + dt.timedelta(minutes=i // 6)) for i in range(200)]
    df = spark.createDataFrame(e, "event_id long, event_type string, user_id long, item_id string, timestamp timestamp_ntz")
    got = consumer.parity(df).collect()
    assert len(got) == 9 and all(r["matches"] for r in got) and max(r["clicks"] for r in got) > 20
    states = spark.createDataFrame([("1", None, 1, 0, "t")], "user_id string, recent array<string>, impressions long, clicks long, last_event_time string")
    assert consumer.recent_features(states).first()["recent"] == []
