"""Features of a log's own earlier clicks against plain Python."""

import collections
import datetime as dt
import math
import random

import numpy as np
import pytest
from tidemark.operators import features, recommend


def rows_of(seed=3, users=9, items=40):
    r = random.Random(seed)
    catalog = [(i, r.choice("abcd"), r.choice(["red hat", "blue hat", "red coat", "old shoe shoe", "x"]), None) for i in range(items)]
    vec = {i: [float(x) for x in np.random.default_rng(seed + i % 7).normal(size=4)] for i in range(items) if i % 5}
    log = []
    for u in range(users):
        for k in range(r.randrange(1, 30)):
            at = dt.datetime(2024, 1, 1 + r.randrange(9), r.randrange(24))
            log += [(u * 1000 + k, None if u == 4 else u, at, i, int(r.random() < 0.4)) for i in r.sample(range(items), r.randrange(1, 5))]
    return catalog, vec, log


def expected(catalog, vec, log, weights, last):
    text = collections.defaultdict(dict)
    for i, term, w in weights:
        text[i][term] = w
    cat, out = {c[0]: c[1] for c in catalog}, {}
    popular = collections.Counter(i for _, _, _, i, c in log if c)
    for imp, user, at, item, _ in log:
        past = [x[3] for x in sorted(log, key=lambda x: (x[2], x[0], x[3])) if x[1] == user and x[4] and (x[2], x[0]) < (at, imp)]
        near = [vec[i] for i in past[-last:] if i in vec]
        score = float(np.mean(near, axis=0) @ np.array(vec[item])) if near and item in vec else 0.0
        often = collections.Counter(cat[i] for i in past)
        top = min((c for c in often if often[c] == max(often.values())), default=None)
        profile = collections.Counter()
        for i in past:
            profile.update(text[i])
        norm = math.sqrt(sum(w * w for w in profile.values()))
        similar = sum(w * profile[t] for t, w in text[item].items()) / norm if norm else 0.0
        out[imp, item] = (score, math.log1p(popular[item]), float(cat[item] == top), similar, len(past), at.hour)
    return out


@pytest.mark.parametrize("matrix_bytes, entries", [(64 << 20, 100_000), (0, 7)])
def test_features_of_earlier_clicks(spark, monkeypatch, matrix_bytes, entries):
    monkeypatch.setattr(features, "MATRIX_BYTES", matrix_bytes)
    monkeypatch.setattr(features, "ENTRIES", entries)
    catalog, vec, log = rows_of()
    frame = spark.createDataFrame(log, "impression_id long, user_id long, time timestamp_ntz, item_id long, clicked int")
    news = spark.createDataFrame(catalog, "item_id long, category string, title string, abstract string")
    x = recommend.Context(frame, news, spark.createDataFrame(list(vec.items()), "item_id long, v array<double>"))
    want = expected(catalog, vec, log, [tuple(r) for r in x.weights.collect()], 5)
    got = recommend.feature_rows(frame, x, 5).collect()
    assert len(got) == len(log)
    for r in got:
        assert [r[c] for c in recommend.FEATURES] == pytest.approx(list(want[r["impression_id"], r["item_id"]]), abs=1e-9)


def test_rows_carry_no_vectors(spark, monkeypatch):
    """beyond the matrix vectors pass each task in blocks; neither shuffle of the log holds them."""
    monkeypatch.setattr(features, "MATRIX_BYTES", 0)
    monkeypatch.setattr(features, "PASSED", 2, raising=False)
    monkeypatch.setattr(features, "ROWS", 60, raising=False)
    catalog, vec, log = rows_of(5)
    frame = spark.createDataFrame(log, "impression_id long, user_id long, time timestamp_ntz, item_id long, clicked int")
    news = spark.createDataFrame(catalog, "item_id long, category string, title string, abstract string")
    x = recommend.Context(frame, news, spark.createDataFrame(list(vec.items()), "item_id long, v array<double>"))
    kind, met = type(frame), []
    handed = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, func, schema, *more: met.append(self.columns) or handed(self, func, schema, *more))
    want = expected(catalog, vec, log, [tuple(r) for r in x.weights.collect()], 5)
    got = recommend.feature_rows(frame, x, 5).collect()
    assert [c for c in met if "user_id" in c] and not any("user_id" in c and "v" in c for c in met)
    assert len(got) == len(log)
    for r in got:
        assert [r[c] for c in recommend.FEATURES] == pytest.approx(list(want[r["impression_id"], r["item_id"]]), abs=1e-9)


def test_a_user_may_span_batches(spark):
    catalog, vec, log = rows_of(5)
    frame = spark.createDataFrame(log, "impression_id long, user_id long, time timestamp_ntz, item_id long, clicked int")
    news = spark.createDataFrame(catalog, "item_id long, category string, title string, abstract string")
    x = recommend.Context(frame, news, spark.createDataFrame(list(vec.items()), "item_id long, v array<float>"))
    whole = sorted(map(tuple, recommend.feature_rows(frame, x).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, recommend.feature_rows(frame, x).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_an_unknown_candidate_raises(spark):
    frame = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 5, 1)], "impression_id long, user_id long, time timestamp_ntz, item_id long, clicked int")
    news = spark.createDataFrame([(1, "a", "red hat", None)], "item_id long, category string, title string, abstract string")
    x = recommend.Context(frame, news, spark.createDataFrame([(1, [1.0])], "item_id long, v array<double>"))
    with pytest.raises(Exception, match="candidate missing from the catalog: 5"):
        recommend.feature_rows(frame, x).collect()


def test_evaluations_of_several_scores_shuffle_rows_once(spark):
    from tidemark.operators import ranking

    r = random.Random(2)
    data = [(g, i, int(r.random() < 0.3), r.randrange(3) / 2, r.random()) for g in range(30) for i in r.sample(range(12), 5)]
    rows, size = spark.createDataFrame(data, "impression_id int, item_id int, clicked int, a double, b double"), spark.range(1).selectExpr("20L as n")
    got = {x["scored_by"]: x for x in ranking.evaluations(rows, ["a", "b"], size, 2).collect()}
    for at, name in ((3, "a"), (4, "b")):
        lists = collections.defaultdict(list)
        for x in data:
            lists[x[0]].append(x)
        lists = [sorted(x, key=lambda x: (-x[at], x[1])) for x in lists.values()]
        assert got[name]["impressions"] == 30 and got[name]["coverage"] == len({x[1] for v in lists for x in v[:2]}) / 20
        assert got[name]["hit"] == pytest.approx(sum(any(x[2] for x in v[:2]) for v in lists) / 30)
        assert got[name]["mrr"] == pytest.approx(sum(next((1 / (i + 1) for i, x in enumerate(v) if x[2]), 0) for v in lists) / 30)
    none = ranking.evaluation(rows.where("false"), "a", size, 2).collect()
    assert len(none) == 1 and none[0]["impressions"] == 0 and none[0]["coverage"] == 0


def test_items_with_one_vector_are_searched_once(spark):
    from tidemark.operators import vectors

    r = np.random.default_rng(4)
    kinds = r.integers(-2, 3, size=(6, 3)).astype(float)
    items = [(i, kinds[i % 6].tolist()) for i in range(300)]
    queries = [(i, r.integers(-2, 3, size=3).astype(float).tolist()) for i in range(20)] + [(99, [0.0, 0.0, 0.0])]
    e, q = spark.createDataFrame(items, "item_id long, v array<double>"), spark.createDataFrame(queries, "query_id long, q array<double>")
    assert vectors.shared(e, 7).selectExpr("count(*) as c", "max(size(k)) as m").first().asDict() == {"c": len({tuple(k) for k in kinds.tolist()}), "m": 7}
    for size in (2, 2048):
        got = {(x["query_id"], x["rn"]): x["item_id"] for x in vectors.exact_top_n(q, e, 7, size).collect()}
        for i, x in queries:
            want = sorted(items, key=lambda y: (-float(np.dot(x, y[1])), y[0]))[:7]
            assert [got[i, k + 1] for k in range(7)] == [y[0] for y in want]


def test_retrieval_is_evaluated_alike_in_place_and_by_lists(spark, monkeypatch):
    from tidemark.operators import towers

    r = np.random.default_rng(6)
    items = spark.createDataFrame([(i, [float(x) for x in (i % 5 - 2, i % 3)]) for i in range(90)], "item_id long, v array<double>")
    users = spark.createDataFrame([(i, r.normal(size=2).tolist() if i % 4 else [0.0, 0.0]) for i in range(40)], "query_id long, q array<double>")
    log = spark.createDataFrame([(i, int(k), int(r.random() < 0.5)) for i in range(38) for k in r.choice(90, 12, replace=False)], "impression_id long, item_id long, clicked int")
    size = spark.range(1).selectExpr("90L as n")
    place = towers.evaluate_retrieval(users, items, log, size, 20).first()
    monkeypatch.setattr(towers, "SHELF_BYTES", 0)
    lists = towers.evaluate_retrieval(users, items, log, size, 20).first()
    assert place["impressions"] == lists["impressions"] == 40 and place["distinct_items"] == lists["distinct_items"]
    assert list(place) == pytest.approx(list(lists))


def test_content_scores_fall_back_without_a_known_history(spark):
    catalog, vec, log = rows_of(7)
    frame = spark.createDataFrame(log, "impression_id long, user_id long, time timestamp_ntz, item_id long, clicked int").selectExpr("*", "3D as popularity")
    news = spark.createDataFrame(catalog, "item_id long, category string, title string, abstract string")
    x = recommend.Context(frame, news, spark.createDataFrame(list(vec.items()), "item_id long, v array<double>"))
    weights = [tuple(r) for r in x.weights.collect()]
    want, known = expected(catalog, vec, log, weights, 5), {w[0] for w in weights}
    for r in recommend.content_scores(frame, x).collect():
        past = [i[3] for i in log if i[1] == r["user_id"] and i[4] and (i[2], i[0]) < (r["time"], r["impression_id"])]
        assert r["fallback"] == (not any(i in known for i in past))
        assert r["score"] == pytest.approx(3.0 if r["fallback"] else want[r["impression_id"], r["item_id"]][3])


def test_explained_candidates_meet_the_catalog_once(spark):
    from tidemark.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["agg25_explanation_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "MapInArrow" in plan and "hashpartitioning(item_id" not in plan[: plan.index("MapInArrow")]
