import numpy as np

from tidemark.operators import factors, models, ranking, vectors


def test_click_model_finds_the_signal(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 2))
    y = (r.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, clicked int")
    scored = models.click_probability(df, models.fit_click_model(df, ["a", "b"]))
    m = models.log_loss_auc(scored).first()
    assert m["auc"] > 0.8 and m["log_loss"] < 0.55
    assert models.calibration_error(models.calibration_bins(scored)).first()["ece"] < 0.05


def test_factors_rank_the_group_first(spark):
    clicks = spark.createDataFrame([("U1", "A"), ("U1", "C"), ("U2", "A"), ("U2", "C"), ("U3", "B"), ("U3", "D"), ("U4", "B"), ("U4", "D")], "user_id string, item_id string")
    u, v = models.collaborative_factors(clicks, 2)
    pop = spark.createDataFrame([("B", 9)], "item_id string, popularity long")
    log = spark.createDataFrame([("U1", "B"), ("U1", "C"), ("U1", "Z"), ("U9", "B")], "user_id string, item_id string")
    got = {(r["user_id"], r["item_id"]): (r["score"], r["fallback"]) for r in models.collaborative_scores(log, u, v, pop).collect()}
    assert got["U1", "C"][0] > got["U1", "B"][0] + 0.5
    assert got["U1", "Z"][0] == float("-inf") and got["U9", "B"] == (9.0, True)


def test_mode_prefers_the_smallest(spark):
    h = spark.createDataFrame([(1, "a"), (1, "b"), (1, "zz")], "user_id long, item_id string")
    c = spark.createDataFrame([("a", "news"), ("b", "food")], "item_id string, category string")
    assert models.dominant_category(h, c).first()["dominant_category"] == "food"


def test_negatives_avoid_clicks(spark):
    cat = spark.createDataFrame([(i,) for i in range(6)], "item_id long")
    clicked = spark.createDataFrame([(1, 0), (1, 1)], "user_id long, item_id long")
    got = models.sample_negatives(clicked, cat, clicked).collect()
    assert len(got) == 8 and all(r["negative_id"] > 1 for r in got)


def test_cells_find_most_neighbours(spark):
    r = np.random.default_rng(1)
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(200, 8)))], "item_id long, v array<double>")
    q = e.where("item_id % 20 = 0").selectExpr("item_id as query_id", "v as q")
    exact = vectors.exact_top_n(q, e, 5)
    indexed, centres = vectors.build_cells(e, 8)
    assert ranking.overlap_share(exact, vectors.cell_top_n(q, indexed, centres, 5, 8), "query_id", "item_id", 5).first()["recall"] == 1.0


def test_truncated_svd_equals_numpy(spark):
    r = np.random.default_rng(8)
    low = r.normal(size=(70, 4)) @ np.diag([9, 7, 4, 2]) @ r.normal(size=(4, 45))
    a = np.where(r.random((70, 45)) < 0.9, low + 0.01 * r.normal(size=(70, 45)), 0)
    cells = spark.createDataFrame([(f"u{i}", j, float(a[i, j])) for i in range(70) for j in range(45)], "user_id string, item_id int, n double")
    u, v, s = factors.truncated_svd(cells, "user_id", "item_id", "n", 4)
    _, want, _ = np.linalg.svd(a)
    assert np.allclose(s, want[:4], rtol=1e-4)
    left, right = ({x[0]: np.array(x[1]) for x in t.collect()} for t in (u, v))
    full = np.linalg.svd(a, full_matrices=False)
    best = full[0][:, :4] * full[1][:4] @ full[2][:4]
    got = np.array([[left[f"u{i}"] @ right[j] for j in range(45)] for i in range(70)])
    assert np.abs(got - best).max() < 0.02 * np.abs(best).max()
    # fewer directions than asked for, and none
    one = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0)], "user_id string, item_id int, n double")
    u, v, s = factors.truncated_svd(one, "user_id", "item_id", "n", 3)
    assert np.allclose(s, [8**0.5]) and {abs(round(x["u"][0], 6)) for x in u.collect()} == {2.0}
    u, v, s = factors.truncated_svd(one.where("false"), "user_id", "item_id", "n", 3)
    assert len(s) == 0 and u.count() == v.count() == 0


def test_products_shuffle_tiles_and_no_vectors(spark, monkeypatch):
    plans, real = [], factors.written

    def seen(df, name, *by):
        if name == "product":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *by)

    monkeypatch.setattr(factors, "written", seen)
    monkeypatch.setattr(factors, "BLOCK", 7, raising=False)
    monkeypatch.setattr(factors, "CELLS", 3, raising=False)
    r = np.random.default_rng(5)
    a = np.where(r.random((20, 12)) < 0.3, r.integers(1, 4, (20, 12)), 0)
    cells = spark.createDataFrame([(i, f"c{j}", float(a[i, j])) for i in range(20) for j in range(12)], "row long, col string, n double")
    u, v, s = factors.truncated_svd(cells, "row", "col", "n", 12, rounds=1, extra=0)
    left, right = ({x[0]: np.array(x[1]) for x in t.collect()} for t in (u, v))
    assert np.allclose([[left[i] @ right[f"c{j}"] for j in range(12)] for i in sorted(left)], a[sorted(left)])
    assert len(plans) == 3 and all(p.count("Exchange") == 1 for p in plans)


def test_vectors_pass_in_pieces(spark, monkeypatch):
    """what passes a task is a piece of a block of vectors, and tiles are cut as they come."""
    written, real = {}, factors.written
    monkeypatch.setattr(factors, "written", lambda df, name, *by: written.setdefault(name, real(df, name, *by)) if name in ("start", "tiles") and name not in written else real(df, name, *by))
    monkeypatch.setattr(factors, "SPREAD", 2)
    monkeypatch.setattr(factors, "PIECE", 3, raising=False)
    monkeypatch.setattr(factors, "CELLS", 4)
    r = np.random.default_rng(6)
    a = np.where(r.random((23, 14)) < 0.5, r.integers(1, 4, (23, 14)), 0)
    cells = spark.createDataFrame([(i, f"c{j}", float(a[i, j])) for i in range(23) for j in range(14)], "row long, col string, n double")
    u, v, s = factors.truncated_svd(cells, "row", "col", "n", 14, rounds=1, extra=0)
    left, right = ({x[0]: np.array(x[1]) for x in t.collect()} for t in (u, v))
    assert np.allclose([[left[i] @ right[f"c{j}"] for j in range(14)] for i in sorted(left)], a[sorted(left)])
    assert max(len(x["flat"]) for x in written["start"].collect()) == 3 * 14 * 8
    assert max(len(x["w"]) for x in written["tiles"].collect()) <= 4 * 8


def test_sums_by_place(spark):
    from tidemark.operators import towers

    at, rows = np.array([2, 0, 2, 5]), np.arange(12.0).reshape(4, 3)
    want = np.zeros((7, 3))
    np.add.at(want, at, rows)
    assert (towers._sums(at, rows, 7) == want).all() and (towers._sums(at[:0], rows[:0], 2) == 0).all()
