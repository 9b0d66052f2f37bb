"""Windows over whole tables that run in parts, against pandas and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.operators import models, vectors


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    data = [(int(i), int(t), float(v)) for i, (t, v) in enumerate(zip(np.sort(r.integers(0, 60, 700)), r.normal(size=700)))]
    return spark.createDataFrame(data, "id long, t long, v double"), data


@pytest.mark.parametrize(("frame", "block"), [(1, 10), (7, 9), (50, 50), (50, 1000)])
def test_rolling(rows, frame, block):
    df, data = rows
    got = {r["id"]: (r["s"], r["n"]) for r in ordering.rolling(df, "id", frame, block, s=F.sum("v"), n=F.count("v")).collect()}
    v = [x[2] for x in data]
    assert len(got) == len(data)
    for i in range(len(v)):
        own = v[max(0, i - frame + 1) : i + 1]
        assert np.isclose(got[i][0], sum(own)) and got[i][1] == len(own)
    with pytest.raises(ValueError):
        ordering.rolling(df, "id", 50, 10, s=F.sum("v"))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_previous_rows_over_ties(rows, parts):
    df, data = rows
    got = {r["id"]: r["before"] for r in ordering.with_previous(df, "t", "v", "before", ("id",), parts).collect()}
    v = [x[2] for x in data]
    assert got == {i: (v[i - 1] if i else None) for i in range(len(v))}


def test_exact_quantiles(spark, rows):
    df, data = rows
    shares = [0, 0.1, 0.25, 0.5, 0.99, 1]
    for column, at in (("v", 2), ("t", 1)):
        got = ordering.exact_quantiles(df, column, shares).first()["quantiles"]
        assert np.allclose(got, np.quantile([x[at] for x in data], shares))
    assert ordering.exact_quantiles(df.where("false"), "v", shares).first()["quantiles"] is None
    assert ordering.exact_quantiles(df.where("id = 3"), "v", [0.5]).first()["quantiles"] == [data[3][2]]


def test_correlations_and_statistics(spark, rows):
    df, data = rows
    df = df.withColumn("one", F.lit(1))
    got = {(r["x"], r["y"]): r["r"] for r in models.correlations(df, ["t", "v", "one"]).collect()}
    c = np.corrcoef([x[1] for x in data], [x[2] for x in data])[0, 1]
    assert got["t", "v"] == pytest.approx(c, abs=1e-4) and got["t", "t"] == 1 and got["t", "one"] is None and got["one", "one"] is None
    stats = {r["column"]: r for r in models.column_statistics(df, ["v", "one"]).collect()}
    assert stats["v"]["std"] == pytest.approx(np.std([x[2] for x in data])) and (stats["one"]["low"], stats["one"]["std"]) == (1, 0)


def test_index_is_stored_and_swept(spark, tmp_path):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 6)) * 4
    e = spark.createDataFrame([(i, (centres[i % 12] + r.normal(size=6)).tolist()) for i in range(600)], "item_id long, v array<double>")
    q = e.where("item_id % 20 = 0").selectExpr("item_id as query_id", "v as q")
    vectors.save_index(*vectors.build_cells(e, 12), str(tmp_path / "index"))
    indexed, found = vectors.load_index(spark, str(tmp_path / "index"))
    sweep = {x["probes"]: x for x in vectors.probe_sweep(q, indexed, found, 5, [1, 3, 12]).collect()}
    assert sweep[12]["recall"] == 1 and sweep[12]["scanned"] == pytest.approx(1) and sweep[1]["scanned"] < sweep[3]["scanned"] < 0.6
    exact = {(x["query_id"], x["item_id"]) for x in vectors.exact_top_n(q, e, 5).collect()}
    for p in (1, 3):
        near = {(x["query_id"], x["item_id"]) for x in vectors.cell_top_n(q, indexed, found, 5, p, size=16).collect()}
        assert len(near & exact) / len(exact) == pytest.approx(sweep[p]["recall"])
    assert vectors.probes_for(vectors.probe_sweep(q, indexed, found, 5, [1, 3, 12]), 0.99) in (1, 3, 12)


def test_centres_need_no_python_workers(spark):
    """centres made of rows of Python went through workers of their own, which stayed beside those of the search."""
    e = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "item_id long, v array<double>")
    _, centres = vectors.build_cells(e, 3)
    assert "ExistingRDD" not in centres._jdf.queryExecution().toString()
    assert centres.dtypes == [("cell", "int"), ("centre", "array<double>")]
    assert sorted((r["cell"], r["centre"][1]) for r in centres.collect()) == [(0, 1.0), (1, 1.0), (2, 1.0)] and {r["centre"][0] for r in centres.collect()} == {0.0, 1.0, 2.0}


def test_bins_of_counts_equal_bins_of_rows(spark, monkeypatch):
    from tidemark.operators import models

    rows = [(0.1, 1), (0.1, 0), (0.2, None), (0.2, 1), (0.5, 0), (0.7, 1), (0.7, 1), (0.9, 0), (None, 1)]
    df = spark.createDataFrame(rows, "p double, clicked int")
    read, quantiles = [], models.exact_quantiles
    monkeypatch.setattr(models, "exact_quantiles", lambda d, *a: read.append(sorted(d.columns)) or quantiles(d, *a))
    got = {r["bin"]: (round(r["mean_predicted"], 9), round(r["observed"], 9), r["n"]) for r in models.calibration_bins(df, 2).collect()}
    # edges 0.1, 0.35, 0.9; the row without a score falls into the first bin
    assert got == {0: (round(0.6 / 4, 9), 0.75, 5), 1: (round(2.8 / 4, 9), 0.5, 4)}
    assert read == [["labelled", "n", "p", "positive"]]  # edges are found in the counts, not in the rows again
