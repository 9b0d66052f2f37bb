import collections
import datetime as dt
import random

import pytest

from tidemark.operators import log, ranking, validation
from tidemark.sources import files


def behaviors(spark, rows):
    return spark.createDataFrame(rows, "impression_id long, user_id string, time timestamp_ntz, history string, impressions string")


T0 = dt.datetime(2021, 2, 27, 9, 40, 3)


def shown(seed, n=60):
    """Impressions of items whose names hold dashes, with runs of white space between them."""
    r, rows = random.Random(seed), []
    for i in range(n):
        c = [(f"item-{r.randint(1, 9)}-{r.choice('uvw')}", r.randint(0, 1)) for _ in range(r.randint(1, 6))]
        rows.append((i, f"user{r.randint(1, 5)}", T0 + dt.timedelta(hours=r.randint(0, 90)), None, c))
    return rows


def encoded(rows, gap):
    return [(i, u, t, h, gap.join(f"{a}-{b}" for a, b in c)) for i, u, t, h, c in rows]


def test_explode_parts_at_the_last_dash(spark):
    rows = shown(1)
    got = collections.defaultdict(dict)
    for r in log.explode_impressions(behaviors(spark, encoded(rows, " \t "))).collect():
        got[r["impression_id"]][r["pos"]] = (r["item_id"], r["clicked"])
    assert all([got[i][p] for p in sorted(got[i])] == c for i, _, _, _, c in rows)


def test_rates_against_counting(spark):
    rows = shown(2)
    kind = {f"item-{i}-{x}": f"kind{i % 4}" for i in range(1, 9) for x in "uvw"}  # items 9 are in no catalog
    count = collections.Counter((kind[a], b) for *_, c in rows for a, b in c if a in kind)
    want = {k: (count[k, 0] + count[k, 1], count[k, 1]) for k in set(kind.values())}
    catalog = spark.createDataFrame(list(kind.items()), "item_id string, category string")
    got = log.ctr_by_category(log.explode_impressions(behaviors(spark, encoded(rows, " "))), catalog).collect()
    assert {r["category"]: (r["impressions"], r["clicks"]) for r in got} == want
    for r in got:
        assert r["ctr"] == round(r["clicks"] / r["impressions"], 4)
        assert r["ctr_rank"] == 1 + sum(c / n > r["clicks"] / r["impressions"] for n, c in want.values())


@pytest.mark.parametrize("days", [1, 2, 4])
def test_split_at_midnight_and_leaks(spark, days):
    rows = shown(3)
    last = max(r[2] for r in rows)
    cut = dt.datetime(last.year, last.month, last.day) - dt.timedelta(days=days - 1)
    s = log.time_split(behaviors(spark, encoded(rows, " ")), days).cache()
    assert {r["impression_id"]: r["split"] for r in s.collect()} == {r[0]: "train" if r[2] < cut else "validation" for r in rows}
    train, valid = s.where("split = 'train'"), s.where("split = 'validation'")
    validation.assert_ordered(train, valid)
    if train.count():
        with pytest.raises(ValueError):
            validation.assert_ordered(valid, train)


def test_read_files_and_validate(spark, tmp_path):
    (tmp_path / "news.tsv").write_text('N1\tsports\tfootball\tSome "" Title\t\thttp://x\t[]\tNA\nN2\tsports\tx\t"Quoted ""a"""\tAbs\thttp://y\t[]\t[]\n')
    news = files.read_news(spark, str(tmp_path / "news.tsv")).orderBy("news_id").collect()
    assert news[0]["abstract"] is None and news[0]["title_entities"] == "[]" and news[0]["abstract_entities"] == "NA"
    assert news[1]["title"] == 'Quoted "a"'
    (tmp_path / "beh.tsv").write_text("1\tU1\t2/27/2021 9:40:03 AM\tN1 N2\tN1-1 N2-0\n2\tU2\t2/27/2021 1:40:03 PM\t\tN1-0\n")
    rows = files.read_behaviors(spark, str(tmp_path / "beh.tsv")).orderBy("impression_id").collect()
    assert rows[0]["time"] == T0 and rows[1]["time"].hour == 13 and rows[1]["history"] is None
    (tmp_path / "twice.tsv").write_text("N1\ta\tb\tT\t\tu\t[]\t[]\n" * 2)
    with pytest.raises(validation.SchemaError):
        files.read_news(spark, str(tmp_path / "twice.tsv"))


def test_metrics_by_hand(spark):
    rows = [(1, "a", 3.0, 0), (1, "b", 2.0, 1), (1, "c", 1.0, 1), (2, "a", 1.0, 0), (3, "b", 1.0, 0), (3, "a", 1.0, 1)]
    df = spark.createDataFrame(rows, "impression_id long, item_id string, score double, clicked int")
    got = {r["impression_id"]: r for r in ranking.metrics(ranking.positions(df, "score"), 2).collect()}
    assert (got[1]["hit"], got[1]["recall"], got[1]["mrr"]) == (1.0, 0.5, 0.5)
    import math

    assert math.isclose(got[1]["ndcg"], (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[2]["hit"], got[2]["recall"], got[2]["ndcg"], got[2]["mrr"]) == (0.0, 0.0, 0.0, 0.0)
    assert got[3]["mrr"] == 1.0  # a tie goes to the smaller id


def test_runs_round_trip(spark, tmp_path):
    p = str(tmp_path / "runs.jsonl")
    assert files.read_runs(spark, p).count() == 0
    files.append_run(p, "a", {"k": "10"}, {"hit": 0.5})
    files.append_run(p, "b", {}, {"hit": 0.75})
    from tidemark.operators.serving import stage_deltas

    wide = files.runs_wide(files.read_runs(spark, p), ["hit"])
    got = stage_deltas(wide, ["a", "b"], ["hit"]).orderBy("stage_no").collect()
    assert [r["hit_delta"] for r in got] == [None, 0.25]
    with pytest.raises(ValueError):
        validation.require_runs(wide, ["a", "c"])
