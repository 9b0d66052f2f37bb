import json

import pytest

from tidemark.sources import files, kafka
from tidemark.sources.files import save_latest
from tidemark.streaming import consumer


def event(i, kind, user, item, at, **more):
    return json.dumps({"event_id": i, "event_type": kind, "schema_version": 1, "user_id": user, "item_id": item, "impression_id": 1, "timestamp": at, "source": "t"} | more)


def test_parse_rejects_what_is_not_exact(spark):
    good = event("1", "click", "u", "a", "2020")
    bad = ["not json {{{", event("2", "buy", "u", "a", "2020"), event("3", "click", "u", "a", "2020", schema_version=999), event("4", "click", "u", "a", "2020", extra=1), "[1]", "{}"]
    df = spark.createDataFrame([(x,) for x in [good, *bad, good]], "value string")
    parsed = consumer.parse(df)
    assert sorted(r["ok"] for r in parsed.collect()) == [False] * 6 + [True] * 2
    c = consumer.counters(parsed).first()
    assert (c["total"], c["malformed"], c["duplicates"], c["click"]) == (8, 6, 1, 1)


def test_stream_equals_recomputation_across_a_restart(spark, tmp_path):
    lines = [event(f"e{i:03d}", ("impression", "click", "skip")[i % 3], f"u{i % 2}", f"n{i}", f"2020-01-01T00:{i:02d}:00") for i in range(60)]
    lines += lines[:5]  # repeats

    def run():
        raw = spark.readStream.text(str(tmp_path / "in"))
        q = consumer.user_states(consumer.parse(raw)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(
            lambda b, i: save_latest(b, str(tmp_path / "store"), i)
        ).trigger(availableNow=True).start()
        q.awaitTermination()

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(lines[:30]))
    run()
    (tmp_path / "in/b.txt").write_text("\n".join(lines[30:]))
    run()
    got = {r["user_id"]: (list(r["recent"]), r["impressions"], r["clicks"]) for r in files.latest(spark, str(tmp_path / "store")).collect()}
    once = consumer.parse(spark.createDataFrame([(x,) for x in lines], "value string")).where("ok").dropDuplicates(["event_id"])
    want = {r["user_id"]: (list(r["recent"]), r["impressions"], r["clicks"]) for r in consumer.recomputed(once).collect()}
    assert got == want


def test_store_of_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda *r: spark.createDataFrame(list(r), "user_id string, n int, word string")
    save_latest(row(("a", 1, "x"), ("b", 1, None)), path, 0, now="2024-01-01 00:00:00")
    save_latest(row(("a", 2, None)), path, 1, now="2024-01-01 01:00:00")
    save_latest(row(("a", 2, None)), path, 1, now="2024-01-01 01:00:00")  # the batch again
    got = {r["user_id"]: (r["n"], r["word"], r["version"]) for r in files.latest(spark, path).collect()}
    assert got == {"a": (2, None, 1), "b": (1, None, 0)}  # the whole record is replaced
    assert {r["user_id"]: r["n"] for r in files.latest(spark, path, upto=0).collect()} == {"a": 1, "b": 1}
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    found = files.lookup(files.latest(spark, path), keys, ttl_seconds=3600, now="2024-01-01 01:00:01").collect()
    assert {r["user_id"]: r["n"] for r in found} == {"a": 2, "b": None, "c": None}
    files.compact(spark, path, str(tmp_path / "next"), ttl_seconds=3600, now="2024-01-01 01:00:01")
    assert [(r["user_id"], r["n"]) for r in files.latest(spark, str(tmp_path / "next")).collect()] == [("a", 2)]


def test_poll_stops_at_the_bound_or_when_idle(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.txt").write_text("\n".join(event(f"{i}{j}", "click", "u", "a", "2020") for j in range(3)) + "\n{broken")
    take = lambda b, i: seen.append((consumer.parse(b).where("ok").count(), b.count()))
    got = kafka.poll(kafka.read_files(spark, str(folder), 1), take, str(tmp_path / "ck"), most=8, idle_seconds=20, every=0.1)
    assert 8 <= got["messages"] <= 16 and set(seen) == {(3, 4)}
    got = kafka.poll(kafka.read_files(spark, str(folder), 1), take, str(tmp_path / "ck"), idle_seconds=2, every=0.1)
    assert len(seen) >= 4 and sum(n for _, n in seen) >= 16
    assert kafka.poll(kafka.read_files(spark, str(folder), 1), take, str(tmp_path / "ck"), idle_seconds=0.5, warm_up=3, every=0.1) == {"messages": 0, "batches": 0}

    def broken(b, i):
        raise ValueError("no batch")

    with pytest.raises(Exception, match="no batch"):
        kafka.poll(kafka.read_files(spark, str(folder), 1), broken, str(tmp_path / "other"), idle_seconds=20)


def test_bounded_deduplication_forgets_behind_the_watermark(spark, tmp_path):
    lines = [event("1", "click", "u", "a", "2020-01-01T00:00:00"), event("1", "click", "u", "a", "2020-01-01T00:00:00"), event("2", "click", "u", "b", "2020-01-01T05:00:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    stream = consumer.deduplicated(consumer.parse(kafka.read_files(spark, str(tmp_path / "in"))), "1 hour")
    kept = []
    kafka.drain(stream, lambda b, i: kept.extend(r["event_id"] for r in b.collect()), str(tmp_path / "ck"))
    assert sorted(kept) == ["1", "2"]
    states = consumer.user_states(consumer.parse(kafka.read_files(spark, str(tmp_path / "in"))), "1 hour")
    out = []
    states.writeStream.outputMode("update").foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["clicks"], list(r["recent"])) for r in out] == [(2, ["a", "b"])]


def test_state_parity_sees_a_difference(spark):
    e = spark.createDataFrame([(f"e{i}", ("click", "impression")[i % 2], f"u{i % 3}", f"n{i}", f"2020-01-01T00:0{i}") for i in range(8)], "event_id string, event_type string, user_id string, item_id string, timestamp string")
    right = consumer.recomputed(e)
    assert tuple(consumer.state_parity(right, e).first()) == (3, 3)
    wrong = right.withColumn("clicks", right["clicks"] + (right["user_id"] == "u1").cast("int"))
    assert tuple(consumer.state_parity(wrong, e).first()) == (3, 2)
    assert tuple(consumer.state_parity(right.where("user_id <> 'u2'"), e).first()) == (3, 2)


def test_stream_state_does_not_depend_on_the_order_of_arrival(spark, tmp_path):
    lines = [event(f"e{i:03d}", ("impression", "click", "skip")[i % 3], f"u{i % 2}", f"n{i}", f"2020-01-01T{i // 60:02d}:{i % 60:02d}:00") for i in range(180)]
    (tmp_path / "in").mkdir()
    for name, part in (("a", lines[90:]), ("b", lines[:90])):  # the later half comes first
        (tmp_path / f"in/{name}.txt").write_text("\n".join(part))
        states = consumer.user_states(consumer.parse(kafka.read_files(spark, str(tmp_path / "in"))))
        q = states.writeStream.outputMode("update").foreachBatch(consumer.upsert_into(str(tmp_path / "store"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["user_id"]: (list(r["recent"]), r["impressions"], r["clicks"], r["last_event_time"]) for r in files.latest(spark, str(tmp_path / "store")).collect()}
    again = consumer.recomputed(consumer.parse(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert got == {r["user_id"]: (list(r["recent"]), r["impressions"], r["clicks"], r["last_event_time"]) for r in again.collect()}
