"""Interaction events: strict parsing, deduplication, per-user state, replay, recomputation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ordering import with_previous

FIELDS = {"event_id": "string", "event_type": "string", "schema_version": "int", "user_id": "string", "item_id": "string", "impression_id": "bigint", "timestamp": "string", "source": "string"}
TYPES, VERSION, RECENT = ("impression", "view", "click", "skip"), 1, 20
STATE = "recent array<string>, impressions bigint, clicks bigint, last_event_time string"
OUT = f"user_id string, {STATE}"
KEPT = f"{STATE}, times array<string>, ids array<string>"


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw with its fields and ok: a JSON object with exactly the known keys, a known type, the version, and no null."""
    schema = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
    e = F.from_json(F.col(column).cast("string"), schema)
    keys = F.array_sort(F.json_object_keys(F.col(column).cast("string")))
    out = raw.withColumn("e", e).withColumn("keys", keys)
    ok = (F.col("keys") == F.array(*[F.lit(k) for k in sorted(FIELDS)])) & F.col("e.event_type").isin(*TYPES) & (F.col("e.schema_version") == VERSION)
    for k in FIELDS:
        ok = ok & F.col(f"e.{k}").isNotNull()
    return out.select(*raw.columns, "e.*", F.coalesce(ok, F.lit(False)).alias("ok"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last clicks are those by (timestamp, event_id), whatever the order of arrival: files of a batch, and batches, may
    bring a user's events out of order."""
    recent, shown, clicks, last, times, ids = state.get if state.exists else ([], 0, 0, None, [], [])
    held = list(zip(times, ids, recent, strict=True))
    for f in frames:
        for kind, item, at, number in zip(f.event_type.tolist(), f.item_id.tolist(), f.timestamp.tolist(), f.event_id.tolist(), strict=True):
            if kind == "impression":
                shown += 1
            elif kind == "click":
                clicks += 1
                held.append((at, number, item))
            last = at if last is None or at > last else last
        held = sorted(held)[-RECENT:]
    times, ids, recent = [x[0] for x in held], [x[1] for x in held], [x[2] for x in held]
    state.update((recent, shown, clicks, last, times, ids))
    yield pd.DataFrame({"user_id": [key[0]], "recent": [recent], "impressions": [shown], "clicks": [clicks], "last_event_time": [last]})


def deduplicated(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """The good events, repeats of an event_id once. Without a horizon every id is kept for good; with one (a duration) an
    id is forgotten once the watermark of the events' time is past it, so the state is bounded by what comes meanwhile."""
    good = events.where("ok")
    if horizon is None:
        return good.dropDuplicates(["event_id"])
    timed = good.withColumn("event_time", F.to_timestamp("timestamp")).withWatermark("event_time", horizon)
    return timed.dropDuplicatesWithinWatermark(["event_id"])


def user_states(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """A stream of parsed events -> the changed user states of each batch; repeats of an event_id count once."""
    return deduplicated(events, horizon).groupBy("user_id").applyInPandasWithState(_advance, OUT, KEPT, "update", GroupStateTimeout.NoTimeout)


def upsert_into(path: str):
    """A foreachBatch function that saves the states that a batch changed as the store's version of its number."""
    from ..sources.files import save_latest

    def write(batch: DataFrame, number: int) -> None:
        save_latest(batch, path, number)

    return write


def running_counts(parsed: DataFrame, horizon: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two streams of counts: messages by ok and event_type, and distinct good events by event_type."""
    by = parsed.groupBy("ok", F.when(F.col("ok"), F.col("event_type")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return by, deduplicated(parsed, horizon).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_counters(messages: DataFrame, distinct: DataFrame) -> DataFrame:
    """One row of the newest running_counts: total, malformed, duplicates, distinct events by type."""
    all_ = messages.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("malformed"))
    kinds = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("good"), *[F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("n"))), F.lit(0)).alias(t) for t in TYPES])
    out = all_.crossJoin(F.broadcast(kinds))  # a row each
    return out.select("total", "malformed", (F.col("total") - F.col("malformed") - F.col("good")).alias("duplicates"), *TYPES)


def counters(parsed: DataFrame) -> DataFrame:
    """One row: totals, malformed, duplicates, events by type, distinct users and items."""
    good = F.col("ok")
    return parsed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~good).alias("malformed"), (F.count_if(good) - F.countDistinct(F.when(good, F.col("event_id")))).alias("duplicates"),
        *[F.countDistinct(F.when(good & (F.col("event_type") == t), F.col("event_id"))).alias(t) for t in TYPES],
        F.countDistinct(F.when(good, F.col("user_id"))).alias("users"), F.countDistinct(F.when(good, F.col("item_id"))).alias("items"),
    )


def recomputed(events: DataFrame, cutoff=None) -> DataFrame:
    """The same features from the whole log (event_id, event_type, user_id, item_id, timestamp) up to an inclusive
    cutoff, without deduplication. The last clicks are cut per task before they meet."""
    if cutoff is not None:
        events = events.where(F.col("timestamp") <= F.lit(cutoff))
    recent = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("event_id"))
    clicks = events.where("event_type = 'click'").withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= RECENT)
    lists = clicks.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("o"), "item_id"))), lambda x: x["item_id"]).alias("recent"))
    counts = events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "impression").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.max("timestamp").alias("last_event_time")
    )
    return counts.join(lists, "user_id", "left").select("user_id", F.coalesce("recent", F.array().cast("array<string>")).alias("recent"), "impressions", "clicks", "last_event_time")


def replay_events(log: DataFrame, limit: int | None = None, speed: float = 1.0) -> DataFrame:
    """Two events per candidate in log order (time, impression, place), with the pause that a replay at `speed` makes."""
    rows = log.orderBy("time", "impression_id", "item_id").limit(limit) if limit is not None else log
    rows = with_previous(rows.withColumn("at", F.unix_timestamp("time")), "at", "at", "before", ("impression_id", "item_id"))
    gap, ordered = F.col("at") - F.col("before"), rows.orderBy("time", "impression_id", "item_id")
    both = F.array(F.lit("impression"), F.when(F.col("clicked") == 1, "click").otherwise("skip"))
    out = ordered.withColumn("pause", F.greatest(F.coalesce(gap / speed, F.lit(0.0)), F.lit(0.0)))
    return out.select("impression_id", "user_id", "item_id", "time", "pause", F.posexplode(both).alias("step", "event_type")).select(
        F.sha2(F.concat_ws("|", "impression_id", "item_id", "step"), 256).alias("event_id"), "event_type", F.lit(VERSION).alias("schema_version"), F.col("user_id").cast("string").alias("user_id"),
        F.col("item_id").cast("string").alias("item_id"), "impression_id", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("replay").alias("source"), "pause", "step",
    )


def lag_report(progress: dict) -> list[dict]:
    """Per partition of a stream's sources: how far the committed offset is behind the latest, 0 at least."""
    out = []
    for s in progress.get("sources", []):
        end, latest = s.get("endOffset") or {}, s.get("latestOffset") or {}
        for topic, parts in latest.items() if isinstance(latest, dict) else ():
            for p, x in parts.items():
                out.append({"topic": topic, "partition": p, "lag": max(x - end.get(topic, {}).get(p, 0), 0)})
    return out


def recent_features(states: DataFrame) -> DataFrame:
    """User states as the features that a request looks up: user_id, recent, impressions, clicks, last_event_time."""
    return states.select("user_id", F.coalesce("recent", F.array().cast("array<string>")).alias("recent"), "impressions", "clicks", "last_event_time")


def state_parity(states: DataFrame, events: DataFrame) -> DataFrame:
    """users, matching: how many users the streamed states and the recomputation from the same events have, and of how many
    all features agree."""
    again = recomputed(events).select(F.col("user_id").cast("string").alias("user_id"), F.col("recent").alias("r2"), F.col("impressions").alias("i2"), F.col("clicks").alias("c2"))
    both = recent_features(states).join(again, "user_id", "full")
    same = F.col("recent").eqNullSafe(F.col("r2")) & F.col("impressions").eqNullSafe(F.col("i2")) & F.col("clicks").eqNullSafe(F.col("c2"))
    return both.agg(F.count(F.lit(1)).alias("users"), F.count_if(same).alias("matching"))


def parity(events: DataFrame, least_times: int = 5) -> DataFrame:
    """user_id, cutoff, impressions, clicks, matches: for every user with at least `least_times` distinct times, at the
    first, the middle and the last of these, whether the running state equals what is recomputed from the log up to the
    cutoff. The state runs over the user's events in arrival order; the recomputation aggregates the events up to each
    cutoff by itself. events: event_id, event_type, user_id, item_id, timestamp."""
    times = events.select("user_id", "timestamp").distinct()
    by = Window.partitionBy("user_id")
    times = times.withColumns({"i": F.row_number().over(by.orderBy("timestamp")), "n": F.count(F.lit(1)).over(by)})
    cuts = times.where((F.col("n") >= least_times) & F.expr("i = 1 or i = n div 2 + 1 or i = n")).select("user_id", F.col("timestamp").alias("cutoff"))
    running, kind = by.orderBy("timestamp").rangeBetween(Window.unboundedPreceding, Window.currentRow), F.col("event_type")
    state = events.select(
        "user_id", "timestamp", F.count_if(kind == "impression").over(running).alias("impressions"), F.count_if(kind == "click").over(running).alias("clicks")
    ).dropDuplicates(["user_id", "timestamp"])
    online = cuts.join(state, (state["user_id"] == cuts["user_id"]) & (state["timestamp"] == cuts["cutoff"])).select(cuts["user_id"], "cutoff", "impressions", "clicks")
    # the last clicks of a state are those whose numbers end at its count
    numbers = events.where(kind == "click").select("user_id", "item_id", F.row_number().over(by.orderBy("timestamp", "event_id")).alias("k"))
    last = online.select("user_id", "cutoff", "clicks").join(numbers, "user_id").where((F.col("k") <= F.col("clicks")) & (F.col("k") > F.col("clicks") - RECENT))
    last = last.groupBy("user_id", "cutoff").agg(F.array_sort(F.collect_list(F.struct("k", "item_id"))).alias("c"))
    last = last.select("user_id", "cutoff", F.transform("c", lambda x: x["item_id"]).alias("recent"))
    online = online.join(last, ["user_id", "cutoff"], "left").withColumn("recent", F.coalesce("recent", F.array().cast("array<string>")))
    named = cuts.select(F.struct("user_id", "cutoff").alias("key"), F.col("user_id").alias("u"), "cutoff")
    upto = named.join(events, (F.col("u") == events["user_id"]) & (events["timestamp"] <= F.col("cutoff")))
    again = recomputed(upto.select(F.col("key").alias("user_id"), "event_id", "event_type", "item_id", "timestamp"))
    again = again.select(F.col("user_id.user_id").alias("user_id"), F.col("user_id.cutoff").alias("cutoff"), F.col("impressions").alias("i2"), F.col("clicks").alias("c2"), F.col("recent").alias("r2"))
    both = online.join(again, ["user_id", "cutoff"])
    same = (F.col("impressions") == F.col("i2")) & (F.col("clicks") == F.col("c2")) & (F.col("recent") == F.col("r2"))
    return both.select("user_id", "cutoff", "impressions", "clicks", same.alias("matches"))
