"""Numbers and running totals over whole tables without a window that holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256


def numbered(df: DataFrame, key: str, name: str = "place", parts: int = PARTS) -> DataFrame:
    """df with name: 0, 1, 2, ... over its rows, in the order of a hash of key (a column with distinct values).

    Rows are numbered inside hash parts; the parts' sizes, `parts` rows, give the offsets."""
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    rows = df.withColumn("__part", part)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    out = rows.withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__offset") + F.col("__inside")).drop("__part", "__inside", "__offset")


def in_parts(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """df with __part, ascending with order (numeric): approximate quantiles, at most `parts` numbers that are gathered on
    the driver, cut the table into parts of similar size. What is exact for any cuts may build on it."""
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    return df.withColumn("__part", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0))


def running_total(df: DataFrame, order: str, amount: str, name: str = "upto", parts: int = 64) -> DataFrame:
    """df with name: the sum of amount over rows whose order is not greater. order: numeric, distinct values.

    Sums run inside each part, and the parts' totals give the offsets."""
    rows = in_parts(df, order, parts)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__part").agg(F.sum(amount).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.sum(amount).over(Window.partitionBy("__part").orderBy(order))
    out = rows.withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__offset") + F.col("__inside")).drop("__part", "__inside", "__offset")


def with_previous(df: DataFrame, order: str, value: str, name: str, then: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """df with name: value of the row before, by order (numeric) and then the columns that break its ties; null for the
    first. Parts hold whole values of order; the first row of each takes what the last part before it ends with."""
    rows = in_parts(df, order, parts)
    keys = [order, *then]
    inside = Window.partitionBy("__part").orderBy(*keys)
    ends = rows.groupBy("__part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*keys)).alias("__end"))
    ends = ends.select("__part", F.lag("__end").over(Window.orderBy("__part")).alias("__end"))  # a row per part
    rows = rows.withColumns({"__at": F.row_number().over(inside), "__before": F.lag(value).over(inside)}).join(F.broadcast(ends), "__part")
    return rows.withColumn(name, F.when(F.col("__at") == 1, F.col("__end.v")).otherwise(F.col("__before"))).drop("__part", "__at", "__before", "__end")


def rolling(df: DataFrame, order: str, frame: int, block: int | None = None, **made: Column) -> DataFrame:
    """df with the made columns: aggregates over the row and the frame - 1 before it, by order (numeric, distinct).

    Rows get their place, and go to the block of it; the last frame - 1 of a block go to the next one too, where they
    only serve as predecessors. A window runs inside each block, so no task holds more than block + frame rows."""
    block = block or max(4 * frame, 20_000)
    if block < frame - 1:
        raise ValueError("a block must hold a frame")
    placed = running_total(df.withColumn("__one", F.lit(1)), order, "__one", "__place").withColumn("__place", F.col("__place") - 1).drop("__one")
    own = F.floor(F.col("__place") / block)
    tail = F.col("__place") % block >= block - (frame - 1)
    rows = placed.withColumn("__own", own).withColumn("__block", F.explode(F.when(tail, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    w = Window.partitionBy("__block").orderBy("__place").rowsBetween(-(frame - 1), 0)
    return rows.withColumns({k: c.over(w) for k, c in made.items()}).where("__block = __own").drop("__own", "__block", "__place")


def exact_quantiles(df: DataFrame, column: str, shares: list[float], amount: str | None = None) -> DataFrame:
    """One row, quantiles (array): linearly interpolated, of the values that are not null; null without any. amount names a
    column that says how many rows each row stands for.

    Values are counted, the counts run up in parts, and a last pass picks the values at the places asked for, so that
    no task sorts or holds all of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg((F.sum(amount) if amount else F.count(F.lit(1))).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return df.sparkSession.range(1).select(F.lit(None).cast("array<double>").alias("quantiles"))
    spots = [(total - 1) * s for s in shares]
    places = sorted({p for s in spots for p in (int(s), min(int(s) + 1, total - 1))})
    upto = running_total(counts, "x", "n", "upto")
    at = upto.agg(*[F.min(F.when(F.col("upto") > p, F.col("x").cast("double"))).alias(f"v{p}") for p in places])
    value = lambda s: F.col(f"v{int(s)}") + (F.col(f"v{min(int(s) + 1, total - 1)}") - F.col(f"v{int(s)}")) * (s - int(s))
    return at.select(F.array(*[value(s) for s in spots]).alias("quantiles"))
