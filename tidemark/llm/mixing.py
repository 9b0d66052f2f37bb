"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Scratch, checked_broadcast

#: Weights by rank of the source, repeating; share of all words that the mix takes; most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Cells by hash into which a source's words are cut for rounding.
CELLS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) of each source -> source, source_size, weight, target: share of the total by weight, at most
    `most` times the source's size, the excess reshared by weight. The level at which water stands over the sources
    sorted by room per weight gives the fixed point of that resharing at once. One row per source throughout: the
    windows sort a table of names and counts, no documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", F.col("size").alias("source_size"), w.alias("weight"))
    s = s.withColumn("room", F.col("source_size") * F.lit(float(most))).withColumn("per", F.col("room") / F.col("weight"))
    fill = Window.orderBy("per", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(rest))
    # the first source whose room is not reached has the level of all that follow
    level = F.min(F.when(F.col("level") <= F.col("per"), F.struct("per", "level"))).over(everything)["level"]
    target = F.least(F.col("room"), F.col("weight") * F.coalesce(level, F.lit(math.inf)))
    return s.select("source", "source_size", "weight", target.alias("target"))


def solve_dual(x: np.ndarray, mass: np.ndarray, target: float, most: int, rounds: int = 100, tol: float = 1e-9) -> float:
    """The multiplier at which the words taken, sum(mass * min(most, exp(lam * x))), meet the target: Newton steps on
    the logarithm of the sum, inside a bracket. x: the classes' tilts, positive; mass: their words."""
    lo = hi = 0.0
    taken = lambda lam: float((mass * np.exp(np.minimum(lam * x, math.log(most)))).sum())
    if not 0 < target < most * mass.sum():
        return -math.inf if target <= 0 else math.inf
    while taken(lo) > target:
        lo = 2 * lo - 1
    while taken(hi) < target:
        hi = 2 * hi + 1
    lam = 0.0
    for _ in range(rounds):
        e = mass * np.exp(np.minimum(lam * x, math.log(most)))
        f, slope = float(e.sum()), float((e * x)[lam * x < math.log(most)].sum())
        if abs(f - target) <= tol * target:
            break
        lo, hi = (lo, lam) if f > target else (lam, hi)
        step = lam - math.log(f / target) * f / slope if slope > 0 else math.inf
        lam = step if lo < step < hi else (lo + hi) / 2
    return lam


def class_rates(levels: np.ndarray, n: np.ndarray, mass: np.ndarray, target: float, most: int) -> np.ndarray:
    """Rate of each class of sizes: exp(lam * level / mean size), at most `most`; classes without words keep 1."""
    total = float(mass.sum())
    some = mass > 0
    rate = np.ones(len(levels))
    if total > 0:
        x = levels[some] * (n.sum() / total)
        lam = solve_dual(x, mass[some], target, most)
        rate[some] = np.exp(np.minimum(lam * x, math.log(most))) if math.isfinite(lam) else (float(most) if lam > 0 else 0.0)
    return rate


def diffuse(levels: np.ndarray, rates: np.ndarray, masses: list[np.ndarray], most: int) -> np.ndarray:
    """How many cells of each class, in hash order, take one copy more than the rounded-down rate. From the largest
    sizes to the smallest, each class takes the cells whose words come nearest to what is due, and what is then missing
    or too much is carried to the next. masses: the words of each class's cells."""
    cuts, carry = np.zeros(len(levels), np.int64), 0.0
    for i in np.argsort(-levels, kind="stable"):
        base = math.floor(rates[i] + 1e-9)
        due = max(rates[i] - base, 0.0) * masses[i].sum() + carry
        upto = np.concatenate([[0.0], np.cumsum(masses[i]) if base < most and levels[i] > 0 else []])
        cuts[i] = int(np.abs(upto - due).argmin())
        carry = due - upto[cuts[i]]
    return cuts


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs plus size, source_size, target, rate and copies (int, 0 to most), by entropy balancing.

    Size is the number of words. Documents are tilted by the class of their size: exact below 128 words, then 64
    classes an octave, so that a source has at most some 3,700 classes at any size of the input and their counts and
    words, aggregated before any shuffle, are all that the dual of its token constraint depends on. Every source's
    Newton iteration runs in its own group. Rates are rounded down; the lost fractions are given back to the documents
    of least hash in each class, by cells of a hash whose words are counted exactly, class by class with the remainder
    carried on (diffuse), so that a source misses its target by half a cell or document at most. Five jobs over the
    documents or their counts, whatever the number of sources. Reruns agree: nothing is random.

    Null text has size 0; null source is a source of its own, last in order. Documents without words get 1 copy. Rows
    that repeat id and text get equal copies. Extra columns pass through, unless they have a name of the result's; an
    empty table gives an empty result. In input, needs doc_id, text, source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    made = ["size", "source_size", "target", "rate", "copies"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    kind = docs.schema["source"].dataType.simpleString()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), "text"), F.lit(1 << 40)) / float(1 << 40)
    shift = F.greatest(F.length(F.bin("size")) - 7, F.lit(0))
    level = F.call_function("shiftleft", F.call_function("shiftright", F.col("size"), shift), shift)

    thin = scratch.save(docs.select("source", size.alias("size"), place.alias("place")).withColumn("level", level), "thin")
    classes = thin.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass"))
    classes = scratch.save(classes, "classes")
    targets = scratch.save(source_targets(classes.groupBy("source").agg(F.sum("mass").alias("size")), weights, share, most), "targets")

    def rates(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("level")
        mass = g["mass"].to_numpy(float)
        rate = class_rates(g["level"].to_numpy(float), g["n"].to_numpy(float), mass, float(g["target"].iloc[0]), most)
        cells = np.maximum(np.minimum(np.ceil(CELLS * mass / max(mass.sum(), 1.0)), g["n"]), 1).astype(np.int64)
        return g[["source", "level", "source_size", "target"]].assign(rate=rate, cells=cells)

    rated = _meet(classes, targets, ["source"]).select("source", "level", "n", "mass", F.col("source_size").cast("long").alias("source_size"), "target")
    rated = rated.groupBy("source").applyInPandas(rates, f"source {kind}, level long, source_size long, target double, rate double, cells long")
    rated = scratch.save(rated, "rated")
    cell = F.floor(F.col("place") * F.col("cells"))
    cells = _meet(thin, rated, ["source", "level"]).groupBy("source", "level", cell.alias("cell")).agg(F.sum("size").alias("words"))
    cells = scratch.save(_meet(cells, rated, ["source", "level"]), "cells")

    def cuts(g: pd.DataFrame) -> pd.DataFrame:
        by = [x.sort_values("cell") for _, x in g.groupby("level")]
        one = [x.iloc[0] for x in by]
        masses = [np.bincount(x["cell"], x["words"], int(x["cells"].iloc[0])) for x in by]
        levels, rate = np.array([x["level"] for x in one], float), np.array([x["rate"] for x in one], float)
        cut = diffuse(levels, rate, masses, most)
        head = pd.DataFrame([x[["source", "level", "source_size", "target", "rate", "cells"]] for x in one])
        return head.assign(base=np.where(levels > 0, np.floor(rate + 1e-9), 1).astype(np.int64), cut=cut)

    plan = cells.groupBy("source").applyInPandas(cuts, f"source {kind}, level long, source_size long, target double, rate double, cells long, base long, cut long")
    plan = scratch.save(plan, "plan")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")  # so that no name of theirs meets one of ours
    out = docs.select(own, "source", size.alias("size"), place.alias("place")).withColumn("level", level)
    out = _meet(out, plan, ["source", "level"])
    copies = (F.col("base") + (cell < F.col("cut")).cast("int")).cast("int")
    return out.select("own.*", "size", "source_size", "target", "rate", copies.alias("copies"))


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns that right has besides, by keys (null is a value); right, a written table, has one row a
    key and is broadcast if it is small, else Spark splits the partitions of hot keys."""
    side = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in left.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(checked_broadcast(side), on).drop(*[f"__{k}" for k in keys])
