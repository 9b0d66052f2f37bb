"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups, proofs and their check.

Levels are windows: a node's children lie in the partition of (group, parent index), where the ordered collect_list over
the full frame is the parent's preimage and holds the siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, checked_broadcast

#: Levels of a tree that are climbed between two shuffles, inside blocks of 2**LEVELS nodes.
LEVELS = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the values one after another: `-` for null, else UTF-8 byte count, `:`, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A string without nulls that sorts as the groups do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _placed(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """nodes (g, order columns, ...) with place (0, 1, ... in g by order) and size (rows of g); and the largest size.

    Rows are dealt by ranges of (g, order) and written sorted, so a group of any size lies in many tasks; a table with a
    row per task and group gives the offsets."""
    order = ["g", *order]
    rows = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = scratch.save(rows, f"{name}-rows").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    runs = scratch.save(runs.select("g", "part", start.alias("start"), F.sum("n").over(group).alias("size")), f"{name}-runs")
    most = runs.agg(F.max("size")).first()[0] or 0
    out = rows.join(checked_broadcast(runs), ["g", "part"]).withColumn("place", F.col("start") + F.col("at"))
    return out.drop("at", "part", "start"), most


def _climb(rows: DataFrame) -> DataFrame:
    """rows (g, place, size, node) with node replaced by their block's node LEVELS levels up, and path, the steps there.

    A step is `<` or `>` and the digest of the sibling to the left or right, or empty where the last node is hashed
    alone; a tree that has come down to one node takes no more steps. Each node is counted once, by its first row."""
    rows = rows.withColumn("block", F.shiftright("place", LEVELS)).repartition("g", "block")
    steps = []
    for k in range(LEVELS):
        w = Window.partitionBy("g", "block", F.shiftright("place", k + 1)).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.col("place").bitwiseAND((1 << k) - 1) == 0
        rows = rows.withColumn("kids", F.collect_list(F.when(first, F.col("node"))).over(w))
        alive = F.col("size") > (1 << k)
        right = F.col("place").bitwiseAND(1 << k) != 0
        step = F.when(F.size("kids") == 1, F.lit("")).when(right, F.concat(F.lit("<"), F.col("kids")[0])).otherwise(F.concat(F.lit(">"), F.col("kids")[1]))
        rows = rows.withColumn(f"step{k}", F.when(alive, step))
        rows = rows.withColumn("node", F.when(alive, F.sha2(F.array_join("kids", ""), 256)).otherwise(F.col("node")))
        steps.append(F.col(f"step{k}"))
    path = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return rows.withColumn("path", path).drop("kids", *[f"step{k}" for k in range(LEVELS)])


def _tree(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of a tree per group, each with g, place, block, path (the first with what nodes has besides); and the
    groups: g, node. nodes: g, order columns, node. A round leaves a row per block, 2**LEVELS times fewer."""
    rows, most = _placed(nodes, order, scratch, name)
    rounds = []
    while True:
        rounds.append(scratch.save(_climb(rows), f"{name}-round{len(rounds)}"))
        tops = rounds[-1].where(F.col("place").bitwiseAND((1 << LEVELS) - 1) == 0)
        rows = tops.select("g", F.col("block").alias("place"), F.ceil(F.col("size") / (1 << LEVELS)).cast("long").alias("size"), "node")
        most = -(-most // (1 << LEVELS))
        if most <= 1:
            return [r.drop("size", "node") for r in rounds], rows.select("g", "node")


def _descend(rounds: list[DataFrame], upper: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The first round's rows with their path up to what upper (g, block, up, ...) begins at."""
    for k in range(len(rounds) - 1, -1, -1):
        joined = rounds[k].join(checked_broadcast(upper), ["g", "block"]).withColumn("path", F.concat("path", "up")).drop("up", "block")
        if not k:
            return joined.drop("place")
        below = joined.withColumnRenamed("place", "block").withColumnRenamed("path", "up")
        upper = scratch.save(below, f"{name}-upper{k}")


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (g from group_key, leaf, order columns and others) with subroot, root and path, the proof from leaf to root.

    In each group leaves ascend by order (nulls first), then by digest; while several nodes remain, every two consecutive
    ones become their hash, an odd last one its own. Subroots, ascending by g, give the root in the same way. A group of
    one leaf has it for its subroot and takes no step. Repeated rows are leaves each; an empty table gives no row."""
    scratch = Scratch(leaves.sparkSession, "merkle")
    base = scratch.save(leaves.withColumn("node", F.col("leaf")).withColumn("row", F.monotonically_increasing_id()), "leaves")
    rounds, subroots = _tree(base, [*order, "leaf", "row"], scratch, "groups")
    subroots = scratch.save(subroots, "subroots")
    tops, root = _tree(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("node").alias("subroot"), "node"), ["name"], scratch, "top")
    no_steps = F.array().cast("array<string>")
    root = scratch.save(root.select("g", F.lit(0).cast("long").alias("block"), no_steps.alias("up"), F.col("node").alias("root")), "root")
    groups = _descend(tops, root, scratch, "top").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), F.col("path").alias("up"), "subroot", "root")
    return _descend(rounds, scratch.save(groups, "tops"), scratch, "groups").drop("row")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    pair = lambda node, step: F.when(F.startswith(step, F.lit("<")), F.concat(F.substring(step, 2, 64), node)).otherwise(F.concat(node, F.substring(step, 2, 64)))
    return F.aggregate(path, leaf, lambda node, step: F.sha2(pair(node, step), 256))


def siblings(path: Column) -> Column:
    """The proof's digests in order, joined."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


def audit(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified; and path.

    The tree stands over the rows as they are. changed (column -> expression) gives the values with which they are checked
    again: folded_root is what the changed row's digest and the original siblings give, verified whether that is the
    root. Nulls of any column count as `-`; null keys come first; extra columns are ignored."""
    now = [(changed or {}).get(c, F.col(c)) for c in columns]
    leaves = docs.select(F.col(key).alias("id"), group_key(F.col(group)).alias("g"), leaf_digest(*map(F.col, columns)).alias("leaf"), leaf_digest(*now).alias("again"))
    out = manifest(leaves, ["id"])
    out = out.select(F.col("id").alias(key), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("again"), F.col("path")).alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
