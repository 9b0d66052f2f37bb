"""Near-duplicate detection: one-permutation MinHash, banded buckets, star edges, exact confirmation, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, WordHash, blobs, lean, mix, shingle_set, words_of

BANDS, ROWS = 24, 5


class OnePermutation:
    """Signatures by one permutation: the hashes are cut into bins by their high bits, each bin keeps its least hash,
    and an empty bin copies the bin that a sequence of hashes of its number first finds filled (optimal densification)."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        tries = np.arange(self.bins * 1024, dtype=np.uint64).reshape(self.bins, 1024)
        self.probes = (mix(tries * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) % np.uint64(self.bins)).astype(np.int64)
        self.seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted and distinct, at least one."""
        bins = (((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted: the first of a bin is its least
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[first]], filled[bins[first]] = hashes[first], True
        if len(first) < self.bins:
            empty = np.flatnonzero(~filled)
            for width in (16, 128, 1024):
                hit = filled[self.probes[empty, :width]]
                found = hit.any(axis=1)
                out[empty[found]] = out[self.probes[empty[found], hit[found].argmax(axis=1)]]
                empty = empty[~found]
                if not len(empty):
                    break
            if len(empty):
                out[empty] = hashes[first[0]]
        return out

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit bucket per band, of the band's number and its rows."""
        h = self.seeds.copy()
        for column in self.signature(hashes).reshape(self.bands, self.rows).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return h.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """row (a number of the row), doc_id, text_hash, n (distinct shingles), k1, k2 (128-bit hash of the word sequence),
    buckets. To be written before use: the row numbers hold for the written table alone."""

    def run(batches):
        oph, cache = OnePermutation(bands, rows), WordHash()
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            for text in blobs(batch, "text"):
                words = words_of(text)
                h = xxhash.xxh3_128_intdigest(b" ".join(words))
                k1.append((h >> 64) - (1 << 63))
                k2.append((h & ((1 << 64) - 1)) - (1 << 63))
                hashes = shingle_set(words, k, cache)
                n.append(len(hashes))
                keys.append(oph.buckets(hashes) if len(hashes) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "text_hash", "n", "k1", "k2", "buckets"],
            )

    schema = "doc_id long, text_hash long, n long, k1 long, k2 long, buckets array<long>"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lean(run), schema)
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        cache, last, kept = WordHash(), None, None
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            good = []
            for i, (x, ta, tb) in enumerate(zip(b, blobs(batch, "ta"), blobs(batch, "tb"), strict=True)):
                if x != last:  # joined by b, so its rows come together
                    last, kept = x, shingle_set(words_of(tb), k, cache)
                own = shingle_set(words_of(ta), k, cache)
                both = len(np.intersect1d(own, kept, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(kept) - both):
                    good.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())})

    return _with_texts(pairs, texts).mapInArrow(lean(run), "a long, b long")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, ta, tb. Pairs that grow with the corpus come with a merge hint: their join is a shuffled one at every size."""
    left = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")
    side = texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
    return left.join(side, "b").select("a", "b", "ta", "tb")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) -> (id, label): label is the least id of its component; ids without edges are absent.

    Each round takes the least label of the neighbours, then jumps to the label's own label; labels only fall, and the
    rounds end when none does. Aggregates combine before their shuffle, and Spark splits the join of a hot id."""
    both = scratch.save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-sym")
    first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
    labels = scratch.save(first, f"{name}-0")
    i = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = step.join(up, "label").select("id", "was", F.least("label", "up").alias("label"))
        new = scratch.save(jumped, f"{name}-{i + 1}")
        moved = new.where("label <> was").limit(1).count()
        scratch.drop(f"{name}-{i}")
        labels, i = new.select("id", "label"), i + 1
        if not moved:
            scratch.drop(f"{name}-sym")
            return labels


def differences(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) with b a hub -> a, b, linked, n (shingles of a), d (differences from the hub), r (those removed), prefix.

    A set X that shares a bucket with hub H is H without r removed and with some added shingles. With t = percent / 100,
    two sets X, Y of one hub are linked if and only if they share at least need(X, Y) = c(X) + c(Y) - s of their
    differences, where c = (removed + t * added) / (1 + t) and s = |H| (1 - t) / (1 + t); X is linked to H itself if
    c(X) <= s. So two sets of which one is not linked to H, the only ones that H does not connect, must share
    differences, and by counting they then share one among the first d - need + 1 of each in any common order. prefix
    holds as many as any partner can call for: added shingles first, which are the rarer ones, each part by hash."""
    t = percent / 100

    def run(batches):
        cache, last, hub = WordHash(), None, None
        for batch in batches:
            linked, n, d, r, prefix = [], [], [], [], []
            for b, ta, tb in zip(batch.column(1).to_pylist(), blobs(batch, "ta"), blobs(batch, "tb"), strict=True):
                if b != last:
                    last, hub = b, shingle_set(words_of(tb), k, cache)
                own = shingle_set(words_of(ta), k, cache)
                at = np.searchsorted(hub, own)
                held = hub[np.minimum(at, len(hub) - 1)] == own
                added, removed = own[~held], np.delete(hub, at[held])
                both, size = len(own) - len(added), len(added) + len(removed)
                near = 100 * both >= percent * (len(own) + len(hub) - both)
                cost, slack = (len(removed) + t * len(added)) / (1 + t), len(hub) * (1 - t) / (1 + t)
                need = max(1, math.ceil((cost if near else (1 + t) * (cost - slack)) - 1e-6))
                linked.append(near)
                n.append(len(own))
                d.append(size)
                r.append(len(removed))
                prefix.append(np.concatenate([added, removed])[: max(0, size - need + 1)].view(np.int64))
            offsets = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), *[pa.array(x, pa.int64()) for x in (n, d, r)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["a", "b", "linked", "n", "d", "r", "prefix"],
            )

    return _with_texts(pairs.hint("merge"), texts).mapInArrow(lean(run), "a long, b long, linked boolean, n long, d long, r long, prefix array<long>")


def _classes(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row per input row: row, doc_id, text_hash, n, k1, k2, label (a number of its component)."""
    scratch = Scratch(docs.sparkSession, "near")
    base = scratch.save(sketches(docs, k, bands, rows), "sketch")
    full = base.where("n > 0")
    # side tables of joins are written first: Spark then splits the join of a hot class or bucket
    reps = scratch.save(full.groupBy("k1", "k2").agg(F.min("row").alias("rep")), "reps")
    classes = base.select("row", "doc_id", "text_hash", "n", "k1", "k2").join(reps, ["k1", "k2"], "left")
    classes = scratch.save(classes.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("row"))), "classes")
    # a class enters the search with one of its rows
    members = full.join(reps.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n", F.explode("buckets").alias("bucket"))
    members = scratch.save(members, "all")
    # The hub of a bucket is its member that meets most rows over all its buckets: the middle of its group, not an edge.
    sizes = scratch.save(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sizes")
    members = scratch.save(members.join(sizes, "bucket"), "shared")
    weights = scratch.save(members.groupBy("rep").agg(F.sum("c").alias("weight")), "weights")
    hubs = members.join(weights, "rep").groupBy("bucket").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("hub"))
    hubs = scratch.save(hubs, "hubs")
    members = scratch.save(members.join(hubs, "bucket").select("bucket", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hn")), "members")
    scratch.drop("all")
    alike = 100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")  # a bound on what sets of these sizes can share
    met = members.select(F.col("rep").alias("row")).distinct()
    # one text a class; rows that share id and text have the same, so the join's own partitions drop repeats
    name = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_hash"]
    keys = classes.where("row = rep").join(met, "row", "left_semi").select(*name, "row")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").select(*name, "text")
    texts = named.join(keys.hint("merge"), ["id", "no_id", "text_hash"]).groupBy("id", "no_id", "text_hash").agg(F.min("row").alias("row"), F.min("text").alias("text"))
    texts = scratch.save(texts.select("row", "text"), "texts")

    # Every class is compared with the hub it meets most often.
    stars = members.where((F.col("rep") != F.col("hub")) & alike)
    stars = stars.groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = stars.groupBy("a").agg(F.max(F.struct("c", -F.col("b"))).alias("m")).select("a", (-F.col("m.col2")).alias("b"))
    links = scratch.save(confirmed(scratch.save(best, "stars").hint("merge"), texts, k, percent), "links0")
    label = components(links, scratch, "cc0")

    # Buckets that still hold several components: differences from their hubs, and those who may share enough of them.
    held = members.select("bucket", "rep", "hub").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    held = scratch.save(held.withColumn("label", F.coalesce("label", "rep")), "held")
    mixed = held.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    pairs = held.join(scratch.save(mixed, "mixed"), "bucket").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    diffs = scratch.save(differences(scratch.save(pairs, "pairs"), texts, k, percent), "diffs")
    links = links.unionByName(diffs.where("linked").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    label = components(links, scratch, "cc1")
    labels = label.withColumnRenamed("id", "a")
    parts = diffs.where("size(prefix) > 0").join(labels, "a", "left").select("a", "b", "linked", "n", "d", "r", F.coalesce("label", "a").alias("label"), F.posexplode("prefix").alias("pos", "e"))
    parts = scratch.save(parts, "parts0")
    shared = parts.groupBy("b", "e").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("linked").alias("all_near"), F.count(F.lit(1)).alias("c"))
    shared = scratch.save(shared.where("lo < hi and not all_near").select("b", "e", "c"), "keys")
    parts = scratch.save(parts.join(shared, ["b", "e"]), "parts")
    scratch.drop("parts0", "held")
    hub_n = hubs.select(F.col("hub.rep").alias("b"), F.col("hub.n").alias("hn")).distinct()
    parts = scratch.save(parts.join(hub_n, "b"), "parts1")
    near = parts.alias("x").join(parts.alias("y"), ["b", "e"]).where(_may_link(percent)).select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()
    found = scratch.save(near, "candidates")
    links = links.unionByName(scratch.save(confirmed(found, texts, k, percent), "links2"))
    label = components(links, scratch, "cc2")
    out = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("row", "doc_id", "text_hash", "n", "k1", "k2", F.coalesce("label", "rep").alias("label"))


def _may_link(percent: int):
    """Whether rows x and y of one hub and difference can be of linked sets that are not connected already."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    size = x("n") + y("n")
    need = F.floor((percent * size + 99 + percent) / (100 + percent)) - x("hn") + x("r") + y("r")
    once = (x("label") != y("label")) & (x("a") > y("a")) & ~(x("linked") & y("linked"))
    return once & (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & (x("pos") <= x("d") - need) & (y("pos") <= y("d") - need)


def _components(found: DataFrame) -> DataFrame:
    """Components of two rows or more: label, component_id (least id), first (the row that stands for it: least id,
    nulls last, then the least row number)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row")
    groups = found.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("first"), F.count(F.lit(1)).alias("c"))
    return groups.where("c > 1").drop("c")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link when their sets of k-word shingles (whole texts, A-Z in lower case) have a Jaccard similarity of
    percent / 100 or more. Rows with the same word sequence are one class and enter the search once. Classes meet in
    the buckets of their bands. Each bucket has one hub; every class is compared with the hub it meets most often (a
    star per bucket), and links are confirmed on the full sets. Buckets that still hold more than one component are
    searched by their members' differences from the hub (differences): two members that the hub does not connect can
    link only if they share enough of these, so they are compared only if they share one of the first few. No bucket
    is capped, none is compared pair by pair, and a pair that shares a bucket is found whenever it links.

    Fewer than k words make one shingle. Null, empty and blank texts have no shingles and link with nothing. Decisions
    are made per row: rows that repeat an id with different texts are documents of their own; rows without an id belong
    to components, whose id is the least one there (null if none has one). kept says that component_id is the row's own
    id. Extra columns are ignored; an empty table gives an empty result.
    """
    found = _classes(docs, k, percent, bands, rows)
    scratch = Scratch(docs.sparkSession, "near-out")
    found = scratch.save(found, "found")
    groups = scratch.save(_components(found), "groups").select("label", "component_id", F.lit(True).alias("many"))
    out = found.join(groups, "label", "left")
    component = F.when(F.col("many"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id (nulls last).

    Rows are told apart by id and text, so a text of its own stays even if another row with its id goes. Of rows that
    repeat both id and text one stays, whichever; null and empty texts all stay. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "near-drop")
    found = scratch.save(_classes(docs, k, percent, BANDS, ROWS), "found")
    groups = scratch.save(_components(found), "groups").select("label", "first")
    key = ["__id", "__no_id", "__hash"]
    named = lambda id_, hash_: (F.coalesce(id_, F.lit(0)).alias(key[0]), id_.isNull().alias(key[1]), hash_.alias(key[2]))
    others = found.join(groups, "label").where("row <> first.row")
    alike = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    others = scratch.save(others.select(*named(F.col("doc_id"), F.col("text_hash")), alike.alias("alike")).distinct(), "others")
    own = docs.select(*named(F.col("doc_id").cast("long"), F.xxhash64("text")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    out = own.join(others.where("not alike").hint("merge"), key, "left_anti")  # grows with the corpus: shuffled at every size
    twice = others.where("alike").drop("alike")
    if twice.limit(1).count():  # rows that repeat the very id and text that stays
        out = out.join(twice, key, "left_anti").unionByName(out.join(twice, key, "left_semi").dropDuplicates(key))
    return out.select("own.*")
