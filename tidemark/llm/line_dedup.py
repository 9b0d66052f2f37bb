"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, blobs, lean, mix

#: Lines that the rolling hash sees; one boundary in so many places; lines of a chunk at least and at most.
WINDOW, EVERY, LEAST, MOST = 2, 3, 2, 64
#: A line of so many words is a chunk of its own and counts like one of several lines.
LONG = 50


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))


def _rolled(h: np.ndarray) -> np.ndarray:
    """The hash of each line and the WINDOW - 1 lines before it."""
    roll = h.copy()
    for back in range(1, WINDOW):
        roll[back:] = mix(roll[back:] * np.uint64(0x9E3779B97F4A7C15) + h[: len(h) - back])
    return roll


def is_long(line: bytes) -> bool:
    return len(line) >= 2 * LONG - 1 and len(line.split()) >= LONG


def chunks(h: np.ndarray, long: np.ndarray, again: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of the chunks of lines with hashes h. A boundary follows a line where the hash of the last WINDOW
    lines says so, so that lines put in or taken out elsewhere move no boundary beyond the next one; long lines stand
    alone. again[i], if given, says that lines i and i + 1 follow each other elsewhere too: boundaries then also fall
    where that ends, so a passage that repeats begins and ends with a chunk, whatever surrounds it; the lines that none
    of their neighbours joins are left out, and of a passage's chunks the last takes in a single line left over."""
    n, out, start = len(h), [], 0
    cut, long = _rolled(h) % np.uint64(EVERY) == 0, long.tolist()
    cut, joined = cut.tolist(), None if again is None else [*again.tolist(), False]

    def close(end):
        nonlocal start
        if joined is None:
            if start < end:
                out.append((start, end))
        elif end - start > 1:
            out.append((start, end))
        elif end - start == 1 and out and out[-1][1] == start and not long[out[-1][0]] and joined[start - 1]:
            out[-1] = (out[-1][0], end)
        start = end

    for i in range(n):
        if long[i]:
            close(i)
            out.append((i, i + 1))
            start = i + 1
        elif (joined is not None and not joined[i]) or i + 1 - start >= MOST or (cut[i] and i + 1 - start >= LEAST):
            close(i + 1)
    close(n)
    return out


def _counts(filled: np.ndarray, long: np.ndarray, a: int, b: int) -> bool:
    """Chunks that may be removed: two lines or more that are not blank, or a long line."""
    return int(filled[a:b].sum()) >= 2 or (b - a == 1 and bool(long[a]))


def _half(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _hash(h: np.ndarray, a: int, b: int, seed: int) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(h[a:b].tobytes(), seed=seed)
    return _half(x >> 64), _half(x & ((1 << 64) - 1))


def line_table(rows: DataFrame) -> DataFrame:
    """row, doc_id, and of its lines: hashes h, filled, long. To be written before use."""

    def run(batches):
        for batch in batches:
            h, filled, long = [], [], []
            for text in blobs(batch, "text"):
                lines = (text or b"").split(b"\n")
                h.append(line_hashes(lines).view(np.int64))
                filled.append([bool(x.strip()) for x in lines])
                long.append([is_long(x) for x in lines])
            offsets = pa.array(np.cumsum([0, *map(len, h)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (
                pa.array(np.concatenate(h) if h else np.empty(0, np.int64)), *[pa.array([y for x in part for y in x], pa.bool_()) for part in (filled, long)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "h", "filled", "long"])

    return rows.mapInArrow(lean(run), "doc_id long, h array<long>, filled array<boolean>, long array<boolean>").select(F.monotonically_increasing_id().alias("row"), "*")


def chunk_table(lines: DataFrame, places: DataFrame, seed: int) -> DataFrame:
    """doc_id, a, b (first line, line after the last), h1, h2 (128 bits) of each chunk that may be removed. lines: a
    line_table; places: row, at (the numbers of the lines that are followed by the same line elsewhere)."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "a", "b", "h1", "h2")}
            for name, h, filled, long, at in zip(*(batch.column(i) for i in range(5)), strict=True):
                h, filled, long = (np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (h, filled, long))
                again = np.zeros(max(len(h) - 1, 0), bool)
                if at.is_valid:
                    again[at.values.to_numpy()] = True
                for a, b in chunks(h.view(np.uint64), long, again):
                    if _counts(filled, long, a, b):
                        for k, v in zip(out, (name.as_py(), a, b, *_hash(h, a, b, seed)), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    held = lines.join(places, "row", "left").where("at is not null or exists(long, x -> x)")
    return held.select("doc_id", "h", "filled", "long", "at").mapInArrow(lean(run), "doc_id long, a long, b long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, text (without removed chunks), n_lines, n_chunks (by the rolling hash alone),
    removed_chunks, removed_lines.

    Lines that follow each other in more than one place make passages; chunks are cut inside these. A chunk that occurs again, in any document, stays where (doc_id, place) is least and goes elsewhere. Hashes find
    the repeats; then the bytes of every repeat are compared by grouping them (hash and bytes), and if two texts share
    a 128-bit hash the whole runs again with another seed. Texts meet one shuffle, by doc_id; chunks meet as hashes.

    Null text is returned as null and has one (empty) line; documents without repeats come back as they are. Rows with
    a null id keep all their text and remove nothing elsewhere. Rows that share an id are one document to the choice of
    what stays. Extra columns are ignored, an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = scratch.save(line_table(rows.where("doc_id is not null")), "lines")
    two = lambda i: F.xxhash64(F.element_at("h", i + 1), F.element_at("h", i + 2))
    pairs = lines.where("size(h) > 1").select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - 2), two)).alias("i", "p"))
    more = scratch.save(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("p"), "pairs")
    places = scratch.save(pairs.join(more, "p").groupBy("row").agg(F.collect_list("i").alias("at")), "places")  # a document's own lines
    table = scratch.save(chunk_table(lines, places, seed), "chunks")
    again = table.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "a")).alias("first")).where("c > 1")
    again = scratch.save(again.select("h1", "h2", "first"), "again")
    marks = table.join(again, ["h1", "h2"]).select("doc_id", F.struct("a", "b", "h1", "h2", (F.struct("doc_id", "a") == F.col("first")).alias("stays")).alias("mark"))
    marks = scratch.save(marks.groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "marks")  # a document's own chunks

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("text", "n_lines", "n_chunks", "removed_chunks", "removed_lines", "repeats")}
            for text, marked in zip(blobs(batch, "text"), batch.column(2).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                h = line_hashes(lines)
                # rows of one id may hold different texts: a mark is for the row that has its chunk
                own = [m for m in marked or () if m["b"] <= len(h) and _hash(h, m["a"], m["b"], seed) == (m["h1"], m["h2"])]
                gone = {i for m in own if not m["stays"] for i in range(m["a"], m["b"])}
                kept = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
                out["text"].append(None if text is None else text if not gone else b"\n".join(kept))
                out["n_lines"].append(len(lines))
                out["n_chunks"].append(len(chunks(h, np.fromiter(map(is_long, lines), bool, len(lines)))))
                out["removed_chunks"].append(sum(not m["stays"] for m in own))
                out["removed_lines"].append(len(gone))
                out["repeats"].append([b"\n".join(lines[m["a"] : m["b"]]) for m in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["text"], pa.binary()).cast(pa.string()), *[pa.array(out[k], pa.int64()) for k in list(out)[1:5]],
                 pa.array(out["repeats"], pa.list_(pa.binary()))], ["doc_id", *out],
            )

    schema = "doc_id long, text string, n_lines long, n_chunks long, removed_chunks long, removed_lines long, repeats array<binary>"
    # marks grow with the corpus, so the join is a shuffled one at every size and never a broadcast
    cleaned = scratch.save(rows.join(marks.hint("merge"), "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(lean(run), schema), "cleaned")
    # Byte comparison: as many repeated texts as repeated hashes, or some hash stands for two.
    texts = cleaned.select(F.explode("repeats").alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("c")).where("c > 1").count()
    if texts != again.count():
        return dedup_lines(docs, seed + 1)
    return cleaned.drop("repeats")
