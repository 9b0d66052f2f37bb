"""LM scoring: hashed maximum-entropy model with n-gram and skip features and a class-factored softmax."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, blobs, lean, mix, one_row_reads, words_of

END = b"\n"  # no word holds white space, so no word is this
CLASSES = 32
#: Kinds of words that classes are made of: so many of the commonest words each, and a hash of the last bytes of others.
NAMED, ENDINGS = 256, 256
KINDS = NAMED + ENDINGS
#: Words of at least one in so many tokens are sent to all workers: at most so many words.
KNOWN = 1_000_000
#: Rows of weights that features are hashed into.
ROWS = 8192
EPOCHS = 12
#: Tokens of an encoded chunk, tokens a bucket of word pairs, what the word factor takes off each pair's count.
CHUNK_TOKENS, BUCKET_TOKENS, DISCOUNT = 500_000, 2_000_000, 0.75


def _ending(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS


def _trains() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2


def word_counts(docs: DataFrame) -> DataFrame:
    """h (hash of the word), ending, n: counts of words and of text ends over all of docs, combined before the shuffle."""

    def run(batches):
        def flush(c):
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in c), np.uint64, len(c)).view(np.int64)
            return pa.RecordBatch.from_pydict({
                "h": pa.array(h), "ending": pa.array([_ending(w) for w in c], pa.int32()), "n": pa.array(list(c.values()), pa.int64())
            })

        counts = Counter()
        for batch in batches:
            texts = blobs(batch, "text")
            counts[END] += len(texts)
            for t in texts:
                counts.update(words_of(t))
                if len(counts) > 500_000:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    parts = docs.select("text").mapInArrow(run, "h long, ending int, n long")
    return parts.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed; unpack gives them back."""
    planes = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    planes = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize).T).view(kind).ravel()


class Coder(dict):
    """word -> its place among the known words, or -1 - its ending."""

    LIMIT = 300_000

    def __init__(self, known: np.ndarray):
        # known: hashes, the commonest word first; arrays: as small as numpy's, much faster to look at one number at a time
        order = np.argsort(known)
        self.known, self.places = array("q", known[order].tobytes()), array("i", order.astype(np.int32).tobytes())

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h -= (h >> 63) << 64
        i = bisect_left(self.known, h)
        out = self[word] = self.places[i] if i < len(self.known) and self.known[i] == h else -1 - _ending(word)
        return out


def encode(docs: DataFrame, known) -> DataFrame:
    """Chunks of some CHUNK_TOKENS tokens, whole texts each: cid, ids, learn, sizes (tokens of each text), syms (codes of
    all tokens), rare (hashes of the unknown words in order). docs: doc_id, text, learn, rid (consecutive in a task)."""

    def run(batches):
        coder = Coder(known.value[0])

        def row(ids, learn, cid, parts):
            sizes, syms, rare = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_pydict({
                "cid": pa.array([cid], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                **{k: pa.array([pack(v)], pa.binary()) for k, v in (("learn", np.array(learn, np.uint8)), ("sizes", sizes), ("syms", syms), ("rare", rare))},
            })

        ids, learn, parts, held, cid = [], [], [], 0, None
        for batch in batches:
            texts, keys = blobs(batch, "text"), batch.column(3).to_pylist()
            all_ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(0, len(texts), 250):
                words = [words_of(t) for t in texts[i : i + 250]]
                flat = [w for x in words for w in (*x, END)]
                syms = np.fromiter(map(coder.__getitem__, flat), np.int32, len(flat))
                at = np.flatnonzero(syms < 0).tolist()
                rare = np.fromiter((xxhash.xxh3_64_intdigest(flat[j]) for j in at), np.uint64, len(at))
                cid = keys[i] if cid is None else cid
                ids += all_ids[i : i + 250]
                learn += flags[i : i + 250]
                parts.append((np.array([len(x) + 1 for x in words], np.int32), syms, rare))
                held += len(flat)
                if held >= CHUNK_TOKENS:
                    yield row(ids, learn, cid, parts)
                    ids, learn, parts, held, cid = [], [], [], 0, None
        if parts:
            yield row(ids, learn, cid, parts)

    return docs.select("doc_id", "text", "learn", "rid").mapInArrow(
        lean(run), "cid long, ids array<long>, learn binary, sizes binary, syms binary, rare binary"
    )


def _chunks(batches):
    """cid, learn (of each token), starts, syms and rare of each row of encoded chunks."""
    for batch in batches:
        for r in batch.select(["cid", "learn", "sizes", "syms", "rare"]).to_pylist():
            sizes = unpack(r["sizes"], np.int32)
            yield r["cid"], np.repeat(unpack(r["learn"], np.uint8), sizes), np.cumsum([0, *sizes]), unpack(r["syms"], np.int32), unpack(r["rare"], np.uint64)


def class_table(known_kinds: np.ndarray, of_kind: np.ndarray) -> np.ndarray:
    """What of_kind says for each code, found at code + ENDINGS."""
    return np.concatenate([of_kind[NAMED + np.arange(ENDINGS)[::-1]], of_kind[known_kinds]])


def pair_places(syms, rare, starts, known: np.ndarray, of_code: np.ndarray, end: int) -> tuple:
    """Contexts (48-bit hash of the word before and the class; sorted), each token's place among them, the pairs (place of the
    context << 32 | hash of the word; sorted) and each token's place among those."""
    h = np.empty(len(syms), np.uint64)
    h[syms >= 0] = known.view(np.uint64)[syms[syms >= 0]]
    h[syms < 0] = rare
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts[:-1]] = np.uint64(end)
    ctx = mix(before * np.uint64(CLASSES) + of_code[syms + ENDINGS].astype(np.uint64)) >> np.uint64(16)
    contexts, of = np.unique(ctx, return_inverse=True)
    pairs, place = np.unique((of.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)), return_inverse=True)
    return contexts, of, pairs, place


def pair_requests(chunks: DataFrame, shared, of_code, buckets: int) -> DataFrame:
    """For each chunk and bucket of contexts: the chunk's contexts, how many pairs each has, the pairs' words and how
    often the training texts of the chunk hold them. A pair is sent once a chunk, however common it is."""

    def run(batches):
        end = xxhash.xxh3_64_intdigest(END)
        for cid, learn, starts, syms, rare in _chunks(batches):
            contexts, _, pairs, place = pair_places(syms, rare, starts, shared.value[0], of_code.value, end)
            n = np.bincount(place, weights=learn, minlength=len(pairs)).astype(np.int64)
            sizes = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(contexts)).astype(np.int32)
            ends = np.cumsum([0, *sizes])
            b = ((contexts >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with contexts
            some, first = np.unique(b, return_index=True)
            cuts = [*first.tolist(), len(b)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            w = pairs.astype(np.uint32)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(some), "cid": pa.array([cid] * len(some), pa.int64()),
                "contexts": pa.array([pack(np.diff(contexts[i:j], prepend=np.uint64(0))) for i, j in spans], pa.binary()), "sizes": pa.array([pack(sizes[i:j]) for i, j in spans], pa.binary()),
                "words": pa.array([pack(w[ends[i] : ends[j]]) for i, j in spans], pa.binary()), "n": pa.array([pack(n[ends[i] : ends[j]]) for i, j in spans], pa.binary()),
            })

    return chunks.mapInArrow(run, "bucket long, cid long, contexts binary, sizes binary, words binary, n binary")


def pair_answers(requests: DataFrame) -> DataFrame:
    """Each request's counts over all training texts: n of its pairs, total and kinds (pairs seen) of its contexts."""

    def run(table):
        def arrays(name, kind):
            return [unpack(x, kind) for x in table.column(name).to_pylist()]

        contexts, words = [np.cumsum(x, dtype=np.uint64) for x in arrays("contexts", np.uint64)], arrays("words", np.uint32)
        _, of = np.unique(np.concatenate(contexts), return_inverse=True)
        own = np.repeat(of, np.concatenate(arrays("sizes", np.int32))).astype(np.uint64)
        pairs, place = np.unique((own << np.uint64(32)) | np.concatenate(words), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(arrays("n", np.int64)))
        owner = (pairs >> np.uint64(32)).astype(np.int64)
        total, kinds = np.bincount(owner, weights=n), np.bincount(owner, weights=n > 0)
        at, to = (np.cumsum([0, *map(len, x)]) for x in (words, contexts))

        def cut(values, places, ends):
            values = values.astype(np.int64)[places]
            return pa.array([pack(values[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary())

        return pa.table({"cid": table.column("cid"), "bucket": table.column("bucket"), "n": cut(n, place, at), "total": cut(total, of, to), "kinds": cut(kinds, of, to)})

    return requests.groupBy("bucket").applyInArrow(run, "cid long, bucket long, n binary, total binary, kinds binary")


def word_factor(n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """t and g of pairs: P(word | class, word before) = t + g * P(word | class)."""
    t = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
    return t, np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)


def _contexts(classes: np.ndarray, starts: np.ndarray, end: int, width: int) -> list[np.ndarray]:
    """The classes one, two and three places before each token; before a text's start stands its end's class."""
    place = np.arange(len(classes)) - np.repeat(starts[:-1], np.diff(starts))
    out = []
    for back in (1, 2, 3):
        c = np.full(len(classes), end, np.int64)
        c[back:] = classes[:-back] if back < len(classes) else c[back:]
        c[place < back] = end
        out.append(c)
    return out


def _tally(chunks: DataFrame, size: int, cells) -> DataFrame:
    """Counts of the training tokens' cells, added up in each task before the shuffle; at most `size` cells."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for _, learn, starts, syms, _ in _chunks(batches):
            total += np.bincount(cells(syms, starts)[learn > 0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return chunks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def word_classes(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 25) -> np.ndarray:
    """Kinds by their neighbours: k-means (fixed start) over a low-rank form of the log ratios of pair counts."""
    n = pairs.sum()
    if not n:
        return np.arange(len(pairs)) % classes
    row, col = pairs.sum(1, keepdims=True), pairs.sum(0, keepdims=True)
    ratio = np.log1p(pairs * n / np.maximum(row * col, 1))
    both = np.hstack([ratio, np.log1p(pairs.T * n / np.maximum(col.T * row.T, 1))])
    u, s, _ = np.linalg.svd(both - both.mean(0), full_matrices=False)
    x = u[:, :16] * s[:16]
    weight = np.sqrt(row[:, 0] + col[0] + 1e-9)
    centres = [x[int(weight.argmax())]]
    for _ in range(classes - 1):  # farthest by weight: no chance involved
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[int((d * weight).argmax())])
    centres = np.array(centres)
    for _ in range(rounds):
        of = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(classes):
            if (of == c).any():
                centres[c] = np.average(x[of == c], axis=0, weights=weight[of == c])
    return of


def feature_rows(ctx: np.ndarray) -> np.ndarray:
    """Rows of weights that a context (c1, c2, c3 packed) has: bias, each class, the n-grams and the skips, hashed."""
    c1, c2, c3 = ctx // CLASSES**2, ctx // CLASSES % CLASSES, ctx % CLASSES
    zero = np.zeros_like(ctx)
    parts = (zero, c1 + 1, c2 + 1, c3 + 1, c1 * CLASSES + c2 + 1, c1 * CLASSES + c3 + 1, c2 * CLASSES + c3 + 1, ctx + 1)
    return np.stack([(mix((p.astype(np.uint64) << np.uint64(4)) + np.uint64(i + 1)) % np.uint64(ROWS)).astype(np.int64) for i, p in enumerate(parts)], axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train_weights(events: DataFrame, tokens: int, start: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Distributed gradient updates: each epoch, tasks return the gradient over their contexts (ROWS x CLASSES numbers,
    a fixed size; the events table has at most CLASSES**4 rows in 8 parts), and the driver takes an Adam step."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    sc = events.sparkSession.sparkContext
    for t in range(1, epochs + 1):
        sent = sc.broadcast(w.astype(np.float32))

        def run(batches):
            w, grad = sent.value, np.zeros((ROWS, CLASSES), np.float64)  # noqa: B023
            for batch in batches:
                cell, n = (np.asarray(batch.column(i)) for i in (0, 1))
                ctx, back = np.unique(cell // CLASSES, return_inverse=True)
                seen = np.zeros((len(ctx), CLASSES))
                np.add.at(seen, (back, cell % CLASSES), n)
                rows = feature_rows(ctx)
                p = np.exp(_log_softmax(w[rows].sum(1)))
                delta = p * seen.sum(1, keepdims=True) - seen
                for j in range(rows.shape[1]):
                    np.add.at(grad, rows[:, j], delta)
            yield pa.RecordBatch.from_pydict({"g": pa.array([grad.astype(np.float32).tobytes()], pa.binary())})

        parts = events.mapInArrow(run, "g binary").toArrow().column(0).to_pylist()
        grad = sum((np.frombuffer(p, np.float32).astype(np.float64) for p in parts), np.zeros(ROWS * CLASSES)).reshape(ROWS, CLASSES)
        grad = grad / max(tokens, 1) + 1e-8 * w
        m, v = 0.8 * m + 0.2 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.15 / np.sqrt(t) * (m / (1 - 0.8**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        sent.destroy()
    return w


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(doc_id) mod 7 is not 2. A token is a lower-cased word or the text's end. The
    model: P(token | before) = P(class | before) * P(word | class, word before). The class softmax adds hashed weights of
    the bias, the last three classes, their n-grams and skips, trained by gradient over counts of all training tokens.
    The word factor has a hashed feature for each pair of words, of weight log(1 + t / (g * q)) over the class's counts
    q = (c + 1) / (N_class + V_class + 1), whose last part is the unseen word: t + g * q once normalised, where t is the
    pair's discounted share of its context (word before and class) and g what the discounts leave. Its weights thus
    have a closed form and take no gradient steps. The whole sums to 1, but for features whose hashes collide (48 bits of a
    context, 32 of a word in it). Classes group common words and word endings by
    their neighbours.

    Counts cover the whole corpus. Words of at least one token in KNOWN (so at most KNOWN words) are known to every
    worker; those of other words meet their counts in a join by hash. Pairs of all words are counted in buckets of
    their contexts, whose number grows with the corpus. Null and empty texts have one token, the end. No training
    text: N = V = 0, scores from the formulas. Repeated rows are scored each; extra columns are ignored.
    """
    with one_row_reads(docs.sparkSession):
        return _score_texts(docs)


def _score_texts(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("learn", _trains())
    counts = scratch.save(word_counts(docs.where("learn")), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bound = max(2, -(-n_all // KNOWN))
    known = counts.where(F.col("n") >= bound).select("h", "n", "ending").toArrow()
    h, n, ending = (np.array(known.column(i), np.int64) for i in range(3))
    order = np.lexsort((h, -n))  # the commonest first
    h, n, kinds = h[order], n[order], NAMED + ending[order]
    kinds[:NAMED] = np.arange(len(kinds[:NAMED]))
    shared = spark.sparkContext.broadcast((h, n))
    chunks = scratch.save(encode(docs.withColumn("rid", F.monotonically_increasing_id()), shared), "chunks")
    end = Coder(h)[END]
    kind_of = spark.sparkContext.broadcast(class_table(kinds, np.arange(KINDS)).astype(np.int16))

    def pair_cells(syms, starts):
        k = kind_of.value[syms + ENDINGS].astype(np.int64)
        prior = np.roll(k, 1)
        prior[starts[:-1]] = kind_of.value[end + ENDINGS]
        return prior * KINDS + k

    got = _tally(chunks, KINDS * KINDS, pair_cells).toArrow()  # KINDS**2 cells at most
    pairs = np.zeros(KINDS * KINDS)
    pairs[np.array(got.column(0), np.int64)] = np.array(got.column(1), np.int64)
    classes = word_classes(pairs.reshape(KINDS, KINDS))
    of_code = spark.sparkContext.broadcast(class_table(kinds, classes).astype(np.int16))
    buckets = max(64, -(-n_all // BUCKET_TOKENS))
    answers = scratch.save(pair_answers(pair_requests(chunks, shared, of_code, buckets)), "answers")

    def event_cells(syms, starts):
        c = of_code.value[syms + ENDINGS].astype(np.int64)
        c1, c2, c3 = _contexts(c, starts, of_code.value[end + ENDINGS], CLASSES)
        return ((c1 * CLASSES + c2) * CLASSES + c3) * CLASSES + c

    events = _tally(chunks, CLASSES**4, event_cells)
    events = scratch.save(events.repartition(8, F.floor(F.col("cell") / CLASSES)), "events")
    # the start: log probabilities of classes after the last class
    two = events.groupBy((F.floor(F.col("cell") / CLASSES**3) * CLASSES + F.col("cell") % CLASSES).alias("k")).agg(F.sum("n").alias("n")).toArrow()
    bigram = np.zeros(CLASSES * CLASSES)
    bigram[np.array(two.column(0), np.int64)] = np.array(two.column(1), np.int64)
    bigram = bigram.reshape(CLASSES, CLASSES)
    prior = (bigram.sum(0) + 1) / (bigram.sum() + CLASSES)
    start = np.zeros((ROWS, CLASSES))
    rows = feature_rows(np.arange(CLASSES) * CLASSES**2)
    for c in range(CLASSES):
        start[rows[c, 1]] += np.log((bigram[c] + 20 * prior) / (bigram[c].sum() + 20)) - np.log(prior)
    start[rows[0, 0]] += np.log(prior)
    weights = train_weights(events, n_all, start) if n_all else start
    every = np.arange(CLASSES**3)
    table = np.concatenate([_log_softmax(weights[feature_rows(x)].sum(1)) for x in np.array_split(every, 16)]) / np.log(10)
    # N and V of each class
    named = {int(x): k for k, x in enumerate(h[:NAMED])}
    by_end = counts.where(~F.col("h").isin(list(named)) if named else F.lit(True)).groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    size = np.ones(CLASSES)
    for k in named.values():
        size[classes[k]] += n[k] + 1
    for r in by_end:
        size[classes[NAMED + r["ending"]]] += r["n"] + r["v"]
    tables = spark.sparkContext.broadcast((table.astype(np.float64), size))

    def score(chunk, told):
        (ids,) = chunk.column("ids").to_pylist()
        ((cid, _, starts, syms, rare),) = _chunks(chunk.to_batches())
        told = told.sort_by("bucket")
        by_class, class_sizes = tables.value
        c = of_code.value[syms + ENDINGS].astype(np.int64)
        c1, c2, c3 = _contexts(c, starts, of_code.value[end + ENDINGS], CLASSES)
        own = by_class[(c1 * CLASSES + c2) * CLASSES + c3, c]
        _, of, _, place = pair_places(syms, rare, starts, shared.value[0], of_code.value, xxhash.xxh3_64_intdigest(END))
        n, total, seen = (np.concatenate([unpack(x, np.int64) for x in told.column(k).to_pylist()]) for k in ("n", "total", "kinds"))
        t, g = word_factor(n[place], total[of], seen[of])
        g /= class_sizes[c]
        more, is_known = np.zeros(len(syms), np.int64), syms >= 0
        more[is_known] = shared.value[1][syms[is_known]]
        own[is_known] += np.log10(t[is_known] + g[is_known] * (more[is_known] + 1))
        at, odd = starts[:-1], np.flatnonzero(~is_known)
        ends = np.searchsorted(odd, starts).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rare.view(np.int64), t[odd].astype(np.float32), g[odd].astype(np.float32))]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "rid": pa.array(cid + np.arange(len(at))), "n_tokens": pa.array(np.diff(starts), pa.int64()),
            "known": pa.array(np.add.reduceat(is_known.astype(np.int64), at)), "logs": pa.array(np.add.reduceat(np.log10(more + 1.0), at)),
            "own": pa.array(np.add.reduceat(own, at)), "rare": lists[0], "t": lists[1], "g": lists[2],
        })

    schema = "doc_id long, rid long, n_tokens long, known long, logs double, own double, rare array<long>, t array<float>, g array<float>"
    scored = scratch.save(chunks.groupBy("cid").cogroup(answers.groupBy("cid")).applyInArrow(score, schema), "scored")
    scratch.drop("chunks", "answers")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "t", "g")).alias("x")).select("rid", F.col("x.rare").alias("h"), "x.t", "x.g")
    less = counts.where(F.col("n") < bound).select("h", "n")
    c = F.coalesce("n", F.lit(0))
    more = rare.join(less, "h", "left").groupBy("rid").agg(
        F.count("n").alias("more"), F.sum(F.log10(c + 1)).alias("more_logs"), F.sum(F.log10(F.col("t") + F.col("g") * (c + 1))).alias("more_own")
    )
    out = scored.drop("rare", "t", "g").join(more, "rid", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        (~_trains()).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"),
        (F.col("own") + F.coalesce("more_own", F.lit(0.0))).alias("score"),
    )
