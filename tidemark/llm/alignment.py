"""Cross-tokenizer alignment: groups and links between the tokens that two tokenizers make of the same texts.

The relational core (`cells`) explodes the tokens of both sides, sums their lengths in a window, brings together what ends
at the same byte, and numbers groups by a running count of cuts. It runs over distinct words instead of documents: both
tokenizers end a token before a space that stands between two other characters, so a text's alignment is that of its words,
one after another. Documents are cut into words by chunks, which keep a code per word; counts of words, links and
pairs and the words' values travel as tables, so that a word counts as often as it occurs but is aligned once."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import BROADCAST_BYTES, Scratch, lean, small_batches, trim
from .tokens import PieceEncoder

#: Bytes of text whose words share a dictionary.
CHUNK_BYTES = 32 << 20
#: Words of a chunk whose groups are put together at once.
GATHER = 200_000
#: A token as one number is its id plus WIDE times its bytes.
WIDE = 1 << 20
#: Runs that a worker's encoder remembers; words are distinct, so few come again.
KEPT = 50_000
#: Texts with this character are not what a sentencepiece model gives back: it stands for the space.
MARK = "▁"
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_CHUNKS = "chunk long, ids array<bigint>, sizes array<int>, codes binary, words array<string>, counts array<bigint>"


def pack(codes: np.ndarray) -> bytes:
    """Codes as four planes of bytes, compressed: most codes are small."""
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    z = zstandard.ZstdCompressor(level=1)
    return b"".join(len(b).to_bytes(4, "little") + b for b in (z.compress(raw[:, i].tobytes()) for i in range(4)))


def unpack(blob: bytes) -> np.ndarray:
    out, at = 0, 0
    for i in range(4):
        n = int.from_bytes(blob[at : at + 4], "little")
        out = out | np.frombuffer(zstandard.decompress(blob[at + 4 : at + 4 + n]), np.uint8).astype(np.int32) << 8 * i
        at += 4 + n
    return out


def cut_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words of the texts (not empty), the words by frequency, and how many each text has. Words lack the
    space before them; one holds white space where that is more than a space between two other characters."""
    cut = pc.split_pattern(texts, " ")
    sizes, cut = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), cut.flatten()
    coded = cut.dictionary_encode()
    del cut
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    del coded
    heads = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
    odd = np.array([not c or c.isspace() for c in heads.dictionary.to_pylist()], bool)[heads.indices.to_numpy(zero_copy_only=False)]
    del heads
    wrong = odd[codes]
    if wrong.any():  # texts with other white space are cut anew
        upto, new, parts, done = np.cumsum(sizes), {}, [], 0
        for i in np.unique(np.searchsorted(upto, np.flatnonzero(wrong), side="right")).tolist():
            own = _CUT.split(texts[i].as_py())
            parts += [codes[done : upto[i] - sizes[i]], np.array([new.setdefault(w, len(words) + len(new)) for w in own], np.int32)]
            done, sizes[i] = upto[i], len(own)
        codes = np.concatenate([*parts, codes[done:]])
        both = pa.concat_arrays([words, pa.array(list(new), words.type)]).dictionary_encode()  # a word may have come both ways
        codes, words = both.indices.to_numpy(zero_copy_only=False)[codes], both.dictionary
    counts = np.bincount(codes, minlength=len(words))
    order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[codes], words.take(pa.array(order)), sizes


def chunked(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk of documents (doc_id, text): their ids, how many words each has, the words' codes, the words and
    their counts. Null and empty texts, and those with MARK, have no words."""

    def run(batches):
        task, seq, texts, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            all_texts, all_ids = pa.concat_arrays(texts), pa.concat_arrays(ids)
            texts.clear()
            ids.clear()
            valid = pc.and_(pc.greater(pc.binary_length(all_texts), 0), pc.invert(pc.match_substring(all_texts, MARK)))
            at, sizes = np.flatnonzero(valid.to_numpy(zero_copy_only=False)), np.zeros(len(all_texts), np.int32)
            if len(at) < len(sizes):
                all_texts = all_texts.filter(valid)
            codes, words, sizes[at] = cut_words(all_texts)
            del all_texts
            counts = np.bincount(codes, minlength=len(words))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            out = [pa.array([task << 32 | seq], pa.int64()), one(all_ids), one(pa.array(sizes)), pa.array([pack(codes)], pa.binary()), one(words.cast(pa.string())), one(pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays(out, names=["chunk", "ids", "sizes", "codes", "words", "counts"])

        for batch in batches:
            new = batch.column(1).fill_null("")
            upto, a = np.cumsum(pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while a < len(new):  # whole documents until the chunk is full
                took = int(upto[a - 1]) if a else 0
                b = min(int(np.searchsorted(upto, took + limit - size)) + 1, len(new))
                texts.append(new.slice(a, b - a))
                ids.append(batch.column(0).slice(a, b - a))
                size, a = size + int(upto[b - 1]) - took, b
                if size >= limit:
                    yield row()
                    seq, size = seq + 1, 0
        if texts:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _CHUNKS)


def encoded(words: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """words (key, word, ...) with the tokens of a space and the word: tokens (those of A, then those of B; each its id plus
    WIDE times its bytes) and n_a, how many are of A.

    a: a byte-level BPE of the tokenizers library; b: a sentencepiece model that leaves texts as they are, adds the space and
    falls back to bytes. A word whose tokens don't make up its bytes ends the job: such a model needs whole texts."""

    def run(batches):
        import sentencepiece

        a, b = PieceEncoder(path_a, KEPT, special=False), sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab = a.tokenizer.get_vocab(with_added_tokens=False)
        size_a, size_b = np.zeros(a.largest + 1, np.int32), np.zeros(b.vocab_size(), np.int32)
        for piece, i in vocab.items():
            size_a[i] = len(piece)  # a letter of a byte-level piece is a byte
        for i in range(b.vocab_size()):
            size_b[i] = 1 if b.is_byte(i) else len(b.id_to_piece(i).replace(MARK, " ").encode())
        if max(len(size_a), len(size_b)) > WIDE or max(size_a.max(), size_b.max()) >= (1 << 31) // WIDE:
            raise ValueError("a vocabulary of more ids, or with longer tokens, than a packed token holds")

        def checked(flat: np.ndarray, each: np.ndarray, sizes: np.ndarray, want: np.ndarray) -> np.ndarray:
            size = sizes[flat]
            upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            if not np.array_equal(np.diff(upto[np.concatenate([[0], np.cumsum(each)])]), want):
                raise ValueError("tokens do not make up the text; the tokenizers must leave texts as they are")
            return size

        for batch in batches:
            words = batch.column(batch.schema.get_field_index("word"))
            want = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            texts = words.to_pylist()
            parts = [a.piece(w) if w and not w[0].isspace() else a._whole(" " + w) for w in texts]
            flat_a, n_a = np.frombuffer(b"".join(parts), "<u4").astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            ids = b.encode(texts, num_threads=1)
            flat_b, n_b = np.fromiter((i for x in ids for i in x), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))
            # a word's tokens of A, then those of B
            upto = np.cumsum(n_a + n_b)
            at_a = np.arange(len(flat_a)) + np.repeat(upto - np.cumsum(n_a) - n_b, n_a)
            at_b = np.arange(len(flat_b)) + np.repeat(upto - np.cumsum(n_b), n_b)
            out = np.empty(len(flat_a) + len(flat_b), np.int32)
            out[at_a] = flat_a + WIDE * checked(flat_a, n_a, size_a, want)
            out[at_b] = flat_b + WIDE * checked(flat_b, n_b, size_b, want)
            new = [pa.array(n_a.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(out))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_a", "tokens"])

    new = StructType.fromDDL("n_a int, tokens array<int>")
    return words.mapInArrow(lean(run), StructType([*words.schema, *new]))


def cells(pairs: DataFrame) -> DataFrame:
    """The stretches between neighbouring token ends of rows (key, n_a, tokens), each a link: key, end, the ids of the tokens of
    both sides that it lies in (a, b), those that end with it (a_ends, b_ends, else null), and group, which counts the
    cuts from here to the text's end.

    Two tokens overlap in one such stretch at most, so the links are all overlapping pairs, each once, however long a
    group is. What ends at one place is brought together by grouping by key and end (an equi-join of the two sides);
    all steps use one deal by key."""
    tokens = pairs.repartition("key").select("key", "n_a", F.posexplode("tokens").alias("pos", "t"))
    tokens = tokens.select("key", (F.col("pos") >= F.col("n_a")).alias("side"), "pos", (F.col("t") % WIDE).alias("id"), F.expr(f"t div {WIDE}").alias("size"))
    upto = Window.partitionBy("key", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = tokens.withColumn("end", F.sum("size").over(upto))
    own = lambda n: F.max(F.when(F.col("side") == F.lit(n), F.col("id")))
    met = ends.groupBy("key", "end").agg(own(False).alias("a_ends"), own(True).alias("b_ends"))
    back = Window.partitionBy("key").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(F.col("a_ends").isNotNull() & F.col("b_ends").isNotNull(), 1).otherwise(0)
    return met.select("key", "end", "a_ends", "b_ends", *[F.last(f"{s}_ends", ignorenulls=True).over(back).alias(s) for s in "ab"], F.sum(cut).over(back).alias("group"))


def aligned(pairs: DataFrame) -> DataFrame:
    """Per key: n_a, n_b, n_groups, said (text: ids of A, `|`, ids of B, groups joined by `;`) and links (array of a, b)."""
    ordered = lambda s: F.array_join(F.transform(F.filter("rows", lambda r: r[f"{s}_ends"].isNotNull()), lambda r: r[f"{s}_ends"].cast("string")), ",")
    rows = F.sort_array(F.collect_list(F.struct("end", "a_ends", "b_ends", "a", "b"))).alias("rows")
    groups = cells(pairs).groupBy("key", "group").agg(rows)
    groups = groups.select("key", "group", F.concat(ordered("a"), F.lit("|"), ordered("b")).alias("said"), "rows")
    out = groups.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("group")).alias("at"), "said"))).alias("said"), F.flatten(F.collect_list("rows")).alias("rows"))
    n = lambda s: F.size(F.filter("rows", lambda r: r[f"{s}_ends"].isNotNull()))
    return out.select("key", n("a").alias("n_a"), n("b").alias("n_b"), F.size("said").alias("n_groups"), F.array_join(F.col("said.said"), ";").alias("said"), F.transform("rows", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))).alias("links"))


def pair_counts(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Of words (n, links): a, b, count (how many links of all texts hold the pair), best (the highest count of its b)."""
    links = words.select("n", F.explode("links").alias("l"))
    pairs = scratch.save(links.groupBy("l.a", "l.b").agg(F.sum("n").alias("count")), "counts")
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))
    return scratch.save(pairs.join(top, "b").select("a", "b", "count", F.col("count") == F.col("top")), "pairs").toDF("a", "b", "count", "best")


def _counted(found: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """found (key, word, n_a, n_b, n_groups, said, links) with n_links, n_best and count_sum: each link's pair looked up.

    Where the pairs, 20 bytes each, take at most `limit`, tasks hold them all and no row of found moves; else links and
    pairs are joined."""
    whole = found.withColumns({**{c: F.col(c).cast("long") for c in ("n_a", "n_b", "n_groups")}, "n_links": F.size("links").cast("long")})
    if 20 * pairs.count() > limit:
        links = found.select("key", F.explode("links").alias("l")).select("key", "l.a", "l.b")
        sums = links.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
        return whole.select("key", "word", "said", *NUMBERS[:4]).join(sums, "key").drop("key")
    rows = pairs.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "count", "best").toPandas().sort_values("pair")
    held = found.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "count", "best")))

    def run(batches):
        pair, count, best = held.value
        for batch in batches:
            links = batch.column(batch.schema.get_field_index("links"))
            a, b = (links.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            at = np.searchsorted(pair, (a << 32) + b)
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[ends]) for x in (best, count)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("word", "said", *NUMBERS[:4])]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums)], names=["word", "said", *NUMBERS])

    return whole.select("word", "said", *NUMBERS[:4], "links").mapInArrow(lean(run), "word string, said string, " + ", ".join(f"{c} long" for c in NUMBERS))


def _packed(values: DataFrame) -> DataFrame:
    """A few rows per chunk and task of values (chunk, code, said, and NUMBERS): compressed columns of the words."""

    def run(batches):
        held, n = [], 0

        def rows():
            table = pa.Table.from_batches(held).sort_by([("chunk", "ascending"), ("code", "ascending")]).combine_chunks()
            chunk = table["chunk"].to_numpy()
            cuts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
            z, out = zstandard.ZstdCompressor(level=3), []
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chunk)], strict=True):
                part = table.slice(i, j - i)
                said = z.compress("\n".join(part["said"].to_pylist()).encode())
                numbers = b"".join(part[c].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in NUMBERS)
                out.append((int(chunk[i]), pack(np.diff(part["code"].to_numpy(), prepend=0)), said, z.compress(numbers)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["chunk", "codes", "said", "numbers"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GATHER:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    return values.select("chunk", "code", "said", *NUMBERS).mapInArrow(lean(run), "chunk long, codes binary, said binary, numbers binary")


def _summed(parts: DataFrame, values: DataFrame) -> DataFrame:
    """Per document, from its chunk's codes and the packed values of the chunk's words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        codes, said, numbers = [], [], []
        for row in right.to_pylist():
            codes.append(np.cumsum(unpack(row["codes"])))
            said.append(pc.split_pattern(pa.array([zstandard.decompress(row["said"])], pa.binary()).cast(pa.string()), "\n").flatten())
            numbers.append(np.frombuffer(zstandard.decompress(row["numbers"]), np.uint8).reshape(len(NUMBERS), 8, -1).transpose(0, 2, 1).copy().view("<i8")[:, :, 0])
        if codes:
            order = np.argsort(np.concatenate(codes), kind="stable")
            said = pa.concat_arrays(said).take(pa.array(order))
            numbers = [np.concatenate([x[k] for x in numbers])[order] for k in range(len(NUMBERS))]
            del codes, order
            trim()
        else:  # no document has words
            said, numbers = pa.array([], pa.string()), np.empty((len(NUMBERS), 0), np.int64)
        out = {"doc_id": [], **{c: [] for c in NUMBERS}, "groups_sha256": []}
        for row in range(left.num_rows):
            ids, sizes, codes = left["ids"][row].values, left["sizes"][row].values.to_numpy(), unpack(left["codes"][row].as_py())
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            out["doc_id"].append(ids)
            digests, i = [], 0
            while i < len(sizes):  # some documents at a time: what is looked up takes much more room than the codes
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + GATHER, side="right")) - 1)
                own, within = codes[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                for c, v in zip(NUMBERS, numbers, strict=True):
                    out[c].append(pa.array(np.diff(np.concatenate([[0], np.cumsum(v[own])])[within])))
                lists = pa.ListArray.from_arrays(pa.array(within, pa.int32()), said.take(pa.array(own)))
                digests += [hashlib.sha256(s).hexdigest() if s else "" for s in pc.binary_join(lists, ";").cast(pa.binary()).to_pylist()]
                i = j
            out["groups_sha256"].append(pa.array(digests, pa.string()))
        return pa.table({c: pa.chunked_array(v) for c, v in out.items()})

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string"
    return parts.select("chunk", "ids", "sizes", "codes").groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(run, schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str, limit: int = CHUNK_BYTES, limit_pairs: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are those of a space and the text, strings of special tokens being plain text. Texts that are null, empty or
    contain MARK have no tokens: zeros, and '' for the digest. Repeated rows and ids, or null ids, are rows each;
    extra columns are ignored; an empty table gives an empty result. limit: bytes of text of a chunk; limit_pairs: bytes of
    the pairs of ids that tasks may hold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    with small_batches(spark, 2000):
        parts = scratch.save(chunked(docs, limit), "chunks")

    def places() -> DataFrame:
        each = scratch.load("chunks", parts.schema).select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
        return each.select("chunk", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))

    words = encoded(places().groupBy("word").agg(F.sum("n").alias("n")).withColumn("key", F.monotonically_increasing_id()), path_a, path_b)
    words = scratch.save(words, "words")
    scratch.settle()
    found = scratch.save(aligned(words.select("key", "n_a", "tokens")).join(words.select("key", "word", "n"), "key"), "aligned")
    scratch.settle("words")
    pairs = pair_counts(found, scratch)
    values = scratch.save(_counted(found, pairs, BROADCAST_BYTES if limit_pairs is None else limit_pairs), "values")
    scratch.settle("aligned")
    back = scratch.save(_packed(places().select("chunk", "code", "word").join(values, "word")), "back")
    scratch.settle("values")
    return _summed(parts, back)
