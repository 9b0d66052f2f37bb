"""Token-ID output: byte-level BPE into wavelet matrices, one compressed file per shard."""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, checked_broadcast, lean, small_batches

MAGIC = b"TDWM2\0"
END_ID = 2
#: A shard closes at the first document end beyond so many ids.
SHARD_IDS = 1_000_000
#: Bits of a plane's block, which is compressed by itself.
BLOCK = 1 << 15
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 6 << 20
_HEAD = "<6sHIIQQQQQ"


class WaveletMatrix:
    """A sequence of ids below 2**bits as bit planes, each stably parted by its bit before the next is taken."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.bits = planes, zeros, n, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
        seq, planes, zeros = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq & seq.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.flatnonzero(~bit)  # places are several times faster than masks on random bits
            zeros.append(len(low))
            seq = np.concatenate([seq.take(low), seq.take(np.flatnonzero(bit))])
        return cls(planes, zeros, len(ids))

    def decode(self) -> np.ndarray:
        """All ids: planes are undone from the last to the first."""
        seq = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(seq)
            out[np.flatnonzero(~bit)] = seq[: self.zeros[k]]
            out[np.flatnonzero(bit)] = seq[self.zeros[k] :] | seq.dtype.type(1 << (self.bits - 1 - k))
            seq = out
        return seq.astype(np.uint32, copy=False)

    def to_bytes(self, doc_ids: np.ndarray, lengths: np.ndarray, nulls: int = 0, part: int = 0, seq: int = 0) -> bytes:
        """The file: head, zeros of each plane, directory of ones before each block, ends of the compressed blocks, the
        document table, blocks. nulls: documents without an id, which come first."""
        z = zstandard.ZstdCompressor(level=1)
        step, blocks = BLOCK // 8, -(-self.n // BLOCK)
        ones, ends, data, at = [], [], [], 0
        for plane in self.planes:
            before = 0
            ones.append(0)
            for i in range(blocks):
                raw = plane[i * step : (i + 1) * step]
                data.append(z.compress(raw.tobytes()))
                before += int(np.bitwise_count(raw).sum())
                at += len(data[-1])
                ones.append(before)
                ends.append(at)
        docs = [z.compress(doc_ids.astype("<i8").tobytes()), z.compress(lengths.astype("<u8").tobytes())]
        head = struct.pack(_HEAD, MAGIC, self.bits, part, seq, self.n, len(doc_ids), nulls, len(docs[0]), len(docs[1]))
        tables = [np.array(x, "<u8").tobytes() for x in (self.zeros, ones, ends)]
        return b"".join([head, *tables, *docs, *data])


class WaveletFile:
    """A shard opened from its one compressed file: reads the head and the directories, then a block at a time.

    rank adds a block's entry of the directory and a popcount inside the block; select searches the directory and then
    one block. Access, counting of an id before a place and the place of its k-th occurrence walk the planes with one
    or two blocks each."""

    HELD = 256  # blocks that stay in memory

    def __init__(self, file):
        self.file = open(file, "rb") if isinstance(file, (str, os.PathLike)) else file
        size = struct.calcsize(_HEAD)
        magic, self.bits, self.part, self.seq, self.n, self.docs, self.nulls, a, b = struct.unpack(_HEAD, self.file.read(size))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        blocks = -(-self.n // BLOCK)
        read = lambda rows, columns: np.frombuffer(self.file.read(8 * rows * columns), "<u8").reshape(rows, columns).astype(np.int64)
        self.zeros = read(1, self.bits)[0].tolist()
        self.ones, self.ends = read(self.bits, blocks + 1), read(self.bits, blocks).ravel()
        self._docs = size + 8 * (self.bits + self.ones.size + self.ends.size)
        self._sizes, self._data, self._held = (a, b), self._docs + a + b, {}

    def __enter__(self) -> WaveletFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def __len__(self) -> int:
        return self.n

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of the documents; the first `nulls` have no id."""
        self.file.seek(self._docs)
        ids, lengths = (zstandard.decompress(self.file.read(s)) for s in self._sizes)
        return np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<u8").astype(np.int64)

    def _block(self, k: int, i: int) -> np.ndarray:
        at = k * (self.ones.shape[1] - 1) + i
        raw = self._held.get(at)
        if raw is None:
            begin = int(self.ends[at - 1]) if at else 0
            self.file.seek(self._data + begin)
            raw = np.frombuffer(zstandard.decompress(self.file.read(int(self.ends[at]) - begin)), np.uint8)
            if len(self._held) >= self.HELD:
                self._held.clear()
            self._held[at] = raw
        return raw

    def _rank(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, rest = divmod(i, BLOCK)
        out = int(self.ones[k, block])
        if rest:
            part = self._block(k, block)[: -(-rest // 8)].copy()
            if rest % 8:
                part[-1] &= (1 << rest % 8) - 1
            out += int(np.bitwise_count(part).sum())
        return out

    def _select(self, k: int, one: int, j: int) -> int:
        """Place of the j-th (from 0) bit of that kind in plane k."""
        before = self.ones[k] if one else np.minimum(np.arange(self.ones.shape[1]) * BLOCK, self.n) - self.ones[k]
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self._block(k, block), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            block, rest = divmod(i, BLOCK)
            one, ones = int(self._block(k, block)[rest >> 3]) >> (rest & 7) & 1, self._rank(k, i)
            value, i = value << 1 | one, self.zeros[k] + ones if one else i - ones
        return value

    def _interval(self, value: int, upto: int) -> tuple[int, int]:
        """Where the id's occurrences among the first `upto` stand below the last plane."""
        lo, hi = 0, upto
        for k in range(self.bits):
            a, b = self._rank(k, lo), self._rank(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, upto: int | None = None) -> int:
        """Occurrences of an id among the first `upto`."""
        if not 0 <= value < 1 << self.bits:
            return 0
        lo, hi = self._interval(value, self.n if upto is None else max(0, min(upto, self.n)))
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._interval(value, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - plane) & 1
            at = self._select(plane, one, at - self.zeros[plane] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids."""
        blocks, planes = self.ones.shape[1] - 1, []
        self.file.seek(self._data)
        data, begin, z = self.file.read(int(self.ends[-1]) if len(self.ends) else 0), 0, zstandard.ZstdDecompressor()
        for k in range(self.bits):
            parts = []
            for end in self.ends[k * blocks : (k + 1) * blocks].tolist():
                parts.append(z.decompress(data[begin:end]))
                begin = end
            planes.append(np.frombuffer(b"".join(parts), np.uint8))
        return WaveletMatrix(planes, self.zeros, self.n).decode()


class PieceEncoder:
    """Encodes with the tokenizers library, each distinct piece of a chunk of texts once.

    A byte-level BPE of this kind never joins across a space that a non-space follows, so a text's ids are those of
    its pieces cut before such spaces, one after another. A piece of Latin letters, ASCII digits and marks and single
    line ends falls into runs of one kind, which the library's model encodes; any other piece goes through the whole
    tokenizer (tests compare with whole texts). Strings of special tokens become those tokens, as the library does by
    default (special=False: they are plain text); texts that hold one are encoded whole. Runs of up to LONGEST characters are remembered from chunk to chunk, at
    most KEEP in each of two generations, some 120 MB a worker (250 MB if all are of that length)."""

    KEEP, LONGEST = 400_000, 32
    #: Pieces whose ids are gathered at once.
    GATHER = 100_000
    #: Apostrophes are left out: they may join letters. All letters of the range, and no others, are taken as such.
    _LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
    PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*")
    RUNS = re.compile(f"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n")
    WORD = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")  # the commonest pieces

    def __init__(self, path: str, keep: int | None = None, special: bool = True):
        self.KEEP = keep or self.KEEP
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        self.tokenizer, self.tokenize, self.now, self.older, self.inner = tokenizer, tokenizer.model.tokenize, {}, {}, {}
        # texts that hold one of these go through the library whole: white space before them is cut otherwise
        self.whole = [t.content for t in tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.largest = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        # the letters that stand for bytes, as the library's own byte-level step gives them
        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.space = step.pre_tokenize_str(" ")[0][0]
        self.letters = {c: step.pre_tokenize_str(chr(c))[0][0] for c in range(0x250)}
        own = tokenizer.pre_tokenizer
        self.plain_model = isinstance(own, pre_tokenizers.ByteLevel) and own.use_regex and not own.add_prefix_space and tokenizer.normalizer is None

    @classmethod
    def of_worker(cls, path: str, keep: int | None = None) -> PieceEncoder:
        """The worker's own encoder: what one task has learned serves the next. Kept outside of this code's module,
        which travels to the workers with every task anew; other operators' tasks free it (shared.lean)."""
        held = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__.setdefault("encoders", {})
        if (path, keep) not in held:
            held[path, keep] = cls(path, keep)
        return held[path, keep]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, text: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(text.translate(self.letters))]).tobytes()

    def _inner(self, run: str) -> bytes:
        """Ids of a run that no space precedes."""
        ids = self.inner.get(run)
        if ids is None:
            ids = self._run(run)
            if len(run) <= self.LONGEST:
                if len(self.inner) >= self.KEEP // 4:
                    self.inner.clear()
                self.inner[run] = ids
        return ids

    def _head(self, text: str) -> bytes:
        """Ids of what comes before a text's first cut."""
        if not self.plain_model or not self.PLAIN.fullmatch(text):
            return self._whole(text) if text else b""
        return b"".join(map(self._inner, self.RUNS.findall(text)))

    def _spaced(self, run: str) -> bytes:
        """Ids of a space and one run that is not remembered of late."""
        ids = self.older.get(run)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize(self.space + (run if run.isascii() else run.translate(self.letters)))]).tobytes()
        if len(run) <= self.LONGEST:
            if len(self.now) >= self.KEEP:
                self.older, self.now = self.now, {}
            self.now[run] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of a space and the piece, which begins with a non-space."""
        if not self.plain_model:
            return self._whole(" " + piece)
        word = self.WORD.fullmatch(piece)
        if word:
            letters, marks = word.groups()
            ids = self.now.get(letters) or self._spaced(letters)
            return ids + (self.inner.get(marks) or self._inner(marks)) if marks else ids
        if not self.PLAIN.fullmatch(piece):
            return self._whole(" " + piece)
        runs = self.RUNS.findall(piece)
        return (self.now.get(runs[0]) or self._spaced(runs[0])) + b"".join(map(self._inner, runs[1:]))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings, no nulls), each text followed by end_id, and how many each text has."""
        cut = pc.split_pattern(texts, " ")
        words, at = cut.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = words.dictionary_encode()
        codes, unique = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [self._head(w) for w in words.take(pa.array(at[:-1])).to_numpy(zero_copy_only=False).tolist()]
        del cut, words, coded
        odd = np.fromiter((not w or w[0].isspace() for w in unique), bool, len(unique))
        pieces = [self.now.get(w) or (b"" if o else self.piece(w)) for w, o in zip(unique, odd.tolist(), strict=True)]
        first = at[:-1]
        wrong = odd[codes]  # white space before a word that is no single space: cut the text anew
        wrong[first] = False
        nothing = len(unique) + len(heads) + 1
        whole = np.zeros(len(texts), bool)
        for content in self.whole:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        for i in np.union1d(np.searchsorted(at, np.flatnonzero(wrong), side="right") - 1, np.flatnonzero(whole)).tolist():
            if whole[i]:
                heads[i] = self._whole(texts[i].as_py())
            else:
                parts = re.split(r" (?=\S)", texts[i].as_py())
                heads[i] = b"".join([self._head(parts[0]), *map(self.piece, parts[1:])])
            codes[at[i] : at[i + 1]] = nothing
        codes[first] = len(unique) + np.arange(len(heads))
        codes = np.insert(codes, at[1:], nothing - 1)
        pieces += [*heads, np.uint32(end_id).astype("<u4").tobytes(), b""]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat, begin = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(size) - size
        ends, out, lengths = at[1:] + np.arange(1, len(heads) + 1), [], []  # where each text's codes end
        a = 0
        while a < len(ends):  # some texts at a time: the indices take several times the ids' own memory
            start = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, start + self.GATHER, side="right")))
            code = codes[start : int(ends[b - 1])]
            n = size[code]
            upto = np.cumsum(n)
            place = np.repeat(begin[code] - (upto - n), n)
            place += np.arange(len(place))
            out.append(flat[place])
            lengths.append(np.diff(upto[ends[a:b] - start - 1], prepend=0))
            a = b
        return np.concatenate(out), np.concatenate(lengths)


def _chunks(texts: pa.Array):
    """(from, upto) of rows that hold CHUNK_BYTES of text together, or one longer text."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j
        i = j


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, keep: int | None = None) -> None:
    """Shards under path, one file each (WaveletFile): documents in ascending id order, nulls first.

    Rows are dealt by ranges of id and a hash of the text, so that rows that share an id, or have none, can be parted;
    a task writes shards one after another. Each shard holds at most shard_ids ids and one document. Ids take as many
    bits as the vocabulary's largest needs. keep bounds the runs that a worker remembers (PieceEncoder.KEEP). Spark's text writer commits the files: a task or executor that fails leaves none."""

    def run(batches):
        encoder = PieceEncoder.of_worker(tokenizer_path, keep)
        bits = max(encoder.largest, end_id, 1).bit_length()
        part, seq, held, lengths, names, nulls, n = TaskContext.get().partitionId(), 0, [], [], [], 0, 0

        def image():
            wm = WaveletMatrix.build(np.concatenate(held), bits)
            blob = wm.to_bytes(np.concatenate(names), np.concatenate(lengths), nulls, part, seq)
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["image"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for a, b in _chunks(texts):
                flat, sizes = encoder.encode(texts.slice(a, b - a), end_id)
                upto, done = np.cumsum(sizes), 0
                while done < len(sizes):  # whole documents until the shard is full
                    took = int(upto[done - 1]) if done else 0
                    stop = min(int(np.searchsorted(upto, took + shard_ids - n)) + 1, len(sizes))
                    held.append(flat[took : int(upto[stop - 1])])
                    lengths.append(sizes[done:stop])
                    names.append(ids[a + done : a + stop])
                    nulls += int(missing[a + done : a + stop].sum())
                    n, done = n + len(held[-1]), stop
                    if n >= shard_ids:
                        yield image()
                        seq, held, lengths, names, nulls, n = seq + 1, [], [], [], 0, 0
        if held:
            yield image()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("place"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    # the text writer puts bytes as they are; the line end after them lies beyond what the head describes
    out = rows.mapInArrow(lean(run, keep=True), "image binary").select(F.col("image").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        out.write.option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                with WaveletFile(pa.BufferReader(blob.as_buffer())) as shard:
                    names, lengths = shard.documents()
                    raw = memoryview(shard.decode().astype("<u4", copy=False)).cast("B")
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    k = len(names)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([shard.part] * k, pa.int32()), "seq": pa.array([shard.seq] * k, pa.int32()), "doc_id": pa.array(names, mask=np.arange(k) < shard.nulls),
                        "at": pa.array(starts), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    files = spark.read.format("binaryFile").load(path).select("content")
    found = scratch.save(files.mapInArrow(lean(run, keep=True), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"), "found")
    sizes = scratch.save(found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n_ids")), "sizes")
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per task
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(before_part), F.lit(0)).alias("p0"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("s0")).join(parts, "part")
    out = found.join(checked_broadcast(scratch.save(offsets, "offsets")), ["part", "seq"])
    return out.select("doc_id", (F.col("p0") + F.col("s0") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, keep: int | None = None) -> DataFrame:
    """Writes the shards and reads them back: doc_id, start, n_tokens, ids_crc32. Ids are the library's with
    add_special_tokens=False, so a special token's string inside a text is that token. Null text is empty (one id, the end);
    null ids come first; rows with one id follow each other by a hash of the text. Extra columns are ignored; an empty
    table gives no shard and an empty result."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_shards(docs, tokenizer_path, scratch.path("shards"), end_id, keep=keep)
    return read_shards(docs.sparkSession, scratch.path("shards"), scratch)
