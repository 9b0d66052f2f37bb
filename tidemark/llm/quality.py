"""Quality classifier: a generalised additive model with pairwise interactions, of cyclic boosted shallow trees."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, blobs, lean

FEATURES = (
    "chars", "words", "word_chars", "upper", "digits", "marks", "other", "line_words", "own_words", "top_word",
    "repeated_lines", "shrinks_to", "ends_marked", "long_words", "one_char_words", "own_triples",
)
#: Labelled rows that training takes at most (those with the least hash of their id).
TRAIN_ROWS = 20_000
THRESHOLD = 0.3

_KIND = bytearray(b"o" * 256)  # upper, lower, digit, space, mark, other (bytes of letters beyond ASCII)
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = ord("u" if _c.isupper() else "l" if _c.islower() else "d" if _c.isdigit() else "s" if _c.isspace() else "m")
_KIND = bytes(_KIND)


def features(text: bytes | None) -> list[float]:
    """The numbers that a text is judged by; zeros for null, empty and blank texts. They see the text alone."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, kinds = len(words), text.translate(_KIND)
    u, d, m, o, s = (kinds.count(x) for x in (b"u", b"d", b"m", b"o", b"s"))
    solid = max(1, len(text) - s)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    marked = sum(v for k, v in ends.items() if _KIND[k] == 109 and k not in b".,;:?")
    lengths = np.fromiter(map(len, words), np.int32, n)
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2) if n > 2 else 1.0
    return [
        np.log1p(len(text)), np.log1p(n), solid / n, u / solid, d / solid, m / solid, o / solid, n / len(lines), len(counts) / n, max(counts.values()) / n,
        1 - len(set(lines)) / len(lines), len(zlib.compress(text, 1)) / len(text), marked / n, float((lengths > 14).mean()), float((lengths == 1).mean()), triples,
    ]


@dataclass
class AdditiveModel:
    """score = sigmoid(base + sum of one looked-up number per feature + one per pair of features)."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    BINS, COARSE = 64, 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def _coarse(self, b: np.ndarray) -> np.ndarray:
        return b * self.COARSE // self.BINS

    @staticmethod
    def _leaves(g: np.ndarray, h: np.ndarray, splits: int = 3, least: float = 2.0) -> np.ndarray:
        """A shallow tree over ordered bins: the best `splits` cuts one after another, then a damped Newton value a leaf."""
        cuts = [0, len(g)]
        cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
        for _ in range(splits):
            best = (1e-9, None)
            for a, b in zip(cuts, cuts[1:], strict=False):
                k = np.arange(a + 1, b)
                if not len(k):
                    continue
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                gain[(ch[k] - ch[a] < least) | (ch[b] - ch[k] < least)] = 0
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(k[i])))
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, most_pairs: int = 6, rate: float = 0.15) -> AdditiveModel:
        """Without labels the score is 0.5 everywhere; with one class it is near that class's label."""
        n = len(y)
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.BINS + 1)[1:-1])) if n else np.empty(0) for j in range(x.shape[1])]
        self.tables = [np.zeros(self.BINS) for _ in self.edges]
        if n == 0 or y.min() == y.max():
            return self
        b = self.bins(x)
        z = np.full(n, self.base)
        for _ in range(rounds):
            for j in range(b.shape[1]):  # in turn, so that no feature takes what another explains as well
                p = 1 / (1 + np.exp(-z))
                step = rate * self._leaves(np.bincount(b[:, j], y - p, self.BINS), np.bincount(b[:, j], p * (1 - p), self.BINS))
                self.tables[j] += step
                z += step[b[:, j]]
        c, k = self._coarse(b), self.COARSE
        p = 1 / (1 + np.exp(-z))
        gains = []
        for i in range(c.shape[1]):
            for j in range(i):
                cell = c[:, i] * k + c[:, j]
                gains.append((float((np.bincount(cell, y - p, k * k) ** 2 / (np.bincount(cell, p * (1 - p), k * k) + 1)).sum()), i, j))
        self.pairs = [(i, j, np.zeros(k * k)) for _, i, j in sorted(gains, reverse=True)[:most_pairs]]
        for _ in range(pair_rounds):
            for i, j, t in self.pairs:
                cell, p = c[:, i] * k + c[:, j], 1 / (1 + np.exp(-z))
                g, h = np.bincount(cell, y - p, k * k), np.bincount(cell, p * (1 - p), k * k)
                order = np.argsort(g / (h + 1), kind="stable")  # cells in the order of their means: a tree over the pair
                step = np.zeros(k * k)
                step[order] = rate * self._leaves(g[order], h[order])
                t += step
                z += step[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        c = self._coarse(b)
        for i, j, t in self.pairs:
            z += t[c[:, i] * self.COARSE + c[:, j]]
        return 1 / (1 + np.exp(-z))


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of FEATURES)."""

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in blobs(batch, "text")], np.float64).reshape(-1, len(FEATURES))
            offsets = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, x array<double>")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, y of at most `rows` labels that are not held out: those whose ids have the least hashes. Null labels and
    ids are left out; of an id's several labels each counts."""
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    return marks.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)


def train(table: DataFrame, some: DataFrame) -> AdditiveModel:
    """Fits on the rows of the feature table that a bounded sample of labels names."""
    got = table.join(F.broadcast(some), "doc_id").select("doc_id", "x", "y").toArrow().to_pydict()
    order = np.lexsort((got["y"], got["doc_id"])) if got["y"] else np.empty(0, int)
    x = np.array(got["x"], np.float64).reshape(-1, len(FEATURES))[order]
    return AdditiveModel().fit(x, np.array(got["y"], np.float64)[order])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Features of whole texts are computed once and written; labels join that narrow table. Null and empty texts have
    all features 0 and a score like any other. Repeated rows are scored each; extra columns are ignored."""
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.save(text_features(docs), "features")
    model = train(table, scratch.save(sampled(labels, train_rows), "labels"))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    out = table.mapInArrow(lean(run), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects; the model scores each text where it is read, without a shuffle."""
    scratch = Scratch(docs.sparkSession, "quality")
    some = scratch.save(sampled(labels), "labels")
    # at most TRAIN_ROWS ids are broadcast, so no text is shuffled
    model = train(scratch.save(text_features(docs.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")), "features"), some)

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in blobs(batch, "text")], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
