"""The stages of the pipeline, each against brute force on a small fixture, and the pipeline against its stages."""

import collections
import zlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_corpus import brute_components, text  # noqa: E402

from tidemark.llm import mixing, quality  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402

ITEM = "the baker sold 14 loaves before noon and 9 loaves after it so how many loaves were sold that day in all"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with junk, near copies, benchmark passages, null and empty texts, and columns named like the stages' own."""
    root = str(tmp_path_factory.mktemp("sf"))
    texts = [None, "", " "]
    for i in range(240):
        words = text(1000 + i, 40 + i % 50)
        texts.append(words.upper().replace(" ", "!! ") if i % 5 == 0 else words)
    texts += [texts[i] + " tail" for i in range(4, 60, 6)] + [f"{text(7, 20)} {ITEM} {text(8, 20)}", ITEM.replace("14", "23").replace("9", "8") + " " + text(9, 30)]
    rows = [(i, t, "en", ["web", None, "books"][i % 3], len(t or ""), f"rate{i}", f"row{i}", f"key{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate string, row string, key string")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i + 3, int(i % 5 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf):
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r["predicted"]}
    a = stages[0](spark, docs, sf)
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == good
    assert not {i + 3 for i in range(0, 240, 5)} & good and {i + 3 for i in range(240) if i % 5} <= good

    a = a.cache()
    ids = sorted(good)
    label, _ = brute_components([rows[i]["text"] for i in ids], 5, 80)
    first = {}
    for n, i in enumerate(ids):
        first.setdefault(label[n], i)
    b = stages[1](spark, a, sf).cache()
    assert b.columns == docs.columns and {r["doc_id"] for r in b.collect()} == set(first.values()) and len(first) < len(good)

    c = stages[2](spark, b, sf).cache()
    leaked = {i for i in first.values() if "baker sold" in (rows[i]["text"] or "")}
    assert leaked and c.columns == docs.columns and {r["doc_id"] for r in c.collect()} == set(first.values()) - leaked

    d = stages[3](spark, c, sf).cache()
    copies = collections.Counter(r["doc_id"] for r in d.collect())
    assert d.columns == docs.columns and max(copies.values()) <= 2 and all(r == rows[r["doc_id"]] for r in d.collect())
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in c.collect()}
    for s in ("web", None, "books"):
        own = [i for i in size if rows[i]["source"] == s]
        target = mixed_targets({x: sum(size[i] for i in size if rows[i]["source"] == x) for x in ("books", "web", None)})[s]
        assert abs(sum(copies[i] * size[i] for i in own) - target) <= 0.01 * target + 1

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    e = stages[4](spark, d, sf).orderBy("start").collect()
    at = 0
    for r in e:
        want = [*t.encode(rows[r["doc_id"]]["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert [r["doc_id"] for r in e] == sorted(copies.elements())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, e))


def test_stages_of_nothing(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def mixed_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing again and again; sizes in the order of the sources."""
    names, left, target = list(sizes), share * sum(sizes.values()), {}
    open_ = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    while open_:
        per = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * per > most * sizes[s]]
        if not full:
            return target | {s: w * per for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing(spark, seed):
    r = np.random.default_rng(seed)
    names = sorted(f"s{i:02d}" for i in range(3 + 4 * seed)) + [None]
    sizes = {s: int(10 ** r.uniform(0, 5)) for s in names}
    got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = mixed_targets(sizes)
    assert all(abs(got[s] - want[s]) <= 1e-6 * want[s] for s in names)


def test_dual_and_diffusion():
    r = np.random.default_rng(1)
    x, mass = r.uniform(0.01, 9, 300), r.integers(1, 900, 300).astype(float)
    for part in (0.05, 0.5, 0.999, 1.3, 1.9):
        lam = mixing.solve_dual(x, mass, part * mass.sum(), 2)
        assert abs((mass * np.minimum(2, np.exp(lam * x))).sum() - part * mass.sum()) < 1e-6 * mass.sum()
    levels = np.array([1.0, 5, 40, 900])
    cells = [r.integers(0, 30, 50) * v for v in levels]
    rates = np.array([1.4, 1.3, 1.2, 1.1])
    cut = mixing.diffuse(levels, rates, cells, 2)
    got = sum(c.sum() + c[:k].sum() for c, k in zip(cells, cut, strict=True))
    assert abs(got - sum(c.sum() * q for c, q in zip(cells, rates, strict=True))) <= 15
