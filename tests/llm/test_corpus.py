"""Small cases and brute force for the corpus operators."""

import collections
import gzip
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("tidemark.llm.queries")

from tidemark.llm import decontaminate, exact_dedup, language_model, licenses, line_dedup, minhash, mixing, quality, tokens, warc  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402
from tidemark.llm.shared import WordHash, shingle_set  # noqa: E402

D = "doc_id long, text string, lang string, source string, n_chars long, size long, rate string"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, sources=None):
    """Rows with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", (sources or ["a", "b", None])[i % 3] if not isinstance(sources, str) else sources, 1, 7, "x") for i, t in enumerate(texts)], D)


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


ODD = [None, "", " \n\t", "one", "a b", text(1, 200), text(1, 200), text(2, 3000), "x " * 5000]


def test_exact_dedup(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, [*ODD, "a  b", "\na b"])).collect()}
    assert got[0]["keep_id"] == got[1]["keep_id"] == 0 and got[0]["group_size"] == 2
    assert got[4]["kept"] and got[9]["keep_id"] == 4 and not got[9]["kept"] and got[10]["group_size"] == 1
    assert got[6]["keep_id"] == 5 and len({r["text_sha256"] for r in got.values()}) == 8
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_mixing_meets_targets(spark):
    texts = [*ODD, *[text(i, 20 + i % 90) for i in range(300)]]
    df = docs(spark, texts)
    rows = mixing.mix_documents(df).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["copies"] <= 2 and r["size"] == len((r["text"] or "").split())
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 2 * v[0]["source_size"]
        assert abs(sum(r["copies"] * r["size"] for r in v) - v[0]["target"]) < 0.02 * v[0]["target"] + 2
    assert mixing.mix_documents(docs(spark, [])).count() == 0


def brute_components(texts, k, percent):
    sets = {i: set(map(int, shingle_set((t or "").encode().lower().split(), k, WordHash()))) for i, t in enumerate(texts)}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {x: a if y == b else y for x, y in label.items()}
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, k, percent):
    base = text(9, 150).split()
    texts = list(ODD)
    for i in range(40):  # chains and stars around the threshold
        w = list(base)
        r = np.random.default_rng(i)
        for _ in range(i % 6):
            w[int(r.integers(0, 150))] = f"new{i}"
        texts.append(" ".join(w))
    want, sizes = brute_components(texts, k, percent)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), k, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert got[0]["kept"] and got[1]["kept"]  # empty ones link with nothing


def test_near_duplicates_of_edge_hubs_and_short_sets(spark):
    """Groups whose members differ from each other, not from one middle, and sets of 1 to 20 shingles."""
    base, texts = text(11, 60).split(), []
    for i in range(60):
        r, w = np.random.default_rng(100 + i), list(base)
        for _ in range(int(r.integers(0, 7))):
            at = int(r.integers(0, len(w)))
            w[at : at + 1] = [[], ["the"], [f"odd{i}"], [w[at], "of"]][int(r.integers(0, 4))]
        texts.append(" ".join(w))
    texts += [text(200, n) for n in range(1, 23)] + [text(200, n) + " end" for n in range(1, 23)]
    for k, percent in ((3, 85), (5, 80)):
        want, _ = brute_components(texts, k, percent)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), k, percent, bands=40, rows=2).collect()}
        assert got == want


def test_near_duplicates_null_and_repeated_ids(spark):
    one, other = text(21, 40), text(22, 40)
    rows = [(None, one), (3, one), (1, one), (5, one), (5, other), (7, None), (None, ""), (9, text(23, 40)), (9, text(23, 40))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "component_id", "kept").na.fill(-1).collect())
    assert got == sorted([(-1, 1, False), (3, 1, False), (1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (-1, -1, True), (9, 9, True), (9, 9, True)])
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect() if r["text"]) == sorted([(1, one), (5, other), (9, text(23, 40))])
    assert kept.count() == 5
    assert minhash.near_duplicates(df.where("false")).count() == 0 and minhash.drop_near_duplicates(df.where("false")).count() == 0


def test_language_model_sums_to_one_and_beats_the_base(spark):
    r = np.random.default_rng(3)
    texts = [*ODD]
    for i in range(400):
        words = WORDS[:50] if i % 2 else WORDS[50:100]
        texts.append(" ".join(words[j] for j in r.integers(0, 50, 30)))
    rows = language_model.score_texts(docs(spark, texts)).collect()
    counts = collections.Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*(t or "").split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    for x in rows:
        w = [*(texts[x["doc_id"]] or "").split(), "\n"]
        assert x["n_tokens"] == len(w) and x["train_tokens"] == n and x["n_known"] == sum(c in counts for c in w)
        assert np.isclose(x["base_score"], sum(np.log10((counts[c] + 1) / (n + v + 1)) for c in w))
    held = [x for x in rows if x["held_out"] and x["doc_id"] >= len(ODD)]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) + 0.15 * sum(x["n_tokens"] for x in held)
    assert language_model.score_texts(docs(spark, [])).count() == 0
    assert np.allclose(np.exp(language_model._log_softmax(np.random.default_rng(0).normal(size=(5, 32)))).sum(1), 1)


def test_language_model_pairs_equal_counting_and_sum_to_one(spark):
    """Counts of pairs over several chunks against a Counter, and each context's probabilities over all words."""
    r = np.random.default_rng(8)
    texts = [None, "", *(" ".join(WORDS[j] for j in r.integers(0, 40, 25)) for _ in range(60))]
    learn = [i % 7 != 3 for i in range(len(texts))]
    lines = [[*(t or "").encode().split(), language_model.END] for t in texts]
    words = sorted({w for x in lines for w in x})
    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in words}
    h = np.array([hashes[w] for w in words[::2]], np.uint64).view(np.int64)  # every other word is unknown
    kinds = language_model.NAMED + np.zeros(len(h), np.int64)
    of_kind = np.arange(language_model.KINDS) % 3
    of_code = language_model.class_table(kinds, of_kind)
    sc = spark.sparkContext
    shared, classes = sc.broadcast((h, h)), sc.broadcast(of_code)
    df = spark.createDataFrame([(i, t, f, i) for i, (t, f) in enumerate(zip(texts, learn, strict=True))], "doc_id long, text string, learn boolean, rid long")
    chunks = language_model.encode(df.repartition(3), shared).cache()
    answers = language_model.pair_answers(language_model.pair_requests(chunks, shared, classes, 5)).cache()
    coder = language_model.Coder(h)
    cls = {w: int(of_code[coder[w] + language_model.ENDINGS]) for w in words}
    counts = collections.Counter((a, b) for x, f in zip(lines, learn, strict=True) if f for a, b in zip([language_model.END, *x], x, strict=False))
    seen = 0
    for row in chunks.collect():
        told = sorted(answers.where(f"cid = {row['cid']}").collect(), key=lambda x: x["bucket"])
        n, total, some = (np.concatenate([language_model.unpack(x[k], np.int64) for x in told]) for k in ("n", "total", "kinds"))
        sizes, syms = language_model.unpack(row["sizes"], np.int32), language_model.unpack(row["syms"], np.int32)
        flat = [w for i in row["ids"] for w in lines[i]]
        assert sizes.tolist() == [len(lines[i]) for i in row["ids"]] and syms.tolist() == [coder[w] for w in flat]
        starts = np.cumsum([0, *sizes])
        _, of, _, place = language_model.pair_places(syms, language_model.unpack(row["rare"], np.uint64), starts, h, of_code, hashes[language_model.END])
        prior = [language_model.END if j in set(starts) else flat[j - 1] for j in range(len(flat))]
        for j, (a, b) in enumerate(zip(prior, flat, strict=True)):
            after = {w: c for (x, w), c in counts.items() if x == a and cls[w] == cls[b]}
            assert (n[place[j]], total[of[j]], some[of[j]]) == (counts[a, b], sum(after.values()), len(after))
            if j % 50 == 0:
                q = {w: 1 / (1 + sum(cls[x] == cls[b] for x in words)) for w in words if cls[w] == cls[b]}
                each = np.array([float(after.get(w, 0)) for w in q])
                t, g = language_model.word_factor(each, np.full(len(q), total[of[j]]), np.full(len(q), some[of[j]]))
                assert np.isclose((t + g * np.array(list(q.values()))).sum() + g[0] * (1 - sum(q.values())), 1)
            seen += 1
    assert seen == sum(map(len, lines))


def test_quality_held_out(spark):
    r = np.random.default_rng(4)
    texts = [None, ""]
    for i in range(400):
        w = [WORDS[j] for j in r.integers(0, 400, 60)]
        texts.append(" ".join(x.upper() + "!!" for x in w) if i % 4 == 0 else " ".join(w))
    labels = spark.createDataFrame([(i + 2, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = {x["doc_id"]: x for x in quality.score_quality(docs(spark, texts), labels).collect()}
    assert all(rows[i + 2]["predicted"] == int(i % 4 != 0) for i in range(400))
    assert 0 <= rows[0]["score"] == rows[1]["score"] <= 1 and any(x["held_out"] for x in rows.values())
    none = labels.where("false")
    assert {x["score"] for x in quality.score_quality(docs(spark, texts[:5]), none).collect()} == {0.5}
    kept = quality.keep_good(docs(spark, texts), labels)
    assert kept.columns == docs(spark, []).columns and kept.where("doc_id >= 2").count() == 300


@pytest.mark.parametrize(("largest", "bits"), [(50_256, 16), (200_000, 18)])
def test_wavelet_file_by_path(tmp_path, largest, bits):
    n = 2 * tokens.BLOCK + 777
    ids = np.random.default_rng(5).integers(0, largest + 1, n).astype(np.uint32)
    ids[::7], ids[5] = 11, largest
    lengths = np.array([1000, n - 1500, 500])
    path = tmp_path / "shard"
    path.write_bytes(tokens.WaveletMatrix.build(ids, bits).to_bytes(np.array([0, 4, 9]), lengths, nulls=1, part=3, seq=2) + b"\n")
    with tokens.WaveletFile(path) as shard:
        names, sizes = shard.documents()
        assert (len(shard), shard.bits, shard.part, shard.seq, shard.nulls) == (n, bits, 3, 2, 1) and names.tolist() == [0, 4, 9] and (sizes == lengths).all()
        assert all(shard.access(i) == ids[i] for i in (0, 5, 511, 512, tokens.BLOCK - 1, tokens.BLOCK, n - 1))
        where = np.flatnonzero(ids == 11)
        assert shard.count(11) == len(where) and all(shard.count(11, i) == (ids[:i] == 11).sum() for i in (0, 777, tokens.BLOCK, n, n + 9))
        assert all(shard.select(11, k) == where[k] for k in (0, 5, len(where) // 2, len(where) - 1))
        assert shard.select(int(ids[5]), 0) == np.flatnonzero(ids == ids[5])[0] and shard.count(1 << bits) == 0
        assert (shard.decode() == ids).all()
        with pytest.raises(IndexError):
            shard.access(n)
        with pytest.raises(IndexError):
            shard.select(11, len(where))
    with pytest.raises(ValueError):
        tokens.WaveletMatrix.build(np.array([70_000], np.uint32), 16)
    path.write_bytes(tokens.WaveletMatrix.build(np.empty(0, np.uint32), 16).to_bytes(np.empty(0), np.empty(0)))
    with tokens.WaveletFile(path) as empty:
        assert len(empty.decode()) == 0 and empty.count(3) == 0


def test_token_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, "a  b", "\n\n a", "don't <|endoftext|>", "ab <|endoftext|> cd", "a  <|endoftext|>  b", "x<|endoftext|>y z", "é 　 ü!", "x\t y", "日本 語。 a"]
    got = {r["doc_id"]: r for r in tokens.encode_documents(docs(spark, texts), tokenizer_path()).collect()}
    at = 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), x
        at += len(ids)


def test_token_files_of_null_and_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [(None, text(1, 50)), (None, None), (0, "zero"), (4, text(2, 900)), (4, text(3, 700)), (-3, "a  b"), (None, text(4, 800))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens.write_shards(df, tokenizer_path(), str(tmp_path / "shards"), shard_ids=1000)
    docs_of, ids = [], []
    files = [tokens.WaveletFile(f) for f in (tmp_path / "shards").glob("part-*")]
    for shard in sorted(files, key=lambda s: (s.part, s.seq)):
        names, sizes = shard.documents()
        docs_of += [None if i < shard.nulls else int(x) for i, x in enumerate(names)]
        ids += np.split(shard.decode(), np.cumsum(sizes)[:-1])
    assert len(files) > 1 and docs_of == [None, None, None, -3, 0, 4, 4]
    want = sorted((-9 if i is None else i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows)
    assert sorted((-9 if i is None else i, x.tolist()) for i, x in zip(docs_of, ids, strict=True)) == want
    found = tokens.encode_documents(df, tokenizer_path()).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == docs_of and [r["n_tokens"] for r in found[3:5]] == [len(want[3][1]), len(want[4][1])]
    assert tokens.encode_documents(df.where("false"), tokenizer_path()).count() == 0


def test_decontamination(spark):
    item = "Anna has 12 apples and gives 5 apples to her friend so how many apples does Anna keep after the long walk"
    other = "it was said that Paul rode 40 km in 3 hours and that this was more than anybody else had ever done"
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "five of them")], "item_id long, text string")
    clean = [text(i, 60) for i in range(5)]
    changed = item.replace("12", "77").replace("5", "31")
    clash = changed.replace("how many apples does Anna", "how many apples does Anna")
    texts = [*clean, f"{clean[0]} {item} {clean[1]}", f"{clean[2]} {changed}", item[: len(item) // 3] + " " + clean[3], None, "", clash]
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert [i for i, r in sorted(got.items()) if r["contaminated"]] == [5, 6, 10]
    assert got[5]["item_id"] == 1 and len(got) == len(texts)
    left = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert left.count() == len(texts) - 3 and left.columns == docs(spark, []).columns


def test_slots_must_be_consistent(spark):
    item = "take 7 red cards and then 7 blue cards and add 7 green cards to the pile of 7 white cards now"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    one = item.replace("7", "9")
    mixed = "take 1 red cards and then 2 blue cards and add 3 green cards to the pile of 4 white cards now"
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(docs(spark, [one, mixed]), bench).collect()}
    assert got == {0: True, 1: False}


def test_line_dedup(spark):
    passage = text(20, 70)
    block = "\n".join(text(30 + i, 6) for i in range(12))
    texts = [f"head {i}\n{block}\ntail {i}" for i in range(3)] + [f"{text(40 + i, 5)}\n{passage}\n{text(50 + i, 5)}" for i in range(2)] + [None, "", text(60, 30)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[3]["text"] == texts[3] and got[5]["text"] is None and got[7]["text"] == texts[7]
    assert passage not in got[4]["text"] and got[4]["removed_chunks"] == 1
    assert got[1]["removed_lines"] >= 6 and "tail 1" in got[1]["text"] and "head 1" in got[1]["text"]
    lines = [x.encode() for x in block.split("\n")]
    cut = lambda x: {x[b - 1] for _, b in line_dedup.chunks(line_dedup.line_hashes(x), np.zeros(len(x), bool))}
    ends = cut(lines)
    assert len(ends & cut([b"new", *lines])) >= len(ends) - 1  # a line put in moves no boundary but the first


@pytest.mark.parametrize("sizes", [[25, 25, 3], [8] * 6, [8] * 10, [30, 25], [9, 60, 9], [4] * 40])
def test_line_dedup_removes_whole_passages(spark, sizes):
    """Passages of over 50 words between other lines, against what must go and what must stay."""
    passage = "\n".join(text(300 + i, n) for i, n in enumerate(sizes))
    texts = [f"{text(400 + i, 7)}\n{text(420 + i, 5)}\n{passage}\n{text(440 + i, 6)}" for i in range(6)] + [text(500 + i, 6) + "\n" + text(510 + i, 6) for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    single = {x for x, n in zip(passage.split("\n"), sizes, strict=True) if 60 in sizes and n == 9}
    for i in range(1, 6):
        left = set(got[i].split("\n"))
        assert set(texts[i].split("\n")) - set(passage.split("\n")) <= left and left & set(passage.split("\n")) <= single
    assert got[0] == texts[0] and all(got[i] == texts[i] for i in range(6, 10))


def test_line_dedup_odd_rows(spark):
    passage, other = text(70, 60), text(71, 60)
    rows = [(1, passage), (5, f"{text(72, 4)}\n{text(73, 4)}\n{passage}"), (5, other), (5, other), (6, None), (None, passage), (7, "")]
    got = [tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "removed_chunks").collect()]
    assert len(got) == len(rows)
    assert sorted(t for d, t, _ in got if d == 5) == sorted([rows[1][1].removesuffix("\n" + passage), other, other])
    assert (1, passage, 0) in got and (None, passage, 0) in got and (6, None, 0) in got and (7, "", 0) in got
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses(spark):
    texts = [text(1, 50) + "\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\nAll rights reserved.", text(2, 80), None, "He got his driving license last year.", "This work is licensed under the GNU General Public License, version 3."]
    got = {r["doc_id"]: r for r in licenses.document_licenses(docs(spark, texts)).collect()}
    assert [got[i]["families"] for i in range(6)] == ["mit", "cc-by-nc,proprietary", "", "", "", "gpl"]


def test_warc(spark):
    html = ["<p>one</p>", None, "", "<p>one</p>", "two\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "é" * 9000]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i} y", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, type int")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_round_trip(pages).collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i] == (len(raw), warc.payload_digest(raw), "response" if first == i else "revisit", None if first == i else first)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_warc_files_close_by_bytes(spark, tmp_path):
    html = ["x" * n for n in (10, 30, 40, 900, 1000, 20000, 20000, 70000)] + [None]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, file_bytes=20000)
    sizes = []
    for f in (tmp_path / "archives").glob("*.gz"):
        records = list(warc.parse(gzip.open(f)))
        sizes.append([len(b) for h, b in records if h["warc-type"] == "response"])
        assert len(records) % 3 == 0
    assert len(sizes) > 4 and all(len(x) < 2 or sum(x) < 20000 for x in sizes)
    got = warc.read_records(spark, path).where("type in ('response', 'revisit')").collect()
    assert sorted(len(r["payload"]) for r in got) == [0, 0, 10, 30, 40, 900, 1000, 20000, 70000]
    assert all(r["digest"] == "sha1:" + warc.payload_digest(bytes(r["payload"])) for r in got if r["type"] == "response")


def test_warc_parser_reads_by_length():
    body = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 12\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n"
    got = list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(body * 2)))))
    assert len(got) == 2 and got[0][1] == b"WARC/1.1\r\n\r\n"


def test_pieces_equal_whole_texts():
    """The encoder that cuts texts at spaces, against the library on whole texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    alphabet = [*"abcXYZé ñß×÷ªº'   \n\n\t\r  .,;:!?$%&#@_`~|<>()[]0123456789", "'s", " 'll", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "日本", "🙂", "́", "ɏ", "ɐ", "the ", "\n ", "\x00", "᠎", "​"]
    rng = np.random.default_rng(3)
    texts = [None, "", *("".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(5000))]
    own = tokens.PieceEncoder(tokenizer_path())
    own.KEEP = 500  # runs are forgotten and met again
    for i in range(0, len(texts), 700):
        some = texts[i : i + 700]
        ids, sizes = own.encode(pa.array([x or "" for x in some]), 2)
        for x, part in zip(some, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert part.tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], x


@pytest.mark.parametrize("n", [8, 9, 10, 11, 13, 16, 24])
def test_decontamination_finds_shared_runs_at_every_place(spark, n):
    item = text(80 + n, n)
    run = " ".join(item.split()[: min(n, 11)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"{text(90 + i, i)} {run} {text(95, 5)}".strip() for i in range(8)] + [text(99, 60)]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert got == {i: i < 8 for i in range(9)}


def test_decontamination_of_short_and_placeholder_items(spark):
    items = ["1 2 3 4 5 6 7 8 9 10 sum", "3 plus 4", "fortytwo", "Paul rode home on that cold day alone", "Red house"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{text(1, i)} {items[i]} {text(2, 9)}" for i in range(5)] + ["11 12 13 14 15 16 17 18 19 20 sum", "5 plus 6", f"{text(3, 40)}"]
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: None, 6: None, 7: None}


def test_licenses_without_cue_words_and_over_lines(spark):
    wrapped = "This work is licensed under the GNU\nGeneral Public\nLicense, version 3."
    texts = ["CC BY-SA 4.0", "This work is available under Creative Commons Attribution 4.0 International.", "Distributed under the Apache 2.0 terms.", wrapped, text(3, 300)]
    got = {r["doc_id"]: r for r in licenses.document_licenses(docs(spark, texts)).collect()}
    assert got[0]["families"] == "cc-by-sa" and got[3]["families"] == "gpl" and got[4]["families"] == ""
    assert all(got[i]["n_notices"] + got[i]["n_unconfirmed"] for i in range(3)), got


def test_licence_bound_spares_only_the_unknown():
    m = licenses.LicenseModel()
    r, known = np.random.default_rng(1), sorted({w for g in m.index for w in g.split()})
    for _ in range(2000):
        words = [str(w) for w in r.choice([*known, *WORDS[:60]], r.integers(0, 25))]
        if m.hopeless(words):
            assert m.predict(" ".join(words))[0] == "unknown"


def test_decontamination_tells_rows_apart(spark):
    """Null ids, several texts under one id, repeated rows, and items without or with shared ids."""
    item, other = text(300, 30), text(301, 30)
    bench = spark.createDataFrame([(None, item), (7, other), (7, text(302, 30))], "item_id long, text string")
    held, clean = f"{text(310, 9)} {item} {text(311, 4)}", text(312, 60)
    rows = [(None, held), (None, clean), (1, held), (1, clean), (1, None), (2, f"x {other}"), (2, f"x {other}"), (3, "")]
    df = spark.createDataFrame([(i, t, "d", "i") for i, t in rows], "doc_id long, text string, doc string, item string")
    got = sorted(((r["doc_id"], r["contaminated"], r["n_items"], r["item_id"]) for r in decontaminate.contamination(df, bench).collect()), key=str)
    want = [(None, True, 1, None), (None, False, 0, None), (1, True, 1, None), (1, False, 0, None), (1, False, 0, None), (2, True, 1, 7), (2, True, 1, 7), (3, False, 0, None)]
    assert got == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(None, clean), (1, clean), (1, None), (3, "")], "doc_id long, text string").collect()))
    assert decontaminate.contamination(df, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(df.where("false"), bench).count() == 0


def test_licenses_confirm_the_right_family():
    m = licenses.LicenseModel()
    for family, notices in licenses.NOTICES.items():
        for n in notices:
            assert (m.predict(n)[0], m.predict(n)[3]) == (family, True), n
    # held-out forms: what they are, or at least nothing else
    forms = {
        "Licensed under the Eclipse Public License 2.0": "epl", "CC BY-ND 4.0": "cc-by-nd", "This work is licensed under the GNU Affero General Public License, version 3.": "agpl",
        "Distributed under the Apache 2.0 terms.": "apache", "Licensed under CC BY-NC-ND 3.0.": "cc-by-nc-nd", "This file is licensed under the MIT License.": "mit",
    }
    assert {x: m.predict(x)[0] for x in forms if m.predict(x)[3]} == forms
    for plain in (*licenses.OTHERS, *licenses.PLAIN, "GNU Affero", "Licensed under the Boost Software License 1.0", "Licensed under the Artistic License 2.0", "Released under the zlib license",
                  "Sie kam mit ihm und mit dem Hund.", "Er wohnt mit seiner Frau in Köln.", "He reserved all rights of the first chapter.", "The public license office was closed."):
        assert not m.predict(plain)[3], plain
    assert all(m.predict(x)[0] == "unknown" for x in (*licenses.PLAIN, "mit", "Wir sind mit dem Rad und mit dem Zug gefahren."))


def test_licenses_tell_rows_apart(spark):
    notice = f"Released under the MIT License.\n{text(320, 30)}"
    rows = [(None, notice), (None, text(321, 30)), (1, notice), (1, text(322, 30)), (1, None), (2, notice), (2, notice)]
    df = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, doc string")
    got = sorted(((r["doc_id"], r["families"], r["n_notices"]) for r in licenses.document_licenses(df).collect()), key=str)
    assert got == sorted([(None, "mit", 1), (None, "", 0), (1, "mit", 1), (1, "", 0), (1, "", 0), (2, "mit", 1), (2, "mit", 1)], key=str)
