"""Merkle manifest, secret scan and alignment of tokenizers, against brute force and planted cases."""

import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import urllib.parse
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.queries")

from tidemark.llm import alignment, merkle, secrets  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string, path string, secrets string, n_a int"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with columns named like those of results."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 1) for r in rows], DOCS)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(nodes):
    """(root, a path of (sibling or None, on the left) per node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            other = at[i] ^ 1
            p.append((nodes[other] if other < len(nodes) else None, other < at[i]))
            at[i] //= 2
        nodes = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows, changed):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(enc, (r[0], r[3], r[2], r[4], r[1]))))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        own = sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = (own, *brute_tree([leaf(r) for r in own]))
    root, tops = brute_tree([trees[x][1] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        own, sub, paths = trees[x]
        for r, p in zip(own, paths, strict=True):
            folded = leaf(changed(r))
            for other, left in p + top:
                folded = digest(folded if other is None else other + folded if left else folded + other)
            out.append((r[0], leaf(r), sub, root, digest("".join(o for o, _ in p + top if o)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (5, 2, 1), (257, 8, 1, 64), (600, 1)])
def test_manifest_against_brute_force(spark, sizes):
    names = [None, "", "en", "é", "zz"]
    rows = [(len(names) * i + k - 7, f"text {i} ü" * (i % 5), names[k], [None, "s"][i % 2], [None, i][i % 3 > 0]) for k, n in enumerate(sizes) for i in range(n)]
    rows += [(None, None, "en", None, None), (None, "a", "en", None, None), (3, "same", "en", "s", 1), (3, "same", "en", "s", 1), (3, "other", "en", "s", 1)] if len(sizes) > 2 else []
    tamper = lambda r: (*r[:4], r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r
    changed = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.audit(frame(spark, rows), changed=changed).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows, tamper)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.audit(frame(spark, []).where("false")).count() == 0
    only = merkle.audit(frame(spark, [(1, "t", "en", "s", 1)])).first()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] and only["proof_sha256"] == digest("") and only["path"] == []
    # any changed value shows, wherever it is
    rows = [(i, f"t{i}", "en", "s", i) for i in range(37)]
    out = merkle.audit(frame(spark, rows), changed={"text": F.when(F.col("doc_id") == 36, "T36").otherwise(F.col("text"))}).collect()
    assert [r["doc_id"] for r in out if not r["verified"]] == [36]


SECRET = "password=hunter2hunter2"


def b64(data):
    return base64.b64encode(data).decode()


WRAPPED = {
    "url": urllib.parse.quote(SECRET).replace("p", "%70"),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "fullwidth": "".join(chr(ord(c) + 0xFEE0) for c in SECRET),
    "hidden": "pass​word=hunter2­hunter2",
    "base64": b64(b"and " + SECRET.encode() + b" too"),
    "base64url": base64.urlsafe_b64encode("ÿþ".encode("utf-16") + SECRET.encode()).decode().rstrip("="),
    "mime": base64.encodebytes((SECRET + " and more" * 20).encode()).decode(),
    "utf16": b64(SECRET.encode("utf-16-le")),
    "gzip": b64(gzip.compress(SECRET.encode())),
    "members": b64(gzip.compress(b"first ") + gzip.compress(SECRET.encode())),
    "zlib": b64(zlib.compress(SECRET.encode())),
    "bzip2": b64(bz2.compress(SECRET.encode())),
    "xz": b64(lzma.compress(SECRET.encode())),
    "zstd": b64(zstandard.compress(SECRET.encode())),
    "nested": urllib.parse.quote(b64(gzip.compress(b64(gzip.compress(f"x {SECRET} y".encode())).encode()))).replace("H", "%48"),
    "unicode in base64 in url": urllib.parse.quote(b64("".join(f"\\u{ord(c):04x}" for c in SECRET).encode())),
}


@pytest.mark.parametrize("name", list(WRAPPED))
def test_wrapped_secrets_are_found_at_their_place(name):
    text = f"Öffentlich 🙂 lead {WRAPPED[name]} tail of it"
    assert secrets.base_spans(text) == []
    spans, layers, unread = secrets.scan(text)
    assert spans and layers and not unread
    a = text.index(WRAPPED[name])
    for start, end, kind, names in spans:
        assert kind == "assign" and names and a <= start < end <= a + len(WRAPPED[name])


def test_spans_of_url_and_base64_are_exact():
    text = "é x p%61ssword%3Dhunter2hunter2 y"
    (span,), _, _ = secrets.scan(text)
    assert text[span[0] : span[1]] == "p%61ssword%3Dhunter2hunter2" and span[3] == "url"
    inner = b"123456" + SECRET.encode() + b" 123456789"
    text = "lead " + b64(inner)
    (span,), _, _ = secrets.scan(text)
    assert base64.b64decode(text[span[0] : span[1]] + "==")[: len(SECRET)] == SECRET.encode() and span[0] == 5 + 8


def test_base_spans_stay_and_cycles_end():
    text = f"{SECRET} AKIAABCDEFGHIJKL {'0a' * 16} {'%41' * 3} token: abc%41bcdefgh"
    spans, _, _ = secrets.scan(text)
    base = secrets.base_spans(text)
    assert {(k, a, b) for a, b, k, names in spans if not names} == set(base) and [k for k, _, _ in base] == ["assign", "access", "hex"]
    assert any(text[a:b] == "token: abc%41bcdefgh" and names == "url" for a, b, _, names in spans)
    deep = SECRET
    for _ in range(12):
        deep = b64(deep.encode())
    assert secrets.scan(deep)[0][0][3].count("base64") == 12
    bomb = b64(gzip.compress(gzip.compress(b"a" * 4_000_000)))
    spans, layers, unread = secrets.scan(bomb, limit=1 << 20)
    assert unread == 1 and layers >= 1
    for odd in ("", "%", "%%41%", "\\u12", "&#99999999;", "=" * 50, "A" * 5001, "%ff%fe" * 20, "\\ud800\\ud800 x", "\\U00110000", b64(b"\x1f\x8b broken")):
        secrets.scan(odd)


def test_secret_table_against_brute_force(spark):
    pattern = {
        "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
    }
    import re

    parts = [SECRET, 'TOKEN: "abc', "api_key=12345678", "apikey = 'x.y-z_9999'", "ſecret=12345678", "AKIA", "AKIAAKIAAKIAAKIA", "0123456789abcdef" * 2, "0" * 31, "F" * 40, " ", "=", "\n", "é", "passwd:token=secret=abcdefgh"]
    r = np.random.default_rng(1)
    texts = [None, "", *("".join(r.choice(parts, r.integers(1, 9))) for _ in range(300)), "x" * 200_000 + SECRET]
    rows = [(i if i % 50 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = secrets.find_secrets(frame(spark, rows))
    assert found.columns == [*(c for c in frame(spark, rows).columns if c != "secrets"), "secrets", "n_layers", "n_unread"]
    got = collections.Counter(tuple(x[:5]) for x in secrets.digests(found).collect())
    want: collections.Counter = collections.Counter()
    for i, t, *_ in rows:
        spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(pattern.items()) for m in re.finditer(p, t or "") if len(m.group(2) if kind == "assign" else m.group()) >= (8, 16, 32)[k]]
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
        want[(i, *(sum(x[3] == k for x in spans) for k in pattern), digest(said))] += 1
    assert got == want
    assert secrets.find_secrets(frame(spark, rows).where("false")).count() == 0


def brute_alignment(texts):
    """Rows of the contract, by walking both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    name, count, rows = {v: k for k, v in a.get_vocab().items()}, collections.Counter(), []
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw) != (" " + text).encode():
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(name[i]) for i in ids_a]).tolist(), np.cumsum([len(x) for x in raw]).tolist()
        starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b)) if max(starts_a[i], starts_b[j]) < min(ends_a[i], ends_b[j])]
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        groups = ["|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        count.update(links)
        rows.append((len(ids_a), len(ids_b), groups, links))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), digest(";".join(r[2]))) for r in rows]


ALPHABET = [*"abcXYZé ñß   \n\n\t\r .,;:!?$%&#@_`~|<>()[]0123456789'", "'s", " 'll", "<|endoftext|>", "<s>", "<0x41>", "\x1c", "\x85", "\xa0", "　", "日本", "🙂", "́", "the ", "\n ", "\x00", "᠎", "​", "ｗ", " die", "  "]


@pytest.mark.parametrize(("limit", "pairs"), [(200, None), (1 << 25, 0)])
def test_alignment_against_brute_force(spark, limit, pairs):
    r = np.random.default_rng(4)
    texts = [None, "", " ", "a", "▁", "a ▁ b", "one  two   three ", " lead", "tail ", "\n", "x" * 700, "日" * 90, *("".join(r.choice(ALPHABET, r.integers(1, 40))) for _ in range(250))]
    texts += [texts[-1], texts[-1], "the dog and the cat " * 400]
    rows = [(None if i == 7 else i // 2, t, "en", "s", 1) for i, t in enumerate(texts)]  # ids come twice
    got = alignment.align_documents(frame(spark, rows), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), limit, pairs).collect()
    want = [(rows[i][0], *x) for i, x in enumerate(brute_alignment(texts))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alignment_of_nothing(spark):
    args = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    assert alignment.align_documents(frame(spark, []).where("false"), *args).count() == 0
    empty = alignment.align_documents(frame(spark, [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "▁", None, None, None)]), *args).collect()
    assert sorted(map(tuple, empty)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_words_are_cut_where_both_sides_end():
    import pyarrow as pa

    texts = ["a b", "a  b c", " a", "a\n b", "a \nb", "a \x1cb c", "b a"]
    codes, words, sizes = alignment.cut_words(pa.array(texts))
    own = [[words[c].as_py() for c in part] for part in np.split(codes, np.cumsum(sizes)[:-1])]
    assert own == [["a", "b"], ["a  b", "c"], [" a"], ["a\n", "b"], ["a \nb"], ["a \x1cb", "c"], ["b", "a"]]
    assert [" ".join(x) for x in own] == texts
