"""Secret scans: base patterns over the text and over every layer that can be unwrapped from it, spans mapped back.

A worklist per text unwraps URL escapes, Unicode escapes and look-alikes, base64 and compressed bytes, nested in any
order, until nothing new turns up; each layer is scanned, and its spans are traced back through the layers above it."""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import lean

#: Kinds in order, their patterns and the length that a match (assign: its second group) needs.
KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Characters of base64 from which on a run is decoded: those of the shortest secret, a 14-character assignment.
LEAST_RUN = 19
#: Bytes that one text's compressed layers are unwrapped to; layers beyond are counted (n_unread).
LAYER_BYTES = 1 << 25

_ASSIGN = re.compile(KINDS["assign"][0], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(KINDS["access"][0])
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # the runs that are long enough
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}"
    r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|equals|colon|lowbar);|[\uFF01-\uFF5E]|[\u00AD\u200B-\u200D\u2060\uFEFF]"
)
_WRAPPED = r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+={0,2}"
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:" + _WRAPPED + r"|[A-Za-z0-9+/_-]{%d,}={0,2})" % LEAST_RUN)
_PART = re.compile(r"[A-Za-z0-9]{%d,}={0,2}" % LEAST_RUN)
#: What a batch's texts are sorted out by before Python looks at one; each holds wherever the Python patterns match.
_SIFT = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "url": r"%[0-9A-Fa-f]{2}",
    "unicode": r"\\[uUx][0-9A-Fa-f{]|%u[0-9A-Fa-f]{4}|&(?:#|quot;|apos;|amp;|equals;|colon;|lowbar;)|[\x{FF01}-\x{FF5E}\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]",
    "base64": r"[A-Za-z0-9+/_-]{%d}" % LEAST_RUN,
}
_ALL = dict.fromkeys(_SIFT, True)


def base_spans(text: str, has: dict = _ALL) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches, leftmost and not overlapping within a kind."""
    out = []
    if has["assign"]:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if has["access"]:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if has["hex"]:
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """Text, how it was unwrapped from its parent, and which part of the parent each part of it comes from."""

    def __init__(self, text: str, parent: Layer | None = None, name: str = "", up=None):
        self.text, self.parent, self.name, self._up = text, parent, name, up

    def root_span(self, a: int, b: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            a, b = layer._up(a, b)
            layer = layer.parent
        return a, b

    def names(self) -> str:
        return f"{self.parent.names()}>{self.name}".lstrip(">") if self.parent is not None else ""


def _character(escape: str) -> str:
    if escape[0] == "&":
        return html.unescape(escape)
    if escape[0] in "\\%":
        if len(escape) == 12:  # a pair of surrogates
            return chr(0x10000 + ((int(escape[2:6], 16) & 0x3FF) << 10) + (int(escape[8:12], 16) & 0x3FF))
        code = int(escape.lstrip("\\%uUx").strip("{}"), 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return chr(ord(escape) - 0xFEE0) if "\uff01" <= escape <= "\uff5e" else ""


def _url_pieces(text: str):
    """(start, end, what stands for it) of each character that is written in URL escapes."""
    for m in _URL.finditer(text):
        at = m.start()
        for c in bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"):
            size = 3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode())
            yield at, at + size, chr(ord(c) - 0xDC00) if size == 3 and c > "\x7f" else c  # no UTF-8: the byte as Latin-1
            at += size


def _substituted(layer: Layer, name: str, pieces) -> Layer | None:
    """The layer with pieces replaced; spans map through a table of the places where copying and replacing alternate."""
    text, out, at, new, old = layer.text, [], 0, 0, []
    for start, end, put in pieces:
        for a, b, s, copied in ((at, start, text[at:start], True), (start, end, put, False)):
            if s:
                old.append((new, a, b, copied))
                out.append(s)
                new += len(s)
        at = end
    if not old and not at:
        return None
    if at < len(text):
        old.append((new, at, len(text), True))
        out.append(text[at:])
    news = [x[0] for x in old]

    def up(a: int, b: int) -> tuple[int, int]:
        n, start, _, copied = old[bisect_right(news, a) - 1]
        m, first, end, also = old[bisect_right(news, b - 1) - 1]
        return start + (a - n if copied else 0), first + (b - m) if also else end

    return Layer("".join(out), layer, name, up)


class _Budget:
    def __init__(self, left: int):
        self.left, self.unread = left, 0


def _inflate(data: bytes, budget: _Budget) -> tuple[str, bytes] | None:
    """Name and content of compressed bytes, at most as many as the budget has left; None if they aren't compressed."""
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        name, make = ("gzip" if data[0] == 0x1F else "zlib"), lambda: zlib.decompressobj(47)
    elif data[:3] == b"BZh":
        name, make = "bzip2", bz2.BZ2Decompressor
    elif data[:6] == b"\xfd7zXZ\x00":
        name, make = "xz", lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        name, make = "zstd", None
    else:
        return None
    out, room = [], budget.left
    try:
        if make is None:
            with zstandard.ZstdDecompressor(max_window_size=1 << 26).stream_reader(data, read_across_frames=True) as f:
                out.append(f.read(room + 1))
            room -= len(out[0])
        while make and data and room >= 0:  # members may follow each other
            member = make()
            out.append(member.decompress(data, room + 1))
            room -= len(out[-1])
            if not member.eof:
                break
            data = member.unused_data
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass  # what came before the fault counts
    content = b"".join(out)
    if room < 0:
        budget.unread += 1
        content = content[: budget.left]
    budget.left -= len(content)
    return (name, content) if content else None


def _texts(data: bytes, budget: _Budget):
    """(names, text, bytes a character or 0 where no character has a place of its own) of decoded bytes, compression undone."""
    names, seen = [], set()
    while (digest := hashlib.sha256(data).digest()) not in seen:
        seen.add(digest)
        found = _inflate(data, budget)
        if found is None:
            break
        names.append(found[0])
        data = found[1]
    else:
        return  # bytes that unwrap to themselves
    place = not names
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or len(data) > 3 and not len(data) % 2 and data.isascii() and (not any(data[1::2]) or not any(data[::2])):
        code = "utf-16" if data[0] >= 0xFE else "utf-16-le" if data[0] else "utf-16-be"
        yield [*names, "utf-16"], data.decode(code, "replace"), 0
    else:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        yield names, text, 1 if place and len(text) == len(data) else 0


def _decoded(layer: Layer, budget: _Budget):
    """Layers of the base64 runs; a run with separators is also taken in parts, as a path or a name may precede."""
    for m in _RUN.finditer(layer.text):
        runs = [(m.start(), m.group())]
        if re.search(r"[+/_-]", m.group()) and "\n" not in m.group():
            runs += [(m.start() + p.start(), p.group()) for p in _PART.finditer(m.group()) if p.group() != m.group()]
        for start, run in runs:
            places = [i for i, c in enumerate(run) if c not in "\r\n="] if "\n" in run else None
            code = re.sub(r"[\r\n=]", "", run).translate({ord("-"): "+", ord("_"): "/"})
            code = code[: len(code) - (len(code) % 4 == 1)]
            end = start + len(run)
            for names, text, width in _texts(base64.b64decode(code + "=" * (-len(code) % 4)), budget):

                def up(a: int, b: int, start=start, end=end, places=places, width=width, n=len(code)) -> tuple[int, int]:
                    if not width:
                        return start, end
                    first, last = a * 4 // 3, min(-(-b * 4 // 3), n) - 1
                    return (start + places[first], start + places[last] + 1) if places else (start + first, start + last + 1)

                yield Layer(text, layer, ">".join(["base64", *names]), up)


def scan(text: str, has: dict = _ALL, limit: int = LAYER_BYTES) -> tuple[list[tuple[int, int, str, str]], int, int]:
    """Spans (start, end, kind, layers; '' for the text's own) by start, kind and end, how many layers were scanned, and
    how many hold more than the limit's bytes. A span that the text itself has, or that several layers give, comes once."""
    budget, order = _Budget(limit), list(KINDS)
    found = {(kind, a, b): "" for kind, a, b in base_spans(text, has)}
    root = Layer(text)
    work, seen, layers = [root], {(text, 0, len(text))}, 0
    while work:
        layer = work.pop()
        of = has if layer is root else _ALL
        children = []
        if of["url"]:
            children.append(_substituted(layer, "url", _url_pieces(layer.text)))
        if of["unicode"]:
            children.append(_substituted(layer, "unicode", ((m.start(), m.end(), _character(m.group())) for m in _UNICODE.finditer(layer.text))))
        if of["base64"]:
            children += _decoded(layer, budget)
        for child in children:
            if child is None or not child.text:
                continue
            key = (child.text, *child.root_span(0, len(child.text)))
            if key in seen:  # met before at this place: a cycle, or another way to the same layer
                continue
            seen.add(key)
            layers += 1
            work.append(child)
            for kind, a, b in base_spans(child.text):
                span = (kind, *child.root_span(a, b))
                names = child.names()
                if span not in found or found[span] and (len(names), names) < (len(found[span]), found[span]):
                    found[span] = names
    return sorted(((a, b, kind, names) for (kind, a, b), names in found.items()), key=lambda x: (x[0], order.index(x[2]), x[1])), layers, budget.unread


def find_secrets(docs: DataFrame, text_col: str = "text", limit: int = LAYER_BYTES) -> DataFrame:
    """Every row of docs with secrets (array of start, end, kind, layers: code points, end exclusive; layers names what
    was unwrapped, '' for matches of the text itself), n_layers and n_unread.

    Rows are judged one by one, whole, by their text alone: nulls and empty texts have no secrets, repeated rows and ids
    change nothing. Columns that bear the new names are replaced. A text's compressed layers are unwrapped to at most
    limit bytes together; n_unread counts the layers of which some is left."""
    columns = [c for c in docs.columns if c not in ("secrets", "n_layers", "n_unread")]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("layers", pa.string())])
    rows = docs.select(*[F.col(f"`{c}`") for c in columns])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
            hits = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in _SIFT.items()}
            any_hit = sum(hits.values()) > 0
            spans, layers, unread = [[]] * len(texts), [0] * len(texts), [0] * len(texts)
            for i in any_hit.nonzero()[0].tolist():
                rows, layers[i], unread[i] = scan(texts[i].as_py(), {k: h[i] for k, h in hits.items()}, limit)
                spans[i] = [{"start": a, "end": b, "kind": kind, "layers": names} for a, b, kind, names in rows]
            new = [pa.array(spans, pa.list_(span)), pa.array(layers, pa.int64()), pa.array(unread, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "secrets", "n_layers", "n_unread"])

    new = StructType.fromDDL("secrets array<struct<start:bigint,end:bigint,kind:string,layers:string>>, n_layers bigint, n_unread bigint")
    return rows.mapInArrow(lean(run), StructType([*rows.schema, *new]))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: counts of the text's own matches by kind, the sha256 of their list, the list of all spans."""
    own = F.filter("secrets", lambda s: s["layers"] == "")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, KINDS), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), "n_layers", "n_unread")
