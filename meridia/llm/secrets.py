"""Secret scan with a recursive decoding worklist.

The text is layer zero.  Each layer is scanned, and whatever in it is URL-encoded, has Unicode
escapes, is base64, or is compressed inside base64 is unwrapped to a further layer on the worklist,
until none is left.  A layer that was seen before (same content from the same place) is not
entered again, so self-reproducing archives end.  Spans found in a layer are mapped back through
its ancestors to code points of the original text: character by character through URL and Unicode
escapes, to the encoded run for base64 and compressed layers.  Base64 lines are decoded together with a
last line of any length, else by bodies and lines.  Where that does not account for all of a run, its lines of any length (indented,
or joined by a written line break) are decoded as one at all four alignments, and every text and compressed stream in it
counts, whatever stands before and after: a path, a prefix, other words.  Escapes are \\u, \\U, \\u{}, \\x, %u, octal and
character references; a surrogate that stands alone stays as written.  All members of gzip, bzip2, xz and zstd
streams, zlib and bare deflate, and all files of tar and zip archives are unpacked, as far as they can be read;
bytes that are not UTF-8 are read as UTF-16 where every other one is zero, else byte by byte.

Kinds of secrets (fixed values): assign, access, hex; see ``base_spans``.

``max_layer`` bounds the bytes that one encoded run is unpacked to, so that an archive bomb cannot fill a
worker; what was read up to there is scanned (cut between characters) and the run counts in ``n_truncated``.  It is
far above any layer that a real text holds, and texts themselves are never cut.

Defined cases: a null text counts as empty and has no spans; rows are scanned one by one whatever their
ids; an empty table gives no rows; columns named like the operator's are replaced, others kept.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_but, map_rows

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
MASK = "[SECRET]"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:%u[0-9A-Fa-f]{4})+|(?:\\[0-3][0-7]{2})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]{16,}+)*+)(\r?\n[A-Za-z0-9+/_-]{1,15}+)?={0,2}")
_C = "[A-Za-z0-9+/_-]"
_SEPARATOR = r"(?:(?:\r?\n|\\r\\n|\\n)[ \t]*+)"
#: Characters of the shortest secret, and of its base64.
_LEAST, _LEAST64 = 14, 19
#: Base64 characters in a row, in lines of any length, indented or joined by a written \\n.
_STREAM = re.compile(rf"(?<!{_C})(?:{_C}{{{_LEAST64},}}+(?:{_SEPARATOR}{_C}++)*+|{_C}++(?:{_SEPARATOR}{_C}++)++)")
_CHUNK = re.compile(rf"{_SEPARATOR}|({_C}++)")
#: Text inside decoded bytes: UTF-8, or UTF-16 of ASCII in either order.
_TEXTS = re.compile(rb"(?:[\t\r\n\x20-\x7E]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}){14,}+")
_WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7E]\x00){14,}+|(?:\x00[\t\r\n\x20-\x7E]){14,}+")
#: How compressed streams begin.
_BEGINS = re.compile(rb"\x1F\x8B\x08|BZh[1-9]1AY&SY|\xFD7zXZ\x00|\x28\xB5\x2F\xFD|PK\x03\x04|x[\x01\x5E\x9C\xDA]")
Span = tuple[int, int]
OWN = {"spans", "added", "n_truncated"}
_READ = 1 << 16
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; those that fail the length test are dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A decoded text, and how a span of it reads in its parent."""

    def __init__(self, text: str, parent: Layer | None = None, to_parent: Callable[[int, int], Span] | None = None, how: str = "", truncated: bool = False, partial: bool = False):
        self.text, self.parent, self.to_parent, self.truncated = text, parent, to_parent, truncated
        self.partial = partial or parent is not None and parent.partial
        self.path = (parent.path if parent else ()) + ((how,) if how else ())

    def original(self, start: int, end: int) -> Span:
        layer = self
        while layer.parent is not None:
            start, end = layer.to_parent(start, end)
            layer = layer.parent
        return start, end


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], list[tuple[str, int]] | None], how: str) -> Layer | None:
    """The layer with matches decoded; decode gives (character, source length) pairs, or None to leave the match."""
    parts, outs, ins, lengths, at, size = [], [0], [0], [0], 0, 0
    # Pieces: from outs[k] on, the text comes from ins[k] on; lengths[k]: source length of each character (0: copied).
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        if m.start() > at:
            parts.append(layer.text[at : m.start()])
            outs.append(size)
            ins.append(at)
            lengths.append(0)
            size += m.start() - at
        source = m.start()
        for char, n in got:
            parts.append(char)
            outs.append(size)
            ins.append(source)
            lengths.append(n)
            size, source = size + 1, source + n
        at = m.end()
    if not at:
        return None
    if at < len(layer.text):
        parts.append(layer.text[at:])
        outs.append(size)
        ins.append(at)
        lengths.append(0)

    def to_parent(start: int, end: int) -> Span:
        a, b = bisect_right(outs, start) - 1, bisect_right(outs, end - 1) - 1
        return (ins[a] if lengths[a] else ins[a] + start - outs[a]), (ins[b] + lengths[b] if lengths[b] else ins[b] + end - outs[b])

    return Layer("".join(parts), layer, to_parent, how)


def _url(run: str) -> list[tuple[str, int]] | None:
    data = bytes.fromhex(run.replace("%", ""))
    try:
        return [(c, 3 * len(c.encode())) for c in data.decode("utf-8")]
    except UnicodeDecodeError:
        return [(chr(b), 3) for b in data]


def _escape(run: str) -> list[tuple[str, int]] | None:
    """The characters of escapes; a surrogate that stands alone stays as it is written."""
    if run[1] == "u" and run[2] != "{":
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        out, i = [], 0
        while i < len(units):
            if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                out.append((chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00), 12))
                i += 2
                continue
            own = run[6 * i : 6 * i + 6]
            out += [(c, 1) for c in own] if 0xD800 <= units[i] < 0xE000 else [(chr(units[i]), 6)]
            i += 1
        return out if len(out) < len(run) else None
    if run[1].isdigit():  # octal bytes
        data = bytes(int(run[i + 1 : i + 4], 8) for i in range(0, len(run), 4))
        try:
            return [(c, 4 * len(c.encode())) for c in data.decode("utf-8")]
        except UnicodeDecodeError:
            return [(chr(b), 4) for b in data]
    digits = run.strip("\\uUx{}&#;X")
    code = int(digits, 10 if run.startswith("&#") and run[2] not in "xX" else 16)
    return [(chr(code), len(run))] if code < 0xD800 or 0xE000 <= code < 0x110000 else None


class Unpacked:
    """Texts inside decoded bytes with the way to each, whether they surely are texts, and whether the limit cut them."""

    def __init__(self) -> None:
        self.texts: list[tuple[str, str]] = []
        self.sure, self.truncated = True, False


def _zstd():
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


#: First bytes of compressed streams, their names, decoders.
_STREAMS: list[tuple[bytes, str, Callable]] = [
    (b"\x1f\x8b", "gzip", lambda: zlib.decompressobj(31)),
    (b"BZh", "bzip2", bz2.BZ2Decompressor),
    (b"\xfd7zXZ\x00", "xz", lzma.LZMADecompressor),
    (b"\x28\xb5\x2f\xfd", "zstd", _zstd),
]


def _read(data: bytes, decoder: Callable, magic: bytes, limit: int) -> bytes:
    """Up to limit bytes of a stream and of the members after it; what comes before damage is kept."""
    out = bytearray()
    while data and data.startswith(magic) and len(out) <= limit:
        own, at = decoder(), 0
        try:
            while at < len(data) and not own.eof and len(out) <= limit:
                out += own.decompress(data[at : at + _READ])
                at += _READ
        except Exception:  # noqa: BLE001 - damaged, or no such stream after all
            break
        if not own.eof:
            break
        data = own.unused_data + data[at:]
    return bytes(out[: limit + 1])


def _members(data: bytes, limit: int) -> tuple[str, list[bytes]] | None:
    """What data is (a kind of archive or stream) and its contents, one byte over limit at most each; None if it is neither."""
    for magic, name, decoder in _STREAMS:
        if data.startswith(magic):
            got = _read(data, decoder, magic, limit)
            return (name, [got]) if got else None
    try:
        if data[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
                return "tar", [f.read(limit + 1) for m in tar if m.isfile() and (f := tar.extractfile(m))]
        if data.startswith(b"PK\x03\x04"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return "zip", [z.open(i).read(limit + 1) for i in z.infolist() if not i.is_dir() and not i.flag_bits & 1]
    except Exception:  # noqa: BLE001 - no such archive after all
        return None
    if len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0 and (got := _read(data, zlib.decompressobj, b"", limit)):
        return "zlib", [got]
    if len(data) > 2 and data[0] & 6 != 6 and _text_of(data) is None:  # block type 3 does not exist
        got = _read(data, lambda: zlib.decompressobj(-15), b"", limit)
        if _text_of(got) is not None:
            return "deflate", [got]
    return None


def _decoded(data: bytes) -> str | None:
    """data as UTF-8, without a character that its end cuts; None if it is none."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        return data[: e.start].decode("utf-8") if e.start >= len(data) - 3 and e.end == len(data) and e.start else None


def _text_of(data: bytes) -> str | None:
    """data as text, if nearly all of it is printable."""
    text = _decoded(data)
    if text is None or len(text) < 8:
        return None
    bad = len(text) - len(_PRINTABLE.findall(text)) if text.isascii() else sum(not (c.isprintable() or c in "\t\r\n") for c in text)
    return text if 20 * bad <= len(text) else None


_PRINTABLE = re.compile(r"[\t\r\n\x20-\x7E]")


def _any_text(data: bytes) -> str:
    """data as the likeliest text, whatever it holds: UTF-16 by its zero bytes, UTF-8, or byte by byte."""
    zeros = (data[::2].count(0), data[1::2].count(0))
    if 3 * max(zeros) > len(data):
        return data.decode("utf-16-le" if zeros[1] > zeros[0] else "utf-16-be", "replace")
    text = _decoded(data)
    return data.decode("latin-1") if text is None else text


def _inner(data: bytes, limit: int) -> Unpacked:
    """The texts inside decoded bytes; nested archives are unpacked to the end, limit bytes in all."""
    out, seen, work, left = Unpacked(), set(), deque([(data, "base64")]), limit
    while work:
        data, how = work.popleft()
        key = hashlib.sha1(data).digest()
        if not data or key in seen:
            continue
        seen.add(key)
        got = _members(data, left)
        if got is None:
            text = _text_of(data)
            out.sure &= (text is not None or how != "base64") and not how.endswith("deflate")  # noise may inflate to letters
            out.texts.append((_any_text(data) if text is None else text, how))
            continue
        for member in got[1]:
            out.truncated |= len(member) > left
            member = member[: max(left, 0)]
            left -= len(member)
            work.append((member, f"{how}+{got[0]}"))
    return out


def _base64_text(run: str, limit: int) -> Unpacked | None:
    raw = re.sub(r"[=\r\n]", "", run).replace("-", "+").replace("_", "/")
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    try:
        got = _inner(base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True), limit)
    except binascii.Error:
        return None
    return got if got.texts else None


def _bodies(text: str, start: int, end: int) -> list[list[Span]]:
    """The lines of a run, grouped into bodies: lines of one length and a shorter last one."""
    out: list[list[Span]] = []
    for m in re.compile(r"[^\r\n]+").finditer(text, start, end):
        last = out[-1] if out else []
        size = last[0][1] - last[0][0] if last else 0
        if last and last[-1][1] - last[-1][0] == size and m.end() - m.start() <= size:
            last.append(m.span())
        else:
            out.append([m.span()])
    return out


def _unwrapped(layer: Layer, start: int, end: int, limit: int) -> tuple[list[Layer], bool]:
    """Layers of a run of base64 lines, and whether all of it surely is text.

    The run is taken whole; if that is no text, as bodies, then by lines; what is still none is read as bytes."""
    text = layer.text
    got = _base64_text(text[start:end], limit)
    whole = [] if got is None else [Layer(t, layer, lambda a, b: (start, end), how, got.truncated) for t, how in got.texts]
    if got is not None and got.sure:
        return whole, True
    bodies = _bodies(text, start, end)
    parts = [(own[0][0], own[-1][1]) for own in bodies] if len(bodies) > 1 else bodies[0]
    if len(parts) < 2:
        return whole, False
    inner = [_unwrapped(layer, s, e, limit) for s, e in parts]
    sure = all(ok for _, ok in inner)
    return [x for own, _ in inner for x in own] + ([] if sure else whole), sure


def _without_tail(m: re.Match, limit: int) -> bool:
    """Whether the short last line of a run is a word after it, not the end of its base64."""
    short, full = _base64_text(m[1], limit), _base64_text(m[0], limit)
    if short is None or not short.sure:
        return False
    if full is None or not full.sure or full.texts == short.texts:
        return True
    rest = full.texts[-1][0][len(short.texts[-1][0]) :]
    return not all(c.isprintable() or c in "\t\r\n" for c in rest)


def _pieces(layer: Layer, start: int, end: int, limit: int) -> Iterator[Layer]:
    """Texts anywhere in a run of base64 characters, whatever stands before and after their own base64.

    What precedes encoded data shifts it by 0 to 3 places, so the run is decoded at all four; what is text in one of them, or
    begins a compressed stream, is a layer that stands for the characters it was decoded from."""
    chunks = [m.span(1) for m in _CHUNK.finditer(layer.text, start, end) if m[1]]
    stream = "".join(layer.text[a:b] for a, b in chunks).replace("-", "+").replace("_", "/")
    if len(stream) < _LEAST64:
        return
    firsts = [0]
    for a, b in chunks:
        firsts.append(firsts[-1] + b - a)

    def place(i: int) -> int:
        """Where the stream's i-th character stands in the layer."""
        k = bisect_right(firsts, i) - 1
        return chunks[k][0] + i - firsts[k]

    def piece(text: str, how: str, at: int, first: int, last: int, truncated: bool = False) -> Layer:
        span = place(at + 4 * first // 3), place(min(len(stream), at - (-4 * last // 3)) - 1) + 1
        return Layer(text, layer, lambda a, b: span, how, truncated, True)

    left = limit
    for at in range(4):
        raw = stream[at:]
        raw = raw[: len(raw) - (len(raw) % 4 == 1)]
        data = base64.b64decode(raw + "=" * (-len(raw) % 4))
        for m in _TEXTS.finditer(data):
            yield piece(m[0].decode("utf-8", "replace"), "base64", at, *m.span())
        for m in _WIDE.finditer(data):
            yield piece(m[0].replace(b"\0", b"").decode(), "base64", at, *m.span())
        view, upto = memoryview(data), 0
        for m in _BEGINS.finditer(data):
            if m.start() < upto or left <= 0:
                continue
            out, upto = _member_at(view, m.start(), left)
            if out:
                got = _inner(out[:left], left)
                got.truncated |= len(out) > left
                left -= len(out)
                for text, how in got.texts:
                    yield piece(text, f"base64+{how}", at, m.start(), upto, got.truncated)


def _member_at(view: memoryview, start: int, limit: int) -> tuple[bytes, int]:
    """What a compressed stream that begins at start holds, up to one byte over limit, and where it ends; damage ends it."""
    begins, at = bytes(view[start : start + 30]), start
    decoder = next((d for magic, _, d in _STREAMS if begins.startswith(magic)), zlib.decompressobj)
    if begins.startswith(b"PK"):
        if len(begins) < 30 or begins[8:10] != b"\x08\0":
            return b"", start
        at += 30 + int.from_bytes(begins[26:28], "little") + int.from_bytes(begins[28:30], "little")
        decoder = lambda: zlib.decompressobj(-15)
    out, own, step = bytearray(), decoder(), 512
    try:
        while at < len(view) and not own.eof and len(out) <= limit:
            out += own.decompress(view[at : at + step])
            at, step = min(len(view), at + step), min(_READ, 2 * step)
    except Exception:  # noqa: BLE001 - damaged, or no such stream after all
        return bytes(out[: limit + 1]), max(start + 1, at if out else 0)
    return bytes(out[: limit + 1]), max(start + 1, at - len(own.unused_data) if own.eof else at)


def _layers_of(layer: Layer, limit: int) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (new := _replaced(layer, _URL, _url, "url")):
        yield new
    if ("\\" in text or "&#" in text or "%u" in text) and (new := _replaced(layer, _ESCAPE, _escape, "unicode")):
        yield new
    surely: list[Span] = []
    for m in _BASE64.finditer(text):
        end = m.end(1) if m[2] and _without_tail(m, limit) else m.end()
        layers, sure = _unwrapped(layer, m.start(), end, limit)
        if sure:
            surely.append((m.start(), end))
        yield from layers
    starts = [a for a, _ in surely]
    for m in _STREAM.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or surely[k][1] < m.end():  # lines that are text each may be one text together
            yield from _pieces(layer, m.start(), m.end(), limit)


def _told(told: list[tuple[tuple[str, int, int], str]], span: tuple[str, int, int], text: str) -> bool:
    """Whether a span that overlaps this one was found for the same secret, or holds it."""
    kind, start, end = span
    return any(k == kind and s < end and start < e and (s <= start and end <= e or text.startswith(own) or own.startswith(text)) for (k, s, e), own in told)


def scan(text: str | None, max_layer: int = MAX_LAYER) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans of the text, and the spans that decoded layers add; both by start, then kind."""
    return examine(text, max_layer)[:2]


def examine(text: str | None, max_layer: int = MAX_LAYER) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, added spans, and how many encoded runs hold more than max_layer bytes."""
    text = text or ""
    base = base_spans(text)
    found, added, seen, cut = set(base), [], set(), set()
    told: list[tuple[tuple[str, int, int], str]] = []
    work = deque([Layer(text)])
    while work:
        layer = work.popleft()
        if layer.parent is not None:
            for kind, a, b in base_spans(layer.text):
                span = (kind, *layer.original(a, b))
                own = layer.text[a:b]
                if span not in found and not (layer.partial and _told(told, span, own)):
                    told.append((span, own))
                    found.add(span)
                    added.append(span)
        for new in _layers_of(layer, max_layer):
            key = (hashlib.sha1(new.text.encode("utf-8", "surrogatepass")).digest(), new.original(0, max(1, len(new.text))))
            if new.truncated:
                cut.add(key[1])
            if key not in seen and new.text != layer.text:
                seen.add(key)
                work.append(new)

    def order(s: tuple[str, int, int]) -> tuple[int, int, int]:
        return s[1], KINDS.index(s[0]), s[2]

    return sorted(base, key=order), sorted(added, key=order), len(cut)


def find_secrets(docs: DataFrame, max_layer: int = MAX_LAYER, keep: list[str] | None = None) -> DataFrame:
    """Add spans (base) and added (from decoded layers), arrays of kind, start, end, by start, then kind; and n_truncated."""
    kept = columns_but(docs, OWN) if keep is None else keep
    inner = docs.select(*kept, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("spans", SPANS), T.StructField("added", SPANS), T.StructField("n_truncated", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def as_rows(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, added, cut = zip(*(examine(t, max_layer) for t in batch.column(batch.num_columns - 1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(as_rows, base), kind), pa.array(map(as_rows, added), kind), pa.array(cut, pa.int64())], names=schema.fieldNames())

    return map_rows(inner, run, schema)


def masked(text: str | None, spans: list[tuple[str, int, int]], mask: str = MASK) -> str | None:
    """text with every span (overlapping ones together) replaced."""
    if not text or not spans:
        return text
    out, at, upto = [], 0, -1
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= upto:
            out += [text[at:start] if start > at else "", mask]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, max_layer: int = MAX_LAYER, mask: str = MASK) -> DataFrame:
    """docs with the secrets of their texts masked (and n_chars, where it is a column, counted anew)."""
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t in batch.column(at).to_pylist():
            base, added = scan(t, max_layer)
            texts.append(masked(t, base + added, mask))
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    out = map_rows(docs, run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
