"""Secret scan with a recursive decoding worklist.

Every text is scanned with the base patterns. Then layers are unwrapped from a worklist until nothing new appears: URL
(%XX), Unicode (\\uXXXX, \\u{X...}, \\UXXXXXXXX, \\xXX, &#n;), base64 (both alphabets, from each of the four alignments, wrapped lines
joined) and compressed bytes (zlib, gzip, bzip2, all members) inside base64 or written as %XX or \\xXX. Bytes needn't be clean text: those outside UTF-8
stand for themselves, and UTF-16 stretches are read too. Archives are read as streams, in windows that end where no match
can go on. Each new layer is scanned again and its matches are mapped back to the characters of the original text they came
from. A layer whose content was already seen at the same place is not opened again, which ends cycles such as an archive
that unpacks to itself.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Unpacked bytes are scanned in windows of about WINDOW bytes. A single stretch of an archive that a match could fill and that is
#: longer than MAX_UNPACKED is reported as kind "oversize" as well: layers inside such a stretch may be cut.
WINDOW = 1 << 22
MAX_UNPACKED = 1 << 26
_PIECE = 1 << 20
_OVERLAP = 1 << 16

_WORDS = ("passw", "secret", "token", "api")
_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(r"\\u(?:([0-9A-Fa-f]{4})|\{0*([0-9A-Fa-f]{1,6})\})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
_NARROW = re.compile(r"(?:[A-Za-z0-9+/_-]{4,15}\r?\n[\x20\t]*){2,}[A-Za-z0-9+/_-]*={0,2}")  # base64 in lines shorter than those of _BASE64
_URL_BYTES = re.compile(r"[A-Za-z0-9_.~-]{0,12}%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/!*'()-])+")
_HEX_BYTES = re.compile(r"[\x21-\x5b\x5d-\x7e]{0,12}\\x[0-9A-Fa-f]{2}(?:\\x[0-9A-Fa-f]{2}|\\[nrt'\"\\]|[\x20-\x5b\x5d-\x7e])+")
_LEAD = 12  # plain characters that may stand before the first escape
_UNIT = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\[nrt'\"\\]|.")
_BYTE_OF = {"\\n": 10, "\\r": 13, "\\t": 9, "\\'": 39, '\\"': 34, "\\\\": 92}
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh")
_ARCHIVE = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\x78[\x01\x5e\x9c\xda]")
_TELLING = re.compile(rb"[A-Za-z0-9+/_.=-]{6}|%[0-9A-Fa-f]{2}|\\[uUx]|&#")  # every pattern and escape holds one of these
_WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){6,}|(?:\x00[\t\r\n\x20-\x7e]){6,}")
_INSIDE = np.zeros(256, dtype=bool)  # bytes a match, an escape, wrapped base64 or UTF-16 may hold
_INSIDE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-%\\&#;:'\"\x20\r\n\t\x00", dtype=np.uint8)] = True

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns: leftmost, not overlapping within a kind, failing ones dropped; by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for k, s, e in sorted(out, key=lambda x: (x[1], x[0], x[2]))]


class _Layer:
    """A decoded text; start[i], end[i]: the original characters that character i came from; fresh[i]: decoded here."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, fresh: np.ndarray, path: str):
        self.text, self.start, self.end, self.fresh, self.path = text, start, end, fresh, path


def _from_bytes(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Bytes as UTF-8 with their origins; a byte outside UTF-8 becomes a character of its own."""
    text = raw.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    width[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    tails = np.cumsum(width) - 1
    return text, start[tails - width + 1], end[tails]


def _substituted(layer: _Layer, pattern: re.Pattern, name: str, value) -> _Layer | None:
    """The whole text with every run of escapes replaced by what it stands for."""
    parts, starts, ends, fresh, at, text = [], [], [], [], 0, layer.text
    for m in pattern.finditer(text):
        new = value(m)
        if new is None:
            continue
        for s, e in ((at, m.start()),):
            parts.append(text[s:e])
            starts.append(layer.start[s:e])
            ends.append(layer.end[s:e])
            fresh.append(np.zeros(e - s, dtype=bool))
        parts.append(new)
        starts.append(np.full(len(new), layer.start[m.start()]))
        ends.append(np.full(len(new), layer.end[m.end() - 1]))
        fresh.append(np.ones(len(new), dtype=bool))
        at = m.end()
    if not at:
        return None
    parts.append(text[at:])
    starts.append(layer.start[at:])
    ends.append(layer.end[at:])
    fresh.append(np.zeros(len(text) - at, dtype=bool))
    return _Layer("".join(parts), np.concatenate(starts), np.concatenate(ends), np.concatenate(fresh), f"{layer.path}{name}>")


def _url(m: re.Match) -> str | None:
    raw = bytes.fromhex(m.group().replace("%", ""))
    return raw.decode("utf-8", "replace")


def _unicode(m: re.Match) -> str | None:
    code = next(int(g, 10 if i == 4 else 16) for i, g in enumerate(m.groups()) if g)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _unpacked(pieces: Iterator[bytes], used: list[int] | None = None) -> Iterator[bytes]:
    """What the members of a compressed stream hold, as far as it can be read; ``used`` gets the bytes of whole members."""
    d, data, fed = None, b"", 0
    for piece in pieces:
        data += piece
        fed += len(piece)
        while data:
            if d is None:
                if not data.startswith(_MAGIC) and not _zlib_head(data):
                    if len(data) < 3:
                        break  # the next member's head may go on in the next piece
                    return
                d = bz2.BZ2Decompressor() if data.startswith(b"BZh") else zlib.decompressobj(47)
            try:
                out = d.decompress(data, _PIECE)
                while out:
                    yield out
                    if d.eof:
                        break
                    data = b"" if isinstance(d, bz2.BZ2Decompressor) else d.unconsumed_tail
                    out = d.decompress(data, _PIECE)
            except (zlib.error, OSError, ValueError, EOFError):
                return
            data = d.unused_data if d.eof else b""
            if d.eof:
                d = None
                if used is not None:
                    used[:] = [fed - len(data)]


def _stream(raw: memoryview, depth: int, used: list[int] | None = None) -> Iterator[bytes]:
    """The bytes found ``depth`` compressed layers below ``raw``."""
    out = iter(bytes(raw[k : k + _PIECE]) for k in range(0, len(raw), _PIECE))
    for k in range(depth):
        out = _unpacked(out, used if k == 0 else None)
    return out


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Windows of a stream, ending at bytes that no match goes across; True with those that had to be cut elsewhere."""
    held, sought = b"", WINDOW
    for piece in pieces:
        held += piece
        if len(held) < sought:
            continue
        b = np.frombuffer(held, dtype=np.uint8)
        stop = ~_INSIDE[b]
        stop[1:] |= (b[1:] == 0) & (b[:-1] == 0)
        at = int(np.flatnonzero(stop)[-1]) + 1 if stop.any() else 0
        if at:
            yield held[:at], False
            held, sought = held[at:], max(WINDOW, len(held) - at + _PIECE)
        elif len(held) > MAX_UNPACKED:
            yield held, True
            held, sought = held[-_OVERLAP:], WINDOW
        else:
            sought = 2 * len(held)
    if held:
        yield held, False


def _layers_of(raw: bytes, start: np.ndarray, end: np.ndarray, path: str) -> Iterator[_Layer]:
    """Layers for decoded bytes: the bytes as UTF-8, and their UTF-16 stretches."""
    if _TELLING.search(raw):
        got = _from_bytes(raw, start, end)
        yield _Layer(*got, np.ones(len(got[0]), dtype=bool), path)
    if b"\x00" in raw:
        for m in _WIDE.finditer(raw):
            text = m.group().replace(b"\x00", b"").decode()
            yield _Layer(text, start[m.start() : m.end() : 2], end[m.start() + 1 : m.end() : 2], np.ones(len(text), dtype=bool), path)


def _heads(raw: bytes, lead: int = 0) -> list[int]:
    """Where compressed bytes may begin: known heads anywhere; up to ``lead`` bytes after the beginning any zlib head, by its own check."""
    return sorted({x.start() for x in _ARCHIVE.finditer(raw)} | {k for k in range(lead + 1) if _zlib_head(raw[k : k + 3])})


def _zlib_head(raw: bytes) -> bool:
    return len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 <= 7 and not raw[1] & 32 and (raw[0] << 8 | raw[1]) % 31 == 0


def _unpack_layers(raw: bytes, start: np.ndarray, end: np.ndarray, path: str, whole: int, found: list[Span], lead: int = 0) -> Iterator[_Layer]:
    """Layers of the archives in decoded bytes. An archive that is all of them ends at ``whole``, its last character's padding included."""
    past = 0
    for head in _heads(raw, lead):
        if head < past:
            continue
        low, high = int(start[head]), int(whole if head == 0 else end[-1])
        seen, depth, inside, used = {raw[head : head + _PIECE]}, 1, path, []
        while (first := next(_stream(memoryview(raw)[head:], depth), None)) is not None and first not in seen:
            seen.add(first)
            inside += "unpack>"
            for window, cut in _windows(_stream(memoryview(raw)[head:], depth, used)):
                if cut:
                    found.append((f"{inside}oversize", low, high))
                yield from _layers_of(window, np.full(len(window), low), np.full(len(window), high), inside)
            depth += 1
        if used:
            past = head + used[0]


def _opened(layer: _Layer, found: list[Span]) -> Iterator[_Layer]:
    """Layers inside base64 runs of a layer."""
    runs = [*_BASE64.finditer(layer.text), *(_NARROW.finditer(layer.text) if "\n" in layer.text else ())]
    for m in runs:
        run, at = m.group().rstrip("="), None
        if "\n" in run:
            kept = np.array([i for i, c in enumerate(run) if c not in "\r\n\t "])
            at, run = m.start() + kept, "".join(run.split())
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            part = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            if not _heads(raw) and not _TELLING.search(raw) and b"\x00" not in raw:
                continue
            k = np.arange(len(raw))
            place = at if at is not None else np.arange(m.start(), m.start() + len(run))
            start, end, path = layer.start[place[skip + k * 8 // 6]], layer.end[place[skip + np.minimum((k * 8 + 7) // 6, len(part) - 1)]], f"{layer.path}base64>"
            yield from _layers_of(raw, start, end, path)
            yield from _unpack_layers(raw, start, end, path, layer.end[m.end() - 1] if skip == 0 else end[-1], found)


def _bytes_in_escapes(layer: _Layer, found: list[Span]) -> Iterator[_Layer]:
    """Layers of runs of %XX or \\xXX, with the plain characters among them, that are bytes rather than text: archives and UTF-16."""
    for pattern, mark, name in ((_URL_BYTES, "%", "url"), (_HEX_BYTES, "\\x", "unicode")):
        for m in pattern.finditer(layer.text) if mark in layer.text else ():
            units = [(u.start(), u.end(), _BYTE_OF.get(u.group()) if u.group() in _BYTE_OF else int(u.group()[-2:], 16) if len(u.group()) > 2 else ord(u.group())) for u in _UNIT.finditer(layer.text, m.start(), m.end())]
            raw = bytes(v for _, _, v in units)
            if not _heads(raw, _LEAD) and b"\x00" not in raw:
                continue
            start, end, path = layer.start[[s for s, _, _ in units]], layer.end[[e - 1 for _, e, _ in units]], f"{layer.path}{name}>"
            if b"\x00" in raw:
                yield from _layers_of(raw, start, end, path)
            yield from _unpack_layers(raw, start, end, path, end[-1], found, _LEAD)


def _inner(layer: _Layer, found: list[Span]) -> Iterator[_Layer]:
    new = [_substituted(layer, re.compile(f"(?:{_URL.pattern})+"), "url", _url) if "%" in layer.text else None, _substituted(layer, _UNICODE, "unicode", _unicode) if "\\" in layer.text or "&#" in layer.text else None]
    yield from (x for x in new if x is not None and len(x.text))
    yield from _opened(layer, found)
    yield from _bytes_in_escapes(layer, found)


def all_spans(text: str) -> list[Span]:
    """Base spans and those of decoded layers (kind prefixed with the layers, as in "url>base64>assign"), by start, then base kinds first."""
    found: list[Span] = []
    base = base_spans(text)
    if "%" in text or "\\" in text or "&#" in text or _BASE64.search(text) or ("\n" in text and _NARROW.search(text)):
        at = np.arange(len(text))
        whole = _Layer(text, at, at + 1, np.zeros(len(text), dtype=bool), "")
        work, seen = [iter([whole])], set()
        while work:  # layers are made one at a time, so that a large archive is never held whole
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
                continue
            if layer is not whole:
                key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(layer.start[0]), int(layer.end[-1]))
                if key in seen:
                    continue
                seen.add(key)
                for kind, s, e in base_spans(layer.text):
                    if layer.fresh[s:e].any():
                        found.append((layer.path + kind, int(layer.start[s:e].min()), int(layer.end[s:e].max())))
            work.append(_inner(layer, found))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted({*base, *found}, key=lambda x: (x[1], rank.get(x[0], len(KINDS)), x[0], x[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and ``spans``, an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts give no spans; repeated rows are scanned again; extra columns are ignored; whole texts are read.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, type=pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op10_decoding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", *map(n, KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
