"""Secret scans through encodings.

A text is the first layer of a worklist. Each layer is scanned with the base patterns and then unwrapped: URL escapes,
Unicode and HTML escapes, base64 (both alphabets), hex, and what gzip, zlib, bzip2, xz or zstd packed inside these.
What comes out is a new layer, until none is new: layers that were seen before (same content, same place) end there,
so cycles do, and depth has no limit. Every layer keeps, for each character, the span of the original text that it
comes from; what was packed comes from the whole encoded piece. Packed data are unpacked as a stream: of more than a
window, one window after the other is scanned."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ESCAPE = re.compile(
    r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}"
    r"|\\x[0-7][0-9A-Fa-f]|(?:\\x[89A-Fa-f][0-9A-Fa-f])+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Base64 over several lines, also where the breaks are written as escapes.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++")
BREAK, PAD = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"), re.compile("={0,2}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{24,}")
#: Bytes of unpacked data that are scanned at once, and bytes of a longer stream that tell whether packed data begin.
WINDOW, AGAIN = 1 << 25, 1 << 16
#: Packed bytes that an unpacker gets at once.
STEP = 1 << 16
#: What packed data begin with; what neither a pattern nor an encoded piece holds.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
APART = re.compile(r"[^A-Za-z0-9+/_=\-\s%&#;:.\\\"']")
_IS_APART = np.array([APART.match(chr(c)) is not None for c in range(128)] + [True])
WIDE_LE, WIDE_BE = re.compile(rb"(?:[\x20-\x7e]\0){6,}"), re.compile(rb"(?:\0[\x20-\x7e]){6,}")
#: A run of ASCII as long as the shortest secret: less of it in other bytes is chance.
PLAIN = re.compile(rb"[\x20-\x7e\t\r\n]{12,}")
_FAULTS = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost without overlaps per kind, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _unpacker(head: bytes):
    """(a decompressor, whether it bounds what it gives at once) for packed data."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(47), True
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor(), True
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(), True
    return (zstandard.ZstdDecompressor().decompressobj(), False) if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _unpacked(chunks: Iterator[bytes], after: list[int] | None = None) -> Iterator[bytes]:
    """What was packed, all members one after the other, a piece at a time, up to the first fault. after: gets the
    number of bytes behind the last member, if no fault came."""
    most = 1 << 20
    data = next(chunks, b"")
    try:
        while found := _unpacker(data):
            d, bounded = found
            while not d.eof:
                if bounded:
                    part = d.decompress(data, most)
                    data = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
                    if part:
                        yield part
                    if d.eof or data or len(part) >= most or not getattr(d, "needs_input", True):
                        continue
                else:  # a few bytes at once, as they may become many
                    part, data = d.decompress(data[:256]), data[256:]
                    if part:
                        yield part
                    if d.eof or data:
                        continue
                data = next(chunks, None)
                if data is None:
                    return
            data = d.unused_data + (data if not bounded else b"")
            while len(data) < 6 and (more := next(chunks, None)) is not None:
                data += more
        if after is not None:
            after.append(len(data))
    except _FAULTS:
        return


def _held(chunks: Iterator[bytes]) -> tuple[bytes, bool]:
    """The first bytes of chunks, a window at most, and whether that is all."""
    out, size = [], 0
    for x in chunks:
        out.append(x)
        size += len(x)
        if size >= WINDOW:
            return b"".join(out), False
    return b"".join(out), True


def _wide(data: bytes) -> str | None:
    """The byte order of UTF-16 text: by its mark, or by characters of ASCII in a row, without which no pattern holds."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    if b"\0" in data:
        for name, run in (("utf-16-le", WIDE_LE), ("utf-16-be", WIDE_BE)):
            if any(m.start() % 2 == 0 for m in run.finditer(data)):
                return name
    return None


def _as_text(data: bytes) -> tuple[str, np.ndarray] | None:
    """Bytes as text, and where each character begins in them (one more for the end); None if they hold no text. Bytes
    of no encoding are read as ASCII, if some of it is there, and all others become marks."""
    if len(data) < 6:
        return None
    if data.isascii() and b"\0" not in data:
        return data.decode("ascii"), np.arange(len(data) + 1)
    wide, skip = _wide(data), 0
    try:
        text = data.decode(wide or "utf-8")
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.where(code > 0xFFFF, 4, 2) if wide else 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        skip = 2 if wide == "utf-16" else 0
    except UnicodeDecodeError:
        if wide and len(data) % 2 == 0:
            text = data.decode("utf-16-be" if wide == "utf-16-be" or data[:2] == b"\xfe\xff" else "utf-16-le", "surrogatepass")
            size = np.where(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0xFFFF, 4, 2)
            text = "".join("\ufffd" if "\ud800" <= c < "\ue000" else c for c in text)
        elif wide:
            found = _as_text(data[:-1])
            return found and (found[0], found[1])
        elif not PLAIN.search(data):
            return None
        else:
            return data.decode("ascii", "replace"), np.arange(len(data) + 1)
    return text, skip + np.concatenate(([0], np.cumsum(size)))


class _Reading:
    """A stream as texts, read as units of 1 byte, or of 2 in one order. What is not ASCII becomes a mark, as no pattern
    and no encoded piece holds it. A window ends behind a character that no pattern and no encoded piece holds, and goes
    on until there is one: so the windows show what the whole would."""

    def __init__(self, unit: str, run: re.Pattern[bytes]):
        self.unit, self.run = np.dtype(unit), run
        self.held: list[bytes] = []
        self.size, self.limit = 0, WINDOW

    def texts(self, x: bytes, last: bool = False) -> Iterator[str]:
        self.held.append(x)
        self.size += len(x)
        if self.size < self.limit and not last:
            return
        data, wide = b"".join(self.held), self.unit.itemsize
        end = len(data) // wide
        if not last:
            apart = _IS_APART[np.minimum(np.frombuffer(data, self.unit, end), 128)]
            end -= int(apart[::-1].argmax()) if apart.any() else end
        self.held = [data[end * wide :]]
        self.size = len(self.held[0])
        self.limit = max(WINDOW, 2 * self.size)
        if any(m.start() % wide == 0 for m in self.run.finditer(data, 0, end * wide)):
            units = np.frombuffer(data, self.unit, end)
            yield np.where(units < 128, units, 0xFFFD).astype("<u2").tobytes().decode("utf-16-le")


def _readings(chunks: Iterator[bytes]) -> Iterator[str]:
    readings = _Reading("u1", PLAIN), _Reading("<u2", WIDE_LE), _Reading(">u2", WIDE_BE)
    for x in chain(chunks, [None]):
        for r in readings:
            yield from r.texts(x or b"", x is None)


def _places(chunks: Iterator[bytes], found: list[tuple[int, tuple[bytes, int] | None]]) -> Iterator[bytes]:
    """chunks; found gets each place that packed data may begin at, and what they are and where they end (0: nobody
    knows), if a few bytes from there tell. Places that give nothing are left out."""
    buf, base, begin, kept = b"", 0, 0, 0  # base: the place of buf in the stream; begin: up to where buf was searched
    for x in chain(chunks, [None]):
        buf += x or b""
        until = len(buf) if x is None else len(buf) - AGAIN
        for m in PACKED.finditer(buf, begin):
            if m.start() >= until:
                break
            begin = m.end()
            ran_out, at, after, out, size = [], [0], [], [], 0
            for y in _unpacked(_from(buf[m.start() : m.start() + AGAIN], 0, at, ran_out), after):
                out.append(y)
                size += len(y)
                if size > AGAIN or kept + size > WINDOW:
                    break
            if size > AGAIN or kept + size > WINDOW or ran_out and not (x is None and m.start() + AGAIN >= len(buf)):
                found.append((base + m.start(), None))
            elif size:
                kept += size
                found.append((base + m.start(), (b"".join(out), base + m.start() + at[0] - after[0] if after else 0)))
        if x is not None:
            yield x
            begin = max(begin, until)
            buf, base, begin = buf[begin:], base + begin, 0


def _from(data: bytes, start: int, at: list[int], ran_out: list[bool] | None = None) -> Iterator[bytes]:
    """data from start in pieces, as an unpacker copies what it has not yet used; at: how far it came; ran_out: gets a
    word if it wanted more."""
    at[0] = start
    while at[0] < len(data):
        start, at[0] = at[0], min(at[0] + STEP, len(data))
        yield data[start : at[0]]
    if ran_out is not None:
        ran_out.append(True)


def _stream(data: bytes, path: tuple[int, ...], at: list[int], after: list[int]) -> Iterator[bytes]:
    """What lies at the first place of path in data, unpacked, then what lies at the next in that, and so on. at: how
    far the last source was read, after: bytes of it behind the packed data, if no fault came."""
    if len(path) == 1:
        return _unpacked(_from(data, path[0], at), after)
    return _unpacked(_after(_stream(data, path[:-1], [0], []), path[-1], at), after)


def _after(chunks: Iterator[bytes], skip: int, at: list[int]) -> Iterator[bytes]:
    for x in chunks:
        at[0] += len(x)
        if skip < len(x):
            yield x[skip:]
        skip = max(0, skip - len(x))


def _texts(data: bytes) -> Iterator[tuple[str, int, np.ndarray | None]]:
    """The texts in data: as they are, with their characters' places, or packed, to any depth, without places; with the
    byte they begin at. What unpacks to less than a window is held; the rest is unpacked again from its source for each
    thing of size found in it. Both ways give the same."""
    if (found := _as_text(data)) is not None:
        yield found[0], 0, found[1]
    seen: set[bytes] = set()
    number = count()
    done = [0]  # up to where this source was unpacked
    work = [(k, next(number), data, (k,), done, None) for k in (m.start() for m in PACKED.finditer(data))]
    while work:  # by where they begin: what lies in packed data is met there first
        first, _, root, path, done, known = heappop(work)
        if path[-1] < done[0]:
            continue
        at, after, stream, whole = [0], [], iter(()), True
        if known is None:
            stream = _stream(root, path, at, after)
            inner, whole = _held(stream)
        else:
            inner, done[0] = known[0], max(done[0], known[1])
        more: list[tuple[int, tuple[bytes, int] | None]] = []
        mark = hashlib.blake2b(inner, digest_size=16)
        if not whole:
            for text in _readings(_places(chain([inner], _hashed(stream, mark)), more)):
                yield text, first, None
        if inner and after:
            done[0] = at[0] - after[0]
        if not inner or mark.digest() in seen:
            continue
        seen.add(mark.digest())
        below = [0]
        if not whole:
            for k, part in more:
                heappush(work, (first, next(number), root, (*path, k), below, part))
            continue
        for text in _readings(iter([inner])):
            yield text, first, None
        for m in PACKED.finditer(inner):
            heappush(work, (first, next(number), inner, (m.start(),), below, None))


def _hashed(chunks: Iterator[bytes], mark) -> Iterator[bytes]:
    for x in chunks:
        mark.update(x)
        yield x


def _escape(s: str) -> str:
    if s[0] == "%":
        return bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")
    if s[:2] == "\\x":
        return bytes.fromhex(s.replace("\\x", "")).decode("utf-8", "replace")
    if s[0] == "\\":
        units = bytes.fromhex(s.replace("\\u", ""))
        return units.decode("utf-16-be", "replace")
    n = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


class Layer:
    """text, and for each character where in the original text it begins and ends (None: it is the original text);
    where: the one span that all of it comes from; fresh: which characters only decoding shows (None: all)."""

    def __init__(self, text: str, begins=None, ends=None, where: tuple[int, int] | None = None, fresh: np.ndarray | None = None):
        self.text, self.begins, self.ends, self.where, self.fresh = text, begins, ends, where, fresh

    @property
    def plain(self) -> bool:
        return self.where is None and self.begins is None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.where:
            return self.where
        return (a, b) if self.begins is None else (int(self.begins[a]), int(self.ends[b - 1]))

    def shows(self, a: int, b: int) -> bool:
        return not self.plain and (self.fresh is None or bool(self.fresh[a:b].any()))

    def _unescaped(self) -> Layer | None:
        t = self.text
        parts, end, size = [], 0, []
        for m in ESCAPE.finditer(t):
            a, b = m.span()
            new = _escape(m[0])
            parts += [t[end:a], new]
            size.append((a, b, len(new)))
            end = b
        if not parts:
            return None
        text = "".join([*parts, t[end:]])
        if self.where:
            return Layer(text, where=self.where)
        keep = np.ones(len(t), np.int64)  # how often each character's place is taken over: escapes, at their first
        for a, b, n in size:
            keep[a:b] = 0
            keep[a] = n
        origin = np.repeat(np.arange(len(t)), keep)
        last = np.arange(len(t))
        new = np.zeros(len(t), bool)
        for a, b, _ in size:
            last[a], new[a] = b - 1, True
        begins, ends = (origin, last[origin] + 1) if self.begins is None else (self.begins[origin], self.ends[last[origin]])
        return Layer(text, begins, ends, None, new[origin] | (self.fresh[origin] if self.fresh is not None else not self.plain))

    def _decoded(self, at: np.ndarray, data: bytes, bits: int, pad: int = 0) -> Iterator[Layer]:
        """Layers of data, which the characters at the places at spell, bits each, before pad more that spell none."""
        for text, first, places in _texts(data):
            if places is None or self.where:
                yield Layer(text, where=self.span(int(at[8 * first // bits]), int(at[-1]) + 1 + pad))
                continue
            lo, hi = at[8 * places[:-1] // bits], at[np.minimum((8 * places[1:] - 1) // bits, len(at) - 1)]
            yield Layer(text, *((lo, hi + 1) if self.begins is None else (self.begins[lo], self.ends[hi])))

    def _base64(self, at: np.ndarray) -> Iterator[Layer]:
        """Base64 whose characters stand at the places at: a run may begin before its code, so at each of four."""
        code = "".join(map(self.text.__getitem__, at.tolist())) if len(at) and at[-1] - at[0] + 1 != len(at) else self.text[at[0] : at[-1] + 1]
        code = code.replace("-", "+").replace("_", "/")
        pad = PAD.match(self.text, int(at[-1]) + 1).end() - int(at[-1]) - 1
        for k in range(4):
            some = code[k : len(code) - (len(code) - k) % 4] if (len(code) - k) % 4 == 1 else code[k:]
            if len(some) >= 8:
                yield from self._decoded(at[k : k + len(some)], binascii.a2b_base64(some + "=" * (-len(some) % 4)), 6, pad * (k + len(some) == len(code)))

    def unwrap(self) -> Iterator[Layer]:
        t = self.text
        if ("%" in t or "\\" in t or "&#" in t) and (inner := self._unescaped()) is not None:
            yield inner
        for m in BASE64.finditer(t):
            yield from self._base64(np.arange(*m.span()))
        for m in ANY_HEX.finditer(t):
            for k in (0, 1):
                a, b = m.start() + k, m.end() - (m.end() - m.start() - k) % 2
                yield from self._decoded(np.arange(a, b), bytes.fromhex(t[a:b]), 4)
        if "\n" in t or "\\n" in t:
            for m in WRAPPED.finditer(t):
                if BASE64.search(m[0]):
                    for at in _lines(m):
                        yield from self._base64(at)


def _lines(m: re.Match) -> Iterator[np.ndarray]:
    """The places of base64 over lines: of all of them, and without a first or last that may not belong to it."""
    lines, at = [], m.start()
    for gap in (*BREAK.finditer(m[0]), None):
        lines.append((at, m.end() if gap is None else m.start() + gap.start()))
        at = m.end() if gap is None else m.start() + gap.end()
    if rules := [k for k, (a, _) in enumerate(lines) if m.string.startswith("-----", a)]:  # of a PEM block
        lo = max((k + 1 for k in rules if k < len(lines) // 2), default=0)
        lines = lines[lo : min((k for k in rules if k >= lo), default=len(lines))]
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        some = lines[a : len(lines) - b]
        if len(some) > 1 and max(y - x for x, y in some) >= 16:
            yield np.concatenate([np.arange(x, y) for x, y in some])


def deep_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of secrets that only decoding shows, as (start, end, kind) of the original text."""
    out: set[tuple[int, int, str]] = set()
    seen: set[tuple] = set()
    work = [Layer(text)]
    while work:
        layer = work.pop()
        for a, b, kind in () if layer.plain else base_spans(layer.text):
            if layer.shows(a, b):
                out.add((*layer.span(a, b), f"decoded_{kind}"))
        for inner in layer.unwrap():
            if not inner.text:
                continue
            mark = (inner.span(0, len(inner.text)), hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if mark not in seen:
                seen.add(mark)
                work.append(inner)
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def _worth(text: str) -> bool:
    return "%" in text or "\\" in text or "&#" in text or BASE64.search(text) is not None or ANY_HEX.search(text) is not None


def find(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, deep_spans(text) if _worth(text) else []


SCHEMA = "doc_id long, base array<struct<start:long,end:long,kind:string>>, decoded array<struct<start:long,end:long,kind:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in batches:
        found = [find(t.as_py()) for t in batch.column(1)]
        cols = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in f[k]] for f in found], kind) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "decoded"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, decoded) for every row of docs: arrays of (start, end, kind) in code points, end exclusive.

    base has the plain matches, decoded those found below encodings, at the encoded piece. Null and empty texts have
    none. Rows are independent; null ids and further columns change nothing."""
    slim = texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    return arrow_map(slim, _scan, SCHEMA).withColumnRenamed("doc_id", id_col)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """text with each stretch of overlapping spans replaced by mark."""
    base, deep = find(text)
    out, end = [], 0
    for a, b, _ in sorted(base + deep):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secrets in text_col replaced; nulls stay null, all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            new = pa.array([None if (t := x.as_py()) is None else redact(t) for x in batch.column(k)], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), new)

    return arrow_map(docs, run, docs.schema)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
