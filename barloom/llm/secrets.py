"""Operator 5: secret scan with a recursive decoding worklist.

The base kinds are found in the text itself.  Then a worklist unwraps layers:
percent escapes, ``\\uXXXX`` / ``\\u{X}`` / ``\\UXXXXXXXX`` / ``\\xXX`` escapes and Unicode's wide, circled and
mathematical letters over the whole layer; and each base64 run (standard or URL alphabet),
within a line and over line breaks, from each of its first four characters, as what stands
before it may belong to the run.  Of decoded bytes, stretches of ``LEAST_TEXT`` characters
of UTF-8 or of UTF-16's ASCII are layers; gzip and zlib streams in them are inflated, all
members of them, and so are those in the bytes that percent, ``\\xXX`` or ``\\u00XX`` escapes
stand for.  Every new layer is scanned again and unwrapped again until nothing new
appears; a layer whose text, or a compressed one whose bytes, were met before ends its
branch, so encodings that lead back to themselves stop.  Each character of a layer knows
the code points of the document that it came from, so found spans are spans of the
document; what comes out of compressed bytes maps to the whole of the run that they were
read from.

Compressed bytes are first read to their end, which gives their place and a digest of what
they inflate to, and then scanned; so neither depends on the size.  Inflated bytes beyond
``HELD_BYTES`` are never held: they are inflated again and go through the same scan in
windows, which overlap by ``OVERLAP_BYTES`` or, if longer, by the base64 or escaped run that goes on
over the window's end, up to ``HELD_BYTES``.  Compressed bytes among them are read on over
a window's end.  Memory is bounded, and time follows the size of what is inflated.  (What windows can't hold
still differs from a held scan: of a base64 or escaped run over ``HELD_BYTES`` inside such a stream, or one over
``OVERLAP_BYTES`` with blanks or other punctuation in it, text is read throughout, but a compressed stream in it
only as far as one window holds it; and a window may begin within a match of a shorter key word.)

Defined cases: a null text is empty; each row is scanned by itself, so repeated rows and
ids agree; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.shared import columns, in_batches

# The kinds of secrets, in the order in which spans are listed.
KINDS = ("assign", "access", "hex")
HELD_BYTES = 1 << 22
"""Inflated bytes up to which a layer is held as a whole."""
WINDOW_BYTES, OVERLAP_BYTES = 1 << 20, 1 << 16
LEAST_TEXT = 12
"""Characters of a stretch of text in decoded bytes; no secret is shorter."""

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{0*[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_STYLED = re.compile("[！-～Ⓐ-ⓩ\U0001d400-\U0001d7ff]+")  # wide, circled and mathematical forms of ASCII
_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]+)\}|\\U([0-9A-Fa-f]{8})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
_PERCENT_BYTES = re.compile(r"[A-Za-z0-9_.~/+-]*%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])*")
_PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|(.)")
_ESCAPE_BYTES = re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[abfnrtv0\\'"]|[\x20-\x5b\x5d-\x7e])+""")
_ESCAPE_BYTE = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|(\\?.)")
_SHORT = {"\\" + k: v for k, v in zip("abfnrtv0", b"\x07\x08\x0c\x0a\x0d\x09\x0b\x00", strict=True)}
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_UTF8 = re.compile(rb"(?:[\x09\x0a\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}" % LEAST_TEXT)
_UTF16 = re.compile(rb"(?:[\x09\x0a\x0d\x20-\x7e]\x00){%d,}|(?:\x00[\x09\x0a\x0d\x20-\x7e]){%d,}" % (LEAST_TEXT, LEAST_TEXT))
_SPACES = re.compile(rb"\x20{65,}")
_OPEN_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.~%\\\r\n"
"""Bytes of base64 over lines and of escapes."""

Source = Callable[[], Iterator[bytes]]
"""Gives the same bytes, a piece at a time, whenever it is called."""
Span = tuple[int, int, int]
"""Start, kind (index into KINDS), end: sorts as the contract lists."""


def scan(text: str) -> list[Span]:
    """The base spans of one layer."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text, and for each character its first and past-last code point in the document."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray) -> None:
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of ``pattern`` decoded: ``decode`` gives text and, per character, its piece of the match."""
    text, start, end, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        new, first, last = got
        text += [layer.text[at : m.start()], new]
        start += [layer.start[at : m.start()], layer.start[m.start() + first]]
        end += [layer.end[at : m.start()], layer.end[m.start() + last - 1]]
        at = m.end()
    if not text:
        return None
    text.append(layer.text[at:])
    start.append(layer.start[at:])
    end.append(layer.end[at:])
    return Layer("".join(text), np.concatenate(start), np.concatenate(end))


def _from_percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        new = raw.decode()
    except UnicodeDecodeError:
        new = raw.decode("latin-1")
        first = 3 * np.arange(len(raw))
        return new, first, first + 3
    size = np.array([len(c.encode()) for c in new])
    last = 3 * np.cumsum(size)
    return new, last - 3 * size, last


def _from_escapes(run: str):
    units = [(int(m[1] or m[2] or m[3] or m[4], 16), m.start(), m.end()) for m in _UNIT.finditer(run)]
    text, first, last, k = [], [], [], 0
    while k < len(units):
        code, a, b = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code, b, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, units[k + 1][2], k + 1
        text.append("�" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code))
        first.append(a)
        last.append(b)
        k += 1
    return "".join(text), np.array(first), np.array(last)


def _from_styled(run: str):
    new = [unicodedata.normalize("NFKC", c) for c in run]
    size = np.array([len(c) for c in new])
    first = np.repeat(np.arange(len(run)), size)
    return "".join(new), first, first + 1


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0


def _inflating(pieces: Iterator[bytes], used: list[int]) -> Iterator[bytes]:
    """The bytes in gzip or zlib streams that follow each other, a piece at a time.

    ``used`` becomes how many bytes they took, if the last stream came to its end, and else stays empty.
    """
    z, taken, ended, made = zlib.decompressobj(47), 0, False, False
    pad, rest = 0, b""
    for piece in pieces:
        data, rest = rest + piece if rest else piece, b""
        while data:
            if ended:  # zeros may pad members; anything else is not theirs
                rest = data.lstrip(b"\0")
                pad += len(data) - len(rest)
                if len(rest) < 3:  # a member's header may go on in the next piece
                    break
                if not _packed(rest):
                    used.append(taken)
                    return
                z, ended = zlib.decompressobj(47), False
                taken, pad = taken + pad, 0
                data, rest = rest, b""
            try:
                out = z.decompress(data, WINDOW_BYTES)
            except zlib.error:
                if made and z.unused_data == b"" and taken:
                    used.append(taken)
                return
            if out:
                made = True
                yield out
            while len(out) == WINDOW_BYTES and not z.eof and not z.unconsumed_tail:  # the rest of a match may wait for room
                out = z.decompress(b"", WINDOW_BYTES)
                if out:
                    yield out
            if z.eof:
                ended = True
                taken += len(data) - len(z.unused_data)
                data = z.unused_data
            else:
                taken += len(data) - len(z.unconsumed_tail)
                data = z.unconsumed_tail
                if not data and not out:
                    break
    if ended:
        used.append(taken)


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The stretches of text in bytes, and the first and past-last byte of each character."""
    for m in _UTF8.finditer(raw):
        piece = m[0]
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            text = piece.decode("latin-1")  # overlong forms: its ASCII is right
        if len(text) == len(piece):
            first = np.arange(m.start(), m.end())
            yield text, first, first + 1
        else:
            last = m.start() + np.cumsum([len(c.encode()) for c in text])
            yield text, np.concatenate([[m.start()], last[:-1]]), last
    if b"\0" in raw:
        for m in _UTF16.finditer(raw):
            text = m[0].replace(b"\0", b"").decode()
            first = m.start() + 2 * np.arange(len(text))
            yield text, first, first + 2


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces of at least ``WINDOW_BYTES``."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= WINDOW_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _from(pieces: Iterator[bytes], at: int) -> Iterator[bytes]:
    """The bytes from place ``at`` on; nothing is read before they are asked for."""
    for piece in pieces:
        if at < len(piece):
            yield piece[at:]
        at = max(0, at - len(piece))


def _spread(text: str, span: tuple[int, int]) -> Layer:
    """A layer whose every character maps to the whole span."""
    return Layer(text, np.broadcast_to(np.int64(span[0]), len(text)), np.broadcast_to(np.int64(span[1]), len(text)))


def _begins_packed(lines: list[str]) -> bool:
    """Whether base64 lines begin with bytes that inflate."""
    head = "".join(lines).replace("-", "+").replace("_", "/")
    if not _packed(base64.b64decode(head[:4]) if len(head) > 3 else b""):
        return False
    try:
        zlib.decompressobj(47).decompress(base64.b64decode(head[: len(head) & -4]), 1 << 16)
    except zlib.error:
        return False
    return True


def _wrapped(text: str) -> list[np.ndarray]:
    """Where the characters of each base64 run over line breaks are.

    Of lines that follow each other these are tried: all; all from one on that begins with a
    gzip or zlib header; those of equal length, with and without a shorter one after them, and
    with what stands before them.
    """
    out = []
    for m in _WRAPPED.finditer(text):
        at = [(p.start(), p.end()) for p in _PIECE.finditer(text, m.start(), m.end())]
        n = [b - a for a, b in at]
        tried, k = {(0, len(n))} | {(i, len(n)) for i in range(len(n) - 1) if _begins_packed([text[a:b] for a, b in at[i : i + 4]])}, 0
        while k < len(n):
            to = k + 1
            while to < len(n) and n[to] == n[k]:
                to += 1
            tail = to + (to < len(n) and n[to] < n[k])
            tried |= {(i, j) for i in (max(k - 1, 0), k) for j in (to, tail) if j - i > 1}
            k = to
        out += [np.concatenate([np.arange(*p) for p in at[i:j]]) for i, j in sorted(tried, key=lambda x: x[0] - x[1]) if sum(n[i:j]) >= 16]
    return out


class Scan:
    """The worklist over one document's layers; ``spans`` holds what was found."""

    def __init__(self, text: str, base: list[Span]) -> None:
        self.spans, self.seen, self.met = set(base), set(), set()
        self.todo: deque[Layer] = deque([Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))])
        self.inside: list[tuple[bytes, tuple[int, int]]] = []
        self.text = text

    def run(self) -> list[Span]:
        while self.todo or self.inside:
            if self.inside:
                self.inner(*self.inside.pop())
                continue
            layer = self.todo.popleft()
            key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.start[0]) if len(layer.start) else 0
            if key in self.seen:
                continue
            self.seen.add(key)
            if layer.text is not self.text:
                for a, kind, b in scan(layer.text):
                    start, end = layer.span(a, b)
                    self.spans.add((start, kind, end))
            self.unwrap(layer)
        return sorted(self.spans)

    def unwrap(self, layer: Layer) -> None:
        whole: list[tuple[int, int]] = []
        if "\n" in layer.text:
            for where in _wrapped(layer.text):
                if any(a <= where[0] and where[-1] < b for a, b in whole):
                    continue
                lines = Layer("".join(map(layer.text.__getitem__, where.tolist())), layer.start[where], layer.end[where])
                if used := self.base64(lines, 0, len(where), True):
                    whole.append((int(where[0]), int(where[min(used, len(where)) - 1]) + 1))
        for mark, run, unit in (("%", _PERCENT_BYTES, _PERCENT_BYTE), ("\\", _ESCAPE_BYTES, _ESCAPE_BYTE)):
            if mark in layer.text:
                self.escaped_bytes(layer, run, unit)
        more = []
        if "%" in layer.text:
            more.append(_replaced(layer, _PERCENT, _from_percent))
        if "\\" in layer.text:
            more.append(_replaced(layer, _ESCAPE, _from_escapes))
        if not layer.text.isascii():
            more.append(_replaced(layer, _STYLED, _from_styled))
        self.todo += [x for x in more if x is not None]
        for m in _BASE64.finditer(layer.text):
            if not any(a <= m.start() and m.start() < b for a, b in whole):  # else a line of compressed bytes, which are read whole
                for k in range(4):
                    self.base64(layer, m.start() + k, m.end())

    def base64(self, layer: Layer, a: int, b: int, lines: bool = False) -> int:
        """Take the layers in the base64 run from ``a`` to ``b``; gives how many of its characters whole compressed streams took.

        Of a run over lines, what follows the compressed bytes isn't theirs.
        """
        run = layer.text[a:b].rstrip("=")
        if len(run) % 4 == 1:
            run = run[:-1]
        if len(run) < 16:
            return 0
        raw = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
        took, end = 0, 0
        for m in _PACKED.finditer(raw):
            if m.start() < end:
                continue
            used = self.packed(raw[m.start() :], lambda n, at=m.start(): layer.span(a + at * 4 // 3, min(a + -(-(at + n) * 4 // 3), b) if n and lines else b))
            if used:
                end = m.start() + used
                took = min(-(-end * 4 // 3), b - a)
        for text, first, last in _texts(raw):
            self.todo.append(Layer(text, layer.start[a + first * 4 // 3], layer.end[np.minimum(a + (last * 4 + 2) // 3, a + len(run)) - 1]))
        return took

    def escaped_bytes(self, layer: Layer, run: re.Pattern, unit: re.Pattern) -> None:
        """Take the texts in compressed bytes that are written by escapes and, where printable, as they are."""
        for m in run.finditer(layer.text):
            if "%" not in m[0] and "\\x" not in m[0] and "\\u" not in m[0]:
                continue
            units = [(int(u[1], 16) if u[1] else _SHORT.get(u[2], ord(u[2][-1])), u.start(), u.end()) for u in unit.finditer(layer.text, m.start(), m.end())]
            if run is _PERCENT_BYTES:
                units = [(0x20 if b == 0x2B and q - p == 1 else b, p, q) for b, p, q in units]
            raw, end = bytes(b for b, _, _ in units), 0
            for h in _PACKED.finditer(raw):
                if h.start() >= end:
                    used = self.packed(raw[h.start() :], lambda n, at=h.start(): layer.span(units[at][1], units[(at + n if n else len(units)) - 1][2]))  # noqa: B023
                    end = h.start() + used

    def packed(self, raw: bytes, span) -> int:
        """Take what is in compressed bytes; ``span`` tells the place of the first ``n`` of them (0: all). Gives how many they were, if they came to an end."""
        return self.inflated(lambda: iter([raw]), span) if _packed(raw) else 0

    def inflated(self, source: Source, span) -> int:
        """Like :meth:`packed`, of bytes that can be read more than once: first all of them for their end, and so their place, whatever they inflate to."""
        used: list[int] = []
        held, size, digest = [], 0, hashlib.sha256()
        for piece in _inflating(source(), used):
            size += len(piece)
            digest.update(piece)
            held.append(piece)
            if size > HELD_BYTES:
                held.clear()
        took = used[0] if used else 0
        if size:
            place = span(took)
            key = digest.digest(), place
            if key not in self.met:
                self.met.add(key)
                if size <= HELD_BYTES:
                    self.inside.append((b"".join(held), place))
                else:
                    self.stream(lambda: _inflating(source(), []), place)
        return took

    def inner(self, raw: bytes, place: tuple[int, int]) -> None:
        """Take inflated bytes that are held: the compressed ones in them, and the texts."""
        end = 0
        for m in _PACKED.finditer(raw):
            if m.start() >= end:
                end = m.start() + self.packed(memoryview(raw)[m.start() :], lambda n: place)
        self.todo += [_spread(text, place) for text, _, _ in _texts(raw)]

    def stream(self, source: Source, place: tuple[int, int]) -> None:
        """Take inflated bytes of any size in windows, like :meth:`inner`; all of them map to one place.

        Compressed bytes that go on over a window's end are read on from the source.
        """
        tail, last, raw, at, end, pieces = b"", b"", b"", 0, 0, _windows(source())
        piece = next(pieces, b"")
        while piece:
            after = next(pieces, b"")
            window = tail + _SPACES.sub(b" " * 64, piece)
            if window != last:  # a bomb repeats itself
                last = window
                self.below([_spread(text, place) for text, _, _ in _texts(window)])
            raw += piece
            ahead = at + len(raw)
            whole = max(0, len(raw) - OVERLAP_BYTES) if after else len(raw)
            for m in _PACKED.finditer(raw):
                if m.start() >= whole:
                    break
                if at + m.start() >= end:
                    rest = memoryview(raw)[m.start() :]
                    end = at + m.start() + self.below([], lambda: itertools.chain([rest], _from(source(), ahead)), place)  # noqa: B023
            at, raw = at + whole, raw[whole:]
            kept = max(len(window.rstrip(_OPEN_RUN)), len(window) - HELD_BYTES)
            tail, piece = window[min(max(0, len(window) - OVERLAP_BYTES), kept) :], after

    def below(self, layers: list[Layer], source: Source | None = None, place: tuple[int, int] = (0, 0)) -> int:
        """Scan layers and compressed bytes at once, so that none of them are kept."""
        scan = Scan("", [])
        scan.met, scan.todo = self.met, deque(layers)
        took = scan.inflated(source, lambda n: place) if source else 0
        self.spans |= set(scan.run())
        return took


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """The base spans and those of every layer below."""
    if "%" not in text and "\\" not in text and not _BASE64.search(text) and not _WRAPPED.search(text) and (text.isascii() or not _STYLED.search(text)):
        return base
    return Scan(text, base).run()


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _run(batches):
    for b in batches:
        counts, digest, spans = [], [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = scan(text)
            kinds = [k for _, k, _ in base]
            counts.append([kinds.count(k) for k in range(3)])
            digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(all_spans(text, base)))
        n = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(n[:, k]) for k in range(3)), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of each row of ``docs`` (doc_id, text): counts and digest of the base spans, and all spans."""
    return columns(docs, doc_id="long", text="string").transform(in_batches, _run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
