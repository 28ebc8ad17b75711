"""Secret scans through nested encodings.

A text is scanned, then unwrapped: percent escapes, Unicode and byte escapes, base64 runs at all alignments and over
line ends, and compressed data inside base64 or escapes. Of decoded bytes every stretch of text is a layer. Every unwrapped layer joins a worklist, is scanned and unwrapped in turn, until no layer gives a
new one; a layer seen before at the same place of the text is not visited again. Each layer carries a map from its
characters to those of the text, so a finding is reported at the place of the text it comes from.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from exposura.llm.text_kernel import released, slices, word_spans

# Kinds of secrets in their order, with the pattern and the rule for the length of each.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 12, 18

_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+")
_BASE64_LEAST = 16
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{_BASE64_LEAST},}}(?:\r?\n[A-Za-z0-9+/_-]+)*={{0,2}}")  # lines of a wrapped run together
_MULTIBYTE = (
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|"
    rb"\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_UTF8 = re.compile(rb"(?:[\x00-\x7f]|" + _MULTIBYTE + rb")+")
# Stretches of text in decoded bytes; no secret and no layer is shorter.
_STRETCH = re.compile(rb"(?:[\t\n\r\x1b\x20-\x7e]|" + _MULTIBYTE + rb"){16,}")
# Escaped bytes may stand between bytes written as they are.
_PERCENT_BYTES = re.compile(r"[!-~]+")
_ESCAPED_BYTES = re.compile(r"[ -~]+")
_UNITS = {"%": re.compile(r"%([0-9A-Fa-f]{2})|[!-~]"), "\\x": re.compile(r"\\x([0-9A-Fa-f]{2})|\\[nrt\\'\"]|[ -~]")}
_SIMPLE = {"\\n": "\n", "\\r": "\r", "\\t": "\t"}
# Compressed data is read in chunks. What it opens to is looked at in pieces that overlap, so that neither its size nor
# that of the layers inside bounds anything; only an encoded layer longer than the overlap that lies over the border
# of two pieces is seen in two parts.
_CHUNK, _PIECE, _OVERLAP = 1 << 16, 1 << 21, 1 << 17
# Shorter data is searched by patterns, longer data as an array.
_SHORT = 1 << 10

_NO_BASE64 = np.ones(256, bool)
_NO_BASE64[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = False
_NO_HEX = np.ones(256, bool)
_NO_HEX[[*b"0123456789abcdef"]] = False

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """Secrets that stand in a text as it is: leftmost and non-overlapping for each kind."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    found = []
    if any(hint in raw for hint in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A text with the first and last-plus-one place in the scanned text of each of its characters."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def key(self) -> tuple[bytes, int, int]:
        """What the layer is and where it stands; equal blobs at two places are two layers."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return digest, *(self.place(0, len(self.text)) if self.text else (0, 0))


_PLAIN = np.zeros(256, bool)
_PLAIN[[*b"\t\n\r\x1b", *range(0x20, 0x7F)]] = True
# Bytes that stand in no text become 0, others 1; no stretch is without a run of 16 of these.
_COULD_BE_TEXT = bytes(b >= 0x80 or bool(_PLAIN[b]) for b in range(256))
_SIXTEEN = b"\1" * 16


def _stretches(data: bytes):
    """The matches of ``_STRETCH``, looked for only where a run of bytes could be text."""
    if _SIXTEEN not in data.translate(_COULD_BE_TEXT):
        return
    if len(data) < _SHORT:
        yield from _STRETCH.finditer(data)
        return
    raw = np.frombuffer(data, np.uint8)
    padded = np.r_[raw, np.zeros(3, np.uint8)]
    follows = (padded & 0xC0) == 0x80
    fits = _PLAIN[raw]
    after = np.ones(len(raw), bool)
    for k, least in ((1, 0xC2), (2, 0xE0), (3, 0xF0)):  # bytes behind the first of a character
        after &= follows[k:k + len(raw)]
        whole = np.flatnonzero(after & (raw >= least) & (raw < (0xE0, 0xF0, 0xF5)[k - 1]))
        for j in range(k + 1):
            fits[whole + j] = True
    edges = np.flatnonzero(np.diff(np.r_[False, fits, False]))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if end - start >= 16:
            yield from _STRETCH.finditer(data, start, end)


def _replaced(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The whole layer with every match decoded; None where nothing is decoded."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    for match in pattern.finditer(layer.text):
        pieces = decode(match.group())
        if pieces is None:
            continue
        changed = True
        a, b = match.span()
        parts.append(layer.text[at:a])
        starts.append(layer.starts[at:a])
        ends.append(layer.ends[at:a])
        for text, first, last in pieces:  # places of each character in the run
            parts.append(text)
            starts.append(layer.starts[a + first])
            ends.append(layer.ends[a + last - 1])
        at = b
    if not changed:
        return None
    parts.append(layer.text[at:])
    return _Layer("".join(parts), np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]))


def _widths(text: str) -> np.ndarray:
    return np.ones(len(text), int) if text.isascii() else np.array([len(c.encode()) for c in text])


def _escaped_bytes(run: str, data: bytes, unit: int):
    """Pieces ``(text, first and last-plus-one place of each character)``; bytes that are no text stay as they are."""
    pieces, at = [], 0
    for match in _UTF8.finditer(data):
        text = match.group().decode()
        kept = np.arange(at * unit, match.start() * unit)
        last = match.start() + np.cumsum(_widths(text))
        pieces += [(run[at * unit:match.start() * unit], kept, kept + 1), (text, (last - _widths(text)) * unit, last * unit)]
        at = match.end()
    kept = np.arange(at * unit, len(run))
    return [*pieces, (run[at * unit:], kept, kept + 1)] if pieces else None


def _percent(run: str):
    return _escaped_bytes(run, bytes.fromhex(run.replace("%", "")), 3)


def _escape(run: str):
    if run.startswith("\\x"):
        return _escaped_bytes(run, bytes.fromhex(run.replace("\\x", "")), 4)
    try:
        if run.startswith("\\u{"):
            text = chr(int(run[3:-1], 16))
        elif run.startswith("\\U"):
            text = chr(int(run[2:], 16))
        else:
            text = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
    except (ValueError, OverflowError):
        return None
    return [(text, np.zeros(len(text), int), np.full(len(text), len(run)))]


def _inflated(data: memoryview, start: int):
    """Blocks of what the gzip or zlib stream at ``start`` opens to; returns its end, or None where it is broken."""
    opener, at, rest = zlib.decompressobj(wbits=47), start, b""
    while not opener.eof:
        fed = rest or data[at:at + _CHUNK]
        at += 0 if rest else len(fed)
        try:
            block = opener.decompress(fed, 16 * _CHUNK)
        except zlib.error:
            return None
        if not block and not len(fed):
            return None
        rest = opener.unconsumed_tail
        if block:
            yield block
    return at - len(opener.unused_data)


def _end(data: memoryview, start: int) -> int | None:
    blocks = _inflated(data, start)
    while True:
        try:
            next(blocks)
        except StopIteration as done:
            return done.value


def _zlib_header(first: int) -> bytes:
    seconds = b"".join(re.escape(bytes([b])) for b in range(256) if (first * 256 + b) % 31 == 0)
    return re.escape(bytes([first])) + b"[" + seconds + b"]"


_HEADER = re.compile(b"|".join([rb"\x1f\x8b", *[_zlib_header(first) for first in range(0x08, 0x80, 0x10)]]), re.DOTALL)


def _headers(data: bytes) -> list[int]:
    """Where the first two bytes could begin gzip or zlib data."""
    if len(data) < _SHORT:
        found, match = [], _HEADER.search(data)
        while match:
            found.append(match.start())
            match = _HEADER.search(data, found[-1] + 1)
        return found
    raw = np.frombuffer(data, np.uint8)
    pairs = raw[:-1].astype(np.uint16) << 8 | raw[1:]
    zlib_like = (raw[:-1] & 0x8F == 8) & (pairs % 31 == 0)
    return np.flatnonzero(zlib_like | (pairs == 0x1F8B)).tolist()


def _streams(data: memoryview, start: int) -> list[tuple[int, int]]:
    """Starts and ends of the gzip members, or of the zlib stream, at ``start``; empty where it is neither."""
    found, at = [], start
    while at + 2 < len(data):
        first, second = data[at], data[at + 1]
        if (first, second) != (0x1F, 0x8B) and (found or first & 15 != 8 or (first * 256 + second) % 31):
            break
        if (end := _end(data, at)) is None:
            break
        found.append((at, end))
        at = end
    return found


def _pieces(data: memoryview, streams: list[tuple[int, int]]):
    held = bytearray()
    for start, _ in streams:
        for block in _inflated(data, start):
            held += block
            while len(held) >= _PIECE:
                yield bytes(held[:_PIECE])
                del held[:_PIECE - _OVERLAP]
    if held:
        yield bytes(held)


def _contents(data: bytes, place: tuple[int, int] | None = None, seen: set | None = None):
    """What compressed data that starts anywhere in ``data`` opens to, through all its layers, with its place in ``data``."""
    seen, view = set() if seen is None else seen, memoryview(data)
    for start in _headers(data):
        streams = _streams(view, start)
        if not streams:
            continue
        own = place or (start, streams[-1][1])
        for piece in _pieces(view, streams):
            key = hashlib.blake2b(piece, digest_size=16).digest(), own
            if key not in seen:
                seen.add(key)
                yield piece, own
                yield from _contents(piece, own, seen)


def _content_layers(layer: _Layer, data: bytes, starts: np.ndarray, ends: np.ndarray):
    """Layers of the compressed data in ``data``, whose bytes stand from ``starts`` to ``ends`` of the layer."""
    for content, (a, b) in _contents(data):
        first, last = layer.place(starts[a], ends[b - 1])
        for match in _stretches(content):
            text = match.group().decode()
            yield _Layer(text, np.broadcast_to(first, len(text)), np.broadcast_to(last, len(text)))


def _base64_layers(layer: _Layer):
    for match in _BASE64.finditer(layer.text):
        letters = None  # where the letters of the run stand, once something is found in it
        run = re.sub(r"[\r\n=]", "", match.group()).replace("-", "+").replace("_", "/")
        for shift in range(4):  # a blob may stand behind other letters of the run
            own = run[shift:len(run) - ((len(run) - shift) % 4 == 1)]
            data = base64.b64decode(own + "=" * (-len(own) % 4))
            stretches, headers = list(_stretches(data)), _headers(data)
            if not stretches and not headers:
                continue
            if letters is None:
                letters = match.start() + np.flatnonzero(~np.isin(np.frombuffer(match.group().encode(), np.uint8), tuple(b"\r\n=")))
            for stretch in stretches:
                text = stretch.group().decode()
                last = stretch.start() + np.cumsum(_widths(text))
                first_letter, last_letter = (last - _widths(text)) * 4 // 3, -(-last * 4 // 3)
                yield _Layer(text, layer.starts[letters[shift + first_letter]], layer.ends[letters[shift + last_letter - 1]])
            if not headers:
                continue
            at = np.arange(len(data))
            yield from _content_layers(layer, data, letters[shift + at * 4 // 3], letters[shift + -(-(at + 1) * 4 // 3) - 1] + 1)


def _escaped_contents(layer: _Layer):
    for sign, runs in (("%", _PERCENT_BYTES), ("\\x", _ESCAPED_BYTES)):
        for match in runs.finditer(layer.text) if sign in layer.text else ():
            run = match.group()
            if sign not in run:
                continue
            if sign == "%":
                data = unquote_to_bytes(run) if _PERCENT.search(run) else run.encode()
            else:
                data = b"".join(map(_byte, _UNITS[sign].finditer(run)))
            if not _headers(data):
                continue
            ends = match.start() + np.array([m.end() for m in _UNITS[sign].finditer(run)])
            yield from _content_layers(layer, data, np.r_[match.start(), ends[:-1]], ends)


def _byte(unit: re.Match) -> bytes:
    if unit[1]:
        return bytes.fromhex(unit[1])
    return _SIMPLE.get(unit[0], unit[0][-1:]).encode()


def _unwrapped(layer: _Layer):
    """Layers inside a layer, one at a time."""
    yield from _base64_layers(layer)
    yield from _escaped_contents(layer)
    for sign, pattern, decode in (("%", _PERCENT, _percent), ("\\", _ESCAPE, _escape)):
        if sign in layer.text and (inner := _replaced(layer, pattern, decode)) is not None:
            yield inner


def find_secrets(text: str, encoded: bool = True, plain: bool = True) -> tuple[list[Span], list[Span], int]:
    """``(spans in the text as it is, spans of all layers, layers opened)``, both sorted and distinct.

    ``encoded`` and ``plain`` say whether the text may hold an encoded layer, and a secret as it is.
    """
    base = scan(text) if plain else []
    if not encoded:
        return base, base, 0
    places = np.arange(len(text) + 1)
    whole = _Layer(text, places[:-1], places[1:])
    found, seen, opened, work = set(base), {whole.key()}, 0, [_unwrapped(whole)]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if inner.key() in seen:
            continue
        seen.add(inner.key())
        opened += 1
        for start, kind, end in scan(inner.text):
            first, last = inner.place(start, end)
            found.add((first, kind, last))
        work.append(_unwrapped(inner))
    return base, sorted(found), opened


def _suspects(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: may it hold a secret as it is, and may it hold an encoded layer."""
    plain, coded = np.zeros(len(column), bool), np.zeros(len(column), bool)
    for first, last, data, offsets in slices(column):
        for gap, least, flags in ((_NO_HEX, 16, plain), (_NO_BASE64, _BASE64_LEAST, coded)):
            starts, ends, _ = word_spans(data, offsets, gap)
            flags[first + np.searchsorted(offsets, starts[ends - starts >= least], "right") - 1] = True
        at = np.flatnonzero((data == 37) | (data == 92))
        coded[first + np.searchsorted(offsets, at, "right") - 1] = True
        raw = data.tobytes().lower()
        for hint in (*_ASSIGN_HINTS, b"akia"):
            at = raw.find(hint)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                plain[first + row] = True
                at = raw.find(hint, int(offsets[row + 1]))
    return plain, coded


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def _span_lists(lists: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in lists], kind)


def _each(column: pa.Array):
    """Spans of each text of a batch; texts that cannot hold anything are not looked at one by one."""
    plain, coded = _suspects(column)
    for at in range(len(column)):
        if plain[at] or coded[at]:
            text = column[at].as_py() or ""
            yield text, *find_secrets(text, bool(coded[at]), bool(plain[at]))
        else:
            yield None, [], [], 0


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_secrets`` and ``secrets`` (lists of kind, start, end) and ``n_layers``.

    Places are code points of the text, the end exclusive; lists are sorted by start, then kind. ``secrets`` holds
    all of ``base_secrets`` and what the layers add. A null or empty text has none. Other columns and repeated
    rows stay; columns called like the new ones are replaced.
    """
    added = ["base_secrets", "secrets", "n_layers"]
    kept = [c for c in docs.columns if c not in added]
    place = kept.index(text)

    def work(batches):
        for batch in batches:
            _, base, found, layers = zip(*_each(batch.column(place))) if batch.num_rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _span_lists(base), _span_lists(found), pa.array(layers, pa.int64())], [*kept, *added]
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    new = T.StructType.fromDDL(f"base_secrets {_SPANS}, secrets {_SPANS}, n_layers long")
    return rows.mapInArrow(released(work), T.StructType([*rows.schema.fields, *new.fields]))


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``secrets`` replaced by ``mark`` (overlapping spans by one). Nulls stay null."""
    place = docs.columns.index(text)

    def masked(original, spans):
        parts, at = [], 0
        for start, _, end in spans:
            if start >= at:
                parts += [original[at:start], mark]
            at = max(at, end)
        return "".join([*parts, original[at:]])

    def work(batches):
        for batch in batches:
            column = batch.column(place)
            texts = [masked(t, found) if found else None for t, _, found, _ in _each(column)]
            changed = pa.array(texts, column.type)
            columns = list(batch.columns)
            columns[place] = pa.compute.coalesce(changed, column)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(released(work), docs.schema)


def span_text(spans: str):
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
