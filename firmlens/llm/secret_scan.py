"""Secrets in texts, also below nested encodings.

Three base kinds follow fixed patterns, leftmost and without overlap: assign (a word such as
password or token, a sign, and a value of 12 or more characters), access (key ids of 18 or
more) and hex (runs of 16 or more). Further spans come from decoded layers. A line of the text
is the first layer; the worklist takes a layer, decodes all its percent escapes, all its
character escapes, all its base64 runs, or all base64 runs that hold compressed bytes, each
where it stands, and puts every result that the line has not had before on the list, until
nothing new comes. A layer is known by its digest, so an archive that holds itself ends too.
Each layer is scanned like the text; every character of a layer remembers the stretch of the
text that it was made from, and a match is reported with that stretch and the way to it.

No pattern can match across a line feed of its own layer, so lines can be decoded apart and
memory goes with the longest line. The layers of one line may add up to ``MOST_DECODED``
characters, a bound against archives made to burst; a line beyond it is reported with the
kind ``unresolved`` over its whole length, after all that was decoded up to there.

Places count code points from 0, the end is exclusive. A null text is empty. Rows are kept as
they are, with repeated or null ids; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ["assign", "access", "hex"]
# Fixed values of the base kinds. Runs of one class of characters carry their least length;
# an assignment with a short value must match first and fail then, as it hides what it covers.
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
LEAST_VALUE = 12

MOST_DECODED = 1 << 26
LEAST_BASE64 = 16

_PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+"
    r"|&\#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
)
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}={{0,2}}")
_CODED = re.compile(rf"%[0-9A-Fa-f]{{2}}|\\[uUx]|&\#|[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}")

Span = tuple[str, int, int, str]  # kind, start, end, way


def _matches(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _ASSIGN.finditer(text):
        if m.end() - m.start(1) >= LEAST_VALUE:
            yield ("assign", *m.span())
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield (kind, *m.span())


# A decoder gives for a match its characters, each with its stretch of the match, or None.
Piece = list[tuple[str, int, int]]


def _text_of(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\t\n\r" for c in text) else None


def _spread(raw: bytes, places: list[tuple[int, int]]) -> Piece | None:
    """Characters of UTF-8 bytes, each with the places of its bytes; Latin-1 where it is no UTF-8."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return [(chr(b), *place) for b, place in zip(raw, places, strict=True)]
    out, at = [], 0
    for c in text:
        size = len(c.encode())
        out.append((c, places[at][0], places[at + size - 1][1]))
        at += size
    return out


def _percent(match: str) -> Piece | None:
    return _spread(unquote_to_bytes(match), [(i, i + 3) for i in range(0, len(match), 3)])


def _escape(match: str) -> Piece | None:
    if match.startswith("\\x"):
        return _spread(bytes.fromhex(match.replace("\\x", "")), [(i, i + 4) for i in range(0, len(match), 4)])
    if match.startswith("&"):
        text = html.unescape(match)
        return [(text, 0, len(match))] if len(text) == 1 else None
    if match.startswith(("\\u{", "\\U")):
        code = int(match.strip("\\uU{}"), 16)
        return [(chr(code), 0, len(match))] if code < 0xD800 or 0xDFFF < code < 0x110000 else None
    units = [(int(match[i + 2 : i + 6], 16), i, i + 6) for i in range(0, len(match), 6)]
    out: Piece = []
    while units:
        code, start, end = units.pop(0)
        if 0xD800 <= code < 0xDC00 and units and 0xDC00 <= units[0][0] < 0xE000:
            low, _, end = units.pop(0)
            code = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00
        # A surrogate without its other half stands for no character.
        out.append((chr(code) if not 0xD800 <= code < 0xE000 else "�", start, end))
    return out


def _bytes_of(match: str) -> bytes | None:
    plain = match.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4))
    except binascii.Error:
        return None


def _base64(match: str) -> Piece | None:
    raw = _bytes_of(match)
    if raw is None or _text_of(raw) is None:
        return None
    size = len(match)
    return _spread(raw, [(i // 3 * 4 + i % 3, min(i // 3 * 4 + i % 3 + 2, size)) for i in range(len(raw))])


def _reader(raw: bytes):
    """A decompressor for bytes that begin like a compressed stream."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


class _TooLarge(Exception):
    pass


def _unpacked(raw: bytes, most: int) -> str | None:
    """The text in compressed bytes, through any number of streams within streams."""
    seen = set()
    while (reader := _reader(raw)) is not None:
        digest = hashlib.sha256(raw).digest()
        if digest in seen:
            return None
        seen.add(digest)
        out, size = [], 0
        try:
            for at in range(0, len(raw), 1024):  # small steps, so that a bomb is seen early
                out.append(reader.decompress(raw[at : at + 1024]))
                size += len(out[-1])
                if size > most:
                    raise _TooLarge
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        except Exception as error:  # zstandard's own error, without importing it for every text
            if type(error).__name__ != "ZstdError":
                raise
            break
        raw = b"".join(out)
    else:
        return _text_of(raw)
    # Streams that end early or are followed by other bytes: what could be read counts.
    return _text_of(b"".join(out)) if out and size else None


def _compressed(match: str, most: int) -> Piece | None:
    raw = _bytes_of(match)
    text = _unpacked(raw, most) if raw and _reader(raw) is not None else None
    return [(c, 0, len(match)) for c in text] if text else None


_DECODERS = [("url", _PERCENT, _percent), ("unicode", _ESCAPE, _escape), ("base64", _BASE64, _base64), ("compressed", _BASE64, _compressed)]


class _Layer:
    """A text whose characters know where they come from: ``starts`` and ``ends`` in the line."""

    __slots__ = ("ends", "starts", "text", "way")

    def __init__(self, text: str, starts, ends, way: tuple[str, ...]):
        self.text, self.starts, self.ends, self.way = text, starts, ends, way

    def decoded(self, way: str, pattern: re.Pattern, decoder, most: int) -> _Layer | None:
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            piece = decoder(m[0], most) if decoder is _compressed else decoder(m[0])
            if piece is None:
                continue
            a, b = m.span()
            parts.append(self.text[at:a])
            starts += (self.starts[at:a], [self.starts[a + s] for _, s, _ in piece])
            ends += (self.ends[at:a], [self.ends[a + e - 1] for _, _, e in piece])
            parts += (c for c, _, _ in piece)
            most -= len(piece)
            if most < 0:
                raise _TooLarge
            at = b
        if not parts:
            return None
        parts.append(self.text[at:])
        starts.append(self.starts[at:])
        ends.append(self.ends[at:])
        flat = chain.from_iterable
        return _Layer("".join(parts), list(flat(starts)), list(flat(ends)), (*self.way, way))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def scan_line(line: str, most: int = MOST_DECODED) -> list[Span]:
    """Spans that show only in decoded layers of a line, and those of the line itself."""
    found = {span: "" for span in _matches(line)}
    if _CODED.search(line) is None:
        return [(*span, way) for span, way in found.items()]
    work = [_Layer(line, range(len(line)), range(1, len(line) + 1), ())]
    known = {_digest(line)}
    left = most
    while work:
        layer = work.pop(0)
        for way, pattern, decoder in _DECODERS:
            try:
                child = layer.decoded(way, pattern, decoder, left)
            except _TooLarge:
                found.setdefault(("unresolved", 0, len(line)), way)
                continue
            if child is None or (digest := _digest(child.text)) in known:
                continue
            known.add(digest)
            left -= len(child.text)
            if left < 0:
                found.setdefault(("unresolved", 0, len(line)), way)
                return [(*span, way) for span, way in found.items()]
            for kind, a, b in _matches(child.text):
                start, end = min(child.starts[a:b]), max(child.ends[a:b])
                found.setdefault((kind, start, end), ">".join(child.way))
            work.append(child)
    return [(*span, way) for span, way in found.items()]


def scan_text(text: str, most: int = MOST_DECODED) -> list[Span]:
    """(kind, start, end, way) in order of start, kind, end; the way of a base span is empty."""
    if _CODED.search(text) is None:
        out = [(*span, "") for span in _matches(text)]
    else:
        out, at = [], 0
        for line in text.split("\n"):
            out += [(kind, a + at, b + at, way) for kind, a, b, way in scan_line(line, most)]
            at += len(line) + 1
    order = {kind: place for place, kind in enumerate([*KINDS, "unresolved"])}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("way", pa.string())]))


def find_secrets(docs: DataFrame, most_decoded: int = MOST_DECODED) -> DataFrame:
    """``doc_id`` and ``secrets``, a list of (kind, start, end, way); no shuffle."""

    def run(batches):
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "way"), s, strict=True)) for s in scan_text(text or "", most_decoded)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "secrets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, secrets array<struct<kind:string,start:long,end:long,way:string>>"
    )
