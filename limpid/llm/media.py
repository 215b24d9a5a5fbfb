"""Media columns: signature sniffing.

An Aho-Corasick automaton over magic bytes finds every place where a known
container may begin. A validator per format then walks the container's own
structure (chunks, blocks, segments, lengths and checksums) and either
confirms it and tells where it ends, or rejects the place. The outermost
container at the start of a value corrects its declared type; all confirmed
containers further in are carved as embedded media.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import given, named, payload, private, utf8

# Fixed values of the formats: media type by magic bytes, with how far into the container they are.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"BM": ("image/bmp", 0),
    b"II*\0": ("image/tiff", 0),
    b"MM\0*": ("image/tiff", 0),
    b"RIFF": ("riff", 0),
    b"fLaC": ("audio/flac", 0),
    b"OggS\0\x02": ("application/ogg", 0),
    b"ID3": ("audio/mpeg", 0),
    b"\xff\xfb": ("audio/mpeg", 0),
    b"\xff\xfa": ("audio/mpeg", 0),
    b"\xff\xf3": ("audio/mpeg", 0),
    b"\xff\xf2": ("audio/mpeg", 0),
    b"ftyp": ("video/mp4", 4),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
}
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
#: Kilobits a second of MPEG audio layer III by index, versions 1 and 2, and samples a second of version 1.
MP3_RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_SAMPLES = (44100, 48000, 32000)
#: Bytes of a value by TIFF field type.
TIFF_SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)


def _crc_table(poly: int, bits: int) -> list[int]:
    """Of a CRC that takes the highest bit first."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: bytes.translate table that turns the bits of each byte around.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class Walk:
    """A value, and where walks over its structure have led, so that many starts that run into one walk cost no more than one.

    A step takes a place and gives (next place, None), or (None, end) at the
    container's end, or (None, None) where the structure breaks.
    """

    def __init__(self, b: bytes):
        self.b, self.known = b, {}

    def end(self, p: int, step) -> int | None:
        known, passed = self.known.setdefault(step, {}), []
        end = None
        while p is not None:
            if p in known:
                end = known[p]
                break
            passed.append(p)
            p, end = step(self, p)
        known.update(dict.fromkeys(passed, end))
        return end

    @cached_property
    def archives(self) -> dict[int, int]:
        """Where ZIP archives begin, by their end records, and where they end; of several ends the last."""
        found, p = {}, self.b.find(b"PK\x05\x06")
        while p >= 0 and p + 22 <= len(self.b):
            size, begin, note = struct.unpack_from("<IIH", self.b, p + 12)
            at = p - size - begin
            if at >= 0 and p + 22 + note <= len(self.b) and self.b[at + begin : at + begin + 4] == b"PK\x01\x02":
                found[at] = p + 22 + note
            p = self.b.find(b"PK\x05\x06", p + 1)
        return found

    @cached_property
    def pdf_parts(self) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Where PDF headers are; and each trailer's place, what it says of its table's, and its end."""
        starts = [m.start() for m in re.finditer(rb"%PDF-", self.b)]
        ends = [(m.start(), int(m[1]), m.end()) for m in re.finditer(rb"startxref\s{1,9}([0-9]{1,18})\s{1,9}%%EOF", self.b)]
        return starts, ends


def _png_chunk(w: Walk, p: int):
    b = w.b
    if p + 12 > len(b):
        return None, None
    n, kind = struct.unpack_from(">I4s", b, p)
    end = p + 12 + n
    if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
        return None, None
    return (None, end) if kind == b"IEND" else (end, None)


def _png(w: Walk, at: int) -> int | None:
    return w.end(at + 8, _png_chunk) if w.b[at + 12 : at + 16] == b"IHDR" else None


def _gif_data(w: Walk, p: int):
    if p >= len(w.b):
        return None, None
    return (p + 1 + w.b[p], None) if w.b[p] else (None, p + 1)


def _gif_block(w: Walk, p: int):
    b = w.b
    if p >= len(b):
        return None, None
    if b[p] == 0x3B:
        return None, p + 1
    if b[p] == 0x21:
        return w.end(p + 2, _gif_data), None
    if b[p] == 0x2C and p + 10 <= len(b):
        return w.end(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0), _gif_data), None
    return None, None


def _gif(w: Walk, at: int) -> int | None:
    b = w.b
    return w.end(at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0), _gif_block) if at + 13 <= len(b) else None


def _jpeg_segment(w: Walk, p: int):
    b = w.b
    if b[p : p + 1] != b"\xff":
        return None, None
    while p + 1 < len(b) and b[p + 1] == 0xFF:  # fill bytes
        p += 1
    if p + 1 >= len(b):
        return None, None
    marker = b[p + 1]
    if marker == 0xD9:
        return None, p + 2
    if marker == 0x01 or 0xD0 <= marker <= 0xD7:  # markers without a length
        return p + 2, None
    if p + 4 > len(b) or marker in (0x00, 0xD8) or (n := struct.unpack_from(">H", b, p + 2)[0]) < 2:
        return None, None
    p += 2 + n
    if marker == 0xDA:  # entropy-coded bytes follow, up to the next marker that is no restart or stuffing
        found = SCAN_END.search(b, p)
        p = found.start() if found else None
    return p, None


SCAN_END = re.compile(rb"\xff(?=[^\x00\xd0-\xd7])")


def _jpeg(w: Walk, at: int) -> int | None:
    return w.end(at + 2, _jpeg_segment)


def _bmp(w: Walk, at: int) -> int | None:
    b = w.b
    if at + 54 > len(b):
        return None
    size, zero, data, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    row = (width * bits + 31) // 32 * 4
    return at + size if data >= 14 + header and data + row * abs(height) <= size and at + size <= len(b) else None


def _tiff(w: Walk, at: int) -> int | None:
    """The furthest byte that the directories and their strips or tiles reach."""
    b, order = w.b, "<" if w.b[at] == 0x49 else ">"
    end, p, seen = at + 8, at + 4, set()
    while True:
        if p + 4 > len(b):
            return None
        offset = struct.unpack_from(order + "I", b, p)[0]
        if not offset:
            return end if seen else None
        p = at + offset
        if offset < 8 or offset in seen or p + 2 > len(b) or not (n := struct.unpack_from(order + "H", b, p)[0]) or p + 2 + 12 * n + 4 > len(b):
            return None
        seen.add(offset)
        fields = {}
        for i in range(p + 2, p + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", b, i)
            if not 1 <= kind < len(TIFF_SIZES):
                return None
            size = TIFF_SIZES[kind] * count
            where = i + 8 if size <= 4 else at + struct.unpack_from(order + "I", b, i + 8)[0]
            if where + size > len(b):
                return None
            end = max(end, where + size if size > 4 else 0)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                fields[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, where)
        p += 2 + 12 * n
        end = max(end, p + 4)
        for begins, sizes in ((273, 279), (324, 325)):
            for x, y in zip(fields.get(begins, ()), fields.get(sizes, ()), strict=False):
                if at + x + y > len(b):
                    return None
                end = max(end, at + x + y)


def _riff(w: Walk, at: int) -> int | None:
    b = w.b
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_KINDS:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p = at + 12
    while p + 8 <= end <= len(b):
        p += 8 + (n := struct.unpack_from("<I", b, p + 4)[0]) + n % 2
    return end if p == end <= len(b) else None


def _flac_frame(b: bytes, p: int) -> int | None:
    """Samples of the frame whose header begins here, None if none does: a header is confirmed by its own checksum."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 2] >> 4 == 0 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return None
    size, rate, lead = b[p + 2] >> 4, b[p + 2] & 15, b[p + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    q = p + 5 + more
    given = (1 if size == 6 else 2 if size == 7 else 0), (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if q + sum(given) >= len(b):
        return None
    crc = 0
    for x in b[p : q + sum(given)]:
        crc = CRC8[crc ^ x]
    if crc != b[q + sum(given)]:
        return None
    if given[0]:
        return int.from_bytes(b[q : q + given[0]], "big") + 1
    return 192 if size == 1 else 576 << (size - 2) if size <= 5 else 256 << (size - 8)


def _flac(w: Walk, at: int) -> int | None:
    """Frame by frame, each up to where its checksum holds and the next frame, or nothing of the stream, begins."""
    b, p, last = w.b, at + 4, False
    if b[p : p + 4] not in (b"\x00\0\0\x22", b"\x80\0\0\x22") or p + 38 > len(b):
        return None
    least, most = int.from_bytes(b[p + 8 : p + 11], "big"), int.from_bytes(b[p + 11 : p + 14], "big")
    left = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1  # samples of the stream; 0: not known
    known = left > 0
    while not last:
        if p + 4 > len(b):
            return None
        last, n = b[p] >> 7, int.from_bytes(b[p + 1 : p + 4], "big")
        p += 4 + n
    end = None
    while (samples := _flac_frame(b, p)) is not None:
        left -= samples
        crc, found, stop = 0, None, min(len(b), p + most) if most else len(b)
        for q in range(p, stop):
            crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b[q]]
            if crc == 0 and q + 1 - p >= max(least, 8):  # the checksum at the end makes the whole 0
                goes_on = _flac_frame(b, q + 1) is not None
                if goes_on or q + 1 == len(b) or (known and left <= 0):
                    found = q + 1
                    break
                found = found or q + 1
        if found is None:
            return None
        p = end = found
        if known and left <= 0:
            break
    return end if not known or left <= 0 else None


def ogg_checksum(b: bytes) -> int:
    """The checksum of an Ogg page whose own field is zero.

    Its polynomial is zlib's, with bits taken from the other end, and nothing
    is inverted before or after: so bytes go in reversed and the sum comes out reversed.
    """
    raw = zlib.crc32(b.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(REVERSED), "big")


def _ogg_page(w: Walk, p: int) -> tuple[int, int, bytes] | None:
    """A page's end, flags and serial number, if it is whole; what costs least is looked at first.

    A stream's first page holds its identification packet and nothing else.
    """
    b, pages = w.b, w.known.setdefault(_ogg_page, {})
    if p not in pages:
        pages[p] = None
        n = b[p + 26] if b[p : p + 5] == b"OggS\0" and p + 27 <= len(b) else 0
        lacing = b[p + 27 : p + 27 + n]
        stop = p + 27 + n + sum(lacing)
        alone = n > 0 and lacing[-1] < 255 and lacing[:-1] == b"\xff" * (n - 1)
        if b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0 and stop <= len(b) and (alone or not b[p + 5] & 2):
            if ogg_checksum(b[p : p + 22] + bytes(4) + b[p + 26 : stop]) == int.from_bytes(b[p + 22 : p + 26], "little"):
                pages[p] = stop, b[p + 5], b[p + 14 : p + 18]
    return pages[p]


def _ogg(w: Walk, at: int) -> int | None:
    """Pages with right checksums, up to where all streams that began have ended and no other begins."""
    p, running, end = at, set(), None
    while (page := _ogg_page(w, p)) is not None:
        stop, flags, serial = page
        if serial not in running and not flags & 2:
            break
        running.add(serial)
        if flags & 4:
            running.discard(serial)
        p = stop
        if not running:
            end = p
    return end


def _mp3_frame(w: Walk, p: int):
    b = w.b
    head = int.from_bytes(b[p : p + 4], "big") if p + 4 <= len(b) else 0
    version, rate, samples = head >> 19 & 3, head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version == 1 or head >> 17 & 3 != 1 or rate in (0, 15) or samples == 3:
        return None, p  # the last frame ends here
    hertz = MP3_SAMPLES[samples] >> {3: 0, 2: 1, 0: 2}[version]
    size = (144 if version == 3 else 72) * MP3_RATES[1 if version == 3 else 2][rate] * 1000 // hertz + (head >> 9 & 1)
    return (p + size, None) if p + size <= len(b) else (None, p)


def _mp3(w: Walk, at: int) -> int | None:
    """An ID3v2 tag and frames, or at least four frames on end."""
    b, p = w.b, at
    tagged = b[at : at + 3] == b"ID3"
    if tagged:
        if at + 10 > len(b) or b[at + 3] not in (2, 3, 4) or any(x > 127 for x in b[at + 6 : at + 10]):
            return None
        p = at + 10 + (b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9])
    q = p
    for _ in range(1 if tagged else 4):
        q, _end = _mp3_frame(w, q)
        if q is None:
            return None
    end = w.end(q, _mp3_frame)
    return end + 128 if end is not None and b[end : end + 3] == b"TAG" and end + 128 <= len(b) else end


def _mp4_box(w: Walk, p: int):
    b = w.b
    if p + 8 > len(b) or b[p + 4 : p + 8] == b"ftyp" or not re.fullmatch(rb"[A-Za-z0-9 \xa9-]{4}", b[p + 4 : p + 8]):
        return None, p  # another file begins, or what is no box
    size = struct.unpack_from(">I", b, p)[0]
    if size == 1 and p + 16 <= len(b):
        size = struct.unpack_from(">Q", b, p + 8)[0]
    elif size == 0:
        return None, len(b)
    if size < 8 or p + size > len(b):
        return None, p
    return p + size, None


def _mp4(w: Walk, at: int) -> int | None:
    """Boxes on end: the file type first, then at least one that describes or holds media."""
    b = w.b
    if at < 0 or at + 16 > len(b):
        return None
    size = struct.unpack_from(">I", b, at)[0]
    if size < 16 or size % 4 or size > 1024 or b[at + size + 4 : at + size + 8] not in (b"moov", b"mdat", b"moof", b"meta", b"free", b"skip", b"wide", b"uuid", b"styp", b"sidx", b"pdin"):
        return None
    end = w.end(at + size, _mp4_box)
    return end if end is not None and end > at + size and re.search(rb"moov|mdat|moof|meta", b[at + size : end]) else None


def _pdf(w: Walk, at: int) -> int | None:
    """Up to the last trailer before the next header whose table is where it says."""
    starts, ends = w.pdf_parts
    i = bisect_right(starts, at)
    stop = starts[i] if i < len(starts) else len(w.b)
    end = None
    for place, table, e in ends[bisect_right(ends, (at,)) : bisect_right(ends, (stop,))]:
        q = at + table
        if q < place and (w.b[q : q + 4] == b"xref" or re.match(rb"[0-9]+ [0-9]+ obj", w.b[q : q + 24])):
            end = e
    return end


def _zip(w: Walk, at: int) -> int | None:
    return w.archives.get(at)


def _gzip(w: Walk, at: int) -> int | None:
    b, stream = w.b, zlib.decompressobj(31)
    try:
        for p in range(at, len(b), 65536):
            stream.decompress(b[p : p + 65536], 1 << 20)
            while stream.unconsumed_tail:
                stream.decompress(stream.unconsumed_tail, 1 << 20)
            if stream.eof:
                return min(p + 65536, len(b)) - len(stream.unused_data)
    except zlib.error:
        pass
    return None


VALIDATORS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "image/tiff": _tiff, "riff": _riff, "audio/flac": _flac, "application/ogg": _ogg, "audio/mpeg": _mp3, "video/mp4": _mp4,
    "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}
#: Formats whose parts begin with the magic bytes of the whole: within one that is confirmed no other is looked for.
OF_ITS_KIND = ("audio/mpeg", "application/ogg")


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (kind, into) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic) + into, kind))
    found.make_automaton()
    return found


def sniff(value: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[str, int, int]]]:
    """How many magic numbers ``value`` holds, and the confirmed containers (type, start, end), outermost first."""
    candidates, found, walk, reach = 0, [], Walk(value), dict.fromkeys(OF_ITS_KIND, 0)
    for last, (length, kind) in automaton.iter(value.decode("latin-1")):
        candidates += 1
        at = last + 1 - length
        if at < reach.get(kind, 0):
            continue
        if (end := VALIDATORS[kind](walk, at)) is not None:
            found.append((RIFF_KINDS[value[at + 8 : at + 12]] if kind == "riff" else kind, at, end))
            if kind in reach:
                reach[kind] = max(reach[kind], end)
    return candidates, sorted(found, key=lambda x: (x[1], -x[2]))


_SNIFFED = T.StructType(
    [
        T.StructField("media_type", T.StringType()),
        T.StructField("candidates", T.LongType()),
        T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("data", T.BinaryType())]))),
    ]
)


@F.pandas_udf(_SNIFFED)
def _sniffed(values: pd.Series) -> pd.DataFrame:
    rows = []
    for value in values:
        b = payload(value)
        candidates, found = sniff(b, _automaton())
        kind = next((k for k, at, _ in found if at == 0), None)
        rows.append((kind, candidates, [{"type": k, "start": at, "end": end, "data": b[at:end]} for k, at, end in found if at]))
    return pd.DataFrame(rows, columns=_SNIFFED.names)


def sniff_media(df: DataFrame, media_col: str, declared_col: str) -> DataFrame:
    """``df`` with a struct ``sniffed``: media_type, corrected, candidates, embedded.

    ``media_type`` is the confirmed container that begins the value, or null;
    ``corrected`` says that it differs from the declared type (a null declared
    type differs from any). ``embedded`` holds each confirmed container that
    begins later, nested ones too, with its bytes. Rows come back with their
    columns, but a column ``sniffed``, in any case, is replaced. A null value
    is an empty one: no type, nothing embedded. Repeated rows get equal results.
    """
    (seen,) = private(df, "seen")
    s = F.col(seen)
    corrected = s["media_type"].isNotNull() & ~s["media_type"].eqNullSafe(named(declared_col))
    sniffed = F.struct(s["media_type"].alias("media_type"), corrected.alias("corrected"), s["candidates"].alias("candidates"), s["embedded"].alias("embedded"))
    return df.withColumn(seen, _sniffed(named(media_col))).select(*given(df, "sniffed"), sniffed.alias("sniffed"))


def wave_of(b: bytes) -> bytes:
    """Bytes, blank-padded to a positive multiple of 192, as 8-bit mono PCM samples in a WAVE container."""
    n = max(1, -(-len(b) // 192)) * 192
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + b.ljust(n)


@F.pandas_udf(T.BinaryType())
def _as_samples(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: wave_of(payload(t)))


def as_samples(text: Column) -> Column:
    """The stored media form of a text (null: empty)."""
    return _as_samples(F.coalesce(utf8(text), F.lit(b"")))


_STORED = T.StructType(
    [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("levels", T.StringType()))]
    + [T.StructField("media_type", T.StringType()), T.StructField("candidates", T.LongType()), T.StructField("embedded", T.StringType())]
)


def read_samples(b: bytes) -> tuple[int, str, int, int, str, str]:
    """What is read back from stored bytes: the samples' number, hashes of them and of the whole, and their levels."""
    p = 12
    while b[p : p + 4] != b"data":
        p += 8 + struct.unpack_from("<I", b, p + 4)[0]
    samples = b[p + 8 : p + 8 + struct.unpack_from("<I", b, p + 4)[0]]
    x = np.frombuffer(samples, np.uint8)
    levels = f"mean={x.mean():.4f};std={x.std():.4f};low={x.min()};high={x.max()}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(b), hashlib.sha256(b).hexdigest(), levels


@F.pandas_udf(_STORED)
def _stored_and_read(texts: pd.Series) -> pd.DataFrame:
    """Each text is stored once; the stored bytes are sniffed and read back."""
    rows = []
    for text in texts:
        b = wave_of(payload(text))
        candidates, found = sniff(b, _automaton())
        kind = next((k for k, at, _ in found if at == 0), None)
        rows.append((*read_samples(b), kind, candidates, "+".join(f"{k}:{at}:{end}" for k, at, end in found if at)))
    return pd.DataFrame(rows, columns=_STORED.names)


def media_features(docs: DataFrame, text_col: str = "text", declared_type: str = "application/octet-stream") -> DataFrame:
    """``docs`` with a struct ``media``.

    Each text is stored as samples (see :func:`as_samples` for these as a
    column), sniffed under ``declared_type``, and read back from its stored
    bytes. ``media`` holds n_bytes (of the text), payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, which
    tells the confirmed type, whether that corrects the declared one, the
    magic numbers seen, the embedded media confirmed, and the sample levels.
    Rows come back with their columns, but a column ``media``, in any case, is
    replaced. Null and empty texts give 192 blanks. Equal texts give equal values.
    """
    (read,) = private(docs, "read")
    r = F.col(read)
    corrected = ~r["media_type"].eqNullSafe(F.lit(declared_type))
    feature = F.concat_ws(";", r["media_type"], F.concat(F.lit("corrected="), corrected.cast("string")), F.concat(F.lit("magic="), r["candidates"].cast("string")), F.concat(F.lit("embedded="), r["embedded"]), r["levels"])
    n_bytes = F.coalesce(F.octet_length(named(text_col)), F.lit(0)).cast("long")
    media = F.struct(n_bytes.alias("n_bytes"), *[r[c].alias(c) for c in _STORED.names[:5]], feature.alias("feature"))
    return docs.withColumn(read, _stored_and_read(utf8(named(text_col)))).select(*given(docs, "media"), media.alias("media"))
