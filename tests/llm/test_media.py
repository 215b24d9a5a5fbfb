"""Each validator on containers of its format: confirmed, cut short, spoilt, and among other bytes."""

import io
import struct
import time
import zipfile
import zlib

import pytest

from limpid.llm import media


def chunk(kind, data):
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def png():
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x" * 40) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a\x01\x00\x01\x00\x00\x00\x00!\xf9\x04\0\0\0\0\0,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def jpeg():
    segment = lambda marker, data: b"\xff" + bytes([marker]) + (len(data) + 2).to_bytes(2, "big") + data
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0data") + b"\xff\xff\xff" + segment(0xDB, bytes(64))[1:] + b"\xff\x01" + segment(0xDA, b"\1\1\0\0") + b"ab\xff\0c\xff\xd0d\xff\0" + segment(0xDA, b"\2\1\0\0") + b"efg" + b"\xff\xd9"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHH", 54 + 16, 0, 54, 40, 3, 1, 1, 24) + bytes(24) + bytes(16)


def tiff(order="<"):
    fields = [(256, 3, 1, 4), (257, 3, 1, 2), (273, 4, 2, 62), (279, 4, 2, 70)]
    packed = b"".join(struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, n, v in fields)
    ifd = struct.pack(order + "H", 4) + packed + struct.pack(order + "I", 0)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    assert len(head + ifd) == 62
    return head + ifd + struct.pack(order + "II", 78, 88) + struct.pack(order + "II", 10, 5) + bytes(15)


def riff(kind):
    body = kind + b"data" + struct.pack("<I", 5) + b"12345\0"
    return b"RIFF" + struct.pack("<I", len(body)) + body


def crc(table, data, bits):
    """Bit by bit from the polynomials, not from the tables of the module."""
    poly, top, mask = table, 1 << (bits - 1), (1 << bits) - 1
    c = 0
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
    return c


def flac(frames=3, known=True):
    blocks = []
    for i in range(frames):
        head = b"\xff\xf8" + bytes([0x10 | 9, 0x08, i])
        frame = head + bytes([crc(0x07, head, 8)]) + bytes([0x02]) + bytes((7 * j + i) % 251 for j in range(192))
        blocks.append(frame + crc(0x8005, frame, 16).to_bytes(2, "big"))
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((44100 << 44) | (7 << 36) | (192 * frames if known else 0)).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80\0\0\x22" + info + b"".join(blocks)


def page(serial, flags, data):
    head = b"OggS\0" + bytes([flags]) + bytes(8) + serial.to_bytes(4, "little") + bytes(4)
    rest = bytes([1, len(data)]) + data
    return head + crc(0x04C11DB7, head + bytes(4) + rest, 32).to_bytes(4, "little") + rest


def ogg():
    """Two streams side by side and a third one after them."""
    return page(1, 2, b"a") + page(2, 2, b"b") + page(1, 4, b"c") + page(2, 4, b"d") + page(3, 2, b"e") + page(3, 4, b"f")


def test_pages_of_ogg():
    for data in (b"", b"a", bytes(range(256)) * 5):
        assert media.ogg_checksum(data) == crc(0x04C11DB7, data, 32)
    two_packets = page(1, 0, b"ab")[:5] + b"\x02" + page(1, 0, b"ab")[6:22] + bytes(4) + bytes([2, 1, 1]) + b"ab"
    right = two_packets[:22] + crc(0x04C11DB7, two_packets, 32).to_bytes(4, "little") + two_packets[26:]
    assert found(ogg()) and not found(right + page(1, 4, b"c"))


def mp3(tag=True):
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    return (b"ID3\x04\0\0\0\0\0\x0a" + bytes(10) if tag else b"") + frame * 5 + b"TAG" + bytes(125)


def mp4():
    box = lambda kind, data: (len(data) + 8).to_bytes(4, "big") + kind + data
    return box(b"ftyp", b"isom\0\0\0\1isom") + box(b"moov", box(b"mvhd", bytes(20))) + (1).to_bytes(4, "big") + b"mdat" + (30).to_bytes(8, "big") + bytes(14)


def pdf(note=b""):
    body = b"%PDF-1.4\n" + note + b"1 0 obj\nendobj\n"
    return body + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"


def archive(inner=b"text"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("inner.zip", inner)
        z.writestr("b.txt", b"second")
    return out.getvalue()


WHOLE = {
    "image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "image/bmp": bmp(), "image/tiff": tiff(), "audio/wav": riff(b"WAVE"), "image/webp": riff(b"WEBP"), "video/x-msvideo": riff(b"AVI "),
    "audio/flac": flac(), "application/ogg": ogg(), "audio/mpeg": mp3(), "video/mp4": mp4(), "application/pdf": pdf(), "application/zip": archive(),
}


def found(value):
    return media.sniff(value, media._automaton())[1]


@pytest.mark.parametrize("kind", WHOLE)
def test_whole_containers_end_where_they_end(kind):
    value = WHOLE[kind]
    assert found(value) == [(kind, 0, len(value))]
    assert found(b"some text " + value + b" and more text") == [(kind, 10, 10 + len(value))]
    assert found(value + value) == ([(kind, 0, 2 * len(value))] if kind in ("application/ogg",) else [(kind, 0, len(value)), (kind, len(value), 2 * len(value))])


@pytest.mark.parametrize("kind", WHOLE)
def test_containers_that_are_cut_short_are_refused(kind):
    value = WHOLE[kind]
    cut = value[: len(value) * 2 // 3]
    # What stands on its own before the cut may be confirmed: frames, pages and boxes. The rest may not.
    assert all(end <= len(cut) and kind in ("audio/mpeg", "application/ogg", "video/mp4") for _, _, end in found(cut)), found(cut)


def test_spoilt_checksums_are_refused():
    for kind, at in (("image/png", 45), ("audio/flac", 100), ("application/ogg", 26)):
        value = bytearray(WHOLE[kind])
        value[at] ^= 1
        assert not [x for x in found(bytes(value)) if x[1] == 0], kind  # a later stream stands on its own


def test_other_forms():
    assert found(tiff(">")) == [("image/tiff", 0, 93)]
    assert found(mp3(False)) == [("audio/mpeg", 0, len(mp3(False)))]
    assert found(b"\xff\xfb\x90\x00" + bytes(413) + b"once") == []
    unknown = flac(4, known=False)
    assert found(unknown) == [("audio/flac", 0, len(unknown))]


def test_nested_and_consecutive_containers():
    inner = archive(png())
    outer = archive(inner)
    at = outer.index(inner)
    assert [(k, s, e) for k, s, e in found(outer) if k == "application/zip"] == [("application/zip", 0, len(outer)), ("application/zip", at, at + len(inner))]
    two = pdf(b"first") + b" between " + pdf(b"second one")
    assert found(two) == [("application/pdf", 0, len(pdf(b"first"))), ("application/pdf", two.rindex(b"%PDF-"), len(two))]


def test_many_starts_cost_no_more_than_one_walk():
    began = time.perf_counter()
    for start in (b"GIF89a", b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"OggS\0\x02", b"\xff\xfb\x90\x00", b"....ftyp"):
        found(start * 30_000 + b"startxref\n5\n%%EOF" * 3)
    assert time.perf_counter() - began < 20
