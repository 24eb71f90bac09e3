"""Tags in audio files: comments of FLAC and Ogg, the INFO list of RIFF waves, ID3 frames, the item list of MP4. Other containers have no rows.

The formats are published ones. What a file says is read in its own order; a file that is cut off or contradicts itself raises ValueError, tags that it
encrypts are left out. *_octets are the inverses, for files that hold nothing but their tags.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from provena.sources.binary import _decoded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of the two formats, and ours.
INFO = {"INAM": "title", "IPRD": "album", "IART": "artist", "ICRD": "date", "IPRT": "track", "IMUS": "composer"}
COMMENTS = {"albumartist": "album_artist", "tracknumber": "track", "discnumber": "disc", "albumartistsort": "sort_album_artist", "artistsort": "sort_artist", "composersort": "sort_composer"}
ID3 = {
    "TIT2": "title", "TALB": "album", "TPE1": "artist", "TPE2": "album_artist", "TCOM": "composer", "TDRC": "date", "TYER": "date", "TRCK": "track", "TPOS": "disc", "TCMP": "compilation",
    "TSO2": "sort_album_artist", "TSOP": "sort_artist", "TSOC": "sort_composer", "TT2": "title", "TAL": "album", "TP1": "artist", "TP2": "album_artist", "TCM": "composer", "TYE": "date",
    "TRK": "track", "TPA": "disc", "TCP": "compilation", "TS2": "sort_album_artist", "TSP": "sort_artist", "TSC": "sort_composer",
}
MP4 = {
    "\xa9nam": "title", "\xa9alb": "album", "\xa9ART": "artist", "aART": "album_artist", "\xa9wrt": "composer", "\xa9day": "date", "trkn": "track", "disk": "disc", "cpil": "compilation",
    "soaa": "sort_album_artist", "soar": "sort_artist", "soco": "sort_composer",
}
_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
TAGS = "ordinal int, name string, value string"


def _whole(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("cut off")
    return data[at : at + n]


def _comments(body: bytes) -> Iterator[tuple[str, str]]:
    at = 4 + int.from_bytes(_whole(body, 0, 4), "little")
    n, at = int.from_bytes(_whole(body, at, 4), "little"), at + 4
    for _ in range(n):
        size = int.from_bytes(_whole(body, at, 4), "little")
        name, _, value = _whole(body, at + 4, size).decode("utf-8", "replace").partition("=")
        yield COMMENTS.get(name.lower(), name.lower()), value
        at += 4 + size


def _info(body: bytes) -> Iterator[tuple[str, str]]:
    at = 4
    while at + 8 <= len(body):
        name, size = struct.unpack_from("<4sI", body, at)
        name = name.decode("latin-1")
        yield INFO.get(name, name), _whole(body, at + 8, size).rstrip(b"\0").decode("utf-8", "replace")
        at += 8 + size + size % 2


def _synchsafe(octets: bytes) -> int:
    if max(octets) > 127:
        raise ValueError("not a size")
    out = 0
    for b in octets:
        out = out << 7 | b
    return out


def _id3_text(name: str, body: bytes) -> tuple[str, str]:
    """Name and value of a text frame; several values are joined by "; "."""
    if body[:1] not in (b"\0", b"\1", b"\2", b"\3"):
        return ID3.get(name, name), ""
    code = _ENCODINGS[body[0]]
    wide = body[0] in (1, 2)
    text = body[1 : len(body) - (len(body) - 1) % 2 if wide else len(body)].decode(code, "replace")
    # in UTF-16 each value may begin with a mark of its own
    parts = [x.lstrip("\ufeff") for x in text.split("\0")]
    if name in ("TXXX", "TXX"):
        return parts[0], "; ".join(x for x in parts[1:] if x)
    return ID3.get(name, name), "; ".join(x for x in parts if x)


def _id3(data: bytes) -> Iterator[tuple[str, str]]:
    major, flags = _whole(data, 0, 10)[3], data[5]
    body = _whole(data, 10, _synchsafe(data[6:10]))
    if major not in (2, 3, 4):
        raise ValueError(f"unknown version {major}")
    if flags & 0x80 and major < 4:  # from version 4 on each frame says so itself
        body = body.replace(b"\xff\0", b"\xff")
    size_of = _synchsafe if major == 4 else lambda b: int.from_bytes(b, "big")
    at = 0
    if flags & 0x40 and major > 2:
        at = size_of(_whole(body, 0, 4)) + (4 if major == 3 else 0)
    head = 6 if major == 2 else 10
    while at + head <= len(body) and body[at]:  # zeros fill up the rest
        name = body[at : at + (3 if major == 2 else 4)].decode("latin-1")
        size = size_of(body[at + 3 : at + 6] if major == 2 else body[at + 4 : at + 8])
        kind = body[at + 9] if major > 2 else 0
        frame, at = _whole(body, at + head, size), at + head + size
        packed, secret, grouped, long = (kind & 0x80, kind & 0x40, kind & 0x20, kind & 0x80) if major == 3 else (kind & 8, kind & 4, kind & 0x40, kind & 1)
        if secret:
            continue
        frame = frame[(1 if grouped else 0) + (4 if long else 0) :]
        if major == 4 and (kind & 2 or flags & 0x80):
            frame = frame.replace(b"\xff\0", b"\xff")
        if packed:
            try:
                frame = zlib.decompress(frame)
            except zlib.error as e:
                raise ValueError(f"frame {name}: {e}") from e
        yield _id3_text(name, frame) if name[0] == "T" else (name, "")


def _ogg_table() -> list[int]:
    """Of CRC-32 with the highest bit first, as pages have it."""
    out = []
    for b in range(256):
        r = b << 24
        for _ in range(8):
            r = r << 1 ^ (0x104C11DB7 if r & 0x80000000 else 0)
        out.append(r)
    return out


_OGG = _ogg_table()


def _ogg_crc(page: bytes) -> int:
    r = 0
    for b in page:
        r = (r << 8 & 0xFFFFFFFF) ^ _OGG[r >> 24 ^ b]
    return r


def _ogg(data: bytes) -> Iterator[tuple[str, str]]:
    """Comments of each logical stream: its second packet, put together over lacing values and pages."""
    packets: dict[int, list[bytearray]] = {}  # by stream: whole packets, then the one that has begun
    following: dict[int, int] = {}
    at = 0
    while at < len(data) and not (packets and all(len(x) > 2 for x in packets.values())):
        if _whole(data, at, 27)[:5] != b"OggS\0":
            raise ValueError("not a page")
        serial, number, crc = struct.unpack_from("<III", data, at + 14)
        lacing = _whole(data, at + 27, data[at + 26])
        size = 27 + len(lacing) + sum(lacing)
        page = _whole(data, at, size)
        if _ogg_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("page checksum")
        if number != following.setdefault(serial, number):
            raise ValueError("a page is missing")
        following[serial] = number + 1
        mine, place = packets.setdefault(serial, [bytearray()]), 27 + len(lacing)
        for n in lacing:
            mine[-1] += page[place : place + n]
            place += n
            if n < 255:
                mine.append(bytearray())
        at += size
    for first, second, *_ in (x for x in packets.values() if len(x) > 2):
        for begins, mark in ((b"\1vorbis", b"\3vorbis"), (b"OpusHead", b"OpusTags")):
            if first.startswith(begins):
                if not second.startswith(mark):
                    raise ValueError("no comments after the first packet")
                yield from _comments(bytes(second[len(mark) :]))
        if first.startswith(b"\x7fFLAC") and second and second[0] & 127 == 4:
            yield from _comments(bytes(second[4:]))
    if packets and not any(len(x) > 2 for x in packets.values()):
        raise ValueError("cut off")


def _atoms(data: bytes, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(name, first octet, octet after the last) of the contents of the atoms in a stretch."""
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = int.from_bytes(_whole(data, at + 8, 8), "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError(f"atom {name!r} is cut off")
        yield name.decode("latin-1"), at + head, at + size
        at += size
    if end - at not in (0, 4) or any(data[at:end]):  # four zeros may end a list
        raise ValueError("cut off between atoms")


def _mp4_value(name: str, kind: int, body: bytes) -> str:
    if name in ("trkn", "disk"):
        n, of = struct.unpack(">HH", _whole(body, 2, 4))
        return f"{n}/{of}" if of else str(n)
    if kind in (0, 21) and name in ("cpil", "tmpo", "pgap"):
        return str(int.from_bytes(body, "big", signed=True))
    return body.decode("utf-16-be" if kind == 2 else "utf-8", "replace") if kind in (1, 2) else ""


def _mp4(data: bytes) -> Iterator[tuple[str, str]]:
    """The item list of moov.udta.meta, found in the tree of atoms."""
    def inside(lo: int, hi: int, path: list[str]) -> Iterator[tuple[int, int]]:
        if not path:
            yield lo, hi
            return
        for name, a, b in _atoms(data, lo, hi):
            if name == path[0]:
                yield from inside(a + 4 if name == "meta" else a, b, path[1:])

    for lo, hi in inside(0, len(data), ["moov", "udta", "meta", "ilst"]):
        for item, a, b in _atoms(data, lo, hi):
            own, cells = item, []
            for name, c, d in _atoms(data, a, b):
                if name == "name" and item == "----":
                    own = data[c + 4 : d].decode("utf-8", "replace")
                elif name == "data":
                    cells.append(_mp4_value(item, int.from_bytes(_whole(data, c, 4), "big") & 0xFFFFFF if item != "----" else 1, data[c + 8 : d]))
            if cells:
                yield MP4.get(own, own), "; ".join(cells)


def _flac(data: bytes) -> Iterator[tuple[str, str]]:
    at, last = 4, False
    while not last:
        head = _whole(data, at, 4)
        last, kind, size = head[0] > 127, head[0] & 127, int.from_bytes(head[1:], "big")
        if kind == 4:
            yield from _comments(_whole(data, at + 4, size))
        at += 4 + size


def _wave(data: bytes) -> Iterator[tuple[str, str]]:
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            yield from _info(_whole(data, at + 8, size))
        at += 8 + size + size % 2


def tag_rows(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(ordinal, name, value) in the order of the file; our names for known tags. ValueError where the file is cut off."""
    found: Iterator[tuple[str, str]] = iter(())
    if data[:4] == b"fLaC":
        found = _flac(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        found = _wave(data)
    elif data[:3] == b"ID3":
        found = _id3(data)
    elif data[:4] == b"OggS":
        found = _ogg(data)
    elif data[4:8] == b"ftyp":
        found = _mp4(data)
    return ((k, *x) for k, x in enumerate(found))


def decode_tags(files: DataFrame, column: str = "content") -> DataFrame:
    """files with their BINARY column replaced by rows (ordinal, name, value): the raw dump of tags, and what tag_record() takes."""
    return _decoded(files, column, tag_rows, TAGS)


def id3_octets(tags: list[tuple[str, str]]) -> bytes:
    """A version 4 tag with frames in UTF-8; names are frames', others become described text."""
    safe = lambda n: bytes(n >> k & 127 for k in (21, 14, 7, 0))
    frames = b""
    for name, value in tags:
        known = next((k for k, v in ID3.items() if v == name and len(k) == 4), None)
        body = b"\3" + (value if known else f"{name}\0{value}").encode()
        frames += (known or "TXXX").encode() + safe(len(body)) + b"\0\0" + body
    return b"ID3\4\0\0" + safe(len(frames)) + frames


def ogg_octets(tags: list[tuple[str, str]], page: int = 255) -> bytes:
    """Two packets of a Vorbis stream in pages of at most `page` lacing values."""
    text = [f"{k}={v}".encode() for k, v in tags]
    comments = b"\3vorbis" + struct.pack("<I", 0) + struct.pack("<I", len(text)) + b"".join(struct.pack("<I", len(t)) + t for t in text) + b"\1"
    out = b""
    number = 0
    for packet in (b"\1vorbis" + bytes(23), comments):
        lacing = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for lo in range(0, len(lacing), page):
            some = lacing[lo : lo + page]
            head = struct.pack("<4sBBqII", b"OggS", 0, 1 if lo else 0, 0, 7, number)
            rest = bytes([len(some), *some]) + packet[at : at + sum(some)]
            out += head + struct.pack("<I", _ogg_crc(head + b"\0\0\0\0" + rest)) + rest
            at, number = at + sum(some), number + 1
    return out


def mp4_octets(tags: list[tuple[str, str]]) -> bytes:
    atom = lambda name, body: struct.pack(">I", 8 + len(body)) + name.encode("latin-1") + body
    items = b""
    for name, value in tags:
        known = next((k for k, v in MP4.items() if v == name), None)
        if known in ("trkn", "disk"):
            n, _, of = value.partition("/")
            items += atom(known, atom("data", bytes(8) + struct.pack(">HHHH", 0, int(n), int(of or 0), 0)))
        elif known == "cpil":
            items += atom(known, atom("data", struct.pack(">II", 21, 0) + bytes([int(value)])))
        else:
            data = atom("data", struct.pack(">II", 1, 0) + value.encode())
            items += atom(known, data) if known else atom("----", atom("mean", bytes(4) + b"tags") + atom("name", bytes(4) + name.encode()) + data)
    return atom("ftyp", b"M4A ") + atom("free", bytes(5)) + atom("moov", atom("mvhd", bytes(100)) + atom("udta", atom("meta", bytes(4) + atom("hdlr", bytes(25)) + atom("ilst", items))))
