"""Binary responses and audio: decoders, and a reader of files of them.

Decoders yield one tuple per row and raise ValueError on truncated or malformed octets. As expressions they work on a BINARY column
(decode_rip, decode_eac, decode_wav), whole Arrow batches at a time.
"""

from __future__ import annotations

import gzip
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.schema import EAC_MAGICS

# Decoders go to executors with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RIP = "entry int, id1 long, id2 long, cddb long, track_pos int, confidence int, crc long, offset_crc long"
EAC = "track_pos int, kind string, ordinal int, crc32 long, count long, date long"
WAV = "channels int, rate int, j long, s long"
_HEAD, _CHUNK = "<BIII", "<BII"


def plain(data: bytes) -> bytes:
    """Inflate a gzip response; octets that are not gzip are taken as they are."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def rip_rows(data: bytes) -> Iterator[tuple]:
    """Entries of the rip database: n and three ids, then n chunks of confidence, checksum and offset checksum."""
    at, entry = 0, 0
    while at < len(data):
        if at + 13 > len(data):
            raise ValueError(f"{len(data) - at} octets remain")
        n, id1, id2, cddb = struct.unpack_from(_HEAD, data, at)
        at += 13
        if at + n * 9 > len(data):
            raise ValueError(f"entry {entry} is cut off")
        for k in range(n):
            confidence, crc, offset_crc = struct.unpack_from(_CHUNK, data, at)
            yield entry, id1, id2, cddb, k + 1, confidence, crc, offset_crc
            at += 9
        entry += 1


def rip_octets(entries: list[tuple[int, int, int, list[tuple[int, int, int]]]]) -> bytes:
    """The inverse of rip_rows, for (id1, id2, cddb, chunks)."""
    return b"".join(struct.pack(_HEAD, len(c), a, b, d) + b"".join(struct.pack(_CHUNK, *x) for x in c) for a, b, d, c in entries)


def eac_rows(data: bytes) -> Iterator[tuple]:
    """The second database's file: n - 1 and a date, then lists of (crc, count, date) per track: whole tracks, then parts, between three magic words.

    Track 0 is a slot before the first track.
    """
    if len(data) % 4:
        raise ValueError("not a whole number of words")
    words = struct.unpack(f"<{len(data) // 4}I", data)
    at = 0

    def take(n: int) -> tuple[int, ...]:
        nonlocal at
        if at + n > len(words):
            raise ValueError("cut off")
        at += n
        return words[at - n : at]

    n, _ = take(2)
    for kind, magic in zip(("whole", "part"), EAC_MAGICS):
        if take(1) != (magic,):
            raise ValueError("not a section")
        for track in range(n + 1):
            for k in range(take(1)[0]):
                yield track, kind, k, *take(3)
    if take(1) != (EAC_MAGICS[2],) or at != len(words):
        raise ValueError("not the end")


def eac_octets(date: int, whole: list[list[tuple[int, int, int]]], part: list[list[tuple[int, int, int]]]) -> bytes:
    """The inverse of eac_rows; one list per track slot."""
    words = [len(whole) - 1, date]
    for magic, lists in zip(EAC_MAGICS, (whole, part)):
        words.append(magic)
        for x in lists:
            words += [len(x), *(w for b in x for w in b)]
    words.append(EAC_MAGICS[2])
    return struct.pack(f"<{len(words)}I", *words)


def _format(body: bytes) -> tuple[int, int, int, int]:
    """(kind, channels, rate, bits) of a format chunk; an extensible one says its kind in the first word of its subformat."""
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
    if kind == 0xFFFE:
        if len(body) < 40:
            raise ValueError("an extensible format without its subformat")
        kind = struct.unpack_from("<H", body, 24)[0]
    if (kind, bits) not in _SAMPLES or channels not in (1, 2) or not rate:
        raise ValueError("only linear samples of 8 to 32 bits or floating ones, mono or stereo")
    return kind, channels, rate, bits


def _wide(body: bytes) -> np.ndarray:
    """24-bit samples: the two high octets."""
    return np.frombuffer(body, np.uint8).reshape(-1, 3)[:, 1:].copy().view("<i2").ravel()


#: By kind of format and bits: whole samples to 16 bits. Wider ones lose their low bits, floating ones are rounded to even and clipped, as not a number is to 0.
_SAMPLES = {
    (1, 8): lambda b: (np.frombuffer(b, np.uint8).astype(np.int16) - 128) << 8,
    (1, 16): lambda b: np.frombuffer(b, "<i2"),
    (1, 24): _wide,
    (1, 32): lambda b: (np.frombuffer(b, "<i4") >> 16).astype(np.int16),
    (3, 32): lambda b: np.clip(np.rint(np.nan_to_num(np.frombuffer(b, "<f4").astype(float) * 32768)), -32768, 32767).astype(np.int16),
    (3, 64): lambda b: np.clip(np.rint(np.nan_to_num(np.frombuffer(b, "<f8") * 32768)), -32768, 32767).astype(np.int16),
}


def wav_rows(data: bytes) -> Iterator[tuple]:
    """Linear or floating samples in a RIFF container, as 16 bits: (channels, rate, j from 1, the stereo pair as one unsigned word). Mono counts on both sides.

    A file without samples, of open or cut off length, or with more than one format or body raises.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name in (b"fmt ", b"data") and at + 8 + size > len(data):
            raise ValueError(f"{name.decode()} is cut off")
        if name == b"fmt ":
            if form is not None or size < 16:
                raise ValueError("not one format")
            form = _format(data[at + 8 : at + 8 + size])
        elif name == b"data":
            if form is None or body is not None:
                raise ValueError("not one body after its format")
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not body:
        raise ValueError("no samples")
    kind, channels, rate, bits = form
    frame = channels * bits // 8
    words = _SAMPLES[kind, bits](body[: len(body) // frame * frame]).astype(np.int64) & 0xFFFF
    pairs = (words[::2] | words[1::2] << 16) if channels == 2 else words | words << 16
    for lo in range(0, len(pairs), 65536):
        for j, s in enumerate(pairs[lo : lo + 65536].tolist(), lo + 1):
            yield channels, rate, j, s


def _decoded(rows: DataFrame, column: str, decode, schema: str) -> DataFrame:
    keep = [c for c in rows.columns if c != column]
    names = [c.split()[0] for c in schema.split(", ")]
    k = rows.columns.index(column)
    given = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "float": pa.float32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = b.select([i for i in range(b.num_columns) if i != k])
            of, found = [], []

            def flush() -> pa.RecordBatch:
                cells = [pa.array(c, types[t.split()[1]]) for c, t in zip(zip(*found), schema.split(", "))]
                out = pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int32())) for c in others.columns), *cells], names=[*keep, *names])
                of.clear()
                found.clear()
                return out

            for at, data in enumerate(b.column(k).to_pylist()):
                for x in decode(plain(data)) if data else ():
                    of.append(at)
                    found.append(x)
                    if len(of) == 50_000:  # many short responses are one batch, a long one is several
                        yield flush()
            if of:
                yield flush()

    return rows.mapInArrow(run, f"{given}, {schema}" if given else schema)


def decode_rip(responses: DataFrame, column: str = "content") -> DataFrame:
    """responses with their BINARY column replaced by the rows of the rip database's format."""
    return _decoded(responses, column, rip_rows, RIP)


def decode_eac(responses: DataFrame, column: str = "content") -> DataFrame:
    return _decoded(responses, column, eac_rows, EAC)


def decode_wav(files: DataFrame, column: str = "content") -> DataFrame:
    return _decoded(files, column, wav_rows, WAV)


def read_files(spark, path: str, kind: str, pattern: str = "*") -> DataFrame:
    """Rows of all files under path with their path. kind: rip, eac or wav. Spark's own reader lists and fetches, so any store works."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return {"rip": decode_rip, "eac": decode_eac, "wav": decode_wav}[kind](files)


def rip_rows_native(responses: DataFrame, column: str = "content", key: str = "path") -> DataFrame:
    """decode_rip for responses of one entry, in built-in expressions only. Any other response (several entries, compressed, cut off) fails the query."""
    word = lambda at: F.conv(F.concat(*(F.hex(F.substring(column, at + k, 1)) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    octet = lambda at: F.conv(F.hex(F.substring(column, at, 1)), 16, 10).cast("int")
    rows = responses.withColumn("_n", octet(F.lit(1)))
    one = F.octet_length(column) == 13 + 9 * F.col("_n")
    rows = rows.where(F.octet_length(column) > 0).where(F.when(one, F.col("_n") > 0).otherwise(F.raise_error(F.lit("not a response of one entry")).cast("boolean")))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    at = 14 + 9 * (F.col("_k") - 1)
    return rows.select(key, F.lit(0).alias("entry"), word(F.lit(2)).alias("id1"), word(F.lit(6)).alias("id2"), word(F.lit(10)).alias("cddb"), F.col("_k").alias("track_pos"), octet(at).alias("confidence"), word(at + 1).alias("crc"), word(at + 5).alias("offset_crc"))
