"""Two data sources for Spark: files of rip-database responses ("rip_responses") and of the second database ("eac_responses").

    register(spark)
    spark.read.format("rip_responses").option("only", "*/dBAR-003*").load(folder)
    rows.write.format("rip_responses").mode("append").save(folder)

Reading: files are listed once and dealt into partitions of about partition_mb (option, 32) of whole files; a rip file is fetched in ranges of about a megabyte that end
with an entry, so its size is no matter. The option `only`, a pattern for whole paths, chooses files before anything is read. Writing: rows of one path that
stand together become one file, a rip file entry by entry, compressed with the option compression=gzip; files get their names when the job commits, so a lost task or job leaves none. Paths are those that pyarrow's file systems know;
binary.read_files() reads what only Spark's own readers reach.

pushing() reads with filters on path pushed down to the choice of files (equality, in, prefix, suffix, part). That is no default, as Spark 4.1 keeps what a Python source has
pushed per loaded frame, not per scan: a frame that one plan scans twice, filtered in two ways or once not at all, would have the wrong rows. Filter what pushing()
returns once, and call it again for another filter.

Defined cases: hidden files and empty files have no rows; gzip files are inflated; truncated or malformed octets fail the query; an empty folder gives no rows.
"""

from __future__ import annotations

import gzip
import sys
import uuid
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from provena.sources import binary

# The classes go to executors with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE, BATCH = 1 << 20, 50_000
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _rip_file(stream) -> Iterator[tuple]:
    """Rows of runs of whole entries, about RANGE octets each."""
    first, n, run = 0, 0, bytearray()
    while head := stream.read(13):
        run += head + (stream.read(9 * head[0]) if len(head) == 13 else b"")
        n += 1
        if len(run) >= RANGE:
            yield from ((first + row[0], *row[1:]) for row in binary.rip_rows(bytes(run)))
            first, n = first + n, 0
            run.clear()
    yield from ((first + row[0], *row[1:]) for row in binary.rip_rows(bytes(run)))


def _eac_file(stream) -> Iterator[tuple]:
    data = stream.read()  # one response, a few kilobytes
    return binary.eac_rows(data) if data else iter(())


def _rip_bytes(rows: Iterator) -> Iterator[bytes]:
    """Octets of an entry at a time, so a file's size is no matter."""
    for (_, *ids), entry in groupby(rows, key=lambda r: (r["entry"], r["id1"], r["id2"], r["cddb"])):
        some = list(islice(entry, 256))  # more than 255 can't be written
        yield binary.rip_octets([(*ids, [(r["confidence"], r["crc"], r["offset_crc"]) for r in sorted(some, key=lambda r: r["track_pos"])])])


def _eac_bytes(rows: Iterator) -> Iterator[bytes]:
    rows = list(rows)  # one response, a few kilobytes
    n = 1 + max(r["track_pos"] for r in rows)
    lists = {k: [[] for _ in range(n)] for k in ("whole", "part")}
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        lists[r["kind"]][r["track_pos"]].append((r["crc32"], r["count"], r["date"]))
    yield binary.eac_octets(max(r["date"] for r in rows), lists["whole"], lists["part"])


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: str, decode):
        self.options, self.columns, self.decode, self.tests = options, [c.split() for c in schema.split(", ")], decode, []
        if only := options.get("only"):
            self.tests.append(lambda p: fnmatchcase(p, only))

    def partitions(self):
        store, root = _store(self.options["path"])
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and all(t(f.path) for t in self.tests))
        out, size, most = [], 0, int(float(self.options.get("partition_mb", 32)) * 1e6)
        for path, n in files:
            if not out or size + n > most:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [_Files([])]

    def read(self, partition):
        store, _ = _store(self.options["path"])
        for path in partition.paths:
            with store.open_input_file(path) as f:
                packed = f.read_at(2, 0) == b"\x1f\x8b"
            with store.open_input_stream(path, compression="gzip" if packed else None, buffer_size=RANGE) as f:
                rows = self.decode(f)
                while some := list(islice(rows, BATCH)):
                    cells = [pa.array([path] * len(some)), *(pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*some), self.columns[1:]))]
                    yield pa.RecordBatch.from_arrays(cells, names=[c for c, _ in self.columns])


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        kinds = {
            EqualTo: lambda v: lambda p: p == v, In: lambda v: lambda p: p in v, StringStartsWith: lambda v: lambda p: p.startswith(v),
            StringEndsWith: lambda v: lambda p: p.endswith(v), StringContains: lambda v: lambda p: v in p,
        }
        for f in filters:
            if type(f) in kinds and f.attribute == ("path",):
                self.tests.append(kinds[type(f)](f.value))
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (hidden name, name)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, encode, overwrite: bool):
        self.options, self.encode, self.overwrite = options, encode, overwrite

    def write(self, iterator):
        store, root = _store(self.options["path"])
        store.create_dir(root, recursive=True)
        files = []
        for path, rows in groupby(iterator, key=lambda r: r["path"]):
            name = path.rsplit("/", 1)[-1]
            hidden = f"{root}/_{uuid.uuid4().hex}"
            packed = self.options.get("compression") == "gzip"
            with store.open_output_stream(hidden, buffer_size=RANGE) as f, gzip.GzipFile("", "wb", 9, f, 0) if packed else nullcontext(f) as out:
                for data in self.encode(rows):
                    out.write(data)
            files.append((hidden, f"{root}/{name}"))
        return _Written(files)

    def commit(self, messages):
        store, root = _store(self.options["path"])
        files = [x for m in messages if m for x in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one path stand apart: repartition by path and sort within partitions before writing")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)):
                if f.is_file and f.base_name[0] not in "._":
                    store.delete_file(f.path)
        for hidden, name in files:
            store.move(hidden, name)

    def abort(self, messages):
        store, _ = _store(self.options["path"])
        for m in messages:
            for hidden, _ in m.files if m else ():
                store.delete_file(hidden)


class RipResponses(DataSource):
    """Rows of binary.RIP with their path."""

    decode, encode, columns = staticmethod(_rip_file), staticmethod(_rip_bytes), f"path string, {binary.RIP}"

    @classmethod
    def name(cls):
        return "rip_responses"

    def schema(self):
        return self.columns

    def reader(self, schema):
        kind = _PushingReader if self.options.get("push") == "true" else _Reader
        return kind(dict(self.options), self.columns, self.decode)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), self.encode, overwrite)


class EacResponses(RipResponses):
    """Rows of binary.EAC with their path."""

    decode, encode, columns = staticmethod(_eac_file), staticmethod(_eac_bytes), f"path string, {binary.EAC}"

    @classmethod
    def name(cls):
        return "eac_responses"


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (RipResponses, EacResponses):
        spark.dataSource.register(source)


def pushing(spark: SparkSession, format_: str, folder: str, **options) -> DataFrame:
    """The rows of all files of folder, to be filtered by path once; the filter chooses the files."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(format_).options(push="true", **options).load(folder)
