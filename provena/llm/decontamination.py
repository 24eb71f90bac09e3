"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's windows.

A shard is a slice of an Arrow batch of documents. Its words become symbols of the benchmark's vocabulary; a word that no
benchmark item holds can lie in no occurrence, so it separates. Stretches between separators that are shorter than the shortest
window are left out, longer ones are cut into chunks of at most CHUNK symbols (twice the window, where that is more) that overlap by a window less one, so that each
occurrence lies whole in a chunk. Over the chunks stands an FM-index: suffix array by prefix doubling, Burrows-Wheeler transform
in a wavelet matrix (rank in one step per bit of the alphabet), suffix positions sampled at chunk starts and every SAMPLE-th
symbol. All windows step backwards together; rows found walk to a sampled position; positions become word spans, which are merged.

The benchmark is held in memory by each worker. Its size is measured first; beyond BENCHMARK_MB the items are dealt into that many
parts, and the documents go through one pass per part, each adding its spans to those found before; after CHAIN parts the rows are written and the parts
given up, so a task never holds more, however large the benchmark. Cutting waits for the spans of all parts
and is repeated over all of them, so the parts change no result.

Defined cases: a null or empty text has no words, no spans and no items; an item without words (or null) never occurs; an
item of fewer words than a window is one window; repeated items are one item id; an item with a null id marks words but is not
counted among the items; texts of any length are indexed whole, in blocks of at most BLOCK symbols.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Shared, read, slices, written

WINDOW = 10
CHUNK, SAMPLE, BLOCK = 64, 8, 1 << 19
SHARD_BYTES = 8 << 20
BENCHMARK_MB = 64
#: Parts of the benchmark that a task holds at a time; after these the rows are written and the next parts sent.
CHAIN = 4

#: A-Z to a-z, all that is no word character to a space.
WORDS = bytes(32 if b < 0x30 or 0x3A <= b < 0x61 or 0x7B <= b < 0x80 else b for b in LOWER)
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Patterns:
    """The distinct windows of benchmark items, by length, over the items' vocabulary (symbols from 1)."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        self.of: list[list[int]] = []
        self.ids: list[str | None] = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            n = min(window, len(w))
            for j in range(len(w) - n + 1 if n else 0):
                at = seen.setdefault(tuple(w[j : j + n]), len(seen))
                if at == len(self.of):
                    self.of.append([])
                if not self.of[at] or self.of[at][-1] != k:
                    self.of[at].append(k)
        by_length: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for w, at in seen.items():
            by_length.setdefault(len(w), []).append((w, at))
        self.groups = [(n, np.array([w for w, _ in v], np.int64), np.array([a for _, a in v], np.int64)) for n, v in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def suffix_array(s: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of s in order. A suffix ends at its chunk's end (end[i], the position of its separator); equal ones stand by position."""
    n, h = len(s), 1
    at = np.arange(n)
    rank = s.astype(np.int64)
    while h < longest:
        nxt = np.zeros(n, np.int64)
        inside = at + h < end
        nxt[inside] = rank[at[inside] + h] + 1
        _, new = np.unique(rank * (int(rank.max()) + 2) + nxt, return_inverse=True)
        if h >= 2 and new.max() == rank.max():
            break
        rank, h = new.astype(np.int64), 2 * h
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Over chunks of symbols from 1; 0 separates."""

    def __init__(self, chunks: list[np.ndarray]):
        lengths = np.array([len(c) for c in chunks])
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        s = np.zeros(n, np.int32)
        starts = ends - lengths
        s[np.setdiff1d(np.arange(n), ends, assume_unique=True)] = np.concatenate(chunks)
        sa = suffix_array(s, np.repeat(ends, lengths + 1), int(lengths.max()) + 1)
        bwt = s[sa - 1]
        self.n, self.bits = n, max(1, int(s.max()).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=(1 << self.bits) + 1))))
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        within = np.arange(n) - np.repeat(starts, lengths + 1)
        self.sampled = np.where((within % SAMPLE == 0)[sa], sa, -1)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the transform's first i symbols are c."""
        left = np.zeros_like(i)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            a, b = self.ones[k][i], self.ones[k][left]
            i = np.where(one, self.zeros[k] + a, i - a)
            left = np.where(one, self.zeros[k] + b, left - b)
        return i - left

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for k in range(self.bits):
            a = self.ones[k][i]
            one = self.ones[k][i + 1] > a
            c = 2 * c + one
            i = np.where(one, self.zeros[k] + a, i - a)
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, row after the last) of the patterns that occur."""
        which = np.arange(len(patterns))
        known = patterns.max(axis=1) < (1 << self.bits)
        which = which[known]
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, k]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            found = hi > lo
            which, lo, hi = which[found], lo[found], hi[found]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in rows: each walks back to a sampled one, which lies in the same chunk."""
        out, steps, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            p = self.sampled[rows]
            found = p >= 0
            out[left[found]] = p[found] + steps
            left, rows = left[~found], rows[~found]
            if len(left):
                c = self.symbol(rows)
                rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def occurrences(ids: np.ndarray, patterns: Patterns) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions in ids, window numbers, window length). ids: symbols, 0 where no benchmark word stands."""
    if not patterns.shortest:
        return
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
    first, last = edge[0::2], edge[1::2]
    long = last - first >= patterns.shortest
    chunk = max(CHUNK, 2 * patterns.window)
    starts, ends = [], []
    for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
        while b - a > chunk:
            starts.append(a)
            ends.append(a + chunk)
            a += chunk - patterns.window + 1
        starts.append(a)
        ends.append(b)
    size, k0 = 0, 0
    for k in range(len(starts) + 1):
        if k == len(starts) or size >= BLOCK:
            if k > k0:
                yield from _in_block(ids, np.array(starts[k0:k]), np.array(ends[k0:k]), patterns)
            size, k0 = 0, k
        if k < len(starts):
            size += ends[k] - starts[k] + 1


def _in_block(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, patterns: Patterns):
    index = FMIndex([ids[a:b] for a, b in zip(starts, ends, strict=True)])
    at = np.concatenate(([0], np.cumsum(ends - starts + 1)))[:-1]
    for n, table, number in patterns.groups:
        which, lo, hi = index.search(table)
        if len(which):
            count = hi - lo
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            where = index.locate(rows)
            chunk = np.searchsorted(at, where, "right") - 1
            yield where - at[chunk] + starts[chunk], np.repeat(number[which], count), n


def scan(texts: list[bytes | None], patterns: Patterns) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """Of each text: number of words, merged spans of hit words [from, to), numbers of the items found."""
    get = patterns.vocabulary.get
    ids, lengths = [], []
    for t in texts:
        w = words(t)
        lengths.append(len(w))
        ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        ids.append(np.zeros(1, np.int32))
    line = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    start = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64) + 1)))
    out: list[tuple[int, list[tuple[int, int]], list[int]]] = [(n, [], []) for n in lengths]
    delta = np.zeros(len(line) + 1, np.int32)
    pairs = []
    for where, number, n in occurrences(line, patterns):
        np.add.at(delta, where, 1)
        np.add.at(delta, where + n, -1)
        pairs.append(np.unique(np.stack((np.searchsorted(start, where, "right") - 1, number)), axis=1))
    if pairs:
        covered = (np.cumsum(delta[:-1]) > 0).astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
        doc = np.searchsorted(start, edge[0::2], "right") - 1
        for d, a, b in zip(doc.tolist(), edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            out[d][1].append((a - int(start[d]), b - int(start[d])))
        found: dict[int, set[int]] = {}
        for d, w in np.concatenate(pairs, axis=1).T.tolist():
            found.setdefault(d, set()).update(patterns.of[w])
        for d, items in found.items():
            out[d][2].extend(items)
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = ("n_words", "spans", "item_ids")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, benchmark_mb: float = BENCHMARK_MB) -> DataFrame:
    """docs with n_words, spans (word ranges [start, end) inside occurrences of windows) and item_ids (sorted strings).

    Columns of docs with these names are replaced.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    k, given = out.columns.index(text_col), out.columns
    parts = _parts(benchmark, item_col, item_text_col, window, benchmark_mb)
    return _scanned(out.toDF(*(f"c{i}" for i in range(len(given)))), k, *parts).toDF(*given, *ADDED)


def _scanned(docs: DataFrame, k: int, n_parts: int, held) -> DataFrame:
    """docs with ADDED of all parts of the benchmark. After every CHAIN of them the rows are written and the parts given up, so that a task has as many at most."""
    spark, given = docs.sparkSession, docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    out, used = docs, []
    for part in range(n_parts):
        if len(used) == CHAIN:
            out = written(out, "spans")
            for sent in used:
                sent.destroy()
            used = []
        used.append(held(spark, part))
        out = out.mapInArrow(_scanner(used[-1], k, len(given)), schema)
    return out


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, benchmark_mb: float):
    """(number of parts, held): held(spark, part) sends the windows of a part, about benchmark_mb of text, to every executor."""
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 50), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(size) // int(benchmark_mb * 1_000_000)))

    def held(spark, part: int) -> Shared:
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        return Shared(spark, Patterns([(r["id"], bytes(r["text"])) for r in mine.collect()], window))

    return parts, held


def _scanner(held, k: int, n_given: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = held.value
        for batch in batches:
            column = batch.column(k).cast(pa.binary())
            for at, n in slices(column, SHARD_BYTES):
                part = batch.slice(at, n)
                found = scan(column.slice(at, n).to_pylist(), patterns)
                spans = [s for _, s, _ in found]
                items = [{patterns.ids[i] for i in x} - {None} for _, _, x in found]
                if batch.num_columns > n_given:  # an earlier pass over other items
                    spans = [merged([*s, *((y["start"], y["end"]) for y in old)]) for s, old in zip(spans, part.column(n_given + 1).to_pylist(), strict=True)]
                    items = [x | set(old) for x, old in zip(items, part.column(n_given + 2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(n_given)),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=[*part.schema.names[:n_given], *ADDED],
                )

    return run


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the words of spans; what separates words stays, but for that inside a span."""
    ends = [m.span() for m in _WORD.finditer(raw.translate(WORDS))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*out, raw[at:]])


def clean(texts: list[bytes | None], patterns: Patterns) -> list[tuple[bytes | None, bool]]:
    """Each text without its hit words, and whether words are left (or there were none). Cut until nothing is found any more."""
    out, todo = [(t, True) for t in texts], list(range(len(texts)))
    while todo:
        again = []
        for i, (n, spans, _) in zip(todo, scan([out[i][0] for i in todo], patterns), strict=True):
            if spans:
                out[i] = (cut(out[i][0], spans), sum(b - a for a, b in spans) < n)
                again.append(i)
        todo = again
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, benchmark_mb: float = BENCHMARK_MB) -> DataFrame:
    """docs with the contaminated words cut from their texts, same columns. A document of which no word is left goes.

    Where a cut brings words together that form a window, they are cut too.
    """
    k, schema, given = docs.columns.index(text_col), docs.schema, docs.columns
    n_parts, held = _parts(benchmark, item_col, item_text_col, window, benchmark_mb)
    if n_parts == 1:
        return docs.mapInArrow(_cleaner(held(docs.sparkSession, 0), k), schema)
    # several parts: the spans of all on the same text, their union cut, and again on the documents that were cut
    todo = docs.toDF(*(f"c{i}" for i in range(len(given))))
    fields = todo.schema.fields
    out = None
    while True:
        done = written(_scanned(todo, k, n_parts, held).mapInArrow(_cutter(k, len(given)), T.StructType([*fields, T.StructField("cut", T.BooleanType())])), "decontaminated")
        rest = done.where(~F.col("cut")).drop("cut")
        out = rest if out is None else out.unionAll(rest)
        todo = done.where("cut").drop("cut")
        if todo.isEmpty():
            return out.toDF(*given)


def _cutter(k: int, n_given: int):
    """Cuts the spans that _scanner has found; cut: whether there were any. A document of which no word is left goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, spans = batch.column(k).cast(pa.binary()).to_pylist(), batch.column(n_given).to_pylist(), batch.column(n_given + 1).to_pylist()
            spans = [[(y["start"], y["end"]) for y in x] for x in spans]
            columns = list(batch.columns[:n_given])
            texts = [cut(t, x) if x else t for t, x in zip(texts, spans, strict=True)]
            columns[k] = pa.array([None if t is None else t.decode() for t in texts], pa.string()).cast(batch.column(k).type)
            left = [not x or sum(b - a for a, b in x) < n for x, n in zip(spans, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x) for x in spans], pa.bool_())], names=[*batch.schema.names[:n_given], "cut"]).filter(pa.array(left, pa.bool_()))

    return run


def _cleaner(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = held.value
        for batch in batches:
            column = batch.column(k).cast(pa.binary())
            for at, n in slices(column, SHARD_BYTES):
                texts = clean(column.slice(at, n).to_pylist(), patterns)
                part = batch.slice(at, n)
                columns = list(part.columns)
                columns[k] = pa.array([None if t is None else t.decode() for t, _ in texts], pa.string()).cast(batch.column(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([left for _, left in texts], pa.bool_()))

    return run


def op6_decontamination(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP6_SQL = r"""
with d as (select row_number() over () as row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as v from benchmark where text is not null),
v as (select item_id, v, least(10, len(v)) as n from b where len(v) > 0),
g as (select distinct item_id, n, array_to_string(v[i:i + n - 1], ' ') as gram from (select *, unnest(generate_series(1, len(v) - n + 1)) as i from v)),
s as (select row, n, i, array_to_string(w[i:i + n - 1], ' ') as gram from (select row, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from g) where len(w) >= n)),
h as (select distinct row, s.n, i, item_id from s join g on s.n = g.n and s.gram = g.gram),
hit as (select row, count(distinct p) as n_hit from (select row, unnest(generate_series(i, i + n - 1)) as p from h) group by 1),
items as (select row, list_sort(list(distinct item_id)) as ids from h where item_id is not null group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (row) left join items using (row)
"""


def brute_force(texts: list[bytes | None], items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text, by looking at every place."""
    rows = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(window, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
                    ids.add(i)
        ids.discard(None)
        rows.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return rows
