"""Line dedup by winnowing over line hashes, and over hashes of words for passages that begin or end inside a line.

A document is its sequence of lines that are not blank; a line is its sequence of words (runs without ASCII white space). A repeated run is MIN_LINES
consecutive lines or more that stand, in the same order, at an earlier place; a repeated passage is MIN_WORDS consecutive words or more that do, wherever
lines break. Places are ordered by (id, text hash, position). What lies in a repeated run or passage is deleted; inside one document the earlier place
itself stays. So every line of a run of MIN_LINES lines goes, and no line that only repeats by itself.

Fingerprints. Of the line hashes in every window of MIN_LINES lines the smallest (the last of equal ones) is selected, so all occurrences of a run select the
same line of it. Of the hashes of every PART consecutive words the smallest in each window of MIN_WORDS words is selected likewise. A fingerprint
goes with the hash of its surroundings: for lines the window, for words the stretch that the windows make up in which it is the smallest.

Join. Of places with equal fingerprint and surroundings, all but the first repeat that one over the whole stretch: one comparison, however many there
are. Only where a part of words has several surroundings are their first places extended both ways: every window around each is hashed from the text and
held against the first that has the same hash. The windows of neighbouring fingerprints overlap, so matches grow as long as texts agree.

No pair of documents is made. Each batch of a task settles its own repeats and sends on only the first place of each key, so a key of a third
of all documents crosses the network once a batch. Fingerprints that a SAMPLE-th of the texts shows to be frequent are dealt over SALTS tasks; that decides
where rows are compared, not what is found. The sort of each task spills; its pass over the sorted rows holds one row.

Hashes of 64 bits are always compared in twos (fingerprint and surroundings, fingerprint and window, id and text hash).

Defined cases: null and empty texts have no lines and stay as they are; a null id stands before all others; rows that repeat id and text are one document
and get the same result; a document whose lines all go keeps an empty text; blank lines stay but inside a deleted run; a line of which words stay keeps these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read, sifted, written
from .hashing import BASE, FACTOR, STEP, Stretches, mix, word_hashes

MIN_LINES, MIN_WORDS, PART = 2, 50, 16
#: Bytes of texts that are hashed at once.
CHUNK = 1 << 20
SAMPLE, HOT, HOT_ROWS, SALTS = 16, 512, 64, 64

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Matches once in each line that is not blank.
SOLID = r"[^\x20\x09-\x0D][^\n]*"


class Hashed:
    """The words of texts, one after the other, with hashes of any stretch of them."""

    def __init__(self, texts: list[bytes | None]):
        texts = [x or b"" for x in texts]
        t = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        h, first, _ = word_hashes(t, (t == 32) | (t - np.uint8(9) <= 4))
        line = np.searchsorted(np.flatnonzero(t == 10), first)
        #: first word of each text, and the number of words; the text of each word
        self.texts = np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in texts)]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.texts))
        #: first word of each line that is not blank, and the number of words; the text of each line
        self.starts = np.concatenate((np.flatnonzero(np.diff(line, prepend=-1)), [len(h)]))
        self.line_text = self.text[self.starts[:-1]]
        self.of = Stretches(h).of

    def lines(self) -> np.ndarray:
        return self.of(self.starts[:-1], self.starts[1:])


def line_run(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the lines [first, last] by the lines' hashes: where lines break counts."""
    out = np.zeros(len(first), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        inside = first + k <= last
        out = np.where(inside, mix(out * STEP + h[np.minimum(first + k, len(h) - 1)] + BASE), out)
    return out


def selected(h: np.ndarray, width: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: (place of the smallest, the last of equal ones, first window, last window) of each run of windows with the same smallest.

    Only windows that are whole (lie in one text) count.
    """
    window = np.flatnonzero(whole)
    if not len(window):
        return window, window, window
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    at = (np.arange(len(view)) + width - 1 - view[:, ::-1].argmin(axis=1))[window]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
    return at[new], window[new], window[np.concatenate((new[1:], [len(at)])) - 1]


def _inside(of: np.ndarray, width: int) -> np.ndarray:
    """Whether the first and the last of every `width` belong to the same text."""
    return of[: max(0, len(of) - width + 1)] == of[width - 1 :]


def packed(lo: np.ndarray, hi: np.ndarray, fixed) -> np.ndarray:
    """A place in one number, which orders places of a text: first word, number of words, whether it is one window (or else every MIN_WORDS words are)."""
    return (lo << 32) | ((hi - lo) << 1) | fixed


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, whether it is one window)."""
    lo = at >> 32
    return lo, lo + ((at & 0xFFFFFFFF) >> 1), (at & 1).astype(bool)


def marks(x: Hashed) -> tuple[np.ndarray, ...]:
    """(text, fingerprint, hash of the surroundings, place) of the fingerprints of texts."""
    h = x.lines()
    at, first, last = selected(h, MIN_LINES, _inside(x.line_text, MIN_LINES))
    times = last - first + 1
    which = np.repeat(first - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
    lines = (x.line_text[which], h[np.repeat(at, times)] ^ FACTOR, line_run(h, which, which + MIN_LINES - 1), packed(x.starts[which], x.starts[which + MIN_LINES], 1))
    i = np.arange(max(0, len(x.text) - PART + 1))
    h = x.of(i, i + PART)
    at, first, last = selected(h, MIN_WORDS - PART + 1, _inside(x.text, MIN_WORDS))
    words = (x.text[first], h[at], x.of(first, last + MIN_WORDS) ^ (at - first).astype(np.uint64), packed(first, last + MIN_WORDS, 0))
    of, fp, around, at = (np.concatenate(c) for c in zip(lines, words, strict=True))
    return of, fp, around, at - (x.texts[of] << 32)


def windows(x: Hashed, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in at, hash, place) of each window of MIN_WORDS words in places of a single text."""
    lo, hi, _ = unpacked(at)
    times = hi - lo - MIN_WORDS + 1
    first = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
    return np.repeat(np.arange(len(at)), times), x.of(first, first + MIN_WORDS), packed(first, first + MIN_WORDS, 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def delete_words(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """(text without the words in spans, lines of which no word is left). Such lines go, with the blank lines between two of them."""
    gone = {i for a, b in merged(spans) for i in range(a, b)}
    lines, at = [], 0
    for x in text.split("\n"):
        words = [m.span() for m in _WORD.finditer(x)]
        stay = [j for j in range(len(words)) if at + j not in gone]
        if words and stay and len(stay) < len(words):
            # a word stays with the white space before it, the first of the line with the line's
            x = x[: words[0][0]] + x[words[stay[0]][0] : words[stay[0]][1]] + "".join(x[words[j - 1][1] : words[j][1]] for j in stay[1:]) + x[words[-1][1] :]
        lines.append((x, None if not words else bool(stay)))
        at += len(words)
    kept, blank, went, inside = [], [], 0, False
    for x, stays in lines:
        if stays is None:
            blank.append(x)
            continue
        if stays or not inside:
            kept += blank
        blank = []
        if stays:
            kept.append(x)
        went += not stays
        inside = not stays
    return "\n".join([*kept, *blank]), went


PLACE = "fp long, around long, at long, done boolean, id {kind}, tx long"


def _later(new_key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, what they repeat) for sorted places: all but the first of each key; of a place that overlaps the first, what the first's first window leaves."""
    first = np.maximum.accumulate(np.where(new_key, np.arange(len(at)), 0))
    same = doc == doc[first]
    rows = np.flatnonzero(~same | (at != at[first]))
    lo, hi, fixed = unpacked(at)
    head = np.where(fixed, hi, lo + MIN_WORDS)[first]
    lo = np.where(same, np.maximum(lo, head), lo)[rows]
    keep = lo < hi[rows]
    return rows[keep], packed(lo[keep], hi[rows][keep], 0)


def _combined(b: pa.RecordBatch, doc: np.ndarray, fp: np.ndarray, around: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """PLACE rows of places in the rows `doc` of b (id, tx, ...): the first of each key, and what the others repeat (done)."""
    order = pa.compute.sort_indices(b.select([0, 1]), sort_keys=[(b.schema.names[0], "ascending"), (b.schema.names[1], "ascending")], null_placement="at_start").to_numpy()
    # rows that repeat id and text are one document
    code = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[order]
    tx = b.column(1).to_numpy()[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.concatenate(([0], (code[1:] != code[:-1]) | (tx[1:] != tx[:-1])))) if len(order) else 0
    at_row, doc = doc, number[doc]
    order = np.lexsort((at, doc, around, fp))
    doc, fp, around, at, at_row = (c[order] for c in (doc, fp, around, at, at_row))
    new = np.concatenate(([True], (fp[1:] != fp[:-1]) | (around[1:] != around[:-1]))) if len(fp) else np.zeros(0, bool)
    rows, spans = _later(new, doc, at)
    first = np.flatnonzero(new)
    of = pa.array(at_row[np.concatenate((first, rows))])
    column = lambda c, none: pa.array(np.concatenate((c[first].view(np.int64), np.full(len(rows), none))))
    return pa.RecordBatch.from_arrays(
        [column(fp, 0), column(around, 0), pa.array(np.concatenate((at[first], spans))), pa.array(np.arange(len(first) + len(rows)) >= len(first)), b.column(0).take(of), b.column(1).take(of)],
        names=["fp", "around", "at", "done", "id", "tx"],
    )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tx, text) to PLACE rows."""
    for b in batches:
        texts, found, some, held = b.column(2).to_pylist(), [], 0, 0
        for k, text in enumerate(texts):
            held += len(text) + 1
            if held >= CHUNK or k == len(texts) - 1:
                of, *columns = marks(Hashed(texts[some : k + 1]))
                found.append((of + some, *columns))
                some, held = k + 1, 0
        if found:
            yield _combined(b, *(np.concatenate(c) for c in zip(*found, strict=True)))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tx, text, fps, ats) to PLACE rows for the windows around these places."""
    for b in batches:
        found = []
        for k, (text, fp, at) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
            which, h, place = windows(Hashed([text]), np.array(at))
            found.append((np.full(len(h), k), np.array(fp).view(np.uint64)[which], h, place))
        if found:
            yield _combined(b, *(np.concatenate(c) for c in zip(*found, strict=True)))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted PLACE rows, with `hot`, to (fp, at, id, tx): what is repeated (no fp), and the first places of fingerprints that have several surroundings.

    What is held from batch to batch: the first place of the last key, and whether it has been returned.
    """
    held, told = None, False
    for b in batches:
        done = b.column(3).to_numpy(zero_copy_only=False)
        out = lambda rows, fp, at, source: pa.RecordBatch.from_arrays([fp, pa.array(at), source.column(4).take(pa.array(rows)), source.column(5).take(pa.array(rows))], names=["fp", "at", "id", "tx"])
        rows = np.flatnonzero(done)
        if len(rows):
            yield out(rows, pa.nulls(len(rows), pa.int64()), b.column(2).to_numpy()[rows], b)
        b = b.filter(pa.array(~done))
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        fp, around, at, tx = (b.column(k).to_numpy() for k in (0, 1, 2, 5))
        hot = b.column(6).to_numpy(zero_copy_only=False)
        code = b.column(4).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new_fp = np.concatenate(([True], fp[1:] != fp[:-1]))
        new_key = new_fp | np.concatenate(([True], around[1:] != around[:-1]))
        doc = np.cumsum(new_key | np.concatenate(([True], (code[1:] != code[:-1]) | (tx[1:] != tx[:-1]))))
        rows, spans = _later(new_key, doc, at)
        yield out(rows, pa.nulls(len(rows), pa.int64()), spans, b)
        group = np.cumsum(new_fp) - 1
        several = (np.bincount(group[new_key])[group] > 1) | hot
        heads = new_key & several & ((at & 1) == 0)
        if told:
            heads[0] = False
        rows = np.flatnonzero(heads)
        yield out(rows, b.column(0).take(pa.array(rows)), at[rows], b)
        last = int(np.flatnonzero(new_key)[-1])
        told = bool(heads[last]) or (last == 0 and told)
        held = b.slice(last, 1)


def _settle(places: DataFrame, keys: list[str], kind: str, label: str, hot: DataFrame | None = None) -> DataFrame:
    if hot is None:
        places = places.withColumn("hot", F.lit(False))
    else:
        places = places.join(F.broadcast(hot), "fp", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(F.col("hot"), F.pmod("around", F.lit(SALTS))).otherwise(0)
    dealt = places.select("fp", "around", "at", "done", "id", "tx", "hot").repartition(n, F.when(F.col("done"), F.xxhash64("id", "tx")).otherwise(F.xxhash64(*keys, salt)))
    ordered = dealt.sortWithinPartitions("done", "fp", "around", F.col("id").asc_nulls_first(), "tx", "at")
    return written(ordered.mapInArrow(_settled, f"fp long, at long, id {kind}, tx long"), label)


def repeated_spans(source: DataFrame) -> DataFrame:
    """(id, tx, spans) of the rows of source (id, tx, text) that repeat something: packed places, words from the start of the text."""
    kind = source.schema["id"].dataType.simpleString()
    schema = PLACE.format(kind=kind)
    some = source.where(F.pmod("tx", F.lit(SAMPLE)) == 0).mapInArrow(_described, schema).where("not done").groupBy("fp").agg(F.count("*").alias("n"))
    some = written(some.where(f"n > {HOT_ROWS}"), "line-frequent")
    # fewer than HOT: frequent ones in order of how frequent
    hot = some.orderBy(F.desc("n"), "fp").limit(HOT).select("fp", F.lit(True).alias("hot"))
    found = _settle(source.mapInArrow(_described, schema), ["fp"], kind, "line-places", hot)

    heads = found.where("fp is not null").groupBy("id", "tx").agg(F.collect_list(F.struct("fp", "at")).alias("h"))
    heads = written(heads.select(F.col("id").alias("i"), F.col("tx").alias("x"), "h.fp", "h.at"), "line-heads")
    near, _ = sifted(source, F.col("tx"), heads, F.col("x"))
    near = near.join(heads, (F.col("tx") == F.col("x")) & F.col("id").eqNullSafe(F.col("i"))).select("id", "tx", "text", "fp", "at")
    wide = _settle(near.mapInArrow(_extended, schema), ["fp", "around"], kind, "line-windows")
    spans = found.where("fp is null").select("id", "tx", "at").unionByName(wide.select("id", "tx", "at"))
    return written(spans.groupBy("id", "tx").agg(F.collect_set("at").alias("spans")), "line-spans")


ADDED = ("n_lines", "n_removed", "clean_text")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines (not blank), n_removed and clean_text. Columns of these names are replaced.

    Texts of which nothing goes take no part in the last join.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    names, tx = docs.columns, F.xxhash64(text_col)
    source = docs.select(F.col(id_col).alias("id"), tx.alias("tx"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    spans = repeated_spans(source)
    n_lines = F.coalesce(F.regexp_count(text_col, F.lit(SOLID)), F.lit(0)).cast("long").alias(ADDED[0])
    changed, same = sifted(docs, tx, spans, F.col("tx"))
    i, x, r = fresh(docs, "line_id", "line_tx", "line_spans")
    spans = spans.select(F.col("id").alias(i), F.col("tx").alias(x), F.col("spans").alias(r))
    joined = changed.join(spans, (tx == F.col(x)) & F.col(id_col).eqNullSafe(F.col(i)), "left").select(*names, n_lines, r)
    k = names.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for text, at in zip(b.column(k).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                lo, hi, _ = unpacked(np.array(at or [], np.int64))
                done.append(delete_words(text, list(zip(lo.tolist(), hi.tolist(), strict=True))) if at else (text, 0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([n for _, n in done], pa.int64()), pa.array([s for s, _ in done], pa.string())], names=[*b.schema.names[:-1], *ADDED[1:]])

    schema = T.StructType([*docs.schema.fields, T.StructField(ADDED[0], T.LongType()), T.StructField(ADDED[1], T.LongType()), T.StructField(ADDED[2], T.StringType())])
    return joined.mapInArrow(cleaned, schema).unionByName(same.select(*names, n_lines, F.lit(0).cast("long").alias(ADDED[1]), F.col(text_col).alias(ADDED[2])))


def op1_line_dedup(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("clean_text").cast("long").alias("n_chars"), F.sha2("clean_text", 256).alias("text_sha256"))


OP1_SQL = r"""
with l as (
  select doc_id, ord, lines[ord] as line, regexp_extract_all(lines[ord], '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') as pieces, regexp_extract_all(lines[ord], '[^\x20\x09-\x0D]+') as words
  from (select doc_id, lines, unnest(generate_series(1, len(lines))) as ord from (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null))),
s as (select *, coalesce(sum(len(words)) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as off,
  lead(words) over (partition by doc_id order by ord) as following from l where len(words) > 0),
flat as (select doc_id, flatten(list(words order by ord)) as words from s group by doc_id),
win as (
  select 'l' || array_to_string(words, ' ') || chr(10) || array_to_string(following, ' ') as what, doc_id, off as lo, off + len(words) + len(following) as hi from s where following is not null
  union all
  select 'w' || array_to_string(words[i + 1:i + 50], ' '), doc_id, i, i + 50 from (select doc_id, words, unnest(range(0, len(words) - 49)) as i from flat where len(words) >= 50)),
met as (select doc_id, lo, hi, first_value(doc_id) over w as f_doc, first_value(lo) over w as f_lo, first_value(hi) over w as f_hi
  from win window w as (partition by what order by doc_id nulls first, lo rows between unbounded preceding and current row)),
gone as (select distinct doc_id, unnest(range(cast(case when doc_id is not distinct from f_doc then greatest(lo, f_hi) else lo end as bigint), cast(hi as bigint))) as i
  from met where doc_id is distinct from f_doc or lo <> f_lo),
p as (select s.doc_id, s.ord, j, pieces[j] as piece, gone.i is null as stays from (select *, unnest(generate_series(1, len(pieces))) as j from s) s
  left join gone on s.doc_id is not distinct from gone.doc_id and s.off + j - 1 = gone.i),
kept as (select doc_id, ord, count(*) filter (stays) as n_stay, string_agg(piece, '' order by j) filter (stays) as rest from p group by doc_id, ord),
o as (select l.doc_id, l.ord, len(l.words) > 0 as solid, coalesce(n_stay, 0) as n_stay,
    case when len(l.words) in (0, n_stay) then line else regexp_extract(line, '^[\x20\x09-\x0D]*') || regexp_replace(rest, '^[\x20\x09-\x0D]+', '') || regexp_extract(line, '[\x20\x09-\x0D]*$') end as line
  from l left join kept on l.doc_id is not distinct from kept.doc_id and l.ord = kept.ord),
b as (select *, last_value(case when solid then n_stay end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as before,
  first_value(case when solid then n_stay end ignore nulls) over (partition by doc_id order by ord rows between 1 following and unbounded following) as after from o),
c as (select doc_id, count(*) filter (solid) as n_lines, count(*) filter (solid and n_stay = 0) as n_removed,
  coalesce(string_agg(line, chr(10) order by ord) filter (case when solid then n_stay > 0 else not coalesce(before = 0 and after = 0, false) end), '') as t from b group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, length(t) as n_chars, sha256(t) as text_sha256
from documents d left join c on d.doc_id is not distinct from c.doc_id
"""
