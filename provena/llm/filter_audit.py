"""Filter interaction audit: sorted duplicates, failure masks, additive counters per part.

Rows are range-partitioned by (fingerprint of the text, identifier) and sorted by (fingerprint, full text, identifier), so equal texts stand together and each row
is compared with its predecessor: a row whose predecessor has the same text and a smaller identifier is a copy. A group of copies, however large, is dealt over
as many ranges as its rows fill. Each range reports the texts of its last fingerprint with their smallest identifier (one row a range, but for collisions
of 64-bit fingerprints), which settles the rows of the next ranges' first fingerprint. The other filters depend on the text alone and run once
a group. A row's failures are a mask; masks are counted per part, and every order of the filters is worked out from these counters, at most 32 a part
for five filters.

Defined cases: a null text is the empty one; a null part is the empty string; a null identifier is larger than any other; rows that repeat an identifier and a
text are no copies of each other (they are combined in batches before the exchange); a row labelled twice counts as good or
toxic if one of its labels says so; null identifiers have no labels; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, written

LETTERS = "ABCDE"
_UPPER, _MARKS, _CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: few words, few different words, many capitals, marks."""
    words = text.split()  # bytes split at ASCII white space
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * len(text.translate(None, _CONTINUED))) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, text, id, part, n): rows of a batch that agree in all as one."""
    for b in batches:
        place: dict = {}  # the kept rows of each fingerprint, identifier and part; their texts are looked at where there are several
        keep, n = [], []
        whole = b.column("text")
        for i, k in enumerate(zip(*(b.column(c).to_pylist() for c in ("fp", "id", "part")), strict=True)):
            mine = place.setdefault(k, [])
            at = next((j for j in mine if whole[keep[j]].equals(whole[i])), None)
            if at is None:
                at = len(keep)
                mine.append(at)
                keep.append(i)
                n.append(0)
            n[at] += 1
        if len(keep) < b.num_rows:
            b = b.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n"])


def _compared(batches: Iterator[pa.RecordBatch], failures: Callable[[bytes], int], copy_bit: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, mask, n, fp, sha, last) of one sorted range. fp and sha are set on rows of the first fingerprint, which earlier ranges may hold too.

    At the end one row (last) for each text of the last fingerprint, with its smallest identifier.
    """
    start = now = text = sha = head = None
    mask, texts = 0, []  # texts: (sha, smallest id) of those with the present fingerprint, but for the present one

    def digest() -> bytes:
        return hashlib.sha256(text).digest()

    def rows(ids, parts, masks, n, fps, shas, last: bool) -> pa.RecordBatch:
        columns = [pa.array(ids, id_type), pa.array(parts, pa.string()), pa.array(masks, pa.int32()), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(shas, pa.binary()), pa.array([last] * len(ids), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "part", "mask", "n", "fp", "sha", "last"])

    for b in batches:
        whole, ids = b.column("text"), b.column("id").to_pylist()
        masks, fps, shas = [], [], []
        for i, fp in enumerate(b.column("fp").to_pylist()):
            t = whole[i].as_py()
            if fp != now or t != text:
                if fp != now:
                    texts = []
                    start = fp if now is None else start
                else:
                    texts.append((sha or digest(), head))
                now, text, head, mask, sha = fp, t, ids[i], failures(t), None
            if fp == start:
                sha = sha or digest()
            later = ids[i] != head  # sorted, so not smaller
            masks.append(mask | copy_bit if later else mask)
            fps.append(fp if fp == start else None)
            shas.append(sha if fp == start else None)
        yield rows(ids, b.column("part"), masks, b.column("n"), fps, shas, False)
    if now is not None:
        texts.append((sha or digest(), head))
        k = len(texts)
        yield rows([x for _, x in texts], [None] * k, [0] * k, [0] * k, [now] * k, [s for s, _ in texts], True)


def failure_masks(docs: DataFrame, failures: Callable[[bytes], int], copy_bit: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, n): n rows of docs with this identifier and part fail the filters whose bits are set.

    failures(text) gives the bits of the filters on texts; copy_bit is set where a smaller identifier has the same text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fp"), text.cast("binary").alias("text"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])
    order = ["fp", "text", F.col("id").asc_nulls_last()]
    placed = rows.mapInArrow(_combined, schema).repartitionByRange("fp", F.col("id").asc_nulls_last()).sortWithinPartitions(*order)
    kind = pa.int64() if isinstance(rows.schema["id"].dataType, T.LongType) else pa.int32() if isinstance(rows.schema["id"].dataType, T.IntegerType) else pa.string()
    out = T.StructType([rows.schema["id"], *T.StructType.fromDDL("part string, mask int, n long, fp long, sha binary, last boolean").fields])
    seen = written(placed.mapInArrow(lambda b: _compared(b, failures, copy_bit, kind), out), "audit-masks")
    # one row a range, and one more for each collision of fingerprints at its end
    heads = seen.where("last").groupBy(F.col("fp").alias("head_fp"), F.col("sha").alias("head_sha")).agg(F.min("id").alias("head"))
    joined = seen.where("not last").join(F.broadcast(heads), (F.col("fp") == F.col("head_fp")) & (F.col("sha") == F.col("head_sha")), "left")
    copied = F.col("head").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("head")))
    return joined.select("id", "part", F.when(copied, F.col("mask").bitwiseOR(F.lit(copy_bit))).otherwise(F.col("mask")).alias("mask"), "n")


def part_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, masks: array of (mask, n, good, toxic)): how many rows of a part have just these failures, and how many of them are labelled.

    Rows are counted by identifier, part and mask before they meet the labels, so an identifier that repeats meets them once a part and mask.
    """
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = masks.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    known = counted.where("id is not null").join(marked, F.col("id") == F.col("label_id"), "left").select("part", "mask", "n", "good", "toxic")
    none = F.lit(None).cast("int")
    rows = known.unionByName(counted.where("id is null").select("part", "mask", "n", none.alias("good"), none.alias("toxic")))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic")).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


def interactions(counters: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step. letters: one per filter, by bit."""
    orders = ["".join(p) for p in permutations(letters)]
    rows = counters.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda found: sum((F.when(found(x), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(letters)), F.lit(0))
    rows = rows.withColumn("own", bits(lambda x: letter == x)).withColumn("earlier", bits(lambda x: F.instr(before, x) > 0))

    def total(of: Callable[[Column], Column], where: Callable[[Column, Column, Column], Column], name: str) -> Column:
        add = lambda acc, m: acc + F.when(where(m["mask"], F.col("own"), F.col("earlier")), of(m)).otherwise(F.lit(0).cast("long"))
        return F.aggregate("masks", F.lit(0).cast("long"), add).alias(name)

    has = lambda m, bits: m.bitwiseAND(bits) != 0
    removed = lambda m, own, earlier: has(m, own) & ~has(m, earlier)
    # a row that fails k filters is removed by each of them in one k-th of all orders
    share = lambda m: m["n"] * F.element_at(F.lit([len(orders) // k for k in range(1, len(letters) + 1)]), F.bit_count(m["mask"]))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: m["n"], lambda m, own, earlier: ~has(m, own.bitwiseOR(earlier)), "kept"),
        total(lambda m: m["n"], removed, "removed"),
        total(lambda m: m["n"], lambda m, own, earlier: has(m, own) & has(m, earlier), "redundant"),
        total(lambda m: m["n"], lambda m, own, earlier: m == own, "unique_fails"),
        total(lambda m: m["good"], removed, "good_lost"),
        total(lambda m: m["toxic"], removed, "toxic_lost"),
        total(share, lambda m, own, earlier: has(m, own), "shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    masks = failure_masks(read(spark, sf_dir, "documents"), text_failures, 1 << 4)
    return interactions(part_counters(masks, read(spark, sf_dir, "labels")))


OP11_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select w.doc_id, part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) over (partition by t), min(w.doc_id) over (partition by t) is not null)} as s, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from w left join l on w.doc_id = l.doc_id),
u as (select *, (case when s['A'] then 'A' else '' end) || (case when s['B'] then 'B' else '' end) || (case when s['C'] then 'C' else '' end) || (case when s['D'] then 'D' else '' end) || (case when s['E'] then 'E' else '' end) as fails from f),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from u group by part, fails),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p as (select filter_order, step, filter_order[step] as own, filter_order[1:step - 1] as earlier from o, (select unnest(range(1, 6)) as step)),
g as (select c.*, filter_order, step, own, contains(fails, own) as here, len(translate(fails, earlier, '')) < len(fails) as gone from c, p)
select part, filter_order, cast(step as int) as step, cast(coalesce(sum(n) filter (not here and not gone), 0) as bigint) as kept, cast(coalesce(sum(n) filter (here and not gone), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (here and gone), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (fails = own), 0) as bigint) as unique_fails,
  cast(coalesce(sum(good) filter (here and not gone), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (here and not gone), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(sum(n) filter (here and not gone)) over (partition by part, own), 0) as bigint) as shapley
from g group by part, filter_order, step, own
"""
