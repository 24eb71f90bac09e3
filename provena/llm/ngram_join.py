"""N-gram Jaccard join by blocked products of the sparse document by n-gram incidence matrix.

A document's row is its set of hashed word n-grams. Rows that are equal are one class from the start (an exact copy meets nobody twice).

Which rows can link. Two sets of n1 and n2 grams with Jaccard similarity num / den or more differ in at most
H = (den - num) (n1 + n2) / (den + num) grams. Sizes fall into classes so that linked sets lie in one class or two neighbouring ones. For each
class the grams are dealt by hash into H + 1 + slack parts; of two linked sets some part is equal and not empty (a set that a deal leaves with too many
empty parts takes part in the next deal, too). Sets with an equal part are tied; a batch settles its own ties, so a frequent part leaves a task once a batch. Texts
that only share a passage seldom have an equal part, so the groups of tied sets stay about as small as the families of near copies are.

Contraction. Each set is first multiplied with the first and the last of the sets that it is tied to, in stars of BLOCK_ROWS rows. What links is joined, so a family
of near copies is sent twice and is one lane from then on. Groups that are a single lane are finished.

The products. In the other groups all pairs of lanes are multiplied: rows are dealt by hash into blocks, a lane of over half a block into blocks of its own, which need not
meet each other. First parity sketches, whose differing bits never outnumber the differing grams (a hundredth of the bytes, SKETCH_ROWS to a block): pairs
over the size-derived bound on differences are discarded, and what the rest connects are the groups of the second product, of the sets themselves (BLOCK_ROWS to
a block). One task multiplies two blocks, accumulating overlap counts: columns that few rows share pair by pair, others over column slices, and
stops as soon as no pair can reach its size-derived bound with the columns left. It returns a spanning forest of the pairs that link, so a block
of b rows gives fewer than b edges, never all its pairs. Every link between different sets is in the closure, so components come out whole.

Cost: a group of f rows that stay in lanes of their own (strangers, or near copies that differ too much from the sets they met) costs f^2 / SKETCH_ROWS^2 pairs of sketch
blocks, spread over tasks.

Defined cases: a null or empty text has no grams and links with nothing; a text of fewer words than n is one gram; rows with a null id
take part, and a component's name is its smallest id that is not null; repeated rows get the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, fresh, read, salted_join, sifted, slices, written
from .graph import components
from .hashing import BASE, FACTOR, mix, word_hashes

BLOCK_ROWS, SKETCH_ROWS, BLOCK_GRAMS, COLUMNS = 256, 1024, 2_000_000, 8192
#: Candidate rows (ten numbers each) up to this number are sent to every executor; beyond it they are joined by sort and merge.
BROADCAST_ROWS = 200_000
SEEN = 1_000_000
#: Texts of about this size are described at once.
BATCH_BYTES = 8 << 20
DEALS = 8
#: Columns that make up to this many pairs are accumulated pair by pair, others as slices of a matrix.
SPARSE, PAIRS = 64, 4_000_000

_WORDS = bytes(32 if b in b"\t\n\v\f\r " else b for b in LOWER)


def grams(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of word n-grams. Words: runs of bytes that are not ASCII white space, A-Z lower-cased."""
    t = np.frombuffer((text or b"").translate(_WORDS) + b" ", np.uint8)
    w, _, _ = word_hashes(t, t == 32)
    if not len(w):
        return np.zeros(0, np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h + w[i : len(w) - k + 1 + i]) * FACTOR
        h ^= h >> np.uint64(31)
    return np.unique(mix(h))


class Sizes:
    """Size classes for a threshold num / den: linked sets lie in one class or two neighbouring ones."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.least, self._parts = [1], {}
        while self.least[-1] < largest:
            self.least.append(self.least[-1] * den // num + 1)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.least, n, "right")) - 1

    def differ(self, c: int) -> int:
        """Most grams in which linked sets differ, the smaller of which is of class c."""
        n1 = self.least[c + 1] - 1
        return (self.den - self.num) * (n1 + n1 * self.den // self.num) // (self.den + self.num)

    def parts(self, c: int) -> tuple[int, int]:
        """(number of parts, slack) for class c; no parts where only equal sets link.

        The slack is over the number of empty parts that the smallest sets of the class are likely to have (three deviations) where that can be, so few sets exceed it.
        """
        h = self.differ(c)
        if not h:
            return 0, 0
        if c not in self._parts:
            # small sets leave many parts empty whatever their number: there the slack falls short by as little as can be
            short = lambda m: max(0.0, (e := m * math.exp(-self.least[c] / m)) + 3 * math.sqrt(e) - (m - h - 1))
            m = min(range(h + 2, h + h // 4 + 12), key=lambda m: (round(short(m), 2), m))
            self._parts[c] = (m, m - h - 1)
        return self._parts[c]


def signatures(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """What a set offers as ties: one number for each part that is not empty, for its class and the one below.

    A set that a deal leaves with too many empty parts offers those of the next deal, too. Linked sets have more than `slack` equal parts in every deal; in the
    first deal that suffices for one of them, which both offer, one of these is not empty. Only a set that DEALS deals fail offers its empty parts.
    """
    out, c = [], sizes.of(len(s))
    mixed = mix(s + BASE)
    for k in (c, c - 1):
        if k < 0 or not (m := sizes.parts(k))[0]:
            continue
        m, slack = m
        for deal in range(DEALS):
            part = ((s if not deal else mix(s + np.uint64(deal))) >> np.uint64(20)) % np.uint64(m)
            order = np.argsort(part.astype(np.uint16 if m < 1 << 16 else np.int64), kind="stable")
            ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=m))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed[order])))[np.concatenate(([0], ends))]
            total = total[1:] - total[:-1]
            empty = np.diff(np.concatenate(([0], ends))) == 0
            sig = mix(total + (np.arange(m, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64((deal << 16) + k + 1)) * FACTOR)
            enough = empty.sum() <= slack
            out.append(sig if not enough and deal == DEALS - 1 else sig[~empty])
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The size of a set and its parity sketch: bit j of the words that follow tells whether an odd number of grams hash to j.

    The bits by which two sketches differ are at most the grams by which the sets differ, whatever the hash does.
    """
    bits = 1024
    while bits * 3 < 2 * sizes.least[sizes.of(len(s)) + 1]:
        bits *= 2
    odd = np.bincount(((s * BASE) >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.concatenate((np.array([len(s)], np.uint64), np.packbits(odd.astype(np.uint8)).view(np.uint64)))


def close(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """As product(), of sketches: which pairs may link. Longer sketches are folded to the length of the shortest."""
    rows = left if right is None else left + right
    bits = min(len(r) - 1 for r in rows) * 64
    x = np.zeros((len(rows), bits), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.bitwise_xor.reduce(np.unpackbits(r[1:].view(np.uint8)).reshape(-1, bits), axis=0)
    n = np.array([int(r[0]) for r in rows], np.int64)
    a, b = (slice(None), slice(None)) if right is None else (slice(0, len(left)), slice(len(left), None))
    ones = x.sum(axis=1)
    differ = ones[a][:, None] + ones[b][None, :] - 2 * (x[a] @ x[b].T)
    may = differ <= (den - num) * (n[a][:, None] + n[b][None, :]) // (den + num)
    if right is None:
        np.fill_diagonal(may, False)
    return may


def product(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Which rows of left link with which of right (with each other where right is None): a matrix of booleans."""
    rows = left if right is None else left + right
    n = np.array([len(r) for r in rows], np.int64)
    cut = len(left)
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), n)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    of, column = of[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    a, b = (n, n) if right is None else (n[:cut], n[cut:])
    # the least overlap that links a pair
    need = -(-num * (a[:, None] + b[None, :]) // (den + num))
    top = int(column[-1]) + 1 if len(column) else 0
    mine = np.ones(len(of), bool) if right is None else of < cut
    yours = mine if right is None else ~mine
    here, there = np.bincount(column[mine], minlength=top), np.bincount(column[yours], minlength=top)
    sparse = here * there <= SPARSE
    overlap = _sparse(of[mine & sparse[column]], column[mine & sparse[column]], of[yours & sparse[column]], column[yours & sparse[column]], (len(a), len(b)), 0 if right is None else cut)
    dense = ~sparse[column]
    of, column = of[dense], (np.cumsum(~sparse) - 1)[column[dense]]
    left_over = np.bincount(of, minlength=len(rows))
    top = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, COLUMNS):
        ra, rb = (left_over, left_over) if right is None else (left_over[:cut], left_over[cut:])
        if not (overlap + np.minimum(ra[:, None], rb[None, :]) >= need).any():
            break
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        x = np.zeros((len(rows), min(COLUMNS, top - at)), np.float32)
        x[of[lo:hi], column[lo:hi] - at] = 1
        overlap += x @ x.T if right is None else x[:cut] @ x[cut:].T
        left_over = left_over - np.bincount(of[lo:hi], minlength=len(rows))
    linked = overlap >= need
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _sparse(of: np.ndarray, column: np.ndarray, of2: np.ndarray, column2: np.ndarray, shape: tuple[int, int], cut: int) -> np.ndarray:
    """Overlap counts from two lists of entries in order of their columns: each entry meets those of the other list in its column."""
    lo, hi = np.searchsorted(column2, column, "left"), np.searchsorted(column2, column, "right")
    ends = np.cumsum(hi - lo)
    out, at = np.zeros(shape[0] * shape[1], np.float32), 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        times = (hi - lo)[at:to]
        other = np.repeat(lo[at:to] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
        out += np.bincount(np.repeat(of[at:to], times) * shape[1] + of2[other] - cut, minlength=len(out))
        at = to
    return out.reshape(shape)


def forest(linked: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest; columns of a matrix that is not square are numbered after its rows."""
    if not square:
        n = linked.shape[0] + linked.shape[1]
        whole = np.zeros((n, n), bool)
        whole[: linked.shape[0], linked.shape[0] :] = linked
        linked = whole | whole.T
    out, new = [], np.ones(len(linked), bool)
    for i in np.flatnonzero(linked.any(axis=1)):
        if new[i]:
            new[i], stack = False, [i]
            while stack:
                k = stack.pop()
                found = np.flatnonzero(linked[k] & new)
                new[found] = False
                out += [(int(k), int(j)) for j in found]
                stack += found.tolist()
    return out


def _node(s: np.ndarray) -> int:
    """The identity of a set; 0 for the empty one."""
    h = xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0
    return h - (1 << 64) if h >> 63 else h


def _two(a: str, b: str, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=[a, b])


def ngram_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs: the size of its set, and the smallest id that links reach from it."""
    spark, sizes = docs.sparkSession, Sizes(num, den)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tx"), F.col(text_col).cast("binary").alias("text"))
    described = source.mapInArrow(lambda b: _described(b, n, sizes), f"id {kind}, tx long, node long, n long, sketch array<long>, sigs array<long>, ties array<long>")
    rows = written(described, "ngram-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    offers = rows.select(F.explode("sigs").alias("sig"), "node").repartition(parts, "sig").sortWithinPartitions("sig", "node")
    ties = written(offers.mapInArrow(_ties, "u long, v long").union(rows.select("node", F.explode("ties"))).distinct(), "ngram-ties")

    # one row stands for a class of equal sets
    classes = written(rows.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "tx")).alias("rep"), F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("rows")), "ngram-classes")

    def sets_of(wanted: DataFrame, columns: list[str]) -> DataFrame:
        """wanted (node, *columns) with the sets of its nodes."""
        wanted = written(wanted.join(classes.select("node", F.col("rep.id").alias("rep_id"), F.col("rep.tx").alias("rep_tx")), "node"), "ngram-wanted")
        schema = T.StructType([*wanted.select("node", *columns).schema.fields, T.StructField("grams", T.ArrayType(T.LongType()))])
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
            texts = source
        else:
            texts, _ = sifted(source, F.col("tx"), wanted, F.col("rep_tx"))
        texts = texts.join(wanted, (F.col("tx") == F.col("rep_tx")) & F.col("id").eqNullSafe(F.col("rep_id"))).select("node", *columns, "text")
        k = len(columns) + 1

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array([grams(t, n).view(np.int64) for t in b.column(k).to_pylist()], pa.list_(pa.int64()))], names=schema.names)

        return texts.mapInArrow(sets, schema)

    def multiplied(work: DataFrame, of) -> DataFrame:
        dealt = work.repartition(parts, "item").sortWithinPartitions("item", "node")
        return dealt.mapInArrow(lambda b: _products(b, of, num, den), "u long, v long").distinct()

    # contraction: each set meets the first and the last of the sets that it is tied to, in stars of BLOCK_ROWS
    to = ties.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("z")).select(F.col("u").alias("node"), F.explode(F.array_distinct(F.array("a", "z"))).alias("v"))
    stars = to.groupBy("v").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("chunks"))
    ray = lambda node, chunk, first: F.struct(F.concat_ws(":", node, chunk).alias("item"), F.lit(False).alias("square"), F.lit(first).alias("first"))
    heads = stars.select(F.col("v").alias("node"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: ray(F.col("v"), c, True)).alias("items"))
    # how a ray's chunk is drawn needs its star's size; a star that many rays go to is dealt over tasks
    rays = salted_join(to, stars.withColumn("rays", F.col("chunks") * BLOCK_ROWS), ["v"], "rays", 2 * ties.count()).select("node", F.array(ray(F.col("v"), F.pmod(F.xxhash64("node"), F.col("chunks")), False)).alias("items"))
    roles = heads.union(rays).groupBy("node").agg(F.flatten(F.collect_list("items")).alias("items"))
    links = written(multiplied(_items(sets_of(roles, ["items"]), "grams"), product), "ngram-links")
    joined = written(components(links, "ngram-links"), "ngram-joined")

    # groups inside which links can lie, and in them the rows that are not all joined yet
    groups = components(ties, "ngram-ties")
    member = written(groups.join(joined.withColumnRenamed("root", "lane"), "node", "left").select("node", "root", F.coalesce("lane", "node").alias("lane")), "ngram-groups")
    sketches = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    near = _placed(_open(member).join(sketches, "node"), sizes, SKETCH_ROWS)
    groups = components(multiplied(_items(near, "sketch"), close), "ngram-close")
    member = written(groups.join(member.select("node", "lane"), "node").select("node", "root", "lane"), "ngram-groups")
    placed = _placed(_open(member).join(classes.select("node", "n"), "node"), sizes, BLOCK_ROWS)
    more = multiplied(_items(sets_of(placed.select("node", "items"), ["items"]), "grams"), product)

    linked = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "ngram-links").join(classes.select("node", "least"), "node")
    name = linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("nodes"))
    named = salted_join(linked.select("node", "root"), name, ["root"], "nodes", linked.count()).select("node", "component")
    of_class = written(classes.select("node", "least", "rows").join(named, "node", "left").select("node", "rows", F.coalesce("component", "least").alias("component")), "ngram-components")
    whole = salted_join(rows.where("n > 0").select("id", "node", "n"), of_class, ["node"], "rows", rows.count())
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).union(rows.where("n = 0").select("id", "n", "id"))


def _described(batches: Iterator[pa.RecordBatch], n: int, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """(id, tx, text) to (id, tx, node, n, sketch, sigs, ties).

    A set that this task has met offers no ties, and of sets of a batch that share a signature the first offers it and the others are tied to that one: a
    signature of a third of all sets leaves a task once a batch.
    """
    seen: set[int] = set()
    lists = pa.list_(pa.int64())
    for b in (b.slice(at, k) for b in batches for at, k in slices(b.column(2), BATCH_BYTES)):
        sets = [grams(t, n) for t in b.column(2).to_pylist()]
        nodes = [_node(s) for s in sets]
        new, sigs = [], []
        for k, (s, h) in enumerate(zip(sets, nodes, strict=True)):
            if len(s) and h not in seen:
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(h)
                new.append(k)
                sigs.append(signatures(s, sizes))
        offered, tied = [None] * len(sets), [None] * len(sets)
        if new:
            flat, owner = np.concatenate(sigs), np.repeat(np.array(new), [len(x) for x in sigs])
            order = np.argsort(flat, kind="stable")
            first = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))[: len(order)]
            head = owner[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else owner
            mine = np.sort(order[first])
            for k, x in zip(new, np.split(flat[mine].view(np.int64), np.searchsorted(owner[mine], new[1:])), strict=True):
                offered[k] = x
            pairs = np.unique(np.stack((owner[order], head))[:, ~first], axis=1)
            for k, j in pairs.T.tolist():
                if k != j:
                    tied[k] = [*(tied[k] or ()), nodes[j]]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, sizes).view(np.int64) if len(s) else None for s in sets], lists), pa.array(offered, lists), pa.array(tied, lists)],
            names=["id", "tx", "node", "n", "sketch", "sigs", "ties"],
        )


def _open(member: DataFrame) -> DataFrame:
    """member (node, root, lane) of the groups (root) that are not of one lane. A lane is what links have joined."""
    lanes = member.groupBy("root").agg(F.min("lane").alias("a"), F.max("lane").alias("z"), F.count("*").alias("in_group"))
    return salted_join(member, lanes.where("a != z").select("root", "in_group"), ["root"], "in_group", member.count()).drop("in_group")


def _placed(member: DataFrame, sizes: Sizes, block_rows: int) -> DataFrame:
    """member (node, root, lane, n, ...) with items: the pairs of blocks that each row goes to.

    A group's rows are dealt into bins by size class. A lane of more than half a block has a bin of its own, as its rows need not meet each other; the other
    lanes share one. Bins of one class or of neighbouring ones meet. Rows that meet nobody are left out.
    """
    member = written(member.withColumn("class", _class_of(sizes, F.col("n"))), "ngram-members")
    total = member.count()
    lanes = member.groupBy("root", "class", "lane").agg(F.count("*").alias("in_lane")).withColumn("bin", F.when(F.col("in_lane") > block_rows // 2, F.col("lane")))
    binned = salted_join(member, lanes, ["root", "class", "lane"], "in_lane", total)
    bins = binned.groupBy("root", "class", "bin").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    bins = written(bins.withColumn("blocks", F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long")), "ngram-bins")
    other = bins.select(F.col("root").alias("r"), F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("near"), F.struct(F.col("class").alias("c"), F.col("bin").alias("l")).alias("o"), F.col("blocks").alias("b"), F.col("rows").alias("k"))
    itself = (F.col("o.c") == F.col("class")) & F.col("o.l").eqNullSafe(F.col("bin"))
    meets = F.when(itself, F.col("bin").isNull() & (F.col("k") > 1)).otherwise(F.col("bin").isNull() | F.col("o.l").isNull() | (F.col("bin") != F.col("o.l")))
    met = bins.join(other, (F.col("root") == F.col("r")) & (F.col("class") == F.col("near"))).where(meets)
    met = met.groupBy("root", "class", "bin").agg(F.first("rows").alias("in_bin"), F.first("blocks").alias("own"), F.collect_list(F.struct("o", "b")).alias("others"))
    met = met.withColumn("lone", F.col("bin").isNull()).withColumn("bin", F.coalesce("bin", F.lit(0)))
    out = salted_join(binned.drop("in_lane").withColumn("lone", F.col("bin").isNull()).withColumn("bin", F.coalesce("bin", F.lit(0))), met, ["root", "class", "lone", "bin"], "in_bin", total)
    name = lambda c, lane, block: F.concat_ws("/", c.cast("string"), F.coalesce(lane.cast("string"), F.lit("-")), block.cast("string"))
    me = name(F.col("class"), F.when(~F.col("lone"), F.col("bin")), F.pmod(F.xxhash64("node"), F.col("own")))

    def item(you):
        return F.struct(F.concat_ws(":", F.col("root"), F.least(me, you), F.greatest(me, you)).alias("item"), (me == you).alias("square"), (me <= you).alias("first"))

    items = F.flatten(F.transform("others", lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["b"] - 1), lambda j: item(name(x["o"]["c"], x["o"]["l"], j)))))
    return out.withColumn("items", items).drop("others", "own", "in_bin", "class", "bin", "lone", "lane")


def _items(kept: DataFrame, payload: str) -> DataFrame:
    return kept.select(F.explode("items").alias("x"), "node", payload).select("x.item", "x.square", "x.first", "node", payload)


def _class_of(sizes: Sizes, n):
    """The size class as an expression: the number of class bounds that n reaches."""
    bounds = F.array(*[F.lit(x).cast("long") for x in sizes.least])
    return (F.size(F.filter(bounds, lambda x: x <= n)) - 1).cast("long")


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first node) of each run of equal signatures; runs may cross batches."""
    sig, first = None, None
    for b in batches:
        s, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(s):
            continue
        new = np.concatenate(([s[0] != sig], s[1:] != s[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        head = np.where(at >= 0, v[np.maximum(at, 0)], first if first is not None else 0)
        other = head != v
        pair = np.unique(np.stack((v[other], head[other])), axis=1)
        sig, first = s[-1], head[-1]
        yield _two("u", "v", *pair)


def _products(batches: Iterator[pa.RecordBatch], of, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Forests of the items, from rows (item, square, first, node, ...) in order. An item's rows are bounded by two blocks; they may cross batches."""
    now, held, out = None, {}, []

    def finish() -> None:
        left = [(k, g) for k, (f, g) in held.items() if f]
        right = [(k, g) for k, (f, g) in held.items() if not f]
        names = [k for k, _ in left + right]
        if now[1] and len(left) > 1:
            found = forest(of([g for _, g in left], None, num, den), True)
        elif not now[1] and left and right:
            found = forest(of([g for _, g in left], [g for _, g in right], num, den), False)
        else:
            return
        out.extend((names[i], names[j]) for i, j in found)

    def edges() -> pa.RecordBatch:
        e = pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])
        out.clear()
        return e

    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        firsts, nodes = b.column(2).to_pylist(), b.column(3).to_pylist()
        flat, ends = b.column(4).values.to_numpy(zero_copy_only=False).view(np.uint64), b.column(4).offsets.to_numpy()
        for x, key in enumerate(keys):
            if key != now:
                if now is not None:
                    finish()
                now, held = key, {}
            held[nodes[x]] = (firsts[x], flat[ends[x] : ends[x + 1]].copy())
        if len(out) > 50_000:
            yield edges()
    if now is not None:
        finish()
    yield edges()


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies: the one with the smallest id. Same columns.

    Documents without words stay. Rows that repeat an id are one record and go or stay together; null ids stay.
    """
    (k,) = fresh(docs, "ngram_id")
    gone = ngram_components(docs, n, num, den, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(k)).distinct()
    return docs.join(gone, docs[id_col] == F.col(k), "left_anti")


def op2_ngram_join(spark, sf_dir):
    return ngram_components(read(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as gram from w),
n as (select doc_id, count(*) as n from g group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from g a join g b using (gram) where a.doc_id <> b.doc_id group by 1, 2
  having 100 * count(*) >= 85 * ((select n from n where n.doc_id = a.doc_id) + (select n from n where n.doc_id = b.doc_id) - count(*))),
reach as (select doc_id, doc_id as other from w union select r.doc_id, l.b from reach r join links l on r.other = l.a)
select w.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(reach.other) as component_id
from w left join n using (doc_id) join reach using (doc_id) group by w.doc_id
"""
