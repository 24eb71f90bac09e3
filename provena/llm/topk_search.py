"""Exact top-k search: term-at-a-time accumulation in blocks, partition selection, merge.

Rows are sparse vectors: (id, terms, weights). Queries are dealt into tiles of at most about TILE weights, candidates into groups; every (tile, group) is one unit
of work, keyed by both, in which the tile's queries come first and the group's candidates stream after them in blocks. A block is turned into
postings: for each term the block's rows that hold it and their weights. Each query adds its weighted postings, one term after the other, into an
array with one score per row of the block; rows that reach the query's k-th best so far go on to a partition selection, and the k best stay. The
units' k best are merged per query. Scores are whole numbers, exact: a unit whose scores could leave 64 bits raises.

What a task holds is a tile with its k best, and one block. All vectors with a query set that is a fixed share of them are quadratic work by definition; the
number of units is the larger of the shuffle partitions and tiles x candidates / GROUP, and each row is sent once per tile or group it meets.

Defined cases: rows whose vector is null or holds null take no part; a vector without terms scores 0 with every row; a candidate with the query's id is the
query's own row; queries that repeat an id and a vector are one, with another vector they are another query under the same id; candidates that repeat count as often as they stand
there; a null id is no query, and as a candidate it is larger than any other in ties; terms may come in any order, and weights of a term that repeats add up; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import read

#: Weights of the queries of a tile; candidates of a group; rows of a block.
TILE, GROUP, BLOCK = 4_000_000, 1_000_000, 4096
#: Partitions at most; beyond, several units share one.
PARTITIONS = 20_000
NO_ID = np.iinfo(np.int64).max


def _sparse(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all weights of a batch."""
    terms, weights = b.column("terms"), b.column("weights")
    row = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
    return row, terms.flatten().to_numpy(), weights.flatten().to_numpy()


class Postings:
    """Of a block of n rows: for each term the rows that hold it and their weights. A term that more than half of the rows hold has a weight for every row."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.lexsort((row, term))
        row, term, weight = row[order], term[order], weight[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))) if len(term) else np.zeros(0, np.int64)
        row, term, weight = row[first], term[first], np.add.reduceat(weight, first) if len(first) else weight
        self.lists = {}
        self.largest = np.abs(weight.astype(float)).max(initial=0.0)
        edges = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1], [True]))) if len(term) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if 2 * (hi - lo) > n:
                every = np.zeros(n, np.int64)
                every[row[lo:hi]] = weight[lo:hi]
                self.lists[int(term[lo])] = None, every
            else:
                self.lists[int(term[lo])] = row[lo:hi], weight[lo:hi]

    def scores(self, terms: list[int], weights: list[int], into: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The scores of a query with every row of the block, in the array that is given."""
        into[:] = 0
        for t, w in zip(terms, weights, strict=True):
            found = self.lists.get(t)
            if found is None:
                continue
            rows, values = found
            if rows is None:
                np.multiply(values, w, out=room)
                np.add(into, room, out=into)
            else:
                into[rows] += values * w
        return into


class Tile:
    """Queries with the k best of what they have met."""

    def __init__(self, batches: list[pa.RecordBatch], k: int):
        self.k, self.ids, self.keys, self.queries = k, [], [], []
        for b in batches:
            row, term, weight = _sparse(b)
            edges = np.searchsorted(row, np.arange(b.num_rows + 1))
            self.ids += b.column("id").to_pylist()
            self.keys += b.column("key").to_pylist()
            self.queries += [(term[lo:hi].tolist(), weight[lo:hi].tolist()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(self.queries)  # scores and ids, best first
        self.reach = max((sum(abs(w) for w in q[1]) for q in self.queries), default=0)

    def meet(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """ids: in ascending order."""
        n = len(ids)
        postings = Postings(n, row, term, weight)
        if self.reach * int(postings.largest) >= 1 << 62:
            raise ArithmeticError("scores do not fit 64 bits")
        scores, room = np.empty(n, np.int64), np.empty(n, np.int64)
        for q, (terms, weights) in enumerate(self.queries):
            postings.scores(terms, weights, scores, room)
            had, had_ids = self.best[q]
            fit = np.flatnonzero(scores >= had[-1]) if len(had) == self.k else np.arange(n)
            fit = fit[ids[fit] != self.ids[q]]
            if len(fit) > self.k:  # the k-th largest score by partition; of the rows that have just that, the first
                at = scores[fit]
                least = np.partition(at, len(at) - self.k)[len(at) - self.k]
                over, even = fit[at > least], fit[at == least]
                fit = np.concatenate((over, even[: self.k - len(over)]))
            if len(fit):
                both, both_ids = np.concatenate((had, scores[fit])), np.concatenate((had_ids, ids[fit]))
                order = np.lexsort((both_ids, -both))[: self.k]
                self.best[q] = both[order], both_ids[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.queries), 1000):
            part = range(lo, min(lo + 1000, len(self.queries)))
            sizes = [len(self.best[q][0]) for q in part]
            ids = np.concatenate([self.best[q][1] for q in part])
            columns = [
                pa.array(np.repeat([self.ids[q] for q in part], sizes), pa.int64()),
                pa.array(np.repeat([self.keys[q] for q in part], sizes), pa.int64()),
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array(np.concatenate([self.best[q][0] for q in part]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "key", "id", "score"])


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for lo in range(0, b.num_rows, BLOCK):
        part = b.slice(lo, BLOCK)
        ids = part.column("id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row, term, weight = _sparse(part)
        yield ids[order], place[row], term, weight


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query of each (tile, group) of a partition that is sorted by (tile, group, candidates last)."""
    unit, queries, tile = None, [], None
    for b in batches:
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tile", "part", "candidate")], axis=1)
        edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True]))) if len(keys) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if unit != tuple(keys[lo][:2]):
                if tile is not None:
                    yield from tile.rows()
                unit, queries, tile = tuple(keys[lo][:2]), [], None
            run = b.slice(lo, hi - lo)
            if not keys[lo][2]:
                queries.append(run)
                continue
            if tile is None:
                tile, queries = Tile(queries, k), []
            if tile.queries:
                for block in _blocks(run):
                    tile.meet(*block)
    if tile is not None:
        yield from tile.rows()


def top_k(vectors: DataFrame, is_query: Column, k: int, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(query_id, rank, id, score): of each query its k best rows, all rows but its own.

    vectors: id long, terms array<int>, weights array<long>; is_query says which rows are queries.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("id", "terms", "weights").where("terms is not null and weights is not null")
    queries = vectors.where(is_query & F.col("id").isNotNull()).withColumn("key", F.xxhash64("id", "terms", "weights")).dropDuplicates(["id", "terms", "weights"])
    size = vectors.agg(F.count("*").alias("n"), F.sum(F.when(is_query & F.col("id").isNotNull(), F.size("terms") + 1)).alias("w")).first()
    tiles = max(1, math.ceil((size["w"] or 0) / tile))
    groups = max(math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / tiles), math.ceil(size["n"] / group))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.pmod("key", F.lit(tiles)).cast("int").alias("tile"), every(groups).alias("part"), F.lit(False).alias("candidate"), "id", "key", "terms", "weights")
    place = F.pmod(F.xxhash64("id", "terms", "weights", F.lit("part")), F.lit(groups)).cast("int")
    right = vectors.select(every(tiles).alias("tile"), place.alias("part"), F.lit(True).alias("candidate"), "id", F.lit(0).cast("long").alias("key"), "terms", "weights")
    parts = min(tiles * groups, max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    unit = F.pmod(F.col("tile").cast("long") * groups + F.col("part"), F.lit(parts)).cast("int")
    units = left.unionByName(right).repartitionById(parts, unit).sortWithinPartitions("tile", "part", "candidate")
    best = units.mapInArrow(lambda b: _searched(b, k), "query_id long, key long, id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def sparse(embedding: Column, scale: int) -> Column:
    """Struct (terms, weights) of floor(scale * x) for each component x that does not become 0; null for vectors that are null or hold null or non-finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    held = F.filter(F.transform(whole, lambda x, i: F.struct(i.cast("int").alias("t"), x.alias("w"))), lambda e: e["w"] != 0)
    return F.when(embedding.isNotNull() & ~odd, F.struct(held["t"].alias("terms"), held["w"].alias("weights")))


def op13_topk_search(spark, sf_dir, every: int = 20, k: int = 20, scale: int = 64):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), sparse(F.col("embedding"), scale).alias("v")).select("id", "v.terms", "v.weights")
    out = top_k(vectors, F.col("id") % every == 0, k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP13_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select distinct vec_id, e from v where vec_id % 20 = 0),
s as (select q.vec_id as query_id, q.e as key, v.vec_id, coalesce(cast(list_sum(list_transform(range(1, least(len(q.e), len(v.e)) + 1), lambda i: q.e[i] * v.e[i])) as bigint), 0) as score
  from q join v on q.vec_id is distinct from v.vec_id)
select query_id, cast(row_number() over (partition by query_id, key order by score desc, vec_id nulls last) as int) as rank, vec_id, score
from s qualify rank <= 20
"""
