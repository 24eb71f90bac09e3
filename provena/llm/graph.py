"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, HOT_ROWS, drop_written, written

#: Edges to a file of a round's result.
FILE_EDGES = 20_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to those that tie each node of a batch to the least node that it reaches inside the batch."""
    for b in batches:
        nodes, at = np.unique(np.concatenate([b.column(k).to_numpy() for k in (0, 1)]), return_inverse=True)
        u, v = at[: len(at) // 2], at[len(at) // 2 :]
        root = np.arange(len(nodes))
        while len(u):
            before = root.copy()
            least = np.minimum(root[u], root[v])
            for x in (u, v):
                np.minimum.at(root, root[x], least)
                np.minimum.at(root, x, least)
            root = root[root]
            if (before == root).all():
                break
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["u", "v"])


def _star(rows: DataFrame, large: bool, total: int, label: str) -> DataFrame:
    """rows: (u, v). Large: u's neighbours v, the larger of which are tied to the least one around; small: smaller ones, all tied to the least, as u is.

    Nodes of many edges, fewer than HOT whatever the size, are told their least neighbour by a broadcast, the others by a join.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = rows.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    hot = F.col("n") > max(total // HOT, HOT_ROWS)
    if total > HOT_ROWS:
        known = F.broadcast(least.where(hot).select("u", "m"))
        told = rows.join(known.select("u"), "u", "left_anti").join(least.where(~hot).select("u", "m"), "u").union(rows.join(known, "u"))
    else:
        told = rows.join(least.select("u", "m"), "u")
    if large:
        out = told.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = told.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    # small tables in few files, so that a round costs what its edges cost
    return written(out.where("u != v").coalesce(max(1, min(parts, total // FILE_EDGES + 1))), label)


def components(edges: DataFrame, label: str = "components", rounds: int = 40) -> DataFrame:
    """(node, root) of every node of edges (u, v: long): root is the least node that it reaches.

    Each batch is first reduced to stars of its own. The rounds grow with the logarithm of the longest chain of what is left; each is written, so that none
    is computed anew.
    """
    given = written(edges.select("u", "v").where("u != v"), label)
    files = max(1, min(int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), given.count() // FILE_EDGES + 1))
    e = written(given.coalesce(files).mapInArrow(_forest, "u long, v long"), label)
    drop_written(given)
    before, total = None, e.count()
    for _ in range(rounds):
        middle = _star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), True, 2 * total, label)
        after = _star(middle, False, total, label)
        drop_written(e)
        drop_written(middle)
        e = after
        sign = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (sign["n"], sign["x"]) == before:
            break
        before, total = (sign["n"], sign["x"]), sign["n"]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
