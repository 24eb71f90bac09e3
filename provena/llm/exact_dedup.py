"""Exact dedup: a tree merge of sorted digest runs.

Every input partition turns its texts into digests and sorts them into a run: one row per digest with the smallest identifier and the number of rows. Runs
are numbered 0 to 2^k - 1. In round i each run exchanges with the one whose number differs in bit i: a digest goes to the partner whose bit i is
the digest's own bit i. The receiving run merges what its partners sent, sorted by Spark's external sorter (which merges spilled runs multiway), in one pass
over the sorted rows that holds one row: equal digests become one, with the smallest identifier and the sum of the rows. After k rounds a digest
is in one run only, the one that its last k bits name. A digest that a third of all rows share is one row of each run from the start, so it
never fills a task.

A digest is (SHA-256, length, xxhash64) of the normalised text; at every level rows merge only where all three witnesses agree, so the smallest
identifier that is kept is verified. That is log2(runs) exchanges of about 60 bytes a distinct digest and run, whatever the texts' size.

Defined cases: a null text counts as empty; empty texts form one group; a null id is larger than any other, and a
group of null ids only keeps them all; rows that repeat the smallest id of their group are one record and all
stay. Extra columns pass through where the operator returns rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh, read, salted_join, written


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, n_bytes, xx) of each row's normalised text."""
    t = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    return t.select("id", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("xx"))


KEY = ["sha", "n_bytes", "xx"]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, sha, n_bytes, xx, keep_id, group_size) in order of digest and identifier, equal digests as one. Holds the last digest, as more may come."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        new = np.ones(b.num_rows, bool)
        new[1:] = False
        for k in (1, 2, 3):
            new[1:] |= pa.compute.not_equal(b.column(k)[1:], b.column(k)[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        sizes = np.add.reduceat(b.column(5).to_numpy(), first)
        out = b.take(pa.array(first))
        out = pa.RecordBatch.from_arrays([*out.columns[:5], pa.array(sizes)], schema=b.schema)
        held = out.slice(len(first) - 1)
        yield out.slice(0, len(first) - 1)
    if held is not None:
        yield held


def merge_runs(keys: DataFrame, n_runs: int | None = None) -> DataFrame:
    """(sha, n_bytes, xx, keep_id, group_size) from rows of digests(), by rounds of exchange between partners."""
    n = n_runs or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, (n - 1).bit_length())
    runs = keys.select(F.pmod(F.spark_partition_id(), F.lit(1 << rounds)).alias("run"), *KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    schema = runs.schema
    merged = lambda r: r.sortWithinPartitions(*KEY, F.col("keep_id").asc_nulls_last()).mapInArrow(_merged, schema)
    runs = merged(runs)
    of_digest = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    for i in range(rounds):
        bit = F.lit(1 << i)
        partner = F.col("run") - F.col("run").bitwiseAND(bit) + of_digest.bitwiseAND(bit).cast("int")
        runs = merged(runs.withColumn("run", partner.cast("int")).repartitionById(1 << rounds, F.col("run")))
    return runs.drop("run")


def exact_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    The digests are written once (56 bytes a row), so texts are read and hashed once. Groups that hold many of the rows are dealt over several tasks
    when rows meet their group.
    """
    keys = written(digests(docs, id_col, text_col), "digests")
    groups = written(merge_runs(keys), "digest-groups")
    return salted_join(keys, groups, KEY, "group_size", keys.count()).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Ids identify rows: a null id stays only in a group of null ids."""
    k, s = fresh(docs, "dedup_id", "dedup_sha")
    stay = exact_dedup_report(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(k), F.col("text_sha256").alias(s)).distinct()
    sha = F.sha2(normalised(F.col(text_col)), 256)
    return docs.join(stay, docs[id_col].eqNullSafe(F.col(k)) & (sha == F.col(s)), "left_semi")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup_report(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id is not distinct from g.keep_id as kept, text_sha256
from d join g using (text_sha256)
"""
