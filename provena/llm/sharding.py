"""Sharding by weighted rendezvous hashing of stable record keys, in DataFrame functions only.

Each key draws one number u in (0, 1) per shard from md5(seed:key:shard); the shard with the smallest
-ln(u) / weight takes the record. The draw for a shard does not depend on how many shards there are, so one more
shard takes rows only into itself, and taking one away moves only its own rows. Shards get rows in proportion
to their weights.

Slots number the rows of a shard from 0 without gaps. A window over a whole shard would put an eighth of
the table in one task; instead rows are numbered within (shard, cell), where a cell is a leading part of the key's
hash, and a table of shards x cells counts (its size is a parameter, not a matter of the data) gives each cell's offset.

Defined cases: a null key is a key like another; rows with the same key go to the same shard, numbered by their whole numbers, then by a hash of their texts; a null text has size 1
and the CRC of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, read

_HEX = 13  # 52 bits


def _key_text(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def _draw(key: Column, what: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(_key_text(key), F.lit(f":{what}"))), 1, _HEX), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float], seed: str = "s1") -> Column:
    """The shard of key, 0 to len(weights) - 1. A shard of weight 0 takes nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight over 0")
    draws = [F.struct((-F.log((_draw(key, f"{seed}:{i}") + F.lit(0.5)) / F.lit(float(16**_HEX))) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["shard"]


def shard_records(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", seed: str = "s1", cells: int = 1024) -> DataFrame:
    """docs with the columns shard (int) and slot (long, gapless from 0 in each shard).

    Column names of docs that clash with these two are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    cell, start, cs, cc = fresh(docs, "cell", "start", "count_shard", "count_cell")
    where = lambda d: d.withColumn("shard", rendezvous(F.col(key_col), weights, seed)).withColumn(cell, F.pmod(_draw(F.col(key_col), "cell"), F.lit(cells)).cast("int"))
    counts = where(docs.select(key_col)).groupBy("shard", cell).agg(F.count("*").alias("n"))
    # offsets of the cells of a shard: one array of at most `cells` counts per shard
    line = counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col(cell).alias("c"), F.col("n").alias("n")))).alias("a"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<c:int,s:bigint>>").alias("out"))
    summed = F.aggregate("a", zero, lambda acc, x: F.struct((acc["sum"] + x["n"]).alias("sum"), F.concat(acc["out"], F.array(F.struct(x["c"].alias("c"), acc["sum"].alias("s")))).alias("out")), lambda acc: acc["out"])
    offsets = line.select(F.col("shard").alias(cs), F.explode(summed).alias("o")).select(cs, F.col("o.c").alias(cc), F.col("o.s").alias(start))
    rows = where(docs)
    texts = [c for c, t in docs.dtypes if c != key_col and t == "string"]
    order = [F.col(key_col).asc_nulls_last(), *[F.col(c) for c, t in docs.dtypes if c != key_col and t in ("bigint", "int")], *([F.xxhash64(*texts)] if texts else [])]
    numbered = rows.withColumn("slot", F.row_number().over(Window.partitionBy("shard", cell).orderBy(*order)) - 1)
    out = numbered.join(F.broadcast(offsets), (F.col("shard") == F.col(cs)) & (F.col(cell) == F.col(cc)))
    return out.withColumn("slot", (F.col("slot") + F.col(start)).cast("long")).drop(cell, start, cs, cc)


def op7_sharding(spark, sf_dir, shards: int = 8):
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_records(rows, [1.0] * shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"))


OP7_SQL = """
with t as (select n, list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as n)),
crc as (select list(c order by n) as t from t),
r as (select doc_id, coalesce('k' || cast(doc_id as varchar), 'null') as key, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, hex(encode(coalesce(text, ''))) as h from documents),
o as (select *, list_transform(range(0, len(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) as octets from r),
c as (select doc_id, key, size, cast(xor(list_reduce(list_prepend(4294967295, octets), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) as bigint) as text_crc32,
  list_transform(range(9), lambda i: -ln((cast(('0x' || substr(md5(key || ':s1:' || i), 1, 13))::bigint as double) + 0.5::double) / 4503599627370496::double)) as cost, ('0x' || substr(md5(key || ':cell'), 1, 13))::bigint % 1024 as cell from o, crc),
s as (select *, cast(list_position(cost[1:8], list_min(cost[1:8])) - 1 as int) as shard, cast(list_position(cost, list_min(cost)) - 1 as int) as grown_shard from c)
select doc_id, size, text_crc32, 'key' as law, shard, cast(row_number() over (partition by shard order by cell, doc_id nulls last, size, text_crc32) - 1 as bigint) as slot, grown_shard from s
"""
