"""What several operators share: reading, text bytes, checkpoints, row keys."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it.
WS = "[\\x20\\x09-\\x0D]"
NON_WS = "[^\\x20\\x09-\\x0D]+"

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of runs that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_WS)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: spark.checkpoint.dir. Where that is unset, a temporary folder in local mode, an error elsewhere."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="provena-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(column: pa.Array, n_bytes: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the slices of a binary column that hold about n_bytes each."""
    at, n, size = 0, 0, 0
    for length in pa.compute.binary_length(column).to_pylist():
        n, size = n + 1, size + (length or 0)
        if size >= n_bytes:
            yield at, n
            at, n, size = at + n, 0, 0
    if n:
        yield at, n


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        n = w
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


#: A key is hot if it holds more than this share of all rows (and HOT_ROWS rows); there are fewer than HOT of these, and each is dealt over SALTS.
HOT, HOT_ROWS, SALTS = 512, 512, 64


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined to table (one row a key, `count` of which says how many of the `total` rows have that key).

    Hot keys, fewer than HOT whatever the size, are known to every executor and dealt over SALTS tasks.
    """
    if total <= HOT_ROWS:  # no key can be hot
        return rows.join(table, keys)
    salt = "salt"
    hot = F.col(count) > max(total // HOT, HOT_ROWS)
    known = F.broadcast(table.where(hot).select(*keys, F.lit(True).alias(salt)))
    dealt = rows.join(known, keys, "left").withColumn(salt, F.when(F.col(salt), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, salt]).drop(salt)


#: Bits of the maps by which rows skip a join that they would not meet anything in: 4 MB at most, whatever the number of keys.
BITS = 1 << 25


def sifted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may meet a wanted key, rows that cannot). The more keys there are, the fewer rows are spared; none is lost."""
    place = lambda k: F.pmod(k, F.lit(BITS))
    bits = wanted.select(place(wanted_key).alias("k")).groupBy(F.bitmap_bucket_number("k").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("m"))
    bucket, bitmap, found = fresh(rows, "sift_bucket", "sift_map", "sift_found")
    bits = F.broadcast(bits.select(F.col("b").alias(bucket), F.col("m").alias(bitmap)))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2
    flagged = rows.join(bits, F.bitmap_bucket_number(place(key)) == F.col(bucket), "left").withColumn(found, F.coalesce(bit == 1, F.lit(False)))
    return flagged.where(found).select(rows.columns), flagged.where(~F.col(found)).select(rows.columns)


class Shared:
    """An object of this package sent to every executor once, its class included. The caller bounds its size."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self._sent.value)

    def destroy(self) -> None:
        self._sent.destroy()
