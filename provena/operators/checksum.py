"""Order-dependent checksums modulo 2**32, their shifts, and the search for offsets.

A disc is the concatenation of its tracks' samples; D[j] indexes it from the start of a track. At offset o a track of N samples has
v1 = sum of l * D[l + o], v2 = sum of the high and low words of l * D[l + o], l = 1..N. Without a track before, l < SKIP_HEAD is left out; without one
after, l > N - SKIP_TAIL. One equi-join brings each sample to its own track and the two beside it; the rest is a pre-aggregated sum.
"""

from __future__ import annotations

import functools
import sys
import zlib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from provena.functions.exprs import duration_seconds, duration_sectors, le32, u32, v1_term, v2_term
from provena.schema import CRC_EDGE, CRC_POLYNOMIAL, SAMPLES_PER_SECTOR, SKIP_HEAD, SKIP_TAIL

# crc_combine goes to executors with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def weighted_checksums(samples: DataFrame, keys: list[str], position: str = "j", sample: str = "s") -> DataFrame:
    """v1 and v2 at offset 0 of whole files, nothing skipped."""
    p, s = F.col(position), F.col(sample)
    return samples.groupBy(*keys).agg(u32(F.sum(v1_term(p, s))).alias("v1"), u32(F.sum(v2_term(p, s))).alias("v2"))


def region_sums(samples: DataFrame, lengths: DataFrame, keys: list[str], head: int = SKIP_HEAD, tail: int = SKIP_TAIL) -> DataFrame:
    """Accumulators of a track's head (j < head), tail (j + tail > n) and body. lengths: keys and n."""
    region = F.when(F.col("j") < head, "head").when(F.col("j") + tail > F.col("n"), "tail").otherwise("body")
    rows = samples.join(lengths, keys).withColumn("region", region)
    return rows.groupBy(*keys, "region").agg(u32(F.sum(v1_term(F.col("j"), F.col("s")))).alias("v1"), u32(F.sum(v2_term(F.col("j"), F.col("s")))).alias("v2"))


def checksums_at_offsets(samples: DataFrame, offsets: list[int] | DataFrame, head: int = SKIP_HEAD, tail: int = SKIP_TAIL) -> DataFrame:
    """(disc, track_pos, offset, v1, v2). samples: disc, track_pos, j (from 1 in each track), s.

    offsets: the same ones for all tracks, or a table (disc, track_pos, offset). Neighbours are tracks at position - 1 and + 1: a gap in the
    positions counts as no neighbour, as the position join of the pipeline has it.
    """
    t = samples.groupBy("disc", "track_pos").agg(F.max("j").alias("n"))
    beside = lambda d, name: t.select("disc", (F.col("track_pos") - d).alias("track_pos"), F.col("n").alias(name))
    t = t.join(beside(-1, "n_before"), ["disc", "track_pos"], "left").join(beside(1, "n_after"), ["disc", "track_pos"], "left")
    t = t.withColumn("lo", F.when(F.col("n_before").isNull(), head).otherwise(1)).withColumn("hi", F.when(F.col("n_after").isNull(), F.col("n") - tail).otherwise(F.col("n")))
    if isinstance(offsets, DataFrame):
        t = t.join(offsets.select("disc", "track_pos", "offset").distinct(), ["disc", "track_pos"])
    else:
        t = t.withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    near = samples.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("track_pos", F.col("track_pos") - F.col("side"))
    # place of the sample, counted from the start of the track that it is brought to
    place = F.when(F.col("side") == -1, F.col("j") - F.col("n_before")).when(F.col("side") == 1, F.col("j") + F.col("n")).otherwise(F.col("j"))
    rows = near.join(t, ["disc", "track_pos"]).withColumn("l", place - F.col("offset")).where("l between lo and hi")
    return rows.groupBy("disc", "track_pos", "offset").agg(u32(F.sum(v1_term(F.col("l"), F.col("s")))).alias("v1"), u32(F.sum(v2_term(F.col("l"), F.col("s")))).alias("v2"))


def prefix_sums(samples: DataFrame, key: str = "stream_index", order: str = "j", sample: str = "s") -> DataFrame:
    """samples with sum_s and sum_js: running sums of s and of j * s mod 2**32, within a stream."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("sum_s", F.sum(sample).over(w)).withColumn("sum_js", u32(F.sum(v1_term(F.col(order), F.col(sample))).over(w)))


def window_checksums(samples: DataFrame, width: int = SAMPLES_PER_SECTOR, key: str = "stream_index") -> DataFrame:
    """(key, start, value): sum of t * s[start + t] for t = 1..width, mod 2**32, of every full window of contiguous samples."""
    w = Window.partitionBy(key).orderBy("j").rowsBetween(1 - width, 0)
    plain, weighted = F.sum("s").over(w), F.sum(v1_term(F.col("j"), F.col("s"))).over(w)
    start = F.col("j") - width
    rows = samples.select(key, "j", plain.alias("w1"), weighted.alias("w2"), F.count("*").over(w).alias("n"), (F.col("j") - F.min("j").over(w)).alias("span"))
    return rows.where((F.col("n") == width) & (F.col("span") == width - 1)).select(key, start.alias("start"), u32(u32(F.col("w2")) - u32(u32(F.col("w1")) * u32(start))).alias("value"))


def find_offsets(samples: DataFrame, targets: DataFrame, centre: int, half: int = 1024, width: int = SAMPLES_PER_SECTOR, key: str = "stream_index") -> DataFrame:
    """(key, target, offset) of all windows within half of centre whose checksum is a target; a target of 0 finds nothing.

    Only the slice that the search can see is windowed.
    """
    slice_ = samples.where(F.col("j").between(centre - half + 1, centre + half + width))
    found = window_checksums(slice_, width, key).where(F.col("start").between(centre - half, centre + half))
    want = targets.select(key, "target").where("target <> 0").distinct()
    return found.join(want, (found[key] == want[key]) & (F.col("value") == F.col("target"))).select(found[key], "target", (F.col("start") - centre).alias("offset"))


def samples_hex(j: str = "j", sample: str = "s") -> Column:
    """Octets of the grouped samples in order, as hexadecimal digits."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(j).alias("j"), le32(F.col(sample)).alias("h"))))
    return F.array_join(F.transform(pairs, lambda x: x["h"]), "")


def _times(a: int, b: int) -> int:
    """Product of two remainders modulo the polynomial of CRC-32; the highest bit stands for 1."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def _power(n: int) -> int:
    """x to the 8 * n-th: what n octets of zeros multiply a remainder by."""
    power, square = 1 << 31, 1 << 23  # 1 and x to the 8th
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return power


def crc_combine(first: int, second: int, n: int) -> int:
    """CRC-32 of two runs of octets, one after the other, from their own ones; n: octets of the second."""
    return _times(_power(n), first) ^ second


def _crcs_of_parts(crcs: pd.Series, octets: pd.Series) -> pd.Series:
    return pd.Series([functools.reduce(lambda c, x: crc_combine(c, int(x[0]), int(x[1])), zip(a, n), 0) for a, n in zip(crcs, octets)], dtype="int64")


def crc_of_parts(parts: Column) -> Column:
    """CRC-32 of parts in order, from an array of structs that hold crc and n (octets)."""
    combine = F.pandas_udf(_crcs_of_parts, T.LongType())
    return combine(F.transform(parts, lambda x: x["crc"]), F.transform(parts, lambda x: x["n"]))


def region_crcs(samples: DataFrame, keys: list[str], block: int = 65536) -> DataFrame:
    """(keys, crc32, octets) of the octets of each group. Blocks of samples are hashed apart, so no task holds a stream; their CRCs are combined."""
    part = F.call_function("div", F.col("j"), F.lit(block))
    blocks = samples.groupBy(*keys, part.alias("_b")).agg(F.crc32(F.unhex(samples_hex())).alias("crc"), (F.count("*") * 4).alias("n"))
    whole = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "crc", "n"))).alias("_p"), F.sum("n").alias("octets"))
    return whole.select(*keys, crc_of_parts(F.col("_p")).alias("crc32"), "octets")


def track_crcs(samples: DataFrame, lengths: DataFrame, keys: list[str], edge: int = CRC_EDGE, block: int = 65536) -> DataFrame:
    """(keys, head, body, tail, whole): CRC-32 of the first and last `edge` samples of a track, of those between, and of all, combined from the three.

    A sample that is near both ends belongs to the head. A region without samples is null. lengths: keys and n.
    """
    region = F.when(F.col("j") <= edge, 0).when(F.col("j") + edge > F.col("n"), 2).otherwise(1)
    parts = region_crcs(samples.join(lengths, keys).withColumn("_region", region), [*keys, "_region"], block)
    named = [F.max(F.when(F.col("_region") == k, F.col("crc32"))).alias(name) for k, name in enumerate(("head", "body", "tail"))]
    out = parts.groupBy(*keys).agg(*named, F.sort_array(F.collect_list(F.struct("_region", F.col("crc32").alias("crc"), F.col("octets").alias("n")))).alias("_p"))
    return out.select(*keys, "head", "body", "tail", crc_of_parts(F.col("_p")).alias("whole"))


def stream_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seconds, sectors, v1, v2, crc32) of whole streams: what the checksum tool prints of a file."""
    sums = weighted_checksums(samples, keys).join(samples.groupBy(*keys).agg(F.count("*").alias("_n")), keys).join(region_crcs(samples, keys), keys)
    return sums.select(*keys, duration_seconds(F.col("_n")).alias("seconds"), duration_sectors(F.col("_n")).alias("sectors"), "v1", "v2", "crc32")


def _advanced(remainder: Column, octets: int) -> Column:
    """The remainder after so many octets of zeros: multiplication by one fixed power, as a table of 256 for each of its four octets."""
    power = _power(octets)
    tables = [F.split(F.lit(",".join(str(_times(power, b << shift)) for b in range(256))), ",").cast("array<bigint>") for shift in (0, 8, 16, 24)]
    found = [F.get(t, F.shiftright(remainder, shift).bitwiseAND(F.lit(255)).cast("int")) for t, shift in zip(tables, (0, 8, 16, 24))]
    return found[0].bitwiseXOR(found[1]).bitwiseXOR(found[2]).bitwiseXOR(found[3])


def sliding_crc(samples: DataFrame, width: int = SAMPLES_PER_SECTOR, key: str = "stream_index", block: int = 65536) -> DataFrame:
    """(key, start, crc32) of every full window of `width` contiguous samples.

    The remainder of two runs is that of the first, advanced by the octets of the second, xor that of the second. So windows of 2, 4, 8, ... samples come from
    two half as long, and `width` is put together from these: some 2 log2(width) steps, each with one fixed advance. Streams are cut into blocks of positions that also get the
    first width - 1 samples of the next, so a stream of any length is spread over tasks. Windows with a missing or null sample are left out.
    """
    block = max(block, 4 * width)
    own = lambda j: F.call_function("div", j - 1 - F.pmod(j - 1, F.lit(block)), F.lit(block))
    j = F.col("j").cast("long")
    blocks = F.when(F.pmod(j - 1, F.lit(block)) < width - 1, F.array(own(j) - 1, own(j))).otherwise(F.array(own(j)))
    rows = samples.select(key, j.alias("j"), F.explode(blocks).alias("_b"), _advanced(F.col("s").cast("long"), 4).alias("_power"))
    w = Window.partitionBy(key, "_b").orderBy("j")
    m, done = 1, 0
    while True:
        if width & m:
            rows = rows.withColumn("_crc", _advanced(F.col("_crc"), 4 * m).bitwiseXOR(F.lead("_power", done).over(w)) if done else F.col("_power"))
            done += m
        if 2 * m > width:
            break
        rows = rows.withColumn("_power", _advanced(F.col("_power"), 4 * m).bitwiseXOR(F.lead("_power", m).over(w)))
        m *= 2
    # registers that begin and end inverted differ from plain remainders by what as many zeros give
    inverted = zlib.crc32(bytes(4 * width))
    rows = rows.withColumn("_last", F.lead("j", width - 1).over(w)).where((F.col("_last") - F.col("j") == width - 1) & (own(F.col("j")) == F.col("_b")) & F.col("_crc").isNotNull())
    return rows.select(key, (F.col("j") - 1).alias("start"), F.col("_crc").bitwiseXOR(F.lit(inverted).cast("long")).alias("crc32"))


def find_offsets_crc(samples: DataFrame, targets: DataFrame, centre: int, half: int = 2940, width: int = SAMPLES_PER_SECTOR, key: str = "stream_index") -> DataFrame:
    """As find_offsets, by CRC-32 of the windows."""
    slice_ = samples.where(F.col("j").between(centre - half + 1, centre + half + width))
    want = targets.select(F.col(key).alias("k"), "target").where("target <> 0").distinct()
    found = sliding_crc(slice_, width, key)
    return found.join(want, (F.col(key) == F.col("k")) & (F.col("crc32") == F.col("target"))).select(key, "target", (F.col("start") - centre).alias("offset"))


def byte_differences(a: DataFrame, b: DataFrame, keys: list[str], position: str = "j", value: str = "s") -> DataFrame:
    """Per key: positions at which both have different values, and positions that only one has; different is their sum."""
    left, right = a.select(*keys, position, F.col(value).alias("x")), b.select(*keys, position, F.col(value).alias("y"))
    both = left.join(right, [*keys, position], "full")
    changed, alone = F.col("x") != F.col("y"), F.col("x").isNull() | F.col("y").isNull()
    return both.groupBy(*keys).agg(F.count_if(~alone & changed).alias("changed"), F.count_if(alone).alias("unmatched")).withColumn("different", F.col("changed") + F.col("unmatched"))


def is_mono(samples: DataFrame, keys: list[str], left: str = "l", right: str = "r") -> DataFrame:
    return samples.groupBy(*keys).agg(F.bool_and(F.col(left) == F.col(right)).alias("mono"))


def ends(samples: DataFrame, lengths: DataFrame, keys: list[str], keep: int = 10 * SAMPLES_PER_SECTOR + 1) -> DataFrame:
    """The first and last `keep` samples of every stream."""
    return samples.join(lengths, keys).where((F.col("j") <= keep) | (F.col("j") > F.col("n") - keep)).drop("n")
