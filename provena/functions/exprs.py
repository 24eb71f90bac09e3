"""Scalar expressions, all built in: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.schema import LEAD_IN, SAMPLES_PER_SECTOR, SECTORS_PER_SECOND, U32


def u32(c: Column) -> Column:
    """c modulo 2**32, never negative."""
    return F.pmod(c, F.lit(U32))


def digit_sum(c: Column, digits: int = 10) -> Column:
    """Sum of the decimal digits of a non-negative integer of at most `digits` digits; arithmetic only."""
    c = c.cast("long")
    return sum((F.pmod(F.call_function("div", c, F.lit(10**k)), F.lit(10)) for k in range(digits)), F.lit(0).cast("long"))


def div(a: Column, b: int) -> Column:
    """Integer quotient of non-negative integers."""
    return F.call_function("div", a, F.lit(b)).cast("long")


def v1_term(position: Column, sample: Column) -> Column:
    """position * sample mod 2**32; both factors under 2**31 and 2**32, so the product fits a BIGINT."""
    return u32(position.cast("long") * sample)


def v2_term(position: Column, sample: Column) -> Column:
    """High word plus low word of position * sample."""
    p = position.cast("long") * sample
    return F.shiftrightunsigned(p, 32) + u32(p)


def duration_seconds(n: Column, rate: int = SAMPLES_PER_SECTOR * SECTORS_PER_SECOND) -> Column:
    return div(n, rate)


def duration_sectors(n: Column) -> Column:
    """Whole sectors of n samples, -1 where they are not whole."""
    return F.when(n % SAMPLES_PER_SECTOR == 0, div(n, SAMPLES_PER_SECTOR)).otherwise(F.lit(-1).cast("long"))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def compilation(c: Column) -> Column:
    return F.coalesce(c, F.lit("0"))


def title(track_title: Column, recording_title: Column) -> Column:
    return F.coalesce(F.nullif(track_title, F.lit("")), recording_title)


def position_of(position: Column, count: Column) -> Column:
    """'3/12'; null where either is unknown."""
    return F.concat(position.cast("string"), F.lit("/"), count.cast("string"))


def unless_same(sort_name: Column, name: Column) -> Column:
    """A sort name says nothing where it equals the display name."""
    return F.when(sort_name == name, "").otherwise(sort_name)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance on code points, case-sensitive; null counts as empty."""
    return F.levenshtein(text_or_empty(a), text_or_empty(b))


def hex32(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 8, "0")


def le32(sample: Column) -> Column:
    """The four octets of a u32, least significant first, as hexadecimal digits."""
    h = hex32(sample)
    return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))


def rip_path(id1: Column, id2: Column, cddb: Column, n: Column, root: str = "/accuraterip") -> Column:
    """Path of a disc in the rip database: three nibbles of id1, least significant first, then all ids."""
    h = hex32(id1)
    name = F.concat(F.lit("dBAR-"), F.lpad(n.cast("string"), 3, "0"), F.lit("-"), h, F.lit("-"), hex32(id2), F.lit("-"), hex32(cddb), F.lit(".bin"))
    return F.concat_ws("/", F.lit(root), *(F.substring(h, k, 1) for k in (8, 7, 6)), name)


def eac_path(disc_id: Column, n: Column, root: str = "/crc") -> Column:
    """Path of a disc in the second database: the octets of its id in upper hexadecimal under folders of its first four nibbles."""
    h = F.hex(F.unbase64(F.translate(disc_id, "._-", "+/=")))
    return F.concat_ws("/", F.lit(root), *(F.substring(h, k, 1) for k in range(1, 5)), F.concat(h, F.lit("-"), n.cast("string"), F.lit(".bin")))


def track_second(offset: Column) -> Column:
    """Second at which a track begins, lead-in included; offset in sectors after the lead-in."""
    return div(offset, SECTORS_PER_SECOND) + LEAD_IN // SECTORS_PER_SECOND


def cddb_id(digit_sums: Column, first: Column, leadout: Column, n: Column) -> Column:
    """From the sum of the digit sums of the tracks' seconds, and sectors after the lead-in of the first track and the lead-out."""
    seconds = div(leadout, SECTORS_PER_SECOND) - div(first, SECTORS_PER_SECOND)
    return u32((digit_sums % 255) * F.lit(1 << 24) + seconds * F.lit(1 << 8) + n)
