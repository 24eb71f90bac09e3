"""Votes of the rip databases on checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACK = ["disc_id", "track_pos"]


def _voted(checksums: DataFrame, votes: DataFrame, track: list[str], crc: str, count: str) -> DataFrame:
    """checksums of the tracks that have votes, with _votes (summed per checksum, as a map), total and max of their track.

    Both sides are exchanged once, by track: the sums per checksum and per track and the join all find their rows there. Entries are summed per checksum before they meet the
    offsets, so a popular pressing with many entries is one cell.
    """
    by_crc = votes.repartition(*track).groupBy(*track, crc).agg(F.sum(count).alias("_c"), F.max(count).alias("_m"))
    cell = F.when(F.col(crc).isNotNull(), F.struct(F.col(crc).alias("k"), F.col("_c").alias("v")))
    whole = by_crc.groupBy(*track).agg(F.map_from_entries(F.collect_list(cell)).alias("_votes"), F.sum("_c").cast("long").alias("total"), F.max("_m").alias("max"))
    return checksums.join(whole, track)


def _votes_on(value: str) -> Column:
    return F.coalesce(F.try_element_at("_votes", F.col(value)), F.lit(0)).cast("long")


def vote_aggregate(checksums: DataFrame, votes: DataFrame, track: list[str] = TRACK) -> DataFrame:
    """Per track and offset: conf_v1 and conf_v2, the confidence of the entries that equal v1 or v2 (one entry may count for both); per track:
    total and max confidence of all entries. checksums: track, offset, v1, v2. votes: track, crc, confidence.

    A track that the response is too short for has no entry, hence no row.
    """
    rows = _voted(checksums, votes, track, "crc", "confidence")
    return rows.select(*track, "offset", _votes_on("v1").alias("conf_v1"), _votes_on("v2").alias("conf_v2"), "total", "max")


def vote_aggregate_exclusive(checksums: DataFrame, votes: DataFrame, track: list[str] = TRACK) -> DataFrame:
    """The older rule: an entry counts for v2 only where it does not equal v1."""
    rows = _voted(checksums, votes, track, "crc", "confidence")
    older = F.when(F.col("v1") == F.col("v2"), F.lit(0).cast("long")).otherwise(_votes_on("v2"))
    return rows.select(*track, "offset", _votes_on("v1").alias("conf_v1"), older.alias("conf_v2"), "total", "max")


def eac_vote_aggregate(checksums: DataFrame, votes: DataFrame, track: list[str] = TRACK) -> DataFrame:
    """As vote_aggregate, for whole-track CRC-32 counts. The live pipeline fetches these but does not verify with them."""
    return _voted(checksums, votes, track, "crc32", "count").select(*track, "offset", _votes_on("crc32").alias("conf_eac"), "total", "max")


def with_votes(voted: DataFrame, track: list[str] = TRACK) -> tuple[DataFrame, DataFrame]:
    """(offsets that got votes, tracks that got none at any: bad rips)."""
    got = voted.where("conf_v1 > 0 or conf_v2 > 0")
    return got, voted.select(*track).distinct().join(got, track, "left_anti")


def release_confidence(voted: DataFrame, release: list[str], stream: str = "stream_index") -> DataFrame:
    """Lowest over streams of the best v1 + v2 votes."""
    per = voted.groupBy(*release, stream).agg(F.max(F.col("conf_v1") + F.col("conf_v2")).alias("c"))
    return per.groupBy(*release).agg(F.coalesce(F.min("c"), F.lit(0)).alias("confidence_min"))


def release_score(matches: DataFrame, release: str = "release_id", stream: str = "stream_index") -> DataFrame:
    """Sum over streams of the highest score."""
    return matches.groupBy(release, stream).agg(F.max("score").alias("s")).groupBy(release).agg(F.sum("s").alias("score"))


def offsets_at_neighbours(rows: DataFrame, disc: str = "disc_id") -> DataFrame:
    """Rows (disc, track_pos, offset) whose offset is known at every existing neighbour, at position - 1 and + 1."""
    have = rows.select(disc, "track_pos", "offset").distinct()
    tracks = have.select(disc, "track_pos").distinct()
    out = rows
    for d in (-1, 1):
        there = tracks.select(disc, (F.col("track_pos") - d).alias("track_pos")).withColumn("_t", F.lit(True))
        known = have.select(disc, (F.col("track_pos") - d).alias("track_pos"), "offset").withColumn("_k", F.lit(True))
        out = out.join(there, [disc, "track_pos"], "left").join(known, [disc, "track_pos", "offset"], "left").where("_t is null or _k").drop("_t", "_k")
    return out


def neighbours(rows: DataFrame, disc: str, position: str, value: str) -> DataFrame:
    """rows with before and after: the value at position - 1 and + 1. Joins by position, not by row: a gap gives null.

    Of several candidates at a position the smallest value is taken.
    """
    first = rows.groupBy(disc, position).agg(F.min(value).alias(value))
    at = lambda d, name: first.select(disc, (F.col(position) - d).alias(position), F.col(value).alias(name))
    return rows.join(at(-1, "before"), [disc, position], "left").join(at(1, "after"), [disc, position], "left")
