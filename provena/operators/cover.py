"""Filters over candidate releases: relational division, any-match and perfect-match prunes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covering(rows: DataFrame, candidate: str, element: str, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of the candidates that have every wanted element; by default every element that any row has.

    Division as two pre-aggregations: the wanted set is one small row count, and candidates are counted on distinct elements. With
    nothing wanted every candidate covers it.
    """
    if wanted is None:
        mine, need = rows, rows.select(element).where(F.col(element).isNotNull()).distinct()
    else:
        need = wanted.select(element).where(F.col(element).isNotNull()).distinct()
        mine = rows.join(need, element, "left_semi")
    full = mine.groupBy(candidate).agg(F.count_distinct(element).alias("have")).join(need.agg(F.count("*").alias("need")), F.col("have") == F.col("need"))
    empty = need.limit(1)
    if wanted is not None:
        nothing = rows.select(candidate).distinct().join(empty.select(F.lit(1).alias("any")), F.lit(True), "left").where("any is null").select(candidate)
        return rows.join(full.select(candidate).union(nothing).distinct(), candidate, "left_semi")
    return rows.join(full.select(candidate), candidate, "left_semi")


def n_wanted(rows: DataFrame, element: str) -> DataFrame:
    """The size of the set that covering() divides by."""
    return rows.agg(F.count_distinct(element).alias("n_wanted"))


def unmatched_streams(streams: DataFrame, disc_tracks: DataFrame, release: str = "release_id", stream: str = "stream_index") -> DataFrame:
    """Streams of a release that occur in no track of its discs."""
    return streams.join(disc_tracks, [release, stream], "left_anti")


def matched_streams(streams: DataFrame, disc_tracks: DataFrame, release: str = "release_id", stream: str = "stream_index") -> DataFrame:
    return streams.join(disc_tracks, [release, stream], "left_semi")


def with_matching_discs(releases: DataFrame, streams: DataFrame, disc_tracks: DataFrame, release: str = "release_id") -> DataFrame:
    """releases with matches: no stream of it is missing from its discs (true without streams)."""
    bad = unmatched_streams(streams, disc_tracks, release).select(release).distinct().withColumn("bad", F.lit(True))
    return releases.join(bad, release, "left").withColumn("matches", F.col("bad").isNull()).drop("bad")


def keep_matching_if_any(rows: DataFrame, flag: Column, within: list[str]) -> DataFrame:
    """Rows whose flag holds, of each group in which any row's does; all rows of the other groups."""
    w = Window.partitionBy(*within)
    return rows.withColumn("_ok", F.coalesce(flag, F.lit(False))).withColumn("_any", F.max("_ok").over(w)).where("_ok or not _any").drop("_ok", "_any")


def keep_best(rows: DataFrame, score: Column, within: list[str], highest: bool = True) -> DataFrame:
    """Rows with the best score of their group. For the prunes by confidence, distance and metadata, which the live pipeline leaves off."""
    w = Window.partitionBy(*within)
    return rows.withColumn("_s", score).withColumn("_b", (F.max if highest else F.min)("_s").over(w)).where("_s = _b").drop("_s", "_b")


def perfect_discs(discs: DataFrame, votes: DataFrame, track_keys: list[str], disc_keys: list[str]) -> DataFrame:
    """discs (disc_keys) with perfect: every track has an offset with v1 or v2 votes; a disc without tracks is perfect.

    votes: track_keys, offset, v1, v2, one row or more per track.
    """
    track = votes.groupBy(*track_keys).agg(F.bool_or((F.coalesce("v1", F.lit(0)) > 0) | (F.coalesce("v2", F.lit(0)) > 0)).alias("good"))
    disc = track.groupBy(*disc_keys).agg(F.bool_and("good").alias("good"))
    return discs.join(disc, disc_keys, "left").withColumn("perfect", F.coalesce("good", F.lit(True))).drop("good")


def prune_imperfect_discs(discs: DataFrame, release: str = "release_id", medium: str = "medium_pos") -> DataFrame:
    """First round: of a medium with a perfect disc, only its perfect discs."""
    return keep_matching_if_any(discs, F.col("perfect"), [release, medium])


def prune_imperfect_releases(releases: DataFrame, discs: DataFrame, group: str = "release_group_id", release: str = "release_id") -> DataFrame:
    """Second round: of a group with a release all of whose discs are perfect, only such releases. A release without discs counts as one."""
    whole = discs.groupBy(release).agg(F.bool_and("perfect").alias("whole"))
    rows = releases.join(whole, release, "left").withColumn("whole", F.coalesce("whole", F.lit(True)))
    return keep_matching_if_any(rows, F.col("whole"), [group]).drop("whole")


def occurs_elsewhere(rows: DataFrame, stream: str = "stream_index", item: str = "recording_id", within: tuple[str, ...] = ()) -> DataFrame:
    """rows with elsewhere: the stream stands under another, known, item as well. One grouping, no self-join of rows."""
    keys = [*within, stream]
    seen = rows.where(F.col(item).isNotNull()).groupBy(*keys).agg(F.min(item).alias("_lo"), F.max(item).alias("_hi"))
    other = (F.col("_lo") != F.col(item)) | (F.col("_hi") != F.col(item)) | (F.col(item).isNull() & F.col("_lo").isNotNull())
    return rows.join(seen, keys, "left").withColumn("elsewhere", F.coalesce(other, F.lit(False))).drop("_lo", "_hi")


def valid_configurations(choices: DataFrame, configuration: list[str], stream: str = "stream_index") -> DataFrame:
    """Configurations in which no stream is used twice."""
    return choices.groupBy(*configuration).agg((F.count(stream) == F.count_distinct(stream)).alias("valid"))


def known_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Drop what the catalogue does not list."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def validated(matches: DataFrame, n_streams: int) -> tuple[DataFrame, DataFrame]:
    """(rows in range, rows to reject): index in 1..n, medium position from 1, track position from 0, score in 0..1."""
    ok = F.col("stream_index").between(1, n_streams) & (F.col("medium_pos") >= 1) & (F.col("track_pos") >= 0) & F.col("score").between(0, 1)
    ok = F.coalesce(ok, F.lit(False))
    return matches.where(ok), matches.where(~ok)
