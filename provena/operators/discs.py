"""Discs: identifiers from track offsets, track lengths, completion and assignment of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.exprs import cddb_id, digit_sum, eac_path, rip_path, track_second, u32
from provena.operators.cover import occurs_elsewhere
from provena.schema import LEAD_IN


def disc_ids(offsets: DataFrame, leadouts: DataFrame, disc: str = "disc_id") -> DataFrame:
    """(disc, n_tracks, id1, id2, cddb, path) from offsets (disc, position, offset) and leadouts (disc, leadout), in sectors.

    A disc whose first offset lies in the lead-in, or without offsets, has no row. Only an offset of exactly the lead-in counts 1 in id2.
    """
    o = F.col("offset") - LEAD_IN
    sums = offsets.groupBy(disc).agg(
        F.count("*").alias("n_tracks"),
        F.sum(o).alias("s1"),
        F.sum(F.when(o == 0, 1).otherwise(o) * F.col("position")).alias("s2"),
        F.sum(digit_sum(track_second(F.greatest(o, F.lit(0))))).alias("digits"),
        F.min_by("offset", "position").alias("first"),
    )
    end = F.col("leadout") - LEAD_IN
    rows = sums.join(leadouts.select(disc, "leadout"), disc).where(F.col("first") >= LEAD_IN)
    rows = rows.select(disc, "n_tracks", u32(F.col("s1") + end).alias("id1"), u32(F.col("s2") + end * (F.col("n_tracks") + 1)).alias("id2"), cddb_id(F.col("digits"), F.col("first") - LEAD_IN, end, F.col("n_tracks")).alias("cddb"))
    return rows.withColumn("path", rip_path(F.col("id1"), F.col("id2"), F.col("cddb"), F.col("n_tracks")))


def eac_paths(discs: DataFrame) -> DataFrame:
    """discs (disc_id of 28 characters, n_tracks) with the path in the second database."""
    return discs.withColumn("eac_path", eac_path(F.col("disc_id"), F.col("n_tracks")))


def remapped(discs: DataFrame, remap: DataFrame) -> DataFrame:
    """The path that the remap table has for a disc, else its own. The table is a hand-kept list; Spark decides how to join it."""
    other = remap.groupBy("disc_id").agg(F.min("path").alias("other"))
    return discs.join(other, "disc_id", "left").withColumn("path", F.coalesce("other", "path")).drop("other")


def responses(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (path) with what is stored under their path; status 0 for a 2xx answer, 1 for 4xx, else -1; entries only with status 0."""
    http = F.col("http")
    status = F.when(http.between(200, 299), 0).when(http.between(400, 499), 1).otherwise(-1)
    return requests.join(stored, "path", "left").withColumn("status", status)


def track_lengths(offsets: DataFrame, leadouts: DataFrame, disc: str = "disc_id", lenient: bool = False) -> DataFrame:
    """offsets with sectors: next track's offset less one's own; the lead-out's after the last track; -1 where the next is missing.

    lenient: the lead-out stands for any missing next track.
    """
    following = offsets.groupBy(disc, (F.col("position") - 1).alias("position")).agg(F.min("offset").alias("next"))
    last = offsets.groupBy(disc).agg(F.max("position").alias("last"))
    rows = offsets.join(following, [disc, "position"], "left").join(last, disc).join(leadouts.select(disc, "leadout"), disc, "left")
    end = F.col("leadout") if lenient else F.when(F.col("position") == F.col("last"), F.col("leadout"))
    return rows.withColumn("sectors", F.coalesce(F.coalesce("next", end) - F.col("offset"), F.lit(-1))).drop("next", "last", "leadout")


def complete(candidates: DataFrame, catalogue: DataFrame, streams: DataFrame, release: str = "release_id", lookup: str = "lookup") -> DataFrame:
    """Candidates filled up: streams of a lookup that are matched nowhere in a release become candidates, without a recording, for every
    catalogue track of the release that has no match.

    candidates: lookup, release, medium_pos, track_pos, stream_index, recording_id. catalogue: lookup, release, medium_pos, track_pos. streams: lookup,
    stream_index. Everything meets on (lookup, release), so the fill is per release: open tracks times open streams.
    """
    place = [lookup, release, "medium_pos", "track_pos"]
    open_tracks = catalogue.select(*place).distinct().join(candidates, place, "left_anti")
    needs = open_tracks.select(lookup, release).distinct()
    matched = candidates.select(lookup, release, "stream_index").distinct()
    open_streams = needs.join(streams.select(lookup, "stream_index").distinct(), lookup).join(matched, [lookup, release, "stream_index"], "left_anti")
    kind = candidates.schema["recording_id"].dataType
    filled = open_tracks.join(open_streams, [lookup, release]).withColumn("recording_id", F.lit(None).cast(kind))
    return candidates.select(*place, "stream_index", "recording_id").unionByName(filled.select(*place, "stream_index", "recording_id"))


def assign_discs(candidates: DataFrame, disc_tracks: DataFrame, durations: DataFrame) -> DataFrame:
    """(disc_id, track_pos, stream_index, recording_id) of the discs that no stream rejects.

    A stream of the wrong length rejects the whole disc, unless its candidate has no recording (it was filled in) or the stream stands under another,
    known recording of the release too. candidates: release_id, medium_pos, track_pos, stream_index, recording_id. disc_tracks: release_id,
    medium_pos, disc_id, track_pos, sectors. durations: stream_index, sectors.
    """
    c = occurs_elsewhere(candidates, within=("release_id",)).join(durations.select("stream_index", F.col("sectors").alias("length")), "stream_index")
    rows = c.join(disc_tracks, ["release_id", "medium_pos", "track_pos"])
    fits = F.col("length") == F.col("sectors")
    bad = rows.where(~fits & F.col("recording_id").isNotNull() & ~F.col("elsewhere")).select("disc_id").distinct()
    return rows.where(fits).join(bad, "disc_id", "left_anti").select("disc_id", "track_pos", "stream_index", "recording_id").distinct()


def disc_offsets_union(found: DataFrame) -> DataFrame:
    """Distinct offsets of every stream of a disc: the union of what its tracks found, given to each of them."""
    every = found.select("disc_id", "offset").distinct()
    return found.select("disc_id", "stream_index").distinct().join(every, "disc_id").select("stream_index", "offset").distinct()
