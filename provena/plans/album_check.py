"""The whole check of albums: files and stored answers in, mismatches out. Any number of albums goes through at once.

What several stages read (samples, candidates, placed tracks, votes) is written once in the shared folder, so no stage repeats the ones before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.exprs import duration_sectors
from provena.operators import checksum, cover, discs, limiter, merge, report, tags, votes
from provena.schema import SAMPLES_PER_SECTOR, SKIP_HEAD, SKIP_TAIL
from provena.shared import written
from provena.sources import binary, lookup_xml


@dataclass
class Album:
    """What the check reads. Stream numbers are unique over all albums; a lookup is one album's request.

    files: stream_index, content (octets of a wave). file_tags: stream_index and the compared fields. requests: lookup, streams (the order of the request). answers: lookup, body.
    catalogue: release_id, medium_pos, track_pos, recording_id, title and the compared fields. media: release_id, medium_pos, disc_id, leadout. offsets: disc_id, position,
    offset. rips and eac: path, content (octets of the two databases' answers). remap: disc_id, path.
    """

    files: DataFrame
    file_tags: DataFrame
    requests: DataFrame
    answers: DataFrame
    catalogue: DataFrame
    media: DataFrame
    offsets: DataFrame
    rips: DataFrame
    eac: DataFrame
    remap: DataFrame


def candidates(album: Album, streams: DataFrame) -> DataFrame:
    """(lookup, release_group_id, release_id, medium_pos, track_pos, stream_index, recording_id, fingerprint_id) of the releases that have every stream of
    their lookup, filled up with the streams that no track has.
    """
    found = limiter.original_streams(lookup_xml.matches(album.answers, ["lookup"]), album.requests).where("release_id is not null")
    place = ["lookup", "release_group_id", "release_id", "medium_pos", "track_pos", "stream_index", "recording_id", "fingerprint_id"]
    found = written(merge.nested_merge(found.select(*place, "score"), keys=place), "matches")
    need = streams.groupBy("lookup").agg(F.count_distinct("stream_index").alias("need"))
    have = found.groupBy("lookup", "release_id").agg(F.count_distinct("stream_index").alias("have")).join(need, "lookup").where("have = need")
    have = written(have, "covering")
    found = found.join(have.select("lookup", "release_id"), ["lookup", "release_id"], "left_semi")
    catalogue = have.select("lookup", "release_id").join(album.catalogue.select("release_id", "medium_pos", "track_pos"), "release_id")
    whole = discs.complete(found, catalogue, streams)
    groups = found.groupBy("lookup", "release_id").agg(F.min("release_group_id").alias("release_group_id"))
    prints = found.groupBy("lookup", "stream_index").agg(F.min("fingerprint_id").alias("fingerprint_id"))
    return whole.distinct().join(groups, ["lookup", "release_id"]).join(prints, ["lookup", "stream_index"]).select(*place)


def placed_on_discs(album: Album, found: DataFrame, samples: DataFrame) -> DataFrame:
    """(release_id, medium_pos, disc_id, track_pos, stream_index) of the discs that no stream rejects."""
    lengths = discs.track_lengths(album.offsets, album.media.select("disc_id", "leadout").distinct()).select("disc_id", F.col("position").alias("track_pos"), "sectors")
    tracks = album.media.select("release_id", "medium_pos", "disc_id").distinct().join(lengths, "disc_id")
    durations = samples.groupBy("stream_index").agg(duration_sectors(F.count("*")).alias("sectors"))
    fitting = discs.assign_discs(found, tracks, durations)
    return fitting.join(album.media.select("release_id", "medium_pos", "disc_id").distinct(), "disc_id").join(found.select("release_id", "medium_pos", "track_pos", "stream_index").distinct(), ["release_id", "medium_pos", "track_pos", "stream_index"], "left_semi")


def votes_of_both(album: Album, placed: DataFrame, samples: DataFrame, centre: int, half: int, width: int, head: int, tail: int) -> tuple[DataFrame, DataFrame]:
    """(votes of the rip database at every offset that any track of a disc found, and at none; votes of the second database at none)."""
    leadouts = album.media.select("disc_id", "leadout").distinct()
    asked = discs.remapped(discs.disc_ids(album.offsets, leadouts), album.remap)
    asked = written(asked, "discs")
    rips = written(asked.select("disc_id", "path").join(binary.decode_rip(album.rips), "path"), "rips")
    on_disc = placed.select("disc_id", "track_pos", "stream_index").distinct()
    targets = on_disc.join(rips, ["disc_id", "track_pos"]).select("stream_index", F.col("offset_crc").alias("target"))
    shifts = checksum.find_offsets(samples, targets, centre, half, width)
    # what one track of a disc has found is tried with all of them
    every = written(shifts.join(on_disc, "stream_index").select("disc_id", "offset").distinct(), "offsets")
    tried = on_disc.join(every, "disc_id").select(F.col("disc_id").alias("disc"), "track_pos", "offset").unionByName(on_disc.select(F.col("disc_id").alias("disc"), "track_pos", F.lit(0).cast("long").alias("offset"))).distinct()
    of_tracks = samples.join(on_disc, "stream_index").select(F.col("disc_id").alias("disc"), "track_pos", "j", "s")
    sums = checksum.checksums_at_offsets(of_tracks, tried, head, tail).withColumnRenamed("disc", "disc_id")
    voted = votes.vote_aggregate(sums, rips.select("disc_id", "track_pos", "crc", "confidence"))
    crcs = checksum.region_crcs(of_tracks, ["disc", "track_pos"]).select(F.col("disc").alias("disc_id"), "track_pos", F.lit(0).cast("long").alias("offset"), "crc32")
    eac = discs.eac_paths(asked.select("disc_id", "n_tracks")).select("disc_id", F.col("eac_path").alias("path")).join(binary.decode_eac(album.eac), "path").where("kind = 'whole'")
    return voted, votes.eac_vote_aggregate(crcs, eac.select("disc_id", "track_pos", "crc32", "count"))


def check(album: Album, fields: tuple[str, ...] = tags.COMPARED, centre: int = 450 * SAMPLES_PER_SECTOR, half: int = 5 * SAMPLES_PER_SECTOR, width: int = SAMPLES_PER_SECTOR, head: int = SKIP_HEAD, tail: int = SKIP_TAIL) -> tuple[DataFrame, DataFrame]:
    """(tracks, findings), as report.report_lines() takes them.

    Decode, look up, merge, keep the releases that cover their album, fill up, place on discs, keep the releases whose discs hold every stream if there is one, search offsets, count votes,
    compare tags.
    """
    samples = written(binary.decode_wav(album.files).select("stream_index", "j", "s"), "samples")
    streams = album.requests.select("lookup", F.explode("streams").alias("stream_index"))
    found = written(candidates(album, streams), "candidates")
    placed = written(placed_on_discs(album, found, samples), "placed")
    releases = found.select("lookup", "release_id").distinct()
    flagged = cover.with_matching_discs(releases, found.select("release_id", "stream_index").distinct(), placed.select("release_id", "stream_index").distinct())
    kept = written(cover.keep_matching_if_any(flagged, F.col("matches"), ["lookup"]).select("release_id").distinct(), "releases")
    found, placed = found.join(kept, "release_id", "left_semi"), placed.join(kept, "release_id", "left_semi")
    place = ["release_id", "medium_pos", "track_pos", "stream_index"]
    on_disc = found.join(placed.select(*place, "disc_id"), place).select(*report.PLACE, "stream_index", "fingerprint_id")
    with_discs = placed.select("release_id", "medium_pos").distinct()
    without = found.where("recording_id is not null").join(with_discs, ["release_id", "medium_pos"], "left_anti").withColumn("disc_id", F.lit(None).cast("string")).select(*report.PLACE, "stream_index", "fingerprint_id")
    tracks = written(on_disc.unionByName(without).distinct(), "tracks")
    voted, voted_eac = (written(v, "votes") for v in votes_of_both(album, placed, samples, centre, half, width, head, tail))
    mine = tracks.select(*place).distinct()
    diffs = tags.field_diff(mine.join(album.file_tags, "stream_index"), mine.join(album.catalogue, place[:3]), place, fields)
    return tracks, report.mismatch_report(tracks, voted, written(diffs, "differences"), voted_eac)
