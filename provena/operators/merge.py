"""Merging nested results held as keyed rows, and set operations on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provena.operators.dealing import dealt
from provena.operators.numbering import numbered

KEYS = ["release_group_id", "release_id", "medium_pos", "track_pos", "recording_id", "fingerprint_id", "stream_index"]


def nested_merge(*parts: DataFrame, keys: list[str] = KEYS, score: str = "score") -> DataFrame:
    """Union by key at every level, keeping the highest score. Null ids are equal to each other, as grouping has it."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy(*keys).agg(F.max(score).alias(score))


def merge_recordings(rows: DataFrame) -> DataFrame:
    """One row per recording of a descriptive lookup: fingerprint ids joined by ", " in order of first sight, leaving out one that
    is part of the text so far; highest score; number of releases; date and track only where there is one release.

    rows: recording_id, ordinal, fingerprint_id, score, release_id, date, track.
    """
    first = rows.groupBy("recording_id", "fingerprint_id").agg(F.min("ordinal").alias("at"))
    names = first.groupBy("recording_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "fingerprint_id"))), lambda x: x["fingerprint_id"]).alias("ids"))
    joined = F.aggregate("ids", F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.contains(acc, x), acc).otherwise(F.concat(acc, F.lit(", "), x)))
    whole = rows.groupBy("recording_id").agg(F.max("score").alias("score"), F.count_distinct("release_id").alias("n_releases"), F.min("date").alias("date"), F.min("track").alias("track"))
    one = F.col("n_releases") <= 1
    return whole.join(names.select("recording_id", joined.alias("fingerprint_ids")), "recording_id").select("recording_id", "fingerprint_ids", "score", "n_releases", F.when(one, F.col("date")).otherwise("").alias("date"), F.when(one, F.col("track")).otherwise("").alias("track"))


def union_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def difference(rows: DataFrame, without: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(without, keys, "left_anti")


def common_to_all(rows: DataFrame, item: str, holder: str) -> DataFrame:
    """Items that every holder has."""
    n = rows.agg(F.count_distinct(holder).alias("n_holders"))
    return rows.groupBy(item).agg(F.count_distinct(holder).alias("n")).join(n, F.col("n") == F.col("n_holders")).select(item)


def erase(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those listed; null keys match null keys."""
    g = gone.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return rows.join(g, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")


def add_or_find(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_in_order(rows: DataFrame, keys: list[str], item: str, ordinal: str = "ordinal") -> DataFrame:
    """Distinct items of each key with the place at which each was first seen."""
    return rows.groupBy(*keys, item).agg(F.min(ordinal).alias(ordinal))


def summary(matches: DataFrame) -> DataFrame:
    """Counts of the merged tree per release."""
    return matches.groupBy("release_group_id", "release_id").agg(F.count_distinct("medium_pos").alias("n_media"), F.count_distinct("medium_pos", "track_pos").alias("n_tracks"), F.count_distinct("stream_index").alias("n_streams"))


def sort_releases(releases: DataFrame) -> DataFrame:
    """Distance ascending, score descending, id ascending."""
    return releases.orderBy(F.col("distance").asc(), F.col("score").desc(), F.col("release_id").asc())


def numbered_releases(releases: DataFrame) -> DataFrame:
    """releases with place, their number in the order of sort_releases(), over all of them."""
    return numbered(releases, [F.col("distance").asc(), F.col("score").desc(), F.col("release_id").asc()], "place")


def sort_groups(releases: DataFrame, group: str = "release_group_id") -> DataFrame:
    """Groups by the distance of their best release."""
    return releases.groupBy(group).agg(F.min("distance").alias("distance")).orderBy("distance", group)


def numbered_groups(releases: DataFrame, group: str = "release_group_id") -> DataFrame:
    """(group, distance, place): groups by the distance of their best release, numbered over all of them."""
    best = releases.groupBy(group).agg(F.min("distance").alias("distance"))
    return numbered(best, ["distance", group], "place")


def permute(rows: DataFrame, permutation: DataFrame, index: str = "stream_index", keys: list[str] | None = None) -> DataFrame:
    """Give every row the index that the permutation (old, new) has for its own; with keys, that of its own key's permutation (keys, old, new)."""
    found = permutation.select(*[F.col(k) for k in keys or []], F.col("old").alias(index), "new")
    return rows.join(found, [*(keys or []), index]).withColumn(index, F.col("new")).drop("new").select(rows.columns)


def tracks_in_order(rows: DataFrame, keys: list[str], position: str = "track_pos") -> DataFrame:
    """Each key's rows as an array in order of position: the nested form, for output."""
    rest = [c for c in rows.columns if c not in keys and c != position]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(position, *rest))).alias("items"))


def tree(rows: DataFrame, levels: list[str], n_rows: int | None = None) -> DataFrame:
    """One row per value of the first level with the others nested in `items`, level by level, in order and each once: the whole tree, for output.

    What is not known at a level (null) stands first. A tree is as large as its root's result, so roots are release groups or smaller.
    Rows are dealt by root first, and all levels are grouped in that task; n_rows as in dealt().
    """
    out, cell, collect = dealt(rows.select(*levels), levels[0], n_rows=n_rows), F.struct(levels[-1]), F.collect_set
    for k in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:k]).agg(F.sort_array(collect(cell)).alias("items"))
        cell, collect = F.struct(levels[k - 1], "items"), F.collect_list
    return out
