"""Choosing one stream per track: ranks by residual, constrained assignment, table-of-contents distance."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from provena.shared import written

# assign_exact goes to executors with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ranked_candidates(candidates: DataFrame, track: list[str], stream: str = "stream_index") -> DataFrame:
    """Candidates of each track by absolute residual, ties in order of the stream."""
    w = Window.partitionBy(*track).orderBy(F.abs("residual"), stream)
    return candidates.withColumn("place", F.row_number().over(w))


def total_residual(chosen: DataFrame, configuration: list[str]) -> DataFrame:
    return chosen.groupBy(*configuration).agg(F.sum(F.abs("residual")).alias("residual"))


def assign_exact(tracks: list[tuple], options: dict[tuple, list[int]]) -> dict[tuple, int] | None:
    """One stream per track from each track's options, no stream twice; the first in order of the options, or none.

    Augmenting paths, so a release with many ties takes polynomial time; then the result is made the least in order.
    """
    def solve(fixed: dict[tuple, int]) -> dict[tuple, int] | None:
        owner: dict[int, tuple] = {s: t for t, s in fixed.items()}

        def place(t: tuple, seen: set[int]) -> bool:
            for s in options[t]:
                if s not in seen and (s not in owner or owner[s] not in fixed):
                    seen.add(s)
                    if s not in owner or place(owner[s], seen):
                        owner[s] = t
                        return True
            return False

        for t in tracks:
            if t not in fixed and not place(t, set()):
                return None
        return {t: s for s, t in owner.items()}

    fixed: dict[tuple, int] = {}
    if solve(fixed) is None:
        return None
    for t in tracks:
        for s in options[t]:
            if s not in fixed.values() and solve(fixed | {t: s}) is not None:
                fixed[t] = s
                break
    return fixed


def best_assignment(candidates: DataFrame, release: str = "release_id") -> DataFrame:
    """(release, medium_pos, track_pos, stream_index) of releases that can be filled with residual 0 and no stream twice.

    candidates: release, medium_pos, track_pos, stream_index, residual. A release is one group: its tracks are few.
    """
    per = candidates.groupBy(release, "medium_pos", "track_pos").agg(F.sort_array(F.collect_set(F.when(F.col("residual") == 0, F.col("stream_index")))).alias("options"))
    rows = per.groupBy(release).agg(F.sort_array(F.collect_list(F.struct("medium_pos", "track_pos", "options"))).alias("tracks"))
    fillable = rows.where(F.forall("tracks", lambda t: F.size(t["options"]) > 0))

    def assign(options: pd.Series) -> pd.Series:
        found = (assign_exact(list(range(len(x))), {k: list(y) for k, y in enumerate(x)}) for x in options)
        return pd.Series([None if f is None else [f[k] for k in range(len(f))] for f in found])

    chosen = F.pandas_udf(assign, T.ArrayType(T.IntegerType()))(F.transform("tracks", lambda t: t["options"].cast("array<int>")))
    pairs = fillable.withColumn("chosen", chosen).where("chosen is not null").select(release, F.explode(F.arrays_zip("tracks", "chosen")).alias("x"))
    return pairs.select(release, *(F.col(f"x.tracks.{c}").cast("int").alias(c) for c in ("medium_pos", "track_pos")), F.col("x.chosen").alias("stream_index"))


def configuration_score(chosen: DataFrame, voted: DataFrame, configuration: list[str]) -> DataFrame:
    """Votes of the chosen streams. chosen: configuration, disc_id, track_pos, stream_index. voted: of vote_aggregate."""
    best = voted.groupBy("disc_id", "track_pos").agg(F.max(F.col("conf_v1") + F.col("conf_v2")).alias("votes"))
    return chosen.join(best, ["disc_id", "track_pos"], "left").groupBy(*configuration).agg(F.sum(F.coalesce("votes", F.lit(0))).alias("score"), F.min(F.coalesce("votes", F.lit(0))).alias("confidence_min"), F.count_if(F.col("votes").isNull()).alias("unmatched"))


def best_configuration(scored: DataFrame, within: list[str]) -> DataFrame:
    """Highest least confidence, then fewest unmatched streams, then the first configuration."""
    order = Window.partitionBy(*within).orderBy(F.col("confidence_min").desc(), F.col("unmatched").asc(), "configuration")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_matches(matched: DataFrame, within: list[str], configuration: str = "configuration") -> DataFrame:
    """(within, configuration, n_streams, confidence_min, unmatched): the configurations that no other one of the same release beats.

    matched: within, configuration, stream_index, confidence, one row per stream. One configuration beats another with as many streams by its higher least
    confidence, then by fewer streams without any. Configurations of different numbers of streams cannot be compared, so this is no total order: one best row for
    each number of streams stays, and all that are equal to it.
    """
    scored = matched.groupBy(*within, configuration).agg(F.count("*").alias("n_streams"), F.min("confidence").alias("confidence_min"), F.count_if(~(F.col("confidence") > 0)).alias("unmatched"))
    merit = F.struct(F.col("confidence_min").alias("c"), (-F.col("unmatched")).alias("u"))
    best = scored.groupBy(*within, "n_streams").agg(F.max(merit).alias("_best"))
    return scored.join(best, [*within, "n_streams"]).where(merit == F.col("_best")).select(*within, configuration, "n_streams", "confidence_min", "unmatched")


def apply_choice(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Keep only what the choice holds."""
    return rows.join(chosen.select(*keys).distinct(), keys, "left_semi")


def disc_choices(discs: DataFrame, release: str = "release_id") -> DataFrame:
    """Every choice of one disc per medium: (release, configuration, discs). Media without discs are skipped; disc ids in order.

    The product is built medium by medium inside the release's row, as arrays.
    """
    media = discs.groupBy(release, "medium_pos").agg(F.sort_array(F.collect_set("disc_id")).alias("ids"))
    rows = media.groupBy(release).agg(F.sort_array(F.collect_list(F.struct("medium_pos", "ids"))).alias("media"))
    start = F.array(F.array().cast("array<string>"))
    grown = F.aggregate("media", start, lambda acc, m: F.flatten(F.transform(acc, lambda a: F.transform(m["ids"], lambda d: F.concat(a, F.array(d))))))
    return rows.select(release, F.posexplode(grown).alias("configuration", "discs"))


def toc_distance(tracks: DataFrame, streams: DataFrame, disc: list[str], position: str = "track_pos") -> DataFrame:
    """Sum of the absolute differences of lengths, position by position, of each disc and each candidate list of streams.

    tracks: disc keys, position, sectors. streams: candidate, position, length.
    """
    rows = tracks.join(streams, position)
    return rows.groupBy(*disc, "candidate").agg(F.sum(F.abs(F.col("sectors") - F.col("length"))).alias("distance"))


#: Groups of positions whose sums bound a distance from below, and pairs per list of a first round at most.
_GROUPS, _MET = 3, 64


def _group_sums(values: str) -> list[Column]:
    """The sums of an array's first, middle and last third; of three values or fewer, the values themselves."""
    def one(k: int) -> Column:
        inside = F.filter(values, lambda _, i: F.call_function("div", i * _GROUPS, F.size(values)) == k)
        return F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x).alias(f"_s{k}")

    return [one(k) for k in range(_GROUPS)]


def nearest_toc_bounded(tracks: DataFrame, streams: DataFrame, disc: list[str], position: str = "track_pos", reach: int | None = None) -> DataFrame:
    """(disc, candidate, distance, compared): nearest_toc(toc_distance(...)) without all pairs; compared: how many different lists the disc was held against.

    Equal lists are one, on both sides. The positions are cut into three groups; the differences of the groups' sums together are never above the distance of the lists. So lists
    meet in the cells of a grid over these sums, twice as wide as the reach; a disc whose best distance is within reach is done, since whatever it did not meet is
    farther away. The others go on with twice the reach, or more where the distances found say so. Sums are taken over the positions that a disc and a candidate share, for
    each pair of sets of positions that there is. reach: of the first round; by default so that a list meets some tens of others.
    """
    shape, whose, sums = ["_have", "_common"], ["_have", "_of"], [f"_s{k}" for k in range(_GROUPS)]
    entries = lambda length: F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(length).cast("long").alias("n"))))
    part = lambda c, f: F.transform(c, lambda x: x[f])
    known = tracks.groupBy(*disc).agg(F.map_from_entries(entries("sectors")).alias("_at")).select(*disc, F.map_keys("_at").alias("_have"), F.map_values("_at").alias("_of"))
    known = written(known, "toc-discs")
    # a candidate meets each set of positions that discs have, where they share one; the sets are few
    places = known.select("_have").distinct().select("_have", F.explode("_have").alias(position))
    offered = streams.join(places, position).groupBy("candidate", "_have").agg(entries("length").alias("_at"))
    offered = offered.groupBy("_have", part("_at", "p").alias("_common"), part("_at", "n").alias("_lengths")).agg(F.min("candidate").alias("candidate"))
    offered = written(offered.select("*", *_group_sums("_lengths")), "toc-candidates")
    open_ = known.select(*whose).distinct().join(offered.select(*shape).distinct(), "_have")
    open_ = open_.withColumn("_sectors", F.transform("_common", lambda p: F.map_from_arrays("_have", "_of")[p]))
    open_ = written(open_.select("*", *_group_sums("_sectors")), "toc-open")

    def cells(rows: DataFrame, values: str, reach: int, sides: tuple[int, ...]) -> DataFrame:
        """rows with their cells _c0 to _c2, one row for each cell that a move by reach to these sides leads to."""
        cell = lambda c: F.floor(c / F.lit(2 * reach)).cast("long")
        for k, c in enumerate(sums):
            rows = rows.withColumn(f"_c{k}", F.explode(F.when(F.size(values) > k, F.array(*(cell(F.col(c) + d * reach) for d in sides))).otherwise(F.array(F.lit(0).cast("long")))))
        return rows

    grid = [*shape, *(f"_c{k}" for k in range(_GROUPS))]

    def pairs(reach: int) -> int:
        count = lambda rows, n: rows.groupBy(*grid).agg(F.count("*").alias(n))
        both = count(cells(open_, "_sectors", reach, (-1, 1)), "_n").join(count(cells(offered, "_lengths", reach, (0,)), "_m"), grid)
        return int(both.agg(F.sum(F.col("_n").cast("decimal(38,0)") * F.col("_m"))).first()[0] or 0)

    far = sum((F.abs(c) for c in sums), F.lit(0))
    farthest = sum(int(rows.agg(F.max(far)).first()[0] or 0) for rows in (open_, offered))
    if reach is None:
        reach, lists = max(farthest, 1), open_.count()
        while reach > 1 and pairs(reach) > _MET * lists:
            reach = max(reach // 4, 1)
    done: list[DataFrame] = []
    while True:
        whole = reach >= farthest
        met = cells(open_, "_sectors", reach, (-1, 1)).join(cells(offered.withColumnsRenamed({c: f"_t{c}" for c in sums}).withColumns({c: F.col(f"_t{c}") for c in sums}), "_lengths", reach, (0,)).drop(*sums), grid)
        met = met.where(sum((F.abs(F.col(c) - F.col(f"_t{c}")) for c in sums), F.lit(0)) <= reach)
        met = met.withColumn("distance", F.aggregate(F.zip_with("_sectors", "_lengths", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda a, x: a + x))
        best = met.groupBy(*whose).agg(F.min(F.struct("distance", "candidate")).alias("b"), F.count("*").alias("compared"))
        best = written(best.select(*whose, F.col("b.candidate").alias("candidate"), F.col("b.distance").alias("distance"), "compared"), "toc-best")
        settled = best if whole else best.where(F.col("distance") <= reach)
        done.append(settled)
        if whole:
            break
        open_ = written(open_.join(settled.select(*whose), whose, "left_anti"), "toc-open")
        if open_.isEmpty():
            break
        # within the distance that a disc has found already it is done at the latest
        found = best.where(F.col("distance") > reach).agg(F.percentile_approx("distance", 0.1).alias("d")).first()["d"]
        reach = max(2 * reach, found or 0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return known.join(out, whose).select(*disc, "candidate", "distance", "compared")


def nearest_toc(distances: DataFrame, disc: list[str]) -> DataFrame:
    """The candidate at the least distance, the first of equal ones."""
    best = distances.groupBy(*disc).agg(F.min(F.struct("distance", "candidate")).alias("b"))
    return best.select(*disc, F.col("b.candidate").alias("candidate"), F.col("b.distance").alias("distance"))
