"""Reports: what does not fit between files, rip databases and the catalogue, as rows; and printed configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provena.operators import dealing
from provena.operators.numbering import counted
from provena.shared import written

PLACE = ["release_group_id", "release_id", "medium_pos", "disc_id", "track_pos"]
_CELLS = {"offset": "long", "conf_v1": "long", "conf_v2": "long", "conf_total": "long", "conf_max": "int", "conf_eac": "long", "eac_total": "long", "eac_max": "long", "stream_index": "int", "field": "string", "file_value": "string", "database_value": "string"}


def _rows(found: DataFrame, kind: Column, **cells: Column) -> DataFrame:
    return found.select(*PLACE, kind.alias("kind"), *(cells.get(c, F.lit(None)).cast(t).alias(c) for c, t in _CELLS.items()))


def votes_of_tracks(voted: DataFrame, voted_eac: DataFrame | None) -> DataFrame:
    """(disc_id, track_pos, votes, total, max, eac_total, eac_max): the tracks that a database knows, a row each, with the offsets that got votes of either.

    votes: array of (offset, conf_v1, conf_v2, conf_eac), empty where no offset got any. What a database does not know is 0. Frames that are partitioned by track are
    not exchanged again.
    """
    key, own = ["disc_id", "track_pos"], ["total", "max", "eac_total", "eac_max"]
    long = lambda c: F.col(c).cast("long")
    none, count = F.lit(None).cast("long"), lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    cell = lambda v, e: F.struct("offset", count(v["conf_v1"]).alias("conf_v1"), count(v["conf_v2"]).alias("conf_v2"), count(e["conf_eac"]).alias("conf_eac"))
    v, e = F.struct(long("conf_v1").alias("conf_v1"), long("conf_v2").alias("conf_v2")), F.struct((none if voted_eac is None else long("conf_eac")).alias("conf_eac"))
    no_v, no_e = F.struct(none.alias("conf_v1"), none.alias("conf_v2")), F.struct(none.alias("conf_eac"))
    first = voted.select(*key, "offset", long("total").alias("total"), long("max").alias("max"), none.alias("eac_total"), none.alias("eac_max"), v.alias("_v"))
    if voted_eac is None:
        rows = first.withColumn("_cells", F.array(cell(F.col("_v"), no_e)))
    else:
        second = voted_eac.select(*key, "offset", none.alias("total"), none.alias("max"), long("total").alias("eac_total"), long("max").alias("eac_max"), e.alias("_e"))
        both = first.unionByName(second, allowMissingColumns=True)
        # an offset of both is one cell; one that a database names twice is met by each of the other's, and unknown ones meet nothing
        side = F.when(F.col("offset").isNull(), F.col("_e").isNull())
        lists = [F.collect_list("_v").alias("_v"), F.collect_list("_e").alias("_e")]
        rows = both.groupBy(*key, "offset", side.alias("_side")).agg(*lists, *(F.max(c).alias(c) for c in own))
        vs, es = F.when(F.size("_v") > 0, F.col("_v")).otherwise(F.array(no_v)), F.when(F.size("_e") > 0, F.col("_e")).otherwise(F.array(no_e))
        rows = rows.withColumn("_cells", F.flatten(F.transform(vs, lambda x: F.transform(es, lambda y: cell(x, y)))))
    got = F.filter("_cells", lambda c: c["conf_v1"] + c["conf_v2"] + c["conf_eac"] > 0)
    tracks = rows.select(*key, *own, got.alias("_cells")).groupBy(*key).agg(F.flatten(F.collect_list("_cells")).alias("votes"), *(count(F.max(c)).alias(c) for c in own))
    return tracks.where("total > 0 or eac_total > 0")


def _places(tracks: DataFrame) -> DataFrame:
    """PLACE, a row each, with _streams and _more: whether a disc's track has more than one stream, a track without disc more than one fingerprint."""
    several = F.coalesce(F.min("fingerprint_id") < F.max("fingerprint_id"), F.lit(False))
    places = tracks.groupBy(*PLACE).agg(F.collect_set("stream_index").alias("_streams"), several.alias("_prints"))
    return places.select(*PLACE, "_streams", F.when(F.col("disc_id").isNull(), F.col("_prints")).otherwise(F.size("_streams") > 1).alias("_more"))


def _with_fields(places: DataFrame, diffs: DataFrame) -> DataFrame:
    """places with _fields, the differences of their streams, in place of _streams. Frames that are partitioned by release_id are not exchanged again."""
    key = ["release_id", "medium_pos", "track_pos"]
    rest = [c for c in places.columns if c not in key]
    place, said = F.struct(*rest).alias("_p"), F.struct("stream_index", "field", "file_value", "database_value").alias("_d")
    rows = places.select(*key, place).unionByName(diffs.dropna(subset=key).select(*key, said), allowMissingColumns=True)
    met = rows.groupBy(*key).agg(F.collect_list("_p").alias("_p"), F.collect_list("_d").alias("_d")).select(*key, F.explode("_p").alias("_p"), "_d")
    fields = F.filter("_d", lambda d: F.array_contains("_p._streams", d["stream_index"]))
    return met.select(*(F.col(c if c in key else f"_p.{c}").cast(places.schema[c].dataType).alias(c) for c in PLACE), "_p._more", fields.alias("_fields"))


def mismatch_report(tracks: DataFrame, voted: DataFrame, diffs: DataFrame, voted_eac: DataFrame | None = None) -> DataFrame:
    """One row per finding, with its place and kind.

    no_disc: a medium that no disc fits (track_pos null). votes: an offset of a disc's track that got votes of either database. bad_rip: a track that one of
    them knows and no offset of which got any. several_streams: a track of a disc with more than one stream. several_fingerprints: a track of a medium without
    discs with more than one fingerprint. field: a tag that differs from the catalogue.

    tracks: PLACE (disc_id null where the medium has none), stream_index, fingerprint_id. voted: as vote_aggregate returns; voted_eac: as
    eac_vote_aggregate returns. diffs: release_id, medium_pos, track_pos, stream_index, field, file_value, database_value.
    """
    alone = F.col("disc_id").isNull()
    # a place is met four times below, so it is made once; what is said of a disc's track goes to its places in one join, votes and bad rips alike
    places = written(_places(tracks), "places")
    no_disc = places.where(alone).select(*PLACE[:-1], F.lit(None).cast(places.schema["track_pos"].dataType).alias("track_pos")).distinct()
    on_disc = places.where(~alone).select(*PLACE).join(votes_of_tracks(voted, voted_eac), ["disc_id", "track_pos"])
    on_disc = on_disc.select(*PLACE, "total", "max", "eac_total", "eac_max", F.explode_outer("votes").alias("vote")).withColumn("_got", F.col("vote").isNotNull())
    cells = {c: F.when(F.col("_got"), F.col(x)) for c, x in {"offset": "vote.offset", "conf_v1": "vote.conf_v1", "conf_v2": "vote.conf_v2", "conf_total": "total", "conf_max": "max", "conf_eac": "vote.conf_eac", "eac_total": "eac_total", "eac_max": "eac_max"}.items()}
    more = F.when(F.col("_more"), F.when(alone, "several_fingerprints").otherwise("several_streams"))
    at = places.select(*PLACE, "_streams").join(diffs, ["release_id", "medium_pos", "track_pos"]).where(F.array_contains("_streams", F.col("stream_index")))
    found = [
        _rows(no_disc, F.lit("no_disc")),
        _rows(on_disc, F.when(F.col("_got"), "votes").otherwise("bad_rip"), **cells),
        _rows(places.withColumn("kind", more).where("kind is not null"), F.col("kind")),
        _rows(at, F.lit("field"), stream_index=F.col("stream_index"), field=F.col("field"), file_value=F.col("file_value"), database_value=F.col("database_value")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


#: Findings in the order in which they stand below their heading.
_KINDS = ["no_disc", "votes", "bad_rip", "several_streams", "several_fingerprints", "field"]
_TEXTS = {"no_disc": "no disc fits", "bad_rip": "bad rip", "several_streams": "more than one stream", "several_fingerprints": "more than one fingerprint"}
_LEVELS = ["release group ", "release ", "medium ", "disc ", "track "]


def _cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def _votes_text(offset, got, total, most, eac, eac_total, eac_max) -> Column:
    return F.concat(F.lit("offset "), offset, F.lit(": "), got, F.lit(" of "), total, F.lit(" (max "), most, F.lit("), "), eac, F.lit(" of "), eac_total, F.lit(" (max "), eac_max, F.lit(")"))


def _field_text(stream, field, file_value, database_value) -> Column:
    return F.concat(F.lit("stream "), _cell(stream), F.lit(": "), _cell(field), F.lit(" is "), _cell(file_value), F.lit(", not "), _cell(database_value))


def _line(level: int, depth: int, text: Column) -> Column:
    """A line of a place: how many columns of PLACE it shows, its depth, its text."""
    return F.struct(F.lit(level).alias("level"), F.lit(depth).alias("depth"), text.alias("text"))


def _in_print(places: DataFrame, n_places: int, tops: DataFrame, heads: Column, said: Column, n_said: Column, no_disc: bool) -> DataFrame:
    """(line, PLACE, depth, text) from places, a row each, under their headings.

    places: PLACE and what the rest is made of. heads: how many headings may stand above, 5 at a track, 3 at a medium. said: an array of _line() in order, of n_said.
    tops: the release groups, a row each. no_disc: whether the first place of a medium without disc says that none fits. Places and not lines are put in order and written; lines are made when their numbers are known.
    """
    group = F.col("release_group_id")
    # a release's places share a task, so that the one before is seen there; groups go over several and have a row of their own
    rows = places.withColumn("_top", F.lit(False)).unionByName(tops.withColumn("_top", F.lit(True)), allowMissingColumns=True)
    order = [group.asc(), F.col("release_id").asc(), F.col("_top").desc(), *(F.col(c).asc() for c in PLACE[2:])]
    w = Window.partitionBy(*PLACE[:2]).orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, -1)
    n = [dealing.tasks(rows.sparkSession, n_places)] if n_places > dealing.TASK_ROWS else []
    placed = rows.repartitionByRange(*n, *PLACE[:2])
    placed = placed.withColumn("_before", F.last(F.when(~F.col("_top") & (heads > 0), F.struct(*PLACE[2:])), ignorenulls=True).over(w))
    new = F.when(F.col("_before").isNull(), 1)
    for k, c in enumerate(PLACE[2:], 2):
        new = new.when(~F.col(f"_before.{c}").eqNullSafe(F.col(c)), k)
    placed = placed.withColumn("_new", new.otherwise(len(PLACE))).drop("_before")
    shown = [F.col("_top"), *(~F.col("_top") & (heads > k) & (F.col("_new") <= k) for k in range(1, len(PLACE)))]
    shown[3] &= F.col("disc_id").isNotNull()
    says = F.lit(no_disc) & shown[2] & F.col("disc_id").isNull()
    heads = [F.when(shown[k], _line(k + 1, k, F.concat(F.lit(word), F.col(c).cast("string")))) for k, (c, word) in enumerate(zip(PLACE, _LEVELS, strict=True))]
    none = F.when(says, _line(3, 3, F.lit(_TEXTS["no_disc"])))
    # a track without a position stands where its medium's own lines do, headings before findings
    below = [F.when(F.col("track_pos").isNotNull(), none), heads[4], F.when(F.col("track_pos").isNull(), none)]
    lines = F.concat(F.array_compact(F.array(*heads[:4], *below)), F.when(~F.col("_top"), said).otherwise(F.array().cast("array<struct<level:int,depth:int,text:string>>")))
    takes = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (*shown, says)), F.when(~F.col("_top"), n_said).otherwise(0))
    out = counted(placed, "line", takes=takes).select("line", *PLACE, F.posexplode(lines).alias("_nth", "_l"))
    return out.select((F.col("line") + F.col("_nth")).alias("line"), *(F.when(F.col("_l.level") > k, F.col(c)).alias(c) for k, c in enumerate(PLACE)), "_l.depth", "_l.text")


def printed_report(tracks: DataFrame, voted: DataFrame, diffs: DataFrame, voted_eac: DataFrame | None = None) -> DataFrame:
    """report_lines() of mismatch_report(), without a row for each finding in between: a place carries what is said of it, in short.

    _texts: what is said below the votes. _votes: "total max eac_total eac_max" of a track that a database knows and then "offset v1+v2 eac" of each offset that got
    votes, in order, parted by semicolons; in order of the printed text where an offset stands twice.
    """
    alone = F.col("disc_id").isNull()
    differs = lambda d: F.struct(d["stream_index"].alias("stream_index"), d["field"].alias("field"), _field_text(d["stream_index"], d["field"], d["file_value"], d["database_value"]).alias("text"))
    more = F.when(F.col("_more"), F.when(alone, _TEXTS["several_fingerprints"]).otherwise(_TEXTS["several_streams"]))
    texts = F.concat(F.array_compact(F.array(more)), F.transform(F.sort_array(F.transform("_fields", differs)), lambda x: x["text"]))
    places = written(_with_fields(_places(tracks), diffs).select(*PLACE, texts.alias("_texts")), "places")
    vote = lambda v: F.struct(v["offset"], F.concat(_cell(v["offset"]), F.lit(" "), v["conf_v1"].cast("string"), F.lit("+"), v["conf_v2"].cast("string"), F.lit(" "), v["conf_eac"].cast("string")).alias("text"))
    votes = F.concat(F.array(F.concat_ws(" ", "total", "max", "eac_total", "eac_max")), F.transform(F.sort_array(F.transform("votes", vote)), lambda x: x["text"]))
    known = votes_of_tracks(voted, voted_eac).select("disc_id", "track_pos", F.array_join(votes, ";").alias("_votes"))
    rows = places.where(~alone).join(known, ["disc_id", "track_pos"], "left").unionByName(places.where(alone), allowMissingColumns=True)
    parts = F.split("_votes", ";")
    own, got = F.split(parts[0], " "), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    printed = lambda c: _votes_text(F.split(c, " ")[0], F.split(c, " ")[1], own[0], own[1], F.split(c, " ")[2], own[2], own[3])
    below = F.when(F.col("_votes").isNull(), F.array().cast("array<string>")).when(F.size(parts) == 1, F.array(F.lit(_TEXTS["bad_rip"]))).otherwise(F.transform(got, printed))
    n = F.coalesce(F.when(F.col("_votes").isNotNull(), F.greatest(F.size(parts) - 1, F.lit(1))), F.lit(0)) + F.size("_texts")
    said = F.transform(F.concat(below, F.col("_texts")), lambda x: _line(5, 5, x))
    return _in_print(rows, places.count(), places.select("release_group_id").distinct(), F.lit(len(PLACE)), said, n, True)


def report_lines(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """(line, depth, text) with PLACE: the report in print, numbered from 1 in order of its places.

    Headings of release groups, releases, media, discs and tracks stand above what was found there. tracks and found: as mismatch_report takes and
    returns them. No task sees the whole report.
    """
    kind, text, cell = F.lit(None).cast("int"), F.lit(None).cast("string"), lambda c: _cell(F.col(c))
    said = {k: F.lit(t) for k, t in _TEXTS.items()} | {
        "votes": _votes_text(cell("offset"), F.concat(cell("conf_v1"), F.lit("+"), cell("conf_v2")), *map(cell, ("conf_total", "conf_max", "conf_eac", "eac_total", "eac_max"))),
        "field": _field_text(*map(F.col, ("stream_index", "field", "file_value", "database_value"))),
    }
    for k, name in enumerate(_KINDS):
        kind, text = F.when(F.col("kind") == name, k).otherwise(kind), F.when(F.col("kind") == name, said[name]).otherwise(text)
    rows = found.select(*PLACE, F.when(F.col("kind") == "no_disc", 3).otherwise(0).alias("_heads"), F.struct(kind.alias("kind"), "offset", "stream_index", "field", text.alias("text")).alias("_f"))
    rows = tracks.select(*PLACE, F.lit(len(PLACE)).alias("_heads")).unionByName(rows, allowMissingColumns=True)
    rows = written(rows.groupBy(*PLACE).agg(F.max("_heads").alias("_heads"), F.sort_array(F.collect_list("_f")).alias("_found")), "places")
    line = lambda f: F.when(f["kind"] == 0, _line(3, 3, f["text"])).otherwise(_line(5, 5, f["text"]))
    tops = rows.where("_heads > 0").select("release_group_id").distinct()
    return _in_print(rows, rows.count(), tops, F.col("_heads"), F.transform("_found", line), F.size("_found"), False)


def configuration_lines(candidates: DataFrame, release: str = "release_id") -> DataFrame:
    """(release, medium_pos, track_pos, line): every candidate stream of a track with its residual, least residual first, or UNASSIGNED.

    candidates: release, medium_pos, track_pos, stream_index (null: the track has none), residual.
    """
    key = [release, "medium_pos", "track_pos"]
    one = F.when(F.col("stream_index").isNotNull(), F.struct(F.abs("residual").alias("a"), "stream_index", "residual"))
    rows = candidates.groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["stream_index"].cast("string"), F.lit(" ["), x["residual"].cast("string"), F.lit("]"))), " ")
    return rows.select(*key, F.when(F.size("c") == 0, "UNASSIGNED").otherwise(text).alias("line"))
