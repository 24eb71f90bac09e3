"""Tags: from catalogue credits to tag values, composers, and field-by-field comparison with a file's tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provena.functions.exprs import compilation, edit_distance, position_of, text_or_empty, title, unless_same
from provena.operators.dealing import dealt
from provena.schema import MISSING_METADATA, TAG_FIELDS

#: Fields that are compared, in this order; the date is not.
COMPARED = ("title", "album", "artist", "sort_artist", "album_artist", "sort_album_artist", "composer", "sort_composer", "compilation", "disc", "track")
ROLES = ("composer", "writer", "arranger", "lyricist", "translator", "librettist")


def _in_order(*fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct("ordinal", *fields)))


def artist_credits(credits: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, artist, sort_artist): credited names, else names, each with its join phrase; sort names joined by "; ", the last with its join phrase."""
    phrase = text_or_empty(F.col("joinphrase"))
    shown = F.concat(F.coalesce(F.nullif("credited_name", F.lit("")), "name"), phrase)
    rows = credits.withColumn("shown", shown).withColumn("phrase", phrase).groupBy(owner).agg(_in_order("shown", "sort_name", "phrase").alias("c"))
    sort = F.concat(F.array_join(F.transform("c", lambda x: x["sort_name"]), "; "), F.element_at("c", -1)["phrase"])
    return rows.select(owner, F.array_join(F.transform("c", lambda x: x["shown"]), "").alias("artist"), sort.alias("sort_artist"))


def album_artists(credits: DataFrame, various: str, owner: str = "owner_id") -> DataFrame:
    """(owner, album_artist, sort_album_artist, compilation). `various` alone gives no artist and compilation "1".

    Real names count, credited ones do not. Between names stands the join phrase where it is ", " or "; "; else " & " before the last name
    and ", " before others. The last name keeps its own phrase. Sort names are joined by "; "; the last one's phrase follows it, as "; " where it is ", ".
    """
    rows = credits.withColumn("phrase", text_or_empty(F.col("joinphrase"))).groupBy(owner).agg(_in_order("artist_id", "name", "sort_name", "phrase").alias("c"))
    n = F.size("c")

    def piece(x: Column, i: Column) -> Column:
        between = F.when(x["phrase"].isin(", ", "; "), x["phrase"]).when(i == n - 2, " & ").otherwise(", ")
        return F.concat(x["name"], F.when(i == n - 1, x["phrase"]).otherwise(between))

    alone = (n == 1) & (F.col("c")[0]["artist_id"] == various)
    phrase = F.element_at("c", -1)["phrase"]
    shown = F.array_join(F.transform("c", piece), "")
    sort = F.concat(F.array_join(F.transform("c", lambda x: x["sort_name"]), "; "), F.when(phrase == ", ", "; ").otherwise(phrase))
    return rows.select(owner, F.when(~alone, shown).alias("album_artist"), F.when(~alone, sort).alias("sort_album_artist"), F.when(alone, "1").alias("compilation"))


def recording_tracks(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """matches with the catalogue's track: by recording id, else by place; of several the last place wins.

    matches: stream_index, release_id, recording_id, medium_pos, track_pos.
    """
    by_id = catalogue.groupBy("release_id", "recording_id").agg(F.max(F.struct("medium_pos", "track_pos", "title")).alias("a"))
    by_place = catalogue.groupBy("release_id", "medium_pos", "track_pos").agg(F.max(F.struct("medium_pos", "track_pos", "title")).alias("b"))
    rows = matches.join(by_id, ["release_id", "recording_id"], "left").join(by_place, ["release_id", "medium_pos", "track_pos"], "left")
    return rows.withColumn("t", F.coalesce("a", "b")).drop("a", "b")


def tag_values(tracks: DataFrame) -> DataFrame:
    """The tag record of catalogue rows that carry everything it is made of; sort names that say nothing are emptied.

    tracks: stream_index, album, album_artist, sort_album_artist, artist, sort_artist, compilation, composer, sort_composer, date, medium_pos, n_media, track_pos,
    n_tracks, track_title, recording_title.
    """
    return tracks.select(
        "stream_index",
        "album",
        "album_artist",
        "artist",
        compilation(F.col("compilation")).alias("compilation"),
        "composer",
        "date",
        position_of(F.col("medium_pos"), F.col("n_media")).alias("disc"),
        unless_same(F.col("sort_album_artist"), F.col("album_artist")).alias("sort_album_artist"),
        unless_same(F.col("sort_artist"), F.col("artist")).alias("sort_artist"),
        unless_same(F.col("sort_composer"), F.col("composer")).alias("sort_composer"),
        title(F.col("track_title"), F.col("recording_title")).alias("title"),
        position_of(F.col("track_pos"), F.col("n_tracks")).alias("track"),
    )


def composers_in_question(relations: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct composers of a recording, in order of first sight. relations: as schema.WORK_RELATIONS. files: recording_id, composer (the file's tag).

    Optional credits (arrangers, translators, librettists, additional ones, lyricists of an instrumental) count only where the artist's name
    is part of the file's tag. Relations are counted and dealt by recording, so what a task sorts is bounded.
    """
    optional = F.col("role").isin("arranger", "translator", "librettist") | text_flag("additional") | (text_flag("instrumental") & (F.col("role") == "lyricist"))
    rows = dealt(relations.where(F.col("role").isin(*ROLES)), "recording_id", n_rows=relations.count())
    rows = rows.join(files.select("recording_id", F.col("composer").alias("reference")), "recording_id", "left")
    rows = rows.where(~optional | F.coalesce(F.contains(F.col("reference"), F.col("name")), F.lit(False)))
    first = Window.partitionBy("recording_id", "artist_id").orderBy("ordinal", "role")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("recording_id", "artist_id", "name", "sort_name", "ordinal", text_or_empty(F.col("reference")).alias("reference"))


def text_flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def order_composers(reference: str, names: list[str]) -> list[int]:
    """Greedy order: each next name is the one whose trial text is nearest to the reference cut to the trial's octets; the first minimum wins. composers() does this for whole tables."""
    left, out, text = list(range(len(names))), [], ""
    octets = reference.encode()
    while left:
        trial = {k: (text + ", " if out else "") + names[k] for k in left}
        best = min(left, key=lambda k: _distance(octets[: len(trial[k].encode())].decode(errors="ignore"), trial[k]))
        text = trial[best]
        out.append(best)
        left.remove(best)
    return out


def _cut(text: Column, n: Column) -> Column:
    """The first n octets of a text, less those of a character that is cut."""
    octets = text.cast("binary")
    within = lambda at: F.hex(F.substring(octets, at + 1, F.lit(1))).between("80", "BF")
    whole = F.when(~within(n), n).when(~within(n - 1), n - 1).when(~within(n - 2), n - 2).otherwise(n - 3)
    return F.substring(octets, F.lit(1), whole).cast("string")


def composers(rows: DataFrame) -> DataFrame:
    """(recording_id, composer, sort_composer) from composers_in_question(), in order_composers()'s order. A recording has a handful of them, so a group is small."""
    order = [x for c in ("ordinal", "artist_id") for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))]
    groups = rows.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct(*order, "name", "sort_name", "reference"))).alias("c"))
    groups = groups.withColumn("_r", F.col("c")[0]["reference"])
    name, sort = lambda k: F.element_at("c", k)["name"], lambda k: F.element_at("c", k)["sort_name"]
    added = lambda acc, field, by, text: F.when(acc["n"] > 0, F.concat(acc[field], F.lit(by), text)).otherwise(text)

    def step(acc: Column, _: Column) -> Column:
        trial = lambda k: added(acc, "shown", ", ", name(k))
        best = F.array_min(F.transform(acc["left"], lambda k: F.struct(F.levenshtein(_cut(F.col("_r"), F.octet_length(trial(k))), trial(k)).alias("d"), k.alias("k"))))["k"]
        grown = lambda k: F.struct(F.filter(acc["left"], lambda x: x != k).alias("left"), trial(k).alias("shown"), added(acc, "sort", "; ", sort(k)).alias("sort"), (acc["n"] + 1).alias("n"))
        return F.transform(F.array(best), grown)[0]

    places = F.sequence(F.lit(1), F.size("c"))
    start = F.struct(places.alias("left"), F.lit("").alias("shown"), F.lit("").alias("sort"), F.lit(0).alias("n"))
    done = groups.select("recording_id", F.aggregate(places, start, step).alias("x"))
    return done.select("recording_id", F.col("x.shown").alias("composer"), F.when(F.col("x.sort") == F.col("x.shown"), "").otherwise(F.col("x.sort")).alias("sort_composer"))


def _fields(rows: DataFrame, key: list[str], value: str, fields: tuple[str, ...]) -> DataFrame:
    read = lambda f: compilation(F.col(f)) if f == "compilation" else text_or_empty(F.col(f))
    pairs = [F.struct(F.lit(f).alias("field"), read(f).alias(value)) for f in fields]
    return rows.select(*key, F.explode(F.array(*pairs)).alias("x")).select(*key, "x.field", f"x.{value}")


def field_diff(files: DataFrame, catalogue: DataFrame, key: list[str], fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """(key, field, file_value, database_value) where they differ. Nulls read as empty, of compilation as "0".

    Several catalogue rows per key: one line where all agree with each other, else a line for each value.
    """
    a, b = _fields(files, key, "file_value", fields), _fields(catalogue, key, "database_value", fields)
    return a.join(b.distinct(), [*key, "field"]).where("file_value <> database_value")


def metadata_distance(files: DataFrame, catalogue: DataFrame, key: list[str], within: list[str], fields: tuple[str, ...] = ("title", "artist", "album")) -> DataFrame:
    """Per group: sum of the edit distances of the fields; MISSING_METADATA for each file that the catalogue has nothing for."""
    c = catalogue.select(*key, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_there"))
    d = F.when(F.col("_there"), sum((edit_distance(F.col(f), F.col(f"_{f}")) for f in fields), F.lit(0))).otherwise(MISSING_METADATA)
    return files.join(c, key, "left").groupBy(*within).agg(F.sum(d).cast("long").alias("distance"))


def tag_record(pairs: DataFrame, key: str = "stream_index") -> DataFrame:
    """One record per stream from rows (stream, name, value) of a container's dictionary: the known tags, and the sorted names of the others.

    Where a tag repeats the last one counts, by ordinal; without that column, the largest.
    """
    known = F.lower("name").isin(*TAG_FIELDS)
    last = (lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("ordinal")))) if "ordinal" in pairs.columns else F.max
    cells = [last(F.when(F.lower("name") == t, F.col("value"))).alias(t) for t in TAG_FIELDS]
    return pairs.groupBy(key).agg(*cells, F.sort_array(F.collect_set(F.when(~known, F.col("name")))).alias("unknown"))
