import math
import random
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.operators import assign, checksum, cover, dealing, discs, limiter, merge, numbering, report, resample, tags, votes
from provena.schema import MATCHES, WORK_RELATIONS

M = 1 << 32
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def by_hand(disc, t, o, head, tail):
    """v1, v2 of track t (0-based) of a list of tracks, at offset o."""
    flat = [s for x in disc for s in x]
    start, n = sum(map(len, disc[:t])), len(disc[t])
    lo, hi = (head if t == 0 else 1), (n - tail if t == len(disc) - 1 else n)
    v1 = v2 = 0
    for l in range(lo, hi + 1):
        k = start + l + o - 1
        if 0 <= k < len(flat) and (t > 0 or k >= 0):
            p = l * flat[k]
            v1, v2 = v1 + p, v2 + (p >> 32) + p % M
    return v1 % M, v2 % M


def test_checksums_at_offsets(spark):
    rng = random.Random(1)
    disc = [[rng.randrange(M) for _ in range(n)] for n in (30, 17, 25)]
    s = spark.createDataFrame([("d", t + 1, j + 1, v) for t, x in enumerate(disc) for j, v in enumerate(x)], "disc string, track_pos int, j long, s long")
    got = {(r["track_pos"], r["offset"]): (r["v1"], r["v2"]) for r in checksum.checksums_at_offsets(s, [-4, -1, 0, 3], head=5, tail=5).collect()}
    assert got == {(t + 1, o): by_hand(disc, t, o, 5, 5) for t in range(3) for o in (-4, -1, 0, 3)}


def test_a_gap_is_no_neighbour(spark):
    s = spark.createDataFrame([("d", 1, j, 1) for j in range(1, 11)] + [("d", 3, j, 1) for j in range(1, 11)], "disc string, track_pos int, j long, s long")
    got = {r["track_pos"]: r["v1"] for r in checksum.checksums_at_offsets(s, [0], head=3, tail=3).collect()}
    assert got == {1: sum(range(3, 8)), 3: sum(range(3, 8))}


def test_regions_add_up(spark):
    s = spark.createDataFrame([("f", j, j * 77777777 % M) for j in range(1, 51)], "f string, j long, s long")
    whole = checksum.weighted_checksums(s, ["f"]).first()
    parts = checksum.region_sums(s, spark.createDataFrame([("f", 50)], "f string, n long"), ["f"], head=6, tail=6).collect()
    assert {p["region"] for p in parts} == {"head", "body", "tail"}
    assert sum(p["v1"] for p in parts) % M == whole["v1"] and sum(p["v2"] for p in parts) % M == whole["v2"]


def test_offset_search(spark):
    rng = random.Random(2)
    x = [rng.randrange(M) for _ in range(60)]
    s = spark.createDataFrame([(0, j + 1, v) for j, v in enumerate(x)], "stream_index int, j long, s long")
    w = 6
    value = lambda start: sum(t * x[start + t - 1] for t in range(1, w + 1)) % M
    targets = spark.createDataFrame([(0, value(25)), (0, value(18)), (0, 0), (0, value(50))], "stream_index int, target long")
    assert rows(checksum.find_offsets(s, targets, centre=20, half=8, width=w), "target", "offset") == sorted([(value(25), 5), (value(18), -2)], key=str)
    crc = lambda start: zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x[start : start + w]))
    targets = spark.createDataFrame([(0, crc(22))], "stream_index int, target long")
    assert rows(checksum.find_offsets_crc(s, targets, centre=20, half=8, width=w), "offset") == [(2,)]
    assert checksum.region_crcs(s, ["stream_index"]).first()["crc32"] == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))


def test_several_offsets_hit_one_target(spark):
    s = spark.createDataFrame([(0, j, 5) for j in range(1, 31)], "stream_index int, j long, s long")
    t = spark.createDataFrame([(0, 5 * 6)], "stream_index int, target long")
    assert len(rows(checksum.find_offsets(s, t, centre=10, half=4, width=3), "offset")) == 9


def test_byte_differences(spark):
    a = spark.createDataFrame([(0, j, v) for j, v in enumerate("abcd")], "k int, j int, s string")
    b = spark.createDataFrame([(0, j, v) for j, v in enumerate("abxdee")], "k int, j int, s string")
    r = checksum.byte_differences(a, b, ["k"]).first()
    assert (r["changed"], r["unmatched"], r["different"]) == (1, 2, 3)


def test_covering(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", None)], "r string, i int")
    assert rows(cover.covering(d, "r", "i"), "r", "i") == [("a", 1), ("a", 2)]
    assert cover.covering(d, "r", "i", d.limit(0)).count() == 5
    assert {r["r"] for r in cover.covering(d, "r", "i", spark.createDataFrame([(1,)], "i int")).collect()} == {"a", "b"}


def test_matching_discs_and_prune(spark):
    r = spark.createDataFrame([("a",), ("b",), ("none",)], "release_id string")
    s = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "release_id string, stream_index int")
    t = spark.createDataFrame([("a", 1), ("b", 1)], "release_id string, stream_index int")
    out = cover.with_matching_discs(r, s, t)
    assert rows(out, "release_id", "matches") == [("a", True), ("b", False), ("none", True)]
    kept = cover.keep_matching_if_any(out.withColumn("g", F.lit(1)), F.col("matches"), ["g"])
    assert {x["release_id"] for x in kept.collect()} == {"a", "none"}
    assert cover.keep_matching_if_any(out.withColumn("g", F.lit(1)), F.lit(False), ["g"]).count() == 3


def test_perfect_discs(spark):
    d = spark.createDataFrame([("r", 1, "x"), ("r", 1, "y"), ("r", 2, "z"), ("r", 2, "empty")], "release_id string, medium_pos int, disc_id string")
    v = spark.createDataFrame([("r", 1, "x", 1, 0, 2, 0), ("r", 1, "x", 1, 6, 0, 0), ("r", 1, "y", 1, 0, 0, 0), ("r", 2, "z", 1, 0, 0, None)], "release_id string, medium_pos int, disc_id string, track_pos int, offset int, v1 int, v2 int")
    keys = ["release_id", "medium_pos", "disc_id"]
    p = cover.perfect_discs(d, v, [*keys, "track_pos"], keys)
    assert rows(p, "disc_id", "perfect") == [("empty", True), ("x", True), ("y", False), ("z", False)]
    assert rows(cover.prune_imperfect_discs(p), "disc_id") == [("empty",), ("x",)]
    releases = spark.createDataFrame([("r", "g"), ("q", "g")], "release_id string, release_group_id string")
    assert rows(cover.prune_imperfect_releases(releases, p), "release_id") == [("q",)]


def test_validations_and_elsewhere(spark):
    d = spark.createDataFrame([(1, "f", 0.5, "r", "g", "l", 1, 0), (9, "f", 0.5, "r", "g", "l", 1, 1), (1, "f", 1.5, "r", "g", "l", 1, 1), (1, "f", None, "r", "g", "l", 1, 1)], MATCHES)
    ok, bad = cover.validated(d, 3)
    assert ok.count() == 1 and bad.count() == 3
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (1, None)], "stream_index int, recording_id string")
    assert rows(cover.occurs_elsewhere(e), "stream_index", "recording_id", "elsewhere") == [(1, "a", True), (1, "b", True), (1, None, True), (2, "a", False), (3, None, False)]


@quick
@given(st.lists(st.tuples(st.sampled_from(["x", None]), st.integers(0, 2), st.integers(0, 3)), min_size=1, max_size=12), st.integers(0, 12))
def test_merge_is_idempotent_and_in_any_order(spark, data, cut):
    keys = ["id", "pos"]
    a, b = (spark.createDataFrame(x, "id string, pos int, score int") for x in (data[:cut], data[cut:]))
    once = rows(merge.nested_merge(a, b, keys=keys), *keys, "score")
    assert once == rows(merge.nested_merge(b, a, a, keys=keys), *keys, "score")
    want = {}
    for i, p, s in data:
        want[i, p] = max(want.get((i, p), 0), s)
    assert once == sorted(((*k, v) for k, v in want.items()), key=str)


def test_merge_recordings_tests_substrings(spark):
    d = spark.createDataFrame([("r", 1, "fp10", 0.5, "l1", "d", "1"), ("r", 2, "fp1", 0.9, "l1", "d", "1"), ("r", 3, "fp2", 0.1, "l2", "e", "2"), ("q", 1, "fp1", 0.2, "l1", "d", "7")], "recording_id string, ordinal int, fingerprint_id string, score double, release_id string, date string, track string")
    got = {r["recording_id"]: (r["fingerprint_ids"], r["score"], r["n_releases"], r["track"]) for r in merge.merge_recordings(d).collect()}
    assert got == {"r": ("fp10, fp2", 0.9, 2, ""), "q": ("fp1", 0.2, 1, "7")}


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert rows(merge.erase(a, spark.createDataFrame([(None,)], "v string"), ["v"]), "k") == [(1,)]
    assert rows(merge.permute(a, spark.createDataFrame([(1, 2), (2, 1)], "old int, new int"), "k"), "k", "v") == [(1, None), (2, "x")]
    assert rows(merge.difference(a, a.limit(0), ["k"]), "k") == [(1,), (2,)]
    assert merge.union_distinct(a, a).count() == 2
    d = spark.createDataFrame([(1.0, 2.0, "b"), (1.0, 2.0, "a"), (1.0, 3.0, "c"), (0.5, 0.0, "d")], "distance double, score double, release_id string")
    assert [r["release_id"] for r in merge.sort_releases(d).collect()] == ["d", "c", "a", "b"]


def test_votes_count_for_both(spark):
    c = spark.createDataFrame([("d", 1, 0, 7, 7), ("d", 1, 6, 8, 9), ("d", 2, 0, 1, 1), ("d", 3, 0, 7, 7)], "disc_id string, track_pos int, offset int, v1 long, v2 long")
    v = spark.createDataFrame([("d", 1, 7, 5), ("d", 1, 7, 3), ("d", 1, 9, 2), ("d", 2, 4, 200)], "disc_id string, track_pos int, crc long, confidence int")
    got = rows(votes.vote_aggregate(c, v), "track_pos", "offset", "conf_v1", "conf_v2", "total", "max")
    assert got == [(1, 0, 8, 8, 10, 5), (1, 6, 0, 2, 10, 5), (2, 0, 0, 0, 200, 200)]
    assert rows(votes.vote_aggregate_exclusive(c, v), "track_pos", "offset", "conf_v1", "conf_v2")[0] == (1, 0, 8, 0)
    got, bad = votes.with_votes(votes.vote_aggregate(c, v))
    assert got.count() == 2 and rows(bad, "track_pos") == [(2,)]


def test_votes_are_exchanged_once(spark):
    c = spark.createDataFrame([("d", 1, 0, 7, None), ("d", 2, 0, 7, 7)], "disc_id string, track_pos int, offset int, v1 int, v2 int")
    v = spark.createDataFrame([("d", 1, 7, 5), ("d", 1, None, 3), ("d", 3, 7, 2)], "disc_id string, track_pos int, crc long, confidence int")
    for f, crc, n in ((votes.vote_aggregate, "crc", "confidence"), (votes.vote_aggregate_exclusive, "crc", "confidence"), (votes.eac_vote_aggregate, "crc32", "count")):
        out = f(c.withColumn("crc32", F.col("v1")), v.withColumnsRenamed({"crc": crc, "confidence": n}))
        got = out.first()
        assert out.count() == 1 and (got["track_pos"], got[3], got["total"], got["max"]) == (1, 5, 8, 5) and ("conf_v2" not in out.columns or got["conf_v2"] == 0)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_neighbours_by_position(spark):
    d = spark.createDataFrame([("d", 1, 10), ("d", 2, 20), ("d", 4, 40)], "disc_id string, track_pos int, v int")
    assert rows(votes.neighbours(d, "disc_id", "track_pos", "v"), "track_pos", "before", "after") == [(1, None, 20), (2, 10, None), (4, None, None)]
    o = spark.createDataFrame([("d", 1, 0), ("d", 1, 5), ("d", 2, 0), ("d", 4, 9)], "disc_id string, track_pos int, offset int")
    assert rows(votes.offsets_at_neighbours(o), "track_pos", "offset") == [(1, 0), (2, 0), (4, 9)]


def test_track_lengths(spark):
    o = spark.createDataFrame([("d", 1, 150), ("d", 2, 300), ("d", 4, 900)], "disc_id string, position int, offset int")
    e = spark.createDataFrame([("d", 1000)], "disc_id string, leadout int")
    assert rows(discs.track_lengths(o, e), "position", "sectors") == [(1, 150), (2, -1), (4, 100)]
    assert rows(discs.track_lengths(o, e, lenient=True), "position", "sectors") == [(1, 150), (2, 700), (4, 100)]


def test_completion(spark):
    c = spark.createDataFrame([("k", "r", 1, 1, 10, "a")], "lookup string, release_id string, medium_pos int, track_pos int, stream_index int, recording_id string")
    cat = spark.createDataFrame([("k", "r", 1, 1), ("k", "r", 1, 2), ("k", "q", 1, 1)], "lookup string, release_id string, medium_pos int, track_pos int")
    s = spark.createDataFrame([("k", 10), ("k", 11)], "lookup string, stream_index int")
    got = rows(discs.complete(c, cat, s), "release_id", "track_pos", "stream_index", "recording_id")
    assert got == sorted([("r", 1, 10, "a"), ("r", 2, 11, None), ("q", 1, 10, None), ("q", 1, 11, None)], key=str)


def test_one_wrong_stream_rejects_the_disc(spark):
    schema = "release_id string, medium_pos int, track_pos int, stream_index int, recording_id string"
    t = spark.createDataFrame([("r", 1, "x", 1, 100), ("r", 1, "x", 2, 200)], "release_id string, medium_pos int, disc_id string, track_pos int, sectors int")
    d = spark.createDataFrame([(1, 100), (2, 200), (3, 999)], "stream_index int, sectors int")
    run = lambda c: rows(discs.assign_discs(spark.createDataFrame(c, schema), t, d), "track_pos", "stream_index")
    good = [("r", 1, 1, 1, "a"), ("r", 1, 2, 2, "b")]
    assert run(good) == [(1, 1), (2, 2)]
    assert run([*good, ("r", 1, 2, 3, "c")]) == []
    assert run([*good, ("r", 1, 2, 3, None)]) == [(1, 1), (2, 2)]
    assert run([*good, ("r", 1, 2, 3, "c"), ("r", 9, 9, 3, "other")]) == [(1, 1), (2, 2)]


def test_remap_and_status(spark):
    d = spark.createDataFrame([("a", "/own"), ("b", "/own2")], "disc_id string, path string")
    assert rows(discs.remapped(d, spark.createDataFrame([("a", "/other")], "disc_id string, path string")), "disc_id", "path") == [("a", "/other"), ("b", "/own2")]
    s = spark.createDataFrame([("/own", 204), ("/own2", 404)], "path string, http int")
    assert rows(discs.responses(d.union(spark.createDataFrame([("c", "/no")], "disc_id string, path string")), s), "path", "status") == [("/no", -1), ("/own", 0), ("/own2", 1)]


CREDITS = "owner_id string, ordinal int, artist_id string, name string, sort_name string, credited_name string, joinphrase string"


def test_credits(spark):
    c = spark.createDataFrame([("o", 1, "1", "Ann", "A, nn", "Annie", " feat. "), ("o", 2, "2", "Bob", "B, ob", "", " & "), ("o", 3, "3", "Cy", "C, y", None, None), ("v", 1, "va", "Various", "Various", None, None)], CREDITS)
    assert rows(tags.artist_credits(c), "owner_id", "artist", "sort_artist")[0] == ("o", "Annie feat. Bob & Cy", "A, nn; B, ob; C, y")
    got = rows(tags.album_artists(c, "va"), "owner_id", "album_artist", "compilation")
    assert got == [("o", "Ann, Bob & Cy", None), ("v", None, "1")]


def test_composers(spark):
    assert tags.order_composers("Bob, Ann", ["Ann", "Bob"]) == [1, 0]
    assert tags.order_composers("", ["Ann", "Bo"]) == [1, 0]
    w = spark.createDataFrame([("r", "w", "composer", "1", "Ann", "A", False, False, 1), ("r", "w", "composer", "2", "Bob", "B", None, None, 2), ("r", "w", "arranger", "3", "Cy", "C", False, False, 3), ("r", "w", "writer", "1", "Ann", "A", False, False, 4)], WORK_RELATIONS)
    f = spark.createDataFrame([("r", "Bob, Ann")], "recording_id string, composer string")
    assert rows(tags.composers(tags.composers_in_question(w, f)), "composer", "sort_composer") == [("Bob, Ann", "B; A")]


def test_composers_in_spark_as_in_their_definition(spark):
    """Names and references with characters of one to four octets, cut anywhere; and no Python in the plan."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("ab, é€𝄞") for _ in range(draw.randint(1, 5)))
    groups = {r: (word() + word() + word(), [word() for _ in range(draw.randint(1, 5))]) for r in range(60)}
    cells = [(r, str(k), n, n.upper(), k, ref) for r, (ref, names) in groups.items() for k, n in enumerate(names)]
    d = tags.composers(spark.createDataFrame(cells, "recording_id int, artist_id string, name string, sort_name string, ordinal int, reference string"))
    want = {r: ", ".join(names[k] for k in tags.order_composers(ref, names)) for r, (ref, names) in groups.items()}
    assert {r["recording_id"]: r["composer"] for r in d.collect()} == want
    assert "Pandas" not in d._jdf.queryExecution().executedPlan().toString()


def test_field_diff_and_distance(spark):
    a = spark.createDataFrame([(1, "x", None, None), (2, "y", "1", "z")], "k int, title string, compilation string, album string")
    b = spark.createDataFrame([(1, "x", "0", ""), (2, "Y", "1", "z")], "k int, title string, compilation string, album string")
    assert rows(tags.field_diff(a, b, ["k"], ("title", "compilation", "album")), "k", "field", "file_value", "database_value") == [(2, "title", "y", "Y")]
    d = tags.metadata_distance(a.withColumn("g", F.lit(1)), b.where("k = 2"), ["k"], ["g"], ("title",)).first()
    assert d["distance"] == 10001


def test_tag_record(spark):
    d = spark.createDataFrame([(1, "TITLE", "t"), (1, "mood", "m"), (2, "artist", "a")], "stream_index int, name string, value string")
    got = {r["stream_index"]: r for r in tags.tag_record(d).collect()}
    assert got[1]["title"] == "t" and got[1]["unknown"] == ["mood"] and got[2]["artist"] == "a" and got[2]["unknown"] == []


def test_tag_values(spark):
    d = spark.createDataFrame([(1, "al", "aa", "aa", "ar", "sort", None, None, None, None, 1, 2, 3, 9, "", "rec")], "stream_index int, album string, album_artist string, sort_album_artist string, artist string, sort_artist string, compilation string, composer string, sort_composer string, date string, medium_pos int, n_media int, track_pos int, n_tracks int, track_title string, recording_title string")
    r = tags.tag_values(d).first()
    assert (r["title"], r["disc"], r["track"], r["sort_album_artist"], r["sort_artist"], r["compilation"]) == ("rec", "1/2", "3/9", "", "sort", "0")


def test_assignment(spark):
    assert assign.assign_exact([(1,), (2,)], {(1,): [5, 6], (2,): [5]}) == {(1,): 6, (2,): 5}
    assert assign.assign_exact([(1,), (2,)], {(1,): [5], (2,): [5]}) is None
    c = spark.createDataFrame([("r", 1, 1, 5, 0), ("r", 1, 1, 6, 0), ("r", 1, 2, 5, 0), ("q", 1, 1, 5, 3)], "release_id string, medium_pos int, track_pos int, stream_index int, residual int")
    assert rows(assign.best_assignment(c), "release_id", "track_pos", "stream_index") == [("r", 1, 6), ("r", 2, 5)]
    assert rows(assign.ranked_candidates(c.where("release_id = 'r'"), ["release_id", "track_pos"]), "track_pos", "stream_index", "place") == [(1, 5, 1), (1, 6, 2), (2, 5, 1)]


def test_configurations(spark):
    d = spark.createDataFrame([("r", 1, "b"), ("r", 1, "a"), ("r", 2, "c")], "release_id string, medium_pos int, disc_id string")
    assert rows(assign.disc_choices(d), "configuration", "discs") == [(0, ["a", "c"]), (1, ["b", "c"])]
    chosen = spark.createDataFrame([("r", 0, "a", 1, 5), ("r", 0, "c", 1, 6), ("r", 1, "b", 1, 5)], "release_id string, configuration int, disc_id string, track_pos int, stream_index int")
    v = spark.createDataFrame([("a", 1, 3, 1), ("b", 1, 9, 0)], "disc_id string, track_pos int, conf_v1 int, conf_v2 int")
    s = assign.configuration_score(chosen, v, ["release_id", "configuration"])
    assert rows(s, "configuration", "score", "confidence_min", "unmatched") == [(0, 4, 0, 1), (1, 9, 9, 0)]
    assert assign.best_configuration(s, ["release_id"]).first()["configuration"] == 1


@quick
@given(st.lists(st.integers(0, 40), min_size=1, max_size=15))
def test_slots_equal_the_recurrence(spark, arrivals):
    arrivals = sorted(arrivals)
    d = spark.createDataFrame([("s", a, i) for i, a in enumerate(arrivals)], "service string, arrival long, ordinal int")
    got = [r["slot"] for r in limiter.rate_slots(d, F.lit(3), order=["arrival", "ordinal"], calls=2).orderBy("ordinal").collect()]
    want = []
    for a in arrivals:
        want.append(max(a, want[-1] + 3) if want else a)
    assert got == want


def test_paging_caching_retries(spark):
    t = spark.createDataFrame([("a", 0), ("b", 26)], "k string, total long")
    assert rows(limiter.pages(t, ["k"]), "k", "offset", "rows") == [("a", 0, 0), ("b", 0, 25), ("b", 25, 1), ("b", 26, 0)]
    r = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "path string, at int")
    assert limiter.cache_statistics(limiter.cached(r, ["path"], "at")).first().asDict() == {"lookups": 3, "hits": 1}
    a = spark.createDataFrame([("x", 1, 503), ("x", 2, 200), ("y", 1, 500), ("y", 6, 200), ("z", 1, 404)], "k string, attempt int, http int")
    assert rows(limiter.retries(a, ["k"]), "k", "attempts", "http") == [("x", 2, 200), ("y", 1, 500), ("z", 1, 404)]
    q = spark.createDataFrame([("release", "1", "", ["artists", "limit"])], "entity string, id string, resource string, params array<string>")
    s = spark.createDataFrame([("release", "1", "", ["artists", "labels"], "yes"), ("release", "1", "", ["labels"], "no")], "entity string, id string, resource string, params array<string>, answer string")
    assert [r["answer"] for r in limiter.covering_cache(q, s).collect()] == ["yes"]


def test_request_and_answer(spark):
    f = spark.createDataFrame([("k", 1, 40, "bb", 9), ("k", 0, 77, "aa", 8)], "lookup string, ordinal int, stream_index int, fingerprint string, duration int")
    b = limiter.request_body(f)
    r = b.first()
    assert r["body"] == "&duration.0=8&fingerprint.0=aa&duration.1=9&fingerprint.1=bb" and r["streams"] == [77, 40]
    answers = spark.createDataFrame([("k", 2), ("k", 1)], "lookup string, index int")
    assert rows(limiter.original_streams(answers, b), "index", "stream_index") == [(1, 77), (2, 40)]


@pytest.mark.parametrize("bad", [True, False])
def test_valid_configuration(spark, bad):
    d = spark.createDataFrame([(1, 5), (1, 5 if bad else 6)], "c int, stream_index int")
    assert cover.valid_configurations(d, ["c"]).first()["valid"] is not bad


@quick
@given(st.binary(max_size=40), st.binary(max_size=40))
def test_crc_of_two_parts(a, b):
    assert checksum.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("n", [1, 5, 9, 40])
def test_track_crcs(spark, n):
    x = [k * 2654435761 % 2**32 for k in range(n)]
    octets = lambda part: zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part)) if part else None
    s = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate(x)], "stream_index int, j long, s long")
    got = checksum.track_crcs(s, spark.createDataFrame([(1, n)], "stream_index int, n long"), ["stream_index"], edge=5, block=4).first()
    assert got.asDict() == {"stream_index": 1, "head": octets(x[:5]), "body": octets(x[5:-5]), "tail": octets(x[max(5, n - 5):]), "whole": octets(x)}


def test_slots_of_a_service_over_many_slices(spark):
    arrivals = [(s, a * 0.75 if a % 50 else 1.0, a) for s in ("x", None) for a in range(200)]
    d = spark.createDataFrame(sorted(arrivals, key=lambda r: (str(r[0]), r[1], r[2])), "service string, arrival double, ordinal int")
    got = {}
    for r in limiter.rate_slots(d, F.lit(0.5), order=["arrival", "ordinal"], calls=4).orderBy("service", "arrival", "ordinal").collect():
        got.setdefault(r["service"], []).append((r["arrival"], r["slot"]))
    for rows_ in got.values():
        last = None
        for arrival, slot in rows_:
            last = arrival if last is None else max(arrival, last + 0.5)
            assert abs(slot - last) < 1e-9
    assert sum(map(len, got.values())) == len(arrivals)


def test_report(spark):
    t = spark.createDataFrame([("g", "r", 1, "d", 1, 0, "f"), ("g", "r", 1, "d", 1, 1, "f"), ("g", "r", 1, "d", 2, 2, "f"), ("g", "r", 2, None, 1, 3, "f"), ("g", "r", 2, None, 1, 3, "h")], "release_group_id string, release_id string, medium_pos int, disc_id string, track_pos int, stream_index int, fingerprint_id string")
    v = spark.createDataFrame([("d", 1, 0, 0, 0, 5, 5), ("d", 2, 0, 0, 0, 5, 5), ("d", 2, 6, 1, 2, 5, 5), ("e", 1, 0, 1, 1, 2, 2)], "disc_id string, track_pos int, offset long, conf_v1 long, conf_v2 long, total long, max int")
    d = spark.createDataFrame([("r", 2, 1, 3, "title", "a", "b"), ("r", 9, 1, 3, "title", "a", "b")], "release_id string, medium_pos int, track_pos int, stream_index int, field string, file_value string, database_value string")
    got = sorted((r["kind"], r["medium_pos"], r["track_pos"] or 0, r["offset"], r["field"]) for r in report.mismatch_report(t, v, d).collect())
    assert got == [("bad_rip", 1, 1, None, None), ("field", 2, 1, None, "title"), ("no_disc", 2, 0, None, None), ("several_fingerprints", 2, 1, None, None), ("several_streams", 1, 1, None, None), ("votes", 1, 2, 6, None)]


def test_report_with_the_second_database(spark):
    """Track 1 has votes of the second database only, track 2 is known to it only and has none, track 3 is known to nobody."""
    places = "release_group_id string, release_id string, medium_pos int, disc_id string, track_pos int, stream_index int, fingerprint_id string"
    t = spark.createDataFrame([("g", "r", 1, "d", k, k, "f") for k in (1, 2, 3, 4)], places)
    v = spark.createDataFrame([("d", 4, 0, 0, 0, 9, 5)], "disc_id string, track_pos int, offset long, conf_v1 long, conf_v2 long, total long, max int")
    eac = spark.createDataFrame([("d", 1, 0, 0, 7, 4), ("d", 1, 3, 4, 7, 4), ("d", 2, 0, 0, 2, 2), ("d", 3, 0, 0, 0, 0), ("d", 4, 2, 1, 1, 1)], "disc_id string, track_pos int, offset long, conf_eac long, total long, max long")
    d = spark.createDataFrame([], "release_id string, medium_pos int, track_pos int, stream_index int, field string, file_value string, database_value string")
    found = report.mismatch_report(t, v, d, eac)
    got = sorted((r["kind"], r["track_pos"], r["offset"], r["conf_v1"], r["conf_total"], r["conf_eac"], r["eac_total"], r["eac_max"]) for r in found.collect())
    assert got == [("bad_rip", 2, None, None, None, None, None, None), ("votes", 1, 3, 0, 0, 4, 7, 4), ("votes", 4, 2, 0, 9, 1, 1, 1)]
    lines = [tuple(r) for r in report.report_lines(t, found).orderBy("line").select("line", "depth", "text").collect()]
    assert lines == [
        (1, 0, "release group g"), (2, 1, "release r"), (3, 2, "medium 1"), (4, 3, "disc d"),
        (5, 4, "track 1"), (6, 5, "offset 3: 0+0 of 0 (max 0), 4 of 7 (max 4)"), (7, 4, "track 2"), (8, 5, "bad rip"), (9, 4, "track 3"), (10, 4, "track 4"), (11, 5, "offset 2: 0+0 of 9 (max 5), 1 of 1 (max 1)"),
    ]


def test_report_makes_places_once(spark):
    """Tracks are read by one aggregate and votes meet places in one join, whatever kinds of findings come of them."""
    t = spark.createDataFrame([("g", "r", 1, "d", 1, s, f) for s, f in ((0, "f"), (None, None), (1, None))] + [("g", "r", 2, None, 1, 3, f) for f in ("f", "f", None)], "release_group_id string, release_id string, medium_pos int, disc_id string, track_pos int, stream_index int, fingerprint_id string")
    v = spark.createDataFrame([("d", 1, o, 0, 0, 5, 5) for o in (4, 6, 6)], "disc_id string, track_pos int, offset long, conf_v1 long, conf_v2 long, total long, max int")
    d = spark.createDataFrame([("r", 1, 1, s, "title", "a", "b") for s in (0, 9, None)], "release_id string, medium_pos int, track_pos int, stream_index int, field string, file_value string, database_value string")
    found = report.mismatch_report(t, v, d)
    assert sorted((r["kind"], r["medium_pos"], r["stream_index"]) for r in found.collect()) == [("bad_rip", 1, None), ("field", 1, 0), ("no_disc", 2, None), ("several_streams", 1, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Expand" not in plan


@pytest.mark.parametrize("task_rows", [20, 500_000])
def test_printed_report_is_the_report_in_lines(spark, monkeypatch, task_rows):
    """Places that carry their findings print what single findings print, in any number of tasks: with unknown ids, offsets named twice and unknown, groups over several releases."""
    monkeypatch.setattr(dealing, "TASK_ROWS", task_rows)
    rng = random.Random(7)
    some = lambda *c: rng.choice(c)
    rows = [(some("g", "h", None), some("r", "s", "u"), some(1, 2), some("d", "e", None), some(1, 2, 3), some(0, 1, None), some("f", "h", None)) for _ in range(90)] + [("g", None, None, None, None, 5, "f"), (None, "r", 1, "d", None, 5, "f")]
    t = spark.createDataFrame(rows, "release_group_id string, release_id string, medium_pos int, disc_id string, track_pos int, stream_index int, fingerprint_id string")
    v = spark.createDataFrame([(some("d", "e", None), some(1, 2, None), some(-3, 0, 3, 12, None), some(0, 0, 2), some(0, 0, 1), some(0, 5, None), 5) for _ in range(20)], "disc_id string, track_pos int, offset long, conf_v1 long, conf_v2 long, total long, max int")
    e = spark.createDataFrame([(some("d", "e"), some(2, 3), some(0, 3, 7, None), some(0, 4), 7, some(4, None)) for _ in range(20)], "disc_id string, track_pos int, offset long, conf_eac long, total long, max long")
    d = spark.createDataFrame([(some("r", "s", None), some(1, 2), some(1, 2, 3), some(0, 1, None), some("title", "artist"), some("a", None), "b") for _ in range(40)], "release_id string, medium_pos int, track_pos int, stream_index int, field string, file_value string, database_value string")
    for eac in (e, None):
        got, found = report.printed_report(t, v, d, eac), report.mismatch_report(t, v, d, eac)
        want = report.report_lines(t, found)
        assert got.dtypes == want.dtypes
        got, want = ([tuple(r) for r in x.orderBy("line").collect()] for x in (got, want))
        assert got == want and [r[0] for r in got] == list(range(1, len(got) + 1))
        heads = {(k, *p[: k + 1]) for p in ((r[0], r[1], r[2], r[3], r[4]) for r in rows) for k in range(5) if k != 3 or p[3] is not None}
        assert len(got) == len(heads) + found.count()
        places = [tuple((c is not None, c) for c in r[1:6]) for r in got]
        assert places == sorted(places)


def test_votes_of_tracks(spark):
    """An offset of both databases is one, one that is named twice meets each of the other's, unknown ones meet nothing; tracks without votes stay if they are known."""
    v = spark.createDataFrame([("d", 1, 0, 1, 0, 5, 4), ("d", 1, 3, 0, 0, 5, 4), ("d", 1, 6, 2, 0, 5, 4), ("d", 1, 6, 3, 0, 5, 4), ("d", 1, None, 4, 0, 5, 4), ("d", 2, 0, 0, 0, 5, 4), ("d", 3, 0, 0, 0, 0, 0)], "disc_id string, track_pos int, offset long, conf_v1 long, conf_v2 long, total long, max int")
    e = spark.createDataFrame([("d", 1, 0, 7, 9, 8), ("d", 1, 6, 1, 9, 8), ("d", 1, 8, 2, 9, 8), ("d", 1, None, 3, 9, 8), ("e", 1, 0, 0, 2, 1)], "disc_id string, track_pos int, offset long, conf_eac long, total long, max long")
    got = {(r["disc_id"], r["track_pos"]): (sorted(map(tuple, r["votes"]), key=str), r["total"], r["max"], r["eac_total"], r["eac_max"]) for r in report.votes_of_tracks(v, e).collect()}
    votes_ = [(0, 1, 0, 7), (6, 2, 0, 1), (6, 3, 0, 1), (8, 0, 0, 2), (None, 0, 0, 3), (None, 4, 0, 0)]
    assert got == {("d", 1): (sorted(votes_, key=str), 5, 4, 9, 8), ("d", 2): ([], 5, 4, 0, 0), ("e", 1): ([], 0, 0, 2, 1)}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_rows_that_take_several_numbers(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d = spark.createDataFrame([(k, k % 4 + 1) for k in range(40)], "a int, n int").repartitionByRange(parts, "a").sortWithinPartitions("a")
        got = {r["a"]: r["line"] for r in numbering.counted(d, first=5, takes=F.col("n")).collect()}
        assert got == {k: 5 + sum(j % 4 + 1 for j in range(k)) for k in range(40)}
        assert numbering.counted(d.limit(0), takes=F.col("n")).columns == ["a", "n", "line"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_without_a_single_task(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), F.col("id").cast("string").alias("b"), F.lit("x").alias("line"), F.lit(1).alias("_place"))
        out = numbering.numbered(d, ["a", F.col("b").desc()])
        got = sorted((r["line"], r["a"], r["b"]) for r in out.collect())
        want = sorted(((i * 37 % 101, str(i)) for i in range(500)), key=lambda x: (x[0], [-ord(c) for c in x[1]] + [0]))
        assert [g[0] for g in got] == list(range(1, 501)) and [g[1:] for g in got] == want
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        assert numbering.numbered(d.limit(0), ["a"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("width,block", [(1, 4), (2, 1), (3, 1), (7, 40), (588, 100)])
def test_moving_crc_over_blocks(spark, width, block):
    """Every full window, in streams with a gap and a null sample, whatever the blocks."""
    draw = random.Random(width)
    streams = {0: {j: draw.getrandbits(32) for j in range(1, 3000 if width > 100 else 200)}, 1: {j: draw.getrandbits(32) for j in range(-5, 60) if j != 30}, 2: {5: 0xFFFFFFFF}}
    rows_ = [(k, j, s) for k, x in streams.items() for j, s in x.items()] + [(1, 60, None)]
    draw.shuffle(rows_)
    out = checksum.sliding_crc(spark.createDataFrame(rows_, "stream_index int, j long, s long"), width, block=block)
    want = {}
    for k, x in streams.items():
        for j in x:
            if all(j + i in x for i in range(width)):
                want[k, j - 1] = zlib.crc32(b"".join(x[j + i].to_bytes(4, "little") for i in range(width)))
    got = out.collect()
    assert {(r["stream_index"], r["start"]): r["crc32"] for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_long_stream_is_spread_over_tasks(spark):
    s = spark.range(1, 200_001).select(F.lit(0).alias("stream_index"), F.col("id").alias("j"), (F.col("id") * 2654435761 % 2**32).alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows_ = checksum.sliding_crc(s, 588, block=4096).select("start", "crc32", F.spark_partition_id().alias("p"))
        got = rows_.groupBy("p").count().collect()
        assert len(got) == 4 and sum(r["count"] for r in got) == 200_000 - 587
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_permutation_by_key(spark):
    a = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c")], "g string, k int, v string")
    p = spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("y", 1, 1)], "g string, old int, new int")
    assert rows(merge.permute(a, p, "k", ["g"]), "g", "k", "v") == [("x", 1, "b"), ("x", 2, "a"), ("y", 1, "c")]


@pytest.mark.parametrize("reach", [None, 1, 10**9])
def test_nearest_toc_with_a_bound(spark, reach):
    """Equal totals, ties, lists of different positions, discs that share a position with nobody; and far from all pairs meet."""
    draw = random.Random(4)
    tocs = {f"d{i}": {p: draw.randint(100, 400) for p in range(1, draw.choice([3, 3, 4]) + 1)} for i in range(25)} | {"odd": {9: 5}, "gap": {2: 150, 4: 50}}
    files = {i: {p: draw.randint(100, 400) * (1 + i % 40) for p in range(1, draw.choice([3, 5]) + 1)} for i in range(300)} | {900: {2: 150}, 901: {2: 150}, 902: {1: 200, 2: 100, 3: 300}, 903: {1: 300, 2: 200, 3: 100}}
    t = spark.createDataFrame([(d, p, n) for d, x in tocs.items() for p, n in x.items()], "disc string, track_pos int, sectors long")
    s = spark.createDataFrame([(c, p, n) for c, x in files.items() for p, n in x.items()], "candidate int, track_pos int, length long")
    want = {}
    for d, x in tocs.items():
        near = [(sum(abs(x[p] - y[p]) for p in x if p in y), c) for c, y in files.items() if set(x) & set(y)]
        if near:
            want[d] = min(near)
    got = assign.nearest_toc_bounded(t, s, ["disc"], reach=reach).collect()
    assert {r["disc"]: (r["distance"], r["candidate"]) for r in got} == want and len(got) == len(want)
    if reach is None:
        assert sum(r["compared"] for r in got) < 0.35 * len(tocs) * len(files)
    assert rows(assign.nearest_toc(assign.toc_distance(t, s, ["disc"]), ["disc"]), "disc", "distance", "candidate") == sorted(((d, *w) for d, w in want.items()), key=str)
    assert assign.nearest_toc_bounded(t, s.limit(0), ["disc"]).count() == 0


def test_nearest_toc_where_totals_say_nothing(spark):
    """Lists of one total and copies of lists: a list meets a few others of all, copies on both sides share what is found."""
    draw = random.Random(6)
    lists = [(a, b, 1000 - a - b) for a, b in ((draw.randint(0, 500), draw.randint(0, 500)) for _ in range(400))]
    cells = lambda x: [(k, p, n) for k, v in enumerate(x) for p, n in enumerate(v, 1)]
    t = spark.createDataFrame(cells(lists[:100] * 2), "disc int, track_pos int, sectors long")
    s = spark.createDataFrame(cells(lists[100:] * 3), "candidate int, track_pos int, length long")
    want = {d: min((sum(abs(a - b) for a, b in zip(x, y)), c) for c, y in enumerate(lists[100:])) for d, x in enumerate(lists[:100] * 2)}
    got = assign.nearest_toc_bounded(t, s, ["disc"]).collect()
    assert {r["disc"]: (r["distance"], r["candidate"]) for r in got} == want and len(got) == 200
    assert sum(r["compared"] for r in got) < 0.1 * 200 * 300


def test_slots_of_many_calls_in_a_slice(spark):
    """Over 2 ** 31 / interval calls in one slice of time."""
    d = spark.range(40_000).select(F.lit("s").alias("service"), F.lit(0).cast("long").alias("arrival"), F.col("id").alias("ordinal"))
    got = limiter.rate_slots(d, F.lit(60_000), order=["arrival", "ordinal"]).agg(F.max("slot").alias("slot"), F.count_distinct("slot").alias("n")).first()
    assert (got["slot"], got["n"]) == (39_999 * 60_000, 40_000)


def test_matches_that_cannot_be_compared(spark):
    draw = random.Random(2)
    m = {(r, c): [draw.randint(0, 3) for _ in range(draw.randint(1, 4))] for r in "ab" for c in range(12)}
    d = spark.createDataFrame([(r, c, k, x) for (r, c), v in m.items() for k, x in enumerate(v)], "release_id string, configuration int, stream_index int, confidence int")

    def beats(a, b):
        return len(a) == len(b) and (min(a), -a.count(0)) > (min(b), -b.count(0))

    want = sorted(k for k, v in m.items() if not any(beats(w, v) for j, w in m.items() if j[0] == k[0]))
    assert sorted((r["release_id"], r["configuration"]) for r in assign.best_matches(d, ["release_id"]).collect()) == want


def test_from_samples_to_the_report(spark):
    """The steps of the main pipeline in order: checksums at offsets, votes, prune, tags, differences, report."""
    s = spark.createDataFrame([("d", t, j, t * 1000003 * j % 2**32) for t in (1, 2) for j in range(1, 31)], "disc string, track_pos int, j long, s long")
    sums = checksum.checksums_at_offsets(s, [-1, 0, 1], head=3, tail=3).withColumnRenamed("disc", "disc_id")
    crc = sums.where("offset = 1 and track_pos = 1").first()["v2"]
    answers = spark.createDataFrame([("d", 1, crc, 7), ("d", 1, crc + 1, 2), ("d", 2, 5, 3)], "disc_id string, track_pos int, crc long, confidence int")
    voted = votes.vote_aggregate(sums, answers)
    placed = spark.createDataFrame([("g", "r", 1, "d", 1, 0, "f"), ("g", "r", 1, "d", 2, 1, "h")], "release_group_id string, release_id string, medium_pos int, disc_id string, track_pos int, stream_index int, fingerprint_id string")
    place = ["release_id", "medium_pos", "track_pos", "stream_index"]
    kept = placed.select(*place)
    files, catalogue = kept.withColumn("title", F.lit("Song")), kept.withColumn("title", F.when(F.col("track_pos") == 1, "Song").otherwise("Other"))
    diffs = tags.field_diff(files, catalogue, place, ("title",))
    got = sorted((r["kind"], r["track_pos"], r["offset"], r["conf_v2"], r["conf_total"], r["database_value"]) for r in report.mismatch_report(placed, voted, diffs).collect())
    assert got == [("bad_rip", 2, None, None, None, None), ("field", 2, None, None, None, "Other"), ("votes", 1, 1, 7, 9, None)]


def test_configuration_lines(spark):
    c = spark.createDataFrame([("r", 1, 1, 4, -2), ("r", 1, 1, 2, 0), ("r", 1, 2, None, None)], "release_id string, medium_pos int, track_pos int, stream_index int, residual int")
    assert sorted(map(tuple, report.configuration_lines(c).collect())) == [("r", 1, 1, "2 [0] 4 [-2]"), ("r", 1, 2, "UNASSIGNED")]


@pytest.mark.parametrize(("up", "down", "taps"), [(147, 160, 16), (2, 1, 8), (1, 3, 8), (3, 2, 2), (5, 5, 4)])
def test_resampling_is_a_direct_convolution(spark, up, down, taps):
    """Whatever the blocks, and for the shortest streams; coefficients of this test's own."""
    draw = random.Random(up)
    streams = {0: [draw.getrandbits(32) for _ in range(333)], 1: [0x7FFF8000] * 40, 2: [5], 3: [draw.getrandbits(32) for _ in range(64)]}
    common = math.gcd(up, down)
    u, d = up // common, down // common
    signed = lambda v: v - 65536 if v > 32767 else v

    def weights(p):
        cut = min(1, u / d)
        raw = []
        for k in range(taps):
            x = k - taps // 2 + 1 - p / u
            sinc = math.sin(math.pi * cut * x) / (math.pi * x) if x else cut
            raw.append(sinc * (1 + math.cos(2 * math.pi * x / taps)) / 2)
        w = [round(r / sum(raw) * 32768) for r in raw]
        w[w.index(max(w))] += 32768 - sum(w)
        return w

    want = {}
    for key, words in streams.items():
        n = len(words)
        for m in range(math.ceil(n * u / d)):
            at, w, cells = m * d // u, weights(m * d % u), []
            for shift in (0, 16):
                x = {i: signed(v >> shift & 0xFFFF) for i, v in enumerate(words)}
                total = sum(x.get(at - taps // 2 + 1 + k, 0) * w[k] for k in range(taps))
                cells.append(max(-32768, min(32767, total + 16384 >> 15)) & 0xFFFF)
            want[key, m + 1] = cells[0] | cells[1] << 16
    rows_ = [(k, j + 1, s) for k, x in streams.items() for j, s in enumerate(x)]
    draw.shuffle(rows_)
    d_ = spark.createDataFrame(rows_, "stream_index int, j long, s long")
    for block in (16, 64, 65536):
        got = resample.resample(d_, up, down, taps, block=block).collect()
        assert {(r["stream_index"], r["j"]): r["s"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bad", [[(0, 1, 1), (0, 3, 1)], [(0, 2, 1)], [(0, 1, None)], [(0, 1, 1), (0, 1, 1)]])
def test_resampling_needs_every_position(spark, bad):
    with pytest.raises(Exception, match="positions"):
        resample.resample(spark.createDataFrame(bad, "stream_index int, j long, s long"), 2, 1).collect()


def test_tree_with_unknown_levels(spark):
    rows_ = spark.createDataFrame([("g", "r", 1, 2), ("g", "r", 1, 1), ("g", "r", 1, 1), ("g", None, None, 7), ("h", "s", 3, None)], "a string, b string, c int, d int")
    got = {r["a"]: r["items"] for r in merge.tree(rows_, ["a", "b", "c", "d"]).collect()}
    assert [(x.b, [(y.c, [z.d for z in y["items"]]) for y in x["items"]]) for x in got["g"]] == [(None, [(None, [7])]), ("r", [(1, [1, 2])])]
    assert [(x.b, [(y.c, [z.d for z in y["items"]]) for y in x["items"]]) for x in got["h"]] == [("s", [(3, [None])])]


def _roots_a_task(d):
    return [r["count"] for r in d.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_dealt_rows_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 250)
    few, many = (spark.range(n).select((F.col("id") % 2000).alias("k")) for n in (250, 8000))
    assert dealing.dealt(few, "k") is few
    assert dealing.dealt(many, "k").rdd.getNumPartitions() == dealing.dealt(many, "k", n_rows=8000).rdd.getNumPartitions() == 32
    assert dealing.dealt(many, "k", n_rows=251).rdd.getNumPartitions() == 4  # no fewer than Spark's own


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_composers_are_sorted_in_tasks_of_bounded_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dealing, "TASK_ROWS", 250)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        w = spark.range(0, 8000, 1, 1).selectExpr("cast(id % 2000 as string) recording_id", "'w' work_id", "if(id % 8000 < 6000, 'composer', 'arranger') role", "cast(id div 4000 as string) artist_id", "concat('n', id div 4000) name", "'s' sort_name", "false additional", "false instrumental", "cast(id div 2000 as int) ordinal")
        f = spark.range(1000).selectExpr("cast(id as string) recording_id", "'n0' composer")
        d = tags.composers_in_question(w, f)
        tasks = _roots_a_task(d)
        assert sum(tasks) == 4000 and max(tasks) < 250  # 32 tasks of 125 rows; more where it is left to Spark
        assert rows(d, "recording_id", "artist_id", "ordinal", "reference") == sorted(((str(r), str(a), 2 * a, "n0" if r < 1000 else "") for r in range(2000) for a in range(2)), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_trees_are_made_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 250)
    rows_ = spark.range(8000).select((F.col("id") % 2000).alias("a"), F.expr("if(id % 3 = 0, null, id % 3)").alias("b"), F.expr("if(id % 7 = 0, null, id div 4000)").alias("c"))
    d = merge.tree(rows_.union(rows_), ["a", "b", "c"])
    tasks = _roots_a_task(d)
    assert sum(tasks) == 2000 and max(tasks) < 100  # 64 tasks of 31 trees; 2000 in one where it is left to Spark
    want = {}
    for i in range(8000):
        want.setdefault(i % 2000, {}).setdefault(i % 3 or None, set()).add(None if i % 7 == 0 else i // 4000)
    key = lambda x: (x is not None, x)
    assert {r["a"]: [(x.b, [y.c for y in x["items"]]) for x in r["items"]] for r in d.collect()} == {a: [(b, sorted(bs[b], key=key)) for b in sorted(bs, key=key)] for a, bs in want.items()}
