import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from provena.sources import binary, lookup_xml

# fixed values: a published response of one entry and three tracks
ENTRY = (134136, 463364, 0x2303EA03, [(2, 0xE6C80974, 0xEC89DA94), (2, 0x10391D71, 0xF5A9F194), (2, 0xE9E5348B, 0x1B3E4725)])


def test_rip_both_ways():
    octets = binary.rip_octets([ENTRY, ENTRY])
    got = list(binary.rip_rows(octets))
    assert len(octets) == 2 * (13 + 27) and got[0] == (0, 134136, 463364, 0x2303EA03, 1, 2, 0xE6C80974, 0xEC89DA94) and got[5][0] == 1
    assert list(binary.rip_rows(b"")) == []
    for cut in (1, 12, 14, len(octets) - 1):
        with pytest.raises(ValueError):
            list(binary.rip_rows(octets[:cut]))


def test_eac_both_ways():
    whole, part = [[], [(1, 2, 3), (4, 5, 6)]], [[(7, 8, 9)], []]
    octets = binary.eac_octets(20200101, whole, part)
    assert list(binary.eac_rows(octets)) == [(1, "whole", 0, 1, 2, 3), (1, "whole", 1, 4, 5, 6), (0, "part", 0, 7, 8, 9)]
    for bad in (octets[:-4], octets + b"\0\0\0\0", octets[:8] + b"abcd" + octets[12:], octets[:-1]):
        with pytest.raises(ValueError):
            list(binary.eac_rows(bad))


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(gzip.compress(binary.rip_octets([ENTRY])))
    (tmp_path / "b.bin").write_bytes(binary.rip_octets([ENTRY]))
    got = binary.read_files(spark, str(tmp_path), "rip", "*.bin")
    assert got.count() == 6 and {r["crc"] for r in got.collect()} == {0xE6C80974, 0x10391D71, 0xE9E5348B}
    native = binary.rip_rows_native(spark.read.format("binaryFile").load(str(tmp_path / "b.bin")).select("path", "content"))
    assert sorted((r["track_pos"], r["crc"]) for r in native.collect()) == [(k + 1, c[1]) for k, c in enumerate(ENTRY[3])]


def test_data_source_reads_ranges_and_pushes_filters(spark, tmp_path, monkeypatch):
    from provena.sources import response_files

    monkeypatch.setattr(response_files, "RANGE", 50)
    many = [(k, 2, 3, [(1, k, 0)] * (k % 3)) for k in range(20)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(binary.rip_octets(many))
    (tmp_path / "sub" / "b.bin").write_bytes(gzip.compress(binary.rip_octets([ENTRY])))
    (tmp_path / "_hidden").write_bytes(b"\1")
    (tmp_path / "empty").write_bytes(b"")
    response_files.register(spark)
    d = spark.read.format("rip_responses").option("partition_mb", 0.0001).load(str(tmp_path))
    got = sorted((r["entry"], r["id1"], r["track_pos"]) for r in d.where(F.col("path") == f"{tmp_path}/a.bin").collect())
    assert got == [(k, k, t + 1) for k in range(20) for t in range(k % 3)]
    # one frame, scanned with and without filters in one plan
    few = d.where(F.col("path").endswith("b.bin"))
    assert few.count() == 3 and d.count() == 22 and d.join(few.select("track_pos").distinct(), "track_pos").count() == 22 and few.unionByName(d.where(F.col("path").endswith("a.bin"))).count() == 22
    pushing = lambda: response_files.pushing(spark, "rip_responses", str(tmp_path))
    for test, n in ((F.col("path").endswith("b.bin"), 3), (F.col("path").contains("/sub/"), 3), (F.col("path").startswith("/nowhere"), 0), (F.col("path").isin(f"{tmp_path}/a.bin", f"{tmp_path}/sub/b.bin"), 22), (F.col("track_pos") == 2, 7)):
        assert pushing().where(test).count() == n == d.where(test).count()
    # the files of other paths are not opened: a malformed one does no harm
    (tmp_path / "bad.bin").write_bytes(b"\5abc")
    some = pushing().where(F.col("path").endswith("b.bin"))
    assert some.count() == 3 and spark.read.format("rip_responses").option("only", "*/sub/*").load(str(tmp_path)).count() == 3
    assert "PushedFilters: [StringEndsWith(path,b.bin)]" in spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    with pytest.raises(Exception, match="remain"):
        pushing().count()


def test_rip_files_are_written_entry_by_entry(tmp_path):
    """The writer holds one entry's rows, whatever the file's size."""
    from provena.sources import response_files

    taken, written_at = [0], []

    def rows_():
        for k in range(3000):
            taken[0] += 1
            yield {"entry": 0, "id1": k // 3, "id2": 1, "cddb": 1, "track_pos": 1 + k % 3, "confidence": 1, "crc": k, "offset_crc": 0}

    octets = []
    for data in response_files._rip_bytes(rows_()):
        octets.append(data)
        written_at.append(taken[0])
    assert written_at[0] <= 4 and len(octets) == 1000 and [r[6] for r in binary.rip_rows(b"".join(octets))] == list(range(3000))
    with pytest.raises(struct.error):
        list(response_files._rip_bytes({"entry": 0, "id1": 1, "id2": 1, "cddb": 1, "track_pos": k, "confidence": 1, "crc": k, "offset_crc": 0} for k in range(300)))


def test_data_source_writes_whole_files(spark, tmp_path):
    from provena.sources import response_files

    response_files.register(spark)
    rows = [(f"f{k % 3}", 0, k, 1, 1, t, 1, k, t) for k in range(9) for t in (1, 2)]
    d = spark.createDataFrame(rows, "path string, entry int, id1 long, id2 long, cddb long, track_pos int, confidence int, crc long, offset_crc long")
    out = str(tmp_path / "out")
    d.repartition(2, "path").sortWithinPartitions("path", "id1").write.format("rip_responses").mode("append").save(out)
    back = spark.read.format("rip_responses").load(out)
    assert sorted((r["path"].rsplit("/")[-1], r["entry"], r["id1"], r["track_pos"]) for r in back.collect()) == sorted((f"f{k % 3}", k // 3, k, t) for k in range(9) for t in (1, 2))
    with pytest.raises(Exception, match="stand apart"):
        d.coalesce(1).sortWithinPartitions("id1").write.format("rip_responses").mode("append").save(str(tmp_path / "apart"))
    assert list((tmp_path / "apart").iterdir()) == []
    one = d.where("path = 'f0'").coalesce(1).sortWithinPartitions("id1")
    one.write.format("rip_responses").mode("overwrite").save(out)
    assert {r["path"].rsplit("/")[-1] for r in spark.read.format("rip_responses").load(out).collect()} == {"f0"}
    one.write.format("rip_responses").option("compression", "gzip").mode("append").save(str(tmp_path / "packed"))
    assert (tmp_path / "packed" / "f0").read_bytes()[:2] == b"\x1f\x8b" and spark.read.format("rip_responses").load(str(tmp_path / "packed")).count() == 6


def test_wav(spark, tmp_path):
    def wav(channels, body):
        form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, 44100, 44100 * 2 * channels, 2 * channels, 16)
        data = form + struct.pack("<4sI", b"data", len(body)) + body
        return b"RIFF" + struct.pack("<I", len(data) + 4) + b"WAVE" + data

    (tmp_path / "s.wav").write_bytes(wav(2, struct.pack("<hhhh", 1, -1, 2, 3)))
    (tmp_path / "m.wav").write_bytes(wav(1, struct.pack("<hh", 5, -2)))
    rows = {(r["channels"], r["j"]): r["s"] for r in binary.read_files(spark, str(tmp_path), "wav", "*.wav").collect()}
    assert rows == {(2, 1): 0xFFFF0001, (2, 2): 0x00030002, (1, 1): 0x00050005, (1, 2): 0xFFFEFFFE}
    with pytest.raises(ValueError):
        list(binary.wav_rows(b"nothing"))


def _wave(kind, channels, bits, body, extensible=False, more=b""):
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, 48000, 0, channels * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHIH", 22, bits, 0, kind) + bytes.fromhex("000000001000800000aa00389b71")
    chunk = lambda name, x: name + struct.pack("<I", len(x)) + x + bytes(len(x) % 2)
    inner = b"WAVE" + chunk(b"LIST", b"odd") + chunk(b"fmt ", form) + more + chunk(b"data", body)
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


@pytest.mark.parametrize("extensible", [False, True])
@pytest.mark.parametrize(("kind", "bits", "body", "want"), [
    (1, 8, bytes([0, 128, 255, 129]), [-32768, 0, 32512, 256]),
    (1, 24, b"\xff\xff\x7f" + b"\0\0\x80" + b"\xff\xff\xff" + b"\x7f\1\0", [32767, -32768, -1, 1]),
    (1, 32, struct.pack("<4i", 2**31 - 1, -(2**31), -1, 65536), [32767, -32768, -1, 1]),
    (3, 32, struct.pack("<4f", 1.0, -2.0, 0.5, float("nan")), [32767, -32768, 16384, 0]),
    (3, 64, struct.pack("<4d", 1.5 / 32768, 2.5 / 32768, -0.5 / 32768, float("-inf")), [2, 2, 0, -32768]),
])
def test_wave_samples_of_other_widths(kind, bits, body, want, extensible):
    word = lambda v: v & 0xFFFF
    stereo = [(2, 48000, 1, word(want[0]) | word(want[1]) << 16), (2, 48000, 2, word(want[2]) | word(want[3]) << 16)]
    assert list(binary.wav_rows(_wave(kind, 2, bits, body, extensible))) == stereo
    assert [r[3] for r in binary.wav_rows(_wave(kind, 1, bits, body, extensible))] == [word(v) | word(v) << 16 for v in want]


def test_waves_that_are_none():
    good = _wave(1, 2, 16, bytes(8))
    assert len(list(binary.wav_rows(good))) == 2 and len(list(binary.wav_rows(_wave(1, 2, 16, bytes(7))))) == 1
    two = b"data" + struct.pack("<I", 4) + bytes(4)
    for bad in (good[:-1], _wave(1, 3, 16, bytes(12)), _wave(1, 2, 12, bytes(8)), _wave(2, 2, 16, bytes(8)), _wave(1, 2, 16, b""), _wave(1, 2, 16, bytes(8), more=two), good[:-12] + b"data" + struct.pack("<I", 2**32 - 1) + bytes(8), b"RIFF"):
        with pytest.raises(ValueError):
            list(binary.wav_rows(bad))


IDS = """<response><status>ok</status><fingerprints><fingerprint><index>1</index><results>
<result><id>f1</id><score>0.5</score><recordings><recording><id>r1</id><releasegroups><releasegroup><id>g</id><releases><release><id>l</id>
<mediums><medium><position>1</position><tracks><track><position>2</position></track></tracks></medium></mediums></release></releases></releasegroup></releasegroups></recording></recordings></result>
<result><id>f1</id><score>0.75</score><recordings><recording><id>r1</id><releasegroups><releasegroup><id>g</id><releases><release><id>l</id>
<mediums><medium><position>1</position><tracks><track><position>2</position></track></tracks></medium></mediums></release></releases></releasegroup></releasegroups></recording></recordings></result>
<result><id>f2</id><score>0.25</score></result></results></fingerprint></fingerprints></response>"""


def test_ids(spark):
    d = spark.createDataFrame([("k", IDS)], "lookup string, body string")
    got = sorted((r["fingerprint_id"], r["score"], r["recording_id"], r["release_id"], r["medium_pos"], r["track_pos"]) for r in lookup_xml.matches(d, ["lookup"]).collect())
    assert got == [("f1", 0.75, "r1", "l", 1, 2), ("f2", 0.25, None, None, None, None)]


@pytest.mark.parametrize("change", [("ok", "error"), ("<score>0.5", "<score>much"), ("<status>", "<odd/><status>")])
def test_bad_responses_fail(spark, change):
    d = spark.createDataFrame([("k", IDS.replace(*change, 1))], "lookup string, body string")
    with pytest.raises(Exception, match="status|unknown|MALFORMED|odd|FAILFAST"):
        lookup_xml.matches(d, ["lookup"]).collect()


def test_descriptions(spark):
    body = """<response><status>ok</status><fingerprints><fingerprint><index>1</index><results><result><id>f</id><score>1</score><recordings><recording><id>r</id><title>T</title>
    <artists><artist><id>1</id><name>A</name><joinphrase> &amp; </joinphrase></artist><artist><id>2</id><name>B</name></artist></artists>
    <releases><release><id>l</id><title>L</title><date><year>1999</year><month>2</month></date><mediums><medium><position>1</position><tracks><track><position>4</position></track></tracks></medium></mediums></release></releases>
    </recording></recordings></result></results></fingerprint></fingerprints></response>"""
    r = lookup_xml.descriptions(spark.createDataFrame([("k", body)], "lookup string, body string"), ["lookup"]).first()
    assert (r["artist"], r["title"], r["release_title"], r["date"], r["track"]) == ("A & B", "T", "L", "1999-02", "4")


@pytest.mark.parametrize("body", [
    "<response><status>ok</status><status>ok</status></response>", "<response><fingerprints/></response>", "<answer/>", "", None, "<response><status>ok</status>", "<response><status>ok</status>text</response>",
    "<response><status>ok</status><results/></response>", "<response><status>ok</status><fingerprints><fingerprint><index>1x</index></fingerprint></fingerprints></response>",
    "<response><status>ok</status><fingerprints><fingerprint><index></index></fingerprint></fingerprints></response>", "<response><status>ok</status><fingerprints><fingerprint><index>1_0</index></fingerprint></fingerprints></response>",
    "<!DOCTYPE response [<!ENTITY a 'ok'>]><response><status>&a;</status></response>", "<response><status>ok</status><fingerprints><fingerprint><results><result><score>nan</score></result></results></fingerprint></fingerprints></response>",
])
def test_misplaced_and_malformed_elements_fail(spark, body):
    with pytest.raises(Exception, match="unknown|odd|status|no element found|mismatched|unclosed"):
        lookup_xml.matches(spark.createDataFrame([("k", body)], "lookup string, body string"), ["lookup"]).collect()


def test_any_order_of_elements():
    parts = ["<status>ok</status>", "<fingerprints><fingerprint><results><result><recordings><recording/><recording><id>r</id></recording></recordings><id>f</id></result><result><score> 1e-1</score></result></results><index> 7</index></fingerprint><fingerprint/></fingerprints>"]
    for body in ("".join(parts), "".join(reversed(parts))):
        got = list(lookup_xml.rows_of(f"<?xml version='1.0'?>\n<response>{body}</response>".encode(), "ids"))
        none = (None,) * 4
        assert got == [(7, "f", None, None, *none), (7, "f", None, "r", *none), (7, None, 0.1, None, *none), (None, None, None, None, *none)]


def test_walked_rows_are_the_automatons(monkeypatch):
    """Responses of the form are walked; odd ones, one change each, end as the automaton ends."""
    def outcome(f, body, kind):
        try:
            return [tuple(r) for r in f(body, kind)]
        except Exception as e:
            return type(e), str(e)

    for kind, body in (("ids", IDS.encode()), ("descriptive", b"<response><status>o<!-- -->k</status><fingerprints><fingerprint><index>1</index><results><result><id>f</id><recordings><recording><artists><artist><id>1</id><name>A</name></artist></artists><releases><release><date><year>1999</year></date><mediums><medium><position>1</position><tracks><track/><track><title>T &lt;</title></track></tracks></medium></mediums></release></releases></recording></recordings></result></results></fingerprint></fingerprints></response>")):
        at = [i for i, c in enumerate(body) if c == ord("<")]
        for i in at:
            for new in (b"", b"x", b"<id>2</id>", b"<!-- -->", b" ", b"<status>ok</status>", b"<!DOCTYPE a>"):
                odd = body[:i] + new + body[i:]
                assert outcome(lookup_xml.rows_of, odd, kind) == outcome(lookup_xml._automaton_rows, odd, kind)
        want = lookup_xml._automaton_rows(body, kind)
        with monkeypatch.context() as m:
            m.setattr(lookup_xml, "_automaton_rows", None)
            assert list(lookup_xml.rows_of(body, kind)) == list(want)


def test_one_parse_in_the_plan(spark):
    d = spark.createDataFrame([("k", IDS)], "lookup string, body string")
    for df in (lookup_xml.matches(d, ["lookup"]), lookup_xml.descriptions(d, ["lookup"])):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("MapInArrow") == 1 and "from_xml" not in plan


def test_descriptions_without_parts(spark):
    one = lambda inner: f"<response><status>ok</status><fingerprints><fingerprint><index>0</index><results><result><id>f</id>{inner}</result></results></fingerprint></fingerprints></response>"
    bodies = [one(""), one("<recordings><recording><id>r</id></recording></recordings>"), one("<recordings><recording><releases><release><mediums><medium><title>A</title></medium></mediums></release></releases></recording></recordings>")]
    d = spark.createDataFrame(list(enumerate(bodies)), "lookup int, body string")
    got = sorted((r["lookup"], r["recording_id"], r["album"], r["disc"], r["place"], r["artist"]) for r in lookup_xml.descriptions(d, ["lookup"]).collect())
    assert got == [(1, "r", None, None, None, None), (2, None, "A", None, None, None)]
    with pytest.raises(Exception, match="unknown element genre"):
        lookup_xml.descriptions(spark.createDataFrame([(1, one("<recordings><recording><genre/></recording></recordings>"))], "lookup int, body string"), ["lookup"]).collect()


def test_container_tags(spark):
    from provena.sources import container_tags

    u = lambda x, n=4, order="little": x.to_bytes(n, order)
    cells = ["TITLE=A=b".encode(), "AlbumArtist=É".encode(), b"bare"]
    body = u(1) + b"v" + u(len(cells)) + b"".join(u(len(c)) + c for c in cells)
    flac = b"fLaC" + u(0, 1) + u(3, 3, "big") + b"xyz" + u(0x84, 1) + u(len(body), 3, "big") + body
    info = b"INFO" + b"INAM" + u(3) + b"So\0" + b"\0" + b"XYZW" + u(2) + b"q\0"
    riff = b"RIFF" + u(0) + b"WAVE" + b"LIST" + u(len(info)) + info
    d = spark.createDataFrame([("f", bytearray(flac)), ("w", bytearray(riff)), ("n", None), ("e", bytearray())], "path string, content binary")
    got = sorted(map(tuple, container_tags.decode_tags(d).drop("ordinal").collect()))
    assert got == [("f", "album_artist", "É"), ("f", "bare", ""), ("f", "title", "A=b"), ("w", "XYZW", "q"), ("w", "title", "So")]
    with pytest.raises(ValueError):
        list(container_tags.tag_rows(flac[:-2]))


TAGGED = [("title", "Trä"), ("artist", "A" * 700), ("track", "3/12"), ("disc", "1"), ("compilation", "1"), ("mood", "x"), ("title", "last")]


@pytest.mark.parametrize("kind", ["id3", "ogg", "mp4"])
def test_tags_both_ways_and_cut_off(kind):
    from provena.sources import container_tags

    octets = getattr(container_tags, f"{kind}_octets")(TAGGED)
    assert [x[1:] for x in container_tags.tag_rows(octets)] == TAGGED
    for cut in range(13, len(octets) - 1, 97):
        with pytest.raises(ValueError):
            list(container_tags.tag_rows(octets[:cut]))


def test_ogg_pages():
    """Packets over many pages; a changed octet, a missing page and other streams' pages."""
    from provena.sources import container_tags

    octets = container_tags.ogg_octets(TAGGED, page=1)
    assert octets.count(b"OggS") > 4 and [x[1:] for x in container_tags.tag_rows(octets)] == TAGGED
    pages = [b"OggS" + p for p in octets.split(b"OggS")[1:]]
    for bad in (octets.replace(b"last", b"lost"), b"".join(pages[:2] + pages[3:]), octets[:-3], octets.replace(b"OggS\0", b"OggS\1", 1)):
        with pytest.raises(ValueError):
            list(container_tags.tag_rows(bad))
    other = bytearray(container_tags.ogg_octets([("title", "other")]))
    # a second logical stream, its pages between those of the first
    mixed = []
    for k, p in enumerate(b"OggS" + x for x in bytes(other).split(b"OggS")[1:]):
        p = p[:14] + (9).to_bytes(4, "little") + p[18:22] + b"\0\0\0\0" + p[26:]
        mixed += [pages[k], p[:22] + container_tags._ogg_crc(p).to_bytes(4, "little") + p[26:]]
    got = [x[1:] for x in container_tags.tag_rows(b"".join(mixed + pages[2:]))]
    assert got == [*TAGGED, ("title", "other")]


def test_id3_versions_and_encodings():
    from provena.sources import container_tags

    def tag(major, flags, frames):
        n = len(frames)
        return b"ID3" + bytes([major, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frames

    def frame(name, body, kind=0):
        return name + len(body).to_bytes(4, "big") + bytes([0, kind]) + body

    rows = lambda data: [x[1:] for x in container_tags.tag_rows(data)]
    assert rows(tag(2, 0, b"TT2\0\0\4\0Tr\xe4" + b"PIC\0\0\1x" + bytes(9))) == [("title", "Trä"), ("PIC", "")]
    wide = "Trä\0two".encode("utf-16")
    assert rows(tag(3, 0, frame(b"TIT2", b"\1" + wide) + frame(b"TPE1", b"\2" + "é".encode("utf-16-be")) + frame(b"TXXX", b"\0mood\0x"))) == [("title", "Trä; two"), ("artist", "é"), ("mood", "x")]
    # unsynchronised as a whole: ff 00 stands for ff
    assert rows(tag(3, 0x80, frame(b"TIT2", b"\1\xff\xfeA\0").replace(b"\xff", b"\xff\0"))) == [("title", "A")]
    packed = zlib.compress(b"\0packed")
    assert rows(tag(3, 0, frame(b"TALB", len(b"\0packed").to_bytes(4, "big") + packed, 0x80) + frame(b"TIT2", b"secret", 0x40))) == [("album", "packed")]
    assert rows(tag(4, 0, frame(b"TIT2", b"\0\0\0\5\3\xc3\xa9!", 1))) == [("title", "é!")]
    assert rows(tag(3, 0x40, b"\0\0\0\6" + bytes(6) + frame(b"TIT2", b"\0x"))) == [("title", "x")]
    for bad in (tag(5, 0, b""), tag(4, 0, b"TIT2\0\0\x80\0\0\0"), tag(3, 0, b"TIT2\0\0\0\x63\0\0x"), tag(3, 0, frame(b"TALB", b"\0\0\0\1zz", 0x80))):
        with pytest.raises(ValueError):
            rows(bad)


def test_the_last_tag_counts(spark):
    from provena.operators import tags
    from provena.sources import container_tags

    d = spark.createDataFrame([(k, bytearray(getattr(container_tags, f"{k}_octets")(TAGGED))) for k in ("id3", "ogg", "mp4")], "path string, content binary")
    got = tags.tag_record(container_tags.decode_tags(d), "path").collect()
    assert len(got) == 3 and all((r["title"], r["track"], r["disc"], r["compilation"], r["unknown"]) == ("last", "3/12", "1", "1", ["mood"]) for r in got)


def test_bucketed_tables_meet_without_an_exchange(spark, sf):
    from provena.plans import engine_queries

    plan = engine_queries.release_media(spark, sf)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("SortMergeJoin") == 2 and "Exchange" not in text and text.count("Bucketed: true") == 3


def test_release_media_by_position(spark):
    from provena.sources import bucketed

    r = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 1, 1), ("unknown", 1, 1), (None, 1, 1)], "release_id string, medium_pos int, streams long")
    c = spark.createDataFrame([("a", [(1, 10)]), ("b", []), ("c", [(1, 5)])], "release_id string, media array<struct<medium_pos: int, n_tracks: long>>")
    d = spark.createDataFrame([("a", [(2, 4), (1, 7)])], "release_id string, media array<struct<medium_pos: int, n_discs: long>>")
    tables = [bucketed.bucketed(x, "release_id", 3) for x in (r, c, d)]
    assert sorted(map(tuple, bucketed.release_media(*tables).collect())) == [("a", 1, 3, 10, 7), ("a", 2, 1, None, 4), ("b", 1, 1, None, 0)]
