"""The main pipeline on one fixture, from octets to the report."""

import random
import struct
import zlib

from provena.operators import report
from provena.plans import album_check
from provena.sources import binary
from test_operators import by_hand

SECTOR = 588


def wave(words):
    body = b"".join(w.to_bytes(4, "little") for w in words)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 44100, 176400, 4, 16)
    data = form + struct.pack("<4sI", b"data", len(body)) + body
    return bytearray(b"RIFF" + struct.pack("<I", len(data) + 4) + b"WAVE" + data)


def answer(results):
    """results: per stream (fingerprint, recording, group, release, medium, track)."""
    one = "".join(
        f"<fingerprint><index>{k + 1}</index><results>" + "".join(f"<result><id>{f}</id><score>0.9</score><recordings><recording><id>{r}</id><releasegroups><releasegroup><id>{g}</id><releases><release><id>{x}</id><mediums><medium><position>{m}</position><tracks><track><position>{t}</position></track></tracks></medium></mediums></release></releases></releasegroup></releasegroups></recording></recordings></result>" for f, r, g, x, m, t in found) + "</results></fingerprint>"
        for k, found in enumerate(results)
    )
    return f"<response><status>ok</status><fingerprints>{one}</fingerprints></response>"


def test_from_octets_to_the_report(spark):
    draw = random.Random(11)
    # album 1: streams 10, 11, 12 on a disc of three tracks; the database knows the first two at an offset of 3, the third in no form
    sizes = [4, 5, 4]
    disc = [[draw.getrandbits(32) for _ in range(n * SECTOR)] for n in sizes]
    # album 2: one stream whose release has no disc
    other = [draw.getrandbits(32) for _ in range(SECTOR)]
    start, offsets = 150, []
    for n in sizes:
        offsets.append(start)
        start += n
    head = tail = 20
    centre, width = 700, 30
    window = lambda t, o: sum(k * disc[t][centre + o + k - 1] for k in range(1, width + 1)) % 2**32
    votes = [(7, by_hand(disc, 0, 3, head, tail)[1], window(0, 3)), (5, by_hand(disc, 1, 3, head, tail)[0], 1), (9, 12345, 2)]
    crc = [zlib.crc32(b"".join(w.to_bytes(4, "little") for w in x)) for x in disc]
    disc_id = "XzPS7vW.HPHsYemQh0HBUGr8vuU-"
    one, media = "t1", lambda rows, schema: spark.createDataFrame(rows, schema)

    tracks = [("rel", 1, k + 1, f"rec{k}", title, "Album") for k, title in enumerate(["One", "Two", "Three"])]
    album = album_check.Album(
        files=media([(10 + k, wave(x)) for k, x in enumerate(disc)] + [(20, wave(other))], "stream_index int, content binary"),
        file_tags=media([(10, "One", "Album"), (11, "Too", "Album"), (12, "Three", None), (20, "Solo", "S")], "stream_index int, title string, album string"),
        requests=media([(one, [12, 10, 11]), ("t2", [20])], "lookup string, streams array<int>"),
        answers=media(
            [
                # stream 12 comes first in the request; release "part" lacks a stream, "wrong" has a track of another length
                (one, answer([[("f12", "rec2", "g", "rel", 1, 3)], [("f10", "rec0", "g", "rel", 1, 1), ("f10", "rec0", "g", "part", 1, 1)], [("f11", "rec1", "g", "rel", 1, 2)]])),
                ("t2", answer([[("f20", "solo", "h", "single", 1, 1)]])),
            ],
            "lookup string, body string",
        ),
        catalogue=media([*tracks, ("single", 1, 1, "solo", "Solo", "S"), ("part", 1, 1, "rec0", "One", "Album")], "release_id string, medium_pos int, track_pos int, recording_id string, title string, album string"),
        media=media([("rel", 1, disc_id, start)], "release_id string, medium_pos int, disc_id string, leadout int"),
        offsets=media([(disc_id, k + 1, o) for k, o in enumerate(offsets)], "disc_id string, position int, offset int"),
        rips=None, eac=None,
        remap=media([(disc_id, "/remapped.bin")], "disc_id string, path string"),
    )
    album.rips = media([("/remapped.bin", bytearray(binary.rip_octets([(1, 2, 3, votes)]))), ("/else.bin", bytearray(binary.rip_octets([(1, 2, 3, [(99, votes[0][1], 0)])])))], "path string, content binary")
    from provena.operators import discs

    path = discs.eac_paths(media([(disc_id, 3)], "disc_id string, n_tracks int")).first()["eac_path"]
    album.eac = media([(path, bytearray(binary.eac_octets(20200101, [[], [], [(crc[1], 4, 1)], [(crc[2] ^ 1, 6, 1)]], [[], [], [], []])))], "path string, content binary")

    places, found = album_check.check(album, ("title", "album"), centre=centre, half=10, width=width, head=head, tail=tail)
    lines = [(r["depth"], r["text"]) for r in report.report_lines(places, found).orderBy("line").collect()]
    assert lines == [
        (0, "release group g"), (1, "release rel"), (2, "medium 1"), (3, f"disc {disc_id}"),
        (4, "track 1"), (5, "offset 3: 0+7 of 7 (max 7), 0 of 0 (max 0)"),
        (4, "track 2"), (5, "offset 0: 0+0 of 5 (max 5), 4 of 4 (max 4)"), (5, "offset 3: 5+0 of 5 (max 5), 0 of 4 (max 4)"), (5, "stream 11: title is Too, not Two"),
        (4, "track 3"), (5, "bad rip"), (5, "stream 12: album is , not Album"),
        (0, "release group h"), (1, "release single"), (2, "medium 1"), (3, "no disc fits"), (4, "track 1"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
