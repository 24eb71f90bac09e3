"""Lookup responses in XML: the id form and the descriptive form, flattened to rows in one pass.

A pushdown automaton reads each body once: a form says which elements may stand within which, how texts become values, and which elements carry columns. An element of
an unknown name or in a wrong place, an element that repeats where there can be one, text between elements, a number that is none, a status other than ok, a
document type and malformed XML raise. Elements may come in any order. The rows of a response hold its columns from the innermost element outwards; an element without inner ones
that carries columns has one row.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.sources.binary import _decoded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WHOLE, _REAL = re.compile(r"\s*[+-]?[0-9]+"), re.compile(r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?")


def _whole(text: str) -> int:
    if not _WHOLE.fullmatch(text):
        raise ValueError(f"odd value {text!r}")
    return int(text)


def _real(text: str) -> float:
    if not _REAL.fullmatch(text):
        raise ValueError(f"odd value {text!r}")
    return float(text)


@dataclass(frozen=True)
class Form:
    """columns: the schema. children: by element, the names of those within it. values: how the text of an element is read, as it is where it is not named.

    skipped: (element, child) that are passed over whole. cells: by element, which child's value goes to which column. folds: elements whose value is made
    of their children's. many: folded elements that may repeat, whose values are a list.
    """

    columns: str
    children: dict[str, str]
    cells: dict[str, dict[str, int]]
    values: dict[str, Callable] = field(default_factory=lambda: {"index": _whole, "position": _whole, "score": _real})
    skipped: frozenset[tuple[str, str]] = frozenset()
    folds: dict[str, Callable[[dict], object]] = field(default_factory=dict)
    many: frozenset[str] = frozenset()


# The elements of the service's two forms.
IDS = Form(
    columns="index int, fingerprint_id string, score float, recording_id string, release_group_id string, release_id string, medium_pos int, track_pos int",
    children={
        "response": "status fingerprints", "fingerprints": "fingerprint", "fingerprint": "index results", "results": "result", "result": "id score recordings",
        "recordings": "recording", "recording": "id releasegroups", "releasegroups": "releasegroup", "releasegroup": "id releases", "releases": "release",
        "release": "id mediums", "mediums": "medium", "medium": "position tracks", "tracks": "track", "track": "position",
    },
    cells={"fingerprint": {"index": 0}, "result": {"id": 1, "score": 2}, "recording": {"id": 3}, "releasegroup": {"id": 4}, "release": {"id": 5}, "medium": {"position": 6}, "track": {"position": 7}},
)
DESCRIPTIVE = Form(
    columns="index int, fingerprint_id string, score float, recording_id string, recording_title string, recording_artist string, release_id string, release_title string, date string, medium_pos int, album string, track_count int, track_pos int, track_title string, track_artist string",
    children={
        "response": "status fingerprints", "fingerprints": "fingerprint", "fingerprint": "index results", "results": "result", "result": "id score recordings",
        "recordings": "recording", "recording": "id title artists releases", "releases": "release", "release": "id title date mediums country track_count medium_count",
        "mediums": "medium", "medium": "format position title track_count tracks", "tracks": "track", "track": "artists id position title",
        "artists": "artist", "artist": "id joinphrase name", "date": "year month day",
    },
    cells={
        "fingerprint": {"index": 0}, "result": {"id": 1, "score": 2}, "recording": {"id": 3, "title": 4, "artists": 5}, "release": {"id": 6, "title": 7, "date": 8},
        "medium": {"position": 9, "title": 10, "track_count": 11}, "track": {"position": 12, "title": 13, "artists": 14},
    },
    values={"index": _whole, "position": _whole, "score": _real, "track_count": _whole, "year": _whole, "month": _whole, "day": _whole},
    skipped=frozenset({("artist", "id"), ("track", "id"), ("medium", "format"), ("release", "country"), ("release", "track_count"), ("release", "medium_count")}),
    folds={
        "artist": lambda v: v.get("name", "") + v.get("joinphrase", ""),
        "artists": lambda v: "".join(v.get("artist", [])),
        "date": lambda v: "-".join(f"{v[k]:0{n}d}" for k, n in (("year", 4), ("month", 2), ("day", 2)) if k in v),
    },
    many=frozenset({"artist"}),
)
FORMS = {"ids": IDS, "descriptive": DESCRIPTIVE}
#: Elements that give a row of their own where none within them does. In the descriptive form a result without recordings has nothing to describe.
_ROWS = {"ids": frozenset(IDS.cells), "descriptive": frozenset({"recording", "release", "medium", "track"})}


class _Open:
    """An element that has begun: the values of its children, and the rows within it."""

    __slots__ = ("name", "values", "rows")

    def __init__(self, name: str):
        self.name, self.values, self.rows = name, {}, []


class _Odd(Exception):
    """Something that the automaton has to look at."""


_INNER = {kind: {k: frozenset(v.split()) for k, v in form.children.items()} for kind, form in FORMS.items()}


def _walked(e: ElementTree.Element, form: Form, inner: dict, own: frozenset, width: int) -> tuple[dict, list]:
    """The values and rows of an element that has inner ones, as the automaton makes them; _Odd where it might raise."""
    name = e.tag
    allowed = inner[name]
    if e.text and e.text.strip():
        raise _Odd
    values, rows = {}, []
    for x in e:
        tag = x.tag
        if tag not in allowed or (x.tail and x.tail.strip()):
            raise _Odd
        if (name, tag) in form.skipped:
            continue
        if tag in inner:
            v, r = _walked(x, form, inner, own, width)
            if tag in form.folds:
                value = form.folds[tag](v)
                if tag in form.many:
                    values.setdefault(tag, []).append(value)
                else:
                    values[tag] = value
                continue
            r = r or ([[None] * width] if tag in own else [])
            for child, column in form.cells.get(tag, {}).items():
                if (value := v.get(child)) is not None:
                    for row in r:
                        row[column] = value
            rows += r
        else:
            if len(x) or tag in values:
                raise _Odd
            read, words = form.values.get(tag), x.text or ""
            values[tag] = read(words) if read else words
    return values, rows


def rows_of(body: bytes, kind: str) -> Iterator[tuple]:
    """The rows of a response. ValueError or expat's error where it is not of the form.

    A response of the form is parsed whole in C and walked; the automaton takes those that are odd, and says what is wrong with them.
    """
    form = FORMS[kind]
    try:
        # a document type can't hide in these encodings; another one is the automaton's
        if b"<!DOCTYPE" in body or b"\0" in body:
            raise _Odd
        root = ElementTree.fromstring(body)
        if root.tag != "response":
            raise _Odd
        values, rows = _walked(root, form, _INNER[kind], _ROWS[kind], form.columns.count(",") + 1)
        if values.get("status") == "ok":
            return map(tuple, rows)
    except (_Odd, ValueError, ElementTree.ParseError):
        pass
    return _automaton_rows(body, kind)


def _automaton_rows(body: bytes, kind: str) -> Iterator[tuple]:
    form, own = FORMS[kind], _ROWS[kind]
    width = form.columns.count(",") + 1
    allowed = {k: frozenset(v.split()) for k, v in form.children.items()}
    stack, text, passed = [_Open("")], [], 0

    def begin(name: str, _: dict) -> None:
        nonlocal passed
        if passed:
            passed += 1
            return
        above = stack[-1].name
        if name not in allowed.get(above, ("response",) if not above else ()):
            raise ValueError(f"unknown element {name} within {above or 'the document'}")
        if (above, name) in form.skipped:
            passed = 1
            return
        text.clear()
        stack.append(_Open(name))

    def end(name: str) -> None:
        nonlocal passed
        if passed:
            passed -= 1
            return
        at, above = stack.pop(), stack[-1]
        if name not in allowed:
            words = "".join(text)
            text.clear()
            if name in above.values:
                raise ValueError(f"unknown second {name} within {above.name}")
            read = form.values.get(name)
            above.values[name] = read(words) if read else words
            return
        if name in form.folds:
            value = form.folds[name](at.values)
            if name in form.many:
                above.values.setdefault(name, []).append(value)
            else:
                above.values[name] = value
            return
        rows = at.rows or ([[None] * width] if name in own else [])
        for child, column in form.cells.get(name, {}).items():
            value = at.values.get(child)
            for r in rows:
                r[column] = value
        above.rows.extend(rows)
        if name == "response" and at.values.get("status") != "ok":
            raise ValueError(f"the lookup's status is {at.values.get('status')!r}")

    def said(words: str) -> None:
        if not passed:
            if stack[-1].name not in allowed:
                text.append(words)
            elif words.strip():
                raise ValueError(f"unknown text within {stack[-1].name}")

    def no_type(*_) -> None:
        raise ValueError("unknown document type")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = begin, end, said, no_type
    parser.Parse(body, True)
    return map(tuple, stack[0].rows)


def flattened(responses: DataFrame, kind: str, column: str = "body") -> DataFrame:
    """responses with their text replaced by its rows. A null or empty response fails the query."""
    body = F.when(F.octet_length(column) > 0, F.col(column)).otherwise(F.raise_error(F.lit("unknown status: no response")).cast("string"))
    return _decoded(responses.withColumn(column, body.cast("binary")), column, lambda data: rows_of(data, kind), FORMS[kind].columns)


def matches(responses: DataFrame, key: list[str], column: str = "body") -> DataFrame:
    """(key, index, fingerprint_id, score, recording_id, release_group_id, release_id, medium_pos, track_pos) of id-form responses.

    One row per result and stream; where a result repeats for a stream the highest score stays. Results without recordings have nulls.
    """
    place = [*key, "index", "fingerprint_id", "recording_id", "release_group_id", "release_id", "medium_pos", "track_pos"]
    return flattened(responses.select(*key, column), "ids", column).groupBy(*place).agg(F.max("score").alias("score"))


def descriptions(responses: DataFrame, key: list[str], column: str = "body") -> DataFrame:
    """A row per track of descriptive responses: (key, index, fingerprint_id, score, recording_id, title, artist, release_id, release_title, date, track, album, disc, place).

    title and artist: the track's own, else the recording's. album: the medium's title. track: its position; place and disc: positions with what is known of
    the number there are, as in 4/9 and 1/?.
    """
    r = flattened(responses.select(*key, column), "descriptive", column)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    on_medium = F.col("medium_pos").isNotNull() | F.col("track_pos").isNotNull() | F.col("track_count").isNotNull()
    return r.select(
        *key, "index", "fingerprint_id", "score", "recording_id", F.coalesce("track_title", "recording_title").alias("title"), F.coalesce("track_artist", "recording_artist").alias("artist"),
        "release_id", "release_title", "date", F.col("track_pos").cast("string").alias("track"), "album", F.concat(F.col("medium_pos").cast("string"), F.lit("/?")).alias("disc"),
        F.when(on_medium, F.concat(known("track_pos"), F.lit("/"), known("track_count"))).alias("place"),
    )


def strict(column, kind: str):
    """Text to a number; anything else in it is an error."""
    return F.trim(column).cast(kind)


def lenient(column, kind: str):
    """Text to a number, or null."""
    return F.trim(column).try_cast(kind)
