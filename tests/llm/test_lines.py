"""Line dedup against brute force, which knows the rule and nothing of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.llm import line_dedup, registered

DOCS = "doc_id long, text string"


def by_hand(rows, n_lines=2, n_words=50):
    """(id, text) -> (clean text, lines gone): every window of lines and of words is looked up among those at earlier places."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = lambda r: ((r[0] is not None, r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42)))
    first, gone = {}, {}
    docs = sorted({r for r in rows if r[1] is not None}, key=order)
    for d in docs:
        lines = [x for x in (re.findall(r"[^\x20\x09-\x0D]+", y) for y in d[1].split("\n")) if x]
        flat = [w for x in lines for w in x]
        at = [sum(map(len, lines[:i])) for i in range(len(lines) + 1)]
        found = [(("lines", *map(tuple, lines[i : i + n_lines])), at[i], at[i + n_lines]) for i in range(len(lines) - n_lines + 1)]
        found += [(("words", *flat[i : i + n_words]), i, i + n_words) for i in range(len(flat) - n_words + 1)]
        gone[d] = set()
        for what, lo, hi in found:
            e, end = first.setdefault(what, (d, hi))
            if (e, end) != (d, hi):
                gone[d].update(range(max(lo, end) if e == d else lo, hi))
    out = {}
    for d in docs:
        kept, n, at, last = [], 0, 0, True
        for x in d[1].split("\n"):
            pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", x)
            stay = [p for k, p in enumerate(pieces) if at + k not in gone[d]]
            if pieces and not stay:
                n += 1
                while not last and kept and kept[-1][1] is None:  # blank lines between two lines that went
                    kept.pop()
                kept.append(("", False))
            elif len(stay) < len(pieces):
                lead, trail = re.match(r"[\x20\x09-\x0D]*", x)[0], re.search(r"[\x20\x09-\x0D]*$", x)[0]
                kept.append((lead + "".join(stay).lstrip(" \t\n\v\f\r") + trail, True))
            else:
                kept.append((x, True if pieces else None))
            if pieces:
                last = bool(stay)
            at += len(pieces)
        out[d] = ("\n".join(x for x, s in kept if s is not False), n)
    return out


def cleaned(spark, rows, schema=DOCS):
    return {(r["doc_id"], r["text"]): (r["clean_text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()}


@pytest.mark.parametrize(("seed", "salted"), [(4, False), (5, True)])
def test_line_dedup(spark, monkeypatch, seed, salted):
    if salted:  # what stands twice in all of the texts is dealt over salts
        monkeypatch.setattr(line_dedup, "HOT_ROWS", 1)
        monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice((1, 3, 6, 30, 60)))) for _ in range(25)]
    rows = [(i if i % 11 else None, "\n".join(x + " " * (i % 2) if k % 5 else f"\n{x}" for k, x in enumerate(rng.choices(pool, k=rng.randint(0, 14))))) for i in range(120)]
    for k in range(40):  # near copies and passages that begin and end anywhere
        w = [f"{rng.choice('xyz')}{j}" for j in range(rng.choice((60, 90, 200)))]
        for c in range(rng.choice((1, 2, 5))):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = f"edit{rng.random()}"
            lo = rng.randrange(20)
            rows.append((1000 + 10 * k + c, "".join(x + rng.choice((" ", " ", " ", "\n", "\t")) for x in v[lo : len(v) - rng.randrange(20)])))
    rows += [(2500, None), (2501, ""), (2502, "\n\n"), rows[7], (2503, "z\n" * 3_000), (2504, rows[9][1]), (2505, "word " * 20_000), (2506, "word " * 20_000), (None, "solo " * 70), (None, "solo " * 70)]
    out = line_dedup.dedup_lines(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")).collect()
    assert len(out) == len(rows)
    got = {(r["doc_id"], r["text"]): (r["clean_text"], r["n_removed"]) for r in out}
    want = by_hand(rows)
    assert {k: v for k, v in got.items() if k[1] is not None} == want
    assert got[2500, None] == (None, 0) and got[2501, ""] == ("", 0)
    assert sum(n for _, n in want.values()) > 100
    assert sum(r["n_lines"] for r in out) == sum(bool(x.strip()) for _, t in rows for x in (t or "").split("\n"))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 40), st.integers(1, 5))
def test_windows_select_their_minimum(seed, width, kinds):
    h = np.random.default_rng(seed).integers(0, 10**kinds, 150).astype(np.uint64)
    at, first, last = line_dedup.selected(h, width, np.ones(len(h) - width + 1, bool))
    assert first[0] == 0 and last[-1] == len(h) - width and (first[1:] == last[:-1] + 1).all()
    for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, b + 1):
            assert p == max(i for i in range(s, s + width) if h[i] == h[s : s + width].min())


def test_runs_of_two_lines_go(spark):
    """No line of a run of two lines or more stays, whichever documents share whichever part of it."""
    rows = [(1, "o1\nb\nc\nd\ne1"), (2, "o2\na\nb\nc\nd\ne\ne2"), (3, "o3\na\nb\nc\nd\ne\ne3")]
    rows += [(10 + k, f"top {k}\nfollow us\nshare this\nend {k}") for k in range(10)] + [(30 + k, f"x{k}\ncommon line\ny{k}") for k in range(5)]
    got = {d: t for (d, _), (t, _) in cleaned(spark, rows).items()}
    assert got[1] == rows[0][1] and got[2] == "o2\na\ne\ne2" and got[3] == "o3\ne3"
    assert [got[10 + k] for k in range(1, 10)] == [f"top {k}\nend {k}" for k in range(1, 10)]
    assert [got[30 + k] for k in range(5)] == [t for _, t in rows[-5:]]


def test_op1_same_as_sql(spark, sf, same_rows):
    same_rows(registered.QUERIES["op1_line_dedup"](spark, sf), registered.ORACLES["op1_line_dedup"])


def test_a_long_run_goes_once(spark):
    run = "\n".join(f"line number {k} of the run" for k in range(6))
    rows = [(1, f"own one\n{run}\nend one"), (2, f"own two\n{run}\nend two"), (3, "own one\nend two\nother")]
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[0][1], 2: "own two\nend two", 3: rows[2][1]}


def test_a_passage_of_fifty_words_goes(spark):
    passage = " ".join(f"w{k}" for k in range(55))
    rows = [(2, f"b\n{passage}"), (1, f"a\n{passage}\nc"), (3, passage.replace("w7 ", "w7\n"))]
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[1][1], 2: "b", 3: ""}
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("sizes", [(20, 20, 20), (24, 25, 24), (1, 48, 1), (30, 10, 30)])
def test_three_lines_of_fifty_words_go(spark, sizes):
    want, rows = {}, []
    for k in range(12):
        passage = "\n".join(" ".join(f"p{k}x{j}y{w}" for w in range(n)) for j, n in enumerate(sizes))
        rows += [(2 * k, f"a{k}\n{passage}\nb{k}"), (2 * k + 1, f"c{k}\n{passage}\nd{k}")]
        want |= {2 * k: rows[-2][1], 2 * k + 1: f"c{k}\nd{k}"}
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_passages_inside_lines_go(spark):
    rng = random.Random(9)
    own = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    rows, want = [], {}
    for k, n in enumerate((49, 50, 52, 59, 120)):
        words = own(f"p{k}x", n)
        passage = "".join(w + ("\n" if j % 30 == 20 else " ") for j, w in enumerate(words)).strip()
        for copy in (0, 1):
            lead, tail = (" ".join(own(f"{t}{k}c{copy}x", rng.randint(1, 40))) for t in "ab")
            rows.append((2 * k + copy, f"{lead} {passage} {tail}\nend {k} {copy}"))
            want[2 * k + copy] = rows[-1][1]
            if copy and n >= 50:
                want[2 * k + copy] = f"{lead}\n{tail}\nend {k} {copy}"
    rows.append((100, " ".join(["again"] * 130)))
    want[100] = " ".join(["again"] * 50)
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want
