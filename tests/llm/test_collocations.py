"""Collocations: against SQL, and against a brute-force version with blocks of any size."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provena.llm import collocations, registered

DOCS = "doc_id long, text string, lang string, words int, f int, phrase string"


def brute_force(docs, max_words, least, percent, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}

    def within(lang, p):
        return any(100 * b >= percent * candidates[lang, p] for (m, q), b in candidates.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))

    out = []
    for lang in {k for k, _ in candidates}:
        scored = []
        for (m, p), a in candidates.items():
            if m == lang and not within(lang, p):
                score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(spark, docs, **how):
    got = collocations.collocations(spark.createDataFrame(docs, DOCS), **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in got.collect())


def prose(seed, rows=120):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "New", "York", "é", "É", "z z", "\x1c", "x-y", "日本"] + [f"w{i}" for i in range(12)]
    out = []
    for i in range(rows):
        words = [draw.choice(["New York city hall", draw.choice(vocabulary)]) + draw.choice([" ", " ", " ", "\t  ", ". ", ",", "\r\n", "!?"]) for _ in range(draw.randint(0, 30))]
        out.append((i, "".join(words), draw.choice(["en", "en", "de", None, ""]), 1, 2, "clash"))
    return out + out[:5] + [(None, None, "en", 0, 0, ""), (7, "", "en", 0, 0, ""), (8, " . , ", "xx", 0, 0, "")]


def test_same_as_sql(spark, sf, same_rows):
    same_rows(registered.QUERIES["op12_collocations"](spark, sf), registered.ORACLES["op12_collocations"])


@pytest.mark.parametrize("block,max_words,least,percent,top", [(8 << 20, 3, 10, 50, 2000), (50, 3, 4, 50, 9), (1, 4, 3, 80, 2000), (300, 5, 3, 30, 25)])
def test_same_as_brute_force(spark, monkeypatch, block, max_words, least, percent, top):
    monkeypatch.setattr(collocations, "BLOCK", block)
    docs = prose(max_words)
    assert found(spark, docs, max_words=max_words, least=least, percent=percent, top=top) == brute_force(docs, max_words, least, percent, top)


def test_full_bit_map_loses_nothing(spark, monkeypatch):
    """A map in which most bits are set spares few lists and changes nothing."""
    monkeypatch.setattr(collocations, "BITS", 32768)
    monkeypatch.setattr(collocations.Frequent, "of", lambda self, lang, phrases: __import__("numpy").ones(len(phrases), bool))
    docs = prose(1)
    assert found(spark, docs) == brute_force(docs, 3, 10, 50, 2000)


def test_one_pair_everywhere(spark):
    """One word stands in a third of all places, so its cuts meet one frequency; copies of one text by the thousand."""
    docs = [(i, "very common pair very common pair" if i % 3 else f"common w{i % 40} common w{i % 40} very", "en", 0, 0, "") for i in range(3000)]
    assert found(spark, docs) == brute_force(docs, 3, 10, 50, 2000)
    assert found(spark, []) == []


def test_long_text_is_cut_between_pieces():
    text = b"a b\xff" * 50
    parts = list(collocations._stretches(text))
    assert b"\xff".join(parts).rstrip(b"\xff") == text.rstrip(b"\xff")


def test_bit_map_holds_its_phrases(spark):
    import pyarrow as pa

    words = [f"p {i}" for i in range(2000)]
    bits = collocations._bit_map(spark.createDataFrame([("en", w) for w in words], "lang string, phrase string"))
    assert bits.of("en", pa.array(words)).all()
    assert bits.of("de", pa.array(words)).sum() < 20 and bits.of("en", pa.array([f"q {i}" for i in range(2000)])).sum() < 20


def test_scores_beyond_64_bits(spark):
    """Products of frequencies pass 64 bits; the score is exact."""
    a, left, right = 3 * 10**13 + 1, 7 * 10**13, 9 * 10**13 + 7
    rows = spark.createDataFrame([(a, left, right), (10, 10, 10)], "a long, l long, r long")
    got = [r["s"] for r in rows.select(collocations.cut_score(F.col("a"), F.col("l"), F.col("r"), 1_000_000).alias("s")).collect()]
    assert got == [1_000_000 * a * a // (left * right), 1_000_000]
