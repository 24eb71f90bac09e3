"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding: lower case; look-alikes of other alphabets and full-width forms become Latin letters; digits and signs that stand for letters
become them (signs only inside a word); invisible characters go; what is left of punctuation becomes a space. Words and
phrases are matched with a space on either side, all in one automaton pass over the whole text.

An entry is a whole word or a phrase, or a beginning of words, written with a star (`stem*`), which matches with a boundary on its left only: where endings vary, whole
words are rare. Of the entries that match at a place the longest counts.

The lexicon is learned from labelled rows: words, and beginnings of BEGINNINGS letters, that occur more often in toxic rows than in others, weighted by the log of
the ratio. Occurrences count, at most REPEATS a row, since toxic rows hold many such words where a clean one holds one by chance; the excess must be one that
chance does not give among all words (log-likelihood ratio SURE). Exception phrases are learned too: a word that an entry matches with its neighbour before or after, where the
pair occurs in several clean rows and in no toxic one; a match takes the word's weight back. Both can be given instead. A logistic regression over the sum of weights,
the sum over the length, the number of different entries, the largest weight and the length gives the score; it is fitted on rows
that the lexicon has not seen. The sample is at most MAX_TRAIN labelled rows.

Defined cases: null and empty texts match nothing and get the score of a text without matches; without labelled rows of both classes
the score is the base rate; repeated rows get the same score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, fresh, read
from .learning import fold_of, logistic, training_sample

MAX_TRAIN = 24_000
MIN_ROWS, MIN_WEIGHT, SURE = 3, 1.8, 24.0
#: Letters of the beginnings of words that may become entries; occurrences of an entry in a row that count.
BEGINNINGS, REPEATS = (5, 6, 7, 8), 3
REJECT = 0.7

#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ſ": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}
_SIGN = re.compile(r"(?<=\w)[@$!|€£](?=\w)")


def _table() -> dict[int, str | None]:
    t: dict[int, str | None] = {}
    for c in [*range(0x80), *range(0xA0, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3004), *range(0xFF00, 0xFF10)]:
        if not chr(c).isalnum():
            t[c] = " "
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)):
        t[c] = None
    t |= {0xFF41 + k: chr(97 + k) for k in range(26)}
    t |= {0xFF21 + k: chr(97 + k) for k in range(26)}
    t |= {0xFF10 + k: DIGITS.get(str(k), str(k)) for k in range(10)}
    return t | {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}


FOLD = _table()


def folded(text: str) -> str:
    t = text.lower()
    if any(c in t for c in SIGNS):
        t = _SIGN.sub(lambda m: SIGNS[m[0]], t)
    return f" {t.translate(FOLD)} "


@dataclass
class Lexicon:
    """Folded words, phrases and beginnings of words with weights; exceptions have negative ones. coefficients: of the five features, then the constant."""

    weights: dict[str, float]
    coefficients: list[float] = field(default_factory=lambda: [0.0] * 6)

    def automaton(self):
        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(f" {k[:-1]}" if k.endswith("*") else f" {k} ", (k, w))
        if len(a):
            a.make_automaton()
        return a


def matches(a, text: str | None) -> tuple[list[float], int]:
    """Features of a text, and how many entries it matched."""
    t = " ".join(folded(text or "").split())
    n = t.count(" ") + 1 if t else 0
    total, found = 0.0, {}  # found: by the place where it begins, the longest entry
    if len(a) and t:
        for end, (k, w) in a.iter(f" {t} "):
            if w < 0:
                total += w
                continue
            size = len(k) if k.endswith("*") else len(k) + 2
            at = end - size + 1
            if at not in found or found[at][0] < size:
                found[at] = size, k, w
    total = max(total + sum(w for _, _, w in found.values()), 0.0)
    if not total:
        return [0.0, 0.0, 0.0, 0.0, np.log1p(n)], 0
    kinds, top = len({k for _, k, _ in found.values()}), max(w for _, _, w in found.values())
    return [np.log1p(total), np.log1p(1000 * total / (n + 20)), np.log1p(kinds), top, np.log1p(n)], kinds


def entry_of(word: str, weights: dict[str, float]) -> str | None:
    """The longest entry that matches a folded word."""
    if word in weights:
        return word
    return next((k for k in (f"{word[:m]}*" for m in sorted(BEGINNINGS, reverse=True) if len(word) >= m) if k in weights), None)


def occurrences(text: str) -> Counter:
    """How often each folded word and each beginning of words occurs, up to REPEATS."""
    words = Counter(folded(text).split())
    out = Counter(words)
    for w, n in words.items():
        for m in BEGINNINGS:
            if len(w) >= m:
                out[f"{w[:m]}*"] += n
    return Counter({k: min(n, REPEATS) for k, n in out.items()})


def _counted(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """Rows (key, pos, neg): how often each key of keys_of(text) occurs in toxic and other rows of this partition."""
    counts = (Counter(), Counter())

    def flush():
        keys = list({*counts[0], *counts[1]})
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["key", "pos", "neg"])
        counts[0].clear()
        counts[1].clear()
        return out

    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            counts[1 if y else 0].update(keys_of(text.decode()))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    yield flush()


def _frequencies(rows: DataFrame, keys_of) -> DataFrame:
    return rows.select("text", "y").mapInArrow(lambda b: _counted(b, keys_of), "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(sample: DataFrame, given: Lexicon | None = None) -> Lexicon:
    """The lexicon and its calibration from rows (id, text, y) of training_sample()."""
    part = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(3))
    first, second = sample.where(part != 0), sample.where(part == 0)
    lexicon = given
    if lexicon is None:
        n = {r["y"]: r["n"] for r in first.groupBy(F.when(F.col("y") > 0, 1).otherwise(0).alias("y")).agg(F.count("*").alias("n")).collect()}
        p, q = n.get(1, 0), n.get(0, 0)
        pos, neg = F.col("pos"), F.col("neg")
        weight = F.log((pos + 0.5) / (p + 1.0)) - F.log((neg + 0.5) / (q + 1.0))
        share = lambda x, n: F.when(x > 0, x * F.log(x * (p + q) / ((pos + neg) * n))).otherwise(0.0)
        counted = _frequencies(first, occurrences).where(pos >= MIN_ROWS)
        found = counted.withColumn("w", weight).where((F.col("w") >= MIN_WEIGHT) & (2 * (share(pos, p) + share(neg, q)) >= SURE))
        lexicon = Lexicon({r["key"]: float(r["w"]) for r in found.orderBy("key").collect()})  # words of at most MAX_TRAIN rows
        words = dict(lexicon.weights)

        def pairs(t: str) -> set[str]:
            w = folded(t).split()
            return {p for i, x in enumerate(w) if entry_of(x, words) for p in ([f"{w[i - 1]} {x}"] if i else []) + ([f"{x} {w[i + 1]}"] if i + 1 < len(w) else [])}

        if words:
            clean = _frequencies(first, pairs).where(f"pos = 0 and neg >= {MIN_ROWS}").orderBy("key").collect()
            for r in clean:
                lexicon.weights[r["key"]] = -max(words.get(entry_of(x, words), 0.0) for x in r["key"].split(" "))
    held = lexicon.weights

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Lexicon(held).automaton()
        for b in batches:
            x = [matches(a, t.decode())[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    rows = second.select("text", "y").mapInArrow(features, "x array<double>, y int").collect()  # five numbers a row, about MAX_TRAIN / 3 rows
    x = np.array([r["x"] for r in rows], float).reshape(-1, 5)
    lexicon.coefficients = logistic(x, np.array([float(r["y"] > 0) for r in rows])).tolist()
    return lexicon


ADDED = ("toxicity", "toxic_matches")


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", added: tuple[str, str] = ADDED) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_matches (different entries found). Columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    k = docs.columns.index(text_col)
    held = Shared(docs.sparkSession, lexicon)  # words and pairs of at most MAX_TRAIN rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value
        a, c = lexicon.automaton(), np.array(lexicon.coefficients)
        for b in batches:
            found = [matches(a, t) for t in b.column(k).to_pylist()]
            x = np.array([f for f, _ in found], float).reshape(-1, 5)
            s = 1 / (1 + np.exp(-np.clip(x @ c[:-1] + c[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([n for _, n in found], pa.int32())], names=[*b.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())]))


def learned(spark, sf_dir) -> Lexicon:
    """From the labelled rows of sf_dir whose fold is not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return fit(training_sample(docs, labels, "toxic", fold_of("doc_id", 3) != 1, MAX_TRAIN))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = REJECT, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under threshold, with the columns they came with."""
    names = fresh(docs, *ADDED)
    return score(docs, lexicon, text_col, tuple(names)).where(F.col(names[0]) < threshold).select(docs.columns)


def op4_toxicity(spark, sf_dir):
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text"), learned(spark, sf_dir))
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= REJECT).cast("int").alias("predicted"))
