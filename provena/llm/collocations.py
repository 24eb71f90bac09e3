"""Phrase collocation mining: vertical positional lists, extended by merge joins, scored by their weakest cut.

Texts of one language are joined, cut between pieces into blocks and turned into inverted lists: for each word the sorted positions at which it stands, where a
separator takes a position of its own. A phrase's frequency is the length of its lists, summed over the blocks. Level by level,
the occurrence positions of frequent phrases are merge-joined with the postings of the frequent words that stand right behind them (and with the phrases' own lists one
position on, as a longer phrase is frequent only if both its ends are), which gives the lists of the phrases that are one word longer. Nothing that
is frequent can be missed, since a phrase is never more frequent than its parts. Positions never leave their block: each level reads the texts anew and builds
the lists up to its own, which costs less than to write and move them. Only a count for each phrase and block is shuffled, summed up in each task before.

Which phrases are frequent reaches the tasks as one bit map of BITS bits, whatever their number: with very many of them fewer lists are spared, and none is
lost, as frequencies are exact and compared at the end. Cuts are joined to the frequencies of their parts with parts of many cuts dealt over
several tasks; scores are whole numbers from 38-digit arithmetic, exact for frequencies under 10^15.

Defined cases: null and empty texts have no words; a null language is `und`; rows that repeat count as often as they stand there; a text of one piece is one block, however
long; ties go by the orders of the contract, to the last by the phrase; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Shared, read, salted_join, slices, written

#: Bytes of text of a block; bits of the map of frequent phrases (8 MB a level); rows of a batch of counts.
BLOCK, BITS, ROWS = 8 << 20, 1 << 26, 50_000
MARK = b"\xff"  # stands in no UTF-8 text
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(MARK[0] if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _stretches(text: bytes) -> Iterator[bytes]:
    """text in stretches of about BLOCK bytes that end at marks."""
    at = 0
    while at < len(text):
        end = text.find(MARK, at + BLOCK) if len(text) > at + BLOCK else -1
        yield text[at : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else len(text)


class Lists:
    """The inverted lists of a block: its phrases, and (phrase number, position) in order of position."""

    def __init__(self, phrases: pa.Array, number: np.ndarray, at: np.ndarray):
        self.phrases, self.number, self.at = phrases, number, at

    def only(self, keep: np.ndarray) -> Lists:
        held = keep[self.number]
        return Lists(self.phrases.filter(pa.array(keep)), (np.cumsum(keep) - 1)[self.number[held]], self.at[held])

    def lengths(self) -> np.ndarray:
        return np.bincount(self.number, minlength=len(self.phrases))


def _word_lists(text: bytes) -> Lists:
    tokens = text.replace(MARK, b" \xff ").split()  # only spaces and tabs are left of white space
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary
    return Lists(words, code, np.arange(len(code))).only(pc.not_equal(words, pa.scalar(MARK, pa.binary())).to_numpy(zero_copy_only=False))


def _meet(positions: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two sorted lists of positions: where in each the common ones stand."""
    if not len(other):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.searchsorted(other, positions)
    i[i == len(other)] = 0
    hit = np.flatnonzero(other[i] == positions)
    return hit, i[hit]


def _extended(left: Lists, words: Lists, level: int) -> Lists:
    """Lists of the phrases of level + 1 words, from frequent ones of level words and frequent words."""
    follows, _ = _meet(left.at + 1, left.at)  # the other end is frequent too
    where, word = _meet(left.at[follows] + level, words.at)
    where = follows[where]
    pair = left.number[where] * np.int64(len(words.phrases)) + words.number[word]
    different, number = np.unique(pair, return_inverse=True)
    if not len(different):
        return Lists(left.phrases[:0], number, left.at[:0])
    phrases = pc.binary_join_element_wise(left.phrases.take(pa.array(different // len(words.phrases))), words.phrases.take(pa.array(different % len(words.phrases))), b" ")
    return Lists(phrases, number, left.at[where])


class Frequent:
    """A bit map of phrases; tells of all that are in it, and of few others, that they are."""

    def __init__(self, buckets: dict[int, bytes]):
        self.bits = np.zeros(BITS // 8, np.uint8)
        for k, m in buckets.items():
            self.bits[k * len(m) : (k + 1) * len(m)] = np.frombuffer(m, np.uint8)

    def of(self, lang: str, phrases: pa.Array) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        at = np.fromiter((xxhash.xxh64_intdigest(p, seed) % BITS for p in phrases.to_pylist()), np.int64, len(phrases))
        return (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _counted(batches: Iterator[pa.RecordBatch], frequent: list[Frequent]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of each block of (lang, text): how often its phrases of len(frequent) + 1 words occur; frequent: by level."""
    for b in batches:
        for first, n in slices(b.column("text"), BLOCK):
            part = b.slice(first, n)
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                joined = MARK.join(t for k, t in zip(langs, texts, strict=True) if k == lang and t).translate(_TABLE)
                for stretch in _stretches(joined):
                    words = lists = _word_lists(stretch)
                    for level, known in enumerate(frequent, 1):
                        lists = lists.only(known.of(lang, lists.phrases))
                        words = lists if level == 1 else words
                        lists = _extended(lists, words, level)
                    phrases, n = lists.phrases.cast(pa.string()), pa.array(lists.lengths(), pa.int64())
                    for lo in range(0, len(n), ROWS):
                        size = min(ROWS, len(n) - lo)
                        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(size, np.int32))), phrases.slice(lo, size), n.slice(lo, size)], names=["lang", "phrase", "n"])


def _bit_map(phrases: DataFrame) -> Frequent:
    """8 MB at most, in parts of one bit map of Spark's size each."""
    place = F.pmod(F.xxhash64("lang", "phrase"), F.lit(BITS)) + 1  # Spark's bit maps begin at 1
    parts = phrases.select(place.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("m")).collect()
    return Frequent({r["b"] - 1: bytes(r["m"]) for r in parts})


def phrase_frequencies(docs: DataFrame, max_words: int, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of up to max_words words that occur least times or more, (lang, n) with the number of all words)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    sent: list[Shared] = []

    def frequencies() -> DataFrame:
        count = lambda b, sent=tuple(sent): _counted(b, [s.value for s in sent])
        return rows.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))

    words = written(frequencies(), "phrases-1")  # the rare ones too, as they count in n
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [words.where(F.col("f") >= least)]
    for level in range(2, max_words + 1):
        sent.append(Shared(spark, _bit_map(found[-1])))
        found.append(written(frequencies().where(F.col("f") >= least), f"phrases-{level}"))
    out = found[0].withColumn("words", F.lit(1))
    for k, f in enumerate(found[1:]):
        out = out.unionByName(f.withColumn("words", F.lit(k + 2)))
    return out, n


def _with_frequency(cuts: DataFrame, frequencies: DataFrame, part: str, name: str, total: int) -> DataFrame:
    """cuts with the frequency of their part. A part of many cuts is dealt over several tasks."""
    uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses"))
    table = frequencies.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(uses, ["lang", part])
    return salted_join(cuts, table, ["lang", part], "uses", total).drop("uses")


def cut_score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * a / (left * right)), exact for frequencies under 10^15 and a scale under 10^7; a is at most left and right."""
    wide = lambda c: c.cast("decimal(15,0)")
    square = (wide(a) * wide(a)).cast("decimal(31,0)")
    return F.call_function("div", square * F.lit(scale).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, percent: int = 50, scale: int = 1_000_000, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases (all, if None) of 2 to max_words words that occur least times or more.

    Phrases that lie within a longer candidate with at least percent % of their frequency are left out.
    """
    frequencies, n = phrase_frequencies(docs, max_words, least, lang_col, text_col)
    candidates = frequencies.where("words > 1")
    words = F.split("phrase", " ")
    stretch = lambda lo, k: F.array_join(F.slice(words, lo, k), " ")

    inside = [F.struct((F.lit(lo)).alias("lo"), F.lit(k).alias("k"), F.lit(m).alias("of")) for m in range(3, max_words + 1) for k in range(2, m) for lo in range(1, m - k + 2)]
    kept = candidates.withColumnRenamed("f", "a")
    if inside:
        longer = candidates.where("words > 2").withColumn("s", F.explode(F.filter(F.array(*inside), lambda s: s["of"] == F.col("words"))))
        longest = longer.groupBy("lang", stretch(F.col("s.lo"), F.col("s.k")).alias("phrase")).agg(F.max("f").alias("within"))
        kept = kept.join(longest, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < percent * F.col("a"))).drop("within")
    k = F.col("k")
    cuts = written(kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", stretch(F.lit(1), k).alias("head"), stretch(k + 1, F.col("words") - k).alias("rest")), "cuts")
    total = cuts.count()
    both = _with_frequency(_with_frequency(cuts, frequencies, "head", "l", total), frequencies, "rest", "r", total)
    least_cut = both.withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r"), scale)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    return _ranked(least_cut, top).join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # n: a row a language


def _ranked(scored: DataFrame, top: int | None, deals: int = 64) -> DataFrame:
    """With rank. The first `top` of each of several deals first, so that no task orders a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    if top is not None:
        dealt = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(deals)))
        scored = dealt.withColumn("rank", number("lang", "deal")).where(F.col("rank") <= top).drop("deal", "rank")
    ranked = scored.withColumn("rank", number("lang"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def op12_collocations(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with p as (select row_number() over () as piece, lang, t from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents)),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') as w from p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
o as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (select unnest([1, 2, 3]) as k)),
f as (select lang, k, phrase, count(*) as f from o group by all having count(*) >= 10),
c as (select *, string_split(phrase, ' ') as s from f where k > 1),
i as (select lang, phrase, max(f) as f from (select lang, f, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) as phrase from c where k = 3) group by all),
kept as (select c.* from c left join i on c.lang = i.lang and c.phrase = i.phrase where i.f is null or 100 * i.f < 50 * c.f),
cuts as (select lang, phrase, f as a, unnest(range(1, k)) as cut, s from kept),
scored as (select cuts.lang, cuts.phrase, a, cut, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(s[1:cut], ' ') join f y on y.lang = cuts.lang and y.phrase = array_to_string(s[cut + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select best.lang, row_number() over (partition by best.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score
from best join n on n.lang = best.lang qualify rank <= 2000
"""
