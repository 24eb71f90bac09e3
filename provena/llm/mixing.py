"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Targets: sources share the words of the mix by weight; a source's target stops at `most` times its size and the excess
is shared anew by weight until none is above (solved in closed form: sources sorted by cap over weight fill up first).

Apportionment: the mix is cut into equal-token blocks, and blocks go to the sources with the highest quotients
target / (2 k + 1). A source's seats lie between target / D - 1/2 and target / d + 1/2 for the divisors d, D that n sources
allow, so only the quotients in that range (two or three per source) are ranked, not those of every block. A source whose target
is under FINE blocks gets its target in blocks of its own, a FINE-th of the target, so that it takes that however large the others are.

Selection: a source's words stand in one line, documents in order of a seeded hash, cut into the same blocks. A quota over the
source's size takes whole passes first; the rest is the blocks whose number under a seeded permutation (block * prime + shift,
modulo the number of blocks) is below what is left. A document takes what its interval shares with taken blocks. The line's
positions come from prefix sums over (source, cell), where a cell is the leading part of the hash, so that no task holds a source.

Defined cases: a null or empty text has size 0 and takes 0; the null source comes last; a source without words has target 0;
an empty table gives an empty result; repeated rows stand side by side in the line and each counts; rows without a key are placed by their text, so
they spread over the cells as others do (those that also share a text stand in one); rows of one key go by size and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, n_words, read

#: Primes over the largest number of blocks, from which the seed picks the step of a source's permutation.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033)
BLOCKS = 65536
FINE = 256
CELLS_HEX = 3


def _hash(key: Column, seed: str, text: Column | None = None) -> Column:
    """Of the key; rows without one are told apart by their text, where it is given."""
    none = F.lit("null") if text is None else F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), none)))


def targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight and target. One row per source, so one task orders them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    w = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", (F.col("source_size") * most).cast("double"))
    total, whole = F.sum("source_size").over(Window.partitionBy()).cast("double"), F.sum("weight").over(Window.partitionBy())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (whole - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("total", total).withColumn("level", level).withColumn("place", F.row_number().over(by_cap))
    # the first source, in this order, whose share at the level of its place lies under its cap: from it on nobody is full
    w = w.withColumn("open", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("place"))).over(Window.partitionBy()))
    share = F.max(F.when(F.col("place") == F.col("open"), F.col("level"))).over(Window.partitionBy())
    full = F.col("open").isNull() | (F.col("place") < F.col("open"))
    return w.withColumn("target", F.when(full, F.col("cap")).otherwise(share * F.col("weight"))).select("source", "source_size", "weight", "target", "total", "rank")


def apportion(t: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """t (of targets) with block (tokens in a block) and quota (blocks of the source)."""
    everything = Window.partitionBy()
    t = t.withColumn("n", F.count("*").over(everything)).withColumn("blocks", F.greatest(F.lit(blocks), F.col("n") * 256).cast("long"))
    p = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    t = t.withColumn("lo", F.greatest(F.floor(p * (F.col("blocks") - F.col("n") / 2) - 0.5), F.lit(0)).cast("long"))
    t = t.withColumn("hi", F.when(p > 0, F.ceil(p * (F.col("blocks") + F.col("n") / 2) + 0.5)).otherwise(0).cast("long"))
    t = t.withColumn("left", F.col("blocks") - F.sum("lo").over(everything))
    q = t.where("hi > lo").select("rank", "left", "target", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("k"))
    q = q.withColumn("place", F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("rank"), F.col("k"))))
    won = q.where("place <= left").groupBy("rank").agg(F.count("*").alias("won"))
    block = F.greatest(F.ceil(F.col("total") / F.col("blocks")), F.lit(1)).cast("long")
    # blocks whose tokens are rounded up would give more words than the targets; the seats are scaled back by the true block
    out = t.join(won, "rank", "left").withColumn("seats", F.col("lo") + F.coalesce("won", F.lit(0))).withColumn("block", block)
    out = out.withColumn("quota", F.round(F.col("seats") * F.col("total") / F.col("blocks") / F.col("block")).cast("long"))
    # a target of few blocks is lost in their rounding; such a source is settled in blocks of its own, FINE to its target
    few = F.col("target") < F.col("block") * FINE
    own = F.greatest(F.floor(F.col("target") / FINE), F.lit(1)).cast("long")
    out = out.withColumn("quota", F.when(few, F.round(F.col("target") / own)).otherwise(F.col("quota")).cast("long"))
    return out.withColumn("block", F.when(few, own).otherwise(F.col("block")))


def mix(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), most: int = 3, seed: str = "mix-1", blocks: int = BLOCKS) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted).

    Column names of docs that clash with these four are replaced.
    """
    mine = ("size", "source_size", "target", "taken")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in mine])
    h, same, cell, s, c, base, pos, rk, blk, quo = fresh(docs, "mix_hash", "mix_same", "mix_cell", "mix_s", "mix_c", "mix_base", "mix_pos", "mix_rank", "mix_block", "mix_quota")
    d = docs.withColumn("size", n_words(F.col(text_col))).withColumn(h, _hash(F.col(key_col), seed, F.col(text_col))).withColumn(same, F.xxhash64(text_col)).withColumn(cell, F.substring(h, 1, CELLS_HEX))
    small = docs.select(F.col(source_col).alias("source"), F.substring(_hash(F.col(key_col), seed, F.col(text_col)), 1, CELLS_HEX).alias("cell"), n_words(F.col(text_col)).alias("size"))
    cells = small.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    # prefix sums of cells: at most 16**CELLS_HEX rows a source, ordered within the source
    starts = cells.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = apportion(targets(cells.groupBy("source").agg(F.sum("n").cast("long").alias("source_size")), weights, most), blocks)
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", F.col("rank").alias(rk), F.col("block").alias(blk), F.col("quota").alias(quo))
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(F.col("source").alias(s), F.col("cell").alias(c), F.col("base").alias(base), "source_size", "target", rk, blk, quo)
    order = Window.partitionBy(source_col, cell).orderBy(F.col(h), F.col(key_col).asc_nulls_last(), F.col("size"), F.col(same))
    line = d.withColumn(pos, F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    line = line.join(starts, F.col(source_col).eqNullSafe(F.col(s)) & (F.col(cell) == F.col(c)))
    line = line.withColumn(pos, F.col(pos) + F.col(base))
    return line.withColumn("taken", _taken(F.col("size"), F.col(pos), F.col("source_size"), F.col(blk), F.col(quo), F.col(rk), most, seed)).drop(h, same, cell, s, c, base, pos, rk, blk, quo)


def _taken(size: Column, pos: Column, whole: Column, block: Column, quota: Column, rank: Column, most: int, seed: str) -> Column:
    """Words of [pos, pos + size) that lie in taken blocks, passes over the whole source included."""
    want = F.least(quota * block, whole * most)
    passes = F.when(whole > 0, F.floor(want / whole)).otherwise(0).cast("long")
    n = F.ceil(whole / block).cast("long")
    left = F.round((want - passes * whole) / block).cast("long")
    number = int.from_bytes(seed.encode()[:6], "big")
    step, shift = F.lit(PRIMES[number % len(PRIMES)]), F.lit(number % 1000003) + rank * 7919
    taken = lambda j: F.pmod(j * step + shift, n) < left
    last = F.floor((pos + size - 1) / block).cast("long")
    first = F.floor(pos / block).cast("long")
    part = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, j: acc + F.when(taken(j), F.least(pos + size, (j + 1) * block) - F.greatest(pos, j * block)).otherwise(0))
    return F.when(size == 0, F.lit(0)).otherwise(size * passes + F.when((left > 0) & (passes < most), part).otherwise(0)).cast("long")


def op8_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))) as h from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source asc nulls last) - 1 as rank from s0),
s2 as (select *, cast([5, 2, 1][1 + rank % 3] as double) as weight, cast(source_size * 3 as double) as cap,
  cast(sum(source_size) over () as double) as total from s1),
s3 as (select *, row_number() over (order by cap / weight, rank) as place,
  (total - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from s2 window w as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
s4 as (select *, min(case when cap > level * weight then place end) over () as opened from s3),
s5 as (select *, case when opened is null or place < opened then cap
  else max(case when place = opened then level end) over () * weight end as target, count(*) over () as n from s4),
s6 as (select *, greatest(65536, n * 256) as blocks, case when total > 0 then target / total else 0 end as p from s5),
q as (select rank, target, k from s6, lateral (select unnest(generate_series(0::bigint, cast(ceil(p * (blocks + n / 2.0) + 0.5) as bigint))) as k) where p > 0),
won as (select rank, count(*) as seats from (select *, row_number() over (order by target / (2 * k + 1) desc, rank, k) as place from q)
  where place <= (select min(blocks) from s6) group by rank),
s7 as (select s6.*, coalesce(seats, 0) as seats, cast(greatest(ceil(total / blocks), 1) as bigint) as block from s6 left join won using (rank)),
s8a as (select *, cast(round(seats * total / blocks / block) as bigint) as quota, target < block * 256 as few, cast(greatest(floor(target / 256), 1) as bigint) as own from s7),
s8 as (select * exclude (quota, block), cast(case when few then round(target / own) else quota end as bigint) as quota, case when few then own else block end as block from s8a),
s9 as (select *, least(quota * block, source_size * 3) as want from s8),
s10 as (select *, case when source_size > 0 then want // source_size else 0 end as passes, cast(ceil(source_size / block) as bigint) as nb from s9),
s11 as (select *, cast(round((want - passes * source_size) / block) as bigint) as remaining from s10),
p as (select d.*, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as pos from d),
j as (select p.doc_id, p.size, p.pos, s11.* exclude (source) from p join s11 on p.source is not distinct from s11.source),
b as (select doc_id, sum(least(pos + size, (x + 1) * block) - greatest(pos, x * block)) as part from
  (select *, unnest(generate_series(cast(pos // block as bigint), cast((pos + size - 1) // block as bigint))) as x from j where size > 0)
  where ((x * 1000000007::hugeint + SHIFT + rank * 7919) % nb) < remaining and passes < 3 group by doc_id)
select j.doc_id, j.size, j.source_size, j.target, cast(j.size * passes + coalesce(part, 0) as bigint) as taken from j left join b using (doc_id)
"""
_N = int.from_bytes(b"mix-1"[:6], "big")
OP8_SQL = OP8_SQL.replace("1000000007", str(PRIMES[_N % len(PRIMES)])).replace("SHIFT", str(_N % 1000003))


def whole_copies(taken: Column, size: Column, key: Column, seed: str = "mix-1") -> Column:
    """How many copies of a whole document stand for its taken words: taken / size, the fraction decided by a seeded draw of the key.

    A document without words has nothing to take and comes once.
    """
    share = taken / F.when(size > 0, size)
    draw = F.conv(F.substring(_hash(key, f"{seed}:copies"), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return F.coalesce(F.floor(share) + F.when(draw < share - F.floor(share), 1).otherwise(0), F.lit(1)).cast("int")


def mix_whole(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole documents in the mix, as often as their taken words say (whole_copies): the columns of docs, whatever their names."""
    names = docs.columns
    plain = dict(zip(names, (f"c{i}" for i in range(len(names))), strict=True))
    mixed = mix(docs.toDF(*plain.values()), plain[key_col], plain[text_col], plain[source_col])
    times = whole_copies(F.col("taken"), F.col("size"), F.col(plain[key_col]))
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return mixed.withColumn("taken", copies).select(*plain.values()).toDF(*names)
