"""The engine's operators over the driver's tables, which stand in for audio: orders are discs, lines are tracks, events are samples.

Every query runs over whole tables. Where SQL can say the same, the SQL stands beside it.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provena.functions import exprs
from provena.operators import assign, checksum, cover, dealing, discs, limiter, merge, numbering, report, resample, tags, votes
from provena.operators.dealing import dealt
from provena.plans.registry import query, table
from provena.operators.report import PLACE
from provena.schema import TAG_FIELDS
from provena.shared import shared_dir, written
from provena.sources import binary, bucketed, container_tags, lookup_xml, response_files

#: A total order of an order's lines: line numbers repeat in the driver's table.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
U32 = 4294967296


def lines(spark, sf: str) -> DataFrame:
    """lineitem with pos, the place of a line in its order."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return dealt(table(spark, sf, "lineitem"), "l_orderkey").withColumn("pos", F.row_number().over(w))


LINES = "select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem"


def event_samples(spark, sf: str) -> DataFrame:
    """events as samples: (user_id, j, s), j by event_id."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor(F.coalesce("value", F.lit(0.0)) * 1000).cast("long").alias("v"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("user_id", F.row_number().over(w).cast("long").alias("j"), F.pmod(F.col("v") * 2654435761, F.lit(U32)).alias("s"))


SAMPLES = f"""select user_id, cast(row_number() over (partition by user_id order by event_id) as bigint) as j,
  cast(((cast(floor(coalesce(value, 0) * 1000) as bigint) * 2654435761::hugeint) % {U32} + {U32}) % {U32} as bigint) as s from events"""


# -- order-dependent checksums ------------------------------------------------------------------------------------------------------

@query("weighted_checksum_v1", f"""
with l as ({LINES})
select l_orderkey, cast(sum((pos * (cast(l_quantity as bigint) * 98765431 % {U32})) % {U32}) % {U32} as bigint) as v1 from l group by l_orderkey
""")
def weighted_checksum_v1(spark, sf):
    s = lines(spark, sf).select("l_orderkey", F.col("pos").alias("j"), exprs.u32(F.col("l_quantity").cast("long") * 98765431).alias("s"))
    return checksum.weighted_checksums(s, ["l_orderkey"]).select("l_orderkey", "v1")


@query("weighted_checksum_v2", f"""
with l as (select *, (l_partkey * 2654435761) % {U32} as s from ({LINES}))
select l_orderkey, cast(sum((pos * s) // {U32} + (pos * s) % {U32}) % {U32} as bigint) as v2 from l group by l_orderkey
""")
def weighted_checksum_v2(spark, sf):
    s = lines(spark, sf).select("l_orderkey", F.col("pos").alias("j"), exprs.u32(F.col("l_partkey") * 2654435761).alias("s"))
    return checksum.weighted_checksums(s, ["l_orderkey"]).select("l_orderkey", "v2")


@query("checksum_offset_shift", f"""
with s as ({SAMPLES}), t as (select user_id, user_id // 10 as disc, cast(user_id % 10 as int) as track_pos, j, s from s),
n as (select disc, track_pos, max(j) as n from t group by all),
m as (select n.*, b.n as n_before, a.n as n_after from n left join n b on b.disc = n.disc and b.track_pos = n.track_pos - 1
  left join n a on a.disc = n.disc and a.track_pos = n.track_pos + 1),
o as (select m.*, o.o as "offset", case when n_before is null then 3 else 1 end as lo, case when n_after is null then n - 3 else n end as hi
  from m, (select unnest([-2, -1, 0, 1, 2]) as o) o),
r as (select o.disc, o.track_pos, o."offset", lo, hi, t.s,
  case t.track_pos - o.track_pos when -1 then t.j - n_before when 1 then t.j + n else t.j end - o."offset" as l
  from o join t on t.disc = o.disc and t.track_pos between o.track_pos - 1 and o.track_pos + 1)
select cast(disc as bigint) as disc, track_pos, "offset", cast(sum((l * s) % {U32}) % {U32} as bigint) as v1,
  cast(sum((l * s) // {U32} + (l * s) % {U32}) % {U32} as bigint) as v2 from r where l between lo and hi group by all
""")
def checksum_offset_shift(spark, sf):
    e = event_samples(spark, sf)
    s = e.select(F.call_function("div", F.col("user_id"), F.lit(10)).alias("disc"), (F.col("user_id") % 10).cast("int").alias("track_pos"), "j", "s")
    return checksum.checksums_at_offsets(s, [-2, -1, 0, 1, 2], head=3, tail=3)


WINDOWS = f"""select user_id, j - 8 as start, cast((sum((j * s) % {U32}) over w - (sum(s) over w)::hugeint * (j - 8)) % {U32} as bigint) as value,
  count(*) over w as n from s window w as (partition by user_id order by j rows between 7 preceding and current row)"""


@query("offset_finder", f"""
with s as ({SAMPLES}), w as (select user_id, start, (value + {U32}) % {U32} as value from ({WINDOWS}) where n = 8),
t as (select distinct user_id, value as target from w where value <> 0)
select w.user_id, target, cast(start - 10 as bigint) as "offset" from w join t on w.user_id = t.user_id and w.value = t.target where start between 2 and 18
""")
def offset_finder(spark, sf):
    s = event_samples(spark, sf)
    t = checksum.window_checksums(s, 8, "user_id").select("user_id", F.col("value").alias("target"))
    return checksum.find_offsets(s, t, centre=10, half=8, width=8, key="user_id")


@query("prefix_sums", f"""
with s as ({SAMPLES}) select user_id, j, cast(sum(s) over w as bigint) as sum_s, cast(sum((j * s) % {U32}) over w % {U32} as bigint) as sum_js
from s window w as (partition by user_id order by j rows unbounded preceding)
""")
def prefix_sums(spark, sf):
    return checksum.prefix_sums(event_samples(spark, sf), "user_id").select("user_id", "j", "sum_s", "sum_js")


@query("region_accumulators", f"""
with l as (select *, count(*) over (partition by l_orderkey) as n, (l_partkey * 2654435761) % {U32} as s from ({LINES}))
select l_orderkey, case when pos < 2 then 'head' when pos + 2 > n then 'tail' else 'body' end as region, cast(sum((pos * s) % {U32}) % {U32} as bigint) as v1,
  cast(sum((pos * s) // {U32} + (pos * s) % {U32}) % {U32} as bigint) as v2 from l group by all
""")
def region_accumulators(spark, sf):
    s = lines(spark, sf).select("l_orderkey", F.col("pos").alias("j"), exprs.u32(F.col("l_partkey") * 2654435761).alias("s"))
    return checksum.region_sums(s, s.groupBy("l_orderkey").agg(F.count("*").alias("n")), ["l_orderkey"], head=2, tail=2)


#: The table of CRC-32 and its use on a list of octets, in SQL.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"
CRC = "cast(xor(list_reduce(list_prepend(4294967295, octets), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) as bigint)"
#: A sample as its four octets, in SQL.
OCTETS = "[s & 255, (s >> 8) & 255, (s >> 16) & 255, s >> 24]"


@query("sliding_crc_matches", f"""
with s as ({SAMPLES}), l as (select user_id, j - 1 as start, flatten(list({OCTETS}) over (partition by user_id order by j rows between current row and 7 following)) as octets from s),
c as (select user_id, start, {CRC} as crc32 from l, ({CRC_TABLE}) where len(octets) = 32),
t as (select distinct user_id, crc32 as target from c where crc32 <> 0)
select c.user_id, target, cast(start - 16 as bigint) as "offset" from c join t on c.user_id = t.user_id and crc32 = target where start between 0 and 32
""")
def sliding_crc_matches(spark, sf):
    """Windows of 8 samples in the searched slice whose CRC-32 is that of any window of the user's stream."""
    s = event_samples(spark, sf)
    t = checksum.sliding_crc(s, 8, "user_id").select("user_id", F.col("crc32").alias("target"))
    return checksum.find_offsets_crc(s, t, centre=16, half=16, width=8, key="user_id")


@query("resampled", f"""
with s as ({SAMPLES}), x as (select user_id, j - 1 as a, side, case when v >= 32768 then v - 65536 else v end as v from (select user_id, j, side, case side when 0 then s & 65535 else s >> 16 end as v from s, (select unnest([0, 1]) as side))),
n as (select user_id, count(*) as n from s group by 1), o as (select user_id, n, unnest(range((n * 147 + 159) // 160)) as m from n),
w as (select user_id, m, side, m * 160 % 147 as p, m * 160 // 147 - 7 as first from o, (select unnest([0, 1]) as side)),
t as (select w.user_id, m, w.side, cast(sum(coalesce(v, 0) * c[p + 1][a - first + 1]) as bigint) as total from (select {resample.phases(147, 160)} as c), w join x on x.user_id = w.user_id and x.side = w.side and a between first and first + 15 group by all),
y as (select user_id, m, side, greatest(least((total + 16384) >> 15, 32767), -32768) & 65535 as v from t)
select user_id, m + 1 as j, cast(sum(case side when 0 then v else v << 16 end) as bigint) as s from y group by 1, 2
""")
def resampled(spark, sf):
    """Events as samples of 48 kHz at 44.1 kHz, in blocks of 64."""
    return resample.resample(event_samples(spark, sf), 44100, 48000, key="user_id", block=64)


@query("region_crcs", f"""
with s as ({SAMPLES}), o as (select user_id, flatten(list({OCTETS} order by j)) as octets from s group by 1)
select user_id, {CRC} as crc32, cast(len(octets) as bigint) as octets from o, ({CRC_TABLE})
""")
def region_crcs(spark, sf):
    return checksum.region_crcs(event_samples(spark, sf), ["user_id"], block=16)


@query("track_crcs", f"""
with s as ({SAMPLES}), n as (select user_id, count(*) as n from s group by 1),
r as (select user_id, j, s, case when j <= 6 then 0 when j + 6 > n then 2 else 1 end as region from s join n using (user_id)),
o as (select user_id, region, flatten(list({OCTETS} order by j)) as octets from r group by all union all select user_id, 3, flatten(list({OCTETS} order by j)) from r group by all),
c as (select user_id, region, {CRC} as crc from o, ({CRC_TABLE}))
select user_id, max(case region when 0 then crc end) as head, max(case region when 1 then crc end) as body, max(case region when 2 then crc end) as tail, max(case region when 3 then crc end) as whole from c group by 1
""")
def track_crcs(spark, sf):
    s = event_samples(spark, sf)
    return checksum.track_crcs(s, s.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], edge=6, block=16)


@query("stream_summary", f"""
with s as ({SAMPLES}), o as (select user_id, count(*) as n, sum((j * s) % {U32}) % {U32} as v1, sum((j * s) // {U32} + (j * s) % {U32}) % {U32} as v2, flatten(list({OCTETS} order by j)) as octets from s group by 1)
select user_id, cast(n // 44100 as bigint) as seconds, cast(case when n % 588 = 0 then n // 588 else -1 end as bigint) as sectors, cast(v1 as bigint) as v1, cast(v2 as bigint) as v2, {CRC} as crc32 from o, ({CRC_TABLE})
""")
def stream_summary(spark, sf):
    return checksum.stream_summary(event_samples(spark, sf), ["user_id"])


@query("crc32_rows", f"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h, text is null as none from documents),
o as (select doc_id, none, list_transform(range(0, len(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) as octets from h)
select doc_id, case when not none then {CRC} end as crc32 from o, ({CRC_TABLE})
""")
def crc32_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32("text").alias("crc32"))


@query("byte_diff", """
with o as (select lang, doc_id, n_chars, row_number() over (partition by lang order by doc_id) as j from documents),
p as (select lang, cast((j - 1) // 2 as bigint) as j, (j - 1) % 2 as side, n_chars % 3 as s from o),
b as (select coalesce(x.lang, y.lang) as lang, x.s as x, y.s as y from (select * from p where side = 0) x full join (select * from p where side = 1) y on x.lang = y.lang and x.j = y.j)
select lang, count_if(x is not null and y is not null and x <> y) as changed, count_if(x is null or y is null) as unmatched,
  count_if(x is null or y is null or x <> y) as different from b group by lang
""")
def byte_diff(spark, sf):
    rows = numbering.numbered(table(spark, sf, "documents").select("lang", "doc_id", (F.col("n_chars") % 3).alias("s")), ["lang", "doc_id"])
    first = rows.groupBy("lang").agg(F.min("line").alias("first"))
    d = rows.join(first, "lang").select("lang", "s", (F.col("line") - F.col("first")).alias("k"))
    side = lambda k: d.where(F.col("k") % 2 == k).select("lang", F.call_function("div", F.col("k"), F.lit(2)).alias("j"), "s")
    return checksum.byte_differences(side(0), side(1), ["lang"])


@query("mono_detection", "select l_orderkey, bool_and(l_returnflag = l_linestatus) as mono from lineitem group by l_orderkey")
def mono_detection(spark, sf):
    return checksum.is_mono(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linestatus")


# -- candidate filters --------------------------------------------------------------------------------------------------------------

@query("cover_filter", """
select user_id, event_type, count(*) as n from events where user_id in
  (select user_id from events group by user_id having count(distinct event_type) = (select count(distinct event_type) from events)) group by all
""")
def cover_filter(spark, sf):
    return cover.covering(table(spark, sf, "events"), "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("any_match_prune", """
with o as (select o_orderkey, c_nationkey, coalesce(o_totalprice > 300000, false) as ok from orders join customer on o_custkey = c_custkey),
a as (select *, max(ok) over (partition by c_nationkey) as has_any from o)
select o_orderkey, c_nationkey from a where ok or not has_any
""")
def any_match_prune(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return cover.keep_matching_if_any(o.select("o_orderkey", "c_nationkey", "o_totalprice"), F.col("o_totalprice") > 300000, ["c_nationkey"]).select("o_orderkey", "c_nationkey")


@query("matching_discs", """
select o_orderkey, not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_suppkey % 7 = 0) as matches from orders
""")
def matching_discs(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("stream_index"))
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("release_id"))
    out = cover.with_matching_discs(r, l, l.where("stream_index % 7 <> 0"))
    return out.select(F.col("release_id").alias("o_orderkey"), "matches")


def _voted_discs(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    v = l.select(F.col("l_orderkey").alias("release_id"), (F.col("l_suppkey") % 3).alias("medium_pos"), F.col("l_suppkey").alias("disc_id"), F.col("l_partkey").alias("track_pos"), F.when(F.col("l_quantity") > 10, 1).otherwise(0).alias("v1"), F.lit(0).alias("v2"))
    keys = ["release_id", "medium_pos", "disc_id"]
    return cover.perfect_discs(v.select(*keys).distinct(), v, [*keys, "track_pos"], keys)


TRACKS = """
with t as (select l_orderkey as release_id, l_suppkey % 3 as medium_pos, l_suppkey as disc_id, l_partkey, bool_or(l_quantity > 10) as good from lineitem group by all),
d as (select release_id, medium_pos, disc_id, bool_and(good) as perfect from t group by all),"""


@query("perfect_disc_prune", TRACKS + """
a as (select *, max(perfect) over (partition by release_id, medium_pos) as has_any from d)
select release_id, medium_pos, disc_id, perfect from a where perfect or not has_any
""")
def perfect_disc_prune(spark, sf):
    return cover.prune_imperfect_discs(_voted_discs(spark, sf)).select("release_id", "medium_pos", "disc_id", "perfect")


@query("perfect_group_prune", TRACKS + """
w as (select release_id, bool_and(perfect) as whole from d group by all),
r as (select o_orderkey as release_id, o_custkey as release_group_id, coalesce(whole, true) as whole from orders left join w on o_orderkey = release_id),
a as (select *, max(whole) over (partition by release_group_id) as has_any from r)
select release_id, release_group_id from a where whole or not has_any
""")
def perfect_group_prune(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("release_group_id"))
    return cover.prune_imperfect_releases(r, _voted_discs(spark, sf)).select("release_id", "release_group_id")


@query("keep_best", """
select o_orderkey, o_custkey from (select *, max(o_totalprice) over (partition by o_custkey) as best from orders) where o_totalprice = best
""")
def keep_best(spark, sf):
    return cover.keep_best(table(spark, sf, "orders"), F.col("o_totalprice"), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("occurs_elsewhere", """
select o_orderkey, l_partkey, l_suppkey, exists (select 1 from lineitem b where b.l_partkey = a.l_partkey and b.l_suppkey <> a.l_suppkey) as elsewhere
from (select l_orderkey as o_orderkey, l_partkey, l_suppkey from lineitem) a
""")
def occurs_elsewhere(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return cover.occurs_elsewhere(l, "l_partkey", "l_suppkey")


@query("valid_configurations", "select l_orderkey, count(l_suppkey) = count(distinct l_suppkey) as valid from lineitem group by l_orderkey")
def valid_configurations(spark, sf):
    return cover.valid_configurations(table(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey")


# -- merging and sets ---------------------------------------------------------------------------------------------------------------

@query("nested_merge", """
select l_orderkey, l_suppkey, l_returnflag, max(l_quantity) as score from
  (select * from lineitem where l_discount < 0.05 union all select * from lineitem where l_discount >= 0.03) group by all
""")
def nested_merge(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("score"), "l_discount")
    keys = ["l_orderkey", "l_suppkey", "l_returnflag"]
    part = lambda c: l.where(c).select(*keys, "score")
    return merge.nested_merge(part("l_discount < 0.05"), part("l_discount >= 0.03"), keys=keys)


@query("merge_recordings", """
with r as (select l_partkey as recording_id, 'fp' || (l_suppkey % 23) as fp, l_quantity, l_orderkey,
    cast(l_shipdate as date) as d, l_linenumber, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ordinal from lineitem),
f as (select recording_id, fp, min(ordinal) as ordinal from r group by all),
g as (select recording_id, list(fp order by ordinal) as ids from f group by all),
j as (select recording_id, list_reduce(ids[2:], lambda acc, x: case when contains(acc, x) then acc else acc || ', ' || x end, ids[1]) as fingerprint_ids from g)
select recording_id, any_value(fingerprint_ids) as fingerprint_ids, max(l_quantity) as score, count(distinct l_orderkey) as n_releases,
  case when count(distinct l_orderkey) <= 1 then min(cast(d as varchar)) else '' end as date,
  case when count(distinct l_orderkey) <= 1 then min(cast(l_linenumber as varchar)) else '' end as track
from r join j using (recording_id) group by recording_id
""")
def merge_recordings(spark, sf):
    l = table(spark, sf, "lineitem")
    ordinal = F.struct("l_orderkey", *LINE_ORDER)  # ordered by what it holds: no numbering of all rows
    return merge.merge_recordings(l.select(F.col("l_partkey").alias("recording_id"), ordinal.alias("ordinal"), F.concat(F.lit("fp"), (F.col("l_suppkey") % 23).cast("string")).alias("fingerprint_id"), F.col("l_quantity").alias("score"), F.col("l_orderkey").alias("release_id"), F.col("l_shipdate").cast("date").cast("string").alias("date"), F.col("l_linenumber").cast("string").alias("track")))


@query("set_difference_fill", """
with c as (select distinct l_orderkey as release, l_linenumber as pos, l_suppkey as stream from lineitem),
cat as (select o_orderkey as release, p as pos from orders, (select unnest([1, 2, 3, 4]) as p)),
st as (select o_orderkey as release, s as stream from orders, (select unnest([1, 2, 3]) as s)),
ot as (select * from cat where not exists (select 1 from c where c.release = cat.release and c.pos = cat.pos)),
os as (select * from st where not exists (select 1 from c where c.release = st.release and c.stream = st.stream))
select release as release_id, cast(pos as int) as track_pos, cast(stream as bigint) as stream_index, false as filled from c
union all select ot.release, cast(pos as int), cast(stream as bigint), true from ot join os using (release)
""")
def set_difference_fill(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    c = l.select(F.col("l_orderkey").alias("lookup"), F.col("l_orderkey").alias("release_id"), F.lit(1).alias("medium_pos"), F.col("l_linenumber").alias("track_pos"), F.col("l_suppkey").alias("stream_index"), F.lit("r").alias("recording_id")).distinct()
    catalogue = o.select(F.col("o_orderkey").alias("lookup"), F.col("o_orderkey").alias("release_id"), F.lit(1).alias("medium_pos"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("track_pos"))
    streams = o.select(F.col("o_orderkey").alias("lookup"), F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))).alias("stream_index"))
    out = discs.complete(c, catalogue, streams)
    return out.select("release_id", "track_pos", "stream_index", F.col("recording_id").isNull().alias("filled"))


@query("common_to_all", """
select l_partkey % 50 as item from lineitem group by 1 having count(distinct l_suppkey % 10) = (select count(distinct l_suppkey % 10) from lineitem)
""")
def common_to_all(spark, sf):
    return merge.common_to_all(table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("item"), (F.col("l_suppkey") % 10).alias("holder")), "item", "holder")


@query("union_offsets", """
with f as (select l_suppkey as disc_id, l_partkey % 100 as stream_index, l_linenumber as "offset" from lineitem)
select distinct a.stream_index, b."offset" from (select distinct disc_id, stream_index from f) a join (select distinct disc_id, "offset" from f) b using (disc_id)
""")
def union_offsets(spark, sf):
    return discs.disc_offsets_union(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("disc_id"), (F.col("l_partkey") % 100).alias("stream_index"), F.col("l_linenumber").alias("offset")))


@query("erase_elements", """
select o_orderkey, o_orderstatus from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0)
""")
def erase_elements(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.erase(table(spark, sf, "orders"), gone, ["o_custkey"]).select("o_orderkey", "o_orderstatus")


@query("add_or_find", """
select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n = 1
""")
def add_or_find(spark, sf):
    return merge.add_or_find(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("result_summary", """
select l_suppkey % 50 as release_group_id, l_orderkey as release_id, count(distinct l_linenumber) as n_media,
  count(distinct (l_linenumber, l_partkey % 20)) as n_tracks, count(distinct l_partkey) as n_streams from lineitem group by 1, 2
""")
def result_summary(spark, sf):
    return merge.summary(table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("release_group_id"), F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("medium_pos"), (F.col("l_partkey") % 20).alias("track_pos"), F.col("l_partkey").alias("stream_index")))


# -- votes --------------------------------------------------------------------------------------------------------------------------

VOTES = """
v as (select l_orderkey as disc_id, l_linenumber as track_pos, l_partkey % 11 as crc, cast(l_quantity as int) as confidence from lineitem),
c as (select distinct l_orderkey as disc_id, l_linenumber as track_pos, o as "offset", l_suppkey % 11 as v1, (l_suppkey + o) % 11 as v2
  from lineitem, (select unnest([0, 1, 2]) as o))"""


def _votes(spark, sf) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf, "lineitem")
    v = l.select(F.col("l_orderkey").alias("disc_id"), F.col("l_linenumber").alias("track_pos"), (F.col("l_partkey") % 11).alias("crc"), F.col("l_quantity").cast("int").alias("confidence"))
    o = F.explode(F.array(*map(F.lit, (0, 1, 2))))
    c = l.select(F.col("l_orderkey").alias("disc_id"), F.col("l_linenumber").alias("track_pos"), "l_suppkey").repartition("disc_id", "track_pos").withColumn("offset", o)  # before each line is three, and where its votes are
    return c.select("disc_id", "track_pos", "offset", (F.col("l_suppkey") % 11).alias("v1"), ((F.col("l_suppkey") + F.col("offset")) % 11).alias("v2")).distinct(), v


@query("vote_aggregate", "with" + VOTES + """
select c.disc_id, c.track_pos, "offset", v1, v2, cast(sum(case when v1 = crc then confidence else 0 end) as bigint) as conf_v1,
  cast(sum(case when v2 = crc then confidence else 0 end) as bigint) as conf_v2, cast(sum(confidence) as bigint) as total, max(confidence) as max
from c join v on c.disc_id = v.disc_id and c.track_pos = v.track_pos group by all
""")
def vote_aggregate(spark, sf):
    c, v = _votes(spark, sf)
    # a line number may stand twice in an order: the checksums are part of the track's key here
    k = ["disc_id", "track_pos"]
    return votes.vote_aggregate(c.withColumn("offset", F.struct("offset", "v1", "v2")), v, k).select(*k, "offset.*", "conf_v1", "conf_v2", "total", "max")


@query("vote_aggregate_exclusive", "with" + VOTES + """
select c.disc_id, c.track_pos, "offset", v1, v2, cast(sum(case when v1 = crc then confidence else 0 end) as bigint) as conf_v1,
  cast(sum(case when v1 <> crc and v2 = crc then confidence else 0 end) as bigint) as conf_v2
from c join v on c.disc_id = v.disc_id and c.track_pos = v.track_pos group by all
""")
def vote_aggregate_exclusive(spark, sf):
    c, v = _votes(spark, sf)
    return votes.vote_aggregate_exclusive(c.withColumn("offset", F.struct("offset", "v1", "v2")), v).select("disc_id", "track_pos", "offset.*", "conf_v1", "conf_v2")


@query("eac_vote_aggregate", "with" + VOTES + """
select c.disc_id, c.track_pos, "offset", v1, v2, cast(sum(case when v1 = crc then confidence else 0 end) as bigint) as conf_eac, cast(sum(confidence) as bigint) as total, max(confidence) as max
from c join v on c.disc_id = v.disc_id and c.track_pos = v.track_pos group by all
""")
def eac_vote_aggregate(spark, sf):
    c, v = _votes(spark, sf)
    c = c.select("disc_id", "track_pos", F.struct("offset", "v1", "v2").alias("offset"), F.col("v1").alias("crc32"))
    out = votes.eac_vote_aggregate(c, v.select("disc_id", "track_pos", F.col("crc").alias("crc32"), F.col("confidence").alias("count")))
    return out.select("disc_id", "track_pos", "offset.*", "conf_eac", "total", "max")


@query("release_confidence", """
with s as (select l_orderkey, l_suppkey, max(cast(l_quantity as bigint) + l_linenumber) as c from lineitem group by all)
select l_orderkey, min(c) as confidence_min from s group by l_orderkey
""")
def release_confidence(spark, sf):
    v = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("stream_index"), F.col("l_quantity").cast("long").alias("conf_v1"), F.col("l_linenumber").alias("conf_v2"))
    return votes.release_confidence(v, ["l_orderkey"])


@query("release_score", """
select release_id, sum(s) as score from (select l_orderkey as release_id, l_suppkey, max(l_quantity) as s from lineitem group by all) group by all
""")
def release_score(spark, sf):
    return votes.release_score(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("stream_index"), F.col("l_quantity").alias("score")))


@query("neighbour_join", """
with f as (select conv_id, turn, min(length(text)) as n from conversations group by all)
select c.conv_id, c.turn, c.n, b.n as before, a.n as after from (select conv_id, turn, length(text) as n from conversations) c
left join f b on b.conv_id = c.conv_id and b.turn = c.turn - 1 left join f a on a.conv_id = c.conv_id and a.turn = c.turn + 1
""")
def neighbour_join(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("n"))
    return votes.neighbours(c, "conv_id", "turn", "n")


@query("offsets_at_neighbours", """
with r as (select distinct l_orderkey as disc_id, l_linenumber as track_pos, l_suppkey % 4 as "offset" from lineitem), t as (select distinct disc_id, track_pos from r)
select * from r where not exists (select 1 from t where t.disc_id = r.disc_id and abs(t.track_pos - r.track_pos) = 1
  and not exists (select 1 from r k where k.disc_id = t.disc_id and k.track_pos = t.track_pos and k."offset" = r."offset"))
""")
def offsets_at_neighbours(spark, sf):
    return votes.offsets_at_neighbours(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("disc_id"), F.col("l_linenumber").alias("track_pos"), (F.col("l_suppkey") % 4).alias("offset")).distinct())


# -- discs --------------------------------------------------------------------------------------------------------------------------

@query("disc_ids", f"""
with l as ({LINES}), o as (select l_orderkey as disc_id, pos, sum(cast(l_quantity as bigint) * 300) over (partition by l_orderkey order by pos rows unbounded preceding) - cast(l_quantity as bigint) * 300 as o from l),
e as (select l_orderkey as disc_id, sum(cast(l_quantity as bigint) * 300) as leadout, count(*) as n from lineitem group by all),
s as (select disc_id, sum(o) as s1, sum(case when o = 0 then 1 else o end * pos) as s2, min_by(o, pos) as first,
  sum(list_sum(list_transform(string_split(cast(o // 75 + 2 as varchar), ''), lambda x: cast(x as int)))) as digits from o group by all)
select disc_id, n as n_tracks, cast((s1 + leadout) % {U32} as bigint) as id1, cast((s2 + leadout * (n + 1)) % {U32} as bigint) as id2,
  cast((digits % 255 * 16777216 + (leadout // 75 - first // 75) * 256 + n) % {U32} as bigint) as cddb,
  concat('/accuraterip/', substr(x1, 8, 1), '/', substr(x1, 7, 1), '/', substr(x1, 6, 1), '/dBAR-', lpad(cast(n as varchar), 3, '0'), '-', x1, '-',
    lpad(lower(to_hex(cast((s2 + leadout * (n + 1)) % {U32} as bigint))), 8, '0'), '-',
    lpad(lower(to_hex(cast((digits % 255 * 16777216 + (leadout // 75 - first // 75) * 256 + n) % {U32} as bigint))), 8, '0'), '.bin') as path
from (select *, lpad(lower(to_hex(cast((s1 + leadout) % {U32} as bigint))), 8, '0') as x1 from s join e using (disc_id))
""")
def disc_ids(spark, sf):
    """Orders as discs: a line's length is 300 sectors per unit."""
    l = lines(spark, sf).select(F.col("l_orderkey").alias("disc_id"), F.col("pos").alias("position"), (F.col("l_quantity").cast("long") * 300).alias("n"))
    w = Window.partitionBy("disc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    o = l.select("disc_id", "position", (F.sum("n").over(w) - F.col("n") + 150).alias("offset"))
    return discs.disc_ids(o, l.groupBy("disc_id").agg((F.sum("n") + 150).alias("leadout")))


@query("toc_lengths", """
with o as (select o_custkey as disc_id, row_number() over (partition by o_custkey order by o_orderkey) as p, o_orderkey as "offset" from orders),
k as (select disc_id, case when p % 5 = 0 then p + 1 else p end as position, "offset" from o), d as (select disc_id, position, min("offset") as "offset" from k group by all),
e as (select disc_id, max("offset") + 1000 as leadout, max(position) as last from d group by all), n as (select disc_id, position - 1 as position, "offset" as next from d)
select d.disc_id, d.position, d."offset", coalesce(coalesce(next, case when d.position = last then leadout end) - d."offset", -1) as sectors
from d join e using (disc_id) left join n on n.disc_id = d.disc_id and n.position = d.position
""")
def toc_lengths(spark, sf):
    """Customers as discs with gaps in the positions."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("disc_id"), F.row_number().over(w).cast("long").alias("p"), F.col("o_orderkey").alias("offset"))
    d = o.groupBy("disc_id", F.when(F.col("p") % 5 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("position")).agg(F.min("offset").alias("offset"))
    return discs.track_lengths(d, d.groupBy("disc_id").agg((F.max("offset") + 1000).alias("leadout")))


@query("toc_lengths_lenient", """
with o as (select o_custkey as disc_id, row_number() over (partition by o_custkey order by o_orderkey) as p, o_orderkey as "offset" from orders),
d as (select disc_id, case when p % 5 = 0 then p + 1 else p end as position, min("offset") as "offset" from o group by all),
e as (select disc_id, max("offset") + 1000 as leadout from d group by all)
select d.disc_id, d.position, d."offset", coalesce(n."offset", leadout) - d."offset" as sectors from d join e using (disc_id) left join d n on n.disc_id = d.disc_id and n.position = d.position + 1
""")
def toc_lengths_lenient(spark, sf):
    """As toc_lengths, the lead-out for any missing next track."""
    d = toc_lengths(spark, sf).drop("sectors")
    return discs.track_lengths(d, d.groupBy("disc_id").agg((F.max("offset") + 1000).alias("leadout")), lenient=True)


@query("duration_match", """
with c as (select distinct l_orderkey as release_id, l_linenumber as track_pos, l_suppkey as stream_index, case when l_partkey % 3 > 0 then l_partkey end as recording_id from lineitem),
s as (select release_id, stream_index, min(recording_id) as lo, max(recording_id) as hi from c where recording_id is not null group by all),
x as (select c.*, coalesce(lo <> recording_id or hi <> recording_id or (recording_id is null and lo is not null), false) as elsewhere from c left join s using (release_id, stream_index)),
t as (select distinct l_orderkey as release_id, l_linenumber as track_pos, l_orderkey * 10 + l_partkey % 2 as disc_id, l_suppkey % 5 as sectors from lineitem),
r as (select x.*, disc_id, sectors, (stream_index % 5) = sectors as fits from x join t using (release_id, track_pos)),
bad as (select distinct disc_id from r where not fits and recording_id is not null and not elsewhere)
select distinct disc_id, track_pos, stream_index, recording_id from r where fits and disc_id not in (select disc_id from bad)
""")
def duration_match(spark, sf):
    l = table(spark, sf, "lineitem")
    base = l.select(F.col("l_orderkey").alias("release_id"), F.lit(1).alias("medium_pos"), F.col("l_linenumber").alias("track_pos"), "l_suppkey", "l_partkey")
    c = base.select("release_id", "medium_pos", "track_pos", F.col("l_suppkey").alias("stream_index"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("recording_id")).distinct()
    t = base.select("release_id", "medium_pos", "track_pos", (F.col("release_id") * 10 + F.col("l_partkey") % 2).alias("disc_id"), (F.col("l_suppkey") % 5).alias("sectors")).distinct()
    d = l.select(F.col("l_suppkey").alias("stream_index"), (F.col("l_suppkey") % 5).alias("sectors")).distinct()
    return discs.assign_discs(c, t, d)


@query("remapped_paths", """
select o_orderkey as disc_id, coalesce(r_name, o_orderstatus) as path from orders left join region on r_regionkey = o_orderkey
""")
def remapped_paths(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("disc_id"), F.col("o_orderstatus").alias("path"))
    return discs.remapped(d, table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("disc_id"), F.col("r_name").alias("path")))


@query("response_status", """
select distinct l_partkey as path, case when l_partkey % 5 = 0 then 0 when l_partkey % 5 = 1 then 1 else -1 end as status from lineitem
""")
def response_status(spark, sf):
    """Stored answers exist for three of five paths."""
    asked = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path")).distinct()
    k = F.col("path") % 5
    stored = asked.where(k < 3).withColumn("http", F.when(k == 0, 200).when(k == 1, 404).otherwise(500))
    return discs.responses(asked, stored).select("path", "status")


@query("duration_scalars", """
select o_orderkey, o_custkey * 588 // 44100 as seconds, case when (o_custkey * 147) % 588 = 0 then (o_custkey * 147) // 588 else -1 end as sectors from orders
""")
def duration_scalars(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", exprs.duration_seconds(F.col("o_custkey") * 588).alias("seconds"), exprs.duration_sectors(F.col("o_custkey") * 147).alias("sectors"))


# -- tags ---------------------------------------------------------------------------------------------------------------------------

@query("edit_distance_sum", """
select a.n_regionkey as region, cast(sum(levenshtein(a.n_name, b.n_name)) as bigint) as distance from nation a join nation b on a.n_regionkey = b.n_regionkey group by 1
""")
def edit_distance_sum(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("a")), n.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("b"))
    return a.join(b, "region").groupBy("region").agg(F.sum(exprs.edit_distance(F.col("a"), F.col("b"))).alias("distance"))


@query("metadata_distance", """
select s_nationkey, cast(sum(case when c_name is null then 10000 else levenshtein(s_name, c_name) end) as bigint) as distance
from supplier left join (select c_custkey, c_name from customer where c_custkey % 3 > 0) on s_suppkey = c_custkey group by 1
""")
def metadata_distance(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey", F.col("s_name").alias("title"))
    c = table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"))
    return tags.metadata_distance(s, c, ["k"], ["s_nationkey"], ("title",))


@query("field_diff", """
with a as (select s_suppkey as k, coalesce(s_name, '') as title, coalesce(cast(s_nationkey as varchar), '') as album from supplier),
b as (select c_custkey as k, coalesce(c_name, '') as title, coalesce(cast(c_nationkey as varchar), '') as album from customer)
select k, 'title' as field, a.title as file_value, b.title as database_value from a join b using (k) where a.title <> b.title
union all select k, 'album', a.album, b.album from a join b using (k) where a.album <> b.album
""")
def field_diff(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("album"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.col("c_nationkey").cast("string").alias("album"))
    return tags.field_diff(a, b, ["k"], ("title", "album"))


CREDITS = """select r_name, n_name, case when n_nationkey % 2 = 0 then ' & ' else ', ' end as p, row_number() over w as i, count(*) over (partition by r_name) as c
  from nation join region on n_regionkey = r_regionkey window w as (partition by r_name order by n_nationkey)"""


@query("artist_credit_join", f"""
with n as ({CREDITS})
select r_name as owner_id, string_agg(n_name || p, '' order by i) as artist, string_agg(n_name || case when i < c then '; ' else p end, '' order by i) as sort_artist from n group by 1
""")
def artist_credit_join(spark, sf):
    return tags.artist_credits(_credits(spark, sf))


def _credits(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    phrase = F.when(F.col("n_nationkey") % 2 == 0, " & ").otherwise(", ")
    return n.select(F.col("r_name").alias("owner_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_nationkey").cast("string").alias("artist_id"), F.col("n_name").alias("name"), F.col("n_name").alias("sort_name"), F.lit("").alias("credited_name"), phrase.alias("joinphrase"))


@query("album_artist_join", f"""
with n as ({CREDITS})
select r_name as owner_id, string_agg(n_name || case when i = c or p = ', ' then p when i = c - 1 then ' & ' else ', ' end, '' order by i) as album_artist,
  string_agg(n_name || case when i < c or p = ', ' then '; ' else p end, '' order by i) as sort_album_artist, cast(null as varchar) as compilation from n group by 1
""")
def album_artist_join(spark, sf):
    return tags.album_artists(_credits(spark, sf), various="various")


@query("tag_scalars", """
select p_partkey, coalesce(nullif(case when p_size % 2 = 0 then '' else p_name end, ''), p_type) as title, p_size || '/' || count(*) over (partition by p_brand) as track,
  case when p_brand = p_type then '' else p_type end as sort_artist, coalesce(case when p_size > 25 then '1' end, '0') as compilation from part
""")
def tag_scalars(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", exprs.title(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")), F.col("p_type")).alias("title"), exprs.position_of(F.col("p_size"), F.count("*").over(Window.partitionBy("p_brand"))).alias("track"), exprs.unless_same(F.col("p_type"), F.col("p_brand")).alias("sort_artist"), exprs.compilation(F.when(F.col("p_size") > 25, "1")).alias("compilation"))


@query("tag_record", """
with e as (select user_id, case event_id % 4 when 0 then 'Title' when 1 then 'ARTIST' when 2 then 'x-' || event_type else 'date' end as name, event_type as value from events)
select user_id, cast(null as varchar) as album, cast(null as varchar) as album_artist, max(case when name = 'ARTIST' then value end) as artist, cast(null as varchar) as compilation, cast(null as varchar) as composer,
  max(case when name = 'date' then value end) as date, cast(null as varchar) as disc, cast(null as varchar) as sort_album_artist, cast(null as varchar) as sort_artist, cast(null as varchar) as sort_composer,
  max(case when name = 'Title' then value end) as title, cast(null as varchar) as track, coalesce(list_sort(list_distinct(list(case when name like 'x-%' then name end))), []) as unknown from e group by 1
""")
def tag_record(spark, sf):
    k = F.col("event_id") % 4
    name = F.when(k == 0, "Title").when(k == 1, "ARTIST").when(k == 2, F.concat(F.lit("x-"), "event_type")).otherwise("date")
    return tags.tag_record(table(spark, sf, "events").select("user_id", name.alias("name"), F.col("event_type").alias("value")), "user_id")


@query("distinct_in_order", "select conv_id, role, min(turn) as turn from conversations group by all")
def distinct_in_order(spark, sf):
    return merge.distinct_in_order(table(spark, sf, "conversations"), ["conv_id"], "role", "turn")


@query("composer_greedy", """
with recursive n as (select n_regionkey as r, n_nationkey as k, n_name as name from nation),
f as (select r, string_agg(name, ', ' order by name desc) as reference, count(*) as n from n group by 1),
g as (select r, cast([] as bigint[]) as used, '' as shown, '' as sort, 0 as i from f
  union all select r, used, shown, sort, i from (
    select *, row_number() over (partition by r order by levenshtein(left(reference, len(shown)), shown), k) as place from (
      select g.r, n.k, f.reference, list_append(g.used, n.k) as used, g.shown || case when g.i > 0 then ', ' else '' end || n.name as shown,
        g.sort || case when g.i > 0 then '; ' else '' end || n.name as sort, g.i + 1 as i
      from g join n on n.r = g.r and not list_contains(g.used, n.k) join f on f.r = g.r)) where place = 1)
select g.r as recording_id, shown as composer, case when sort = shown then '' else sort end as sort_composer from g join f on f.r = g.r and g.i = f.n
""")
def composer_greedy(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("recording_id"), F.lit("w").alias("work_id"), F.lit("composer").alias("role"), F.col("n_nationkey").cast("string").alias("artist_id"), F.col("n_name").alias("name"), F.col("n_name").alias("sort_name"), F.lit(False).alias("additional"), F.lit(False).alias("instrumental"), F.col("n_nationkey").alias("ordinal"))
    reference = n.groupBy("recording_id").agg(F.array_join(F.sort_array(F.collect_list("name"), asc=False), ", ").alias("composer"))
    return tags.composers(tags.composers_in_question(n, reference))


# -- search, limits, formats --------------------------------------------------------------------------------------------------------

@query("candidate_rank", """
select l_orderkey, l_linenumber, l_suppkey, l_partkey, row_number() over (partition by l_orderkey order by abs(l_partkey % 7 - 3), l_partkey, l_suppkey, l_linenumber) as place
from (select distinct l_orderkey, l_linenumber, l_suppkey, l_partkey from lineitem)
""")
def candidate_rank(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    return assign.ranked_candidates(l.withColumn("residual", F.col("l_partkey") % 7 - 3).withColumn("s", F.struct("l_partkey", "l_suppkey", "l_linenumber")), ["l_orderkey"], "s").drop("residual", "s")


@query("toc_manhattan", """
with t as (select l_suppkey as disc, l_linenumber as p, sum(cast(l_quantity as bigint)) as sectors from lineitem group by all),
s as (select p_size as candidate, p, p_size * p * 20 as length from (select distinct p_size from part), (select unnest([1, 2, 3, 4, 5, 6, 7]) as p)),
d as (select disc, candidate, sum(abs(sectors - length)) as distance from t join s using (p) group by all)
select disc, min_by(candidate, (distance, candidate)) as candidate, cast(min(distance) as bigint) as distance from d group by 1
""")
def toc_manhattan(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("disc"), F.col("l_linenumber").alias("track_pos")).agg(F.sum(F.col("l_quantity").cast("long")).alias("sectors"))
    p = table(spark, sf, "part").select(F.col("p_size").alias("candidate")).distinct()
    s = p.select("candidate", F.explode(F.array(*map(F.lit, range(1, 8)))).alias("track_pos")).withColumn("length", F.col("candidate") * F.col("track_pos") * 20)
    return assign.nearest_toc_bounded(t, s, ["disc"]).select("disc", "candidate", "distance")


@query("toc_nearest_customers", """
with o as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as p, cast(floor(o_totalprice / 100) as bigint) as sectors from orders),
d as (select o_custkey as disc, p, sectors from o where p <= 3 and o_custkey % 2 = 0), c as (select o_custkey as candidate, p, sectors as length from o where p <= 3 and o_custkey % 2 = 1),
x as (select disc, candidate, sum(abs(sectors - length)) as distance from d join c using (p) group by all)
select disc, min_by(candidate, (distance, candidate)) as candidate, cast(min(distance) as bigint) as distance from x group by 1
""")
def toc_nearest_customers(spark, sf):
    """The first three orders of each customer as a table of contents; for every second customer the nearest of the others."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", F.row_number().over(w).alias("track_pos"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("sectors")).where("track_pos <= 3")
    discs_ = o.where("o_custkey % 2 = 0").withColumnRenamed("o_custkey", "disc")
    return assign.nearest_toc_bounded(discs_, o.where("o_custkey % 2 = 1").select(F.col("o_custkey").alias("candidate"), "track_pos", F.col("sectors").alias("length")), ["disc"]).select("disc", "candidate", "distance")


@query("best_matches", f"""
with m as (select l_orderkey, l_suppkey % 4 as configuration, case when l_tax < 0.02 then 0 else cast(l_quantity as bigint) % 7 end as c from lineitem),
s as (select l_orderkey, configuration, count(*) as n_streams, min(c) as confidence_min, count_if(c <= 0) as unmatched from m group by all)
select * from s where not exists (select 1 from s b where b.l_orderkey = s.l_orderkey and b.n_streams = s.n_streams and (b.confidence_min > s.confidence_min or b.confidence_min = s.confidence_min and b.unmatched < s.unmatched))
""")
def best_matches(spark, sf):
    """Each order's lines in four configurations of different sizes, and those that no other beats."""
    m = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("configuration"), F.col("l_linenumber").alias("stream_index"), F.when(F.col("l_tax") < 0.02, 0).otherwise(F.col("l_quantity").cast("long") % 7).alias("confidence"))
    return assign.best_matches(m, ["l_orderkey"])


@query("configuration_residual", "select l_orderkey, cast(sum(abs(l_partkey % 9 - 4)) as bigint) as residual from lineitem group by 1")
def configuration_residual(spark, sf):
    return assign.total_residual(table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 9 - 4).alias("residual")), ["l_orderkey"])


@query("disc_choices", """
with recursive m as (select l_orderkey as release_id, l_suppkey % 2 as medium, list_sort(list_distinct(list('d' || l_suppkey % 5))) as ids from lineitem group by all),
k as (select *, row_number() over (partition by release_id order by medium) as i, count(*) over (partition by release_id) as n from m),
c as (select release_id, i, n, [d] as discs from k, lateral (select unnest(ids) as d) where i = 1
  union all select c.release_id, k.i, k.n, list_append(c.discs, d) from c join k on k.release_id = c.release_id and k.i = c.i + 1, lateral (select unnest(k.ids) as d))
select release_id, cast(row_number() over (partition by release_id order by discs) - 1 as int) as configuration, discs from c where i = n
""")
def disc_choices(spark, sf):
    return assign.disc_choices(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("release_id"), (F.col("l_suppkey") % 2).alias("medium_pos"), F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string")).alias("disc_id")))


@query("best_assignment", """
with recursive c as (select distinct l_orderkey as release_id, l_linenumber as t, cast(l_suppkey % 8 as int) as s, l_partkey % 2 as residual from lineitem),
k as (select release_id, t, list(s) filter (residual = 0) as options, row_number() over (partition by release_id order by t) as i, count(*) over (partition by release_id) as n from c group by release_id, t),
a as (select k.release_id, i, n, [s] as chosen, [t] as places from k, lateral (select unnest(options) as s) where i = 1
  union all select a.release_id, k.i, k.n, list_append(a.chosen, s), list_append(a.places, t) from a join k on k.release_id = a.release_id and k.i = a.i + 1, lateral (select unnest(k.options) as s) where not list_contains(a.chosen, s)),
b as (select release_id, min(chosen) as chosen, any_value(places) as places from a where i = n group by 1)
select release_id, 1 as medium_pos, cast(unnest(places) as int) as track_pos, unnest(chosen) as stream_index from b
""")
def best_assignment(spark, sf):
    l = table(spark, sf, "lineitem")
    return assign.best_assignment(l.select(F.col("l_orderkey").alias("release_id"), F.lit(1).alias("medium_pos"), F.col("l_linenumber").alias("track_pos"), (F.col("l_suppkey") % 8).cast("int").alias("stream_index"), (F.col("l_partkey") % 2).alias("residual")))


@query("rate_slots", """
with a as (select event_type, event_id, cast(epoch(date_trunc('second', ts)) as bigint) * 1000 as arrival, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)
select event_type, event_id, arrival, cast(max(arrival - i * 60000) over (partition by event_type order by i rows unbounded preceding) + i * 60000 as bigint) as slot from a
""")
def rate_slots(spark, sf):
    """Events as calls of a service that may be called once a minute, in milliseconds."""
    a = table(spark, sf, "events").select("event_type", "event_id", "ts", (F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) * 1000).alias("arrival"))
    return limiter.rate_slots(a, F.lit(60000), "event_type", "arrival", ["ts", "event_id"]).select("event_type", "event_id", "arrival", F.col("slot").cast("long").alias("slot"))


@query("cache_statistics", "select count(*) as lookups, count(*) - count(distinct (user_id, event_type)) as hits from events")
def cache_statistics(spark, sf):
    return limiter.cache_statistics(limiter.cached(table(spark, sf, "events"), ["user_id", "event_type"], "event_id"))


@query("lookup_pages", """
with t as (select o_custkey, count(*) * 7 as total from orders group by 1)
select o_custkey, cast(least(k * 25, total) as bigint) as "offset", cast(least(25, total - least(k * 25, total)) as bigint) as rows from t, lateral (select unnest(generate_series(0::bigint, (total + 24) // 25)) as k)
""")
def lookup_pages(spark, sf):
    return limiter.pages(table(spark, sf, "orders").groupBy("o_custkey").agg((F.count("*") * 7).alias("total")), ["o_custkey"]).select("o_custkey", "offset", "rows")


@query("lookup_retries", """
with a as (select l_orderkey, l_linenumber as attempt, min(case when l_partkey % 2 = 0 then 503 else 200 end) as http from lineitem where l_linenumber <= 5 group by all)
select l_orderkey, coalesce(min(case when http < 500 then attempt end), max(attempt)) as attempts, case when min(http) < 500 then 200 else 503 end as http from a group by 1
""")
def lookup_retries(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("attempt")).agg(F.min(F.when(F.col("l_partkey") % 2 == 0, 503).otherwise(200)).alias("http"))
    return limiter.retries(a, ["l_orderkey"])


@query("request_body", f"""
with r as (select l_orderkey as lookup, pos - 1 as n, l_suppkey, cast(l_quantity as bigint) as d, l_partkey from ({LINES}))
select lookup, string_agg(concat('&duration.', n, '=', d, '&fingerprint.', n, '=', l_partkey), '' order by n) as body, list(l_suppkey order by n) as streams from r group by 1
""")
def request_body(spark, sf):
    l = lines(spark, sf).select(F.col("l_orderkey").alias("lookup"), F.col("pos").alias("ordinal"), F.col("l_suppkey").alias("stream_index"), F.col("l_partkey").cast("string").alias("fingerprint"), F.col("l_quantity").cast("long").alias("duration"))
    return limiter.request_body(l)


@query("original_streams", f"select l_orderkey as lookup, cast(pos as int) as index, l_partkey as answer, l_suppkey as stream_index from ({LINES})")
def original_streams(spark, sf):
    """Answers by place in the request, with the caller's streams."""
    answers = lines(spark, sf).select(F.col("l_orderkey").alias("lookup"), F.col("pos").cast("int").alias("index"), F.col("l_partkey").alias("answer"))
    return limiter.original_streams(answers, request_body(spark, sf)).select("lookup", "index", "answer", "stream_index")


@query("release_media", """
with r as (select l_orderkey as release_id, l_linenumber as medium_pos, count(*) as streams from lineitem group by all),
c as (select o_orderkey as release_id, unnest([1, 2, 3, 4]) as medium_pos, o_custkey % 9 + 1 as n_tracks from orders where o_orderkey % 11 > 0),
d as (select l_orderkey as release_id, l_linenumber as medium_pos, count(distinct l_suppkey) as n_discs from lineitem where l_partkey % 3 = 0 group by all)
select r.*, c.n_tracks, coalesce(n_discs, 0) as n_discs from r left join c using (release_id, medium_pos) left join d using (release_id, medium_pos) where release_id in (select release_id from c)
""")
def release_media(spark, sf):
    """Responses, catalogue and discs written bucketed by release, and joined without an exchange."""
    l, n = table(spark, sf, "lineitem"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = l.groupBy(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("medium_pos")).agg(F.count("*").alias("streams"))
    media = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.struct(k.alias("medium_pos"), (F.col("o_custkey") % 9 + 1).alias("n_tracks")))
    c = table(spark, sf, "orders").where("o_orderkey % 11 > 0").select(F.col("o_orderkey").alias("release_id"), media.alias("media"))
    d = l.where("l_partkey % 3 = 0").groupBy(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("medium_pos")).agg(F.count_distinct("l_suppkey").alias("n_discs"))
    d = d.groupBy("release_id").agg(F.collect_list(F.struct("medium_pos", "n_discs")).alias("media"))
    return bucketed.release_media(*(bucketed.bucketed(x, "release_id", n, name) for x, name in ((r, "responses"), (c, "catalogue"), (d, "discs"))))


@query("release_order", """
with r as (select l_orderkey as release_id, min(l_partkey % 5) as distance, max(l_suppkey % 4) as score from lineitem group by 1)
select *, row_number() over (order by distance, score desc, release_id) as place from r
""")
def release_order(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("release_id")).agg(F.min(F.col("l_partkey") % 5).alias("distance"), F.max(F.col("l_suppkey") % 4).alias("score"))
    return merge.numbered_releases(r)


@query("add_elements", "select l_orderkey, l_partkey as element from lineitem union select l_orderkey, l_suppkey from lineitem")
def add_elements(spark, sf):
    l = table(spark, sf, "lineitem")
    return merge.union_distinct(l.select("l_orderkey", F.col("l_partkey").alias("element")), l.select("l_orderkey", F.col("l_suppkey").alias("element")))


_ROLES = ["composer", "writer", "arranger", "lyricist", "translator", "librettist", "performer"]
_COMPOSERS = f"""
rel as (select p_partkey as r, k, {_ROLES}[(p_size + k) % 7 + 1] as role, 'a' || (p_partkey * (k + 1)) % 4 as artist, p_brand || ' ' || (p_partkey * (k + 1)) % 4 as name, (p_partkey * (k + 1)) % 4 || ', ' || p_brand as sort_name,
  k = 4 as additional, p_size % 2 = 0 as instrumental, p_brand || ' 3, ' || p_brand || ' 1' as reference from part, (select unnest(range(6)) as k)),
c as (select r, artist, name, sort_name, k, reference from rel where role <> 'performer' and (not (role in ('arranger', 'translator', 'librettist') or additional or (instrumental and role = 'lyricist')) or contains(reference, name))
  qualify row_number() over (partition by r, artist order by k, role) = 1)"""
_GREEDY = """
n as (select r, row_number() over (partition by r order by k, artist) as k, name, sort_name, reference from c), f as (select r, count(*) as n from n group by 1),
g as (select r, cast([] as bigint[]) as used, '' as shown, '' as sort, 0 as i from f
  union all select r, used, shown, sort, i from (select *, row_number() over (partition by r order by levenshtein(left(reference, len(shown)), shown), k) as place from (
    select g.r, n.k, n.reference, list_append(g.used, n.k) as used, g.shown || case when g.i > 0 then ', ' else '' end || n.name as shown, g.sort || case when g.i > 0 then '; ' else '' end || n.sort_name as sort, g.i + 1 as i
    from g join n on n.r = g.r and not list_contains(g.used, n.k))) where place = 1),
composers as (select g.r as recording_id, shown as composer, case when sort = shown then '' else sort end as sort_composer from g join f on f.r = g.r and g.i = f.n)"""


def _relations(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    a = (F.col("p_partkey") * (F.col("k") + 1) % 4).cast("string")
    role = F.element_at(F.lit(_ROLES), (F.col("p_size") + F.col("k")) % 7 + 1)
    rel = p.select(F.col("p_partkey").alias("recording_id"), F.lit("w").alias("work_id"), role.alias("role"), F.concat(F.lit("a"), a).alias("artist_id"), F.concat("p_brand", F.lit(" "), a).alias("name"), F.concat(a, F.lit(", "), "p_brand").alias("sort_name"), (F.col("k") == 4).alias("additional"), (F.col("p_size") % 2 == 0).alias("instrumental"), F.col("k").alias("ordinal"))
    return rel, table(spark, sf, "part").select(F.col("p_partkey").alias("recording_id"), F.concat("p_brand", F.lit(" 3, "), "p_brand", F.lit(" 1")).alias("composer"))


@query("composer_roles", f"with {_COMPOSERS} select r as recording_id, artist as artist_id, name, sort_name, cast(k as int) as ordinal, reference from c")
def composer_roles(spark, sf):
    """Credits of seven roles, artists several times; optional ones only where the file names them."""
    return tags.composers_in_question(*_relations(spark, sf))


@query("tag_mapping", f"""
with recursive {_COMPOSERS}, {_GREEDY},
l as ({LINES}), k as (select l_orderkey as release_id, l_linenumber % 2 + 1 as medium_pos, cast(pos as int) as track_pos, l_partkey % 3 as recording_id, 'T' || l_suppkey as title from l),
m as (select cast(pos as int) as stream_index, l_orderkey as release_id, case when l_tax > 0.03 then l_partkey % 3 end as recording_id, l_linenumber % 2 + 1 as medium_pos, cast(pos + case when l_discount > 0.06 then 1 else 0 end as int) as track_pos, l_partkey from l),
a as (select *, 1 as there from k qualify row_number() over (partition by release_id, recording_id order by medium_pos desc, track_pos desc, title desc) = 1),
b as (select *, 1 as there from k qualify row_number() over (partition by release_id, medium_pos, track_pos order by title desc) = 1),
t as (select m.*, case when a.there = 1 then a.medium_pos else b.medium_pos end as at_medium, case when a.there = 1 then a.track_pos else b.track_pos end as at_track, case when a.there = 1 then a.title else b.title end as track_title,
    (select count(*) from k where k.release_id = m.release_id) as n_tracks
  from m left join a on a.release_id = m.release_id and a.recording_id = m.recording_id left join b on b.release_id = m.release_id and b.medium_pos = m.medium_pos and b.track_pos = m.track_pos)
select release_id, stream_index, 'Order ' || release_id as album, 'A' || release_id % 7 as album_artist, 'R' || l_partkey % 3 as artist, case when release_id % 3 = 0 then '1' else '0' end as compilation, composer, case when release_id % 2 = 0 then '2001' end as date,
  at_medium || '/2' as disc, case when 'A' || release_id % 5 = 'A' || release_id % 7 then '' else 'A' || release_id % 5 end as sort_album_artist, '' as sort_artist, coalesce(sort_composer, '') as sort_composer, coalesce(track_title, 'Recording') as title, at_track || '/' || n_tracks as track
from t left join composers c on c.recording_id = t.l_partkey
""")
def tag_mapping(spark, sf):
    """Matches with the catalogue's tracks, by recording or by place, and the tag record that comes of them, composers of several roles included."""
    l = lines(spark, sf).withColumn("pos", F.col("pos").cast("int"))
    place = [F.col("l_orderkey").alias("release_id"), (F.col("l_linenumber") % 2 + 1).alias("medium_pos")]
    catalogue = l.select(*place, F.col("pos").alias("track_pos"), (F.col("l_partkey") % 3).alias("recording_id"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("title"))
    moved = F.when(F.col("l_discount") > 0.06, 1).otherwise(0)
    found = l.select(F.col("pos").alias("stream_index"), *place, F.when(F.col("l_tax") > 0.03, F.col("l_partkey") % 3).alias("recording_id"), (F.col("pos") + moved).alias("track_pos"), "l_partkey")
    names = tags.composers(tags.composers_in_question(*_relations(spark, sf))).withColumnRenamed("recording_id", "l_partkey")
    sizes = catalogue.groupBy("release_id").agg(F.count("*").alias("n_tracks"))
    rows = tags.recording_tracks(found, catalogue).join(sizes, "release_id").join(names, "l_partkey", "left")
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    release = F.col("release_id")
    rows = rows.select(F.struct("release_id", "stream_index").alias("stream_index"), named("Order ", release).alias("album"), named("A", release % 7).alias("album_artist"), named("A", release % 5).alias("sort_album_artist"), named("R", F.col("l_partkey") % 3).alias("artist"), named("R", F.col("l_partkey") % 3).alias("sort_artist"), F.when(release % 3 == 0, "1").alias("compilation"), "composer", "sort_composer",
        F.when(release % 2 == 0, "2001").alias("date"), F.col("t.medium_pos").alias("medium_pos"), F.lit(2).alias("n_media"), F.col("t.track_pos").alias("track_pos"), "n_tracks", F.col("t.title").alias("track_title"), F.lit("Recording").alias("recording_title"))
    return tags.tag_values(rows).select("stream_index.*", *TAG_FIELDS)


def _element(name: str, *inner) -> Column:
    return F.concat(F.lit(f"<{name}>"), *(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in inner), F.lit(f"</{name}>"))


def _responses(rows: DataFrame, of: str, results: Column) -> DataFrame:
    """(lookup, body): one response per value of `of`, with a fingerprint for each row."""
    one = _element("fingerprint", _element("index", F.col("l_linenumber")), _element("results", results))
    r = rows.groupBy(F.col(of).alias("lookup")).agg(F.array_join(F.collect_list(one), "").alias("f"))
    return r.select("lookup", _element("response", _element("status", "ok"), _element("fingerprints", F.col("f"))).alias("body"))


@query("xml_flatten", """
select l_orderkey as lookup, l_linenumber as index, 'f' || l_partkey as fingerprint_id, 'r' || l_suppkey as recording_id, 'g' || l_suppkey % 7 as release_group_id, 'l' || l_partkey % 9 as release_id,
  1 as medium_pos, l_linenumber as track_pos, max(cast(l_discount as float)) as score from lineitem group by all
""")
def xml_flatten(spark, sf):
    """Lines written as lookup responses, one per order, and read back."""
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    medium = _element("medium", _element("position", "1"), _element("tracks", _element("track", _element("position", F.col("l_linenumber")))))
    release = _element("release", _element("id", named("l", F.col("l_partkey") % 9)), _element("mediums", medium))
    group = _element("releasegroup", _element("id", named("g", F.col("l_suppkey") % 7)), _element("releases", release))
    recording = _element("recording", _element("id", named("r", F.col("l_suppkey"))), _element("releasegroups", group))
    result = _element("result", _element("id", named("f", F.col("l_partkey"))), _element("score", F.col("l_discount")), _element("recordings", recording))
    return lookup_xml.matches(_responses(table(spark, sf, "lineitem"), "l_orderkey", result), ["lookup"])


@query("lookup_descriptions", f"""
with l as ({LINES}), t as (select *, pos as p, unnest(case when l_suppkey % 3 = 0 then [0] else [0, 1] end) as k from l where l_partkey % 10 > 0)
select l_orderkey as lookup, l_linenumber as index, 'f' || l_partkey as fingerprint_id, cast(l_discount as float) as score, 'r' || l_suppkey as recording_id, case when k = 0 then l_returnflag || ' & <' || p || '>' end as title,
  case when l_suppkey % 2 = 0 then l_linestatus || ' feat. ' || l_returnflag else l_linestatus || ' feat. ' end as artist, 'l' || l_partkey % 9 as release_id, null::varchar as release_title, null::varchar as date,
  (k + p)::varchar as track, case when l_suppkey % 5 > 0 then 'Disc ' || l_linenumber end as album, l_linenumber || '/?' as disc, (k + p)::varchar || '/' || case when l_partkey % 4 > 0 then (l_partkey % 40)::varchar else '?' end as place
from t
""")
def lookup_descriptions(spark, sf):
    """Lines written as descriptive lookup responses, with elements in changing order, names with markup, and parts missing here and there; read back."""
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    some = lambda when, x: F.when(when, x).otherwise("")
    l = lines(spark, sf)
    artist = lambda name, *more: _element("artist", _element("id", "ignored"), *more, _element("name", F.col(name)))
    artists = _element("artists", artist("l_linestatus", _element("joinphrase", " feat. ")), some(F.col("l_suppkey") % 2 == 0, artist("l_returnflag")))
    title = _element("title", F.concat("l_returnflag", F.lit(" &amp; &lt;"), F.col("pos").cast("string"), F.lit("&gt;")))
    one = _element("track", title, _element("id", "ignored"), _element("position", F.col("pos")), artists)
    other = _element("track", artists, _element("position", F.col("pos") + 1))
    tracks = _element("tracks", one, some(F.col("l_suppkey") % 3 != 0, other))
    medium = _element("medium", some(F.col("l_partkey") % 4 > 0, _element("track_count", F.col("l_partkey") % 40)), tracks, _element("format", "CD"), _element("position", F.col("l_linenumber")), some(F.col("l_suppkey") % 5 > 0, _element("title", named("Disc ", F.col("l_linenumber")))))
    release = _element("release", _element("mediums", medium), _element("id", named("l", F.col("l_partkey") % 9)))
    recordings = some(F.col("l_partkey") % 10 > 0, _element("recordings", _element("recording", _element("releases", release), _element("id", named("r", F.col("l_suppkey"))))))
    result = _element("result", recordings, _element("score", F.col("l_discount")), _element("id", named("f", F.col("l_partkey"))))
    return lookup_xml.descriptions(_responses(l, "l_orderkey", result), ["lookup"])


@query("binary_decode", f"""
select l_orderkey as path, 0 as entry, l_orderkey as id1, 2 as id2, 3 as cddb, cast(pos as int) as track_pos, cast(l_quantity as int) as confidence, l_partkey as crc, l_suppkey as offset_crc from ({LINES})
""")
def binary_decode(spark, sf):
    """Lines written as responses of the rip database, one per order, and decoded."""
    return binary.decode_rip(_rip_responses(spark, sf)).select("path", "entry", "id1", F.col("id2").cast("int").alias("id2"), F.col("cddb").cast("int").alias("cddb"), "track_pos", "confidence", "crc", "offset_crc")


def _rip_responses(spark, sf) -> DataFrame:
    octet = lambda c: F.lpad(F.hex(c.cast("int")), 2, "0")
    chunk = F.concat(octet(F.col("l_quantity")), exprs.le32(F.col("l_partkey")), exprs.le32(F.col("l_suppkey")))
    r = lines(spark, sf).groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", chunk.alias("h")))), lambda x: x["h"]), "").alias("h"))
    return r.select("path", F.unhex(F.concat(octet(F.col("n")), exprs.le32(F.col("path")), exprs.le32(F.lit(2)), exprs.le32(F.lit(3)), "h")).alias("content"))


@query("binary_decode_native", f"""
select l_orderkey as path, 0 as entry, l_orderkey as id1, 2::bigint as id2, 3::bigint as cddb, cast(pos as int) as track_pos, cast(l_quantity as int) as confidence, l_partkey as crc, l_suppkey as offset_crc from ({LINES})
""")
def binary_decode_native(spark, sf):
    return binary.rip_rows_native(_rip_responses(spark, sf))


# -- operators that only programs used so far ------------------------------------------------------------------------------------


@query("eac_paths", """
with o as (select o_orderkey, upper(sha1(cast(o_orderkey as varchar))) as h, 1 + o_orderkey % 20 as n from orders)
select o_orderkey, concat('/crc/', h[1], '/', h[2], '/', h[3], '/', h[4], '/', h, '-', n, '.bin') as eac_path from o
""")
def eac_paths(spark, sf):
    key = F.base64(F.unhex(F.sha1(F.col("o_orderkey").cast("string"))))
    d = table(spark, sf, "orders").select("o_orderkey", F.translate(key, "+/=", "._-").alias("disc_id"), (1 + F.col("o_orderkey") % 20).alias("n_tracks"))
    return discs.eac_paths(d).select("o_orderkey", "eac_path")


#: Fixed values of the second database's format, lists of ten tracks at most here.
_EAC_SQL = f"""
with l as (select *, count(*) over (partition by l_orderkey) as n from ({LINES}))
select l_orderkey as path, cast(pos as int) as track, kind, 0 as k, cast(case kind when 'whole' then l_partkey else l_suppkey end as bigint) as crc,
  cast(l_quantity as bigint) as confidence, l_orderkey as date from l, (values ('whole'), ('part')) v(kind)
"""


@query("eac_decode", _EAC_SQL)
def eac_decode(spark, sf):
    """Lines written as files of the second database, one per order, a checksum for each track, and decoded."""
    word = exprs.le32
    entry = lambda c: F.concat(word(F.lit(1)), word(c), word(F.col("l_quantity").cast("long")), word(F.col("l_orderkey")))
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("path"), "pos", entry(F.col("l_partkey")).alias("w"), entry(F.col("l_suppkey")).alias("p"))
    r = rows.groupBy("path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "w", "p"))).alias("x"))
    # track 0 is empty in both sections
    section = lambda magic, f: F.concat(word(F.lit(magic)), word(F.lit(0)), F.array_join(F.transform("x", lambda y: y[f]), ""))
    whole, part, *end = binary.EAC_MAGICS
    text = F.concat(word(F.col("n")), word(F.col("path")), section(whole, "w"), section(part, "p"), *(word(F.lit(m)) for m in end))
    out = binary.decode_eac(r.select("path", F.unhex(text).alias("content")))
    return out.select("path", F.col("track_pos").alias("track"), "kind", F.col("ordinal").alias("k"), F.col("crc32").alias("crc"), F.col("count").alias("confidence"), "date")


def _files_read(spark, rows: DataFrame, format_: str) -> DataFrame:
    """rows written as files and read by two scans, whose filters choose the files; path is the file's name again."""
    response_files.register(spark)
    folder = f"{shared_dir(spark)}/{format_}-{uuid.uuid4().hex}"
    rows.write.format(format_).mode("append").save(folder)
    some = lambda part: response_files.pushing(spark, format_, folder).where(F.col("path").contains(part))
    return some("/even-").unionByName(some("/odd-")).withColumn("path", F.substring_index("path", "/", -1))


@query("rip_files", f"""
select case when l_orderkey % 2 = 0 then 'even-' else 'odd-' end || l_orderkey % 40 || '.bin' as path, cast(dense_rank() over (partition by l_orderkey % 40 order by l_orderkey) - 1 as int) as entry, l_orderkey as id1, l_orderkey % 7 as id2,
  5 as cddb, cast(pos as int) as track_pos, cast(l_quantity as int) as confidence, l_partkey as crc, l_suppkey as offset_crc from ({LINES})
""")
def rip_files(spark, sf):
    """Lines written as forty files of the rip database, an entry per order, and read back by the data source."""
    name = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "even-").otherwise("odd-"), (F.col("l_orderkey") % 40).cast("string"), F.lit(".bin"))
    rows = lines(spark, sf).select(name.alias("path"), F.lit(0).alias("entry"), F.col("l_orderkey").alias("id1"), (F.col("l_orderkey") % 7).alias("id2"), F.lit(5).cast("long").alias("cddb"), F.col("pos").cast("int").alias("track_pos"), F.col("l_quantity").cast("int").alias("confidence"), F.col("l_partkey").alias("crc"), F.col("l_suppkey").alias("offset_crc"))
    return _files_read(spark, rows.repartition("path").sortWithinPartitions("path", "id1", "track_pos"), "rip_responses").withColumn("cddb", F.col("cddb").cast("int"))


@query("eac_files", f"""
with l as ({LINES}), t as (select case when l_suppkey % 2 = 0 then 'even-' else 'odd-' end || l_suppkey || '.bin' as path, l_linenumber as track_pos, kind, l_suppkey as s, l_orderkey, pos, case kind when 'whole' then l_partkey else l_orderkey end as crc32, cast(l_quantity as bigint) as count,
  l_orderkey as date from l, (values ('whole'), ('part')) v(kind))
select path, track_pos, kind, cast(row_number() over (partition by s, track_pos, kind order by l_orderkey, pos) - 1 as int) as ordinal, crc32, count, date from t
""")
def eac_files(spark, sf):
    """Lines written as files of the second database, one per supplier, and read back by the data source."""
    name = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "even-").otherwise("odd-"), F.col("l_suppkey").cast("string"), F.lit(".bin"))
    one = lines(spark, sf).withColumn("kind", F.explode(F.array(F.lit("whole"), F.lit("part"))))
    place = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber", "kind").orderBy("l_orderkey", "pos")) - 1
    crc = F.when(F.col("kind") == "whole", F.col("l_partkey")).otherwise(F.col("l_orderkey"))
    rows = one.select(name.alias("path"), F.col("l_linenumber").alias("track_pos"), "kind", place.cast("int").alias("ordinal"), crc.alias("crc32"), F.col("l_quantity").cast("long").alias("count"), F.col("l_orderkey").alias("date"))
    return _files_read(spark, rows.repartition("path").sortWithinPartitions("path"), "eac_responses")


@query("stream_ends", f"""
with s as ({SAMPLES}), n as (select user_id, count(*) as n from s group by 1)
select user_id, j, s from s join n using (user_id) where j <= 5 or j > n - 5
""")
def stream_ends(spark, sf):
    s = event_samples(spark, sf)
    return checksum.ends(s, s.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], keep=5).select("user_id", "j", "s")


@query("known_recordings", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size > 25)")
def known_recordings(spark, sf):
    known = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return cover.known_only(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, "l_partkey")


@query("valid_matches", f"""
select l_orderkey, pos, coalesce(l_linenumber between 1 and 5 and l_suppkey % 3 >= 1 and l_linenumber >= 1 and l_tax * 15 between 0 and 1, false) as valid from ({LINES})
""")
def valid_matches(spark, sf):
    m = lines(spark, sf).select("l_orderkey", "pos", F.col("l_linenumber").alias("stream_index"), (F.col("l_suppkey") % 3).alias("medium_pos"), (F.col("l_linenumber") - 1).alias("track_pos"), (F.col("l_tax") * 15).alias("score"))
    good, bad = cover.validated(m, 5)
    return good.select("l_orderkey", "pos", F.lit(True).alias("valid")).unionByName(bad.select("l_orderkey", "pos", F.lit(False).alias("valid")))


@query("nonzero_votes", """
with v as (select l_partkey as stream_index, l_suppkey as disc_id, l_linenumber as track_pos, case when l_quantity > 40 then 1 else 0 end as c from lineitem),
t as (select stream_index, disc_id, track_pos, max(c) as best from v group by all)
select stream_index, disc_id, track_pos, best = 0 as bad_rip from t
""")
def nonzero_votes(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("stream_index"), F.col("l_suppkey").alias("disc_id"), F.col("l_linenumber").alias("track_pos"), F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("conf_v1"), F.lit(0).alias("conf_v2"))
    keys = ["stream_index", "disc_id", "track_pos"]
    got, none = votes.with_votes(v, keys)
    return got.select(*keys).distinct().withColumn("bad_rip", F.lit(False)).unionByName(none.select(*keys).withColumn("bad_rip", F.lit(True)))


@query("stream_permutation", f"select l_orderkey, n + 1 - pos as stream_index, l_partkey from (select *, max(pos) over (partition by l_orderkey) as n from ({LINES}))")
def stream_permutation(spark, sf):
    """Each order's lines backwards: one permutation an order, as long as the order."""
    l = lines(spark, sf).select("l_orderkey", F.col("pos").cast("int").alias("stream_index"), "l_partkey")
    order = l.groupBy("l_orderkey").agg(F.max("stream_index").alias("n")).select("l_orderkey", F.posexplode(F.sequence(F.col("n"), F.lit(1), F.lit(-1))).alias("old", "new"))
    return merge.permute(l, order.withColumn("old", F.col("old") + 1), keys=["l_orderkey"]).select("l_orderkey", F.col("stream_index").cast("long").alias("stream_index"), "l_partkey")


@query("group_order", """
with g as (select o_custkey as release_group_id, min(o_totalprice) as distance from orders group by 1)
select release_group_id, distance, row_number() over (order by distance, release_group_id) as place from g
""")
def group_order(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("release_group_id"), F.col("o_totalprice").alias("distance"))
    return merge.numbered_groups(r)


@query("nested_tracks", f"select l_orderkey, count(*) as n_tracks, string_agg(pos || ':' || l_partkey, ',' order by pos) as tracks from ({LINES}) group by 1")
def nested_tracks(spark, sf):
    t = merge.tracks_in_order(lines(spark, sf).select("l_orderkey", F.col("pos").alias("track_pos"), "l_partkey"), ["l_orderkey"])
    return t.select("l_orderkey", F.size("items").cast("long").alias("n_tracks"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["track_pos"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("tracks"))


@query("tree_dump", f"""
with l as (select distinct l_orderkey // 4 as g, l_orderkey as r, l_linenumber % 2 as m, pos as t, l_suppkey as s from ({LINES})),
t as (select g, r, m, t || '=' || string_agg(s, '+' order by s) as x, t from l group by g, r, m, t), m as (select g, r, m || '[' || string_agg(x, ',' order by t) || ']' as x, m from t group by g, r, m),
r as (select g, r || '(' || string_agg(x, ';' order by m) || ')' as x, r from m group by g, r)
select g as release_group_id, string_agg(x, ' ' order by r) as tree from r group by g
""")
def tree_dump(spark, sf):
    """Four orders as a release group, its releases, media, tracks and streams in one row."""
    levels = ["release_group_id", "release_id", "medium_pos", "track_pos", "stream_index"]
    t = merge.tree(lines(spark, sf).select(F.call_function("div", F.col("l_orderkey"), F.lit(4)).alias(levels[0]), F.col("l_orderkey").alias(levels[1]), (F.col("l_linenumber") % 2).alias(levels[2]), F.col("pos").alias(levels[3]), F.col("l_suppkey").alias(levels[4])), levels, table(spark, sf, "lineitem").count())
    text = lambda c: c.cast("string")
    streams = lambda x: F.concat(text(x["track_pos"]), F.lit("="), F.array_join(F.transform(x["items"], lambda s: text(s["stream_index"])), "+"))
    media = lambda x: F.concat(text(x["medium_pos"]), F.lit("["), F.array_join(F.transform(x["items"], streams), ","), F.lit("]"))
    releases = lambda x: F.concat(text(x["release_id"]), F.lit("("), F.array_join(F.transform(x["items"], media), ";"), F.lit(")"))
    return t.select(levels[0], F.array_join(F.transform("items", releases), " ").alias("tree"))


@query("covering_cache", """
with s as (select o_orderstatus as entity, o_custkey as id, o_orderpriority as resource, o_orderkey % 4 = 0 as media, o_orderkey as answer from orders where o_orderkey % 3 = 0)
select o.o_orderkey, min(answer) as answer from orders o join s on entity = o_orderstatus and id = o_custkey and resource = o_orderpriority
where media or o.o_orderkey % 2 = 0 group by 1
""")
def covering_cache(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("entity"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("resource"))
    names = lambda more, *rest: F.when(more, F.array(F.lit("artists"), F.lit("media"), *map(F.lit, rest))).otherwise(F.array(F.lit("artists"), *map(F.lit, rest)))
    stored = o.where("o_orderkey % 3 = 0").withColumn("params", names(F.col("o_orderkey") % 4 == 0)).withColumnRenamed("o_orderkey", "answer")
    return limiter.covering_cache(o.withColumn("params", names(F.col("o_orderkey") % 2 == 1, "limit")), stored).select("o_orderkey", "answer")


_VOTED = "select l_partkey, l_suppkey, max(cast(l_quantity as int) + l_suppkey % 5) as votes from lineitem where l_quantity > 25 group by all"


@query("configuration_choice", f"""
with v as ({_VOTED}), c as (select l_orderkey, pos % 3 as configuration, coalesce(votes, 0) as g, votes is null as missing from ({LINES}) l left join v using (l_partkey, l_suppkey)),
s as (select l_orderkey, configuration, cast(sum(g) as bigint) as score, cast(min(g) as bigint) as confidence_min, cast(count_if(missing) as bigint) as unmatched from c group by all)
select * from s qualify row_number() over (partition by l_orderkey order by confidence_min desc, unmatched, configuration) = 1
""")
def configuration_choice(spark, sf):
    """Each order's lines in three configurations; that of the best votes is chosen, and its lines are kept."""
    l = lines(spark, sf)
    chosen = l.select("l_orderkey", (F.col("pos") % 3).cast("long").alias("configuration"), F.col("l_partkey").alias("disc_id"), F.col("l_suppkey").alias("track_pos"), F.col("l_linenumber").alias("stream_index"))
    v = l.where("l_quantity > 25").select(F.col("l_partkey").alias("disc_id"), F.col("l_suppkey").alias("track_pos"), F.col("l_quantity").cast("int").alias("conf_v1"), (F.col("l_suppkey") % 5).cast("int").alias("conf_v2"))
    best = assign.best_configuration(assign.configuration_score(chosen, v, ["l_orderkey", "configuration"]), ["l_orderkey"])
    kept = assign.apply_choice(chosen, best, ["l_orderkey", "configuration"]).select("l_orderkey", "configuration").distinct()
    return best.join(kept, ["l_orderkey", "configuration"]).select("l_orderkey", "configuration", F.col("score").cast("long").alias("score"), F.col("confidence_min").cast("long").alias("confidence_min"), F.col("unmatched").cast("long").alias("unmatched"))


# -- reports and tags of files ---------------------------------------------------------------------------------------------------


_REPORT = f"""
l as ({LINES}), t as (select distinct l_suppkey as release_group_id, l_orderkey as release_id, l_linenumber as medium_pos, case when l_partkey % 4 > 0 then l_partkey end as disc_id, cast(pos as int) as track_pos,
    cast(l_quantity as int) as stream_index, l_returnflag as fingerprint_id from l union select distinct l_suppkey, l_orderkey, l_linenumber, case when l_partkey % 4 > 0 then l_partkey end, cast(pos as int), cast(l_quantity as int) + cast(l_suppkey % 3 as int), l_linestatus from l),
v as (select l_partkey as disc_id, cast(pos as int) as track_pos, l_suppkey % 5 as "offset", max(cast(case when l_tax > 0.04 then l_quantity else 0 end as bigint)) as conf_v1, max(cast(l_suppkey % 2 as bigint)) as conf_v2, max(l_suppkey % 6) as total, 6 as max
  from l where l_partkey % 3 > 0 group by all),
e as (select l_partkey as disc_id, cast(pos as int) as track_pos, l_suppkey % 7 as "offset", max(case when l_discount > 0.07 then l_linenumber else 0 end)::bigint as conf_eac, max(l_suppkey % 4)::bigint as eac_total, max(l_suppkey % 3)::bigint as eac_max from l where l_partkey % 5 > 1 group by all),
w as (select disc_id, track_pos, "offset", coalesce(conf_v1, 0) as conf_v1, coalesce(conf_v2, 0) as conf_v2, coalesce(conf_eac, 0) as conf_eac from v full join e using (disc_id, track_pos, "offset")),
ts as (select disc_id, track_pos, max(total) as total, max(max) as max from v group by all), te as (select disc_id, track_pos, max(eac_total) as eac_total, max(eac_max) as eac_max from e group by all),
known as (select w.*, coalesce(total, 0) as conf_total, coalesce(max, 0) as conf_max, coalesce(eac_total, 0) as eac_total, coalesce(eac_max, 0) as eac_max from w left join ts using (disc_id, track_pos) left join te using (disc_id, track_pos)),
p as (select release_group_id, release_id, medium_pos, disc_id, track_pos, count(distinct stream_index) as streams, count(distinct fingerprint_id) as prints from t group by all),
o as (select release_group_id, release_id, medium_pos, known.* from p join known on p.disc_id = known.disc_id and p.track_pos = known.track_pos where conf_total > 0 or eac_total > 0),
d as (select l_orderkey as release_id, l_linenumber as medium_pos, cast(pos as int) as track_pos, cast(l_quantity as int) as stream_index, l_returnflag as a, l_linestatus as b from l where l_discount > 0.05),
found as (select distinct release_group_id, release_id, medium_pos, disc_id, null::int as track_pos, 'no_disc' as kind, null::bigint as "offset", null::bigint as conf_v1, null::bigint as conf_v2, null::bigint as conf_total, null::int as conf_max,
  null::bigint as conf_eac, null::bigint as eac_total, null::bigint as eac_max, null::int as stream_index, null::varchar as field, null::varchar as file_value, null::varchar as database_value from p where disc_id is null
union all select release_group_id, release_id, medium_pos, disc_id, track_pos, 'votes', "offset", conf_v1, conf_v2, conf_total, conf_max, conf_eac, eac_total, eac_max, null, null, null, null from o where conf_v1 + conf_v2 + conf_eac > 0
union all select release_group_id, release_id, medium_pos, disc_id, track_pos, 'bad_rip', null, null, null, null, null, null, null, null, null, null, null, null from o group by all having max(conf_v1 + conf_v2 + conf_eac) = 0
union all select release_group_id, release_id, medium_pos, disc_id, track_pos, 'several_streams', null, null, null, null, null, null, null, null, null, null, null, null from p where disc_id is not null and streams > 1
union all select release_group_id, release_id, medium_pos, disc_id, track_pos, 'several_fingerprints', null, null, null, null, null, null, null, null, null, null, null, null from p where disc_id is null and prints > 1
union all select release_group_id, t.release_id, t.medium_pos, disc_id, t.track_pos, 'field', null, null, null, null, null, null, null, null, t.stream_index, 'title', a, b
  from (select distinct release_group_id, release_id, medium_pos, disc_id, track_pos, stream_index from t) t
  join d on d.release_id = t.release_id and d.medium_pos = t.medium_pos and d.track_pos = t.track_pos and d.stream_index = t.stream_index)"""


def _report(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines as tracks, a quarter of them on media without a disc, with votes of two databases that know different tracks, and one differing tag: what mismatch_report takes."""
    l = table(spark, sf, "lineitem")
    buckets = dealing.tasks(spark, l.count())
    # numbered once for the tracks, both databases and the tags, which need less than a line's figures; kept by order, as tracks and tags meet there
    small = [F.col("l_quantity").cast("int").alias("q"), (F.col("l_tax") > 0.04).alias("taxed"), (F.col("l_discount") > 0.05).alias("cheap"), (F.col("l_discount") > 0.07).alias("cheapest")]
    l = l.select("l_orderkey", *LINE_ORDER, "l_returnflag", "l_linestatus", *small).repartition(buckets, "l_orderkey")
    l = l.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("int")).drop("l_extendedprice")
    l = bucketed.bucketed(l, "l_orderkey", buckets, "lines", apart=True)
    place = [F.col("l_suppkey").alias("release_group_id"), F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("medium_pos"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey")).alias("disc_id"), F.col("pos").alias("track_pos")]
    two = [F.struct(F.col("q").alias("stream_index"), F.col("l_returnflag").alias("fingerprint_id")), F.struct((F.col("q") + (F.col("l_suppkey") % 3).cast("int")).alias("stream_index"), F.col("l_linestatus").alias("fingerprint_id"))]
    tracks = l.select(*place, F.explode(F.array(*two)).alias("x")).select(*PLACE, "x.*")
    track = [F.col("l_partkey").alias("disc_id"), F.col("pos").alias("track_pos")]
    voters = lambda known, vote: l.where(known).select(*track, "l_suppkey", vote.cast("long").alias("c")).repartition(buckets, "disc_id", "track_pos")
    by, most = ["disc_id", "track_pos"], lambda n: F.max(F.col("l_suppkey") % n)
    v = voters("l_partkey % 3 > 0", F.when(F.col("taxed"), F.col("q")).otherwise(0)).groupBy(*by, (F.col("l_suppkey") % 5).alias("offset")).agg(F.max("c").alias("conf_v1"), most(2).alias("conf_v2"), most(6).alias("total"), F.lit(6).alias("max"))
    eac = voters("l_partkey % 5 > 1", F.when(F.col("cheapest"), F.col("l_linenumber")).otherwise(0)).groupBy(*by, (F.col("l_suppkey") % 7).alias("offset")).agg(F.max("c").alias("conf_eac"), most(4).alias("total"), most(3).alias("max"))
    d = l.where("cheap").select(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("medium_pos"), F.col("pos").alias("track_pos"), F.col("q").alias("stream_index"), F.lit("title").alias("field"), F.col("l_returnflag").alias("file_value"), F.col("l_linestatus").alias("database_value"))
    return tracks, v, d, eac


@query("mismatch_report", f"with {_REPORT} select * from found")
def mismatch_report(spark, sf):
    return report.mismatch_report(*_report(spark, sf))


@query("report_lines", f"""
with {_REPORT},
h as (select distinct release_group_id as g, release_id as r, medium_pos as m, disc_id as d, track_pos as t from t),
heads as (select distinct g, null::bigint as r, null::int as m, null::bigint as d, null::int as t, 0 as depth, 'release group ' || g as text from h union all select distinct g, r, null, null, null, 1, 'release ' || r from h
  union all select distinct g, r, m, null, null, 2, 'medium ' || m from h union all select distinct g, r, m, d, null, 3, 'disc ' || d from h where d is not null union all select distinct g, r, m, d, t, 4, 'track ' || t from h),
a as (select *, -1 as k, null::bigint as o, null::int as i, null::varchar as f from heads
  union all select release_group_id, release_id, medium_pos, disc_id, track_pos, case kind when 'no_disc' then 3 else 5 end,
    case kind when 'no_disc' then 'no disc fits' when 'bad_rip' then 'bad rip' when 'several_streams' then 'more than one stream' when 'several_fingerprints' then 'more than one fingerprint'
      when 'votes' then 'offset ' || "offset" || ': ' || conf_v1 || '+' || conf_v2 || ' of ' || conf_total || ' (max ' || conf_max || '), ' || conf_eac || ' of ' || eac_total || ' (max ' || eac_max || ')'
      else 'stream ' || stream_index || ': ' || field || ' is ' || file_value || ', not ' || database_value end,
    list_position(['no_disc', 'votes', 'bad_rip', 'several_streams', 'several_fingerprints', 'field'], kind) - 1, "offset", stream_index, field from found)
select row_number() over (order by g nulls first, r nulls first, m nulls first, d nulls first, t nulls first, k, o nulls first, i nulls first, f nulls first, text) as line,
  g as release_group_id, r as release_id, m as medium_pos, d as disc_id, t as track_pos, depth, text from a
""")
def report_lines(spark, sf):
    return report.printed_report(*_report(spark, sf))


@query("configuration_lines", f"""
with c as (select l_orderkey as release_id, l_linenumber % 2 as medium_pos, l_linenumber as track_pos, case when l_suppkey % 3 > 0 then l_suppkey end as s, l_partkey % 9 - 4 as residual from lineitem)
select release_id, medium_pos, track_pos, coalesce(string_agg(s || ' [' || residual || ']', ' ' order by abs(residual), s, residual) filter (s is not null), 'UNASSIGNED') as line from c group by 1, 2, 3
""")
def configuration_lines(spark, sf):
    l = table(spark, sf, "lineitem")
    return report.configuration_lines(l.select(F.col("l_orderkey").alias("release_id"), (F.col("l_linenumber") % 2).alias("medium_pos"), F.col("l_linenumber").alias("track_pos"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("stream_index"), (F.col("l_partkey") % 9 - 4).alias("residual")))


@query("tag_scan", """
select o_orderkey, o_orderstatus || '=é' as title, o_orderpriority as sort_artist, cast(o_custkey as varchar) as track, ['mood'] as unknown from orders
""")
def tag_scan(spark, sf):
    """Orders written as FLAC files with comments, and their tags read back into records."""
    tag = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c.cast("string"), F.lit("")))
    sized = lambda c: F.concat(exprs.le32(F.octet_length(c)), F.hex(c))
    cells = [tag("TITLE", F.concat("o_orderstatus", F.lit("=é"))), tag("ArtistSort", F.col("o_orderpriority")), tag("tracknumber", F.col("o_custkey")), tag("mood", F.col("o_orderstatus"))]
    body = F.concat(sized(F.lit("vendor")), exprs.le32(F.lit(len(cells))), *map(sized, cells))
    head = F.concat(F.lit("84"), F.lpad(F.hex(F.call_function("div", F.length("body"), F.lit(2)).cast("int")), 6, "0"))
    files = table(spark, sf, "orders").withColumn("body", body).select("o_orderkey", F.unhex(F.concat(F.hex(F.lit("fLaC")), head, "body")).alias("content"))
    return tags.tag_record(container_tags.decode_tags(files), "o_orderkey").select("o_orderkey", "title", "sort_artist", "track", "unknown")


def _tag_files(spark, sf, octets) -> DataFrame:
    """Parts as files that hold nothing but tags, the title twice, read back into records."""
    def written_(names: pd.Series, brands: pd.Series, kinds: pd.Series, keys: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([octets([("title", "first"), ("title", n), ("album", f"É {b}"), ("artist", k), ("track", f"{i % 90 + 1}/{s + 90}"), ("compilation", str(i % 2)), ("mood", "calm")]) for n, b, k, i, s in zip(names, brands, kinds, keys, sizes)])

    content = F.pandas_udf(written_, "binary")("p_name", "p_brand", "p_type", "p_partkey", "p_size")
    files = table(spark, sf, "part").select("p_partkey", content.alias("content"))
    return tags.tag_record(container_tags.decode_tags(files), "p_partkey").select("p_partkey", "title", "album", "artist", "track", "compilation", "composer", "unknown")


_TAG_FILES = """
select p_partkey, p_name as title, 'É ' || p_brand as album, p_type as artist, p_partkey % 90 + 1 || '/' || p_size + 90 as track, (p_partkey % 2)::varchar as compilation, null::varchar as composer, ['mood'] as unknown from part
"""


@query("tag_scan_id3", _TAG_FILES)
def tag_scan_id3(spark, sf):
    return _tag_files(spark, sf, container_tags.id3_octets)


@query("tag_scan_ogg", _TAG_FILES)
def tag_scan_ogg(spark, sf):
    return _tag_files(spark, sf, container_tags.ogg_octets)


@query("tag_scan_mp4", _TAG_FILES)
def tag_scan_mp4(spark, sf):
    return _tag_files(spark, sf, container_tags.mp4_octets)
