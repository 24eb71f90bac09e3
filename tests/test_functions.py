import zlib

import pytest
from pyspark.sql import functions as F

from provena import schema
from provena.functions import exprs
from provena.operators import discs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms_stay_exact_at_the_limits(spark):
    l, s = (1 << 31) - 1, (1 << 32) - 1
    p = l * s
    row = spark.createDataFrame([(l, s)], "l long, s long").select(exprs.v1_term(F.col("l"), F.col("s")).alias("a"), exprs.v2_term(F.col("l"), F.col("s")).alias("b")).first()
    assert row["a"] == p % (1 << 32) and row["b"] == (p >> 32) + p % (1 << 32)


@pytest.mark.parametrize("n", [0, 9, 10, 987654321])
def test_digit_sum(spark, n):
    assert one(spark, exprs.digit_sum(F.lit(n))) == sum(map(int, str(n)))


def test_durations(spark):
    assert one(spark, exprs.duration_sectors(F.lit(588 * 7))) == 7
    assert one(spark, exprs.duration_sectors(F.lit(588 * 7 + 1))) == -1
    assert one(spark, exprs.duration_seconds(F.lit(44100 * 3 - 1))) == 2


def test_edit_distance_counts_code_points_and_case(spark):
    assert one(spark, exprs.edit_distance(F.lit("Trä"), F.lit("Tra"))) == 1
    assert one(spark, exprs.edit_distance(F.lit("a"), F.lit("A"))) == 1
    assert one(spark, exprs.edit_distance(F.lit(None).cast("string"), F.lit("ab"))) == 2


def test_extractors(spark):
    null = F.lit(None).cast("string")
    assert one(spark, exprs.compilation(null)) == "0" and one(spark, exprs.text_or_empty(null)) == ""
    assert one(spark, exprs.title(F.lit(""), F.lit("r"))) == "r" and one(spark, exprs.title(F.lit("t"), F.lit("r"))) == "t"
    assert one(spark, exprs.unless_same(F.lit("a"), F.lit("a"))) == ""
    assert one(spark, exprs.position_of(F.lit(3), F.lit(12))) == "3/12"


# fixed values: two paths of the rip database with the ids that they spell
@pytest.mark.parametrize(("ids", "path"), [((0x002C7BBB, 0x02480762, 0x1F124813, 18), "/accuraterip/b/b/b/dBAR-018-002c7bbb-02480762-1f124813.bin"), ((0x0002C3AA, 0x0009F0CC, 0x30065D04, 3), "/accuraterip/a/a/3/dBAR-003-0002c3aa-0009f0cc-30065d04.bin")])
def test_rip_path(spark, ids, path):
    assert one(spark, exprs.rip_path(*map(F.lit, ids))) == path


def test_eac_path(spark):
    got = one(spark, exprs.eac_path(F.lit("7vqa6F_exuZ4paBsKHn0GO.tCrw-"), F.lit(11)))
    assert got.startswith("/crc/E/E/F/A/EEFA9AE85FDEC6E678A5A06C2879F418EFAD0ABC") and got.endswith("-11.bin")


def test_disc_ids_by_hand(spark):
    offsets = [(1, 150), (2, 20150), (3, 40000)]
    leadout = 60000
    o = spark.createDataFrame([("d", *x) for x in offsets], "disc_id string, position int, offset int")
    r = discs.disc_ids(o, spark.createDataFrame([("d", leadout)], "disc_id string, leadout int")).first()
    rel = [(p, x - 150) for p, x in offsets]
    end = leadout - 150
    assert r["id1"] == sum(x for _, x in rel) + end
    assert r["id2"] == sum((x or 1) * p for p, x in rel) + end * 4
    digits = sum(sum(map(int, str(x // 75 + 2))) for _, x in rel)
    assert r["cddb"] == (digits % 255 << 24) + ((end // 75) << 8) + 3


def test_disc_in_the_lead_in_has_no_ids(spark):
    o = spark.createDataFrame([("d", 1, 149)], "disc_id string, position int, offset int")
    assert discs.disc_ids(o, spark.createDataFrame([("d", 5000)], "disc_id string, leadout int")).count() == 0


def test_le32(spark):
    assert one(spark, exprs.le32(F.lit(0x01020384))) == "84030201"
    assert one(spark, F.crc32(F.unhex(exprs.le32(F.lit(7))))) == zlib.crc32((7).to_bytes(4, "little"))


def test_schemas_parse(spark):
    for name in ("STREAMS", "SAMPLES", "MATCHES", "CATALOG_TRACKS", "DISCS", "DISC_OFFSETS", "AR_VOTES", "EAC_VOTES", "REMAP", "TAGS", "ARTIST_CREDITS", "WORK_RELATIONS", "ARRIVALS"):
        assert spark.createDataFrame([], getattr(schema, name)).columns
