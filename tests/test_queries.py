"""Every registered query of the engine against its SQL, on the smallest tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from provena import shared
from provena.operators import dealing, numbering
from provena.plans import engine_queries, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, spark, sf, same_rows):
    same_rows(registry.QUERIES[name](spark, sf), registry.ORACLES[name])


@pytest.mark.parametrize("name", ["tree_dump", "stream_permutation", "configuration_choice", "composer_roles", "tag_mapping"])
def test_same_as_sql_when_dealt(name, spark, sf, same_rows, monkeypatch):
    """Tasks of 300 rows, as larger tables have of TASK_ROWS."""
    monkeypatch.setattr(dealing, "TASK_ROWS", 300)
    same_rows(registry.QUERIES[name](spark, sf), registry.ORACLES[name])


@pytest.mark.parametrize("name", ["mismatch_report", "report_lines"])
def test_reports_same_as_sql_when_dealt(name, spark, sf, same_rows, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 300)
    same_rows(registry.QUERIES[name](spark, sf), registry.ORACLES[name])


def test_report_lines_writes_places_and_not_lines(spark, sf, duck, monkeypatch):
    """What stays on disk to be numbered is a row for each place and release group, not one for each line."""
    kept = []
    monkeypatch.setattr(numbering, "written", lambda *a: kept.append(shared.written(*a)) or kept[-1])
    n = registry.QUERIES["report_lines"](spark, sf).count()
    lines, groups = duck.execute("select count(*), count(distinct l_suppkey) from lineitem").fetchone()
    assert [x.count() for x in kept] == [lines + groups] and lines + groups < n


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["l_orderkey", "v1"]


def test_sliding_crc_matches_takes_every_window(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    one = e.limit(1).drop("user_id").crossJoin(spark.range(60).withColumnRenamed("id", "event_no"))
    one = one.withColumn("event_id", F.col("event_no").cast(e.schema["event_id"].dataType)).withColumn("user_id", F.lit(1).cast(e.schema["user_id"].dataType))
    one.select(e.columns).write.parquet(f"{tmp_path}/events.parquet")
    streams = {}
    for r in engine_queries.event_samples(spark, str(tmp_path)).collect():
        streams.setdefault(r["user_id"], {})[r["j"]] = r["s"]
    want = set()
    for u, s in streams.items():
        crc = {j - 1: zlib.crc32(b"".join(s[j + k].to_bytes(4, "little") for k in range(8))) for j in s if all(j + k in s for k in range(8))}
        want |= {(u, c, start - 16) for start, c in crc.items() if -16 <= start - 16 <= 16 and c}
    got = engine_queries.sliding_crc_matches(spark, str(tmp_path)).select("user_id", "target", "offset").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 33
