"""The filter audit: against SQL, and against a brute-force version on awkward rows and many ranges."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from provena.llm import filter_audit, registered

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
DOCS = "doc_id long, text string, source string, mask int, fp string, part int"


def brute_force(docs, labels):
    def fails(i, t):
        w = [x for x in t.replace("\t", " ").replace("\n", " ").split(" ") if x]
        out = "A" * (len(w) < 200) + "B" * (2 * len(set(w)) < len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        twins = [j for j, u, *_ in docs if (u or "") == t]
        return out + "E" * any(j is not None and (i is None or j < i) for j in twins)

    rows = [(s or "", fails(i, t or ""), i) for i, t, s, *_ in docs]
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for p, *_ in rows}:
        mine = [(f, i) for p, f, i in rows if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order):
                here = [(f, i) for f, i in mine if x in f and not set(f) & set(order[:step])]
                removed_by[x] += len(here)
                kept = sum(not set(f) & set(order[: step + 1]) for f, _ in mine)
                redundant = sum(x in f and bool(set(f) & set(order[:step])) for f, _ in mine)
                out[part, order, step + 1] = [kept, len(here), redundant, sum(f == x for f, _ in mine), sum(i in good for _, i in here), sum(i in toxic for _, i in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def audited(spark, docs, labels):
    masks = filter_audit.failure_masks(spark.createDataFrame(docs, DOCS), filter_audit.text_failures, 16)
    got = filter_audit.interactions(filter_audit.part_counters(masks, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in got}
    assert len(out) == len(got)
    return out


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (6, 1, 1), (9, 1, 1), (99, 1, 1)]


def test_same_as_sql(spark, sf, same_rows):
    same_rows(registered.QUERIES["op11_filter_audit"](spark, sf), registered.ORACLES["op11_filter_audit"])


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(3, "same", "a"), (1, "same", "b"), (2, "same", None), (None, "same", "a"), (1, "same", "b"), (4, None, "a"), (5, "", ""), (None, None, "a"), (6, long, "a"), (7, long + " é" * 300, "a"), (8, long.upper(), "c"), (9, long + " |", "a"), (9, long, "a"), (10, "x" * 300_000, "b")]
    docs = [(*d, 7, "clash", 0) for d in docs]
    got = audited(spark, docs, LABELS)
    assert got == brute_force(docs, LABELS)
    assert audited(spark, docs, []) == brute_force(docs, []) and audited(spark, [], LABELS) == {}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_copies_over_many_ranges(spark, ranges):
    """A third of all rows is one group of copies, which stretches over several ranges."""
    draw = random.Random(5)
    docs = [(i if draw.random() > 0.05 else None, draw.choice(["hot"] * 4 + ["one", "two", "", None, f"own {i}"]), draw.choice("abc"), 1, "", 2) for i in range(300)]
    docs += docs[:20] + [(7, "hot", "a", 1, "", 2)] * 60
    draw.shuffle(docs)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert audited(spark, docs, LABELS) == brute_force(docs, LABELS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_fingerprints_of_different_texts(spark):
    """_compared() goes by the full text where fingerprints agree, over ranges too."""
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()))], names=["fp", "text", "id", "part", "n"])

    rows = [(5, b"a", 1, "", 1), (5, b"a", 3, "", 1), (5, b"b", 2, "", 1), (5, b"b", 4, "", 1), (9, b"c", 1, "", 1), (9, b"d", 5, "", 1), (9, b"d", 5, "", 1)]
    got = [r for b in filter_audit._compared(iter([batch(rows[:3]), batch(rows[3:])]), lambda t: 0, 16, pa.int64()) for r in b.to_pylist()]
    assert [r["mask"] for r in got if not r["last"]] == [0, 16, 0, 16, 0, 0, 0]
    assert [r["fp"] for r in got if not r["last"]] == [5, 5, 5, 5, None, None, None]
    assert [(r["fp"], r["id"]) for r in got if r["last"]] == [(9, 1), (9, 5)]


def test_plan_has_one_exchange_of_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plan = filter_audit.failure_masks(d, filter_audit.text_failures, 16)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_repeated_rows_are_combined_before_the_exchange():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1] * 4), pa.array([b"a", b"a", b"b", b"a"]), pa.array([7, 7, 7, None]), pa.array(["s"] * 4)], names=["fp", "text", "id", "part"])
    (out,) = filter_audit._combined(iter([b]))
    assert [(r["text"], r["id"], r["n"]) for r in out.to_pylist()] == [(b"a", 7, 2), (b"b", 7, 1), (b"a", None, 1)]


def test_shares_add_up(spark, sf):
    rows = registered.QUERIES["op11_filter_audit"](spark, sf).groupBy("part", "filter_order").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert rows and all(r["s"] == 120 * r["r"] for r in rows)
