"""N-gram join, line dedup and decontamination against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.llm import decontamination, graph, ngram_join, registered

DOCS = "doc_id long, text string"


def sets_by_hand(texts, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def components_by_hand(rows, n, num, den):
    """(id, size of its set, smallest id reached) of each row, by looking at all pairs."""
    sets, root = sets_by_hand([t for _, t in rows], n), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids, default=None) if sets[i] else d)))
    return sorted(out, key=str)


def families(seed, n_families=12, largest=40, vocabulary=300):
    """Documents in families of near copies, some of them chains, with passages that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [" ".join(rng.choices(words, k=12)) for _ in range(3)]
    rows = []
    for _ in range(n_families):
        base = rng.choices(words, k=rng.choice((3, 8, 14, 40, 120, 300)))
        for _ in range(rng.choice((1, 2, 5, largest))):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                base = w
            text = " ".join(w) + (" " + rng.choice(shared) if rng.random() < 0.3 else "")
            rows.append(text.upper() if rng.random() < 0.1 else text)
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


ODD = [(None, "a b c d e"), (4, "a b c d e"), (9, None), (10, ""), (11, " \t\n"), (12, "one"), (13, "ONE"), (13, "ONE"), (14, "x y"), (15, "é " * 9), (16, "word " * 50_000), (None, "lonely null"), (None, "lonely null")]


@pytest.mark.parametrize(("n", "num", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_components(spark, monkeypatch, n, num, seed):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    rows = families(seed) + (ODD if seed == 1 else [])
    rows = [(None if i is None else i + (10_000 if k >= len(rows) - len(ODD) and seed == 1 else 0), t) for k, (i, t) in enumerate(rows)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS), n, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == components_by_hand(rows, n, num, 100)


def test_components_by_sort_and_merge(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = families(3, 5)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components_by_hand(rows, 4, 85, 100)


def test_no_documents_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, "q", 3)], "doc_id long, text string, ngram_id int")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(d).collect()) == [1, 3]
    assert ngram_join.ngram_components(d.limit(0)).count() == 0


def test_op2_same_as_sql(spark, sf, same_rows):
    same_rows(registered.QUERIES["op2_ngram_join"](spark, sf), registered.ORACLES["op2_ngram_join"])


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (50, 100)])
def test_size_classes(num, den):
    s = ngram_join.Sizes(num, den, 5000)
    for n1 in range(1, 1500):
        n2 = n1 * den // num
        assert s.of(n1) <= s.of(n2) <= s.of(n1) + 1
        assert (den - num) * (n1 + n2) // (den + num) <= s.differ(s.of(n1))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.floats(0, 1))
def test_linked_sets_share_a_signature(n, seed, share):
    rng = np.random.default_rng(seed)
    sizes = ngram_join.Sizes(85, 100)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    gone = int(len(a) * 0.08 * share)
    b = np.unique(np.concatenate((a[gone:], rng.integers(0, 2**63, int(gone * rng.random())).astype(np.uint64))))
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
        assert len(np.intersect1d(ngram_join.signatures(a, sizes), ngram_join.signatures(b, sizes)))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.booleans())
def test_products(seed, square):
    rng = np.random.default_rng(seed)
    make = lambda k: [np.unique(rng.choice(60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(k)]
    left, right = make(6), None if square else make(4)
    got = ngram_join.product(left, right, 60, 100)
    other = left if square else right
    for i, a in enumerate(left):
        for j, b in enumerate(other):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 60 * (len(a) + len(b) - both) and not (square and i == j))
    f = ngram_join.forest(got, square)
    assert len(f) < len(left) + (0 if square else len(right))


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 3), (3, 5), (9, 9), (-7, 5)], []])
def test_graph(spark, edges):
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root


# -- benchmark ----------------------------------------------------------------------------------------------------------------------

ITEMS = [("1", "the quick brown fox jumps over the lazy dog and runs away again"), ("2", "short item"), ("3", ""), ("4", None), (None, "no id here at all"), ("5", "fox jumps over the lazy dog and runs away again today"), ("2", "short item")]


def contaminated(seed):
    rng = random.Random(seed)
    words = "the quick brown fox jumps over lazy dog and runs away again short item no id here at all ä 9".split()
    texts = [None, "", " ", "Short  ITEM", "short, item!", "x " * 30_000 + "short item"]
    for _ in range(80):
        w = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = (rng.choice(ITEMS)[1] or "").upper().split()
        texts.append(", ".join(w))
    return texts


def test_a_task_holds_few_parts_of_a_large_benchmark(spark):
    """Eleven parts: as one plan they would be a chain of eleven workers; spans and cut texts are those of one part."""
    draw = random.Random(6)
    words_ = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words_, k=60))) for i in range(30)] + [(30, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(draw.choices(words_, k=3))) for i in range(60)], "item_id long, text string")
    whole, parts = (decontamination.find_contamination(docs, bench, benchmark_mb=mb) for mb in (64, 0.0004))
    assert decontamination._parts(bench, "item_id", "text", 10, 0.0004)[0] > 2 * decontamination.CHAIN
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("MapInArrow") <= decontamination.CHAIN
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    a, b = (sorted(map(str, decontamination.decontaminate(docs, bench, benchmark_mb=mb).collect())) for mb in (64, 0.0004))
    assert a == b


@pytest.mark.parametrize("mb", [64, 0.0001])
def test_decontamination(spark, mb):
    texts = contaminated(5)
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Spans int")
    b = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(d, b, benchmark_mb=mb).collect()}
    want = decontamination.brute_force([t and t.encode() for t in texts], [(i, t and t.encode()) for i, t in ITEMS])
    for i, (n, hit, items, _, bad) in enumerate(want):
        r = got[i]
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["item_ids"]), bool(r["spans"])) == (n, hit, items, bad)
    clean = decontamination.decontaminate(d, b, benchmark_mb=mb)
    assert clean.columns == d.columns
    left = decontamination.find_contamination(clean, b).collect()
    assert not any(r["spans"] for r in left)
    untouched = {i for i, w in enumerate(want) if not w[4]}
    kept = {r["doc_id"]: r["text"] for r in left}
    assert all(kept[i] == texts[i] for i in untouched) and 3 not in kept
    assert decontamination.find_contamination(d.limit(0), b).count() == 0
    assert decontamination.find_contamination(d, b.limit(0)).where("size(spans) > 0").count() == 0


def test_cutting_in_parts_is_cutting_at_once(spark):
    texts = contaminated(5)
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Spans int")
    b = spark.createDataFrame(ITEMS, "item_id string, text string")
    at_once, parts = (decontamination.decontaminate(d, b, benchmark_mb=mb) for mb in (64, 0.0001))
    assert parts.columns == d.columns
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, at_once.collect()), key=str)
    assert not any(r["spans"] for r in decontamination.find_contamination(parts, b).collect())


def test_index_in_small_blocks(monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 40)
    texts = [t and t.encode() for t in contaminated(6)]
    items = [(i, t and t.encode()) for i, t in ITEMS]
    p = decontamination.Patterns(items)
    got = [(n, sum(b - a for a, b in s)) for n, s, _ in decontamination.scan(texts, p)]
    assert got == [w[:2] for w in decontamination.brute_force(texts, items)]


def test_op6(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    b = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = decontamination.brute_force([r["text"].encode() for r in d], [(str(r["item_id"]), r["text"].encode()) for r in b])
    got = registered.QUERIES["op6_decontamination"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == want and any(w[4] for w in want)


@pytest.mark.parametrize("window", [3, 64, 65, 200])
def test_windows_of_any_length(window):
    rng = random.Random(window)
    item = [f"w{rng.randrange(9)}" for _ in range(450)]
    texts = [" ".join(item[a : a + n]).encode() for a, n in ((0, 450), (7, window), (9, window - 1), (100, 300))] + [b"w1 w2", None]
    items = [("a", " ".join(item).encode())]
    got = decontamination.scan(texts, decontamination.Patterns(items, window))
    want = decontamination.brute_force(texts, items, window)
    assert [(n, sum(b - a for a, b in spans)) for n, spans, _ in got] == [(w[0], w[1]) for w in want]


def test_unrelated_short_texts_are_not_tied():
    """Short sets of strangers share no signature, however many there are."""
    rng = np.random.default_rng(3)
    for num, den in ((80, 100), (85, 100)):
        sizes = ngram_join.Sizes(num, den)
        sigs = np.concatenate([np.unique(ngram_join.signatures(np.unique(rng.integers(0, 2**63, 5 + k % 8).astype(np.uint64)), sizes)) for k in range(20_000)])
        _, count = np.unique(sigs, return_counts=True)
        assert count.max() <= 2 and (count > 1).sum() < 3


def test_a_family_is_sent_once(spark, monkeypatch):
    """5000 near copies of one text are joined along their ties: few rows are left for the products of blocks."""
    rng, sent = random.Random(1), []
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(5000):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(5000 + i, " ".join(f"s{i}x{k}" for k in range(120))) for i in range(50)]
    whole = ngram_join._items
    monkeypatch.setattr(ngram_join, "_items", lambda kept, payload: sent.append(whole(kept, payload)) or sent[-1])
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS).repartition(8)).collect()
    assert all(r["component_id"] == (0 if r["doc_id"] < 5000 else r["doc_id"]) for r in got)
    assert sum(x.count() for x in sent) < 3 * 5000
