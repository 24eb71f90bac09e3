"""The corpus pipeline, each stage on its own input."""

import hashlib
import math

import corpus_pipeline
import duckdb
import pytest

from provena.llm import decontamination, registered, toxicity
from test_near import components_by_hand


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for s in stages[:-1]:
        assert s.dtypes == docs.dtypes
    assert stages[-1].columns == [*docs.columns, "shard", "slot"]


def test_toxic_documents_go(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = toxicity.score(docs, toxicity.learned(spark, sf)).where(f"toxicity >= {toxicity.REJECT}")
    assert ids(stages[0]) == sorted(set(ids(docs)) - set(ids(rejected)))


def toxicity_by_hand(text, lexicon):
    """The score from the lexicon's entries, by looking at every word."""
    words = toxicity.folded(text or "").split()
    positive = {k: w for k, w in lexicon.weights.items() if w > 0}
    total, kinds, top = 0.0, set(), 0.0
    for i in range(len(words)):
        fits = [k for k in positive if (words[i].startswith(k[:-1]) if k.endswith("*") else words[i : i + len(k.split())] == k.split())]
        if fits:
            # a whole word with the spaces around it is longer than a beginning of as many letters
            k = max(fits, key=lambda k: len(k) if k.endswith("*") else len(k) + 2)
            total, top = total + positive[k], max(top, positive[k])
            kinds.add(k)
        for k, w in lexicon.weights.items():
            if w < 0 and words[i : i + len(k.split())] == k.split():
                total += w
    n = len(words)
    x = [math.log1p(total), math.log1p(1000 * total / (n + 20)), math.log1p(len(kinds)), top, math.log1p(n)] if total > 0 else [0.0, 0.0, 0.0, 0.0, math.log1p(n)]
    z = sum(a * b for a, b in zip(x, lexicon.coefficients)) + lexicon.coefficients[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxic_documents_by_hand(spark, sf, stages):
    lexicon = toxicity.learned(spark, sf)
    if not lexicon.weights:  # few labelled rows: one lexicon of every kind of entry
        lexicon.weights = {"the": 1.0, "the*": 0.5, "und": 2.0}
    lexicon.weights |= {"zz top": 1.5, "not zz top": -1.5}
    odd = [(-1, "zz top zz TOP"), (-2, "not zz top"), (-3, "z2 t0p"), (-4, ""), (-5, None)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r["doc_id"]: (r["toxicity"], r["text"]) for r in toxicity.score(docs, lexicon).collect()}
    for i, (score, text) in got.items():
        assert score == pytest.approx(toxicity_by_hand(text, lexicon), abs=1e-9), i
    kept = ids(toxicity.reject_toxic(docs, lexicon))
    assert kept == sorted(i for i, (_, text) in got.items() if toxicity_by_hand(text, lexicon) < toxicity.REJECT)


def test_copies_in_the_mix_by_sql(spark, stages):
    """Taken words by the SQL of mixing, and the draw of the fraction by hand."""
    con = duckdb.connect()
    con.register("documents", stages[2].select("doc_id", "text", "lang", "source").toArrow())
    want = []
    for doc, size, _, _, taken in con.execute(registered.ORACLES["op8_mixing"]).fetchall():
        draw = int(hashlib.md5(f"mix-1:copies:{doc}".encode()).hexdigest()[:8], 16) / 2**32
        share = taken / size if size else 1
        want += [doc] * (math.floor(share) + (draw < share - math.floor(share)))
    assert ids(stages[3]) == sorted(want)


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[0].collect()]
    assert ids(stages[1]) == sorted(i for i, _, c in components_by_hand(rows, 5, 80, 100) if i == c)


def test_nothing_of_the_benchmark_is_left(spark, sf, stages):
    items = [(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[1:3])
    hit = dict(zip(before, decontamination.brute_force([r["text"].encode() for r in before.values()], items)))
    assert not any(w[4] for w in decontamination.brute_force([r["text"].encode() for r in after.values()], items))
    for i, w in hit.items():
        if not w[4]:
            assert after[i]["text"] == before[i]["text"]
        elif w[1] == w[0]:
            assert i not in after
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_mix_and_shards(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    mixed = stages[3].collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed)
    assert max(ids(stages[3]).count(i) for i in set(ids(stages[3]))) <= 3
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r["text"].split()) for r in mixed) - total) < 0.3 * total
    last = stages[4].collect()
    assert sorted(r["doc_id"] for r in last) == ids(stages[3])
    for s in {r["shard"] for r in last}:
        slots = sorted(r["slot"] for r in last if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_goes_through(spark, sf, stages):
    assert ids(corpus_pipeline.run(spark, sf)) == ids(stages[4])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, Toxic_Matches int, size string, target int, taken string, c0 int, spans string, ngram_id string"


def awkward(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    texts = [None, "", " \n\t", "one", long, "the same text stands here twice or more", "the same text stands here twice or more", "you worthless idiot, stupid moron, pathetic scum", "a b c d e f g"]
    rows = [(i if i else None, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t), "mine", i, "mine", i, None, 7, "mine", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[6]], CLASHING)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_rows(spark, sf, k):
    """Nulls, empty and long texts, repeated rows, columns that clash with the operators' own, and no rows at all."""
    docs = awkward(spark)
    name, stage = corpus_pipeline.STAGES[k]
    for d in (docs, docs.limit(0)):
        out = stage(spark, d, sf)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        assert all(r["toxicity"] == "mine" and r["c0"] == 7 and r["ngram_id"] is None for r in got)
        if name != "sharding":
            assert out.dtypes == docs.dtypes and all(r["size"] == "mine" and r["spans"] == "mine" for r in got)
    given = docs.collect()
    got = stage(spark, docs, sf).collect()
    if name == "toxicity":
        assert {r["text"] for r in given} - {r["text"] for r in got} <= {given[7]["text"]}
    elif name == "ngram_jaccard_join":
        assert len(got) == len(given) - 2 and {r["text"] for r in got} == {r["text"] for r in given}
    elif name in ("benchmark_decontamination", "sharding"):
        assert sorted(str(r["text"]) for r in got) == sorted(str(r["text"]) for r in given)
    else:
        assert {r["text"] for r in got} <= {r["text"] for r in given}
