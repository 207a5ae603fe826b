"""Every stage of the pipeline on a small fixture against brute force, with nulls, repeated ids, ties, empty and long texts and a clashing column."""

import random

import pytest

import corpus_pipeline as cp
from veilspark.llm import nbsvm, toxicity

SCHEMA = "doc_id long, text string, lang string, score string"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch the red moon rise above the quiet sea tonight"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        own = [rng.choice(words) for _ in range(40)]
        if i % 10 == 0:
            own[5:8] = ["scum", "idiot", "moron"]
        text = " ".join(own) + "."
        if i % 10 == 3:
            text = "BUY!! NOW!! " * 20
        rows.append((i, text, "en", "x"))
        labels.append((i, int(i % 10 != 3), int(i % 10 == 0)))
    base = [rng.choice(words) for _ in range(80)]
    for k in range(6):
        own = list(base)
        own[10 * k] = f"edit{k}"
        rows.append((1000 + k, " ".join(own) + ".", "en", None))
    rows += [(1001, rows[401][1], "en", None), (2000, None, None, None), (2001, "", "en", None), (2002, "", "en", None), (None, " ".join(base) + ".", "en", None), (2003, " ".join(words[:150]) + ". " + ITEM + " " + " ".join(words[150:]) + ".", "en", None)]
    rows.append((2004, " ".join(rng.choice(words) for _ in range(60_000)) + ".", "en", None))
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("module, stage, wanted", [(toxicity, cp.drop_toxic, 0), (nbsvm, cp.drop_poor, 1)])
def test_classifying_stages_keep_the_rows_their_operator_keeps(spark, tables, module, stage, wanted):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    judged = module.score(docs, module.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))).collect()
    kept = stage(spark, docs, tables)
    assert kept.columns == docs.columns
    assert sorted((str(r[0]) for r in kept.collect())) == sorted(str(r["doc_id"]) for r in judged if r["predicted"] == wanted)
    rejected = {r["doc_id"] for r in judged if r["predicted"] != wanted}
    planted = {i for i in range(400) if i % 10 == (0 if wanted == 0 else 3)}
    assert len(planted & rejected) > 0.9 * len(planted) and len(set(range(400)) & rejected - planted) < 8


def test_one_document_of_each_group_stays(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = rows_of(cp.drop_near_copies(spark, docs, tables))
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        if r["doc_id"] is not None and w:
            sets.setdefault(r["doc_id"], []).append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = sorted((tuple(r) for r in docs.collect() if r["doc_id"] not in parent or find(r["doc_id"]) == r["doc_id"]), key=repr)
    assert kept == want


def test_benchmark_passages_are_cut(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    cut = cp.cut_benchmark(spark, docs, tables)
    assert cut.columns == docs.columns
    want = [(i, t.replace(ITEM + " ", "") if i == 2003 else t, lang, s) for i, t, lang, s in (tuple(r) for r in docs.collect())]
    assert rows_of(cut) == sorted(want, key=repr)


def test_whole_run_and_empty_tables(spark, tables):
    pytest.importorskip("public_tokenizers")
    out = cp.run(spark, tables)
    pieces = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert pieces and all(r[1] <= 1024 for r in pieces)
    whole = out.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert {r["doc_id"] for r in whole} >= {2000, 2004} or all(r[2] % r["doc_tokens"] == 0 for r in whole)
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, tables).count() == 0
