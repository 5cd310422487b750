from collections import Counter

import corpus_pipeline
from test_neardup import slow


def test_stages_keep_their_contract(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert set(docs.columns) <= set(out.columns), name
            if name != "shard":
                assert out.columns == docs.columns, name
            assert out.count() >= 0


def test_whole_run(spark, sf_docs):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        by[name] = [r["doc_id"] for r in docs.collect()]
    texts = {r["doc_id"]: r["text"] for r in sf_docs.collect()}
    assert set(by["language"]) == set(texts)  # clean documents stay
    near = slow(sorted(texts.items()), 5)
    assert sorted(by["near_duplicates"]) == sorted(d for d, (_, c) in near.items() if c == d)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaking = {d for d in by["near_duplicates"] if any(" ".join(i.lower().split()) in " ".join(texts[d].lower().split()) for i in items)}
    assert leaking and not leaking & set(by["decontaminate"])
    assert len(by["near_duplicates"]) - len(by["decontaminate"]) <= 1.2 * len(leaking) + 1
    assert max(Counter(by["mix"]).values()) <= 2 and set(by["mix"]) <= set(by["decontaminate"])
    assert Counter(by["shard"]) == Counter(by["mix"])
    slots = {}
    for r in docs.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
