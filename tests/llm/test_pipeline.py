"""The pipeline: each stage against what its operator says of its input."""

import os

import corpus_pipeline
from orograph.llm import decontaminate, secrets, simhash, toxicity
from orograph.llm.common import cut
from orograph.shared import tables
from tests.conftest import SMALL
from tests.llm.test_operators import brute_simhash, check_packing


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench, labels = spark.read.parquet(f"{SMALL}/benchmark.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, SMALL))
        assert after.columns == columns
        before_ids, after_ids = ([r.doc_id for r in d.select("doc_id").collect()] for d in (docs, after))
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").select("row.doc_id").collect()}
            assert sorted(after_ids) == sorted(i for i in before_ids if i not in bad)
        if name == "near_duplicates":
            groups = brute_simhash([(r.doc_id, r.text) for r in docs.collect()])[1]
            assert sorted(after_ids) == sorted(i for i in before_ids if groups[i] == i)
            assert simhash.keep_first(after).count() == after.count()
        if name == "decontamination":
            hit = {r.doc_id for r in decontaminate.digest_rows(docs, bench).where("contaminated").collect()}
            assert sorted(after_ids) == sorted(i for i in before_ids if i not in hit)
        if name == "secrets":
            assert sorted(after_ids) == sorted(before_ids)
            assert secrets.scan_rows(after).where("n_access + n_hex > 0").count() == 0
        seen.append(name)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert check_packing([(r.doc_id, r.text) for r in docs.collect()], packed, 2048) < 0.05
    with tables() as written:
        whole = corpus_pipeline.run(spark, SMALL).collect()
    # of all tables the last stage's input is left
    assert len(written) > 10 and [os.path.isdir(p.removeprefix("file://")) for p in written].count(True) == 1
    assert sorted((r.doc_id, r.doc_tokens) for r in whole if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in packed if r.start == 0)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
