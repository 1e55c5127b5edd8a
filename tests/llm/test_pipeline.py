"""The pipeline, stage by stage, against brute-force versions on the smallest tables."""

import collections
import hashlib

import corpus_pipeline
from gridloom.llm import bpe
from gridloom.llm.common import saved, table
from gridloom.llm.pipeline_stages import quality_rules
from tests_llm_help import shingle_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == names
            docs = saved(docs, "test-stage")
        after = docs.collect()
        if name in ("quality_rules", "quality_classifier"):
            assert 0 < len(after) < len(before) or name == "quality_classifier"
            assert not collections.Counter(after) - collections.Counter(before)
        elif name == "near_dedup":
            heads = shingle_components([(r["doc_id"], r["text"]) for r in before], 5)
            assert sorted(r["doc_id"] for r in after) == sorted(heads)
        elif name == "mix_sources":
            assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 3
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        else:
            codec = bpe.codec("byte_bpe_50k.tiktoken", None)
            text = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            for r in after:
                ids = codec.ids([text[r["doc_id"]]])[0]
                assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(after)


def test_rules_keep_short_documents(spark):
    rows = [(1, "A short and clean note of a few words."), (2, "BUY NOW AND SAVE")]
    assert [r["doc_id"] for r in quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()] == [1]
