"""The corpus pipeline: each stage on its own input, and the rows of a run."""

import hashlib

import numpy as np
import pytest
import tiktoken

import public_tokenizers
from factloom.llm import common, stages

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = common.table(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), "stage")
        out.append(docs)
    return out


def test_stages_filter_and_keep_columns(spark, kept):
    docs = common.table(spark, DATA, "documents")
    counts = [docs.count(), *(k.count() for k in kept)]
    assert counts[0] > counts[1] > 0 and counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert all(k.columns == docs.columns for k in kept[:-1])
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(whole[r.doc_id] == tuple(r) for k in kept[:-1] for r in k.collect())


def test_one_document_of_each_group_stays(kept):
    before, after = ({r.doc_id: r.text for r in k.collect()} for k in kept[1:3])
    assert len(set(after.values())) == len(after) and set(after.values()) <= set(before.values())


def test_tokens_are_those_of_the_library(kept):
    from factloom.llm import bpe

    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in kept[3].collect()}
    for r in kept[4].collect():
        assert bytes(r.ids) == np.array(enc.encode_ordinary(text[r.doc_id]), "<u4").tobytes() and r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_stages_of_no_documents(spark):
    docs = common.table(spark, DATA, "documents").where("false")
    for stage in (stages.drop_toxic, stages.drop_low_quality, stages.drop_near_duplicates, stages.mix_sources, stages.encode):
        assert stage(spark, docs, DATA).count() == 0


def test_the_driver_rests_before_each_stage(spark, monkeypatch):
    calls, rested = [], common.rested
    monkeypatch.setattr(corpus_pipeline, "rested", lambda s: (calls.append("rest"), rested(s)))
    same = lambda s, docs, d: (calls.append("stage"), docs)[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", same), ("b", same), ("c", same)])
    assert corpus_pipeline.run(spark, DATA).count() == common.table(spark, DATA, "documents").count()
    assert calls == ["rest", "stage"] * 3


def test_a_stage_called_alone_rests_the_driver_too(spark, monkeypatch):
    calls, rested = [], common.rested
    monkeypatch.setattr(stages, "rested", lambda s: (calls.append("rest"), rested(s)))
    docs = common.table(spark, DATA, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA)
    assert len(calls) >= len(corpus_pipeline.STAGES)


def test_the_driver_rests_after_a_job_where_its_heap_has_grown(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "rested", lambda s: calls.append("rest"))
    for large in (False, True, True):
        monkeypatch.setattr(common, "grown", lambda s: large)  # noqa: B023
        assert common.stored(spark.range(3)).count() == 3
    assert calls == ["rest"] * 2
    monkeypatch.undo()
    assert common.grown(spark) in (False, True)


def test_the_drivers_jvm_gives_back_free_memory_outside_its_heap(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) / 1024

    assert common.trimmed(spark)
    for _ in range(3):  # so that the one below hardly needs new heap
        common.stored(spark.range(3))
    held = [jvm.java.util.zip.Deflater() for _ in range(4000)]  # each takes over 100 kB outside the heap
    for x in held[:-1]:
        x.end()
    full = resident()
    assert common.stored(spark.range(3)).count() == 3
    assert resident() < full - 100
    held[-1].end()
