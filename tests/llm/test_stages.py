"""Stages of the corpus pipeline against brute force, on small fixtures."""

import itertools
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from factloom.llm import common, minhash, mixing, quality, stages, toxicity

DATA = "/root/testdata/sf0.001"

WORDS = [f"w{i}" for i in range(400)]
A, B, C = (" ".join(WORDS[i : i + 60]) for i in (0, 100, 200))


def near(text, word="other"):
    return text.rsplit(" ", 1)[0] + " " + word


def test_texts_of_one_doc_id_are_judged_each_by_itself(spark):
    rows = [(3, A), (7, near(A)), (7, B), (7, B), (8, near(B)), (9, C), (9, None), (None, A), (None, A)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in stages.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted([(0, A), (0, A), (3, A), (7, B), (9, C), (9, "")])


def test_rows_of_one_doc_id_share_a_component(spark):
    rows = [(3, A), (5, B), (6, near(B)), (7, A), (7, B), (7, None), (8, C), (9, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (6, 3, False), (7, 3, False), (7, 3, False), (7, 3, False), (8, 8, True), (9, 9, True)]


@pytest.mark.parametrize("module, stage, keep", [(toxicity, stages.drop_toxic, lambda s: s < 0.7), (quality, stages.drop_low_quality, lambda s: s >= 0.7)])
def test_filters_drop_exactly_the_rows_beyond_the_threshold(spark, monkeypatch, module, stage, keep):
    docs = common.table(spark, DATA, "documents")
    model = module.train(docs, common.table(spark, DATA, "labels"))
    rows = docs.select("doc_id", "text").collect()
    scores = [float(x) for x in model.scores(pa.array([r.text for r in rows], pa.string()))]
    want = Counter(r.doc_id for r, s in zip(rows, scores) if keep(s))
    assert 0 < sum(want.values()) < len(rows)
    assert Counter(r.doc_id for r in stage(spark, docs, DATA).select("doc_id").collect()) == want
    monkeypatch.setattr(module, "train", lambda *a: None)
    monkeypatch.setattr(module, "score", lambda text, model: text.cast("double"))
    texts = ["0", "0.69", "0.7", "0.7", "0.71", "1"]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in stage(spark, some, DATA).collect()) == [i for i, t in enumerate(texts) if keep(float(t))]


def test_near_duplicates_keep_the_smallest_id_of_each_brute_force_component(spark):
    r = random.Random(4)
    texts = []
    for _ in range(12):
        words = [r.choice(WORDS) for _ in range(80)]
        texts.append(" ".join(words))
        for edits in range(r.randrange(4)):  # each a near copy of the one before, or too far from it
            words = words[:]
            for _ in range(1 + 2 * edits):
                words[r.randrange(80)] = r.choice(WORDS)
            texts.append(" ".join(words))
    texts += [texts[0], "", "short one", "short one"]
    ids = r.sample(range(1000), len(texts))
    sets = {}
    for i, t in zip(ids, texts):
        w = t.split()
        sets[i] = {tuple(w[k : k + minhash.WORDS]) for k in range(max(1, len(w) - minhash.WORDS + 1))} if w else set()
    group = {i: i for i in ids}
    for a, b in itertools.combinations(ids, 2):
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    want = sorted(set(group.values()))
    assert len(set(texts)) > len(want) > 12
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in stages.drop_near_duplicates(spark, docs, "").collect()) == want


def test_mix_repeats_each_document_as_often_as_it_is_taken(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), "abc"[min(i % 5, 2)]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {x.doc_id: x.taken for x in mixing.mixed(docs).collect()}
    size = {i: len(re.findall(mixing.WORD, t)) for i, t, _ in rows}
    want = {i: int(taken[i] / size[i] + 0.5) for i in size if size[i]}
    got = Counter(x.doc_id for x in stages.mix_sources(spark, docs, "").collect())
    assert got == Counter({i: n for i, n in want.items() if n}) and len(set(want.values())) > 1


def test_stages_keep_columns_whose_names_they_might_use(spark, monkeypatch):
    """Extra columns stay as they are, and every row of a repeated document is one of its own."""
    monkeypatch.setattr(toxicity, "train", lambda *a: None)
    monkeypatch.setattr(toxicity, "score", lambda text, model: text.cast("double"))
    odd = ["_score", "_s", "_fp", "_v", "_row", "_pass", "_key", "_times", "_piece", "h", "size", "taken", "row", "lo", "rep"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in odd)
    rows = [(i, "0.1" if i % 2 else "0.9", "s", *range(len(odd))) for i in range(6)]
    got = stages.drop_toxic(spark, spark.createDataFrame(rows, schema), DATA)
    assert got.columns == ["doc_id", "text", "source", *odd]
    assert sorted(tuple(r) for r in got.collect()) == [r for r in rows if r[1] == "0.1"]
    docs = spark.createDataFrame([(1, A, "s", *range(len(odd))), (2, near(A), "s", *range(len(odd))), (3, B, "s", *range(len(odd)))], schema)
    found = stages.drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns and sorted((r.doc_id, r._v, r.rep) for r in found.collect()) == [(1, 3, 14), (3, 3, 14)]
    same = spark.createDataFrame([(1, A, "s", *range(len(odd)))] * 5 + [(None, B, "s", *range(len(odd)))] * 4, schema)
    mixed = stages.mix_sources(spark, same, "")
    assert mixed.columns == same.columns
    out = mixed.collect()
    assert abs(len(out) - 13) <= 2 and all(tuple(r)[3:] == tuple(range(len(odd))) for r in out)  # one and a half times 9 rows


def test_near_duplicates_of_the_largest_ids(spark):
    big = 2**63 - 2
    rows = [(big, f"text number {k} of this id with words of its own {k * 7}") for k in range(6)] + [(big + 1, "text number 0 of this id with words of its own 0"), (-(2**63), "another text altogether, far from all the others here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, "").collect())
    assert kept == Counter([r for r in rows if r[0] != big + 1])


def test_a_broken_number_of_times_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="1.5"):
        mixing.mixed(docs, most=1.5)
