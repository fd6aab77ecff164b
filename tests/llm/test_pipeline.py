"""The pipeline, stage by stage, held against brute force on the smallest tables."""

import pytest
from cases import no_documents, odd_documents, prose
from test_duplicates import brute_components, brute_lines
from test_token_operators import by_library, check_pieces

import corpus_pipeline
from firmlens.llm import decontaminate
from firmlens.llm.queries import folder

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and what every stage makes of them."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = folder(spark, f"test-{name}")
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontamination", "packing"]
    for docs in stages[1:5]:
        assert docs.dtypes == stages[0].dtypes


def test_toxic_documents_go_and_others_stay_as_they_are(spark, stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[:2])
    assert all(before[i] == r for i, r in after.items())
    assert len(after) > 0.7 * len(before)


def test_recurring_lines_go(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[1:3])
    wanted = brute_lines([(i, r.text) for i, r in before.items()], corpus_pipeline.COPY)
    assert set(before) == set(after)
    for i, r in after.items():
        drop = {int(x) for x in wanted[i].split(",") if x}
        assert r.text == "\n".join(x for n, x in enumerate(before[i].text.split("\n")) if n not in drop)
        assert r.n_chars == len(r.text)


def test_one_of_each_group_stays(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    groups = brute_components([(i, r.text) for i, r in before.items()], words=5)
    assert set(after) == {i for i, (_, least) in groups.items() if i == least}


def test_documents_with_items_go(spark, stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[3:5])
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {
        i
        for i, r in before.items()
        if all(decontaminate.edit_distance(x, decontaminate.words_of(r.text))[0] > decontaminate.edits_allowed(len(x)) for x in items)
    }
    assert set(after) == clean


def test_all_tokens_are_packed(stages):
    documents = [(r.doc_id, by_library(r.text)) for r in stages[4].collect()]
    check_pieces(stages[5].collect(), documents, 2048)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_every_stage_takes_odd_documents(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        if name != "near_dup":
            assert out.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= docs.count()


def test_passage_of_half_a_document_stays_in_one(spark):
    passage = prose(60, 3)
    own = {i: prose(50, 100 + i) for i in range(1, 4)}
    docs = [(i, f"{own[i]}\n{passage}") for i in own]
    docs += [(i, f"{prose(20, 4)}\n{prose(80, 5)}") for i in (8, 9)]  # whole copies: one goes, the other stays whole
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_duplicates):
        frame = stage(spark, frame, SF_DIR)
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert texts == {1: docs[0][1], 2: own[2], 3: own[3], 8: docs[3][1]}
