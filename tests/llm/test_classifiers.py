"""Both classifiers by their accuracy on rows that they have not learned from."""

import zlib

import numpy as np
import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from firmlens.llm import quality, subwords, toxicity
from firmlens.llm.queries import op2_toxicity, op5_quality

SF_DIR = "/root/testdata/sf0.1"


def area(scores, labels):
    """The chance that a row of label 1 scores above one of label 0."""
    order = np.argsort(np.argsort(scores))
    ones = labels == 1
    return (order[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


@pytest.mark.parametrize(
    "query, label, parts, rest, least, share",
    [(op2_toxicity, "toxic", 3, 1, 0.7, 0.93), (op5_quality, "quality", 5, 0, 0.3, 0.95)],
)
def test_held_out_rows(spark, query, label, parts, rest, least, share):
    rows = query(spark, SF_DIR).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    truth = np.array([labels[r.doc_id] for r in held])
    assert area(np.array([r.score for r in held]), truth) > share
    assert (np.array([r.predicted for r in held]) == truth).mean() > share


def test_scores_do_not_depend_on_labels_of_the_row(spark):
    texts = [("good plain words here", 0), ("you idiot idiot", 1)] * 40
    model = toxicity.train(texts)
    assert toxicity.Scorer(model).score("what an idiot") > toxicity.Scorer(model).score("what plain words")
    assert toxicity.train([("a", 1)] * 5) is None and quality.train([]) is None


def test_words_of_few_texts_are_learned_too():
    texts = [("good plain words here", 0), ("what an idiot", 1)] * 30
    texts[5], texts[6] = ("xyzzq", 1), ("wvvkj", 0)  # neither is set aside
    model = toxicity.train(texts)
    score = toxicity.Scorer(model).score
    assert score("xyzzq") > score("never seen") > score("wvvkj")
    held = {b for i, (x, _) in enumerate(texts) if i % toxicity.SET_ASIDE for w in x.split() for b in subwords.buckets_of(w)}
    assert {*np.flatnonzero(model.table.any(axis=1))} == held


def test_odd_documents(spark):
    docs = odd_documents(spark)
    bad = toxicity.train([("plain words", 0), ("idiot", 1)] * 20)
    good = quality.train([("plain words", 1), ("%%% ###", 0)] * 20)
    for scored, name in ((toxicity.score(docs, bad), "toxicity"), (quality.score(docs, good), "score")):
        scores = [r[name] for r in scored.collect()]
        assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(docs, bad).columns == [*docs.columns, "toxicity"]
    assert toxicity.score(no_documents(spark), bad).count() == quality.score(no_documents(spark), good).count() == 0
    assert {r.toxicity for r in toxicity.score(docs, None).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, None).collect()} == {1.0}


def test_samples_are_bounded_and_skip_unusable_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(60, "x" * 99)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (4, 7), (60, 1)], "doc_id long, toxic int")
    sample = subwords.labelled_sample(docs, labels, "toxic", F.lit(True), 10, 50)
    assert sorted(y for _, y in sample) in ([0] * 10 + [1] * 10, [0] * 10 + [1] * 9)
    assert all(int(t.split()[1]) % 2 == y for t, y in sample)


def test_long_texts_take_no_place_and_are_sampled_too(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (90 if i < 40 else 9)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40 or i % 2)) for i in range(60)], "doc_id long, toxic int")
    sample = subwords.labelled_sample(docs, labels, "toxic", F.lit(True), 10, 50)
    assert sorted(y for _, y in sample) == [0] * 10 + [1] * 10 and max(len(t) for t, _ in sample) <= 50
    sample = subwords.labelled_sample(docs, labels, "toxic", F.lit(True), 10, 50, 300)
    assert [y for t, y in sample if len(t) > 50] == [1] * 3 and len(sample) == 23


def test_repeated_words_are_one_feature():
    assert quality.words_of("A a  b b B c") == ["a", "<again>", "b", "<again>", "<again>", "c"]


def test_text_without_spaces_is_read_to_its_end():
    long = "".join(f"{i}ñ語" for i in range(400))
    parts = subwords.pieces(["a", long, "b"])
    assert parts[0] == "a" and parts[-1] == "b" and max(map(len, parts)) <= 200
    got = {b for w in parts for b in subwords.buckets_of(w)}
    edged = f"<{long}>".encode()
    assert set(subwords.buckets_of(long)[1:]) <= got
    assert all(zlib.crc32(edged[i : i + 3], 3) % subwords.BUCKETS in got for i in range(len(edged) - 2))
    head, bad, good = "abc" * 200, "youidiot" * 30, "nicetext" * 30
    texts = [(f"{head}{bad}", 1), (f"{head}{good}", 0)] * 30
    score = toxicity.Scorer(toxicity.train(texts)).score
    assert score(f"{head}xy{bad}z") > 0.7 > score(f"{head}xy{good}z")
    score = quality.Scorer(quality.train([(x, 1 - y) for x, y in texts])).score
    assert score(f"{head}xy{bad}z") < 0.45 < 0.55 < score(f"{head}xy{good}z")


def test_buckets_are_equal_whether_kept_or_not(monkeypatch):
    words = ["one", "two", "three", "four"]
    kept = subwords.Spans(words)
    monkeypatch.setattr(subwords, "KEPT_CHARS", 7)
    monkeypatch.setattr(subwords, "FILLED_CHARS", 4)
    some = subwords.Spans(words)
    assert some.kept == 2 and all(list(kept[i]) == list(some[i]) == subwords.buckets_of(w) for i, w in enumerate(words))
    assert list(subwords._parts(words)) == [["one", "two"], ["three"], ["four"]]


def test_language_is_guessed_from_the_text():
    scorer = toxicity.Scorer(toxicity.train([("plain words", 0), ("idiot", 1)] * 20))
    assert [scorer.probability(x)[1] for x in ("the dog and this", "der und nicht", "les des une", "los y con", "zzz")] == ["en", "de", "fr", "es", ""]
