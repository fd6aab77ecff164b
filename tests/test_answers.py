"""The answer store with clients that count their calls in files."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from firmlens.functions import declared
from firmlens.operators import answers

KIND = declared.record({"n": declared.WHOLE})


def counting_client(log: str, bad=()):
    """Answers with the prompt's length; every prompt that reaches it leaves a file."""

    def make_client():
        def answer(batch):
            out = []
            for prompt in batch:
                (Path(log) / uuid.uuid4().hex).write_text(prompt)
                out.append(None if prompt in bad else json.dumps({"n": len(prompt)}))
            return out

        return answer

    return make_client


@pytest.fixture
def place(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log"), str(tmp_path / "store")


def calls(log):
    return sorted(f.read_text() for f in Path(log).iterdir())


def ask(spark, rows, place, bad=(), **options):
    prompts = spark.createDataFrame(rows, "id int, prompt string")
    found = answers.answer(prompts, counting_client(place[0], bad), ["id"], place[1], "v1", **options)
    return {r.id: r.raw for r in found.collect()}


def test_equal_prompts_are_asked_once_and_never_again(spark, place):
    rows = [(i, f"p{i % 3}") for i in range(60)]
    wanted = {i: '{"n": 2}' for i in range(60)}
    assert ask(spark, rows, place) == wanted
    assert calls(place[0]) == ["p0", "p1", "p2"]
    assert ask(spark, rows, place) == wanted
    assert calls(place[0]) == ["p0", "p1", "p2"]
    assert ask(spark, [*rows, (60, "more")], place)[60] == '{"n": 4}'
    assert calls(place[0]) == ["more", "p0", "p1", "p2"]


def test_failures_are_asked_a_stated_number_of_times(spark, place):
    rows = [(1, "good"), (2, "bad"), (3, None)]
    assert ask(spark, rows, place, bad=("bad",), tries=2) == {1: '{"n": 4}', 2: None, 3: None}
    assert calls(place[0]) == ["bad", "bad", "good"]
    # A later run with the same allowance asks nothing, one with more goes on, and an answer ends it.
    assert ask(spark, rows, place, bad=("bad",), tries=2)[2] is None
    assert len(calls(place[0])) == 3
    assert ask(spark, rows, place, tries=4)[2] == '{"n": 3}'
    assert ask(spark, rows, place, tries=9)[2] == '{"n": 3}'
    assert calls(place[0]) == ["bad", "bad", "bad", "good"]


def test_answers_that_are_not_accepted_count_as_failed(spark, place):
    fits = lambda raw: declared.read(raw, KIND)["value"]["n"] > 3
    assert ask(spark, [(1, "long enough"), (2, "no")], place, accept=fits) == {1: '{"n": 11}', 2: None}
    assert calls(place[0]) == ["long enough", "no", "no", "no"]


def test_versions_do_not_share_answers(spark, place):
    prompts = spark.createDataFrame([(1, "x")], "id int, prompt string")
    for version in ("v1", "v2", "v1"):
        answers.answer(prompts, counting_client(place[0]), ["id"], place[1], version).collect()
    assert calls(place[0]) == ["x", "x"]
    digests = spark.range(1).select(
        answers.prompt_digest(F.lit("b"), "a"), answers.prompt_digest(F.lit(""), "a1:b"), answers.prompt_digest(F.lit("1:b"), "")
    )
    assert len(set(digests.first())) == 3


def test_no_prompts(spark, place):
    assert ask(spark, [], place) == {}


def test_compacted_store_answers_alike(spark, place, tmp_path):
    rows = [(1, "good"), (2, "bad")]
    ask(spark, rows, place, bad=("bad",), tries=2)
    ask(spark, rows, place, bad=("bad",), tries=2)
    target = str(tmp_path / "compact")
    answers.compact(spark, place[1], target)
    before = sorted(map(tuple, answers.known(spark, place[1]).collect()))
    assert sorted(map(tuple, answers.known(spark, target).collect())) == before
    assert ask(spark, rows, (place[0], target), bad=("bad",), tries=2)[1] == '{"n": 4}'
    assert len(calls(place[0])) == 3
