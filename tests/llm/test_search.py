"""Top-k search and benchmark decontamination, held against brute force."""

import random

import numpy as np
import pytest
from cases import no_documents, odd_documents, prose
from pyspark.sql import functions as F

from firmlens.llm import decontaminate, topk
from firmlens.llm.queries import op3_topk, op4_decontamination

SF_DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score long, length string"


def brute_topk(rows, is_query, k=5):
    numbers = [(i, np.floor(256 * np.array(v, np.float64)).astype(object)) for i, v in rows]
    out = []
    for q, own in numbers:
        if is_query(q):
            scores = [(-int(own.dot(v)), i) for i, v in numbers if i != q and len(v) == len(own)]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_topk_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    found = sorted(map(tuple, op3_topk(spark, SF_DIR).collect()))
    assert found == brute_topk(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("block", [3, 4096])
def test_all_ways_of_pruning(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "HEAD", 8)
    rng = np.random.default_rng(block)
    base = rng.normal(size=(4, 6))
    rows = []
    for i in range(400):
        length = 10.0 ** int(rng.integers(-2, 3))
        near = base[i % 4] + rng.normal(size=6) * (0.01 if i % 3 else 1)
        rows.append((i, [float(np.float32(x)) for x in near * length]))
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(2000, [0.0] * 6), (2004, [0.0] * 6), (2008, [1.0, 2.0]), (2012, [3.0, -1.0]), (2016, [])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    found = topk.search(frame, F.col("vec_id") % 4 == 0, block=block).collect()
    assert sorted(map(tuple, found)) == brute_topk(rows, lambda i: i % 4 == 0)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    found = topk.search(frame, F.lit(True)).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 5, 65536), (5, 1, 0, 65536)]
    assert topk.search(frame.where("false"), F.lit(True)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(3_000_000 + i), float(2_999_999 - 2 * i)]) for i in range(20)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    assert sorted(map(tuple, topk.search(frame, F.lit(True)).collect())) == brute_topk(rows, lambda i: True)


def least_edits(item, text):
    last = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        now = [i]
        for j, other in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (word != other)))
        last = now
    return min(last)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        item = [rng.choice("abc") for _ in range(rng.randint(1, 90 if rng.random() < 0.1 else 9))]
        text = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        assert decontaminate.edit_distance(item, text)[0] == least_edits(item, text)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        kind, place = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[place] = "other"
        elif kind == 1:
            words.insert(place, "more")
        else:
            del words[place]
    return words


def test_edited_items_are_found(spark):
    rng = random.Random(4)
    items = [(i, prose(12 + 3 * i, 900 + i)) for i in range(15)] + [(50, None), (51, "!?"), (None, "x")]
    docs, wanted = [], set()
    for n in range(300):
        item_id, item = items[n % 15]
        words = decontaminate.words_of(item)
        allowed = decontaminate.edits_allowed(len(words))
        edits = rng.choice([0, 1, allowed, allowed + 3])
        inside = edited(words, min(edits, len(words) - 1), rng)
        text = [*prose(rng.randrange(40), n).split(), *inside, *prose(rng.randrange(40), 10_000 + n).split()]
        docs.append((n, " ".join(text).title()))
    for n, text in docs:
        for item_id, item in items[:15]:
            words = decontaminate.words_of(item)
            if least_edits(words, decontaminate.words_of(text)) <= decontaminate.edits_allowed(len(words)):
                wanted.add((n, item_id))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_items in (20_000, 5):
        found = decontaminate.find_leaks(frame, bench, block_items=block_items)
        found = {(r.doc_id, r.item_id) for r in found.select("doc_id", F.inline("leaks")).collect()}
        assert found <= wanted
        assert len(found) >= 0.99 * len(wanted)


def distinct(name, count):
    return [f"{name}{i}" + "x" * (i * 7 % 5) for i in range(count)]


def leaked(item, texts):
    finder = decontaminate.Finder(decontaminate.Items([(1, item)]))
    return [[(x["item_id"], x["edits"]) for x in found] for found in finder.find([" ".join(t) for t in texts])]


def test_cut_heads_and_runs_of_insertions_are_found():
    for size in (15, 20, 40, 59):
        for n in range(20):
            item, allowed = distinct(f"i{n}w", size), decontaminate.edits_allowed(size)
            third = size // 3
            # As many words as may differ, and one more.
            for edits, wanted in ((allowed, [(1, allowed)]), (allowed + 1, [])):
                run = distinct("other", edits)
                before, after = distinct("before", 30), distinct("after", 30)
                texts = [
                    [*item[edits:], *after],
                    item[edits:],
                    [*before, *item[:-edits]],
                    [*before, *item[:third], *run, *item[third:], *after],
                ]
                assert leaked(item, texts) == [wanted] * len(texts)


@pytest.mark.parametrize("size", [200, 400])
def test_long_items_are_found(size):
    texts, item, allowed = [], distinct("i", size), decontaminate.edits_allowed(size)
    for n in range(60):
        run = edited(item, allowed, random.Random(n))
        texts.append([*distinct("before", n), *run, *distinct("after", n)])
    assert all(len(found) == 1 for found in leaked(item, texts))


def test_one_anchor_left_reaches_the_recall():
    """All anchors but one are replaced: one window alone has to agree in some table."""
    found, count = {}, {5: 200, 8: 300, 10: 300, 15: 300, 20: 300, 31: 300, 59: 300, 200: 60, 400: 30}
    for size in count:
        rng, allowed, found[size] = random.Random(size), decontaminate.edits_allowed(size), 0
        for n in range(count[size]):
            item = [f"i{n}w{i}" for i in range(size)]
            rng.shuffle(item)
            item = [w + "x" * rng.randrange(9) for w in item]
            anchors = sorted(range(size), key=lambda i: (-len(item[i]), i))[: allowed + 1]
            left = rng.choice(anchors)
            run = [f"other{i}" if i in anchors and i != left else w for i, w in enumerate(item)]
            found[size] += len(leaked(item, [[*distinct("before", 9), *run, *distinct("after", 9)]])[0])
    assert sum(found.values()) >= decontaminate.RECALL * sum(count.values())
    # Each size by itself, but for three standard deviations of its draws.
    assert all(found[x] >= decontaminate.RECALL * n - 3 * (n * (1 - decontaminate.RECALL)) ** 0.5 for x, n in count.items())


def test_tables_grow_with_the_recall_not_with_the_length():
    for shape in ((4, 8), (16, 16), (0, 32)):
        tables = [decontaminate.tables_for(shape, recall=recall) for recall in (0.5, 0.9, 0.99)]
        assert tables == sorted(tables) and tables[0] < tables[-1]
    # Sixteen times the length.
    assert decontaminate.tables_for((256, 256)) <= 4 * decontaminate.tables_for((16, 16))
    assert decontaminate.tables_for((16, 16), similarity=1.0) == 1


def test_candidates_come_from_the_tables():
    item = distinct("i", 30)
    block = decontaminate.Items([(1, item)])
    assert decontaminate.Finder(block).find([" ".join(item)])[0]
    block.tables = {shape: [] for shape in block.tables}
    assert decontaminate.Finder(block).find([" ".join(item)]) == [[]]


def test_clean_and_odd_documents(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "some words of a question that no document holds at all")], "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench)
    assert found.columns == [*docs.columns, "leaks"]
    assert found.where("size(leaks) = 0").count() == docs.count()
    assert decontaminate.find_leaks(no_documents(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).where("size(leaks) = 0").count() == docs.count()


def test_decontamination_query(spark):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    wanted = set()
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        words = decontaminate.words_of(r.text)
        wanted |= {
            (r.doc_id, i) for i, item in items if decontaminate.edit_distance(item, words)[0] <= decontaminate.edits_allowed(len(item))
        }
    assert {(r.doc_id, r.item_id) for r in op4_decontamination(spark, SF_DIR).collect()} == wanted
