"""Near-duplicates, line templates and components, held against brute force."""

import collections
import random
import re

import pytest
from cases import no_documents, odd_documents, prose
from pyspark.sql import functions as F

from firmlens.llm import line_templates, near_dup
from firmlens.llm.components import join_components
from firmlens.llm.queries import op6_near_dup, op7_line_templates

SF_DIR = "/root/testdata/sf0.001"


class Groups(dict):
    def find(self, x):
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_components(docs, words=4, percent=80):
    sets = {}
    for doc_id, text in docs:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", lower)
        size = max(1, len(found) - words + 1)
        sets[doc_id] = {tuple(found[i : i + words]) for i in range(size)} if found else set()
    groups = Groups({d: d for d in sets})
    holders = collections.defaultdict(list)
    for doc_id, shingles in sets.items():
        common = collections.Counter(other for s in shingles for other in holders[s])
        for other, n in common.items():
            if 100 * n >= percent * (len(shingles) + len(sets[other]) - n):
                groups.join(doc_id, other)
        for s in shingles:
            holders[s].append(doc_id)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def check(rows, docs, **how):
    wanted = brute_components(docs, **how)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def changed(text, edits, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_dup_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(op6_near_dup(spark, SF_DIR).collect(), docs)


def test_chains_and_large_groups(spark):
    base, other = prose(300, 1), prose(300, 2)
    docs = [(i, changed(base, i % 6, i)) for i in range(150)]
    chain = base
    for i in range(150, 190):  # each step near the last, the ends far apart
        chain = changed(chain, 5, i)
        docs.append((i, chain))
    docs += [(200 + i, other) for i in range(300)]  # copies
    docs += [(600 + i, changed(other, 30, i)) for i in range(20)]  # alike, but not enough
    docs += [(700, "one two"), (701, "ONE two"), (702, "one two three"), (703, "É x"), (704, "é x")]
    rows = near_dup.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    check(rows, docs)


def test_large_group_just_below_the_threshold_writes_no_pairs(spark, monkeypatch):
    base, n = prose(300, 4), 400
    docs = [(i, changed(base, 11, i)) for i in range(n)]  # most pairs at 0.72 to 0.8, few above it
    docs += [(1000 + i, changed(text, 2, i)) for i, (_, text) in enumerate(docs[:10])]
    written, cut = [], near_dup.cut

    def counted(df, *how):
        out = cut(df, *how)
        written.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "cut", counted)
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    check(near_dup.components(frame).collect(), docs)
    assert max(written) <= near_dup.BANDS * len(docs) * 2 < len(docs) ** 2 / 4


def test_block_gives_back_links_that_span_it():
    import numpy as np
    import pandas as pd

    texts = [changed(prose(200, 5), 2, i) for i in range(60)] + [prose(200, 6)] * 2
    sets = [near_dup.Shingles().of(t) for t in texts]
    rows = [(0, 0, 0, 0, right, i, i, near_dup.signature(s), s.tobytes()) for right in (False, True) for i, s in enumerate(sets)]
    columns = [*near_dup._BLOCK, "right", "node", "component", "signature", "hashes"]
    block = pd.DataFrame(rows, columns=columns)
    signatures = near_dup._signatures(block["signature"])
    first = signatures[:, : near_dup.ROWS]
    block = block[(first == first[0]).all(axis=1)]  # those that share the bucket of band 0
    links = near_dup._spanning_links(block, 0.8, 80)
    assert len(block) > 20 and len(links) == block["node"].nunique() - 1
    block = block.assign(band=1)  # pairs of an earlier band are not compared again
    assert near_dup._spanning_links(block, 0.8, 80).empty and not np.any(links["a"] >= links["b"])


def test_similarity_just_at_the_threshold(spark):
    words = [f"w{i}" for i in range(13)]
    docs = [(1, " ".join(words[:12])), (2, " ".join([*words[:11], "z"])), (3, " ".join(words))]
    rows = near_dup.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(rows, docs)  # 8 of 10: linked; 9 of 10: linked


def test_odd_documents(spark):
    rows = near_dup.components(odd_documents(spark)).collect()
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.n_shingles > 0, r.component_id, r.kept))
    assert by_id[1] == {(True, 1, True)} and by_id[7] == {(True, 1, False)}
    assert by_id[2] == {(False, 2, True)} and by_id[4] == {(False, 4, True)}
    assert by_id[None] == {(True, None, True), (False, None, True)}
    assert len(rows) == 11
    kept = near_dup.drop_near_duplicates(odd_documents(spark), 5)
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8]


def test_no_documents(spark):
    assert near_dup.components(no_documents(spark)).count() == 0
    assert line_templates.find_recurring(no_documents(spark)).count() == 0


def test_sequential_test_keeps_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**32, (20_000, near_dup.HASHES), dtype=np.int64).astype(np.uint32)
    for similarity, least, most in ((0.8, 0.9999, 1), (0.3, 0, 0.001)):
        right = np.where(rng.random(left.shape) < similarity, left, left + 1)
        share = (near_dup.agreements(left, right, 0.8) >= 0).mean()
        assert least <= share <= most


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(200, 200)]
    nodes = sorted({x for e in edges for x in e})
    labels = spark.createDataFrame([(n, n) for n in nodes], "node long, component long")
    found = join_components(labels, spark.createDataFrame(edges, "a long, b long")).collect()
    groups = collections.defaultdict(set)
    for r in found:
        groups[r.component].add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(1, 60)), list(range(100, 161)), [200]]


def brute_lines(docs, copy=None):
    def tokens(line):
        words = line.split()
        if len(words) < line_templates.MIN_TOKENS:
            return words
        return ["<*>" if re.search("[0-9]", t) else t for t in words]

    def enough(words):
        return len(words) >= line_templates.MIN_TOKENS or len("".join(words)) >= line_templates.MIN_CHARS

    kinds = collections.defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if enough(line.split()):
                kinds[tuple(tokens(line))].add(doc_id)
    leaf = lambda m: (len(m), m[: line_templates.DEPTH])
    leaves = collections.Counter(map(leaf, kinds))
    support = collections.defaultdict(set)
    for kind, holders in kinds.items():
        for i, t in enumerate(kind):
            support[leaf(kind), i, t] |= holders
    template = {}
    for kind in kinds:
        fixed = tuple(t if t != "<*>" and len(support[leaf(kind), i, t]) >= 2 else None for i, t in enumerate(kind))
        general = leaves[leaf(kind)] > 1 and sum(t is not None for t in fixed) >= line_templates.FIXED * len(kind)
        template[kind] = (leaf(kind), fixed) if general else kind
    where = collections.defaultdict(set)
    for kind, holders in kinds.items():
        where[template[kind]] |= holders
    out = {}
    for doc_id, text in docs:
        lines = [tuple(tokens(x)) for x in (text or "").split("\n")]
        again = [i for i, k in enumerate(lines) if k in kinds and len(where[template[k]]) > 1]
        drop = [i for i in again if doc_id != min(where[template[lines[i]]])]
        again_tokens, all_tokens = sum(len(lines[i]) for i in again), sum(map(len, lines))
        copied = copy is not None and bool(again) and again_tokens >= copy * all_tokens
        out[doc_id] = "" if copied else ",".join(map(str, drop))
    return out


def test_line_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = op7_line_templates(spark, SF_DIR).collect()
    assert {r.doc_id: r.dropped for r in rows} == brute_lines(docs)
    assert all(r.n_dropped == len([x for x in r.dropped.split(",") if x]) for r in rows)
    assert sum(r.n_dropped for r in rows) > 20


def test_templates_with_fields_recur(spark):
    own = [prose(40, 50 + i).replace(" ", " z") for i in range(4)]
    docs = [
        (1, f"Page 3 of 10 in section A\n{own[0]}\nThe quick brown fox jumps over the lazy Anna"),
        (2, f"{own[1]}\nPage 14 of 90 in section A\nshort line here"),
        (3, f"{own[2]}\nThe quick brown fox jumps over the lazy Bert\nshort line here"),
        (4, f"{own[3]}\nThe quick brown cat looks under that green tree"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = line_templates.find_recurring(frame)
    texts = {r.doc_id: r.text for r in line_templates.drop_recurring(frame, found).collect()}
    assert texts[1] == docs[0][1]
    assert texts[2] == f"{own[1]}\nshort line here"
    assert texts[3] == f"{own[2]}\nshort line here"
    assert texts[4] == docs[3][1]


def test_long_passage_stays_in_one_document(spark):
    passage = prose(70, 3)
    docs = [(i, "\n".join([prose(90, 100 + i), passage, prose(90, 200 + i)])) for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = line_templates.drop_recurring(frame, line_templates.find_recurring(frame)).collect()
    assert sorted(r.doc_id for r in out if passage in r.text) == [0]
    assert all(prose(90, 100 + r.doc_id) in r.text and prose(90, 200 + r.doc_id) in r.text for r in out)


def test_copies_keep_what_only_they_have_unless_they_are_to_stay_whole(spark):
    copy = "\n".join(prose(30, i) for i in range(5))
    own = "and one more line that only this one has"
    docs = [(1, copy), (2, copy), (3, copy + "\n" + own)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = line_templates.drop_recurring(frame, line_templates.find_recurring(frame))
    assert sorted(map(tuple, out.collect())) == [(1, copy), (2, ""), (3, own)]
    out = line_templates.drop_recurring(frame, line_templates.find_recurring(frame, copy=0.5))
    assert sorted(map(tuple, out.collect())) == docs


def test_lines_without_spaces_recur_as_they_are(spark):
    long = "昔々あるところに2人のお爺さんとお婆さんが住んでいました"
    docs = [(1, f"{long}\n短い行"), (2, f"{long}\n短い行"), (3, long.replace("2", "3")), (4, "All rights reserved")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = line_templates.drop_recurring(frame, line_templates.find_recurring(frame))
    assert sorted(map(tuple, out.collect())) == [docs[0], (2, "短い行"), docs[2], docs[3]]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_support_counts_a_document_once(spark, min_docs):
    # Document 1 alone has "d" in two kinds of lines; the others bring kinds of their own.
    docs = [(1, "A B C d e\nA B C d f"), *[(i, f"A B C {'ghk'[i - 2]} e") for i in range(2, min_docs + 2)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = line_templates.find_recurring(frame, min_docs=min_docs)
    # "A B C <*> e" has four of five tokens fixed; "A B C d f" has three.
    out = {r.doc_id: r.text for r in line_templates.drop_recurring(frame, found).collect()}
    assert out == {1: docs[0][1], **{i: "" for i, _ in docs[1:]}}


def test_odd_documents_keep_rows_and_columns(spark):
    docs = odd_documents(spark)
    found = line_templates.find_recurring(docs)
    out = line_templates.drop_recurring(docs, found)
    assert out.columns == docs.columns
    # Rows 7 are copies of row 1, of one line: nothing is left of them, and all else is as it was.
    wanted = docs.withColumn("text", F.when(F.col("doc_id") == 7, "").otherwise(F.col("text")))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, wanted.collect()))
    whole = line_templates.drop_recurring(docs, line_templates.find_recurring(docs, copy=0.5))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.collect()))
    assert line_templates.report(docs, found).count() == docs.count()
