"""Alignment of two tokenizers against a plain computation over tokens and pairs."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import no_documents, odd_documents
from tokenizers import Tokenizer

from firmlens.llm import alignment
from firmlens.llm.queries import both_vocabularies, op13_alignment

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    """Texts to (id, bytes) of both sides, read in another way than the operator does."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().split()
    names = {int(i): base64.b64decode(x) for x, i in zip(ranks[::2], ranks[1::2], strict=True)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if name.startswith("<0x") else name.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        ours = [(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        theirs = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        if any(b"".join(x for _, x in side) != whole for side in (ours, theirs)):
            return [], []
        return ours, theirs

    return encode


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute_groups(a, b):
    """(end, A ids, B ids) of each group."""
    both = sorted({e for _, _, e in a} & {e for _, _, e in b})
    out, at = [], [0, 0]
    for end in both:
        inside = ([], [])
        for k, side in enumerate((a, b)):
            while at[k] < len(side) and side[at[k]][2] <= end:
                inside[k].append(side[at[k]][0])
                at[k] += 1
        out.append((end, *inside))
    return out


def brute_links(a, b):
    out, j = [], 0
    for i, s, e in a:
        while j < len(b) and b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def brute_alignment(texts, encode):
    found = []
    for text in texts:
        a, b = map(spans, encode(text))
        found.append((a, b, brute_links(a, b)))
    counts = Counter(pair for _, _, links in found for pair in set(links))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for a, b, links in found:
        groups = brute_groups(a, b)
        listed = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for _, x, y in groups)
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        out.append(
            (len(a), len(b), len(ends), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links))
            + (hashlib.sha256(listed.encode()).hexdigest() if a else "",)
        )
    return out, counts, most


def check_rows(rows, docs, encode):
    key = lambda r: (repr(r[0]), repr(r[1:]))
    wanted, _, _ = brute_alignment([t for _, t in docs], encode)
    wanted = [(i, *w) for (i, _), w in zip(docs, wanted, strict=True)]
    found = [tuple(r[c] for c in COLUMNS) for r in rows]
    for w, f in zip(sorted(wanted, key=key), sorted(found, key=key), strict=True):
        assert f == w


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_pointer_jumping_finds_common_ends():
    rng = random.Random(4)
    for _ in range(400):
        size = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, size + 1), rng.randrange(1, size + 1)), size}) for _ in range(2))
        last = alignment.terminals(np.array(a), np.array(b))
        ends = [*a, *b]
        common = sorted(set(a) & set(b))
        for node, to in enumerate(last.tolist()):
            assert to >= len(a) and ends[to] == min(e for e in common if e >= ends[node])


def test_one_long_chain():
    """No common end but the last: doubling needs few rounds, and one group comes out."""
    a, b = np.append(np.arange(2, 200_000, 2), 200_001), np.arange(1, 200_002, 2)
    assert set(alignment.terminals(a, b).tolist()) == {len(a) + len(b) - 1}


def test_segments_give_the_ids_of_whole_texts():
    """The short ways, segment by segment, against the libraries over whole texts."""
    words = alignment.Vocabularies(*both_vocabularies())
    assert words.short_a and words.short_b
    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\r\n", "\t", "a", "The", "Über", "straße", "it's", "'LL", "'", '"', "12", "3456", ".", "...", "—", "x" * 40, "tion", "é", "ß,"]
    odd = ["\u00a0", "日本", "🙂", "▁", "<s>", "<|endoftext|>", "\x00", "ª", "²", "\u2028"]
    for n in range(4000):
        text = "".join(rng.choice(parts + odd * (n % 4 == 0)) for _ in range(rng.randrange(1, 12)))
        whole = words._whole_a(" " + text), words._whole_b(" " + text)
        wanted = (b"", b"") if None in whole else whole
        assert tuple(x.tobytes() for x in words.encode(text)) == wanted, repr(text)


def test_alignment_query(spark, sides):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = op13_alignment(spark, SF_DIR)
    assert found.columns == COLUMNS
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    rows = found.collect()
    assert sum(r.n_links for r in rows) > 0
    check_rows(rows, texts_of(docs), sides)


def test_odd_documents_and_small_chunks(spark, sides, monkeypatch):
    docs = odd_documents(spark)
    for text in ("▁a", "<|endoftext|><s>", "a  b\r\n\tc", "\x00", "ﬁ é", "<0x41>", " ", "naïve 日本語テキスト 🙂🙂"):
        docs = docs.unionByName(docs.limit(1).selectExpr("doc_id", f"'{text}' as text", "score", "kept", "rank", "ids", "part"))
    from firmlens.functions.lineage import cut

    docs = cut(docs)
    rows = alignment.align(docs, both_vocabularies).collect()
    assert len(rows) == docs.count()
    check_rows(rows, texts_of(docs), sides)
    key = lambda r: (repr(r.doc_id), repr(r))
    again = alignment.align(docs.repartition(5), both_vocabularies).collect()
    assert sorted(again, key=key) == sorted(rows, key=key)


def test_chunks_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "CHUNK_CHARS", 10)
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 3)
    texts = ["a" * n for n in (3, 3, 3, 3, 30, 1, 9, 2)] + [None, "", "x", "y", "z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    chunks = [(ids.to_pylist(), t) for ids, t in alignment._chunks([batch])]
    assert [x for ids, _ in chunks for x in ids] == list(range(len(texts)))
    assert [x for _, t in chunks for x in t] == texts
    assert all(len(t) == 1 or (len(t) <= 3 and sum(len(x or "") for x in t) <= 10) for _, t in chunks)


def test_groups_and_pairs(spark, sides):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("n_chars < 1500")
    groups = {}
    for r in alignment.token_groups(docs, both_vocabularies).collect():
        groups.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert groups.keys() == {i for i, t in texts.items() if sides(t)[0]}
    for i, found in groups.items():
        found.sort(key=lambda r: r.group)
        wanted = brute_groups(*map(spans, sides(texts[i])))
        assert [(r.end, r.a_ids, r.b_ids) for r in found] == wanted
        assert [r.start for r in found] == [0, *(e for e, _, _ in wanted[:-1])]
        assert [r.group for r in found] == list(range(len(found)))
    _, counts, most = brute_alignment(list(texts.values()), sides)
    pairs = alignment.pair_counts(alignment.encoded(docs, both_vocabularies)).collect()
    assert {(r.a, r.b): (r.docs, r.best) for r in pairs} == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_no_documents(spark):
    found = alignment.align(no_documents(spark), both_vocabularies)
    assert found.columns == COLUMNS and found.count() == 0
    assert alignment.token_groups(no_documents(spark), both_vocabularies).count() == 0
