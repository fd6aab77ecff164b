"""Encoding, packing and wavelet shards, held against the library and brute force."""

import random
import weakref
import zlib

import numpy as np
import pytest
from cases import no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from firmlens.llm import packing, token_ids, wavelet
from firmlens.llm.queries import op1_packing, op8_wavelet, vocabulary
from firmlens.llm.token_ids import Encoder

SF_DIR = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(vocabulary())
ENCODER = Encoder(vocabulary())


def by_library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aE'sdt .,\n\t<|>é×_9\x1c"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_those_of_the_whole_text(text):
    assert list(np.frombuffer(ENCODER.encode(text), "<u4")) == by_library(text)[:-1]


def check_pieces(pieces, documents, length):
    """Each id in one piece, no gap in a document or a sequence, none too long."""
    wanted = sorted((d, i, t) for d, ids in documents for i, t in enumerate(ids))
    found, places = [], {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        found += [(p["doc_id"] if p["doc_id"] is not None else -1, p["start"] + i, t) for i, t in enumerate(ids)]
        places.setdefault(p["sequence_id"], []).append((p["offset"], len(ids)))
    assert sorted(found) == wanted
    for pieces_of in places.values():
        at = 0
        for offset, size in sorted(pieces_of):
            assert offset == at
            at += size
        assert at <= length
    return len(places)


@pytest.mark.parametrize("length, windows, fan_in", [(2048, 64, 64), (128, 4, 2), (16, 1, 2)])
def test_packing_keeps_every_id(spark, length, windows, fan_in):
    docs = odd_documents(spark)
    documents = [(-1 if r.doc_id is None else r.doc_id, by_library(r.text)) for r in docs.collect()]
    pieces = packing.pack_documents(docs, vocabulary, length, windows, fan_in).collect()
    sequences = check_pieces(pieces, documents, length)
    total = sum(len(ids) for _, ids in documents)
    assert sequences == -(-total // length)


def test_packer_prefers_the_best_fit():
    packer = packing.Packer(10, 2, 0, 0)
    for doc_id, size in enumerate([6, 8, 4, 2]):
        packer.add((doc_id, 0, bytes(4 * size), size))
    assert [(r[0], r[4]) for r in packer.rows] == [(0, 0), (2, 0), (1, 1), (3, 1)]
    packer.add((4, 0, bytes(4 * 7), 7))
    packer.add((5, 0, bytes(4 * 6), 6))
    packer.add((6, 0, bytes(4 * 5), 5))  # fits none: the fullest is topped up with its head
    assert packer.rows[-2:] == [(4, 0, bytes(28), 7, 2, 0, True, 0), (6, 0, bytes(12), 5, 2, 7, True, 0)]


def test_packing_of_nothing(spark):
    assert packing.pack_documents(no_documents(spark), vocabulary).count() == 0


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    ids = {r.doc_id: by_library(r.text) for r in docs}
    rows = op1_packing(spark, SF_DIR).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == crc(own[r.start : r.start + r["length"]])
    sequences = len({r.sequence_id for r in rows})
    assert sum(map(len, ids.values())) / (sequences * 2048) > 0.98


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix(size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 300, size).astype(np.uint32)
    matrix = wavelet.Shard(wavelet.write_shard([5], [size], ids)).matrix
    assert (matrix.decode() == ids).all()
    for at in random.Random(1).sample(range(size), min(size, 60)):
        value = int(ids[at])
        assert matrix.access(at) == value
        assert matrix.rank(value, at) == (ids[:at] == value).sum()
        assert matrix.select(value, matrix.rank(value, at)) == at
    for value in (0, 77, 299, 300, 1 << 20):
        assert matrix.count(value) == (ids == value).sum()
    with pytest.raises(IndexError):
        matrix.select(301, 0)
    with pytest.raises(IndexError):
        matrix.access(size)


def test_shards_in_order_of_ids(spark, tmp_path):
    docs = odd_documents(spark)
    wavelet.write_tokens(docs, str(tmp_path / "t"), vocabulary, partitions=3, shard_tokens=50)
    rows = wavelet.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    wanted, at = [], 0
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
    for r in sorted(docs.collect(), key=key):
        ids = by_library(r.text)
        wanted.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in rows] == wanted
    assert spark.read.parquet(str(tmp_path / "t")).count() > 3


def test_shards_of_nothing(spark, tmp_path):
    wavelet.write_tokens(no_documents(spark), str(tmp_path / "t"), vocabulary)
    assert wavelet.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_wavelet_query(spark):
    rows = {r.doc_id: r for r in op8_wavelet(spark, SF_DIR).collect()}
    at = 0
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect():
        ids = by_library(r.text)
        assert tuple(rows[r.doc_id]) == (r.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_an_encoder_ends_with_its_task_and_its_cache_stays_small(monkeypatch):
    """Idle workers wait beside the next stage; what they keep counts as the executor's memory."""
    left = weakref.ref(token_ids.encoder(vocabulary))
    assert left() is None
    monkeypatch.setattr(token_ids, "CACHED_PIECES", 5)
    small, whole = token_ids.encoder(vocabulary), token_ids.encoder(vocabulary)
    for i in range(40):
        text = f"the word {chr(97 + i % 26)}{chr(97 + i // 26)}q of a list"
        assert small.encode(text) == whole._whole(text)
        assert "the" in small.pieces, "frequent pieces stay"
        assert i < 5 or len(small.pieces) + len(small.pieces.older) <= 2 * (5 + 6)
