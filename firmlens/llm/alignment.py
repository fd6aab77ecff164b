"""Alignment of two tokenizers over the same bytes: groups, links and how common they are.

A text is encoded twice: with a blank before it by a byte-level vocabulary (A), and as it is
by a piece vocabulary (B), which adds that blank itself. Both token sequences then cover the
same bytes, and byte offsets at which tokens of both end cut them into groups. Groups come
from pointer jumping: every token points to the farthest-right token of the other side that
it overlaps, or to itself where nothing reaches further; in each round all pointers are
replaced by their pointers' pointers at once, until none changes, and tokens with the same
terminal token are one group. Tokens of A and B whose bytes overlap are links; an id pair
counts as often as there are rows of the table, documents, that hold it linked.

Documents go through in chunks of some two megabytes of text, one row each. A chunk names each
of its id pairs once, with its number of documents; these dictionaries are counted, and each
chunk gets its own pairs' counts back. So a pair that every document has moves once a chunk,
links themselves never move, and no table of all pairs is held anywhere.

Null and empty texts, and texts that a vocabulary does not give back byte for byte (B reads
U+2581 as a blank), have no tokens: zeros and empty lists. Repeated rows and rows without
doc_id are documents of their own. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut
from firmlens.llm.token_ids import _byte_alphabet

CHUNK_CHARS = 2_000_000
CHUNK_DOCS = 5_000
_ID_BITS = 32


CACHED_SEGMENTS = 500_000  # the first met, among them nearly all frequent ones; the others are encoded each time
CACHED_CHARS = 32
_NO_IDS = np.empty(0, "<u4")
_ALPHABET = _byte_alphabet()

# How the byte-level vocabulary cuts texts before it merges, for texts of the characters below.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_A_SEGMENTS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\r{_LETTERS}0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)
_A_PLAIN = re.compile(rf"[ -~\t\n\r{_LETTERS}«»¡¿‐-―‘-”•…]*")
# No piece has a blank after another character, or a line feed: nothing merges across these.
_B_SEGMENTS = re.compile(" +[^ \n]*|\n|[^ \n]+")


def _checked(ids: list[int], bytes_of: list[bytes], text: str) -> bytes | None:
    """The ids, packed, if their tokens are the bytes of the text."""
    if b"".join(map(bytes_of.__getitem__, ids)) != text.encode():
        return None
    return np.array(ids, "<u4").tobytes()


class _Segments(dict):
    """Segment -> packed ids (null if they are other bytes), filled from the model on first use."""

    def __init__(self, model: Callable[[str], list[int]], bytes_of: list[bytes]):
        super().__init__()
        self.model, self.bytes_of = model, bytes_of

    def __missing__(self, segment: str) -> bytes | None:
        ids = _checked(self.model(segment), self.bytes_of, segment)
        if len(segment) <= CACHED_CHARS and len(self) < CACHED_SEGMENTS:
            self[segment] = ids
        return ids


class Vocabularies:
    """Both vocabularies with the bytes of every token. One per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(_ALPHABET)}
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # Written ids: of A and B, each within its list and at the end of it.
        written = [(len(self.a_bytes), ","), (len(self.a_bytes), "|"), (len(self.b_bytes), ","), (len(self.b_bytes), ";")]
        self.written = [f"{i}{mark}".encode() for size, mark in written for i in range(size)]

        self.segments_a = _Segments(self._model_a, self.a_bytes)
        self.segments_b = _Segments(self._model_b, self.b_bytes)
        # The short ways are taken only where the vocabularies have what they rest upon.
        samples = [" It's 12 of.. \t\n  a1,b  ", " Ünïcode – «x»\r\n\n", "  '' 's'm 'LL"]
        self.short_a = all(self._by_segments(self.segments_a, _A_SEGMENTS, x) == self._whole_a(x) for x in samples)
        plain = [p for i, p in pieces if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.short_b = not any(re.search("[^▁]▁|\n", p) for p in plain) and all(
            self._by_segments(self.segments_b, _B_SEGMENTS, x) == self._whole_b(x) for x in samples
        )

    def _model_a(self, segment: str) -> list[int]:
        return [t.id for t in self.a.model.tokenize("".join(_ALPHABET[b] for b in segment.encode()))]

    def _model_b(self, segment: str) -> list[int]:
        if segment.startswith(" ") and not segment.isspace():
            return self.b.encode(segment[1:])
        # A line feed keeps the blank that the library puts in front away from the segment.
        return self.b.encode("\n" + segment)[2:]

    def _whole_a(self, text: str) -> bytes | None:
        return _checked(self.a.encode(text, add_special_tokens=False).ids, self.a_bytes, text)

    def _whole_b(self, text: str) -> bytes | None:
        return _checked(self.b.encode(text[1:]), self.b_bytes, text)

    @staticmethod
    def _by_segments(known: _Segments, pattern: re.Pattern, text: str) -> bytes | None:
        parts = list(map(known.__getitem__, pattern.findall(text)))
        return None if None in parts else b"".join(parts)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none where a side does not give the bytes of blank + text back."""
        text = " " + text
        a = self._by_segments(self.segments_a, _A_SEGMENTS, text) if self.short_a and _A_PLAIN.fullmatch(text) else self._whole_a(text)
        b = self._by_segments(self.segments_b, _B_SEGMENTS, text) if self.short_b else self._whole_b(text)
        if a is None or b is None:
            return _NO_IDS, _NO_IDS
        return np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")


_loaded: dict[tuple[str, str], Vocabularies] = {}


def _vocabularies(paths: Callable[[], tuple[str, str]]) -> Vocabularies:
    key = paths()
    if key not in _loaded:
        _loaded[key] = Vocabularies(*key)
    return _loaded[key]


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For the tokens of A, then of B, the terminal token (counted in this order) of the group
    of each, by pointer jumping. Both sides cover the same bytes without gaps."""
    n = len(a_ends)
    starts = lambda ends: np.concatenate([[0], ends[:-1]])
    farthest_b = np.searchsorted(starts(b_ends), a_ends, "left") - 1
    farthest_a = np.searchsorted(starts(a_ends), b_ends, "left") - 1
    ends_here = a_ends[farthest_a] == b_ends
    jump = np.concatenate([farthest_b + n, np.where(ends_here, np.arange(len(b_ends)) + n, farthest_a)])
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


class Alignment:
    """All documents of a chunk, one after the other; document bounds are bounds of groups."""

    def __init__(self, words: Vocabularies, texts: list[str | None]):
        self.words = words
        both = [words.encode(t) if t else (_NO_IDS, _NO_IDS) for t in texts]
        self.n_a = np.array([len(a) for a, _ in both], dtype=np.int64)
        self.n_b = np.array([len(b) for _, b in both], dtype=np.int64)
        self.a, self.b = (np.concatenate(side).astype(np.int64) for side in zip(*both, strict=True))
        self.a_ends, self.b_ends = words.a_sizes[self.a].cumsum(), words.b_sizes[self.b].cumsum()
        last = terminals(self.a_ends, self.b_ends) if len(self.a) else np.empty(0, np.int64)
        ends, group = np.unique(last, return_inverse=True)
        self.a_group, self.b_group = group[: len(self.a)], group[len(self.a) :]
        self.group_ends = self.b_ends[ends - len(self.a)]
        self.doc_ends = np.concatenate([[0], self.a_ends])[self.n_a.cumsum()]
        # Documents without tokens end where the one before ends and are never found here.
        self.group_doc = np.searchsorted(self.doc_ends, self.group_ends, "left")
        self.n_groups = np.bincount(self.group_doc, minlength=len(texts))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, A id and B id of every link. Two tokens overlap in one stretch between
        neighbouring ends, and each stretch has one token of either side."""
        ends = np.sort(np.concatenate([self.a_ends, self.b_ends]), kind="stable")  # two runs: one merge
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        a = self.a[np.searchsorted(self.a_ends, ends, "left")]
        b = self.b[np.searchsorted(self.b_ends, ends, "left")]
        return np.searchsorted(self.doc_ends, ends, "left"), a, b

    def group_lists(self) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        words, groups = self.words, len(self.group_ends)
        a_upto = np.bincount(self.a_group, minlength=groups).cumsum()
        b_upto = np.bincount(self.b_group, minlength=groups).cumsum()
        b_before = b_upto - np.bincount(self.b_group, minlength=groups)
        a_at, b_at = np.arange(len(self.a)), np.arange(len(self.b))
        a_last = a_at + 1 == a_upto[self.a_group]
        b_last = b_at + 1 == b_upto[self.b_group]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        n_a, n_b = len(words.a_bytes), len(words.b_bytes)
        codes[a_at + b_before[self.a_group]] = self.a + n_a * a_last
        codes[b_at + a_upto[self.b_group]] = self.b + 2 * n_a + n_b * b_last
        at = 0
        for size in (self.n_a + self.n_b).tolist():
            yield b"".join([words.written[c] for c in codes[at : at + size].tolist()])[:-1]
            at += size


def _chunks(batches) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Row ids and texts of chunks; a text beyond the bound is a chunk of its own."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        start = chars = 0
        for at, text in enumerate(texts):
            size = len(text or "")
            if at > start and (chars + size > CHUNK_CHARS or at - start == CHUNK_DOCS):
                yield ids.slice(start, at - start), texts[start:at]
                start, chars = at, 0
            chars += size
        if start < len(texts):
            yield ids.slice(start), texts[start:]


_GROUPS = "group long, start long, end long, a_ids array<int>, b_ids array<int>"


def token_groups(docs: DataFrame, paths: Callable[[], tuple[str, str]]) -> DataFrame:
    """``doc_id, group, start, end, a_ids, b_ids``: the groups of every document in order, with
    their byte offsets in blank + text."""

    def run(batches):
        for ids, texts in _chunks(batches):
            found = Alignment(_vocabularies(paths), texts)
            if not len(found.group_ends):
                continue
            firsts = np.concatenate([[0], found.n_groups.cumsum()[:-1]])[found.group_doc]
            begins = np.concatenate([[0], found.doc_ends[:-1]])[found.group_doc]
            starts = np.concatenate([[0], found.group_ends[:-1]])
            lists = lambda values, group: pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.bincount(group).cumsum()]), pa.int32()), pa.array(values, pa.int32())
            )
            columns = [
                ids.take(pa.array(found.group_doc)),
                pa.array(np.arange(len(firsts)) - firsts),
                pa.array(starts - begins),
                pa.array(found.group_ends - begins),
                lists(found.a, found.a_group),
                lists(found.b, found.b_group),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_GROUPS}")


def _squeezed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").tobytes())


def _unsqueezed(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").astype(np.int64)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def encoded(docs: DataFrame, paths: Callable[[], tuple[str, str]]) -> DataFrame:
    """One row a chunk, written: per document its counts and the digest of its groups, the
    chunk's dictionary of linked pairs, and each document's pairs as numbers of that dictionary."""

    def run(batches):
        for number, (ids, texts) in enumerate(_chunks(batches)):
            found = Alignment(_vocabularies(paths), texts)
            doc, a, b = found.links()
            names, pair = np.unique(a << _ID_BITS | b, return_inverse=True)
            held, times = np.unique(doc * max(len(names), 1) + pair, return_counts=True)
            doc_of, pair = np.divmod(held, max(len(names), 1))
            docs_of = np.bincount(pair, minlength=len(names))
            # Common pairs get low numbers: steps between a document's numbers stay small.
            common = np.argsort(-docs_of, kind="stable")
            place = np.empty_like(common)
            place[common] = np.arange(len(common))
            pair = place[pair]
            order = np.lexsort((pair, doc_of))
            pair, times = pair[order], times[order]
            sizes = np.bincount(doc_of, minlength=len(texts))
            steps = np.diff(pair, prepend=0)
            firsts = (sizes.cumsum() - sizes)[sizes > 0]
            steps[firsts] = pair[firsts]
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.group_lists()]
            one = lambda values, kind=pa.int64(): pa.array([values], pa.list_(kind))
            columns = {
                "chunk": pa.array([TaskContext.get().partitionId() << 33 | number]),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "n_a": one(found.n_a),
                "n_b": one(found.n_b),
                "n_groups": one(found.n_groups),
                "n_links": one(np.bincount(doc, minlength=len(texts))),
                "digests": one(digests, pa.string()),
                "sizes": one(sizes),
                "pairs": pa.array([_squeezed(steps)], pa.binary()),
                "times": pa.array([_squeezed(times)], pa.binary()),
                "a": one(names[common] >> _ID_BITS),
                "b": one(names[common] & ((1 << _ID_BITS) - 1)),
                "docs": one(docs_of[common]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"chunk long, doc_ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,"
        " digests array<string>, sizes array<long>, pairs binary, times binary, a array<long>, b array<long>, docs array<long>"
    )
    return cut(docs.select("doc_id", "text").mapInArrow(run, schema))


def _dictionary(chunks: DataFrame) -> DataFrame:
    every = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "pair"))
    return every.select("chunk", "place", "pair.a", "pair.b", "pair.docs")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``a, b, docs, best``: all linked id pairs, and whether no other of ``a`` is in more documents."""
    counts = cut(_dictionary(chunks).groupBy("a", "b").agg(F.sum("docs").alias("docs")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, paths: Callable[[], tuple[str, str]]) -> DataFrame:
    """Per document: counts of tokens, groups and links, ``n_best``, ``count_sum``, and the digest
    of its groups. ``paths`` gives the files of A and B on the worker."""
    chunks = encoded(docs, paths)
    # A chunk's counts, twice the documents plus one for a best pair, in the order of its dictionary.
    judged = pair_counts(chunks).select("a", "b", (F.col("docs") * 2 + F.col("best").cast("long")).alias("count"))
    met = _dictionary(chunks).drop("docs").join(judged, ["a", "b"])
    counts = met.groupBy("chunk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "count"))), lambda x: x["count"]).alias("counts")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name, row=row, batch=batch: batch.column(name)[row]
                array = lambda name, value=value: value(name).values.to_numpy(zero_copy_only=False)
                sizes = array("sizes")
                n_best = count_sum = np.zeros(len(sizes), np.int64)
                if sizes.any():
                    ends = sizes.cumsum()
                    sums = _unsqueezed(value("pairs").as_py()).cumsum()
                    # Steps begin anew with each document.
                    firsts = ends - sizes
                    before = np.concatenate([[0], sums])[firsts]
                    found = array("counts")[sums - np.repeat(before, sizes)]
                    times = _unsqueezed(value("times").as_py())
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    add = lambda what, doc=doc, sizes=sizes: np.bincount(doc, what, minlength=len(sizes)).astype(np.int64)
                    # Sums of whole numbers below 2^53 are exact as doubles.
                    n_best, count_sum = add((found & 1) * times), add((found >> 1) * times)
                columns = [value("doc_ids").values, *(value(n).values for n in _COUNTS), pa.array(n_best), pa.array(count_sum), value("digests").values]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    columns = ["doc_ids", *_COUNTS, "digests", "sizes", "pairs", "times", "counts"]
    return chunks.drop("a", "b", "docs").join(counts, "chunk", "left").select(*columns).mapInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
