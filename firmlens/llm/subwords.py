"""Hashed word and character n-gram features, and bounded labelled samples."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
CACHED_WORDS = 200_000
CACHED_CHARS = 40
PIECE = 200  # characters of a word that are read at once
FILLED_CHARS = 500_000  # of new words, at once
KEPT_CHARS = 2_000_000  # of words whose buckets are kept while a model learns


def pieces(words: list[str]) -> list[str]:
    """Words of over ``PIECE`` characters, as in text without spaces, in consecutive pieces.

    They overlap so far that every n-gram lies in one of them.
    """
    if max(map(len, words), default=0) <= PIECE:
        return words
    overlap = max(GRAMS) - 1
    return [w[i : i + PIECE] for w in words for i in (range(0, len(w) - overlap, PIECE - overlap) if len(w) > PIECE else (0,))]


def buckets_of(word: str, buckets: int = BUCKETS) -> list[int]:
    """The word itself and its character n-grams with edges, as bucket numbers."""
    edged = f"<{word}>".encode()
    found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets]
    for n in GRAMS:
        found += [zlib.crc32(edged[i : i + n], n) % buckets for i in range(len(edged) - n + 1)]
    return found


def csr(words: Sequence[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words in one row, and where each word begins and ends."""
    found, ends = array("q"), np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(words, 1):
        found.extend(buckets_of(word, buckets))
        ends[i] = len(found)
    return np.array(found, np.int64), ends


class Spans:
    """Bucket numbers of each word; those beyond ``KEPT_CHARS`` are made when they are asked for."""

    def __init__(self, words: list[str]):
        self.words = words
        total = np.cumsum([len(w) for w in words])
        self.kept = int(np.searchsorted(total, KEPT_CHARS, "right"))
        self.buckets, self.ends = csr(words[: self.kept])

    def __getitem__(self, i: int) -> np.ndarray:
        if i < self.kept:
            return self.buckets[self.ends[i] : self.ends[i + 1]]
        return np.array(buckets_of(self.words[i]), np.int64)


def word_vectors(table: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean of each word's bucket vectors."""
    if len(ends) < 2:
        return np.zeros((0, table.shape[1]), table.dtype)
    return np.add.reduceat(table[buckets], ends[:-1]) / np.diff(ends)[:, None].astype(table.dtype)


class WordRows(dict):
    """Word -> row of a table that ``fill`` computes for many new words at once.

    The cache only saves time; it is emptied between texts when it is full.
    """

    def __init__(self, fill, width: int):
        super().__init__()
        self.fill, self.new = fill, []
        self.table = np.zeros((1024, width), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def rows(self, words: Sequence[str]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            if len(self) > len(self.table):
                grown = np.zeros((2 * len(self), self.table.shape[1]), np.float32)
                grown[: len(self.table)] = self.table
                self.table = grown
            at = len(self) - len(self.new)
            for part in _parts(self.new):
                self.table[at : at + len(part)] = self.fill(part)
                at += len(part)
            self.new = []
        return found


def _parts(words: list[str]) -> Iterator[list[str]]:
    """Consecutive words of about ``FILLED_CHARS`` together."""
    start = chars = 0
    for end, word in enumerate(words, 1):
        chars += len(word)
        if chars >= FILLED_CHARS or end == len(words):
            yield words[start:end]
            start, chars = end, 0


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_chars: int, long_chars: int = 0
) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class, in the order of a hash of the id.

    ``train`` says which labelled rows may be learned from. Only the sample's texts come to the
    driver: ``per_class`` of at most ``max_chars``, and of longer ones, whole, as many as have
    ``long_chars`` of each class together.
    """
    rows = labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("chars", F.length("text"))
    short, long = texts.where(F.col("chars") <= max_chars), texts.where(F.col("chars") > max_chars)
    # Texts count by their length before the limit, so that long ones take no place of others.
    usable = rows.join(short.select("doc_id"), "doc_id", "left_semi")
    kept = [usable.where(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    found = short.join(F.broadcast(kept[0].unionByName(kept[1])), "doc_id")
    if long_chars:
        sizes = rows.join(long.groupBy("doc_id").agg(F.sum("chars").alias("chars")), "doc_id")
        chosen = []
        for y in (0, 1):
            room = long_chars
            for r in sizes.where(F.col("label") == y).orderBy(*order).limit(per_class).collect():
                if r["chars"] <= room:
                    room -= r["chars"]
                    chosen.append((r["doc_id"], y))
        if chosen:
            own = docs.sparkSession.createDataFrame(chosen, rows.schema)
            found = found.unionByName(long.join(F.broadcast(own), "doc_id"))
    rows = found.select("doc_id", F.xxhash64("doc_id").alias("order"), "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["order"], r["doc_id"], r["text"]))]
