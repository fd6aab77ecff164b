"""Token ids in compressed shard files with rank and select: wavelet matrices.

A shard holds the ids of consecutive documents as one wavelet matrix: a bit-plane for each
bit of the largest id, from the highest; each plane stably moves the positions with a zero
bit before those with a one. Access, counting and finding the k-th occurrence read one
position of each plane, without decoding the shard. A shard file is one zstd frame of
header, document lengths, planes and rank directories.

Shards are written through Spark, one row for each file, into a Parquet folder, so any
store that Spark knows will do. Documents are in ascending doc_id order (without id first,
repeated ids by text); null and empty texts have the end id alone. Columns besides the two
used are ignored; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.llm.token_ids import END_ID, encoder

SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512
_MAGIC = b"WMX1"
_HEADER = struct.Struct("<4sQQB")
SHARD_SCHEMA = "part int, shard int, part_start long, n_tokens long, n_docs long, file binary"
DOC_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Static sequence of unsigned ids with access, rank and select."""

    def __init__(self, size: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.size, self.planes, self.ranks = size, planes, ranks
        self.zeros = [size - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        size = len(ids)
        now = ids.astype(np.uint32)
        planes, ranks = [], []
        for bit in reversed(range(max(1, int(now.max()).bit_length() if size else 1))):
            ones = (now >> np.uint32(bit)) & np.uint32(1)
            planes.append(np.packbits(ones.astype(np.uint8), bitorder="little"))
            ranks.append(cls._directory(planes[-1]))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        return cls(size, planes, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK_BITS, and all of them at the end."""
        width = BLOCK_BITS // 8
        padded = np.zeros(-(-max(len(plane), 1) // width) * width, np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded).reshape(-1, width).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)]).astype("<u4")

    def _ones(self, level: int, position: int) -> int:
        """Ones of a plane before a position."""
        block, rest = divmod(position, BLOCK_BITS)
        start = block * (BLOCK_BITS // 8)
        whole, bits = divmod(rest, 8)
        plane = self.planes[level]
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[start : start + whole]).sum())
        return count + (int(plane[start + whole] & ((1 << bits) - 1)).bit_count() if bits else 0)

    def _bit(self, level: int, position: int) -> int:
        return int(self.planes[level][position >> 3] >> (position & 7)) & 1

    def access(self, position: int) -> int:
        """The id at a position."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, position)
            ones = self._ones(level, position)
            position = self.zeros[level] + ones if bit else position - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, position: int) -> int:
        """How often a value occurs before a position."""
        if value >> len(self.planes):
            return 0
        first = 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, first), self._ones(level, position)
            if value >> (len(self.planes) - 1 - level) & 1:
                first, position = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, position = first - a, position - b
        return position - first

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence of a value, from 0."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        first = 0
        for level in range(len(self.planes)):
            ones = self._ones(level, first)
            one = value >> (len(self.planes) - 1 - level) & 1
            first = self.zeros[level] + ones if one else first - ones
        position = first + k
        for level in reversed(range(len(self.planes))):
            one = value >> (len(self.planes) - 1 - level) & 1
            position = self._find(level, position - self.zeros[level] if one else position, one)
        return position

    def _find(self, level: int, k: int, one: int) -> int:
        """The position of the k-th one (or zero) of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * BLOCK_BITS - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * (BLOCK_BITS // 8)
        bits = np.unpackbits(self.planes[level][start : start + BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids in order: each plane's bits are followed back from the last one."""
        values = np.zeros(self.size, np.uint32)
        for level in reversed(range(len(self.planes))):
            bits = np.unpackbits(self.planes[level], bitorder="little")[: self.size].astype(bool)
            back = np.empty_like(values)
            back[~bits] = values[: self.zeros[level]]
            back[bits] = values[self.zeros[level] :] | np.uint32(1 << (len(self.planes) - 1 - level))
            values = back
        return values


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [_HEADER.pack(_MAGIC, len(ids), len(doc_ids), len(matrix.planes)), known.tobytes()]
    parts.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    parts.append(np.array(lengths, "<i8").tobytes())
    for plane, ranks in zip(matrix.planes, matrix.ranks):
        parts += [plane.tobytes(), ranks.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


class Shard:
    """One file, opened: its documents, and its ids as a wavelet matrix."""

    def __init__(self, file: bytes):
        data = zstandard.ZstdDecompressor().decompress(file)
        magic, size, docs, depth = _HEADER.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        at = _HEADER.size

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        known = read("u1", docs)
        ids = read("<i8", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.lengths = read("<i8", docs)
        self.ends = np.cumsum(self.lengths)
        width = -(-size // 8)
        planes, ranks = [], []
        for _ in range(depth):
            planes.append(read("u1", width))
            ranks.append(read("<u4", -(-max(width, 1) // (BLOCK_BITS // 8)) + 1))
        self.matrix = WaveletMatrix(size, planes, ranks)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: Callable[[], str],
    partitions: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
    end_id: int = END_ID,
) -> None:
    """Write all documents as shards in ascending doc_id order.

    A range partition is one run of doc_ids and writes its shards as it reads; a shard
    closes with the document that reaches ``shard_tokens``.
    """
    spark = docs.sparkSession
    end = end_id.to_bytes(4, "little")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, texts = TaskContext.get().partitionId(), encoder(vocabulary)
        doc_ids, found, size, number, begin = [], [], 0, 0, 0

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(found), "<u4")
            file = write_shard(doc_ids, [len(x) // 4 for x in found], ids)
            return pd.DataFrame([(part, number, begin, len(ids), len(doc_ids), file)], columns=["part", "shard", "part_start", "n_tokens", "n_docs", "file"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = texts.encode(text) + end
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                found.append(ids)
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield close()
                    doc_ids, found, begin, size, number = [], [], begin + size, 0, number + 1
        if found:
            yield close()

    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInPandas(shards, SHARD_SCHEMA).write.parquet(path, compression="uncompressed")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the shard files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts all ids before the document. Every shard is decoded from its planes.
    Only totals of partitions are added up in one place.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                shard = Shard(row.file)
                data = shard.matrix.decode().astype("<u4")
                starts = shard.ends - shard.lengths
                sums = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, shard.ends)]
                yield pd.DataFrame({
                    "doc_id": pd.array(shard.doc_ids, "Int64"),
                    "part": np.int32(row.part),
                    "part_start": starts + row.part_start,
                    "n_tokens": shard.lengths,
                    "ids_crc32": sums,
                })

    found = shards.select("part", "part_start", "file").mapInPandas(documents, DOC_SCHEMA)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
