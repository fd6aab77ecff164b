"""Packing token sequences: bounded-space best fit.

Every scan partition keeps a fixed number of open windows. What is left of a document
after whole windows have been cut from it goes to the open window that it fits best; when
none fits and all are in use, the fullest is topped up with its head and emitted. At the
end of a partition the open windows are merged, so that at most one stays open; those meet
in groups of partitions, level by level, until one is left. A task holds the open windows
and nothing else, and every result is written before a later step reads it.

Null and empty texts give a sequence piece with the end id alone. Repeated rows and rows
without a doc_id are packed like any other. Columns besides the two used are ignored. An
empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut
from firmlens.llm.token_ids import END_ID, encoder
from firmlens.llm.workers import release

LENGTH = 2048
OPEN_WINDOWS = 64
FAN_IN = 64
SCHEMA = (
    "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long,"
    " closed boolean, origin long"
)
_COLUMNS = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "closed", "origin"]
_WIDTH = 4  # bytes of an id
_NUMBERS = 1 << 32  # sequences of one partition or group, at most
_LEVELS = 1 << 56

# A piece is (doc_id, start, ids as bytes, doc_tokens); a window a list of pieces.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Best fit into at most ``open_windows`` windows; gives rows of SCHEMA."""

    def __init__(self, length: int, open_windows: int, first_id: int, origin: int):
        self.room_of = length * _WIDTH
        self.open_windows = open_windows
        self.next_id, self.origin = first_id, origin
        self.rooms: list[tuple[int, int]] = []  # (free bytes, window), sorted
        self.windows: dict[int, list[Piece]] = {}
        self.made = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[Piece], closed: bool = True) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, ids, total, self.next_id, offset, closed, self.origin))
            offset += len(ids) // _WIDTH
        self.next_id += 1

    @staticmethod
    def _split(piece: Piece, size: int) -> tuple[Piece, Piece]:
        doc_id, start, ids, total = piece
        return (doc_id, start, ids[:size], total), (doc_id, start + size // _WIDTH, ids[size:], total)

    def add(self, piece: Piece) -> None:
        while len(piece[2]) >= self.room_of:
            head, piece = self._split(piece, self.room_of)
            self._emit([head])
        if not piece[2]:
            return
        best = bisect_left(self.rooms, (len(piece[2]), -1))
        if best < len(self.rooms):
            room, key = self.rooms.pop(best)
            self.windows[key].append(piece)
            if room > len(piece[2]):
                insort(self.rooms, (room - len(piece[2]), key))
            else:
                self._emit(self.windows.pop(key))
            return
        if len(self.rooms) == self.open_windows:
            room, key = self.rooms.pop(0)
            head, piece = self._split(piece, room)
            self._emit([*self.windows.pop(key), head])
        self.windows[self.made] = [piece]
        insort(self.rooms, (self.room_of - len(piece[2]), self.made))
        self.made += 1

    def finish(self, last: bool = False) -> None:
        """Merge the open windows; one partly filled window stays, open unless ``last``."""
        left = [self.windows[key] for _, key in self.rooms]
        self.rooms, self.windows = [], {}
        kept: list[Piece] = []
        used = 0
        for piece in (p for window in left for p in window):
            if used + len(piece[2]) >= self.room_of:
                head, piece = self._split(piece, self.room_of - used)
                self._emit([*kept, head])
                kept, used = [], 0
            if piece[2]:
                kept.append(piece)
                used += len(piece[2])
        if kept:
            self._emit(kept, closed=last)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=_COLUMNS)


def pack_documents(
    docs: DataFrame,
    vocabulary: Callable[[], str],
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    fan_in: int = FAN_IN,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, ids`` (little-endian
    unsigned 32-bit), ``doc_tokens, sequence_id, offset``. Each id is in exactly one piece.

    Runs jobs: the pieces are written once, leftovers once per level.
    """
    end = end_id.to_bytes(_WIDTH, "little")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packer, texts = Packer(length, open_windows, part * _NUMBERS, part), encoder(vocabulary)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = texts.encode(text) + end
                packer.add((None if pd.isna(doc_id) else int(doc_id), 0, ids, len(ids) // _WIDTH))
                if len(packer.rows) >= 10_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()
        del packer, texts
        release()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(docs.mapInPandas(first, SCHEMA), "zstd")
    done = [pieces.where("closed")]
    left = pieces.where("not closed")
    groups = (left.agg(F.max("origin")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        groups = -(-groups // fan_in)
        merged = cut(_merge(left, length, open_windows, fan_in, level, groups == 1))
        done.append(merged.where("closed"))
        left = merged.where("not closed")
        if groups == 1:
            break
    return reduce(DataFrame.unionByName, done).drop("closed", "origin")


def _merge(left: DataFrame, length: int, open_windows: int, fan_in: int, level: int, last: bool) -> DataFrame:
    """At most ``fan_in`` open windows, one of each origin, meet in one group."""

    def repack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        packer = Packer(length, open_windows, level * _LEVELS + group * _NUMBERS, group)
        for row in rows.sort_values(["origin", "offset"]).itertuples():
            doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
            packer.add((doc_id, int(row.start), bytes(row.ids), int(row.doc_tokens)))
        packer.finish(last)
        return packer.take()

    group = F.floor(F.col("origin") / fan_in).alias("group")
    return left.groupBy(group).applyInPandas(repack, SCHEMA)
