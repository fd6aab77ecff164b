"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words (lower-cased runs of letters and digits). A
text leaks an item when some run of its words is within edit distance k of the item, k being
a fifth of the item's words, rounded down.

The CGK random walk embeds a sequence so that edit distance becomes Hamming distance: at each
step the current word is written out, and a random bit of (step, word) says whether to move on.
Each of several tables has walks of its own and samples a few positions of the embedding; equal
samples make a candidate. Candidates are verified by their exact edit distance.

Windows. An item has k + 1 anchors, its longest words at different places; k edits leave one of
them untouched. The window of an item's size that has the anchor at its place is embedded from
the anchor outwards, to the left and to the right, so edits elsewhere never shift where the walk
begins: text that misses the item's head, or has words inserted before the anchor, is met like
any other. Lengths of both sides are rounded down to powers of two (a *shape*), so a place of a
text is embedded once for each shape that its word anchors and looked up in the tables, however
many items share them. Positions near the anchor are sampled more often (log-uniform), which
keeps the number of tables alike for items of any length.

Tables are added to a shape until the target recall of a single window is reached on simulated
items of the shape's size with most edits a word, for each kind of edit; there is no upper limit.
Items with more than one anchor left are found more often.

Items go through in blocks of about ``BLOCK_ITEMS``, each broadcast and met by all texts, one
block after another. Null and empty texts leak nothing; items without words or without id take
no part; repeated items and rows are reported each. Other columns of the documents are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut
from firmlens.llm.workers import release

SIMILARITY = 0.8
RECALL = 0.99
SAMPLED = 2
#: Windows of up to this many words beside the anchor have one sample a table: one edit may take half of them.
FEW_WORDS = 4
#: Simulated items of each shape, a quarter with each kind of edit and a quarter with all kinds.
TRIALS = 2_000
BLOCK_ITEMS = 20_000
#: Words of texts that are embedded at a time.
MOST_WORDS = 1 << 18
LEAKS = "array<struct<item_id:long,item_words:int,edits:int,start:int>>"
_WORDS = re.compile(r"[^\W_]+")
_PAD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
Shape = tuple[int, int]  # words that are embedded to the left and to the right of an anchor


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def edits_allowed(words: int, similarity: float = SIMILARITY) -> int:
    return math.floor(words * (1 - similarity) + 1e-9)


def edit_distance(item: list[str], text: list[str]) -> tuple[int, int]:
    """Least edits between the item and any run of the text, and where such a run ends.

    Myers' bit vectors: one whole-number step for each word of the text.
    """
    size = len(item)
    places: dict[str, int] = defaultdict(int)
    for i, word in enumerate(item):
        places[word] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for i, word in enumerate(text, 1):
        equal = places.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(horizontal | up)), up & horizontal
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if score < best:
            best, end = score, i
    return best, end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Word -> number of 64 bits; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        data = word.encode("utf-8", "surrogatepass")
        self[word] = number = zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)
        return number

    def of(self, words: list[str]) -> np.ndarray:
        return _mixed(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))


def _side(length: int) -> int:
    """The length rounded down to a power of two."""
    return 1 << (length.bit_length() - 1) if length else 0


@cache
def _table(shape: Shape, number: int) -> tuple[int, list[tuple[int, np.ndarray, frozenset[int]]]]:
    """One table: its seed and, of each side, the direction, the keys of the steps and those sampled."""
    rng = np.random.default_rng([number, *shape])
    few = sum(shape) <= FEW_WORDS
    sampled: tuple[set[int], set[int]] = set(), set()
    for _ in range(min(1 if few else SAMPLED, sum(shape))):
        free = [side for side in (0, 1) if len(sampled[side]) < shape[side]]
        side = free[int(rng.integers(len(free)))]
        step = int(shape[side] ** rng.random() if not few else 1 + rng.integers(shape[side])) - 1
        while step in sampled[side]:
            step = (step + 1) % shape[side]
        sampled[side].add(step)
    sides = []
    for direction, steps in zip((-1, 1), sampled):
        if steps:
            keys = rng.integers(0, 2**63, max(steps) + 1, dtype=np.int64).astype(np.uint64) << np.uint64(1)
            sides.append((direction, keys | np.uint64(1), frozenset(steps)))
    return int(rng.integers(1, 2**62)), sides


def signatures(flat: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, shape: Shape, table: int) -> np.ndarray:
    """Sampled positions of the embedding around the words ``at``, as one number for each.

    ``flat``: all words; a text's own lie between ``first`` and ``last``, where a walk stays.
    """
    seed, sides = _table(shape, table)
    out = _mixed(flat[at] ^ np.uint64(seed))
    for direction, keys, sampled in sides:
        place = at + direction
        for step, key in enumerate(keys):
            place = np.maximum(place, first) if direction < 0 else np.minimum(place, last)
            word = flat[place]
            if step in sampled:
                out = _mixed(out ^ word)
            if step + 1 < len(keys):
                place = place + direction * ((word * key) >> np.uint64(63)).view(np.int64)
    return out


@cache
def tables_for(shape: Shape, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Tables by which a window of this shape is found with the wanted recall.

    Measured on items of the shape's size with most edits a word, made of random words, with all
    edits that are allowed anywhere but at the anchor, inside random text.
    """
    least = sum(shape) + 1
    most = sum(max(2 * side - 1, 0) for side in shape) + 1
    size = max(range(least, most + 1), key=lambda n: (edits_allowed(n, similarity) / max(n - 1, 1), n))
    edits = edits_allowed(size, similarity)
    if not edits:
        return 1
    left = min(shape[0] + size - least, max(2 * shape[0] - 1, 0))
    rng = np.random.default_rng([size, *shape])
    width = 2 * size + 2 * edits

    def laid(rows: list[tuple[list[int], list[int]]], anchors: np.ndarray) -> np.ndarray:
        out = rng.integers(1, 2**62, (TRIALS, 2 * width + 1), dtype=np.int64).astype(np.uint64)
        out[:, width] = anchors
        for row, (before, after) in zip(out, rows):
            row[width - len(before) : width] = before
            row[width + 1 : width + 1 + len(after)] = after
        return out

    originals, edited = [], []
    for trial in range(TRIALS):
        words = rng.integers(1, 2**62, size).tolist()
        originals.append((words[:left], words[left + 1 :]))
        sides = (words[:left], words[left + 1 :])
        kinds = rng.integers(0, 3, edits) if trial % 4 == 3 else np.full(edits, trial % 4)
        # From the end, so that earlier places still hold.
        for place, kind in zip(sorted(rng.choice(size - 1, edits, replace=False), reverse=True), kinds.tolist()):
            side, place = (sides[0], place) if place < left else (sides[1], place - left)
            if kind == 2:
                del side[place]
            else:
                side[place : place + kind] = [int(rng.integers(1, 2**62))]  # insert or replace
        edited.append(sides)
    anchors = rng.integers(1, 2**62, TRIALS, dtype=np.int64).astype(np.uint64)
    one, other = (_mixed(laid(rows, anchors)).ravel() for rows in (originals, edited))
    start = np.arange(TRIALS) * (2 * width + 1)
    at, last = start + width, start + 2 * width
    missed, tables = np.ones(TRIALS, bool), 0
    while missed.reshape(-1, 4).mean(axis=0).max() > 1 - recall:
        missed &= signatures(one, at, start, last, shape, tables) != signatures(other, at, start, last, shape, tables)
        tables += 1
    return tables


@dataclass
class Items:
    """One block of the benchmark, as it is broadcast."""

    items: list[tuple[int, list[str]]]
    similarity: float = SIMILARITY
    recall: float = RECALL
    allowed: list[int] = field(default_factory=list)  # edits of each item
    words: list[frozenset[str]] = field(default_factory=list)  # of each item
    anchors: dict[Shape, np.ndarray] = field(default_factory=dict)  # numbers of anchors, sorted
    tables: dict[Shape, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)
    """Of each table: signatures, sorted, and the items and places of their anchors."""

    def __post_init__(self) -> None:
        numbers = _Numbers()
        flat, starts, entries = [np.full(1, _PAD)], [], defaultdict(list)
        length = 1
        for number, (_, words) in enumerate(self.items):
            self.allowed.append(edits_allowed(len(words), self.similarity))
            self.words.append(frozenset(words))
            firsts = {word: i for i, word in reversed(list(enumerate(words)))}
            places = sorted(range(len(words)), key=lambda i: (firsts[words[i]] < i, -len(words[i]), i))
            for place in places[: self.allowed[-1] + 1]:
                entries[_side(place), _side(len(words) - place - 1)].append((number, place))
            flat += [numbers.of(words), np.full(1, _PAD)]
            starts.append(length)
            length += len(words) + 1
        joined, begins = np.concatenate(flat), np.array(starts, np.int64)
        sizes = np.array([len(words) for _, words in self.items], np.int64)
        for shape, own in entries.items():
            item, place = np.array(own, np.int64).T
            at, first, last = begins[item] + place, begins[item] - 1, begins[item] + sizes[item]
            self.anchors[shape] = np.unique(joined[at])
            self.tables[shape] = []
            for table in range(tables_for(shape, self.similarity, self.recall)):
                made = signatures(joined, at, first, last, shape, table)
                order = np.argsort(made, kind="stable")
                self.tables[shape].append((made[order], item[order], place[order]))


class Finder:
    """Finds a block's items in texts; one per Python worker and partition."""

    def __init__(self, block: Items):
        self.block = block
        self.numbers = _Numbers()
        shapes = list(block.anchors)
        self.anchors = np.unique(np.concatenate([block.anchors[s] for s in shapes])) if shapes else np.zeros(0, np.uint64)
        self.shapes = [(s, np.isin(self.anchors, block.anchors[s])) for s in shapes]

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """Of each text, the items that it leaks."""
        found: list[list[dict]] = []
        group: list[list[str]] = []
        length = 0
        for text in texts:
            words = words_of(text)
            if group and length + len(words) > MOST_WORDS:
                found += self._leaks(group)
                group, length = [], 0
            group.append(words)
            length += len(words)
        return found + self._leaks(group)

    def _leaks(self, texts: list[list[str]]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        sizes = np.array([len(words) for words in texts], np.int64)
        if not len(self.anchors) or not sizes.sum():
            return out
        flat = np.full(int(sizes.sum()) + len(texts) + 1, _PAD)
        ends = np.cumsum(sizes + 1)  # the pad behind each text; another stands before the first
        for words, end in zip(texts, ends.tolist()):
            flat[end - len(words) : end] = self.numbers.of(words)
        near = np.searchsorted(self.anchors, flat)
        near[near == len(self.anchors)] = 0
        at = np.flatnonzero(self.anchors[near] == flat)
        for text, item, starts in self._candidates(flat, at, near[at], ends, sizes):
            if leak := self._verified(texts[text], item, starts):
                out[text].append(leak)
        return out

    def _candidates(self, flat, at, anchor, ends, sizes) -> Iterator[tuple[int, int, list[int]]]:
        """Texts, items and where those would start, of windows that agree in some table."""
        found = [np.zeros((3, 0), np.int64)]
        for shape, own in self.shapes:
            place = at[own[anchor]]
            text = np.searchsorted(ends, place)
            last = ends[text]
            first = last - sizes[text] - 1
            for number, (keys, items, places) in enumerate(self.block.tables[shape]):
                made = signatures(flat, place, first, last, shape, number)
                left = np.searchsorted(keys, made)
                left[left == len(keys)] = 0
                rows = np.flatnonzero(keys[left] == made)
                if len(rows):
                    left = left[rows]
                    many = np.searchsorted(keys, made[rows], "right") - left
                    entry = np.arange(many.sum()) + np.repeat(left - np.cumsum(many) + many, many)
                    rows = np.repeat(rows, many)
                    found.append(np.array([text[rows], items[entry], place[rows] - first[rows] - 1 - places[entry]]))
            if len(found) > 1:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
        text, item, start = found[0]
        cuts = [0, *np.flatnonzero((text[1:] != text[:-1]) | (item[1:] != item[:-1])) + 1, len(text)]
        for one, other in zip(cuts, cuts[1:]):
            if other > one:
                yield int(text[one]), int(item[one]), start[one:other].tolist()

    def _verified(self, text: list[str], item: int, starts: list[int]) -> dict | None:
        """The item's first run with fewest edits among the candidates' stretches."""
        item_id, words = self.block.items[item]
        size, allowed, own = len(words), self.block.allowed[item], self.block.words[item]
        least = len(own) - allowed
        stretches: list[list[int]] = []
        for start in starts:
            first, last = max(start - allowed, 0), start + size + allowed
            if len(own.intersection(text[first:last])) >= least:
                if stretches and first <= stretches[-1][1]:
                    stretches[-1][1] = last
                else:
                    stretches.append([first, last])
        best = None
        for first, last in stretches:
            stretch = text[first:last]
            # The words may repeat in the item.
            if len(own) < size and sum((Counter(words) & Counter(stretch)).values()) < size - allowed:
                continue
            edits, end = edit_distance(words, stretch)
            if edits <= allowed and (best is None or edits < best["edits"]):
                best = {"item_id": item_id, "item_words": size, "edits": edits, "start": max(first + end - size, 0)}
                if not edits:
                    break
        return best


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """All columns of ``docs`` and ``leaks``: items, their size, edits and about where.

    With several blocks, what is found so far is written after each, so that one block at a
    time is held.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-items.count() // block_items))
    out = docs
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        split = [(r["item_id"], words_of(r["text"])) for r in sorted(own)]
        block = Items([x for x in split if x[1]], similarity, recall)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = _column(shared)(F.coalesce("text", F.lit("")))
        out = out.withColumn("leaks", F.concat("leaks", found) if b else found)
        if blocks > 1:
            out = cut(out)
            shared.unpersist()
    return out


def _column(shared):
    @F.pandas_udf(LEAKS)
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(shared.value)
        for batch in texts:
            found = pd.Series(finder.find(batch.tolist()), dtype=object)
            del batch  # before the next one comes
            release()
            yield found
        del finder
        release()

    # Else a filter on the result would run it a second time.
    return leaks.asNondeterministic()
