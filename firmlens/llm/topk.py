"""Exact top-k inner products: retrieval from buckets of similar length.

Vectors are written once, sorted by falling length. A task reads them in buckets of similar
length. For a query with k-th best score t so far, a bucket whose longest vector has length
l can only hold a better one at a cosine of t / (|q| l) or more. Where that is above one the
bucket is skipped. From ``COORDINATES_FROM`` on, coordinate pruning: a unit vector at such a
cosine has each coordinate in a narrow range around the query's, so a sorted list of one
coordinate and tests of two more leave few candidates. Below it, length pruning: only
vectors of length t / |q| or more. All that remain are verified by their exact product.

The stated queries go through in blocks, which are broadcast and never exceed about
``BLOCK`` vectors; every block meets all vectors, and starts from the k-th best score among
the ``HEAD`` longest vectors.

Components become floor(256 x). Vectors that are null, or hold null or non-finite
components, take no part, nor do rows without id. Products are defined between vectors of
equally many components, whose product must fit a long. A query never finds rows of its own
id; repeated rows are found once for each; of queries with the same id the smallest vector
counts. Ties go to the smaller id. Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut, shared_folder

K = 5
SCALE = 256
BLOCK = 4096
HEAD = 2048
BUCKET = 2048
SHRINK = 0.9  # a bucket ends where vectors are shorter than this part of its longest
COORDINATES_FROM = 0.8
FOCUS = 3
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, numbers, length`` of the vectors that take part."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    numbers = F.transform(parts, lambda x: F.floor(x * SCALE))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("numbers"))
    squares = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.withColumn("length", F.sqrt(squares))


def _matrix(numbers: list) -> np.ndarray:
    """Rows as floats while every product is exact in them, else as whole numbers."""
    found = np.array([np.asarray(x, np.int64) for x in numbers], np.int64)
    most = float(np.abs(found.astype(np.float64)).max(initial=0))
    return found.astype(np.float64) if most * most * max(found.shape[1], 1) < 2**52 else found


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == b.dtype == np.float64:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best of each query of a block so far, and the score to reach."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.numbers, self.k = ids, numbers, k
        self.lengths = np.sqrt((numbers.astype(np.float64) ** 2).sum(axis=1))
        self.unit = numbers / np.maximum(self.lengths, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.floors = floors.astype(np.float64)
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted

    def offer(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates in ascending order of id, with exact products."""
        fit = (scores >= self.floors[query]) & (ids != self.ids[query])
        if not fit.any():
            return
        ids, scores = ids[fit], scores[fit]
        if len(ids) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            above = np.flatnonzero(scores > least)
            at = np.concatenate([above, np.flatnonzero(scores == least)[: self.k - len(above)]])
            ids, scores = ids[at], scores[at]
        new = [(-int(s), int(i)) for s, i in zip(scores, ids)]
        self.found[query] = sorted(self.found[query] + new)[: self.k]
        if len(self.found[query]) == self.k:
            self.floors[query] = max(self.floors[query], -self.found[query][-1][0])

    def bucket(self, ids: np.ndarray, numbers: np.ndarray) -> None:
        """Try one bucket on all queries of the block."""
        order = np.argsort(ids, kind="stable")
        ids, numbers = ids[order], numbers[order]
        lengths = np.sqrt((numbers.astype(np.float64) ** 2).sum(axis=1))
        reach = self.lengths * lengths.max() * (1 + 1e-9)
        cosine = np.where(reach > 0, self.floors / np.maximum(reach, 1e-300), np.where(self.floors > 0, 2.0, -2.0))
        by_coordinates = np.flatnonzero((cosine >= COORDINATES_FROM) & (cosine <= 1))
        by_length = np.flatnonzero(cosine < COORDINATES_FROM)
        if len(by_length):
            need = self.floors[by_length] / np.maximum(self.lengths[by_length], 1e-300)
            long_enough = lengths >= max(need.min(), 0) * (1 - 1e-9) if self.lengths[by_length].min() > 0 else lengths >= 0
            own_ids = ids[long_enough]
            for query, scores in zip(by_length, _product(self.numbers[by_length], numbers[long_enough])):
                self.offer(query, own_ids, scores)
        if len(by_coordinates):
            unit = numbers / np.maximum(lengths, 1e-300)[:, None]
            lists = {f: np.argsort(unit[:, f], kind="stable") for f in np.unique(self.focus[by_coordinates])}
            ordered = {f: unit[at, f] for f, at in lists.items()}
            for query in by_coordinates:
                at = self._near(query, cosine[query], unit, lists, ordered)
                if len(at):
                    scores = _product(self.numbers[query : query + 1], numbers[at])[0]
                    self.offer(query, ids[at], scores)

    def _near(self, query: int, cosine: float, unit: np.ndarray, lists: dict, ordered: dict) -> np.ndarray:
        """Rows whose focus coordinates allow the cosine, in ascending order."""
        coordinates = self.focus[query]
        own = self.unit[query, coordinates]
        width = np.sqrt(np.maximum((1 - own**2) * (1 - cosine**2), 0)) + 1e-9
        low, high = own * cosine - width, own * cosine + width
        # A coordinate that the query itself has beyond the range's end bounds one side only.
        low, high = np.where(own < -cosine, -1.1, low), np.where(own > cosine, 1.1, high)
        first = coordinates[0]
        a, b = np.searchsorted(ordered[first], [low[0], high[0] + 1e-12])
        at = lists[first][a:b]
        for f, bottom, top in zip(coordinates[1:], low[1:], high[1:]):
            at = at[(unit[at, f] >= bottom) & (unit[at, f] <= top)]
        return np.sort(at)


def _buckets(lengths: np.ndarray) -> Iterator[slice]:
    start = 0
    while start < len(lengths):
        stop = min(start + BUCKET, len(lengths))
        short = np.flatnonzero(lengths[start:stop] < SHRINK * lengths[start])
        stop = start + int(short[0]) if len(short) else stop
        yield slice(start, stop)
        start = stop


def search(
    vectors: DataFrame, is_query: Column, vector: str = "embedding", k: int = K, block: int = BLOCK
) -> DataFrame:
    """The k best of every query: ``query_id, rank, vec_id, score``. Runs jobs."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, vector).withColumn("width", F.size("numbers"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    falling = [F.col("width"), F.col("length").desc()]
    stored = cut(rows.repartitionByRange(count, *falling).sortWithinPartitions(*falling, "vec_id"))
    asked = cut(stored.where(is_query).groupBy("vec_id").agg(F.min("numbers").alias("numbers")))
    blocks = max(1, -(-asked.count() // block))
    head = stored.orderBy(F.col("length").desc(), "vec_id").limit(HEAD).select("vec_id", "numbers").collect()
    path = f"{shared_folder(spark).rstrip('/')}/found-{uuid.uuid4().hex}"
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {len(r["numbers"]) for r in own}:
            mine = [r for r in own if len(r["numbers"]) == width]
            start = [r for r in head if len(r["numbers"]) == width]
            ids, numbers = np.array([r["vec_id"] for r in mine]), _matrix([r["numbers"] for r in mine])
            first = Best(ids, numbers, np.full(len(ids), -np.inf), k)
            if start:
                first.bucket(np.array([r["vec_id"] for r in start]), _matrix([r["numbers"] for r in start]))
            by_width[width] = ids, numbers, first.floors
        _one_block(stored, by_width, k).write.mode("append").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_block(stored: DataFrame, by_width: dict, k: int) -> DataFrame:
    shared = stored.sparkSession.sparkContext.broadcast(by_width)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {w: Best(*queries, k) for w, queries in shared.value.items()}
        for batch in batches:
            for width, rows in batch.groupby("width", sort=False):
                if width in kept:
                    numbers, ids = _matrix(rows["numbers"].tolist()), rows["vec_id"].to_numpy()
                    for part in _buckets(rows["length"].to_numpy()):
                        kept[width].bucket(ids[part], numbers[part])
        out = [(int(q), i, -s) for best in kept.values() for q, found in zip(best.ids, best.found) for s, i in found]
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return stored.select("vec_id", "numbers", "length", "width").mapInPandas(scan, FOUND)
