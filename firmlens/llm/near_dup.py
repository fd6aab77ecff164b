"""Near-duplicates: banded MinHash candidates, verified sequentially and Bayesian.

Documents are sets of distinct word shingles. Equal sets are one class from the start, so
copies never meet in pairs. Classes whose signatures agree in a band share a bucket.

- Every bucket has a random centre, and each member is compared with it: as many pairs as
  members. Signatures are compared batch by batch; after each, a pair goes when the posterior
  chance of a similarity at or above the threshold is below ``MISS``.
- Survivors are verified on full sets: first one partner for each class, then only pairs
  between different components, the most alike first.
- In a bucket that still holds several components, members outside its largest one are
  compared, block by block and by signature, with all members of other components. A pair
  that shares several buckets is compared in that of the first band only. Members of surviving
  pairs get their sets, and each block verifies its pairs itself: of the links it gives back only
  those that join what it has not joined yet, less than it has members. So of the
  candidates that bands give, only those are left out that a chain of links already joins: the
  components are those of all candidate pairs.

Bands are so many that a pair at the threshold is missed with a chance of some 1e-7.

A null or wordless text has no shingles and links with nothing. Rows that share a doc_id
count as linked. Rows without doc_id take part, but never name a component; where no row of
a set has an id, they stay unnamed and are kept. Other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut, settled
from firmlens.llm.components import join_components

WORDS = 4
PERCENT = 80
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
SURE = 0.87  # agreement from which a first partner is taken by chance, not by agreement
PER_PAIR = 8  # pairs of two components that are verified before all others
BLOCK = 1024  # members of a bucket that are compared with as many others at a time
BLOCK_SHINGLES = 1_000_000  # and the shingles of either side, on average
PAIRS_AT_ONCE = 256
_WIDTH = 4  # bytes of a hash in a signature
SETS = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"
_BLOCK = ["band", "bucket", "rows", "columns"]
MEMBERS = "band int, bucket long, rows int, columns int, right boolean, node long, component long, signature binary"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _random_numbers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    numbers = rng.integers(0, 2**63, (2, HASHES, 1), dtype=np.int64).astype(np.uint64)
    return numbers[0] * np.uint64(2) + np.uint64(1), numbers[1]


class Shingles:
    """Shingle sets as sorted 64-bit hashes; one per Python worker and partition."""

    def __init__(self, words: int = WORDS):
        self.words = words
        rng = np.random.default_rng(words)
        self.factors = [np.uint64(int(x) * 2 + 1) for x in rng.integers(0, 2**62, words)]

    def of(self, text: str | None) -> np.ndarray:
        """Lower-cases A to Z only; words are what lies between ASCII white space."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        numbers = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        size = min(self.words, len(found))
        total = np.full(len(found) - size + 1, np.uint64(size))
        for place in range(size):
            total = total + _mixed(numbers[place : place + len(total)] * self.factors[place])
        return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> bytes:
    factors, summands = _random_numbers()
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[start : start + 2048] * factors + summands).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Size, 128-bit name and signature of every document's set."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = shingles.of(text)
                if len(hashes):
                    name = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
                    rows.append((len(hashes), int(name[0]), int(name[1]), signature(hashes)))
                else:
                    rows.append((0, 0, 0, b""))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "signature"])
            out.insert(0, "doc_id", pd.array(batch["doc_id"], "Int64"))
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sets, SETS)


@cache
def least_agreement(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared batches, the agreements below which a pair goes: the
    posterior (uniform prior) of a similarity at or above the threshold is below ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            weights = np.exp((logs := m * np.log(grid) + (n - m) * np.log1p(-grid)) - logs.max())
            if weights[grid >= threshold].sum() >= miss * weights.sum():
                found.append(m)
                break
    return tuple(found)


def agreements(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Agreeing hashes of signature pairs, row by row; -1 for pairs that were pruned."""
    found = np.zeros(len(left), np.int32)
    alive = np.arange(len(left))
    for batch, least in enumerate(least_agreement(threshold)):
        part = slice(batch * BATCH, (batch + 1) * BATCH)
        found[alive] += (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
        alive = alive[found[alive] >= least]
    kept = np.full(len(left), -1, np.int32)
    kept[alive] = found[alive]
    return kept


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, HASHES)


def _band_keys(name: str) -> Column:
    width = ROWS * _WIDTH
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.xxhash64(band, F.substring(name, band * width + 1, F.lit(width))),
    )


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``. Runs jobs."""
    sets = cut(shingle_sets(docs, words))
    name = ["set_a", "set_b"]
    filled = sets.where("n_shingles > 0")
    named = settled(docs.sparkSession, lambda: _named(docs, sets, filled, words, percent))
    empty = F.col("n_shingles") == 0
    return (
        filled.select("doc_id", "n_shingles", *name)
        .join(named, name, "left")
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(sets.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _named(docs: DataFrame, sets: DataFrame, filled: DataFrame, words: int, percent: int) -> DataFrame:
    """The component of each class of equal sets."""
    name = ["set_a", "set_b"]
    classes = cut(filled.groupBy(name).agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"))
    nodes = sets.withColumnRenamed("doc_id", "node").join(classes, ["node", *name])
    nodes = cut(nodes.select("node", "n_shingles", "signature").distinct())

    bands = nodes.select("node", F.posexplode(_band_keys("signature")).alias("band", "bucket"))
    pick = F.min(F.struct(F.xxhash64("bucket", "node"), F.col("node").alias("node")))
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("members"), pick.alias("centre"))
    buckets = cut(buckets.where("members > 1").select("bucket", F.col("centre.node").alias("centre")))
    crowded = cut(bands.join(buckets, "bucket"))

    search = _Search(docs, nodes, crowded, words, percent)
    labels = search.run()
    lowest = labels.groupBy("component").agg(F.min("node").alias("component_id"))
    named = classes.join(labels, "node", "left").join(lowest, "component", "left")
    return named.select(*name, F.coalesce("component_id", "node").alias("component_id"))


class _Search:
    """Finds links between classes until bands offer none between different components."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, crowded: DataFrame, words: int, percent: int):
        self.nodes, self.crowded = nodes, crowded
        self.words, self.percent = words, percent
        self.labels = cut(crowded.select("node", F.col("node").alias("component")).distinct())
        bodies = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
        self.bodies = cut(bodies.join(self.labels.select("node"), "node", "left_semi"))

    def run(self) -> DataFrame:
        pairs = self._rated(
            self.crowded.where(F.col("node") != F.col("centre"))
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
            .distinct()
        )
        self._link(self._first_partners(pairs))
        best = Window.partitionBy("one", "other").orderBy(F.col("agreed").desc(), "a", "b")
        across = self._across(pairs).withColumn("place", F.row_number().over(best))
        self._link(across.where(F.col("place") <= PER_PAIR).select("a", "b"))
        self._link(self._across(pairs).select("a", "b"))
        self.labels = join_components(self.labels, self._leftovers().distinct())
        return self.labels

    def _rated(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the sequential test keeps, with the number of agreeing hashes."""
        threshold = self.percent / 100

        @F.pandas_udf("int")
        def agreed(left: pd.Series, right: pd.Series) -> pd.Series:
            return pd.Series(agreements(_signatures(left), _signatures(right), threshold))

        own = lambda side: self.nodes.select(F.col("node").alias(side), F.col("signature").alias(f"of_{side}"))
        joined = cut(pairs).join(own("a"), "a").join(own("b"), "b")
        return cut(joined.select("a", "b", agreed("of_a", "of_b").alias("agreed")).where("agreed >= 0"))

    def _first_partners(self, pairs: DataFrame) -> DataFrame:
        """One partner for each class: any that looks surely alike, by a hash that is the
        same for all so that many take the same one, else the most alike."""
        ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agreed"))
        doubt = F.when(F.col("agreed") >= int(SURE * HASHES), 0).otherwise(HASHES - F.col("agreed"))
        choice = F.min(F.struct(doubt.alias("doubt"), F.xxhash64("b").alias("order"), F.col("b").alias("b")))
        chosen = ways.groupBy("a").agg(choice.alias("choice")).select("a", F.col("choice.b").alias("b"))
        return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _across(self, pairs: DataFrame) -> DataFrame:
        """Pairs between different components, with both."""
        own = lambda side, name: self.labels.select(F.col("node").alias(side), F.col("component").alias(name))
        joined = pairs.join(own("a", "of_a"), "a").join(own("b", "of_b"), "b").where("of_a != of_b")
        return joined.select(
            "a", "b", "agreed", F.least("of_a", "of_b").alias("one"), F.greatest("of_a", "of_b").alias("other")
        )

    def _link(self, pairs: DataFrame) -> None:
        """Verify pairs on full sets and join the components of those that pass."""
        words, percent = self.words, self.percent

        @F.pandas_udf("boolean")
        def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            shingles = Shingles(words)
            for left, right in batches:
                found, last, seen = [], None, None
                for a, b in zip(left, right):
                    if b != last:
                        last, seen = b, shingles.of(b)
                    own = shingles.of(a)
                    common = len(np.intersect1d(own, seen, assume_unique=True))
                    found.append(100 * common >= percent * (len(own) + len(seen) - common))
                yield pd.Series(found, dtype=bool)

        own = lambda side: self.bodies.select(F.col("node").alias(side), F.col("text").alias(f"of_{side}"))
        pairs = cut(pairs)
        joined = pairs.join(own("a"), "a").join(own("b"), "b")
        links = joined.where(linked("of_a", "of_b")).select("a", "b").distinct()
        with _small_batches(links.sparkSession, PAIRS_AT_ONCE):
            links = cut(links)
        self.labels = join_components(self.labels, links)

    def _leftovers(self) -> DataFrame:
        """Links between members of a bucket outside its largest component and members of other
        components: from each block as many as join its components, and no more."""
        threshold, words, percent = self.percent / 100, self.words, self.percent
        members = self.crowded.join(self.labels, "node").select("band", "bucket", "node", "component")
        counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        main = F.max(F.struct("n", "component"))
        mixed = counts.groupBy("bucket").agg(F.count("*").alias("kinds"), main.alias("main")).where("kinds > 1")
        mixed = cut(mixed.select("bucket", F.col("main.component").alias("main")))
        members = cut(members.join(mixed, "bucket")).join(self.nodes, "node")
        members = cut(members.select("band", "bucket", "node", "component", "n_shingles", "signature", "main"))
        outside = F.col("component") != F.col("main")

        def blocks(here: Column) -> Column:
            shingles = F.sum(F.when(here, F.col("n_shingles")).otherwise(0))
            return F.greatest(F.ceil(F.count_if(here) / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")

        sizes = members.groupBy("bucket").agg(blocks(F.lit(True)).alias("rows"), blocks(outside).alias("columns"))
        members = members.join(cut(sizes), "bucket")

        def side(rows: DataFrame, right: bool) -> DataFrame:
            """Each row in its own block of one side, once for each block of the other."""
            own, other = ("columns", "rows") if right else ("rows", "columns")
            place = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own)
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
            placed = rows.select("band", "bucket", place, every, F.lit(right).alias("right"), "node", "component", "signature")
            return placed.select(*_BLOCK, "right", "node", "component", "signature")

        def in_doubt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Members of a block with a pair that the sequential test keeps."""
            for block in _blocks(batches):
                left, right = _alike(block, threshold)
                yield block.iloc[np.unique(np.concatenate([left, right]))]

        def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingles = Shingles(words)
            for batch in batches:
                found = [shingles.of(text).tobytes() for text in batch["text"]]
                yield pd.DataFrame({"node": batch["node"], "hashes": found})

        def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block in _blocks(batches):
                yield _spanning_links(block, threshold, percent)

        both = side(members, False).unionByName(side(members.where(outside), True))
        both = both.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
        doubted = cut(both.mapInPandas(in_doubt, MEMBERS))
        bodies = self.bodies.join(doubted.select("node").distinct(), "node", "left_semi")
        # A node may stand for several rows with one id; any of its texts would bring its own links.
        full = doubted.join(bodies.mapInPandas(hashes, "node long, hashes binary"), "node")
        full = full.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
        with _small_batches(full.sparkSession, PAIRS_AT_ONCE):
            return cut(full.mapInPandas(links, "a long, b long"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks follow each other; one that goes on in the next batch waits for its parts."""
    parts: list[pd.DataFrame] = []
    current = None
    for batch in batches:
        if batch.empty:
            continue
        named = batch[_BLOCK].to_numpy()
        starts = [0, *np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1, len(batch)]
        for start, end in zip(starts, starts[1:]):
            if parts and tuple(named[start]) != current:
                yield pd.concat(parts, ignore_index=True)
                parts = []
            current = tuple(named[start])
            parts.append(batch.iloc[start:end])
    if parts:
        yield pd.concat(parts, ignore_index=True)


def _alike(block: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of both sides of a block, in different components, that the test keeps
    and that share no bucket of an earlier band."""
    right = block["right"].to_numpy(bool)
    component = block["component"].to_numpy()
    hashes = _signatures(block["signature"])
    bands = hashes.reshape(-1, BANDS, ROWS)
    band = int(block["band"].iloc[0])
    x, y = np.flatnonzero(~right), np.flatnonzero(right)
    step = max(1, 50_000 // max(len(y), 1))
    found = [(np.zeros(0, np.int64),) * 2]
    for start in range(0, len(x), step):
        i, j = np.nonzero(component[x[start : start + step], None] != component[None, y])
        i, j = x[start + i], y[j]
        near = agreements(hashes[i], hashes[j], threshold) >= 0
        i, j = i[near], j[near]
        same = (bands[i, : band + 1] == bands[j, : band + 1]).all(axis=2)
        first = same[:, band] & ~same[:, :band].any(axis=1)
        found.append((i[first], j[first]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _spanning_links(block: pd.DataFrame, threshold: float, percent: int) -> pd.DataFrame:
    """Verified pairs of a block, each of which joins components that those before it left apart."""
    left, right = _alike(block, threshold)
    nodes = block["node"].to_numpy()
    sizes = block["hashes"].map(len).to_numpy() // 8
    _, places = np.unique(np.frombuffer(b"".join(block["hashes"]), "<u8"), return_inverse=True)
    ends = np.cumsum(sizes)
    sets = [places[end - size : end] for end, size in zip(ends, sizes)]
    marked = np.zeros(len(places), bool)
    _, group = np.unique(block["component"].to_numpy(), return_inverse=True)
    above = list(range(len(group)))

    def top(place: int) -> int:
        while above[place] != place:
            above[place] = place = above[above[place]]
        return place

    found, last = [], None
    for i, j in zip(left.tolist(), right.tolist()):
        one, other = top(group[i]), top(group[j])
        if one == other or 100 * min(sizes[i], sizes[j]) < percent * max(sizes[i], sizes[j]):
            continue
        if i != last:
            if last is not None:
                marked[sets[last]] = False
            marked[sets[i]] = True
            last = i
        common = int(np.count_nonzero(marked[sets[j]]))
        if 100 * common >= percent * (int(sizes[i]) + int(sizes[j]) - common):
            above[one] = other
            found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


@contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Texts come in pairs, and some are very long: fewer of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that name their component, once for each doc_id, with all columns."""
    chosen = lambda: components(docs, words, percent).where("kept AND doc_id IS NOT NULL")
    kept = settled(docs.sparkSession, lambda: chosen().select("doc_id").distinct())
    own = Window.partitionBy("doc_id").orderBy("text")
    place = "_place_among_equal_ids"
    named = docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(own))
    named = named.where(F.col(place) == 1).select(docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))
