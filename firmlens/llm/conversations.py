"""Conversation structure repair: the cheapest edits that give every conversation legal roles.

The initials of the roles have to read ``(s?(ua)+)?``. A row is kept (K, costs 0), gets the
role user or assistant (R, 1) or is deleted (D, 2; the only choice for blank rows and for
duplicates); rows with empty text and role user or assistant are inserted (I, 5); a truncated
row that stays costs 5 more. Of equally cheap edits those whose initials, in order, come
first in ASCII are taken.

Viterbi over four states with survivor coalescence. Paths are kept as a tree of back pointers
in which every node counts the paths that still need it; a node that none needs goes at once,
and as soon as all survivors share an ancestor, all edits up to it are final and leave the
task. Survivors that no continuation can save are dropped. Ties go by the whole unresolved
suffixes: inserts are written before the row that follows them, so the edits of one row are
never the beginning of other edits of it, and the order of two suffixes is the order of
their first rows that differ. That order is kept as a rank for each survivor, which compares
complete suffixes at the price of two numbers. A task holds the unresolved stretch, at most
the rows of one range of the sort.

A conversation may hold any share of all rows: rows are sorted by range, and a conversation
that meets several ranges is solved range by range for every state it can begin in; these
small tables, one per range, are then joined by the same rule, and each range is walked again
between the states found. Only a digest over a whole conversation is computed in one stream.

A null role or text is one space. Rows come by turn, nulls first; rows of the same turn by
role, then digest of the text. A null conv_id is a conversation of its own. Repeated rows are
duplicates. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut

BLANKS = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States are named after the last role that was given out; START: none yet.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = "sua"  # others follow as one class
_SOUND, _CUT_OFF, _GONE = range(3)  # rows that may stay, that may at a price, that must go

# What state x pays at most to follow the best continuation of state y.
_DETOUR = {
    START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """States that inserts lead to, with the number of inserts."""
    seen, count = [], 0
    while state not in seen:
        yield state, count
        seen.append(state)
        state = next(to for to in _NEXT[state].values() if to in _NAMES)
        count += 1


def _moves(initial: str, fault: int) -> list[tuple[int, list]]:
    """For each state after a row: the states before it, with cost and edits."""
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(source, target, cost, edits):
        if (source, target) not in best or (cost, edits) < best[source, target]:
            best[source, target] = (cost, edits)

    for source in _NEXT:
        for state, count in _inserted(source):
            paid, edits = INSERT * count, "I" * count
            offer(source, state, paid + DELETE, edits + "D")
            if fault == _GONE:
                continue
            paid += TRUNCATED if fault == _CUT_OFF else 0
            for role, target in _NEXT[state].items():
                if role == initial:
                    offer(source, target, paid, edits + "K")
                if target in _NAMES:
                    offer(source, target, paid + REROLE, edits + "R")
    return [
        (target, [(source, *best[source, target]) for source in _NEXT if (source, target) in best])
        for target in _NEXT
    ]


_MOVES = [[_moves(initial, fault) for fault in range(3)] for initial in [*_INITIALS, ""]]
# Edits that end a conversation: inserts up to a state in which it may end.
_ENDS = {START: (0, 0), ASSISTANT: (0, 0), USER: (INSERT, 1), SYSTEM: (2 * INSERT, 2)}


def _follow(front: dict, moves) -> dict:
    """One step of all survivors: state -> (cost, rank, state before, edits).

    ``front`` has cost and rank of each survivor. Equal costs go by rank, then by edits."""
    found = {}
    for target, ways in moves:
        best = None
        for source, cost, edits in ways:
            held = front.get(source)
            if held is not None:
                way = (held[0] + cost, held[1], edits, source)
                if best is None or way < best:
                    best = way
        if best is not None:
            found[target] = best
    alive = {
        y: way
        for y, way in found.items()
        if all(other[0] + _DETOUR[x][y] >= way[0] for x, other in found.items() if x != y)
    }
    order = sorted(alive, key=lambda s: alive[s][1:3])
    ranks = {state: place for place, state in enumerate(order)}
    return {s: (way[0], ranks[s], way[3], way[2]) for s, way in alive.items()}


class _Node:
    """The edits of one row on a path; ``heirs`` are the nodes that build on it."""

    __slots__ = ("before", "edits", "heirs", "row", "state")

    def __init__(self, before, state, edits, row):
        self.before, self.state, self.edits, self.row = before, state, edits, row
        self.heirs = []


class _Paths:
    """Survivors of one stretch of rows from one state on."""

    def __init__(self, entry: int, emit: Callable | None):
        self.root = _Node(None, entry, "", None)
        self.front = {entry: (0, 0)}
        self.leaves = {entry: self.root}
        self.emit = emit

    def add(self, symbol, row) -> None:
        step = _follow(self.front, _MOVES[symbol[0]][symbol[1]])
        self.front = {s: (cost, rank) for s, (cost, rank, _, _) in step.items()}
        if self.emit is None:
            return
        old, self.leaves = self.leaves, {}
        for state, (_, _, source, edits) in step.items():
            node = self.leaves[state] = _Node(old[source], state, edits, row)
            old[source].heirs.append(node)
        for node in old.values():
            while not node.heirs and node.before is not None:
                node.before.heirs.remove(node)
                node = node.before
        while len(self.root.heirs) == 1:
            self._settle(self.root.heirs[0])

    def _settle(self, node: _Node, inserts: int = 0) -> None:
        self.emit(self.root.state, node, inserts)
        node.before, self.root = None, node

    def finish(self, leave: int | None) -> None:
        """Settle what is left of the path to ``leave``, or of the best path that may end."""
        if leave is None:
            leave = min(self.front, key=lambda s: (self.front[s][0] + _ENDS[s][0], self.front[s][1]))
            inserts = _ENDS[leave][1]
        else:
            inserts = 0
        path, node = [], self.leaves[leave]
        while node is not self.root:
            path.append(node)
            node = node.before
        for node in reversed(path[1:]):
            self._settle(node)
        if path:
            self._settle(path[0], inserts)


def _symbol(initial: str, fault: int) -> tuple[int, int]:
    return (_INITIALS.find(initial) if initial and initial in _INITIALS else 3, fault)


def _roles(state: int, count: int) -> tuple[list[str], int]:
    out = []
    for _ in range(count):
        state = next(to for to in _NEXT[state].values() if to in _NAMES)
        out.append(_NAMES[state])
    return out, state


def prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order with what the edits depend on, and their texts, each written once: fault (blank, duplicate, truncated or
    null) and the order within the conversation: turn, role, digest of the text, number."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    trimmed = F.rtrim("text", F.lit(BLANKS))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text")).select(
        "*",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").alias("own"),
        F.monotonically_increasing_id().alias("number"),
    )
    out = cut(out)
    spoken = out.where("own is distinct from 'blank'")
    first = F.min(F.struct("turn", "number"))["number"].alias("number")
    firsts = spoken.groupBy("conv_id", "role", "digest").agg(first).select("number", F.lit(True).alias("first"))
    marked = out.drop("text").join(firsts, "number", "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("own"))
    marked = marked.select("conv_id", "turn", "role", "digest", "number", fault.alias("fault"))
    order = ["conv_id", "turn", "role", "digest", "number"]
    return cut(
        marked.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33))
    ), out


def _streams(rows: DataFrame) -> DataFrame:
    """Stretches, (conv_id, part), whole and in order within a task."""
    kind = F.when(F.col("fault").isin("blank", "duplicate"), _GONE).when(F.col("fault") == "truncated", _CUT_OFF).otherwise(_SOUND)
    return (
        rows.withColumns({"initial": F.substring("role", 1, 1), "kind": kind})
        .repartition("conv_id", "part")
        .sortWithinPartitions("conv_id", "part", "place")
    )


def _stretches(batches, names: list[str]):
    """Rows of batches as tuples, with a flag for the first row of each stretch."""
    last = object()
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            yield row[:2] != last, row
            last = row[:2]


_TABLE = "part long, enter int, leave int, cost long, rank int"
_GATES = "part long, enter int, leave int"
_CHUNK = 20_000


def _schema(like: DataFrame, rest: str) -> str:
    return f"conv_id {like.schema['conv_id'].dataType.simpleString()}, {rest}"


class _Rows:
    """Collects output rows and gives them as batches."""

    def __init__(self, names: list[str], types: pa.Schema):
        self.names, self.types, self.rows = names, types, []

    def take(self, least: int = _CHUNK):
        if len(self.rows) >= max(least, 1):
            columns = list(zip(*self.rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, self.types.types, strict=True)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(arrays, schema=self.types)


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def _tables(key: pa.DataType):
    """Costs and ranks of each stretch from every state to every state."""
    types = pa.schema(
        [("conv_id", key), ("part", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]
    )

    def run(batches):
        out = _Rows(types.names, types)
        paths, at = [], None

        def close():
            for p in paths:
                out.rows.extend((*at, p.root.state, s, cost, rank) for s, (cost, rank) in p.front.items())

        for fresh, row in _stretches(batches, ["conv_id", "part", "initial", "kind"]):
            if fresh:
                close()
                paths, at = [_Paths(s, None) for s in _NEXT], row[:2]
            for p in paths:
                p.add(_symbol(row[2], row[3]), None)
            yield from out.take()
        close()
        yield from out.take(1)

    return run


def _gates(key: pa.DataType):
    """From the tables of a conversation's stretches, the states the best path has between them."""
    types = pa.schema([("conv_id", key), ("part", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])

    def solve(conv, tables):
        front, back = {START: (0, 0)}, []
        for _, table in tables:
            moves = [(t, [(s, *table[s, t]) for s in _NEXT if (s, t) in table]) for t in _NEXT]
            step = _follow(front, moves)
            back.append({s: way[2] for s, way in step.items()})
            front = {s: way[:2] for s, way in step.items()}
        at = min(front, key=lambda s: (front[s][0] + _ENDS[s][0], front[s][1]))
        leave = None  # the last stretch ends the conversation
        for (part, _), before in zip(reversed(tables), reversed(back), strict=True):
            yield (conv, part, before[at], leave)
            at = leave = before[at]

    def run(batches):
        out = _Rows(types.names, types)
        conv, tables = None, []
        last = object()
        for fresh, (key_, part, enter, leave, cost, rank) in _stretches(batches, ["conv_id", "part", "enter", "leave", "cost", "rank"]):
            if fresh and (not tables or key_ != last):
                out.rows.extend(solve(conv, tables) if tables else ())
                conv, tables, last = key_, [], key_
            if fresh:
                tables.append((part, {}))
            tables[-1][1][enter, leave] = (cost, rank)
            yield from out.take()
        out.rows.extend(solve(conv, tables) if tables else ())
        yield from out.take(1)

    return run


def _walk(key: pa.DataType):
    """The edits of every row, given the states before and after each stretch."""
    roles = pa.list_(pa.string())
    types = pa.schema(
        [("conv_id", key), ("part", pa.int64()), ("place", pa.int64()), ("number", pa.int64()), ("before", roles)]
        + [("edit", pa.string()), ("new_role", pa.string()), ("after", roles), ("cost", pa.int32())]
    )

    def run(batches):
        out = _Rows(types.names, types)
        paths, at, leave = None, None, None

        def emit(state, node, inserts):
            place, number, role, kind = node.row
            before, state = _roles(state, len(node.edits) - 1)
            edit = node.edits[-1]
            given = {"K": role, "R": _NAMES.get(node.state), "D": None}[edit]
            after, _ = _roles(node.state, inserts)
            cost = INSERT * (len(before) + inserts) + {"K": 0, "R": REROLE, "D": DELETE}[edit]
            cost += TRUNCATED if kind == _CUT_OFF and edit != "D" else 0
            out.rows.append((*at, place, number, before, edit, given, after, cost))

        names = ["conv_id", "part", "initial", "kind", "enter", "leave", "place", "number", "role"]
        for fresh, row in _stretches(batches, names):
            if fresh:
                if paths is not None:
                    paths.finish(leave)
                at, leave = row[:2], row[5]
                paths = _Paths(row[4], emit)
            paths.add(_symbol(row[2], row[3]), (*row[6:], row[3]))
            yield from out.take()
        if paths is not None:
            paths.finish(leave)
        yield from out.take(1)

    return run


def find_edits(ordered: DataFrame) -> DataFrame:
    """One row per row of ``prepared``: roles inserted before it, its edit (K, R or D), the role
    it gets, roles inserted after a conversation's last row, and the cost."""
    key = _arrow_type(ordered)
    stretches = ordered.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    # A conversation meets as many stretches as ranges, of which there are as many as partitions.
    many = cut(stretches.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1").select("conv_id", "part"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    if many.isEmpty():
        bounded = ordered.withColumns({"enter": F.lit(START), "leave": F.lit(None).cast("int")})
    else:
        split = ordered.join(many, same(ordered, many), "left_semi")
        tables = _streams(split).select("conv_id", "part", "initial", "kind").mapInArrow(_tables(key), _schema(ordered, _TABLE))
        tables = cut(tables).repartition("conv_id").sortWithinPartitions("conv_id", "part")
        gates = cut(tables.mapInArrow(_gates(key), _schema(ordered, _GATES)))
        met = ordered.join(gates, same(ordered, gates), "left")
        bounded = met.select(*(ordered[c] for c in ordered.columns), F.coalesce("enter", F.lit(START)).alias("enter"), "leave")
    columns = ["conv_id", "part", "initial", "kind", "enter", "leave", "place", "number", "role"]
    walked = _streams(bounded).select(*columns).mapInArrow(
        _walk(key),
        _schema(ordered, "part long, place long, number long, before array<string>, edit string, new_role string, after array<string>, cost int"),
    )
    return cut(walked)


def repaired(ordered: DataFrame, texts: DataFrame, edits: DataFrame, whole: bool = False) -> DataFrame:
    """The repaired rows, in order within each task: ``conv_id, role, text``.

    Text and edits of a row meet by their place in the order, so texts move once. ``whole``
    brings each conversation into one stream, for digests; otherwise ranges are split."""
    order = ["conv_id", "turn", "role", "digest", "number"]
    none = F.lit(None)
    own = ordered.select(*order).join(edits.select("number", "before", "edit", "new_role", "after"), "number")
    both = texts.select(*order, F.lit(1).alias("kind"), "text", none.cast("array<string>").alias("before"), none.cast("string").alias("edit"), none.cast("string").alias("new_role"), none.cast("array<string>").alias("after"))
    both = both.unionByName(own.select(*order, F.lit(0).alias("kind"), none.cast("string").alias("text"), "before", "edit", "new_role", "after"))
    dealt = both.repartition("conv_id") if whole else both.repartitionByRange(*order)
    types = pa.schema([("conv_id", _arrow_type(ordered)), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        out = _Rows(types.names, types)
        held = None
        for batch in batches:
            for conv, kind, text, before, edit, role, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    held = (before, edit, role, after)
                    continue
                before, edit, role, after = held
                out.rows.extend((conv, r, "") for r in before)
                if edit != "D":
                    out.rows.append((conv, role, text))
                out.rows.extend((conv, r, "") for r in after)
            yield from out.take(1)

    ready = dealt.sortWithinPartitions(*order, "kind").select("conv_id", "kind", "text", "before", "edit", "new_role", "after")
    return ready.mapInArrow(run, _schema(ordered, "role string, text string"))


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of its lines ``role:text``; rows of a conversation come together."""
    types = pa.schema([("conv_id", _arrow_type(rows)), ("repaired_sha256", pa.string())])

    def run(batches):
        out = _Rows(types.names, types)
        last, state = object(), None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if conv == last:
                    state.update(b"\n" + line)
                    continue
                if state is not None:
                    out.rows.append((last, state.hexdigest()))
                last, state = conv, hashlib.sha256(line)
            yield from out.take()
        if state is not None:
            out.rows.append((last, state.hexdigest()))
        yield from out.take(1)

    return rows.mapInArrow(run, _schema(rows, "repaired_sha256 string"))


def _illegal(ordered: DataFrame) -> DataFrame:
    """Neighbours whose initials do not read su, ua or au; across stretches by their ends."""
    bad = lambda a, b: (~F.concat(a, b).isin("su", "ua", "au")).cast("long")
    rows = ordered.withColumn("initial", F.substring("role", 1, 1))
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    stretches = (
        rows.withColumn("last", F.lag("initial").over(inside))
        .groupBy("conv_id", "part")
        .agg(
            F.sum(bad(F.col("last"), F.col("initial"))).alias("illegal"),
            F.min_by("initial", "place").alias("head"),
            F.max_by("initial", "place").alias("tail"),
        )
    )
    across = Window.partitionBy("conv_id").orderBy("part")
    seam = F.coalesce(bad(F.lag("tail").over(across), F.col("head")), F.lit(0))
    return stretches.select("conv_id", (F.coalesce("illegal", F.lit(0)) + seam).alias("illegal"))


def _counts(ordered: DataFrame) -> DataFrame:
    fault = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    turns = ordered.groupBy("conv_id", "turn").agg(*(fault(f) for f in ("blank", "duplicate", "truncated")))
    return turns.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
        *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )


def _audits(edits: DataFrame) -> DataFrame:
    letters = F.concat(F.repeat(F.lit("I"), F.size("before")), "edit", F.repeat(F.lit("I"), F.size("after")))
    joined = lambda by, what: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]), ""
    )
    parts = edits.withColumn("letters", letters).groupBy("conv_id", "part").agg(joined("place", "letters").alias("audit"), F.sum("cost").alias("cost"))
    return parts.groupBy("conv_id").agg(joined("part", "audit").alias("audit"), F.sum("cost").alias("cost"))


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, edits and repaired digest of every conv_id of ``conversations``, for ``rows``:
    zeros, no edits and the digest of nothing where it has no row."""
    ordered, texts = prepared(rows)
    edits = find_edits(ordered)
    numbers, words = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
    found = [
        conversations.select("conv_id").distinct(),
        _counts(ordered),
        _illegal(ordered),
        _audits(edits),
        digests(repaired(ordered, texts, edits, whole=True)),
    ]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in numbers),
        *(F.coalesce(F.max(w), F.lit(nothing[w])).alias(w) for w in words),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with one fault in four, by the checksum of ``conv_id:turn``: 0 of 20 goes, 1 loses
    its text, 2 its full stops, 3 stands twice, 4 is the user's. Nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.expr("array_repeat(0, copies)"))).drop("col")
