"""Conversation repair against an exhaustive search and a plain cheapest-path computation."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from cases import prose

from firmlens.llm import conversations
from firmlens.llm.queries import op12_repair

SF_DIR = "/root/testdata/sf0.001"
BLANK = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        plain = text.strip(BLANK)
        if not plain:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("sound" if plain[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """(cost, audit, repaired rows) from the end backwards; whole strings are compared."""
    kinds = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserts):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in follow[last]:
                    cost, audit, rest = best(i, role[0], inserts + 1)
                    ways.append((cost + 5, "I" + audit, ((role, ""), *rest)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, rest = best(i + 1, last, 0)
            ways.append((cost + 2, "D" + audit, rest))
            if kinds[i] in ("sound", "truncated"):
                extra = 5 * (kinds[i] == "truncated")
                if role and role[0] in follow[last]:
                    cost, audit, rest = best(i + 1, role[0], 0)
                    ways.append((cost + extra, "K" + audit, ((role, text), *rest)))
                for new in ("user", "assistant"):
                    if new[0] in follow[last]:
                        cost, audit, rest = best(i + 1, new[0], 0)
                        ways.append((cost + extra + 1, "R" + audit, ((new, text), *rest)))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):
        for last in follow:
            best(i, last, 0)
    return best(0, "", 0)


def every_repair(rows):
    """The same from all edit sequences of a tiny conversation."""
    kinds, best = faults(rows), None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(["K", "D", "user", "assistant"], repeat=len(rows)):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                cost += 5 * len(gaps[i])
                audit += "I" * len(gaps[i])
                out += [(r, "") for r in gaps[i]]
                if i == len(rows):
                    break
                if edits[i] == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if kinds[i] in ("blank", "duplicate"):
                    cost = 10**6
                cost += (edits[i] != "K") + 5 * (kinds[i] == "truncated")
                audit += "K" if edits[i] == "K" else "R"
                out.append((rows[i][0] if edits[i] == "K" else edits[i], rows[i][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, tuple(out))
    return best


def brute_report(conv_rows):
    """Result columns of one conversation from its (turn, role, text) in order."""
    rows = [(r, t) for _, r, t in conv_rows]
    kinds = faults(rows)
    turns = {t for t, _, _ in conv_rows if t is not None}
    cost, audit, out = brute_repair(tuple(rows))
    initials = [r[:1] for r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def brute_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def by_conversation(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    out = {}
    for row in sorted(rows, key=key):
        out.setdefault(row[0], []).append(row[1:])
    return out


def wanted(original, damaged):
    found = by_conversation(damaged)
    return {conv: brute_report(found.get(conv, [])) for conv in {r[0] for r in original}}


def collected(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r.pop("conv_id"): r for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(rng, conv, size):
    texts = ["One.", "Two!", "Cut off", "", "  \n", *(f"Text {i}{'.' * (i % 3 > 0)}" for i in range(40))]
    return [
        (conv, i + rng.randrange(2), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", " "]), rng.choice(texts))
        for i in range(size)
    ]


def test_plain_computation_equals_all_sequences():
    rng = random.Random(3)
    for size in (0, 1, 2, 3):
        for _ in range(3 if size == 3 else 12):
            rows = tuple((r, t) for _, _, r, t in random_rows(rng, 0, size))
            assert brute_repair(rows) == every_repair(rows)


SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int, number int"


def test_repairs_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [r for conv in range(250) for r in random_rows(rng, conv, rng.randrange(1, 14))]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    assert collected(conversations.report(df, df)) == wanted(rows, rows)


def test_a_conversation_over_many_ranges(spark):
    """One conversation has most rows: it is split by range, and the parts fit together."""
    rng = random.Random(5)
    rows = random_rows(rng, 7, 400) + random_rows(rng, 1, 6) + random_rows(rng, 9, 60)
    rows += [(8, i, "user", "") for i in range(150)] + [(8, 150, "user", "A."), (8, 151, "assistant", "B.")]
    rows += [(6, i, "system" if i < 90 else "assistant", "x") for i in range(120)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered, texts = conversations.prepared(df)
        edits = conversations.find_edits(ordered)
        assert edits.where("conv_id = 7").select("part").distinct().count() > 1
        assert collected(conversations.report(df, df)) == wanted(rows, rows)
        rebuilt = [tuple(r) for r in conversations.repaired(ordered, texts, edits).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for conv, found in by_conversation(rows).items():
        out = brute_repair(tuple((r, t) for _, r, t in found))[2]
        assert [r[1:] for r in rebuilt if r[0] == conv] == list(out)


def test_settled_edits_leave_the_tree():
    """Memory: after a long legal conversation the tree holds a few rows only."""
    seen = []
    paths = conversations._Paths(conversations.START, lambda state, node, inserts: seen.append(node.edits))
    for i in range(5000):
        paths.add(conversations._symbol("ua"[i % 2], 0), i)
    assert len(seen) > 4990
    paths.finish(None)
    assert seen == ["K"] * 5000


def test_odd_rows(spark):
    rows = [
        (None, None, None, None),
        (None, 3, "user", "A question?"),
        (None, 3, "user", "A question?"),
        (1, None, "user", "No turn."),
        (1, 2**40, "assistant", "Far away."),
        (1, -5, "", "No role."),
        (2, None, "system", " \v"),
        (2, None, "system", None),
        (3, 0, "User", prose(20_000, 3) + "."),
        (3, 1, "assistant", "x" * 200_000 + "! "),
        (3, 2, "assistant", "é.\n"),
        (2**60, 1, "user", "Large id."),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(2)
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert collected(conversations.report(df, df)) == wanted(rows, spaced)
    assert collected(conversations.report(df, conversations.damaged(df))) == wanted(rows, brute_damaged(rows))


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.report(df, df).count() == 0


def test_a_conversation_without_rows_after_damage(spark):
    rows = [(i, 0, "user", "Hi.") for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    found = collected(conversations.report(df, conversations.damaged(df)))
    assert found == wanted(rows, brute_damaged(rows))
    empty = [r for r in found.values() if r["audit"] == ""]
    assert empty and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_repair_query(spark, scale):
    folder = SF_DIR.replace("sf0.001", scale)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op12_repair(spark, folder)
    assert {c: t for c, t in found.dtypes if t != "bigint"} == {"audit": "string", "repaired_sha256": "string"}
    assert collected(found) == wanted(rows, brute_damaged(rows))
