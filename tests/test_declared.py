"""Reading by declared types against a plain recursive reader."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from firmlens.functions import declared as D

ORDER = D.record(
    {
        "order": D.WHOLE,
        "status": D.one_of("open", "done"),
        "note": D.maybe(D.TEXT),
        "total": D.record({"amount": D.NUMBER, "currency": D.default(D.TEXT, "'USD'")}),
        "lines": D.list_of(
            D.record({"quantity": D.WHOLE, "final": D.FLAG, "tags": D.default(D.maybe(D.list_of(D.maybe(D.TEXT))), "array('none')")})
        ),
        "sizes": D.maybe(D.list_of(D.list_of(D.NUMBER))),
    }
)


class Fault(Exception):
    pass


def pairs(items):
    if len({k for k, _ in items}) < len(items):
        raise ValueError("repeated key")
    return dict(items)


def plain(kind, v, place):
    """Value of a parsed JSON value by a declared type, or the first fault."""
    if isinstance(kind, D._Default):
        return plain(kind.inner, v, place)
    if isinstance(kind, D._Maybe):
        return None if v is None else plain(kind.inner, v, place)
    if v is None:
        raise Fault(f"{place}: null")
    if isinstance(kind, D._List):
        if not isinstance(v, list):
            raise Fault(f"{place}: not a list")
        return [plain(kind.item, x, f"{place}[{i}]") for i, x in enumerate(v)]
    if isinstance(kind, D._Record):
        if not isinstance(v, dict):
            raise Fault(f"{place}: not an object")
        out = {}
        for name, inner in kind.fields:
            if name in v:
                out[name] = plain(inner, v[name], f"{place}.{name}")
            elif inner.fallback is None:
                raise Fault(f"{place}.{name}: missing")
            else:
                out[name] = {"'USD'": "USD", "array('none')": ["none"]}[inner.fallback]
        return out
    found = atom(kind, v)
    if found is None:
        raise Fault(f"{place}: not {kind.name}")
    return found


def atom(kind, v):
    text = v.strip(D.BLANKS) if isinstance(v, str) else None
    if isinstance(v, (list, dict)):
        return None
    if kind is D.WHOLE:
        if text is not None:
            v = float(text) if re.match(D.WHOLE_NUMBER, text) else None
        return int(v) if v is not None and v == math.floor(v) and abs(v) < 2**31 else None
    if kind is D.NUMBER:
        if text is not None:
            return float(text) if re.match(D.DECIMAL_NUMBER, text) else None
        return float(v)
    if kind is D.FLAG:
        if isinstance(v, str):
            return True if v.lower() in D.TRUE_WORDS else False if v.lower() in D.FALSE_WORDS else None
        return {1: True, 0: False}.get(v)
    if not isinstance(v, str):
        return None
    return v if kind is D.TEXT or v in kind.name.removeprefix("one of ").split(", ") else None


def expected(raw):
    try:
        value = json.loads(raw, object_pairs_hook=pairs) if raw is not None else Fault
        if value is Fault:
            return "$: not JSON", None
    except ValueError:
        return "$: not JSON", None
    try:
        return None, plain(ORDER, value, "$")
    except Fault as fault:
        return str(fault), None


ATOMS = [None, True, False, 0, 1, 7, -3, 7.0, 7.5, 1e3, 2**31, "7", " 7.0 ", "7.5", "x", "", "open", "done", "YES", "off", "1e2", ".5", [], {}, [1]]


def anything(rng, kind, odd):
    if rng.random() < odd:
        return rng.choice(ATOMS)
    if isinstance(kind, (D._Maybe, D._Default)):
        return None if kind.nullable and rng.random() < 0.2 else anything(rng, kind.inner, odd)
    if isinstance(kind, D._List):
        return [anything(rng, kind.item, odd) for _ in range(rng.randrange(4))]
    if isinstance(kind, D._Record):
        out = {n: anything(rng, k, odd) for n, k in kind.fields if rng.random() > (0.4 if k.fallback else odd / 2)}
        if rng.random() < 0.2:
            out["more"] = rng.choice(ATOMS)
        return dict(rng.sample(list(out.items()), len(out)))
    good = {D.WHOLE: [5, "7", 7.0, True], D.NUMBER: [1.25, 3, "2.5"], D.FLAG: [True, "no", 0], D.TEXT: ["x", "é\n"]}
    return rng.choice(good.get(kind, ["open", "done"]))


def read_all(spark, texts, kind=ORDER):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    rows = df.select("id", D.read(F.col("raw"), kind).alias("r")).orderBy("id").collect()
    return [(r.r.fault, None if r.r.value is None else r.r.value.asDict(recursive=True)) for r in rows]


def test_random_documents(spark):
    rng = random.Random(6)
    texts = [json.dumps(anything(rng, ORDER, odd)) for odd in (0, 0.02, 0.1) for _ in range(400)]
    texts += [None, "", "no", "{", "[]", "3", "null", '{"order": 1, "order": 2}', "{}"]
    wanted = [expected(t) for t in texts]
    assert read_all(spark, texts) == wanted
    assert sum(f is None for f, _ in wanted) > 300 and len({re.sub(r"\d+", "", f) for f, _ in wanted if f}) > 20


def test_the_schema_is_the_declared_one(spark):
    df = spark.createDataFrame([("{}",)], "raw string")
    kind = df.select(D.read(F.col("raw"), ORDER)["value"].alias("v")).schema["v"].dataType.simpleString()
    assert kind.replace(" ", "") == ORDER.ddl.replace(" ", "").replace("`", "")


def test_roots_that_are_not_records(spark):
    df = spark.createDataFrame([("[1, 2]",), ("[1, null]",), ('"a"',)], "raw string")
    found = [r.r for r in df.select(D.read(F.col("raw"), D.list_of(D.WHOLE)).alias("r")).collect()]
    assert [(r.fault, r.value) for r in found] == [(None, [1, 2]), ("$[1]: null", None), ("$: not a list", None)]


def test_fields_apart(spark):
    kind = D.record({"a": D.WHOLE, "b": D.maybe(D.TEXT), "c": D.default(D.FLAG, "true")})
    df = spark.createDataFrame([('{"a": 1.5, "b": null}',), ("[]",), (None,)], "raw string")
    one, *others = [r.r for r in df.select(D.read_fields(F.col("raw"), kind).alias("r")).collect()]
    assert [tuple(one[n]) for n in "abc"] == [(".a: not a whole number", None), (None, None), (None, True)]
    assert others == [None, None]


def test_no_python_worker(spark):
    df = spark.range(1).select(D.read(F.col("id").cast("string"), ORDER).alias("r"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_an_empty_record_is_refused():
    with pytest.raises(ValueError):
        D.record({})
