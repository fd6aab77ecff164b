"""Reading JSON by a declared type, strictly, with the place of the first fault.

A type is built from atoms (``TEXT``, ``WHOLE``, ``NUMBER``, ``FLAG``, ``one_of``), lists and
records::

    ORDER = record({
        "order": WHOLE,
        "status": one_of("open", "done"),
        "note": maybe(TEXT),
        "lines": list_of(record({"quantity": NUMBER, "tags": default(list_of(TEXT), "array()")})),
    })
    rows.select(read(F.col("raw"), ORDER).alias("read"))   # struct<fault, value>

It is compiled to VARIANT expressions that stay in the JVM: no UDF, no schema inference.
``value`` has the Spark type of the declaration and is null when there is a fault; ``fault``
names the first place, in the order of the declaration and of the lists, that does not fit,
such as ``$.lines[2].quantity: not a number``.

Keys must be present unless they have a default; null is a fault unless ``maybe`` allows it.
Unknown keys are ignored. Atoms take what a strict reader with number coercion takes: texts
only from texts; whole numbers also from ``"7"``, ``7.0`` and ``true``, up to 32 bits; numbers
also from such texts and booleans; booleans also from 0, 1 and the usual words. A null text
and a text that is not JSON, or that repeats a key, are faults of the whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a text must look like to be taken for a number, and words for booleans.
WHOLE_NUMBER = r"^[+-]?[0-9]+([.]0+)?$"
DECIMAL_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
TRUE_WORDS = ["true", "t", "yes", "y", "on", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "off", "0"]
BLANKS = " \t\n\r\f\v"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def _text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def string_value(value: Column) -> Column:
    """The text of a JSON string; null for every other type."""
    return F.when(F.schema_of_variant(value) == "STRING", _text_of(value))


def int_value(value: Column) -> Column:
    """The integer a strict reader with number coercion accepts, else null.

    7, 7.0, "7", " 7.0 " and true are integers; 7.5, null, lists and objects are
    not. Whole numbers beyond 32 bits do not fit the column and are rejected.
    """
    kind = F.schema_of_variant(value)
    text = F.btrim(_text_of(value), F.lit(BLANKS))
    number = F.try_variant_get(value, "$", "decimal(38,10)")
    return (
        F.when(
            kind == "STRING",
            F.when(text.rlike(WHOLE_NUMBER), text.try_cast("decimal(38,10)").try_cast("int")),
        )
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .when(_is_number(kind), F.when(number == F.floor(number), number.try_cast("int")))
    )


def number_value(value: Column) -> Column:
    """A finite number as a double: from numbers, their texts and booleans."""
    kind = F.schema_of_variant(value)
    text = F.btrim(_text_of(value), F.lit(BLANKS))
    number = (
        F.when(kind == "STRING", F.when(text.rlike(DECIMAL_NUMBER), text.try_cast("double")))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
        .when(_is_number(kind), F.try_variant_get(value, "$", "double"))
    )
    return F.when(F.abs(number) < float("inf"), number)


def flag_value(value: Column) -> Column:
    """A boolean: true, false, 0, 1, and the usual words in any case."""
    kind = F.schema_of_variant(value)
    word = F.lower(_text_of(value))
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False))
        .when(_is_number(kind), F.when(number == 1, True).when(number == 0, False))
    )


def _found(fault: Column, value: Column) -> Column:
    return F.struct(fault.alias("fault"), F.when(fault.isNull(), value).alias("value"))


NO_FAULT = "cast(null as string)"


class Declared:
    """A declared type. ``read`` gives struct<fault, value> for a VARIANT that is present."""

    ddl: str
    nullable = False
    fallback: str | None = None

    def read(self, value: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class _Atom(Declared):
    ddl: str
    name: str
    convert: Callable[[Column], Column]

    def read(self, value: Column) -> Column:
        return _let(self.convert(value), lambda v: _found(F.when(v.isNull(), F.lit(f": not {self.name}")), v))


TEXT = _Atom("string", "a text", string_value)
WHOLE = _Atom("int", "a whole number", int_value)
NUMBER = _Atom("double", "a number", number_value)
FLAG = _Atom("boolean", "a boolean", flag_value)


def one_of(*words: str) -> Declared:
    """A text out of a fixed set."""

    def convert(value: Column) -> Column:
        return _let(string_value(value), lambda v: F.when(v.isin(*words), v))

    return _Atom("string", "one of " + ", ".join(words), convert)


@dataclass(frozen=True)
class _Maybe(Declared):
    inner: Declared
    nullable = True

    @property
    def ddl(self) -> str:
        return self.inner.ddl

    def read(self, value: Column) -> Column:
        nothing = F.struct(F.expr(NO_FAULT).alias("fault"), F.lit(None).cast(self.ddl).alias("value"))
        return F.when(F.is_variant_null(value), nothing).otherwise(self.inner.read(value))


def maybe(inner: Declared) -> Declared:
    """The type or null; the key must be there."""
    return _Maybe(inner)


@dataclass(frozen=True)
class _Default(Declared):
    inner: Declared
    fallback: str

    @property
    def ddl(self) -> str:
        return self.inner.ddl

    @property
    def nullable(self) -> bool:
        return self.inner.nullable

    def read(self, value: Column) -> Column:
        return self.inner.read(value)


def default(inner: Declared, value: str) -> Declared:
    """The type, or the value of an SQL expression where the key is absent."""
    return _Default(inner, value)


@dataclass(frozen=True)
class _List(Declared):
    item: Declared

    @property
    def ddl(self) -> str:
        return f"array<{self.item.ddl}>"

    def read(self, value: Column) -> Column:
        def judged(items: Column) -> Column:
            read = F.transform(items, lambda item, at: _let(item, lambda i: _placed(self.item, i, F.concat(F.lit("["), at, F.lit("]")))))
            return _let(
                read,
                lambda r: _found(
                    F.when(items.isNull(), F.lit(": not a list")).otherwise(
                        F.try_element_at(F.filter(F.transform(r, lambda x: x["fault"]), lambda f: f.isNotNull()), F.lit(1))
                    ),
                    F.transform(r, lambda x: x["value"]),
                ),
            )

        return _let(F.try_variant_get(value, "$", "array<variant>"), judged)


def list_of(item: Declared) -> Declared:
    return _List(item)


def _placed(kind: Declared, value: Column, place: Column) -> Column:
    """Read a value that is there, with its place in front of its fault."""
    read = kind.read(value)
    if not kind.nullable:
        missing = F.struct(F.lit(": null").alias("fault"), F.lit(None).cast(kind.ddl).alias("value"))
        read = F.when(F.is_variant_null(value), missing).otherwise(read)
    return _let(read, lambda r: F.struct(F.concat(place, r["fault"]).alias("fault"), r["value"].alias("value")))


@dataclass(frozen=True)
class _Record(Declared):
    fields: tuple[tuple[str, Declared], ...]

    @property
    def ddl(self) -> str:
        return "struct<" + ", ".join(f"`{n}`: {t.ddl}" for n, t in self.fields) + ">"

    def each(self, keys: Column) -> list[Column]:
        """struct<fault, value> of every field, from a map of the keys that are there."""
        out = []
        for name, kind in self.fields:
            if kind.fallback is None:
                absent = F.struct(F.lit(f".{name}: missing").alias("fault"), F.lit(None).cast(kind.ddl).alias("value"))
            else:
                absent = F.struct(F.expr(NO_FAULT).alias("fault"), F.expr(kind.fallback).cast(kind.ddl).alias("value"))
            there = _bound(keys[name], kind, F.lit(f".{name}"))
            out.append(F.when(F.map_contains_key(keys, name), there).otherwise(absent))
        return out

    def read(self, value: Column) -> Column:
        def judged(keys: Column) -> Column:
            read = F.struct(*(f.alias(f"f{at}") for at, f in enumerate(self.each(keys))))
            return F.when(keys.isNull(), F.struct(F.lit(": not an object").alias("fault"), F.lit(None).cast(self.ddl).alias("value"))).otherwise(
                _let(read, self._whole)
            )

        return _let(F.try_variant_get(value, "$", "map<string,variant>"), judged)

    def _whole(self, read: Column) -> Column:
        parts = [read[f"f{at}"] for at in range(len(self.fields))]
        fault = F.coalesce(*(p["fault"] for p in parts), F.expr(NO_FAULT))
        return _found(fault, F.struct(*(p["value"].alias(n) for p, (n, _) in zip(parts, self.fields, strict=True))))


def _bound(value: Column, kind: Declared, place: Column) -> Column:
    return _let(value, lambda v: _placed(kind, v, place))


def record(fields: dict[str, Declared]) -> Declared:
    """An object with these keys, in this order; others are ignored."""
    if not fields:
        raise ValueError("a record needs a field")
    return _Record(tuple(fields.items()))


def read(raw: Column, kind: Declared) -> Column:
    """``struct<fault, value>`` of a JSON text."""
    nothing = lambda text: F.struct(F.lit(f"$: {text}").alias("fault"), F.lit(None).cast(kind.ddl).alias("value"))
    return _let(
        F.try_parse_json(raw),
        lambda v: F.when(v.isNull(), nothing("not JSON")).otherwise(_placed(kind, v, F.lit("$"))),
    )


def read_fields(raw: Column, kind: Declared) -> Column:
    """For a record: ``struct<fault, value>`` of each field apart, named as declared, so that one
    bad field does not hide the others. Null when the text is not a JSON object."""
    if not isinstance(kind, _Record):
        raise TypeError("only the fields of a record can be read apart")
    names = [n for n, _ in kind.fields]
    return _let(
        F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"),
        lambda keys: F.when(keys.isNotNull(), F.struct(*(f.alias(n) for n, f in zip(names, kind.each(keys), strict=True)))),
    )
