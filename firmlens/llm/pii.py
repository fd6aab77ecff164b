"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Four base kinds follow fixed patterns and rules: email, ip (parts to 255), card (16 to 19
digits with a valid Luhn sum) and phone (8 to 15 digits); a proposal that fails its rule is
dropped and not tried again. Two kinds come on top: iban, confirmed by its mod-97 check, and
shortcard, 13 to 15 digits with a valid Luhn sum that need a word of the trade nearby. Words
near a span raise its score; a kind's own confirmation sets where it starts.

Only DataFrame expressions. Matches and the text between them come from the same pattern,
so a span's place is the length of all before it. Each pattern is written so that a match
can only begin where a run of its first characters begins, or where the last match ended;
that gives the same matches as the plain pattern in time linear in the text, on any text.

A null text is empty. Rows are kept as they are, with repeated ids; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base kinds, as possessive patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"  # up to 255, with any zeros before it

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["iban", "shortcard"]
CONTEXT_CHARS = 48
# Words of the trade in the four languages of the tables, by kind.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|adresse|host|server",
    "card": "card|visa|master|amex|karte|carte|tarjeta|kredit|credit",
    "phone": "phone|call|tel|mobil|anruf|llam|appel",
    "iban": "iban|bank|konto|account|compte|cuenta",
    "shortcard": "card|visa|master|amex|karte|carte|tarjeta|kredit|credit",
}
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "shortcard": 0.3}
NEARBY = 0.2
LEAST = 0.5
_CHUNK = 128


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn sum."""
    back = F.split(F.reverse(digits), "")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(
        F.filter(back, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number passes its mod-97 check."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    count = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(count.between(16, 19), luhn(_digits(match))).otherwise(False)
    if kind == "shortcard":
        return F.when(count.between(13, 15), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return count.between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), mod97(match)).otherwise(False)
    return F.lit(True)


_SHAPE = "array<struct<start:int,end:int,text:string>>"


def _moves(gaps: Column, matches: Column) -> Column:
    """For each match the length of what lies before it, its own length, and its text.
    ``gaps``: the stretches between matches, one more than there are matches."""
    return F.zip_with(
        F.slice(gaps, F.lit(1), F.greatest(F.size(matches), F.lit(1))),
        matches,
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("text")
        ),
    )


# A match has two characters and a gap one at least: so many reach over the context.
_NEIGHBOURS = CONTEXT_CHARS // 3


def _surroundings(gaps: Column, matches: Column) -> Column:
    """What lies within reach before and after each match, from the ends of the gaps and matches
    next to it: no text is searched from its start for a place in it."""
    last = lambda c: F.right(c, F.lit(CONTEXT_CHARS))
    first = lambda c: F.left(c, F.lit(CONTEXT_CHARS))
    count = F.size(matches)
    ends = F.struct(
        F.transform(gaps, last).alias("gap_ends"),
        F.transform(gaps, first).alias("gap_heads"),
        F.zip_with(F.slice(gaps, F.lit(1), count), matches, lambda g, m: F.concat(last(g), last(m))).alias("before"),
        F.zip_with(matches, F.slice(gaps, F.lit(2), count), lambda m, g: F.concat(first(m), first(g))).alias("after"),
    )

    def around(e: Column) -> Column:
        def of(at: Column) -> Column:
            reach = F.least(at, F.lit(_NEIGHBOURS))
            before = F.concat(F.array_join(F.slice(e["before"], at - reach + 1, reach), ""), e["gap_ends"][at])
            after = F.concat(e["gap_heads"][at + 1], F.array_join(F.slice(e["after"], at + 2, F.lit(_NEIGHBOURS)), ""))
            return F.concat(last(before), F.lit(" "), first(after))

        return F.transform(F.sequence(F.lit(0), count - 1), of)

    return F.transform(F.array(ends), around)[0]


def _placed(moves: Column) -> Column:
    """Matches in order, as (from, to, text).

    Running sums go over chunks of matches, then over the chunks, so that a text with very
    many matches does not copy its list for each of them.
    """

    def run(part: Column) -> Column:
        """Spans of one chunk from 0, and where the chunk ends."""
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SHAPE).alias("spans"))
        return F.aggregate(
            part,
            empty,
            lambda a, m: F.struct(
                (a["at"] + m["gap"] + m["size"]).alias("at"),
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + m["gap"]).alias("start"),
                            (a["at"] + m["gap"] + m["size"]).alias("end"),
                            m["text"].alias("text"),
                        )
                    ),
                ).alias("spans"),
            ),
        )

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(moves) - 1) / _CHUNK).cast("int")),
        lambda i: run(F.slice(moves, i * _CHUNK + 1, F.lit(_CHUNK))),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SHAPE}>").alias("spans"))
    moved = F.aggregate(
        chunks,
        begin,
        lambda a, c: F.struct(
            (a["at"] + c["at"]).alias("at"),
            F.concat(
                a["spans"],
                F.array(
                    F.transform(
                        c["spans"],
                        lambda s: F.struct(
                            (s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["text"].alias("text")
                        ),
                    )
                ),
            ).alias("spans"),
        ),
    )
    return F.when(F.size(moves) > 0, F.flatten(moved["spans"])).otherwise(F.array().cast(_SHAPE))


def _scored(kind: str, spans: Column, around: Column) -> Column:
    """Confirmed spans with a score; words of the trade are looked for on both sides."""
    scored = F.transform(
        F.filter(F.arrays_zip(spans.alias("span"), around.alias("around")), lambda s: _confirmed(kind, s["span"]["text"])),
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["span"]["start"].alias("start"),
            s["span"]["end"].alias("end"),
            F.when(s["around"].rlike(f"(?i){CONTEXT[kind]}"), START[kind] + NEARBY).otherwise(START[kind]).alias("score"),
        ),
    )
    return scored if kind in KINDS else F.filter(scored, lambda s: s["score"] >= LEAST)


# What a text must hold at least for a pattern to be worth a try.
_TELLTALE = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
}
_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and a list of (kind, start, end, score) for each kind; places count
    code points from 0, the end is exclusive."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Step by step: what a later step reads more than once is computed once.
    text = F.col("text")
    found = {
        f"_{k}": F.when(text.rlike(_TELLTALE[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
        for k, p in _PATTERN.items()
    }
    some = lambda k: F.size(f"_{k}") > 0
    none = F.array().cast("array<struct<gap:int,size:int,text:string>>")
    out = out.withColumns(found)
    strings = F.array().cast("array<string>")
    out = out.withColumns({f"_gaps_{k}": F.when(some(k), F.split(text, p, -1)).otherwise(strings) for k, p in _PATTERN.items()})
    gaps = lambda k: F.col(f"_gaps_{k}")
    out = out.withColumns({f"_around_{k}": F.when(some(k), _surroundings(gaps(k), F.col(f"_{k}"))).otherwise(strings) for k in _PATTERN})
    out = out.withColumns({f"_{k}": F.when(some(k), _moves(gaps(k), F.col(f"_{k}"))).otherwise(none) for k in _PATTERN})
    out = out.withColumns({f"_{k}": _placed(F.col(f"_{k}")) for k in _PATTERN})
    source = lambda k: "card" if k == "shortcard" else k
    return out.select(
        "doc_id",
        "text",
        *(_scored(k, F.col(f"_{source(k)}"), F.col(f"_around_{source(k)}")).alias(k) for k in [*KINDS, *ADDED]),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The texts with every confirmed span replaced by its kind in angle brackets."""
    every = F.array_sort(F.concat(*KINDS, *ADDED), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    walked = F.aggregate(
        every,
        begin,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["parts"], F.array(F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"),
            )
        ),
    )
    found = find_spans(docs).withColumn("_walked", walked)
    return found.select(
        "doc_id",
        F.concat(F.concat_ws("", "_walked.parts"), F.substring("text", F.col("_walked.at") + 1, F.length("text"))).alias("text"),
    )
