"""Line deduplication by log templates: a fixed-depth tree over token count and first tokens.

A line's tokens lie between white space; a token with a digit is a variable field, written
``<*>``. Lines with equally many tokens and equal first ``DEPTH`` tokens share a leaf. In a
leaf, a token is fixed at its place when lines of at least ``min_docs`` documents have it
there; all others are fields too. What is left is the line's template, as long as at least
``FIXED`` of the tokens stay fixed; a line with more fields than that keeps its own tokens.
A template that occurs in ``min_docs`` documents or more recurs: it stays in the document
with the smallest doc_id and is dropped from all others, whatever share of them it makes up.

Lines of fewer than ``MIN_TOKENS`` tokens have no fields: they recur as they are, if their tokens
have ``MIN_CHARS`` characters or more (text without spaces), and are never dropped if shorter.

Who wants copies of whole documents left to near-duplicate detection, which keeps one of a group,
names a share as ``copy``: nothing is dropped from documents of which that share of the tokens
recurs. Without it no document is an exception.

Only DataFrame expressions, all counts over all documents. Distinct documents are counted in
two steps, so that a line in a third of all documents meets in no single task; text moves
twice, and apart from that only hashes and the tokens of leaves with several kinds of lines.

A null text stays null and has no lines; repeated rows are one document; rows without doc_id
come before all others. Other columns are kept as they are. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut, settled

DEPTH = 3
MIN_DOCS = 2
MIN_TOKENS = 4
MIN_CHARS = 20
FIXED = 0.8
FIELD = "<*>"
_DOC, _BODY = "_doc_of_lines", "_text_of_lines"
_KEY = [_DOC, _BODY]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def _masked(line: Column, min_tokens: int) -> Column:
    """Tokens of a trimmed line that is not empty. Each pattern reads a line once: fields are
    looked for in lines with a digit and enough tokens, and only from where a token begins."""
    fields = F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD)
    enough = line.rlike(rf"^(?:\S++\s++){{{min_tokens - 1}}}\S")
    return F.split(F.when(line.rlike("[0-9]") & enough, fields).otherwise(line), r"\s+")


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is its id and its text, so that repeated rows are one."""
    least = F.lit(-(2**63)).cast("long")
    return docs.withColumns({_DOC: F.coalesce(F.col("doc_id").cast("long"), least), _BODY: F.xxhash64("text")})


def _count_documents(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return rows.groupBy(keys).agg(
        F.count_distinct(*_KEY).alias("docs"), F.min(F.struct(*_KEY)).alias("first"), *more
    )


def _lines(docs: DataFrame, min_tokens: int, min_chars: int) -> DataFrame:
    """Every line by its leaf and its own hash, and whether it is long enough; no text."""
    lines = _keyed(docs).where("text IS NOT NULL").select(
        *_KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    lines = lines.select(*_KEY, "line_no", _trimmed(F.col("line")).alias("line")).where("line != ''")
    lines = lines.select(*_KEY, "line_no", _masked(F.col("line"), min_tokens).alias("tokens"))
    return lines.select(
        *_KEY,
        "line_no",
        F.size("tokens").alias("n"),
        ((F.size("tokens") >= min_tokens) | (F.length(F.array_join("tokens", "")) >= min_chars)).alias("enough"),
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf"),
        F.xxhash64("tokens").alias("whole"),
    )


def _supported(found: DataFrame, kinds: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """``leaf, place, token`` that lines of at least ``min_docs`` different documents have.

    A kind of line in so many documents is enough by itself. Each other kind is in fewer than
    ``min_docs``, so their documents can be listed and counted once, whatever their kinds."""
    spot = ["leaf", "place", "token"]

    def tokens(rows: DataFrame, *more: str) -> DataFrame:
        exploded = rows.select("leaf", *more, F.posexplode("tokens").alias("place", "token"))
        return exploded.where(F.col("token") != FIELD).withColumn("token", F.xxhash64("token"))

    kind = ["leaf", "whole"]
    alone = kinds.where("docs = 1").select(*kind, *[f"first.{name}" for name in _KEY])
    few = cut(kinds.where((F.col("docs") > 1) & (F.col("docs") < min_docs)).select(kind))
    held = alone.unionByName(lines.join(few, kind, "left_semi").select(*kind, *_KEY).distinct())
    held = tokens(found.where(F.col("docs") < min_docs).join(held, kind), *_KEY)
    counted = held.groupBy(spot).agg(F.count_distinct(*_KEY).alias("support")).where(F.col("support") >= min_docs)
    often = tokens(found.where(F.col("docs") >= min_docs))
    return often.select(spot).unionByName(counted.select(spot)).distinct()


def _generalised(docs: DataFrame, kinds: DataFrame, lines: DataFrame, min_docs: int, min_tokens: int, fixed: float) -> DataFrame:
    """``leaf, whole, general``: templates of the lines in leaves with several kinds."""
    several = kinds.groupBy("leaf").agg(F.count("*").alias("kinds")).where("kinds > 1")
    chosen = kinds.join(cut(several.select("leaf")), "leaf", "left_semi")
    places = F.struct("leaf", "whole", "docs", F.col("at.line_no").alias("line_no"))
    wanted = chosen.groupBy(F.col(f"at.{_DOC}").alias(_DOC), F.col(f"at.{_BODY}").alias(_BODY)).agg(
        F.collect_list(places).alias("wanted")
    )
    texts = _keyed(docs.select("doc_id", "text")).select(*_KEY, "text")
    # Repeated rows would bring their lines again.
    found = texts.join(cut(wanted), _KEY).withColumn("lines", F.split("text", "\n"))
    found = found.select(F.explode("wanted").alias("w"), "lines").select(
        "w.leaf", "w.whole", "w.docs", _masked(_trimmed(F.element_at("lines", F.col("w.line_no") + 1)), min_tokens).alias("tokens")
    )
    found = cut(found.dropDuplicates(["leaf", "whole"]))
    tokens = found.select("leaf", "whole", "docs", F.posexplode("tokens").alias("place", "token"))
    tokens = tokens.where(F.col("token") != FIELD).withColumn("token", F.xxhash64("token"))
    spot = ["leaf", "place", "token"]
    stays = tokens.join(cut(_supported(found, chosen, lines, min_docs)), spot, "left_semi")
    templates = stays.groupBy("leaf", "whole").agg(
        F.xxhash64(F.array_sort(F.collect_list(F.struct("place", "token")))).alias("general"),
        F.count("*").alias("fixed"),
    )
    sizes = found.select("leaf", "whole", F.size("tokens").alias("n"))
    enough = templates.join(sizes, ["leaf", "whole"]).where(F.col("fixed") >= F.col("n") * fixed)
    return cut(enough.select("leaf", "whole", "general"))


def find_recurring(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    fixed: float = FIXED,
    copy: float | None = None,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Of each document with recurring lines: how many tokens it has and how many of them
    recur, and the numbers of the lines to drop. Without ``copy`` no document is left whole.
    Runs jobs, whose own tables are dropped."""
    return settled(docs.sparkSession, lambda: _found(docs, min_docs, min_tokens, fixed, copy, min_chars))


def _found(docs: DataFrame, min_docs: int, min_tokens: int, fixed: float, copy: float | None, min_chars: int) -> DataFrame:
    lines = cut(_lines(docs, min_tokens, min_chars))
    at = F.min(F.struct(*_KEY, "line_no")).alias("at")
    long_lines = lines.where("enough")
    kinds = cut(_count_documents(long_lines, ["leaf", "whole"], at))
    general = _generalised(docs, kinds, long_lines, min_docs, min_tokens, fixed)
    template = F.coalesce("general", "whole")
    placed = long_lines.join(general, ["leaf", "whole"], "left").select(*_KEY, "line_no", "n", "leaf", template.alias("template"))
    placed = cut(placed)
    recurring = _count_documents(placed, ["leaf", "template"]).where(F.col("docs") >= min_docs)
    recurring = cut(recurring.select("leaf", "template", "first"))
    marked = placed.join(recurring, ["leaf", "template"])
    goes = F.struct(*_KEY) != F.col("first")
    marked = marked.groupBy(_KEY).agg(
        # Repeated rows have their lines counted as often, here and in the totals.
        F.sum("n").alias("recurring"),
        F.array_sort(F.collect_set(F.when(goes, F.col("line_no")))).alias("drop"),
    )
    totals = lines.groupBy(_KEY).agg(F.sum("n").alias("tokens"))
    copied = F.lit(False) if copy is None else F.col("recurring") >= F.col("tokens") * copy
    found = marked.join(totals, _KEY).withColumn("copied", copied)
    nothing = F.array().cast("array<int>")
    return found.withColumn("drop", F.when(F.col("copied"), nothing).otherwise(F.col("drop")))


def drop_recurring(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, the texts without the lines to drop."""
    drops = found.where(F.size("drop") > 0).select(*_KEY, F.col("drop").alias("_lines_to_drop"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_lines_to_drop", i))
    text = F.when(F.col("_lines_to_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = _keyed(docs).join(drops, _KEY, "left").withColumn("text", text)
    return joined.select(docs.columns)


def report(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row's doc_id, the number of its lines, and which of them are dropped, and how many."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = _keyed(docs.select("doc_id", "text")).select(
        "doc_id", *_KEY, F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines")
    )
    return rows.join(found, _KEY, "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("drop").cast("array<string>"), ","), F.lit("")).alias("dropped"),
    )
