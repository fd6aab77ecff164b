"""What a sentence asserts: cues of negation and how far they reach.

A sentence is cut into clauses at commas, colons, brackets, dashes and words such as ``but``.
In a clause a cue (``no``, ``never``, ``without``, ``stopped using``) takes back what follows it,
and a passive verb of removal (``was dropped``, ``has been replaced``) what precedes it.
``replaced A with B`` takes back A only. Phrases that only look like cues (``not only``, ``no
doubt``) are none. What is taken back is replaced by a mark that no term contains, so the
result can be searched like any ``padded`` text.

Everything is a chain of rewrites that Java's and RE2's patterns read alike.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, CLAUSE = "#", "|"

# Words that end a clause and begin another, cues, and what is no cue.
CONJUNCTIONS = [
    "but", "however", "although", "though", "whereas", "while", "yet", "instead", "rather", "except", "unlike",
    "aber", "sondern", "jedoch", "mais", "pero", "sino",
]
CUES = [
    "no", "not", "never", "neither", "nor", "none", "without", "cannot", "lacks", "lacking", "ceased", "stopped",
    "dropped", "ditched", "abandoned", "replaced", "replaces", "replacing", "rejected", "refused", "formerly",
    "kein", "keine", "nicht", "ohne", "sans", "jamais", "sin", "nunca",
]
REMOVED = ["replaced", "abandoned", "dropped", "discontinued", "ditched", "retired", "rejected", "phased out", "ruled out", "switched off"]
AUXILIARIES = ["is", "are", "was", "were", "be", "been", "being", "got"]
NO_CUES = ["not only", "not just", "not merely", "not least", "no doubt", "without doubt", "no less", "no exception", "no wonder"]


def _any(phrases: list[str]) -> str:
    return "(?:" + "|".join(p.replace(" ", "  ") for p in phrases) + ")"


#: Rewrites of a lower-case sentence into words with a blank on both sides and clause marks.
WORDS = [
    (r"n['’]t([^\p{L}\p{N}]|$)", " not $1"),
    (r"[,;:()\[\]–—]| - ", f" {CLAUSE} "),
    (rf"[^\p{{L}}\p{{N}}{CLAUSE}]+", "  "),
]
#: Rewrites of the padded sentence before it is cut at the clause marks.
CLAUSES = [
    (rf" {_any(NO_CUES)} ", f" {MARK}{MARK} "),
    (f" ({_any(CONJUNCTIONS)}) ", rf" {CLAUSE}  $1 "),
    (rf" ((?:replaced|replaces|replacing) [^{CLAUSE}]*?) (with|by) ", rf" $1 {CLAUSE}  $2 "),
]
#: Rewrites of one clause.
SCOPES = [
    (rf"^.* {_any(AUXILIARIES)}  {_any(REMOVED)} ", f" {MARK} "),
    (rf"^(.*?) {_any(CUES)} .*$", f"$1 {MARK} "),
]
#: Rewrites of the clauses put together again.
TOGETHER = [(" +", "  ")]


def _rewritten(text: Column, rewrites: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rewrites:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _pad(text: Column) -> Column:
    return F.concat(F.lit(" "), F.btrim(text), F.lit(" "))


def asserted(sentence: Column) -> Column:
    """``padded`` text of what the sentence does not take back; null for null."""
    words = _rewritten(_pad(_rewritten(F.lower(sentence), WORDS)), CLAUSES)
    kept = F.transform(F.split(words, "[" + CLAUSE + "]"), lambda clause: _rewritten(clause, SCOPES))
    return _pad(_rewritten(F.array_join(kept, " "), TOGETHER))
