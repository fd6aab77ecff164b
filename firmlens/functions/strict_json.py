"""The two responses of a model that the job knows, by their declared types.

``from_json`` cannot be used here: it hides absent keys, accepts a number where
a text is required and turns "7" or 7.0 into null where an integer is required.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlens.functions.declared import TEXT, WHOLE, int_value, list_of, maybe, read_fields, record, string_value
from firmlens.schemas import EXTRACTION_FIELDS

SCORED_LINKS = record({"scored_links": list_of(record({"url": TEXT, "score": WHOLE, "reason": TEXT}))})
EXTRACTION = record({n: WHOLE if kind == "int" else maybe(TEXT) for n, kind in EXTRACTION_FIELDS.items()})


def scored_links(raw: Column) -> Column:
    """Scored links of a curation response; null when the response is invalid.

    One bad item rejects the whole response. An empty list is valid. The result
    is ``ARRAY<STRUCT<url, score INT, reason>>`` in the order of the response: the value
    that ``read(raw, SCORED_LINKS)`` gives, without the place of a fault, which costs most.
    """
    items = F.try_variant_get(
        F.try_parse_json(raw), "$.scored_links", "array<struct<url: variant, score: variant, reason: variant>>"
    )
    read = F.transform(
        items,
        lambda i: F.struct(string_value(i["url"]).alias("url"), int_value(i["score"]).alias("score"), string_value(i["reason"]).alias("reason")),
    )
    fits = lambda i: i["url"].isNotNull() & i["score"].isNotNull() & i["reason"].isNotNull()
    return F.transform(F.array(read), lambda links: F.when(F.forall(links, fits), links))[0]


def extraction_record(raw: Column) -> Column:
    """Extraction response as ``STRUCT<error, 8 fields>``; ``error`` null when valid."""
    fields = read_fields(raw, EXTRACTION)
    named = F.concat_ws(", ", *(F.when(fields[n]["fault"].isNotNull(), F.lit(n)) for n in EXTRACTION_FIELDS))
    error = F.when(fields.isNull(), F.lit("response is not a JSON object")).when(
        named != "", F.concat(F.lit("missing or invalid in response: "), named)
    )
    return F.struct(error.alias("error"), *(fields[n]["value"].alias(n) for n in EXTRACTION_FIELDS))
