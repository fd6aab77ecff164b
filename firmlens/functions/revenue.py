"""Revenue figures in a sentence: amount, currency, scale and year."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import lookup

# Written currency (lower case) -> currency code.
CURRENCIES = {
    "$": "USD", "usd": "USD", "us$": "USD",
    "₹": "INR", "inr": "INR", "rs": "INR",
    "€": "EUR", "eur": "EUR",
    "£": "GBP", "gbp": "GBP",
}

# Scale word (lower case) -> factor.
SCALES = {
    "thousand": 10**3, "k": 10**3,
    "lakh": 10**5, "lakhs": 10**5,
    "million": 10**6, "mn": 10**6, "m": 10**6,
    "crore": 10**7, "crores": 10**7, "cr": 10**7,
    "billion": 10**9, "bn": 10**9, "b": 10**9,
}

# US dollars per unit; a caller with current rates passes their own table.
USD_RATES = {"USD": "1", "INR": "0.012", "EUR": "1.08", "GBP": "1.27"}

KEYWORD = r"(?:revenues?|turnover|sales)"
CURRENCY = r"(us\$|usd|inr|eur|gbp|rs|[$₹€£])"
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
SCALE = r"(?:\s*(thousand|lakhs?|million|mn|crores?|cr|billion|bn|[mkb])(?:[^\p{L}\p{N}]|$))?"
AMOUNT = CURRENCY + r"\s*" + NUMBER + SCALE

# An amount within 80 characters after the keyword, else before it.
AFTER_KEYWORD = r"(?i)(?:^|[^\p{L}\p{N}])" + KEYWORD + r"[^\p{L}\p{N}](?:[^\n]{0,78}?[^\p{L}\p{N}])??" + AMOUNT
BEFORE_KEYWORD = r"(?i)(?:^|[^\p{L}\p{N}])" + AMOUNT + r"[^\n]{0,80}?" + KEYWORD + r"(?:[^\p{L}\p{N}]|$)"

FIRST_AMOUNT = r"(?i)(?:^|[^\p{L}\p{N}])" + AMOUNT

YEAR = r"(?:19|20)[0-9]{2}"
# First year of the rest of the sentence, and last year of its beginning.
YEAR_AFTER = r"^([^\n]*?[^0-9.,])?(" + YEAR + r")(?:[^0-9]|$)"
YEAR_BEFORE = r"^(?:[^\n]*[^0-9.,])?(" + YEAR + r")([^0-9][^\n]*)?$"

GROWTH = (
    r"(?i)(?:revenues?|turnover|sales)[^\n%]{0,80}?"
    r"(?:grew|growth|increased|rose|up)[^\n%]{0,40}?[^0-9.]([0-9]+(?:\.[0-9]+)?) ?%"
)
MARKET_CAP = r"(?i)market cap(?:itali[sz]ation)?[^\n]{0,40}?[^\p{L}\p{N}]" + AMOUNT


def _amount_text(symbol: Column, number: Column, scale: Column) -> Column:
    return F.concat_ws(
        " ",
        F.when(symbol != "", symbol),
        F.when(number != "", number),
        F.when(scale != "", scale),
    )


def nearest_year(head: Column, tail: Column) -> Column:
    """The year closest to an amount, from the text before and after it.

    On a tie the year after the amount counts.
    """
    after, before = F.regexp_extract(tail, YEAR_AFTER, 2), F.regexp_extract(head, YEAR_BEFORE, 1)
    gap_after = F.length(F.regexp_extract(tail, YEAR_AFTER, 1))
    gap_before = F.length(F.regexp_extract(head, YEAR_BEFORE, 2))
    year = (
        F.when((after != "") & ((before == "") | (gap_after <= gap_before)), after)
        .when(before != "", before)
    )
    return year.cast("int")


def to_usd(symbol: Column, number: Column, scale: Column, rates: dict = USD_RATES) -> Column:
    """US dollars as DECIMAL(38,2); null when the currency has no rate."""
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(18,4)")
    factor = F.coalesce(lookup(F.lower(scale), SCALES), F.lit(1)).cast("decimal(10,0)")
    plain = (value * factor).try_cast("decimal(24,2)")
    rate = lookup(lookup(F.lower(symbol), CURRENCIES), rates).cast("decimal(12,6)")
    return (plain * rate).try_cast("decimal(38,2)")


def with_figure(df: DataFrame, sentence: Column, where: Column, rates: dict = USD_RATES) -> DataFrame:
    """Add the first revenue figure of a sentence: ``amount, amount_year, amount_usd``.

    All three are null where ``where`` is false or nothing is found.
    """
    after = F.when(where, F.regexp_extract(sentence, AFTER_KEYWORD, 0))
    before = F.regexp_extract(sentence, BEFORE_KEYWORD, 0)
    figure = F.col("_figure")
    found = df.withColumn("_figure", after).withColumn(
        "_figure", F.nullif(F.when(figure == "", before).otherwise(figure), F.lit(""))
    )
    parts = {
        name: F.regexp_extract(figure, FIRST_AMOUNT, group)
        for group, name in enumerate(("_symbol", "_number", "_scale"), 1)
    }
    symbol, number, scale = (F.col(name) for name in parts)
    return (
        found.withColumns(parts)
        # The matched text, then its amount, then the number in it: the digits alone may
        # stand elsewhere too.
        .withColumn("_written", F.regexp_extract(figure, FIRST_AMOUNT, 0))
        .withColumn(
            "_at",
            F.instr(sentence, figure) + F.instr(figure, F.col("_written")) + F.instr(F.col("_written"), number) - 2,
        )
        .withColumns(
            {
                "_head": F.substring(sentence, F.lit(1), F.col("_at") - 1),
                "_tail": F.substring(sentence, F.col("_at") + F.length(number), F.length(sentence)),
            }
        )
        .withColumns(
            {
                "amount": F.when(figure.isNotNull(), _amount_text(symbol, number, scale)),
                "amount_year": nearest_year(F.col("_head"), F.col("_tail")),
                "amount_usd": to_usd(symbol, number, scale, rates),
            }
        )
        .drop("_figure", *parts, "_written", "_at", "_head", "_tail")
    )


def growth_rate(sentence: Column) -> Column:
    """Revenue growth such as ``12.5%``, or ""."""
    rate = F.regexp_extract(sentence, GROWTH, 1)
    return F.when(rate != "", F.concat(rate, F.lit("%"))).otherwise(F.lit(""))


def market_cap(sentence: Column) -> Column:
    """Market capitalisation as written, or ""."""
    return _amount_text(*[F.regexp_extract(sentence, MARKET_CAP, g) for g in (1, 2, 3)])
