"""Joins that stay even when one key holds a large share of the rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_OUT = 1024
TARGET_ROWS = 10_000
SALT = "_salt"
SALTS = "_salts"


def fan_out_join(
    rows: DataFrame,
    payload: DataFrame,
    key: str,
    spread_by: list[str],
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    how: str = "left",
    fan_out: int = FAN_OUT,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Join rows with a payload looked up by ``key``; any key may be hot in ``rows``.

    Rows are counted per key, map-side first. A key with more than ``target_rows`` rows gets
    as many salts as it has such shares (at most ``fan_out``); its rows are spread by a hash
    of ``spread_by`` and its payload is copied once per salt. All other keys, nearly all of
    them, have one salt and one copy. ``prepare`` turns the looked-up payload into the wanted
    one and so runs once per key, not once per row; it must keep the column ``SALTS``.
    """
    shares = F.ceil(F.count("*") / target_rows).cast("int")
    wanted = rows.groupBy(key).agg(F.least(F.lit(fan_out), shares).alias(SALTS))
    hot = wanted.where(F.col(SALTS) > 1)
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce(SALTS, F.lit(1))).cast("int")
    salted = rows.join(hot, key, "left").withColumn(SALT, salt).drop(SALTS)
    found = payload.join(wanted, key)
    if prepare is not None:
        found = prepare(found)
    copies = found.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.col(SALTS) - 1))).drop(SALTS)
    return salted.join(copies, [key, SALT], how).drop(SALT)
