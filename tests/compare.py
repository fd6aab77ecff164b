"""Runs registered queries beside their SQL and compares rows and columns."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return db


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(spark, db, query, sql: str, sf_dir: str) -> list[str]:
    """What differs between a query and its SQL; empty when nothing does."""
    df = query(spark, sf_dir)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if KINDS.get(kind) != kinds[field.name]:
            problems.append(f"type of {field.name}: {kind} and {kinds[field.name]}")
    ours, theirs = _rows(df.columns, df.collect()), _rows(names, result.fetchall())
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} and {len(theirs)} rows")
    if ours != theirs:
        only_ours = [r for r in ours if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(ours)][:3]
        problems.append(f"only here {only_ours}, only in SQL {only_theirs}")
    return problems
