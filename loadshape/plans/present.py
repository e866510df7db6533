"""Result presentation shared by check queries and their SQL twins.

Integers are widened to BIGINT and doubles rounded half-up with the same
formula in both engines, ``floor(x * 10^d + 0.5 + 1e-6) / 10^d``. Built-in
``round`` differs between engines on exact ties, and a mean of 2-decimal
readings often sits exactly on a tie; the 1e-6 (in units of the last kept
digit) lifts both engines' values, which differ by far less, to the same
side of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMALS = 6
TIE_LIFT = 0.5 + 1e-6


def present(df: DataFrame, decimals: dict[str, int] | None = None) -> DataFrame:
    decimals = decimals or {}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            scale = float(10 ** decimals.get(f.name, DECIMALS))
            c = F.floor(c.cast("double") * scale + TIE_LIFT).cast("double") / scale
        out.append(c.alias(f.name))
    return df.select(*out)


def sql_present(name: str, kind: str, decimals: int = DECIMALS) -> str:
    q = f'"{name}"'
    if kind == "int":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "double":
        return f"{sql_round(f'CAST({q} AS DOUBLE)', decimals)} AS {q}"
    return f"{q}"


def sql_round(expr: str, decimals: int = DECIMALS) -> str:
    scale = float(10 ** decimals)
    return f"(floor({expr} * {scale!r} + {TIE_LIFT!r}) / {scale!r})"
