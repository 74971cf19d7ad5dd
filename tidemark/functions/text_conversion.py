"""Typed columns of the output tables <-> text. The null label stands for null in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans import specs

NULL = "null"
DECIMALS = 5
PATTERN = "yyyy-MM-dd HH:mm:ss"


def to_str(c: Column, kind: str, decimals: int = DECIMALS, null: str = NULL) -> Column:
    """Text of a typed column: integers cut off, numbers with fixed decimals rounded half-even, arrays as {a,b,null}."""
    if kind == "int":
        text = c.try_cast("double").try_cast("bigint").cast("string")
    elif kind == "numeric":
        text = F.bround(c.try_cast("double"), decimals).try_cast(f"decimal(38,{decimals})").cast("string")
    elif kind.startswith("timestamp"):
        text = F.date_format(c.cast("timestamp_ntz"), PATTERN)
    elif kind.endswith("[]"):
        one = kind[:-2]
        items = F.transform(c, lambda x: F.coalesce(x.try_cast("bigint").cast("string") if one == "int" else x.cast("string"), F.lit(null)))
        text = F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(null))


def from_str(c: Column, kind: str, null: str = NULL) -> Column:
    """The typed column of a text; the null label, and what does not parse, is null."""
    text = F.when(F.trim(c) != null, c)
    if kind == "int":
        return text.try_cast("double").try_cast("bigint")
    if kind == "numeric":
        return text.try_cast("double")
    if kind.startswith("timestamp"):
        return F.try_to_timestamp(text, F.lit(PATTERN)).cast("timestamp_ntz")
    if kind.endswith("[]"):
        to = {"int": "bigint", "numeric": "double", "varchar": "string"}[kind[:-2]]
        inner = F.regexp_replace(F.trim(text), r"^\{|\}$", "")
        items = F.transform(F.split(inner, ","), lambda x: F.when(F.trim(x) != null, F.trim(x).try_cast(to)))
        return F.when(text.isNotNull(), items)
    return text


def convert_table(df: DataFrame, table: str, to: str, null: str = NULL, decimals: dict[str, int] | None = None) -> DataFrame:
    """All known columns of a table to 'str' or 'typed'; others stay."""
    kinds = specs.columns(table)
    one = (lambda c: to_str(F.col(c), kinds[c], (decimals or {}).get(c, DECIMALS), null)) if to == "str" else (lambda c: from_str(F.col(c), kinds[c], null))
    return df.select(*[one(c).alias(c) if c in kinds else F.col(c) for c in df.columns])
