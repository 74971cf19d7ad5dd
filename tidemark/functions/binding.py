"""A projection that stays apart: its columns are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """Add columns behind a one-row generator: neither projections nor filters above are merged into them, which would
    multiply long expressions."""
    if columns and all(isinstance(c, str) for c in columns.values()):  # SQL: one call for all of them
        return df.selectExpr("*", "inline(array(struct(" + ", ".join(f"{c} AS `{k}`" for k, c in columns.items()) + ")))")
    columns = {k: F.expr(c) if isinstance(c, str) else c for k, c in columns.items()}
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))) if columns else df
