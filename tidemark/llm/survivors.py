"""Best representative of each group of duplicate records (problem 7).

Skyline selection: of the rows of one key those are undominated that no other equals or exceeds in trust, recency and
completeness (the number of filled fields) while exceeding it in one. Rows are peeled into layers of dominance; the
survivor is the first row of the first layer by the lexicographic policy (trust, recency, completeness, then the smaller
row id), and a field that it lacks is taken from the first row that fills it, in order of layers and policy.

Rows of equal trust and equal set of filled fields are represented by the most recent one before anything is gathered (it
dominates the others and fills the same fields), in a partial aggregate. So at most trusts x 2**fields rows of a key
meet, however many rows the key has.

Defined results: null keys have no group; null trust or time is below any other; NaN, null, blank and missing-value marks are
not filled; rows equal in all three respects stay undominated together; a group of one row survives as it is; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import small

FIELDS = ["core_id", "core_lat", "core_lon", "core_at", "core_dpt", "core_sst", "core_slp", "core_d", "core_w"]
MISSING = {"core_slp": [999.9, 9999.9]}  # every other number: 999.9


def filled(df: DataFrame, field: str) -> Column:
    """Whether a field holds a value; never null."""
    c, kind = F.col(field), dict(df.dtypes)[field]
    if kind == "string":
        return F.coalesce((F.trim(c) != "") & (F.trim(c) != "999.9"), F.lit(False))
    holds = c.isNotNull() & ~c.isin(*MISSING.get(field, [999.9])) if kind in ("double", "float") else c.isNotNull()
    return F.coalesce(holds & ~F.isnan(c) if kind in ("double", "float") else holds, F.lit(False))


def representatives(df: DataFrame, key: str, row: str, trust: str, recency: str, fields: list[str]) -> DataFrame:
    """Per key, trust and set of filled fields the most recent row: `_s_key`, trust, mask, n_filled, at, row, ties, values."""
    flags = [filled(df, f) for f in fields]
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(0) for i, x in enumerate(flags)), F.lit(0)).cast("int")
    time = F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(2**62)))
    values = F.struct(*[F.when(x, F.col(f)).alias(f) for f, x in zip(fields, flags)])
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_s_key"), F.coalesce(F.col(trust).cast("int"), F.lit(-(2**31))).alias("trust"), mask.alias("mask"), time.alias("at"), F.col(row).alias("row"), values.alias("values"))
    best = F.max(F.struct(F.col("at"), (-F.col("row")).alias("minus_row"), F.col("values"))).alias("b")
    # how many rows share the most recent time: told by the greatest and the least row id at that time
    last = F.max(F.struct("at", "row")).alias("l")
    rep = rows.groupBy("_s_key", "trust", "mask").agg(best, last, F.count("*").alias("n"))
    return rep.select("_s_key", "trust", "mask", F.bit_count("mask").alias("n_filled"), F.col("b.at").alias("at"), (-F.col("b.minus_row")).alias("row"), (F.col("l.row") != -F.col("b.minus_row")).alias("tied"), F.col("b.values").alias("values"), "n")


def layers(reps: DataFrame, fields: bool = True) -> DataFrame:
    """Per key the representatives with their layer, by layer and policy: `_s_key`, n (rows), items."""
    chosen = ["trust", "at", "n_filled", "row", "tied", *(["values"] if fields else [])]
    # dominators come first in this order
    order = F.struct(F.col("trust"), F.col("at"), F.col("n_filled"), (-F.col("row")).alias("minus_row"))
    gathered = reps.groupBy("_s_key").agg(F.sum("n").alias("n"), F.reverse(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*chosen).alias("i"))))).alias("all")).filter("n > 1")

    def dominates(a: Column, b: Column) -> Column:
        least = (a["trust"] >= b["trust"]) & (a["at"] >= b["at"]) & (a["n_filled"] >= b["n_filled"])
        return least & ((a["trust"] > b["trust"]) | (a["at"] > b["at"]) | (a["n_filled"] > b["n_filled"]))

    def place(done: Column, x: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: dominates(d["i"], x["i"])), lambda d: d["layer"])
        return F.concat(done, F.array(F.struct((F.coalesce(F.array_max(above), F.lit(0)) + 1).alias("layer"), x["o"].alias("o"), x["i"].alias("i"))))

    start = F.expr("cast(array() as array<struct<layer:int,o:struct<trust:int,at:bigint,n_filled:int,minus_row:bigint>,i:struct<trust:int,at:bigint,n_filled:int,row:bigint,tied:boolean" + ("" if not fields else ",values:" + reps.schema["values"].dataType.simpleString()) + ">>>)")
    placed = F.aggregate("all", start, place)
    # by layer, and within a layer in the order they were placed in
    ordered = F.flatten(F.transform(F.sequence(F.lit(1), F.array_max(F.transform("p", lambda x: x["layer"]))), lambda k: F.filter("p", lambda x: x["layer"] == k)))
    return gathered.withColumn("p", placed).select("_s_key", "n", ordered.alias("items"))


def survivors(df: DataFrame, key: str, row: str, trust: str, recency: str, fields: list[str]) -> DataFrame:
    """One row per key of several rows: key, row (of the survivor), n, layers, skyline (rows in the first layer, ties
    once), sole (whether it alone is undominated) and the fields, filled from successive layers, with the number of filled-in ones."""
    out = layers(representatives(df, key, row, trust, recency, fields))

    def first(f: str) -> Column:
        return F.get(F.filter(F.transform("items", lambda x: x["i"]["values"][f]), lambda v: v.isNotNull()), F.lit(0))

    top = F.col("items")[0]
    ahead = F.filter("items", lambda x: x["layer"] == 1)
    borrowed = sum((F.when(top["i"]["values"][f].isNull() & first(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return out.select(F.col("_s_key").alias(key), top["i"]["row"].alias(row), "n", F.array_max(F.transform("items", lambda x: x["layer"])).alias("layers"), F.size(ahead).alias("skyline"), ((F.size(ahead) == 1) & ~top["i"]["tied"]).alias("sole"), borrowed.alias("borrowed"), *[first(f).alias(f) for f in fields])


def reports_with_trust(reports: DataFrame, decks: DataFrame) -> DataFrame:
    of = small(decks.groupBy(F.col("dck").alias("_dck"), F.col("sid").alias("_sid")).agg(F.max("trust").alias("trust")))
    rows = reports.select("row_id", "c98_uid", "c1_dck", "c1_sid", "received_at", *FIELDS)
    return rows.join(of, (F.col("c1_dck") == F.col("_dck")) & (F.col("c1_sid") == F.col("_sid")), "left").drop("_dck", "_sid")


def best_reports(reports: DataFrame, decks: DataFrame) -> DataFrame:
    return survivors(reports_with_trust(reports, decks), "c98_uid", "row_id", "trust", "received_at", FIELDS)


def found(reports: DataFrame, decks: DataFrame) -> DataFrame:
    """(report_id, row_id): the one row that no other exceeds in any respect and that exceeds each other in one."""
    reps = representatives(reports_with_trust(reports, decks), "c98_uid", "row_id", "trust", "received_at", FIELDS)
    out = layers(reps.drop("values"), fields=False)
    top = F.col("items")[0]
    sole = (F.size(F.filter("items", lambda x: x["layer"] == 1)) == 1) & ~top["i"]["tied"]
    return out.filter(sole).select(F.concat(F.lit("ICOADS-30-"), "_s_key").alias("report_id"), top["i"]["row"].alias("row_id"))
