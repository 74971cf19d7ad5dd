"""Quantities recorded in different units -> common units (problem 4).

A row's own unit (its code, then its text) goes before that of its element. What a row states is the same for all rows of one
combination of model, element, variable, code and text, so texts are read once a combination, not once a row.

Where none of them can be read, the unit is chosen by physical identities among the quantities of one report: air, dew point and sea
temperatures of one place are nearly equal in kelvin, the dew point is not above the air, the pressure at sea level is nearly that of the
standard atmosphere, the wind is of the order of its climate. For each open value the combination of units with the other open
quantities of its report is formed whose log residuals are least, for each unit that it may have itself; stated units are
fixed in it. A source does not change the unit of an element from row to row, so the residuals of a source's open rows of one
element are added up (each bounded, so that a bad reading decides nothing), and the unit with the least sum is taken. A
solution is flagged as not unique if another unit is nearly as good.

Defined results: rows without a value, without a dimension (directions, unknown or null variables) have no unit; a code of another
dimension counts as none; a row that cannot be solved (no report id and no anchor) still has its anchor; a null source is one
of its own; several open values of one quantity in a report are solved each by itself; empty tables give empty results; repeated rows
are resolved alike; input columns are kept, but for those that begin with `_u_`, as the added ones do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.units import COMMON, TO_COMMON, code_unit, conversion, dimension, read_unit, to_common, units_of
from tidemark.session import small

# The quantities of a report, their anchors in common units and the spread of the logarithm around them.
QUANTITIES = {85: ("temperature", 288.0, 0.05), 36: ("temperature", 283.0, 0.05), 95: ("temperature", 288.0, 0.04), 58: ("pressure", 101325.0, 0.02), 107: ("speed", 9.0, 0.7)}
# Pairs of quantities that are nearly equal in common units, and the spread of the logarithm of their ratio.
IDENTITIES = [(85, 95, 0.015), (85, 36, 0.02), (36, 95, 0.025)]
# Pairs of which the first is not above the second, and the spread of the logarithm of what it is above by.
NOT_ABOVE = [(36, 85, 0.004)]
MARGIN = 2.0  # of squared residuals, in units of their spread: less than that apart is not unique
BOUND = 30.0  # to which one row's residual counts in the sum of its source
CHOSEN = ["imodel", "element", "observed_variable", "units", "units_text"]


def element_units(elements: DataFrame) -> DataFrame:
    """One row per (imodel, element) and dimension: its unit and limits, as they are and in common units. Sections that
    share an element's name share the first. The texts are read here, once an element."""
    by = elements.groupBy("imodel", "element").agg(F.min(F.struct("section", "units", "valid_min", "valid_max")).alias("e"))
    of = by.select("imodel", "element", "e.*", F.explode(F.array(*map(F.lit, COMMON))).alias("dim"))
    of = of.withColumn("unit", read_unit(F.col("units"), F.col("dim")))
    return of.select(
        F.col("imodel").alias("_u_imodel"), F.col("element").alias("_u_element"), F.col("dim").alias("_u_edim"), F.col("unit").alias("_u_eunit"), F.col("valid_min").alias("_u_rawmin"), F.col("valid_max").alias("_u_rawmax"),
        to_common(F.col("valid_min"), F.col("unit")).alias("_u_emin"), to_common(F.col("valid_max"), F.col("unit")).alias("_u_emax"),
    )


def combinations_of(observations: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per combination of CHOSEN: `_u_dim`, `_u_stated`, its divisor, factor and summand to the common unit, and the limits of
    the element, in common units where it has a unit."""
    dim = dimension(F.col("observed_variable"))
    out = observations.select(*CHOSEN).distinct().withColumn("_u_dim", dim)
    of = small(element_units(elements))
    out = out.join(of, (F.col("imodel") == F.col("_u_imodel")) & (F.col("element") == F.col("_u_element")) & (F.col("_u_dim") == F.col("_u_edim")), "left")
    stated = F.coalesce(code_unit(F.col("units"), F.col("_u_dim")), F.when(F.col("units_text").isNotNull(), read_unit(F.col("units_text"), F.col("_u_dim"))), F.col("_u_eunit"))
    out = out.withColumn("_u_stated", stated)
    divisor, factor, shift = conversion(F.col("_u_stated"))
    out = out.withColumns({"_u_by": divisor, "_u_factor": factor, "_u_shift": shift})
    # limits of an element without a unit are in that of the row
    lows, highs = F.coalesce("_u_emin", to_common(F.col("_u_rawmin"), F.col("_u_stated"))), F.coalesce("_u_emax", to_common(F.col("_u_rawmax"), F.col("_u_stated")))
    out = out.withColumns({"_u_min": lows, "_u_max": highs})
    return out.select(*[F.col(c).alias(f"_u_k{i}") for i, c in enumerate(CHOSEN)], "_u_dim", "_u_stated", "_u_by", "_u_factor", "_u_shift", "_u_min", "_u_max", "_u_rawmin", "_u_rawmax")


def stated_units(observations: DataFrame, elements: DataFrame) -> tuple[DataFrame, bool]:
    """All rows with what their combination states, and whether any may be open."""
    out = observations.drop(*[c for c in observations.columns if c.startswith("_u_")])
    table = combinations_of(out, elements)
    of = small(table)
    is_open = of.filter(F.col("_u_dim").isNotNull() & F.col("_u_stated").isNull())
    may_be_open = of is table or bool(is_open.head(1))  # a table of the driver, or too large to ask
    same = None
    for i, c in enumerate(CHOSEN):
        equal = F.col(c).eqNullSafe(F.col(f"_u_k{i}"))
        same = equal if same is None else same & equal
    return out.join(of, same, "left").drop(*[f"_u_k{i}" for i in range(len(CHOSEN))]), may_be_open


def _in_common(value: np.ndarray, unit: str) -> np.ndarray:
    factor, shift = TO_COMMON[unit.removeprefix("0.1")]
    return (value / 10 if unit.startswith("0.1") else value) * factor + shift


def _square(value: np.ndarray, to, spread: float, above: bool = False) -> np.ndarray:
    """Squared log residual in units of its spread; nothing where one is missing, very much where one is not positive."""
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = np.log(value / to)
    ratio = np.maximum(ratio, 0) if above else ratio
    out = np.where((value > 0) & (to > 0), (ratio / spread) ** 2, 1e6)
    return np.where(np.isnan(value) | np.isnan(to), 0.0, out)


def _costs(own: int, value: np.ndarray, fixed: dict[int, np.ndarray], free: dict[int, np.ndarray]) -> np.ndarray:
    """Rows by units of `own`: the least sum of squares over the units of the other open quantities of the report."""
    kind = QUANTITIES[own][0]
    block, units = [v for v, (d, _, _) in QUANTITIES.items() if d == kind], units_of(kind)
    if kind != "temperature":
        block = [own]
    tables = {}
    for i, v in enumerate(block):
        numbers = value if v == own else free[v]
        table = np.stack([_in_common(numbers, u) for u in units], axis=1)
        table = np.where(np.isnan(table), fixed[v][:, None], table) if v != own else table
        tables[v] = table.reshape([len(value) if k == 0 else (len(units) if k == i + 1 else 1) for k in range(len(block) + 1)])
    cost = sum(_square(t, QUANTITIES[v][1], QUANTITIES[v][2]) for v, t in tables.items())
    for a, b, spread in IDENTITIES:
        cost = cost + _square(tables[a], tables[b], spread) if a in tables and b in tables else cost
    for a, b, spread in NOT_ABOVE:
        cost = cost + _square(tables[a], tables[b], spread, True) if a in tables and b in tables else cost
    others = tuple(i + 1 for i, v in enumerate(block) if v != own)
    return cost.min(axis=others) if others else cost


def solve(rows: DataFrame, pool: list[str]) -> DataFrame:
    """Units of the open rows: the columns of `pool`, observed_variable, _u_solved, _u_unique.

    rows: of `stated_units`. A report gives one value for each other quantity before the combinations are formed, at most
    4 temperatures ** 3; pressure and wind have no partner and are solved against their anchors. Sums are pre-aggregated, so a
    source of a third of all rows is no hot task."""
    report = F.coalesce(F.upper(F.trim("report_id")), F.concat(F.lit("row "), F.col("row_id").cast("string")))
    rows = rows.filter(F.col("_u_dim").isNotNull() & F.col("observation_value").isNotNull()).withColumn("_u_report", report)
    is_open = F.col("_u_stated").isNull()
    opened = rows.filter(is_open)
    of = rows.join(opened.select("_u_report").distinct(), "_u_report", "left_semi")
    known = {}
    for v in QUANTITIES:
        mine = F.col("observed_variable") == v
        known[f"fixed{v}"] = F.avg(F.when(mine & ~is_open, F.col("observation_value") / F.col("_u_by") * F.col("_u_factor") + F.col("_u_shift")))
        known[f"free{v}"] = F.min(F.when(mine & is_open, F.col("observation_value")))
    reports = of.groupBy("_u_report").agg(*[e.alias(n) for n, e in known.items()])
    values = opened.filter(F.col("observed_variable").isin(list(QUANTITIES))).groupBy("_u_report", *pool, "observed_variable", "observation_value").agg(F.count("*").alias("_u_n")).join(reports, "_u_report")

    @F.pandas_udf("array<double>")
    def costs(own: pd.Series, value: pd.Series, known: pd.DataFrame) -> pd.Series:
        out = pd.Series([None] * len(own), index=own.index, dtype=object)
        for v in own.unique():
            at = np.flatnonzero(own.to_numpy() == v)
            fixed, free = ({q: known[f"{k}{q}"].to_numpy("float64")[at] for q in QUANTITIES} for k in ("fixed", "free"))
            table = _costs(int(v), value.to_numpy("float64")[at], fixed, free)
            # what a row adds for a unit is what it is worse than the row's best
            added = np.minimum(table - table.min(axis=1, keepdims=True), BOUND)
            for i, row in zip(at, added.tolist()):
                out.iat[i] = row
        return out

    tested = values.withColumn("_u_costs", costs("observed_variable", "observation_value", F.struct(*known)))
    most = max(len(units_of(d)) for d, _, _ in QUANTITIES.values())
    sums = tested.groupBy(*pool, "observed_variable").agg(*[F.sum(F.get("_u_costs", F.lit(i)) * F.col("_u_n")).alias(f"_u_c{i}") for i in range(most)])
    names = F.create_map(*[F.lit(x) for d in COMMON for i, u in enumerate(units_of(d)) for x in (f"{d}{i}", u)])
    ranked = F.array_sort(F.filter(F.array(*[F.struct(F.round(f"_u_c{i}", 6).alias("cost"), F.try_element_at(names, F.concat(dimension(F.col("observed_variable")), F.lit(str(i)))).alias("unit")) for i in range(most)]), lambda x: x["cost"].isNotNull()))
    return sums.select(*pool, "observed_variable", ranked[0]["unit"].alias("_u_solved"), (ranked[1]["cost"] - ranked[0]["cost"] > MARGIN).alias("_u_unique"))


def resolve_units(observations: DataFrame, elements: DataFrame) -> DataFrame:
    """All rows of `observations` with `_u_unit`, `_u_value` (in K, Pa or m/s), `_u_basis` ('stated', 'solved',
    'not unique', null without one), `_u_min` and `_u_max` (the element's limits in common units). Open rows are pooled by source_id
    (where there is such a column), imodel, element and variable."""
    rows, may_be_open = stated_units(observations, elements)
    stated = F.when(F.col("observation_value").isNotNull(), F.col("_u_stated"))
    value = F.round(F.col("observation_value") / F.col("_u_by") * F.col("_u_factor") + F.col("_u_shift"), 6)
    plain = {"_u_unit": stated, "_u_value": value, "_u_basis": F.when(stated.isNotNull(), F.lit("stated"))}
    dropped = ["_u_stated", "_u_by", "_u_factor", "_u_shift", "_u_rawmin", "_u_rawmax"]
    if not may_be_open:
        return rows.withColumns(plain).drop(*dropped)
    is_open = F.col("_u_dim").isNotNull() & F.col("observation_value").isNotNull() & F.col("_u_stated").isNull()
    pool = [c for c in ("source_id", "imodel", "element") if c in rows.columns]
    solved = solve(rows, pool)
    solved = small(solved.select(*[F.col(c).alias(f"_u_p{i}") for i, c in enumerate([*pool, "observed_variable"])], "_u_solved", "_u_unique"))
    same = None
    for i, c in enumerate([*pool, "observed_variable"]):
        equal = F.col(c).eqNullSafe(F.col(f"_u_p{i}"))
        same = equal if same is None else same & equal
    still = rows.filter(is_open).join(solved, same, "left")
    unit = F.col("_u_solved")
    limits = {n: F.coalesce(n, to_common(F.col(raw), unit)) for n, raw in (("_u_min", "_u_rawmin"), ("_u_max", "_u_rawmax"))}
    basis = F.when(unit.isNull(), None).when(F.col("_u_unique"), "solved").otherwise("not unique")
    still = still.withColumns({"_u_unit": unit, "_u_value": to_common(F.col("observation_value"), unit), "_u_basis": basis} | limits)
    closed = rows.filter(~is_open).withColumns(plain).drop(*dropped)
    return closed.unionByName(still.select(*closed.columns))


def hidden_units(observations: DataFrame, elements: DataFrame) -> DataFrame:
    """How well hidden units are solved: each variable's units are hidden in all rows in turn, and solved from the others. Columns:
    observed_variable, unit (the true one), n, n_right, n_unique, n_unique_right."""
    rows = observations.select("row_id", "report_id", "observed_variable", "observation_value", "units", "units_text", "imodel", "element", "source_id")
    true, _ = stated_units(rows, elements)
    true = true.filter(F.col("observation_value").isNotNull()).select("row_id", F.col("_u_stated").alias("unit")).filter(F.col("unit").isNotNull())
    out = None
    for v in QUANTITIES:
        hide = F.col("observed_variable") == v
        masked = rows.withColumns({"units": F.when(~hide, F.col("units")), "units_text": F.when(~hide, F.col("units_text")), "element": F.when(hide, F.concat(F.lit("\u0001"), "element")).otherwise(F.col("element"))})
        got = resolve_units(masked, elements).filter(F.col("observed_variable") == v).select("row_id", "observed_variable", "_u_unit", "_u_basis")
        right, unique = F.coalesce(F.col("_u_unit") == F.col("unit"), F.lit(False)), F.col("_u_basis") == "solved"
        part = got.join(true, "row_id").groupBy("observed_variable", "unit").agg(F.count("*").alias("n"), F.count(F.when(right, 1)).alias("n_right"), F.count(F.when(unique, 1)).alias("n_unique"), F.count(F.when(unique & right, 1)).alias("n_unique_right"))
        out = part if out is None else out.unionByName(part)
    return out


def found(observations: DataFrame, elements: DataFrame) -> DataFrame:
    """(row_id, unit) of each row with a value, other than a direction, that is not in K, Pa or m/s."""
    needed = ["row_id", "report_id", "observed_variable", "observation_value", "units", "units_text", "imodel", "element", "source_id"]
    rows = observations.select(*[c for c in needed if c != "source_id" or c in observations.columns])
    return resolve_units(rows, elements).filter(F.col("_u_unit").isNotNull() & ~F.col("_u_unit").isin("K", "Pa", "m/s")).select("row_id", F.col("_u_unit").alias("unit"))
