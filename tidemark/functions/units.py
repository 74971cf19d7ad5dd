"""Units: their texts, and conversion to the common units K, Pa and m/s.

A unit is a base (K, degC, degF, Pa, hPa, inHg, mmHg, m/s, kn, km/h, mph), with '0.1' before it if the numbers are ten
times the value in it. Texts are read by rule: a mark of tenths, the words for degree, then a name of the base.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor and summand to the common unit.
TO_COMMON = {
    "K": (1.0, 0.0), "degC": (1.0, 273.15), "degF": (5.0 / 9.0, 273.15 - 32 * 5.0 / 9.0),
    "Pa": (1.0, 0.0), "hPa": (100.0, 0.0), "inHg": (3386.389, 0.0), "mmHg": (133.322387415, 0.0),
    "m/s": (1.0, 0.0), "kn": (1852.0 / 3600.0, 0.0), "km/h": (1 / 3.6, 0.0), "mph": (0.44704, 0.0),
}
# Names of the bases, without blanks, dots and the words for degree, in lower case.
NAMES = {
    "temperature": {"K": ["k", "kelvin"], "degC": ["c", "celsius", "centigrade", "℃"], "degF": ["f", "fahr", "fahrenheit", "℉"]},
    "pressure": {
        "Pa": ["pa", "pascal", "pascals"], "hPa": ["hpa", "hectopascal", "hectopascals", "hektopascal", "mb", "mbar", "millibar", "millibars"],
        "inHg": ["inhg", "inches", "inch", "in", "inchesofmercury", "incheshg"], "mmHg": ["mmhg", "mm", "torr", "millimetresofmercury", "millimetersofmercury"],
    },
    "speed": {
        "m/s": ["m/s", "ms-1", "mps", "metrespersecond", "meterspersecond", "m/sec"], "kn": ["kn", "kt", "kts", "knot", "knots", "knoten", "noeuds", "nudos"],
        "km/h": ["km/h", "kmh", "kph", "kmperhour", "kmh-1", "kilometresperhour", "kilometersperhour"], "mph": ["mph", "miles/h", "milesperhour", "milesanhour", "statutemilesanhour", "statutemilesperhour"],
    },
}
# Codes of variables and units.
DIMENSION = {85: "temperature", 36: "temperature", 95: "temperature", 41: "temperature", 58: "pressure", 107: "speed"}
CODES = {"temperature": {5: "K", 60: "degC"}, "pressure": {32: "Pa", 530: "hPa"}, "speed": {731: "m/s"}}
COMMON = {"temperature": "K", "pressure": "Pa", "speed": "m/s"}

TENTH = r"(?:\b(?:0[.,]1|1/10)(?:\s|(?=\D)))|tenths?\s+of|zehntel|dixi[eè]mes?\s+d[e']|d[eé]cimas?\s+de|\s*[x*×]\s*10$"
DEGREE = r"^(?:an?\s+)?(?:degrees?|degr[eé]s?|deg\.?|grados?|gradi|grad|°|º)\s*"


def units_of(dimension: str) -> list[str]:
    return [*NAMES[dimension], *{"temperature": ["0.1degC"], "pressure": ["0.1hPa"], "speed": []}[dimension]]


def dimension(variable: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in DIMENSION.items() for x in kv]), variable.cast("int"))


def read_unit(text: Column, dim: Column) -> Column:
    """The unit that a text names for a quantity of dimension `dim`; null if it names none."""
    t = F.lower(F.trim(text))
    base = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(t, r"\(.*?\)", ""), TENTH, "")), DEGREE, ""), r"[\s.]", "")
    table = {f"{d} {n}": u for d, names in NAMES.items() for u, every in names.items() for n in every}
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.concat_ws(" ", dim, base))
    return F.when(t.rlike(TENTH), F.concat(F.lit("0.1"), unit)).otherwise(unit)


def code_unit(code: Column, dim: Column) -> Column:
    """The unit of a code, if it is one of a quantity of dimension `dim`."""
    table = {f"{d} {c}": u for d, codes in CODES.items() for c, u in codes.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.concat_ws(" ", dim, code.cast("string")))


def conversion(unit: Column) -> tuple[Column, Column, Column]:
    """Divisor, factor and summand from a unit to the common one, null for an unknown unit."""
    tenth = unit.startswith("0.1")
    base = F.when(tenth, F.substring(unit, 4, 20)).otherwise(unit)
    factor = F.try_element_at(F.create_map(*[F.lit(x) for u, (f, _) in TO_COMMON.items() for x in (u, f)]), base)
    shift = F.try_element_at(F.create_map(*[F.lit(x) for u, (_, s) in TO_COMMON.items() for x in (u, s)]), base)
    return F.when(tenth, 10.0).otherwise(1.0), factor, shift


def to_common(value: Column, unit: Column) -> Column:
    """`value` in K, Pa or m/s, null for an unknown unit; rounded to 1e-6 so that equal readings stay equal."""
    divisor, factor, shift = conversion(unit)
    return F.round(value / divisor * factor + shift, 6)
