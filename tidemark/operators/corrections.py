"""Corrections of dates and platform types by deck, and checks of times and station ids; all conditional columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans import specs

# Platform type that fills missing ones, by release and deck.
FILLS = {
    "r300": dict.fromkeys(["128", "150", "151", "152", "155", "156", "192", "201", "246", "255", "875", "897", "899", "993"], "5"),
    "r302": {"793": "6", "794": "22", "795": "13", "797": "13", "798": "22", "993": "6", "994": "22", "995": "13"},
}
# The columns that hold a station's id, source and platform type, and the parts of its time, by model.
COLUMNS = {
    "id": {"icoads": "core.ID", "gdac": "ID", "craid": "drifter_characteristics.DRIFTER_WMO_NUMBER", "cdm": "header.primary_station_id"},
    "source": {"icoads": "c1.SID", "gdac": "005"},
    "platform": {"icoads": "c1.PT", "gdac": "OP", "cdm": "header.platform_type"},
    "time": {"icoads": ["core.YR", "core.MO", "core.DY", "core.HR"], "gdac": ["AAAA", "MM", "YY", "GG"]},
}


@lru_cache
def id_patterns() -> dict[str, list[str]]:
    """Patterns of valid ids by deck."""
    lines = (specs.FOLDER / "station_ids.txt").read_text().splitlines()
    return {deck: of.lstrip(" ").split("\t") if of.strip() else [] for deck, _, of in (x.partition(":") for x in lines if x and not x.startswith("#"))}


def timestamp_of(y: Column, m: Column, d: Column, hour: Column) -> Column:
    """Timestamp of year, month, day and decimal hour, seconds cut off; null if there is no such time."""
    h = hour.cast("double")
    whole = F.floor(h)
    minute = F.floor(F.round((h - whole) * 3600, 6) / 60)
    return F.try_make_timestamp_ntz(y.cast("int"), m.cast("int"), d.cast("int"), whole.cast("int"), minute.cast("int"), F.lit(0))


def columns_of(ts: Column) -> tuple[Column, Column, Column, Column]:
    """Year, month, day and decimal hour of a timestamp."""
    return F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts) + F.minute(ts) / F.lit(60.0)


def valid_datetime(y: Column, m: Column, d: Column, hour: Column) -> Column:
    return timestamp_of(y, m, d, hour).isNotNull()


def correct_deck_201(df: DataFrame, y: str, m: str, d: str, h: str) -> DataFrame:
    """Up to 1899, midnight of this deck is that of the day before; a date that does not exist becomes null."""
    old = (F.col(y) <= 1899) & (F.col(h) == 0)
    before = F.date_sub(timestamp_of(F.col(y), F.col(m), F.col(d), F.lit(0)).cast("date"), 1)
    out = {y: F.year(before), m: F.month(before), d: F.dayofmonth(before)}
    return df.withColumns({c: F.when(old, v.cast(dict(df.dtypes)[c])).otherwise(F.col(c)) for c, v in out.items()})


def correct_datetime(df: DataFrame, imodel: str, y: str = "core_yr", m: str = "core_mo", d: str = "core_dy", h: str = "core_hr") -> DataFrame:
    """Only deck 201 has a correction; models without release and deck stay as they are."""
    return correct_deck_201(df, y, m, d, h) if imodel.startswith("icoads") and _deck(imodel)[1] == "201" else df


def fill_value(column: Column, fill: str, *, own: Sequence | None = None, fill_null: bool = False, others: Sequence[tuple[Column, Sequence]] = (), joined: str = "intersect") -> Column:
    """Overwrite a column where it holds one of `own` and ('intersect') or or ('join') all other columns hold one of their
    values; also where it is null, if `fill_null`."""
    yes = F.lit(False)
    mine = column.isin(*own) if own is not None else None
    out = None
    for c, values in others:
        p = c.isin(*values) if isinstance(values, (list, tuple)) else values
        out = p if out is None else out & p
    if mine is not None and out is not None:
        yes = (mine & out) if joined == "intersect" else (mine | out)
    elif mine is not None or out is not None:
        yes = mine if mine is not None else out
    if fill_null:
        yes = F.coalesce(yes, F.lit(False)) | column.isNull()
    return F.when(F.coalesce(yes, F.lit(False)), F.lit(fill)).otherwise(column)


def numeric_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d+$"), F.lit(False))


def deck_717(op: Column, n: Column) -> tuple[Column, Column]:
    """(OP, N): null OP is '7'; N null where OP is '0' is '9'."""
    return F.coalesce(op, F.lit("7")), F.when(n.isNull() & (op == "0"), "9").otherwise(n)


def deck_700(pt: Column, ident: Column, sid: Column) -> Column:
    """Null is '7'; a drifter with a five-digit id from source 147 that passes as a ship is '6'."""
    pt = F.coalesce(pt, F.lit("7"))
    return F.when(ident.rlike(r"^\d{5}$") & (sid == "147") & (pt == "5"), "6").otherwise(pt)


def deck_892(pt: Column, ident: Column, sid: Column) -> Column:
    return F.when(ident.rlike(r"^\d{5}$") & (sid == "29") & (pt == "5"), "6").otherwise(pt)


def _numbered_buoy(ident: Column) -> Column:
    return numeric_id(ident) & ~F.length(ident).isin(5, 7) & ~ident.startswith("7")


def deck_792(pt: Column, ident: Column, sid: Column) -> Column:
    return F.when(_numbered_buoy(ident) & (sid == "103") & (pt == "5"), "6").otherwise(pt)


def deck_992(pt: Column, ident: Column, sid: Column) -> Column:
    """First '4' for seven digits 620 and then twos only, then '6' for other numbers that are no ships'."""
    light = F.when(ident.rlike(r"^6202+$") & (F.length(ident) == 7) & (sid == "114") & (pt == "5"), "4").otherwise(pt)
    return F.when(_numbered_buoy(ident) & (sid == "114") & (light == "5"), "6").otherwise(light)


DECK_FUNCTIONS: dict[tuple[str, str], Callable[[Column, Column, Column], Column]] = {
    ("r300", "700"): deck_700, ("r300", "892"): deck_892, ("r302", "792"): deck_792, ("r302", "992"): deck_992,
}


def _deck(imodel: str) -> tuple[str, str]:
    """Release and deck of a model, empty if it names none."""
    parts = imodel.split("_")
    deck = next((p for p in parts[1:] if p.startswith("d") and p[1:].isdigit()), "")
    return (parts[1] if len(parts) > 2 else "", deck.removeprefix("d"))


def correct_pt(df: DataFrame, imodel: str, pt: str = "c1_pt", ident: str = "core_id", sid: str = "c1_sid", op: str = "OP", n: str = "N", corrections: dict[str, dict] | None = None) -> DataFrame:
    """Platform types corrected by the rule of the model's deck; models without a deck stay as they are. corrections: external rules,
    {deck: {"method": "fillna", "fill_value": v}} or {deck: {"method": "function", "function": Column function of type, id, source}}."""
    model, (release, deck) = imodel.split("_")[0], _deck(imodel)
    if corrections is not None and (rule := corrections.get(f"d{deck}") or corrections.get(deck)):
        if rule.get("method") == "fillna":
            if rule.get("fill_value") is None:
                raise ValueError(f"fillna of deck {deck} needs a fill_value")
            return df.withColumn(pt, F.coalesce(pt, F.lit(rule["fill_value"])))
        if rule.get("method") != "function" or rule.get("function") is None:
            raise ValueError(f"deck {deck} has no rule that is known: {rule}")
        return df.withColumn(pt, rule["function"](F.col(pt), F.trim(ident), F.trim(F.col(sid).cast("string"))))
    if model == "gdac" and deck == "717":
        new_op, new_n = deck_717(F.col(op), F.col(n))
        return df.withColumns({op: new_op, n: new_n})
    if model != "icoads" or not deck:
        return df
    if f := DECK_FUNCTIONS.get((release, deck)):
        return df.withColumn(pt, f(F.col(pt), F.trim(ident), F.trim(F.col(sid).cast("string"))))
    fill = FILLS.get(release, {}).get(deck)
    return df.withColumn(pt, F.coalesce(pt, F.lit(fill))) if fill else df


def valid_id(ident: Column, imodel: str, blank: bool = False, patterns: dict[str, list[str]] | None = None) -> Column:
    """Whether an id begins with a match of one of its deck's patterns; null is valid if `blank` or one of them is '^$'. A
    deck without patterns accepts every text. A model without a library of patterns, or without a deck, raises."""
    parts = imodel.split("_")
    if len(parts) < 3:
        raise ValueError(f"{imodel} names no deck")
    if patterns is None and parts[:2] != ["icoads", "r300"]:
        raise FileNotFoundError(f"no id patterns for {imodel}")
    known = patterns if patterns is not None else id_patterns()
    if parts[2] not in known:
        raise ValueError(f"deck {parts[2]} has no entry among the id patterns")
    chosen = [*(known[parts[2]] or [".*?"]), *["^$"] * blank]
    return F.coalesce(ident.rlike("^(?:" + "|".join(chosen) + ")"), F.lit("^$" in chosen))


def valid_model_datetime(imodel: str, find: Callable[[str], Column | None]) -> Column:
    """Whether the time columns of a model hold a time; for models without such, whether a timestamp column `date_time` does."""
    names = COLUMNS["time"].get(imodel.split("_")[0])
    if names is None:
        return F.col("date_time").isNotNull()
    parts = [find(x) for x in names]
    if any(p is None for p in parts):
        raise ValueError(f"no columns {names}")
    return valid_datetime(*parts)
