"""Time cells of many formats, precisions and zones -> one UTC instant (problem 1).

`parse_times` reads the cells into a local clock reading or an absolute instant, all in JVM expressions.
`zone_histories` estimates the offset history of offices whose zone nobody knows, by laying their local readings
against the times of receipt. `normalise_times` joins both and converts.

Defined results:
* cells that hold no time, or one that does not exist (hour 25, 30 February, 99 o'clock), give status 'none';
* a null, blank or unknown zone and no estimate give 'no zone'; an estimate gives 'estimated';
* a local reading that the zone's clock skips gives 'skipped', one that it shows twice 'twice';
* 24:00 is midnight of the next day; a day without a month counts from 1 January;
* nulls in any cell are missing cells; an empty table gives an empty table; repeated rows are converted alike;
* input columns are kept, but for those that begin with `_t_`, as the added ones do.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binding import bind
from tidemark.session import cut, small

# Civil abbreviations that stand for one offset, in minutes east of Greenwich.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MET": 60, "EET": 120,
    "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CDT": -300, "MDT": -360, "MST": -420, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "NST": -210, "NDT": -150, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
# The months' English names and Roman numerals.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]

ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*(.*)$"
DATE = r"^(\d{4})([-/.]?)(\d{2})\2(\d{2})$"
DECIMAL = r"^(\d{1,2}(?:[.,]\d+)?)\s*((?!h\d)(?:[A-Za-z]|[+-]).*)?$"
CLOCK = r"^(\d{1,2})(?:[:h.](\d{2})(?::(\d{2})(?:[.,]\d+)?)?|(\d{2}))\s*([AaPp]\.?[Mm]\.?)?\s*((?:[A-Za-z]|[+-]).*)?$"
MERIDIEM = r"[0-9]\s*[AaPp]\.?[Mm]\.?(\s|$)"
DAY = r"^(\d{1,3})(?:\.|st|nd|rd|th)?$"
EPOCH = r"^(\d{8,13})(?:\.(\d+))?$"
PERIOD_S = 900  # width of a bin of lag, in seconds
SURPRISE = 0.1  # violations that a nat of surprise counts for


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def offset_minutes(zone: Column) -> Column:
    """Minutes east of Greenwich that a zone text states ('Z', 'CET', '+0530', 'GMT-03:30', 'UTC+2'), else null."""
    z = F.upper(F.trim(zone))
    pattern = r"^(?:UTC|GMT)?\s*([+-])(\d{1,2}):?(\d{2})?$"
    hours, minutes = _number(F.regexp_extract(z, pattern, 2)), F.coalesce(_number(F.regexp_extract(z, pattern, 3)), F.lit(0))
    sign = F.when(F.regexp_extract(z, pattern, 1) == "-", -1).otherwise(1)
    numeric = F.when((hours <= 14) & (minutes < 60), sign * (hours * 60 + minutes))
    return F.when(z.rlike(pattern), numeric).otherwise(F.try_element_at(_map(ABBREVIATIONS), z))


def parse_times(df: DataFrame, yr: str = "core_yr", mo: str = "core_mo", dy: str = "core_dy", hr: str = "core_hr") -> DataFrame:
    """Add `_t_instant` (epoch seconds, where the cells give one alone), `_t_local` (seconds of the local clock since
    1970) and `_t_zone` (the zone text in the cells, '' if none); all null where the cells hold no time."""
    df = df.drop(*[c for c in df.columns if c.startswith("_t_")])
    out = bind(df, {f"_t_{k}": F.nullif(F.trim(F.col(v)), F.lit("")) for k, v in {"y": yr, "m": mo, "d": dy, "h": hr}.items()})
    y, m, d, h = (F.col(f"_t_{k}") for k in "ymdh")
    decimal_hour = h.rlike(DECIMAL) & ~h.rlike(MERIDIEM)
    out = bind(out, {"_t_iso": y.rlike(ISO), "_t_date": y.rlike(DATE), "_t_decimal": decimal_hour, "_t_clock": h.rlike(CLOCK), "_t_half": h.rlike(MERIDIEM)})
    iso, date, decimal, meridiem, clocked = (F.col(f"_t_{k}") for k in ("iso", "date", "decimal", "half", "clock"))
    year = _number(F.when(iso, F.regexp_extract(y, ISO, 1)).when(date, F.regexp_extract(y, DATE, 1)).when(y.rlike(r"^\d{4}$"), y))
    names_of = {str(i + 1): i + 1 for i in range(12)} | {f"0{i + 1}": i + 1 for i in range(9)}
    names_of |= {x.upper(): i + 1 for i, x in enumerate(ROMAN)} | {x.upper(): i + 1 for i, x in enumerate(MONTHS)} | {x[:3].upper(): i + 1 for i, x in enumerate(MONTHS)}
    named = F.try_element_at(_map(names_of), F.upper(F.regexp_replace(m, r"\.$", "")))
    month = F.when(iso, _number(F.regexp_extract(y, ISO, 2))).when(date, _number(F.regexp_extract(y, DATE, 3))).when(m.isNull(), F.lit(1)).otherwise(named)
    day = F.when(iso, _number(F.regexp_extract(y, ISO, 3))).when(date, _number(F.regexp_extract(y, DATE, 4))).otherwise(_number(F.regexp_extract(d, DAY, 1)))
    def fraction(text: Column) -> Column:
        return F.coalesce(F.concat(F.lit("0."), F.nullif(text, F.lit(""))).try_cast("double"), F.lit(0.0))

    def clock(hours: Column, minutes: Column, seconds: Column) -> Column:
        exists = ((hours < 24) & (minutes < 60) & (seconds < 60)) | ((hours == 24) & (minutes == 0) & (seconds == 0))
        return F.when(exists, hours * 3600.0 + minutes * 60 + seconds)

    zero = F.lit(0)
    hours = F.regexp_replace(F.regexp_extract(h, DECIMAL, 1), ",", ".").try_cast("double")
    out = bind(out, {
        "_t_year": year, "_t_month": month, "_t_mday": day, "_t_hours": F.when(decimal, hours),
        "_t_ch": _number(F.when(iso, F.regexp_extract(y, ISO, 4)).otherwise(F.regexp_extract(h, CLOCK, 1))),
        "_t_cm": F.coalesce(_number(F.when(iso, F.regexp_extract(y, ISO, 5)).otherwise(F.regexp_extract(h, CLOCK, 2))), _number(F.regexp_extract(h, CLOCK, 4)), zero),
        "_t_cs": F.coalesce(_number(F.when(iso, F.regexp_extract(y, ISO, 6)).otherwise(F.regexp_extract(h, CLOCK, 3))), zero) + F.when(iso, fraction(F.regexp_extract(y, ISO, 7))).otherwise(0.0),
        "_t_zone": F.coalesce(F.trim(F.when(iso, F.regexp_extract(y, ISO, 8)).when(decimal, F.regexp_extract(h, DECIMAL, 2)).when(clocked, F.regexp_extract(h, CLOCK, 6))), F.lit("")),
        "_t_epoch": F.when(y.isNull() & m.isNull() & d.isNull() & h.rlike(EPOCH), F.regexp_extract(h, EPOCH, 1)),
    })
    year, month, day, hours, ch, cm, cs, ticks = (F.col(f"_t_{k}") for k in ("year", "month", "mday", "hours", "ch", "cm", "cs", "epoch"))
    leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    length = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    most = F.when(~iso & ~date & m.isNull(), F.when(leap, 366).otherwise(365)).otherwise(length)
    valid = year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= most)
    first = F.try_make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    days = F.when(valid, F.unix_date(first) + day - 1)

    half = F.when(ch.between(1, 12), clock(F.pmod(ch, F.lit(12)) + F.when(F.lower(F.regexp_extract(h, CLOCK, 5)).startswith("p"), 12).otherwise(0), cm, cs))
    read = F.when(iso, clock(ch, cm, cs)).when(decimal, F.when(hours <= 24, F.round(hours * 3600, 3))).when(clocked, F.when(meridiem, half).otherwise(clock(ch, cm, cs)))
    instant = (ticks.try_cast("double") + fraction(F.regexp_extract(h, EPOCH, 2))) / F.when(F.length(ticks) > 11, 1000).otherwise(1)
    out = bind(out, {"_t_instant": instant, "_t_local": days * F.lit(86400.0) + read})
    return out.select(*df.columns, "_t_instant", "_t_local", "_t_zone")


def _clock_offset(seconds: Column, zone: Column) -> Column:
    """Seconds that the clock of `zone` is ahead of UTC at an instant; independent of the session's zone."""
    whole = F.floor(seconds)
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(whole), zone)) - whole


def zone_table(decks: DataFrame, key: str = "dck", zone: str = "time_zone") -> DataFrame:
    """One row per office with its IANA zone, null where it is missing or no such zone exists."""
    known = F.when(F.col(zone).isin(sorted(available_timezones())), F.col(zone))
    return decks.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_t_key")).agg(F.max(known).alias("_t_deckzone"))


def _best_history(typical_bins: int, switch: float, surprise: np.ndarray):
    """Per office: the offset of each period, such that the fewest readings lie after their receipt or implausibly
    long before it; each change of offset costs `switch` readings (Viterbi over the periods in order). Among offsets
    that violate about as few, the one under which the delays of receipt are least surprising."""
    offsets = np.arange(-12 * 4, 14 * 4 + 1)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        periods = np.sort(pdf["period"].unique())
        cost, doubt = np.zeros((len(periods), len(offsets))), np.zeros((len(periods), len(offsets)))
        for i, p in enumerate(periods):
            part = pdf[pdf["period"] == p]
            delay = part["lag"].to_numpy()[:, None] + offsets[None, :]
            cost[i] = (part["n"].to_numpy()[:, None] * ((delay < 0) | (delay > typical_bins))).sum(axis=0)
            doubt[i] = (part["n"].to_numpy()[:, None] * surprise[np.clip(delay, -1, len(surprise) - 2)]).sum(axis=0)
        # then the one nearest to zero, and the western one
        paid = cost + SURPRISE * doubt + np.abs(offsets) * 1e-6 + (offsets > 0) * 1e-7
        best, back = paid[0], []
        for row in paid[1:]:
            stay, move = best, best.min() + switch
            back.append(np.where(stay <= move, np.arange(len(offsets)), best.argmin()))
            best = np.minimum(stay, move) + row
        path = [int(best.argmin())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        path.reverse()
        n = pdf.groupby("period")["n"].sum().reindex(periods).to_numpy()
        return pd.DataFrame({"_t_key": pdf["_t_key"].iloc[0], "period": periods, "offset_minutes": offsets[path] * 15, "readings": n, "violations": cost[np.arange(len(periods)), path].astype("int64")})

    return choose


def zone_histories(parsed: DataFrame, zones: DataFrame, key: str = "c1_dck", received: str = "received_at", typical_share: float = 0.8, switch: float = 12.0) -> DataFrame:
    """Estimated offset per office of unknown zone and month: columns _t_key, period (year * 12 + month - 1),
    offset_minutes, readings, violations.

    A reading's lag is its time of receipt less its local time. The offices of known zone tell how long reports take:
    within which delay `typical_share` of those that come within two days do. For the others an offset is violated by
    each reading that it puts after its receipt or before that delay. Only histograms (office, month, 15-minute bin) leave
    the tasks, at most some 200 bins a month, whatever the number of rows."""
    local = parsed.filter(F.col("_t_local").isNotNull() & (F.col("_t_zone") == "") & F.col(received).isNotNull())
    local = local.join(small(zones), F.col(key) == F.col("_t_key"))
    known, day = F.col("_t_deckzone").isNotNull(), 86400 // PERIOD_S
    lag = F.unix_seconds(F.col(received).cast("timestamp")) - F.col("_t_local") + F.when(known, _clock_offset(F.col("_t_local"), F.col("_t_deckzone"))).otherwise(0)
    month = F.date_from_unix_date(F.floor(F.col("_t_local") / 86400).cast("int"))
    # offices of known zone are told apart by nothing but their lags
    bins = local.select(F.when(~known, F.col("_t_key")).alias("_t_key"), known.alias("known"), F.when(~known, F.year(month) * 12 + F.month(month) - 1).alias("period"), F.floor(lag / PERIOD_S).cast("int").alias("lag"))
    inside = F.when(F.col("known"), F.col("lag").between(0, 2 * day - 1)).otherwise(F.col("lag").between(-60, 60 + 2 * day))
    bins = cut(bins.filter(inside).groupBy("_t_key", "known", "period", "lag").agg(F.count("*").alias("n")))
    delay = bins.filter("known").select("lag", "n").toPandas().sort_values("lag")  # at most 192 rows
    typical = 24
    if len(delay):
        typical = int(delay["lag"].to_numpy()[np.searchsorted(delay["n"].cumsum(), typical_share * delay["n"].sum())])
    # how surprising a delay is, in nats; one beyond two days, or negative (the last entry), most of all
    seen = np.ones(2 * day + 1)
    seen[delay["lag"].to_numpy("int64")] += delay["n"].to_numpy("int64")
    surprise = -np.log(seen / seen.sum())
    unknown = bins.filter(~F.col("known")).select("_t_key", "period", "lag", "n")
    return unknown.groupBy("_t_key").applyInPandas(_best_history(typical, switch, surprise), "_t_key string, period int, offset_minutes int, readings long, violations long")


def normalise_times(df: DataFrame, decks: DataFrame, *, yr: str = "core_yr", mo: str = "core_mo", dy: str = "core_dy", hr: str = "core_hr", key: str = "c1_dck", received: str = "received_at", estimate: bool = True) -> DataFrame:
    """All rows of `df` with `_t_utc` ('YYYY-MM-DD HH:MM', to the nearest minute, null if no single instant follows),
    `_t_status` ('instant', 'cells', 'deck', 'estimated', 'no zone', 'twice', 'skipped', 'none') and `_t_offset`
    (minutes, for 'cells' and 'estimated'). A zone in the cells goes before that of the office."""
    df, zones = df.drop(*[c for c in df.columns if c.startswith("_t_")]), zone_table(decks)
    parsed = parse_times(df, yr, mo, dy, hr)
    out = parsed.join(small(zones), F.col(key) == F.col("_t_key"), "left")
    local, zone = F.col("_t_local"), F.col("_t_deckzone")
    month = F.date_from_unix_date(F.floor(local / 86400).cast("int"))
    if estimate:
        # offices of unknown zone times calendar months
        history = zone_histories(parsed, zones, key, received).select(F.col("_t_key").alias("_t_hkey"), F.col("period").alias("_t_period"), F.col("offset_minutes").alias("_t_guess"))
        wanted = F.when(zone.isNull() & (F.col("_t_zone") == ""), F.year(month) * 12 + F.month(month) - 1)
        out = out.join(small(history), (F.col(key) == F.col("_t_hkey")) & (wanted == F.col("_t_period")), "left")
    else:
        out = out.withColumn("_t_guess", F.lit(None).cast("int"))
    stated = offset_minutes(F.col("_t_zone"))
    out = bind(out, {"_t_stated": stated, "_t_o1": _clock_offset(local - 86400, zone), "_t_o2": _clock_offset(local + 86400, zone)})
    u1, u2 = local - F.col("_t_o1"), local - F.col("_t_o2")
    out = bind(out, {"_t_ok1": _clock_offset(u1, zone) == F.col("_t_o1"), "_t_ok2": _clock_offset(u2, zone) == F.col("_t_o2")})
    same, ok1, ok2 = F.col("_t_o1") == F.col("_t_o2"), F.col("_t_ok1"), F.col("_t_ok2")
    status = (
        F.when(F.col("_t_instant").isNotNull(), "instant").when(local.isNull(), "none").when(F.col("_t_stated").isNotNull(), "cells")
        .when((F.col("_t_zone") != "") | (zone.isNull() & F.col("_t_guess").isNull()), "no zone").when(zone.isNull(), "estimated")
        .when(same | (ok1 != ok2), "deck").when(ok1, "twice").otherwise("skipped")
    )
    out, status = bind(out, {"_t_status": status}), F.col("_t_status")
    seconds = (
        F.when(status == "instant", F.col("_t_instant")).when(status == "cells", local - F.col("_t_stated") * 60)
        .when(status == "estimated", local - F.col("_t_guess") * 60).when(status == "deck", F.when(same | ok1, u1).otherwise(u2))
    )
    out = bind(out, {"_t_minute": F.floor(F.round(seconds, 3) / 60 + 0.5)})
    minute = F.col("_t_minute")
    inside = F.pmod(minute, F.lit(1440))
    text = F.concat(F.date_from_unix_date(F.floor(minute / 1440).cast("int")).cast("string"), F.lit(" "), F.lpad(F.floor(inside / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((inside % 60).cast("string"), 2, "0"))
    offset = F.when(status == "cells", F.col("_t_stated")).when(status == "estimated", F.col("_t_guess"))
    return out.withColumns({"_t_utc": text, "_t_offset": offset}).select(*df.columns, "_t_utc", "_t_status", "_t_offset", "_t_deckzone")


def is_plain(yr: str = "core_yr", mo: str = "core_mo", dy: str = "core_dy", hr: str = "core_hr") -> Column:
    """Whether the cells are in the plain form: UTC office, YYYY, unpadded month and day, decimal hours below 24 with two decimals."""
    shape = F.col(yr).rlike(r"^\d{4}$") & F.col(mo).rlike(r"^[1-9]\d?$") & F.col(dy).rlike(r"^[1-9]\d?$") & F.col(hr).rlike(r"^(?:[01]?\d|2[0-3])\.\d{2}$")
    return F.coalesce((F.col("_t_deckzone") == "UTC") & shape & (F.col("_t_status") == "deck"), F.lit(False))


def instants(reports: DataFrame, decks: DataFrame) -> DataFrame:
    """(row_id, utc_time, status): every row with its instant, also where the zone is estimated, and how that is known."""
    return normalise_times(reports.select("row_id", "core_yr", "core_mo", "core_dy", "core_hr", "c1_dck", "received_at"), decks).select("row_id", F.col("_t_utc").alias("utc_time"), F.col("_t_status").alias("status"))


def hidden_zones(reports: DataFrame, decks: DataFrame) -> DataFrame:
    """How well hidden zones are estimated: the zones of one half of the offices are hidden and estimated with the other half known, and
    the other way round. Columns: dck, n (rows that need the zone of their office), n_estimated, n_right (the true instant)."""
    needed = reports.select("core_yr", "core_mo", "core_dy", "core_hr", "c1_dck", "received_at")
    out = None
    for half in (0, 1):
        mine = F.pmod(F.xxhash64("dck"), F.lit(2)) == half
        guessed = normalise_times(needed, decks.withColumn("time_zone", F.when(~mine, F.col("time_zone"))))
        guessed = guessed.select(*needed.columns, F.col("_t_utc").alias("guess"), F.col("_t_status").alias("how"))
        true = normalise_times(guessed, decks, estimate=False).filter(F.pmod(F.xxhash64("c1_dck"), F.lit(2)) == half)
        part = true.filter("_t_status = 'deck'").groupBy(F.col("c1_dck").alias("dck")).agg(F.count("*").alias("n"), F.count(F.when(F.col("how") == "estimated", 1)).alias("n_estimated"), F.count(F.when((F.col("how") == "estimated") & (F.col("guess") == F.col("_t_utc")), 1)).alias("n_right"))
        out = part if out is None else out.unionByName(part)
    return out


def unplain_times(reports: DataFrame, decks: DataFrame) -> DataFrame:
    """(row_id, utc_time) of each row whose time is not plain; 'unclear' if no single instant follows from what is
    known: an estimated zone is no known zone."""
    times = normalise_times(reports.select("row_id", "core_yr", "core_mo", "core_dy", "core_hr", "c1_dck", "received_at"), decks)
    sure = F.col("_t_status").isin("instant", "cells", "deck")
    return times.filter(~is_plain()).select("row_id", F.when(sure, F.col("_t_utc")).otherwise("unclear").alias("utc_time"))
