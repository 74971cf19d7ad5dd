"""Transforms of the mapper: columns in, one column out. A registry resolves them by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.corrections import timestamp_of

Transform = Callable[..., Column]
REGISTRY: dict[str, Transform] = {}
# How the history column names the source, the longest known prefix of the model winning.
LINEAGES = {
    "icoads": ". Initial conversion from ICOADS R3.0.0T", "icoads_r300_d714": ". Initial conversion from ICOADS R3.0.0T with supplemental data recovery",
    "icoads_r302": ". Initial conversion from ICOADS R3.0.2T NRT", "craid": ". Initial conversion from C-RAID", "marob": ". Initial conversion from DWD MAROB data base", "cmems": ". Initial conversion from CMEMS",
}
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"  # fixed value of RFC 4122


def transform(f: Transform) -> Transform:
    REGISTRY[f.__name__] = f
    return f


def number(c: Column) -> Column:
    return c.try_cast("double")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


@transform
def datetime_decimalhour_to_hm(h, *_, **__):
    """HR and M of a decimal hour, seconds cut off; null for what is no number."""
    x = number(h)
    hour = F.floor(x)
    return F.struct(hour.alias("HR"), F.floor(F.round((x - hour) * 3600, 6) / 60).alias("M"))


@transform
def datetime_imma1(y, m, d, h, **_):
    return timestamp_of(y, m, d, h)


@transform
def datetime_imma1_to_utc(y, m, d, h, lon, lat, **_):
    """Local noon by the nautical zone of the longitude (fifteen degrees an hour); zone polygons are not at hand."""
    east = number(lon)
    east = F.when(east > 180, east - 360).otherwise(east)
    noon = timestamp_of(y, m, d, F.lit(12.0))
    return noon - F.make_dt_interval(F.lit(0), F.rint(east / 15).cast("int"))


@transform
def datetime_imma1_701(y, m, d, h, lon, lat, **_):
    return F.when(h.isNotNull(), timestamp_of(y, m, d, h)).otherwise(datetime_imma1_to_utc(y, m, d, h, lon, lat))


@transform
def datetime_immt(y, m, d, h, **_):
    return F.try_make_timestamp_ntz(y.cast("int"), m.cast("int"), d.cast("int"), h.cast("int"), F.lit(0), F.lit(0))


@transform
def datetime_utcnow(*_, now: datetime | None = None, **__):
    return F.lit((now or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


@transform
def datetime_craid(c, **_):
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")).cast("timestamp_ntz")


@transform
def datetime_cmems(c, **_):
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


@transform
def datetime_marob(c, **_):
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


@transform
def df_col_join(*cols, sep="", **_):
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("nan")) for c in cols])


@transform
def float_opposite(c, **_):
    return -number(c)


@transform
def select_column(*cols, **_):
    return F.coalesce(*cols)


@transform
def float_scale(c, factor=1.0, **_):
    return number(c) * F.lit(float(factor))


@transform
def integer_to_float(c, **_):
    return number(c)


@transform
def icoads_wd_conversion(c, **_):
    return F.when(c == 361, F.lit(0)).when(c == 362, None).otherwise(c)


@transform
def icoads_wd_integer_to_float(c, **_):
    return icoads_wd_conversion(c).cast("double")


@transform
def lineage(*_, imodel: str = "", now: datetime | None = None, **__):
    key = max((k for k in LINEAGES if imodel.startswith(k)), key=len, default=None)
    return F.lit((now or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S") + (LINEAGES[key] if key else ""))


@transform
def longitude_360to180(c, **_):
    """Single precision, as the tables hold it."""
    x = number(c)
    return F.when(x > 180, -180 + x % 180).otherwise(x).cast("float").cast("double")


@transform
def location_accuracy(li, lat, **_):
    degrees = F.try_element_at(_map({"0": 0.1, "1": 1.0, "4": 1 / 60, "5": 1 / 3600}), F.regexp_replace(li.cast("string"), r"\.0$", ""))
    km = degrees * F.sqrt(111.0**2 * (1 + F.pow(F.cos(F.radians(number(lat))), 2)))
    return F.when(km.isNotNull(), F.greatest(F.lit(1.0), F.rint(km)))


@transform
def observing_programme(c, **_):
    c = c.cast("string")
    return F.when(c.isin("0", "1", "2", "3", "4", "5"), F.array(*map(F.lit, [5, 7, 56]))).when(c == "7", F.array(*map(F.lit, [5, 7, 9])))


def _add(middle, prepend=None, append=None, separator=""):
    parts = [F.lit(prepend)] * bool(prepend) + [middle] + [F.lit(append)] * bool(append)
    return F.when(middle != "", F.concat_ws(separator or "", *parts))


def zero_filled(text: Column, width: int) -> Column:
    """Zeros before a text up to a width, behind its sign; longer texts stay."""
    sign = F.regexp_extract(text, "^[+-]", 0)
    rest = F.substr(text, F.length(sign) + 1)
    return F.when(F.length(text) < width, F.concat(sign, F.lpad(rest, F.lit(width) - F.length(sign), F.lit("0")))).otherwise(text)


@transform
def string_add(c, prepend=None, append=None, separator="", **_):
    """Null, the empty text and the number 0 give null; the text "0" is a text like any other."""
    text = c.cast("string")
    return _add(F.when((F.typeof(c) == "string") | (c.try_cast("double") != 0), text), prepend, append, separator)


@transform
def string_join_add(*cols, prepend=None, append=None, separator="", zfill_col=None, zfill=None, **_):
    width = dict(zip(zfill_col or [], zfill or []))
    texts = [F.coalesce(c.cast("string"), F.lit("nan")) for c in cols]
    filled = [zero_filled(t, width[i]) if i in width else t for i, t in enumerate(texts)]
    return _add(F.concat_ws(separator or "", *filled), prepend, append, separator)


@transform
def temperature_celsius_to_kelvin(*cols, method: str = "method_a", **_):
    if method == "method_b":
        sign, t = cols
        return F.when(sign.isin("0", "5"), number(t)).otherwise(-number(t)) + 273.15
    return number(cols[0]) + 273.15


@transform
def velocity_kmh_in_ms(c, **_):
    return number(c) * F.lit(1 / 3.6)


@transform
def velocity_kn_in_ms(c, **_):
    return number(c) * F.lit(1852 / 3600)


@transform
def pressue_hpa_in_pa(c, **_):
    return number(c) * 100


@transform
def time_accuracy(c, **_):
    return F.try_element_at(_map({"0": 3600, "1": 360, "2": 60, "3": 36}), c.cast("string"))


@transform
def feet_to_m(c, **_):
    return F.bround(number(c) / 3.2808, 2)


@transform
def gdac_uid(y, m, d, h, *rest, prepend="", append="", **_):
    """Name-based UUID (version 5) of date and hour zero-filled, and what follows, in hexadecimal; pure SQL over SHA-1."""
    name = F.concat(F.lpad(y.cast("string"), 4, "0"), *[F.lpad(c.cast("string"), 2, "0") for c in (m, d, h)], *[F.coalesce(c.cast("string"), F.lit("")) for c in rest])
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.lit(prepend or ""), F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.substring(variant, -1, 1), F.substring(digest, 18, 15), F.lit(append or ""))


@transform
def gdac_latitude(qc, lat, **_):
    return F.when(qc.cast("int").isin(3, 5), -number(lat)).otherwise(number(lat))


@transform
def gdac_longitude(qc, lon, **_):
    return F.when(qc.cast("int").isin(5, 7), -number(lon)).otherwise(number(lon))


@transform
def gdac_pressure(c, **_):
    p = number(c)
    return F.when(p < 1000, p + 10000).otherwise(p) * 0.1


def coord_360_to_180(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def coord_dmh_to_90(degrees: Column, minutes: Column, hemisphere: Column) -> Column:
    """Degrees and minutes with a letter for the hemisphere, to two decimals."""
    return F.bround(F.abs(degrees) + minutes / 60, 2) * F.when(hemisphere.isin("S", "W"), -1).otherwise(1)
