"""Report lines -> typed columns with a validity mask, by a schema compiled to expressions (no shuffle, no Python).

A cell is text, missing (blank or the missing value), or absent (its section is not there). Sections come in order; one
whose sentinel does not stand at the cursor is absent and leaves the cursor. Cells become `data.<section>.<element>` (or
`data.<element>` in flat schemas) and `mask` of the same shape: true valid or missing, false invalid or absent, null unchecked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binding import bind
from tidemark.plans.specs import Element, Schema, Section

TEXT, MISSING, ABSENT = 0, 1, 2
WIDEST = 100_000
Converter = Callable[[Column, Element], Column]


def cell_name(section: str, element: str) -> str:
    return f"_c_{section}_{element}"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cell(text: str, present: str, e: Element) -> str:
    """SQL of struct(v, st) of a cell's text."""
    blank = f"trim({text}) = ''" + (f" OR trim({text}) = {quoted(e.missing)}" if e.missing is not None else "")
    return f"named_struct('v', if({present} AND NOT ({blank}), {text}, null), 'st', cast(CASE WHEN NOT {present} THEN {ABSENT} WHEN {blank} THEN {MISSING} ELSE {TEXT} END AS tinyint))"


def parse_lines(lines: DataFrame, schema: Schema, line: str = "line", sections: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Add a cell column for each element. sections, excludes: names of sections, of elements in flat schemas."""
    def wanted(section: str, element: str) -> bool:
        name = element if schema.flat else section
        return (not sections or name in sections) and not (excludes and name in excludes)

    text = f"coalesce(`{line}`, '')"
    # first the cursor and presence of each section, a narrow chain; then all cells at once
    out = bind(lines, {"_at0": "1"})
    for k, s in enumerate(schema.sections):
        here = f"substring({text}, _at{k}, {len(s.sentinel)}) = {quoted(s.sentinel)}" if s.sentinel else "true"
        widths = sum(e.width or WIDEST for e in s.elements)
        span = (s.length or WIDEST) if s.raw else WIDEST if s.format == "delimited" or s.delimiter else min(widths, s.length or WIDEST)
        out = bind(out, {f"_here{k}": here, f"_at{k + 1}": f"_at{k} + if({here}, {span}, 0)"})
    cells: dict[str, str] = {}
    for k, s in enumerate(schema.sections):
        if s.raw:
            if wanted(s.name, s.name):
                cells[cell_name(s.name, "")] = f"if(_here{k}, substring({text}, _at{k}, {s.length or WIDEST}), null)"
        elif s.format == "delimited":
            row = ", ".join(f"f{i} string" for i in range(len(s.elements)))
            out = bind(out, {f"_row{k}": f"from_csv(substring({text}, _at{k}), '{row}', map('sep', {quoted(s.delimiter or ',')}))"})
            for i, e in enumerate(s.elements):
                if wanted(s.name, e.name) and not e.ignore:
                    v = f"trim(_row{k}.f{i})"
                    # a blank field of a delimited section is no text, and not valid for numbers
                    cells[cell_name(s.name, e.name)] = f"named_struct('v', if(_here{k} AND {v} <> '', {v}, null), 'st', cast(if(_here{k} AND {v} <> '', {TEXT}, {ABSENT}) AS tinyint))"
        elif s.delimiter:
            out = _separated(out, s, k, text, cells, wanted)
        else:
            start, end = 0, s.length or WIDEST
            for e in s.elements:
                width = min(e.width or WIDEST, max(0, end - start))
                if wanted(s.name, e.name) and not e.ignore:
                    cells[cell_name(s.name, e.name)] = _cell(f"substring({text}, _at{k} + {start}, {width})", f"_here{k}", e)
                start += e.width or WIDEST
    out = bind(out, cells)
    return out.select(*lines.columns, *cells)


def parse_columns(rows: DataFrame, schema: Schema, sections: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """The same cells from rows that have a column per element (array files), named as it or 'section.element'; other columns than those of
    the schema are kept. What has no column is absent, null and blank text are missing. Where files lack columns, `_has` names those
    that a row's file has."""
    cells = {}
    for s in schema.sections:
        name = lambda e: f"{s.name}.{e.name}"  # noqa: B023, E731
        if (sections and s.name not in sections and not schema.flat) or (excludes and s.name in excludes):
            continue
        if s.raw:
            cells[cell_name(s.name, "")] = "cast(null AS string)"
            continue
        for e in s.elements:
            column = name(e) if name(e) in rows.columns else e.name
            if column in rows.columns:
                present = f"array_contains(`_has`, {quoted(column)})" if "_has" in rows.columns else "true"
                cells[cell_name(s.name, e.name)] = _cell(f"coalesce(cast(`{column}` AS string), '')", present, e)
            else:
                cells[cell_name(s.name, e.name)] = f"named_struct('v', cast(null AS string), 'st', cast({ABSENT} AS tinyint))"
    return bind(rows, cells)


def _separated(df: DataFrame, s: Section, k: int, text: str, cells: dict[str, str], wanted: Callable[[str, str], bool]) -> DataFrame:
    """A section of fixed widths with delimiters between the fields: a cursor per field."""
    out, sep = bind(df, {f"_f{k}_0": f"_at{k}"}), quoted(s.delimiter)
    for i, e in enumerate(s.elements):
        out = bind(out, {f"_w{k}_{i}": f"substring_index(substring({text}, _f{k}_{i}, {e.width or WIDEST}), {sep}, 1)"})
        follows = f"_f{k}_{i} + length(_w{k}_{i})"
        out = bind(out, {f"_f{k}_{i + 1}": f"{follows} + if(substring({text}, {follows}, 1) = {sep}, 1, 0)"})
        if wanted(s.name, e.name) and not e.ignore:
            cells[cell_name(s.name, e.name)] = _cell(f"_w{k}_{i}", f"_here{k}", e)
    return out


def decimals(x: float | None) -> int:
    text = f"{x:.10f}".rstrip("0") if x else ""
    return len(text.partition(".")[2])


def number_sql(text: str, scale: float | None = None, offset: float | None = None) -> str:
    """offset + text * scale in decimal arithmetic, inner blanks as zeros, rounded half-even to the most decimals among the
    three; null if it is no number."""
    scale, offset = scale or 1.0, offset or 0.0
    clean = f"replace(trim({text}), ' ', '0')"
    least = max(decimals(scale), decimals(offset))
    digits = f"least(greatest(length(split_part({clean}, '.', 2)), {least}), 6)"
    unit = f"element_at(array({', '.join(f'{10**d}BD' for d in range(7))}), {digits} + 1)"
    value = f"try_cast({clean} AS decimal(20,6)) * cast('{scale!r}' AS decimal(12,6)) + cast('{offset!r}' AS decimal(18,6))"
    return f"if(rlike({clean}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$'), cast(bround(cast(({value}) * {unit} AS decimal(38,6)), 0) AS double) / cast({unit} AS double), null)"


def base36_sql(text: str) -> str:
    """A base-36 number as decimal text; other text raises."""
    t = f"trim({text})"
    return f"CASE WHEN {t} IS NULL THEN null WHEN rlike({t}, '^[0-9A-Za-z]+$') THEN conv({t}, 36, 10) ELSE raise_error(concat('no base-36 number: ', {t})) END"


def strip_sql(text: str, how: str | bool | None = None) -> str:
    """Text without white space at its ends ('l': only the right one, 'r': only the left one, True or 'none': as it is), null if empty."""
    left, right = how in (None, False, "", "r"), how in (None, False, "", "l")
    out = f"regexp_replace({text}, '^[ \\t\\r\\n]+', '')" if left else text
    return f"nullif({f"regexp_replace({out}, '[ \\t\\r\\n]+$', '')" if right else out}, '')"


def java_format(pattern: str) -> str:
    """A strptime pattern as one of Spark."""
    known = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD"}
    out = pattern.replace("T", "'T'").replace("Z", "'Z'")
    for k, v in known.items():
        out = out.replace(k, v)
    return out.removesuffix(".f") + "[.SSSSSS]" if out.endswith(".f") else out


def numeric(e: Element) -> bool:
    return "int" in e.column_type or "float" in e.column_type


def converted(e: Element, text: str) -> str:
    """SQL of the typed value of a cell's decoded text."""
    if numeric(e):
        number = number_sql(text, e.scale, e.offset)
        if e.name == "PPPP":
            number = f"if(startswith({text}, '0'), {number_sql(f"concat('1', {text})", e.scale, e.offset)}, {number})"
        return f"cast({number} AS bigint)" if "int" in e.column_type else number
    if e.column_type in ("str", "object", "key"):
        return strip_sql(text, e.strip)
    if e.column_type == "datetime":
        return f"cast(try_to_timestamp(trim({text}), {quoted(java_format(e.datetime_format))}) AS timestamp_ntz)"
    raise KeyError(f"no converter for type {e.column_type!r} of {e.name}")


def validity(e: Element, state: str, value: str, codes: tuple[str, ...] | None) -> str:
    """SQL of the mask of a cell: by type, then by its state."""
    if numeric(e):
        bounds = [f"{value} >= {e.valid_min}D"] * (e.valid_min is not None) + [f"{value} <= {e.valid_max}D"] * (e.valid_max is not None)
        inside = " AND ".join([f"{value} IS NOT NULL", *bounds])
    elif e.column_type == "key":
        if codes is None:
            return "cast(null AS boolean)"
        inside = f"coalesce({value} IN ({', '.join(map(quoted, codes))}), true)" if codes else "false"
    elif e.column_type == "datetime":
        inside = "true"
    else:
        return "true" if e.column_type == "str" else "cast(null AS boolean)"
    return f"CASE {state} WHEN {MISSING} THEN true WHEN {ABSENT} THEN false ELSE coalesce({inside}, false) END"


def read_cells(parsed: DataFrame, schema: Schema, keep: list[str], convert: bool = True, decode: bool = True, validate: bool = True, converters: dict[str, Converter] | None = None, decoders: dict[str, Converter] | None = None, tables: dict[str, list[str]] | None = None) -> DataFrame:
    """`keep`, `data` and `mask` of parsed lines. converters and decoders (Column and Element to Column) and tables of codes go
    by 'section.element' or element."""
    have = set(parsed.columns)

    def pick(d: dict | None, s: Section, e: Element):
        return (d or {}).get(f"{s.name}.{e.name}", (d or {}).get(e.name))

    decoded: dict[str, Column | str] = {}
    values: dict[str, Column | str] = {}
    for s in schema.sections:
        for e in s.elements:
            if (c := cell_name(s.name, e.name)) not in have:
                continue
            text = f"`{c}`.v"
            own = pick(decoders, s, e) if decode else None
            if own or (decode and e.encoding == "base36"):
                decoded[f"_d{c}"] = own(F.col(c)["v"], e) if own else base36_sql(text)
                text = f"`_d{c}`"
            own = pick(converters, s, e) if convert else None
            values[f"_v{c}"] = own(F.expr(text), e) if own else converted(e, text) if convert else text
    out = bind(bind(parsed, decoded), values)
    data, mask = [], []
    for s in schema.sections:
        d, m = [], []
        if s.raw:
            if (c := cell_name(s.name, "")) in have:
                data.append(f"'{s.name}', `{c}`")
                mask.append(f"'{s.name}', cast(null AS boolean)")
            continue
        for e in s.elements:
            if (c := cell_name(s.name, e.name)) in have:
                d.append(f"'{e.name}', `_v{c}`")
                given = pick(tables, s, e)
                codes = tuple(given) if given is not None else e.codes
                m.append(f"'{e.name}', {validity(e, f'`{c}`.st', f'`_v{c}`', codes) if validate else 'true'}")
        if d:
            data += d if schema.flat else [f"'{s.name}', named_struct({', '.join(d)})"]
            mask += m if schema.flat else [f"'{s.name}', named_struct({', '.join(m)})"]
    return out.selectExpr(*[f"`{k}`" for k in keep], f"named_struct({', '.join(data)}) AS data", f"named_struct({', '.join(mask)}) AS mask")


def select_years(df: DataFrame, year: str, first: int | None, last: int | None) -> DataFrame:
    """Rows whose year lies between both bounds, bounds included; rows without a year only if no bound is set."""
    y = F.col(year).try_cast("double")
    if first is not None:
        df = df.filter(y >= first)
    return df.filter(y <= last) if last is not None else df
