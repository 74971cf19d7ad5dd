"""Declarative specs: layered JSON, and the compact text specs of this package (schemas, code tables, mapping rules).

An input model is named `model[_release[_deck]]`. Layers are merged from general to specific, key by key; a value 'ignore'
deletes the key, {'substitute': {...}} redirects to another model, lists are replaced.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import lru_cache
from pathlib import Path

FOLDER = Path(__file__).resolve().parent.parent / "specs"
OBSERVATIONS = ["at", "sst", "dpt", "wbt", "wd", "ws", "slp"]
TABLES = ["header", *[f"observations-{x}" for x in OBSERVATIONS]]
# Models whose lines are not in UTF-8.
ENCODINGS = {"icoads/r300/d721": "cp1252"}
MODELS = ["craid", "gdac", "icoads", "pub47", "marob", "cmems", "csv"]


def layers(imodel: str) -> list[str]:
    """'icoads_r300_d702' -> ['icoads', 'icoads/r300', 'icoads/r300/d702']."""
    parts = imodel.split("_")
    if parts[0] not in MODELS:
        raise ValueError(f"unknown model {parts[0]!r}; known: {MODELS}")
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]


def merge(*specs: dict) -> dict:
    """Deep merge, the later spec winning; 'ignore' deletes."""
    out: dict = {}
    for spec in specs:
        for k, v in spec.items():
            if v == "ignore":
                out.pop(k, None)
            elif isinstance(v, dict):
                out[k] = merge(out[k] if isinstance(out.get(k), dict) else {}, v)
            else:
                out[k] = v
    return out


def load_layered(folder: str | Path, imodel: str) -> dict:
    """Merge `<folder>/<layer>/<imodel up to it>.json` over all layers of `imodel`; missing layers are skipped."""
    found = []
    for layer in layers(imodel):
        path = Path(folder) / layer / (layer.replace("/", "_") + ".json")
        if path.exists():
            spec = json.loads(path.read_text())
            if "substitute" in spec:
                to = spec["substitute"]
                # the other model's spec, whole, in the place of what the layers gave so far
                found = [load_layered(folder, "_".join(x for x in (to.get("data_model"), to.get("release"), to.get("deck")) if x))]
            else:
                found.append(spec)
    return merge(*found)


@dataclass(frozen=True)
class Element:
    name: str
    width: int | None
    column_type: str
    scale: float | None = None
    offset: float | None = None
    valid_min: float | None = None
    valid_max: float | None = None
    codes: tuple[str, ...] | None = None
    missing: str | None = None
    codetable: str | None = None  # name of an external table of allowed keys
    encoding: str | None = None
    strip: str | bool | None = None
    ignore: bool = False
    datetime_format: str = "%Y%m%d"


@dataclass(frozen=True)
class Section:
    name: str
    elements: tuple[Element, ...] = ()
    sentinel: str | None = None
    length: int | None = None
    delimiter: str | None = None
    format: str | None = None
    raw: bool = False  # emitted as one text column


@dataclass(frozen=True)
class Schema:
    sections: tuple[Section, ...]
    encoding: str = "utf-8"
    flat: bool = field(default=False)  # one nameless section: elements are top-level columns


def _range_keys(text: str) -> tuple[str, ...]:
    out: list[str] = []
    for part in text.split(","):
        if m := re.fullmatch(r"(\d+)-(\d+)", part):
            out += [str(i) for i in range(int(m[1]), int(m[2]) + 1)]
        else:
            out.append(part)
    return tuple(out)


def _element(text: str) -> Element:
    name, width, kind, *options = text.split()
    known = dict(o.split("=", 1) if "=" in o else (o, "yes") for o in options)
    number = {k: float(known[v]) for k, v in (("scale", "scale"), ("offset", "offset"), ("valid_min", "min"), ("valid_max", "max")) if v in known}
    return Element(name, int(width) or None, kind, codes=_range_keys(known["codes"]) if "codes" in known else None, missing=known.get("missing"), encoding=known.get("encoding"), strip=known.get("strip"), ignore="ignore" in known, datetime_format=known.get("datetime", "%Y%m%d"), **number)


@lru_cache
def _schema_layers() -> dict[str, dict[str, Section | None]]:
    out: dict[str, dict[str, Section | None]] = {}
    layer = section = None
    for line in (FOLDER / "schemas.txt").read_text().splitlines():
        if not line or line.startswith("#"):
            continue
        if line.startswith("model "):
            name, _, same = line[6:].partition(" same=")
            layer, section = out.setdefault(name, dict(out[same]) if same else {}), None
        elif line.startswith("section "):
            name, _, rest = line[8:].partition(" ")
            options = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("[^"]*"|\S+)', rest)}
            section = name
            layer[name] = None if "drop" in options else Section(name, (), options.get("sentinel"), int(options["length"]) if "length" in options else None, options.get("delimiter"), options.get("format"), "raw" in options)
        else:
            section = section or "_"
            old = layer.get(section) or Section(section)
            layer[section] = replace(old, elements=(*old.elements, *map(_element, filter(None, map(str.strip, line.split(";"))))))
    return out


def schema_from_json(spec: dict) -> Schema:
    """A schema of a JSON spec: {header, sections: {name: {header, elements}}}, or {header, elements} for one nameless section."""
    def element(name: str, e: dict) -> Element:
        flag = str(e.get("ignore", "")).lower() in ("true", "1", "yes")
        codes = tuple(e["codes"]) if "codes" in e else None
        return Element(name, e.get("field_length"), e.get("column_type", "str"), e.get("scale"), e.get("offset"), e.get("valid_min"), e.get("valid_max"), codes, e.get("missing_value"), e.get("codetable"), e.get("encoding"), e.get("disable_white_strip"), flag, e.get("datetime_format", "%Y%m%d"))

    head = spec.get("header", {})
    if "sections" not in spec:
        s = Section("_", tuple(element(n, e) for n, e in spec["elements"].items()), None, head.get("length"), head.get("delimiter"), head.get("format"))
        return Schema((s,), head.get("encoding", "utf-8"), True)
    order = [n for group in head.get("parsing_order", [{"s": list(spec["sections"])}]) for names in group.values() for n in names]
    out = []
    for name in order:
        h = spec["sections"][name].get("header", {})
        elements = tuple(element(n, e) for n, e in spec["sections"][name].get("elements", {}).items())
        out.append(Section(name, elements, h.get("sentinel"), h.get("length"), h.get("delimiter"), h.get("format"), bool(h.get("disable_read"))))
    return Schema(tuple(out), head.get("encoding", "utf-8"), len(out) == 1)


def validation_tables(s: Schema, ext_table_path: str | Path, imodel: str | None = None) -> dict[str, list[str]]:
    """{section.element: allowed keys} of the elements that name a table, from JSON tables of a folder: `<table>.json`, or with
    a model layer by layer (`<layer>/<table>.json`); nested tables give the keys of their first level. A table that is not there raises."""
    out = {}
    for part in s.sections:
        for e in part.elements:
            if e.codetable is None:
                continue
            places = [Path(ext_table_path) / f"{e.codetable}.json", *[Path(ext_table_path) / layer / f"{e.codetable}.json" for layer in (layers(imodel) if imodel else [])]]
            found = [expand_ranges(json.loads(p.read_text())) for p in places if p.is_file()]
            if not found:
                raise FileNotFoundError(f"no table {e.codetable} in {ext_table_path}")
            out[f"{part.name}.{e.name}"] = list(merge(*found))
    return out


def schema(imodel: str | None = None, ext_schema_file: str | None = None, ext_schema_path: str | None = None) -> Schema:
    """The schema of a JSON file, of a folder with a JSON file of its own name, or of a model of this package, in that order."""
    if ext_schema_file:
        return schema_from_json(json.loads(Path(ext_schema_file).read_text()))
    if ext_schema_path:
        return schema_from_json(json.loads((Path(ext_schema_path) / f"{Path(ext_schema_path).name}.json").read_text()))
    if imodel is None:
        raise ValueError("one of imodel, ext_schema_file and ext_schema_path is needed")
    sections: dict[str, Section | None] = {}
    for layer in layers(imodel):
        for name, s in _schema_layers().get(layer, {}).items():
            sections.pop(name, None) if s is None else sections.__setitem__(name, s)
    if not sections:
        raise FileNotFoundError(f"no schema for {imodel}")
    return Schema(tuple(s for s in sections.values() if s), ENCODINGS.get("/".join(imodel.split("_")), "utf-8"), len(sections) == 1)


def expand_ranges(table: dict, year: int | None = None) -> dict:
    """'[lo,hi(,step)]' keys become one key per integer, 'yyyy' as the upper end is this year; malformed lists are dropped."""
    year = year or datetime.now(timezone.utc).year
    out: dict = {}
    for key, value in table.items():
        value = expand_ranges(value, year) if isinstance(value, dict) else value
        if not key.startswith("["):
            out[key] = value
            continue
        try:
            bounds = ast.literal_eval(re.sub(r"""["']?yyyy["']?""", str(year), key))
            steps = range(bounds[0], bounds[1] + 1, *bounds[2:3])
        except (ValueError, SyntaxError, TypeError, IndexError):
            continue
        out |= {str(k): value for k in steps}
    return out


def _value(text: str):
    if text == "null":
        return None
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def _pairs(text: str) -> dict:
    out: dict = {}
    for key, nested, plain in re.findall(r"(\[[^\]]*\]|[^\s={}]+)=(?:\{([^}]*)\}|(\S+))", text):
        out[key.replace("~", " ")] = _pairs(nested) if nested else _value(plain.replace("~", " "))
    return out


@lru_cache
def _code_tables() -> dict[str, dict]:
    lines = (FOLDER / "codes.txt").read_text().splitlines()
    return {name: _pairs(rest) for name, rest in (x.split(": ", 1) for x in lines if x and not x.startswith("#"))}


def code_table(name: str, imodel: str, extra: dict[str, dict] | None = None) -> dict:
    """The code table of the most specific layer that has one, ranges expanded; {} if none has."""
    if extra and name in extra:
        return expand_ranges(extra[name])
    for layer in [*reversed(layers(imodel)), "common"]:
        if (t := _code_tables().get(f"{layer}/{name}")) is not None:
            return expand_ranges(t)
    return {}


@lru_cache
def columns(table: str) -> dict[str, str]:
    """Names and types of the columns of an output table, in order."""
    kind = "header" if table == "header" else "observations"
    line = next(x for x in (FOLDER / "columns.txt").read_text().splitlines() if x.startswith(kind + ": "))
    return dict(c.rsplit(" ", 1) for c in line.split(": ", 1)[1].split(", "))


def _keywords(text: str) -> dict:
    return {k.arg: ast.literal_eval(k.value) for k in ast.parse(f"f({text})", mode="eval").body.keywords}


def rule(text: str) -> dict | str:
    """One mapping rule from its compact form."""
    if text == "ignore":
        return "ignore"
    if m := re.fullmatch(r"kw\{(.*)\}", text):
        return {"kwargs": _keywords(m[1])}
    out: dict = {}
    if m := re.search(r"/(\d+|default_decimal_places)$", text):
        out["decimal_places"] = 5 if m[1].startswith("d") else int(m[1])
        text = text[: m.start()]
    if text.startswith("="):
        return out | {"default": ast.literal_eval(text[1:])}
    if m := re.search(r"\?([^?]+)$", text):
        out["fill_value"] = ast.literal_eval(m[1])
        text = text[: m.start()]
    inputs, _, step = text.partition("->")
    if inputs:
        out["elements"] = inputs.split("+")
    if m := re.fullmatch(r"\[(\w+)\]", step):
        out["code_table"] = m[1]
    elif m := re.fullmatch(r"(\w+)\((.*)\)", step, re.DOTALL):
        out["transform"] = m[1]
        out["kwargs"] = _keywords(m[2])
    return out


@lru_cache
def _rule_layers() -> dict[str, dict]:
    out = {}
    for line in (FOLDER / "mappings.txt").read_text().splitlines():
        if line and not line.startswith("#"):
            name, rules = line.split(" :: ", 1)
            out[name] = {c: rule(r.strip()) for c, _, r in (part.strip().partition(": ") for part in rules.split(" ; "))}
    return out


def mapping(imodel: str, tables: list[str] | None = None) -> dict[str, dict[str, dict]]:
    """{table: {column: rule}} of a model; the rules common to observations lie under those of each of their tables."""
    chosen = tables or TABLES
    if unknown := set(chosen) - set(TABLES):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    out = {}
    for table in chosen:
        kinds = ["header"] if table == "header" else ["observations", table]
        specs = [_rule_layers().get(f"{layer}/{kind}", {}) for layer in layers(imodel) for kind in kinds]
        merged: dict = {}
        for spec in specs:
            for column, r in spec.items():
                if r == "ignore":
                    merged.pop(column, None)
                else:
                    old = merged.get(column, {})
                    # another source of the value replaces the inherited one, keywords alone are added to it
                    if "default" in r:
                        old = {}
                    merged[column] = merge(old, r)
        out[table] = merged
    return out
