"""Source columns -> header and observation tables by mapping rules, one projection per table.

Precedence in a rule: without elements, or with one that the source lacks, the default; else the transform; else the code table;
else a copy. Then the fill value, then the cast to the column's type. Tables are a dict of DataFrames; the source is read
once per table, and only the removal of repeated rows shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.transforms import REGISTRY
from tidemark.plans import specs

TYPES = {"int": "bigint", "numeric": "double", "varchar": "string", "timestamp": "timestamp_ntz", "timestamp with timezone": "timestamp_ntz", "int[]": "array<bigint>", "numeric[]": "array<double>", "varchar[]": "array<string>"}
METHODS = {"gdac": "method_b"}  # of temperatures in kelvin: with a sign column

def resolve(df: DataFrame) -> Callable[[str], Column | None]:
    """Finds 'section.element': as a nested field of `data` or of the row, a column of that name, or 'section:element'."""
    schema = {f.name: f.dataType for f in df.schema.fields}

    def nested(kind, names: list[str]) -> bool:
        return not names or (hasattr(kind, "fieldNames") and names[0] in kind.fieldNames() and nested(kind[names[0]].dataType, names[1:]))

    def find(name: str) -> Column | None:
        parts = name.split(".")
        if "data" in schema and nested(schema["data"], parts):
            return F.col("data." + ".".join(f"`{p}`" for p in parts))
        for flat in (name, name.replace(".", ":")):
            if flat in schema:
                return F.col(f"`{flat}`")
        if parts[0] in schema and nested(schema[parts[0]], parts[1:]):
            return F.col(".".join(f"`{p}`" for p in parts))
        return None

    return find


def code_key(c: Column) -> Column:
    """A cell as the key of a code table: whole numbers as such, other numbers as they print."""
    return c.cast("string")


def lookup(table: dict, keys: list[Column]) -> Column:
    """Value of nested tables for one key per level; null where a key is not there or the walk ends on a table."""
    flat: dict[str, object] = {}

    def walk(t: dict, path: tuple[str, ...]) -> None:
        for k, v in t.items():
            if isinstance(v, dict):
                walk(v, (*path, k))
            elif v is not None and len(path) + 1 == len(keys):
                flat["\u0001".join((*path, k))] = v

    walk(table, ())
    if not flat:
        return F.lit(None)
    parts = [code_key(k) for k in keys]
    key = F.when(F.greatest(*[p.isNull() for p in parts], F.lit(False)), None).otherwise(F.concat_ws("\u0001", *parts))
    real = any(isinstance(v, float) for v in flat.values())
    values = {k: float(v) if real else v for k, v in flat.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def literal(value) -> Column:
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def column(rule: dict, kind: str, find: Callable[[str], Column | None], imodel: str, codes_subset: list[str] | None, extra_codes: dict[str, dict] | None, **context) -> Column:
    """The expression of one target column."""
    given = rule.get("default")
    default = literal([given] if kind.endswith("[]") and given is not None and not isinstance(given, list) else given)
    names = rule.get("elements", [])
    inputs = [find(n) for n in names]
    code, step = rule.get("code_table"), rule.get("transform")
    if code and codes_subset is not None and code not in codes_subset:
        code = None
    if step and step not in REGISTRY:
        raise KeyError(f"unknown transform {step!r}")
    keywords = rule.get("kwargs", {}) | {"imodel": imodel, "method": METHODS.get(imodel.split("_")[0], "method_a")} | context
    if names and any(i is None for i in inputs):
        out = default
    elif not names and ("default" in rule or not step):
        out = default
    elif step:
        out = REGISTRY[step](*inputs, **keywords)
    elif code:
        out = lookup(specs.code_table(code, imodel, extra_codes), inputs)
    else:
        out = inputs[0]
    out = out.try_cast(TYPES[kind]) if not kind.endswith("[]") else out.cast(TYPES[kind])
    return F.coalesce(out, literal(rule["fill_value"]).cast(TYPES[kind])) if "fill_value" in rule else out


def map_model(df: DataFrame, imodel: str, cdm_subset: str | list[str] | None = None, codes_subset: list[str] | None = None, cdm_complete: bool = True, drop_missing_obs: bool = True, drop_duplicates: bool = True, rules: dict[str, dict] | None = None, codes: dict[str, dict] | None = None, keep: list[str] | None = None, **context) -> dict[str, DataFrame]:
    """{table: DataFrame}. rules: {table: {column: rule}} laid over those of the model; codes: further code tables; keep:
    source columns that come first; context: keywords for all transforms (now=...)."""
    tables = [cdm_subset] if isinstance(cdm_subset, str) else cdm_subset
    known = specs.mapping(imodel, tables)
    find, out = resolve(df), {}
    for table, of in known.items():
        of = specs.merge(of, (rules or {}).get(table, {}))
        chosen = {c: k for c, k in specs.columns(table).items() if cdm_complete or c in df.columns}
        cols = [column(of.get(c, {}), k, find, imodel, codes_subset, codes, **context).alias(c) for c, k in chosen.items()]
        rows = df.select(*(keep or []), *cols)
        if drop_missing_obs and table != "header" and "observation_value" in chosen:
            rows = rows.filter(F.col("observation_value").isNotNull())
        out[table] = rows.dropDuplicates() if drop_duplicates else rows
    return out
