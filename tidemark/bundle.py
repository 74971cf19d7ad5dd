"""A bundle: rows with `_row_id`, `data` and `mask`, or a dict of output tables, and what is done with them."""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import corrections, parsing, selection
from tidemark.operators.mapping import map_model, resolve
from tidemark.operators.selection import ROW_ID
from tidemark.plans import specs
from tidemark.sources import tables as io


def logger(name: str = "tidemark", level: str = "INFO", file: str | None = None) -> logging.Logger:
    """A logger to `file`, to the file that TIDEMARK_LOG_FILE names, or to standard output; set up once a name."""
    log = logging.getLogger(name)
    log.setLevel(level.upper())
    if not log.handlers:
        to = file or os.environ.get("TIDEMARK_LOG_FILE")
        handler = logging.FileHandler(to) if to else logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
        log.addHandler(handler)
    return log


def _fields(column: str) -> list[str]:
    return [p.strip("`") for p in column.split(".")]


def with_field(df: DataFrame, column: str, value: Column) -> DataFrame:
    """`df` with a top-level column or a nested field ('data.core.YR') set."""
    root, *rest = _fields(column)
    return df.withColumn(root, F.col(root).withField(".".join(f"`{p}`" for p in rest), value) if rest else value)


@dataclass
class Bundle:
    """Every operation gives a new bundle, or, with inplace=True, changes this one and gives None. The mask travels in the row, so
    nothing has to be aligned; `masked` keeps the mask of rows that a selection with do_mask=False has left out of the data."""

    df: DataFrame | None = None
    imodel: str | None = None
    mode: str = "data"
    tables: dict[str, DataFrame] | None = None
    encoding: str = "utf-8"
    parse_dates: list[str] = field(default_factory=list)
    masked: DataFrame | None = None

    # what it holds

    @property
    def data(self) -> DataFrame | dict[str, DataFrame]:
        return self.tables if self.mode == "tables" else self.df.select(ROW_ID, "data.*")

    @data.setter
    def data(self, value: DataFrame) -> None:
        """Rows with `_row_id` and columns; a row keeps its mask, a new one has none to fail."""
        new = value.select(ROW_ID, F.struct(*[F.col(f"`{c}`") for c in value.columns if c != ROW_ID]).alias("data"))
        if self.df is not None and "mask" in self.df.columns:
            self.df = new.join(self.df.select(ROW_ID, "mask"), ROW_ID, "left")
        else:
            self.df = new.withColumn("mask", default_mask(new))

    @property
    def mask(self) -> DataFrame:
        return (self.df if self.masked is None else self.masked).select(ROW_ID, "mask.*")

    @mask.setter
    def mask(self, value: DataFrame) -> None:
        of = value.select(ROW_ID, F.struct(*[F.col(f"`{c}`") for c in value.columns if c != ROW_ID]).alias("mask"))
        self.df, self.masked = self.df.drop("mask").join(of, ROW_ID, "left"), None

    @property
    def columns(self) -> list[str]:
        return selection.leaves(self.df, "data")

    @property
    def dtypes(self) -> dict[str, str]:
        return dict(self.df.select(*[F.col(c).alias(c.replace("`", "").removeprefix("data.")) for c in self.columns]).dtypes)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    @property
    def empty(self) -> bool:
        return self.df is None or not self.df.head(1)

    def __len__(self) -> int:
        return 0 if self.df is None else self.df.count()

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name in ("df", "tables", "masked"):
            raise AttributeError(name)
        return getattr(self.df, name)

    def __getitem__(self, item: str | list[str]) -> DataFrame:
        """The rows of one column or section, or of several."""
        if isinstance(item, str) and item in self.__dict__:
            return getattr(self, item)
        names = [item] if isinstance(item, str) else list(item)
        return self.df.select(ROW_ID, *[F.col("data." + ".".join(f"`{p}`" for p in _fields(n))).alias(n) for n in names])

    def __setitem__(self, item: str, value: Column) -> None:
        self.df = with_field(self.df, "data." + item, value)

    def __repr__(self) -> str:
        return f"Bundle({self.imodel}, {self.mode}, {sorted(self.tables) if self.tables else self.df})"

    # how operations give their result

    def copy(self) -> Bundle:
        return replace(self)

    def add(self, addition: dict[str, Any], inplace: bool = False) -> Bundle | None:
        """Set parts by name ('data', 'mask', 'imodel', 'tables', ...)."""
        to = self if inplace else self.copy()
        for name, value in addition.items():
            setattr(to, name, value)
        return None if inplace else to

    def _give(self, inplace: bool, **parts: Any) -> Bundle | None:
        if not inplace:
            return replace(self, **parts)
        for name, value in parts.items():
            setattr(self, name, value)
        return None

    # select and split

    def _masks(self) -> list[str]:
        return selection.leaves(self.df, "mask")

    def _select(self, predicate: Column, inverse: bool, inplace: bool, do_mask: bool, reset_index: bool) -> Bundle | None:
        chosen = selection.split(self.df, predicate, inverse)[0]
        chosen = selection.renumber(chosen) if reset_index else chosen
        return self._give(inplace, df=chosen, masked=None if do_mask else (self.df if self.masked is None else self.masked))

    def select_where_all_true(self, inverse: bool = False, inplace: bool = False, do_mask: bool = True, reset_index: bool = False) -> Bundle | None:
        return self._select(selection.mask_predicate(self._masks(), True), inverse, inplace, do_mask, reset_index)

    def select_where_all_false(self, inverse: bool = False, inplace: bool = False, do_mask: bool = True, reset_index: bool = False) -> Bundle | None:
        return self._select(selection.mask_predicate(self._masks(), False), inverse, inplace, do_mask, reset_index)

    def select_where_entry_isin(self, chosen: dict[str, list], inverse: bool = False, inplace: bool = False, do_mask: bool = True, reset_index: bool = False) -> Bundle | None:
        """By the first entry of {column: values}; columns as 'data.section.element'."""
        column, values = next(iter(chosen.items()))
        return self._select(selection.entries(column, values), inverse, inplace, do_mask, reset_index)

    def select_where_index_isin(self, index, inverse: bool = False, inplace: bool = False, do_mask: bool = True, reset_index: bool = False) -> Bundle | None:
        chosen = selection.split_by_index(self.df, index, inverse)[0]
        chosen = selection.renumber(chosen) if reset_index else chosen
        return self._give(inplace, df=chosen, masked=None if do_mask else (self.df if self.masked is None else self.masked))

    def _both(self, halves: tuple[DataFrame, DataFrame], reset_index: bool) -> tuple[Bundle, Bundle]:
        yes, no = (replace(self, df=selection.renumber(h) if reset_index else h, masked=None) for h in halves)
        return yes, no

    def split_by_boolean(self, boolean: bool, inverse: bool = False, reset_index: bool = False) -> tuple[Bundle, Bundle]:
        return self._both(selection.split(self.df, selection.mask_predicate(self._masks(), boolean), inverse), reset_index)

    def split_by_boolean_true(self, **options) -> tuple[Bundle, Bundle]:
        return self.split_by_boolean(True, **options)

    def split_by_boolean_false(self, **options) -> tuple[Bundle, Bundle]:
        return self.split_by_boolean(False, **options)

    def split_by_column_entries(self, chosen: dict[str, list], inverse: bool = False, reset_index: bool = False) -> tuple[Bundle, Bundle]:
        column, values = next(iter(chosen.items()))
        return self._both(selection.split(self.df, selection.entries(column, values), inverse), reset_index)

    def split_by_index(self, index, inverse: bool = False, reset_index: bool = False) -> tuple[Bundle, Bundle]:
        return self._both(selection.split_by_index(self.df, index, inverse), reset_index)

    def reset_index(self, inplace: bool = False) -> Bundle | None:
        return self._give(inplace, df=selection.renumber(self.df))

    def unique(self, columns: list[str] | None = None) -> DataFrame:
        """(column, value, n) of the values of columns, of all of them if none are named."""
        return selection.count_by_cat(self.df, columns or self.columns)

    # combine and correct

    def stack_v(self, other: Bundle | Iterable[Bundle], *more: Bundle, inplace: bool = False) -> Bundle | None:
        """Rows of all bundles, renumbered from 0 in order; empty if one of them is."""
        others = [*([other] if isinstance(other, Bundle) else other), *more]
        parts = [df.withColumn("_part", F.lit(i)) for i, df in enumerate([self.df, *[o.df for o in others]])]
        stacked = selection.stack_v(parts)
        return self._give(inplace, df=selection.renumber(stacked, ("_part", ROW_ID)).drop("_part"))

    def stack_h(self, other: Bundle | Iterable[Bundle], *more: Bundle, inplace: bool = False) -> Bundle | None:
        """Sections (columns in flat models) side by side, outer by row id; clashing names of later ones get '_2'."""
        out = self.df.select(ROW_ID, "data", "mask")
        for o in [*([other] if isinstance(other, Bundle) else other), *more]:
            joined = out.join(o.df.select(ROW_ID, F.col("data").alias("_d"), F.col("mask").alias("_m")), ROW_ID, "full")
            parts = {}
            for kind, right in (("data", "_d"), ("mask", "_m")):
                left, names = out.schema[kind].dataType.fieldNames(), o.df.schema[kind if kind == "data" else "mask"].dataType.fieldNames()
                parts[kind] = F.struct(*[F.col(f"{kind}.`{c}`").alias(c) for c in left], *[F.col(f"{right}.`{c}`").alias(f"{c}_2" if c in left else c) for c in names])
            out = joined.select(ROW_ID, *[e.alias(k) for k, e in parts.items()])
        return self._give(inplace, df=out)

    def replace_columns(self, df_corr: DataFrame, pivot_l: str, pivot_r: str, rep_map: dict[str, str], subset: str | None = None, inplace: bool = False) -> Bundle | None:
        """Columns of the data ({column: column of df_corr}) overwritten by those of the row of `df_corr` with the same key, null where
        there is none; names are within section `subset` if one is given."""
        place = lambda c: f"data.{subset}.{c}" if subset else f"data.{c}"
        flat = self.df.withColumns({"_pivot": F.col(".".join(f"`{p}`" for p in _fields(place(pivot_l))))} | {f"_to{i}": F.lit(None).cast(dict(df_corr.dtypes)[r]) for i, r in enumerate(rep_map.values())})
        got = selection.replace_columns(flat, df_corr, "_pivot", pivot_r, {f"_to{i}": r for i, r in enumerate(rep_map.values())})
        for i, c in enumerate(rep_map):
            got = with_field(got, place(c), F.col(f"_to{i}"))
        return self._give(inplace, df=got.drop("_pivot", *[f"_to{i}" for i in range(len(rep_map))]))

    def _flat(self, names: dict[str, str | None]) -> tuple[DataFrame, dict[str, str]]:
        """The rows with some data columns at the top, as a correction wants them; those that there are."""
        find, have = resolve(self.df), {}
        df = self.df
        for to, name in names.items():
            if name and (c := find(name)) is not None:
                df, have[to] = df.withColumn(to, c), name
        return df, have

    def _back(self, df: DataFrame, have: dict[str, str], inplace: bool) -> Bundle | None:
        for name, place in have.items():
            df = with_field(df, f"data.{place}", F.col(name))
        return self._give(inplace, df=df.drop(*have))

    def correct_datetime(self, imodel: str | None = None, inplace: bool = False) -> Bundle | None:
        imodel = imodel or self.imodel
        df, have = self._flat(dict(zip(("_y", "_m", "_d", "_h"), corrections.COLUMNS["time"].get(imodel.split("_")[0], []))))
        return self._back(corrections.correct_datetime(df, imodel, "_y", "_m", "_d", "_h") if len(have) == 4 else df, have, inplace)

    def correct_pt(self, imodel: str | None = None, inplace: bool = False, corrections_of: dict[str, dict] | None = None) -> Bundle | None:
        imodel = imodel or self.imodel
        model = imodel.split("_")[0]
        names = {"_op": "OP", "_n": "N"} if model == "gdac" else {"_pt": corrections.COLUMNS["platform"].get(model), "_id": corrections.COLUMNS["id"].get(model), "_sid": corrections.COLUMNS["source"].get(model)}
        df, have = self._flat(names)
        if len(have) == len(names):
            df = corrections.correct_pt(df, imodel, "_pt", "_id", "_sid", "_op", "_n", corrections_of)
        return self._back(df, have, inplace)

    def validate_datetime(self, imodel: str | None = None) -> DataFrame:
        """(_row_id, valid)."""
        return self.df.select(ROW_ID, corrections.valid_model_datetime(imodel or self.imodel, resolve(self.df)).alias("valid"))

    def validate_id(self, imodel: str | None = None, blank: bool = False) -> DataFrame:
        """(_row_id, valid)."""
        imodel = imodel or self.imodel
        column = resolve(self.df)(corrections.COLUMNS["id"].get(imodel.split("_")[0], ""))
        if column is None:
            raise ValueError(f"no id column of {imodel}")
        return self.df.select(ROW_ID, corrections.valid_id(column, imodel, blank).alias("valid"))

    def apply(self, function, schema: str) -> DataFrame:
        """Any function of chunks (an iterator of pandas frames to one of such), on the flat data; partitions are the chunks."""
        return self.df.select(ROW_ID, *[F.col(c).alias(c.replace("`", "").removeprefix("data.")) for c in self.columns]).mapInPandas(function, schema)

    # map and write

    def map_model(self, imodel: str | None = None, inplace: bool = False, **options) -> Bundle | None:
        imodel = imodel or self.imodel
        return self._give(inplace, df=None, mode="tables", tables=map_model(self.df, imodel, **options), imodel=imodel, masked=None)

    def write(self, out_dir: str, mode: str | None = None, **options) -> list[str]:
        return write(self.tables if (mode or self.mode) == "tables" else self, out_dir, mode or self.mode, imodel=self.imodel, **options)


def default_mask(df: DataFrame) -> Column:
    """A mask of the shape of `data` that is true everywhere."""
    from pyspark.sql.types import StructType

    def walk(kind: StructType) -> Column:
        return F.struct(*[(walk(f.dataType) if isinstance(f.dataType, StructType) else F.lit(True)).alias(f.name) for f in kind.fields])

    return walk(df.schema["data"].dataType)


def from_frames(spark: SparkSession, frames: Iterable[pd.DataFrame] | Iterator[pd.DataFrame], imodel: str | None = None) -> Bundle:
    """A bundle of frames that come one by one, with row ids from 0 over all of them. Each frame becomes a part of its own."""
    parts, start = [], 0
    for frame in frames:
        if not isinstance(frame, pd.DataFrame):
            raise TypeError(f"a frame is needed, not {type(frame)}")
        if len(frame):
            frame = frame.reset_index(drop=True)
            frame.insert(0, ROW_ID, range(start, start + len(frame)))
            parts.append(spark.createDataFrame(frame))
            start += len(frame)
    if not parts:
        raise ValueError("no frame, or empty ones only")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rows = out.select(ROW_ID, F.struct(*[F.col(f"`{c}`") for c in out.columns if c != ROW_ID]).alias("data"))
    return Bundle(rows.withColumn("mask", default_mask(rows)), imodel)


def merged_options(*options: dict[str, Any] | None) -> dict[str, Any]:
    """Options of several sources as one; a name that stands in two of them raises."""
    out: dict[str, Any] = {}
    for given in options:
        if twice := set(out) & set(given or {}):
            raise ValueError(f"given twice: {sorted(twice)}")
        out |= given or {}
    return out


def check_arguments(source, imodel, ext_schema_file, ext_schema_path, year_init, year_end, chunksize, skiprows) -> None:
    """Raises for arguments that cannot be meant."""
    if isinstance(source, str) and not any(c in source for c in "*?[{,") and "://" not in source and not os.path.exists(source):
        raise FileNotFoundError(source)
    if not (imodel or ext_schema_file or ext_schema_path):
        raise ValueError("one of imodel, ext_schema_file and ext_schema_path is needed")
    if chunksize is not None and chunksize <= 0:
        raise ValueError("chunksize is not positive")
    if skiprows < 0:
        raise ValueError("skiprows is negative")
    if year_init is not None and year_end is not None and year_init > year_end:
        raise ValueError("year_init is after year_end")


def read_mdf(spark: SparkSession, source: str | DataFrame, imodel: str | None = None, *, ext_schema_file: str | None = None, ext_schema_path: str | None = None, ext_table_path: str | None = None, year_init: int | None = None, year_end: int | None = None, year_column: str | None = None, encoding: str | None = None, chunksize: int | None = None, skiprows: int = 0, convert_flag: bool = True, decode_flag: bool = True, validate_flag: bool = True, converter_dict: dict | None = None, converter_kwargs: dict[str, dict] | None = None, decoder_dict: dict | None = None, sections: list[str] | None = None, excludes: list[str] | None = None, tables: dict[str, list[str]] | None = None) -> Bundle:
    """Report lines of a path (or a DataFrame with `_row_id` and line) as a bundle. A DataFrame without a line has a column per
    element, named as it or 'section.element' (array files). chunksize is checked and has no effect, partitions are the chunks;
    converter_kwargs: {element: options that its converter gets}; ext_table_path: a folder of JSON tables of allowed keys."""
    check_arguments(source, imodel, ext_schema_file, ext_schema_path, year_init, year_end, chunksize, skiprows)
    schema = specs.schema(imodel, ext_schema_file, ext_schema_path)
    if ext_table_path:
        tables = specs.validation_tables(schema, ext_table_path, imodel) | (tables or {})
    if converter_kwargs:
        own = {k: (lambda c, e, f=(converter_dict or {})[k], o=o: f(c, e, **o)) for k, o in converter_kwargs.items() if k in (converter_dict or {})}
        if unknown := set(converter_kwargs) - set(own):
            raise KeyError(f"options of converters that aren't given: {sorted(unknown)}")
        converter_dict = (converter_dict or {}) | own
    encoding = encoding or schema.encoding
    lines = source if isinstance(source, DataFrame) else io.read_lines(spark, source, encoding, skiprows)
    parsed = parsing.parse_lines(lines, schema, "line", sections, excludes) if "line" in lines.columns else parsing.parse_columns(lines, schema, sections, excludes)
    if year_init is not None or year_end is not None:
        place = year_column or {"icoads": "core.YR", "gdac": "AAAA", "csv": "YR"}[(imodel or "csv").split("_")[0]]
        section, _, element = place.rpartition(".")
        cell = parsing.cell_name(section or schema.sections[0].name, element)
        parsed = parsing.select_years(parsed.withColumn("_year", F.col(f"`{cell}`.v")), "_year", year_init, year_end).drop("_year")
    df = parsing.read_cells(parsed, schema, [ROW_ID], convert_flag, decode_flag, validate_flag, converter_dict, decoder_dict, tables)
    dates = [f"{s.name}.{e.name}" for s in schema.sections for e in s.elements if e.column_type == "datetime"]
    return Bundle(df, imodel, encoding=encoding, parse_dates=dates)


def read(spark: SparkSession, source, mode: str = "mdf", **options):
    """Dispatch: 'mdf' report lines, 'data' intermediate data, 'tables' output tables."""
    kinds = {"mdf": read_mdf, "data": io.read_data, "tables": io.read_tables}
    if mode not in kinds:
        raise ValueError(f"mode {mode!r} is none of {list(kinds)}")
    return kinds[mode](spark, source, **options)


def write(data: Bundle | dict[str, DataFrame] | DataFrame, out_dir: str, mode: str = "data", imodel: str | None = None, **options) -> list[str]:
    """Dispatch: 'data' a bundle or rows as intermediate data, 'tables' a dict of output tables."""
    if mode == "tables":
        return io.write_tables(data.tables if isinstance(data, Bundle) else data, out_dir, imodel=imodel, **options)
    if mode != "data":
        raise ValueError(f"mode {mode!r} is none of ['data', 'tables']")
    if isinstance(data, Bundle):
        return io.write_data(data.data, data.mask, out_dir, **merged_options(options, {} if "encoding" in options else {"encoding": data.encoding}))
    return io.write_data(data, None, out_dir, **options)
