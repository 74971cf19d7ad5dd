"""Readers and writers: report lines, intermediate data (data, mask, info) and output tables as csv, parquet or feather."""

from __future__ import annotations

import codecs
import json
import logging
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text_conversion import NULL, convert_table
from tidemark.operators.selection import ROW_ID, outer_tables
from tidemark.plans import specs
from tidemark.plans.specs import TABLES

LOG = logging.getLogger("tidemark")
EXTENSIONS = {"csv": "csv", "parquet": "pq", "feather": "feather"}


def file_name(*parts: str | None, extension: str, separator: str = "_") -> str:
    """Parts that are not empty joined, with an extension."""
    return separator.join(p for p in parts if p) + "." + extension.lstrip(".")


def adjusted_name(name: str, table: str, extension: str = "psv") -> str:
    """A given file name with the table before it and an extension behind, where it lacks them."""
    name = name if table in name else f"{table}-{name}"
    return name if "." in name else f"{name}.{extension}"


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8", skiprows: int = 0) -> DataFrame:
    """Lines of text files: `_row_id`, file, line, blank ones too. All go through the splittable text source; ids are positions in the
    partitioned scan. Encodings in which a byte below 128 is the ASCII character are decoded line by line from its bytes, in Arrow batches;
    others (UTF-16, UTF-32) need whole files, a row each. The first `skiprows` lines of each file are those of the least positions in
    it; only they are looked for, by a limit per file."""
    name = F.col("_metadata.file_name").alias("file")
    codec = codecs.lookup(encoding).name
    if codec.startswith(("utf-16", "utf-32", "utf_16", "utf_32")):
        return _read_whole(spark, path, encoding, skiprows)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias(ROW_ID), name, F.col("value").alias("line"))
    if codec not in ("utf-8", "ascii"):

        @F.pandas_udf("string")
        def decode(raw: pd.Series) -> pd.Series:
            return raw.map(lambda b: bytes(b).decode(codec, "replace"))

        # the bytes as they are in the file: the source copies them without decoding
        lines = lines.withColumn("line", decode(F.col("line").cast("binary")))
    if skiprows:
        first = F.row_number().over(Window.partitionBy("file").orderBy(ROW_ID))
        heads = lines.select("file", ROW_ID).withColumn("_n", first).filter(F.col("_n") <= skiprows)
        lines = lines.join(heads.select(ROW_ID), ROW_ID, "left_anti").select(ROW_ID, "file", "line")
    return lines


def _read_whole(spark: SparkSession, path: str, encoding: str, skiprows: int) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("array<string>")
    def split(content: pd.Series) -> pd.Series:
        return content.map(lambda b: re.split("\r?\n", re.sub("\r?\n$", "", b.decode(encoding, "replace"))))

    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(split("content")).alias("pos", "line"))
    return rows.filter(F.col("pos") >= skiprows).select(F.monotonically_increasing_id().alias(ROW_ID), "file", "line")


def _write(df: DataFrame, path: Path, data_format: str, delimiter: str, encoding: str | None = None) -> None:
    if data_format == "parquet":
        df.write.mode("overwrite").parquet(str(path))
    elif data_format == "csv":
        writer = df.write.mode("overwrite").option("header", True).option("sep", delimiter)
        (writer.option("encoding", encoding) if encoding else writer).csv(str(path))
    elif data_format == "feather":
        # one Arrow file on the driver: for small extracts only
        import pyarrow.feather

        pyarrow.feather.write_feather(df.toArrow(), str(path))
    else:
        raise ValueError(f"unknown format {data_format!r}; known: {list(EXTENSIONS)}")


def _read(spark: SparkSession, path: Path | str, data_format: str, delimiter: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    if data_format == "parquet":
        df = spark.read.parquet(str(path))
    elif data_format == "csv":
        reader = spark.read.option("header", True).option("sep", delimiter)
        df = (reader.schema(schema) if schema else reader).csv(str(path))
    elif data_format == "feather":
        import pyarrow.feather

        df = spark.createDataFrame(pyarrow.feather.read_table(str(path)))
    else:
        raise ValueError(f"unknown format {data_format!r}; known: {list(EXTENSIONS)}")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def write_data(data: DataFrame, mask: DataFrame | None, out_dir: str, data_format: str = "parquet", prefix: str | None = None, suffix: str | None = None, extension: str | None = None, separator: str = "_", col_subset: list[str] | None = None, delimiter: str = ",", encoding: str = "utf-8") -> list[str]:
    """`[prefix_]data[_suffix].ext`, the mask likewise, and for csv an info file with columns and types."""
    ext, out = extension or EXTENSIONS[data_format], []
    for name, df in (("data", data), ("mask", mask)):
        if df is None:
            continue
        df = df.select(*[f"`{c}`" for c in col_subset]) if col_subset else df
        path = Path(out_dir) / file_name(prefix, name, suffix, extension=ext, separator=separator)
        _write(df, path, data_format, delimiter, encoding)
        out.append(str(path))
        if data_format == "csv" and name == "data":
            info = Path(out_dir) / file_name(prefix, "info", suffix, extension="json", separator=separator)
            info.write_text(json.dumps({"columns": df.columns, "dtypes": dict(df.dtypes), "parse_dates": [c for c, k in df.dtypes if k.startswith("timestamp")], "encoding": encoding}))
            out.append(str(info))
    return out


def read_data(spark: SparkSession, data_file: str, mask_file: str | None = None, info_file: str | None = None, data_format: str = "parquet", col_subset: list[str] | None = None, delimiter: str = ",") -> tuple[DataFrame, DataFrame | None]:
    """(data, mask) written by `write_data`; types from the info file, if there is one."""
    info = json.loads(Path(info_file).read_text()) if info_file else None
    schema = ", ".join(f"`{c}` {info['dtypes'][c]}" for c in info["columns"]) if info and data_format == "csv" else None
    masks = ", ".join(f"`{c}` boolean" for c in info["columns"]) if info and data_format == "csv" else None
    data = _read(spark, data_file, data_format, delimiter, schema, col_subset)
    return data, _read(spark, mask_file, data_format, delimiter, masks, col_subset) if mask_file else None


def _subset(chosen, table: str) -> list[str] | None:
    """Columns of one table: of a dict by table, or of a list for all tables."""
    if isinstance(chosen, dict):
        chosen = chosen.get(table)
    return [chosen] if isinstance(chosen, str) else chosen


def write_tables(tables: dict[str, DataFrame], out_dir: str, data_format: str = "parquet", prefix: str | None = None, suffix: str | None = None, extension: str | None = None, filename: str | dict[str, str] | None = None, separator: str = "-", cdm_subset: str | list[str] | None = None, col_subset: dict[str, list[str]] | list[str] | None = None, delimiter: str = "|", encoding: str | None = None, to_text: bool | None = None, null_label: str = NULL, imodel: str | None = None) -> list[str]:
    """One file per table, rows without any value left out; as text in csv, with the decimal places of the mapping of `imodel`. filename:
    a name for all tables (the table goes before it) or {table: name}."""
    out = []
    chosen = [cdm_subset] if isinstance(cdm_subset, str) else cdm_subset
    for name, df in tables.items():
        if chosen and name not in chosen:
            continue
        df = df.select(*(_subset(col_subset, name) or df.columns)).dropna("all")
        if to_text if to_text is not None else data_format == "csv":
            df = convert_table(df, name, "str", null_label, decimal_places(imodel, name))
        ext = extension or {"csv": "psv"}.get(data_format, EXTENSIONS[data_format])
        given = filename.get(name) if isinstance(filename, dict) else filename
        path = Path(out_dir) / (adjusted_name(given, name, ext) if given else file_name(prefix, name, suffix, extension=ext, separator=separator))
        _write(df, path, data_format, delimiter, encoding)
        out.append(str(path))
    return out


def decimal_places(imodel: str | None, table: str) -> dict[str, int]:
    """{column: decimal places} by the mapping of a model."""
    if imodel is None:
        return {}
    return {c: r["decimal_places"] for c, r in specs.mapping(imodel, [table])[table].items() if "decimal_places" in r}


def read_tables(spark: SparkSession, source: str, data_format: str = "parquet", prefix: str | None = None, suffix: str | None = None, extension: str | None = None, separator: str = "-", cdm_subset: str | list[str] | None = None, col_subset: dict[str, list[str]] | list[str] | None = None, delimiter: str = "|", null_label: str = NULL, typed: bool = True) -> dict[str, DataFrame]:
    """{table: DataFrame} of a folder, or of one file of one table. A table's file is named prefix-table-suffix, with anything before the suffix
    or in its place; a table with none or several of them is left out, with a warning, as is one that no model knows. Rows whose
    report_id is the null label are dropped."""
    ext = (extension or {"csv": "psv"}.get(data_format, EXTENSIONS[data_format])).lstrip(".")
    chosen = [cdm_subset] if isinstance(cdm_subset, str) else cdm_subset
    folder = Path(source)
    if chosen and len(chosen) == 1 and not any(folder.glob(f"*.{ext}")) and folder.exists():
        return {chosen[0]: _read_table(spark, folder, chosen[0], data_format, col_subset, delimiter, null_label, typed)}
    tail = "*" if suffix in (None, "*") else f"*{suffix}"
    if not any(folder.glob(file_name(prefix, tail, extension=ext, separator=separator))):
        raise FileNotFoundError(f"no file {file_name(prefix, tail, extension=ext, separator=separator)} in {source}")
    out = {}
    for table in chosen or TABLES:
        if table not in TABLES:
            LOG.warning("no table %s is known", table)
            continue
        parts = (prefix, table, tail) if suffix else (prefix, table)
        found = sorted(folder.glob(file_name(*parts, extension=ext, separator=separator)))
        if len(found) != 1:
            LOG.warning("table %s has %s files: %s", table, len(found), found)
            continue
        out[table] = _read_table(spark, found[0], table, data_format, col_subset, delimiter, null_label, typed)
    return out


def _read_table(spark: SparkSession, path: Path, table: str, data_format: str, col_subset, delimiter: str, null_label: str, typed: bool) -> DataFrame:
    df = _read(spark, path, data_format, delimiter, columns=_subset(col_subset, table))
    df = df.filter(F.col("report_id") != null_label) if "report_id" in df.columns else df
    return convert_table(df, table, "typed", null_label) if typed and data_format == "csv" else df


def merged(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables side by side by report_id."""
    return outer_tables(tables)
