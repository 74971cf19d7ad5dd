"""Array files in the classic formats (CDF-1, -2 and -5) as rows: one row per point of the product of their dimensions.

The format is read from its public description: a header of dimensions, attributes and variables, then big-endian data. Files are read whole
in Arrow batches, one at a time (2 GB are the limit of the binary source). Variables that lack a dimension are repeated
along it, dimensions of length one vanish, characters along the last dimension are texts, global attributes are constant columns (line breaks
as '; '). Scale, offset and fill values are applied; times 'since' a date are texts of the form YYYY-MM-DDTHH:MM:SS. Files in the
hierarchical format (HDF5) raise, as no library for it is at hand.
"""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta
from math import isnan, prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.bundle import Bundle, read_mdf
from tidemark.operators import selection
from tidemark.operators.selection import ROW_ID
from tidemark.plans import specs

# Types of the format by their numbers, tags of its lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
SINCE = re.compile(r"(second|minute|hour|day)s? since (\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?")


class Reader:
    """The header of a file, and its variables on demand."""

    def __init__(self, content: bytes):
        if content[:3] != b"CDF" or content[3] not in (1, 2, 5):
            raise ValueError("no file of the classic array formats")
        self.content, self.version, self.at = content, content[3], 4
        self.records = self._size()
        self.dims = [(self._name(), self._size()) for _ in self._list(DIMENSIONS)]
        self.attributes = self._attributes()
        self.variables: dict[str, tuple[list[int], dict, int, int, int]] = {}
        for _ in self._list(VARIABLES):
            name = self._name()
            dims = [self._size() for _ in range(self._size())]
            self.variables[name] = (dims, self._attributes(), self._int(), self._size(), self._offset())
        self.record_dim = next((i for i, (_, n) in enumerate(self.dims) if n == 0), None)

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.content, self.at - 4)[0]

    def _long(self) -> int:
        self.at += 8
        return struct.unpack_from(">q", self.content, self.at - 8)[0]

    def _size(self) -> int:
        return self._long() if self.version == 5 else self._int()

    def _offset(self) -> int:
        return self._int() if self.version == 1 else self._long()

    def _list(self, tag: int) -> range:
        found, n = self._int(), self._size()
        if n and found != tag:
            raise ValueError("damaged header")
        return range(n)

    def _bytes(self, n: int) -> bytes:
        out = self.content[self.at : self.at + n]
        self.at += (n + 3) // 4 * 4
        return out

    def _name(self) -> str:
        return self._bytes(self._size()).decode("utf-8")

    def _attributes(self) -> dict:
        out = {}
        for _ in self._list(ATTRIBUTES):
            name, kind = self._name(), np.dtype(TYPES[self._int()])
            n = self._size()
            raw = self._bytes(n * kind.itemsize)
            out[name] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind.char == "S" else np.frombuffer(raw, kind)[:n].tolist()
        return out

    def shape(self, name: str) -> list[int]:
        return [self.records if d == self.record_dim else self.dims[d][1] for d in self.variables[name][0]]

    def values(self, name: str) -> np.ndarray:
        dims, _, kind, _, begin = self.variables[name]
        kind, shape = np.dtype(TYPES[kind]), self.shape(name)
        if not dims or dims[0] != self.record_dim:
            return np.frombuffer(self.content, kind, prod(shape), begin).reshape(shape)
        # records of all such variables are interleaved, each padded to four bytes, but for a single variable
        sizes = {v: prod(self.shape(v)[1:]) * np.dtype(TYPES[k]).itemsize for v, (d, _, k, _, _) in self.variables.items() if d and d[0] == self.record_dim}
        step = sizes[name] if len(sizes) == 1 else sum((x + 3) // 4 * 4 for x in sizes.values())
        rows = [np.frombuffer(self.content, kind, prod(shape[1:]), begin + i * step) for i in range(shape[0])]
        return np.stack(rows).reshape(shape) if rows else np.empty(shape, kind)


def _texts(values: np.ndarray, attributes: dict) -> np.ndarray:
    """Numbers as they print, in their units; texts without blanks around them; what is missing as ''."""
    if values.dtype.char == "S":
        joined = values.reshape(*values.shape[:-1], -1)
        flat = [b"".join(row.tolist()).rstrip(b"\0").decode("utf-8", "replace").strip() for row in joined.reshape(-1, joined.shape[-1])]
        return np.array(flat, dtype=object).reshape(values.shape[:-1])
    fills = [x for k in ("_FillValue", "missing_value") for x in attributes.get(k, [])]
    scale, offset = (attributes.get(k, [d])[0] for k, d in (("scale_factor", 1), ("add_offset", 0)))
    since = SINCE.match(str(attributes.get("units", "")))
    start = datetime(*[int(x or 0) for x in since.groups()[1:]]) if since else None

    def text(x) -> str:
        if x in fills or (isinstance(x, float) and isnan(x)):
            return ""
        x = x if scale == 1 and offset == 0 else x * scale + offset
        if start is not None:
            return (start + timedelta(**{f"{since[1]}s": x}) + timedelta(microseconds=500_000)).strftime("%Y-%m-%dT%H:%M:%S")
        return repr(float(np.float32(x)) if values.dtype == ">f4" and scale == 1 and offset == 0 else x) if not values.dtype == ">f4" else f"{np.float32(x):.7g}"

    return np.array([text(x) for x in values.reshape(-1).tolist()], dtype=object).reshape(values.shape)


def rows_of(content: bytes, names: list[str]) -> pd.DataFrame:
    """The named variables and global attributes of a file as texts; names that it lacks have no column."""
    file = Reader(content)
    chosen = {n: v for n, v in file.variables.items() if n in names}
    used: list[int] = []
    for n, (dims, _, kind, _, _) in chosen.items():
        used += [d for d, size in zip(dims[:-1] if kind == 2 else dims, file.shape(n)) if size != 1 and d not in used]
    used.sort()
    sizes = [file.records if d == file.record_dim else file.dims[d][1] for d in used]
    out = {}
    for n, (dims, attributes, kind, _, _) in chosen.items():
        values = _texts(file.values(n), attributes)
        of = dims[:-1] if kind == 2 else dims
        kept = [d for d in of if d in used]
        order = sorted(range(len(kept)), key=lambda i: used.index(kept[i]))
        values = values.reshape([s for d, s in zip(of, values.shape) if d in used]).transpose(order) if kept else values.reshape(())
        out[n] = np.broadcast_to(values.reshape([s if d in kept else 1 for d, s in zip(used, sizes)]), sizes).reshape(-1)
    frame = pd.DataFrame(out, index=range(prod(sizes)))
    for n, value in file.attributes.items():
        if n in names and n not in frame.columns:
            frame[n] = value.replace("\n", "; ") if isinstance(value, str) else ", ".join(map(str, value))
    for n, size in file.dims:
        if n in names and n not in frame.columns:
            frame[n] = str(size or file.records)
    return frame


def read_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of all files of a path: `_row_id`, file, the names as text columns, and `_has`, those that the file has."""
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                frame = rows_of(bytes(content), names)
                has = [list(frame.columns)] * len(frame)
                frame = frame.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
                yield frame.assign(file=file, _has=has)[["file", "_has", *names]]

    columns = ", ".join(f"`{n}` string" for n in names)
    return raw.mapInPandas(run, f"file string, _has array<string>, {columns}").withColumn(ROW_ID, F.monotonically_increasing_id())


def read_arrays(spark: SparkSession, path: str, imodel: str, **options) -> Bundle:
    """A bundle of array files by the schema of their model; cmems gets dimensions.NTIME, times numbered by first appearance."""
    schema = specs.schema(imodel, options.get("ext_schema_file"), options.get("ext_schema_path"))
    names = list(dict.fromkeys(e.name for s in schema.sections for e in s.elements))
    bundle = read_mdf(spark, read_rows(spark, path, names), imodel, **options)
    if imodel.split("_")[0] != "cmems" or "coordinates" not in bundle.df.schema["data"].dataType.fieldNames():
        return bundle
    timed = selection.factorize(bundle.df.withColumn("_time", F.col("data.coordinates.TIME").cast("string")), "_time", "_ntime")
    data = F.col("data").withField("dimensions", F.struct(F.col("_ntime").cast("long").alias("NTIME")))
    return Bundle(timed.withColumn("data", data).drop("_time", "_ntime"), imodel, parse_dates=bundle.parse_dates)
