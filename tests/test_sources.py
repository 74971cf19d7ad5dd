import json
import struct
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.bundle import Bundle, default_mask, from_frames, logger, merged_options, read, read_mdf, write
from tidemark.operators import corrections, selection
from tidemark.plans import specs
from tidemark.sources import netcdf
from tidemark.sources import tables as io


def classic(version=1):
    """A small classic file: a record dimension of three times, a dimension of two levels, a text, scaled and missing numbers."""
    def name(x):
        raw = x.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attribute(key, value):
        if isinstance(value, str):
            return name(key) + struct.pack(">i", 2) + name(value)
        kind, fmt = (4, ">i") if isinstance(value, int) else (6, ">d")
        return name(key) + struct.pack(">ii", kind, 1) + struct.pack(fmt, value)

    def attributes(**pairs):
        return struct.pack(">ii", 12 if pairs else 0, len(pairs)) + b"".join(attribute(k, v) for k, v in pairs.items())

    dims = struct.pack(">ii", 10, 3) + name("TIME") + struct.pack(">i", 0) + name("LEVEL") + struct.pack(">i", 2) + name("CHARS") + struct.pack(">i", 5)
    variables = [
        ("LEVEL", [1], attributes(), 5, np.array([0.5, 2.25], ">f4").tobytes(), None), ("NAME", [2], attributes(), 2, b"buoy\0\0\0\0", None),
        ("TIME", [0], attributes(units="days since 1950-01-01 00:00:00"), 6, None, [struct.pack(">d", x) for x in (0.0, 0.5, 1.0)]),
        ("TEMP", [0, 1], attributes(scale_factor=0.5, _FillValue=-9), 4, None, [struct.pack(">ii", a, b) for a, b in ((20, 21), (-9, 22), (30, 31))]),
    ]
    head = b"CDF" + bytes([version]) + struct.pack(">i", 3) + dims + attributes(platform_code="6200", note="a\nb") + struct.pack(">ii", 11, len(variables))
    pointer = ">i" if version == 1 else ">q"
    size = lambda v: len(v[4]) if v[4] else len(v[5][0])
    length = len(head) + sum(len(name(v[0])) + 4 + 4 * len(v[1]) + len(v[2]) + 8 + struct.calcsize(pointer) for v in variables)
    at, begins = length, {}
    for v in variables[:2]:
        begins[v[0]], at = at, at + size(v)
    for v in variables[2:]:
        begins[v[0]], at = at, at + size(v)
    body = b"".join(name(v[0]) + struct.pack(">i", len(v[1])) + b"".join(struct.pack(">i", d) for d in v[1]) + v[2] + struct.pack(">ii", v[3], size(v)) + struct.pack(pointer, begins[v[0]]) for v in variables)
    return head + body + b"".join(v[4] for v in variables[:2]) + b"".join(r for i in range(3) for r in (variables[2][5][i], variables[3][5][i]))


@pytest.mark.parametrize("version", [1, 2])
def test_classic_arrays(spark, tmp_path, version):
    (tmp_path / "a.nc").write_bytes(classic(version))
    rows = netcdf.rows_of(classic(version), ["TIME", "LEVEL", "TEMP", "NAME", "platform_code", "note", "none"])
    assert rows["TIME"].tolist()[::2] == ["1950-01-01T00:00:00", "1950-01-01T12:00:00", "1950-01-02T00:00:00"] and rows["LEVEL"].tolist()[:2] == ["0.5", "2.25"]
    assert rows["TEMP"].tolist() == ["10.0", "10.5", "", "11.0", "15.0", "15.5"] and set(rows["NAME"]) == {"buoy"} and set(rows["note"]) == {"a; b"} and "none" not in rows
    b = netcdf.read_arrays(spark, str(tmp_path / "a.nc"), "cmems")
    out = b.df.orderBy("_row_id").select("data.global_attributes.platform_code", "data.coordinates.TIME", "data.dimensions.NTIME", F.col("mask.coordinates.LATITUDE").alias("m")).collect()
    assert [r.NTIME for r in out] == [0, 0, 1, 1, 2, 2] and out[2].TIME == datetime(1950, 1, 1, 12) and {r.platform_code for r in out} == {6200} and {r.m for r in out} == {False}
    with pytest.raises(ValueError):
        netcdf.rows_of(b"\x89HDF", [])


def test_layouts_of_all_decks(spark):
    """Blank and rendered supplements: sections in order, each where it belongs."""
    for deck in ("d701", "d702", "d704", "d705", "d706", "d707", "d714", "d721", "d730", "d781"):
        schema = specs.schema(f"icoads_r300_{deck}")
        assert not any(s.name == "c99" and s.raw for s in schema.sections), deck
        assert any(s.name.startswith("c99") and s.elements for s in schema.sections)
    core = "1870 6162016 6900 31961" + " " * 85
    sections = {s.name: s for s in specs.schema("icoads_r300_d704").sections}
    journal = "1" + "".join(str(i % 10) * (e.width or 0) for i, e in enumerate(sections["c99_journal"].elements))[1:117]  # the section is shorter than its fields
    data5 = "5" + "".join("1" * e.width for e in sections["c99_data5"].elements)[1:]
    lines = spark.createDataFrame([(0, core + "99 0 " + journal + data5), (1, core)], "_row_id long, line string")
    got = read_mdf(spark, lines, "icoads_r300_d704").df.orderBy("_row_id").select("data.c99_journal.reel_no", "data.c99_data5.year", "data.c99_data4.year", "data.core.YR", F.col("mask.c99_journal.reel_no").alias("m")).collect()
    assert tuple(got[0]) == ("111", 1111, None, 1870, True) and tuple(got[1]) == (None, None, None, 1870, True)
    assert specs.schema("icoads_r300_d721").encoding == "cp1252" and specs.schema("icoads_r302").sections[-1].elements[-1].name == "supp"


def test_every_deck_maps(spark):
    for deck in ("r300_d701", "r300_d702", "r300_d704", "r300_d705", "r300_d714", "r300_d721", "r300_d730", "r300_d781", "r302_d992"):
        lines = spark.createDataFrame([(0, "1870 6162016 6900 31961" + " " * 85 + "99 0 ")], "_row_id long, line string")
        header = read_mdf(spark, lines, f"icoads_{deck}").map_model(cdm_subset="header", drop_duplicates=False).tables["header"]
        assert header.columns[0] == "report_id" and header.count() == 1


def test_tables_of_allowed_keys(spark, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps({"elements": {"k": {"field_length": 2, "column_type": "key", "codetable": "K"}}}))
    (tmp_path / "K.json").write_text(json.dumps({"[1,3]": "x", "A": "y"}))
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["1 ", "3 ", "4 ", "A ", "  "])], "_row_id long, line string")
    b = read_mdf(spark, lines, ext_schema_file=str(tmp_path / "schema.json"), ext_table_path=str(tmp_path))
    assert [r.k for r in b.mask.orderBy("_row_id").collect()] == [True, True, False, True, True]
    with pytest.raises(FileNotFoundError):
        read_mdf(spark, lines, ext_schema_file=str(tmp_path / "schema.json"), ext_table_path=str(tmp_path / "none"))
    doubled = read_mdf(spark, lines, ext_schema_file=str(tmp_path / "schema.json"), converter_dict={"k": lambda c, e, times=1: F.repeat(F.trim(c), times)}, converter_kwargs={"k": {"times": 2}})
    assert [r.k for r in doubled.data.orderBy("_row_id").collect()][:2] == ["11", "33"]
    for wrong in ({"chunksize": 0}, {"skiprows": -1}, {"year_init": 2, "year_end": 1}):
        with pytest.raises(ValueError):
            read_mdf(spark, lines, "icoads", **wrong)
    with pytest.raises(FileNotFoundError):
        read_mdf(spark, str(tmp_path / "no.txt"), "icoads")


def test_bundle_interface(spark, tmp_path):
    frames = [pd.DataFrame({"a": [1, 2], "b": ["x", "y"]}), pd.DataFrame({"a": [3], "b": ["z"]})]
    b = from_frames(spark, iter(frames), "csv")
    assert b.shape == (3, 2) and not b.empty and len(b) == 3 and [r._row_id for r in b.data.orderBy("_row_id").collect()] == [0, 1, 2]
    assert b.dtypes == {"a": "bigint", "b": "string"} and [r.a for r in b["a"].orderBy("_row_id").collect()] == [1, 2, 3]
    other = b.copy()
    assert other.select_where_index_isin([0, 2], inplace=True, reset_index=True) is None and len(other) == 2 and len(b) == 3
    assert b.add({"imodel": "gdac"}).imodel == "gdac" and b.add({"imodel": "gdac"}, inplace=True) is None and b.imodel == "gdac"
    b["a"] = F.col("data.a") * 10
    assert [r.a for r in b.data.orderBy("_row_id").collect()] == [10, 20, 30]
    b.mask = b.data.select("_row_id", (F.col("a") > 10).alias("a"), F.lit(True).alias("b"))
    yes, no = b.split_by_boolean_true()
    assert len(yes) == 2 and len(no) == 1 and len(b.split_by_boolean_false()[0]) == 0
    b.data = b.data.filter("a < 30")
    assert len(b) == 2 and len(b.stack_v([b, yes])) == 6
    doubled = b.apply(lambda batches: (pdf.assign(a=pdf["a"] * 2)[["_row_id", "a"]] for pdf in batches), "_row_id long, a long")
    assert sorted(r.a for r in doubled.collect()) == [20, 40]
    assert {(r["column"], r["value"]) for r in b.unique().collect()} >= {("data.`a`", "10")}
    with pytest.raises(ValueError):
        from_frames(spark, [])
    with pytest.raises(TypeError):
        from_frames(spark, [1])
    assert merged_options({"a": 1}, None, {"b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        merged_options({"a": 1}, {"a": 2})
    logger("tidemark.test", file=str(tmp_path / "log")).info("said")
    assert "said" in (tmp_path / "log").read_text()
    ids = [spark.range(3).withColumnRenamed("id", "_row_id"), spark.range(2, 5).withColumnRenamed("id", "_row_id")]
    assert selection.union_of_ids(*ids).count() == 5


def test_table_files(spark, tmp_path):
    header = spark.createDataFrame([("A", 1.234), ("null", 2.0)], "report_id string, latitude double")
    folder = str(tmp_path / "t")
    write({"header": header, "observations-at": header.limit(0)}, folder, "tables", "icoads_r300", data_format="csv", prefix="p", suffix="s1")
    back = read(spark, folder, "tables", data_format="csv", prefix="p", suffix="s1")
    assert [tuple(r) for r in back["header"].collect()] == [("A", 1.23)]  # two decimals by the mapping, the null label dropped
    assert set(read(spark, folder, "tables", data_format="csv", prefix="p", suffix="1", cdm_subset=["header", "nothing"])) == {"header"}
    io.write_tables({"header": header}, folder, "csv", filename="p-header-s0.psv")
    assert "header" not in io.read_tables(spark, folder, "csv", prefix="p", suffix="*")  # two files
    with pytest.raises(FileNotFoundError):
        io.read_tables(spark, folder, "csv", prefix="q")
    assert io.adjusted_name("data", "header") == "header-data.psv" and io.adjusted_name("header-data.txt", "header") == "header-data.txt"
    one = io.read_tables(spark, f"{folder}/p-header-s1.psv", "csv", cdm_subset="header")
    assert one["header"].count() == 1


def test_lines_of_any_encoding(spark, tmp_path):
    text = "first\n\nzweite für\nthird\n"
    for encoding in ("windows-1252", "utf-8", "utf-16", "iso-8859-15"):
        path = tmp_path / f"{encoding}.txt"
        path.write_bytes(text.encode(encoding))
        got = io.read_lines(spark, str(path), encoding, skiprows=1).orderBy("_row_id").collect()
        assert [r.line for r in got] == ["", "zweite für", "third"], encoding


def test_decks_and_ids(spark):
    assert len(corrections.id_patterns()) == 112 and corrections.id_patterns()["d714"] == []
    df = spark.createDataFrame([("0",), (None,)], "OP string").withColumn("N", F.lit(None).cast("string"))
    assert [tuple(r) for r in corrections.correct_pt(df, "gdac_d717").collect()] == [("0", "9"), ("7", None)]
    rows = spark.createDataFrame([(None, "x", "1")], "c1_pt string, core_id string, c1_sid string")
    assert corrections.correct_pt(rows, "icoads_r300_d1", corrections={"d1": {"method": "fillna", "fill_value": "3"}}).first().c1_pt == "3"
    for wrong in ({"method": "fillna"}, {"method": "other"}):
        with pytest.raises(ValueError):
            corrections.correct_pt(rows, "icoads_r300_d1", corrections={"d1": wrong})
    assert default_mask(spark.range(1).select(F.struct("id").alias("data"))) is not None and isinstance(Bundle().copy(), Bundle)
