import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.bundle import Bundle, read, read_mdf
from tidemark.functions import text_conversion
from tidemark.functions.transforms import REGISTRY as T
from tidemark.operators import corrections, mapping, parsing, selection
from tidemark.plans import specs
from tidemark.sources import tables as io


def test_layered_specs(tmp_path):
    assert specs.merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": "ignore", "z": 3}, "b": "ignore"}) == {"a": {"x": 1, "z": 3}}
    (tmp_path / "icoads" / "r300" / "d705").mkdir(parents=True)
    (tmp_path / "icoads" / "r300" / "d706").mkdir()
    (tmp_path / "icoads" / "icoads.json").write_text(json.dumps({"a": 1, "b": 2}))
    (tmp_path / "icoads" / "r300" / "d705" / "icoads_r300_d705.json").write_text(json.dumps({"b": "ignore", "c": 3}))
    (tmp_path / "icoads" / "r300" / "d706" / "icoads_r300_d706.json").write_text(json.dumps({"substitute": {"data_model": "icoads", "release": "r300", "deck": "d705"}}))
    assert specs.load_layered(tmp_path, "icoads_r300_d706") == {"a": 1, "c": 3}
    assert specs.expand_ranges({"[2000,2002]": 1, "[2004, 2008, 2]": 2, "[2009,'yyyy']": 3, "[oops": 4, "x": 5}, 2010) == {"2000": 1, "2001": 1, "2002": 1, "2004": 2, "2006": 2, "2008": 2, "2009": 3, "2010": 3, "x": 5}
    with pytest.raises(ValueError):
        specs.layers("nobody_r1")


@pytest.mark.parametrize("text,scale,offset,value", [("10", 0.1, 0, 1.0), ("10", 1, 5, 15.0), ("3.5", 2, 1.0, 8.0), (" 2 ", 1, 0, 2.0), ("", 1, 0, None), ("abc", 1, 0, None), ("1 2", 1, 0, 102.0), ("1.234", 0.1, 0, 0.123), ("5", 0, None, 5.0)])
def test_numbers(spark, text, scale, offset, value):
    assert spark.createDataFrame([(text,)], "t string").select(F.expr(parsing.number_sql("t", scale, offset)).alias("v")).first().v == value


CORE = "2010 7 1 100-5319  1467" + " " * 22
CORE = (CORE + " 353" + " " * 40).ljust(108)


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "_row_id long, line string")


def test_sections_and_mask(spark):
    b = read_mdf(spark, lines(spark, CORE + "9815ABC123  2  ", CORE[:40], None, "x" * 20), "icoads_r300")
    rows = {r._row_id: r for r in b.df.collect()}
    assert rows[0].data.core.YR == 2010 and rows[0].data.core.LAT == -53.19 and rows[0].data.core.D == 353 and rows[0].data.c98.UID == "ABC123"
    assert rows[0].mask.core.YR and rows[0].mask.c1.DCK is False and rows[0].mask.c98.UID and rows[1].data.c98.UID is None
    assert rows[2].mask.core.YR is True and rows[2].data.core.YR is None
    assert rows[3].mask.core.YR is False
    core = read_mdf(spark, lines(spark, CORE, None), "icoads_r300", sections=["core"], year_init=2000, year_end=2010)
    assert core.df.schema["data"].dataType.fieldNames() == ["core"] and len(core) == 1
    with pytest.raises(ValueError):
        read_mdf(spark, lines(spark, CORE), "icoads_r300", year_init=2, year_end=1)


def test_delimited_base36_and_separated(spark, tmp_path):
    spec = {"header": {"parsing_order": [{"s": ["a", "b"]}]}, "sections": {"a": {"header": {"length": 2}, "elements": {"n": {"field_length": 2, "column_type": "key", "encoding": "base36"}}}, "b": {"header": {"delimiter": ",", "format": "delimited"}, "elements": {"x": {"column_type": "int"}, "y": {"column_type": "str"}}}}}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    rows = read_mdf(spark, lines(spark, 'zz1,"p,q"', "0a2"), ext_schema_file=str(tmp_path / "s.json")).df.orderBy("_row_id").collect()
    assert rows[0].data.a.n == "1295" and rows[0].data.b.x == 1 and rows[0].data.b.y == "p,q" and rows[1].data.b.y is None
    sep = specs.Schema((specs.Section("c", (specs.Element("p", 4, "float"), specs.Element("q", 3, "int")), None, None, ","),), flat=True)
    out = parsing.read_cells(parsing.parse_lines(lines(spark, "1.5,20", "22.5,3"), sep), sep, ["_row_id"]).orderBy("_row_id").collect()
    assert [(r.data.p, r.data.q) for r in out] == [(1.5, 20), (22.5, 3)]


def test_partition_count_does_not_matter(spark):
    df = lines(spark, *[CORE] * 20)
    one, many = (read_mdf(spark, df.repartition(n), "icoads_r300", sections=["core"]).df.select("_row_id", "data.core.*").collect() for n in (1, 8))
    assert sorted(one) == sorted(many)


def masked(spark):
    return spark.createDataFrame([(10, (1, "a"), (True, True)), (11, (2, "b"), (None, True)), (12, (3, "c"), (False, False)), (13, (4, None), (None, None)), (14, (5, "e"), (True, False))], "_row_id long, data struct<A:long,B:string>, mask struct<A:boolean,B:boolean>")


def test_select_and_split(spark):
    b = Bundle(masked(spark))
    ids = lambda x: sorted(r._row_id for r in x.df.collect())
    assert ids(b.select_where_all_true()) == [10, 11, 13] and ids(b.select_where_all_false()) == [12, 13]
    assert ids(b.select_where_all_true(inverse=True)) == [12, 14]
    assert ids(b.select_where_entry_isin({"data.B": ["a", None]})) == [10, 13]
    yes, no = b.split_by_index([11, 99])
    assert ids(yes) == [11] and ids(no) == [10, 12, 13, 14] and len(b) == 5
    assert ids(b.reset_index()) == [0, 1, 2, 3, 4]
    counts = {(r.column, r.value): r.n for r in b.unique(["data.B"]).collect()}
    assert counts[("data.B", "nan")] == 1
    assert len(b.stack_v(b)) == 10 and len(b.stack_v(Bundle(masked(spark).limit(0)))) == 0


def test_replace(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "id long, x long")
    right = spark.createDataFrame([(1, 11), (3, 33)], "id long, b long")
    out = sorted(selection.replace_columns(left, right, "id", "id", {"x": "b"}).collect(), key=str)
    assert out == [(1, 11), (2, None), (None, None)]
    with pytest.raises(ValueError):
        selection.replace_columns(left, right.union(right), "id", "id", {"x": "b"})
    with pytest.raises(KeyError):
        selection.replace_columns(left, right, "id", "id", {"nope": "b"})


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_transforms(spark):
    L = F.lit
    assert abs(one(spark, T["longitude_360to180"](L(255.68))) + 104.31999969482422) < 1e-9 and one(spark, T["longitude_360to180"](L(360.0))) == -180.0
    assert one(spark, T["datetime_imma1"](L(2010), L(7), L(1), L(1.5))) == datetime(2010, 7, 1, 1, 30) and one(spark, T["datetime_imma1"](L(2010), L(2), L(30), L(1.0))) is None
    assert one(spark, T["string_add"](L("x"), prepend="A", append="B", separator="-")) == "A-x-B" and one(spark, T["string_add"](L(""), prepend="A")) is None
    assert one(spark, T["string_add"](L("0"), prepend="A")) == "A0" and one(spark, T["string_add"](L(0), prepend="A")) is None and one(spark, T["string_add"](L(7), prepend="A")) == "A7"
    assert one(spark, T["string_join_add"](L("-7"), L("0"), zfill_col=[0], zfill=[4])) == "-0070" and one(spark, T["string_join_add"](L("0"))) == "0"
    assert one(spark, T["string_join_add"](L("7"), L("89"), prepend="P", separator="-", zfill_col=[0], zfill=[3])) == "P-007-89"
    assert one(spark, T["temperature_celsius_to_kelvin"](L("1"), L(2.0), method="method_b")) == 271.15
    assert one(spark, T["observing_programme"](L("7"))) == [5, 7, 9] and one(spark, T["location_accuracy"](L("1"), L(0.0))) == 157.0
    assert one(spark, T["feet_to_m"](L(10.0))) == 3.05 and one(spark, T["gdac_longitude"](L(7), L(12.5))) == -12.5
    name = "2010070103WBGCA"
    assert one(spark, T["gdac_uid"](L(2010), L(7), L(1), L(3), L("WBGCA"), prepend="g_")) == "g_" + uuid.uuid5(uuid.NAMESPACE_OID, name).hex
    assert one(spark, T["datetime_imma1_to_utc"](L(1850), L(1), L(1), L(None), L(285.0), L(10.0))) == datetime(1850, 1, 1, 17)


def test_corrections(spark):
    df = spark.createDataFrame([("12345", "147", "5"), ("1234", "147", "5"), ("12345", "147", None), ("6202123", "114", "5"), ("6202222", "114", "5"), ("123456", "114", "5"), ("123456", "103", "5")], "core_id string, c1_sid string, c1_pt string")
    pt = lambda m: [r.c1_pt for r in corrections.correct_pt(df, m).collect()]
    assert pt("icoads_r300_d700") == ["6", "5", "7", "5", "5", "5", "5"] and pt("icoads_r302_d992") == ["5", "5", None, "5", "4", "6", "5"]
    assert pt("icoads_r302_d792")[6] == "6" and pt("gdac") == ["5", "5", None, "5", "5", "5", "5"] and pt("icoads_r300_d128")[2] == "5"
    ids = spark.createDataFrame([("12345",), ("ABCDE",), ("",), (None,)], "i string")
    assert [r.v for r in ids.select(corrections.valid_id(F.col("i"), "icoads_r300_d201").alias("v")).collect()] == [True, False, True, True]
    with pytest.raises(FileNotFoundError):
        corrections.valid_id(F.col("i"), "icoads_r302_d700")
    d = spark.createDataFrame([(1899, 1, 1, 0.0), (1899, 1, 1, 6.0), (1900, 1, 1, 0.0)], "core_yr long, core_mo long, core_dy long, core_hr double")
    assert [tuple(r)[:3] for r in corrections.correct_datetime(d, "icoads_r300_d201").collect()] == [(1898, 12, 31), (1899, 1, 1), (1900, 1, 1)]
    f = spark.createDataFrame([("1", "a"), (None, "a"), ("2", "b")], "p string, o string")
    assert [r.x for r in f.select(corrections.fill_value(F.col("p"), "9", own=["1"], others=[(F.col("o"), ["a"])], fill_null=True).alias("x")).collect()] == ["9", "9", "2"]


def test_mapper(spark, tmp_path):
    src = spark.createDataFrame([("2", "A1", "1"), ("4", "A2", None), ("9", "A3", None), ("21", "A4", "3"), ("21", "A4", "3")], "`c1.PT` string, `c98.UID` string, `c1.LZ` string")
    h = {r.report_id: r for r in mapping.map_model(src, "icoads_r300", "header", now=datetime(2020, 1, 1))["header"].collect()}
    assert [h[f"ICOADS-300-A{i}"].platform_type for i in (1, 2, 3, 4)] == [2, 33, 32, 45] and [h[f"ICOADS-300-A{i}"].location_quality for i in (1, 2, 3, 4)] == [2, 0, 0, 0]
    assert len(h) == 4 and h["ICOADS-300-A1"].duplicate_status == 4 and h["ICOADS-300-A1"].source_id is None and h["ICOADS-300-A1"].record_timestamp == datetime(2020, 1, 1)
    every = mapping.map_model(src, "icoads_r300", now=datetime(2020, 1, 1))
    assert set(every) == set(specs.TABLES) and every["observations-at"].count() == 0 and len(every["observations-sst"].columns) == 46 and len(every["header"].columns) == 43
    with pytest.raises(ValueError):
        specs.mapping("icoads", ["nothing"])
    io.write_tables({"header": every["header"]}, str(tmp_path), "csv")
    back = io.read_tables(spark, str(tmp_path), "csv")["header"]
    assert back.count() == 4 and back.select("application_area").first()[0] == [1, 7, 10, 11] and back.select("record_timestamp").first()[0] == datetime(2020, 1, 1)
    for model in ("gdac", "craid", "cmems", "marob", "pub47", "icoads_r302", "icoads_r300_d714"):
        assert len(mapping.map_model(src, model, now=datetime(2020, 1, 1))) == 8


@pytest.mark.parametrize("value,kind,decimals,text", [(2.5, "numeric", 0, "2"), (None, "numeric", 2, "null"), (1.005, "numeric", 1, "1.0"), (7, "int", 0, "7"), ([1, None, 3], "int[]", 0, "{1,null,3}"), (None, "varchar", 0, "null"), (datetime(2001, 2, 3, 4, 5, 6), "timestamp", 0, "2001-02-03 04:05:06")])
def test_text(spark, value, kind, decimals, text):
    types = {"numeric": "double", "int": "long", "int[]": "array<long>", "varchar": "string", "timestamp": "timestamp_ntz"}
    df = spark.createDataFrame([(value,)], f"v {types[kind]}")
    got = df.select(text_conversion.to_str(F.col("v"), kind, decimals).alias("t"))
    assert got.first().t == text
    back = got.select(text_conversion.from_str(F.col("t"), kind).alias("b")).first().b
    assert back == value or kind == "numeric"


def test_intermediate_files(spark, tmp_path):
    data = spark.createDataFrame([(1, 1.5, "x"), (2, None, None)], "A int, B double, C string")
    mask = spark.createDataFrame([(True, False, None)], "A boolean, B boolean, C boolean")
    for kind, ext in io.EXTENSIONS.items():
        out = tmp_path / kind
        out.mkdir()
        io.write_data(data, mask, str(out), kind, prefix="p")
        d, m = io.read_data(spark, f"{out}/p_data.{ext}", f"{out}/p_mask.{ext}", f"{out}/p_info.json" if kind == "csv" else None, kind)
        assert sorted(map(str, d.collect())) == sorted(map(str, data.collect())) and m.count() == 1
    (tmp_path / "latin.txt").write_bytes("é1\n\nx\n".encode("cp1252"))
    got = io.read_lines(spark, str(tmp_path / "latin.txt"), "windows-1252", skiprows=1).orderBy("_row_id").collect()
    assert [r.line for r in got] == ["", "x"]
    with pytest.raises(ValueError):
        read(spark, "x", mode="nothing")


def test_stream(spark, tmp_path):
    from tidemark.streaming.lines import stream_table

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(CORE + "9815ABC123  2  \n")
    q = stream_table(spark, str(tmp_path / "in"), "icoads_r300", "observations-wd", str(tmp_path / "out"), str(tmp_path / "cp"), now=datetime(2020, 1, 1))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().observation_id == "ICOADS-300-ABC123-WD"
