"""Further queries: transforms, corrections, whole mapped tables, readers and writers, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid as ids
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.bundle import Bundle, default_mask, read_mdf, write
from tidemark.functions import text_conversion, transforms
from tidemark.functions.transforms import REGISTRY as T
from tidemark.operators import corrections, mapping, parsing, selection
from tidemark.plans import specs
from tidemark.plans.catalogue import query
from tidemark.plans.reference_queries import ITEM_SCHEMA, LINE_KEY, MASKED, _masked, _rendered
from tidemark.plans.specs import Element, Schema, Section, schema_from_json
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import tables as io
from tidemark.streaming.lines import stream_lines

NOW = datetime(2020, 1, 1)


def shared_folder(df: DataFrame) -> str:
    """A new folder in the one that executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir().removeprefix('file:')}/{ids.uuid4().hex}"


# transforms

UID_NAME = "lpad(year(o_orderdate)::varchar, 4, '0') || lpad(month(o_orderdate)::varchar, 2, '0') || lpad(day(o_orderdate)::varchar, 2, '0') || '07' || o_custkey"


@query("orders", sql=f"SELECT o_orderkey, 'u_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', 1 + strpos('0123456789abcdef', substr(h, 17, 1))::int % 4 - CASE WHEN strpos('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN -3 ELSE 1 END, 1) || substr(h, 18, 15) AS uid FROM (SELECT o_orderkey, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || ({UID_NAME})::blob) AS h FROM orders)")
def transform_gdac_uid(orders):
    return orders.select("o_orderkey", T["gdac_uid"](F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.lit(7), F.col("o_custkey"), prepend="u_").alias("uid"))


@query("orders", sql="SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), (o_custkey % 24)::int, 0, 0) AS immt, date_trunc('day', o_orderdate) + INTERVAL 1 HOUR + INTERVAL 250 MILLISECOND AS craid, date_trunc('day', o_orderdate) + INTERVAL 2 MINUTE AS cmems, CASE WHEN o_custkey % 5 <> 0 THEN date_trunc('day', o_orderdate) + INTERVAL 3 SECOND END AS marob, CASE o_custkey % 5 WHEN 0 THEN 3600 WHEN 1 THEN 360 WHEN 2 THEN 60 WHEN 3 THEN 36 END AS accuracy, timestamp '2020-01-01' AS now FROM orders")
def transforms_datetime(orders):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey")
    marob = F.when(k % 5 != 0, F.concat(day, F.lit("T00:00:03"))).otherwise(F.lit("none"))
    return orders.select(
        "o_orderkey", T["datetime_immt"](F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), k % 24).alias("immt"), T["datetime_craid"](F.concat(day, F.lit(" 01:00:00.250000"))).alias("craid"),
        T["datetime_cmems"](F.concat(day, F.lit(" 00:02:00"))).alias("cmems"), T["datetime_marob"](marob).alias("marob"), T["time_accuracy"]((k % 5).cast("string")).alias("accuracy"), T["datetime_utcnow"](now=NOW).alias("now"),
    )


@query("orders", sql="SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 12 HOUR - to_hours(round_even(CASE WHEN o_custkey % 360 > 180 THEN o_custkey % 360 - 360 ELSE o_custkey % 360 END / 15.0, 0)::int) AS utc, CASE WHEN o_custkey % 2 = 0 THEN date_trunc('day', o_orderdate) + to_minutes((o_custkey % 96 * 15)::int) ELSE date_trunc('day', o_orderdate) + INTERVAL 12 HOUR - to_hours(round_even(CASE WHEN o_custkey % 360 > 180 THEN o_custkey % 360 - 360 ELSE o_custkey % 360 END / 15.0, 0)::int) END AS either, (o_custkey % 96 // 4)::bigint AS hour, (o_custkey % 4 * 15)::bigint AS minute FROM orders")
def transforms_local_noon(orders):
    """Local noon by the nautical zone; with the hour, where there is one; hours and minutes of decimal hours."""
    k = F.col("o_custkey")
    y, m, d, lon, h = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), (k % 360).cast("double"), F.when(k % 2 == 0, k % 96 / 4)
    hm = T["datetime_decimalhour_to_hm"](k % 96 / 4)
    return orders.select("o_orderkey", T["datetime_imma1_to_utc"](y, m, d, h, lon, F.lit(0.0)).alias("utc"), T["datetime_imma1_701"](y, m, d, h, lon, F.lit(0.0)).alias("either"), hm["HR"].cast("long").alias("hour"), hm["M"].cast("long").alias("minute"))


@query("customer", sql="SELECT c_custkey, c_acctbal * 0.1::double AS scaled, CASE WHEN c_nationkey <> 3 THEN c_nationkey END::double AS real, CASE WHEN c_nationkey = 5 THEN 0 WHEN c_nationkey = 6 THEN NULL ELSE c_nationkey END::double AS wd, round_even(c_custkey / 3.2808::double, 2) AS metres, CASE WHEN c_nationkey % 8 IN (5, 7) THEN -c_acctbal ELSE c_acctbal END AS lon, (CASE WHEN c_custkey % 2000 < 1000 THEN c_custkey % 2000 + 10000 ELSE c_custkey % 2000 END)::double * 0.1::double AS pressure, CASE WHEN c_nationkey % 6 IN (0, 5) THEN c_acctbal ELSE -c_acctbal END + 273.15 AS kelvin, (((c_acctbal::double + 180) % 360 + 360) % 360) - 180 AS lon180, round_even(abs(c_nationkey) + (c_custkey % 60) / 60.0::double, 2) * CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END AS dmh FROM customer")
def transforms_scaled(customer):
    n, b, k = F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_custkey")
    text = F.when(n != 3, n.cast("string")).otherwise(F.lit("x"))
    wind = F.when(n == 5, 361).when(n == 6, 362).otherwise(n)
    return customer.select(
        "c_custkey", T["float_scale"](b, factor=0.1).alias("scaled"), T["integer_to_float"](text).alias("real"), T["icoads_wd_integer_to_float"](wind).alias("wd"), T["feet_to_m"](k).alias("metres"), T["gdac_longitude"](n % 8, b).alias("lon"),
        T["gdac_pressure"](k % 2000).alias("pressure"), T["temperature_celsius_to_kelvin"]((n % 6).cast("string"), b, method="method_b").alias("kelvin"), transforms.coord_360_to_180(b).alias("lon180"),
        transforms.coord_dmh_to_90(n, k % 60, F.when(n % 2 == 0, "S").otherwise("N")).alias("dmh"),
    )


@query("orders", sql="SELECT o_orderkey, coalesce(o_orderstatus, 'nan') || '/' || o_custkey AS joined, CASE WHEN o_custkey % 3 <> 0 THEN 'N-' || (o_custkey % 3) END AS number, 'T-' || (o_custkey % 3) AS text, CASE WHEN o_custkey % 3 = 0 THEN '-00' || (o_custkey % 10) ELSE lpad((o_custkey % 10)::varchar, 4, '0') END AS filled, CASE WHEN o_custkey % 9 BETWEEN 0 AND 5 THEN '5,7,56' WHEN o_custkey % 9 = 7 THEN '5,7,9' END AS programme, '2020-01-01 00:00:00. Initial conversion from ICOADS R3.0.2T NRT' AS lineage FROM orders")
def transforms_text(orders):
    """Text zero stays, the number zero gives null; zeros are filled behind the sign."""
    k = F.col("o_custkey")
    signed = F.when(k % 3 == 0, F.concat(F.lit("-"), k % 10)).otherwise((k % 10).cast("string"))
    return orders.select(
        "o_orderkey", T["df_col_join"](F.col("o_orderstatus"), k, sep="/").alias("joined"), T["string_add"](k % 3, prepend="N", separator="-").alias("number"), T["string_add"]((k % 3).cast("string"), prepend="T", separator="-").alias("text"),
        T["string_join_add"](signed, zfill_col=[0], zfill=[4]).alias("filled"), F.array_join(T["observing_programme"](k % 9), ",").alias("programme"), T["lineage"](imodel="icoads_r302_d992", now=NOW).alias("lineage"),
    )


# corrections and checks

PT_CASES = "CASE WHEN row_id % 3 = 0 THEN '6202222' WHEN row_id % 3 = 1 THEN '6202123' ELSE trim(core_id) END"


def _pt_cases(reports: DataFrame) -> DataFrame:
    i = F.when(F.col("row_id") % 3 == 0, "6202222").when(F.col("row_id") % 3 == 1, "6202123").otherwise(F.col("core_id"))
    number = F.when(F.col("row_id") % 7 == 0, "123456").otherwise(i)
    return reports.select("row_id", number.alias("core_id"), F.when(F.col("row_id") % 2 == 0, "114").otherwise("103").alias("c1_sid"), F.lit("5").alias("c1_pt"))


@query("reports", sql=f"SELECT row_id, CASE WHEN row_id % 2 = 0 AND i = '6202222' THEN '4' WHEN row_id % 2 = 0 AND regexp_full_match(i, '[0-9]+') AND length(i) NOT IN (5, 7) AND i NOT LIKE '7%' THEN '6' ELSE '5' END AS d992, CASE WHEN row_id % 2 = 1 AND regexp_full_match(i, '[0-9]+') AND length(i) NOT IN (5, 7) AND i NOT LIKE '7%' THEN '6' ELSE '5' END AS d792 FROM (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN '123456' ELSE {PT_CASES} END AS i FROM reports)")
def correct_pt_buoys(reports):
    """Decks 992 and 792: light vessels are 620 and twos only."""
    rows = _pt_cases(reports)
    both = corrections.correct_pt(rows, "icoads_r302_d992").withColumnRenamed("c1_pt", "d992").withColumn("c1_pt", F.lit("5"))
    return corrections.correct_pt(both, "icoads_r302_d792").select("row_id", "d992", F.col("c1_pt").alias("d792"))


@query("reports", sql="SELECT row_id, CASE WHEN regexp_full_match(i, '[0-9]{5}') AND c1_sid = '147' AND coalesce(c1_pt, '7') = '5' THEN '6' ELSE coalesce(c1_pt, '7') END AS d700, coalesce(c1_pt, '7') AS op, CASE WHEN c1_dck IS NULL OR (row_id % 5 = 0) THEN CASE WHEN c1_pt = '0' THEN '9' END ELSE c1_dck END AS n FROM (SELECT row_id, c1_pt, c1_dck, CASE WHEN row_id % 4 = 0 THEN '12345' ELSE trim(core_id) END AS i, CASE WHEN row_id % 8 = 0 THEN '147' ELSE c1_sid END AS c1_sid FROM reports)")
def correct_pt_700_717(reports):
    rows = reports.select("row_id", F.when(F.col("row_id") % 4 == 0, "12345").otherwise(F.col("core_id")).alias("core_id"), F.when(F.col("row_id") % 8 == 0, "147").otherwise(F.col("c1_sid")).alias("c1_sid"), "c1_pt", F.col("c1_pt").alias("OP"), F.when(F.col("row_id") % 5 != 0, F.col("c1_dck")).alias("N"))
    out = corrections.correct_pt(corrections.correct_pt(rows, "icoads_r300_d700"), "gdac_d717")
    return out.select("row_id", F.col("c1_pt").alias("d700"), F.col("OP").alias("op"), F.col("N").alias("n"))


@query("reports", sql="SELECT row_id, coalesce(regexp_matches(core_id, '^(?:^([0-9]{1}[A-Z]{1}|^[A-Z]{1}[0-9]{1}|^[A-Z]{2})[A-Z0-9]{1,}$|^(AMO|BAT|BAR|IDD|MIN|SCA|TBW)(AA|UK|FR|DE|EU)[0-9]{2}$|^SHIP$|^BBXX KS[0-9]{2}$)'), false) AS d700, core_id IS NOT NULL AS d714, coalesce(regexp_matches(core_id, '^[0-9]{6}$|^$'), true) AS d118 FROM reports")
def validate_ids(reports):
    """A deck with patterns, one without any, and one where blank ids pass."""
    i = F.col("core_id")
    return reports.select("row_id", corrections.valid_id(i, "icoads_r300_d700").alias("d700"), corrections.valid_id(i, "icoads_r300_d714").alias("d714"), corrections.valid_id(i, "icoads_r300_d118", blank=True).alias("d118"))


@query("orders", sql="SELECT o_orderkey, o_custkey % 31 + 1 <= day(last_day(o_orderdate)) AND o_custkey % 25 < 24 AS valid, year(o_orderdate)::bigint AS y, month(o_orderdate)::bigint AS m, day(o_orderdate)::bigint AS d, (o_custkey % 96) / 4.0::double AS h FROM orders")
def model_datetime(orders):
    """Whether year, month, day and hour are a time; and a time's parts back again."""
    k = F.col("o_custkey")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    back = corrections.columns_of(corrections.timestamp_of(y, m, F.dayofmonth("o_orderdate"), k % 96 / 4))
    return orders.select("o_orderkey", corrections.valid_datetime(y, m, k % 31 + 1, k % 25).alias("valid"), *[c.cast("long").alias(n) for c, n in zip(back[:3], "ymd")], back[3].alias("h"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS meet, CASE WHEN o_orderstatus = 'F' OR o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS either, regexp_full_match(o_clerk, '[0-9]+') AS digits FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN o_custkey::varchar ELSE o_orderpriority END AS o_clerk FROM orders)")
def fill_values(orders):
    even = [(F.col("o_custkey") % 2, [0])]
    s = F.col("o_orderstatus")
    clerk = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority"))
    return orders.select("o_orderkey", corrections.fill_value(s, "X", own=["F"], others=even).alias("meet"), corrections.fill_value(s, "X", own=["F"], others=even, joined="join").alias("either"), corrections.numeric_id(clerk).alias("digits"))


# parser options

@query("lineitem", sql=f"SELECT {LINE_KEY} AS row_id, CASE WHEN l_linenumber = 1 THEN 1000 + l_quantity / 10 ELSE l_quantity / 10 END::double AS pressure, CASE WHEN l_returnflag = 'N' THEN NULL ELSE '  ' || l_returnflag || l_linestatus || '  ' END AS kept, CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS stripped, l_linenumber * 10 AS tens, CASE l_returnflag WHEN 'N' THEN true ELSE l_linestatus = 'F' AND l_returnflag = 'R' END AS m_key FROM lineitem")
def parse_options(lineitem):
    """A leading zero of PPPP, white space, a converter of one's own, keys of a table that the caller gives."""
    schema = schema_from_json({"header": {}, "elements": {
        "PPPP": {"field_length": 4, "column_type": "float", "scale": 0.1}, "kept": {"field_length": 6, "column_type": "str", "disable_white_strip": True}, "stripped": {"field_length": 6, "column_type": "str"}, "tens": {"field_length": 1, "column_type": "int"},
        "key": {"field_length": 2, "column_type": "key"}, "no": {"field_length": 3, "column_type": "str", "ignore": "yes"},
    }})
    flags = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("  "), "l_returnflag", "l_linestatus", F.lit("  "))).otherwise(F.lit(" " * 6))
    number = F.when(F.col("l_linenumber") == 1, F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0")).otherwise(F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, " "))
    line = F.concat(number, flags, flags, F.col("l_linenumber").cast("string"), F.trim(flags), F.lit("abc"))
    line = F.when(F.col("l_returnflag") == "N", F.concat(number, flags, flags, F.col("l_linenumber").cast("string"), F.lit("  abc"))).otherwise(line)
    rows = lineitem.select(F.expr(LINE_KEY).alias("_row_id"), line.alias("line"))
    parsed = parsing.parse_lines(rows, schema)
    out = parsing.read_cells(parsed, schema, ["_row_id"], converters={"tens": lambda c, e: c.cast("long") * 10}, tables={"key": ["RF"]})
    return out.select(F.col("_row_id").alias("row_id"), F.col("data.PPPP").alias("pressure"), "data.kept", "data.stripped", "data.tens", F.col("mask.key").alias("m_key"))


@query("lineitem", sql=f"SELECT {LINE_KEY} AS row_id, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag FROM lineitem WHERE l_orderkey BETWEEN 100 AND 30000")
def parse_sections_and_years(lineitem):
    """One section only, and rows by the bounds of a number."""
    parsed = parsing.parse_lines(_rendered(lineitem), ITEM_SCHEMA, sections=["core", "c1"], excludes=["c2"])
    parsed = parsing.select_years(parsed.withColumn("_n", F.col("_c_core_ORDER.v")), "_n", 100, 30000).drop("_n")
    out = parsing.read_cells(parsed, ITEM_SCHEMA, ["_row_id"])
    return out.select(F.col("_row_id").alias("row_id"), F.col("data.c1.FLAG").alias("flag"))


@query("customer", sql="SELECT c_custkey AS row_id, CASE WHEN trim(c_mktsegment) <> '' THEN c_mktsegment END AS segment, c_acctbal AS balance, c_acctbal BETWEEN 0 AND 5000 AS m_balance, false AS m_none FROM customer")
def parse_columns(customer):
    """Rows with a column per element, as array files give them."""
    schema = Schema((Section("a", (Element("c_mktsegment", None, "str"), Element("c_acctbal", None, "float", valid_min=0, valid_max=5000), Element("none", None, "int"))),), "utf-8")
    b = parsing.read_cells(parsing.parse_columns(customer.withColumn("_row_id", F.col("c_custkey")), schema), schema, ["_row_id"])
    return b.select(F.col("_row_id").alias("row_id"), F.col("data.a.c_mktsegment").alias("segment"), F.col("data.a.c_acctbal").alias("balance"), F.col("mask.a.c_acctbal").alias("m_balance"), F.col("mask.a.none").alias("m_none"))


NUMBER = "regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')"
YEAR, HOUR = "replace(trim(substr(coalesce(line, ''), 1, 4)), ' ', '0')", "replace(trim(substr(coalesce(line, ''), 9, 4)), ' ', '0')"


@query("raw_lines", "elements", "schema_header", sql=f"SELECT CASE WHEN {NUMBER.format(YEAR)} THEN trunc({YEAR}::double)::bigint END AS year, count(*) AS n, count(CASE WHEN {HOUR} = '' OR ({NUMBER.format(HOUR)} AND round({HOUR}::double * 0.01, 2) BETWEEN 0 AND 23.99) THEN 1 END) AS n_valid_hours FROM raw_lines WHERE imodel = 'icoads' GROUP BY 1")
def read_report_lines(raw_lines, elements, schema_header):
    """The report lines of the sectioned model by the schema that the tables give: rows and valid hours by year."""
    sections = {}
    for e in sorted(elements.filter("imodel = 'icoads'").collect(), key=lambda e: e.elem_no):
        spec = {"field_length": e.field_length, "column_type": e.column_type, "scale": e.scale, "valid_min": e.valid_min, "valid_max": e.valid_max, "missing_value": e.missing_value}
        sections.setdefault(e.section, {"header": {}, "elements": {}})["elements"][e.element] = spec | ({"codes": e.codes.split(",")} if e.codes else {})
    heads = sorted(schema_header.filter("imodel = 'icoads'").collect(), key=lambda h: h.section_no)
    for h in heads:
        sections[h.section]["header"] = {"sentinel": h.sentinel, "length": h.section_length}
    schema = schema_from_json({"header": {"parsing_order": [{"s": [h.section for h in heads]}]}, "sections": sections})
    lines = raw_lines.filter("imodel = 'icoads'").select(F.col("line_id").alias("_row_id"), "line")
    b = Bundle(parsing.read_cells(parsing.parse_lines(lines, schema), schema, ["_row_id"]), "icoads")
    return b.df.groupBy(F.col("data.core.YR").alias("year")).agg(F.count("*").alias("n"), F.count(F.when(F.col("mask.core.HR"), 1)).alias("n_valid_hours"))


# bundle

def _priced(orders: DataFrame) -> Bundle:
    rows = orders.select(F.col("o_orderkey").alias("_row_id"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("data"), F.struct((F.col("o_totalprice") > 100000).alias("price"), F.lit(None).cast("boolean").alias("status")).alias("mask"))
    return Bundle(rows)


@query("orders", sql="SELECT o_orderkey AS row_id, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price, o_totalprice > 100000 AS m_price FROM orders")
def bundle_unmasked(orders):
    """A selection that leaves the mask as it was: the mask has all rows, the data the chosen ones."""
    b = _priced(orders)
    b.select_where_all_true(inplace=True, do_mask=False)
    mask = b.mask.select(F.col("_row_id").alias("row_id"), F.col("price").alias("m_price"))
    return mask.join(b.data.select(F.col("_row_id").alias("row_id"), "price"), "row_id", "left")


@query("orders", "customer", sql="SELECT o_orderkey AS row_id, c_name AS status, c_acctbal AS price FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def bundle_replace_columns(orders, customer):
    rows = orders.select(F.col("o_orderkey").alias("_row_id"), F.struct(F.struct("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("core")).alias("data"))
    b = Bundle(rows.withColumn("mask", default_mask(rows))).replace_columns(customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey", {"status": "c_name", "price": "c_acctbal"}, subset="core")
    return b.df.select(F.col("_row_id").alias("row_id"), "data.core.status", "data.core.price")


@query("lineitem", sql=f"SELECT coalesce(a.k, b.k) AS k, a.l_quantity, b.l_quantity AS l_quantity_2, coalesce(a.k, 0) > 0 AS left_there FROM (SELECT {LINE_KEY} AS k, l_quantity FROM lineitem WHERE l_quantity < 30) a FULL JOIN (SELECT {LINE_KEY} AS k, l_quantity FROM lineitem WHERE l_quantity > 20) b ON a.k = b.k")
def bundle_stack_h(lineitem):
    def part(condition: str) -> Bundle:
        rows = lineitem.filter(condition).select(F.expr(LINE_KEY).alias("_row_id"), F.struct("l_quantity").alias("data"))
        return Bundle(rows.withColumn("mask", default_mask(rows)))

    b = part("l_quantity < 30").stack_h(part("l_quantity > 20"))
    return b.df.select(F.col("_row_id").alias("k"), "data.l_quantity", "data.l_quantity_2", F.coalesce("mask.l_quantity", F.lit(False)).alias("left_there"))


@query("lineitem", sql=f"SELECT row_number() OVER (ORDER BY p, k) - 1 AS i, k FROM (SELECT 0 AS p, {LINE_KEY} AS k FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 1, {LINE_KEY} FROM lineitem WHERE l_quantity > 45)")
def bundle_stack_v(lineitem):
    def part(condition: str) -> Bundle:
        rows = lineitem.filter(condition).select(F.expr(LINE_KEY).alias("_row_id"), F.struct(F.expr(LINE_KEY).alias("k")).alias("data"))
        return Bundle(rows.withColumn("mask", default_mask(rows)))

    return part("l_quantity < 10").stack_v(part("l_quantity > 45")).df.select(F.col("_row_id").alias("i"), "data.k")


@query("reports", sql="SELECT row_id, CASE WHEN regexp_full_match(trim(core_id), '[0-9]{5}') AND c1_sid = '29' AND c1_pt = '5' THEN '6' ELSE c1_pt END AS pt, coalesce(regexp_matches(core_id, '^[0-9]{5}$|^$'), true) AS valid_id, coalesce(TRY_CAST(core_mo AS int) BETWEEN 1 AND 12 AND TRY_CAST(core_yr AS int) BETWEEN 1 AND 9999 AND TRY_CAST(core_dy AS int) BETWEEN 1 AND 28 AND TRY_CAST(core_hr AS double) >= 0 AND TRY_CAST(core_hr AS double) < 24, false) AS valid_time FROM reports")
def bundle_corrections(reports):
    """Platform types, ids and times through the methods of a bundle; days up to 28 count."""
    day = F.col("core_dy").try_cast("int")
    rows = reports.select(F.col("row_id").alias("_row_id"), F.struct(F.struct(F.col("core_yr").try_cast("int").alias("YR"), F.col("core_mo").try_cast("int").alias("MO"), F.when(day <= 28, day).alias("DY"), F.col("core_hr").try_cast("double").alias("HR"), F.col("core_id").alias("ID")).alias("core"), F.struct(F.col("c1_pt").alias("PT"), F.col("c1_sid").alias("SID")).alias("c1")).alias("data"))
    b = Bundle(rows.withColumn("mask", default_mask(rows)), "icoads_r300_d892")
    ids_, times = b.validate_id("icoads_r300_d201").withColumnRenamed("valid", "valid_id"), b.validate_datetime().withColumnRenamed("valid", "valid_time")
    out = b.correct_pt().df.select("_row_id", F.col("data.c1.PT").alias("pt"))
    return out.join(ids_, "_row_id").join(times, "_row_id").withColumnRenamed("_row_id", "row_id")


# whole mapped tables

MAPPED_FROM = {"core_id": "core.ID", "core_lat": "core.LAT", "core_lon": "core.LON", "core_ds": "core.DS", "core_vs": "core.VS", "core_at": "core.AT", "core_dpt": "core.DPT", "core_wbt": "core.WBT", "core_sst": "core.SST", "core_slp": "core.SLP", "core_d": "core.D", "core_w": "core.W", "c1_pt": "c1.PT", "c98_uid": "c98.UID", "c1_sid": "c1.SID", "c1_dck": "c1.DCK"}
SOURCE_SQL = "(SELECT *, TRY_CAST(core_yr AS int) AS y, TRY_CAST(core_mo AS int) AS m, TRY_CAST(core_dy AS int) AS d, TRY_CAST(core_hr AS double) AS h FROM reports)"
TIME_SQL = "CASE WHEN h >= 0 AND h < 24 THEN TRY(make_timestamp(y, m, d, floor(h)::int, floor(round((h - floor(h)) * 3600, 6) / 60)::int, 0)) END"
LON_SQL = "(CASE WHEN core_lon > 180 THEN -180 + core_lon % 180 ELSE core_lon END)::float::double"
SOURCE_ID_SQL = "'ICOADS-3-0-0T-' || coalesce(lpad(c1_sid, greatest(3, length(c1_sid))::int, '0'), 'nan') || '-' || coalesce(c1_dck, 'nan') || '-' || coalesce(y::varchar, 'nan') || '-' || coalesce(lpad(m::varchar, greatest(2, length(m::varchar))::int, '0'), 'nan')"
SPEED = "CASE WHEN y BETWEEN 1750 AND 1967 THEN [0.0, 1.02888, 2.5722, 4.11552, 5.65884, 7.20216, 8.74548, 10.2888, 11.8321, 12.861][core_vs + 1] WHEN y BETWEEN 1968 AND 2100 THEN [0.0, 1.54332, 4.11552, 6.68772, 9.25992, 11.8321, 14.4043, 16.9765, 19.5487, 22.1209][core_vs + 1] END"
PLATFORM = "CASE c1_pt WHEN '4' THEN 33 WHEN '6' THEN 4 WHEN '7' THEN 5 WHEN '8' THEN 6 WHEN '9' THEN 32 WHEN '10' THEN 35 WHEN '11' THEN 34 WHEN '12' THEN 44 WHEN '13' THEN 43 WHEN '14' THEN 43 WHEN '15' THEN 3 WHEN '16' THEN 38 WHEN '17' THEN 46 WHEN '18' THEN 36 WHEN '19' THEN 40 WHEN '20' THEN 42 WHEN '21' THEN 45 WHEN '31' THEN 43 ELSE CASE WHEN c1_pt IN ('0', '1', '2', '3', '5') THEN 2 END END"
HEADER_SQL = {
    "report_id": "'ICOADS-300-' || nullif(c98_uid, '')", "application_area": "'1,7,10,11'", "observing_programme": "CASE WHEN c1_pt IN ('0', '1', '2', '3', '4', '5') THEN '5,7,56' WHEN c1_pt = '7' THEN '5,7,9' END", "report_type": "0", "station_type": "2",
    "platform_type": PLATFORM, "platform_sub_type": "CASE WHEN c1_pt = '7' THEN 69 END", "primary_station_id": "core_id", "station_record_number": "1", "primary_station_id_scheme": "8", "longitude": LON_SQL, "latitude": "core_lat", "location_quality": "0", "crs": "0",
    "station_speed": SPEED, "station_course": "CASE WHEN core_ds BETWEEN 0 AND 8 THEN core_ds * 45 END", "height_of_station_above_local_ground": "0", "height_of_station_above_sea_level": "0", "report_meaning_of_timestamp": "2", "report_timestamp": TIME_SQL,
    "report_duration": "11", "report_time_quality": "2", "duplicate_status": "4", "record_timestamp": "timestamp '2020-01-01'", "history": "'2020-01-01 00:00:00. Initial conversion from ICOADS R3.0.0T'", "source_id": SOURCE_ID_SQL, "source_record_id": "c98_uid",
}
OBSERVATION_SQL = {
    "report_id": "'ICOADS-300-' || nullif(c98_uid, '')", "data_policy_licence": "0", "date_time": TIME_SQL, "date_time_meaning": "2", "observation_duration": "8", "longitude": LON_SQL, "latitude": "core_lat", "crs": "0", "z_coordinate_type": "0",
    "value_significance": "2", "conversion_flag": "0", "spatial_representativeness": "3", "quality_flag": "2", "sensor_automation_status": "5", "exposure_of_sensor": "3", "processing_level": "3", "traceability": "2", "advanced_qc": "0", "advanced_uncertainty": "0",
    "advanced_homogenisation": "0", "source_id": SOURCE_ID_SQL, "units": "5", "original_units": "60", "conversion_method": "1",
}
VARIABLES = {
    "at": ("85", "core_at + 273.15", "core_at", {}), "sst": ("95", "core_sst + 273.15", "core_sst", {}), "dpt": ("36", "core_dpt + 273.15", "core_dpt", {}), "wbt": ("41", "core_wbt + 273.15", "core_wbt", {}),
    "wd": ("106", "CASE core_d WHEN 361 THEN 0 WHEN 362 THEN NULL ELSE core_d END", "core_d", {"units": "320", "original_units": "320", "conversion_flag": "2", "conversion_method": "NULL"}),
    "ws": ("107", "core_w", "core_w", {"units": "731", "original_units": "731", "conversion_flag": "2", "conversion_method": "NULL"}), "slp": ("58", "core_slp * 100", "core_slp", {"units": "32", "original_units": "530", "conversion_method": "7"}),
}
SQL_TYPES = {"int": "bigint", "numeric": "double", "varchar": "varchar", "timestamp": "timestamp", "timestamp with timezone": "timestamp"}


def _table_sql(table: str, expressions: dict[str, str]) -> str:
    return ", ".join(f"({expressions.get(c, 'NULL')})::{SQL_TYPES.get(k, 'varchar')} AS {c}" for c, k in specs.columns(table).items())


def _observation_sql(name: str) -> str:
    variable, value, original, other = VARIABLES[name]
    of = OBSERVATION_SQL | {"observation_id": f"'ICOADS-300-' || nullif(c98_uid, '') || '-{name.upper()}'", "observed_variable": variable, "observation_value": value, "original_value": original} | other
    return f"SELECT DISTINCT '{name}' AS kind, {_table_sql('observations-at', of)} FROM {SOURCE_SQL} WHERE ({value}) IS NOT NULL"


def _source(reports: DataFrame) -> DataFrame:
    time = {"core.YR": "int", "core.MO": "int", "core.DY": "int", "core.HR": "double"}
    return reports.select(*[F.col(k).alias(v) for k, v in MAPPED_FROM.items()], *[F.col(f"core_{c[-2:].lower()}").try_cast(k).alias(c) for c, k in time.items()])


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(F.col(c), ",").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes])


@query("reports", sql=f"SELECT DISTINCT {_table_sql('header', HEADER_SQL)} FROM {SOURCE_SQL}")
def map_header_rows(reports):
    """All columns of the header, repeated rows left out."""
    return _plain(mapping.map_model(_source(reports), "icoads_r300", "header", now=NOW)["header"])


@query("reports", sql=" UNION ALL ".join(map(_observation_sql, VARIABLES)))
def map_observation_rows(reports):
    """All columns of all seven observation tables, through the method of a bundle."""
    tables = Bundle(_source(reports), "icoads_r300").map_model(cdm_subset=[f"observations-{x}" for x in VARIABLES], now=NOW).tables
    out = None
    for name, df in tables.items():
        part = _plain(df).select(F.lit(name.removeprefix("observations-")).alias("kind"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("reports", sql="SELECT DISTINCT 'GDAC' AS source, 5 AS units, 85 AS observed_variable, CASE WHEN row_id % 2 = 0 THEN core_at ELSE -core_at END + 273.15 AS observation_value, CASE WHEN row_id % 2 = 0 THEN 1 ELSE -1 END AS secondary_value FROM reports WHERE core_at IS NOT NULL")
def map_gdac_at(reports):
    """Another model: values with a sign column, and the code table of signs."""
    rows = reports.select(F.when(F.col("row_id") % 2 == 0, "0").otherwise("1").alias("snTTT"), F.col("core_at").alias("TTT"))
    t = mapping.map_model(rows, "gdac", "observations-at", drop_duplicates=False)["observations-at"]
    return t.select(F.lit("GDAC").alias("source"), F.col("units").cast("int"), F.col("observed_variable").cast("int"), "observation_value", F.col("secondary_value").cast("int")).distinct()


# readers and writers

@query("reports", sql=f"SELECT report_id, round_even(latitude, 2) AS latitude, report_timestamp, application_area, platform_type FROM (SELECT DISTINCT {_table_sql('header', HEADER_SQL)} FROM {SOURCE_SQL}) WHERE report_id IS NOT NULL")
def tables_as_text(reports):
    """The header as text with the decimals of its mapping, written, found by its name and read back."""
    tables = mapping.map_model(_source(reports), "icoads_r300", "header", now=NOW)
    folder = shared_folder(reports)
    write(tables, folder, "tables", "icoads_r300", data_format="csv", prefix="x", suffix="2020")
    back = io.read_tables(reports.sparkSession, folder, "csv", prefix="x", suffix="2020")["header"]
    return _plain(back).select("report_id", "latitude", "report_timestamp", "application_area", "platform_type")


@query("reports", sql="SELECT DISTINCT 'ICOADS-300-' || c98_uid AS report_id, core_at + 273.15 AS observation_value FROM reports WHERE core_at IS NOT NULL AND nullif(c98_uid, '') IS NOT NULL")
def tables_as_parquet(reports):
    tables = mapping.map_model(_source(reports), "icoads_r300", "observations-at", now=NOW)
    folder = shared_folder(reports)
    io.write_tables(tables, folder, filename="mine.pq", col_subset=["report_id", "observation_value"])
    back = io.read_tables(reports.sparkSession, folder, suffix="mine", cdm_subset="observations-at")["observations-at"]
    return back.filter(F.col("report_id").isNotNull()).distinct()


@query("orders", sql="SELECT o_orderkey AS row_id, o_totalprice AS price, o_totalprice > 100000 AS m_price FROM orders")
def data_as_csv(orders):
    """Data, mask and their info file written and read back with types."""
    spark, folder = orders.sparkSession, shared_folder(orders)
    write(_priced(orders), folder, "data", data_format="csv", prefix="x")
    data, _ = io.read_data(spark, f"{folder}/x_data.csv", None, f"{folder}/x_info.json", "csv")
    mask = spark.read.option("header", True).schema("_row_id long, m_price boolean, m_status boolean").csv(f"{folder}/x_mask.csv")
    return data.join(mask, "_row_id").select(F.col("_row_id").alias("row_id"), "price", "m_price")


@query("lineitem", sql=f"SELECT row_id, l_returnflag FROM {MASKED}")
def data_as_parquet(lineitem):
    folder = shared_folder(lineitem)
    files = io.write_data(Bundle(_masked(lineitem)).data, None, folder, suffix="s", col_subset=["_row_id", "l_returnflag"])
    return io.read_data(lineitem.sparkSession, files[0])[0].select(F.col("_row_id").alias("row_id"), "l_returnflag")


@query("customer", sql="SELECT c_custkey AS row_id, c_acctbal FROM customer")
def data_as_feather(customer):
    folder = shared_folder(customer)
    import os

    os.makedirs(folder)
    files = io.write_data(customer.select(F.col("c_custkey").alias("row_id"), "c_acctbal"), None, folder, "feather")
    return io.read_data(customer.sparkSession, files[0], data_format="feather")[0]


@query("documents", sql="SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def lines_in_an_encoding(documents):
    """Lines of another character set, the first one of each file skipped."""
    folder = shared_folder(documents)
    line = F.concat(F.col("doc_id").cast("string"), F.lit("é"), "lang")
    # a head line per file
    documents.filter("lang IS NOT NULL").select(line.alias("line")).write.option("encoding", "iso-8859-1").option("header", True).option("quote", "").csv(folder)
    back = io.read_lines(documents.sparkSession, folder, "iso-8859-1", skiprows=1)
    parts = F.split("line", "é")
    return back.select(parts[0].cast("long").alias("doc_id"), parts[1].alias("lang"))


@query("lineitem", sql="SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def stream_of_lines(lineitem):
    """The parser on a stream of files: the same rows, appended batch by batch."""
    spark, folder = lineitem.sparkSession, shared_folder(lineitem)
    _rendered(lineitem).select("line").write.text(f"{folder}/in")
    parsed = parsing.read_cells(parsing.parse_lines(stream_lines(spark, f"{folder}/in"), ITEM_SCHEMA), ITEM_SCHEMA, ["_row_id"])
    parsed.select("_row_id", F.col("data.c1.FLAG").alias("flag")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("_row_id long, flag string").parquet(f"{folder}/out").dropDuplicates(["_row_id"])
    return back.filter("flag IS NOT NULL").groupBy("flag").agg(F.count("*").alias("n"))


@query("cdm_header", sql="SELECT row_id, coalesce(printf('%.2f', round_even(longitude, 2)), 'null') AS lon, coalesce(primary_station_id, 'null') AS station, CASE WHEN duplicates IS NULL THEN 'null' ELSE '{' || array_to_string([coalesce(x, 'null') for x in duplicates], ',') || '}' END AS duplicates, round_even(longitude, 2) AS back FROM cdm_header")
def text_of_numbers(cdm_header):
    text = text_conversion.to_str(F.col("longitude"), "numeric", 2)
    return cdm_header.select("row_id", text.alias("lon"), text_conversion.to_str(F.col("primary_station_id"), "varchar").alias("station"), text_conversion.to_str(F.col("duplicates"), "varchar[]").alias("duplicates"), text_conversion.from_str(text, "numeric").alias("back"))


@query("orders", sql="SELECT o_orderkey, o_custkey % 2 = 0 AS chosen FROM orders")
def index_lists(orders):
    """Ids of the selected and of the rejected rows."""
    yes, no = selection.index_lists(orders, F.col("o_custkey") % 2 == 0, "o_orderkey")
    return yes.withColumn("chosen", F.lit(True)).unionByName(no.withColumn("chosen", F.lit(False)))
