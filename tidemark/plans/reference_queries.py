"""Queries that show each operator of the engine over the whole given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.bundle import Bundle
from tidemark.functions import text_conversion
from tidemark.functions.transforms import REGISTRY as T
from tidemark.operators import corrections, mapping, parsing, selection
from tidemark.plans import specs
from tidemark.plans.catalogue import query
from tidemark.plans.specs import Element, Schema, Section

LINE_KEY = "l_orderkey * 10 + l_linenumber"


def _masked(lineitem: DataFrame) -> DataFrame:
    quantity, discount = F.col("l_quantity").between(5, 40), F.col("l_discount") <= 0.05
    return lineitem.select(F.expr(LINE_KEY).alias("_row_id"), F.struct("l_returnflag", "l_quantity").alias("data"), F.struct(quantity.alias("a"), F.when(F.col("l_tax") > 0.01, discount).alias("b")).alias("mask"))


MASKED = f"(SELECT {LINE_KEY} AS row_id, l_returnflag, l_quantity, l_quantity BETWEEN 5 AND 40 AS a, CASE WHEN l_tax > 0.01 THEN l_discount <= 0.05 END AS b FROM lineitem)"


@query("lineitem", sql=f"SELECT row_id, l_returnflag, l_quantity FROM {MASKED} WHERE coalesce(a, true) AND coalesce(b, true)")
def select_all_true(lineitem):
    b = Bundle(_masked(lineitem)).select_where_all_true()
    return b.df.select(F.col("_row_id").alias("row_id"), "data.*")


@query("lineitem", sql=f"SELECT row_id, l_returnflag, l_quantity FROM {MASKED} WHERE NOT (coalesce(a, false) OR coalesce(b, false))")
def select_all_false(lineitem):
    b = Bundle(_masked(lineitem)).select_where_all_false()
    return b.df.select(F.col("_row_id").alias("row_id"), "data.*")


@query("lineitem", sql=f"SELECT row_id, l_returnflag, l_quantity FROM {MASKED} WHERE NOT (coalesce(a, true) AND coalesce(b, true))")
def split_rejected(lineitem):
    b = Bundle(_masked(lineitem)).split_by_boolean(True)[1]
    return b.df.select(F.col("_row_id").alias("row_id"), "data.*")


@query("orders", sql="SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def select_entries(orders):
    return selection.split(orders, selection.entries("o_orderpriority", ["1-URGENT", "2-HIGH"]))[0].select("o_orderkey", "o_orderpriority")


@query("orders", "customer", sql="SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def select_index_inverse(orders, customer):
    """Orders without those of a long index of customers, by an anti join; orders without a customer stay."""
    index = customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return selection.split_by_index(orders, index, inverse=True, row_id="o_custkey")[0].select("o_orderkey", "o_custkey")


@query("orders", sql="SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1995")
def select_years(orders):
    return parsing.select_years(orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y")), "y", 1993, 1995)


@query("lineitem", sql="SELECT 'l_returnflag' AS \"column\", coalesce(l_returnflag, 'nan') AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', coalesce(l_linestatus, 'nan'), count(*) FROM lineitem GROUP BY ALL")
def count_by_cat(lineitem):
    return selection.count_by_cat(lineitem, ["l_returnflag", "l_linestatus"])


@query("orders", "customer", sql="SELECT o_orderkey, c_mktsegment AS o_orderstatus FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def replace_columns(orders, customer):
    return selection.replace_columns(orders, customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey", {"o_orderstatus": "c_mktsegment"}).select("o_orderkey", "o_orderstatus")


@query("orders", sql="SELECT coalesce(a.o_orderkey, b.o_orderkey) AS report_id, a.o_totalprice AS a_price, b.o_orderstatus AS b_status FROM (SELECT * FROM orders WHERE o_totalprice > 100000) a FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') b ON a.o_orderkey = b.o_orderkey")
def tables_outer(orders):
    a = orders.filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("report_id"), F.col("o_totalprice").alias("price"))
    b = orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("status"))
    out = selection.outer_tables({"a": a, "b": b})
    return out.select("report_id", F.col("`a:price`").alias("a_price"), F.col("`b:status`").alias("b_status"))


@query("lineitem", sql=f"SELECT {LINE_KEY} AS k, l_quantity, NULL::double AS l_tax FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT {LINE_KEY}, NULL, l_tax FROM lineitem WHERE l_quantity > 45")
def stack_v(lineitem):
    k = F.expr(LINE_KEY).alias("k")
    return selection.stack_v([lineitem.filter("l_quantity < 10").select(k, "l_quantity"), lineitem.filter("l_quantity > 45").select(k, "l_tax")])


@query("lineitem", sql=f"SELECT coalesce(a.k, b.k) AS k, a.l_quantity, b.l_tax FROM (SELECT {LINE_KEY} AS k, l_quantity FROM lineitem WHERE l_quantity < 30) a FULL JOIN (SELECT {LINE_KEY} AS k, l_tax FROM lineitem WHERE l_quantity > 20) b ON a.k = b.k")
def stack_h(lineitem):
    k = F.expr(LINE_KEY).alias("k")
    return selection.stack_h(lineitem.filter("l_quantity < 30").select(k, "l_quantity"), lineitem.filter("l_quantity > 20").select(k, "l_tax"), "k")


@query("lineitem", sql="SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def drop_duplicates(lineitem):
    return selection.distinct_rows(lineitem.select("l_returnflag", "l_linestatus", "l_tax"))


@query("events", sql="SELECT event_id, coalesce(r, -1) AS code FROM events LEFT JOIN (SELECT event_type AS t, dense_rank() OVER (ORDER BY m) - 1 AS r FROM (SELECT event_type, min(event_id) AS m FROM events WHERE event_type IS NOT NULL GROUP BY 1)) ON t = event_type")
def factorize(events):
    return selection.factorize(events.select("event_id", "event_type"), "event_type", "code", "event_id").select("event_id", F.col("code").cast("long").alias("code"))


@query("lineitem", sql=f"SELECT {LINE_KEY} AS k, row_number() OVER (ORDER BY {LINE_KEY}) - 1 AS i FROM lineitem WHERE l_quantity > 30")
def reset_index(lineitem):
    rows = lineitem.filter("l_quantity > 30").select(F.expr(LINE_KEY).alias("_row_id"), F.expr(LINE_KEY).alias("k"))
    return selection.renumber(rows).select("k", F.col("_row_id").alias("i"))


SPEED = {"[1750,1994]": {"0": 0.0, "1": 1.02888, "2": 2.5722}, "[1995,'yyyy']": {"0": 0.0, "1": 1.54332, "2": 4.11552}}


@query("orders", sql="SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1750 AND 1994 THEN CASE o_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.02888 WHEN 2 THEN 2.5722 END ELSE CASE o_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.54332 WHEN 2 THEN 4.11552 END END::double AS speed FROM orders")
def code_table_ranges(orders):
    return orders.select("o_orderkey", mapping.lookup(specs.expand_ranges(SPEED), [F.year("o_orderdate"), F.col("o_custkey") % 4]).alias("speed"))


@query("customer", sql="SELECT c_custkey, CASE c_nationkey WHEN 4 THEN 33 WHEN 6 THEN 4 WHEN 7 THEN 5 WHEN 8 THEN 6 WHEN 9 THEN 32 WHEN 10 THEN 35 WHEN 11 THEN 34 WHEN 12 THEN 44 WHEN 13 THEN 43 WHEN 14 THEN 43 WHEN 15 THEN 3 WHEN 16 THEN 38 WHEN 17 THEN 46 WHEN 18 THEN 36 WHEN 19 THEN 40 WHEN 20 THEN 42 WHEN 21 THEN 45 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 2 END AS platform FROM customer")
def code_table_flat(customer):
    return customer.select("c_custkey", mapping.lookup(specs.code_table("platform_type", "icoads_r300"), [F.col("c_nationkey")]).alias("platform"))


ITEM_SCHEMA = Schema((
    Section("core", (Element("ORDER", 8, "int", valid_min=1, valid_max=50000), Element("LINE", 2, "int"), Element("QTY", 4, "float", scale=0.1, valid_min=0, valid_max=4)), None, 14),
    Section("c1", (Element("ATTI", 3, "str"), Element("FLAG", 1, "key", codes=("A", "N")), Element("DAY", 8, "datetime")), " 17", 12),
    Section("c2", (Element("ATTI", 2, "str"), Element("KEY", 6, "str", encoding="base36")), "98", 8),
), "utf-8")
RENDERED = "lpad(l_orderkey::varchar, 8, ' ') || lpad(l_linenumber::varchar, 2, ' ') || lpad(l_quantity::int::varchar, 4, ' ') || CASE WHEN l_returnflag <> 'R' THEN ' 17' || l_returnflag || strftime(l_shipdate, '%Y%m%d') ELSE '' END || '98' || lpad(l_partkey::varchar, 6, '0')"


def _rendered(lineitem: DataFrame) -> DataFrame:
    """Fixed-width lines with an optional section, rendered from the rows."""
    text = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, " "), F.lpad(F.col("l_linenumber").cast("string"), 2, " "), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, " "), F.when(F.col("l_returnflag") != "R", F.concat(F.lit(" 17"), "l_returnflag", F.date_format("l_shipdate", "yyyyMMdd"))).otherwise(""), F.lit("98"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    return lineitem.select(F.expr(LINE_KEY).alias("_row_id"), text.alias("line"))


def _parsed(lineitem: DataFrame) -> DataFrame:
    lines = _rendered(lineitem)
    return parsing.read_cells(parsing.parse_lines(lines, ITEM_SCHEMA), ITEM_SCHEMA, ["_row_id"], decode=False)


@query("lineitem", sql=f"SELECT {LINE_KEY} AS row_id, l_orderkey AS o, l_linenumber::bigint AS l, round(l_quantity * 0.1, 1) AS q, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag, CASE WHEN l_returnflag <> 'R' THEN date_trunc('day', l_shipdate) END AS day, lpad(l_partkey::varchar, 6, '0') AS key FROM lineitem")
def parse_fixed_width(lineitem):
    d = _parsed(lineitem)
    return d.select(F.col("_row_id").alias("row_id"), F.col("data.core.ORDER").alias("o"), F.col("data.core.LINE").alias("l"), F.col("data.core.QTY").alias("q"), F.col("data.c1.FLAG").alias("flag"), F.col("data.c1.DAY").alias("day"), F.col("data.c2.KEY").alias("key"))


@query("lineitem", sql=f"SELECT {LINE_KEY} AS row_id, l_orderkey BETWEEN 1 AND 50000 AS m_order, l_quantity <= 40 AS m_qty, l_returnflag <> 'R' AS m_flag, l_returnflag <> 'R' AS m_day, true AS m_key FROM lineitem")
def validity_mask(lineitem):
    d = _parsed(lineitem)
    return d.select(F.col("_row_id").alias("row_id"), F.col("mask.core.ORDER").alias("m_order"), F.col("mask.core.QTY").alias("m_qty"), F.col("mask.c1.FLAG").alias("m_flag"), F.col("mask.c1.DAY").alias("m_day"), F.col("mask.c2.KEY").alias("m_key"))


@query("lineitem", sql="SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 1 AND 50000 AND l_quantity <= 40 AND l_returnflag <> 'R' GROUP BY 1")
def parse_validate_select_count(lineitem):
    """Report lines, parsed, validated, selected where all is valid, and counted."""
    b = Bundle(_parsed(lineitem)).select_where_all_true()
    return b.df.groupBy(F.col("data.c1.FLAG").alias("flag")).agg(F.count("*").alias("n"))


@query("lineitem", sql="SELECT l_orderkey AS order_key, l_linenumber::bigint AS line, l_returnflag AS flag, l_quantity AS q FROM lineitem")
def parse_delimited(lineitem):
    s = Schema((Section("flat", (Element("order_key", None, "int"), Element("line", None, "int"), Element("flag", None, "str"), Element("q", None, "float")), None, None, "|", "delimited"),), "utf-8", True)
    lines = lineitem.select(F.expr(LINE_KEY).alias("_row_id"), F.concat_ws("|", "l_orderkey", "l_linenumber", F.concat(F.lit('"'), "l_returnflag", F.lit('"')), "l_quantity").alias("line"))
    return parsing.read_cells(parsing.parse_lines(lines, s), s, ["_row_id"]).select("data.*")


@query("orders", sql="SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def base36(orders):
    text = orders.select("o_orderkey", F.conv(F.col("o_orderkey").cast("string"), 10, 36).alias("t"))
    return text.select("o_orderkey", F.expr(parsing.base36_sql("t")).cast("long").alias("decoded"))


@query("lineitem", sql=f"SELECT {LINE_KEY} AS k, (l_quantity::int * 0.1::decimal(4,2) + 5)::double AS v FROM lineitem")
def to_numeric(lineitem):
    rows = lineitem.select(F.expr(LINE_KEY).alias("k"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 5, " ").alias("t"))
    return rows.select("k", F.expr(parsing.number_sql("t", 0.1, 5)).alias("v"))


@query("lineitem", sql=f"SELECT {LINE_KEY} AS k, l_quantity + 273.15 AS kelvin, l_quantity * 100 AS pa, l_quantity * (1852.0::double / 3600) AS kn, l_quantity * (1 / 3.6::double) AS kmh, -l_quantity AS opp, CASE WHEN l_linenumber = 5 THEN 0 WHEN l_linenumber = 6 THEN NULL ELSE l_linenumber END AS wd, coalesce(CASE WHEN l_tax > 0.04 THEN l_tax END, l_discount) AS sel, CASE WHEN l_linenumber IN (3, 5) THEN -l_quantity ELSE l_quantity END AS lat FROM lineitem")
def transforms_numeric(lineitem):
    q = F.col("l_quantity")
    wind = F.when(F.col("l_linenumber") == 5, 361).when(F.col("l_linenumber") == 6, 362).otherwise(F.col("l_linenumber"))
    return lineitem.select(F.expr(LINE_KEY).alias("k"), T["temperature_celsius_to_kelvin"](q).alias("kelvin"), T["pressue_hpa_in_pa"](q).alias("pa"), T["velocity_kn_in_ms"](q).alias("kn"), T["velocity_kmh_in_ms"](q).alias("kmh"), T["float_opposite"](q).alias("opp"), T["icoads_wd_conversion"](wind).alias("wd"), T["select_column"](F.when(F.col("l_tax") > 0.04, F.col("l_tax")), F.col("l_discount")).alias("sel"), T["gdac_latitude"](F.col("l_linenumber"), q).alias("lat"))


@query("customer", sql="SELECT c_custkey, (CASE WHEN c_acctbal / 25 > 180 THEN -180 + (c_acctbal / 25) % 180 ELSE c_acctbal / 25 END)::float::double AS lon FROM customer")
def longitude(customer):
    return customer.select("c_custkey", T["longitude_360to180"](F.col("c_acctbal") / 25).alias("lon"))


@query("customer", sql="SELECT c_custkey, CASE WHEN d IS NULL THEN NULL ELSE greatest(1.0, round_even(d * sqrt(12321.0 * (1 + cos(radians(c_acctbal / 120)) * cos(radians(c_acctbal / 120)))), 0)) END::double AS accuracy FROM (SELECT *, CASE c_nationkey % 6 WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 WHEN 4 THEN 1.0::double / 60 WHEN 5 THEN 1.0::double / 3600 END::double AS d FROM customer)")
def location_accuracy(customer):
    return customer.select("c_custkey", T["location_accuracy"]((F.col("c_nationkey") % 6).cast("string"), F.col("c_acctbal") / 120).alias("accuracy"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey <> 0 THEN 'ORD-' || o_orderkey || '-X' END AS added, 'S-' || lpad((o_custkey % 1000)::varchar, 4, '0') || '-' || o_orderstatus AS joined FROM orders")
def string_transforms(orders):
    return orders.select("o_orderkey", T["string_add"](F.col("o_orderkey"), prepend="ORD", append="X", separator="-").alias("added"), T["string_join_add"](F.col("o_custkey") % 1000, F.col("o_orderstatus"), prepend="S", separator="-", zfill_col=[0], zfill=[4]).alias("joined"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 28 OR month(o_orderdate) <> 1 THEN date_trunc('day', o_orderdate) + to_minutes((o_custkey % 96 * 15)::int) ELSE NULL END AS ts FROM orders")
def datetime_imma1(orders):
    """Years, months, days and decimal hours; dates moved to 30 or 31 February do not exist."""
    month = F.when((F.dayofmonth("o_orderdate") > 29) & (F.month("o_orderdate") == 1) | (F.dayofmonth("o_orderdate") == 29) & (F.month("o_orderdate") == 1), F.lit(13)).otherwise(F.month("o_orderdate"))
    return orders.select("o_orderkey", T["datetime_imma1"](F.year("o_orderdate"), month, F.dayofmonth("o_orderdate"), (F.col("o_custkey") % 96) / 4).alias("ts"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN old THEN year(b) ELSE y END::bigint AS core_yr, CASE WHEN old THEN month(b) ELSE m END::bigint AS core_mo, CASE WHEN old THEN day(b) ELSE d END::bigint AS core_dy, (o_custkey % 2 * 6)::double AS core_hr FROM (SELECT *, TRY(make_date(y, m, d)) - 1 AS b, o_custkey % 2 = 0 AND y <= 1899 AS old FROM (SELECT *, year(o_orderdate) - 96 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders))")
def correct_datetime(orders):
    """Midnights up to 1899 are those of the day before; of a date that does not exist (29 February 1900) they are null."""
    rows = orders.select("o_orderkey", (F.year("o_orderdate") - 96).cast("long").alias("core_yr"), F.month("o_orderdate").cast("long").alias("core_mo"), F.dayofmonth("o_orderdate").cast("long").alias("core_dy"), (F.col("o_custkey") % 2 * 6).cast("double").alias("core_hr"))
    return corrections.correct_datetime(rows, "icoads_r300_d201")


@query("reports", sql="SELECT row_id, CASE WHEN regexp_full_match(trim(core_id), '[0-9]{5}') AND c1_sid = '29' AND c1_pt = '5' THEN '6' ELSE c1_pt END AS c1_pt FROM reports")
def correct_pt_892(reports):
    return corrections.correct_pt(reports, "icoads_r300_d892").select("row_id", "c1_pt")


@query("reports", sql="SELECT row_id, coalesce(c1_pt, '5') AS c1_pt FROM reports")
def correct_pt_fill(reports):
    return corrections.correct_pt(reports, "icoads_r300_d128").select("row_id", "c1_pt")


@query("reports", sql="SELECT row_id, CASE WHEN core_id IS NULL THEN true ELSE regexp_matches(core_id, '^(?:^[0-9]{5}$|^$)') END AS valid FROM reports")
def validate_id(reports):
    return reports.select("row_id", corrections.valid_id(F.col("core_id"), "icoads_r300_d201").alias("valid"))


MAPPED = """SELECT row_id, 'ICOADS-300-' || c98_uid AS report_id, CASE c1_pt WHEN '4' THEN 33 WHEN '6' THEN 4 WHEN '7' THEN 5 WHEN '8' THEN 6 WHEN '9' THEN 32 WHEN '10' THEN 35 WHEN '11' THEN 34 WHEN '12' THEN 44 WHEN '13' THEN 43 WHEN '14' THEN 43 WHEN '15' THEN 3 WHEN '16' THEN 38 WHEN '17' THEN 46 WHEN '18' THEN 36 WHEN '19' THEN 40 WHEN '20' THEN 42 WHEN '21' THEN 45 WHEN '31' THEN 43
  ELSE CASE WHEN c1_pt IN ('0', '1', '2', '3', '5') THEN 2 END END::bigint AS platform_type, CASE WHEN c1_pt = '7' THEN 69 END::bigint AS platform_sub_type, core_id AS primary_station_id, 8 AS primary_station_id_scheme, core_lat AS latitude, 2 AS report_quality_default, 4::bigint AS duplicate_status FROM reports"""


def _source(reports: DataFrame) -> DataFrame:
    names = {"core_id": "core.ID", "core_lat": "core.LAT", "core_at": "core.AT", "core_sst": "core.SST", "core_slp": "core.SLP", "c1_pt": "c1.PT", "c98_uid": "c98.UID", "c1_sid": "c1.SID", "c1_dck": "c1.DCK"}
    return reports.select("row_id", *[F.col(k).alias(v) for k, v in names.items()])


@query("reports", sql=MAPPED.replace("2 AS report_quality_default, ", "").replace("8 AS primary_station_id_scheme, ", ""))
def map_header(reports):
    h = mapping.map_model(_source(reports), "icoads_r300", "header", drop_duplicates=False, keep=["row_id"])["header"]
    return h.select("row_id", "report_id", "platform_type", "platform_sub_type", "primary_station_id", "latitude", "duplicate_status")


@query("reports", sql="SELECT DISTINCT 'ICOADS-300-' || c98_uid || '-AT' AS observation_id, core_at + 273.15 AS observation_value, 85::bigint AS observed_variable, 5::bigint AS units, core_at AS original_value FROM reports WHERE core_at IS NOT NULL")
def map_observations_at(reports):
    t = mapping.map_model(_source(reports), "icoads_r300", "observations-at", drop_duplicates=False)["observations-at"]
    return t.select("observation_id", "observation_value", "observed_variable", "units", "original_value").distinct()


@query("reports", sql="SELECT DISTINCT 'ICOADS-300-' || c98_uid || '-SLP' AS observation_id, core_slp * 100 AS observation_value FROM reports WHERE core_slp IS NOT NULL")
def map_observations_slp(reports):
    t = mapping.map_model(_source(reports), "icoads_r300", "observations-slp")["observations-slp"]
    return t.select("observation_id", "observation_value").distinct()


@query("cdm_header", sql="SELECT row_id, coalesce('{' || array_to_string([coalesce(x::varchar, 'null') for x in application_area], ',') || '}', 'null') AS areas, coalesce(strftime(report_timestamp, '%Y-%m-%d %H:%M:%S'), 'null') AS ts, coalesce(location_quality::varchar, 'null') AS q FROM cdm_header")
def to_text(cdm_header):
    return cdm_header.select("row_id", text_conversion.to_str(F.col("application_area"), "int[]").alias("areas"), text_conversion.to_str(F.col("report_timestamp"), "timestamp").alias("ts"), text_conversion.to_str(F.col("location_quality"), "int").alias("q"))


@query("cdm_header", sql="SELECT row_id, len(application_area)::bigint AS n_areas, report_timestamp, location_quality::bigint AS location_quality FROM cdm_header")
def text_round_trip(cdm_header):
    kinds = {"application_area": "int[]", "report_timestamp": "timestamp", "location_quality": "int"}
    text = cdm_header.select("row_id", *[text_conversion.to_str(F.col(c), k).alias(c) for c, k in kinds.items()])
    back = text.select("row_id", *[text_conversion.from_str(F.col(c), k).alias(c) for c, k in kinds.items()])
    return back.select("row_id", F.size("application_area").cast("long").alias("n_areas"), "report_timestamp", "location_quality")
