"""Registered queries and the SQL that gives the same rows, of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import references, spikes, timestamps, unit_resolution
from tidemark.session import table
from tidemark.sources import rejects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of the named tables under its own name."""

    def register(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("reports", "decks")
def p1_found(reports, decks):
    return timestamps.unplain_times(reports, decks)


@query("reports", "decks")
def p1_zone_histories(reports, decks):
    """Estimated offsets of the offices of unknown zone, month by month."""
    out = timestamps.zone_histories(timestamps.parse_times(reports), timestamps.zone_table(decks))
    return out.select(F.col("_t_key").alias("dck"), F.floor(F.col("period") / 12).alias("year"), (F.col("period") % 12 + 1).alias("month"), "offset_minutes", "readings", "violations")


@query("reports", "decks")
def p1_instants(reports, decks):
    """Every report's instant, with the estimated ones of offices of unknown zone."""
    return timestamps.instants(reports, decks)


@query("reports", "decks")
def p1_hidden_zones(reports, decks):
    """Zones of known offices hidden and estimated, half of the offices at a time: right instants by office."""
    return timestamps.hidden_zones(reports, decks)


P3_REFERENCES = """
refs AS (
  SELECT 'observations' AS ref_table, row_id, nullif(upper(trim(report_id)), '') AS ref_id, loaded_at, strftime(date_time, '%Y-%m') AS month, observation_value AS value FROM observations
  UNION ALL
  SELECT DISTINCT 'cdm_header', row_id, nullif(upper(trim(x)), ''), loaded_at, strftime(report_timestamp, '%Y-%m'), NULL::double
  FROM (SELECT row_id, loaded_at, report_timestamp, unnest(duplicates) AS x FROM cdm_header)),
heads AS (SELECT upper(trim(report_id)) AS id, min(loaded_at) AS first_load, max(loaded_at) AS last_load FROM cdm_header GROUP BY 1),
gone AS (SELECT upper(trim(report_id)) AS id, max(deleted_at) AS withdrawn FROM header_deletions GROUP BY 1),
orphans AS (
  SELECT * FROM (
    SELECT ref_table, row_id, ref_id, month, value,
      CASE WHEN g.id IS NOT NULL AND (h.id IS NULL OR h.last_load <= g.withdrawn) THEN 'deleted'
           WHEN h.id IS NULL THEN 'missing' WHEN h.first_load > r.loaded_at THEN 'late' END AS kind
    FROM refs r LEFT JOIN heads h ON h.id = r.ref_id LEFT JOIN gone g ON g.id = r.ref_id WHERE r.ref_id IS NOT NULL)
  WHERE kind IS NOT NULL)
"""


@query("observations", "cdm_header", "header_deletions", sql=f"WITH {P3_REFERENCES} SELECT ref_table, row_id, ref_id, kind FROM orphans")
def p3_found(observations, header, deletions):
    return references.found(observations, header, deletions)


@query("observations", "cdm_header", "header_deletions", sql=f"WITH {P3_REFERENCES} SELECT ref_table, month, kind, count(*) AS refs, count(DISTINCT ref_id) AS ids, count(value) AS n_values FROM orphans GROUP BY ALL")
def p3_by_period(observations, header, deletions):
    return references.by_period(observations, header, deletions)


def _text_unit(text: str) -> str:
    """SQL of the unit that a text names, by what its spellings have in common."""
    t = f"lower({text})"
    return f"""CASE dim
      WHEN 'T' THEN CASE WHEN {t} IN ('k', 'kelvin', 'deg k') THEN 'K' WHEN {t} LIKE '%f' OR {t} LIKE '%fahr%' THEN 'degF' WHEN regexp_matches({t}, 'tenth|0[.,]1|1/10|x 10|\\*10') THEN '0.1degC' ELSE 'degC' END
      WHEN 'P' THEN CASE WHEN {t} IN ('pa', 'pascal') THEN 'Pa' WHEN {t} LIKE 'in%' THEN 'inHg' WHEN {t} LIKE 'mm%' OR {t} LIKE 'torr' OR {t} LIKE 'millim%' THEN 'mmHg' WHEN regexp_matches({t}, 'tenth|0[.,]1|1/10|x 10|\\*10') THEN '0.1hPa' ELSE 'hPa' END
      WHEN 'S' THEN CASE WHEN {t} IN ('m/s', 'm s-1', 'mps', 'metres per second') THEN 'm/s' WHEN {t} LIKE 'kn%' OR {t} LIKE 'kt%' THEN 'kn' WHEN {t} LIKE 'k%' THEN 'km/h' ELSE 'mph' END END"""


def _common(value: str, unit: str) -> str:
    return f"""round(CASE {unit} WHEN 'K' THEN {value} WHEN 'degC' THEN {value} + 273.15 WHEN 'degF' THEN ({value} - 32) * 5.0::double / 9 + 273.15 WHEN '0.1degC' THEN {value} / 10 + 273.15
      WHEN 'Pa' THEN {value} WHEN 'hPa' THEN {value} * 100 WHEN '0.1hPa' THEN {value} / 10 * 100 WHEN 'inHg' THEN {value} * 3386.389 WHEN 'mmHg' THEN {value} * 133.322387415
      WHEN 'm/s' THEN {value} WHEN 'kn' THEN {value} * (1852.0::double / 3600) WHEN 'km/h' THEN {value} * (1 / 3.6::double) WHEN 'mph' THEN {value} * 0.44704 END::double, 6)"""


UNITS = f"""
el AS (SELECT imodel AS m, element AS e, any_value(units) AS eu, any_value(valid_min) AS lo, any_value(valid_max) AS hi FROM elements GROUP BY ALL),
read AS (
  SELECT *, CASE units WHEN 5 THEN 'K' WHEN 60 THEN 'degC' WHEN 32 THEN 'Pa' WHEN 530 THEN 'hPa' WHEN 731 THEN 'm/s' ELSE CASE WHEN units_text IS NOT NULL THEN {_text_unit('units_text')} ELSE {_text_unit('eu')} END END AS unit, {_text_unit('eu')} AS eunit
  FROM (SELECT *, CASE WHEN observed_variable IN (85, 36, 95) THEN 'T' WHEN observed_variable = 58 THEN 'P' WHEN observed_variable = 107 THEN 'S' END AS dim FROM observations) JOIN el ON imodel = m AND element = e
  WHERE dim IS NOT NULL AND observation_value IS NOT NULL)
"""


@query("observations", "elements", sql=f"WITH {UNITS} SELECT row_id, unit FROM read WHERE unit NOT IN ('K', 'Pa', 'm/s')")
def p4_found(observations, elements):
    return unit_resolution.found(observations, elements)


@query("observations", "elements", sql=f"WITH {UNITS} SELECT row_id, observed_variable, unit, {_common('observation_value', 'unit')} AS common_value, 'stated' AS basis FROM read")
def p4_common_values(observations, elements):
    """Every value in K, Pa or m/s, with the unit it was in and how that is known."""
    out = unit_resolution.resolve_units(observations, elements).filter(F.col("_u_unit").isNotNull())
    return out.select("row_id", "observed_variable", F.col("_u_unit").alias("unit"), F.col("_u_value").alias("common_value"), F.col("_u_basis").alias("basis"))


# fields of delimited lines, fields of fixed-width ones by the lengths of sections and elements, then the reasons in order
P5 = """WITH ln AS (SELECT line_id, l.imodel, translate(coalesce(line, ''), chr(10) || chr(13), '  ') AS line, any_value(field_layout) AS layout, any_value(delimiter) AS d FROM raw_lines l JOIN schema_header h ON h.imodel = l.imodel GROUP BY ALL),
dl AS (SELECT line_id, imodel, line, d, replace('(?:^|D)("(?:[^"]|"")*"|[^"D]*)', 'D', CASE d WHEN '|' THEN '\\|' ELSE d END) AS cell FROM ln WHERE layout = 'delimited'),
dc AS (SELECT line_id, imodel, [CASE WHEN x LIKE '"%"' THEN trim(replace(substr(x, 2, length(x) - 2), '""', '"')) ELSE trim(x) END FOR x IN regexp_extract_all(line, cell, 1)] AS cells,
  NOT regexp_full_match(line, replace('(?:"(?:[^"]|"")*"|[^"D]*)(?:D(?:"(?:[^"]|"")*"|[^"D]*))*', 'D', CASE d WHEN '|' THEN '\\|' ELSE d END)) AS badly_quoted, length(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g'), d, '')) + 1 AS n_fields FROM dl),
wd AS (SELECT imodel, section, section_no, coalesce(sentinel, '') AS sentinel, parsing_order LIKE '%{"o": ["' || section || '"]}%' AS optional, (SELECT sum(field_length) FROM elements e WHERE e.imodel = h.imodel AND e.section = h.section) AS width, count(*) OVER (PARTITION BY imodel) AS k FROM schema_header h WHERE field_layout = 'fixed_width'),
f0 AS (SELECT line_id, ln.imodel, line, s1.width AS a1, s1.k AS k, s2.sentinel AS t2, s2.width AS w2, s3.sentinel AS t3, s3.width AS w3 FROM ln JOIN wd s1 ON s1.imodel = ln.imodel AND s1.section_no = (SELECT min(section_no) FROM wd w WHERE w.imodel = ln.imodel) LEFT JOIN wd s2 ON s2.imodel = ln.imodel AND s2.optional LEFT JOIN wd s3 ON s3.imodel = ln.imodel AND NOT s3.optional AND s3.section <> s1.section WHERE layout = 'fixed_width'),
f1 AS (SELECT *, length(line) AS n, coalesce(starts_with(substr(line, a1::int + 1), t2), false) AS has2 FROM f0),
f2 AS (SELECT *, a1 + CASE WHEN has2 THEN w2 ELSE 0 END AS a2 FROM f1),
fx AS (SELECT *, CASE WHEN n < a1 THEN 'length' WHEN n < a2 THEN 'length' WHEN t3 IS NOT NULL AND NOT starts_with(substr(line, a2::int + 1), t3) THEN 'section' WHEN n < a2 + coalesce(w3, 0) THEN 'length' WHEN n > a2 + coalesce(w3, 0) THEN CASE WHEN k > 1 THEN 'section' ELSE 'length' END END AS cut FROM f2),
el AS (SELECT *, sum(field_length) OVER (PARTITION BY imodel, section ORDER BY elem_no) - field_length AS start, row_number() OVER (PARTITION BY imodel ORDER BY elem_no) AS i, count(*) OVER (PARTITION BY imodel) AS n_elements FROM elements),
vs AS (SELECT line_id, e.*, cells[i] AS cell FROM dc JOIN el e ON e.imodel = dc.imodel WHERE NOT badly_quoted AND n_fields = n_elements
  UNION ALL SELECT line_id, e.*, trim(substr(line, (CASE WHEN w.sentinel = '' THEN 0 WHEN w.optional THEN a1 ELSE a2 END + start + 1)::int, field_length::int)) FROM fx JOIN el e ON e.imodel = fx.imodel JOIN wd w ON w.imodel = e.imodel AND w.section = e.section WHERE cut IS NULL AND (NOT w.optional OR has2)),
ck AS (SELECT *, cell <> '' AND cell <> coalesce(missing_value, '') AS filled, CASE column_type WHEN 'int' THEN regexp_full_match(cell, '[+-]?[0-9]+') WHEN 'float' THEN regexp_full_match(cell, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') END AS number FROM vs),
bd AS (SELECT line_id, bool_or(filled AND (NOT coalesce(number, true) OR CASE WHEN number THEN round(TRY_CAST(cell AS double) * coalesce(scale, 1), 9) NOT BETWEEN coalesce(valid_min, -1e300) AND coalesce(valid_max, 1e300) ELSE false END OR (codes IS NOT NULL AND NOT list_contains(string_split(codes, ','), cell)))) AS bad FROM ck GROUP BY 1)
"""


@query("raw_lines", "elements", "schema_header", sql=P5 + """SELECT line_id, reason FROM (SELECT line_id, CASE WHEN badly_quoted THEN 'quoting' WHEN n_fields <> (SELECT count(*) FROM elements e WHERE e.imodel = dc.imodel) THEN 'columns' WHEN bad THEN 'value' END AS reason FROM dc LEFT JOIN bd USING (line_id)
  UNION ALL SELECT line_id, coalesce(cut, CASE WHEN bad THEN 'value' END) FROM fx LEFT JOIN bd USING (line_id)) WHERE reason IS NOT NULL""")
def p5_found(lines, elements, schema_header):
    return rejects.found(lines, elements, schema_header)


@query("raw_lines", "elements", "schema_header", sql=P5 + """SELECT line_id, max(CASE WHEN element = 'marob_id' AND filled THEN cell::bigint END) AS marob_id, max(CASE WHEN element = 'kennung' AND filled THEN cell END) AS kennung, max(CASE WHEN element = 'geogr_laenge' AND filled THEN cell::double END) AS geogr_laenge, max(CASE WHEN element = 'geogr_breite' AND filled THEN cell::double END) AS geogr_breite,
  max(CASE WHEN element = 'messzeit' AND filled THEN cell END) AS messzeit, max(CASE WHEN element = 'lufttemperatur' AND filled THEN cell::double END) AS lufttemperatur, max(CASE WHEN element = 'taupunkttemperatur' AND filled THEN cell::double END) AS taupunkttemperatur, max(CASE WHEN element = 'wassertemperatur' AND filled THEN cell::double END) AS wassertemperatur, max(CASE WHEN element = 'luftdruck_stationshoehe' AND filled THEN cell::double END) AS luftdruck_stationshoehe,
  max(CASE WHEN element = 'windrichtung' AND filled THEN cell::bigint END) AS windrichtung, max(CASE WHEN element = 'windgeschwindigkeit' AND filled THEN cell::double END) AS windgeschwindigkeit, max(CASE WHEN element = 'bemerkung' AND filled THEN cell END) AS bemerkung FROM ck JOIN bd USING (line_id) WHERE NOT bad AND imodel = 'marob' GROUP BY line_id""")
def p5_marob_fields(lines, elements, schema_header):
    """The valid lines of one delimited schema as typed columns."""
    return rejects.fields_of(rejects.load_lines(lines, elements, schema_header), elements, schema_header, "marob")


P6 = f"""WITH {UNITS},
rd AS (SELECT row_id, sensor_id, observed_variable AS ov, date_time, {_common('observation_value', 'unit')} AS v, {_common('lo', 'eunit')} AS vmin, {_common('hi', 'eunit')} AS vmax
  FROM read WHERE sensor_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY observation_id, sensor_id, observed_variable ORDER BY row_id) = 1),
nb AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, count(*) OVER (PARTITION BY sensor_id, ov) AS n FROM rd WINDOW w AS (PARTITION BY sensor_id, ov ORDER BY date_time, row_id)),
md AS (SELECT sensor_id AS s, ov AS o, median(round(abs(v - b), 6)) AS m FROM nb WHERE b IS NOT NULL GROUP BY ALL),
rn AS (SELECT *, sum(CASE WHEN v = b THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id, ov ORDER BY date_time, row_id) AS run FROM nb),
ln AS (SELECT *, count(*) OVER (PARTITION BY sensor_id, ov, run) AS len FROM rn)
SELECT row_id, kind FROM (SELECT row_id, CASE WHEN v < vmin OR v > vmax THEN 'impossible' WHEN n >= 24 AND len >= 10 THEN 'stuck'
  WHEN n >= 24 AND ((v > b AND v > a) OR (v < b AND v < a)) AND round(least(abs(v - b), abs(v - a)), 6) > round(10 * m, 6) THEN 'spike' END AS kind
  FROM ln LEFT JOIN md ON s = sensor_id AND o = ov) WHERE kind IS NOT NULL"""


@query("observations", "elements", sql=P6)
def p6_found(observations, elements):
    return spikes.flagged(observations, elements)


ESD = """
ls AS (SELECT sensor_id AS s, ov, row_id, rd.date_time AS t, v FROM rd),
w9 AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, median(v) OVER (PARTITION BY s, ov ORDER BY t NULLS FIRST, row_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS trend,
  count(*) OVER (PARTITION BY s, ov) AS n, coalesce(hour(t), -1) AS h FROM ls WINDOW w AS (PARTITION BY s, ov ORDER BY t NULLS FIRST, row_id)),
rs AS (SELECT *, CASE WHEN v > greatest(a, b) THEN v - greatest(a, b) WHEN v < least(a, b) THEN least(a, b) - v ELSE 0 END * (a IS NOT NULL AND b IS NOT NULL)::int AS fast, round(v - trend, 6) AS slow, round(abs(v - b), 6) AS change FROM w9),
sn AS (SELECT s AS s2, ov AS ov2, h AS h2, quantile_disc(slow, 0.5) AS season FROM rs GROUP BY ALL HAVING count(*) >= 10),
lf AS (SELECT rs.*, round(abs(slow - coalesce(season, 0)), 6) AS rest FROM rs LEFT JOIN sn ON s = s2 AND ov = ov2 AND h = h2),
sc AS (SELECT s AS s3, ov AS ov3, CASE WHEN quantile_disc(rest, 0.5) > 0 THEN quantile_disc(rest, 0.5) * 1.4826 ELSE avg(rest) * 1.2533 END AS slow_scale, median(change) * (1.4826 / sqrt(2)) AS fast_scale FROM lf GROUP BY ALL),
dv AS (SELECT *, CASE WHEN rest = 0 THEN 0 WHEN slow_scale > 0 THEN rest / slow_scale ELSE 1e300 END AS slow_x, CASE WHEN round(fast, 6) = 0 THEN 0 WHEN fast_scale > 0 THEN round(fast, 6) / fast_scale ELSE 1e300 END AS fast_x
  FROM lf JOIN sc ON s = s3 AND ov = ov3 WHERE n >= 24),
ev AS (SELECT row_id, s, ov, n, 'slow' AS kind, slow_x AS x0 FROM dv UNION ALL SELECT row_id, s, ov, n, 'fast', fast_x FROM dv),
e3 AS (SELECT *, CASE WHEN x0 >= 1e300 THEN x0 ELSE round_even(x0 / pow(10, floor(log10(x0)) - 2), 0) * pow(10, floor(log10(x0)) - 2) END AS x FROM ev WHERE x0 > 0),
rk AS (SELECT *, (n - (rank() OVER (PARTITION BY s, ov, kind ORDER BY x DESC) - 1))::double AS m FROM e3 WHERE x >= 2),
zs AS (SELECT *, sqrt(-2 * ln(0.025 / m)) AS q, greatest(m - 2, 1) AS f FROM rk WHERE m * 2 >= n),
zt AS (SELECT *, q - (2.515517 + 0.802853 * q + 0.010328 * q * q) / (1 + 1.432788 * q + 0.189269 * q * q + 0.001308 * q * q * q) AS z FROM zs),
tt AS (SELECT *, z + (z * z * z + z) / (4 * f) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * f * f) AS t FROM zt),
lm AS (SELECT s AS s4, ov AS ov4, kind AS k4, min(x) AS bound FROM tt WHERE x > (m - 1) * t / sqrt((f + t * t) * m) GROUP BY ALL)
SELECT row_id, bool_or(kind = 'slow') AS slow, bool_or(kind = 'fast') AS fast FROM e3 JOIN lm ON s = s4 AND ov = ov4 AND kind = k4 WHERE x >= bound GROUP BY row_id"""


@query("observations", "elements", sql=P6[: P6.index("nb AS")] + ESD)
def p6_outliers(observations, elements):
    """The readings whose remainder from trend and season exceeds the ESD limit of their series."""
    return spikes.outliers(observations, elements)


@query("observations", "elements")
def p4_hidden_units(observations, elements):
    """Each variable's units hidden in all rows in turn and solved by identities: solutions and right ones by true unit."""
    return unit_resolution.hidden_units(observations, elements)
