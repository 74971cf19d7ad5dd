"""Registered queries and their SQL, of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_duplicates, packing, residue, survivors, token_ids
from tidemark.session import table

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


def _near_sql() -> str:
    """Two rows that differ in at most three of 15 fields agree wholly on two of five groups of them."""
    groups = [near_duplicates.REPORT_FIELDS[i::5] for i in range(5)]
    both = [a + b for i, a in enumerate(groups) for b in groups[i + 1 :]]
    parts = [f"SELECT a.row_id AS x, b.row_id AS y FROM reports a JOIN reports b ON {' AND '.join(f'a.{f} IS NOT DISTINCT FROM b.{f}' for f in fields)} WHERE a.row_id < b.row_id" for fields in both]
    differ = " + ".join(f"(a.{f} IS DISTINCT FROM b.{f})::int" for f in near_duplicates.REPORT_FIELDS)
    return f"SELECT x AS row_id_a, y AS row_id_b FROM ({' UNION '.join(parts)}) JOIN reports a ON a.row_id = x JOIN reports b ON b.row_id = y WHERE {differ} <= 3"


@query("reports", sql=_near_sql())
def p2_found(reports):
    return near_duplicates.pairs_found(reports)


def _groups_sql() -> str:
    fields = ", ".join(near_duplicates.REPORT_FIELDS)
    same = " AND ".join(f"r.{f} IS NOT DISTINCT FROM c.{f}" for f in near_duplicates.REPORT_FIELDS)
    return f"""WITH RECURSIVE cl AS (SELECT {fields}, min(row_id) AS class_id FROM reports GROUP BY ALL),
mem AS (SELECT row_id, class_id FROM reports r JOIN cl c ON {same}),
prs AS ({_near_sql()}),
edges AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM prs JOIN mem a ON a.row_id = row_id_a JOIN mem b ON b.row_id = row_id_b WHERE a.class_id <> b.class_id),
linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk(id, root) AS (SELECT class_id, class_id FROM cl UNION SELECT b, root FROM walk JOIN linked ON a = id)
SELECT row_id, class_id, (SELECT count(*) FROM linked WHERE a = class_id) AS links, root AS group_id FROM mem JOIN (SELECT id, min(root) AS root FROM walk GROUP BY 1) ON id = class_id"""


@query("reports", sql=_groups_sql())
def p2_groups(reports):
    """One row per report with its class of exact copies, its links and its group."""
    return near_duplicates.groups(reports)


def _p7_sql() -> str:
    parts = ["(coalesce(trim(core_id), '') NOT IN ('', '999.9'))::int"]
    parts += [f"({f} IS NOT NULL AND {f} <> 999.9{' AND core_slp <> 9999.9' if f == 'core_slp' else ''})::int" for f in survivors.FIELDS[1:]]
    return f"""WITH t AS (SELECT row_id, c98_uid, coalesce(trust, -1) AS trust, coalesce(received_at, timestamp '0001-01-01') AS seen, {' + '.join(parts)} AS n
  FROM reports LEFT JOIN decks ON c1_dck = dck AND c1_sid = sid WHERE c98_uid IS NOT NULL),
g AS (SELECT c98_uid, max(trust) AS mt, max(seen) AS ms, max(n) AS mn, count(*) AS k FROM t GROUP BY 1)
SELECT 'ICOADS-30-' || c98_uid AS report_id, min(row_id) AS row_id FROM t JOIN g USING (c98_uid)
WHERE k > 1 AND trust = mt AND seen = ms AND n = mn GROUP BY c98_uid HAVING count(*) = 1"""


@query("reports", "decks", sql=_p7_sql())
def p7_found(reports, decks):
    return survivors.found(reports, decks)


@query("reports", "decks")
def p7_best_reports(reports, decks):
    """One record per report id of several rows, gaps filled from successive layers of dominance."""
    return survivors.best_reports(reports, decks)


@query("documents")
def p8_ids(documents):
    return token_ids.encode(documents)


@query("documents", "containers")
def p9_containers(documents, containers):
    return packing.pack(documents, containers)


@query("documents")
def p10_found(documents):
    return residue.found(documents)


@query("documents")
def p10_templates(documents):
    """Induced templates of suspicious segments, with their records and fillings."""
    return residue.templates(documents)
