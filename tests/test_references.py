from datetime import datetime as dt

from tidemark.operators import references

OBS = "row_id long, report_id string, date_time timestamp_ntz, observation_value double, loaded_at timestamp_ntz, kind string"
HEAD = "row_id long, report_id string, report_timestamp timestamp_ntz, duplicates array<string>, loaded_at timestamp_ntz"
GONE = "report_id string, deleted_at timestamp_ntz"


def frames(spark, obs, head, gone):
    return spark.createDataFrame(obs, OBS), spark.createDataFrame(head, HEAD), spark.createDataFrame(gone, GONE)


def test_kinds(spark):
    t = [dt(2000, 1, d) for d in range(1, 29)]
    head = [(1, "A-01", t[5], [" a-02 ", "A-02", "zz", None], t[3]), (2, "A-02", None, None, t[9]), (3, "A-03", t[5], [], t[2]), (4, "A-04", t[5], None, t[2]), (5, "A-04", t[5], None, t[8]), (6, "A-05", None, None, None)]
    gone = [("a-03", t[4]), ("A-04", t[4]), ("A-09", t[4]), (None, t[4])]
    obs = [(10, "a-01 ", t[5], 1.0, t[5], ""), (11, "A-02", t[5], 2.0, t[5], ""), (12, "A-03", t[5], None, t[5], ""), (13, "A-04", t[5], 1.0, t[5], ""), (14, "A-09", None, 1.0, t[5], ""), (15, "A-1", t[5], 1.0, t[5], ""), (16, None, t[5], 1.0, t[5], ""), (17, "  ", t[5], 1.0, t[5], ""), (18, "A-05", t[5], 1.0, t[5], ""), (19, "A-02", t[5], 1.0, None, "")]
    got = sorted(tuple(r) for r in references.found(*frames(spark, obs, head, gone)).collect())
    assert got == [("cdm_header", 1, "A-02", "late"), ("cdm_header", 1, "ZZ", "missing"), ("observations", 11, "A-02", "late"), ("observations", 12, "A-03", "deleted"), ("observations", 14, "A-09", "deleted"), ("observations", 15, "A-1", "missing")]
    assert references.by_period(*frames(spark, obs, head, gone)).filter("kind = 'deleted'").count() == 2


def test_runs_are_contiguous_and_cut_at_blocks(spark):
    ids = [(i, f"K{i:04d}", None, None, dt(2000, 1, 1)) for i in [1, 2, 3, 5, 9, 10]]
    states = references.parent_states(spark.createDataFrame(ids, HEAD), None)
    runs = {(r.run_start, r.run_end) for r in references.key_runs(states).collect()}
    assert sum(b - a + 1 for a, b in runs) == 6 and len(runs) < 6


def test_hot_and_empty(spark):
    head = [(1, "H", None, None, dt(2000, 1, 1))]
    obs = [(i, "GONE" if i % 3 else "H", dt(2000, 1, 2), 1.0, dt(2000, 1, 2), "") for i in range(3000)]
    assert references.found(*frames(spark, obs, head, [])).count() == 2000
    assert references.found(*frames(spark, [], head, [])).count() == 0
    assert references.found(*frames(spark, obs[:5], [], [])).count() == 5
