from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_duplicates as nd
from tidemark.llm import survivors

FIELDS = [f"f{i}" for i in range(15)]


def table(spark, n=400, seed=3):
    """Records of which a third share five values, every fifth is an edited copy of another, and some are exact copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 5 == 4:
            base = list(rows[rng.integers(len(rows))])
            for f in rng.choice(15, rng.integers(0, 4), replace=False):
                base[f] = None if rng.random() < 0.2 else f"e{rng.integers(9)}"
            rows.append(base)
        else:
            r = [f"{rng.integers(300)}" for _ in range(15)]
            if i % 3 == 0:
                r[:5] = ["hot"] * 5
            rows.append([None if rng.random() < 0.1 else v for v in r])
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "row_id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", _class string"), rows


def brute(rows, most=3):
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sum(a != b for a, b in zip(rows[i], rows[j])) <= most}


def found(df):
    pairs, tokens, _ = nd.near_duplicate_pairs(df, "row_id", FIELDS)
    cls = {r._id: r._class for r in nd.classes(tokens).collect()}
    close = {(r._a, r._b) for r in pairs.collect()}
    return cls, close


def test_no_link_is_lost(spark):
    df, rows = table(spark)
    cls, close = found(df)
    want = brute(rows)
    got = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if cls[i] == cls[j] or (min(cls[i], cls[j]), max(cls[i], cls[j])) in close}
    assert got == want


def test_large_buckets_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(nd, "MEMBERS", 2)
    df, rows = table(spark, 120)
    cls, close = found(df)
    assert {(i, j) for i in range(120) for j in range(i + 1, 120) if cls[i] == cls[j] or (min(cls[i], cls[j]), max(cls[i], cls[j])) in close} == brute(rows)


def linked(rows, cls, close):
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if cls[i] == cls[j] or (min(cls[i], cls[j]), max(cls[i], cls[j])) in close}


def records(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, " + ", ".join(f"{f} string" for f in FIELDS))


def test_few_informative_fields(spark):
    """Eleven of 15 fields are equal or null everywhere: pairs share one informative value at least, and bands are longer."""
    rng = np.random.default_rng(5)
    rows = [[f"{rng.integers(300)}" for _ in range(4)] + ["same"] * 6 + [None] * 5 for _ in range(400)]
    rows += [[f"x{i}", "all", f"y{i}", f"z{i}"] + ["same"] * 6 + [None] * 5 for i in range(70)]  # a large bucket of pairs
    cls, close = found(records(spark, rows))
    assert linked(rows, cls, close) == brute(rows)


def test_large_buckets_go_on(spark):
    """Eight fields follow from the station, so their bits promise small buckets that hold a fourth of all rows each."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(480):
        if i % 3 == 2:
            base = list(rows[rng.integers(len(rows))])
            for f in rng.choice(15, 3, replace=False):
                base[f] = f"e{rng.integers(9)}"
        else:
            base = [f"s{rng.integers(4)}"] * 8 + [f"{rng.integers(12)}" for _ in range(7)]
        rows.append(base)
    cls, close = found(records(spark, rows))
    assert linked(rows, cls, close) == brute(rows)


def test_bucket_stream_across_batches():
    key = np.array([1, 1, 1, 2] + [3] * 150 + [4, 4], dtype=np.int64)
    ids = np.arange(len(key), dtype=np.int64)
    cuts = [0, 2, 5, 60, 100, len(key)]
    state, sketches = np.full(len(key), -1, dtype=np.int32), np.where(ids == 2, 0x11, 0)  # two places apart from the others
    batches = (pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (key, ids, state, sketches)], names=["_band", "_id", "_state", "_sketch"]) for a, b in zip(cuts, cuts[1:]))
    out = list(nd.bucket_pairs(15, 1)(batches))
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert {r[:2] for r in rows if r[1] is not None} == {(0, 1), (154, 155)}
    assert sorted(r[0] for r in rows if r[1] is None) == list(range(4, 154))


@pytest.mark.parametrize("fields", [3, 15, 40, 70])
def test_sketches_are_no_further_apart_than_records(fields):
    rng = np.random.default_rng(fields)
    x, y = rng.integers(-(2**62), 2**62, (500, fields)), rng.integers(-(2**62), 2**62, (500, fields))
    y = np.where(rng.random((500, fields)) < rng.random((500, 1)), x, y)
    told, true = nd.places_apart(nd.sketch(x), nd.sketch(y), fields), (x != y).sum(axis=1)
    assert (told <= true).all() and (fields != 15 or (true - told).max() <= 6)


def test_no_table_of_records_goes_through_the_driver(spark, monkeypatch):
    """Spark holds records for smaller than they are, so its own choice broadcasts millions of them."""
    real, plans = nd.cut, []

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def cut(df):
        out = real(df)
        plan(df)
        return out

    monkeypatch.setattr(nd, "cut", cut)
    monkeypatch.setattr(nd, "MEMBERS", 2)  # so that choices go on, with a join each
    df, rows = table(spark, 120)
    out = nd.pairs_found(df.toDF("row_id", *nd.REPORT_FIELDS, "_class"))
    assert {tuple(r) for r in out.collect()} == brute(rows)
    plan(out)
    grouped = nd.groups(df, "row_id", FIELDS)
    assert len(grouped.collect()) == 120
    plan(grouped)
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)


def test_groups_and_empty(spark):
    df, rows = table(spark, 60)
    out = nd.groups(df, "row_id", FIELDS).collect()
    assert len(out) == 60 and all(r.group_id <= r.class_id <= r.row_id for r in out)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.row_id: r.group_id for r in out} == {i: root(i) for i in range(60)}
    assert nd.groups(df.limit(0), "row_id", FIELDS).count() == 0


REPORTS = "row_id long, c98_uid string, c1_dck string, c1_sid string, received_at timestamp_ntz, core_id string, core_lat double, core_lon double, core_at double, core_dpt double, core_sst double, core_slp double, core_d int, core_w double, trust string, dck string"
DECKS = "dck string, sid string, trust int"


def report(i, uid, sid, day, **values):
    given = {"core_id": "X", "core_lat": 1.0, "core_lon": 2.0, "core_at": 3.0, "core_dpt": 4.0, "core_sst": 5.0, "core_slp": 1000.0, "core_d": 7, "core_w": 8.0} | values
    return (i, uid, "1", sid, datetime(2000, 1, day) if day else None, *given.values(), "clash", "clash")


def test_survivors(spark):
    rows = [
        report(1, "A", "hi", 5), report(2, "A", "lo", 4, core_at=None), report(3, "B", "hi", 3, core_at=None, core_sst=None), report(4, "B", "lo", 4, core_slp=9999.9), report(5, "C", "hi", 3), report(6, "C", "hi", 3),
        report(7, "D", "hi", 3), report(8, None, "hi", 3), report(9, None, "hi", 3), report(10, "E", "zz", None, core_id=" "), report(11, "E", "zz", 2, core_at=999.9), report(12, "F", None, 2, core_at=float("nan")), report(13, "F", "lo", 2),
    ]
    df, decks = spark.createDataFrame(rows, REPORTS), spark.createDataFrame([("1", "hi", 9), ("1", "lo", 2)], DECKS)
    assert sorted(tuple(r) for r in survivors.found(df, decks).collect()) == [("ICOADS-30-A", 1), ("ICOADS-30-E", 11), ("ICOADS-30-F", 13)]
    best = {r.c98_uid: r for r in survivors.best_reports(df, decks).collect()}
    assert set(best) == {"A", "B", "C", "E", "F"}
    assert best["B"].row_id == 3 and best["B"].core_at == 3.0 and best["B"].core_sst == 5.0 and best["B"].borrowed == 2 and not best["B"].sole and best["B"].core_slp == 1000.0
    assert best["C"].row_id == 5 and not best["C"].sole and best["E"].core_id == "X" and best["E"].core_at == 3.0
    assert survivors.found(df.limit(0), decks).count() == 0


def test_hot_key(spark):
    rows = [report(i, "H", "hi" if i % 2 else "lo", 1 + i % 28, core_at=None if i % 3 else 1.0) for i in range(3000)] + [report(9999, "H", "hi", 29)]
    got = survivors.found(spark.createDataFrame(rows, REPORTS), spark.createDataFrame([("1", "hi", 9), ("1", "lo", 2)], DECKS)).collect()
    assert [tuple(r) for r in got] == [("ICOADS-30-H", 9999)]
