"""Implausible readings: impossible values, frozen runs and spikes, per series (problem 6).

A series is the readings of one sensor and variable that have a value, in common units, in order of time (ties by row),
each observation id once. Readings are range-partitioned by series and time, so a hot series is cut by rows like any other; a task
passes over its part once, with the nine readings on either side of it added (the edges of all parts, 18 rows a part, are
what the driver holds).

Robust seasonal-trend decomposition: the slow trend is the running median of nine readings (fewer at the ends of a series), the seasonal part the median of the
detrended readings of an hour of the day (where it has ten or more), the remainder what is left. The fast trend is the
running median of three; what is left of it shows what lasts for one reading only. Remainders are studentised by robust scales,
1.4826 times the median absolute remainder (slow) and that of the changes between neighbours over the root of two (fast), and
tested by the generalised extreme studentised deviate (ESD) procedure: with the greater ones removed, a deviate is
extreme if it exceeds the critical value for the number that remain. Deviates are taken to three digits, which bounds
the distinct ones of a series, whatever its length.

What exceeds a limit is an outlier (`outliers`). `flagged` takes the outliers and checks them exactly: above both neighbours or below
both, and from each by more than ten times the median absolute change. None is lost: such a reading's fast deviate exceeds 9.5,
and the critical value is below that up to 10 ** 18 readings. Runs of ten equal readings and the element's limits are separate checks.
Medians of changes are exact, in two steps (a quantile sketch brackets the middle, then what lies between is counted); seasonal
parts and median remainders are those of the sketch, exact up to some ten thousand readings, beyond that within one in 10,000 of rank.

Defined results: null sensors, null and other variables and readings without a value have no series; NaN is no value; a null time
is before all others; a null observation id stands for itself; limits that are null or have no unit bound nothing; series of
fewer than 24 readings have impossible readings only; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.unit_resolution import resolve_units
from tidemark.session import cut, small

RUN, FEWEST, TIMES, ALPHA = 10, 24, 10, 0.05
PHASE = 10  # readings of an hour of the day from which it has a seasonal part, else the part would be the reading itself
HALF = 4  # readings on either side of the one whose slow trend is taken
EDGE = RUN - 1  # readings of the neighbouring parts that a task needs
LEAST = 2.0  # smaller deviates are extreme in no series of 24 readings, of which at most half may be removed
ACCURACY = 10_000


def readings(observations: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per reading of a series: s (series), t (microseconds), row_id, v, outside."""
    needed = ["row_id", "observation_id", "report_id", "date_time", "observed_variable", "observation_value", "units", "units_text", "imodel", "element", "sensor_id", "source_id"]
    rows = resolve_units(observations.select(*[c for c in needed if c != "source_id" or c in observations.columns]).filter(F.col("sensor_id").isNotNull() & F.col("observation_value").isNotNull() & ~F.isnan("observation_value")), elements)
    rows = rows.filter(F.col("_u_value").isNotNull())
    outside = F.coalesce((F.col("_u_value") < F.col("_u_min")) | (F.col("_u_value") > F.col("_u_max")), F.lit(False))
    rows = rows.select(series_key().alias("s"), time_key().alias("t"), "row_id", F.col("_u_value").alias("v"), outside.alias("outside"), F.coalesce("observation_id", F.concat(F.lit("\u0001"), F.col("row_id").cast("string"))).alias("o"))
    # a rank limit is applied before the shuffle as well, so copies of one id do not meet in a task
    first = F.row_number().over(Window.partitionBy("s", "o").orderBy("row_id"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n", "o")


def series_key() -> Column:
    return F.xxhash64("sensor_id", F.col("observed_variable").cast("int"))


def time_key() -> Column:
    return F.coalesce(F.unix_micros(F.col("date_time").cast("timestamp")), F.lit(-(2**62)))


def _ln_normal_tail(p: Column) -> Column:
    """Upper quantile of the normal distribution for a small tail p (Abramowitz and Stegun 26.2.23)."""
    t = F.sqrt(-2 * F.log(p))
    return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)


def esd_critical(n: Column, alpha: float = ALPHA) -> Column:
    """Critical value of the ESD procedure for n remaining readings: Student's t by its expansion around the normal."""
    z, df = _ln_normal_tail(F.lit(alpha / 2) / n), F.greatest(n - 2, F.lit(1.0))
    t = z + (z * z * z + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    return (n - 1) * t / F.sqrt((df + t * t) * n)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("s", "t", "row_id", "v", "outside")}


def part_edges(batches):
    """A mapInArrow function over a sorted part: its first and last EDGE rows (all, if it has no more than both)."""
    first = last = part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("s", "v")}
        part = batch.column("p")[0].as_py()
        first = rows if first is None else first
        if len(first["s"]) < EDGE and first is not rows:
            first = {n: np.concatenate([first[n], rows[n]])[: 4 * EDGE] for n in rows}
        last = rows if last is None else {n: np.concatenate([last[n], rows[n]]) for n in rows}
        last = {n: x[-2 * EDGE :] for n, x in last.items()}
    if part is None:
        return
    for side, rows, keep in (("first", first, slice(0, EDGE)), ("last", last, slice(-EDGE, None))):
        n = len(rows["s"][keep])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([side] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(rows["s"][keep]), pa.array(rows["v"][keep])], names=["p", "side", "i", "s", "v"])


def _of_neighbours(s: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Per reading of sorted series: change to the one before, fast (what is left of the median of three), slow (of that of nine)
    and stuck; right for readings with EDGE others, or the end of the series, on either side."""
    n = len(s)
    padded_s, padded_v = np.r_[np.zeros(HALF, s.dtype), s, np.zeros(HALF, s.dtype)], np.r_[np.full(HALF, np.nan), v, np.full(HALF, np.nan)]
    around = np.lib.stride_tricks.sliding_window_view(padded_v, 2 * HALF + 1)
    inside = np.lib.stride_tricks.sliding_window_view(padded_s, 2 * HALF + 1) == s[:, None]
    window = np.sort(np.where(inside, around, np.nan), axis=1)  # NaN last
    have = np.isfinite(window).sum(axis=1)
    rows = np.arange(n)
    trend = (window[rows, (have - 1) // 2] + window[rows, have // 2]) / 2
    same = np.r_[False, s[1:] == s[:-1]]
    before, after = np.r_[np.nan, v[:-1]], np.r_[v[1:], np.nan]
    before, after = np.where(same, before, np.nan), np.where(np.r_[same[1:], False], after, np.nan)
    high, low = np.maximum(before, after), np.minimum(before, after)  # NaN at the ends of a series
    with np.errstate(invalid="ignore"):
        fast = np.where(v > high, v - high, np.where(v < low, v - low, 0.0))
    # runs of equal readings
    begins = np.flatnonzero(~(same & (v == before)))
    length = np.diff(np.r_[begins, n])
    stuck = np.repeat(length >= RUN, length)
    return {"change": np.round(np.abs(v - before), 6), "fast": np.round(fast, 6), "slow": np.round(v - trend, 6), "stuck": stuck}


def part_scan(edges):
    """A mapInArrow function over sorted parts: s, row_id, hour, outside, change, fast, slow, stuck. edges: broadcast (part,
    side, s, v) arrays in order of part."""

    def run(batches):
        held, done = None, 0  # rows not yet given out, behind those that they need
        part = None

        def results(rows: dict[str, np.ndarray], lo: int, hi: int):
            of = _of_neighbours(rows["s"], rows["v"])
            hour = (rows["t"] // 3_600_000_000) % 24
            change = of["change"][lo:hi]
            return pa.RecordBatch.from_arrays([
                pa.array(rows["s"][lo:hi]), pa.array(rows["row_id"][lo:hi]), pa.array(hour[lo:hi].astype(np.int8)), pa.array(rows["outside"][lo:hi].astype(bool)), pa.array(change, mask=np.isnan(change)),
                pa.array(of["fast"][lo:hi]), pa.array(of["slow"][lo:hi]), pa.array(of["stuck"][lo:hi]),
            ], names=["s", "row_id", "hour", "outside", "change", "fast", "slow", "stuck"])

        def strange(s: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
            n = len(s)
            return {"s": s, "v": v, "t": np.zeros(n, np.int64), "row_id": np.zeros(n, np.int64), "outside": np.zeros(n, bool)}

        def joined(a: dict, b: dict) -> dict:
            return {k: np.concatenate([a[k], b[k]]) for k in b}

        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("p")[0].as_py()
                p, last, s, v = edges.value
                at = np.flatnonzero((p < part) & last)[-EDGE:]
                held, done = strange(s[at], v[at]), len(at)
            held = joined(held, _columns(batch))
            ready = len(held["s"]) - EDGE
            if ready > done:
                yield results(held, done, ready)
                keep = max(0, ready - EDGE)
                held, done = {k: x[keep:] for k, x in held.items()}, ready - keep
        if part is not None:
            p, last, s, v = edges.value
            at = np.flatnonzero((p > part) & ~last)[:EDGE]
            end = len(held["s"])
            held = joined(held, strange(s[at], v[at]))
            yield results(held, done, end)

    return run


def neighbours(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Per reading: s, row_id, hour, outside, change (to the reading before), fast, slow (what is left of both trends), stuck."""
    spark, by = rows.sparkSession, ["s", "t", "row_id"]
    ranged = rows.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by).withColumn("p", F.spark_partition_id())
    ranged = cut(ranged.select("s", "t", "row_id", "v", "outside", "p"))
    edges = ranged.select("s", "v", "p").mapInArrow(part_edges, "p int, side string, i int, s long, v double").toPandas().sort_values(["p", "side", "i"], kind="stable")
    shared = spark.sparkContext.broadcast((edges["p"].to_numpy(), (edges["side"] == "last").to_numpy(bool), edges["s"].to_numpy("int64"), edges["v"].to_numpy("float64")))
    return ranged.mapInArrow(part_scan(shared), "s long, row_id long, hour tinyint, outside boolean, change double, fast double, slow double, stuck boolean")


def median_changes(parts: DataFrame) -> DataFrame:
    """s, n (readings), median_change: the exact median of the absolute changes, null for a single reading."""
    near = 3 / ACCURACY
    bands = parts.groupBy("s").agg(F.count("*").alias("n"), F.count("change").alias("k"), F.percentile_approx("change", [0.5 - near, 0.5 + near], ACCURACY).alias("band"))
    bands = cut(bands)
    tested = parts.filter(F.col("change").isNotNull()).join(small(bands.select("s", F.col("band")[0].alias("lo"), F.col("band")[1].alias("hi"))), "s")
    # what is below the band is one row, what is inside are its distinct values
    inside = F.when(F.col("change") >= F.col("lo"), F.col("change")).otherwise(F.lit(-1.0))
    counts = tested.filter(F.col("change") <= F.col("hi")).groupBy("s", inside.alias("x")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("s").orderBy("x")
    upto = counts.withColumn("upto", F.sum("m").over(w)).join(bands.select("s", "k"), "s")
    low = F.min(F.when(F.col("upto") >= F.ceil(F.col("k") / 2), F.col("x")))
    high = F.min(F.when(F.col("upto") >= F.floor(F.col("k") / 2) + 1, F.col("x")))
    medians = upto.groupBy("s").agg(((low + high) / 2).alias("median_change"))
    return bands.select("s", "n").join(medians, "s", "left")


def three_digits(x: Column) -> Column:
    """A positive number to three significant digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) - 2)
    return F.rint(x / unit) * unit


def decompose(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tested, limits): parts with deviates slow_d and fast_d (null below LEAST) and the median change of their series; per series the
    ESD limits slow_limit and fast_limit, and n."""
    changes = median_changes(parts)
    seasonal = parts.groupBy("s", "hour").agg(F.count("*").alias("k"), F.percentile_approx("slow", 0.5, ACCURACY).alias("season"))
    seasonal = small(seasonal.filter((F.col("k") >= PHASE) & (F.col("season") != 0)).drop("k"))
    left = parts.join(seasonal, ["s", "hour"], "left").withColumn("left", F.round(F.abs(F.col("slow") - F.coalesce("season", F.lit(0.0))), 6)).drop("season", "slow")
    scales = left.groupBy("s").agg(F.percentile_approx("left", 0.5, ACCURACY).alias("mad"), F.avg("left").alias("mean"))
    # a series that stands still for half of the time has a scale from the rest of it
    slow_scale = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(F.col("mean") * 1.2533)
    series = cut(changes.join(scales.select("s", slow_scale.alias("slow_scale")), "s"))
    fast_scale = F.col("median_change") * (1.4826 / 2**0.5)

    def deviate(x: Column, scale: Column) -> Column:
        d = F.when(x == 0, 0.0).when(scale > 0, three_digits(x / scale)).otherwise(F.lit(1e300))
        return F.when(d >= LEAST, d)

    long = series.filter(F.col("n") >= FEWEST)
    tested = left.join(small(long), "s").withColumns({"slow_d": deviate(F.col("left"), F.col("slow_scale")), "fast_d": deviate(F.abs("fast"), fast_scale)})
    both = F.explode(F.array(F.struct(F.lit("slow").alias("kind"), F.col("slow_d").alias("x")), F.struct(F.lit("fast").alias("kind"), F.col("fast_d").alias("x"))))
    counts = tested.select("s", "n", both.alias("e")).select("s", "n", "e.*").filter(F.col("x").isNotNull()).groupBy("s", "n", "kind", "x").agg(F.count("*").alias("m"))
    above = F.coalesce(F.sum("m").over(Window.partitionBy("s", "kind").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    remain = (F.col("n") - above).cast("double")
    extreme = (remain * 2 >= F.col("n")) & (F.col("x") > esd_critical(remain))
    of = counts.withColumn("extreme", extreme).filter("extreme").groupBy("s")
    return tested, of.agg(*[F.min(F.when(F.col("kind") == k, F.col("x"))).alias(f"{k}_limit") for k in ("slow", "fast")])


def analyse(observations: DataFrame, elements: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(readings, tested): the readings of all series with what their neighbours say; those of series of 24 or more with slow_out and
    fast_out, whether they exceed an ESD limit, and the median change of their series."""
    rows = cut(neighbours(readings(observations, elements), parts))
    tested, limits = decompose(rows)
    tested = tested.join(small(limits), "s", "left")
    return rows, tested.withColumns({f"{k}_out": F.coalesce(F.col(f"{k}_d") >= F.col(f"{k}_limit"), F.lit(False)) for k in ("slow", "fast")})


def outliers(observations: DataFrame, elements: DataFrame, parts: int | None = None) -> DataFrame:
    """(row_id, slow, fast): each reading of a series of 24 or more whose remainder from the slow trend and season, or from the fast
    trend, exceeds the ESD limit of its series."""
    tested = analyse(observations, elements, parts)[1]
    return tested.filter(F.col("slow_out") | F.col("fast_out")).select("row_id", F.col("slow_out").alias("slow"), F.col("fast_out").alias("fast"))


def flagged(observations: DataFrame, elements: DataFrame, parts: int | None = None) -> DataFrame:
    """(row_id, kind): each reading of a series that is 'impossible', 'stuck' or a 'spike', by the first that holds."""
    rows, tested = analyse(observations, elements, parts)
    impossible = rows.filter("outside").select("row_id", F.lit("impossible").alias("kind"))
    outlier = (F.col("slow_out") | F.col("fast_out")) & (F.col("fast") != 0) & (F.abs("fast") > F.round(TIMES * F.col("median_change"), 6))
    kind = F.when(F.col("stuck"), "stuck").when(outlier, "spike")
    return impossible.unionByName(tested.filter(~F.col("outside")).select("row_id", kind.alias("kind")).filter(F.col("kind").isNotNull()))
