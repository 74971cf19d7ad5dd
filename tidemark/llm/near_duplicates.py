"""Near-duplicate records with small edits, by min-max hashing completed by exact prefixes (problem 2).

Two records are near-duplicates if, as written, they differ in at most `max_diff` of the given fields (null equals null).

1. A record is the set of its tokens (field, value). Exact copies are collapsed to one representative.
2. Under each random permutation of all tokens both the minimum and the maximum are retained: two components of the signature
   for one evaluation of the hash. The permutations are weighted (exponential races) by a token's information
   -log2(share of the records that hold it), so that a value that a third of all records share is seldom a component.
   Shares come from counts over all records; only tokens in at least 1/4096 of the records (at most 4096 a field) are
   told apart, the rest count as rare.
3. A band is as many components as it takes for their distinct tokens to carry log2(records) + 1 bits, at most six.
   So frequent values lengthen a band, and the buckets stay small whatever the skew.
4. Bands are probable candidates only; exact prefixes complete them. Tokens have one order for all records, the most
   informative first. Two records that differ in at most `max_diff` fields share all other tokens, in this order, and
   neither skips more than `max_diff` of its own before any of them. So each record takes every choice of its tokens with
   at most `max_diff` skipped, until the choice carries log2(records) + 1 bits or has as many tokens as a pair must share. When
   to stop is told by the shared tokens alone, so both records of a pair come to the same choice, whatever size and skew are.
5. Each row carries some bits of each of its record's tokens, in one 64-bit sketch. Equal tokens have equal bits, so a pair whose
   sketches differ in more than `max_diff` places is none, and never leaves its bucket.
6. Buckets are streamed in sorted order. Up to 64 members they give their pairs. The choices of larger ones of prefixes go
   on by further tokens, round by round; a large bucket that shares all that a pair must share is joined with itself, as all
   of its pairs hold. Larger ones of bands give nothing, the prefixes have their pairs.
7. Candidate pairs are checked field by field.

Defined results: a null is a value like any other; records without any field filled are copies of each other; ids must
be unique and not null; ties and repeated rows are copies; an empty table has no pairs; other columns are ignored.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

REPORT_FIELDS = [
    "core_id", "core_yr", "core_mo", "core_dy", "core_hr", "core_lat", "core_lon", "core_at", "core_dpt", "core_sst",
    "core_slp", "core_d", "core_w", "c1_dck", "c99",
]
HEAVY = 4096  # a token is told apart if it is in at least one of so many records
BANDS, COMPONENTS, MEMBERS = 8, 6, 64
RARE_BITS = 12.0
FURTHER_BITS = 8.0  # by which the choices of a large bucket go on
SLICE = 2048  # records whose choices are held at a time


def record_tokens(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`_id` and `_tok`, a 64-bit token per field; -0.0 is 0.0."""
    def value(f: str):
        return F.col(f) + F.lit(0.0) if dict(df.dtypes)[f] in ("double", "float") else F.col(f)

    return df.select(F.col(key).alias("_id"), F.array(*[F.xxhash64(F.lit(i), value(f)) for i, f in enumerate(fields)]).alias("_tok"))


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joined by shuffle, whatever the sizes are held to be: Spark counts an array as one element and so holds tables of records for a
    small part of what they are, and a broadcast of one goes through the driver's memory."""
    return left.join(right.hint("merge"), on, how)


def classes(tokens: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """Each record with the smallest id among its exact copies: `_id`, `_class`. Copies are told by 128 bits. Of `reps`, those without
    copies are taken as they are, so that only the keys of the others meet the records."""
    reps = representatives(tokens) if reps is None else reps
    several = reps.filter("_copies > 1").select("_h1", "_h2", F.col("_id").alias("_class"))
    copies = _meet(tokens.select("_id", *_copy_key()), several, ["_h1", "_h2"]).select("_id", "_class")
    return reps.filter("_copies = 1").select("_id", F.col("_id").alias("_class")).unionByName(copies)


def _copy_key():
    return F.xxhash64("_tok").alias("_h1"), F.xxhash64(F.lit(1), F.reverse("_tok")).alias("_h2")


def representatives(tokens: DataFrame) -> DataFrame:
    """The record with the smallest id of each class of exact copies, with its tokens and the number of copies."""
    least = tokens.groupBy(*_copy_key()).agg(F.min(F.struct("_id", "_tok")).alias("r"), F.count("*").alias("_copies"))
    return least.select("r._id", "r._tok", "_copies", "_h1", "_h2")


def heavy_tokens(tokens: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and shares of the tokens in at least 1/4096 of all records: at most 4096 for each field."""
    counts = tokens.select(F.explode("_tok").alias("t")).groupBy("t").count()
    rows = counts.filter(F.col("count") >= max(2.0, total / HEAVY)).toPandas()
    rows = rows.sort_values("t")
    return rows["t"].to_numpy("int64"), rows["count"].to_numpy("float64") / max(1, total)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def information(tok: np.ndarray, heavy: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Bits of each token, at least 0.01."""
    own = np.full(tok.shape, RARE_BITS, dtype=np.float32)
    if len(heavy):
        info = np.minimum(RARE_BITS, -np.log2(np.clip(shares, 1e-9, 1.0)))
        at = np.searchsorted(heavy, tok).clip(max=len(heavy) - 1)
        own = np.where(heavy[at] == tok, info[at], RARE_BITS).astype(np.float32)
    return np.maximum(own, np.float32(0.01))


def sketch(tok: np.ndarray) -> np.ndarray:
    """64 bits of a record: as many of each token as there is room for, in order of the fields."""
    width = _sketch_bits(tok.shape[1])
    out = np.zeros(len(tok), dtype=np.uint64)
    for i in range(tok.shape[1] if width else 0):
        out |= (tok[:, i].view(np.uint64) & np.uint64((1 << width) - 1)) << np.uint64(i * width)
    return out.view(np.int64)


def _sketch_bits(fields: int) -> int:
    return min(8, 64 // fields)


def places_apart(x: np.ndarray, y: np.ndarray, fields: int) -> np.ndarray:
    """In how many fields two sketches differ; no more than their records do."""
    width = _sketch_bits(fields)
    if not width:
        return np.zeros(len(x), dtype=np.int64)
    apart = (x ^ y).view(np.uint64)
    folded = apart
    for k in range(1, width):
        folded = folded | (apart >> np.uint64(k))
    return np.bitwise_count(folded & np.uint64(sum(1 << i * width for i in range(fields))))


def _keyed(keys: np.ndarray, ids: np.ndarray, state: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(state), pa.array(sketches)], names=["_band", "_id", "_state", "_sketch"])


def minmax_bands(heavy: np.ndarray, shares: np.ndarray, bits: float, bands: int, seed: int):
    """A mapInArrow function: (_id, _tok) -> (_band, _id, _state, _sketch), a row for each band; its state is -1."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 2**63, size=(bands, COMPONENTS // 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, size=(bands, COMPONENTS // 2), dtype=np.uint64)

    def components(tok: np.ndarray, weight: np.ndarray, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        u = ((_mix(tok * odd[b, k] + shift[b, k]) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) / np.float32(2**24)
        return (np.log(u) * weight).argmax(axis=1), (np.log1p(-u) * weight).argmax(axis=1)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tok = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            width = tok.shape[1]
            own = information(tok, heavy, shares)
            weight, utok, ids = 1 / own, tok.view(np.uint64), batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.empty((bands, n), dtype=np.uint64)
            for b in range(bands):
                key = np.full(n, b + 1, dtype=np.uint64)
                used, got = np.zeros((n, width), dtype=bool), np.zeros(n, dtype=np.float32)
                rows = np.arange(n)
                for k in range(COMPONENTS // 2):
                    if not len(rows):
                        break
                    for pick in components(utok[rows], weight[rows], b, k):
                        # a later component joins only those whose band is still too short
                        short = got[rows] < bits
                        r, c = rows[short], pick[short]
                        key[r] = _mix(key[r] * np.uint64(0xD6E8FEB86659FD93) + utok[r, c])
                        got[r] += np.where(used[r, c], np.float32(0), own[r, c])
                        used[r, c] = True
                    rows = rows[got[rows] < bits]
                keys[b] = key
            yield _keyed(keys.reshape(-1), np.tile(ids, bands), np.full(bands * n, -1, dtype=np.int32), np.tile(sketch(tok), bands))

    return run


def prefix_choices(heavy: np.ndarray, shares: np.ndarray, bits: float, shared: int, max_diff: int):
    """A mapInArrow function: (_id, _tok, _band, _state) -> (_band, _id, _state, _sketch). Each choice goes on from its state (tokens
    passed << 16 | tokens chosen) with every choice of further tokens, until these carry `bits` or `shared` are chosen."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                n = batch.num_rows
                ids, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                state = batch.column(3).to_numpy(zero_copy_only=False)
                tok = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                sketches, tok = sketch(tok), np.sort(tok, axis=1)
                own = information(tok, heavy, shares)
                order = np.argsort(-own, axis=1, kind="stable")  # ties by token, so that all records have one order
                utok, own = np.take_along_axis(tok, order, 1).view(np.uint64), np.take_along_axis(own, order, 1)
                row, at, chosen, got = np.arange(n), state >> 16, state & 0xFFFF, np.zeros(n, dtype=np.float32)
                while len(row):
                    done = (got >= bits) | (chosen >= shared)
                    if done.any():
                        yield _keyed(key[done], ids[row[done]], (at[done] << 16 | chosen[done]).astype(np.int32), sketches[row[done]])
                        row, at, chosen, got, key = (x[~done] for x in (row, at, chosen, got, key))
                    steps = []
                    for skip in range(max_diff + 1):
                        # fewer than `shared` are chosen, so a token is left whenever another may be skipped
                        r = np.flatnonzero(at - chosen + skip <= max_diff)
                        to = at[r] + skip
                        steps.append((row[r], to + 1, chosen[r] + 1, got[r] + own[row[r], to], _mix(key[r] * np.uint64(0xD6E8FEB86659FD93) + utok[row[r], to])))
                    row, at, chosen, got, key = (np.concatenate(x) for x in zip(*steps))

    return run


def bucket_pairs(fields: int, max_diff: int):
    """A mapInArrow function over (_band, _id, _state, _sketch) sorted by the first two: (_a, _b, _band, null) for each pair of a bucket
    of up to MEMBERS whose sketches may be those of near-duplicates; of a larger bucket (_a, null, _band, _state) for each member. A
    bucket is held up to MEMBERS ids only."""

    def flush(key: np.ndarray, ids: np.ndarray, sketches: np.ndarray, start: np.ndarray, size: np.ndarray):
        a, b, k = [], [], []
        for m in np.unique(size):
            if m < 2:
                continue
            at = start[size == m]
            places = at[:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            left, right = places[:, i].reshape(-1), places[:, j].reshape(-1)
            near = places_apart(sketches[left], sketches[right], fields) <= max_diff
            a.append(ids[left[near]]), b.append(ids[right[near]]), k.append(np.repeat(key[at], len(i))[near])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(k)), pa.nulls(len(a), pa.int32())], names=["_a", "_b", "_band", "_state"])

    def members(key: int, ids: np.ndarray, state: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(np.full(len(ids), key, dtype=np.int64)), pa.array(state)], names=["_a", "_b", "_band", "_state"])

    def run(batches):
        carry_key, large = None, False
        carry = carry_state = carry_sketch = np.empty(0, dtype=np.int64)
        for batch in batches:
            key, ids, state, sketches = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_band", "_id", "_state", "_sketch"))
            if not len(key):
                continue
            if carry_key is not None:
                if large and key[0] == carry_key:  # the rest of a bucket already known to be large
                    n = int(np.searchsorted(key, carry_key, side="right"))
                    yield members(carry_key, ids[:n], state[:n])
                    key, ids, state, sketches = key[n:], ids[n:], state[n:], sketches[n:]
                    if not len(key):
                        continue
                elif not large:
                    key, ids = np.concatenate([np.full(len(carry), carry_key, dtype=np.int64), key]), np.concatenate([carry, ids])
                    state, sketches = np.concatenate([carry_state, state]), np.concatenate([carry_sketch, sketches])
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            for s, m in zip(start[size > MEMBERS], size[size > MEMBERS]):
                yield members(int(key[s]), ids[s : s + m], state[s : s + m])
            carry_key, large = int(key[start[-1]]), bool(size[-1] > MEMBERS)
            kept = slice(0, 0) if large else slice(start[-1], None)
            carry, carry_state, carry_sketch = ids[kept], state[kept], sketches[kept]
            whole = size <= MEMBERS
            whole[-1] = False
            if (out := flush(key, ids, sketches, start[whole], size[whole])) is not None:
                yield out
        if carry_key is not None and not large and (out := flush(np.full(len(carry), carry_key, dtype=np.int64), carry, carry_sketch, np.array([0]), np.array([len(carry)]))) is not None:
            yield out

    return run


def _pairs_of(keyed: DataFrame, parts: int, fields: int, max_diff: int) -> DataFrame:
    return keyed.repartition(parts, "_band").sortWithinPartitions("_band", "_id").mapInArrow(bucket_pairs(fields, max_diff), "_a long, _b long, _band long, _state int")


def near_duplicate_pairs(df: DataFrame, key: str = "row_id", fields: list[str] = REPORT_FIELDS, max_diff: int = 3, bands: int = BANDS, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, tokens, reps): pairs (_a < _b, _diff) between representatives of classes of exact copies that differ in 1 to
    `max_diff` fields; tokens as of `record_tokens` and reps as of `representatives`, of which `classes` gives the members of each class."""
    tokens = record_tokens(df, key, fields)
    reps = cut(representatives(tokens))
    total = reps.count()
    heavy, shares = heavy_tokens(reps, total)
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (bands + 10) // 2_000_000)
    shared, kind, first = len(fields) - max_diff, "_band long, _id long, _state int, _sketch long", log2(max(2, total)) + 1
    keyed = reps.select("_id", "_tok").mapInArrow(minmax_bands(heavy, shares, first, bands, seed), kind)
    begin = reps.select("_id", "_tok", F.lit(0).cast("long").alias("_band"), F.lit(0).alias("_state"))
    keyed = keyed.unionByName(begin.mapInArrow(prefix_choices(heavy, shares, first, shared, max_diff), kind))
    small = None
    while True:
        raw = cut(_pairs_of(keyed, parts, len(fields), max_diff))
        here = raw.filter(F.col("_b").isNotNull()).select("_a", "_b")
        small = here if small is None else small.unionByName(here)
        large = raw.filter(F.col("_b").isNull() & (F.col("_state") >= 0))
        # what shares all that a pair must share is a pair; these are joined, not collected
        final = large.filter(F.col("_state").bitwiseAND(0xFFFF) >= shared)
        small = small.unionByName(_meet(final.select("_band", "_a"), final.select("_band", F.col("_a").alias("_b")), "_band").filter(F.col("_a") < F.col("_b")).select("_a", "_b"))
        large = large.filter(F.col("_state").bitwiseAND(0xFFFF) < shared).select(F.col("_a").alias("_id"), "_band", "_state")
        if not large.head(1):
            break
        further = _meet(large, reps.select("_id", "_tok"), "_id").select("_id", "_tok", "_band", "_state")
        keyed = further.mapInArrow(prefix_choices(heavy, shares, FURTHER_BITS, shared, max_diff), kind)
    pairs = small.distinct()
    a = reps.select(F.col("_id").alias("_a"), F.col("_tok").alias("_ta"))
    b = reps.select(F.col("_id").alias("_b"), F.col("_tok").alias("_tb"))
    differ = F.aggregate(F.zip_with("_ta", "_tb", lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    checked = _meet(_meet(pairs, a, "_a"), b, "_b").select("_a", "_b", differ.alias("_diff"))
    return checked.filter(F.col("_diff") <= max_diff), tokens, reps


def pairs_found(reports: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), a < b: each pair of rows of one observation, copies among them."""
    pairs, tokens, reps = near_duplicate_pairs(reports)
    pairs, of = cut(pairs.select("_a", "_b")), cut(classes(tokens, reps))
    several = _meet(of, reps.filter("_copies > 1").select(F.col("_id").alias("_class")), "_class")
    x, y = several.select("_class", F.col("_id").alias("row_id_a")), several.select("_class", F.col("_id").alias("row_id_b"))
    copies = _meet(x, y, "_class").filter(F.col("row_id_a") < F.col("row_id_b")).select("row_id_a", "row_id_b")
    left = _meet(pairs, of.select(F.col("_class").alias("_a"), F.col("_id").alias("u")), "_a")
    between = _meet(left, of.select(F.col("_class").alias("_b"), F.col("_id").alias("v")), "_b")
    return between.select(F.least("u", "v").alias("row_id_a"), F.greatest("u", "v").alias("row_id_b")).unionByName(copies)


def components(edges: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """Connected components of undirected edges: `_id`, `_root` (the least id), by rounds of the larger neighbours' and
    then the smaller neighbours' links to the least one (Kiveris et al., 2014); each round cuts its lineage."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = _meet(both, least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = _meet(e, least, "u")
        e = cut(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = e.select(F.col("u").alias("_id"), F.col("v").alias("_root"))
    return roots.unionByName(roots.select(F.col("_root").alias("_id"), "_root").distinct())


def groups(df: DataFrame, key: str = "row_id", fields: list[str] = REPORT_FIELDS, max_diff: int = 3) -> DataFrame:
    """One row per record: the key, class_id (least id of its exact copies), links (representatives it is linked with)
    and group_id (least id of all that are linked with it directly or through others)."""
    pairs, tokens, reps = near_duplicate_pairs(df, key, fields, max_diff)
    pairs = cut(pairs)
    ends = pairs.select(F.col("_a").alias("_class")).unionAll(pairs.select(F.col("_b").alias("_class")))
    links = ends.groupBy("_class").agg(F.count("*").alias("links"))
    roots = components(pairs).withColumnRenamed("_id", "_class")
    out = _meet(_meet(classes(tokens, reps), links, "_class", "left"), roots, "_class", "left")
    return out.select(F.col("_id").alias(key), F.col("_class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("_root", "_class").alias("group_id"))
