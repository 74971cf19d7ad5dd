"""References to records that do not exist (problem 3).

Parent keys are mapped to integers and compressed into contiguous runs; each distinct reference key is matched as-of to
the run that starts at or before it, and is an orphan where it lies beyond the run's end. The references themselves are
reduced to distinct keys before anything is sorted, so a key that a third of all rows refer to costs one row here.

The id's tail of up to 12 base-36 digits is its integer; the rest is the prefix, and runs never cross prefixes. Keys fall into
fixed blocks of 2**12 integers (runs are cut at block borders), so that blocks are independent: no state is carried
from one task to another and no task holds more than 2**12 parents and as many distinct references of a prefix.

Defined results:
* ids are compared trimmed and in upper case; null and blank ids refer to nothing; an id without digits or letters at
  its end is all prefix, with integer 0;
* a parent whose load time is null counts as always loaded; a withdrawal without a time as after every load; a
  reference without a load time is never late;
* repeated parents and references count as often as they stand, but each (row, id) gives one row;
* an empty parent table makes every reference 'missing'; an empty reference table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12
TAIL = r"([0-9A-Z]{0,12})$"  # 36**12 < 2**63


def clean_id(column: Column) -> Column:
    """The id as it is compared: without blanks around it, in upper case; null if nothing is left."""
    return F.nullif(F.upper(F.trim(column)), F.lit(""))


def keyed(df: DataFrame, column: str) -> DataFrame:
    """Add the integer key of a clean id: `_k_prefix`, `_k_block` and `_k_at` (the place in the block)."""
    tail = F.regexp_extract(F.col(column), TAIL, 1)
    # the digit count keeps '01' and '1' apart
    prefix = F.concat_ws("\u0001", F.length(tail).cast("string"), F.substring(F.col(column), F.lit(1), F.length(F.col(column)) - F.length(tail)))
    number = F.when(tail == "", F.lit(0)).otherwise(F.conv(tail, 36, 10).cast("long"))
    return df.withColumns({"_k_prefix": prefix, "_k_number": number}).withColumns({"_k_block": F.shiftright("_k_number", BLOCK_BITS), "_k_at": F.col("_k_number").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")}).drop("_k_number")


def parent_states(parents: DataFrame, deletions: DataFrame | None, key: str = "report_id", loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """One row per parent id: `_id`, `first_load`, and `gone` (withdrawn and not loaded since, or only withdrawn)."""
    always, never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    rows = parents.select(clean_id(F.col(key)).alias("_id"), F.coalesce(F.col(loaded).cast("timestamp_ntz"), always).alias("first"), F.col(loaded).cast("timestamp_ntz").alias("last"), F.lit(None).cast("timestamp_ntz").alias("withdrawn"))
    if deletions is not None:
        none = F.lit(None).cast("timestamp_ntz")
        rows = rows.unionByName(deletions.select(clean_id(F.col(key)).alias("_id"), none.alias("first"), none.alias("last"), F.coalesce(F.col(deleted).cast("timestamp_ntz"), never).alias("withdrawn")))
    state = rows.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.min("first").alias("first_load"), F.max("last").alias("last_load"), F.max("withdrawn").alias("withdrawn"))
    gone = F.col("withdrawn").isNotNull() & F.coalesce(F.col("last_load") <= F.col("withdrawn"), F.lit(True))
    return state.select("_id", "first_load", gone.alias("gone"))


def key_runs(states: DataFrame) -> DataFrame:
    """Compress parents into runs of consecutive integers of one block: `_k_prefix`, `_k_block`, `run_start`, `run_end`
    and per key of the run `gone` and `first_load`, in order."""
    w = Window.partitionBy("_k_prefix", "_k_block").orderBy("_k_at")
    runs = keyed(states, "_id").withColumn("_run", F.col("_k_at") - F.row_number().over(w))
    items = F.array_sort(F.collect_list(F.struct("_k_at", "gone", "first_load")))
    return runs.groupBy("_k_prefix", "_k_block", "_run").agg(F.min("_k_at").alias("run_start"), F.max("_k_at").alias("run_end"), items.alias("members")).drop("_run")


def orphan_keys(references: DataFrame, states: DataFrame) -> DataFrame:
    """Of the distinct ids in `references` (_id, last_seen), those with a doubt: `_id`, `kind` ('missing', 'deleted' or
    'late') and `first_load`; 'late' holds for references loaded before first_load only."""
    distinct = references.groupBy("_id").agg(F.min("seen").alias("first_seen"))
    refs = keyed(distinct, "_id").withColumns({"run_start": F.col("_k_at"), "is_ref": F.lit(1)})
    runs = key_runs(states).withColumn("is_ref", F.lit(0))
    both = runs.unionByName(refs, allowMissingColumns=True)
    w = Window.partitionBy("_k_prefix", "_k_block").orderBy("run_start", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.last(F.when(F.col("is_ref") == 0, F.struct("run_start", "run_end", "members")), ignorenulls=True).over(w)
    matched = both.withColumn("_at", run).filter(F.col("is_ref") == 1)
    beyond = F.col("_at").isNull() | (F.col("_k_at") > F.col("_at.run_end"))
    member = F.when(~beyond, F.element_at(F.col("_at.members"), F.col("_k_at") - F.col("_at.run_start") + 1))
    matched = matched.select("_id", "first_seen", member.alias("m"))
    kind = F.when(F.col("m").isNull(), "missing").when(F.col("m.gone"), "deleted").when(F.col("m.first_load") > F.col("first_seen"), "late")
    return matched.select("_id", kind.alias("kind"), F.col("m.first_load").alias("first_load")).filter(F.col("kind").isNotNull())


def orphan_references(references: DataFrame, parents: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """`references` (with the columns `_id`, a clean id, and `seen`, the load time of the referring row, besides others)
    without their parent, with `kind`. The orphaned ids are few beside the references; Spark broadcasts them where their
    measured size allows, else joins by key with adaptive splitting of hot ids."""
    ids = references.filter(F.col("_id").isNotNull())
    orphans = orphan_keys(ids.select("_id", "seen"), parent_states(parents, deletions))
    late = (F.col("kind") != "late") | (F.col("first_load") > F.col("seen"))
    return ids.join(orphans, "_id").filter(late).drop("first_load")


def header_references(observations: DataFrame, header: DataFrame) -> DataFrame:
    """All references to header.report_id: ref_table, row_id, _id, seen, month (of the referring row), value."""
    def ntz(c: str) -> Column:
        return F.col(c).cast("timestamp_ntz")

    obs = observations.select(F.lit("observations").alias("ref_table"), "row_id", clean_id(F.col("report_id")).alias("_id"), ntz("loaded_at").alias("seen"), F.date_format(ntz("date_time"), "yyyy-MM").alias("month"), F.col("observation_value").alias("value"))
    # only an array can name an id twice in a row
    ids = F.array_distinct(F.transform("duplicates", clean_id))
    named = header.select("row_id", "loaded_at", "report_timestamp", F.explode(ids).alias("_raw"))
    dup = named.select(F.lit("cdm_header").alias("ref_table"), "row_id", F.col("_raw").alias("_id"), ntz("loaded_at").alias("seen"), F.date_format(ntz("report_timestamp"), "yyyy-MM").alias("month"), F.lit(None).cast("double").alias("value"))
    return obs.unionByName(dup)


def found(observations: DataFrame, header: DataFrame, deletions: DataFrame) -> DataFrame:
    """(ref_table, row_id, ref_id, kind), once per row and id."""
    out = orphan_references(header_references(observations, header), header, deletions)
    return out.select("ref_table", "row_id", F.col("_id").alias("ref_id"), "kind")


def by_period(observations: DataFrame, header: DataFrame, deletions: DataFrame) -> DataFrame:
    """Orphans per referring table, month and kind: references, rows, and the observation values left without a header."""
    out = orphan_references(header_references(observations, header), header, deletions)
    return out.groupBy("ref_table", "month", "kind").agg(F.count("*").alias("refs"), F.countDistinct("_id").alias("ids"), F.count("value").alias("n_values"))
