"""Select, split, replace, stack, count and de-duplicate rows; all as filters, equi-joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import small

ROW_ID = "_row_id"
IN_LIST = 1000  # longer lists of ids become a join


def leaves(df: DataFrame, root: str) -> list[str]:
    """Paths of the leaf fields of a struct column."""
    from pyspark.sql.types import StructType

    def walk(kind, path: str) -> list[str]:
        return [p for f in kind.fields for p in walk(f.dataType, f"{path}.`{f.name}`")] if isinstance(kind, StructType) else [path]

    return walk(df.schema[root].dataType, root)


def mask_predicate(masks: Sequence[Column | str], boolean: bool) -> Column:
    """Whether all masks of a row are `boolean`; null masks don't count. Without masks all rows are true and none is false."""
    cols = [F.col(m) if isinstance(m, str) else m for m in masks]
    if boolean:
        return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in cols], F.lit(True))
    return ~reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cols], F.lit(False)) if cols else F.lit(False)


def split(df: DataFrame, predicate: Column, inverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selected, rejected) by a predicate; null counts as false."""
    p = F.coalesce(predicate, F.lit(False))
    yes, no = df.filter(p), df.filter(~p)
    return (no, yes) if inverse else (yes, no)


def entries(column: str, values: Iterable) -> Column:
    """Whether a column holds one of the values; null only if listed."""
    values = list(values)
    known = F.col(column).isin([v for v in values if v is not None])
    return F.coalesce(known, F.lit(False)) | F.col(column).isNull() if None in values else F.coalesce(known, F.lit(False))


def split_by_index(df: DataFrame, index: Iterable[int] | DataFrame, inverse: bool = False, row_id: str = ROW_ID) -> tuple[DataFrame, DataFrame]:
    """(selected, rejected) by row ids; a long list or a DataFrame of ids is joined."""
    if not isinstance(index, DataFrame):
        index = list(index)
        if len(index) <= IN_LIST:
            return split(df, F.col(row_id).isin(index), inverse)
        index = df.sparkSession.createDataFrame([(i,) for i in index], f"{row_id} long")
    ids = index.select(row_id).distinct()
    yes, no = df.join(ids, row_id, "left_semi"), df.join(ids, row_id, "left_anti")
    return (no, yes) if inverse else (yes, no)


def index_lists(df: DataFrame, predicate: Column, row_id: str = ROW_ID) -> tuple[DataFrame, DataFrame]:
    """Ids of the rows that a predicate selects, and of the others; as tables, they may be long. `inverse` does not matter for them."""
    yes, no = split(df, predicate)
    return yes.select(row_id), no.select(row_id)


def union_of_ids(*ids: DataFrame) -> DataFrame:
    """Ids of several lists, each once."""
    return reduce(lambda a, b: a.unionByName(b), ids).distinct()


def count_by_cat(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of each column's values as text, nulls as 'nan'; one aggregation for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def replace_columns(left: DataFrame, right: DataFrame, pivot_l: str, pivot_r: str, replace: dict[str, str], check: bool = True) -> DataFrame:
    """`left` with columns overwritten by those of the row of `right` with the same key ({left column: right column});
    null where there is none. A key that stands twice in `right` raises ValueError."""
    if missing := [c for c in replace if c not in left.columns]:
        raise KeyError(f"no such columns: {missing}")
    if check and right.groupBy(pivot_r).count().filter(f"count > 1 AND `{pivot_r}` IS NOT NULL").head(1):
        raise ValueError(f"{pivot_r} is not unique")
    of = small(right.select(F.col(pivot_r).alias("_r_key"), *[F.col(r).alias(f"_r_{i}") for i, r in enumerate(replace.values())]))
    joined = left.join(of, F.col(pivot_l) == F.col("_r_key"), "left")
    new = {c: f"_r_{i}" for i, c in enumerate(replace)}
    return joined.select(*[F.col(new[c]).alias(c) if c in new else F.col(c) for c in left.columns])


def renumber(df: DataFrame, order: Sequence[str] = (ROW_ID,), row_id: str = ROW_ID) -> DataFrame:
    """Dense row ids from 0 in the order of `order`: counted per range partition, then offset; no single task sees all rows."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from tidemark.session import cut

    sorted_ = cut(sorted_)
    sizes = {r["_p"]: r["n"] for r in sorted_.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    start, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p], start = start, start + sizes[p]
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_p")) if offsets else F.lit(0)
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return sorted_.withColumn("_new", (base + at).cast("long")).drop("_p", row_id).withColumnRenamed("_new", row_id)


def stack_v(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns that a frame lacks are null. If any frame is empty, the result is (as defined)."""
    if any(not f.head(1) for f in frames):
        return frames[0].limit(0)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_h(left: DataFrame, right: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Columns side by side, outer by row id; clashing names of the right one get '_2'."""
    names = {c: f"{c}_2" if c in left.columns else c for c in right.columns if c != row_id}
    other = right.select(row_id, *[F.col(c).alias(n) for c, n in names.items()])
    return left.join(other, row_id, "full")


def distinct_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct rows; with `order`, a row id that is not part of the comparison, the first of equal rows."""
    if order is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*rest).agg(F.min(order).alias(order)).select(*df.columns)


def factorize(df: DataFrame, column: str, out: str, row_id: str = ROW_ID) -> DataFrame:
    """Dense code of a column's values in order of first appearance, -1 for null. The distinct values are ranked, not the rows."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("_first"))
    codes = renumber(first.withColumn("_code", F.col("_first")), ("_first",), "_code").select(F.col(column).alias("_value"), F.col("_code"))
    return df.join(codes, F.col(column) == F.col("_value"), "left").withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_value", "_code")


def outer_tables(tables: dict[str, DataFrame], key: str = "report_id") -> DataFrame:
    """Full outer join of tables by key; columns become `table:column`."""
    named = [df.select(F.col(key), *[F.col(c).alias(f"{name}:{c}") for c in df.columns if c != key]) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)
