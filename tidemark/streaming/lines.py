"""The row-local plans on a stream of report lines: the same parser and mapper, appended file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.bundle import read_mdf
from tidemark.operators.mapping import map_model
from tidemark.operators.selection import ROW_ID


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files that arrive in a folder. Ids are hashes of file, place of its part and position within the part's rows, so equal
    lines of a file have ids of their own, and a batch that is run again gives the same ones."""
    lines = spark.readStream.text(folder)
    placed = lines.select(F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("at"), F.col("value").alias("line"))

    def number(batches):
        seen: dict[int, int] = {}  # parts of files that this task reads, each from its start
        for pdf in batches:
            within = pdf.groupby("at").cumcount() + pdf["at"].map(seen).fillna(0).astype("int64")
            for at, n in pdf.groupby("at").size().items():
                seen[at] = seen.get(at, 0) + int(n)
            yield pdf.assign(n=within)

    return placed.mapInPandas(number, "at long, line string, n long").select(F.xxhash64("at", "n").alias(ROW_ID), "line")


def stream_table(spark: SparkSession, folder: str, imodel: str, table: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Parse, validate and map arriving lines to one output table, written as parquet; all that is there, then stop."""
    rows = read_mdf(spark, stream_lines(spark, folder), imodel).df
    mapped = map_model(rows, imodel, table, drop_duplicates=False, **options)[table]
    return mapped.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
