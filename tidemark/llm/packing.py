"""Filling containers of fixed capacity with texts (problem 9).

An item is a text measured in tokens; one longer than the capacity is cut into parts that fill a container each and a
rest, which is an item. Items meet in groups of bounded size, drawn by a hash of their key, so groups are alike whatever the
skew of sources; a group is packed by conflict-constrained best fit, copies first, then the largest: bins are ordered by
their residual capacity, a successor search starts at the smallest residual that holds the item and goes on, bin by bin
and residual by residual, until a compatible bin is found. Bins carry bitmaps of their sources and of their clusters of
copies: no bin holds two copies of a text, nor two sources that are declared to conflict. A group of 20,000 texts fills
hundreds of containers and leaves one or two with room, so groups need not meet again.

Defined results: null and empty texts are items of no size, and are placed too; every row is an item, whether its id is null, repeated or neither; copies are told by the text in lower case with white
space collapsed; an empty table has no containers; capacities that are null or below one raise ValueError.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.token_ids import encode
from tidemark.session import cut, small

GROUP = 20_000  # items
KINDS = 1000  # of containers, at most; more raise ValueError
OUT = "container string, bin long, doc_id long, part int, start long, tokens int"


def best_fit(sizes: np.ndarray, sources: list[int], clusters: list[int], conflicts: list[int], capacity: int) -> np.ndarray:
    """Bin of each item. sources: a bit each; clusters: a bit for those with several items, else 0; conflicts: the
    sources that an item's source must not meet, as bits."""
    # copies go first, while many bins have room: they must all lie apart
    order = np.lexsort((-sizes, [c == 0 for c in clusters]))
    place = np.empty(len(sizes), dtype=np.int64)
    residuals: list[int] = []  # those that some bin has, in order
    by: dict[int, list[int]] = {}
    held_sources, held_clusters, barred = [], [], []
    for i in order:
        size, source, cluster, against = int(sizes[i]), sources[i], clusters[i], conflicts[i]
        at, found = bisect_left(residuals, size), -1
        while at < len(residuals) and found < 0:
            left = residuals[at]
            here = by[left]
            for k in range(len(here) - 1, -1, -1):
                b = here[k]
                if not (held_clusters[b] & cluster or held_sources[b] & against or barred[b] & source):
                    found = b
                    here[k] = here[-1]
                    here.pop()
                    if not here:
                        del by[left]
                        residuals.pop(at)
                    break
            at += 1
        if found < 0:
            found, left = len(held_sources), capacity
            held_sources.append(0), held_clusters.append(0), barred.append(0)
        held_sources[found] |= source
        held_clusters[found] |= cluster
        barred[found] |= against
        place[i], left = found, left - size
        if left in by:
            by[left].append(found)
        else:
            by[left] = [found]
            insort(residuals, left)
    return place


def sized(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, tokens, source, cluster) of every document."""
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.when(plain != "", F.xxhash64(plain)).alias("cluster"))
    return encode(rows, name=name, also=["source", "cluster"]).select("doc_id", F.size("ids").alias("tokens"), "source", "cluster")


def pack(documents: DataFrame, containers: DataFrame, conflicts: list[tuple[str, str]] | None = None, name: str = "byte_bpe_50k", group: int = GROUP) -> DataFrame:
    """(container, bin, doc_id, part, start, tokens): where each text or part of one lies, for each kind of container."""
    kinds = [(r.container, r.capacity_tokens) for r in containers.limit(KINDS + 1).collect()]
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    if any(c is None or c < 1 for _, c in kinds):
        raise ValueError("a container needs a capacity")
    items = cut(sized(documents, name))
    groups = max(1, -(-items.count() // group))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).alias("capacity")) for k, c in kinds])).alias("k")
    # rows without an id are spread by their place in the checkpoint, and told by a flag, as pandas has no null integers
    place = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    own = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "tokens", "source", "cluster"]
    rows = items.select(*own, F.pmod(place, F.lit(groups)).cast("int").alias("g"), each).select("doc_id", "none", "tokens", "source", "cluster", "g", "k.*")
    pairs = conflicts or []

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "none", "tokens"], ignore_index=True)
        capacity, number = int(pdf["capacity"].iloc[0]), int(pdf["g"].iloc[0])
        tokens = pdf["tokens"].to_numpy("int64")
        full, rest = tokens // capacity, tokens % capacity
        full = np.where((rest == 0) & (tokens > 0), full - 1, full)  # the last full part is the item itself
        last = tokens - full * capacity
        names = {s: 1 << i for i, s in enumerate(sorted(pdf["source"].unique()))}
        against = dict.fromkeys(names, 0)
        for a, b in pairs:
            if a in names and b in names:
                against[a] |= names[b]
                against[b] |= names[a]
        several = pdf["cluster"].value_counts()
        bit = {c: 1 << i for i, c in enumerate(several[several > 1].index)}
        bins = best_fit(last, [names[s] for s in pdf["source"]], [bit.get(c, 0) for c in pdf["cluster"]], [against[s] for s in pdf["source"]], capacity)
        used = int(bins.max()) + 1
        ids, none, starts = pdf["doc_id"].to_numpy("int64"), pdf["none"].to_numpy(bool), full * capacity
        parts = [pd.DataFrame({"bin": bins, "doc_id": ids, "none": none, "part": full, "start": starts, "tokens": last})]
        n = int(full.sum())
        if n:
            which = np.repeat(np.arange(len(ids)), full)
            nth = np.arange(n) - np.repeat(np.cumsum(full) - full, full)
            parts.append(pd.DataFrame({"bin": used + np.arange(n), "doc_id": ids[which], "none": none[which], "part": nth, "start": nth * capacity, "tokens": capacity}))
        out = pd.concat(parts, ignore_index=True)
        return out.assign(container=pdf["container"].iloc[0], bin=out["bin"] + (number << 32))[["container", "bin", "doc_id", "part", "start", "tokens", "none"]]

    packed = rows.groupBy("container", "g").applyInPandas(fill, OUT + ", none boolean")
    return packed.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def fill_rates(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: bins, items, tokens, and the share of their room that is used."""
    of = small(containers.select("container", "capacity_tokens"))
    out = packed.groupBy("container").agg(F.countDistinct("bin").alias("bins"), F.count("*").alias("items"), F.sum("tokens").alias("tokens")).join(of, "container")
    return out.select("container", "bins", "items", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 4).alias("fill"))
