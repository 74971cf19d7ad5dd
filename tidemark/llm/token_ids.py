"""Encoding of a corpus by a public byte-level tokenizer (problem 8).

Texts up to PIECE characters are encoded whole. Longer ones are cut into pieces wherever PIECE falls, the pieces are encoded
in parallel over the cluster, and a tree of concatenations joins neighbours: the text of a growing window around the
join, from sure boundaries of the pre-tokenizer on either side, is encoded again until its outer segments agree exactly
with what both sides have; the ids within the window replace the old ones. If no window agrees, the window is all of both.

A sure boundary is a place that is between two pre-tokens whatever the context: between a letter or digit and a character
of another class, or before white space that follows a character.

Defined results: null and empty texts have no ids (an empty list); special tokens' strings are ordinary text; repeated texts
have equal ids; a row comes out for every row, whether its key is null, repeated or neither; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pre-tokenizer's pattern of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SURE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")
PIECE = 16_384  # characters
WINDOW = 64  # characters on either side of a join, at first


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str = FOLDER):
    """(tiktoken encoding, bytes of each token), once per worker process."""
    import tiktoken

    path = os.path.join(folder, f"{name}.tiktoken")
    # a machine without the folder has the file that the driver sent
    with open(path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _upto(lengths: np.ndarray, size: int) -> int:
    """How many of the tokens cover exactly `size` bytes from the start; -1 if no boundary of tokens is there."""
    ends = np.cumsum(lengths)
    n = int(np.searchsorted(ends, size))
    return 0 if size == 0 else n + 1 if n < len(ends) and ends[n] == size else -1


def join(left: np.ndarray, right: np.ndarray, encoding, lengths: np.ndarray) -> np.ndarray:
    """Ids of the concatenated texts of two id sequences, each exact for its own text."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    span = WINDOW
    while True:
        a, b = left[-span:], right[:span]  # a token is a byte at least
        whole = len(a) == len(left) and len(b) == len(right)
        before, after = encoding.decode_bytes(a.tolist()), encoding.decode_bytes(b.tolist())
        # a token may end within a character
        skip = 0 if len(a) == len(left) else next((i for i in range(min(4, len(before))) if before[i] & 0xC0 != 0x80), 0)
        try:
            x, y = before[skip:].decode(), _whole_characters(after)
        except UnicodeDecodeError:
            x = y = ""
        if whole:
            return np.asarray(encoding.encode_ordinary(before.decode() + after.decode()), dtype=np.int32)
        ls, rs = [m.start() for m in SURE.finditer(x) if 0 < m.start() < len(x)], [m.start() for m in SURE.finditer(y) if 0 < m.start() < len(y) - 1]
        if len(a) == len(left):
            ls = [0, *ls]
        if len(b) == len(right):
            rs = [*rs, len(y)]
        if len(ls) >= 2 and len(rs) >= 2:
            # outer segments x[lo:l1] and y[r1:hi] must come out as they are
            lo, l1, r1, hi = ls[0], ls[-1], rs[0], rs[-1]
            new = np.asarray(encoding.encode_ordinary(x[lo:] + y[:hi]), dtype=np.int32)
            sizes = lengths[new]
            total = int(sizes.sum())
            old_lo, old_hi = _upto(lengths[a], skip + len(x[:lo].encode())), _upto(lengths[b], len(y[:hi].encode()))
            old_l1, old_r1 = _upto(lengths[a], skip + len(x[:l1].encode())), _upto(lengths[b], len(y[:r1].encode()))
            new_l1, new_r1 = _upto(sizes, len(x[lo:l1].encode())), _upto(sizes, total - len(y[r1:hi].encode()))
            if min(old_lo, old_hi, old_l1, old_r1, new_l1, new_r1) >= 0 and np.array_equal(new[:new_l1], a[old_lo:old_l1]) and np.array_equal(new[new_r1:], b[old_r1:old_hi]):
                return np.concatenate([left[: len(left) - len(a) + old_lo], new, right[old_hi:]])
        span *= 2


def _whole_characters(data: bytes) -> str:
    """Text of the bytes up to the last whole character."""
    for cut in range(4):
        try:
            return data[: len(data) - cut].decode()
        except UnicodeDecodeError as e:
            if e.end < len(data) - cut:
                raise
    return ""


def concatenate(parts: list[np.ndarray], encoding, lengths: np.ndarray) -> np.ndarray:
    """A tree of joins over the pieces' ids."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], encoding, lengths) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.empty(0, dtype=np.int32)


def _lists(ids: list) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    values = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, piece: int = PIECE, also: list[str] = []) -> DataFrame:
    """(key, *also, ids) of every row; also: columns that go with the row."""
    if os.path.exists(path := os.path.join(folder, f"{name}.tiktoken")):
        documents.sparkSession.sparkContext.addFile(path)
    kept = [key, *also]
    kinds = "".join(f"`{c}` {dict(documents.dtypes)[c]}, " for c in kept)
    rows = documents.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    short, long = rows.filter(F.length("_text") <= piece), rows.filter(F.length("_text") > piece)

    def whole(batches):
        encoding, _ = tokenizer(name, folder)
        for batch in batches:
            # long lists of texts in shares, to hold few ids as Python objects at a time
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encoding.encode_ordinary(t) for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], _lists(ids)], names=[*kept, "ids"])

    def pieces(batches):
        encoding, _ = tokenizer(name, folder)
        for batch in batches:
            ids = [encoding.encode_ordinary(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ids)], names=[*kept, "_hash", "_pos", "_copies", "ids"])

    def tree(batches):
        encoding, lengths = tokenizer(name, folder)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                parts = [p.values.to_numpy(zero_copy_only=False) for p in row.column(len(kept) + 1)[0].values.field("ids")]
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], _lists([concatenate(parts, encoding, lengths)])], names=[*kept, "_copies", "ids"])

    starts = F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / piece).cast("int"))
    parts = F.transform(starts, lambda i: F.substring(F.col("_text"), i * piece + 1, F.lit(piece)))
    # keys may be null or repeated, so a text is told by its hash as well; rows that are alike are encoded once and counted
    cut = long.select(*kept, F.sha2("_text", 256).alias("_hash"), F.posexplode(parts).alias("_pos", "_part"))
    once = cut.groupBy(*kept, "_hash", "_pos").agg(F.count("*").alias("_copies"), F.first("_part").alias("_part"))
    coded = once.mapInArrow(pieces, f"{kinds}_hash string, _pos int, _copies long, ids array<int>")
    gathered = coded.groupBy(*kept, "_hash").agg(F.max("_copies").alias("_copies"), F.sort_array(F.collect_list(F.struct("_pos", "ids"))).alias("_parts")).drop("_hash")
    joined = gathered.mapInArrow(tree, f"{kinds}_copies long, ids array<int>")
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*kept, "ids")
    return short.mapInArrow(whole, f"{kinds}ids array<int>").unionByName(joined)
