"""Blocks of documents, question and answer exchange by hash, and tables that cut lineage.

Corpus-wide questions ("how many documents hold this shingle?") go out once per block and
distinct hash, as packed arrays in one row per (block, hash bucket). The answers come back in
the order of the questions, so they need no keys: a block sorts its own hashes again. A key
that a third of all rows hold is thereby asked once per block, never once per row.

With b blocks there are up to b*b rows. Blocks grow with the square root of the input where that would make rows of
less than ROW_BYTES of text, so the rows grow as the input does: at most one for each ROW_BYTES. A block is looked
through once, whatever the number of buckets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import numtext as T
from quern.plans.storage import new_dir, remove_dir, shared_dir, stash, unstash

#: Bytes of text in a block, at least. A block is what one Python call holds.
BLOCK_BYTES = 6 << 20
#: Bytes of text for each row of an exchange, at least: 100 TB make blocks of 160 MB, 30 GB and less such of BLOCK_BYTES.
ROW_BYTES = 256
#: Partitions that blocks are dealt out to, at most; a partition may hold many blocks, which are looked at one by one.
PARTITIONS = 20_000


def text_stats(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text)"""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def block_count(size: int, block_bytes: int) -> int:
    """The number of blocks for so many bytes of text."""
    return max(1, -(-size // max(block_bytes, math.isqrt(ROW_BYTES * size))))


def partitions(blocks: int) -> int:
    """The number of partitions that so many blocks are dealt out to."""
    return min(blocks, PARTITIONS)


def blocked(docs: DataFrame, extra: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, extra..., m), dealt out by m, and the number of blocks.

    The block of a row follows from its doc_id and text, so repeated ids spread out. The number
    of blocks grows with the bytes of text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    _, size = text_stats(docs)
    blocks = block_count(size, block_bytes)
    m = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.withColumn("m", m).repartition(partitions(blocks), "m"), blocks


def ordered(table):
    """The rows of a block in one fixed order: by doc_id (null first), then by text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if table.num_rows < 2:
        return table.combine_chunks()
    ids = table.column("doc_id").combine_chunks()
    at = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)))
    key = ids.take(pa.array(at))
    same = pc.equal(key.slice(1), key.slice(0, len(key) - 1))
    if pc.any(pc.fill_null(same, True)).as_py():
        texts = table.column("text").to_pylist()
        values = ids.to_pylist()
        at = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, texts[i] is not None, texts[i] or ""))
    return table.take(pa.array(at)).combine_chunks()


def bucket_slices(sorted_hashes: np.ndarray, buckets: int, bits: int) -> list[tuple[int, slice]]:
    """(bucket, its part of a sorted array) of each bucket that has any; buckets are equal ranges of hashes of so many bits."""
    if not len(sorted_hashes):
        return []
    bucket = ((sorted_hashes >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    return [(int(bucket[x]), slice(int(x), int(y))) for x, y in zip([0, *at], [*at, len(bucket)], strict=True)]


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of equal runs and, for each value, the number of its run."""
    new = np.ones(len(sorted_values), dtype=bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


__all__ = ["BLOCK_BYTES", "T", "block_count", "blocked", "bucket_slices", "new_dir", "ordered", "partitions", "remove_dir", "runs", "shared_dir", "stash", "text_stats", "unstash"]
