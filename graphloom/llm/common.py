"""Tables, shared work folders and bounded helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace, prepare, shared_dir  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def returned_names(columns: list[str], taken: list[str]) -> list[str]:
    """The names under which passed-through columns are returned: their own, or, where a result or an earlier column has that name in any case, with _input after it (as often as it takes)."""
    used, out = {t.lower() for t in taken}, []
    for c in columns:
        while c.lower() in used:
            c += "_input"
        used.add(c.lower())
        out.append(c)
    return out


def plain(name: str) -> F.Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give memory that is free but still held by allocators back, so that what a worker held for one stage does not add to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Batches) -> Batches:
    """A function for mapInArrow that gives memory back when its partition is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


class HashBitmap:
    """A bitmap of uniformly hashed 64-bit keys: a superset test of MOST_BITS at most, whatever the number of keys.

    It has some 16 bits a key up to that bound (16 MB), beyond it fewer. It is built by a distributed
    bit_or over words of 64 bits, so the driver gets at most bits / 64 rows. A test may say yes to a key outside the set (callers check
    again by an exact join), never no to one inside it; a fuller bitmap only says yes more often.
    """

    LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27

    def __init__(self, df: DataFrame, key: F.Column) -> None:
        bits = 1 << min(self.MOST_BITS.bit_length() - 1, max(self.LEAST_BITS.bit_length() - 1, (16 * df.count()).bit_length()))
        self.bits = bits
        slots = df.select(key.bitwiseAND(F.lit(bits - 1)).alias("slot"))
        words = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")).toArrow()
        table_ = np.zeros(bits // 64, dtype=np.int64)
        table_[words["word"].to_numpy()] = words["mask"].to_numpy()
        self.shared = df.sparkSession.sparkContext.broadcast(table_.view(np.uint8))

    def test(self, keys: np.ndarray) -> np.ndarray:
        """For each key (uint64 or int64) whether it may be in the set; for use in Python workers."""
        slots = keys.view(np.int64) & np.int64(self.bits - 1)
        return (self.shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
