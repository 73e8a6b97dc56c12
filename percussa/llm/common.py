"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from percussa.session import checkpoint_root

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Bounds of ranges that one query carries.
MOST_CELLS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder of spark.checkpoint.dir."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back: cuts the lineage and survives lost executors.

    Nothing needs the shuffle files behind it any more. Spark deletes them once the driver has collected its garbage,
    which a driver with little to do puts off, so it is asked to here; executors keep their disks for what follows. What the
    caller still held when the last table was written is garbage only by the time of the next one, so it is asked before too.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, what)
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once a row, though a lambda uses it for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """All words of a text in order; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a column over all rows."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces_of(total: int, each: int) -> int:
    """How many shards of about `each` bytes hold `total` bytes; grows with the data."""
    return max(1, -(-total // each))


def range_cells(docs: DataFrame, key: str, cell_bytes: int) -> Column:
    """The number of a row's range of `key`; ranges hold about `cell_bytes` of text."""
    n = min(MOST_CELLS, pieces_of(total_bytes(docs, "text"), cell_bytes))
    bounds = docs.agg(F.percentile_approx(key, F.lit([k / n for k in range(1, n)] or [0.5]), 10 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    block = 64
    every, heads = F.lit(bounds).cast("array<long>"), F.lit(bounds[::block]).cast("array<long>")
    coarse = F.greatest(F.size(F.filter(heads, lambda b: b <= F.col(key))), F.lit(1))
    fine = F.size(F.filter(F.slice(every, (coarse - 1) * block + 1, block), lambda b: b <= F.col(key)))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise((coarse - 1) * block + fine).cast("long")


def packed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings end to end (uint8) and their n + 1 offsets; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) \
        else column.cast(pa.large_string()).cast(pa.large_binary())
    column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each; a longer row stands alone."""
    out, begin, n = [], 0, len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(n, max(begin + 1, end))
        out.append((begin, end))
        begin = end
    return out


def words64(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one integer, zeros behind the end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", held.data, 0, (1,)).copy()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def file_system(folder: str):
    """File system and path of a shared folder, for tasks that write or read files of their own formats."""
    from pyarrow import fs

    plain = folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return fs.FileSystem.from_uri(plain if "://" in plain else "file://" + os.path.abspath(plain))


def write_file(folder: str, stem: str, data: bytes) -> str:
    """Write one file under a name that no other attempt uses, and return its name.

    Only the names that a finished task reports count, so a repeated or lost task does no harm.
    """
    where, base = file_system(folder)
    where.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with where.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder.rstrip('/')}/{name}"


def worker_keeps(name: str, make):
    """What `make` gives, made once for each Python worker and kept from task to task under `name`."""
    import sys
    import types

    state = sys.modules.setdefault("_kept_by_this_worker", types.ModuleType("_kept_by_this_worker"))
    if not hasattr(state, name):
        setattr(state, name, make())
    return getattr(state, name)


class Recent:
    """A bounded table in two generations: what was used lately stays, the rest goes when the older one is dropped."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def turn(self) -> dict:
        """The newer generation, begun afresh if it is full; called before a batch, which then only adds to it."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        return self.new

    def missing(self, keys) -> set:
        """Keys that neither generation holds; those of the older one move to the newer."""
        new, old, lost = self.new, self.old, set()
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    lost.add(k)
        return lost
