"""What the operators of this subpackage share: checkpoints, reading and Arrow helpers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.lineage import checkpoint

#: Rows and bytes of text that a kernel works on at once.
TEXT_ROWS, TEXT_BYTES = 512, 4 << 20


def ship(module_name: str) -> None:
    """Send a module's functions to the workers by value, so that they need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], text: int, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``rows`` rows and ``size`` bytes in column ``text``; a longer text is one slice.

    Spark bounds a batch by bytes of its own; kernels that hold many numbers for each byte need less.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            under = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = min(max(under, at + 1), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, however it is written."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows, without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
