"""Small helpers over frames that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarterwise.session import file_system_of, new_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """The frame written below the shared folder; the shuffle files behind it go as soon as it is."""
    spark = df.sparkSession
    path = path or new_folder(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored frames that go when the block ends, for steps whose results are stored in turn."""

    def __init__(self) -> None:
        self.made: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        spark = df.sparkSession
        self.made.append((spark, new_folder(spark, label)))
        return stored(df, label, self.made[-1][1])

    def __exit__(self, *_: object) -> None:
        for spark, path in self.made:
            file_system, hadoop_path = file_system_of(spark, path)
            file_system.delete(hadoop_path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name starting with `base` that the frame does not have yet (names differ beyond case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


#: Texts that are handled together at most.
MOST_ROWS = 16_384


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges that cover the column, each of at most MOST_ROWS rows and `limit` bytes of text, or one row."""
    offsets = text_buffers(column)[0]
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + MOST_ROWS)
        yield lo, hi
        lo = hi


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, UTF-8 bytes) of a text column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def rows_of(batches: Iterable[pa.RecordBatch], columns: list[str], limit: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        for lo, hi in text_slices(batch.column(text), limit):
            yield batch.slice(lo, hi - lo).select(columns)
