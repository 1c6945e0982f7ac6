"""What the operators of this subpackage share: tables, shared scratch tables, Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystone.sources.scratch import discard, new_path, on, written

__all__ = ["arrow_filter", "arrow_map", "discard", "fold", "fresh", "keep_store", "new_path", "on", "spread", "table", "written"]

#: Rows that a Python worker looks at together, and rows of the batches that reach it.
SLICE_ROWS, BATCH_ROWS = 256, 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in these batches, on both sides outside the heap: keep them small, unless the session
    has a number of its own."""
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # not on this C library
        ctypes.CDLL(None).malloc_trim(0)


_STORES: dict[str, Callable[[], None]] = {}


def keep_store(owner: str, clear: Callable[[], None]) -> None:
    """A module keeps something between the tasks of a worker; clear empties it."""
    _STORES[owner] = clear


def let_go(owner: str) -> None:
    """Empty what other modules keep: their stage is over when another one's task comes to this worker."""
    for name, clear in _STORES.items():
        if name != owner:
            clear()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], columns: list[str], schema: str) -> DataFrame:
    """mapInArrow by slices of SLICE_ROWS rows.  make() runs once a task and gives a function from the lists
    of the named columns to the lists of the columns of schema."""
    target = StructType.fromDDL(schema)
    names = target.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        let_go(make.__module__)
        to = to_arrow_schema(target)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = work([part.column(i).to_pylist() for i in range(len(columns))])
                yield pa.RecordBatch.from_arrays([pa.array(v, to.field(n).type) for v, n in zip(out, names, strict=True)], schema=to)
        give_back()

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, target)


def fold(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def spread(column: str = "doc_id", salt: str = "") -> F.Column:
    """A number in [0, 1) that depends on the id alone: for documented samples, the same at every layout."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def arrow_filter(df: DataFrame, make: Callable[[], Callable[[list[list]], list[bool]]], columns: list[str]) -> DataFrame:
    """The rows of df, with all their columns, for which the function that make() gives is true; no shuffle.
    Columns of df may have any names."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(make.__module__)
        keep = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                if any(mask := keep([part.column(i).to_pylist() for i in at])):
                    yield part.filter(pa.array(mask, pa.bool_()))
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
