"""Shared helpers: the cluster's shared folder, cutting lineage, and row identity."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import fresh_dir, shared_dir, written

__all__ = ["WORD", "fresh_dir", "let", "quoted", "read", "released", "shared_dir", "sliced", "small_batches", "spare", "word_count", "written"]

#: Word separators of every word-based operator: blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; lambdas that index an array expression would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold ``BATCH_ROWS`` rows, unless the session asks for fewer: both ends keep a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def _release() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with memory given back after each result and at the end."""

    @functools.wraps(run)
    def around(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            _release()
        _release()

    return around


def sliced(column: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of a text column of about ``size`` bytes, one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > size:
            yield column.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(column):
        yield column.slice(start)
