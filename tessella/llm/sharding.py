"""Sharding by a Feistel permutation of global row numbers.

Every row gets a number 0..n-1 that depends on the rows' contents alone, a keyed Feistel network with
cycle walking permutes the numbers within 0..n-1, and the permuted position p goes to shard ``p % shards``
at slot ``p // shards``. Shard sizes differ by one row at most, slots are gapless, a rerun gives the same
result, and ``Permutation`` computes the place of a row number, and the row number of a place, without data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import quoted, spare, written

#: Buckets that rows are numbered in; their counts are all that the driver holds.
BUCKETS = 4096
ROUNDS = 4


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), keyed."""
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0..n-1: a balanced Feistel network over the next power of four, cycle-walked."""

    n: int
    seed: int = 42
    rounds: int = ROUNDS

    @property
    def half(self) -> int:
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _keys(self) -> list[int]:
        base = np.arange(1, self.rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return [int(k) for k in _mix(base, self.seed & (2**64 - 1))]

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in reversed(self._keys()) if back else self._keys():
            if back:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        return (left << bits) | right

    def _walk(self, numbers, back: bool) -> np.ndarray:
        out = np.asarray(numbers, dtype=np.uint64)
        with np.errstate(over="ignore"):
            out = self._pass(out, back)
            while (outside := out >= np.uint64(self.n)).any():
                out[outside] = self._pass(out[outside], back)
        return out.astype(np.int64)

    def place(self, numbers) -> np.ndarray:
        """Positions of row numbers."""
        return self._walk(numbers, False)

    def number(self, places) -> np.ndarray:
        """Row numbers at positions; the inverse of ``place``."""
        return self._walk(places, True)


def row_numbers(df: DataFrame, name: str = "row_number") -> tuple[DataFrame, int]:
    """Add a gapless global row number, 0..n-1, that does not depend on files, partitions or order of arrival.

    Rows are bucketed by a hash of all columns, numbered in each bucket in the order of that hash and of the
    columns, and shifted by the counts of the buckets before. Equal rows take neighbouring numbers, so any
    order among them is the same result. Nulls order first. Returns the frame and the number of rows.
    """
    columns = quoted(df)
    by, bucket, at = spare(df, "_hash", "_bucket", "_at")
    hashed = df.select(*columns, F.xxhash64(*columns).alias(by)).withColumn(bucket, F.pmod(by, F.lit(BUCKETS)).cast("int"))
    ties = [c for c, f in zip(columns, df.schema.fields, strict=True) if f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy(bucket).orderBy(by, *ties)
    counts = dict(hashed.groupBy(bucket).count().collect())
    first, total = [], 0
    for b in range(BUCKETS):
        first.append(total)
        total += counts.get(b, 0)
    before = F.lit(np.array(first, dtype=np.int64))
    number = F.row_number().over(order).cast("long") - 1
    out = hashed.withColumn(at, number).withColumn(name, F.col(at) + F.get(before, F.col(bucket)))
    return out.select(*columns, name), total


def permuted(number: Column, n: int, seed: int) -> Column:
    """Position of a row number under the permutation of 0..n-1."""
    law = Permutation(n, seed)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(law.place(numbers.to_numpy()))

    return place(number)


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Add ``shard`` int and ``slot`` long to each row of ``df``; columns of ``df`` with these names are replaced.

    Nulls in any column are values like others. Repeated rows are rows of their own. An empty table stays empty.
    ``slot`` runs gapless from 0 in each shard, and the shards' row counts differ by one at most.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("shard", "slot")
    number, place = spare(df, "_row_number", "_place")
    numbered, n = row_numbers(df, number)
    if not n:
        return numbered.drop(number).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    out = numbered.withColumn(place, permuted(F.col(number), n, seed))
    out = out.withColumns({"shard": (F.col(place) % shards).cast("int"), "slot": F.floor(F.col(place) / shards).cast("long")})
    return out.drop(number, place)


def op4_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the law ``rows``. A null text has no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
    )
    out = shard_rows(written(slim, "op4"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
