"""Nearest neighbours by a block matrix join over int8 tiles, exact.

Vectors become int8 codes with a scale and the length of what quantisation left out. Codes of queries and candidates are
packed into blocks; a grid pairs every query group with every candidate group, so that each side is replicated once per
group of the other and no single row meets a single row; the original vectors stay behind. In a tile the codes are
multiplied as matrices, and by the triangle inequality give a lower and an upper bound of each distance. Pairs whose lower
bound exceeds the query's k-th smallest upper bound in the tile go; for the others the original vectors are joined by row and
the distance is computed in double precision. The heaps of k pairs that each partition keeps are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import written

#: Vectors of a packed block, and blocks on a side of a tile. A side is sent once per group of the other side,
#: so groups are as large as a task can hold; the matrices of a tile are made block by block.
BLOCK = 512
GROUP = 64
#: Codes run from -127 to 127; float32 adds their products exactly up to this many dimensions.
EXACT_DIM = 1 << 24 >> 14

PACKED = "side string, dim int, grp long, n int, rows binary, ids binary, codes binary, scales binary, errors binary"
FOUND = "q long, c long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (array of double) of the rows that take part.

    Null ids, and vectors null, empty, all zero or holding null or non-finite components, take no part.
    """
    v = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def _codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the lengths of the errors."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1  # subnormal vectors: all codes are 0, the error is the vector
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((v - scale[:, None] * codes.astype(np.float64)) ** 2).sum(axis=1))


def _pack(side: str, groups: int):
    """Code a partition's vectors (row, id, v) and pack them into blocks of one dimension, dealt over ``groups`` groups."""
    schema = pa.schema([("side", pa.string()), ("dim", pa.int32()), ("grp", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "codes", "scales", "errors"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows, ids, vs = held.pop(dim)
            rows = np.array(rows, dtype=np.int64)
            grp = int((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) % np.uint64(groups))
            parts = (rows, np.array(ids, dtype=np.int64), *_codes(np.array(vs, dtype=np.float64)))
            cells = [side, dim, grp, len(rows), *(x.tobytes() for x in parts)]
            return pa.RecordBatch.from_pydict({f.name: [c] for f, c in zip(schema, cells, strict=True)}, schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = held.setdefault(len(row[2]), ([], [], []))
                for part, x in zip(parts, row, strict=True):
                    part.append(x)
                if len(parts[0]) == BLOCK:
                    yield block(len(row[2]))
        for dim in list(held):
            yield block(dim)

    return run


@dataclass
class Coded:
    """A block of codes: the vectors' rows and ids, codes, scales, error lengths, and squared lengths of what the codes stand for."""

    rows: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    scales: np.ndarray
    errors: np.ndarray

    @classmethod
    def of(cls, block) -> Coded:
        longs, doubles = (lambda x: np.frombuffer(x, dtype=np.int64)), (lambda x: np.frombuffer(x, dtype=np.float64))
        codes = np.frombuffer(block.codes, dtype=np.int8).reshape(block.n, block.dim)
        return cls(longs(block.rows), longs(block.ids), codes, doubles(block.scales), doubles(block.errors))

    @property
    def squares(self) -> np.ndarray:
        return self.scales**2 * (self.codes.astype(np.float64) ** 2).sum(axis=1)


def _bounds(q: Coded, c: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances of a tile; infinite between rows of one id."""
    kind = np.float32 if q.codes.shape[1] <= EXACT_DIM else np.float64
    product = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(np.float64)
    qn, cn = q.squares, c.squares
    coded = np.sqrt(np.maximum(qn[:, None] + cn[None, :] - 2 * q.scales[:, None] * c.scales[None, :] * product, 0))
    # What the few roundings of this formula can add up to.
    slack = q.errors[:, None] + c.errors[None, :] + 1e-7 * (np.sqrt(qn)[:, None] + np.sqrt(cn)[None, :])
    own = q.ids[:, None] == c.ids[None, :]
    return np.where(own, np.inf, coded - slack), np.where(own, np.inf, coded + slack)


def _survivors(lower: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that can be among the k nearest of a query."""
    edge = np.partition(upper, k - 1, axis=1)[:, k - 1 : k] if upper.shape[1] > k else np.full((len(upper), 1), np.inf)
    return np.nonzero((lower <= edge) & np.isfinite(lower))


def _search(k: int):
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        sides = {side: [Coded.of(b) for b in part.itertuples()] for side, part in blocks.groupby("side")}
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for q in sides.get("q", ()):
            kept = [], [], [], []
            for c in sides.get("c", ()):
                lower, upper = _bounds(q, c)
                at, to = _survivors(lower, upper, k)
                for part, x in zip(kept, (at, c.rows[to], lower[at, to], upper[at, to]), strict=True):
                    part.append(x)
            if not kept[0]:
                continue
            at, rows, lower, upper = map(np.concatenate, kept)
            # The group's k-th smallest upper bound of each query.
            order = np.lexsort((upper, at))
            first = np.searchsorted(at[order], np.arange(len(q.rows) + 1))
            last = np.minimum(first[:-1] + k - 1, first[1:] - 1)
            edge = np.where(np.diff(first) >= k, upper[order][np.maximum(last, 0)] if len(order) else np.inf, np.inf)
            stay = lower <= edge[at]
            found.append((q.rows[at[stay]], rows[stay]))
        return pd.DataFrame({"q": np.concatenate([f[0] for f in found]), "c": np.concatenate([f[1] for f in found])})

    return run


class _Heaps:
    """The k nearest of each query, a row each; ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, query: int, ids, scores) -> None:
        best = self.kept.setdefault(query, [])
        best += zip(scores, ids, strict=True)
        if len(best) > 4 * self.k:
            self.kept[query] = self.nearest(query)

    def nearest(self, query: int) -> list[tuple[float, int]]:
        return heapq.nsmallest(self.k, self.kept[query])

    def rows(self) -> Iterator[tuple[int, int, int, float]]:
        for query in self.kept:
            for rank, (s, i) in enumerate(self.nearest(query), 1):
                yield query, rank, i, s


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = _Heaps(k)
        for batch in batches:
            frame = batch.to_pandas()
            for query, part in frame.groupby("query_id"):
                heaps.add(int(query), part.vec_id.tolist(), part.score.tolist())
        out = list(heaps.rows())
        cells = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_pydict(
            {n: pa.array(x, t) for n, x, t in zip(("query_id", "rank", "vec_id", "score"), cells, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)}
        )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: each query's k nearest by Euclidean distance.

    Candidates are all usable rows with another id than the query's and as many components; all of them,
    if fewer than k. Ties go to the smaller id. Each row counts: rows that share an id are candidates of their own, and
    query rows that share an id are one query with the candidates of all. Queries that are not usable, or have no
    candidate, give no rows. Other columns are left out.
    """
    # Numbered as written, so that numbers stay.
    numbered = lambda df, name: written(usable(df, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), name).select("row", "id", "v")
    q, c = numbered(queries, "queries"), numbered(vectors, "candidates")
    blocks_q, blocks_c = (max(1, -(-df.count() // BLOCK)) for df in (q, c))
    many_q, many_c = -(-blocks_q // GROUP), max(-(-blocks_c // GROUP), min(blocks_c, vectors.sparkSession.sparkContext.defaultParallelism))
    packed_q = written(q.repartition(many_q).mapInArrow(_pack("q", many_q), PACKED), "query-codes")
    packed_c = written(c.mapInArrow(_pack("c", many_c), PACKED), "candidate-codes")
    fan = lambda df, n, own, other: df.withColumn(own, F.col("grp")).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    tiles = fan(packed_q, many_c, "qg", "cg").unionByName(fan(packed_c, many_q, "cg", "qg"))
    found = tiles.groupBy("dim", "qg", "cg").applyInPandas(_search(k), FOUND)
    # The original vectors of what is left, by row.
    both = found.join(c.select(F.col("row").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("cv")), "c")
    both = both.join(q.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv")), "q")
    squares = F.aggregate(F.zip_with("qv", "cv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)
    scored = both.select("query_id", "vec_id", F.sqrt(squares).alias("score"))
    parts = max(1, min(many_q * 8, 100_000))
    return scored.repartition(parts, "query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 100 against all rows of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
