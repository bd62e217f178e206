"""Quality classifier by co-training on two views of a document.

The content view sees what the text is made of: shares of kinds of characters, lengths and repetition of words. The
metadata view sees language, source, and the page's extent and layout. Each view has an additive classifier
over quantile bins. Over rounds, each labels the documents of an unlabelled pool that it is most sure of, for the
other to learn from. Both are then calibrated on labelled documents kept aside, and combined for all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import quoted, released, small_batches, spare, written
from tessella.llm.shingles import words

#: Labelled documents fitted on, and unlabelled ones of the pool: those with the smallest hash of their id.
MAX_FIT, MAX_POOL = 20_000, 10_000
ROUNDS, PER_ROUND, SURE = 4, 500, 0.95
#: Of the labelled documents, one in so many is kept for the calibration.
ASIDE = 5
BINS, BUCKETS = 16, 64
#: A document whose score is below this is rejected.
REJECT = 0.1
BLOCK = 1 << 20

#: Kinds of characters, by ASCII members; letters, digits and what is not ASCII are kinds of their own.
_KINDS = [" ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "|", "%", "$", "#", "&", "*", "\"'`", "()[]{}", "<>", "@/\\", "-_", ":;", "+=~^"]
_KIND = np.zeros(256, dtype=np.int64)
for _i, _members in enumerate(_KINDS):
    _KIND[[ord(c) for c in _members]] = _i + 6
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[ord(c) for c in "0123456789"]] = 3
_KIND[0xC0:] = 4
_KIND[0x80:0xC0] = 5
_WIDTH = len(_KINDS) + 6
CONTENT, META = _WIDTH + 4, 5


def numbers(texts: pa.Array) -> np.ndarray:
    """A row for each text: ``CONTENT`` numbers of its content, then ``META`` of its extent and layout. Null counts as empty."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(texts), CONTENT + META))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        part, n = data[offsets[at] : offsets[to]], to - at
        of = np.repeat(np.arange(n), np.diff(bounds))
        kinds = np.bincount(of * _WIDTH + _KIND[part], minlength=n * _WIDTH).reshape(n, _WIDTH).astype(np.float64)
        chars = np.maximum(kinds.sum(axis=1) - kinds[:, 5], 1)
        hashes, per = words(part, bounds)
        many = np.diff(per).astype(np.float64)
        distinct, most, twice = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            own = hashes[per[i] : per[i + 1]]
            if len(own):
                _, times = np.unique(own, return_counts=True)
                distinct[i], most[i] = len(times), times.max()
                twice[i] = (own[1:] == own[:-1]).sum()
        total = np.maximum(many, 1)
        solid = kinds.sum(axis=1) - kinds[:, 5] - kinds[:, 6:9].sum(axis=1)
        lines = kinds[:, 7] + 1
        out[at:to, :_WIDTH] = kinds / chars[:, None]
        out[at:to, _WIDTH:CONTENT] = np.stack([solid / total, distinct / total, most / total, twice / total], axis=1)
        out[at:to, CONTENT:] = np.stack([chars, many, lines, chars / lines, many / lines], axis=1)
        at = to
    return out


def _bucket(values: pa.Array) -> np.ndarray:
    """Buckets of category names; null has one of its own."""
    names = values.to_pylist()
    of = {v: BUCKETS if v is None else zlib.crc32(v.encode()) % BUCKETS for v in set(names)}
    return np.array([of[v] for v in names], dtype=np.int64)


@dataclass
class View:
    """An additive logistic model over bins of numbers and buckets of categories."""

    edges: np.ndarray  # numbers x (BINS - 1)
    weights: np.ndarray
    bias: float = 0.0

    def cells(self, x: np.ndarray, categories: np.ndarray) -> np.ndarray:
        """Rows of one-hot positions."""
        at = np.stack([np.searchsorted(e, x[:, j], side="right") + j * BINS for j, e in enumerate(self.edges)], axis=1)
        base = len(self.edges) * BINS
        return np.concatenate([at, categories + base + np.arange(categories.shape[1]) * (BUCKETS + 1)], axis=1)

    def logits(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(axis=1) + self.bias

    def fit(self, cells: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 150) -> None:
        """Weighted logistic loss with a ridge, by gradient steps scaled per weight."""
        size = len(self.weights)
        self.weights, self.bias = np.zeros(size), float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
        seen, seen_b = np.full(size, 1e-3), 1e-3
        for _ in range(steps):
            g = w * (y - 1 / (1 + np.exp(-np.clip(self.logits(cells), -30, 30))))
            gw = np.bincount(cells.ravel(), weights=np.repeat(g, cells.shape[1]), minlength=size) - 1.0 * self.weights
            seen += gw**2
            seen_b += g.sum() ** 2
            self.weights += 0.3 * gw / np.sqrt(seen)
            self.bias += 0.3 * g.sum() / np.sqrt(seen_b)


def _calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression of y on the columns of z and 1, by Newton steps with a small ridge."""
    x = np.column_stack([z, np.ones(len(z))])
    c = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-2 * np.eye(len(c))
        c += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * c)
    return c


@dataclass
class CoTrained:
    content: View
    meta: View
    scales: np.ndarray  # a row for each view: slope and shift
    joint: np.ndarray  # of the two calibrated logits, and 1

    def scores(self, x: np.ndarray, categories: np.ndarray) -> np.ndarray:
        """Columns: combined, content and metadata probability of good quality."""
        z = self.views(x, categories) * self.scales[:, 0] + self.scales[:, 1]
        both = np.column_stack([z, np.ones(len(z))]) @ self.joint
        return 1 / (1 + np.exp(-np.clip(np.column_stack([both, z]), -30, 30)))

    def views(self, x: np.ndarray, categories: np.ndarray) -> np.ndarray:
        none = categories[:, :0]
        return np.column_stack([
            self.content.logits(self.content.cells(x[:, :CONTENT], none)),
            self.meta.logits(self.meta.cells(x[:, CONTENT:], categories)),
        ])


def _view(x: np.ndarray, categories: int) -> View:
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T if len(x) else np.zeros((x.shape[1], BINS - 1))
    return View(edges, np.zeros(x.shape[1] * BINS + categories * (BUCKETS + 1)))


def co_train(x: np.ndarray, categories: np.ndarray, labels: np.ndarray) -> CoTrained:
    """The model of rows whose label is 1, 0 or nan (the pool), in an order that is as good as random."""
    known = ~np.isnan(labels)
    model = CoTrained(_view(x[:, :CONTENT], 0), _view(x[:, CONTENT:], categories.shape[1]), np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([0.5, 0.5, 0.0]))
    y0 = labels[known]
    if not len(y0) or y0.min() == y0.max():
        # Nothing to tell apart: all are what the labels say, and good without any.
        model.joint = np.array([0.0, 0.0, 20.0 if not len(y0) or y0[0] == 1 else -20.0])
        return model
    views = (model.content, model.meta)
    cells = (model.content.cells(x[:, :CONTENT], categories[:, :0]), model.meta.cells(x[:, CONTENT:], categories))
    place = np.cumsum(known) - 1
    aside = known & (place % ASIDE == 0)
    taught = [np.where(known & ~aside, labels, np.nan) for _ in views]
    pool = ~known
    good = float(np.nanmean(labels))
    for turn in range(ROUNDS + 1):
        for view, cell, y in zip(views, cells, taught, strict=True):
            on = ~np.isnan(y)
            # a pseudo-label counts half
            view.fit(cell[on], y[on], np.where(known[on], 1.0, 0.5))
        if turn == ROUNDS or not pool.any():
            break
        gone = np.zeros(len(pool), dtype=bool)
        for k, (view, cell) in enumerate(zip(views, cells, strict=True)):
            z = np.where(pool, view.logits(cell), np.nan)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            for kind, share, sure in ((1, good, p), (0, 1 - good, 1 - p)):
                best = np.argsort(-np.nan_to_num(sure, nan=-1.0), kind="stable")[: max(1, round(PER_ROUND * share))]
                best = best[np.nan_to_num(sure[best], nan=0.0) >= SURE]
                taught[1 - k][best] = kind
                gone[best] = True
        pool &= ~gone
    z = np.column_stack([v.logits(c[aside]) for v, c in zip(views, cells, strict=True)])
    y = labels[aside]
    if y.min() != y.max():
        model.scales = np.array([_calibrated(z[:, [k]], y) for k in (0, 1)])
        model.joint = _calibrated(z * model.scales[:, 0] + model.scales[:, 1], y)
    return model


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_pool: int = MAX_POOL) -> CoTrained:
    """The model from ``docs`` (doc_id, text, lang, source) and ``labels`` (doc_id, quality).

    Features are made where the texts are; one task gathers them for at most ``max_fit`` labelled and ``max_pool``
    other documents, and no more rows in all. Null ids and labels take no part, several labels of an id count as the smallest.
    """
    small_batches(docs.sparkSession)
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    few = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    others = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).join(own, "doc_id", "left_anti").distinct()
    wanted = few(own, max_fit).unionByName(few(others, max_pool).withColumn("y", F.lit(None).cast("double")))
    sample = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "text", "lang", "source")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = numbers(b.column(2))
            cats = np.stack([_bucket(b.column(3)), _bucket(b.column(4))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(cats.tolist(), pa.list_(pa.int64()))], ["doc_id", "y", "x", "c"])

    rows = written(sample.mapInArrow(released(featured), "doc_id long, y double, x array<double>, c array<long>"), "quality")
    if rows.count() > max_fit + max_pool:  # ids that repeat
        rows = written(rows.orderBy(F.xxhash64("doc_id", "x"), "doc_id").limit(max_fit + max_pool), "quality")

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(batches))
        n = len(all_rows)
        x = np.array(all_rows.x.tolist(), dtype=np.float64).reshape(n, CONTENT + META)
        c = np.array(all_rows.c.tolist(), dtype=np.int64).reshape(n, 2)
        m = co_train(x, c, all_rows.y.to_numpy(dtype=np.float64))
        parts = {"e0": m.content.edges, "w0": m.content.weights, "b0": m.content.bias, "e1": m.meta.edges, "w1": m.meta.weights, "b1": m.meta.bias, "scales": m.scales, "joint": m.joint}
        yield pd.DataFrame({"part": parts.keys(), "v": [np.ravel(v).tolist() for v in parts.values()]})

    ready = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "x")
    parts = {r.part: np.array(r.v) for r in ready.mapInPandas(released(fitted), "part string, v array<double>").collect()}
    if not parts:
        return co_train(np.zeros((0, CONTENT + META)), np.zeros((0, 2), np.int64), np.zeros(0))
    views = [View(parts[f"e{k}"].reshape(-1, BINS - 1), parts[f"w{k}"], float(parts[f"b{k}"][0])) for k in (0, 1)]
    return CoTrained(*views, parts["scales"].reshape(2, 2), parts["joint"])


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """Add ``quality_score``, ``content_score`` and ``meta_score`` double, 0 to 1, to each row of ``docs`` (text, lang, source).

    Null and empty texts, and null languages and sources, are scored like any other. Columns of ``docs`` with the added
    names are replaced.
    """
    names = ("quality_score", "content_score", "meta_score")
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("struct<a:double,b:double,c:double>")
    @released
    def scored(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, lang, source in batches:
            s = held.value.scores(numbers(text), np.stack([_bucket(lang), _bucket(source)], axis=1))
            yield pa.StructArray.from_arrays([pa.array(s[:, k]) for k in range(3)], ["a", "b", "c"])

    at, = spare(docs, "_scored")
    out = docs.withColumn(at, scored("text", "lang", "source"))
    return out.select(*quoted(docs), *(F.col(f"{at}.{f}").alias(n) for f, n in zip("abc", names, strict=True)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the co-trained model; ``keep`` is false for those rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    out = score(docs, model)
    return out.select("doc_id", "quality_score", "content_score", "meta_score", (F.col("quality_score") >= REJECT).alias("keep"))
