"""Toxicity by multiple-instance learning: sentences scored from labels of documents.

A sentence's score is the logistic function of the weights of its words' features; a document's is the noisy-or of its
sentences': it is toxic unless every sentence is clean. Only documents have labels, so the gradient of a
document's likelihood is shared out among its sentences by how much each explains the label, and the
sentences that offend emerge. Weights start from the features' log-odds between toxic and clean documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import quoted, released, small_batches, spare, written
from tessella.llm.features import BITS, Block, blocks

#: Labelled documents that the model is fitted on: those with the smallest hash of their id.
MAX_FIT = 20_000
#: Documents of the fit that must hold a feature for it to get a weight, and its least absolute log-odds.
MIN_DOCS, MIN_ODDS = 3, 1.0
EPOCHS, RATE, DECAY, START = 40, 0.5, 1e-4, -9.0
THRESHOLD = 0.3
#: Weights nearer to 0 are left out; bits that the table of known features leaves out.
LEAST, SHIFT = 0.05, 10


class Weights:
    """Weights of the features that have one, found by their sorted hashes; a table of their upper bits passes over most others."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: float):
        self.slots, self.weights, self.bias = slots, weights, bias
        self.some = np.zeros(1 << (BITS - SHIFT), dtype=bool)
        self.some[slots >> SHIFT] = True

    def of(self, slot: np.ndarray) -> np.ndarray:
        out = np.zeros(len(slot))
        hit = np.flatnonzero(self.some[slot >> SHIFT])
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, slot[hit]), len(self.slots) - 1)
            out[hit] = np.where(self.slots[at] == slot[hit], self.weights[at], 0.0)
        return out


def _used(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Slots and the sentence of each, once per sentence."""
    per_word = np.zeros(len(b.slots), np.int64)
    per_word[b.sentence[1:]] = 1
    sentence = np.repeat(np.cumsum(per_word), b.slots.shape[1])
    slot = b.slots.ravel()
    key = (sentence << BITS) | slot
    key = np.unique(key[slot >= 0])
    return (key & ((1 << BITS) - 1)).astype(np.int32), (key >> BITS).astype(np.int32)


Bag = tuple[np.ndarray, np.ndarray]  # slots and the sentence of each, of one document


def bags_of(texts: pa.Array) -> Iterator[Bag]:
    for b in blocks(texts):
        slot, sentence = _used(b)
        of = np.searchsorted(b.sentences_of, sentence, side="right") - 1
        cuts = np.searchsorted(of, np.arange(len(b.bounds)))
        yield from ((slot[i:j], sentence[i:j]) for i, j in zip(cuts, cuts[1:], strict=False))


def fit(bags: list[Bag], every: np.ndarray, labels: np.ndarray, known: np.ndarray, odds: np.ndarray) -> Weights:
    """The model from documents' bags of the ``known`` slots (ascending, with their log-``odds``), counts of all sentences, and 0/1 labels."""
    y = labels.astype(np.float64)
    none = np.zeros(0, np.int32)
    if not len(y) or y.min() == y.max():
        return Weights(none, np.zeros(0), -20.0 if not len(y) or y[0] == 0 else 20.0)
    if not len(known):
        return Weights(none, np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    # Sentences that hold a kept feature; of the others of a document only the count matters, their score is the bias'.
    slots, rows, row_doc, plain, n = [], [], [], np.zeros(len(y)), 0
    for d, (slot, sentence) in enumerate(bags):
        kept, row = np.unique(sentence, return_inverse=True)
        plain[d] = every[d] - len(kept)
        slots.append(np.searchsorted(known, slot))
        rows.append(row + n)
        row_doc.append(np.full(len(kept), d))
        n += len(kept)
    slots, rows, row_doc = map(np.concatenate, (slots, rows, row_doc))
    w = np.where(odds > 0, 1.2 * odds, 0.0)
    bias, seen = START, np.full(len(w), 1e-2)

    def clean_odds(bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Minus the log of the chance that all sentences of a document are clean, and the sentences' logits."""
        z = np.clip(np.bincount(rows, weights=w[slots], minlength=n) + bias, -30, 30)
        return np.bincount(row_doc, weights=np.logaddexp(0, z), minlength=len(y)) + plain * np.log1p(np.exp(bias)), z

    def loss(bias: float) -> float:
        clean, _ = clean_odds(bias)
        return float(-np.where(y == 1, np.log(np.maximum(-np.expm1(-clean), 1e-12)), -clean).sum())

    for epoch in range(EPOCHS):
        clean, z = clean_odds(bias)
        toxic = np.maximum(-np.expm1(-clean), 1e-9)
        # d log-likelihood / dz of a sentence: p (1 - P) / P in toxic documents, -p in clean ones
        share = np.where(y == 1, np.exp(-clean) / toxic, -1.0)
        g = share[row_doc] / (1 + np.exp(-z))
        gw = np.bincount(slots, weights=g[rows], minlength=len(w)) - DECAY * len(y) * w
        seen += gw**2
        w += RATE * gw / np.sqrt(seen)
        if epoch % 5 == 4:  # the bias alone, on a grid: a sentence without any sign must not add up in long texts
            bias = min(np.arange(-14, -2, 0.5), key=loss)
    told = np.abs(w) >= LEAST
    return Weights(known[told], w[told], float(bias))


def _scores(b: Block, model: Weights) -> np.ndarray:
    """Logits of a block's sentences."""
    slot, sentence = _used(b)
    return np.clip(np.bincount(sentence, weights=model.of(slot), minlength=len(b.sentence)) + model.bias, -30, 30)


BAGS = "doc_id long, key long, toxic int, every int, slots array<int>, sentences array<int>"


def _bag_rows(ids: pa.Array, keys: pa.Array, toxic: pa.Array, every: pa.Array, sizes: np.ndarray, slots: np.ndarray, sentences: np.ndarray) -> pa.RecordBatch:
    """Rows of bags from the slots and sentences of all, ``sizes`` of each."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (slots, sentences)]
    return pa.RecordBatch.from_arrays([ids, keys, toxic, every, *lists], ["doc_id", "key", "toxic", "every", "slots", "sentences"])


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Weights:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), fitted on at most ``max_fit`` rows.

    Features are made where the texts are and counted there; one task gathers only those that get a weight. Null labels
    and ids take no part, several labels of an id count as the largest; of more than ``max_fit`` rows those with the
    smallest hashes of id and text do. Without any label, or with one kind only, the model says that kind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    sample = sample.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("toxic").cast("int").alias("toxic"), "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = list(bags_of(batch.column(3)))
            every = pa.array([len(np.unique(b[1])) for b in bags], pa.int32())
            slots, sentences = (np.concatenate([np.zeros(0, np.int32), *(b[k] for b in bags)]) for k in (0, 1))
            yield _bag_rows(*batch.columns[:3], every, np.array([len(b[0]) for b in bags], dtype=np.int64), slots, sentences)

    rows = written(sample.mapInArrow(released(featured), BAGS), "toxicity-features")
    if rows.count() > max_fit:  # ids that repeat
        rows = written(rows.orderBy("key", "doc_id").limit(max_fit), "toxicity-features")
    of = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, n = of.toxic or 0, of.n
    counts = rows.select("toxic", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count("*").alias("many"), F.sum("toxic").alias("hit"))
    odds = F.log((F.col("hit") + 0.5) / (toxic + 1)) - F.log((F.col("many") - F.col("hit") + 0.5) / (n - toxic + 1))
    told = counts.filter(F.col("many") >= MIN_DOCS).select("slot", odds.alias("odds")).filter(F.abs("odds") >= MIN_ODDS)
    told = sorted((r.slot, r.odds) for r in told.collect())  # bounded by the sample
    known, odds = np.array([t[0] for t in told], dtype=np.int32), np.array([t[1] for t in told])
    held = spark.sparkContext.broadcast(known)

    def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False)
            slots, sentences = (pc.list_flatten(batch.column(k)).to_numpy(zero_copy_only=False) for k in (4, 5))
            keep = known[np.minimum(np.searchsorted(known, slots), len(known) - 1)] == slots if len(known) else np.zeros(len(slots), dtype=bool)
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            yield _bag_rows(*batch.columns[:4], left, slots[keep], sentences[keep])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, every, y = [], [], []
        for batch in batches:
            bags += [tuple(np.array(x, dtype=np.int32) for x in b) for b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            every += batch.column(3).to_pylist()
            y += batch.column(2).to_pylist()
        model = fit(bags, np.array(every), np.array(y, dtype=np.int64), held.value, odds)
        yield pa.RecordBatch.from_pydict({"slot": np.append(-1, model.slots).astype(np.int64), "weight": np.append(model.bias, model.weights)})

    # Sorted, so that a rerun adds in the same order.
    kept = rows.mapInArrow(released(told_apart), BAGS).repartition(1).sortWithinPartitions("doc_id", "key")
    model = written(kept.mapInArrow(released(fitted), "slot long, weight double"), "toxicity")
    rows = sorted((r.slot, r.weight) for r in model.collect()) or [(-1, -20.0)]
    return Weights(np.array([r[0] for r in rows[1:]], dtype=np.int32), np.array([r[1] for r in rows[1:]]), rows[0][1])


def score(docs: DataFrame, model: Weights, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Add ``score`` double and ``offending`` array<struct<start, end int (bytes), score double>> to each row of ``docs``.

    ``offending`` has the sentences that reach ``threshold`` alone, in text order. A null, empty or blank text has no
    sentence and the score 0. Columns of ``docs`` with the added names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score", "offending")
    held = spark.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    found = "array<struct<start:int,end:int,score:double>>"
    out_type = f"struct<score:double,offending:{found}>"
    kind = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    @F.arrow_udf(out_type)
    def scored(texts: pa.Array) -> pa.Array:
        model = held.value
        scores, marks = [], []
        for b in blocks(texts):
            z = _scores(b, model) if len(b.sentence) else np.zeros(0)
            clean = np.append(0, np.cumsum(np.logaddexp(0, z)))
            cuts = b.sentences_of
            scores += (-np.expm1(-(clean[cuts[1:]] - clean[cuts[:-1]]))).tolist()
            hit = np.flatnonzero(z >= np.log(threshold / (1 - threshold)))
            of = np.searchsorted(cuts, hit, side="right") - 1
            last = np.append(b.sentence[1:], len(b.starts)) - 1
            some: dict[int, list] = {}
            for s, t in zip(hit.tolist(), of.tolist(), strict=True):
                base = int(b.bounds[t])
                some.setdefault(t, []).append({"start": int(b.starts[b.sentence[s]]) - base, "end": int(b.ends[last[s]]) - base, "score": float(1 / (1 + np.exp(-z[s])))})
            marks += [some.get(t, []) for t in range(len(cuts) - 1)]
        return pa.array([{"score": s, "offending": m} for s, m in zip(scores, marks, strict=True)], kind)

    at, = spare(docs, "_scored")
    out = docs.withColumn(at, scored(F.col(text_col)))
    return out.select(*quoted(docs), F.col(f"{at}.score").alias("score"), F.col(f"{at}.offending").alias("offending"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt from the labels outside the held-out quarter. A row without doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.filter(remainder(F.col("doc_id")) != 2))
    out = score(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
        "offending",
    )
