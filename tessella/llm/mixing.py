"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, on DataFrame functions only.

1. Each source's target is its weighted share of all words, stopped at ``max_epochs`` times its size; what
   exceeds that is shared again by weight until no target is above.
2. A source's documents are dealt by a hash into about sqrt(n) blocks, numbered in each epoch by a keyed
   permutation. Whole epochs take every block. Of the last epoch a prefix of the permuted blocks is taken,
   and of the next few blocks as many documents as the target has room for.
3. The block quotas of all sources are split among the output shards by a binary tree: at a node the left
   half's quotas are one multivariate-hypergeometric draw from the node's. Down to the leaves the quotas add
   up exactly, and a shard takes the next blocks, in permuted order, of each source: disjoint for any two shards.
4. Within a shard rows are ordered by a keyed hash of document and epoch.

The driver holds a row for each source and nothing that grows with the documents. Of the blocks' table only
sums over sqrt(n) rows are formed at a time, and only the documents of EDGE blocks of a source, a few sqrt(n),
are looked at one by one; so a source with a third of all rows is no task of its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import quoted, spare, word_count, written

#: Weights by rank of the source, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: Blocks behind the prefix whose documents are looked at one by one, and passes that fill what is left with them.
EDGE = 8
PASSES = 6
#: Balls of a kind below which the generator draws exactly.
LIMIT = 1_000_000_000
#: Rows of chosen documents up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def targets(sizes: list[int], weights: list[float], total: int, most: float = 3.0) -> list[float]:
    """Weighted shares of ``total``, stopped at ``most`` times the sizes, the excess reshared by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if weight <= 0 or left * weights[i] / weight >= most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
            free.remove(i)
        left = max(0.0, float(total) - sum(out[i] for i in range(len(sizes)) if i not in free))
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of ``shards`` leaves (rows) by source (columns): the columns' sums are ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left, drawn = shards // 2, np.zeros_like(quotas)
    total = int(quotas.sum())
    take = total * left // shards
    # One draw of `take` from the node, a source after the other: the marginals of the multivariate law.
    rest = total
    for i, q in enumerate(map(int, quotas)):
        rest -= q
        drawn[i] = _hypergeometric(rng, q, rest, take)
        take -= int(drawn[i])
    return np.vstack([split(drawn, left, rng), split(quotas - drawn, shards - left, rng)])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) >= LIMIT:  # that many blocks of sqrt(n) documents are beyond any corpus
        raise ValueError(f"{good + bad} blocks are more than can be drawn from exactly")
    return int(rng.hypergeometric(good, bad, n))


def _step(n: int, key: int) -> int:
    """A multiplier coprime to n."""
    a = key % n or 1
    while math.gcd(a, n) != 1:
        a += 1
    return a


def mix(
    docs: DataFrame,
    shards: int = 64,
    seed: int = 42,
    max_epochs: int = 3,
    size: Column | None = None,
    cycle: tuple[float, ...] = CYCLE,
) -> DataFrame:
    """Add ``mix_size`` and ``mix_source_size`` long, ``mix_target`` double (its source's) and
    ``mix_copies`` array<struct<epoch int, shard int, key long>> to each row of ``docs``.

    ``docs`` needs doc_id, text and source. ``mix_copies`` has an entry for each time the mix takes the row, none
    up to ``max_epochs``. Sources rank by code point, null last, and weigh ``cycle`` repeating. Rows without words
    are in no epoch's way and come with the block they are in. Rows equal in doc_id, source and text share
    their fate. An empty table stays empty. Columns of ``docs`` with the added names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    size = word_count(F.col("text")) if size is None else size
    key, = spare(docs, "_mix_key")
    keyed = docs.select(*quoted(docs), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias(key), size.alias("mix_size"))
    names = [r for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()]
    if not names:
        empty = F.array().cast("array<struct<epoch:int,shard:int,key:bigint>>")
        return keyed.drop(key).withColumns({"mix_source_size": F.lit(0).cast("long"), "mix_target": F.lit(0.0), "mix_copies": empty})
    names.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    blocks_of = [math.isqrt(r.n - 1) + 1 for r in names]
    index = spark.createDataFrame([(r.source, i, b) for i, (r, b) in enumerate(zip(names, blocks_of, strict=True))], "src string, s int, nb long")

    def placed(df: DataFrame, extra: DataFrame) -> DataFrame:
        # a row for each source
        return df.join(F.broadcast(extra), df["source"].eqNullSafe(extra["src"])).drop("src")

    block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.col("nb"))
    slim = placed(keyed.select("source", key, "mix_size"), index).select("s", "nb", block.alias("b"), key, "mix_size")
    slim = written(slim, "mix-sizes")
    table = written(slim.groupBy("s", "b").agg(F.sum("mix_size").alias("words")), "mix-blocks")
    words = dict(table.groupBy("s").agg(F.sum("words")).collect())
    sizes = [words.get(i, 0) for i in range(len(names))]
    goal = targets(sizes, [cycle[i % len(cycle)] for i in range(len(names))], sum(sizes), max_epochs)
    rng = np.random.default_rng(seed)
    full = [min(max_epochs, int(t // n)) if n else 0 for t, n in zip(goal, sizes, strict=True)]
    steps = [[_step(b, int(rng.integers(1, 1 << 31))) for _ in range(max_epochs + 1)] for b in blocks_of]
    shifts = [[int(rng.integers(0, b)) for _ in range(max_epochs + 1)] for b in blocks_of]

    # The prefix of the last epoch's permuted blocks that the rest of the target holds.
    rank = lambda e: F.pmod(F.col("b") * F.get("steps", e) + F.get("shifts", e), F.col("nb"))
    plan = spark.createDataFrame(
        [(i, b, full[i], float(goal[i] - full[i] * sizes[i]), steps[i], shifts[i]) for i, b in enumerate(blocks_of)],
        "s int, nb long, full int, room double, steps array<long>, shifts array<long>",
    )
    order = Window.partitionBy("s").orderBy("r")
    ranked = table.join(F.broadcast(plan), "s").withColumn("r", rank(F.col("full"))).select("s", "b", "r", "words", "room", "full")
    ranked = ranked.withColumn("sum", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Sources that come max_epochs times are full: not even their documents without words come again.
    edge = ranked.filter((F.col("sum") > F.col("room")) & (F.col("full") < max_epochs)).groupBy("s").agg(
        F.min_by(F.struct("r", (F.col("room") - F.col("sum") + F.col("words")).alias("left")), "r").alias("at")
    )
    cut = {r.s: (r["at"].r, r["at"].left) for r in edge.collect()}
    taken_blocks = [int(cut[i][0]) if i in cut else (b if full[i] < max_epochs and goal[i] > full[i] * sizes[i] else 0) for i, b in enumerate(blocks_of)]

    # Documents of the blocks at the edge, in the order of their hash, as far as there is room; again with what is left.
    edges = spark.createDataFrame([(i, r, left) for i, (r, left) in cut.items()], "s int, first long, room double")
    edges = ranked.drop("room", "full").join(F.broadcast(edges), "s").filter(F.col("r").between(F.col("first"), F.col("first") + EDGE - 1))
    rows = slim.join(F.broadcast(edges.select("s", "b", "room")), ["s", "b"]).groupBy("s", key).agg(F.sum("mix_size").alias("w"), F.first("room").alias("room"))
    rows = rows.withColumn("taken", F.lit(False))
    order, whole = Window.partitionBy("s").orderBy(key), Window.partitionBy("s")
    for _ in range(PASSES):
        fits = ~F.col("taken") & (F.col("w") <= F.col("room"))
        rows = rows.withColumn("sum", F.sum(F.when(fits, F.col("w")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("now", fits & (F.col("sum") <= F.col("room")))
        rows = rows.withColumns({"room": F.col("room") - F.sum(F.when(F.col("now"), F.col("w")).otherwise(0)).over(whole), "taken": F.col("taken") | F.col("now")})
    # One more, the smallest, where that ends nearer the target.
    least = F.row_number().over(Window.partitionBy("s").orderBy("taken", "w", key)) == 1
    rows = rows.withColumn("taken", F.col("taken") | (least & (F.col("w") < 2 * F.col("room"))))
    chosen = written(rows.filter("taken").select("s", key), "mix-edge")

    # The splitting tree over blocks: whole epochs, the last epoch's prefix, and the blocks at the edge.
    edge_blocks = [min(EDGE, b - taken_blocks[i]) if i in cut else 0 for i, b in enumerate(blocks_of)]
    quotas = np.array([full[i] * b + taken_blocks[i] + edge_blocks[i] for i, b in enumerate(blocks_of)], dtype=np.int64)
    ends = np.cumsum(split(quotas, shards, rng), axis=0)
    final = spark.createDataFrame(
        [(r.source, i, b, sizes[i], float(goal[i]), full[i], taken_blocks[i], edge_blocks[i], steps[i], shifts[i], ends[:, i].tolist()) for i, (r, b) in enumerate(zip(names, blocks_of, strict=True))],
        "src string, s int, nb long, mix_source_size long, mix_target double, full int, prefix long, edge long, steps array<long>, shifts array<long>, ends array<long>",
    )
    inner = ("s", "nb", "full", "prefix", "edge", "steps", "shifts", "ends", "b", "c")
    own = dict(zip(inner, spare(keyed, *(f"_mix_{c}" for c in inner)), strict=True))
    final = final.withColumnsRenamed({c: n for c, n in own.items() if c in final.columns})
    few = chosen.count() <= BROADCAST_ROWS
    chosen = chosen.select(F.col("s").alias(own["s"]), key, F.lit(True).alias(own["c"]))
    c = {n: F.col(own[n]) for n in inner}
    out = placed(keyed, final).withColumn(own["b"], F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), c["nb"]))
    ranks = lambda e: F.pmod(c["b"] * F.get(c["steps"], e) + F.get(c["shifts"], e), c["nb"])
    at_edge = (ranks(c["full"]) >= c["prefix"]) & (ranks(c["full"]) < c["prefix"] + c["edge"])
    if few:
        out = out.join(F.broadcast(chosen), [own["s"], key], "left")
    else:
        # Only rows of edge blocks can be chosen: the others go by.
        out = out.filter(at_edge).join(chosen, [own["s"], key], "left").unionByName(out.filter(~at_edge).withColumn(own["c"], F.lit(None).cast("boolean")))
    last = F.coalesce(c["c"], F.lit(False)) | (ranks(c["full"]) < c["prefix"])
    epochs = F.sequence(F.lit(0), c["full"] - 1 + last.cast("int"))
    epochs = F.when(c["full"] + last.cast("int") > 0, epochs).otherwise(F.array().cast("array<int>"))
    copy = lambda e: F.struct(
        e.alias("epoch"),
        F.least(F.lit(shards - 1), F.size(F.filter(c["ends"], lambda x: x <= e * c["nb"] + ranks(e)))).cast("int").alias("shard"),
        F.xxhash64(F.lit(seed + 2), F.col(key), e).alias("key"),
    )
    added = [F.col("mix_size"), F.col("mix_source_size"), F.col("mix_target"), F.transform(epochs, copy).alias("mix_copies")]
    return out.select(*quoted(docs), *added)


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """A row for each copy, with ``mix_epoch``, ``mix_shard`` and ``mix_key``, the shuffled order within its shard."""
    out = mixed.withColumn("mix_copy", F.explode("mix_copies")).withColumns(
        {"mix_epoch": F.col("mix_copy.epoch"), "mix_shard": F.col("mix_copy.shard"), "mix_key": F.col("mix_copy.key")}
    )
    return out.drop("mix_copies", "mix_copy")


def shuffled(mixed: DataFrame) -> DataFrame:
    """The copies, range-partitioned by shard and shuffled order: what a writer of shards takes partition by partition."""
    return mixed_rows(mixed).repartitionByRange("mix_shard", "mix_key").sortWithinPartitions("mix_shard", "mix_key")


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed over all words at weights 5, 2, 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_copies")).cast("long").alias("taken"),
        F.transform("mix_copies", lambda x: x["shard"]).alias("shards"),
    )
