"""N-gram Jaccard join: size-banded tiles with hashed bitmaps, exact.

A text is the set of its k-word shingles, as 64-bit hashes. Texts with equal sets are one class from the
start. Shingles have one order for all: those that very many texts hold come last, else by hash. Two sets as
near as asked share a shingle among the first few of both (the prefix filter), so classes meet in the lists of
prefix shingles, and only there. A list is cut, by size, into chunks, and every two chunks make a tile.

In a tile, pairs whose sizes are too far apart go; of the others, the bits in which the two bitmaps (parity
of the hashes by bucket) differ are counted: the sets differ in at least as many shingles, which bounds the
overlap from above. What is left is checked exactly by intersecting the sorted arrays.

Groups of near copies would make all their pairs. So a first pass pairs each row of a list only with the few
before it by size; what that links is joined into components; then the tiles of the lists that still hold more
than one give all pairs across components, whose links complete them. No link between components is lost, none
inside is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh_dir, released, small_batches, spare, written
from tessella.llm.components import components
from tessella.llm.shingles import shingle_sets

#: Least bits of a bitmap; a larger set has the next power of two above its size.
BITS = 512
#: Rows of a chunk: a tile holds two chunks at most.
CHUNK = 2048
#: Earlier rows of a list that the first pass looks at.
LOOK_BACK = 3
#: Shingles of a class by which the lists agree on which of them gives a pair.
FIRSTS = 6
#: Texts of a task that hold a shingle before it counts as frequent there; texts overall; shingles kept, the most frequent.
#: The order of shingles is all that depends on these, never the result.
LOCAL, FREQUENT, MOST = 3, 40, 400_000
#: Ids up to which a list of texts to look at is broadcast.
BROADCAST_IDS = 1_000_000

_SETS = "kind int, doc_id long, node long, n int, tally long, bitmap binary"
_POSTINGS = "tok long, node long, n int, head boolean"
_U = np.uint64


def _node(tokens: np.ndarray) -> int:
    """A class id: order-free hash of a set."""
    x = tokens * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return int(((x * _U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + _U(len(tokens))).view(np.int64))


def _bitmap(tokens: np.ndarray) -> bytes:
    width = max(BITS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> _U(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sets(k: int):
    """Of each text its id, class, size and bitmap (kind 0); of each task the shingles that several of its different texts hold (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            tok, many = np.unique(np.concatenate(held), return_counts=True)
            tok, many = tok[many >= LOCAL].view(np.int64), many[many >= LOCAL]
            held.clear()
            seen.clear()
            n = len(tok)
            return _batch(_SETS, [np.ones(n, np.int32), [None] * n, tok, np.zeros(n, np.int32), many.astype(np.int64), [None] * n])

        for batch in batches:
            ids, nodes, sizes, maps = batch.column(0), [], [], []
            for tokens in shingle_sets(batch.column(1), k):
                sizes.append(len(tokens))
                nodes.append(_node(tokens) if len(tokens) else None)
                maps.append(_bitmap(tokens) if len(tokens) else None)
                if len(tokens) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(tokens)
            n = len(sizes)
            yield _batch(_SETS, [np.zeros(n, np.int32), ids, nodes, sizes, np.zeros(n, np.int64), maps])
            if sum(map(len, held)) > 2_000_000:
                yield frequent()
        if held:
            yield frequent()

    return run


def _prefixes(k: int, t: Fraction, late: np.ndarray):
    """The prefix of each different text of a task; ``head`` where it also is in the shorter prefix of a smaller set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cells: list[list] = [[], [], [], []]
            for tokens in shingle_sets(batch.column(0), k):
                n = len(tokens)
                if not n or (node := _node(tokens)) in seen:
                    continue
                seen.add(node)
                if len(late):
                    at = np.searchsorted(late, tokens)
                    hot = late[np.minimum(at, len(late) - 1)] == tokens
                    tokens = np.concatenate([tokens[~hot], tokens[hot]])
                p = n - -(-n * t.numerator // t.denominator) + 1
                both = 2 * t / (1 + t)
                q = n - -(-n * both.numerator // both.denominator) + 1
                cells[0].append(tokens[:p].view(np.int64))
                cells[1].append(np.full(p, node))
                cells[2].append(np.full(p, n, dtype=np.int32))
                cells[3].append(np.arange(p) < q)
            if cells[0]:
                yield _batch(_POSTINGS, [np.concatenate(c) for c in cells])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal first ``keys`` columns of sorted batches, as arrays (lists for binaries)."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]).combine_chunks() if rest is not None and len(rest) else table
        cols = [rest.column(i).to_numpy() for i in range(rest.num_columns)]
        change = np.zeros(len(rest), dtype=bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        for a, b in zip(np.append(0, cuts), cuts, strict=False):
            if b - a > 1:
                yield [c[a:b] for c in cols]
        rest = rest.slice(cuts[-1]) if len(cuts) else rest
    if rest is not None and len(rest) > 1:
        yield [rest.column(i).to_numpy() for i in range(rest.num_columns)]


def _maps(bitmaps) -> np.ndarray:
    """Bitmaps of one width as rows of words."""
    return np.frombuffer(b"".join(bitmaps), dtype=np.uint64).reshape(len(bitmaps), -1)


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps as they would be with fewer buckets: parities add."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def _enough(n_a, n_b, differ, t: Fraction):
    """Whether sizes and differing bits leave room for the similarity: 2 * overlap <= n_a + n_b - differ."""
    both = n_a + n_b
    most = (both - differ) // 2
    return t.denominator * most >= t.numerator * (both - most)


def _pruned(t: Fraction):
    """The pairs (a, b, n_a, n_b, map_a, map_b) that sizes and bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
                x, y = (np.array(batch.column(i).to_pylist(), dtype=object) for i in (4, 5))
                wide = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)])
                differ = np.zeros(len(a), np.int64)
                for pair in np.unique(wide, axis=0):
                    at = np.flatnonzero((wide == pair).all(axis=1))
                    p, q = (_folded(_maps(m[at].tolist()), int(pair.min()) // 8) for m in (x, y))
                    differ[at] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
                keep = _enough(n_a, n_b, differ, t)
                yield _batch("a long, b long", [a[keep], b[keep]])

    return run


def _tiles(t: Fraction):
    """Pairs across components that sizes and bitmaps allow, of rows sorted by tile, size and class."""
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, many = [], [], 0
        pack = lambda: _batch("a long, b long", [np.concatenate(out_a), np.concatenate(out_b)])
        for tok, one, two, n, node, chunk, head, bitmap, root, firsts in _runs(batches, 3):
            if (root == root[0]).all() or not head.any():
                continue
            # Sizes ascend, and so do widths: each width is a stretch of rows.
            wide, n = np.array([len(m) for m in bitmap]), n.astype(np.int64)
            cuts = [0, *(np.flatnonzero(wide[1:] != wide[:-1]) + 1).tolist(), len(n)]
            stretches = [(x, y, _maps(bitmap[x:y])) for x, y in zip(cuts, cuts[1:], strict=False)]
            low = np.searchsorted(n, -(-n * num // den))
            own_list = int(tok[0])
            firsts = [frozenset(f.tolist()) if f is not None else frozenset() for f in firsts]
            for i in range(1, len(n)):
                js = np.arange(low[i], i)
                js = js[head[js] & (root[js] != root[i])]
                if one[0] != two[0]:
                    js = js[chunk[js] != chunk[i]]
                if len(js):
                    own = np.frombuffer(bitmap[i], dtype=np.uint64)
                    differ = np.concatenate([
                        np.bitwise_count(maps[part - x] ^ _folded(own, maps.shape[1])).sum(axis=1, dtype=np.int64)
                        for x, y, maps in stretches if len(part := js[(js >= x) & (js < y)])
                    ])
                    js = js[_enough(n[js], n[i], differ, t)]
                # Where a pair shares first shingles, only the list of the smallest of them gives it.
                js = np.array([j for j in js.tolist() if not (both := firsts[i] & firsts[j]) or min(both) == own_list], dtype=np.int64)
                if len(js):
                    out_a.append(np.full(len(js), node[i]))
                    out_b.append(node[js])
                    many += len(js)
            if many > 100_000:
                yield pack()
                out_a, out_b, many = [], [], 0
        if out_a:
            yield pack()

    return run


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), k)]
            yield _batch("node long, tokens binary", [batch.column(0), sets])

    return run


def _check(t: Fraction):
    """Of rows sorted by ``a``, the set of ``a`` itself first (b null), the pairs whose exact similarity is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(tokens, dtype=np.uint64)
                if b is None:
                    own, mine = a, tokens
                elif own == a:
                    overlap = len(np.intersect1d(mine, tokens, assume_unique=True))
                    if t.denominator * overlap >= t.numerator * (len(mine) + len(tokens) - overlap):
                        a_out.append(a)
                        b_out.append(b)
            yield _batch("a long, b long", [a_out, b_out])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df``, to be broadcast if it has ``rows`` rows at most."""
    return F.broadcast(df) if df.count() <= rows else df


def _exact(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The links among ``pairs`` (a, b) of classes: the sets are made again from the texts of their representatives."""
    pairs = written(_ordered(pairs), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = written(nodes.join(classes, "node").select("node", F.col("row").alias("_row")), "wanted")
    texts = docs.select(F.col("_row").alias("_r"), "_text").join(_small(wanted), F.col("_r") == F.col("_row"))
    sets = written(texts.select("node", "_text").dropDuplicates(["node"]).mapInArrow(released(_tokens(k)), "node long, tokens binary"), "sets")
    theirs = pairs.join(sets, pairs.b == sets.node).select("a", "b", "tokens")
    own = pairs.select("a").distinct().join(sets, F.col("a") == F.col("node")).select("a", F.lit(None).cast("long").alias("b"), "tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = theirs.union(own).repartition(parts, "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return written(ready.mapInArrow(released(_check(t)), "a long, b long"), "near")


def _rooted(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """``_id``, ``_row``, ``node``, ``n`` and ``root`` of each row of ``docs`` (_id, _text, _row); root is null without shingles."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    path = fresh_dir(spark, "sets")
    named = docs.select("_row", "_text").mapInArrow(released(_sets(k)), _SETS.replace("doc_id", "row"))
    named.write.partitionBy("kind").parquet(path)
    made = spark.read.schema(_SETS.replace("doc_id", "row")).parquet(path)
    rows = made.filter("kind = 0").select("row", "node", "n", "bitmap")
    late = made.filter("kind = 1").groupBy("node").agg(F.sum("tally").alias("tally")).filter(F.col("tally") >= FREQUENT)
    late = np.array([r.node for r in late.orderBy(F.desc("tally"), "node").limit(MOST).select("node").collect()], dtype=np.int64)
    late = np.sort(late.view(np.uint64))

    # A row for each class: one row of its texts, and its bitmap.
    classes = written(rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("row", "n", "bitmap")).alias("x")).select("node", "x.*"), "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange by shingle serves copies of postings, list sizes, chunks and neighbours.
    postings = docs.select("_text").mapInArrow(released(_prefixes(k, t, late)), _POSTINGS).repartition(parts, "tok").distinct()
    order = Window.partitionBy("tok")
    by_size = order.orderBy("n", "node")
    lists = postings.withColumn("many", F.count("*").over(order)).withColumn("at", F.row_number().over(by_size) - 1)
    earlier = [F.lag(F.when(F.col("head"), F.struct("node", "n")), i).over(by_size).alias(f"p{i}") for i in range(1, LOOK_BACK + 1)]
    lists = lists.select("*", *earlier).filter("many > 1").withColumns({"chunk": F.floor(F.col("at") / CHUNK).cast("int"), "chunks": F.ceil(F.col("many") / CHUNK).cast("int")})
    lists = written(lists.drop("many", "at"), "lists")

    # Each row and the few before it in its lists, where sizes and bitmaps allow.
    chain = lists.select("node", "n", F.explode(F.array(*(f"p{i}" for i in range(1, LOOK_BACK + 1)))).alias("p"))
    chain = chain.filter((F.col("p.n") * t.denominator >= F.col("n") * t.numerator)).select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"map_{c}"))
    chain = _ordered(chain).join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "map_a", "map_b")
    near = _exact(chain.mapInArrow(released(_pruned(t)), "a long, b long"), docs, classes, k, t)
    groups = written(components(near), "groups")

    # All pairs across components, in tiles of the lists that hold more than one component.
    rooted = lists.drop(*(f"p{i}" for i in range(1, LOOK_BACK + 1))).join(_small(groups), "node", "left").withColumn("root", F.coalesce("root", "node"))
    near_size = (F.lag("n").over(by_size) * t.denominator >= F.col("n") * t.numerator) | (F.col("n") * t.denominator >= F.lead("n").over(by_size) * t.numerator)
    rooted = rooted.withColumns({"lo": F.min("root").over(order), "hi": F.max("root").over(order), "some": near_size}).filter("lo < hi AND some").drop("lo", "hi", "some")
    rooted = written(rooted, "rooted")
    firsts = rooted.filter("head").groupBy("node").agg(F.slice(F.array_sort(F.collect_list("tok")), 1, FIRSTS).alias("firsts"))
    sides = classes.select("node", "bitmap").join(firsts, "node", "left")
    rooted = rooted.join(sides, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = rooted.select("tok", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "n", "node", "chunk", "head", "bitmap", "root", "firsts")
    tiles = tiles.repartition(parts, "tok", "one", "two").sortWithinPartitions("tok", "one", "two", "n", "node")
    more = _exact(tiles.mapInArrow(released(_tiles(t)), "a long, b long"), docs, classes, k, t)
    groups = written(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "groups")

    ids = docs.select("_id", "_row").join(rows.select(F.col("row").alias("_row"), "node", "n").dropDuplicates(["_row"]), "_row")
    ids = written(ids.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "ids")
    return ids


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return docs.withColumn("_row", F.xxhash64("_id", "_text"))


def near_components(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` long and ``component_id`` long for each row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of k-word shingles reaches ``similarity``;
    ``component_id`` is the smallest id that links reach, the row's own included. A text with fewer than k
    words has its whole sequence as one shingle. Null and empty texts have none and link with nothing; their
    component is their own id. Null ids are never the smallest; a component of null ids only is null. Repeated
    ids and rows are rows like others. An empty table gives no rows; other columns are left out.
    """
    ids = _rooted(_rows(docs, id_col, text_col), k, Fraction(similarity))
    least = ids.filter("root IS NOT NULL").groupBy("root").agg(F.min("_id").alias("least")).withColumnRenamed("root", "of")
    out = ids.join(least, F.col("root") == F.col("of"), "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less all but one row of each component: the smallest id stays (null last), among equal ids any one row.

    Rows without shingles are in no component and stay.
    """
    ids = _rooted(_rows(docs, id_col, text_col), k, Fraction(similarity)).filter("root IS NOT NULL")
    rank = F.struct(F.col("_id").isNull().alias("last"), "_id", "_row")
    stay = ids.groupBy("root").agg(F.min(rank)["_row"].alias("stay"))
    gone = written(ids.join(stay, "root").filter("_row != stay").select(F.col("_row").alias("_gone")).distinct(), "gone")
    again = ids.groupBy("_row").count().filter("count > 1").select(F.col("_row").alias("_gone"))
    key, = spare(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    out = keyed.join(_small(gone), F.col(key) == F.col("_gone"), "left_anti")
    if again.limit(1).count():
        repeated = written(again, "again")
        twice = out.join(repeated, F.col(key) == F.col("_gone"), "left_semi").dropDuplicates([key])
        out = out.join(repeated, F.col(key) == F.col("_gone"), "left_anti").unionByName(twice)
    return out.drop(key)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five-word shingles, similarity 0.75."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 75 * (a.n + b.n - both_have)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
