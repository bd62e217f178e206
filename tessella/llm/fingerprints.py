"""Document fingerprints by order MinHash, on DataFrame functions only.

A text is its sequence of tokens: runs of word characters, at most 16 code points each. Its k-mers, k tokens
in a row, are numbered by occurrence, so that a repeated k-mer is as many different ones. One keyed hash sends a
numbered k-mer to one of ``slots`` slots and ranks it there; each slot selects its ``take`` minimal ones, puts
them back into text order and hashes the tuple. Two texts agree in a slot only if they share its minimal k-mers
in the same order, so the share of agreeing slots falls with edit distance, moves of passages included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import let, quoted, spare

TOKEN = r"[^\x20\x09-\x0D]{1,16}"
SLOT_BITS, POSITION_BITS = 6, 24
RANK_BITS = 63 - SLOT_BITS - POSITION_BITS
K, TAKE = 3, 2


def _high(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, 64 - bits)


def signature(text: Column, k: int = K, take: int = TAKE, seed: int = 42) -> Column:
    """The agreeing units of a text: an array<long> of (slot, tuple hash), ascending by slot; empty for a text without tokens.

    Null counts as empty. A text with fewer than k tokens has one k-mer, all of them. Positions beyond 2^24
    share the last number, and then order by rank.
    """
    place = (1 << POSITION_BITS) - 1
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(F.lit(seed), w))

    def kmers(t: Column) -> Column:
        # Hash bits above, position below: one sort of longs brings equal k-mers together in text order.
        n = F.greatest(F.size(t) - (k - 1), F.lit(1))
        at = lambda i: F.xxhash64(*(F.get(t, i + j) for j in range(k)))
        packed = lambda i: _high(at(i), 63 - POSITION_BITS) * (1 << POSITION_BITS) + F.least(i, F.lit(place))
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), n - 1), packed)).otherwise(F.array().cast("array<bigint>"))

    def ranked(x: Column, occurrence: Column) -> Column:
        """Slot, rank and position of a packed k-mer with its occurrence number."""
        h = F.xxhash64(F.lit(seed + 1), F.shiftright(x, POSITION_BITS), occurrence)
        return _high(h, SLOT_BITS + RANK_BITS) * (1 << POSITION_BITS) + x.bitwiseAND(place)

    def numbered(s: Column) -> Column:
        """From sorted packed k-mers; where none repeats all are first occurrences."""
        kinds = F.transform(s, lambda x: F.shiftright(x, POSITION_BITS))
        again = let(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.shiftright(F.get(s, i), POSITION_BITS) != F.shiftright(F.get(s, i - 1), POSITION_BITS))),
            lambda starts: F.flatten(F.transform(starts, lambda a, j: F.transform(
                F.slice(s, a + 1, F.coalesce(F.get(starts, j + 1), F.size(s)) - a), lambda x, o: ranked(x, o)))),
        )
        return F.when(F.size(F.array_distinct(kinds)) == F.size(s), F.transform(s, lambda x: ranked(x, F.lit(0)))).otherwise(again)

    slot = lambda x: F.shiftright(x, RANK_BITS + POSITION_BITS)

    def selected(r: Column) -> Column:
        """The first ``take`` of each slot."""
        return F.filter(r, lambda x, i: (i < take) | (slot(F.get(r, i - take)) != slot(x)))

    def tuples(m: Column) -> Column:
        turned = lambda x: x.bitwiseAND(place) * (1 << RANK_BITS) + F.shiftright(x, POSITION_BITS).bitwiseAND((1 << RANK_BITS) - 1)
        of = lambda x, i: F.filter(F.slice(m, i + 1, take), lambda y: slot(y) == slot(x))
        ranks = lambda x, i: F.transform(F.sort_array(F.transform(of(x, i), turned)), lambda y: y.bitwiseAND((1 << RANK_BITS) - 1))
        tup = lambda x, i: F.when((i == 0) | (slot(F.get(m, i - 1)) != slot(x)), slot(x) * (1 << 32) + _high(F.xxhash64(ranks(x, i)), 32))
        return F.filter(F.transform(m, tup), lambda y: y.isNotNull())

    return let(tokens, lambda t: let(F.sort_array(kmers(t)), lambda s: F.when(F.size(s) == 0, s).otherwise(
        let(F.sort_array(numbered(s)), lambda r: let(selected(r), tuples)))))


def fingerprint(units: Column) -> Column:
    """A signature as text: ten hexadecimal digits for each unit."""
    return F.array_join(F.transform(units, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing slots of two signatures among the slots that either uses; 1 for two empty ones."""
    used = lambda x: F.transform(x, lambda y: F.shiftright(y, 32))
    slots = F.size(F.array_union(used(a), used(b)))
    return F.when(slots == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / slots).cast("double")


def with_next(docs: DataFrame, order: str, carried: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """Add the columns ``made`` and ``next_<c>`` for each carried column, made ones among them: its value in the next row by descending ``order``, after the last the first's.

    Nulls of ``order`` come last; equal ones go by the rest of the row's hash. Rows are dealt to ranges of ``order`` and
    looked at range by range; the first row of each range is sent to the range before as well, so that no
    row needs more than its own range. Only the ranges' bounds and first keys are gathered, as many as there are
    ranges, four times the shuffle partitions.
    """
    spark = docs.sparkSession
    own = quoted(docs)
    tie, part, ghost = spare(docs, "_tie", "_part", "_ghost")
    keyed = docs.withColumn(tie, F.xxhash64(*own))
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(order, [i / many for i in range(1, many)], 20 * many).alias("c")).first().c
    cuts = sorted({c for c in cuts or [] if c is not None})
    # Range 0 has the greatest; rows without a key are the last range.
    last = len(cuts) + 1
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<long>")
    place = F.when(F.col(order).isNull(), F.lit(last)).otherwise(F.size(F.filter(bounds, lambda c: c > F.col(order))))
    placed = keyed.withColumn(part, place)
    first = placed.groupBy(part).agg(F.min(F.struct((-F.col(order)).alias("o"), F.col(tie).alias("t"))).alias("f")).collect()
    first = sorted((r[part], None if r.f.o is None else -r.f.o, r.f.t) for r in first)
    if not first:
        docs = docs.withColumns(made or {})
        return docs.withColumns({f"next_{c}": F.col(c) for c in carried})
    # The first row of a range stands, as a ghost, behind the last row of the range before; that of the first range behind all.
    before = [first[-1][0], *(f[0] for f in first[:-1])]
    lead = spark.createDataFrame([(p, o, t, b) for (p, o, t), b in zip(first, before, strict=True)], "p int, o long, t long, b int")
    lead = F.broadcast(lead)
    heads = placed.join(lead, (F.col(part) == F.col("p")) & F.col(order).eqNullSafe(F.col("o")) & (F.col(tie) == F.col("t")), "inner")
    heads = heads.dropDuplicates(["p"]).select(*own, tie, F.col("b").alias(part), F.lit(True).alias(ghost))
    rows = placed.withColumn(ghost, F.lit(False)).select(*own, tie, part, ghost).unionByName(heads).withColumns(made or {})
    window = Window.partitionBy(part).orderBy(ghost, F.desc_nulls_last(order), tie)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in carried})
    return out.filter(~F.col(ghost)).drop(tie, part, ghost)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text and its edit: the last half replaced by the start of the next document, by descending doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs, "doc_id", ["text", "sig"], {"sig": signature(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    out = near.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    out = out.withColumn("edited_sig", signature(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
