"""Fuzzy line deduplication by MinHash, on DataFrame functions only.

A line, lower-cased, is the set of its character shingles: the SHINGLE UTF-16 units (characters, beyond the basic plane halves of them) from each place; a shorter line is one
shingle. Shingles are rows that never leave their task: hashed in generated code, they fold into a row for each kind of
equal lines (by two hashes), its MinHash signature: the smallest hash in each of SLOTS slots that the hash picks (one
permutation). Two slots are a band; lines at the threshold share one with a probability of about 0.98, nearer ones almost
surely. Lines of up to FEW shingles, whose slots are mostly empty, are banded by their smallest hash as well.

In a band's bucket each line is paired with the first one; of what links, components are formed. In long buckets that
still hold more than one, lines outside the largest component meet one of its lines, another in each turn, so that one
group's components grow together for a pair a line. Buckets that even then hold more than one give all pairs across
components, by tiles of sizes and chunks, so that no two lines of a bucket go without a look. Pairs with a first line
that agree in enough slots, and all others, are verified if sizes and bitmaps leave room: by exact Jaccard similarity
of the whole sets. Of each component only the first line, by document and place, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import let, quoted, spare, written
from tessella.llm.components import components

SHINGLE = 12
SIMILARITY = 0.75
#: Slots of a signature, the first of them paired into bands, and in how many of them lines at the threshold agree at
#: least, but for one pair in some 300.
SLOTS, BANDS, ALIKE = 10, 5, 4
#: Stands for the hash of an empty slot: the largest long.
NONE = (1 << 63) - 1
#: Shingles of a line that its signature is the minima of, at least, if it has as many.
KEPT = 48
#: Shingles up to which a line's smallest hash is a band, too.
FEW = 12
#: Words of the bitmaps that are compared in tiles, a power of two.
WORDS = 16
#: Shingles that a row of a line's whole set holds before the set is gathered.
STEP = 32
#: Rows of a bucket, about, that meet as many others in a tile.
CHUNK = 256
#: Lines of a bucket from which on the largest component's lines are met before the tiles, and turns of that.
LONG, TURNS = 32, 4
#: Lines that a turn may meet for each link it finds, for another turn to follow; the tiles take what is left.
YIELD = 8
#: Lines, of all kinds, for each pair that such buckets may give the tiles without a turn.
FREE = 16
#: Bytes of a list of documents' lines up to which it is broadcast.
BROADCAST_BYTES = 32 << 20

def _points(line: Column) -> Column:
    """The lower-cased line in two bytes a unit: shingles are cut from any place without a search."""
    return F.encode(F.lower(line), "UTF-16BE")


def _places(points: Column) -> Column:
    """The first byte of each shingle, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.length(points) - 2 * SHINGLE + 1, F.lit(1)), F.lit(2))


def _shingle(points: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(points, place, F.lit(2 * SHINGLE)))


def _shingles(line: Column) -> Column:
    """Hashes of a line's shingles in their order: each step of the lambda, which costs as much as a hash, takes four places."""
    last = lambda b: F.greatest(F.length(b) - 2 * SHINGLE + 1, F.lit(1))
    fours = lambda b: F.transform(F.sequence(F.lit(1), last(b), F.lit(8)), lambda i: F.array(*(_shingle(b, i + k) for k in (0, 2, 4, 6))))
    return let(_points(line), lambda b: F.slice(F.flatten(fours(b)), F.lit(1), F.floor((last(b) + 1) / 2).cast("int")))


def shingle_set(line: Column) -> Column:
    """Distinct hashes of a line's shingles."""
    return F.array_distinct(_shingles(line))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _lines(text: Column) -> Column:
    """How many lines ``lines_of`` gives, counted without making them."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _blank(line: Column) -> Column:
    """Whether a line holds nothing but blanks and U+0009 to U+000D."""
    return F.ltrim(line, F.lit("\t\n\x0b\f\r ")) == ""


def _once(value: Column, name: str) -> Column:
    """``value`` as a column that is computed once, in generated code: neither filters nor projects are moved into it."""
    return F.explode(F.array(value)).alias(name)


def _sets(texts: DataFrame) -> DataFrame:
    """``id``, ``s``: hashes of the shingles of each of ``texts`` (id, line), which may repeat.

    ``_shingles`` without a lambda: rows of STEP places each are hashed in generated code and gathered where the line is.
    """
    own = texts.repartition("id").select("id", _once(_points(F.col("line")), "points"))
    last = F.greatest(F.length("points") - 2 * SHINGLE + 1, F.lit(1))
    rows = own.select("id", "points", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(2 * STEP))).alias("place"))
    some = F.array(*(_shingle(F.col("points"), F.col("place") + 2 * k) for k in range(STEP)))
    there = F.least(F.shiftright(F.col("last") - F.col("place"), 1) + 1, F.lit(STEP))
    return rows.select("id", F.slice(some, F.lit(1), there).alias("s")).groupBy("id").agg(F.flatten(F.collect_list("s")).alias("s"))


def _signatures(lines: DataFrame) -> DataFrame:
    """``h``, ``h2``, ``many`` (lines), ``least`` (shingle, of lines of few) and ``slots`` of each kind of equal ``lines`` (line).

    All are minima and sums over the shingles, which the map side forms before anything is sent.
    """
    own = lines.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), _points(F.col("line")).alias("points"))
    # A long line's shingles count if their leading zeros are as many as leave KEPT of them or more: of a smallest hash that stays
    # nothing changes, and lines of all lengths are comparable.
    zeros = F.greatest(F.floor(F.log2(F.length("points") / (2 * KEPT))), F.lit(0)).cast("int")
    rows = own.select("h", "h2", "points", (63 - zeros).alias("_bits"), F.explode(_places(F.col("points"))).alias("place"))
    # always true, but not to the optimizer, which would hash once in the filter and again for what it lets through
    once = F.monotonically_increasing_id() >= 0
    rows = rows.select("h", "h2", "place", "_bits", F.when(once, F.shiftrightunsigned(_shingle(F.col("points"), F.col("place")), 1)).alias("x"))
    rows = rows.filter((F.call_function("shiftright", F.col("x"), F.col("_bits")) == 0) | (F.col("place") == 1))
    # minima over values that are never null take less; an empty slot has NONE
    x = F.coalesce("x", F.lit(NONE))
    slot = [F.nullif(F.min(F.when(x % SLOTS == k, x).otherwise(F.lit(NONE))), F.lit(NONE)).alias(f"s{k}") for k in range(SLOTS)]
    kinds = rows.groupBy("h", "h2").agg(F.sum((F.col("place") == 1).cast("long")).alias("many"), F.max("place").alias("last"), *slot)
    slots = [f"s{k}" for k in range(SLOTS)]
    return kinds.select("h", "h2", "many", F.when(F.col("last") < 2 * FEW, F.array_min(F.array(*slots))).alias("least"), F.array(*slots).alias("slots"))


def _bands(slots: Column, least: Column) -> Column:
    """Pairs of slots that are not both empty, and the smallest hash of a line of few shingles."""
    pair = [(F.get(slots, F.lit(2 * i)), F.get(slots, F.lit(2 * i + 1))) for i in range(BANDS)]
    two = [F.when(a.isNotNull() | b.isNotNull(), F.xxhash64(F.lit(i), F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))) for i, (a, b) in enumerate(pair)]
    return F.array(*two, F.when(least.isNotNull(), F.xxhash64(F.lit(BANDS), least)))


def _maps(sets: DataFrame) -> DataFrame:
    """``id``, ``n``, ``map`` of ``sets`` (id, s), whose hashes may repeat: bitmaps with the parity of the distinct ones in each of 64 * WORDS buckets."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("x", 8).bitwiseAND(63).cast("int"))
    rows = sets.select("id", F.explode(F.array_distinct("s")).alias("x"))
    words = rows.groupBy("id", F.col("x").bitwiseAND(WORDS - 1).alias("w")).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("bits"))
    map_ = [F.max(F.when(F.col("w") == w, F.col("bits"))).alias(f"w{w}") for w in range(WORDS)]
    rows = words.groupBy("id").agg(F.sum("n").alias("n"), *map_)
    return rows.select("id", "n", F.array(*(F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(WORDS))).alias("map"))


def _may(similarity: float) -> Column:
    """Whether sizes and bitmaps of x and y leave room: sets differ in as many hashes as bitmaps in bits, at least."""
    both = F.col("x.n") + F.col("y.n")
    differ = sum((F.bit_count(F.get("x.map", F.lit(w)).bitwiseXOR(F.get("y.map", F.lit(w)))) for w in range(WORDS)), F.lit(0))
    sizes = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
    return sizes & ((both - differ) * (1 + similarity) >= 2 * similarity * both)


def _alike() -> Column:
    """Whether x and y agree in enough of the slots, those that are empty in both left out; lines of few slots always do."""
    at = lambda c, k: F.get(f"{c}.slots", F.lit(k))
    same = sum(((at("x", k) == at("y", k)).eqNullSafe(True).cast("int") for k in range(SLOTS)), F.lit(0))
    used = sum(((at("x", k).isNotNull() | at("y", k).isNotNull()).cast("int") for k in range(SLOTS)), F.lit(0))
    return (used < SLOTS) | (same >= ALIKE)


def _near(pairs: DataFrame, maps: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is enough; for those that sizes and bitmaps leave, shingles are made again, once a line and not for each of its pairs."""
    x, y = maps.alias("x"), maps.alias("y")
    room = pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & _may(similarity)).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n"))
    room = written(room, "line-room")
    ids = room.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_sets(texts.join(ids, "id")), "line-sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
    both = room.join(side("a"), "a").join(side("b"), "b")
    enough = F.size(F.array_intersect("s_a", "s_b")) * (1 + similarity) >= similarity * F.col("n")
    return written(both.filter(enough).select("a", "b"), "line-near")


def _sketched(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in enough slots."""
    x, y = kinds.select("id", "slots").alias("x"), kinds.select("id", "slots").alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    return written(both.filter(_alike()).select("a", "b"), "line-pairs")


def _open(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``band``, ``id``, ``many`` and ``root`` of the rows of ``lists`` whose band's lines are of more than one component."""
    rooted = lists.join(groups, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    rooted = written(rooted.select("band", "id", "many", "root"), "line-rooted")
    still = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    return written(rooted.join(still, "band"), "line-rooted")


def _merged(groups: DataFrame, near: DataFrame) -> DataFrame:
    """``groups`` (node, root) with the links ``near`` (a, b) of their nodes or others."""
    for end in ("a", "b"):
        near = near.join(groups.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    tops = written(components(near), "line-tops")
    moved = groups.join(tops.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left")
    alone = tops.join(groups.select("node"), "node", "left_anti")
    return written(moved.select("node", F.coalesce("_top", "root").alias("root")).union(alone.select("node", "root")), "line-groups")


def _met(lists: DataFrame, groups: DataFrame, free: int, maps: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``groups`` (node, root), grown by what links where, in long open buckets, the other lines meet one of the largest component's.

    Each turn makes a pair for a row of ``lists`` at most, with another line of that component, whatever the bucket's length.
    Where all pairs of those buckets are ``free`` at most, or a turn links few of the lines it met, the tiles take the rest.
    """
    lists = lists.filter(F.col("many") > LONG)
    for turn in range(TURNS):
        lists = _open(lists, groups).select("band", "id", "many", "root")
        if (lists.agg(F.sum("many")).first()[0] or 0) <= free:
            break
        sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
        rows = lists.join(sizes, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        heads = rows.groupBy("band").agg(F.max(F.struct("size", "root", F.xxhash64("id", F.lit(turn)).alias("draw"), "id")).alias("head"))
        met = rows.join(heads, "band").filter(F.col("root") != F.col("head.root"))
        met = written(met.select(F.greatest("id", "head.id").alias("a"), F.least("id", "head.id").alias("b")).distinct(), "line-met")
        near = _near(met, maps, texts, similarity)
        links = near.count()
        if links:
            groups = _merged(groups, near)
        if links * YIELD < met.count():
            break
        lists = lists.drop("root")
    return groups


def _tiles(rooted: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) across components whose sizes and bitmaps leave room, in the buckets of ``rooted`` (band, id, many, root).

    A tile holds what a chunk of a bucket's lines of one class of sizes meets in another chunk, of the same class or the
    one below: lines two classes apart are too different in size. A pair comes once, from the first of its buckets.
    """
    chunks = F.ceil(F.col("many") / CHUNK).cast("int")
    before = F.collect_list("band").over(Window.partitionBy("id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    rows = rooted.join(maps, "id").select(
        "band", "id", "root", "n", "map", F.floor(-F.log(F.col("n")) / F.log(F.lit(similarity))).cast("int").alias("class"),
        F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), F.sequence(F.lit(0), chunks - 1).alias("others"), before.alias("before"),
    )
    rows = written(rows, "line-open")
    one = rows.select("band", "class", F.col("chunk").alias("i"), F.explode("others").alias("j"), "id", "root", "n", "map", "before").alias("x")
    # a line asks those of its own class with smaller ids, and all of the class below
    classes = F.explode(F.array(*(F.struct((F.col("class") + k).alias("class"), F.lit(k == 0).alias("own")) for k in (0, 1)))).alias("c")
    two = rows.select("band", classes, F.col("chunk").alias("j"), "others", "id", "root", "n", "map", "before")
    two = two.select("band", "c.*", F.explode("others").alias("i"), "j", "id", "root", "n", "map", "before").alias("y")
    tile = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "class", "i", "j")]
    apart = [F.col("x.root") != F.col("y.root"), ~F.col("y.own") | (F.col("y.id") < F.col("x.id"))]
    pairs = one.join(two, [*tile, *apart, _may(similarity), ~F.arrays_overlap("x.before", "y.before")])
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))


def _across(lists: DataFrame, groups: DataFrame, judged: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) across components, in the buckets of ``lists`` (band, id, many) that pairs with the first don't exhaust, less those ``judged`` (a, b) before."""
    pairs = _tiles(_open(lists.filter("many > 2"), groups), maps, similarity)
    return written(pairs.join(judged, ["a", "b"], "left_anti"), "line-pairs")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its rows, of ``row_bytes`` each, are few; joins move the other side else."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def duplicate_lines(docs: DataFrame, key: str, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``key``, ``drops`` array<int>: of each row of ``docs`` (key, doc_id, text) that has any, the lines that go.

    Lines are what stands between line feeds. Blank ones stay. Of equal and near lines the first stays, by doc_id (null
    last), then key, then place. Long lines are taken whole.
    """
    lines = docs.select(F.col(key).alias("row"), "doc_id", F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    lines = lines.filter(~_blank(F.col("line")))
    # A row for each kind of equal lines, numbered as written, so that numbers stay.
    kinds = written(_signatures(lines).withColumn("id", F.monotonically_increasing_id()), "line-kinds")
    banded = kinds.select("id", F.explode(_bands(F.col("slots"), F.col("least"))).alias("band")).filter("band IS NOT NULL").repartition("band")
    firsts = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("many")).filter("first < last")
    lists = written(banded.join(firsts.drop("last").hint("shuffle_hash"), "band"), "line-lists")

    listed = written(kinds.join(lists.select("id").distinct().hint("shuffle_hash"), "id").select("id", "h", "h2", "slots"), "line-listed")
    pairs = lists.filter("id > first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    pairs = _sketched(pairs, listed)

    # The texts of lines that are verified or whose bucket holds more than two.
    ids = lists.filter("many > 2").select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = written(ids.join(listed, "id").select("id", F.col("h").alias("_h"), F.col("h2").alias("_h2")), "line-wanted")
    hashed = lines.select("line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    texts = hashed.join(_small(wanted, 64), (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2"))).select("id", "line")
    texts = written(texts.dropDuplicates(["id"]), "line-texts")
    maps = written(_maps(_sets(texts)), "line-maps")

    near = _near(pairs, maps, texts, similarity)
    # Of a line's firsts, BANDS + 1 at most, the least speaks for the others: fewer links, the same components.
    hubs = near.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("bs"))
    hubs = written(hubs, "line-hubs")
    links = hubs.select("a", F.col("m").alias("b")).union(hubs.select(F.explode("bs").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
    groups = written(components(links), "line-groups")
    groups = _met(lists, groups, kinds.count() // FREE, maps, texts, similarity)
    groups = _merged(groups, _near(_across(lists, groups, pairs, maps, similarity), maps, texts, similarity))

    # One line of each component stays: the first of all its kinds' lines.
    kind = kinds.join(groups, kinds.id == groups.node, "left").withColumns({"linked": F.col("root").isNotNull(), "root": F.coalesce("root", "id")})
    kind = kind.filter(F.col("linked") | (F.col("many") > 1))
    kind = written(kind.select(F.col("h").alias("_h"), F.col("h2").alias("_h2"), "root"), "line-repeated")
    slim = lines.select("row", "doc_id", "place", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    slim = slim.join(_small(kind, 64), (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2")))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "place")
    repeats = written(slim.select("root", rank.alias("rank")), "line-repeats")
    stay = repeats.groupBy("root").agg(F.min("rank").alias("stay"))
    gone = repeats.join(_small(stay, 100), "root").filter(F.col("rank") != F.col("stay"))
    drops = gone.groupBy("rank.doc_id", "rank.row").agg(F.collect_set("rank.place").alias("drops"))
    return written(drops.withColumnRenamed("row", key), "line-drops")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``text`` less its repeated lines, ``n_lines`` and ``n_dropped`` int.

    A null text stays null and counts no lines. An empty text has one blank line. Rows equal in doc_id and text
    lose the same lines: as repeats of each other they keep theirs. An empty table stays empty. Columns
    of ``docs`` with the added names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    key, drops, has, doc = spare(docs, "_line_key", "_drops", "_has", "_has_doc")
    own = quoted(docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    gone = duplicate_lines(keyed.select(key, "doc_id", "text"), key, similarity)
    gone = gone.select(F.col("doc_id").alias(doc), F.col(key).alias(has), F.col("drops").alias(drops))
    out = keyed.join(_small(gone, 200), (F.col(key) == F.col(has)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    lines = lines_of(F.col("text"))
    kept = let(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drops)), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(kept)
    counts = {"n_lines": _lines(F.col("text")), "n_dropped": F.coalesce(F.size(F.col(drops)), F.lit(0))}
    out = out.withColumns({c: F.when(F.col("text").isNull(), 0).otherwise(v).cast("int") for c, v in counts.items()}).withColumn("text", text)
    return out.select(*own, "n_lines", "n_dropped")


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what is left of each text, and how many of its lines went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
