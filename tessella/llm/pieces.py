"""SentencePiece encoding and decoding by a relational lattice.

Blanks stand for the piece mark, one is put before each text, and a text is cut into segments, a run of blanks
and what follows up to the next, which no piece crosses. The frequent segments of the corpus are encoded
relationally: substrings up to the longest piece are exploded, equi-joined to the piece table, the edges grouped
by segment and folded by a higher-order aggregate. Of a unigram model the fold is Viterbi's. Of a BPE model, where a
piece's score is only the rank of its merge and the best sum is not what the model means, the fold applies
the merges the edges allow, best rank first and leftmost among equals. The resulting dictionary has a
fixed size bound and is broadcast; segments outside of it are folded the same way in arrays, where they occur.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import let, released, sliced, small_batches
from tessella.llm.shingles import _powers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Segments of the dictionary, and occurrences in a block of text from which one is counted.
DICTIONARY, LOCAL = 200_000, 3
#: Segments up to this length are folded together, longer ones with a heap.
SHORT = 48
BLOCK = 1 << 19
_TABLE = np.random.default_rng(0xB17E).integers(0, 1 << 64, 256, dtype=np.uint64)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """Pieces of a model file with scores and kinds."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = BPE
    prefix: bool = True
    unk: int = 0
    ids: dict[str, int] = field(default_factory=dict)
    bytes: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unk = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with open(os.fspath(path), "rb") as f:
            data = f.read()
        pieces, scores, kinds, kind, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("models that normalise their input are not supported")
                prefix = bool(own.get(3, 1))
        model = cls(pieces, scores, kinds, kind, prefix)
        if any(MARK in p[1:] and p.strip(MARK) for p in model.ids):
            raise ValueError("models with pieces across blanks are not supported")
        return model

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its bytes', or the unknown piece."""
        own = [self.bytes.get(b) for b in char.encode()]
        return [self.unk] if None in own else own

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @property
    def alone(self) -> np.ndarray:
        """By byte: ASCII that no longer piece holds, always a segment of its own."""
        held = set("".join(p for p in self.ids if len(p) > 1))
        return np.array([b < 128 and b != 0x20 and chr(b) not in held for b in range(256)])


# --- the lattice over frequent segments, relational -------------------------------------------------------------


def lattice(segments: DataFrame, model: Model) -> DataFrame:
    """``segment`` and ``ids`` array<int> of each distinct segment (with marks for blanks) of ``segments`` (segment)."""
    spark = segments.sparkSession
    rank = sorted(model.ids.values(), key=lambda i: (-model.scores[i], i))
    rank = {i: r for r, i in enumerate(rank)}
    table = spark.createDataFrame([(p, i, rank[i], model.scores[i]) for p, i in model.ids.items()], "piece string, id int, rank int, score double")
    n = F.char_length("segment")
    starts = F.sequence(F.lit(0), n - 1)
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(n - s, F.lit(model.longest))), lambda k: F.struct(s.alias("s"), k.alias("k")))))
    # Partitioned by segment from the start, so that its edges are grouped where they arise.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = segments.filter(F.char_length("segment") > 0).select("segment").repartition(parts, "segment").distinct()
    spread = own.select("segment", F.explode(spans).alias("at"))
    spread = spread.select("segment", "at.s", "at.k", F.substring("segment", F.col("at.s") + 1, F.col("at.k")).alias("sub"))
    edges = spread.join(F.broadcast(table), F.col("sub") == F.col("piece"), "left").filter(F.col("id").isNotNull() | (F.col("k") == 1))
    key = F.col("s") * 65536 + F.col("s") + F.col("k")  # from, to
    grouped = edges.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), F.struct("rank", "id", "score").alias("edge")))).alias("edges"))
    fold = _merges if model.kind == BPE else _viterbi
    bounds = grouped.select("segment", "edges", fold(F.col("edges"), F.char_length("segment")).alias("b"))
    codes = F.array(*(F.lit(model.bytes.get(b, -1)) for b in range(256)))

    def ids(a: Column, b: Column) -> Column:
        raw = F.substring("segment", a + 1, F.lit(1))
        hexed = F.hex(F.encode(raw, "UTF-8"))
        own = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda j: F.get(codes, F.conv(F.substring(hexed, 2 * j + 1, F.lit(2)), 16, 10).cast("int")))
        own = F.when(F.exists(own, lambda x: x < 0), F.array(F.lit(model.unk))).otherwise(own)
        edge = F.try_element_at(F.col("edges"), a * 65536 + b)
        return F.when(edge["id"].isNotNull(), F.array(edge["id"])).otherwise(own)

    pairs = let(F.col("b"), lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda j: ids(F.get(b, j), F.get(b, j + 1)))))
    return bounds.select("segment", pairs.alias("ids"))


def _merges(edges: Column, n: Column) -> Column:
    """Bounds of the pieces after all merges, the best rank first, leftmost among equals."""

    def step(b: Column, _: Column) -> Column:
        rank = lambda j: F.try_element_at(edges, F.get(b, j) * 65536 + F.get(b, j + 2))["rank"]
        found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(b) - 3, F.lit(0))), lambda j: F.struct(rank(j).alias("r"), j.alias("j")))
        best = F.array_min(F.filter(found, lambda x: x["r"].isNotNull()))
        return let(best, lambda x: F.when(x.isNull(), b).otherwise(F.filter(b, lambda _, i: i != x["j"] + 1)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), step)


def _viterbi(edges: Column, n: Column) -> Column:
    """Bounds of the path with the greatest sum of scores, the longer last piece among equals."""
    worst = -1e9  # of a character that is no piece

    def step(best: Column, to: Column) -> Column:
        def reach(f: Column) -> Column:
            edge = F.try_element_at(edges, f * 65536 + to)
            score = F.when(edge.isNull(), None).otherwise(F.coalesce(edge["score"], F.lit(worst)))
            return F.struct((F.get(best, f)["score"] + score).alias("score"), (-f).alias("back"))

        top = F.array_max(F.filter(F.transform(F.sequence(F.lit(0), to - 1), reach), lambda x: x["score"].isNotNull()))
        return F.concat(best, F.array(top))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))
    best = F.aggregate(F.sequence(F.lit(1), n), start, step)

    def back(path: Column, _: Column) -> Column:
        at = F.get(path, F.lit(0))
        return lambda b: F.when(at == 0, path).otherwise(F.concat(F.array(-F.get(b, at)["back"]), path))

    return let(best, lambda b: F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda path, i: back(path, i)(b)))


# --- the same fold over arrays ----------------------------------------------------------------------------------


class Folder:
    """Merges of many segments at once; exact, one merge per segment and round."""

    def __init__(self, model: Model):
        self.model = model
        chars = sorted({c for p in model.ids for c in p})
        self.extra = {c: len(model.pieces) + i for i, c in enumerate(c for c in chars if c not in model.ids)}
        self.char = {c: model.ids.get(c, self.extra.get(c)) for c in chars}
        known = model.ids | self.extra
        pairs = [(known[p[:i]] << 20 | known[p[i:]], r) for p, r in model.ids.items() for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.into = np.array([r for _, r in pairs] or [0], dtype=np.int64)
        order = np.argsort(-np.array(model.scores), kind="stable")
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))

    def _start(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        kinds, inverse = np.unique(text, return_inverse=True)
        # unknown characters: negative, and no pair's part
        codes = np.array([self.char.get(chr(c), -int(c) - 1) for c in kinds], dtype=np.int64)
        return codes[inverse], np.repeat(np.arange(len(segments)), [len(s) for s in segments])

    def _pair(self, a: int, b: int) -> int | None:
        key = a << 20 | b
        at = min(int(np.searchsorted(self.keys, key)), len(self.keys) - 1)
        return int(self.into[at]) if self.keys[at] == key else None

    def _joined(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((sym[:-1] >= 0) & (sym[1:] >= 0), sym[:-1] << 20 | sym[1:], -2)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.into[at]

    def fold(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in a row, and how many each has."""
        if not segments:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        done_sym, done_word = [], []
        short = [i for i, s in enumerate(segments) if len(s) <= SHORT]
        for i, s in enumerate(segments):
            if len(s) > SHORT:
                own = self._heap(s)
                done_sym.append(np.array(own, dtype=np.int64))
                done_word.append(np.full(len(own), i))
        sym, word = self._start([segments[i] for i in short])
        word = np.array(short, dtype=np.int64)[word]
        never = np.int64(1) << 40
        while len(sym) > 1:
            hit, into = self._joined(sym)
            hit &= word[1:] == word[:-1]
            value = np.where(hit, self.rank[into], never) * 64
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            place = np.arange(len(sym)) - np.repeat(first, size)
            value = np.append(value, never * 64) + place  # the leftmost of equal ranks
            value[np.append(~hit, True)] = never * 64
            best = np.minimum.reduceat(value, first)
            some = best < never * 64
            at = first[some] + best[some] % 64
            sym = sym.copy()
            sym[at] = into[at]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            going = np.repeat(some, size)
            done_sym.append(sym[~going])
            done_word.append(word[~going])
            stay &= going
            sym, word = sym[stay], word[stay]
        done_sym.append(sym)
        done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._ids(sym[order], word[order], len(segments))

    def _ids(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.model.pieces)))
        if not len(odd):
            return sym.astype(np.int32), np.bincount(word, minlength=n)
        back = {v: k for k, v in self.extra.items()}
        many = np.ones(len(sym), dtype=np.int64)
        own = [self.model.fallback(back.get(s) or chr(-s - 1)) for s in sym[odd].tolist()]
        many[odd] = [len(x) for x in own]
        out = np.repeat(sym, many)
        spot = np.cumsum(many) - many
        for i, x in zip(odd.tolist(), own, strict=True):
            out[spot[i] : spot[i] + len(x)] = x
        return out.astype(np.int32), np.bincount(np.repeat(word, many), minlength=n)

    def _heap(self, segment: str) -> list[int]:
        sym = self._start([segment])[0].tolist()
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (r := self._pair(sym[i], sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[r]), i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            push(i)
        gone = [False] * len(sym)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], right[i] = self._pair(a, b), True, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [s for s, g in zip(sym, gone, strict=True) if not g]


def _cut(data: np.ndarray, bounds: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the segments of the texts data[bounds[i]:bounds[i+1]], their hashes, and the bounds of each text's segments."""
    blank, own = data == 0x20, alone[data]
    first = np.zeros(len(data), dtype=bool)
    first[1:] = (blank[1:] & ~blank[:-1]) | own[1:] | own[:-1]
    inner = bounds[:-1]
    first[inner[inner < len(data)]] = True
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, size)
    sums = np.add.reduceat(_TABLE[data] * _powers(int(size.max()))[place], starts)
    return starts, mix(sums ^ size.astype(np.uint64)), np.searchsorted(starts, bounds)


def _texts(column: pa.Array, prefix: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts with blanks for marks and one blank before each that is not empty; their bytes and offsets."""
    texts = column.cast(pa.large_string())
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    if prefix:
        marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, marked)
    texts = pc.fill_null(texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    return texts, np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8), offsets


def _blocks(column: pa.Array, model_prefix: bool, alone: np.ndarray):
    """Block by block: the bytes, segment starts, hashes and bounds by text."""
    _, data, offsets = _texts(column, model_prefix)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        own, bounds = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if len(own):
            yield own, *_cut(own, bounds, alone)
        else:
            yield own, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(to - at + 1, np.int64)
        at = to


def _segment(data: np.ndarray, starts: np.ndarray, i: int) -> str:
    end = starts[i + 1] if i + 1 < len(starts) else len(data)
    return data[starts[i] : end].tobytes().decode("utf-8", "replace").replace(" ", MARK)


def frequent_segments(texts: DataFrame, model: Model, most: int = DICTIONARY) -> DataFrame:
    """``segment``: the ``most`` segments with the greatest counts, counted where they come often in a batch."""
    alone, prefix = model.alone, model.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for part in sliced(batch.column(0)):
                for data, starts, hashes, _ in _blocks(part, prefix, alone):
                    if len(hashes):
                        _, index, many = np.unique(hashes, return_index=True, return_counts=True)
                        for i, c in zip(index[many >= LOCAL].tolist(), many[many >= LOCAL].tolist(), strict=True):
                            s = _segment(data, starts, i)
                            counts[s] = counts.get(s, 0) + c
            yield pa.RecordBatch.from_pydict({"segment": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    counted = texts.mapInArrow(released(run), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    return counted.filter(F.char_length("segment") <= 64).orderBy(F.desc("n"), "segment").limit(most).select("segment")


def _dictionary(words: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes of the segments of (segment, ids), how many ids each has, where they begin, and all ids."""
    if not words.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    plain = pc.replace_substring(words["segment"].cast(pa.large_string()), MARK, " ").combine_chunks()
    offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    _, hashes, per = _cut(data, offsets - offsets[0], np.zeros(256, dtype=bool))
    ids = words["ids"].combine_chunks()
    size, flat = pc.list_value_length(ids).to_numpy().astype(np.int64), pc.list_flatten(ids).to_numpy().astype(np.int32)
    whole = np.flatnonzero(np.diff(per) == 1)
    whole = whole[np.argsort(hashes[per[whole]], kind="stable")]
    return hashes[per[whole]], size[whole], (np.cumsum(size) - size)[whole], flat


def encode(docs: DataFrame, model: Model, text_col: str = "text", out: str = "ids", dictionary: int = DICTIONARY) -> DataFrame:
    """Add ``out`` array<int> to each row of ``docs``: the pieces of its whole text.

    Null gives null, an empty text no pieces. A column of ``docs`` named like ``out`` is replaced. A mark in the text
    counts as a blank.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(out) if out != text_col else docs
    words = lattice(frequent_segments(docs.select(text_col), model, dictionary), model).toArrow()  # bounded by `dictionary`
    key, size, spot, flat = _dictionary(words)
    held = spark.sparkContext.broadcast((model, key, size, spot, flat))
    alone, prefix = model.alone, model.prefix

    @F.arrow_udf("array<int>")
    @released
    def coded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known, size, spot, flat = held.value
        folder = Folder(model)
        for column in columns:
            ids, sizes = [], [np.zeros(1, np.int64)]
            for part in sliced(column):
                for data, starts, hashes, per in _blocks(part, prefix, alone):
                    kinds, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                    at = np.minimum(np.searchsorted(known, kinds), max(0, len(known) - 1))
                    there = known[at] == kinds if len(known) else np.zeros(len(kinds), dtype=bool)
                    rest = np.flatnonzero(~there)
                    more, many = folder.fold([_segment(data, starts, i) for i in index[rest].tolist()])
                    pool = np.concatenate([flat, more])
                    n, where = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
                    if len(known):
                        n[there], where[there] = size[at[there]], spot[at[there]]
                    n[rest], where[rest] = many, len(flat) + np.cumsum(many) - many
                    own = n[inverse]
                    ends = np.cumsum(own)
                    total = int(ends[-1]) if len(ends) else 0
                    ids.append(pool[np.repeat(where[inverse] - (ends - own), own) + np.arange(total)])
                    sizes.append(np.diff(np.append(0, ends)[per]))
            offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            del ids
            yield pa.ListArray.from_arrays(offsets, values, mask=column.is_null() if column.null_count else None)

    return docs.withColumn(out, coded(F.col(text_col)))


def decode(ids: Column, model: Model) -> Column:
    """The text of an array of ids, on DataFrame functions: bytes of the pieces, blanks for marks, without the first blank.

    Null gives null, no ids the empty text. Control and unknown pieces give nothing; ids outside the table nothing.
    """
    text = lambda p, k: f"{int(p[3:5], 16):02x}" if k == BYTE else p.encode().hex() if k in (NORMAL, USER) else ""
    table = F.lit([text(p, k) for p, k in zip(model.pieces, model.kinds, strict=True)])
    raw = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")).cast("string")
    plain = F.replace(raw, F.lit(MARK), F.lit(" "))
    return F.when(plain.startswith(" "), F.substr(plain, F.lit(2))).otherwise(plain) if model.prefix else plain


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: ids of the whole text, and whether decoding gives it back."""
    model = Model.load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, model)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (decode(F.col("ids"), model) == F.col("text")).alias("round_trip"))
