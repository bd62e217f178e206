"""Fingerprints, line dedup, near copies, pieces: against brute force."""

import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tessella.llm import fingerprints, line_dedup, near_join, pieces, shingles
from tessella.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)] + [(5, 5), (None, 3), (7, None), (1, 2), (1, 2)]
    g = Groups()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            g.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: g.find(x) for x in g.parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_without_long_buckets_take_no_turns(spark, monkeypatch):
    calls, sketched = [], line_dedup._sketched
    monkeypatch.setattr(line_dedup, "_sketched", lambda *a: calls.append(1) or sketched(*a))
    base = " ".join(f"word{i}" for i in range(40))
    texts = [base, base + " end", "another line that is quite unlike all of the others here", base.replace("word39", "last")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == {0: base, 1: "", 2: texts[2], 3: ""}
    assert len(calls) == 1


# ---- fingerprints --------------------------------------------------------------------------------------------------

M64 = (1 << 64) - 1
signed = lambda x: x - (1 << 64) if x >> 63 else x


def h_long(v, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", signed(v & M64)), seed & M64)


def h_int(v, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", v), seed & M64)


def brute_signature(text, k=3, take=2, seed=42):
    tokens = [xxhash.xxh64_intdigest(w.encode(), h_int(seed, 42)) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")]
    if not tokens:
        return []
    seen, slots = Counter(), defaultdict(list)
    for i in range(max(1, len(tokens) - k + 1)):
        h = 42
        for t in tokens[i : i + k]:
            h = h_long(t, h)
        kmer = h >> 25
        ranked = h_int(seen[kmer], h_long(kmer, h_int(seed + 1, 42)))
        seen[kmer] += 1
        slots[ranked >> 58].append(((ranked >> 25) & ((1 << 33) - 1), i))
    out = []
    for slot, members in sorted(slots.items()):
        h = 42
        for rank, _ in sorted(sorted(members)[:take], key=lambda m: (m[1], m[0])):
            h = h_long(rank, h)
        out.append((slot << 32) | (h >> 32))
    return out


def test_signature_against_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, int(n))) for n in (1, 2, 3, 4, 10, 80, 400, 900)] + ["a b " * 200, "same " * 50, "x" * 400, "", None, "é 你好 🙂 " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", fingerprints.signature(F.col("t")).alias("s")).collect():
        assert r.s == brute_signature(texts[r.i]), r.i


def test_order_matters_and_equal_texts_agree(spark):
    rng = np.random.default_rng(7)
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(600)]
    moved = base[300:] + base[:300]
    shuffled = list(rng.permutation(base))
    edit = base[:590] + ["other"] * 10
    rows = [tuple(" ".join(x) for x in (base, list(base), edit, moved, shuffled))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    s = {c: fingerprints.signature(F.col(c)) for c in "abcde"}
    r = df.select(*(fingerprints.likeness(s["a"], s[c]).alias(c) for c in "bcde")).first()
    assert r.b == 1.0 and r.c > 0.8 and r.c > r.d > r.e and r.e < 0.05
    assert df.select(fingerprints.likeness(fingerprints.signature(F.lit("")), fingerprints.signature(F.lit(None).cast("string")))).first()[0] == 1.0


def test_next_document(spark, odd):
    df = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("x").alias("_part"))
    rows = fingerprints.with_next(df, "doc_id", ["text"]).collect()
    assert len(rows) == 10 and "_part" in rows[0]
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 1)}
    assert by[7].next_text == by[6].text and by[3].next_text == by[2].text and by[2].next_text == "a b c d e f g h"
    assert Counter(r.next_text for r in rows) == Counter(r.text for r in rows)
    one = fingerprints.with_next(df.filter("doc_id = 7"), "doc_id", ["text"]).first()
    assert one.next_text == one.text
    assert fingerprints.with_next(df.limit(0), "doc_id", ["text"]).count() == 0


# ---- lines ---------------------------------------------------------------------------------------------------------

def plain_shingles(line):
    """Runs of 12 UTF-16 units from every place; a shorter line is one."""
    x = line.lower().encode("utf-16-be")
    return {x[2 * i : 2 * i + 24] for i in range(max(len(x) // 2 - 11, 1))}


def brute_lines(rows, similarity=0.75):
    lines, where = [], []
    for i, text in rows:
        for j, line in enumerate((text or "").split("\n")):
            if WORDS.search(line):
                lines.append(line)
                where.append((i, j))
    sets = [plain_shingles(x) for x in lines]
    g = Groups()
    for a in range(len(lines)):
        g.find(a)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if lines[a] == lines[b] or both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                g.join(a, b)
    gone = defaultdict(set)
    firsts = {}
    for a in sorted(range(len(lines)), key=lambda a: where[a]):
        if firsts.setdefault(g.find(a), a) != a:
            gone[where[a][0]].add(where[a][1])
    return {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in rows}


def test_lines_against_brute_force(spark, docs):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "bcdfgk" for b in ("an", "on", "ort", "elle", "i")]
    base = [" ".join(rng.choice(words, 25)) for _ in range(30)]

    def near(x, n):
        out = x.split()
        for _ in range(n):
            out[int(rng.integers(0, len(out)))] = "changed"
        return " ".join(out)

    rows = []
    for i in range(60):
        own = [base[int(rng.integers(0, 30))] for _ in range(3)]
        rows.append((i, "\n".join([own[0], near(own[1], 1), "", near(own[2], 9).upper(), f"only here {i * 7919} {i * 104729} for good"])))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute_lines(rows)


def hot_lines(rng, pairs=30):
    """Texts in no order, each with a near copy, that share the shingle of least hash in every slot of a band, and so that band."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    hashed = lambda w: xxhash.xxh64_intdigest(w.encode("utf-16-be"), 42) >> 1
    words = sorted({"".join(w) for w in rng.choice(letters, (50_000, 12))}, key=hashed)
    common = [next(w for w in words if hashed(w) % line_dedup.SLOTS == k) for k in range(2 * line_dedup.BANDS)]
    out = []
    for _ in range(pairs):
        own = ["".join(w) for w in rng.choice(letters, (60, 8))]
        out += [" ".join(common + own), " ".join(common + [*own[:20], "replaced", *own[21:]])]
    return [out[i] for i in rng.permutation(len(out))]


@pytest.mark.parametrize("chunk", [8, 256])
def test_near_lines_apart_in_a_hot_bucket(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    rows = list(enumerate(hot_lines(np.random.default_rng(5))))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute_lines(rows)
    assert sum(t == "" for t in got.values()) == 30


def test_no_pair_of_lines_is_judged_twice(spark, docs, monkeypatch):
    """Lines somewhat below the threshold, three or more in a bucket: what a first line's pairs have settled the tiles leave out."""
    seen, near = [], line_dedup._near
    monkeypatch.setattr(line_dedup, "_near", lambda pairs, *a: seen.extend((r.a, r.b) for r in pairs.collect()) or near(pairs, *a))
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    base = [word() for _ in range(80)]
    rows = []
    for i in range(12):
        own = list(base)
        for at in (3 + 6 * i, 6 + 6 * i):
            own[at] = word()
        own[76:] = [word() for _ in range(4)]
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute_lines(rows) and len(seen) > 11
    assert len(seen) == len(set(seen))


def test_a_pair_comes_from_one_of_its_buckets(spark, docs, monkeypatch):
    """Lines that share all bands are met in the first of those buckets only, where each of the five would make the pair."""
    made, tiles = [], line_dedup._tiles
    monkeypatch.setattr(line_dedup, "_tiles", lambda *a: made.extend((r.a, r.b) for r in tiles(*a).collect()) or tiles(*a))
    rows = list(enumerate(hot_lines(np.random.default_rng(6), 12)))
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()} == brute_lines(rows)
    assert made and len(made) == len(set(made))


def test_sets_are_made_once_for_each_line(spark, monkeypatch):
    cut, sets = [], line_dedup._sets
    monkeypatch.setattr(line_dedup, "_sets", lambda texts: cut.extend(r.id for r in texts.collect()) or sets(texts))
    base = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), 400))
    lines = [base[:n] for n in (1, 11, 12, 13, *range(12 + 30, 12 + 35), 12 + 62, 12 + 63, 12 + 64, 300, 400)] + ["ab" * 60, "é🙂x" * 30]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    signed = lambda x: struct.unpack("q", struct.pack("Q", xxhash.xxh64_intdigest(x, 42)))[0]
    plain = [plain_shingles(x) for x in lines]
    assert {r.id: set(r.s) for r in sets(texts).collect()} == {k: set(map(signed, x)) for k, x in enumerate(plain)}
    maps = line_dedup._maps(sets(texts))
    pairs = [(a, b) for a in range(len(lines)) for b in range(a)]
    got = line_dedup._near(spark.createDataFrame(pairs, "a long, b long"), maps, texts, 0.75).collect()
    want = {(a, b) for a, b in pairs if len(plain[a] & plain[b]) >= 0.75 * len(plain[a] | plain[b])}
    assert {(r.a, r.b) for r in got} == want and len(want) > 10
    assert len(cut) == len(set(cut))


def test_shingles_with_repeats_and_of_all_lengths(spark):
    lines = ["ab" * 40, "x" * 70, *("Some Words, of a line that is cut"[:n] for n in range(1, 33))]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    signed = lambda x: struct.unpack("q", struct.pack("Q", xxhash.xxh64_intdigest(x, 42)))[0]
    want = {k: sorted(map(signed, plain_shingles(x))) for k, x in enumerate(lines)}
    assert {r.id: sorted(r.s) for r in df.select("id", line_dedup.shingle_set(F.col("line")).alias("s")).collect()} == want
    sets = df.select("id", line_dedup._shingles(F.col("line")).alias("s"))
    assert {r.id: r.n for r in line_dedup._maps(sets).collect()} == {k: len(v) for k, v in want.items()}


def test_shingles_start_at_every_character(spark, docs):
    lines = ["2024-05-01T10:22:31Z INFO job finished ok", "2024-05-01T11:59:31Z INFO job finished ok", "Short", "", "é🙂" * 9, "x" * 40]
    got = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", line_dedup.shingle_set(F.col("line")).alias("s")).collect()
    signed = lambda x: struct.unpack("q", struct.pack("Q", xxhash.xxh64_intdigest(x, 42)))[0]
    assert {r.k: sorted(r.s) for r in got} == {k: sorted(map(signed, plain_shingles(x))) for k, x in enumerate(lines)}
    long = "".join(np.random.default_rng(3).choice(list("0123456789abcdef"), 300))
    rows = [(i, x) for i, x in enumerate([*lines[:2], long, "#" + long])]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()} == {0: lines[0], 1: lines[1], 2: long, 3: ""}


@pytest.mark.parametrize("bases, variants, words, changed", [(8, 60, 20, 1), (6, 80, 30, 2)])
def test_many_variants_of_a_line(spark, docs, bases, variants, words, changed):
    rng = np.random.default_rng(words)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda: "".join(rng.choice(letters, int(rng.integers(3, 9))))
    rows = []
    for _ in range(bases):
        base = [word() for _ in range(words)]
        for _ in range(variants):
            own = list(base)
            for at in rng.integers(0, words, changed):
                own[at] = word()
            rows.append(" ".join(own))
    rows = list(enumerate(rows[i] for i in rng.permutation(len(rows))))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_that_differ_late_in_long_words_or_are_shifted(spark, docs):
    rng = np.random.default_rng(9)
    japanese = "".join(chr(0x3041 + int(i)) for i in rng.integers(0, 80, 38))
    rows = [(1, "customer-id-0001 transaction-0001"), (2, "customer-id-0999 transaction-0777"), (3, japanese), (4, "「" + japanese), (5, "x" * 70_000)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute_lines(rows) and got[2] and got[3] and not got[4]


def test_lines_of_one_shingle(spark, docs):
    rows = [(1, "Unsubscribe"), (2, "UNSUBSCRIBE"), (3, "unsubscribed\nok"), (4, "OK")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == {1: "Unsubscribe", 2: "", 3: "unsubscribed\nok", 4: ""}


def test_odd_lines(spark, odd):
    df = odd.withColumns({"n_lines": F.lit("mine"), "_drops": F.lit(0), "_line_key": F.lit(1)})
    rows = line_dedup.dedup_lines(df).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[2].text is None and by[2].n_lines == 0
    assert by[3].text == "" and by[4].text == "  \n\n " and by[7].text == "é ü 你好 🙂\nline two" and by[7].n_dropped == 1
    assert [r.text for r in rows if r.doc_id is None and r.text is not None] == [""]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# ---- near copies ---------------------------------------------------------------------------------------------------


def brute_shingles(text, k=5):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows):
    sets, g = [brute_shingles(t) for _, t in rows], Groups()
    for a in range(len(rows)):
        g.find(a)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                g.join(a, b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[g.find(a)].append(i)
    return Counter((i, len(sets[a]), min((x for x in least[g.find(a)] if x is not None), default=None)) for a, (i, _) in enumerate(rows))


def test_shingle_sets_against_brute_force():
    texts = ["", None, "  ", "a", "a b", "A  b\n", "b a", "a b c d e", "a b c d e f", "x" * 3_000_000, "ab", "", "a b c\x1fd", "w " * 50, "É é"]
    got = [len(s) for s in shingles.shingle_sets(pa.array(texts))]
    assert got == [len(brute_shingles(t)) for t in texts]
    sets = list(shingles.shingle_sets(pa.array(["A b", "a  b\n", "b a", "ab"])))
    assert (sets[0] == sets[1]).all() and (sets[0] != sets[2]).all() and (sets[0] != sets[3]).all()


@pytest.mark.parametrize("chunk", [2048, 16])
def test_near_copies_against_brute_force(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(near_join, "CHUNK", chunk)
    rng = np.random.default_rng(13)
    words = [f"v{i}" for i in range(300)]
    common = " ".join(rng.choice(words, 40))
    rows = []
    for i in range(40):
        text = list(rng.choice(words, int(rng.integers(5, 120))))
        rows.append((1000 - i, " ".join(text)))
        for c in range(int(rng.integers(0, 4))):
            copy = list(text)
            for _ in range(c):
                copy[int(rng.integers(0, len(copy)))] = f"e{rng.integers(0, 10**6)}"
            rows.append((2000 + len(rows), " ".join(copy).upper()))
    rows += [(3000 + i, f"{common} {' '.join(rng.choice(words, 12))}") for i in range(60)]  # a hot passage, some links
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (None, "one two"), (5002, "one two"), (None, None)]
    df = docs(rows).withColumns({"_row": F.lit(1), "n_shingles": F.lit(2)})
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_join.near_components(df).collect())
    assert got == brute_near(rows)
    left = near_join.one_of_each(df).select("doc_id", "text").collect()
    want = {c for _, n, c in brute_near(rows) if n}
    assert sorted(r.doc_id for r in left if brute_shingles(r.text)) == sorted(want)
    assert sum(1 for r in left if not brute_shingles(r.text)) == 3


def test_no_documents(spark, docs):
    assert near_join.near_components(docs([(1, "a")]).limit(0)).count() == 0


# ---- pieces --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load()


def test_encoding_is_the_librarys_and_decodes(spark, docs, model):
    rng = np.random.default_rng(17)
    letters = list("abcdefgh     ABC éüñ,.\n\t0123你好🙂▂")
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 400, 80)]
    texts += ["", " ", "  lead", "trail  ", "a" * 700, "ab" * 900 + " x", "日本語" * 300, "a\x00b", "\n\n\n"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    df = docs([(i, t) for i, t in enumerate(texts)] + [(-1, None)]).withColumn("ids", F.lit("mine"))
    for dictionary in (0, 50):
        out = pieces.encode(df, model, dictionary=dictionary).select("doc_id", "ids", "text", pieces.decode(F.col("ids"), model).alias("back"))
        for r in out.collect():
            if r.doc_id == -1:
                assert r.ids is None and r.back is None
            else:
                assert r.ids == library.encode(texts[r.doc_id]), texts[r.doc_id]
                assert r.back == r.text
    assert pieces.encode(df.limit(0), model).count() == 0


def test_relational_lattice_is_the_librarys(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    words = ["Hello", "international", "été", "🙂🙂", "xqzwv", "a", "  two", "   three3"]
    segments = spark.createDataFrame([("▁" + w.replace(" ", "▁"),) for w in words], "segment string")
    got = {r.segment: r.ids for r in pieces.lattice(segments, model).collect()}
    for w in words:
        assert got["▁" + w.replace(" ", "▁")] == library.encode(w)


def test_viterbi_of_a_unigram_model(spark):
    table = {"a": -1.0, "b": -1.5, "c": -2.0, "ab": -1.8, "bc": -2.2, "abc": -4.5, "ca": -2.5, "▁": -1.0, "▁a": -1.2}
    m = pieces.Model(["<unk>", *table], [0.0, *table.values()], [pieces.UNKNOWN, *[pieces.NORMAL] * len(table)], pieces.UNIGRAM)

    def best(s):
        top = {0: (0.0, [])}
        for to in range(1, len(s) + 1):
            options = [(top[f][0] + table[s[f:to]], top[f][1] + [s[f:to]]) for f in range(to) if s[f:to] in table]
            top[to] = max(options, key=lambda x: x[0])
        return top[len(s)]

    words = ["▁abcab", "▁cacab", "abcabc", "▁a", "bbb", "▁bcabca"]
    df = spark.createDataFrame([(w,) for w in words], "segment string")
    for r in pieces.lattice(df, m).collect():
        got = sum(table[m.pieces[i]] for i in r.ids)
        assert "".join(m.pieces[i] for i in r.ids) == r.segment and got == pytest.approx(best(r.segment)[0])
