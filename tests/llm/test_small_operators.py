"""Sharding, mixing, neighbours, WARC: against their laws and brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, neighbours, sharding, warc


# ---- sharding ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation_is_a_bijection_with_its_inverse(n):
    p = sharding.Permutation(n, seed=9)
    places = p.place(np.arange(n))
    assert sorted(places) == list(range(n)) and (p.number(places) == np.arange(n)).all()
    assert n < 5 or (places != np.arange(n)).any()


def test_shards_are_even_and_slots_gapless(spark, odd):
    df = odd.withColumns({"Shard": F.lit("mine"), "_hash": F.lit(1), "_place": F.lit(2)})
    out = sharding.shard_rows(df, 4)
    assert "_hash" in out.columns and out.columns.count("shard") == 1
    rows = out.collect()
    assert len(rows) == 10
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    again = sharding.shard_rows(df.repartition(3), 4)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_empty_table_and_one_shard(spark, docs):
    assert sharding.shard_rows(docs([(1, "a")]).limit(0), 4).count() == 0
    assert sorted(r.slot for r in sharding.shard_rows(docs([(i, "a") for i in range(5)]), 1).collect()) == [0, 1, 2, 3, 4]


# ---- mixing --------------------------------------------------------------------------------------------------------


def test_targets_stop_at_three_times_and_reshare():
    t = mixing.targets([10, 1000, 1000], [5.0, 2.0, 1.0], 2010)
    assert t[0] == 30 and t[1] == pytest.approx(2 * t[2]) and sum(t) == pytest.approx(2010)
    assert mixing.targets([0, 0], [5.0, 2.0], 0) == [0.0, 0.0]


def test_tree_splits_quotas_exactly():
    q = np.array([100, 7, 0, 55])
    leaves = mixing.split(q, 8, np.random.default_rng(1))
    assert leaves.shape == (8, 4) and (leaves.sum(axis=0) == q).all() and leaves.min() >= 0
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 3


def test_mix_meets_targets_and_reruns_agree(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{int(rng.integers(0, 4))}") for i in range(1500)]
    rows += [(2000 + i, "v " * 3, None) for i in range(20)]
    rows += [(3000 + i, "" if i % 2 else None, None) for i in range(20)]  # without words, of a source that is taken three times
    df = docs(rows)
    out = mixing.mix(df).select("doc_id", "source", "mix_size", "mix_target", "mix_copies").collect()
    by = {}
    for r in out:
        assert len(r.mix_copies) <= 3 and len({c.epoch for c in r.mix_copies}) == len(r.mix_copies)
        t = by.setdefault(r.source, [r.mix_target, 0])
        t[1] += r.mix_size * len(r.mix_copies)
    assert all(abs(got - want) <= 30 for want, got in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r.mix_size for r in out))
    again = mixing.mix(df.repartition(5)).select("doc_id", "mix_copies").collect()
    assert {(r.doc_id, str(r.mix_copies)) for r in again} == {(r.doc_id, str(r.mix_copies)) for r in out}
    shards = {c.shard for r in out for c in r.mix_copies}
    assert shards <= set(range(64))


def test_draws_beyond_the_generator_are_refused():
    with pytest.raises(ValueError):
        mixing.split(np.array([3 * 10**9, 5]), 2, np.random.default_rng(1))


def test_mix_of_odd_rows(spark, odd):
    df = odd.withColumns({"mix_size": F.lit("mine"), "s": F.lit(1), "_mix_key": F.lit(2)})
    out = mixing.mix(df)
    assert out.count() == 10 and "s" in out.columns
    assert mixing.mixed_rows(out).filter("mix_shard IS NULL").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.shuffled(out).count() == mixing.mixed_rows(out).count()


# ---- neighbours ----------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, queries, k):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and ok(v)]
    out = {}
    for q, v in good:
        if q in queries:
            out.setdefault(q, []).extend((c, float(np.sqrt(((v - w) ** 2).sum()))) for c, w in good if c != q and len(w) == len(v))
    return {q: sorted(n, key=lambda x: (x[1], x[0]))[:k] for q, n in out.items() if n}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(1200)]
    rows += [(2000 + i, rows[i][1], 0) for i in range(30)]  # equal vectors: ties
    rows += [(5, rng.normal(size=16).astype(np.float32).tolist(), 0)]  # an id that repeats
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [None] * 16, 0), (None, [1.0] * 16, 0), (3004, [], 0), (3010, [1.0, 2.0], 0), (3020, [3.0, 2.0], 0)]
    df = vectors(spark, rows)
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 5 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, {i for i, _, _ in rows if i is not None and i % 5 == 0}, 10)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [c for _, c, _ in sorted(got[q])] == [c for c, _ in near]
        assert np.allclose([s for _, _, s in sorted(got[q])], [s for _, s in near], rtol=1e-12)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_rows_that_share_an_id_against_the_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (1, [1.0, 0.2], 0), (2, [0.0, 5.0], 0), (100, [3.0, 1.0], 0), (100, [2.0, 1.0], 0), (None, [1.0, 1.0], 0)]
    rows += [(int(i), rng.normal(size=2).astype(np.float32).tolist(), 0) for i in rng.integers(0, 300, 400)]
    vectors(spark, rows).withColumnsRenamed({"label": "v"}).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = neighbours.op9_nearest_vectors(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(neighbours.OP9_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(7, 24)) * 100, rng.normal(size=(50, 24))
    coded = lambda v, base: neighbours.Coded(np.arange(len(v)), np.arange(base, base + len(v)), *neighbours._codes(v))
    lower, upper = neighbours._bounds(coded(q, 0), coded(c, 100))
    full = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2))
    assert (lower <= full).all() and (full <= upper).all()
    rows, cols = neighbours._survivors(lower, upper, 3)
    for i in range(7):
        assert set(np.argsort(full[i])[:3]) <= set(cols[rows == i])


# ---- WARC ----------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, rows, tmp_path, split=1 << 10, min_bytes=0):
    manifest = warc.write_warc(pages(spark, rows), f"file://{tmp_path}/w", min_bytes)
    files = [(p, b) for p, b, _ in manifest]
    return manifest, warc.read_warc(spark, files, split_bytes=split)


def test_warc_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, f"http://h/{i}\r\nX: 1", "".join(chr(int(c)) for c in rng.integers(32, 1000, int(rng.integers(0, 3000))))) for i in range(60)]
    rows += [(100 + i, "u", rows[3][2]) for i in range(5)] + [(200, None, None), (201, "e", ""), (None, "n", rows[3][2])]
    manifest, back = round_trip(spark, rows, tmp_path)
    got = [r for r in back.collect() if r.record_type != "warcinfo"]
    assert len(got) == len(rows) == sum(n for _, _, n in manifest)
    by = {r.record_id: r for r in got}
    for i, url, html in rows:
        r = by[f"{warc.ID}{'' if i is None else i}"]
        body = (html or "").encode()
        assert r.payload_digest == warc.digest(body) and r.payload_bytes == len(body)
        first = min(j for j, _, h in rows if (h or "") == (html or "") and j is not None)
        if i == first:
            assert r.record_type == "response" and r.payload == body and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == f"{warc.ID}{first}"
    assert "X" not in by[f"{warc.ID}0"].target_uri.split("\n")[1:]


def test_splits_neither_lose_nor_repeat_records(spark, tmp_path):
    # stored members hold the magic and false members inside
    junk = warc.MAGIC + b"\x00\x00\x00\x00\x00\x03" + zlib.compress(b"WARC/1.1 no")[2:-4]
    records = [warc._record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<r{i}>")], junk * (i % 5) + b"z" * i) for i in range(200)]
    data = b"".join(warc._member(r, 0 if i % 2 else 6) for i, r in enumerate(records))
    path = tmp_path / "f.warc.gz"
    path.write_bytes(data)
    for split in (37, 1000, len(data)):
        got = [r.record_id for r in warc.read_warc(spark, [(f"file://{path}", len(data))], split_bytes=split).collect()]
        assert sorted(got) == sorted(f"r{i}" for i in range(200))


def test_damage_is_an_error(spark, tmp_path):
    data = bytearray(warc._member(warc.page_record(1, "u", b"hello" * 500, None, False), 6))
    (tmp_path / "cut.gz").write_bytes(data[:-30])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, [(f"file://{tmp_path}/cut.gz", len(data) - 30)]).collect()
    assert hashlib.sha1(b"").hexdigest() and warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_small_payloads_are_all_responses(spark, tmp_path):
    _, back = round_trip(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], tmp_path, min_bytes=5)
    assert {r.record_id[len(warc.ID):]: r.record_type for r in back.collect() if r.record_type != "warcinfo"} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_no_pages_no_files(spark, tmp_path):
    manifest, back = round_trip(spark, [], tmp_path)
    assert manifest == [] and back.count() == 0
