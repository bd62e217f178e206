"""Quality and toxicity: held-out accuracy, odd rows, the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import features, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(spark, tables):
    out = queries.QUERIES["op8_toxicity"](spark, SF).join(tables[1], "doc_id").filter("held_out")
    row = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("ok"), F.count("*").alias("n")).first()
    assert row.n > 50 and row.ok > 0.9


def test_offending_sentences_are_located(spark, docs):
    clean = [(i, f"The day is fine number {i}. We walk home. All is well.") for i in range(60)]
    bad = [(100 + i, f"The day is fine number {i}. You are a grumblix {i}! All is well.") for i in range(20)]
    df = docs(clean + bad)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + bad] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    text = "é fine. Such a grumblix here. All is well."
    r = toxicity.score(docs([(1, text)]).withColumns({"score": F.lit("x"), "_scored": F.lit(1)}), model).first()
    assert r.score > 0.5 and len(r.offending) == 1
    assert text.encode()[r.offending[0].start : r.offending[0].end].decode() == "Such a grumblix here."
    assert toxicity.score(df.filter("doc_id < 60"), model).filter("score >= 0.3").count() == 0


def test_odd_rows_have_scores(spark, odd, tables):
    model = toxicity.train(odd, tables[1].select("doc_id", "toxic"))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if not (r.text or "").strip())
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.train(odd, tables[1].select("doc_id", "toxic").limit(0))
    assert all(r.score < 1e-6 for r in toxicity.score(odd, none).collect())


def test_feature_blocks_do_not_run_into_each_other():
    import pyarrow as pa

    whole = list(features.blocks(pa.array(["Ab. cd", None, "", "cd! Ef\ngh"])))
    apart = [b for t in ["Ab. cd", None, "", "cd! Ef\ngh"] for b in features.blocks(pa.array([t], pa.string()))]
    assert (whole[0].slots == __import__("numpy").concatenate([b.slots for b in apart])).all()
    assert whole[0].sentences_of.tolist() == [0, 2, 2, 2, 5]


def test_quality_held_out(spark, tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.train(docs, labels.filter(~held))
    out = quality.score(docs, model).join(labels.filter(held), "doc_id")
    row = out.agg(F.avg(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("double")).alias("ok"), F.count("*").alias("n")).first()
    assert row.n > 50 and row.ok > 0.85
    kept = out.filter("quality = 1").agg(F.avg((F.col("quality_score") >= quality.REJECT).cast("double"))).first()[0]
    assert kept > 0.95


def test_quality_of_odd_rows(spark, odd, tables):
    model = quality.train(odd, tables[1].select("doc_id", "quality"))
    rows = quality.score(odd.withColumn("meta_score", F.lit("mine")), model).collect()
    assert len(rows) == 10 and all(0 <= r.quality_score <= 1 for r in rows)
    blank = quality.train(odd.limit(0), tables[1].select("doc_id", "quality").limit(0))
    assert all(r.quality_score > 0.5 for r in quality.score(odd, blank).collect())
    assert quality.score(odd.limit(0), blank).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5] > 0
    distinct = spark.read.parquet(f"{tmp_path}/near_copies")
    assert distinct.select("doc_id").distinct().count() == distinct.count()
    again = spark.read.parquet(f"{tmp_path}/lines")
    assert again.filter("n_chars <> length(text)").count() == 0
    assert docs.filter("ids IS NULL").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_says_the_same(spark, name):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
