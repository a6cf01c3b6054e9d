"""The pipeline's stages on the small tables, and the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert len(corpus_pipeline.STAGES) == 5
    sizes = [before]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > 0 and sizes[2] >= sizes[3] > 0
    ids = spark.read.parquet(f"{tmp_path}/4")
    assert set(ids.columns) >= {"doc_id", "ids"} and ids.where("ids is null").count() == 0


def test_run_leaves_its_last_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [p.name for p in tmp_path.glob("pipeline-*/*")] == ["4-sentencepiece"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:1], ("fails", lambda spark, docs, sf_dir: docs.select("none"))])
    with pytest.raises(Exception):
        corpus_pipeline.run(spark, DATA)
    assert len(list(tmp_path.glob("pipeline-*/*"))) == 1


@pytest.mark.parametrize("name", ["op2_minhash", "op10_url_filter"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
