"""The pipeline, stage by stage, on a small table with odd rows and on an empty one."""

import shutil
from pathlib import Path

import corpus_pipeline
from tests.llm.fixtures import documents, empty, table

FOLDER = "/root/testdata/sf0.001"


def write(df, path):
    df.write.parquet(str(path))


def folder(spark, tmp_path: Path, rows) -> str:
    for name in ("benchmark", "embeddings"):
        shutil.copy(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    write(rows, tmp_path / "documents.parquet")
    return str(tmp_path)


def test_stages_keep_the_columns_and_narrow_the_rows(spark, tmp_path):
    sf = folder(spark, tmp_path, table(spark, documents()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        write(out, tmp_path / f"stage-{k}")
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == counts[-1] and sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)
    assert sorted(map(str, last)) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_an_empty_table_goes_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, empty(spark))).collect() == []
