"""The pipeline's stages on nulls, empty texts, repeated rows, clashing columns and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txsentry.llm import line_dedup, mixing, simhash
from txsentry.llm.common import drop_scratch, owned_scratch, written


def run_stages(spark, docs, folder):
    """Each stage written and read again, as the driver does."""
    seen = []
    docs.write.parquet(f"{folder}/0")
    now = spark.read.parquet(f"{folder}/0")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, now, str(folder)).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        seen.append(now)
    return seen


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, edge_docs):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (7, 1, 0), (None, 1, 1), (9, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def bag(df):
    return Counter(map(str, df.collect()))


def test_defined_cases(spark, edge_docs, folder, tmp_path):
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    seen = run_stages(spark, edge_docs, tmp_path)
    for out in seen[:-1]:
        assert out.columns == edge_docs.columns
    clean, lines, single, mixed, _ = seen
    kept = clean.collect()
    assert {r.doc_id for r in kept if r.text is None} == {None, 3}
    brute = line_dedup.dedup_lines(written(clean, "t")).select("doc_id", "text")
    assert bag(lines.select("doc_id", "text")) == bag(brute)
    fps = [simhash.simhash(r.text) for r in single.collect()]
    assert len(fps) == len(set(fps)) and all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    assert 0 in fps                                     # one of the blank and null texts
    assert set(bag(mixed.select("doc_id", "text"))) <= set(bag(single.select("doc_id", "text")))
    assert seen[-1].count() == mixed.count()


def test_row_identity_from_the_scan_equals_written_rows(spark, edge_docs, tmp_path):
    many = edge_docs.unionByName(edge_docs).unionByName(edge_docs.withColumn("doc_id", F.lit(None).cast("long"))).repartition(6)
    many.write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    placed, row = corpus_pipeline._placed(docs)
    assert placed.select(*row).distinct().count() == docs.count()
    texts = lambda df: Counter(r.text for r in df.collect())
    assert texts(line_dedup.dedup_lines(placed, row=row)) == texts(line_dedup.dedup_lines(docs))
    assert bag(simhash.keep_one(placed, row=row).select("doc_id", "text")) == bag(simhash.keep_one(docs).select("doc_id", "text"))
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(mixing.mixed(placed, row=row)) - words(mixing.mixed(docs))) < words(docs)


def test_rows_that_no_file_holds(spark, edge_docs):
    placed, row = corpus_pipeline._placed(edge_docs.limit(5))
    assert len(row) == 2 and placed.select(*row).distinct().count() == placed.count() == 5


def test_empty_table(spark, no_docs, folder, tmp_path):
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert [out.count() for out in run_stages(spark, no_docs, tmp_path)] == [0] * 5


def test_scratch_tables_have_an_owner(spark):
    with owned_scratch() as paths:
        kept = written(spark.range(5), "mine")
    other = written(spark.range(3), "other")
    assert len(paths) == 1 and kept.count() == 5
    drop_scratch(spark, paths)
    assert other.count() == 3
    with pytest.raises(Exception):
        spark.read.schema("id long").parquet(paths[0]).count()
