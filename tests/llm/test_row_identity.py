"""Rows keep their identity when files are cut and packed otherwise between the jobs of an operator."""

from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundshift.llm import kdtree, neardup, queries, rtree, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shifting(spark, monkeypatch):
    """Every table stored by an operator changes how the next job packs files."""
    conf, calls = "spark.sql.files.maxPartitionBytes", []
    sizes = ["20000", "134217728", "7000", "60000"]

    def stored(df, label):
        out = tables.stored(df, label)
        calls.append(label)
        spark.conf.set(conf, sizes[len(calls) % len(sizes)])
        return out

    for module in (neardup, kdtree, rtree):
        monkeypatch.setattr(module, "stored", stored)
    spark.conf.set(conf, sizes[0])
    yield calls
    spark.conf.unset(conf)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    for name in ("documents", "embeddings", "benchmark"):
        table = pq.read_table(f"{SF}/{name}.parquet")
        if name == "benchmark":
            pq.write_table(table, folder / f"{name}.parquet")
            continue
        (folder / f"{name}.parquet").mkdir()
        step = -(-len(table) // 6)
        for i in range(6):
            pq.write_table(table.slice(i * step, step), folder / f"{name}.parquet" / f"part-{i}.parquet", row_group_size=10)
    return str(folder)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_numbers_by_position_do_change(spark, parts, shifting):
    """What the other tests guard against: the same table, numbered in two jobs."""
    docs = spark.read.parquet(f"{parts}/documents.parquet")
    before = dict(docs.select("doc_id", F.monotonically_increasing_id()).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    assert before != dict(spark.read.parquet(f"{parts}/documents.parquet").select("doc_id", F.monotonically_increasing_id()).collect())


@pytest.mark.parametrize("name", ["op1_near_duplicates", "op6_top_k", "op11_hard_negatives"])
def test_queries_give_the_same_rows(spark, parts, shifting, name):
    found = bag(queries.QUERIES[name](spark, parts))
    assert shifting
    spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    with pytest.MonkeyPatch.context() as plain:
        for module in (neardup, kdtree, rtree):
            plain.setattr(module, "stored", tables.stored)
        assert found == bag(queries.QUERIES[name](spark, SF))


def test_stages_keep_the_right_rows(spark, parts, shifting):
    docs = spark.read.parquet(f"{parts}/documents.parquet")
    kept = bag(corpus_pipeline.drop_copies(spark, docs, parts).select("doc_id"))
    classes = {r["doc_id"]: r["class_id"] for r in queries.op1_near_duplicates(spark, SF).collect()}
    assert kept == Counter((c,) for c in set(classes.values()))
    clean = bag(corpus_pipeline.drop_benchmark_passages(spark, docs, parts).select("doc_id"))
    leaked = {r["doc_id"] for r in queries.op8_decontamination(spark, SF).collect()}
    assert clean == Counter((d,) for d in classes if d not in leaked) and leaked


def test_clashing_names_and_tables_in_memory(spark, tmp_path):
    rows = [(1, "one two three four five six seven", 9, 8), (1, "one two three four five six seven", 9, 8), (None, None, 7, 6), (2, "other words here", 5, 4)]
    memory = spark.createDataFrame(rows, "doc_id long, text string, row_number long, ROW_NUMBER_ long")
    path = str(tmp_path / "docs")
    memory.write.parquet(path)
    for docs in (memory, spark.read.parquet(path)):
        kept = neardup.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and sorted(r["row_number"] for r in kept.collect()) == [5, 7, 9]
        assert corpus_pipeline.drop_benchmark_passages(spark, docs, SF).columns == docs.columns
        assert corpus_pipeline.drop_benchmark_passages(spark, docs, SF).count() == 4


def test_rows_of_files_are_unique_and_stable(spark, parts):
    docs = tables.file_rows(spark.read.parquet(f"{parts}/documents.parquet"), "at")
    first = dict((r["doc_id"], r["at"]) for r in docs.select("doc_id", "at").collect())
    assert len(set(first.values())) == docs.count() and docs.schema["at"].dataType.simpleString() == "struct<file:bigint,row:bigint>"
    assert first == dict((r["doc_id"], r["at"]) for r in docs.filter("length(text) >= 0").select("doc_id", "at").collect())
