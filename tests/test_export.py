import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablewright.operators.export import describe, export_parquet, manifest, summarize, write_parquet
from tests.conftest import rows


def test_everything_is_written(spark, folder):
    df = spark.range(0, 1001, 1, 4)
    files = export_parquet(df, f"{folder}/out")
    assert rows(summarize(files).select("n_files", "n_rows")) == [(4, 1001)]
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(df)
    assert all(file.endswith(".parquet") and size > 0 for file, _, size in files.collect())


def test_an_empty_result_has_a_file_without_rows(spark, folder):
    df = spark.sql("SELECT 1 AS a, 'x' AS b WHERE false")
    assert write_parquet(df, f"{folder}/out") == 0
    files = manifest(spark, f"{folder}/out", df.schema)
    assert [row.n_rows for row in files.collect()] == [0]
    assert spark.read.parquet(f"{folder}/out").columns == ["a", "b"]


def test_an_empty_partitioned_result_has_no_files(spark, folder):
    df = spark.sql("SELECT 1 AS a, 'x' AS b WHERE false")
    files = export_parquet(df, f"{folder}/out", ["b"])
    assert rows(summarize(files)) == [(0, 0, 0)]


def test_a_later_export_replaces_all_of_an_earlier_one(spark, folder):
    export_parquet(spark.sql("SELECT id, id % 3 AS p FROM range(9)"), f"{folder}/out", ["p"])
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        export_parquet(spark.sql("SELECT id, 7 AS p FROM range(2)"), f"{folder}/out", ["p"])
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert rows(spark.read.parquet(f"{folder}/out")) == [(0, 7), (1, 7)]


def test_the_count_is_exact_behind_a_shuffle(spark, folder):
    df = spark.range(5000).repartition(7).groupBy((F.col("id") % 1000).alias("k")).count()
    assert write_parquet(df, f"{folder}/out") == 1000


def test_a_partitioned_write_makes_few_files(spark, folder):
    df = spark.range(0, 4000, 1, 16).withColumn("p", F.col("id") % 4)
    files = export_parquet(df, f"{folder}/out", ["p"])
    assert summarize(files).first().n_files == 4


def test_duplicate_names_are_refused(spark, folder):
    with pytest.raises(AnalysisException, match="COLUMN_ALREADY_EXISTS"):
        export_parquet(spark.sql("SELECT 1 AS a, 2 AS a"), f"{folder}/out")


@pytest.mark.parametrize("target", ["{}/in", "{}/in/", "file:{}/in", "file://{}/in"])
def test_a_result_may_replace_what_it_reads(spark, folder, target):
    spark.range(3).write.parquet(f"{folder}/in")
    export_parquet(spark.read.parquet(f"{folder}/in").where("id > 0"), target.format(folder))
    assert rows(spark.read.parquet(f"{folder}/in")) == [(1,), (2,)]
    assert os.listdir(folder) == ["in"]


def test_a_result_may_read_the_target_in_a_subquery(spark, folder):
    spark.range(10).write.parquet(f"{folder}/out")
    spark.read.parquet(f"{folder}/out").createOrReplaceTempView("old_export")
    df = spark.sql("SELECT id FROM range(20) WHERE id > (SELECT 2 * avg(id) FROM old_export)")
    export_parquet(df, f"{folder}/out")
    assert rows(spark.read.parquet(f"{folder}/out")) == [(i,) for i in range(10, 20)]


def test_a_result_may_read_the_target_from_a_cache(spark, folder):
    spark.range(10).write.parquet(f"{folder}/out")
    kept = spark.read.parquet(f"{folder}/out").cache()
    export_parquet(kept.where("id < 2"), f"{folder}/out")
    kept.unpersist()
    assert rows(spark.read.parquet(f"{folder}/out")) == [(0,), (1,)]


def test_a_query_that_fails_leaves_the_earlier_export(spark, folder):
    export_parquet(spark.range(5), f"{folder}/out")
    failing = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        export_parquet(failing.toDF("id"), f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").count() == 5
    assert os.listdir(folder) == ["out"]


def test_the_text_of_an_export_names_its_files(spark, folder, monkeypatch):
    df = spark.range(0, 6, 1, 3)
    files = export_parquet(df, f"{folder}/out")
    names = sorted(row.file for row in files.collect())
    text = describe(f"{folder}/out", files, df.schema)
    assert "Files:\n" + "\n".join(names) + "\n\nSchema:" in text and len(names) == 3
    monkeypatch.setattr("tablewright.operators.export.NAMES", 2)
    assert "\n".join([*names[:2], "and 1 more"]) in describe(f"{folder}/out", files, df.schema)
    none = describe(f"{folder}/out", files.where("false"), df.schema)
    assert "Files:\nNo Parquet files found (write may have failed)" in none
