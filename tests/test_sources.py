"""Catalog, files and sinks."""

from datetime import datetime

import pytest

from poiscope.sources import catalog, files, sinks

NOW = datetime(2024, 5, 6, 7, 8, 9)


def test_catalog(spark):
    spark.range(7).createOrReplaceTempView("seven")
    assert "seven" in [r.name for r in catalog.list_tables(spark).collect()]
    assert [tuple(r) for r in catalog.session_catalog(spark, ["seven"]).collect()] == [("seven", 7, 1)]
    assert catalog.session_catalog(spark, []).count() == 0
    assert catalog.scan_table(spark, "seven", 3).count() == 3
    assert catalog.scan_table(spark, "seven").count() == 7
    with pytest.raises(ValueError):
        catalog.scan_table(spark, "no_such_table")


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    first = {r.id for r in catalog.random_sample(df, ["id"], 100, seed=1).collect()}
    assert len(first) == 100
    assert first == {r.id for r in catalog.random_sample(df.repartition(7), ["id"], 100, seed=1).collect()}
    assert first != {r.id for r in catalog.random_sample(df, ["id"], 100, seed=2).collect()}
    assert catalog.random_sample(df, ["id"], 0).count() == 0
    with pytest.raises(ValueError):
        catalog.random_sample(df, ["id"], -1)
    assert len({r.id for r in catalog.random_sample(df, ["id"], 3).collect()}) == 3
    assert catalog.random_sample(df, ["id"], 200_000).count() == 1000


def test_csv_keeps_null_empty_and_line_breaks(spark, tmp_path):
    data = [(1, None), (2, ""), (3, ' "a", b\nc '), (None, None), (4, "\\N x")]
    df = spark.createDataFrame(data, "id int, s string")
    path = files.export_csv({"t": df}, str(tmp_path))["t"]
    back = files.read_exported_csv(spark, path, df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(data, key=str)


def test_loaded_file_becomes_a_table(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "some-data.parquet"))
    name, df = files.register_loaded_file(spark, str(tmp_path / "some-data.parquet"), NOW)
    assert name == "some_data_20240506070809" and df.count() == 5
    (tmp_path / "people.csv").write_text('id,name\n1,"a, b"\n2,\n')
    name, df = files.register_loaded_file(spark, str(tmp_path / "people.csv"), NOW)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a, b"), (2, None)]
    with pytest.raises(ValueError):
        files.register_loaded_file(spark, str(tmp_path / "people.xlsx"), NOW)


def test_saving_cleaned_tables(spark):
    assert sinks.save_cleaned(spark.range(3), "poi", NOW) == "poi_cleaned_20240506070809"
    with pytest.raises(ValueError):
        sinks.save_cleaned(spark.range(0), "poi", NOW)
    sinks.replace_cleaned(spark.range(3), "poi")
    sinks.replace_cleaned(spark.range(4), "poi")
    assert spark.table("poi_cleaned").count() == 4


def test_json_results(spark, tmp_path):
    path = files.export_results_json(spark.range(2), str(tmp_path), "metrics", NOW)
    assert path.endswith("metrics_20240506_070809") and spark.read.json(path).count() == 2


def test_manifest_and_changes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    before = spark.createDataFrame(files.file_manifest(spark, str(tmp_path)).collect())
    assert {r.digest for r in before.collect()} >= {"f97c5d29941bfb1b2fdab0874906ab82"}
    (tmp_path / "b.txt").write_text("2")
    (tmp_path / "c.txt").write_text("three")
    changes = files.manifest_changes(before, files.file_manifest(spark, str(tmp_path)))
    assert {(r.key.rsplit("/", 1)[1], r.change) for r in changes.collect()} == {("b.txt", "modified"), ("c.txt", "added")}


def test_manifest_of_rows(spark):
    df = spark.createDataFrame([(1, "one"), (2, None), (3, "é")], "k int, s string")
    rows = {r.key: (r.length, r.digest) for r in files.manifest(df, "k", "s").collect()}
    assert rows == {1: (3, "f97c5d29941bfb1b2fdab0874906ab82"), 2: (None, None), 3: (2, rows[3][1])}


def test_broken_csv_is_an_error(spark, tmp_path):
    (tmp_path / "broken.csv").write_text('id,name\n1,"a\nb"\n2,c\n')
    assert files.read_csv(spark, str(tmp_path / "broken.csv"), multi_line=True).count() == 2
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, str(tmp_path / "broken.csv"), schema="id int, name string").collect()


def test_filtered_view(spark, places):
    view = catalog.filtered_view(places, "open_retail_places")
    assert view.count() == spark.table("open_retail_places").count() > 0


def test_run_sql_and_preview(spark):
    assert catalog.run_sql(spark, "SELECT count(*) AS n FROM {t}", t=spark.range(9)).first().n == 9
    assert [r.id for r in catalog.preview(spark.range(50), 5, ["id"]).collect()] == [0, 1, 2, 3, 4]
