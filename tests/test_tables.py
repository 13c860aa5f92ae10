"""Readers and table maintenance on small literal inputs."""

import datetime as dt

from pyspark.sql import functions as F

from gridwatt.session import scratch_path, stored
from gridwatt.sources import panels, readers, tables

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_matches_null_keys_and_repeats_safely(spark):
    t = spark.createDataFrame([("a", None, 1.0), ("a", 1, 2.0), ("b", 2, 3.0)], "k string, i int, v double")
    s = spark.createDataFrame([("a", None, 9.0), ("c", 3, 4.0)], "k string, i int, v double")
    once = tables.upsert(t, s, ["k", "i"])
    want = [("a", 9.0), ("a", 2.0), ("b", 3.0), ("c", 4.0)]
    assert rows(once, "k", "v") == sorted(want)
    assert rows(tables.upsert(once, s, ["k", "i"]), "k", "v") == sorted(want)


def test_dedupe_keeps_the_last(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 5.0), (None, 2, 6.0)], "k string, o int, v double")
    assert rows(tables.dedupe_last(d, ["k"], "o").fillna("-"), "k", "v") == [("-", 6.0), ("a", 2.0)]


def test_partition_upsert_leaves_other_partitions_alone(spark):
    path = scratch_path(spark, "upsert")
    spark.createDataFrame([(1, 2023, 1.0), (2, 2024, 2.0)], "k int, y int, v double").write.partitionBy("y").parquet(path)
    before = {r[0] for r in spark.read.parquet(path).filter("y = 2023").select(F.input_file_name()).collect()}
    tables.upsert_partitions(spark, path, spark.createDataFrame([(2, 2024, 7.0), (3, 2024, 8.0)], "k int, y int, v double"), ["k", "y"], "y")
    assert rows(spark.read.parquet(path), "k", "y", "v") == [(1, 2023, 1.0), (2, 2024, 7.0), (3, 2024, 8.0)]
    assert {r[0] for r in spark.read.parquet(path).filter("y = 2023").select(F.input_file_name()).collect()} == before


def _upsert(spark, old, new, schema, keys, partition="p"):
    path = scratch_path(spark, "upsert")
    spark.createDataFrame(old, schema).write.partitionBy(partition).parquet(path)
    for _ in range(2):                                        # a replay changes nothing
        tables.upsert_partitions(spark, path, spark.createDataFrame(new, schema), keys, partition)
    kinds = spark.createDataFrame(old, schema).schema
    got = spark.read.schema(kinds).parquet(path).select(*kinds.names).collect()
    return sorted(map(tuple, got), key=str)


def test_partition_upsert_keeps_null_padded_and_moved_partitions(spark):
    text = "k int, p string, v int"
    assert _upsert(spark, [(1, None, 1), (2, None, 2), (3, "a", 3)], [(1, None, 9), (3, "a", 8)], text, ["k", "p"]) == [(1, None, 9), (2, None, 2), (3, "a", 8)]
    assert _upsert(spark, [(1, None, 1), (2, "a", 2)], [(1, None, 9), (4, None, 4)], text, ["k", "p"]) == [(1, None, 9), (2, "a", 2), (4, None, 4)]
    assert _upsert(spark, [(1, "01", 1), (2, "1", 2)], [(1, "01", 9)], text, ["k", "p"]) == [(1, "01", 9), (2, "1", 2)]
    assert _upsert(spark, [(1, "a", 1), (2, "a", 2), (3, "b", 3)], [(1, "c", 9), (3, "a", 7)], text, ["k"]) == [(1, "c", 9), (2, "a", 2), (3, "a", 7)]


def test_slice_on_disk(spark):
    path = scratch_path(spark, "slice")
    spark.createDataFrame([("A", 1), ("B", 2)], "s string, v int").write.partitionBy("s").parquet(path)
    tables.replace_slice_on_disk(spark.createDataFrame([("B", 9)], "s string, v int"), path, "s")
    assert rows(spark.read.parquet(path), "s", "v") == [("A", 1), ("B", 9)]


def test_watermark_backfills_an_empty_target(spark):
    d = spark.createDataFrame([(D(2026, 1, 1),), (D(2026, 1, 2),)], "day date")
    assert tables.after_watermark(d, d.limit(0), "day").count() == 2
    assert tables.after_watermark(d, d.filter("day = DATE'2026-01-01'"), "day").count() == 1


def test_dimension_is_loaded_once(spark, tmp_path):
    f = tmp_path / "w.csv"
    f.write_text("area,latitude,longitude,population\nDE,50.0,8.0,10\n")
    spark.sql("DROP TABLE IF EXISTS pop_test")
    assert tables.load_dimension_once(spark, "pop_test", str(tmp_path / "missing.csv"), ["area"]) is None
    assert tables.load_dimension_once(spark, "pop_test", str(f), ["area", "population"]).count() == 1
    f.write_text("area,latitude,longitude,population\nDE,50.0,8.0,10\nFR,48.0,2.0,10\n")
    assert tables.load_dimension_once(spark, "pop_test", str(f), ["area"]).count() == 1
    spark.sql("DROP TABLE pop_test")
    assert tables.first_column(spark.createDataFrame([(1,)], "Curve_Member int"), ["curve_member", "member"]) == "Curve_Member"


def test_wide_indices(spark, tmp_path):
    f = tmp_path / "i.csv"
    f.write_text("Date,NAO eof,AO\n2026-11-01,0.5,M\n11/02/2026,inf,1.5\nnot a date,1,1\n1970-01-01,1,1\n")
    got = rows(readers.read_wide_indices(spark, str(f)), "index_name", "date", "value")
    assert got == [("AO", D(2026, 11, 2), 1.5), ("NAO_EOF", D(2026, 11, 1), 0.5)]


def test_panel_files(spark, tmp_path):
    (tmp_path / "t-SWE_countries_timeseries.csv").write_text(
        'country,France,France,"Korea, South"\nband,total,total_roll,total\n2026-07-31,1.0,2.0,9\n07/31/2026,3.0,,nan\n2026-10-01 00:00:00,5.0\nnot a day,1,1,1\n2026-11-01,,inf,x\n')
    (tmp_path / "m-SWE_countries_timeseries.csv").write_text("country,France,France\nband,total,total_roll\n2026-07-31,0.1,0.2\n2026-12-01,0.5,0.6\n")
    (tmp_path / "t-SWE_timeseries.csv").write_text("date,SWE_raw,SWE_roll\n2026-01-01,7,8\n")
    (tmp_path / "m-SWE_catchments_timeseries.csv").write_text("date,Po,Po_roll\n2026-01-01,1,2\n")
    (tmp_path / "t-Upper-Rhone_heightbands_timeseries.csv").write_text("\ufeffdate,500-1000,500-1000_roll\r\n2026-01-01,3,4\r\n", encoding="utf-8")
    (tmp_path / "t-SWE_countries_timeseries.csv.bak").write_text("junk")
    (tmp_path / "m-empty_heightbands_timeseries.csv").write_text("")
    p = panels.read_panels(spark, str(tmp_path), panels.PIXELS | {"alps": 25})
    got = rows(p, "level", "day", "region", "band", *panels.MEASURES, "pixel_size_m", "winter_season", "day_of_winter")
    assert got == [("alps", D(2026, 1, 1), "Alps", "total", 7.0, None, 8.0, None, 25, "2025/2026", 93), ("catchment", D(2026, 1, 1), "Po", "total", None, 1.0, None, 2.0, 100, "2025/2026", 93),
                   ("country", D(2026, 7, 31), "France", "total", 3.0, 0.1, None, 0.2, 300, "2025/2026", 304),
                   ("country", D(2026, 10, 1), "France", "total", 5.0, None, None, None, 300, "2026/2027", 1), ("country", D(2026, 12, 1), "France", "total", None, 0.5, None, 0.6, 300, "2026/2027", 62),
                   ("heightband", D(2026, 1, 1), "Upper-Rhone", "500-1000", 3.0, None, 4.0, None, 100, "2025/2026", 93)]
    assert len(panels.PanelReader(str(tmp_path)).partitions()) == 6
    assert panels.read_panels(spark, str(tmp_path / "none")).count() == 0


def test_curve_models(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"ldz_de": {"structure": "single", "k_cold": 15, "k_hot": null, "names": ["intercept", "T", "cold"], "coef": [10, -1, 2], "bias_correction": 0.5}}')
    r = readers.read_curve_models(spark, str(f)).first()
    assert (r["series"], r["country"], r["b_intercept"], r["b_t"], r["b_cold"], r["b_hot"], r["k_hot"], r["half_life_days"]) == ("ldz", "de", 10.0, -1.0, 2.0, 0.0, None, 0.0)


def test_stored_reads_back_the_same(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert rows(stored(d).fillna("-"), "k", "s") == [(1, "a"), (2, "-")]
