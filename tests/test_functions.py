"""Column functions on hand-computed edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from gridwatt.functions import geo, holidays, measures, names, time

D = dt.date


def one(spark, col, **values):
    """Evaluate a column over a one-row frame of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first()["x"]


def test_cet_day_follows_daylight_saving(spark):
    ts = F.col("s").cast("timestamp")
    cases = {"2026-07-01 21:59:00": D(2026, 7, 1), "2026-07-01 22:00:00": D(2026, 7, 2), "2026-01-01 22:59:00": D(2026, 1, 1),
             "2026-01-01 23:00:00": D(2026, 1, 2), "2026-03-28 23:00:00": D(2026, 3, 29), "2026-03-29 22:00:00": D(2026, 3, 30),
             "2026-10-24 22:00:00": D(2026, 10, 25), "2026-10-25 22:59:00": D(2026, 10, 25), "2026-10-25 23:00:00": D(2026, 10, 26)}
    for s, want in cases.items():
        assert one(spark, time.cet_day(ts), s=s) == want, s


def test_leap_days_share_a_slot(spark):
    d = F.col("s").cast("date")
    for s, want in {"2024-02-28": 59, "2024-02-29": 60, "2024-03-01": 60, "2023-03-01": 60, "2024-12-31": 365, "1900-12-31": 365}.items():
        assert one(spark, time.doy365(d), s=s) == want, s


def test_cycles_and_init(spark):
    ts = F.col("s").cast("timestamp")
    for s, want in {"2026-10-05 07:45:00": dt.datetime(2026, 10, 5, 0), "2026-10-05 19:45:00": dt.datetime(2026, 10, 5, 12),
                    "2026-10-05 03:00:00": dt.datetime(2026, 10, 4, 12)}.items():
        assert one(spark, time.snap_to_cycle(ts), s=s) == want, s
    init = time.init_time(ts, F.lit(12))
    assert one(spark, init, s="2026-09-20 22:00:00") == dt.datetime(2026, 9, 21, 12)


def test_weeks_and_winters(spark):
    d = F.col("s").cast("date")
    assert one(spark, time.week_label(d), s="2027-01-01") == "W53"
    assert one(spark, time.week_start(d), s="2027-01-01") == D(2026, 12, 28)
    assert one(spark, time.winter_season(d), s="2026-07-31") == "2025/2026"
    assert one(spark, time.winter_season(d), s="2026-08-01") == "2026/2027"
    assert one(spark, time.day_of_winter(d), s="2026-10-01") == 1


def test_report_windows_by_weekday(spark):
    d = F.col("s").cast("date")
    w = time.report_windows(d)
    got = {s: [one(spark, w[k], s=s) for k in ("w1_start", "w1_end", "w2_start", "w2_end", "prev_days", "delta_label")]
           for s in ("2026-09-21", "2026-09-23", "2026-09-25", "2026-09-27")}
    assert got["2026-09-21"] == [D(2026, 9, 21), D(2026, 9, 27), D(2026, 9, 28), D(2026, 10, 4), 3, "Δ -72h"]
    assert got["2026-09-23"] == [D(2026, 9, 26), D(2026, 9, 27), D(2026, 9, 28), D(2026, 10, 4), 1, "Δ -24h"]
    assert got["2026-09-25"] == [D(2026, 9, 28), D(2026, 10, 4), D(2026, 10, 5), D(2026, 10, 11), 1, "Δ -24h"]
    assert got["2026-09-27"][4:] == [2, "Δ -48h"]


def test_gas_pairs_on_and_around_monday(spark):
    p = time.gas_run_pair(F.col("p"), F.col("s").cast("timestamp"))
    get = lambda s, pat: [one(spark, p[k], s=s, p=pat) for k in ("prev_pattern", "prev_day", "d_in", "d_out")]
    assert get("2026-09-21 00:00:00", "ec00ens") == ["ec00ens", D(2026, 9, 18), D(2026, 9, 21), D(2026, 10, 2)]
    assert get("2026-09-22 00:00:00", "ec00ens") == ["ec00ens", D(2026, 9, 21), D(2026, 9, 23), D(2026, 10, 5)]
    assert get("2026-09-20 12:00:00", "ec12ens") == ["ec00ens", D(2026, 9, 18), D(2026, 9, 20), D(2026, 10, 1)]
    assert get("2026-09-22 12:00:00", "ec12ens") == ["ec00ens", D(2026, 9, 22), D(2026, 9, 23), D(2026, 10, 5)]


def test_windows_a_forecast_can_fill(spark):
    w = time.forecast_windows(F.col("a").cast("date"), F.col("b").cast("date"))
    assert one(spark, w["rest_start"], a="2026-09-27", b="2026-10-10") is None          # a Sunday issue
    assert one(spark, w["after_start"], a="2026-09-21", b="2026-10-04") is None
    assert one(spark, w["next_end"], a="2026-09-21", b="2026-10-01") == D(2026, 10, 1)


def test_easter_and_day_types(spark):
    for y, want in {1818: D(1818, 3, 22), 1943: D(1943, 4, 25), 2000: D(2000, 4, 23), 2024: D(2024, 3, 31), 2026: D(2026, 4, 5), 2038: D(2038, 4, 25)}.items():
        assert one(spark, holidays.easter(F.col("y")), y=y) == want
    d = F.col("s").cast("date")
    load = holidays.daytype_load(d, F.col("a"))
    assert one(spark, load, s="2026-12-26", a="DE") == "holiday"      # a Saturday: the holiday wins
    assert one(spark, holidays.daytype_gas(d), s="2026-12-26") == "sat"
    assert one(spark, load, s="2026-05-14", a="DE") == "holiday"      # Ascension
    assert one(spark, load, s="2026-05-14", a="UK") == "weekday"
    assert one(spark, load, s="2026-08-31", a="UK") == "holiday"      # last Monday of August
    assert one(spark, load, s="2026-12-29", a="XX") == "holiday"      # the year-end lull


def test_member_ids(spark):
    m = names.member_id(F.col("m"))
    for text, want in {"M07": 7, "ens07": 7, "7.0": 7, "07": 7, "e06": 6, "Ctrl": 0, "M00": 0, "avg": None, "xyz": None, "run2_m13": 13}.items():
        assert one(spark, m, m=text) == want, text
    assert one(spark, names.member_id(F.col("m"), F.lit("one_based")), m="12") == 11


def test_patterns_match_whole_words(spark):
    whole = names.classify_by_pattern(F.col("n"), ["ec00", "gfs00"], "% {p} %")
    assert one(spark, whole, n="tt de con ec00ens °c") is None
    assert one(spark, whole, n="tt de con ec00 °c") == "ec00"
    assert one(spark, names.classify_by_pattern(F.col("n"), ["ec00", "ec00ens"]), n="tt de con ec00ens °c") == "ec00ens"


def test_snapping_and_regions(spark):
    assert one(spark, geo.snap_coord(F.col("x"), 0.5), x=47.9999999) == 48.0
    assert one(spark, geo.named_region(F.col("a"), F.col("b")), a=47.0, b=10.0) == "the Alps"
    assert one(spark, geo.named_region(F.col("a"), F.col("b")), a=-12.0, b=-60.0) == "12°S 60°W"


def test_percent_of_a_zero_normal_is_null(spark):
    assert one(spark, measures.anomaly_pct(F.col("v"), F.col("n")), v=3.0, n=0.0) is None
    assert one(spark, names.leading_number(F.col("t")), t="12.6 GW") == 12.6
    assert one(spark, names.leading_number(F.col("t")), t="n/a") is None


def test_interpolation_is_flat_beyond_the_grid(spark):
    k = measures.interp_grid([7, 14, 28], F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.col("h"))
    assert [one(spark, k, h=h) for h in (1.0, 7.0, 10.5, 21.0, 99.0)] == [1.0, 1.0, 1.5, 3.0, 4.0]


def test_tails(spark):
    # two-sided t: t(1) at 1 is 0.5; t(10) at 2.228139 is 0.05; large df approaches the normal
    rows = spark.createDataFrame([(1.0, 1.0), (2.2281388519649385, 10.0), (1.959963984540054, 1e7), (0.0, 5.0), (None, 3.0)], "t double, v double")
    got = [r[0] for r in rows.select(measures.t_two_sided("t", "v")).collect()]
    assert [round(x, 5) for x in got[:4]] == [0.5, 0.05, 0.05, 1.0] and got[4] is None
    b = spark.createDataFrame([(8.0, 10.0), (0.0, 10.0), (10.0, 10.0)], "k double, n double").select(measures.binomial_upper("k", "n")).collect()
    assert [round(r[0], 9) for r in b] == [round(56 / 1024, 9), 1.0, round(1 / 1024, 9)]
