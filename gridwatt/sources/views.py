"""Domain tables seen in the generic star schema the data folder holds.

Each function reads only the columns it needs and returns a lazy DataFrame in the
layout the operators expect. The divisors bring amounts to display size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import require
from ..functions import time
from ..session import stored

N_MEMBERS, N_LEADS, N_POINTS = 10, 10, 64
PATTERNS = ["ec00ens", "ec12ens", "gfs00ens", "ec00", "gfs00"]
REGIMES = ["ScTr", "GL", "EuBl", "AR", "AT", "ScBl", "ZO"]
LABELS = [*REGIMES, "no"]


class Tables:
    """The tables of one data folder.

    ``keep`` names daily views that the caller reads several times: they are computed once,
    written to the shared folder and read from there, as the scheduled refresh of such tables
    would do. Views read once stay part of the caller's plan.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: Sequence[str] = ()):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name in keep:
            setattr(self, name, self._kept(name))

    def _kept(self, name: str):
        build, found = getattr(self, name), []

        def view() -> DataFrame:
            if not found:
                found.append(stored(build(), name))
            return found[0]

        return view

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- dimensions --------------------------------------------------------
    def nation_area(self) -> DataFrame:
        """(nation key, nation as area, region as area group)."""
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("area"), F.col("r_name").alias("region"))

    def weights(self) -> DataFrame:
        """(area, latitude, longitude, population)."""
        pos = F.col("c_custkey") % N_POINTS
        return (self.raw("customer").join(self.nation_area(), F.col("c_nationkey") == F.col("n_nationkey"))
                .groupBy("area", "region", *_point(pos)).agg(F.count("*").alias("population")))

    def region_map(self) -> DataFrame:
        """(area, region); every fifth nation belongs to a second, shared region."""
        m = self.nation_area()
        both = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.col("region"), F.lit("SHARED"))).otherwise(
            F.array(F.col("region")))
        return m.select("area", F.explode(both).alias("region"))

    def stations(self) -> DataFrame:
        """(station_key, station, area, latitude, longitude)."""
        s = self.raw("supplier").join(self.nation_area(), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(F.col("s_suppkey").alias("station_key"), F.col("s_name").alias("station"), "area",
                        (F.lit(36) + F.col("s_suppkey") % 30).cast("double").alias("latitude"),
                        (F.lit(-10) + F.col("s_suppkey") % 37).cast("double").alias("longitude"))

    # -- facts -------------------------------------------------------------
    def obs(self) -> DataFrame:
        """Sub-daily curve points: (curve, area, ts, value)."""
        e = self.raw("events").select("event_type", "user_id", "ts", "value")
        return e.join(self.nation_area(), (F.col("user_id") % 25) == F.col("n_nationkey")).select(
            F.col("event_type").alias("curve"), "area", "region", F.col("ts").cast("timestamp").alias("ts"),
            (F.col("value") / 9.97131).alias("value"), "user_id")

    def _orders_area(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice",
                                      "o_orderstatus", "o_orderpriority")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
                .join(self.nation_area(), F.col("c_nationkey") == F.col("n_nationkey")))

    def _lines(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
        return li.join(self._orders_area(), F.col("l_orderkey") == F.col("o_orderkey"))

    def hist(self) -> DataFrame:
        """Daily history: (area, day, actual), an area being a region of the schema."""
        return (self._orders_area().groupBy(F.col("region").alias("area"), F.to_date("o_orderdate").alias("day"))
                .agg((F.sum("o_totalprice") / 99713.1).alias("actual")))

    def load(self) -> DataFrame:
        """Daily load and temperature: (area, day, load, temp)."""
        temp = (F.lit(12.0) + F.cos((F.dayofyear("day") - 200) * 0.0172024) * 10
                + (F.dayofmonth("day") % 5 + F.length("area") % 3) * 1.01)
        return self.hist().select("area", "day", F.col("actual").alias("load"), temp.alias("temp"))

    def member(self) -> DataFrame:
        """Ensemble members: (reference_date, area, lead_day, day, member, value, n_points)."""
        ref = F.to_date(F.date_trunc("quarter", "o_orderdate"))
        return (self._lines().groupBy(ref.alias("reference_date"), F.col("region").alias("area"),
                                      (F.col("l_linenumber") - 1).alias("lead_day"),
                                      (F.col("l_suppkey") % 20).cast("int").alias("member"))
                .agg((F.avg("l_extendedprice") / 997.131).alias("value"), F.count("*").alias("n_points"))
                .withColumn("day", F.expr("date_add(reference_date, lead_day)")))

    def morning(self) -> DataFrame:
        """Run values: (family, region, pattern, reference_date, init_time, day, value, n_points)."""
        ref = F.date_add(F.to_date(F.date_trunc("month", "o_orderdate")), (F.col("o_custkey") % 2).cast("int"))
        lead = (F.col("l_linenumber") - 1 + (F.col("l_suppkey") % 2) * 7).cast("int")
        code = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        pattern = F.get(F.array(*[F.lit(p) for p in PATTERNS]), code)
        family = F.when(F.col("o_orderstatus") == "F", "tt").otherwise("wnd")
        g = (self._lines()
             .groupBy(family.alias("family"), "region", pattern.alias("pattern"), ref.alias("reference_date"),
                      lead.alias("lead"))
             .agg((F.avg("l_extendedprice") / 997.131).alias("value"), F.count("*").alias("n_points")))
        return g.select("family", "region", "pattern", "reference_date",
                        (F.col("reference_date").cast("timestamp")
                         + time.hours(time.pattern_init_hour(F.col("pattern")))).alias("init_time"),
                        F.expr("date_add(reference_date, lead)").alias("day"), "value", "n_points")

    def river(self) -> DataFrame:
        """Station rows: (station_key, data_type, day, value, issued, tag)."""
        kind = (F.when(F.col("l_returnflag") == "A", "actual").when(F.col("l_returnflag") == "R", "backcast")
                .otherwise("forecast"))
        li = self.raw("lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_quantity")
        day = F.to_date("l_shipdate")
        issued = F.when(kind == "forecast", F.to_date(F.date_trunc("month", "l_shipdate")))
        return (li.groupBy(F.col("l_suppkey").alias("station_key"), kind.alias("data_type"), day.alias("day"),
                           issued.alias("issued"))
                .agg((F.avg("l_quantity") / 1.97131).alias("value")))

    def grid(self) -> DataFrame:
        """Gridded member field: (run, reference_date, day, lead_day, member, latitude, longitude, value, label)."""
        e = require(self.raw("embeddings"), "vec_id", "embedding")
        ref = F.expr("date_add(DATE'2024-01-03', CAST(7 * (vec_id DIV 100) AS INT))")
        x = e.select("vec_id", "label", ref.alias("reference_date"), F.posexplode("embedding").alias("pos", "x"))
        lead = F.expr("CAST((vec_id DIV 10) % 10 AS INT)")
        return x.select(
            F.expr("vec_id DIV 100").alias("run"), "reference_date",
            F.date_add("reference_date", lead).alias("day"), lead.alias("lead_day"),
            (F.col("vec_id") % N_MEMBERS).cast("int").alias("member"), *_point(F.col("pos")),
            (F.col("x").cast("double") * 300.3).alias("value"), "label")

    def index_daily(self) -> DataFrame:
        """Daily index panel: (index_name, day, value)."""
        o = self.raw("orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
        return (o.groupBy(F.concat(F.lit("IDX_"), "o_orderstatus").alias("index_name"),
                          F.to_date("o_orderdate").alias("day"))
                .agg((F.avg("o_totalprice") / 99713.1).alias("value")))

    def regime_days(self) -> DataFrame:
        """Classified days: (area, day, regime), an area being a region of the schema."""
        d = self._orders_area().groupBy(F.col("region").alias("area"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
        block = F.floor(F.datediff("day", F.lit("1992-01-01").cast("date")) / 9)
        base = (block * 5 + F.floor(block / 3) + F.length("area")) % 8
        code = F.when(F.col("n") % 5 == 0, (base + 1) % 8).otherwise(base)
        return d.select("area", "day", F.get(F.array(*[F.lit(x) for x in LABELS]), code.cast("int")).alias("regime"))

    def hydro(self) -> DataFrame:
        """Hydro state: (area, day, data_type SA / N, value)."""
        h = self.hist().withColumn("value", F.col("actual") + F.cos(F.dayofyear("day") * 0.0172) * 5 + 40)
        return h.select("area", "day", "value")


def _point(pos) -> list:
    """Latitude and longitude of one of the 8 x 8 grid points."""
    return [(F.lit(35.0) + F.floor(pos / 8) * 4.0).alias("latitude"),
            (F.lit(-15.0) + (pos % 8) * 6.0).alias("longitude")]


def patterns(spark: SparkSession) -> DataFrame:
    """A rule-made set of seven regime patterns on the 8 x 8 grid: (latitude, longitude, w_*)."""
    p = spark.range(N_POINTS).select(*_point(F.col("id")))
    lat, lon = F.col("latitude"), F.col("longitude")
    return p.select("latitude", "longitude", *[
        F.cos(F.radians(lat * (k + 1) + lon * (k + 2))).alias(f"w_{r}") for k, r in enumerate(REGIMES)])


def projection_norm(spark: SparkSession) -> DataFrame:
    """(regime, proj_avg, denom) of the rule-made patterns."""
    return spark.createDataFrame([(r, 0.02 * k, 1.5 + 0.1 * k) for k, r in enumerate(REGIMES)],
                                 "regime string, proj_avg double, denom double")


def amplitude(spark: SparkSession) -> DataFrame:
    """(month, day_of_month, amplitude)."""
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS d")
    return days.select(F.month("d").alias("month"), F.dayofmonth("d").alias("day_of_month"),
                       (F.lit(1.0) + F.month("d") * 0.1 + F.dayofmonth("d") * 0.001).alias("amplitude"))


__all__ = ["Tables", "amplitude", "patterns", "projection_norm"]
