"""Readers of the file formats the feeds deliver, and of the fitted curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import finite
from ..functions import names

def parse_day(text: Column) -> Column:
    """ISO or US date; NULL when neither reads."""
    t = F.trim(text)
    return F.coalesce(F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))),
                      F.to_date(F.try_to_timestamp(t, F.lit("M/d/yyyy"))))


def wide_indices_to_long(wide: DataFrame, date_col: str = "Date", start_year: int = 1979, source: str = "file") -> DataFrame:
    """One column per index to one row per (index, date); unreadable and infinite values go."""
    cols = [c for c in wide.columns if c != date_col]
    d = wide.select(parse_day(F.col(date_col).cast("string")).alias("date"),
                    *[finite(F.col(f"`{c}`").try_cast("double")).alias(names.index_name(c)) for c in cols])
    d = d.filter(F.year("date") >= start_year)
    return (d.unpivot("date", [names.index_name(c) for c in cols], "index_name", "value")
            .filter("value IS NOT NULL").select("index_name", "date", "value", F.lit(source).alias("source")))


def read_wide_indices(spark: SparkSession, path: str, start_year: int = 1979, source: str = "file") -> DataFrame:
    return wide_indices_to_long(spark.read.csv(path, header=True, nullValue="M"), "Date", start_year, source)


_MODEL = ("struct<structure:string,k_cold:double,k_hot:double,names:array<string>,coef:array<double>,"
          "bias_correction:double,half_life_days:double>")


def curve_models(json_text: DataFrame, column: str = "value") -> DataFrame:
    """A JSON map of fitted curves to one row per (series, country), coefficients as columns."""
    m = json_text.select(F.explode(F.from_json(column, f"map<string,{_MODEL}>")).alias("key", "m"))
    pairs = F.map_from_arrays("m.names", "m.coef")

    def coef(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("pairs"), F.lit(name)), F.lit(0.0)).alias(f"b_{name.lower()}")

    m = m.withColumn("pairs", pairs)
    return m.select(F.substring_index("key", "_", 1).alias("series"),
                    F.expr("substring(key, instr(key, '_') + 1)").alias("country"), "m.structure", "m.k_cold", "m.k_hot",
                    *[coef(c) for c in ("intercept", "is_sat", "is_sun", "is_holiday", "T", "cold", "hot")],
                    F.coalesce("m.bias_correction", F.lit(0.0)).alias("bias"),
                    F.coalesce("m.half_life_days", F.lit(0.0)).alias("half_life_days"))


def read_curve_models(spark: SparkSession, path: str) -> DataFrame:
    return curve_models(spark.read.text(path, wholetext=True))


def grid_matrix_to_rows(cubes: DataFrame, name: str, flat: str, n_lon: int, lat0: float, dlat: float,
                        lon0: float, dlon: float) -> DataFrame:
    """A flattened (latitude, longitude) array per pattern to one row per grid point, times cos(latitude)."""
    p = cubes.select(name, F.posexplode(flat).alias("pos", "w"))
    lat = F.lit(lat0) + F.floor(F.col("pos") / n_lon) * dlat
    return p.select(name, lat.alias("latitude"), (F.lit(lon0) + (F.col("pos") % n_lon) * dlon).alias("longitude"),
                    (F.col("w").cast("double") * F.cos(F.radians(lat))).alias("weight"))


def block_sum_weights(fine: DataFrame, res: float = 0.5, min_persons: float = 0.5) -> DataFrame:
    """Persons per fine cell to the coarse grid (cell centres on multiples of ``res``)."""
    def cell(c: str) -> Column:
        return (F.floor(F.col(c) / res + 0.5) * res).alias(c)
    return (fine.groupBy("area", cell("latitude"), cell("longitude")).agg(F.sum("persons").alias("persons"))
            .filter(F.col("persons") > min_persons)
            .select("area", "latitude", "longitude", F.bround("persons").cast("bigint").alias("population")))


def explode_scenarios(series: DataFrame, keys: Sequence[str], names_col: str = "names", values_col: str = "values",
                      mean_col: str | None = "mean", offset: int = 0) -> DataFrame:
    """Array of member values per day to (key, member, value) rows; the mean keeps member NULL."""
    pairs = F.transform(F.arrays_zip(F.col(names_col).alias("n"), F.col(values_col).alias("v")), lambda z: F.struct(
        (names.member_id(z["n"]) + offset).alias("member"), z["v"].cast("double").alias("value"), F.lit(False).alias("mean")))
    if mean_col is not None:
        mean = F.struct(F.lit(None).cast("int").alias("member"), F.col(mean_col).cast("double").alias("value"), F.lit(True).alias("mean"))
        pairs = F.concat(pairs, F.array(mean))
    rows = series.select(*keys, F.inline(pairs))
    return rows.filter("value IS NOT NULL AND (mean OR member IS NOT NULL)").drop("mean")


def station_dimension(curves: DataFrame, coordinates: DataFrame, name: str = "curve_name") -> DataFrame:
    """Stations read off curve names, with coordinates where the gauge is placed and the kinds of series held."""
    slug = names.word(F.col(name), 2)
    part = names.station_parts(slug)
    s = curves.select(F.upper(names.word(F.col(name), 1)).alias("area"), slug.alias("slug"),
                      *[c.alias(k) for k, c in part.items()],
                      names.curve_kind(F.col(name)).alias("kind"))
    g = s.groupBy("area", "slug", "station", "river", "site").agg(
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("data_types"))     # at most three kinds
    return g.join(coordinates, "slug", "left").withColumn("station_key", F.concat_ws("-", F.lower("area"), "slug"))
