"""Registry of queries and the SQL form of the input views."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..common import round_doubles
from ..session import prepare
from ..sources.views import LABELS, PATTERNS, REGIMES, Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ["tables", "scalars", "joins", "aggregates", "windows", "picks", "regimes", "scenarios", "compare",
            "demand", "hydro", "tele", "streams"]


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


SQL_VIEWS = {
    "v_na": """SELECT n_nationkey, n_name AS area, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_weights": """SELECT area, region, 35.0 + 4.0 * ((c_custkey % 64) // 8) AS latitude,
            -15.0 + 6.0 * ((c_custkey % 64) % 8) AS longitude, COUNT(*) AS population
        FROM customer JOIN v_na ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4""",
    "v_region": """SELECT area, region FROM v_na UNION ALL SELECT area, 'SHARED' FROM v_na WHERE n_nationkey % 5 = 0""",
    "v_station": """SELECT s_suppkey AS station_key, s_name AS station, area,
            CAST(36 + s_suppkey % 30 AS DOUBLE) AS latitude, CAST(-10 + s_suppkey % 37 AS DOUBLE) AS longitude
        FROM supplier JOIN v_na ON s_nationkey = n_nationkey""",
    "v_obs": """SELECT event_type AS curve, area, region, ts, value / 9.97131 AS value, user_id
        FROM events JOIN v_na ON user_id % 25 = n_nationkey""",
    "v_oa": """SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN v_na ON c_nationkey = n_nationkey""",
    "v_lines": """SELECT * FROM lineitem JOIN v_oa ON l_orderkey = o_orderkey""",
    "v_hist": """SELECT region AS area, CAST(o_orderdate AS DATE) AS day, SUM(o_totalprice) / 99713.1 AS actual
        FROM v_oa GROUP BY 1, 2""",
    "v_load": """SELECT area, day, actual AS load, 12.0 + cos((dayofyear(day) - 200) * 0.0172024) * 10
            + (day(day) % 5 + length(area) % 3) * 1.01 AS temp FROM v_hist""",
    "v_member": """SELECT *, reference_date + CAST(lead_day AS INTEGER) AS day FROM (
            SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS reference_date, region AS area,
              l_linenumber - 1 AS lead_day, CAST(l_suppkey % 20 AS INTEGER) AS member,
              AVG(l_extendedprice) / 997.131 AS value, COUNT(*) AS n_points
            FROM v_lines GROUP BY 1, 2, 3, 4)""",
    "v_morning": f"""SELECT family, region, pattern, reference_date,
            CAST(reference_date AS TIMESTAMP) + CASE WHEN pattern LIKE '%12%' THEN INTERVAL 12 HOURS ELSE INTERVAL 0 HOURS END AS init_time,
            reference_date + lead AS day, value, n_points FROM (
            SELECT CASE WHEN o_orderstatus = 'F' THEN 'tt' ELSE 'wnd' END AS family, region,
              {_list(PATTERNS)}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS pattern,
              CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_custkey % 2 AS INTEGER) AS reference_date,
              CAST(l_linenumber - 1 + (l_suppkey % 2) * 7 AS INTEGER) AS lead,
              AVG(l_extendedprice) / 997.131 AS value, COUNT(*) AS n_points
            FROM v_lines GROUP BY 1, 2, 3, 4, 5)""",
    "v_river": """SELECT l_suppkey AS station_key,
            CASE l_returnflag WHEN 'A' THEN 'actual' WHEN 'R' THEN 'backcast' ELSE 'forecast' END AS data_type,
            CAST(l_shipdate AS DATE) AS day,
            CASE WHEN l_returnflag NOT IN ('A', 'R') THEN CAST(date_trunc('month', l_shipdate) AS DATE) END AS issued,
            AVG(l_quantity) / 1.97131 AS value
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "v_grid": """SELECT vec_id // 100 AS run, DATE '2024-01-03' + CAST(7 * (vec_id // 100) AS INTEGER) AS reference_date,
            DATE '2024-01-03' + CAST(7 * (vec_id // 100) + (vec_id // 10) % 10 AS INTEGER) AS day,
            CAST((vec_id // 10) % 10 AS INTEGER) AS lead_day, CAST(vec_id % 10 AS INTEGER) AS member,
            35.0 + 4.0 * (pos // 8) AS latitude, -15.0 + 6.0 * (pos % 8) AS longitude,
            CAST(embedding[pos + 1] AS DOUBLE) * 300.3 AS value, label
        FROM (SELECT *, unnest(range(len(embedding))) AS pos FROM embeddings)""",
    "v_index": """SELECT 'IDX_' || o_orderstatus AS index_name, CAST(o_orderdate AS DATE) AS day,
            AVG(o_totalprice) / 99713.1 AS value FROM orders GROUP BY 1, 2""",
    "v_regday": f"""SELECT area, day, {_list(LABELS)}[1 + CASE WHEN n % 5 = 0 THEN (base + 1) % 8 ELSE base END] AS regime FROM (
            SELECT area, day, n, ((day - DATE '1992-01-01') // 9 * 5 + (day - DATE '1992-01-01') // 9 // 3 + length(area)) % 8 AS base FROM (
            SELECT region AS area, CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM v_oa GROUP BY 1, 2))""",
    "v_hydro": """SELECT area, day, actual + cos(dayofyear(day) * 0.0172) * 5 + 40 AS value FROM v_hist""",
    "v_cell": "SELECT 35.0 + 4.0 * (pos // 8) AS latitude, -15.0 + 6.0 * (pos % 8) AS longitude "
              "FROM (SELECT unnest(range(64)) AS pos)",
    "v_pattern": "SELECT latitude, longitude, regime, k, cos(radians(latitude * (k + 1) + longitude * (k + 2))) AS w "
                 f"FROM v_cell, (SELECT unnest({_list(REGIMES)}) AS regime, unnest(range(7)) AS k)",
    "v_gclim": "SELECT latitude, longitude, dayofyear(day) - CASE WHEN month(day) > 2 AND dayofyear(make_date(year(day), 12, 31)) = 366 "
               "THEN 1 ELSE 0 END AS doy, AVG(value) AS normal, COUNT(*) AS n_years FROM v_grid GROUP BY 1, 2, 3",
    "v_raw": """SELECT run, reference_date, g.day, lead_day, member, regime, k,
            SUM((value - normal) / (1.0 + month(g.day) * 0.1 + day(g.day) * 0.001) * w * cos(radians(g.latitude)))
              / (SELECT SUM(cos(radians(latitude))) FROM v_cell) AS raw
        FROM v_grid g JOIN v_pattern p ON p.latitude = g.latitude AND p.longitude = g.longitude
        JOIN v_gclim c ON c.latitude = g.latitude AND c.longitude = g.longitude
          AND c.doy = dayofyear(g.day) - CASE WHEN month(g.day) > 2 AND dayofyear(make_date(year(g.day), 12, 31)) = 366 THEN 1 ELSE 0 END
        GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "v_iwr": "SELECT run, reference_date, day, lead_day, member, regime, k, (raw - 0.02 * k) / (1.5 + 0.1 * k) AS iwr FROM v_raw",
    "v_wr": """SELECT run, reference_date, day, lead_day, member, MAX(iwr) AS max_iwr,
            1.0 + lead_day * -0.018774217528098960 AS threshold,
            CASE WHEN MAX(iwr) >= 1.0 + lead_day * -0.018774217528098960 THEN arg_max(regime, iwr) ELSE 'no' END AS regime
        FROM v_iwr GROUP BY 1, 2, 3, 4, 5""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a statement with the views it mentions, dependencies first."""
    views = {**SQL_VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in views and name not in order:
                visit(views[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + body


def finish_sql(body: str, f: str = "", i: str = "", digits: int = 6) -> str:
    """Round the float columns ``f`` and widen the integer columns ``i`` of a statement."""
    parts = [f"ROUND(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in f.split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
    if not parts:
        return f"SELECT * FROM (\n{body}\n)" if body.lstrip().upper().startswith("WITH") else body
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{body}\n)"


def query(sql: str | None = None, f: str = "", i: str = "", digits: int = 6,
          views: dict[str, str] | None = None, keep: str = ""):
    """Register a plan under its function name.

    ``f``/``i`` name float and integer result columns; ``keep`` the daily views the plan reads
    more than once.
    """
    def wrap(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return round_doubles(fn(Tables(prepare(spark), folder, keep.split())), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = with_views(finish_sql(sql, f, i, digits), views)
        return fn
    return wrap


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"gridwatt.queries.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
