"""Streaming operators run to the end of the given tables (survey section 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time
from ..session import scratch_path, stored
from ..sources import tables
from ..streaming import curves as S
from ..streaming.curves import REVISION_DAYS
from ..streaming.state import keep_revisions, keyed_state, revisions, stream_new_runs
from .base import query


def _stream(t, name: str):
    """One table of the folder as a file stream."""
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _finish(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


_LOCAL = "ts AT TIME ZONE 'UTC' AT TIME ZONE 'CET'"


@query(f"""SELECT event_type, CAST({_LOCAL} AS DATE) AS day, AVG(value / 9.97131) AS value, COUNT(*) AS n_points FROM events
  WHERE CAST({_LOCAL} AS DATE) + 1 <= (SELECT MAX({_LOCAL}) - INTERVAL 2 DAYS FROM events) GROUP BY 1, 2 HAVING COUNT(*) >= 3""", f="value", i="n_points")
def s1_stream_daily_curve(t):
    out = scratch_path(t.spark, "s1")
    e = _stream(t, "events").withColumn("value", F.col("value") / 9.97131)
    days = S.daily_curve(e, ["event_type"], "2 days", ts="ts", min_points=3)
    _finish(days.writeStream.outputMode("append").option("checkpointLocation", out + "-state").format("parquet").option("path", out))
    return t.spark.read.parquet(out)


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders""", f="price")
def s2_stream_upsert(t):
    path = scratch_path(t.spark, "s2")
    tables.replace_table(t.raw("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price")), path, ["year"])
    revised = _stream(t, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_totalprice") * 2).alias("price"))
    q = S.stream_upsert(revised, path, ["o_orderkey", "year"], "year", ["price"], path + "-state").start()
    q.awaitTermination()
    return t.spark.read.parquet(path).select("o_orderkey", "year", "price")


@query("SELECT DISTINCT user_id, event_type FROM events")
def s3_stream_dedupe(t):
    out = scratch_path(t.spark, "s3")
    e = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = S.stream_dedupe(e, ["user_id", "event_type"], "ts", S.revision_delay("indices")).select("user_id", "event_type")
    _finish(d.writeStream.outputMode("append").option("checkpointLocation", out + "-state").format("parquet").option("path", out))
    return t.spark.read.parquet(out)


def _in_turn(t, rows, batch: str, name: str):
    """A stream that brings the rows of each batch number as one micro-batch, in the order of the numbers."""
    rows, src = stored(rows, name), scratch_path(t.spark, name + "-feed")
    for (n,) in sorted(rows.select(batch).distinct().collect()):
        rows.filter(F.col(batch) == n).drop(batch).coalesce(1).write.mode("append").parquet(src)
    return t.spark.readStream.schema(rows.drop(batch).schema).option("maxFilesPerTrigger", 1).parquet(src)


_PIECES = """SELECT run, member, value, CASE WHEN month(run) % 5 = 0 AND member >= 8 THEN 3 ELSE (member + month(run)) % 3 END AS turn FROM (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS run, l_suppkey % 20 AS member, AVG(l_extendedprice / 997.131) AS value FROM lineitem GROUP BY 1, 2)"""


@query(f"""SELECT run, member, value, CASE WHEN run < DATE '1995-01-01' THEN 'stored' WHEN turn <= 2 AND (SELECT COUNT(*) FROM ({_PIECES}) y WHERE y.run = x.run AND turn <= 2) >= 9 THEN 'new' ELSE 'left' END AS origin
  FROM ({_PIECES}) x""", f="value")
def s4_stream_new_runs(t):
    """Runs whose members arrive in four turns: built at nine members, rebuilt by later ones, told apart from what came too late or stayed incomplete."""
    path, start = scratch_path(t.spark, "s4"), F.lit("2000-01-01").cast("timestamp")
    x = t.raw("lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("run"), (F.col("l_suppkey") % 20).alias("member")).agg(
        F.avg(F.col("l_extendedprice") / 997.131).alias("value"))
    x.filter("run < DATE'1995-01-01'").withColumn("origin", F.lit("stored")).write.partitionBy("run").parquet(path)
    last, third = (F.month("run") % 5 == 0) & (F.col("member") >= 8), ((F.col("member") + F.month("run")) % 3).cast("int")
    sent = x.withColumn("turn", F.when(last, 3).otherwise(third))
    again = sent.filter("turn < 2 AND member % 3 = 0").withColumn("turn", F.lit(2))  # a replay
    tick = sent.limit(1).select(F.lit(None).cast("date").alias("run"), F.lit(None).cast("long").alias("member"), F.lit(None).cast("double").alias("value"), F.lit(9).alias("turn"))
    sent = sent.unionByName(again).unionByName(tick)
    sent = sent.withColumn("arrived", start + time.hours(F.col("turn") * 24)).withColumn("due", start + F.expr("INTERVAL 60 HOURS"))
    w = stream_new_runs(_in_turn(t, sent, "turn", "s4-sent"), path, ["run"], "member", [], "arrived", "due", 9, lambda r: r.withColumn("origin", F.lit("new")), path + "-state")
    with keyed_state(t.spark):
        w.start().awaitTermination()
    left = t.spark.read.parquet(path + "__left").select("run", "member", "value", F.lit("left").alias("origin"))
    return t.spark.read.parquet(path).select("run", "member", "value", "origin").unionByName(left)


_SENT = """s AS (SELECT area, day, actual AS value, (year(day) - 1992) // 2 AS turn FROM v_hist),
    r AS (SELECT area, day, value + CASE WHEN dayofyear(day) % 4 = 0 THEN 1 ELSE 0 END AS value, turn + 1 AS turn FROM s WHERE dayofyear(day) % 4 < 2),
    n AS (SELECT area, turn + 1 AS turn, MAX(day) AS newest FROM s GROUP BY 1, 2),
    j AS (SELECT r.*, day < newest - 90 AS late FROM r JOIN n USING (area, turn))"""


@query(f"""WITH {_SENT} SELECT area, day, 'late' AS status, value FROM j WHERE late
  UNION ALL SELECT s.area, s.day, 'held', COALESCE(j.value, s.value) FROM s LEFT JOIN j ON j.area = s.area AND j.day = s.day AND NOT j.late""", f="value", keep="hist")
def s5_stream_revisions(t):
    """A daily feed in five turns that sends old days again: what is in the revision window reaches the table, the rest the side table."""
    path, start = scratch_path(t.spark, "s5"), F.lit("2000-01-01").cast("timestamp")
    s = t.hist().select("area", "day", F.col("actual").alias("value"), F.floor((F.year("day") - 1992) / 2).cast("int").alias("turn"))
    doy = F.dayofyear("day") % 4
    r = s.filter(doy < 2).withColumn("value", F.col("value") + F.when(doy == 0, 1).otherwise(0)).withColumn("turn", F.col("turn") + 1)
    sent = s.unionByName(r).withColumn("year", F.year("day")).withColumn("arrived", start + time.hours(F.col("turn") * 24))
    told = revisions(_in_turn(t, sent, "turn", "s5-sent"), ["area"], "day", ["value"], "arrived", REVISION_DAYS["indices"])
    w = told.writeStream.outputMode("append").foreachBatch(keep_revisions(path, ["area"], "day", "arrived", "year")).option("checkpointLocation", path + "-state")
    with keyed_state(t.spark):
        _finish(w)
    late = t.spark.read.parquet(path + "__late").select("area", "day", "value", F.lit("late").alias("status"))
    return t.spark.read.parquet(path).select("area", "day", "value", F.lit("held").alias("status")).unionByName(late)
