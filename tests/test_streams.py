"""Streams with keyed state, fed in several micro-batches and restarted in between."""

import datetime as dt

from pyspark.sql import functions as F

from gridwatt.session import scratch_path
from gridwatt.sources import tables
from gridwatt.streaming import state as S

PIECE = "run int, member int, part int, v double, arrived timestamp, due timestamp"


def at(day, hour=0):
    return dt.datetime(2026, 1, 1 + day, hour)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def feeder(spark, schema, start):
    """Appends rows to a folder and runs the stream over what is new, from its checkpoint."""
    src = scratch_path(spark, "feed")

    def feed(*sent):
        spark.createDataFrame(sent, schema).coalesce(1).write.mode("append").parquet(src)
        with S.keyed_state(spark):
            start(spark.readStream.schema(schema).parquet(src)).start().awaitTermination()
    return feed


def test_runs_are_built_from_pieces_once_enough_members_came(spark):
    path = scratch_path(spark, "runs")
    spark.createDataFrame([(9, -1.0, 0)], "run int, v double, n long").write.partitionBy("run").parquet(path)  # loaded by somebody else
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    build = lambda x: x.groupBy("run").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    feed = feeder(spark, PIECE, lambda s: S.stream_new_runs(s, path, ["run"], "member", ["part"], "arrived", "due", 3, build, path + "-state"))
    row = lambda run, member, v, day, part=0, due=4, hour=0: (run, member, part, v, at(day, hour), at(due))
    table = lambda: rows(spark.read.parquet(path), "run", "v", "n")
    left = lambda: rows(spark.read.parquet(path + "__left"), "run", "member", "v", "status")

    feed(row(1, 0, 1.0, 0), row(1, 0, 0.5, 0), row(1, 1, 2.0, 0), row(2, 0, 5.0, 0), *[row(9, m, 1.0, 0) for m in range(5)])
    assert table() == [(9, -1.0, 0)] and left() == []                         # two members; the other run was there before
    feed(row(1, 2, 4.0, 1), row(3, 0, 1.0, 1, due=20))
    assert table() == [(1, 7.5, 4), (9, -1.0, 0)]
    feed(row(1, 2, 4.0, 2), row(1, 0, 3.0, 2, part=1))                        # a replay, and a further piece of a member
    assert table() == [(1, 10.5, 5), (9, -1.0, 0)]
    feed(row(1, 1, 20.0, 3), row(1, 3, 8.0, 3))                               # a piece that was corrected, and a late member
    assert table() == [(1, 36.5, 6), (9, -1.0, 0)]
    feed(row(1, 4, 64.0, 5), row(2, 1, 7.0, 5))                               # past the runs' time
    assert table() == [(1, 36.5, 6), (9, -1.0, 0)] and left() == [(1, 4, 64.0, "late"), (2, 0, 5.0, "expired"), (2, 1, 7.0, "late")]
    feed(*[row(1, m, 1.0, 6) for m in range(3)])                              # a whole run again, too late: the table stays
    assert table() == [(1, 36.5, 6), (9, -1.0, 0)]
    feed(row(3, 1, 1.0, 7, due=20), row(3, 2, 1.0, 7, due=20))                # a run that has waited all the time
    assert table() == [(1, 36.5, 6), (3, 3.0, 3), (9, -1.0, 0)]
    feed((None, None, None, None, at(25), at(25)))                            # moves time on, builds nothing
    assert table() == [(1, 36.5, 6), (3, 3.0, 3), (9, -1.0, 0)] and len(left()) == 6
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_state_holds_runs_that_are_due_and_no_others(spark):
    path = scratch_path(spark, "bounded")
    feed = feeder(spark, PIECE, lambda s: S.stream_new_runs(s, path, ["run"], "member", ["part"], "arrived", "due", 2, lambda x: x.select("run", "v"), path + "-state"))
    held = lambda: spark.read.format("statestore").option("stateVarName", "pieces").load(path + "-state").count()
    sizes = []
    for day in range(0, 20, 4):
        feed(*[(10 * day + k, m, 0, 1.0, at(day), at(day + 2)) for k in range(3) for m in range(1 + k % 2)])
        with S.keyed_state(spark):
            sizes.append(held())
    assert max(sizes) <= 4 and spark.read.parquet(path).count() == 10
    assert spark.read.parquet(path + "__batch").count() <= 8                 # what a batch told, not what all batches told


def test_revisions_reach_the_table_and_late_rows_the_side_table(spark):
    path, start = scratch_path(spark, "revised"), dt.date(2026, 1, 1)
    schema = "area string, day date, v double, n int, arrived timestamp, y int"
    day = lambda i: start + dt.timedelta(days=i)

    def stream(s):
        told = S.revisions(s, ["area"], "day", ["v", "n"], "arrived", 5)
        return told.writeStream.foreachBatch(S.keep_revisions(path, ["area"], "day", "arrived", "y")).option("checkpointLocation", path + "-state").trigger(availableNow=True)

    feed = feeder(spark, schema, stream)
    row = lambda area, i, v, turn, n=0: (area, day(i), v, n, at(turn), 2026)
    table, late = lambda: rows(spark.read.parquet(path), "area", "day", "v"), lambda: rows(spark.read.parquet(path + "__late"), "area", "day", "v")
    feed(row("a", 0, 1.0, 0), row("a", 0, 2.0, 1), row("a", 10, 3.0, 0), (None, day(1), 9.0, 0, at(0), 2026), ("a", None, 1.0, 0, at(0), 2026))
    assert table() == [("a", day(0), 2.0), ("a", day(10), 3.0), (None, day(1), 9.0)] and late() == []     # the last to arrive counts
    feed(row("a", 4, 5.0, 2), row("a", 5, 6.0, 2), row("a", 10, 3.0, 2), row("b", 0, 7.0, 2), (None, day(1), None, 0, at(2), 2026))
    assert table() == [("a", day(0), 2.0), ("a", day(10), 3.0), ("a", day(5), 6.0), ("b", day(0), 7.0), (None, day(1), None)] and late() == [("a", day(4), 5.0)]
    feed(row("a", 20, 1.0, 3), row("a", 6, 8.0, 3))
    feed(row("a", 6, 9.0, 4), row("a", 14, 9.0, 4), row("a", 15, 9.0, 4))
    assert late() == [("a", day(14), 9.0), ("a", day(4), 5.0), ("a", day(6), 9.0)] and ("a", day(6), 8.0) in table() and ("a", day(15), 9.0) in table()
    with S.keyed_state(spark):
        held = {r["key"]["area"]: 0 for r in spark.read.format("statestore").option("stateVarName", "newest").load(path + "-state").collect()}
        for r in spark.read.format("statestore").option("stateVarName", "held").load(path + "-state").collect():
            held[r["key"]["area"]] += 1
    assert held == {"a": 2, "b": 1, None: 1}


def test_every_row_sent_has_one_status(spark):
    schema = "area string, day date, v double, arrived timestamp"
    src, out = scratch_path(spark, "status"), scratch_path(spark, "status-out")
    day = lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=i)
    for turn in range(4):
        sent = [("ab"[i % 2], day(6 * turn + i - 9), float(i % 3 * turn), at(turn, i % 5)) for i in range(17)]
        spark.createDataFrame(sent, schema).coalesce(1).write.mode("append").parquet(src)
    told = S.revisions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), ["area"], "day", ["v"], "arrived", 8)
    with S.keyed_state(spark):
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got.drop("status"), "area", "day", "v", "arrived") == rows(spark.read.parquet(src), "area", "day", "v", "arrived")
    assert {r["status"] for r in got.select("status").collect()} == {"new", "revised", "same", "late"}
    assert tables.read_if_there(spark, out + "-nothing") is None
