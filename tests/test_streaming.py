from datetime import datetime, timedelta

from pyspark.sql import functions as F

from actloom.streaming import events

T0 = datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    df = spark.createDataFrame([(e, T0 + timedelta(minutes=m), u, kind, 1.0, "{}") for e, m, u, kind in rows], events.EVENTS)
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def test_restart_goes_on_where_it_ended(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    seen = []

    def each(batch, number):
        seen.extend((r["user_id"], r["status"], r["events"]) for r in batch.collect())

    write(spark, folder, "a", [(1, 0, 7, "view"), (2, 5, 7, "click"), (3, 1, 8, "view")])
    run = lambda: events.run_to_end(events.latest_status(events.read_events(spark, f"{folder}/*")), checkpoint, "update", each)
    run()
    assert sorted(seen) == [(7, "click", 2), (8, "view", 1)]
    seen.clear()
    write(spark, folder, "b", [(4, 3, 7, "late"), (5, 9, 8, "error"), (6, 9, 9, None)])
    run()
    assert sorted(seen, key=str) == [(7, "click", 3), (8, "error", 2), (9, None, 1)]
    seen.clear()
    run()
    assert seen == []


def test_repeated_deliveries_count_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [(1, 0, 7, "view"), (1, 0, 7, "view"), (2, 1, 7, "view")])
    write(spark, folder, "b", [(1, 0, 7, "view"), (3, 70, 7, "view")])
    seen = []
    stream = events.deduplicated(events.read_events(spark, f"{folder}/*"))
    events.run_to_end(stream, str(tmp_path / "c"), "append", lambda b, n: seen.extend(r[0] for r in b.select("event_id").collect()))
    assert sorted(seen) == [1, 2, 3]


def test_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [(1, 0, 7, "view"), (2, 59, 7, "view"), (3, 60, 7, "view"), (4, 1, 7, "click")])
    seen = {}
    stream = events.windowed(events.read_events(spark, f"{folder}/*"))
    events.run_to_end(stream, str(tmp_path / "c"), "complete", lambda b, n: seen.update({(r["h"], r["event_type"]): r["n"] for r in b.withColumn("h", F.hour("window_start")).collect()}))
    assert seen == {(0, "view"): 2, (1, "view"): 1, (0, "click"): 1}
