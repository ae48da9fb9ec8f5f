"""Streams over batches that come late and out of order."""

import datetime

from pyspark.sql import functions as F

from marlstone.streaming import events as E

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def stream(spark, folder, batches, schema):
    """Each batch is a file, and the files come one by one in their order."""
    import os

    for n, rows in enumerate(batches):
        part = f"{folder}/part{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{part}/{name}", f"{folder}/in/b{n}.parquet")
        os.utime(f"{folder}/in/b{n}.parquet", (n + 1, n + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_sliding_windows_leave_late_rows_out(spark, tmp_path):
    rows = [[(1, at(0), "a", 1.0), (2, at(70), "a", 2.0)], [(3, at(400), "a", 4.0)], [(6, at(410), "b", 0.0)], [(4, at(5), "a", 8.0)], [(5, at(900), "a", 16.0)]]
    out = E.run_once(E.windowed(stream(spark, str(tmp_path), rows, "event_id long, ts timestamp, event_type string, value double"), "1 hour", "30 minutes", "2 hours"), "append")
    got = {r.since: r.total for r in out.where("event_type = 'a'").collect()}
    assert got == {at(-30): 1.0, at(0): 1.0, at(30): 2.0, at(60): 2.0, at(360): 4.0, at(390): 4.0}


def test_latest_event_decides_in_any_order(spark, tmp_path):
    schema = "job_id long, step string, ts timestamp, event_id long"
    rows = [
        [(1, "scored", at(50), 1), (2, "started", at(5), 9), (2, "created", at(5), 2), (3, "converted", at(5), 1), (4, "started", at(9), 1), (5, "started", at(0), 1)],
        [(1, "created", at(10), 2), (2, "scored", at(5), 3), (3, "created", at(5), 2), (4, "finished", at(1), 2), (5, "created", None, 2), (5, "scored", at(90), 3)],
        [(1, "started", at(1), 3), (2, "created", at(4), 99), (4, "created", at(99), 3)],
    ]
    # and one job whose rows fill several pieces of a batch, the latest first
    long = [(6, "created" if i == 3 else "started", at(1000 - abs(i - 3)), i) for i in range(4)] + [(6, "started", at(i % 900), 10 + i) for i in range(25_000)]
    out = E.run_once(E.lifecycle(stream(spark, str(tmp_path), [[*rows[0], *long], *rows[1:]], schema), None, tie="event_id"), "update")
    last = {r.job_id: (r.n, r.s.status, r.s.progress) for r in out.groupBy("job_id").agg(F.max("n").alias("n"), F.max_by(F.struct("status", "progress"), "n").alias("s")).collect()}
    assert last == {1: (3, "processing", 85), 2: (4, "processing", 5), 3: (2, "pending", 0), 4: (3, "succeeded", 100), 5: (3, "pending", 0), 6: (25_004, "pending", 0)}


def test_silent_jobs_fail_and_stay_so(spark, tmp_path):
    rows = [[(1, "created", at(0)), (2, "created", at(0))], [(2, "started", at(30)), (3, "created", at(300))], [(4, "created", at(310))], [(1, "started", at(305)), (5, "created", at(320))]]
    out = E.run_once(E.lifecycle(stream(spark, str(tmp_path), rows, "job_id long, step string, ts timestamp")), "update")
    last = {r.job_id: r.status for r in out.groupBy("job_id").agg(F.max_by("status", F.struct("batch", "n")).alias("status")).collect()}
    assert last[1] == "failed" and last[2] == "failed" and last[5] == "pending"


def test_admissions_keep_the_active_jobs(spark, tmp_path):
    row = lambda who, job, step, m: (who, who != "g", job, step, at(m))
    rows = [[row("u", 1, "created", 0), row("u", 2, "created", 1), row("u", 3, "created", 2), row("u", 4, "created", 3), row("g", 9, "created", 0), row("g", 10, "created", 1)], [row("u", 1, "finished", 5), row("u", 5, "created", 5), row("g", 9, "failed", 5), row("g", 11, "created", 6)]]
    out = E.run_once(E.admissions(stream(spark, str(tmp_path), rows, "requester string, is_user boolean, job_id long, step string, ts timestamp")), "append")
    assert {r.job_id: r.admitted for r in out.collect()} == {1: True, 2: True, 3: True, 4: False, 9: True, 10: False, 5: True, 11: True}
