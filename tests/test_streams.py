"""Stateful streams: state that goes when idle, runs that go on from their checkpoint, late rows as they pass."""

from gradeflow.operators import actions
from gradeflow.scratch import shared_folder
from gradeflow.streaming import jobs

FRAMES = "video_id string, timestamp double"


def deliver(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in.parquet")
    return jobs.read_stream(spark, folder, "in.parquet")


def states(spark, path):
    rows = spark.read.format("statestore").option("stateVarName", "last").load(f"{path}/state").select("key.video_id", "value.last").collect()
    return {r["video_id"]: r["last"] for r in rows}


def test_state_goes_when_idle_and_a_restart_goes_on(spark):
    folder, path = shared_folder(spark, "in"), shared_folder(spark, "frames")
    first = [("a", t / 2) for t in range(20)] + [("b", 3.0), ("b", 3.5), (None, 1.0), ("a", None)]
    for rows in (first, [("a", 10.2), ("a", 9.9), ("b", 8.0)]):
        found = jobs.run(jobs.sample_frames(deliver(spark, folder, rows, FRAMES), 1.0, idle_seconds=60.0), "frames", path)
    # the second run knew the last kept times of the first: 9.0 of a, 3.0 of b
    assert sorted(r["timestamp"] for r in found.filter("video_id = 'a'").collect()) == [*map(float, range(10)), 10.2]
    assert sorted(r["timestamp"] for r in found.filter("video_id = 'b'").collect()) == [3.0, 8.0]
    assert states(spark, path) == {"a": 10.2, "b": 8.0, None: 1.0}
    jobs.run(jobs.sample_frames(deliver(spark, folder, [("c", 500.0)], FRAMES), 1.0, idle_seconds=60.0), "frames", path)
    assert states(spark, path) == {"c": 500.0}
    # what comes later than that is dropped
    found = jobs.run(jobs.sample_frames(deliver(spark, folder, [("a", 20.0), ("c", 501.0)], FRAMES), 1.0, idle_seconds=60.0), "frames", path)
    assert found.filter("timestamp = 20").count() == 0 and found.filter("video_id = 'c'").count() == 2
    # nothing new: the same rows
    again = jobs.run(jobs.sample_frames(jobs.read_stream(spark, folder, "in.parquet"), 1.0, idle_seconds=60.0), "frames", path)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))


def test_state_kept_and_the_settings_of_the_session(spark):
    folder, key = shared_folder(spark, "in"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    rows = [(v, t / 3) for v in "ab" for t in range(50)]
    found = jobs.run(jobs.sample_frames(deliver(spark, folder, rows, FRAMES), 1.0), "kept")
    want = actions.sample_frames(spark.createDataFrame(rows, FRAMES), 1.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert spark.conf.get(key, None) == before


def test_late_rows_of_each_delivery(spark):
    folder, path = shared_folder(spark, "in"), shared_folder(spark, "late")
    for seconds in ([1000, 5000], [1500, 4399, 4400, 4900, 6000, None], [5399, 5400, 7], []):
        given = deliver(spark, folder, [(s, "x") for s in seconds], "s long, late_by string") if seconds else jobs.read_stream(spark, folder, "in.parquet")
        found = jobs.late_report(given.selectExpr("timestamp_seconds(s) as ts", "s"), 600.0, path=path)
    assert sorted(map(tuple, found.collect())) == [(0, 2, 0), (1, 6, 2), (2, 3, 2)]
    late = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/events").filter("late")
    assert sorted(r["s"] for r in late.collect()) == [7, 1500, 4399, 5399]
