"""Newest frames across micro-batches, and requests as a stream."""

import time

from pyspark.sql import functions as F

from tesserae.sources.store import Runs
from tesserae.streaming import newest, requests

SCHEMA = "device string, ms long, key long, note string"


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def write(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)


def test_older_frames_are_dropped_across_batches(spark, tmp_path):
    batches = [
        [("a", 10, 1, "x"), ("a", 20, 2, "y"), ("b", 5, 3, None), (None, 1, 9, "n"), ("c", None, 1, "no time")],
        [("a", 15, 8, "late"), ("a", 20, 2, "again"), ("b", 5, 4, "same time, larger key")],
        [("a", 30, 1, "z"), ("a", 25, 1, "q"), (None, 0, 1, "old")],
    ]
    sink = f"{tmp_path}/out"
    for n, rows in enumerate(batches):
        write(spark, rows, f"{tmp_path}/in/{n}")
        with newest.state_in_rocksdb(spark):
            newest.newest_stream(stream(spark, f"{tmp_path}/in"), "device", "ms", "key").writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.device or "", r.ms, r.key, r.note) for r in spark.read.schema(SCHEMA).parquet(sink).collect())
    assert got == [("", 1, 9, "n"), ("a", 20, 2, "y"), ("a", 30, 1, "z"), ("b", 5, 3, None), ("b", 5, 4, "same time, larger key")]


def test_a_pending_frame_goes_on_when_its_time_comes(spark, tmp_path):
    write(spark, [("a", 1, 1, "first")], f"{tmp_path}/in/0")
    with newest.state_in_rocksdb(spark):
        rows = newest.newest_stream(stream(spark, f"{tmp_path}/in"), "device", "ms", "key", interval=6_000, forget_ms=600_000)
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    read = lambda: sorted(r.ms for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())

    def wait(n):
        end = time.time() + 60
        while time.time() < end:
            if (tmp_path / "out").exists() and len(read()) >= n:
                return
            time.sleep(0.5)

    try:
        wait(1)
        write(spark, [("a", 2, 1, "waits"), ("a", 3, 1, "waits too")], f"{tmp_path}/in/1")
        wait(2)
        assert read() in ([1, 3], [1, 2, 3]) and read()[-1] == 3
    finally:
        q.stop()


def test_requests_are_answered_by_the_newest_run(spark, tmp_path):
    runs, out = Runs(spark, f"{tmp_path}/runs"), f"{tmp_path}/served"
    asked = "id long, value string"
    loads = []

    def respond(rows, model):
        loads.append(model["m"].first().name)
        bad = F.col("value") == "bad"
        return rows.join(F.broadcast(model["m"])).select("id", "value", F.when(~bad, F.col("name")).alias("said"), F.when(bad, "cannot read").alias("error"))

    def serve(server):
        server.start(stream(spark, f"{tmp_path}/in", asked), f"{tmp_path}/c").awaitTermination()

    model = lambda name: {"m": spark.createDataFrame([(name,)], "name string")}
    server = requests.Server(runs, "knn", ["m"], respond, out)
    write(spark, [(0, "early")], f"{tmp_path}/in/0", asked)
    serve(server)
    for n, name in enumerate(("one", "two"), 1):
        runs.save("knn", model(name), run_id=name)
        runs.save("svm", model("other"), run_id=f"svm-{name}")
        write(spark, [(10 * n, "x"), (10 * n + 1, "bad")], f"{tmp_path}/in/{n}", asked)
        serve(server)
    answers = lambda: sorted((r.id, r.said, r.run_id, r.batch_id) for r in spark.read.parquet(f"{out}/answers").where("said is not null").collect())
    failures = lambda: sorted((r.id, r.error, r.run_id) for r in spark.read.schema("id long, value string, error string, run_id string").parquet(f"{out}/failures").collect())
    want = [(10, "one", "one", 1), (20, "two", "two", 2)]
    assert [r for r in answers() if r[1]] == want
    assert failures() == [(0, "no model", None), (11, "cannot read", "one"), (21, "cannot read", "two")]
    # batch 1 is run again, by a server that starts anew and while a newer run is there: the same answers, once
    requests.Server(runs, "knn", ["m"], respond, out)(spark.createDataFrame([(10, "x"), (11, "bad")], asked), 1)
    assert [r for r in answers() if r[1]] == want and len(failures()) == 3
    assert set(loads) == {"one", "two"}
