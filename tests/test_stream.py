from pyspark.sql import functions as F

from lakesteward.streaming.latest import event_stream, fold_changes, latest_snapshot, stream_latest_state

SCHEMA = "run STRING, at BIGINT, state STRING"


def test_states_are_kept_across_restarts(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*events):
        spark.createDataFrame(list(events), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        events = event_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        stream_latest_state(events, ["run"], "at", ["state"], root).awaitTermination()
        return {r["run"]: (r["state"], r["at"], r["n"]) for r in latest_snapshot(spark, root, ["run"]).collect()}

    arrive(("a", 1, "SUBMITTED"), ("b", 1, "RUNNING"))
    arrive(("a", 3, "COMPLETED"))
    assert run() == {"a": ("COMPLETED", 3, 2), "b": ("RUNNING", 1, 1)}
    arrive(("a", 2, "RUNNING"), ("c", 5, "FAILED"))  # late for a, new for c
    assert run() == {"a": ("COMPLETED", 3, 3), "b": ("RUNNING", 1, 1), "c": ("FAILED", 5, 1)}
    assert run() == {"a": ("COMPLETED", 3, 3), "b": ("RUNNING", 1, 1), "c": ("FAILED", 5, 1)}
    batches = spark.read.parquet(f"{root}/changes").agg(F.count_distinct("batch")).first()[0]
    assert batches == 3
    before = {tuple(r) for r in latest_snapshot(spark, root, ["run"]).collect()}
    assert fold_changes(spark, root, ["run"]) == fold_changes(spark, root, ["run"]) == 2
    (tmp_path / "out" / "folded" / "upto=9").mkdir()  # one that was not finished
    assert {tuple(r) for r in latest_snapshot(spark, root, ["run"]).collect()} == before
    arrive(("b", 7, "CANCELLED"))
    assert run() == {"a": ("COMPLETED", 3, 3), "b": ("CANCELLED", 7, 2), "c": ("FAILED", 5, 1)}
    assert fold_changes(spark, root, ["run"]) == 3


def test_half_written_batches_are_left_out(spark, tmp_path):
    root = str(tmp_path)

    def batch(n, *rows):
        spark.createDataFrame(list(rows), "run STRING, at BIGINT, state STRING, n BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{root}/changes/batch={n}")

    batch(0, ("a", 1, "RUNNING", 1))
    batch(1, ("b", 1, "RUNNING", 1), ("c", 1, "FAILED", 1))
    (tmp_path / "changes/batch=1/_SUCCESS").unlink()
    batch(2, ("a", 9, "COMPLETED", 2))
    assert {r["run"] for r in latest_snapshot(spark, root, ["run"]).collect()} == {"a"}
    assert fold_changes(spark, root, ["run"]) == 0
    batch(1, ("b", 1, "RUNNING", 1), ("c", 1, "FAILED", 1))
    assert {r["run"]: r["state"] for r in latest_snapshot(spark, root, ["run"]).collect()} == {"a": "COMPLETED", "b": "RUNNING", "c": "FAILED"}
    assert fold_changes(spark, root, ["run"]) == 2
