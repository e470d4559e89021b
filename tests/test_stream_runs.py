"""The state machine as a stream against the fold over all events."""

import random
import time

from pyspark.sql import functions as F

from lakesteward.functions.runs import RUN_STATES
from lakesteward.operators.runs import fold_run_state
from lakesteward.streaming.latest import event_stream, latest_snapshot
from lakesteward.streaming.run_states import merged, state_of, stream_run_states

SCHEMA = "vc STRING, run INT, at INT, state STRING, rc INT, over BOOLEAN, cancel BOOLEAN"


def marks():
    return {"state": F.col("state"), "exit_code": F.col("rc"), "exited": F.col("over"), "cancel": F.col("cancel")}


class Machine:
    def __init__(self, spark, folder, **times):
        self.spark, self.source, self.root, self.times = spark, str(folder / "in"), str(folder / "out"), times
        self.events = []

    def arrive(self, *events):
        self.events += events
        self.spark.createDataFrame(list(events), SCHEMA).repartition(2).write.mode("append").parquet(self.source)

    def run(self):
        events = event_stream(self.spark, self.source, self.spark.createDataFrame([], SCHEMA).schema)
        stream_run_states(events, ["vc", "run"], "at", root=self.root, **marks(), **self.times).awaitTermination()
        return {(r["vc"], r["run"]): r for r in latest_snapshot(self.spark, self.root, ["vc", "run"]).collect()}


def random_events(rng, n):
    # a run's position is used by one event, so that the first and the last one are known
    out = {}
    for _ in range(n):
        vc, run, at = rng.choice([None, "v", "w"]), rng.choice([None, 1, 2, 3, 4]), rng.randrange(30)
        kind = rng.random()
        rest = (
            (rng.choice(RUN_STATES), None, False, None) if kind < 0.4 else (None, rng.choice([0, 1, None]), True, None) if kind < 0.5
            else (None, None, None, True) if kind < 0.6 else (None, 5, False, False)
        )
        out[vc, run, at] = (vc, run, at, *rest)
    return list(out.values())


def test_batches_with_repeated_and_late_events_and_restarts_equal_the_fold(spark, tmp_path):
    rng = random.Random(4)
    events = random_events(rng, 120)
    rng.shuffle(events)
    machine = Machine(spark, tmp_path)
    for low in (0, 40, 80):
        repeated = rng.sample(events[: low + 40], 15)
        machine.arrive(*events[low : low + 40], *repeated)
        found = machine.run()  # each call is a restart
        frame = spark.createDataFrame(machine.events, SCHEMA)
        expected = {(r["vc"], r["run"]): r for r in fold_run_state(frame, ["vc", "run"], "at", **marks(), with_end=True).collect()}
        columns = ("state", "finished", "exit_code")
        assert {k: tuple(r[c] for c in columns) for k, r in found.items()} == {k: tuple(r[c] for c in columns) for k, r in expected.items()}
        counts = {}
        for e in machine.events:
            counts[e[:2]] = counts.get(e[:2], 0) + 1
        assert {k: r["events"] for k, r in found.items()} == counts
        assert not any(r["overdue"] for r in found.values())


def test_a_session_with_the_default_state_store(spark, tmp_path):
    """The settings of the session that runs a stream need not be those of ``build_session``, and stay as they are."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    own, plain = spark.conf.get(setting), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(setting, plain)
    try:
        machine = Machine(spark, tmp_path)
        machine.arrive(("v", 1, 1, "RUNNING", None, False, None), ("v", 2, 1, None, 0, True, None))
        machine.run()
        machine.arrive(("v", 1, 2, None, 1, True, None))
        assert {k[1]: r["state"] for k, r in machine.run().items()} == {1: "FAILED", 2: "COMPLETED"}
        assert spark.conf.get(setting) == plain
    finally:
        spark.conf.set(setting, own)


def test_runs_without_an_end_become_overdue(spark, tmp_path):
    machine = Machine(spark, tmp_path, deadline_ms=1500)
    machine.arrive(("v", 1, 1, "RUNNING", None, False, None), ("v", 2, 1, "RUNNING", None, False, None), ("v", 3, 1, None, 0, True, None))
    machine.run()
    time.sleep(2)
    machine.arrive(("v", 4, 1, "SUBMITTED", None, False, None))
    found = machine.run()
    assert {k[1]: (r["state"], r["overdue"]) for k, r in found.items() if k[1] < 4} == {1: ("RUNNING", True), 2: ("RUNNING", True), 3: ("COMPLETED", False)}
    machine.arrive(("v", 1, 9, None, 1, True, None))
    found = machine.run()
    assert {k[1]: (r["state"], r["overdue"]) for k, r in found.items() if k[1] < 4} == {1: ("FAILED", False), 2: ("RUNNING", True), 3: ("COMPLETED", False)}


def test_a_run_is_forgotten_after_its_time(spark, tmp_path):
    machine = Machine(spark, tmp_path, keep_ms=1500)
    machine.arrive(("v", 1, 1, None, 0, True, None))
    assert machine.run()["v", 1]["state"] == "COMPLETED"
    time.sleep(2)
    machine.arrive(("v", 1, 5, "RUNNING", None, False, None))
    found = machine.run()["v", 1]
    assert (found["state"], found["events"]) == ("RUNNING", 1)


def test_merging_does_not_depend_on_order():
    rng = random.Random(1)
    folds = [
        tuple(x) for x in (
            (a, rng.choice([4, 5, 7]), rng.choice([None, 0, 1]), None, None, None, 1) if kind == 0 else (None, None, None, a, None, None, 1)
            if kind == 1 else (None, None, None, None, a, rng.randrange(1, 7), 1)
            for a, kind in ((rng.randrange(20), rng.randrange(3)) for _ in range(40))
        )
    ]
    results = set()
    for _ in range(20):
        rng.shuffle(folds)
        fold = folds[0]
        for f in folds[1:]:
            fold = merged(fold, f)
        results.add((fold, state_of(fold)))
    assert len(results) == 1
