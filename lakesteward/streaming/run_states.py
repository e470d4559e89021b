"""The state machine of runs as a stream: each run's state, kept up to date as its events arrive."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lakesteward.functions.runs import RUN_STATES, TERMINAL_STATES
from lakesteward.operators.runs import state_code

#: what is kept of a run's events: its first end, first cancel request and last reported state
FOLD = "end_at BIGINT, ended_as INT, exit_code INT, cancel_at BIGINT, reported_at BIGINT, reported INT, events BIGINT"
OUTCOME = "state STRING, finished BIGINT, exit_code INT, overdue BOOLEAN, events BIGINT"

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Spark's default store, which cannot hold the several column families that a stateful processor needs, and the one that can
PLAIN_STORE, FAMILY_STORE = (
    f"org.apache.spark.sql.execution.streaming.state.{name}StateStoreProvider" for name in ("HDFSBacked", "RocksDB")
)

Fold = tuple[int | None, int | None, int | None, int | None, int | None, int | None, int]


def merged(a: Fold, b: Fold) -> Fold:
    """What both say of one run. The order of the events and repeated ones change nothing but their count."""
    end = min((f[:3] for f in (a, b) if f[0] is not None), key=lambda e: (e[0], e[1], e[2] is None, e[2] or 0), default=(None, None, None))
    cancel = min((f[3] for f in (a, b) if f[3] is not None), default=None)
    reported = max((f[4:6] for f in (a, b) if f[4] is not None), default=(None, None))
    return (*end, cancel, *reported, a[6] + b[6])


def state_of(fold: Fold) -> str:
    """The state that ``fold_run_state`` gives."""
    end_at, ended_as, _, cancel_at, _, reported, _ = fold
    if cancel_at is not None and end_at is None:
        return "CANCEL_PENDING"
    if cancel_at is not None and cancel_at < end_at:
        return "CANCELLED"
    return RUN_STATES[(ended_as or reported or 1) - 1]


@contextmanager
def _family_store(spark: SparkSession) -> Iterator[None]:
    """A stream that is started within keeps its state in a store with column families; the session is left as it was.

    A stream copies the session's settings when it starts. A provider other than Spark's default stays.
    """
    own = spark.conf.get(STATE_STORE, PLAIN_STORE)
    if own != PLAIN_STORE:
        yield
        return
    spark.conf.set(STATE_STORE, FAMILY_STORE)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, own)


def _folded_in_tasks(key: list[str]):
    """Fold the events of a batch of rows by run, so that a run with very many of them moves few rows."""
    names = [c.split()[0] for c in FOLD.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first: dict[tuple, int] = {}
            folds: dict[tuple, Fold] = {}
            keys = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            for i, (own, one) in enumerate(zip(keys, zip(*(batch.column(n).to_pylist() for n in names), strict=True), strict=True)):
                first.setdefault(own, i)
                folds[own] = merged(folds[own], one) if own in folds else one
            at = pa.array(list(first.values()), pa.int64())
            kept = [batch.column(k).take(at) for k in key]
            columns = zip(*folds.values(), strict=True)
            values = [pa.array(c, batch.schema.field(n).type) for n, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *values], [*key, *names])

    return fold


class RunStates(StatefulProcessor):
    """Keeps the fold of one run's events; a timer, if there is a deadline, marks a run that has not ended in time."""

    def __init__(self, key: list[str], deadline_ms: int | None, keep_ms: int | None) -> None:
        self.key, self.deadline_ms, self.keep_ms = key, deadline_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.fold.get() if self.fold.exists() else None
        fold = tuple(stored) if stored is not None else (None, None, None, None, None, None, 0)
        for row in rows:
            fold = merged(fold, tuple(row)[len(key) :])
        self.fold.update(fold)
        if self.deadline_ms is not None and stored is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.deadline_ms)
        yield self._row(key, fold, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a run whose state has expired has not been heard of for longer than it is kept
        if self.fold.exists():
            fold = tuple(self.fold.get())
            if state_of(fold) not in TERMINAL_STATES:
                yield self._row(key, fold, True)

    def close(self) -> None:
        pass

    def _row(self, key, fold: Fold, overdue: bool) -> Row:
        names = [*self.key, *(c.split()[0] for c in OUTCOME.split(", "))]
        return Row(**dict(zip(names, (*key, state_of(fold), fold[0], fold[2], overdue, fold[6]), strict=True)))


def stream_run_states(
    events: DataFrame,
    key: list[str],
    order: str,
    state: Column,
    exit_code: Column,
    exited: Column,
    cancel: Column,
    root: str,
    deadline_ms: int | None = None,
    keep_ms: int | None = None,
) -> StreamingQuery:
    """Start the state machine over what has arrived and write the changed runs of each batch.

    The columns mean what they mean for ``fold_run_state``, and the newest row of a run, which
    ``latest_snapshot`` gives, has the state that this finds over all events so far, in whatever order and however often they
    came; ``finished`` and ``exit_code`` are those of the first end, and ``events`` counts the rows.
    A run that has not ended ``deadline_ms`` after its first event came is written once more, as
    ``overdue``, and an end that comes later takes that back. With ``keep_ms`` a run that has had no event for so
    long is forgotten, which must be longer than events can be late and than the deadline: an event
    after it begins a new run. Both are times of processing, and are looked at with every batch.

    Run it again with the same ``root`` and it goes on from its checkpoint; a repeated batch
    overwrites itself. ``order`` is a whole number. It runs in any session, whatever state store that one has.
    """
    timed = deadline_ms is not None or keep_ms is not None
    at = F.col(order).cast("bigint")
    terminal = state.isin(TERMINAL_STATES)
    ended_as = F.when(terminal, state_code(state)).when(exit_code == 0, F.lit(RUN_STATES.index("COMPLETED") + 1)).otherwise(F.lit(RUN_STATES.index("FAILED") + 1))
    end = F.coalesce(exited | terminal, F.lit(False))
    asked = F.coalesce(cancel, F.lit(False)) | F.coalesce(state == "CANCEL_PENDING", F.lit(False))
    known = [
        F.when(end, at).alias("end_at"), F.when(end, ended_as).cast("int").alias("ended_as"), F.when(end, exit_code).cast("int").alias("exit_code"),
        F.when(asked, at).alias("cancel_at"), F.when(state.isNotNull(), at).alias("reported_at"), state_code(state).alias("reported"),
        F.lit(1).cast("bigint").alias("events"),
    ]
    single = events.select(*key, *known)
    keys = StructType([single.schema[k] for k in key])
    schema = StructType([*keys, *StructType.fromDDL(FOLD)])
    folded = single.mapInArrow(_folded_in_tasks(key), schema)
    outcome = folded.groupBy(*key).transformWithState(
        RunStates(key, deadline_ms, keep_ms), StructType([*keys, *StructType.fromDDL(OUTCOME)]), "Update", "ProcessingTime" if timed else "None"
    )

    def write_changes(batch: DataFrame, batch_id: int) -> None:
        # a run may be both changed and overdue in one batch; then it is overdue unless it has ended
        newest = batch.groupBy(*key).agg(F.max_by(F.struct("state", "finished", "exit_code", "overdue", "events"), F.struct("events", "overdue")).alias("last"))
        newest.select(*key, "last.*").write.mode("overwrite").parquet(os.path.join(root, "changes", f"batch={batch_id}"))

    writer = (
        outcome.writeStream.outputMode("update")
        .foreachBatch(write_changes)
        .option("checkpointLocation", os.path.join(root, "progress"))
        # with times to look at there is always another batch to run, so all that has arrived goes into one
        .trigger(**({"once": True} if timed else {"availableNow": True}))
    )
    with _family_store(events.sparkSession):
        return writer.start()
