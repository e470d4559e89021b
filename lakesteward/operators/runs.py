"""Operators over job runs, their events and their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from lakesteward.functions.logs import is_cause_line, strip_line
from lakesteward.functions.names import spare_names
from lakesteward.functions.runs import RUN_STATES, TERMINAL_STATES, duration_s, failure_reason, is_terminal, state_details
from lakesteward.session import saved


_FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def failure_summary(
    lines: DataFrame,
    runs: DataFrame | None = None,
    run_key: list[str] | None = None,
    order: str = "position",
    stream: str = "stderr",
) -> DataFrame:
    """Per run, the last line that names a cause, or empty text.

    Where lines have a ``stream`` column only the given one is searched.
    With ``runs`` the logs are first cut down to their cause lines, and runs without logs are
    kept by a left join. Without it the runs are those seen in the logs, in the same single scan.
    """
    keys = run_key or ["vc_id", "jr_id"]
    searched = F.col("line")
    if "stream" in lines.columns:
        searched = F.when(F.col("stream") == stream, searched)
    stripped = lines.select(*keys, F.col(order).alias("_at"), strip_line(searched).alias("_line"))
    cause = is_cause_line(F.col("_line"))
    if runs is None:
        named = stripped.select(*keys, F.when(cause, F.struct("_at", "_line")).alias("_c"))
        last = named.groupBy(*keys).agg(F.max_by("_c._line", "_c._at").alias("summary"))
        return last.withColumn("summary", F.coalesce("summary", F.lit("")))
    last = stripped.filter(cause).groupBy(*keys).agg(F.max_by("_line", "_at").alias("summary"))
    return runs.select(*keys).join(last, keys, "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def override_last_wins(kv: DataFrame, group: list[str], order: str, key: str = "k", value: str = "v") -> DataFrame:
    """One row per group and key with the value at the highest position."""
    return kv.groupBy(*group, key).agg(F.max_by(value, order).alias(value))


def run_stats(
    runs: DataFrame,
    by: list[str],
    started: str = "startedAt",
    finished: str = "finishedAt",
) -> DataFrame:
    """Per group: runs, first start, last finish, and the shortest, longest and mean duration."""
    took = duration_s(F.col(started), F.col(finished))
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min(started).alias("first_at"),
        F.max(finished).alias("last_at"),
        F.min(took).alias("min_s"),
        F.max(took).alias("max_s"),
        F.avg(took).alias("avg_s"),
    )


def latest_state(events: DataFrame, key: list[str], order: str, values: list[str] | None = None) -> DataFrame:
    """Last write per key. Combined within each task, so only one row per key and task moves."""
    kept = values or [c for c in events.columns if c not in key]
    if all(isinstance(events.schema[c].dataType, _FIXED_WIDTH) for c in [*kept, order]):
        # buffers of fixed width are hashed; a struct or text would make Spark sort the events
        return events.groupBy(*key).agg(*(F.max_by(c, order).alias(c) for c in kept))
    picked = events.groupBy(*key).agg(F.max_by(F.struct(*kept), F.col(order)).alias("_last"))
    return picked.select(*key, "_last.*")


def state_code(state: Column) -> Column:
    """Place of a state in its life cycle, from 1; null for none."""
    position = F.array_position(F.array(*map(F.lit, RUN_STATES)), state).cast("int")
    return F.nullif(position, F.lit(0))


def fold_run_state(
    events: DataFrame,
    key: list[str],
    order: str,
    state: Column,
    exit_code: Column,
    exited: Column,
    cancel: Column,
    with_end: bool = False,
) -> DataFrame:
    """Final state of each run from its events.

    ``state`` is a reported state or null, ``exited`` marks the end of the process with
    ``exit_code`` (null counts as failure), ``cancel`` a cancel request; a reported state
    CANCEL_PENDING is one as well. The first end is final. A cancel request before it is sticky and beats the exit code, and leaves a run that has not
    ended CANCEL_PENDING; one after it changes nothing. ``with_end`` adds the position of the first
    end, ``finished``, and the exit code that it gives.

    States are carried as integers: all aggregation buffers then have a fixed width, and Spark
    hashes the groups instead of sorting the events.
    """
    at = F.col(order)
    ends = exited | state.isin(TERMINAL_STATES)
    ended_as = (
        F.when(state.isin(TERMINAL_STATES), state_code(state))
        .when(exit_code == 0, F.lit(RUN_STATES.index("COMPLETED") + 1))
        .otherwise(F.lit(RUN_STATES.index("FAILED") + 1))
    )
    end_at = F.when(F.coalesce(ends, F.lit(False)), at)
    asked = F.coalesce(cancel, F.lit(False)) | F.coalesce(state == "CANCEL_PENDING", F.lit(False))
    cancel_at = F.when(asked, at)
    state_at = F.when(state.isNotNull(), at)
    (end, ended, cancelled_at, reported) = spare_names(key, "end_at", "ended_as", "cancel_at", "reported")
    codes = [F.min_by(exit_code, end_at).alias("exit_code")] if with_end else []
    folded = events.groupBy(*key).agg(
        F.min(end_at).alias(end),
        F.min_by(ended_as, end_at).alias(ended),
        F.min(cancel_at).alias(cancelled_at),
        F.max_by(state_code(state), state_at).alias(reported),
        *codes,
    )
    cancelled = F.col(cancelled_at).isNotNull() & (
        F.col(end).isNull() | (F.col(cancelled_at) < F.col(end))
    )
    name = F.array(*map(F.lit, RUN_STATES))
    final = (
        F.when(cancelled & F.col(end).isNull(), "CANCEL_PENDING")
        .when(cancelled, "CANCELLED")
        .otherwise(F.get(name, F.coalesce(ended, reported, F.lit(1)) - 1))
    )
    more = [F.col(end).alias("finished"), F.col("exit_code")] if with_end else []
    return folded.select(*key, final.alias("state"), *more)


def finalised_runs(
    runs: DataFrame,
    events: DataFrame,
    lines: DataFrame,
    key: list[str],
    order: str,
    state: Column,
    exit_code: Column,
    exited: Column,
    cancel: Column,
    line_order: str = "position",
    stdout: str = "stdout",
    stderr: str = "stderr",
) -> DataFrame:
    """One row per run: its key, state, exit code, end, summary, details and reason.

    ``runs`` has the key and the places of both outputs, ``events`` what ``fold_run_state`` takes,
    ``lines`` the log lines. A run without events is PENDING; one without logs has an empty summary.
    ``finished`` is the ``order`` of its first end, whether the process exited or a terminal state
    was recorded, and ``exit_code`` what that event gives. Details are given once the state is terminal.
    """
    folded = fold_run_state(events, key, order, state, exit_code, exited, cancel, with_end=True)
    summaries = failure_summary(lines, run_key=key, order=line_order)
    joined = runs.select(*key, stdout, stderr).join(folded, key, "left").join(summaries, key, "left")
    current = F.coalesce("state", F.lit(RUN_STATES[0]))
    summary = F.coalesce("summary", F.lit(""))
    details = F.when(is_terminal(current), state_details(current, F.col("exit_code"), summary, F.col(stdout), F.col(stderr)))
    return joined.select(
        *key, current.alias("state"), "exit_code", "finished", summary.alias("summary"), details.alias("details"),
        failure_reason(current, F.col("exit_code")).alias("reason"),
    )


def first_of_token(runs: DataFrame, token: str = "clientToken", order: str = "createdAt") -> DataFrame:
    """Runs without those that repeat the non-empty client token of an earlier one of their cluster.

    Runs without a token or a cluster take no part in the join, where they would all meet on one key.
    The first runs are stored, so that AQE can split a token that very many runs share.
    """
    keys = ["virtualClusterId", token]
    (first,) = spare_names(runs.columns, "_first")
    taken = F.nullif(F.col(token), F.lit("")).isNotNull() & F.col("virtualClusterId").isNotNull()
    bearing = runs.filter(taken)
    firsts = saved(bearing.groupBy(*keys).agg(F.min(F.struct(order, "id")).alias(first)), "first-of-token")
    kept = bearing.join(firsts, keys).filter(F.struct(order, "id") == F.col(first)).select(*runs.columns)
    return kept.unionByName(runs.filter(~taken))
