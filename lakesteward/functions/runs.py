"""Expressions over job-run records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run states in life-cycle order, the terminal ones, and the texts shown to users.
RUN_STATES = ["PENDING", "SUBMITTED", "RUNNING", "COMPLETED", "FAILED", "CANCEL_PENDING", "CANCELLED"]
TERMINAL_STATES = ["COMPLETED", "FAILED", "CANCELLED"]
NO_SUMMARY = "(no exception summary in stderr; see stderr.gz for context)"

STATUS_FIELDS = [
    "id", "virtualClusterId", "name", "state", "exitCode", "startedAt", "finishedAt",
    "logUri", "stdoutS3", "stderrS3", "stdoutLocal", "stderrLocal",
]
STATUS_SCHEMA = (
    "id STRING, virtualClusterId STRING, name STRING, state STRING, exitCode INT, "
    "startedAt DOUBLE, finishedAt DOUBLE, logUri STRING, stdoutS3 STRING, stderrS3 STRING, "
    "stdoutLocal STRING, stderrLocal STRING"
)

# The records of job runs and of clusters as the run API gives them.
RUN_SCHEMA = (
    "id STRING, name STRING, virtualClusterId STRING, arn STRING, state STRING, clientToken STRING, "
    "executionRoleArn STRING, releaseLabel STRING, "
    "configurationOverrides STRUCT<monitoringConfiguration: STRUCT<s3MonitoringConfiguration: STRUCT<logUri: STRING>>>, "
    "jobDriver STRUCT<sparkSubmitJobDriver: STRUCT<entryPoint: STRING, sparkSubmitParameters: STRING, "
    "entryPointArguments: ARRAY<STRING>>>, tags MAP<STRING, STRING>, createdAt DOUBLE, createdBy STRING, "
    "finishedAt DOUBLE, stateDetails STRING, failureReason STRING"
)
CLUSTER_SCHEMA = (
    "id STRING, name STRING, arn STRING, state STRING, "
    "containerProvider STRUCT<id: STRING, type: STRING, info: STRUCT<eksInfo: STRUCT<namespace: STRING>>>, "
    "createdAt DOUBLE, tags MAP<STRING, STRING>"
)


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL_STATES)


def log_uri(overrides: Column) -> Column:
    """Log destination of a run; null when any level of the nested settings is absent."""
    return overrides["monitoringConfiguration"]["s3MonitoringConfiguration"]["logUri"]


def log_object_uri(base: Column, vc_id: Column, jr_id: Column, file_name: Column) -> Column:
    """Where the driver log of a run lies below its log destination."""
    folder = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return F.concat(
        folder, vc_id, F.lit("/jobs/"), jr_id, F.lit("/containers/spark-"), jr_id,
        F.lit("/spark-"), jr_id, F.lit("-driver/"), file_name,
    )


def default_value(value: Column, default: str, empty_is_missing: bool = False) -> Column:
    present = F.nullif(value, F.lit("")) if empty_is_missing else value
    return F.coalesce(present, F.lit(default))


def epoch_to_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def duration_s(started: Column, finished: Column) -> Column:
    return finished - started


# a step takes a whole run of plain characters or a whole quoted part, and gives nothing back, so
# that neither long words nor long quotes make the matcher recurse
_PLAIN, _ESCAPED = r"""[^\s"'\\]++""", r"\\."
_DOUBLE, _SINGLE = r'''"(?:[^"\\]++|\\.)*+"''', r"""'[^']*+'"""
_PART = f"{_PLAIN}|{_ESCAPED}|{_DOUBLE}|{_SINGLE}"


def _unquoted(word: Column) -> Column:
    """A word without its quotes and escapes: within double quotes only a quote or a backslash is escaped."""

    def bare(part: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.char_length(part) - 2)
        return (
            F.when(part.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(part.startswith("'"), inner)
            .when(part.startswith("\\"), F.substring(part, F.lit(2), F.char_length(part)))
            .otherwise(part)
        )

    parts = F.regexp_extract_all(word, F.lit(f"(?s)({_PART})"), F.lit(1))
    quoted = word.contains('"') | word.contains("'") | word.contains("\\")
    return F.when(quoted, F.array_join(F.transform(parts, bare), "")).otherwise(word)


def submit_conf(params: Column) -> Column:
    """``--conf k=v`` options of a submit string as ordered structs (pos, key, value).

    The string is cut into words as a shell does, with quoted parts and escaped characters, so an
    option and its value within one pair of quotes are none. A quote that is never closed, or a
    backslash at the very end, ends the word there and is left out.
    """
    words = F.regexp_extract_all(params, F.lit(f"(?s)((?:{_PART})++)"), F.lit(1))

    def options(words: Column) -> Column:
        def option(word: Column, pos: Column) -> Column:
            after = F.when(pos > 0, F.get(words, pos - 1)) == "--conf"
            inline = F.when(word.startswith("--conf="), F.substring(word, F.lit(8), F.char_length(word)))
            return F.when(after, word).otherwise(inline)

        return F.filter(F.transform(words, option), lambda text: text.isNotNull())

    def entry(text: Column, pos: Column) -> Column:
        key = F.substring_index(text, "=", 1)
        value = F.substring(text, F.char_length(key) + F.lit(2), F.char_length(text))
        return F.struct(pos.alias("pos"), key.alias("key"), value.alias("value"))

    # wrapped as a lambda over one element, so that the string is cut once and not per word
    plain = F.array(F.transform(words, _unquoted))
    return F.get(F.transform(plain, lambda words: F.transform(options(words), entry)), 0)


def conf_map(entries: Column) -> Column:
    """Map from the ordered entries of one run; a later entry for the same key wins.

    The entries are folded from the last one, so that the expression is evaluated once per row.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("keys"), none.alias("values"))

    def add(kept: Column, entry: Column) -> Column:
        more = F.struct(
            F.array_append(kept["keys"], entry["key"]).alias("keys"),
            F.array_append(kept["values"], entry["value"]).alias("values"),
        )
        return F.when(F.array_contains(kept["keys"], entry["key"]), kept).otherwise(more)

    return F.aggregate(F.reverse(entries), start, add, lambda kept: F.map_from_arrays(kept["keys"], kept["values"]))


def log_location(remote: Column, local: Column) -> Column:
    return F.coalesce(F.nullif(remote, F.lit("")), local)


def state_details(state: Column, exit_code: Column, summary: Column, stdout: Column, stderr: Column) -> Column:
    """Text for a run's page: where its output is, and for a failed run the exit code and the cause."""
    shown = [F.coalesce(c.cast("string"), F.lit("None")) for c in (exit_code, stdout, stderr)]
    code, out, err = shown
    cause = default_value(summary, NO_SUMMARY, empty_is_missing=True)
    return (
        F.when(state == "COMPLETED", F.concat(F.lit("stdout: "), out))
        .when(state == "CANCELLED", F.concat(F.lit("cancelled. stdout: "), out))
        .otherwise(
            F.concat(
                F.lit("spark-submit exit "), code, F.lit(": "), cause,
                F.lit("\nstdout: "), out, F.lit("\nstderr: "), err,
            )
        )
    )


def failure_reason(state: Column, exit_code: Column) -> Column:
    """Reason code of a run that failed with its own exit code; null for any other run."""
    code = F.coalesce(exit_code.cast("string"), F.lit("None"))
    return F.when(state == "FAILED", F.concat(F.lit("USER_ERROR: spark-submit exit "), code))


def to_status_json(*fields: Column) -> Column:
    """Status record as JSON text; absent values are kept as explicit nulls."""
    columns = fields or tuple(F.col(name) for name in STATUS_FIELDS)
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
