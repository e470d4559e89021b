"""Run status records and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesteward.functions.logs import decode_utf8_replace, split_at_line_ends
from lakesteward.functions.runs import CLUSTER_SCHEMA, RUN_SCHEMA, STATUS_SCHEMA
from lakesteward.session import saved


def read_run_status(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Run status records: pretty-printed, one per file, or (``False``) one JSON object per line.

    A record that is broken or does not fit the fields fails the job when it is read; see
    ``broken_run_status`` for which ones do.
    """
    return spark.read.schema(STATUS_SCHEMA).option("multiLine", one_per_file).option("mode", "FAILFAST").json(path)


def read_job_runs(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Job-run records as JSON, one per line or per file, with all their fields; a broken one fails the job."""
    return spark.read.schema(RUN_SCHEMA).option("multiLine", one_per_file).option("mode", "FAILFAST").json(path)


def read_clusters(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Cluster records as JSON, one per line or per file; a broken one fails the job."""
    return spark.read.schema(CLUSTER_SCHEMA).option("multiLine", one_per_file).option("mode", "FAILFAST").json(path)


def broken_run_status(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """File and text of the records that ``read_run_status`` would fail on."""
    reader = spark.read.schema(STATUS_SCHEMA + ", broken STRING").option("multiLine", one_per_file)
    rows = reader.option("columnNameOfCorruptRecord", "broken").json(path)
    # all fields are stored: one that is not asked for is not parsed, and so never broken
    parsed = saved(rows.select(F.col("_metadata.file_path").alias("file"), *rows.columns), "run-status")
    return parsed.filter("broken IS NOT NULL").select("file", "broken")


# Fixed value: where the run API itself stores driver logs below a log destination.
DRIVER_LOG_PATH = r"([^/]+)/jobs/([^/]+)/containers/[^/]+/[^/]+/(stdout|stderr)\.[^/]*$"


def read_run_logs(
    spark: SparkSession, root: str, layout: str = "partitions", scope: Column | str | None = None, numbered: bool = False
) -> DataFrame:
    """Log lines as (vc_id, jr_id, stream, position, line), read as a stream and never file by file.

    ``position`` sorts the lines of one run and stream: batch, part number, file, byte range and the
    row's place in that range. With ``numbered`` a dense 1-based ``line_no`` takes its place, which
    a later filter leaves as it is. ``scope`` is a predicate on vc_id, jr_id and stream; given here
    it prunes directories, which a filter on the result cannot, as rows are numbered in between.
    ``layout="driver"`` takes the ids, unescaped, from the path the run API writes its logs to.
    """
    if layout == "partitions":
        raw = spark.read.schema("value STRING, vc_id STRING, jr_id STRING, stream STRING").text(root)
    elif layout == "driver":
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "std*.gz").text(root)
        file_path = F.col("_metadata.file_path")
        raw = raw.withColumns(
            {
                # a plus sign is itself in a path
                name: F.url_decode(F.regexp_replace(F.regexp_extract(file_path, DRIVER_LOG_PATH, i), r"\+", "%2B"))
                for i, name in enumerate(["vc_id", "jr_id", "stream"], start=1)
            }
        )
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if scope is not None:
        raw = raw.filter(scope)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("bigint")
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/[^/]*$", 1).try_cast("bigint")
    placed = raw.select(
        "vc_id", "jr_id", "stream",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.coalesce(batch, F.lit(0).cast("bigint")).alias("batch"),
        F.coalesce(part, F.lit(0).cast("bigint")).alias("part"),
        F.explode(split_at_line_ends(decode_utf8_replace(F.col("value")))).alias("line"),
    )
    lines = placed.select(
        "vc_id", "jr_id", "stream",
        F.struct("batch", "part", "file", "block", F.monotonically_increasing_id().alias("row")).alias("position"),
        "line",
    )
    return _with_line_numbers(lines) if numbered else lines


def _with_line_numbers(lines: DataFrame) -> DataFrame:
    """Replace the ``position`` of all lines of the files read by a dense 1-based ``line_no`` per run and stream.

    Only one row per file range is sorted, and stored, so that its true size is known when the lines
    are joined with it; the lines are numbered by adding the range's offset, so no run is ever
    gathered in one task.
    """
    chunk = ["vc_id", "jr_id", "stream", "batch", "part", "file", "block"]
    rows = lines.select("vc_id", "jr_id", "stream", "position.*", "line")
    earlier = Window.partitionBy("vc_id", "jr_id", "stream").orderBy("batch", "part", "file", "block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    chunks = saved(rows.groupBy(*chunk).agg(F.count("*").alias("n"), F.min("row").alias("first_row")), "log-ranges")
    offsets = chunks.select("file", "block", "first_row", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    number = (F.col("row") - F.col("first_row") + F.col("offset") + 1).alias("line_no")
    return rows.join(offsets, ["file", "block"]).select("vc_id", "jr_id", "stream", number, "line")
