"""The registered queries: every operator, run over whole tables.

Tables stand in for the data of a lake: customers belong to tenants (their nation), orders and
line items hang on customers, documents are stored objects, users' days are job runs and events
are what happens to them.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesteward.functions import logs as log_fn
from lakesteward.functions import paths as path_fn
from lakesteward.functions import runs as run_fn
from lakesteward.functions.templates import resolve_template
from lakesteward.operators import manifests, matching, measures, ordering, quality, runs, scope, tenants
from lakesteward.operators.clustering import cluster
from lakesteward.operators.maintenance import compact, file_count_for, vacuum_execute, vacuum_plan
from lakesteward.plans.clone import clone_prefixes, clone_table
from lakesteward.plans.offboard import offboard_tenant
from lakesteward.plans.packing import pack_table, table_files
from lakesteward.plans.partitions import delete_tenants, upsert_table
from lakesteward.plans.retention import lease_version, publish_recorded, release_version, vacuum_versions
from lakesteward.session import saved, workspace
from lakesteward.sources.basic import range_source, rows_source
from lakesteward.sources.catalog import catalogued_partitions, register_batch, table_location
from lakesteward.sources.definitions import definition_shapes, definition_texts, read_table_defs, resolve_table_defs
from lakesteward.sources.manifest import file_manifest, list_prefix, qualified, storage_opener, storage_options
from lakesteward.sources.run_records import read_clusters, read_job_runs, read_run_logs, read_run_status
from lakesteward.sources.sinks import overwrite_sink, publish_version, write_run_logs
from lakesteward.streaming.run_states import stream_run_states
from lakesteward.streaming.latest import event_stream, latest_snapshot, stream_latest_state

Query = Callable[[SparkSession, str], DataFrame]

TENANT = 6
CLONED_TENANTS = [6, 11]
RUN = ["user_id", "day"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("day", F.to_date("ts"))


def tenant_tables(spark: SparkSession, sf_dir: str) -> list[tenants.TenantTable]:
    return [
        tenants.TenantTable(
            "customer", table(spark, sf_dir, "customer"), tenant_col="c_nationkey", key="c_custkey",
            unique_key=("c_custkey",),
        ),
        tenants.TenantTable(
            "orders", table(spark, sf_dir, "orders"), key="o_orderkey", parent="customer", fk="o_custkey",
            unique_key=("o_orderkey",),
        ),
        tenants.TenantTable("lineitem", table(spark, sf_dir, "lineitem"), parent="orders", fk="l_orderkey"),
    ]


def _stacked(tables: dict[str, DataFrame]) -> DataFrame:
    """All columns of the tables; those that a table lacks are null."""
    customer, orders, lineitem = (tables[t].withColumn("tbl", F.lit(t)) for t in ("customer", "orders", "lineitem"))
    return customer.unionByName(orders, allowMissingColumns=True).unionByName(lineitem, allowMissingColumns=True)


def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = quality.row_count(table(spark, sf_dir, "lineitem")).first()["n"]
    return range_source(spark, n).agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def overwrite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, path = table(spark, sf_dir, "orders"), workspace(spark, "orders")
    overwrite_sink(orders.filter("o_orderstatus = 'F'"), path)
    return overwrite_sink(orders, path)


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("section"), F.col("p_brand").alias("name")
    )
    chosen = scope.filter_sections(definitions, ["ECONOMY", "PROMO", "ABSENT"])
    names = rows_source(spark, [("Brand#6",), ("Brand#11",), ("NO_SUCH_BRAND",)], "name STRING")
    return scope.filter_tables(chosen, names).select("p_partkey", "section", "name")


def partition_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clone_table(
        spark, f"{sf_dir}/customer.parquet", workspace(spark, "clone"), {"c_nationkey": CLONED_TENANTS},
        partition_by=["c_nationkey"],
    )


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "documents").select(F.col("source").alias("prefix"), F.col("n_chars").alias("length"))
    return manifests.manifest_summary(objects, ["prefix"])


def _copied_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as objects, and a copy that lacks the unlabelled ones, has the toxic ones changed, and some others."""
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("documents/"), F.col("doc_id")).alias("key"), "doc_id", F.col("n_chars").alias("length"),
        (F.col("doc_id") % 7).alias("mtime"),
    )
    labels = table(spark, sf_dir, "labels")
    copied = documents.join(labels, "doc_id").select(
        "key", (F.col("length") + F.col("toxic")).alias("length"), F.lit(5).cast("bigint").alias("mtime")
    )
    left_over = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark/"), F.col("item_id")).alias("key"),
        F.char_length("text").cast("bigint").alias("length"),
        F.lit(0).cast("bigint").alias("mtime"),
    )
    return documents.select("key", "length", "mtime"), copied.unionByName(left_over)


def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.sync_plan(*_copied_manifests(spark, sf_dir)).select("key", "action")


def sync_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan by checksums of ranges, with the lengths on both sides."""
    return manifests.sync_plan_by_ranges(*_copied_manifests(spark, sf_dir))


def prefix_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.regexp_replace("url", "^http://", "s3://")
    key = path_fn.uri_parts(F.col("url"))["key"]
    return table(spark, sf_dir, "pages").select(
        "page_id",
        path_fn.normalize_scheme(stored).alias("uri"),
        path_fn.remap_prefix(key, "en", "local/en").alias("path"),
    )


def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", path_fn.uri_parts(F.col("url")).alias("u")).select(
        "page_id", "u.*"
    )


def template_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.concat(F.lit("s3://data-{bucket_suffix}/{env}/"), F.col("s_name"), F.lit("/{unknown}/{env}"))
    resolved = resolve_template(template, {"env": "local", "bucket_suffix": "dev"})
    return table(spark, sf_dir, "supplier").select("s_suppkey", resolved.alias("location"))


def expectation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = quality.expectations(
        table(spark, sf_dir, "customer"),
        [quality.NonEmpty(), quality.Unique(("c_custkey",)), quality.Holds("acctbal_positive", F.col("c_acctbal") >= 0)],
    )
    lineitem = quality.expectations(
        table(spark, sf_dir, "lineitem"), [quality.NonEmpty(), quality.Unique(("l_orderkey", "l_linenumber"))]
    )
    named = [df.select(F.lit(t).alias("tbl"), "rule", "ok") for t, df in (("customer", customer), ("lineitem", lineitem))]
    return named[0].unionByName(named[1])


def ordinal_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ordering.ordinal_of_total(orders, ["o_custkey", "o_orderkey"], from_scan=True)


def _step_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", F.concat(F.lit("step failed with "), F.col("props")))
    return run_events(spark, sf_dir).select(*RUN, "event_id", failed.alias("error"))


def outcome_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.batch_outcome(_step_results(spark, sf_dir), RUN)


def failures_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.batch_failures(_step_results(spark, sf_dir), RUN, item="event_id")


def parent_autoregister(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select("c_custkey", "c_name")
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return matching.autoregister_parents(
        children, known, "c_custkey", {"c_name": matching.auto_name("c_custkey")}
    )


def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    base = customer.filter("c_acctbal >= 0").select("c_custkey", "c_name", "c_mktsegment")
    updates = customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.concat(F.lit("upd-"), F.col("c_name")).alias("c_name"), F.lit("MOVED").alias("c_mktsegment")
    )
    return matching.upsert(base, updates, "c_custkey")


def tenant_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(tenants.tenant_delete(tenant_tables(spark, sf_dir), [TENANT, None]))


def tenant_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = tenant_tables(spark, sf_dir)
    root = workspace(spark, "tenant")
    kept = tenants.tenant_delete(snapshot, [TENANT])
    current = [
        tenants.TenantTable(
            t.name, overwrite_sink(kept[t.name], os.path.join(root, "deleted", t.name)),
            t.tenant_col, t.key, t.parent, t.fk, t.unique_key,
        )
        for t in snapshot
    ]
    restored = tenants.tenant_recovery(current, snapshot, [TENANT])
    reread = {name: overwrite_sink(df, os.path.join(root, "restored", name)) for name, df in restored.items()}
    return _stacked(reread)


def compacted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows, whether their number of files is the one asked for, and whether each file is in order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    size = manifests.manifest_summary(list_prefix(spark, f"{sf_dir}/orders.parquet")).first()["bytes"]
    files = file_count_for(size, 64 * 1024)
    packed = compact(orders, files, ["o_orderstatus", "o_custkey"], from_scan=True)
    stored = overwrite_sink(packed, workspace(spark, "compact"))
    rows = stored.select("*", F.col("_metadata.file_name").alias("file"), F.struct("o_orderstatus", "o_custkey").alias("at"))
    ranges = rows.groupBy("file").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    following = F.lead("low").over(Window.orderBy("low", "high"))
    apart = ranges.select("file", F.coalesce(F.col("high") <= following, F.lit(True)).alias("ranged"))
    checks = apart.agg((F.count("*") == files).alias("files_as_asked"), F.every("ranged").alias("ranged")).first()
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", *(F.lit(v).alias(n) for n, v in checks.asDict().items()))


def vacuum_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return vacuum_plan(documents, table(spark, sf_dir, "labels"), 2000, key="doc_id", age="n_chars").select("doc_id")


def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = runs.latest_state(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "ts"])
    return latest.withColumnRenamed("event_type", "state")


def _run_event_marks() -> dict[str, Column]:
    """What the kinds of events mean for a run: some cancels are requests, the others recorded as a state, as are some failures."""
    kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
    return {
        "state": F.when(kind == "signup", "SUBMITTED").when(kind == "view", "RUNNING")
        .when((kind == "click") & even, "CANCEL_PENDING").when((kind == "error") & even, "FAILED"),
        "exit_code": F.when(kind == "purchase", 0).when((kind == "error") & ~even, 1),
        "exited": (kind == "purchase") | ((kind == "error") & ~even),
        "cancel": (kind == "click") & ~even,
    }


def run_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.fold_run_state(run_events(spark, sf_dir), RUN, "event_id", **_run_event_marks())


def finalised_run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as runs. Sign-ups and clicks write no log, so some runs have none."""
    events = run_events(spark, sf_dir)
    place = F.concat(F.lit("/var/logs/"), F.col("user_id"), F.lit("-"), F.col("day"))
    listed = events.select(*RUN).distinct().select(
        *RUN, F.concat(place, F.lit("/stdout.log")).alias("stdout"), F.concat(place, F.lit("/stderr.log")).alias("stderr")
    )
    lines = _log_lines(spark, sf_dir).filter(~F.col("event_type").isin("signup", "click"))
    return runs.finalised_runs(listed, events, lines, RUN, "event_id", **_run_event_marks(), line_order="event_id")


def job_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as job-run records, written as JSON and read back; customers repeat client tokens."""
    path = workspace(spark, "job-runs")
    order = table(spark, sf_dir, "orders")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    record = F.struct(
        F.concat(F.lit("jr-"), F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("vc-"), F.col("o_custkey") % 10).alias("virtualClusterId"),
        F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("tok-"), F.col("o_custkey"))).otherwise("").alias("clientToken"),
        F.struct(F.struct(F.struct(F.when(F.col("o_orderstatus") == "F", "s3://logs").alias("logUri")).alias("s3MonitoringConfiguration"))
                 .alias("monitoringConfiguration")).alias("configurationOverrides"),
        F.struct(F.struct(F.lit("s3://jobs/main.py").alias("entryPoint"), F.concat(F.lit("--conf a="), F.col("o_orderstatus")).alias("sparkSubmitParameters"))
                 .alias("sparkSubmitJobDriver")).alias("jobDriver"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("tags"), at.alias("createdAt"),
    )
    order.select(F.to_json(record).alias("value")).write.option("compression", "gzip").text(path)
    records = runs.first_of_token(read_job_runs(spark, path))
    option = run_fn.submit_conf(F.col("jobDriver.sparkSubmitJobDriver.sparkSubmitParameters"))[0]["value"]
    return records.select(
        "id", "virtualClusterId", run_fn.log_uri(F.col("configurationOverrides")).alias("log_uri"),
        option.alias("option"), F.col("tags")["status"].alias("tag"), "createdAt",
    )


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    line = (
        F.when(kind == "error", F.concat(F.lit("pkg.StepError: "), number))
        .when(kind == "view", F.lit("24/01/01 00:00:00 ERROR x"))
        .when(kind == "purchase", F.concat(F.lit("\tCaused by: p"), number))
        .otherwise(F.lit("  noise"))
    )
    return run_events(spark, sf_dir).select(*RUN, "event_id", "event_type", line.alias("line"))


def failure_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failure_summary(_log_lines(spark, sf_dir), run_key=RUN, order="event_id")


def override_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("k"), F.col("value").alias("v"), "event_id"
    )
    return runs.override_last_wins(kv, ["user_id"], "event_id")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_stats(_status_records(spark, sf_dir), ["state"])


def priority_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    rank = ordering.priority_rank("event_type", ["purchase", "signup", "click"])
    return ordering.first_n(events, [rank, "event_id"], 20)


def priority_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted rows with the place that the sort gave each of them."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ranked = ordering.priority_order(customer, "c_mktsegment", ["MACHINERY", "BUILDING"], then=["c_custkey"], from_scan=True)
    placed = saved(ranked.withColumn("row", F.monotonically_increasing_id()), "sorted")
    parts = placed.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = (F.col("offset") + F.col("row").bitwiseAND(2**33 - 1) + 1).cast("bigint")
    joined = placed.withColumn("part", F.shiftright("row", 33)).join(offsets, "part")
    return joined.select("c_custkey", "c_mktsegment", place.alias("place"))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    # a file stream wants a directory or a pattern, so the name is written as one
    events = event_stream(spark, f"{sf_dir}/[e]vents.parquet", schema)
    stream_latest_state(events, ["user_id"], "event_id", ["event_type"], root).awaitTermination()
    return latest_snapshot(spark, root, ["user_id"]).select("user_id", F.col("event_type").alias("state"), "n")


def published_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts published three times: whole, by size with a new column, and by size again with the larger ones only."""
    root = workspace(spark, "published")
    name = "published_" + os.path.basename(root).rpartition("-")[2]
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    publish_version(part, name, root)
    publish_version(part.withColumn("p_next", F.col("p_partkey") + 1), name, root, partition_by=["p_size"])
    publish_version(spark.table(name).filter("p_size > 20"), name, root, partition_by=["p_size"])
    sizes = len(catalogued_partitions(spark, name))
    return spark.table(name).select("p_partkey", "p_name", "p_size", "p_next", F.lit(sizes).alias("partitions"))


def prefix_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of a level, and the number and bytes of the files in one of them, in plain text so that they are known."""
    path = workspace(spark, "listing")
    lines = table(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws("|", "c_custkey", "c_name").alias("value"))
    lines.repartition(3, "c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    listed = list_prefix(spark, path).filter("is_dir").select(path_fn.basename(F.col("path")).alias("name"), "is_dir", "length")
    inside = manifests.data_files(list_prefix(spark, f"{path}/c_nationkey={TENANT}")).filter("length > 0")
    total = inside.agg(F.lit("files").alias("name"), F.max("is_dir").alias("is_dir"), F.sum("length").alias("length"))
    return listed.unionByName(total)


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes per folder of three sections of plain text."""
    path = workspace(spark, "layers")
    sections = {"gold": "supplier", "silver": "customer", "bronze": "orders"}
    columns = {"supplier": "s_nationkey", "customer": "c_nationkey", "orders": "o_orderstatus"}
    text = {"supplier": ["s_suppkey", "s_name"], "customer": ["c_custkey", "c_name"], "orders": ["o_orderkey", "o_orderpriority"]}
    for section, name in sections.items():
        rows = table(spark, sf_dir, name).select(columns[name], F.concat_ws("|", *text[name]).alias("value"))
        rows.repartition(2).write.partitionBy(columns[name]).text(f"{path}/{section}/{name}")
    found = manifests.data_files(file_manifest(spark, [f"{path}/{s}" for s in sections]))
    folder = path_fn.relative_key(path_fn.dirname(F.col("path")), F.col("prefix"))
    return found.select(folder.alias("folder"), F.col("length")).groupBy("folder").agg(F.sum("length").alias("bytes"))


def _written_as_files(files: DataFrame) -> None:
    """Write the rows (path, body) as files of these names, inside the tasks."""
    options = storage_options(files.sparkSession)

    def write(batches):
        open_path = storage_opener(options)
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                store, inner = open_path(path)
                store.create_dir(os.path.dirname(inner), recursive=True)
                with store.open_output_stream(inner) as out:
                    out.write(body.encode())
            yield batch.select(["path"])

    files.select("path", "body").mapInArrow(write, "path STRING").write.format("noop").mode("overwrite").save()


def table_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of a part type as tables, defined in files ``<type>/<brand>.json`` that are read back; those of one size are broken."""
    root = qualified(spark, workspace(spark, "definitions"))
    brands = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"))
    body = F.format_string(
        '{\n  "database": "{env}_db",\n  "table": "t%d",\n  "location": "s3://data-{bucket_suffix}/{env}/%s/t%d",\n'
        '  "columns": [{"name": "id", "type": "string"}, {"name": "%s", "type": "int"}]\n}\n',
        "largest", "p_type", "smallest", "p_brand",
    )
    path = F.concat_ws("/", F.lit(root), "p_type", F.concat(F.col("p_brand"), F.lit(".json")))
    _written_as_files(brands.select(path.alias("path"), F.when(F.col("smallest") == 1, "{ broken").otherwise(body).alias("body")))
    found = read_table_defs(spark, root, ["ECONOMY", "SMALL", "LARGE"], None, {"env": "local", "bucket_suffix": "dev"})
    entry = F.col("definition")
    return found.select(
        F.concat_ws("/", path_fn.basename(path_fn.dirname(F.col("path"))), path_fn.basename(F.col("path"))).alias("path"), "name",
        entry["database"].alias("db"), entry["table"].alias("tbl"), entry["location"].alias("location"),
        F.get(entry["columns"], 1)["name"].alias("second_column"), entry.isNotNull().alias("ok"),
    )


def unknown_definition_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as tables, defined in files with fields that the library does not know; some are broken."""
    root = qualified(spark, workspace(spark, "shapes"))
    groups = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_name").alias("first"))
    body = F.format_string(
        '{"table": "t%d", "location": "s3://x/t%d", "owner": {"name": "%s", "teams": [%d, null]}, "tier": %s}',
        "s_nationkey", "s_nationkey", "first", "n", F.when(F.col("s_nationkey") % 2 == 0, F.col("n").cast("string")).otherwise('"low"'),
    )
    path = F.concat_ws("/", F.lit(root), F.lit("gold"), F.concat(F.lit("t"), F.col("s_nationkey"), F.lit(".json")))
    _written_as_files(groups.select(path.alias("path"), F.when(F.col("s_nationkey") % 5 == 4, F.lit("[1")).otherwise(body).alias("body")))
    found = read_table_defs(spark, root, keep_unknown=True)
    shapes = definition_shapes(definition_texts(spark, root)).first()
    return found.select(
        "name", F.col("definition.table").alias("tbl"), F.size("unknown").alias("n_unknown"), F.col("unknown")["owner"].alias("owner"),
        F.col("unknown")["tier"].alias("tier"), F.lit(shapes["broken"]).alias("broken"), F.lit("teams: ARRAY<BIGINT>" in shapes["shape"]).alias("shaped"),
    )


def retained_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of four sizes published one after the other; the first is leased, then released, and the newest two are kept."""
    root = workspace(spark, "retained")
    name = "retained_" + os.path.basename(root).rpartition("-")[2]
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    versions = [publish_recorded(part.filter(F.col("p_size") <= most), name, root) for most in (10, 20, 30, 50)]
    soon = datetime.now() + timedelta(days=1)

    def left() -> list[bool]:
        vacuum_versions(spark, [name], root, newest=2, younger_than=soon, dry_run=False)
        found = manifests.data_files(file_manifest(spark, [root])).select("path")
        return [not found.filter(F.col("path").contains(os.path.basename(v))).isEmpty() for v in versions]

    lease = lease_version(spark, root, versions[0], 3600)
    while_leased, read = left(), spark.read.parquet(versions[0]).count()
    release_version(spark, root, lease)
    released = left()
    checks = {"leased_stays": while_leased == [True, False, True, True], "released_goes": released == [False, False, True, True]}
    rows = spark.table(name).select("p_partkey", "p_name", "p_size")
    return rows.select("*", F.lit(read).cast("bigint").alias("n_leased"), *(F.lit(v).alias(k) for k, v in checks.items()))


def merged_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over line items out of measures of a part per return flag, and whether the columns drift between two flags."""
    items = table(spark, sf_dir, "lineitem")
    own = [
        quality.NonEmpty(), quality.Holds("discounted", F.col("l_discount") <= 0.05), quality.Holds("positive", F.col("l_quantity") > 0),
        quality.Unique(("l_orderkey", "l_linenumber"), "line_unique"), quality.Unique(("l_orderkey",), "order_unique"),
    ]
    parts = {
        flag: saved(measures.measured(items.filter(F.col("l_returnflag") == flag), own, ["l_quantity"]), "measures")
        for flag in sorted(r[0] for r in items.select("l_returnflag").distinct().collect())
    }
    flags = list(parts)
    stacked = parts[flags[0]]
    for flag in flags[1:]:
        stacked = stacked.unionByName(parts[flag])
    report = measures.measured_report(measures.merged_measures(stacked), own)
    steady = not measures.drift(parts[flags[0]], parts[flags[-1]], 0.2).filter("drifted").count()
    text = F.when(~F.col("rule").endswith("_unique"), F.col("message"))
    return report.select("rule", "ok", text.alias("message"), F.lit(steady).alias("steady"))


def status_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority, status and year as a run each, with its pretty-printed status in a file of its own."""
    root = qualified(spark, workspace(spark, "status-files"))
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    groups = orders.groupBy("o_orderpriority", "o_orderstatus", "year").agg(F.min(at).alias("startedAt"), F.max(at).alias("finishedAt"), F.count("*").alias("n"))
    run = F.concat_ws("-", F.lit("jr"), F.substring("o_orderpriority", 1, 1), "o_orderstatus", "year")
    record = groups.select(
        run.alias("id"), F.concat(F.lit("vc-"), F.col("o_orderstatus")).alias("virtualClusterId"), F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("state"), (F.col("n") % 3).cast("int").alias("exitCode"),
        "startedAt", "finishedAt", *(F.lit(None).cast("string").alias(c) for c in run_fn.STATUS_FIELDS[7:10]),
        F.concat(F.lit("/var/logs/"), run, F.lit("/stdout.log")).alias("stdoutLocal"), F.lit(None).cast("string").alias("stderrLocal"),
    )
    fields = F.struct(*run_fn.STATUS_FIELDS)
    path = F.concat_ws("/", F.lit(root), "virtualClusterId", "id", F.lit("status.json"))
    _written_as_files(record.select(path.alias("path"), F.to_json(fields, {"pretty": "true", "ignoreNullFields": "false"}).alias("body")))
    read = read_run_status(spark, f"{root}/*/*")
    return read.select("id", "virtualClusterId", "name", "state", "exitCode", "startedAt", "finishedAt", "logUri", "stdoutLocal")


def cluster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters in JSON, with the customers' orders as their runs."""
    path = workspace(spark, "clusters")
    record = F.struct(
        F.concat(F.lit("vc-"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit("RUNNING").alias("state"),
        F.struct(F.lit("eks").alias("id"), F.lit("EKS").alias("type"), F.struct(F.struct(F.concat(F.lit("ns-"), F.col("n_regionkey")).alias("namespace"))
                 .alias("eksInfo")).alias("info")).alias("containerProvider"),
        (F.col("n_nationkey") * 1.5).cast("double").alias("createdAt"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("tags"),
    )
    table(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(F.to_json(record).alias("value")).write.text(path)
    clusters = saved(read_clusters(spark, path), "clusters")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("vc-"), F.col("c_nationkey")).alias("virtualClusterId"))
    runs_of = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey")
    joined = matching.runs_with_cluster(runs_of, clusters)
    namespaces = clusters.select(
        F.col("id").alias("virtualClusterId"), F.col("containerProvider.info.eksInfo.namespace").alias("namespace"), "createdAt", F.col("tags")["region"].alias("region")
    )
    return joined.join(namespaces, "virtualClusterId", "left").select(
        "o_orderkey", "virtualClusterId", "cluster_name", "cluster_state", "namespace", "createdAt", "region"
    )


def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "registered")
    tag = os.path.basename(path).rpartition("-")[2]
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    overwrite_sink(supplier, path)
    good = f'{{"table": "good_{tag}", "location": "{path}", "columns": [' \
           '{"name": "s_suppkey", "type": "bigint"}, {"name": "s_name", "type": "string"}]}'
    texts = rows_source(
        spark,
        [
            ("gold/a.json", "gold", "a", good),
            ("gold/b.json", "gold", "b", good.replace("good_", "drift_").replace('"string"', '"int"')),
            ("gold/c.json", "gold", "c", "{ not json"),
        ],
        "path STRING, section STRING, name STRING, body STRING",
    )
    outcome = register_batch(spark, resolve_table_defs(texts))
    totals = quality.batch_outcome(outcome).first()
    kept = table_location(spark, f"good_{tag}").endswith(os.path.basename(path))
    return spark.table(f"good_{tag}").select(
        "s_suppkey", "s_name",
        F.lit(totals["failed"]).cast("bigint").alias("failed"), F.lit(totals["exit_code"]).alias("exit_code"), F.lit(kept).alias("kept"),
    )


def _status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished run per order: its cluster is the customer, its times the ordered day and price."""
    orders = table(spark, sf_dir, "orders")
    started = (F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) * 86400).cast("double")
    state = F.element_at(
        F.create_map(*(F.lit(x) for x in ("F", "COMPLETED", "O", "RUNNING", "P", "FAILED"))), F.col("o_orderstatus")
    )
    run = F.concat(F.lit("jr-"), F.col("o_orderkey"))
    local = F.concat(F.lit("/var/logs/"), run)
    remote = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("s3://logs/"), run))
    return orders.select(
        run.alias("id"),
        F.concat(F.lit("vc-"), F.col("o_custkey")).alias("virtualClusterId"),
        F.col("o_orderpriority").alias("name"),
        state.alias("state"),
        F.when(state == "COMPLETED", 0).when(state == "FAILED", 1).cast("int").alias("exitCode"),
        started.alias("startedAt"),
        F.when(state != "RUNNING", started + F.floor("o_totalprice")).alias("finishedAt"),
        F.when(remote.isNotNull(), "s3://logs").alias("logUri"),
        F.concat(remote, F.lit("/stdout.gz")).alias("stdoutS3"),
        F.concat(remote, F.lit("/stderr.gz")).alias("stderrS3"),
        F.concat(local, F.lit("/stdout.log")).alias("stdoutLocal"),
        F.concat(local, F.lit("/stderr.log")).alias("stderrLocal"),
    )


def run_status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "status")
    text = _status_records(spark, sf_dir).select(run_fn.to_status_json().alias("value"))
    text.write.option("compression", "gzip").text(path)
    stats = runs.run_stats(read_run_status(spark, path, one_per_file=False), ["virtualClusterId", "state"])
    return stats.drop("avg_s")


def run_logs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "logs")
    lines = _log_lines(spark, sf_dir).select(
        F.date_format("day", "yyyy-MM").alias("vc_id"), F.col("day").cast("string").alias("jr_id"),
        F.lit("stderr").alias("stream"), F.col("event_id").alias("line_no"), "line",
    )
    write_run_logs(lines, path)
    return runs.failure_summary(read_run_logs(spark, path, scope="stream = 'stderr'"))


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "texts")
    split = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("vc_id"), F.col("source").alias("jr_id"), F.lit("stdout").alias("stream"),
        "doc_id", F.posexplode(log_fn.split_lines(F.col("text"))).alias("pos", "line"),
    )
    # in two batches, the second of which goes on where the first ends
    stored = saved(split, "split-lines")
    half = (stored.agg(F.max("doc_id")).first()[0] or 0) // 2
    early = F.coalesce(F.col("doc_id") <= half, F.lit(False))
    write_run_logs(stored.filter(early), path, ["doc_id", "pos"])
    write_run_logs(stored.filter(~early), path, ["doc_id", "pos"], mode="append")
    return read_run_logs(spark, path, numbered=True).drop("stream")


def offboard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = offboard_tenant(spark, tenant_tables(spark, sf_dir), [TENANT], workspace(spark, "offboard"))
    return report.drop("location")


def cluster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(
        F.concat(F.lit("vc-"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"),
        F.lit("RUNNING").alias("state"),
    )
    run_records = _status_records(spark, sf_dir).select("id", "virtualClusterId", "state")
    joined = matching.runs_with_cluster(run_records, clusters)
    return joined.withColumn("is_terminal", run_fn.is_terminal(F.col("state")))


def cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _status_records(spark, sf_dir).select("id", "virtualClusterId", "state")
    listed = scope.runs_of_cluster(records, "vc-6").select(F.lit("listed").alias("kind"), "id")
    unknown = scope.runs_of_cluster(records, "vc-none").select(F.lit("unknown").alias("kind"), "id")
    found = scope.find_run(records, "vc-899", "jr-0").select(F.lit("found").alias("kind"), "id")
    foreign = scope.find_run(records, "vc-6", "jr-0").select(F.lit("foreign").alias("kind"), "id")
    return listed.unionByName(unknown).unionByName(found).unionByName(foreign)


def run_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = F.when(
        F.col("stdoutS3").isNotNull(),
        F.struct(F.struct(F.struct(F.col("logUri").alias("logUri")).alias("s3MonitoringConfiguration")).alias(
            "monitoringConfiguration")),
    )
    bare = _status_records(spark, sf_dir).select(
        "id",
        F.when(F.col("state") != "FAILED", F.when(F.col("state") == "COMPLETED", F.col("name")).otherwise("")).alias("name"),
        run_fn.log_uri(overrides).alias("log_uri"),
    )
    both = bare.select("id", "log_uri", F.col("name").alias("if_absent"), F.col("name").alias("if_blank"))
    absent = scope.with_defaults(both, {"if_absent": "unnamed"})
    return scope.with_defaults(absent, {"if_blank": "unnamed"}, empty_is_missing=True)


def submit_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.concat(
        F.lit("--conf spark.app.name=run-"), F.col("event_id"), F.lit(" --conf spark.kind="), F.col("event_type"),
        F.lit(" --deploy-mode cluster --conf spark.app.name=again=\""), F.col("props"), F.lit('"'),
    )
    options = run_fn.submit_conf(F.replace(params, F.lit('{"k"'), F.lit("{k")))
    parsed = table(spark, sf_dir, "events").select("event_id", options.alias("options"))
    mapped = parsed.select("event_id", F.size("options").alias("n"), run_fn.conf_map(F.col("options")).alias("conf"))
    return mapped.select(
        "event_id", F.col("n").alias("n_options"),
        F.col("conf")["spark.app.name"].alias("app_name"), F.col("conf")["spark.kind"].alias("kind"),
    )


def state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = _status_records(spark, sf_dir)
    out = run_fn.log_location(F.col("stdoutS3"), F.col("stdoutLocal"))
    err = run_fn.log_location(F.col("stderrS3"), F.col("stderrLocal"))
    summary = F.when(F.col("name") == "5-LOW", F.lit("pkg.StepError: low"))
    return record.select(
        "id",
        run_fn.state_details(F.col("state"), F.col("exitCode"), summary, out, err).alias("details"),
        run_fn.failure_reason(F.col("state"), F.col("exitCode")).alias("reason"),
        F.unix_seconds(run_fn.epoch_to_ts(F.col("startedAt"))).alias("started"),
        run_fn.duration_s(F.col("startedAt"), F.col("finishedAt")).alias("seconds"),
        run_fn.log_object_uri(F.coalesce("logUri", F.lit("s3://other/")), F.col("virtualClusterId"), F.col("id"),
                              F.lit("stderr.gz")).alias("log_object"),
    )


def published_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(path_fn.uri_parts(F.col("url"))["key"].alias("path"))
    return manifests.name_collisions(pages, "local")


def path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", path_fn.uri_parts(F.col("url"))["key"].alias("path"))
    kept = scope.exclude_globs(pages, ["en/*", "*/[1-3]*.html"])
    return scope.match_names(kept, [".html", "/5"])


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = path_fn.uri_parts(F.col("url"))
    name = path_fn.strip_suffix(part["basename"], ".html")
    key = path_fn.object_key(F.lit("local"), F.regexp_extract("url", "://[^/]*/([a-z]*)", 1), name)
    base = F.regexp_extract("url", "^([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", name.alias("name"), key.alias("key"), path_fn.join_uri(base, F.lit("stderr.gz")).alias("log")
    )


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bytes_in = log_fn.decode_utf8_replace(F.encode("text", "UTF-8"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(log_fn.split_lines(bytes_in)).alias("raw"))
    stripped = lines.select("doc_id", log_fn.strip_line(F.col("raw")).alias("line"))
    marked = stripped.select(
        "doc_id", "line", log_fn.is_log4j_line(F.col("line")).alias("chatter"),
        log_fn.is_cause_line(F.col("line")).alias("cause"),
    )
    return marked.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("line") == "").alias("n_blank"),
        F.sum(F.char_length("line")).alias("n_chars"),
        F.count_if("chatter").alias("n_chatter"),
        F.count_if("cause").alias("n_cause"),
    )


def vacuumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace(spark, "vacuum")
    name = "vacuumed_" + os.path.basename(root).rpartition("-")[2]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    publish_version(orders.filter("o_orderstatus = 'F'"), name, root)
    live = publish_version(orders, name, root)
    listed, referenced = file_manifest(spark, [root]), file_manifest(spark, [live])
    newest = listed.agg(F.max("mtime").alias("t")).first()["t"]
    outcome = vacuum_execute(vacuum_plan(listed, referenced, newest), dry_run=False)
    left = manifests.data_files(file_manifest(spark, [root]))
    lost = quality.batch_outcome(outcome).first()["failed"]
    reachable = left.select(F.col("path").contains(live).alias("live")).agg(F.every("live").alias("only_live"))
    only_live = reachable.first()["only_live"]
    return spark.table(name).select("o_orderkey", "o_orderstatus", F.lit(only_live and lost == 0).alias("only_live"))


def _published(df: DataFrame, label: str, partition_by: list[str] | None = None) -> tuple[str, str]:
    """``df`` as a catalogued table of its own: its name and the folder of its versions."""
    root = workspace(df.sparkSession, label)
    name = f"{label}_{os.path.basename(root).rpartition('-')[2]}"
    publish_version(df, name, root, partition_by=partition_by)
    return name, root


def partition_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation and orders by status without a tenant; whether the files of other nations are as they were."""
    customers, customer_root = _published(table(spark, sf_dir, "customer"), "tenant_customers", ["c_nationkey"])
    orders, order_root = _published(table(spark, sf_dir, "orders"), "tenant_orders", ["o_orderstatus"])
    before = saved(manifests.data_files(file_manifest(spark, [customer_root])), "files-before")
    related = [
        tenants.TenantTable(customers, spark.table(customers), tenant_col="c_nationkey", key="c_custkey"),
        tenants.TenantTable(orders, spark.table(orders), parent=customers, fk="o_custkey"),
    ]
    report = {r["tbl"]: r for r in delete_tenants(spark, related, [TENANT], workspace(spark, "tenant-left")).collect()}
    after = manifests.data_files(file_manifest(spark, [customer_root]))
    same = before.exceptAll(after).isEmpty() and report[customers]["n_after"] == 0
    checks = [F.lit(report[t]["partitions"]).alias(n) for t, n in ((customers, "nations"), (orders, "statuses"))]
    left = spark.table(orders).select("o_orderkey", "o_custkey", "o_orderstatus")
    kept = spark.table(customers).select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return left.join(kept, "o_custkey").select("o_orderkey", "o_custkey", "o_orderstatus", "c_nationkey", *checks, F.lit(same).alias("others_untouched"))


def partition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment: those of one segment and a part of the nations move to a new one, some are new."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    name, root = _published(customer, "segments", ["c_mktsegment"])
    before = saved(manifests.data_files(file_manifest(spark, [root])), "files-before")
    moved = customer.filter("c_mktsegment = 'BUILDING' AND c_nationkey < 5").withColumn("c_mktsegment", F.lit("MOVED"))
    new = customer.filter("c_mktsegment = 'MACHINERY'").select(
        (-F.col("c_custkey") - 1).alias("c_custkey"), "c_name", "c_nationkey", F.lit("MOVED").alias("c_mktsegment")
    )
    touched = upsert_table(spark, name, moved.unionByName(new), "c_custkey", root)
    same = before.exceptAll(manifests.data_files(file_manifest(spark, [root]))).isEmpty()
    rows = spark.table(name).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return rows.select("*", F.lit(touched).alias("partitions"), F.lit(same).alias("old_files_untouched"))


def cloned_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer, a table and one partition of a table copied to another environment, over an older copy."""
    source, target = workspace(spark, "env-qa"), workspace(spark, "env-local")
    overwrite_sink(table(spark, sf_dir, "supplier"), f"{source}/qa/gold/supplier")
    overwrite_sink(table(spark, sf_dir, "nation"), f"{source}/qa/gold/nation")
    overwrite_sink(table(spark, sf_dir, "customer"), f"{source}/qa/silver/customer", partition_by=["c_nationkey"], rebalance=True)
    overwrite_sink(table(spark, sf_dir, "region"), f"{source}/qa/silver/region")
    overwrite_sink(table(spark, sf_dir, "region"), f"{target}/local/bronze/left_over")
    wanted = ["qa/gold", f"qa/silver/customer/c_nationkey={TENANT}", "qa/silver/customer/c_nationkey=11", "qa/absent"]
    total = clone_prefixes(spark, source, target, wanted).first()
    listed = manifests.data_files(file_manifest(spark, [target]))
    tables = manifests.table_roots(listed)
    names = [r["path"] for r in tables.toLocalIterator()]
    sums = listed.agg(F.count("*").alias("n"), F.sum("length").alias("b")).first()
    counted = []
    for path in sorted(names):
        rows = spark.read.parquet(path)
        key = F.col(next(c for c in rows.columns if c.endswith("key"))).cast("bigint")
        counted.append(rows.agg(F.lit(path.split("/local/")[-1]).alias("tbl"), F.count("*").alias("n"), F.sum(key).alias("keys")))
    stacked = counted[0]
    for one in counted[1:]:
        stacked = stacked.unionByName(one)
    as_reported = (total["objects"], total["bytes"]) == (sums["n"], sums["b"])
    return stacked.withColumn("as_reported", F.lit(as_reported))


def clustered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in 64 files along a curve through three columns.

    For each column: whether an interval of a sixteenth of its rows meets at most 60 of 100 files, where a
    layout that ignores the column has it meet all of them.
    """
    columns = ["l_orderkey", "l_partkey", "l_shipdate"]
    items = table(spark, sf_dir, "lineitem").select("l_linenumber", *columns)
    stored = overwrite_sink(cluster(items, 64, columns, from_scan=True), workspace(spark, "clustered"))
    rows = stored.select("*", F.col("_metadata.file_name").alias("file"))
    number = {c: F.unix_micros(F.col(c).cast("timestamp")) if c == "l_shipdate" else F.col(c) for c in columns}
    ends = rows.agg(*(F.percentile_approx(number[c], [0.5, 0.5625], 10000).alias(c) for c in columns)).first()
    ranges = rows.groupBy("file").agg(*(f(number[c]).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "low"), (F.max, "high"))))
    met = ranges.agg(
        F.count("*").alias("files"),
        *(F.count_if((F.col(f"low_{c}") <= ends[c][1]) & (F.col(f"high_{c}") >= ends[c][0])).alias(c) for c in columns),
    ).first()
    pruned = [F.lit(met[c] <= 0.6 * met["files"]).alias(f"prunes_{c}") for c in columns]
    return stored.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", *pruned)


def packed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status in a large file and many small ones each; whether the large ones stayed and the others were packed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    large, small = F.col("o_orderkey") % 8 > 0, F.col("o_orderkey") % 8 == 0
    name, root = _published(orders.filter(large).coalesce(1), "packed", ["o_orderstatus"])
    place = table_location(spark, name)
    orders.filter(small).repartition(12).write.mode("append").partitionBy("o_orderstatus").parquet(place)
    spark.catalog.refreshTable(name)
    before = saved(table_files(spark, name), "files-before")
    largest = before.groupBy(path_fn.dirname(F.col("path")).alias("folder")).agg(F.max("length").alias("most"))
    target = largest.agg(F.min("most")).first()[0]
    outcome = pack_table(spark, name, root, target).first()
    after = saved(table_files(spark, name), "files-after")
    kept = before.filter(F.col("length") >= target)
    checks = {
        "large_untouched": kept.exceptAll(after).isEmpty() and not kept.isEmpty(),
        "fewer": after.count() == before.count() - outcome["replaced"] + outcome["packed"] < before.count(),
        "fits": after.join(before, "path", "left_anti").filter(F.col("length") > target * 2).isEmpty(),
    }
    return spark.table(name).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", *(F.lit(v).alias(k) for k, v in checks.items()))


def streamed_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as runs whose events arrive out of order in three batches, a tenth of them twice, with a restart after each."""
    root = workspace(spark, "run-states")
    events = run_events(spark, sf_dir).select(*RUN, "event_id", "event_type")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for i in range(3):
        twice = (part == (i + 2) % 3) & (F.col("event_id") % 10 == 0)
        events.filter((part == i) | twice).write.mode("append").parquet(f"{root}/events")
        arriving = event_stream(spark, f"{root}/events", events.schema)
        stream_run_states(arriving, RUN, "event_id", **_run_event_marks(), root=root).awaitTermination()
    latest = latest_snapshot(spark, root, RUN)
    return latest.select(*RUN, "state", "finished", "exit_code", F.col("events").alias("n"))


def resumed_offboarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a job that is started again with its journal, and whether all files are as the first start left them."""
    root, journal = workspace(spark, "offboard"), workspace(spark, "offboard-journal")
    related = tenant_tables(spark, sf_dir)
    report = offboard_tenant(spark, related, [TENANT], root, journal=journal)
    written = saved(manifests.data_files(file_manifest(spark, [root])), "files-before")
    again = offboard_tenant(spark, related, [TENANT], root, journal=journal)
    same = written.exceptAll(manifests.data_files(file_manifest(spark, [root]))).isEmpty() and report.collect() == again.collect()
    return again.drop("location").withColumn("nothing_twice", F.lit(same))


QUERIES: dict[str, Query] = {
    "q01_range_count": range_count,
    "q02_overwrite_roundtrip": overwrite_roundtrip,
    "q03_scope_filter": scope_filter,
    "q04_partition_clone": partition_clone,
    "q05_manifest_summary": manifest_totals,
    "q06_sync_plan": sync_actions,
    "q07_prefix_remap": prefix_remap,
    "q08_uri_parts": uri_parts,
    "q09_template_resolve": template_resolve,
    "q10_expectations": expectation_report,
    "q11_ordinal_progress": ordinal_progress,
    "q12_batch_outcome": outcome_by_run,
    "q13_parent_autoregister": parent_autoregister,
    "q14_upsert": upsert_actions,
    "q15_tenant_delete": tenant_delete,
    "q16_tenant_recovery": tenant_recovery,
    "q17_compact": compacted_orders,
    "q18_vacuum_plan": vacuum_candidates,
    "q19_latest_state": latest_states,
    "q20_run_state_fold": run_state_fold,
    "q21_failure_summary": failure_summaries,
    "q22_override_last_wins": override_last_wins,
    "q23_run_stats": run_stats,
    "q24_priority_top": priority_top,
    "q25_stream_latest": stream_latest,
    "q26_batch_failures": failures_by_run,
    "q27_publish_version": published_version,
    "q28_list_prefix": prefix_listing,
    "q29_file_manifest": manifest_rows,
    "q30_table_definitions": table_definitions,
    "q31_catalog_roundtrip": catalog_roundtrip,
    "q32_run_status_stats": run_status_stats,
    "q33_run_logs_summary": run_logs_summary,
    "q34_run_log_lines": run_log_lines,
    "q35_offboard_report": offboard_report,
    "q36_cluster_runs": cluster_runs,
    "q37_cluster_lookup": cluster_lookup,
    "q38_run_defaults": run_defaults,
    "q39_submit_options": submit_options,
    "q40_state_texts": state_texts,
    "q41_name_collisions": published_names,
    "q42_path_patterns": path_patterns,
    "q43_object_keys": object_keys,
    "q44_text_lines": text_lines,
    "q45_vacuumed_rows": vacuumed_rows,
    "q46_priority_sorted": priority_sorted,
    "q47_finalised_runs": finalised_run_table,
    "q48_job_run_records": job_run_records,
    "q49_partition_delete": partition_delete,
    "q50_partition_upsert": partition_upsert,
    "q51_clone_prefixes": cloned_prefixes,
    "q52_clustered_items": clustered_items,
    "q53_packed_orders": packed_orders,
    "q54_stream_run_states": streamed_run_states,
    "q55_resumed_offboarding": resumed_offboarding,
    "q56_status_files": status_files,
    "q57_cluster_records": cluster_records,
    "q58_sync_by_ranges": sync_by_ranges,
    "q59_unknown_definition_fields": unknown_definition_fields,
    "q60_retained_versions": retained_versions,
    "q61_merged_expectations": merged_expectations,
}
