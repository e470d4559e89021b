from datetime import date, datetime, time, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lakesteward.operators import tenants
from lakesteward.operators.tenants import TenantTable
from lakesteward.plans.offboard import offboard_tenant
from lakesteward.sources.catalog import table_location
from lakesteward.sources.sinks import publish_version


@pytest.fixture
def tables(spark):
    org = spark.createDataFrame([(1, 6), (2, 6), (3, 7), (4, None), (5, 8)], "id INT, organization_id INT")
    doc = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None), (14, 99)], "doc BIGINT, owner BIGINT")
    line = spark.createDataFrame([(10, "a"), (10, "a"), (12, "b"), (None, "c"), (11, "d")], "doc INT, t STRING")
    return [
        TenantTable("org", org, tenant_col="organization_id", key="id", unique_key=("id",)),
        TenantTable("doc", doc, key="doc", parent="org", fk="owner", unique_key=("doc",)),
        TenantTable("line", line, parent="doc", fk="doc"),
    ]


def rows(frames):
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in frames.items()}


EXPECTED = {
    "org": [(3, 7), (4, None), (5, 8)],
    "doc": [(12, 3), (13, None), (14, 99)],
    "line": [(12, "b"), (None, "c")],
}


@pytest.mark.parametrize("form", ["list", "frame"])
def test_delete_cascades_and_ignores_null_keys(spark, tables, form):
    keys = [6, None, 6, 12345]
    given = keys if form == "list" else spark.createDataFrame([(k,) for k in keys], "k BIGINT")
    assert rows(tenants.tenant_delete(tables, given)) == {k: sorted(v, key=str) for k, v in EXPECTED.items()}


def test_delete_nothing_and_twice(spark, tables):
    whole = rows({t.name: t.df for t in tables})
    assert rows(tenants.tenant_delete(tables, [])) == whole
    assert rows(tenants.tenant_delete(tables, [None])) == whole
    assert rows(tenants.tenant_delete(tables, [8]))["doc"] == whole["doc"]
    once = tenants.tenant_delete(tables, [6])
    again = [TenantTable(t.name, once[t.name], t.tenant_col, t.key, t.parent, t.fk) for t in tables]
    # the second pass no longer knows the deleted parents, and has nothing to delete
    assert rows(tenants.tenant_delete(again, [6])) == rows(once)


def test_many_keys_are_joined(spark, tables, monkeypatch):
    monkeypatch.setattr(tenants, "MAX_LITERAL_KEYS", 0)
    assert rows(tenants.tenant_delete(tables, [6])) == {k: sorted(v, key=str) for k, v in EXPECTED.items()}


@pytest.mark.parametrize("n", [1000, 1001])
@pytest.mark.parametrize("form", ["list", "frame"])
def test_number_and_form_of_keys_change_nothing(spark, n, form):
    def kept(values, kind, column="BIGINT"):
        rows = spark.range(3000).selectExpr(f"CAST(id AS {column}) AS tenant").unionByName(spark.createDataFrame([(None,)], f"tenant {column}"))
        table = [TenantTable("t", rows, tenant_col="tenant")]
        keys = values if form == "list" else spark.createDataFrame([(v,) for v in values], f"k {kind}")
        return {r["tenant"] for r in tenants.tenant_delete(table, keys)["t"].collect()}

    everyone = {None, *range(3000)}
    assert kept([*range(n), None], "BIGINT") == everyone - set(range(n))
    assert kept([str(i) for i in range(n)], "STRING") == everyone - set(range(n))
    assert kept([float(i) for i in range(n)], "DOUBLE") == everyone - set(range(n))
    assert kept([str(i) for i in range(n)], "STRING", "STRING") == {None, *(str(i) for i in range(n, 3000))}
    for values, kind in (
        ([i + 0.5 for i in range(n)], "DOUBLE"), ([*map(str, range(n - 1)), "x"], "STRING"), ([*map(str, range(n - 1)), "1.5"], "STRING"),
        ([*map(float, range(n - 1)), 1e30], "DOUBLE"),
    ):
        with pytest.raises(Exception, match="not exactly"):
            kept(values, kind)
    with pytest.raises(Exception, match="not exactly"):
        kept([*range(n - 1), 2**40], "BIGINT", "INT")


def test_parent_keys_are_compared_in_the_wider_type(spark):
    parent = spark.createDataFrame([(2**32 + 5, 6), (7, 6)], "id BIGINT, org INT")
    child = spark.createDataFrame([(5,), (7,), (None,)], "owner INT")
    tables = [TenantTable("p", parent, tenant_col="org", key="id"), TenantTable("c", child, parent="p", fk="owner")]
    assert rows(tenants.tenant_delete(tables, [6])) == {"p": [], "c": sorted([(5,), (None,)], key=str)}


def test_recovery_of_null_unique_keys_is_idempotent(spark):
    snapshot = spark.createDataFrame([(None, 6), (1, 6), (2, 7)], "id INT, org INT")
    old = TenantTable("t", snapshot, tenant_col="org", unique_key=("id",))
    for current in (snapshot, snapshot.filter("org = 7")):
        for _ in range(2):
            current = tenants.tenant_recovery([TenantTable("t", current, tenant_col="org", unique_key=("id",))], [old], [6])["t"]
            assert sorted(map(tuple, current.collect()), key=str) == sorted(map(tuple, snapshot.collect()), key=str)


def test_recovery_undoes_deletion_and_is_idempotent(spark, tables):
    whole = rows({t.name: t.df for t in tables})
    current = tenants.tenant_delete(tables, [6])
    for _ in range(2):
        as_tables = [TenantTable(t.name, current[t.name], t.tenant_col, t.key, t.parent, t.fk, t.unique_key) for t in tables]
        current = tenants.tenant_recovery(as_tables, tables, [6])
        assert rows(current) == whole


def test_recovery_keeps_newer_rows_of_the_same_key(spark, tables):
    newer = tables[1].df.filter("doc <> 11").withColumn("owner", F.when(F.col("doc") == 10, 77).otherwise(F.col("owner")))
    current = [tables[0], TenantTable("doc", newer, key="doc", parent="org", fk="owner", unique_key=("doc",)), tables[2]]
    got = rows(tenants.tenant_recovery(current, tables, [6]))
    assert (10, 77) in got["doc"] and (10, 1) not in got["doc"] and (11, 2) in got["doc"]


def test_order_of_tables_is_checked(tables):
    with pytest.raises(ValueError, match="parent"):
        tenants.tenant_delete(tables[1:], [6])


def test_offboard_reports_and_repoints(spark, tables, tmp_path):
    catalog = {}
    for t in tables:
        catalog[t.name] = f"offboard_{t.name}"
        publish_version(t.df, catalog[t.name], str(tmp_path / "old" / t.name))
    live = [TenantTable(t.name, spark.table(catalog[t.name]), t.tenant_col, t.key, t.parent, t.fk) for t in tables]
    report = offboard_tenant(spark, live, [6], str(tmp_path / "new"), catalog)
    got = {r["tbl"]: (r["n_before"], r["n_after"], r["n_deleted"]) for r in report.collect()}
    assert got == {"org": (5, 3, 2), "doc": (5, 3, 2), "line": (5, 2, 3)}
    assert rows({n: spark.table(c) for n, c in catalog.items()}) == {k: sorted(v, key=str) for k, v in EXPECTED.items()}
    assert all(f"{tmp_path}/new" in table_location(spark, c) for c in catalog.values())


def test_offboarding_keeps_partitions(spark, tables, tmp_path):
    org = tables[0]
    name = "offboard_parted"
    publish_version(org.df, name, str(tmp_path / "old"), partition_by=["organization_id"])
    live = TenantTable("org", spark.table(name), "organization_id", "id", partition_by=("organization_id",))
    offboard_tenant(spark, [live], [6], str(tmp_path / "new"), {"org": name})
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == sorted([(3, 7), (4, None), (5, 8)], key=str)
    assert [c.name for c in spark.catalog.listColumns(name) if c.isPartition] == ["organization_id"]
    assert not (tmp_path / "new" / "org" / "organization_id=6").exists()


def test_literal_keys_reach_the_scan(spark, sf_dir):
    customer = TenantTable("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"), tenant_col="c_nationkey")
    plan = tenants.tenant_delete([customer], [6])["customer"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PushedFilters: [Or(" in plan


def test_missing_copies(spark, monkeypatch):
    from lakesteward.operators import matching

    monkeypatch.setattr(matching, "COPIES_PER_BLOCK", 3)
    wanted = spark.createDataFrame([(1, None)] * 10 + [(2, "x")] * 2 + [(3, "y"), (None, None)], "a INT, b STRING")
    present = spark.createDataFrame([(1, None)] * 3 + [(2, "x")] * 5 + [(9, "z")], "a INT, b STRING")
    got = sorted(map(tuple, matching.missing_copies(wanted, present).collect()), key=str)
    assert got == sorted([(1, None)] * 7 + [(3, "y"), (None, None)], key=str)
    assert matching.missing_copies(wanted, wanted).isEmpty()


DAY = date(2024, 1, 1)
KINDS = {
    "date": lambda n: [DAY + timedelta(days=i) for i in range(n)],
    "midnight": lambda n: [datetime(2024, 1, 1) + timedelta(days=i) for i in range(n)],
    "noon": lambda n: [datetime(2024, 1, 1, 12) + timedelta(days=i) for i in range(n)],
    "mixed": lambda n: [DAY + timedelta(days=i) if i % 2 else datetime(2024, 1, 1) + timedelta(days=i) for i in range(n)],
    "zoned": lambda n: [datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=i) for i in range(n)],
}
TYPES = {"date": "DATE", "midnight": "TIMESTAMP_NTZ", "noon": "TIMESTAMP_NTZ", "mixed": "TIMESTAMP_NTZ", "zoned": "TIMESTAMP"}


@pytest.mark.parametrize("n", [3, 1000, 1001])
@pytest.mark.parametrize("column", ["DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "STRING"])
@pytest.mark.parametrize("kind", KINDS)
def test_keys_of_dates_and_times(spark, n, column, kind):
    base = spark.range(1500).selectExpr("id", f"CAST(date_add(DATE'2024-01-01', CAST(id AS INT)) AS {column}) AS tenant")
    rows = base.unionByName(spark.createDataFrame([(-1, None)], f"id BIGINT, tenant {column}"))
    table = [TenantTable("t", rows, tenant_col="tenant")]
    keys = KINDS[kind](n)
    moments = [datetime.combine(k, time()) if type(k) is date else k for k in keys]
    frame = spark.createDataFrame([(k if kind == "date" else m,) for k, m in zip(keys, moments)], f"k {TYPES[kind]}")
    wrong = column == "DATE" and kind == "noon"
    for given in ([*keys, None], frame):
        if wrong:
            with pytest.raises(Exception, match="not exactly"):
                tenants.tenant_delete(table, given)["t"].collect()
            continue
        kept = {r["id"] for r in tenants.tenant_delete(table, given)["t"].collect()}
        # text is compared as it is written: a date is spelt differently than a time
        hit = kind != "noon" and (column != "STRING" or kind == "date")
        assert kept == {-1, *range(n if hit else 0, 1500)}


def test_keys_with_and_without_a_zone_do_not_mix(spark):
    table = TenantTable("t", spark.range(1).selectExpr("current_timestamp() AS tenant"), tenant_col="tenant")
    with pytest.raises(tenants.InexactKey):
        tenants.listed_keys([datetime(2024, 1, 1), datetime(2024, 1, 1, tzinfo=timezone.utc)], table)


class Killed(BaseException):
    pass


@pytest.mark.parametrize("form", ["list", "frame"])
def test_offboarding_goes_on_from_its_journal(spark, tables, tmp_path, monkeypatch, form):
    from lakesteward.plans import offboard
    from lakesteward.plans.journal import Journal

    record, write = Journal.record, offboard.overwrite_sink
    written, left = [], [0]

    def counted(df, path, **options):
        written.append(path)
        return write(df, path, **options)

    def killed(self, place, result):
        if not left[0]:
            raise Killed  # the work of the step is done, its record is not written
        left[0] -= 1
        record(self, place, result)

    monkeypatch.setattr(offboard, "overwrite_sink", counted)
    catalog = {}
    for t in tables:
        catalog[t.name] = f"journal_{form}_{t.name}"
        publish_version(t.df, catalog[t.name], str(tmp_path / "old" / t.name))
    keys = [6] if form == "list" else spark.createDataFrame([(6,)], "k INT")

    def start():
        live = [TenantTable(t.name, spark.table(catalog[t.name]), t.tenant_col, t.key, t.parent, t.fk) for t in tables]
        return offboard_tenant(spark, live, keys, str(tmp_path / "new"), catalog, str(tmp_path / "journal"))

    with monkeypatch.context() as patched:
        patched.setattr(Journal, "record", killed)
        for finished in range(20):
            # each start finishes one more step than the one before, and dies in the next
            left[0] = 1 if finished else 0
            try:
                report = start()
                break
            except Killed:
                pass
    got = {r["tbl"]: (r["n_before"], r["n_after"], r["n_deleted"]) for r in report.collect()}
    assert got == {"org": (5, 3, 2), "doc": (5, 3, 2), "line": (5, 2, 3)}
    assert rows({n: spark.table(c) for n, c in catalog.items()}) == {k: sorted(v, key=str) for k, v in EXPECTED.items()}
    # a table is written again only by the start after the one that died before it could record it
    assert all(written.count(str(tmp_path / "new" / t.name)) == 2 for t in tables)
    written.clear()
    assert start().collect() == report.collect() and written == []
    with pytest.raises(offboard.OtherRequest):
        offboard_tenant(spark, tables[:1], keys, str(tmp_path / "new"), catalog, str(tmp_path / "journal"))
