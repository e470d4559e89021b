import json
import uuid

import pytest
from pyspark.sql import functions as F

from lakesteward.operators.quality import batch_outcome
from lakesteward.sources import catalog
from lakesteward.sources.definitions import read_table_defs, resolve_table_defs
from lakesteward.sources.sinks import overwrite_sink, publish_version, same_or_nested


@pytest.fixture
def database(spark):
    name = f"db_{uuid.uuid4().hex[:8]}"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def definition(database, table, location, columns=(("id", "string"), ("env", "string")), **kw):
    return catalog.TableDefinition(table, str(location), list(columns), database, **kw)


def test_overwrite_is_idempotent(spark, tmp_path):
    one = spark.createDataFrame([("seed-1", "local")], "id STRING, env STRING")
    for _ in range(2):
        back = overwrite_sink(one, str(tmp_path / "t"))
    assert [tuple(r) for r in back.collect()] == [("seed-1", "local")]
    with pytest.raises(ValueError):
        overwrite_sink(one, str(tmp_path / "t"), replace="some")


def test_overwrite_partitions_only(spark, tmp_path):
    path = str(tmp_path / "p")
    overwrite_sink(spark.createDataFrame([(1, "006"), (2, "007")], "v INT, k STRING"), path, partition_by=["k"])
    new = spark.createDataFrame([(3, "006")], "v INT, k STRING")
    back = overwrite_sink(new, path, partition_by=["k"], replace="partitions")
    assert sorted(map(tuple, back.collect())) == [(2, "007"), (3, "006")]


def test_overlapping_paths():
    assert same_or_nested("s3://b/a", "s3a://b/a/c") and same_or_nested("/a/b/", "file:///a/b")
    assert not same_or_nested("/a/b", "/a/bc") and not same_or_nested("s3://b/a", "s3://c/a")


def test_register_and_read_back(spark, tmp_path, database):
    rows = spark.createDataFrame([("seed-1", "local")], "id STRING, env STRING")
    overwrite_sink(rows, str(tmp_path / "v1"))
    entry = definition(database, "auditlog", tmp_path / "v1", properties={"classification": "it's \\ delta"})
    catalog.register_table(spark, entry)
    catalog.register_table(spark, entry)  # an update keeps the data
    assert spark.table(entry.full_name).count() == 1
    assert catalog.table_location(spark, entry.full_name).endswith("/v1")
    shown = spark.sql(f"SHOW TBLPROPERTIES {entry.full_name}").filter("key = 'classification'").first()["value"]
    assert shown == "it's \\ delta"
    overwrite_sink(rows.union(rows), str(tmp_path / "v2"))
    catalog.register_table(spark, definition(database, "auditlog", tmp_path / "v2"))
    assert spark.table(entry.full_name).count() == 2


def test_drift_is_refused_and_old_entry_survives(spark, tmp_path, database):
    overwrite_sink(spark.createDataFrame([("a", 1)], "id STRING, n INT"), str(tmp_path / "t"))
    catalog.register_table(spark, definition(database, "t", tmp_path / "t", [("id", "string"), ("n", "int")]))
    for columns in ([("id", "string"), ("n", "bigint")], [("id", "string"), ("gone", "int")]):
        with pytest.raises(catalog.SchemaDrift):
            catalog.register_table(spark, definition(database, "t", tmp_path / "t", columns))
    assert spark.table(f"{database}.t").count() == 1


def test_registered_ahead_of_its_data(spark, tmp_path, database):
    catalog.register_table(spark, definition(database, "later", tmp_path / "later"))
    assert spark.table(f"{database}.later").isEmpty()


def test_managed_table_is_not_dropped(spark, tmp_path, database):
    catalog.ensure_database(spark, database)
    spark.range(3).write.saveAsTable(f"{database}.managed")
    with pytest.raises(ValueError, match="managed"):
        catalog.register_table(spark, definition(database, "managed", tmp_path / "x", [("id", "bigint")]))
    assert spark.table(f"{database}.managed").count() == 3


def test_partitioned_table_and_new_version(spark, tmp_path, database):
    catalog.ensure_database(spark, database)
    rows = spark.range(6).select("id", (F.col("id") % 3).cast("int").alias("k"))
    name = f"{database}.parts"
    first = publish_version(rows, name, str(tmp_path), partition_by=["k"])
    assert spark.table(name).count() == 6
    second = publish_version(spark.table(name).filter("k <> 1"), name, str(tmp_path), partition_by=["k"])
    assert first != second and spark.table(name).count() == 4
    assert spark.table(name).filter("k = 1").isEmpty()


def test_publish_reads_and_replaces_the_same_table(spark, tmp_path, database):
    catalog.ensure_database(spark, database)
    name = f"{database}.t"
    publish_version(spark.range(10), name, str(tmp_path))
    publish_version(spark.table(name).filter("id < 4"), name, str(tmp_path))
    assert spark.table(name).count() == 4


def write_defs(root, docs):
    for path, body in docs.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body if isinstance(body, str) else json.dumps(body, indent=2))


def test_definitions_and_batch(spark, tmp_path, database):
    data = tmp_path / "data"
    overwrite_sink(spark.createDataFrame([("a", "b")], "id STRING, env STRING"), str(data / "local" / "good"))
    columns = [{"name": "id", "type": "string"}, {"name": "env", "type": "string"}]

    def body(table, columns=columns):
        return {"database": database, "table": table, "location": str(data) + "/{env}/good", "columns": columns, "note": "{x}"}

    root = tmp_path / "my defs"
    write_defs(root, {
        "gold/good.json": body("good"),
        "silver/good.json": body("good_{bucket_suffix}"),
        "gold/broken.json": "{ not json",
        "gold/drift.json": body("drift", [{"name": "id", "type": "int"}]),
        "gold/deeper/gold/nested.json": body("nested"),
        "gold/readme.txt": "no",
        "other/x.json": body("x"),
    })
    params = {"env": "local", "bucket_suffix": "dev"}
    defs = read_table_defs(spark, str(root), params=params)
    assert sorted((r["section"], r["name"]) for r in defs.collect()) == [
        ("gold", "broken"), ("gold", "drift"), ("gold", "good"), ("silver", "good"),
    ]
    assert read_table_defs(spark, str(root), tables=["good", "nope"], params=params).count() == 2
    assert read_table_defs(spark, str(root), sections=["bronze"]).isEmpty()
    outcome = catalog.register_batch(spark, defs)
    got = [(r["idx"], r["total"], r["path"].rsplit("/", 2)[-2:], r["ok"]) for r in outcome.orderBy("idx").collect()]
    assert got == [
        (1, 4, ["gold", "broken.json"], False), (2, 4, ["gold", "drift.json"], False),
        (3, 4, ["gold", "good.json"], True), (4, 4, ["silver", "good.json"], True),
    ]
    assert tuple(batch_outcome(outcome).first()) == (4, 2, 1)
    assert spark.table(f"{database}.good").count() == 1 and spark.table(f"{database}.good_dev").count() == 1


def test_no_definitions_is_success(spark, tmp_path):
    (tmp_path / "defs").mkdir()
    outcome = catalog.register_batch(spark, read_table_defs(spark, str(tmp_path / "defs")))
    assert tuple(batch_outcome(outcome).first()) == (0, 0, 0)


def test_bad_format_name_is_refused(spark, tmp_path, database):
    with pytest.raises(ValueError):
        catalog.register_table(spark, definition(database, "t", tmp_path, format="parquet OPTIONS (x"))


def test_layout_change_keeps_properties_and_shows_new_rows(spark, tmp_path):
    from lakesteward.sources.catalog import table_location

    name, root = f"layout_{tmp_path.name.replace('-', '_')}", str(tmp_path)
    rows = spark.createDataFrame([(i, i % 2) for i in range(4)], "v INT, k INT")
    publish_version(rows, name, root, partition_by=["k"])
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('owner_team' = 'lake')")
    more = spark.createDataFrame([(i, i % 2) for i in range(10)], "v INT, k INT")
    for layout in ([], ["k"], ["k"], []):
        location = publish_version(more, name, root, partition_by=layout)
        assert spark.table(name).count() == 10
        assert location in table_location(spark, name)
        assert [c.name for c in spark.catalog.listColumns(name) if c.isPartition] == layout
        assert spark.sql(f"SHOW TBLPROPERTIES {name}").filter("key = 'owner_team'").first()["value"] == "lake"


def test_old_entry_comes_back_when_creating_fails(spark, tmp_path, monkeypatch):
    from lakesteward.sources import catalog

    name, root = f"restored_{tmp_path.name.replace('-', '_')}", str(tmp_path)
    publish_version(spark.createDataFrame([(1, 2)], "v INT, k INT"), name, root, partition_by=["k"])
    real, calls = catalog.register_table, []

    def failing(session, definition):
        calls.append(definition)
        if len(calls) == 1:
            session.sql(f"DROP TABLE {name}")
            raise RuntimeError("no catalog")
        real(session, definition)

    monkeypatch.setattr(catalog, "register_table", failing)
    with pytest.raises(RuntimeError, match="no catalog"):
        publish_version(spark.createDataFrame([(3, 4)], "v INT, k INT"), name, root)
    assert [tuple(r) for r in spark.table(name).collect()] == [(1, 2)]


def test_a_column_called_location(spark, tmp_path):
    from lakesteward.sources.catalog import table_location

    name = f"located_{tmp_path.name.replace('-', '_')}"
    location = publish_version(spark.createDataFrame([("x", "y")], "Location STRING, Provider STRING"), name, str(tmp_path))
    assert location in table_location(spark, name)


def test_undeclared_stored_columns_are_drift(spark, tmp_path):
    from lakesteward.sources.catalog import SchemaDrift, TableDefinition, register_table

    spark.range(3).selectExpr("id", "id AS extra").write.parquet(str(tmp_path / "t"))
    with pytest.raises(SchemaDrift, match="extra is stored but not declared"):
        register_table(spark, TableDefinition("drifted", str(tmp_path / "t"), [("id", "bigint")]))


def test_a_hundred_definitions_are_checked_side_by_side(spark, tmp_path, monkeypatch):
    import threading
    import time

    check, running, most, lock, never = catalog.check_drift, [0], [0], threading.Lock(), threading.Event()

    def slow(session, definition):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            if definition.table == "side_50":
                # a job that does not end; it is cancelled by its tag
                session.range(1).select(F.udf(lambda _: time.sleep(600))("id")).collect()
            if definition.table == "side_60":
                never.wait(600)  # cannot be cancelled at all
            time.sleep(0.05)
            check(session, definition)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(catalog, "check_drift", slow)
    overwrite_sink(spark.range(3), str(tmp_path / "data"))
    rows = []
    for i in range(100):
        kind = "STRING" if i % 10 == 3 else "BIGINT"
        body = f'{{"table": "side_{i}", "location": "{tmp_path}/data", "columns": [{{"name": "id", "type": "{kind}"}}]}}'
        rows.append((f"{i:03d}", "gold", f"n{i}", "{ broken" if i % 10 == 7 else body))
    texts = spark.createDataFrame(rows[::-1], "path STRING, section STRING, name STRING, body STRING")
    began = time.monotonic()
    outcome = sorted(catalog.register_batch(spark, resolve_table_defs(texts), threads=8, timeout_s=4.0).collect())
    assert time.monotonic() - began < 120 and most[0] > 1
    assert [(r["idx"], r["total"], r["path"]) for r in outcome] == [(i + 1, 100, f"{i:03d}") for i in range(100)]
    for i, r in enumerate(outcome):
        expected = "SchemaDrift" if i % 10 == 3 else "ValueError" if i % 10 == 7 else "TimeoutError" if i in (50, 60) else None
        assert r["ok"] == (expected is None) and (expected is None or r["error"].startswith(expected)), r
        assert spark.catalog.tableExists(f"side_{i}") == (expected is None)
    never.set()


def test_fields_of_unknown_shape_are_kept(spark):
    from lakesteward.sources.definitions import definition_shapes

    rows = [
        ("a", "gold", "a", '{"table": "t", "location": "l", "owner": {"x": [1, null]}, "n": 1.50, "flag": null}'),
        ("b", "gold", "b", '{"table": "t", "location": "l"}'), ("c", "gold", "c", "{ broken"), ("d", "bronze", "d", '[1, 2]'), ("e", "bronze", "e", None),
    ]
    texts = spark.createDataFrame(rows, "path STRING, section STRING, name STRING, body STRING")
    found = {r["path"]: r for r in resolve_table_defs(texts, keep_unknown=True).collect()}
    assert found["a"]["unknown"] == {"owner": '{"x":[1,null]}', "n": "1.5", "flag": "null"} and found["a"]["definition"]["table"] == "t"
    assert found["b"]["unknown"] == {} and found["c"]["unknown"] is None and found["d"]["unknown"] is None and found["e"]["unknown"] is None
    shapes = {r["section"]: r for r in definition_shapes(texts).collect()}
    assert shapes["gold"]["broken"] == 1 and "owner: OBJECT<x: ARRAY<BIGINT>>" in shapes["gold"]["shape"] and shapes["bronze"]["broken"] == 1
