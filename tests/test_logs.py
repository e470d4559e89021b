import gzip

import pytest
from pyspark.sql import functions as F

from lakesteward.functions import logs
from lakesteward.operators.runs import failure_summary
from lakesteward.plans.queries import run_log_lines
from lakesteward.sources.run_records import read_run_logs
from lakesteward.sources.sinks import write_run_logs

LINE_ENDS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def test_split_lines_agrees_with_python(column):
    texts = ["", "a", "\n", "a\n\nb\n", "\r\n\r\n", "x\r\x1cy", "é\u2028ü\u2028", "a\n\r\n"]
    texts += [f"a{e}b{e}" for e in LINE_ENDS] + [f"{e}{e}z" for e in LINE_ENDS]
    assert column(texts, logs.split_lines) == [t.splitlines() for t in texts]


def test_strip_line_agrees_with_python(column):
    lines = ["\t a b \t", "\x1c\x1fx\xa0\u3000", "\u2003é\u200a", "", " \t ", "a\u200b"]
    assert column(lines, logs.strip_line) == [x.strip() for x in lines]


def test_decode_replaces_invalid_bytes(column):
    data = [b"ok", b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x92\xa9", b"\xc3\xa9\xc3", b"\xed\xa0\x80"]
    got = column([bytearray(b) for b in data], logs.decode_utf8_replace, "BINARY")
    assert got[:2] == ["ok", "a\ufffdb"]
    assert got[3] == "\U0001f4a9"
    assert got[4] == "é\ufffd"
    assert got[2].strip("\ufffd") == "" and got[5].strip("\ufffd") == ""


def test_is_cause_line(column):
    cases = {
        "a.b.FooError: x": True,
        "xError": True,
        "java.lang.IllegalStateException": True,
        "pkg.Inner$Failure: why": True,
        "StageFailed": True,
        "ÉException": True,
        "²Error": True,
        "Caused by: y": True,
        "Some Error": False,
        "Error in x": False,
        "FooErrors": False,
        "caused by: y": False,
        "25/05/08 12:34:56 ERROR FooError": False,
        "": False,
    }
    assert column(list(cases), logs.is_cause_line) == list(cases.values())


def summarise(spark, text):
    rows = [(1, i, line) for i, line in enumerate(text.splitlines())] or [(1, 0, "")]
    lines = spark.createDataFrame(rows, "run INT, at INT, line STRING")
    return failure_summary(lines, run_key=["run"], order="at").first()["summary"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", ""),
        ("25/05/08 12:34:56 ERROR x\n25/05/08 12:34:57 WARN y", ""),
        ("a.b.FooError: x\nCaused by: y", "Caused by: y"),
        ("Caused by: y\na.b.FooError: x", "a.b.FooError: x"),
        ("\ta.FooError: tab\n   \nnoise", "a.FooError: tab"),
        ("Some Error\nplain", ""),
    ],
)
def test_failure_summary(spark, text, expected):
    assert summarise(spark, text) == expected


def test_failure_summary_keeps_runs_without_logs(spark):
    lines = spark.createDataFrame([("a", 0, "xError")], "run STRING, at INT, line STRING")
    runs = spark.createDataFrame([("a",), ("b",)], "run STRING")
    got = failure_summary(lines, runs, ["run"], "at").collect()
    assert {r["run"]: r["summary"] for r in got} == {"a": "xError", "b": ""}


def test_logs_round_trip_in_order_across_many_files(spark, tmp_path):
    # one run holds nearly all lines and is written by several tasks
    lines = (
        spark.range(20000)
        .select(
            F.lit("vc-1").alias("vc_id"),
            F.when(F.col("id") % 50 == 0, F.concat(F.lit("00"), F.col("id") % 3)).otherwise("hot").alias("jr_id"),
            F.lit("stderr").alias("stream"),
            F.col("id").alias("line_no"),
            F.concat(F.lit("line "), F.col("id")).alias("line"),
        )
        .repartition(7)
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_run_logs(lines, str(tmp_path / "logs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "logs").glob("vc_id=vc-1/jr_id=hot/stream=stderr/*/*.gz"))) > 1
    back = read_run_logs(spark, str(tmp_path / "logs"), numbered=True).collect()
    expected = {}
    for row in sorted(lines.collect(), key=lambda r: r["line_no"]):
        expected.setdefault(row["jr_id"], []).append(row["line"])
    got = {}
    for row in sorted(back, key=lambda r: r["line_no"]):
        got.setdefault(row["jr_id"], []).append((row["line_no"], row["line"]))
    assert got == {run: list(enumerate(texts, start=1)) for run, texts in expected.items()}


def test_driver_layout_and_raw_bytes(spark, tmp_path):
    folder = tmp_path / "vc-1" / "jobs" / "jr-9" / "containers" / "spark-jr-9" / "spark-jr-9-driver"
    folder.mkdir(parents=True)
    (folder / "stderr.gz").write_bytes(gzip.compress(b"one\r\ntwo\rbad\xffbyte\n\nCaused by: z\n25/05/08 12:34:56 INFO x\n"))
    (folder / "stdout.gz").write_bytes(gzip.compress(b"fooError\n"))
    read = read_run_logs(spark, str(tmp_path), layout="driver", scope="stream = 'stderr'")
    numbered = read_run_logs(spark, str(tmp_path), layout="driver", scope="stream = 'stderr'", numbered=True).orderBy("line_no").collect()
    assert [r["line"] for r in numbered] == ["one", "two", "bad\ufffdbyte", "", "Caused by: z", "25/05/08 12:34:56 INFO x"]
    assert {(r["vc_id"], r["jr_id"], r["stream"]) for r in numbered} == {("vc-1", "jr-9", "stderr")}
    assert failure_summary(read).first()["summary"] == "Caused by: z"
    everything = read_run_logs(spark, str(tmp_path), layout="driver")
    assert failure_summary(everything).first()["summary"] == "Caused by: z"
    assert failure_summary(everything, stream="stdout").first()["summary"] == "fooError"


def test_uncompressed_log_read_in_several_ranges(spark, tmp_path):
    folder = tmp_path / "vc_id=a" / "jr_id=007" / "stream=stdout"
    folder.mkdir(parents=True)
    texts = [f"{i:06d} " + "x" * (i % 90) for i in range(30000)]
    (folder / "part-00000-x.txt").write_text("\n".join(texts) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        read = read_run_logs(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 2
        got = read_run_logs(spark, str(tmp_path), numbered=True).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in got] == texts
    assert got[0]["line_no"] == 1 and got[-1]["line_no"] == len(texts) and got[0]["jr_id"] == "007"


def test_appended_lines_follow_and_filtered_ones_keep_their_numbers(spark, tmp_path):
    def lines(label, n):
        return spark.range(n).selectExpr("'v c+%' AS vc_id", "'j' AS jr_id", "'stderr' AS stream", "id AS line_no", f"concat('{label}', id, 'Error') AS line").repartition(3)

    root = str(tmp_path / "logs")
    write_run_logs(lines("L", 30), root)
    write_run_logs(lines("M", 5), root, mode="append")
    read = read_run_logs(spark, root, numbered=True)
    expected = [f"L{i}Error" for i in range(30)] + [f"M{i}Error" for i in range(5)]
    assert [(r["line_no"], r["line"], r["vc_id"]) for r in read.orderBy("line_no").collect()] == [(i, x, "v c+%") for i, x in enumerate(expected, 1)]
    assert [(r["line_no"], r["line"]) for r in read.filter("line LIKE '%9Error'").orderBy("line_no").collect()] == [(10, "L9Error"), (20, "L19Error"), (30, "L29Error")]
    assert failure_summary(read_run_logs(spark, root)).first()["summary"] == "M4Error"
    folder = tmp_path / "driver" / "v%20c+1" / "jobs" / "j" / "containers" / "spark-j" / "spark-j-driver"
    folder.mkdir(parents=True)
    (folder / "stderr.gz").write_bytes(gzip.compress(b"x\n"))
    assert read_run_logs(spark, str(tmp_path / "driver"), layout="driver").first()["vc_id"] in ("v c+1", "v%20c+1")


def test_numbering_moves_no_line(spark, tmp_path):
    rows = spark.range(2000).selectExpr("'a' AS vc_id", "'j' AS jr_id", "'stderr' AS stream", "id AS line_no", "repeat(cast(id as string), 50) AS line")
    write_run_logs(rows, str(tmp_path / "logs"))
    plan = read_run_logs(spark, str(tmp_path / "logs"), numbered=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_run_log_lines_of_a_document_without_id(spark, tmp_path):
    rows = [(1, "a\nb"), (9, "c"), (None, "d\ne")]
    documents = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["line"] for r in run_log_lines(spark, str(tmp_path)).collect()) == ["a", "b", "c", "d", "e"]
