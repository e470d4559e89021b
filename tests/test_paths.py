import pytest
from pyspark.sql import functions as F

from lakesteward.functions import paths
from lakesteward.functions.templates import resolve_template


def test_normalize_scheme_changes_the_prefix_only(column):
    given = ["s3://b/k", "s3a://b/k", "gs://b/s3://k", "x s3://b"]
    assert column(given, paths.normalize_scheme) == ["s3a://b/k", "s3a://b/k", "gs://b/s3://k", "x s3://b"]


def test_remap_prefix(column):
    given = ["qa/gold", "qa", "qaX/gold", "common", "a/qa/b", None]
    expected = ["local/gold", "local", "qaX/gold", "common", "a/qa/b", None]
    assert column(given, lambda c: paths.remap_prefix(c, "qa", "local")) == expected


def test_names(column):
    assert column(["a/b/c.json", "c.json"], paths.basename) == ["c.json", "c.json"]
    assert column(["a/b/c.json"], paths.dirname) == ["a/b"]
    stripped = column(["t.json", "t.json.bak", "a.jsonx", "xjson", ".json"], lambda c: paths.strip_suffix(c, ".json"))
    assert stripped == ["t", "t.json.bak", "a.jsonx", "xjson", ""]
    assert column(["x/y/conf.py"], lambda c: paths.flatten_name(c, "local")) == ["local_conf.py"]


def test_join_uri_adds_one_slash_if_missing(column):
    assert column(["s3://b/logs", "s3://b/logs/"], lambda c: paths.join_uri(c, F.lit("x"))) == ["s3://b/logs/x"] * 2


def test_object_key(column):
    key = column(["t.json"], lambda c: paths.object_key(F.lit("local"), F.lit("gold"), c))
    assert key == ["local/ddl/configs/gold/t.json"]


def test_uri_parts(column):
    given = ["s3://bucket/a b/c.gz", "S3A://bucket//k", "https://h.example:80/x/y?q=1#f", "s3://bucket", "plain/path"]
    got = column(given, paths.uri_parts)
    assert [tuple(r) for r in got] == [
        ("s3", "bucket", "a b/c.gz", "c.gz"),
        ("s3a", "bucket", "k", "k"),
        ("https", "h.example:80", "x/y", "y"),
        ("s3", "bucket", "", ""),
        ("", "", "", ""),
    ]


def test_canonical_path(column):
    given = ["/a/b", "file:/a/b", "file:///a/b", "s3a://b/k", "s3://b/k", "hdfs://n/a"]
    assert column(given, paths.canonical_path) == ["/a/b"] * 3 + ["s3://b/k"] * 2 + ["hdfs://n/a"]


def test_relative_key(column):
    assert column(["/r/a/b", "/r/a/c/d"], lambda c: paths.relative_key(c, F.lit("/r/a/"))) == ["b", "c/d"]


@pytest.mark.parametrize(
    ("glob", "hits", "misses"),
    [
        ("*/__pycache__/*", ["a/__pycache__/x.pyc", "a/b/__pycache__/c/d"], ["__pycache__/x", "a/__pycache__"]),
        ("resources/*", ["resources/a", "resources/a/b"], ["x/resources/a", "resources"]),
        ("a?c.[ch]", ["abc.c", "axc.h"], ["ac.c", "abc.d", "abcxc"]),
        ("v[!0-9].py", ["va.py"], ["v1.py", "vapy"]),
        ("a+(b).txt", ["a+(b).txt"], ["aab.txt"]),
    ],
)
def test_globs(column, glob, hits, misses):
    assert column(hits + misses, lambda c: c.rlike(paths.glob_to_regex(glob))) == [True] * len(hits) + [False] * len(misses)


def test_resolve_template(column):
    text = "{env}/{env}/{other}/{bucket_suffix}"
    got = column([text], lambda c: resolve_template(c, {"env": "a/b", "bucket_suffix": "$1\\n"}))
    assert got == ["a/b/a/b/{other}/$1\\n"]
