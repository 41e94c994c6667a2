import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import json as js
from tidewell.functions import numbers as num
from tidewell.functions import text as txt
from tidewell.operators import catalog


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, x, fn, kind="string"):
    return [r[0] for r in values(spark, [(v,) for v in x], f"x {kind}", fn("x"))]


def test_titles(spark):
    rows = [("\n\n# Head \nx", "f.md"), ("Line ##\n", "f.md"), ("  \n", "dir/a.b.txt"), ("", ".hidden"), ("#No", "x")]
    assert [r[0] for r in values(spark, rows, "t string, n string", txt.extract_title("t", "n"))] == ["Head", "Line", "a.b", ".hidden", "#No"]


def test_extensions_and_names(spark):
    assert one(spark, ["A.MD", "a.b.C", "none", ".x"], txt.doc_extension) == [".md", ".c", "", ".x"]
    assert one(spark, ["..", " .a/b:c ", "a|b", "...", "ok"], txt.sanitize_file_name) == ["", "a-b-c", "a-b", "", "ok"]
    assert one(spark, ["  ..MD ", ".", ""], txt.bare_extension) == ["md", None, None]


def test_versions(spark):
    rows = [("1.2.3", "1.2.2"), ("v10.0.0", "9.9.9"), ("abc", "1.0.0"), ("1.2.3-beta", "1.2.3"), ("2", "1.9.9"), ("1.0", "1.0.0")]
    assert [r[0] for r in values(spark, rows, "a string, b string", num.is_newer("a", "b"))] == [True, True, False, False, True, False]
    assert one(spark, ["1.x.3", "a.b", "4.5.6.7"], num.version_parts) == [(1, 3, 0), (0, 0, 0), (4, 5, 6)]


def test_progress_and_limits(spark):
    lines = ["50%", "120 %", "3/4", "7/0 then 9%", "none", "5 of 6", "1 / 3 files"]
    assert one(spark, lines, txt.progress_pct) == [50, 100, 75, 9, None, None, 33]
    assert one(spark, ["1mb", "512 KB", "10b", "123", "x", " 2MB "], txt.body_limit) == [1048576, 524288, 10, 123, 1048576, 2097152]


def test_sizes_round_ties_to_even(spark):
    assert one(spark, [5760, 5770, 1 << 20, 12, 3 << 30], txt.format_size, "long") == ["5.62 KB", "5.63 KB", "1.00 MB", "12 B", "3.00 GB"]


def test_packages(spark):
    rows = [
        ("npx", ["-y", "@s/p@1.0"]), ("npx", ["--", "q[x]"]), ("npx", ["a", "--", "b"]), ("uvx", ["--from", "p==1", "run"]), ("uvx", ["--from=z>2", "run"]), ("uvx", ["-q", "m@latest"]), ("node", ["x"]), ("npx", []),
    ]
    assert [r[0] for r in values(spark, rows, "c string, a array<string>", txt.package_of_command("c", "a"))] == ["@s/p", "q", "a", "p", "z", "m", None, None]


def test_ascii_like_keeps_other_cases(spark):
    rows = [("ÉCLAIR",), ("éclair",), ("a\\b",), ("A%B",)]
    assert [r[0] for r in values(spark, rows, "x string", txt.like_ascii("x", "É"))] == [True, False, False, False]
    assert [r[0] for r in values(spark, rows, "x string", txt.like_ascii("x", "\\"))] == [False, False, True, False]


def test_token_estimate_counts_bytes(spark):
    assert one(spark, ["", "abcd", "abcde", "éé", None], num.token_estimate) == [0, 1, 2, 1, 0]


def test_protocol_versions(spark):
    got = one(spark, ["2024-11-05", "2025-03-26", "2025-06-18", "2025-11-25", "2099-01-01", ""], lambda c: catalog.negotiate(F.col(c)))
    assert got == ["2024-11-05", "2025-03-26", "2025-06-18", "2025-11-25", "2025-03-26", "2025-03-26"]
    tools = spark.createDataFrame([("a", "{}", "{}")], "name string, annotations string, output_schema string")
    assert catalog.shape_for_protocol(tools, "2024-11-05").columns == ["name"] and len(catalog.shape_for_protocol(tools, "2025-06-18").columns) == 3


@pytest.mark.parametrize(
    ("spec", "url"),
    [
        ({"servers": [{"url": "{s}/api/v1", "variables": {"s": {"default": "https://x.example"}}}]}, "https://x.example/api/v1"), ({"servers": [{"url": "https://y.example/v2"}]}, "https://y.example/v2"),
        ({"servers": [{"url": "/rel"}]}, "http://localhost/rel"), ({"host": "h", "basePath": "/b", "schemes": ["http"]}, "http://h/b"), ({"x-base-url": "https://z"}, "https://z"), ({}, None),
    ],
)
def test_base_urls(spec, url):
    assert js.base_url(spec) == url


def test_merge_replaces_all_but_objects():
    assert js.merge({"a": {"b": 1}, "c": [1]}, {"a": {"d": None}, "c": [2]}) == {"a": {"b": 1, "d": None}, "c": [2]}


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_without_empty_is_idempotent(key):
    once = js.without_empty({key: {"x": [], "y": {"z": None}}, "k": 1})
    assert js.without_empty(once) == once == {"k": 1}


def test_slugs_and_names_are_idempotent(spark):
    x = ["Hello, World!", "--a--", "Ünï", "a/b", "", "..x", "C++ & D"]
    assert one(spark, one(spark, x, txt.slugify), txt.slugify) == one(spark, x, txt.slugify)
    assert one(spark, one(spark, x, txt.sanitize_file_name), txt.sanitize_file_name) == one(spark, x, txt.sanitize_file_name)
