"""Literal cases of small rules, specifications and reports."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import chunk, office, text_rules
from millrace.operators import reports, spec


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("rule", "given", "want"),
    [
        (text_rules.complete_api_url, "http://a/v1/", "http://a/v1/chat/completions"),
        (text_rules.complete_api_url, "http://a/chat/completions", "http://a/chat/completions"),
        (text_rules.safe_identifier, "a/b c?é-_.1", "abcé-_.1"),
        (text_rules.content_type, " # x", "Markdown"),
        (text_rules.content_type, "A PDF", "PDF converted content"),
        (text_rules.content_type, "x", "Text"),
        (text_rules.target_type, "2301.12345v2", "arxiv_id"),
        (text_rules.target_type, "", "search_query"),
        (lambda c: text_rules.truncate(c, 4), "abc defg", "abc..."),
        (lambda c: text_rules.truncate(c, 4, False), "abc defg", "abc ..."),
        (text_rules.json_objects, 'x {"a": {"b": 1}} {no} {}', ['{"a": {"b": 1}}', "{}"]),
        (office.titles_as_headers, "Title\nA sentence.\n" + "y" * 60, "## Title\n\nA sentence.\n\n" + "y" * 60),
        (office.scrub, "w:p <b>Hello</b> &lt;i&gt; w:t world zzzzzzzzz\n====%%%%\n\n\n\nok", "p Hello t world z\n\nok"),
        (office.scrub, "short", ""),
        (office.blocks_to_text, "<p>a</p><p>b</p><tr><td>x</td><td>y</td></tr><script>z</script>", "a\nb\nx | y |"),
    ],
)
def test_rules(spark, rule, given, want):
    assert one(spark, rule, given) == want
    assert one(spark, rule, None) is None


def test_byte_sizes(spark):
    for given, want in ((0.0, "0.00B"), (1023.0, "1023.00B"), (1536.0, "1.50KB"), (1024.0**5, "1.00PB"), (1024.0**6, None)):
        assert one(spark, text_rules.byte_size, given, "double") == want


def test_wps_kinds(spark):
    for given, want in ((b"..Microsoft Works", "ms_works"), (office.COMPOUND + b"x", "ole_based"), (b"\x00Kingsoft", "wps_office"), (b"\x05\x75\x05\x35", "generic"), (b"x" * 600 + b"WPS", "generic")):
        assert one(spark, office.wps_kind, bytearray(given), "binary") == want


def test_mht():
    raw = b"Head\n<html><body><h1>T=C3=A9</h1><p>a &amp; b=\nc</p><pre class=3D\"x\"><code>if a &lt; b:\n    c</code></pre><ul><li>one</li></ul></body></html>"
    assert office.mht_to_text(raw) == "Té\n\na & bc\nif a < b:\n    c• one"


def test_code_languages(spark):
    for name, text, want in (("a.TSX", "", "javascript"), ("a.hpp", "", "cpp"), ("a.x", "import os\ndef f", "python"), ("a", "fn x let y", "rust"), ("a", "def x", "generic")):
        got = spark.createDataFrame([(name, text)], "n string, t string").select(chunk.code_language(F.col("n"), F.col("t")).alias("y")).first().y
        assert got == want


SPEC = {
    "servers": [{"url": "http://s"}],
    "security": [{"key": []}],
    "paths": {
        "/pets": {"post": {"operationId": "make", "tags": ["pets"], "requestBody": {"content": {"text/plain": {"schema": {"type": "string"}}, "application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}}},
        "/pets/{id}": {"parameters": [{"name": "id"}], "get": {"x-depends-on": "other", "responses": {"404": {}, "200": {"content": {"a/b": {"schema": {"type": "integer"}}}}}, "security": []}, "trace": {}},
    },
    "components": {"schemas": {"Pet": {"type": "object", "properties": {"name": {"type": "string"}, "parent": {"$ref": "#/components/schemas/Pet"}}}}},
}


def test_specifications(spark):
    got = {r.path: r for r in spec.load(spark, {"a": json.dumps(SPEC), "b": "{", "c": json.dumps(SPEC)}).collect()}
    assert set(got) == {"/pets", "/pets/{id}"}
    assert got["/pets"].identifier == "make" and got["/pets/{id}"].identifier == "get_pets_id"
    assert json.loads(got["/pets"].request)["properties"]["parent"] == {"$ref": "#/components/schemas/Pet"}
    assert got["/pets/{id}"].response == '{"type": "integer"}' and got["/pets/{id}"].security == [] and got["/pets"].security == [{"key": []}]
    assert got["/pets/{id}"].parameters == ["id"] and got["/pets/{id}"].dependencies == ["other"]
    linked = spec.structural_dependencies(spec.load(spark, {"a": json.dumps(SPEC)}))
    assert {r.identifier: r.dependencies for r in linked.collect()} == {"make": [], "get_pets_id": ["other", "make"]}
    assert spec.load(spark, {}).count() == 0


def test_summaries():
    assert spec.summary({"type": "array", "items": {"enum": [1, 2]}}) == "array<enum(1, 2)>"
    assert spec.summary({"oneOf": [{"type": "a"}, {"allOf": [{"type": "b"}, {}]}]}) == "a | b & any"
    assert spec.summary({"properties": {c: {"type": "x"} for c in "abc"}}, 2) == "{a: x, b: x, ... +1 more}"
    assert spec.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.json", "sub/a.yaml", "c.txt"):
        (tmp_path / name).write_text("{}")
    assert [r.path.rpartition("/")[2] for r in spec.discover(spark, str(tmp_path)).collect()] == ["b.json", "a.yaml"]


def test_choices(spark):
    row = spark.sql("select array('404', '201', '200') as s, map('text/x', 'a', 'application/json', 'b') as m, map('text/x', 'a') as n, array('x', 'q') as p, array('a', 'q') as k")
    got = row.select(spec.first_success(F.col("s")), spec.json_first(F.col("m")), spec.json_first(F.col("n")), spec.known_tools(F.col("p"), F.col("k")), spec.known_tools(F.slice("p", 1, 1), F.col("k"))).first()
    assert list(got) == ["201", "b", "a", ["q"], ["a"]]


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "kind string, target string, ok boolean, seconds double")
    got = reports.crawl_metrics(none).first()
    assert (got.total_crawls, got.avg_duration, got.success_rate) == (0, 0.0, 0.0)
    assert reports.batch_summary(none, 0.0).first().files_per_second == 0.0
    assert reports.places(none, ["kind"]).count() == 0


def test_rows_before_in_a_group_of_most_rows(spark):
    rows = [("hot", k, k * 10) for k in range(500)] + [(None, k, k) for k in range(50)] + [(f"g{k % 7}", k, k) for k in range(60)]
    frame = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {(r.g, r.k): r.before for r in reports.previous(frame, "g", ["k"], "v", "before").collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((k, v) for h, k, v in rows if h == g)
        assert [got[g, k] for k, _ in mine] == [None, *[v for _, v in mine[:-1]]]
    assert reports.previous(frame.limit(0), "g", ["k"], "v", "before").count() == 0
