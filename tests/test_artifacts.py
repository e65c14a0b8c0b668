import base64
import hmac
import json
import os
from datetime import UTC, datetime

import pytest

from fieldglass.operators import files, graph, manifest
from fieldglass.operators import schema as L
from fieldglass.plans import pipe_language as K
from fieldglass.sources import envelopes as E


def test_failed_writes_leave_the_old_file_alone(tmp_path):
    path = str(tmp_path / "out.json")
    files.write_atomically(path, [b"old"])

    def broken():
        yield b"new"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        files.write_atomically(path, broken())
    assert open(path).read() == "old" and os.listdir(tmp_path) == ["out.json"]


def test_envelopes_round_trip(spark, tmp_path):
    df = spark.sql("select 'a' as name, 9007199254740993L as n, cast(null as string) as x union all select 'b', 2, 'y'")
    path = str(tmp_path / "e.json")
    files.write_envelope(df, path)
    back = E.read_named(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files.write_lines(df, str(tmp_path / "l.json"))
    assert E.read_ingest(spark, str(tmp_path / "l.json")).count() == 2
    files.write_envelope(df.limit(0), path)
    assert E.read_named(spark, path).columns == ["name", "n", "x"] and E.read_named(spark, path).count() == 0


def test_lower_case_envelope_skips_what_is_no_row(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"schema": [{"name": "a", "type": "Int64"}, {"type": "x"}], "results": [{"a": 1}, 5, {"a": None}]}))
    assert sorted(map(str, E.read_named(spark, str(tmp_path / "e.json")).collect())) == ["Row(a=1)", "Row(a=None)"]


def test_positional_envelopes(spark, tmp_path):
    path = tmp_path / "p.json"
    columns = [{"name": "t", "type": "datetime"}, {"name": "d", "type": "dynamic"}, {"name": "v", "type": "decimal"}]
    good = {"tables": [{"name": "T", "columns": columns, "rows": [["2024-01-02T03:04:05Z", {"k": [1]}, "1.25"], [None, "plain", None]]}]}
    path.write_text(json.dumps(good))
    rows = sorted(E.read_positional(spark, str(path)).collect(), key=str)
    assert str(rows[1].v) == "1.2500000000" and json.loads(rows[1].d) == {"k": [1]} and rows[0].d == "plain" and rows[0].t is None
    for bad in ({"tables": []}, {"tables": [good["tables"][0]] * 2}, good | {"error": {"code": "x"}}, {"tables": [{"columns": columns[:1] * 2, "rows": []}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(E.EnvelopeError):
            E.read_positional(spark, str(path))
    path.write_text(json.dumps({"tables": [{"columns": columns, "rows": [[1]]}]}))
    with pytest.raises(Exception, match="more or fewer"):
        E.read_positional(spark, str(path)).collect()


def test_ingest_files_are_told_apart(spark, tmp_path):
    for i, (text, n) in enumerate([('{"a": 1}', 1), ('[{"a": 1}, {"a": 2}]', 2), ('{"a": 1}\n\n{"a": 2}\n', 2), ('{\n "a": 1\n}', 1), ('{"Results": [{"a": 1}, {"a": 2}]}', 2)]):
        (tmp_path / f"{i}.json").write_text(text)
        assert E.read_ingest(spark, str(tmp_path / f"{i}.json")).count() == n, text
    (tmp_path / "empty.json").write_text("\n")
    with pytest.raises(E.EnvelopeError):
        E.read_ingest(spark, str(tmp_path / "empty.json"))


def test_errors_are_classified(spark, sf):
    assert E.is_size_exceeded(400, "The Result Size exceeded the limit") and not E.is_size_exceeded(500, "result size exceeded")
    assert E.is_table_missing(400, "Table 'Foo' could not be resolved", "Foo") and not E.is_table_missing(400, "Table 'Foo' could not be resolved", "foo")
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert E.retry_delay({"Retry-After": "7"}, "", 1) == 7 and E.retry_delay({}, "please retry in 12 seconds", 1) == 12
    assert [E.retry_delay({}, "", n) for n in (1, 2, 9)] == [30, 60, 900]
    assert E.retry_delay({"retry-after": "Mon, 01 Jan 2024 00:00:30 GMT"}, "", 1, now) == 30
    t = E.Tables(spark, sf)
    assert t.exists("events") and not t.exists("nothing")


def test_schema_inference(spark):
    rows = ['{"a":1,"b":1,"t":"2024-01-01T00:00:00Z","s":"x","o":true,"z@odata.type":"q"}', '{"a":2.5,"b":2,"t":"2024-01-01T00:00:00.5Z","s":null,"o":false}']
    got = {r.name: r.type for r in L.infer(spark.createDataFrame([(x,) for x in rows], "j string"), "j").collect()}
    assert got == {"a": "Double", "b": "Int64", "t": "DateTime", "s": "Dynamic", "o": "Boolean"}
    assert L.merge("Int64", "Double") == "Double" and L.export_type(" TimeSpan ") == "dynamic" and L.key_type("float") is None


def test_schema_script_and_names(spark):
    text = files.schema_script(spark.sql("select 1 as `Device-Name`, 'x' as n"), "T", "M", "f.json")
    assert "T (Device_Name:int, n:string)" in text and "$[''Device-Name'']" in text and 'mapping "M"' in text
    assert files.sidecars("a/b.json") == ("a/b.adx.json", "a/b.adx.kql") and files.default_table("x/1 a.json") == "_1_a"


def test_ingest_replies():
    ok = {"Tables": [{"TableName": "T", "Columns": [{"ColumnName": "ExtentId"}], "Rows": [["1-2"]]}]}
    assert not files.ingest_failures(ok)
    assert files.ingest_failures({"Tables": [{"TableName": "T", "Columns": [{"ColumnName": "extentid"}], "Rows": [["0000-0000"]]}]})
    key, when = base64.b64encode(b"secret").decode(), "2024-01-01T00:00:00Z"
    one = hmac.new(b"secret", b"POST/x", "sha256").digest()
    two = hmac.new(one, when.encode(), "sha256").digest()
    assert base64.b64decode(files.signature(key, when, "post", "/x", b"body")) == hmac.new(two, b"body", "sha256").digest()


def test_graph_shapes(spark):
    rows = spark.createDataFrame([("e1", "s", "S name", "User", ["A", "B"], "t", "T name", "Machine", [], "owns it")], "EdgeId string, SourceNodeId string, SourceNodeName string, SourceNodeLabel string, SourceNodeCategories array<string>, TargetNodeId string, TargetNodeName string, TargetNodeLabel string, TargetNodeCategories array<string>, EdgeLabel string")
    nodes, edges = graph.payload(rows)
    assert {r.id: (r.kinds, r.name) for r in nodes.collect()} == {"s": (["User", "A", "B"], "S name"), "t": (["Machine"], "T name")}
    assert edges.first()["kind"] == "owns_it"
    with pytest.raises(Exception, match="neither"):
        graph.classified(spark.sql("select 'x' as DeviceName")).collect()
    with pytest.raises(graph.GraphError):
        graph.lowered(spark.sql("select 1 as Id, 2 as id"))
    create, update = graph.icon_changes(graph.icons(nodes), spark.sql("select 'User' as kind"))
    assert update.count() == 1 and create.count() == 3


def _entry(**more):
    return {"source": "s", "name": "n", "status": "captured", "rows": 2, "columns": [{"name": "a", "type": "int"}], "file": "f.json", "sha256": "0" * 64, "bytes": 3, "captured_at": "2024-01-01"} | more


@pytest.mark.parametrize(
    "change",
    [{"source": ""}, {"name": None}, {"x": 1}, {"status": "done"}, {"rows": 0}, {"rows": None}, {"rows": "2"}, {"status": "captured_empty"}, {"status": "not_captured"}, {"status": "absent_in_source"}, {"file": None}, {"file": "/abs"}, {"file": "../up"}, {"sha256": "0" * 63}, {"sha256": "G" * 64}, {"bytes": -1}, {"bytes": None}, {"columns": []}, {"columns": [{"name": "", "type": "int"}]}, {"columns": [{"name": "a", "type": "int"}] * 2}, {"note": "why"}, {"window_start": "2024"}, {"window_start": "2025", "window_end": "2024"}, {"captured_at": ""}],
)
def test_manifest_rules(change):
    assert not manifest.broken_rules(_entry())
    assert manifest.broken_rules(_entry(**change))


def test_manifest_upserts_and_modes(tmp_path):
    path, data = str(tmp_path / "m.json"), tmp_path / "f.json"
    data.write_bytes(b"abc")
    m = manifest.Manifest.open(path)
    m.record(_entry(**manifest.describe(str(data), path)))
    m.record(_entry(rows=3, query="T"))
    m.record({"source": "s", "name": "gone", "status": "absent_in_source"})
    with pytest.raises(manifest.ManifestError):
        m.record(_entry(rows=-1))
    m.save(path)
    back = manifest.Manifest.open(path)
    assert [t["name"] for t in back.tables] == ["gone", "n"] and back.tables[1]["rows"] == 3
    with pytest.raises(manifest.ManifestError):
        manifest.Manifest.open(path, True, "k")
    assert manifest.failure_note(ValueError("secret"), True) == "ValueError"
    hidden = manifest.Manifest(True, "k")
    hidden.record(_entry(query="T"))
    assert "query" not in hidden.tables[0]


@pytest.mark.parametrize("text", ["", "events | frob x", "events | where", "events | join kind=outer (orders) on x", "events | extend a = nothing(1)", "events; events", "events | where a == 'open"])
def test_bad_queries(spark, sf, text):
    with pytest.raises(K.QueryError):
        K.query(text, lambda n: spark.read.parquet(f"{sf}/{n}.parquet"))
