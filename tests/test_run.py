import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldglass import __main__ as command
from fieldglass import streaming
from fieldglass.operators import collect, config, files, manifest, paths, run
from fieldglass.operators.vault import Vault
from fieldglass.sources.envelopes import Tables, read_named


def test_a_table_from_end_to_end(spark, sf, tmp_path):
    m, path = manifest.Manifest(), str(tmp_path / "m.json")
    kw = {"record": m, "manifest_path": path}
    p = run.collect_table(Tables(spark, sf), "events", "ts", "14d", datetime(2024, 1, 25), str(tmp_path / "e.json"), limit=200, **kw)
    assert p.buckets and read_named(spark, str(tmp_path / "e.json")).count() == p.total
    assert spark.read.parquet(str(tmp_path / "e.json.parts")).count() == p.total
    assert run.collect_table(Tables(spark, sf), "nothing", "ts", "1d", datetime(2024, 1, 25), str(tmp_path / "n.json"), **kw) is None
    with pytest.raises(Exception):
        run.collect_table(Tables(spark, sf), "orders", "no_column", "1d", datetime(2024, 1, 25), str(tmp_path / "o.json"), **kw)
    run.collect_query(Tables(spark, sf), "customer | take 5", "few", str(tmp_path / "q.json"), **kw)
    got = {t["name"]: t["status"] for t in manifest.Manifest.open(path).tables}
    assert got == {"events": "captured", "nothing": "absent_in_source", "orders": "not_captured", "few": "captured"}


def test_pseudonymised_collection_saves_the_vault(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 2), "ann", "pc1")], "t timestamp, AccountName string, DeviceName string").write.parquet(str(tmp_path / "T.parquet"))
    vault = Vault(b"k" * 32)
    run.collect_table(Tables(spark, str(tmp_path)), "T", "t", "5d", datetime(2024, 1, 5), str(tmp_path / "o.json"), vault=vault, vault_path=str(tmp_path / "v.json"))
    text = (tmp_path / "o.json").read_text()
    assert "ann" not in text and "pc1" not in text and Vault.open(str(tmp_path / "v.json")).get("username", "ann") in text


@pytest.mark.parametrize("with_vault", [False, True])
def test_collections_in_buckets_with_and_without_pseudonyms(spark, tmp_path, with_vault):
    rows = [(datetime(2024, 1, 2), f"user{i}", f"pc{i % 7}.corp.test", i) for i in range(500)]
    spark.createDataFrame(rows, "t timestamp, AccountName string, DeviceName string, n long").write.parquet(str(tmp_path / "T.parquet"))
    vault, out = Vault(b"k" * 32) if with_vault else None, str(tmp_path / "o.json")
    p = run.collect_table(Tables(spark, str(tmp_path)), "T", "t", "5d", datetime(2024, 1, 5), out, limit=60, vault=vault, vault_path=str(tmp_path / "v.json"), sidecars=True)
    assert p.total == 500 and p.buckets > 8 and all(0 < n < 60 for _, n in p.counts)
    parts = spark.read.parquet(out + ".parts")
    assert {r[0]: r[1] for r in parts.groupBy("DumpPartition").count().collect()} == dict(p.counts)
    assert parts.select("n", "AccountName").distinct().count() == 500 and (parts.filter("AccountName = 'user1'").count() == 0) is with_vault
    assert read_named(spark, out).count() == 500 and len((tmp_path / "o.adx.json").read_text().splitlines()) == 500
    assert (tmp_path / "o.adx.kql").read_text().startswith(".create table o (")
    with pytest.raises(collect.CollectionError):  # what was there stays if a check fails
        collect.collect_to(spark.range(3), out + ".parts", collect.Plan(4, None, (), ()))
    assert spark.read.parquet(out + ".parts").count() == 500 and not [x for x in tmp_path.iterdir() if x.name.endswith(".new")]
    with pytest.raises(ValueError):
        files.write_envelope(parts, out, 499)


def test_graph_files_are_written(spark, tmp_path):
    rows = [("a", "User", "Ann", "b", "Machine", "pc", "owns")]
    spark.createDataFrame(rows, "SourceNodeId string, SourceNodeLabel string, SourceNodeName string, TargetNodeId string, TargetNodeLabel string, TargetNodeName string, EdgeLabel string").write.parquet(str(tmp_path / "G.parquet"))
    run.collect_query(Tables(spark, str(tmp_path)), "G | take 5", "g", str(tmp_path / "g.json"), graph_files=True)
    made = json.loads((tmp_path / "g.opengraph.json").read_text())["graph"]
    assert {n["id"]: (n["kinds"], n["properties"]["name"]) for n in made["nodes"]} == {"a": (["User"], "Ann"), "b": (["Machine"], "pc")}
    assert [(e["start"], e["end"], e["kind"]) for e in made["edges"]] == [({"match_by": "id", "value": "a"}, {"match_by": "id", "value": "b"}, "owns")]
    icons = json.loads((tmp_path / "g.opengraph.icons.json").read_text())["custom_types"]
    assert icons == {"Machine": {"icon": {"type": "font-awesome", "name": "desktop", "color": "#2563EB"}}, "User": {"icon": {"type": "font-awesome", "name": "user", "color": "#16A34A"}}}


def test_file_families_paths_and_prose(spark):
    df = spark.createDataFrame([("Run.exe", "C:\\tools\\run.exe", "run --password x RUN.EXE runner", "other.dll")], "FileName string, FolderPath string, ProcessCommandLine string, InitiatingProcessFileName string")
    r = paths.linked_files(df, b"k" * 32).first()
    assert r.FileName.startswith("file-") and r.FolderPath == f"C:\\tools\\{r.FileName}"
    assert r.ProcessCommandLine == f"{r.FileName[:-4]} --password *** {r.FileName} runner" and r.InitiatingProcessFileName != r.FileName
    assert [(s.kind, s.text) for s in paths.path_spans("HomeDirectory", "\\\\srv\\x\\ann\\")] == [("username", "ann")]
    assert [s.text for s in paths.path_spans("FolderPath", "/home/bo/x.txt", True)] == ["bo"]
    assert [s.text for s in paths.embedded_domain_spans("https://a.example.com/x.exe?y=b.test")] == ["a.example.com", "b.test"]
    assert paths.is_prose("Description", "a = b c") and not paths.is_prose("FolderPath", "a b c") and not paths.is_prose("x", "nospace")
    assert [s.text for s in paths.name_spans("The report by Anna Meyer of Blue Corp", frozenset(["Blue Corp"]))] == ["Anna Meyer", "Blue Corp"]
    told = spark.createDataFrame([("h.test", "p.example")], "key string, pseudonym string")
    urls = spark.createDataFrame([("http://H.test:8/x",), ("none",)], "u string")
    assert {x.o for x in paths.rewrite_host(F.col("u"), told, urls, "o").collect()} == {"http://p.example:8/x", "none"}


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / ".env"
    f.write_text("# c\nexport A='x y'\nB=\"q\\\"w\" # note\nC=plain # note\n")
    env = config.load_dotenv(str(f))
    assert env == {"A": "x y", "B": 'q"w', "C": "plain"}
    monkeypatch.setenv("A", "from env")
    assert config.setting("a", None, env, "A") == "from env" and config.setting("a", "given", env, "A") == "given" and config.setting("b", None, env, "B") == 'q"w'
    for bad in ("novalue\n", "A='open\n"):
        f.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load_dotenv(str(f))
    with pytest.raises(config.ConfigError):
        config.read_query("a", "b")
    for bad in ({"table": "t", "query": "q"}, {"lookback": "1d"}, {"irreversible": True}, {"limit": 100_001}, {"limit": 0}, {"table": "t", "out": "a", "vault": "./a"}, {"table": "a b"}, {"table": "t", "lookback": "5w"}, {"source": "hunt", "query": "q"}, {"manifest": "m", "query": "q"}, {"table": "t", "manifest": "m", "manifest_table": "x"}, {"ingest_file": "f", "cluster": "c"}, {"graph_upload": True, "graph_url": "u", "graph_token": "t"}, {"graph_file": "g", "graph_url": "u", "graph_token_id": "i"}, {"table": "t", "vault": "v", "retention": "some"}, {"table": "t", "out": "o.json", "sidecars": True, "manifest": "o.adx.json"}):
        with pytest.raises(config.ConfigError):
            config.check(bad)
    config.check({"table": "t", "lookback": "1d", "limit": 5, "out": "a", "vault": "b"})


def test_commands(spark, tmp_path, capsys):
    rows = [(datetime(2024, 1, 2), f"user{i}", "a", i) for i in range(40)]
    spark.createDataFrame(rows, "t timestamp, AccountName string, note string, n long").write.parquet(str(tmp_path / "T.parquet"))
    at = lambda name: str(tmp_path / name)
    told = ["--folder", str(tmp_path), "--out", at("o.json"), "--vault", at("v.json"), "--manifest", at("m.json")]
    assert command.main([*told, "--table", "T", "--time-column", "t", "--lookback", "5d", "--cutoff", "2024-01-05", "--sidecars"], spark) == 0
    text = (tmp_path / "o.json").read_text()
    assert "user1" not in text and len((tmp_path / "o.adx.json").read_text().splitlines()) == 40 and (tmp_path / "v.json").exists()
    assert manifest.Manifest.open(at("m.json"), True, Vault.open(at("v.json")).key_id).tables[0]["rows"] == 40
    (tmp_path / "q.kql").write_text("T | where n < 3")
    (tmp_path / ".env").write_text(f"FIELDGLASS_FOLDER={tmp_path}\n")
    assert command.main(["--query-file", at("q.kql"), "--dotenv", at(".env"), "--out", at("q.json")], spark) == 0
    assert read_named(spark, at("q.json")).count() == 3
    for bad in (["--query", "T", "--table", "T"], ["--table", "T", "--folder", str(tmp_path), "--out", at("x.json")], ["--query", "T | nonsense", "--folder", str(tmp_path), "--out", at("x.json")]):
        assert command.main(bad, spark) == 1 and "error: " in capsys.readouterr().err


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").repartition(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.collect_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), 4, ["event_id", "event_type"])
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    q = streaming.windowed_counts(stream, "ts", "1 day", "1 hour", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(Count) from counts").first()[0] == events.count()
