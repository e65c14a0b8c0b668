import ipaddress
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import scalar as S
from fieldglass.operators import files
from fieldglass.plans import pipe_language as K
from fieldglass.sources import transport as T


class Fake:
    """Replies in order; requests are kept."""

    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def __call__(self, method, url, headers, body):
        self.seen.append((method, url, headers, body))
        return self.replies.pop(0)


def reply(value, code=200, **headers):
    return T.Reply(code, json.dumps(value).encode(), headers)


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"] or 0))
            seen.append((self.path, dict(self.headers), body))
            self.send_response(404 if self.path == "/missing" else 200)
            self.end_headers()
            self.wfile.write(b'{"Tables": [{"TableName": "T", "Columns": [{"ColumnName": "ExtentId"}], "Rows": [["1-2"]]}]}')

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_throttled_queries_wait_and_come_back(spark):
    waits = []
    send = Fake(reply({}, 429, **{"Retry-After": "7"}), reply({"m": "retry after 3 seconds"}, 429), reply({}, 429), reply({"Schema": [{"Name": "n", "Type": "Int64"}], "Results": [{"n": 1}, {"n": 2}]}))
    assert [r.n for r in T.hunt(spark, send, "http://h", "tok", "T | take 2", waits.append).orderBy("n").collect()] == [1, 2]
    assert waits == [7.0, 3.0, 120.0] and {x[1] for x in send.seen} == {"http://h/security/runHuntingQuery"}
    assert send.seen[0][2]["Authorization"] == "Bearer tok" and json.loads(send.seen[3][3]) == {"Query": "T | take 2"}
    with pytest.raises(T.RequestError) as e:
        T.hunt(spark, Fake(reply({"e": "no"}, 400)), "http://h", "", "T")
    assert e.value.code == 400


def test_workspace_queries_ask_for_time(spark):
    send = Fake(reply({"tables": [{"columns": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}], "rows": [[1, "x"], [2, None]]}]}))
    assert {tuple(r) for r in T.workspace(spark, send, "http://h/w/query", "t", "T").collect()} == {(1, "x"), (2, None)}
    assert send.seen[0][2]["Prefer"] == "wait=600"


def test_tables_are_made_and_bad_replies_are_errors(spark):
    df, send = spark.sql("select 1L as `a-b`, 'x' as c"), Fake(reply({"Tables": []}), T.Reply(200, b"not json"))
    T.ensure_table(send, "http://c", "db", "t", "T", "T_json", df)
    assert [json.loads(x[3])["csl"] for x in send.seen] == files.table_commands(df, "T", "T_json") and send.seen[0][1] == "http://c/v1/rest/mgmt"
    with pytest.raises(T.RequestError):
        T.manage(Fake(reply({"Tables": [{"TableName": "Exceptions", "Columns": [], "Rows": [["x"]]}]})), "c", "d", "", ".show")
    empty = {"Tables": [{"TableName": "T", "Columns": [{"ColumnName": "ExtentId"}], "Rows": [["0000-00"]]}]}
    T.manage(Fake(reply(empty)), "c", "d", "", ".show tables")  # only an ingest has extents
    with pytest.raises(T.RequestError):
        T.manage(Fake(reply(empty)), "c", "d", "", ".ingest inline into table T <|")


def test_rows_are_sent_by_their_tasks(spark, server):
    url, seen = server
    df = spark.range(0, 1203, 1, 3).select("id", F.when(F.col("id") % 2 == 0, "é").alias("t"))
    assert T.ingest(T.http, url, "db", "tok", "T", "it's", df, 250) == (6, 1203)
    lines = [json.loads(x) for _, _, body in seen for x in json.loads(body)["csl"].split("<|\n", 1)[1].splitlines()]
    assert sorted(x["id"] for x in lines) == list(range(1203)) and lines[0].keys() == {"id", "t"}
    assert "ingestionMappingReference='it''s'" in json.loads(seen[0][2])["csl"]
    assert T.ingest(T.http, url, "db", "tok", "T", "m", df.limit(0)) == (0, 0)
    assert T.http("POST", url + "/missing", {}, b"").code == 404


def test_graph_files_and_icons_are_sent(tmp_path):
    path = tmp_path / "g.json"
    path.write_text("{}")
    send = Fake(reply({"data": {"id": 42}}), reply({}), reply({}))
    key = "c2VjcmV0"
    assert T.GraphService(send, "http://g/", token_id="id", token_key=key).upload(str(path)) == 42
    assert [x[1] for x in send.seen] == ["http://g/api/v2/file-upload/start", "http://g/api/v2/file-upload/42", "http://g/api/v2/file-upload/42/end"]
    h = send.seen[1][2]
    assert h["Signature"] == files.signature(key, h["RequestDate"], "POST", "/api/v2/file-upload/42", b"{}") and h["X-File-Upload-Name"] == "g.json" and h["Authorization"] == "bhesignature id"
    icon = {"icon": {"type": "font-awesome", "name": "user", "color": "#16A34A"}}
    send = Fake(reply({"data": [{"kindName": "A b"}, {"kindName": "Z"}]}), reply({}), reply({}))
    assert T.GraphService(send, "http://g", token="t").icons({"A b": icon, "New": icon}) == (1, 1)
    assert [(x[0], x[1]) for x in send.seen][1:] == [("POST", "http://g/api/v2/custom-nodes"), ("PUT", "http://g/api/v2/custom-nodes/A%20b")]
    assert json.loads(send.seen[1][3]) == {"custom_types": {"New": icon}} and json.loads(send.seen[2][3]) == {"config": icon}
    for bad in (reply({}, 500), reply({"data": {}})):
        with pytest.raises(T.RequestError):
            T.GraphService(Fake(bad), "http://g", token="t").upload(str(path))
    with pytest.raises(ValueError):
        T.GraphService(send, "http://g")


def test_addresses_agree_with_the_library(spark):
    texts = ["::", "::1", "1::", "fe80::1%eth0", "[2001:db8::8:800:200c:417a]", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "::ffff:1.2.3.4", "::ffff:1.2.3.400", "12345::", ":1", "1:", "g::", "1.2.3.4", "256.1.1.1", "1.2.3", "", "x", "1:2:3:4:5:6:1.2.3.4", "10:30"]

    def known(text):
        try:
            return bool(ipaddress.ip_address(text.strip("[]")))
        except ValueError:
            return False

    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", S.is_ip(F.col("t"))).collect()}
    assert got == {t: known(t) for t in texts} | {None: False}


def test_arrival_times_need_a_column(spark):
    with pytest.raises(K.QueryError):
        K.query("T | where ingestion_time() > datetime(2024-01-01)", lambda n: spark.range(1))
