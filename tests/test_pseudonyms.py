import hashlib
import hmac
import json
import os
import stat
import time

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import digest as D
from fieldglass.operators import allocate as A
from fieldglass.operators import command_lines as M
from fieldglass.operators import pseudonyms as P
from fieldglass.operators import recognise as N
from fieldglass.operators import resource_ids as I
from fieldglass.operators import rows as rows_module
from fieldglass.operators import vault as vault_module
from fieldglass.operators.policy import FieldPolicy, default_fields, field_kind, field_kind_in
from fieldglass.operators.vault import Vault, VaultError

SEED = b"0123456789abcdef0123456789abcdef"


def test_native_digest_is_hmac(spark):
    got = spark.sql("select ' Zoë  Q ' as x").select(D.entity_digest(SEED, "person", F.col("x"), 3)).first()[0]
    assert got == hmac.new(SEED, "person\0zoë q\x003".encode(), hashlib.sha256).hexdigest()


def test_ten_thousand_names_get_distinct_pseudonyms(spark):
    df = spark.range(10_000).select(F.concat(F.lit("person "), "id").alias("n"))
    out = A.allocate(A.entities(df, "n"), "person", SEED)
    r = out.agg(F.count("*"), F.countDistinct(F.lower("pseudonym")), F.sum(F.when(F.col("attempt") == 0, 1))).first()
    assert r[0] == r[1] == 10_000 and 500 < r[2] <= 1024


def test_allocation_does_not_depend_on_order_and_respects_taken(spark):
    df = spark.range(200).select(F.concat(F.lit("h"), "id").alias("n"))
    one = {r.key: r.pseudonym for r in A.allocate(A.entities(df, "n"), "organization", SEED).collect()}
    two = {r.key: r.pseudonym for r in A.allocate(A.entities(df.orderBy(F.desc("n")).repartition(7), "n"), "organization", SEED).collect()}
    assert one == two
    taken = spark.createDataFrame([(next(iter(one.values())).upper(),)], "pseudonym string")
    assert next(iter(one.values())) not in {r.pseudonym for r in A.allocate(A.entities(df, "n"), "organization", SEED, taken).collect()}


def test_public_addresses_run_out_with_an_error(spark):
    df = spark.range(3).select(F.concat(F.lit("8.8.8."), "id").alias("n"))
    assert A.allocate(A.entities(df, "n"), "ip_address", SEED).select("pseudonym").distinct().count() == 3
    with pytest.raises(A.AllocationError):
        A.allocate(A.entities(spark.range(40).select(F.concat(F.lit("x"), "id").alias("n")), "n"), "phone", SEED, attempts=1)


def test_composite_values_share_parts_and_originals_vanish(spark):
    rows = [("alice", "alice@corp.test", "CORP\\alice", "pc1.corp.test", "10.1.2.3", "hello alice"), ("bob", "bob@corp.test", "CORP\\bob", "pc2", "8.8.8.8", None)]
    df = spark.createDataFrame(rows, "AccountName string, AccountUpn string, TargetAccount string, DeviceName string, RemoteIP string, note string")
    vault = Vault(SEED)
    out = {r.note: r for r in P.pseudonymise(df, FieldPolicy("*accountname,*upn,targetaccount,*devicename,remoteip"), vault).collect()}
    a = out["hello alice"]
    assert a.AccountUpn.split("@")[0] == a.AccountName == a.TargetAccount.split("\\")[1]
    assert a.DeviceName.split(".", 1)[1] == a.AccountUpn.split("@")[1]
    assert a.RemoteIP.startswith("10.203.") and out[None].RemoteIP.rsplit(".", 1)[0] in ("192.0.2", "198.51.100", "203.0.113")
    assert not any(x in json.dumps([v for k, v in r.asDict().items() if k != "note"]) for r in out.values() for x in ("alice", "bob", "corp.test", "pc1"))
    again = {r.note: r for r in P.pseudonymise(df.orderBy(F.desc("AccountName")), FieldPolicy("*accountname,*upn,targetaccount,*devicename,remoteip"), vault).collect()}
    assert again == out


def test_families_link_users_across_rows(spark):
    df = spark.createDataFrame([("jo", "j.doe@x.test"), ("j.doe", "joe@x.test")], "AccountName string, AccountUpn string")
    got = P.pseudonymise(df, FieldPolicy("*accountname,*upn"), Vault(SEED)).collect()
    assert len({r.AccountName for r in got} | {r.AccountUpn.split("@")[0] for r in got}) == 1


def test_nothing_of_an_identity_is_left_under_the_built_in_policy(spark):
    text = '{"AccountName":"ann31","n":1.10,"big":1e400,"list":[{"AccountUpn":"ann31@corp.test"}],"x":12345678901234567890}'
    rows = [("ann31", "tool.exe --password s3cret31 -user ann31", "C:\\Users\\ann31\\x.txt", text, "run.exe", {"AccountName": "ann31", "k": "v"}, ["x"]), ("", None, " ", "plain", "notes.md", None, None)]
    df = spark.createDataFrame(rows, "AccountName string, ProcessCommandLine string, FolderPath string, AdditionalFields string, FileName string, Extra map<string,string>, list array<string>")
    vault = Vault(SEED)
    got = P.pseudonymise(df, FieldPolicy(default_fields("DeviceProcessEvents")), vault).collect()
    one, two = sorted(got, key=lambda r: r.FileName, reverse=True)
    user = vault.get("username", "ann31")
    assert not any("ann31" in json.dumps(r.asDict()) or "s3cret" in json.dumps(r.asDict()) for r in got)
    assert one.AccountName == user and one.FolderPath == f"C:\\Users\\{user}\\x.txt" and one.FileName == "run.exe" and one.Extra == {"AccountName": user, "k": "v"}
    assert one.AdditionalFields.startswith(f'{{"AccountName":"{user}","n":1.10,"big":1e400,"list":[{{"AccountUpn":"{user}@') and one.AdditionalFields.endswith('"x":12345678901234567890}')
    assert (two.AccountName, two.ProcessCommandLine, two.FolderPath, two.AdditionalFields, two.FileName, two.Extra) == ("", None, " ", "plain", "notes.md", None)
    named = P.pseudonymise(df, FieldPolicy(default_fields("DeviceProcessEvents")), Vault(SEED), options=P.Options(filenames=True)).collect()
    assert not any(r.FileName in ("run.exe", "notes.md") for r in named)


def test_blank_members_are_made_up_and_persons_follow_their_users(spark):
    df = spark.createDataFrame([("ann", " ", "", "Ann Lee", 1), ("ann", "", "ann@x.test", "", 2), ("", "", "", "Ann Lee", 3), (None, None, None, "Bo Ek", 4), ("", "", "", "", 5)], "AccountName string, AccountUpn string, AccountEmailAddress string, AccountDisplayName string, n int")
    vault = Vault(SEED)
    got = {r.n: r for r in P.pseudonymise(df, FieldPolicy("account*"), vault).collect()}
    user = vault.get("username", "ann")
    assert got[1].AccountName == got[2].AccountName == user and got[1].AccountUpn.split("@")[0] == user and got[2].AccountEmailAddress.split("@")[0] == user
    assert got[1].AccountDisplayName == got[2].AccountDisplayName == got[3].AccountDisplayName == vault.get("person", "ann lee")
    assert got[3].AccountName and got[4].AccountName is None and got[4].AccountDisplayName != "Bo Ek" and got[5].AccountName == ""
    outer = spark.createDataFrame([("a1", "", "b1@x.test")], "AccountName string, AccountUpn string, AccountEmailAddress string")
    r = P.pseudonymise(outer, FieldPolicy("account*"), Vault(SEED)).first()
    assert r.AccountName == r.AccountEmailAddress.split("@")[0]  # a blank between two members doesn't part them


def test_addresses_stay_where_a_host_is_asked_for(spark):
    df = spark.createDataFrame([("10.0.0.1", "fe80::1", "a.b.corp.test")], "DeviceName string, UrlDomain string, DnsDomain string")
    r = P.pseudonymise(df, FieldPolicy("*"), Vault(SEED)).first()
    assert (r.DeviceName, r.UrlDomain) == ("10.0.0.1", "fe80::1") and r.DnsDomain != "a.b.corp.test" and r.DnsDomain.count(".") >= 2


def test_more_public_addresses_than_there_are_fail_at_once_and_full_ranges_fit(spark):
    some = lambda n: spark.range(n).select(F.concat(F.lit("8.8."), (F.col("id") / 250).cast("int"), F.lit("."), F.col("id") % 250).alias("n"))
    full = A.allocate(A.entities(some(762), "n"), "ip_address", SEED)
    assert full.select("pseudonym").distinct().count() == 762
    with pytest.raises(A.AllocationError):
        A.allocate(A.entities(some(763), "n"), "ip_address", SEED).count()
    taken = full.limit(700).select("pseudonym").persist()
    rest = A.allocate(A.entities(some(62), "n"), "ip_address", SEED, taken)
    assert rest.count() == 62 and rest.join(taken, "pseudonym").count() == 0
    with pytest.raises(A.AllocationError):
        A.allocate(A.entities(some(63), "n"), "ip_address", SEED, taken).count()


def test_time_to_mask_grows_with_the_line():
    def took(n):
        line, began = "run " + " ".join(f"--password 's{i}' --x=\"y {i}\"" for i in range(n)), time.perf_counter()
        assert M.mask(line).count("***") == n
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 20 * took(1000)


def test_vault_round_trip_modes_and_conflicts(tmp_path):
    for irreversible in (False, True):
        path = str(tmp_path / f"vault{irreversible}")
        v = Vault.open(path, irreversible)
        v.add("person", "Ann  Lee", "Ada Barlow")
        v.save(path)
        assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
        w = Vault.open(path, irreversible)
        assert w.get("person", " ann lee ") == "Ada Barlow" and w.new_count == 0 and w.key_id == v.key_id
        assert ("Ann" in open(path).read()) is not irreversible
        with pytest.raises(VaultError):
            w.add("person", "ann lee", "Other Name")
        with pytest.raises(VaultError):
            Vault.open(path, not irreversible)
        d = json.load(open(path))
        for change in ({"version": 9}, {"extra": 1}, {"key_id": "0" * 16}, {"mappings": [{"entity_type": "nothing", "original": "x", "pseudonym": "y"}]}):
            json.dump(d | change, open(path, "w"))
            with pytest.raises(VaultError):
                Vault.open(path, irreversible)
        assert w.finish(path, "delete") and not os.path.exists(path)


@pytest.mark.parametrize(
    "line,want",
    [
        ("run --user ann --passwd 'a b' --apikey=z9 --tenant-id 7", "run --user *** --passwd '***' --apikey=*** --tenant-id ***"),
        ("run -Username bo -ClientSecret s3", "run -Username *** -ClientSecret ***"),
        ('curl -u a:b -H "Authorization: Basic Zm9v" -H "api-key: k1" x', 'curl -u *** -H "Authorization: Basic ***" -H "api-key: ***" x'),
        ('run --json "{\\"password\\":\\"q\\\\\\"w\\",\\"mode\\":\\"ok\\"}"', 'run --json "{\\"password\\":\\"***\\",\\"mode\\":\\"ok\\"}"'),
        ("Server=s;Uid=ann;Pwd=p q;Db=d", "Server=s;Uid=***;Pwd=*** q;Db=d"),
        ("get ftp://ann:pw@h.test/x?sig=1&m=2", "get ftp://***@h.test/x?sig=***&m=2"),
        ("mysqldump -uadmin -psecret -P3307 db", "mysqldump -u*** -p*** -P3307 db"),
        ("tool -port 80 -upper x", "tool -port 80 -upper x"),
        ("type C:\\Users\\ann\\a.txt mail bo@x.test", "type C:\\Users\\***\\a.txt mail ***"),
        ("x ASIAABCDEFGHIJKLMNOP y", "x *** y"),
        ('run --password "never closed', "run --password ***"),
        ("run --password 'it''s' --next ok", "run --password '***' --next ok"),
    ],
)
def test_command_lines(line, want):
    assert M.mask(line) == want
    assert M.mask(want) == want


def test_known_identities_are_masked_as_tokens(spark):
    df = spark.createDataFrame([("runas CORP\\lena lena2 Lena", "lena", "lena@x.test")], "c string, a string, u string")
    assert df.select(M.masked(F.col("c"), F.col("a"), F.col("u"))).first()[0] == "runas CORP\\*** lena2 ***"


def test_policy_and_kinds():
    p = FieldPolicy("*accountname, Device-Name")
    assert "InitiatingProcess_AccountName" in p and "AccountName_s" in p and "DeviceName" in p and "FileName" not in p
    with pytest.raises(ValueError):
        FieldPolicy(" ,")
    assert "remoteurl" in default_fields("DeviceEvents").split(",") and "*email" not in default_fields("deviceinfo").split(",")
    assert field_kind("HashedSHA1") is None and field_kind("UserCompanyName") == "organization"
    assert field_kind_in("label", {"type": "Machine"}) == "hostname" and field_kind_in("label", {"type": "x"}) is None


def test_spans_phrases_and_json(tmp_path):
    spans = N.settled(N.pattern_spans("mail Ann@x.test from 10.0.0.1 or 2024-01-02, file a.exe, C:\\Users\\bo\\x"))
    assert [(s.kind, s.text) for s in spans] == [("email", "Ann@x.test"), ("ip_address", "10.0.0.1"), ("username", "bo")]
    f = tmp_path / "phrases.json"
    f.write_text(json.dumps({"replacements": [{"find": ["Blue Moon", "BM"], "replace": "P1"}, {"find": "moon", "replace": "P2"}]}))
    ph = N.Phrases.load(str(f))
    assert N.rewrite("a blue moon, MOON, bm, moons", ph.spans("a blue moon, MOON, bm, moons"), lambda k, t: t) == "a P1, P2, P1, moons"
    for bad in ('{"x": 1}', '{"replacements": [{"find": " ", "replace": "a"}]}', '{"replacements": [{"find": "a"}]}', '{"replacements": [{"find": ["a", "A"], "replace": "b"}]}', "[]"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            N.Phrases.load(str(f))
    same = '{ "n": 12345678901234567890, "x": "keep" }'
    assert N.rewrite_json(same, lambda k, v: v) == same
    assert N.rewrite_json('{"a":{"u":"bo"},"l":["bo"],"s":"{\\"u\\":\\"bo\\"}","n":12345678901234567890}', lambda k, v: "X" if k == "u" else v) == '{"a":{"u":"X"},"l":["bo"],"s":"{\\"u\\":\\"X\\"}","n":12345678901234567890}'


def test_resource_ids():
    g = "0f8fad5b-d9cb-469f-a165-70867728950e"
    text = f"/subscriptions/{g}/resourceGroups/rg/providers/Ns.X/servers/s1/databases/d1"
    assert I.parts(text) == [(2, "identifier"), (4, "resource_group"), (8, "hostname"), (10, "resource_name")]
    assert I.rewrite(text, lambda k, v: k[0]) == "/subscriptions/i/resourceGroups/r/providers/Ns.X/servers/h/databases/r"
    for bad in ("/subscriptions/x", f"/subscriptions/{g}/resourceGroups", f"/subscriptions/{g}/providers/Ns", "x"):
        assert I.parts(bad) is None


@pytest.mark.parametrize("irreversible", [False, True])
def test_a_mapping_kept_as_a_table_gives_the_same_rows_and_the_same_vault(spark, tmp_path, monkeypatch, irreversible):
    """nothing of a large mapping is gathered; before, all of it went through the driver."""
    rows = [(f"u{i % 7}", f"u{i % 7}@corp.test", "" if i % 3 else f"Ann {i % 7}", {"AccountName": f"u{i}"} if i % 2 else None, i) for i in range(40)] + [(None, None, None, None, 40), ("jo", "j.doe@corp.test", "", None, 41)]
    df = spark.createDataFrame(rows, "AccountName string, AccountUpn string, AccountDisplayName string, Extra map<string,string>, n int").repartition(3)
    policy, small, large = FieldPolicy("account*"), Vault(SEED, irreversible), Vault(SEED, irreversible)
    want = {r.n: r for r in P.pseudonymise(df, policy, small).collect()}
    gathered = []
    monkeypatch.setattr(Vault, "add_all", lambda self, entries: gathered.extend(entries))
    monkeypatch.setattr(P, "SHIPPED", 0)
    monkeypatch.setattr(P, "CHUNK_ROWS", 4)
    out = P.pseudonymise(df, policy, large)
    assert {r.n: r for r in out.collect()} == want and out.schema == df.schema
    assert not gathered and not large.mappings and large.new_count == small.new_count > 20
    assert large.get("username", "U3") == small.get("username", "u3") and large.get("username", "nobody") is None
    small.save(tmp_path / "small")
    large.save(tmp_path / "large")
    one, two = (json.loads((tmp_path / x).read_text())["mappings"] for x in ("small", "large"))
    assert one == two and any("alias_of" in m for m in one) and large.new_count == 0
    # Later runs over the held table add nothing, whichever way the mapping goes; a limit is kept and changes nothing.
    assert {r.n: r for r in P.pseudonymise(df, policy, large).collect()} == want and large.new_count == 0
    monkeypatch.setattr(P, "SHIPPED", 50_000)
    more = df.select(F.concat("AccountName", F.lit("x")).alias("AccountName"), "AccountUpn", "n")
    with pytest.raises(VaultError):
        P.pseudonymise(more, policy, large, record=1)
    assert large.new_count == 0
    P.pseudonymise(more, policy, large).collect()
    assert large.new_count and large.get("username", "u3") == small.get("username", "u3")
    reopened = tmp_path / "again"
    large.save(reopened)
    assert Vault.open(str(reopened), irreversible).get("username", "u3x") == large.get("username", "u3x")


def test_a_large_mapping_is_never_broadcast(spark, monkeypatch):
    """Spark judged a mapping by its compressed files and sent 900,000 entries through the driver."""
    told = spark.createDataFrame([("username", f"u{i}", f"u{i}", f"name{i}") for i in range(40)], "kind string, key string, original string, pseudonym string")
    plans, plain = [], vault_module.staged
    monkeypatch.setattr(vault_module, "staged", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, name))[1])
    vault = Vault(SEED)
    vault.add_table(told)
    vault.add_table(told.select("kind", F.concat("key", F.lit("x")).alias("key"), "original", F.concat("pseudonym", F.lit("x")).alias("pseudonym")))
    plans.append(vault.unknown(told)._jdf.queryExecution().executedPlan().toString())
    rows = spark.createDataFrame([(f"u{i}",) for i in range(40)], "AccountName string")
    out = P.put_in_from(rows, FieldPolicy("account*"), told)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans) and all("SortMergeJoin" in p for p in plans)
    assert {r.AccountName for r in out.collect()} == {f"name{i}" for i in range(40)}


def test_a_row_is_noted_without_masking_and_names_that_a_line_lacks_cost_no_expression(monkeypatch):
    """each row's names were compiled to expressions, in three runs, and field names were judged anew for each row."""
    row, asked = {"AccountName": "ann", "ProcessCommandLine": "run --password x --level 3"}, []
    policy = FieldPolicy(default_fields("DeviceProcessEvents"))
    want = rows_module.Rewriter(policy, P.identity_family, lambda kind, text: "new").row(row)
    assert want == {"AccountName": "new", "ProcessCommandLine": "run --password *** --level 3"}
    assert M.mask_identity("run ANN x", "ann") == "run *** x" and M.mask_identity("run ſam x", "sam") == "run *** x" and M.mask_identity("run SAM x", "ſam") == "run *** x"
    monkeypatch.setattr(M.re, "sub", lambda *a, **k: pytest.fail("an expression was made"))
    assert M.mask_identity("run --level 3", "ann") == "run --level 3"
    monkeypatch.setattr(M, "mask", lambda *a: pytest.fail("masked"))
    rows_module.Rewriter(policy, P.identity_family, lambda kind, text: asked.append((kind, text)) or text, masks=False).row(row)
    assert ("username", "ann") in asked
