"""Readers, writers and the tailing stream over files written here."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strata import schemas
from strata.sources import jsonl, project
from strata.streaming import activity, tail


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(path, *records, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in records) + end)


def test_permissive(spark, tmp_path):
    write(f"{tmp_path}/s1.jsonl", {"id": "a", "chose": "x", "at": "t", "extra": 1}, "not json", {"id": "b"}, "", {"id": "c", "chose": "y", "at": "u"})
    good, bad = jsonl.permissive(jsonl.lines(spark, str(tmp_path)), schemas.DECISIONS, "id", "chose", "at")
    assert rows(good.select("id", "line")) == [("a", 1), ("c", 5)] and bad.first().unreadable == 2


def decision(spark, **given):
    base = {"session": "s1", "at": "2024-01-02T03:04:05.678Z", "kind": "decision", "agent": "m", "job": "j", "chose": "x", "over": ["y"], "because": "z"} | given
    df = spark.createDataFrame([(json.dumps(base),)], "t string").select(F.from_json("t", schemas.DECISIONS).alias("r")).select(jsonl.decision_id(F.col("r")).alias("id"))
    return {"id": df.first().id} | base


def test_strict(spark, tmp_path):
    good = [decision(spark), decision(spark, chose="w")]
    read = lambda at: jsonl.strict_decisions(jsonl.lines(spark, f"{tmp_path}/{at}"))
    write(f"{tmp_path}/ok/s1.jsonl", *good)
    kept, damage = read("ok")
    assert damage.count() == 0 and sorted(r.id for r in kept.collect()) == sorted(g["id"] for g in good)
    bad = {
        "corrupt": ["{", json.dumps(good[0]) + "x", json.dumps(good[0]) + json.dumps(good[0]), json.dumps(good[0]) + ",{}"], "forged": [good[0] | {"chose": "other"}], "time": [decision(spark, at="yesterday")], "kind": [decision(spark, kind="guess")], "displaced": [decision(spark, session="s9")],
        "reference": [decision(spark, kind="retraction")], "dangling": [decision(spark, kind="retraction", supersedes="d-00000000")], "conflict": [good[0], good[0] | {"job": "k"}],
    }
    for code, records in bad.items():
        write(f"{tmp_path}/{code}/s1.jsonl", good[1], *records)
        kept, damage = read(code)
        assert code in {r.code for r in damage.collect()} and kept.count() == 0, code
    write(f"{tmp_path}/torn/s1.jsonl", good[0], end="")
    assert {r.code for r in read("torn")[1].collect()} == {"torn"}


def test_ids_shared_by_chance(spark, tmp_path):
    """Eight digits of the digests of these two are the same; what refers to them can't say which it means."""
    a, b = decision(spark, chose="x21694"), decision(spark, chose="x94231")
    assert a["id"] == b["id"]
    write(f"{tmp_path}/two/s1.jsonl", a, b, a)
    kept, damage = jsonl.strict_decisions(jsonl.lines(spark, f"{tmp_path}/two"))
    assert damage.count() == 0 and kept.count() == 3
    for code, more in {"ambiguous": decision(spark, kind="retraction", supersedes=a["id"]), "conflict": b | {"job": "k"}}.items():
        write(f"{tmp_path}/{code}/s1.jsonl", a, b, more)
        kept, damage = jsonl.strict_decisions(jsonl.lines(spark, f"{tmp_path}/{code}"))
        assert [r.code for r in damage.collect()] == [code] and kept.count() == 0
    forged = decision(spark, chose="other") | {"id": a["id"]}
    write(f"{tmp_path}/forged/s1.jsonl", a, forged)
    assert sorted(r.code for r in jsonl.strict_decisions(jsonl.lines(spark, f"{tmp_path}/forged"))[1].collect()) == ["conflict", "forged"]


def test_a_log_in_several_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"part-{i}").write_bytes("".join(f"h{i}{k}\x1fsaid\nf{k}\n\x1e" for k in range(3)).encode())
    commits, touched = project.commit_log(spark, str(tmp_path), 7)
    assert [r["hash"] for r in commits.orderBy("ord").collect()] == ["h00", "h01", "h02", "h10", "h11", "h12", "h20"] and touched.count() == 7


def test_append_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], "id string, session string, n int")
    jsonl.append(df.limit(1), str(tmp_path))
    read = lambda: spark.read.schema("id string, n int, session string").json(str(tmp_path))
    jsonl.append_once(df, read(), str(tmp_path))
    assert rows(read().select("id")) == [("a",), ("b",)]


def test_compaction(spark, tmp_path):
    files = [("f1", "main", "2024-01", True, "2024-01-31 00:00:00", 0), ("f2", "main", "2024-01", True, "2024-02-01 11:30:00", 0), ("f3", "main", "2024-01", False, "2024-01-01 00:00:00", 0), ("f4", "main", "2024-01", True, "2024-01-01 00:00:00", 1)]
    df = spark.createDataFrame(files, "file string, branch string, month string, committed boolean, changed_at string, unreadable int").withColumn("changed_at", F.to_timestamp("changed_at"))
    plan = jsonl.compaction_plan(df, F.to_timestamp(F.lit("2024-02-01 12:00:00")))
    assert rows(plan.select("file", "skip")) == [("f1", None), ("f2", "still warm"), ("f3", "never committed"), ("f4", "unreadable")]
    lines = spark.createDataFrame([("f1", '{"b":1}', "2", "b", "s"), ("f1", '{"a":  1}', "1", "a", "s"), ("f2", "{}", "0", "c", "s")], "file string, text string, at string, id string, session string")
    jsonl.compact(lines, plan, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":  1}', '{"b":1}']


def test_files(spark, tmp_path):
    for name, body in {"src/a.py": b"x\ny\n", "src/b.bin": b"\0\n", ".git/c.py": b"", "src/core/core.spec.md": b"# C\n", "tests/test_a.py": b"x", "node_modules/z.py": b"q"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = project.scan(spark, str(tmp_path), ignore=("node_modules",))
    assert rows(project.file_stats(found).select("path", "lines")) == [("src/a.py", 2), ("src/b.bin", 0), ("src/core/core.spec.md", 1), ("tests/test_a.py", 0)]
    assert rows(project.spec_dirs(found)) == [("src/core", "src/core/core.spec.md")]
    assert rows(project.sources(project.scan(spark, str(tmp_path), extensions=(".py",), ignore=("node_modules",))).select("path", "test")) == [("src/a.py", False), ("tests/test_a.py", True)]


def test_scan_reads_small_files_in_few_tasks(spark, tmp_path):
    for i in range(400):
        at = tmp_path / f"d{i % 3}" / "e" / f"f{i}.py"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"%d" % i)
    (tmp_path / "d0" / "empty.py").touch()
    found = project.scan(spark, f"file://{tmp_path}")
    assert {(r.path, bytes(r.content)) for r in found.collect()} == {(f"d{i % 3}/e/f{i}.py", b"%d" % i) for i in range(400)}
    assert found.rdd.getNumPartitions() == 4


def test_log(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eh2\x1fsecond\napp/a\napp/b\n\x1eh1\x1ffirst\nother\n")
    commits, touched = project.commit_log(spark, str(tmp_path / "log"))
    assert [r.hash for r in commits.orderBy("ord").collect()] == ["h2", "h1"]
    assert rows(project.rebase(touched, "app/")) == [("h2", "a"), ("h2", "b")]
    (tmp_path / "stat").write_text("\x1eh2\n 2 files changed, 5 insertions(+), 1 deletion(-)\n\x1eh1\n 1 file changed, 3 deletions(-)\n")
    assert rows(project.commit_deltas(spark, str(tmp_path / "stat"))) == [("h1", 0, 3), ("h2", 5, 1)]


def test_config(tmp_path):
    assert not project.load_config(str(tmp_path)).declared
    (tmp_path / "strata.json").write_text('{"sources": "lib", "ignore": ["x"]}')
    c = project.load_config(str(tmp_path))
    assert (c.sources, c.ignore, c.declared) == ("lib", ("x",), True)
    for text in ("{", '{"nope": 1}'):
        (tmp_path / "strata.json").write_text(text)
        with pytest.raises(ValueError):
            project.load_config(str(tmp_path))


def test_texts():
    assert project.json_objects('noise {"a": "}{\\"", "b": {}} x {"c": 1} {') == ['{"a": "}{\\"", "b": {}}', '{"c": 1}']
    assert json.loads(project.jsonc('{"a": "// no", /* c */ "b": [1, 2,], // d\n}')) == {"a": "// no", "b": [1, 2]}
    assert json.loads(project.toml_json("[a]\nb = 1")) == {"a": {"b": 1}} and project.toml_json("=") is None
    assert project.canonical_json('{"b": 1, "a": [2]}') == '{"a":[2],"b":1}' and project.canonical_json("{") is None


def test_reports(spark):
    vitest = 'log {"x": 1}\n' + json.dumps({"testResults": [{"name": "a.ts", "assertionResults": [{"fullName": "s t", "status": "passed", "duration": 4.5}]}]}) + " done"
    pytest_ = json.dumps({"tests": [{"nodeid": "t.py::C::test_x[1]", "outcome": "failed", "call": {"duration": 0.5}}]})
    df = spark.createDataFrame([(1, vitest), (2, pytest_), (3, "nothing")], "run int, text string")
    assert rows(project.test_report(df, "vitest")) == [(1, "s t", "passed", "a.ts", 4.5)]
    got = project.test_report(df, "pytest")
    assert rows(got) == [(2, "t.py::C::test_x[1]", "failed", "t.py", 500.0)]
    assert got.select(project.pytest_function(F.col("full_name")).alias("f")).first().f == "test_x"


def test_patches(spark):
    patch = "*** Begin Patch\n*** Update File: a/b.ts\n*** Move to: c.ts\n-x\n*** Add File: d.ts\n*** End Patch"
    payload = json.dumps({"session_id": "s", "tool_name": "edit", "tool_input": {"file_path": "x.ts", "command": patch}})
    df = spark.createDataFrame([(patch, payload)], "p string, j string")
    r = df.select(project.patch_paths(F.col("p")).alias("p"), project.hook_reads(F.col("j")).alias("h")).first()
    assert [tuple(x) for x in r.p] == [("update", "a/b.ts"), ("move", "c.ts"), ("add", "d.ts")]
    assert (r.h.session, r.h.tool, r.h.paths) == ("s", "edit", ["x.ts", "a/b.ts", "c.ts", "d.ts"])


def test_premises(spark):
    df = spark.createDataFrame([("a", "use src/x.ts:12", "calls `go()`", None), ("b", "see y.md", "", ["lib/z.ts"])], "id string, chose string, because string, files array<string>")
    refs = project.premise_referents(df)
    assert rows(refs) == [("a", "go", "symbol", False), ("a", "src/x.ts", "file", False), ("b", "lib/z.ts", "file", True)]
    paths = spark.createDataFrame([("src/x.ts",), ("new/Z.ts",)], "path string")
    assert rows(project.premise_leases(refs, paths, spark.createDataFrame([("go",)], "symbol string"))) == [("a", "live"), ("b", "moved")]


def test_tail(spark, tmp_path):
    root, seen = tmp_path / "in", "tail_out"
    write(f"{root}/s1.jsonl", {"session": "s1", "id": "a", "at": "1"}, '{"session": "s1", "id": "b"', end="")
    stream = tail.tail(spark, str(root), "session string, id string, at string")
    q = stream.writeStream.format("memory").queryName(seen).option("checkpointLocation", str(tmp_path / "cp")).start()
    ids = lambda: sorted(r.id for r in spark.table(seen).collect())
    try:
        q.processAllAvailable()
        assert ids() == ["a"]  # the torn line waits
        write(f"{root}/s1.jsonl", ', "at": "2"}')
        q.processAllAvailable()
        assert ids() == ["a", "b"]
        os.remove(f"{root}/s1.jsonl")  # compacted into another file, and one new row
        write(f"{root}/main.jsonl", {"session": "s1", "id": "a", "at": "1"}, {"session": "s1", "id": "b", "at": "2"}, {"session": "s2", "id": "c", "at": "3"})
        q.processAllAvailable()
        assert ids() == ["a", "b", "c"]
        with open(f"{root}/main.jsonl", "w") as f:  # rewritten
            f.write(json.dumps({"session": "s1", "id": "d", "at": "9"}) + "\n")
        q.processAllAvailable()
        assert ids() == ["a", "b", "c", "d"]
    finally:
        q.stop()


def test_running_counts(spark, tmp_path):
    write(f"{tmp_path}/in/x.json", {"event": "e", "replay_key": "k", "row": "1"}, {"event": "e", "replay_key": "k", "row": "2"}, {"event": "e", "row": "3"})
    stream = spark.readStream.schema("event string, replay_key string, row string").json(f"{tmp_path}/in")
    q = activity.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts_out").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("counts_out")) == [("e", 2)]
    finally:
        q.stop()


OPENED = {
    "version": 1, "event": "opened", "at": "2024-01-02T03:04:05.678Z", "session": "s1", "agent": "a", "job": "j", "work": "wrk-a", "parent": None, "objective": "do it", "criteria": ["done"], "constraints": [], "nonGoals": [],
    "authority": {"kind": "agent-local", "grantedBy": "me", "boundary": "this"}, "owner": {"session": "s1", "agent": "a"}, "dependsOn": ["wrk-b"], "readScopes": ["**"], "writeScopes": ["src/**", "x.ts"], "risk": "low", "state": "open",
}
REPO = {"branch": "main", "commit": None, "dirty": False}
LINK = {"version": 1, "event": "linked", "at": OPENED["at"], "session": "s1", "agent": "a", "job": "j", "basis": "agent-assessed", "repo": REPO, "from": {"kind": "work", "id": "w"}, "relation": "implements", "to": {"kind": "decision", "id": "d"}, "evidence": "it does"}
DEFECT = {"version": 1, "event": "recorded", "at": OPENED["at"], "basis": "agent-assessed", "session": "s1", "agent": "a", "job": "j", "repo": REPO, "summary": "broken", "evidence": "seen", "files": ["a/b.ts"]}


def signed(ledger, record):
    from strata.sources import strict

    return record | {"id": strict.content_id(ledger, record)}


@pytest.mark.parametrize(
    ("ledger", "good", "bad"),
    [
        ("work", OPENED, {"risk": {"risk": "none"}, "state": {"state": "active"}, "work": {"work": "W"}, "criteria": {"criteria": []}, "dependsOn": {"dependsOn": ["wrk-b", "wrk-a"]}, "writeScopes": {"writeScopes": ["../x"]}, "owner": {"owner": {"session": "unknown", "agent": "a"}}, "shape": {"extra": 1}, "at": {"at": "2024-01-02"}, "objective": {"objective": " x"}, "displaced": {"session": "s2"}}),
        ("consequence", LINK, {"relation": {"relation": "authorizes"}, "from": {"from": {"kind": "person", "id": "x"}}, "repo": {"repo": REPO | {"commit": "abc"}}, "basis": {"basis": "sure"}, "evidence": {"evidence": ""}, "version": {"version": 2}}),
        ("defect", DEFECT, {"files": {"files": ["b", "a"]}, "summary": {"summary": "a\nb"}, "shape": {"event": "linked"}}),
    ],
)
def test_strict_ledgers(spark, tmp_path, ledger, good, bad):
    from strata.sources import strict

    def read(at, *records, end="\n"):
        write(f"{tmp_path}/{at}/s1.jsonl", *records, end=end)
        kept, damage = strict.strict(jsonl.lines(spark, f"{tmp_path}/{at}"), ledger)
        return kept.collect(), {(r.line, r.code) for r in damage.collect()}

    one, other = signed(ledger, good), signed(ledger, good | {"agent": "b"})
    kept, damage = read("ok", one, other, one)
    assert not damage and {r.id for r in kept} == {one["id"], other["id"]}
    if ledger == "work":
        assert kept[0].depends_on == ["wrk-b"] and kept[0].authority.granted_by == "me"
    faulty = [signed(ledger, good | change) for change in bad.values()]
    assert read("bad", one, *faulty, "{", one | {"agent": "z"}) == ([], {(i + 2, code) for i, code in enumerate(bad)} | {(len(bad) + 2, "corrupt"), (len(bad) + 3, "forged")})
    assert read("torn", one, end="") == ([], {(1, "torn")})


def test_sound_rows_of_activity_and_traces(spark):
    from strata.sources import strict

    s = F.lit("s")
    base = {"version": 1, "at": OPENED["at"], "host": "codex", "transport": "direct", "session": "s", "attribution": "session", "event": "Stop", "bundleHash": None}
    rows_ = [base, base | {"host": "other"}, base | {"attribution": "agent"}, base | {"attribution": "agent", "agentId": "s"}, base | {"attribution": "parent-fallback", "parentSession": "s"}, base | {"turn": "t"}, base | {"at": "now"}, base | {"session": "x"}]
    rows_ += [base | {"command": {"kind": "verification", "name": "verify", "command": "x verify", "result": r, "exitCode": 0}} for r in ("success", "failure")] + ["no"]
    df = spark.createDataFrame([("f", i, x if isinstance(x, str) else json.dumps(x), False) for i, x in enumerate(rows_)], "file string, line int, text string, torn boolean")
    good, bad = strict.counted(jsonl.parsed(df, schemas.ACTIVITY, camel=True), strict.activity_sound(s))
    assert sorted(r.line for r in good.collect()) == [0, 3, 4, 8] and bad.first().unreadable == 7
    base = {"at": OPENED["at"], "session": "s", "tool": "Read", "path": "a.ts"}
    seen = {"version": 1, "host": "claude", "transport": "launcher", "attribution": "session", "eventId": None}
    rows_ = [base, base | {"mode": "write"}, base | {"mode": "x"}, base | {"path": ""}, base | {"provenance": {"source": "apply_patch", "operation": "move"}}, base | {"provenance": {"source": "guess", "operation": "move"}}, base | {"observation": seen}, base | {"observation": seen | {"attribution": "agent"}}]
    df = spark.createDataFrame([("f", i, json.dumps(x), False) for i, x in enumerate(rows_)], "file string, line int, text string, torn boolean")
    good, bad = strict.counted(jsonl.parsed(df, schemas.READ_TRACE, camel=True), strict.trace_sound(s))
    assert sorted(r.line for r in good.collect()) == [0, 1, 4, 6] and bad.first().unreadable == 4
