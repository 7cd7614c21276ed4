"""Facts of code, single records and small path tables."""

import pytest

from strata.operators import graph, ratchet, similarity
from strata.sources import extractors as X
from strata.sources import records as R

PY = '''"""Doc."""
import os, sys
from .core import thing
COLORS = ["red", "green", "blue"]
TABLE = {"a": 1, "b": 2, "c": 3}
Kind = Literal["x", "y", "z"]
class Shade(Enum):
    """Said."""
    ONE = 1
    TWO = 2
    THREE = 3
def test_it(): pass
class C:
    def m(self): pass
'''
TS = """import a from "./core/x";
import "../side.js";
export type Verdict = "pass" | "fail" | 'skip';
export enum E { A, B = 2, C }
export async function go() {}
const hidden = 1;
test("does it", () => {}); it(`also`, f);
"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_facts(spark):
    src = spark.createDataFrame([("pkg/a.py", PY), ("src/b.ts", TS), ("bad.py", "def ("), ("n.md", "x"), ("e.py", None)], "path string, text string")
    found = X.facts(src).cache()
    pick = lambda path, fact, *c: rows(found.where(f"path = '{path}' and fact = '{fact}'").select(*c))
    assert pick("pkg/a.py", "symbol", "name", "detail", "doc") == [("C", None, None), ("Shade", None, "Said."), ("m", "C", None), ("test_it", None, None)]
    assert pick("pkg/a.py", "import", "name", "detail") == [(".core", "thing"), ("os", None), ("sys", None)]
    assert pick("pkg/a.py", "domain", "name", "detail", "keys") == [("COLORS", "list", ["blue", "green", "red"]), ("Kind", "union", ["x", "y", "z"]), ("Shade", "enum", ["ONE", "THREE", "TWO"]), ("TABLE", "table", ["a", "b", "c"])]
    assert pick("pkg/a.py", "test", "name") == [("test_it",)]
    assert pick("src/b.ts", "symbol", "name", "line") == [("E", 4), ("Verdict", 3), ("go", 5)]
    assert pick("src/b.ts", "import", "name") == [("../side.js",), ("./core/x",)]
    assert pick("src/b.ts", "domain", "name", "keys") == [("E", ["A", "B", "C"]), ("Verdict", ["fail", "pass", "skip"])]
    assert pick("src/b.ts", "test", "name") == [("also",), ("does it",)]
    assert found.where("path in ('bad.py', 'n.md', 'e.py')").count() == 0
    paths = spark.createDataFrame([("src/core/x.ts",), ("side.ts",), ("pkg/core.py",), ("pkg/a.py",)], "path string")
    assert [(r.source, r.target) for r in graph.first_candidate(X.import_candidates(found), paths).orderBy("target").collect()] == [("pkg/a.py", "pkg/core.py"), ("src/b.ts", "side.ts"), ("src/b.ts", "src/core/x.ts")]
    assert similarity.domain_pairs(X.sites(found)).count() == 0
    other = X.facts(spark.createDataFrame([("src/b.ts", TS.replace("'skip'", "'skip' | 'new'").replace("go()", "stop()"))], "path string, text string"))
    assert rows(ratchet.surface_delta(X.surface(found.where("path = 'src/b.ts'"), "a"), X.surface(other, "b"))) == [(1, 1, 1)]


def test_own_adapter(spark):
    X.register(".zz", lambda path, text: [("symbol", text.strip(), None, 1, None, None)])
    assert rows(X.facts(spark.createDataFrame([("a.zz", " me ")], "path string, text string")).select("name")) == [("me",)]


def test_headers(spark):
    df = spark.createDataFrame([("a.ts", "// One\n// two.\ncode"), ("b.py", '"""Doc here."""\nx'), ("c.ts", "/* Block\n * more */\n"), ("d.ts", "code // not")], "path string, text string")
    assert rows(X.header_comment(df)) == [("a.ts", "One\ntwo."), ("b.py", "Doc here."), ("c.ts", "Block\nmore")]


def test_records(spark, tmp_path):
    at = str(tmp_path / "x" / "r.json")
    assert R.read(at) is None
    R.write(at, {"b": 1})
    R.stamp(at, "drift", {"n": 2}, "t", "c")
    assert R.read(at) == {"b": 1, "drift": {"n": 2, "at": "t", "commit": "c"}}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        R.read(str(tmp_path / "bad.json"))
    pinned = str(tmp_path / "p.json")
    assert R.baseline(spark, pinned, "key string, value double") is None
    R.pin(pinned, spark.createDataFrame([("b", 2.0), ("a", 1.0)], "key string, value double"), "key")
    assert rows(R.baseline(spark, pinned, "key string, value double")) == [("a", 1.0), ("b", 2.0)]
    assert R.refuse_vacuous(0, 3) and not R.refuse_vacuous(0, 0) and not R.refuse_vacuous(1, 3) and not R.refuse_vacuous(0, None)


def test_dims(spark):
    m = spark.createDataFrame([("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "1", "c": "2"}}'), ("bad/package.json", "{")], "path string, text string")
    assert rows(R.dependency_dims(m).select("key", "value")) == [("dependencies|package.json", 1.0), ("devDependencies|package.json", 2.0), ("peerDependencies|package.json", 0.0)]
    dims, not_ = R.probe_dims(spark.createDataFrame([("a", 0, "n = 3\n4.5 ok"), ("b", 1, "7"), ("c", 0, "none")], "key string, exit_code int, stdout string"))
    assert rows(dims) == [("a", 4.5)] and rows(not_) == [("b",), ("c",)]
    good, bad = R.bindings(spark.createDataFrame([("DB", "d1"), ("DB", "d1"), ("KV", "kv"), ("KV", "d1")], "name string, kind string"))
    assert rows(good) == [("DB", "d1")] and rows(bad) == [("KV", ["d1", "kv"])]


def test_paths(spark):
    p = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    assert rows(R.union_paths(p("a", "b"), p("b", "c"))) == [("a",), ("b",), ("c",)]
    delta = spark.createDataFrame([(1, 2)], "added long, deleted long")
    assert rows(R.with_untracked(delta, spark.createDataFrame([("x", 5)], "path string, lines long"))) == [(6, 2)]
    commits = spark.createDataFrame([("h0", 0), ("h1", 1)], "hash string, ord int")
    assert rows(R.commits_since(commits, spark.createDataFrame([("h1",), ("zz",)], "hash string"))) == [("h1", 1), ("zz", None)]


def test_paths_are_not_broadcast(spark):
    from strata.operators import graph

    imports = spark.createDataFrame([("a/x.ts", "./y", ["a/y", "a/y.ts"]), ("a/x.ts", "./x", ["a/x.ts"])], "source string, spec string, candidates array<string>")
    made = graph.first_candidate(imports, spark.createDataFrame([("a/x.ts",), ("a/y.ts",)], "path string"))
    assert [tuple(r) for r in made.collect()] == [("a/x.ts", "./y", "a/y.ts")]
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
