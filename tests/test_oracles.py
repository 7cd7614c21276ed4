"""What named tests range over, titles of tests, snapshots, and claims measured elsewhere, on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from strata.operators import claims as K
from strata.sources import oracles as O

HEAD = "import dflt, { A as B, type T } from './x';\nimport * as ns from 'y';\nconst req = require('z');\nconst LIST: string[] = ['a', 'b'];\nconst SET = new Set(['a']);\nconst MADE = ['a'].map(f);\nconst RX = /a[/]b/;\nlet later;\n"


def judged(body, head=HEAD):
    (row,) = O.file_anchors("x.test.ts", head + f'describe("it\\"s", () => {{ {body} }});\n')
    assert row[1] == 'it"s'
    return row[2:8]


@pytest.mark.parametrize(
    ("body", "verdict", "reason", "root"),
    [
        ("for (const x of B) {}", "live", "imported", "B"),
        ("for (const x of A) {}", "live", "opaque-root", "A"),
        ("for (const k in ns.table.rows) {}", "live", "imported", "ns"),
        ("dflt.forEach(f)", "live", "imported", "dflt"),
        ("Object.entries(req).map(f)", "live", "imported", "req"),
        ("Array.from((LIST as string[]).filter(f)).every(f)", "literal", "const-array", "LIST"),
        ("for (const x of SET) {}", "literal", "const-array", "SET"),
        ("for (const x of MADE) {}", "live", "live-local", "MADE"),
        ("for (const x of RX) {}", "literal", "const-array", "RX"),
        ("for (const x of later) {}", "live", "live-local", "later"),
        ("for (const x of ['a']) {}", "literal", "inline-literal", None),
        ("for (const x of new Set(['a'])) {}", "literal", "inline-literal", None),
        ("for (const x of new Set(B)) {}", "live", "unresolved", None),
        ("for (const x of a.b().c()) {}", "live", "call", None),
        ("for (const x of a[0].b[1]) {}", "live", "opaque-root", "a"),
        ("expect([...B, 1]).toBe(1)", "live", "imported", "B"),
        ("const y = { ...B }; const g = (...B) => 1; expect([...['a']])", "no-iteration", None, None),
        ("test.each(LIST)('x', f)", "literal", "const-array", "LIST"),
        ("for (let i = 0; i < B.n; i++) {}", "no-iteration", None, None),
        ("// B.map(f)\n'B.map(f)'; `B.map(f)`; /B.map(f)/", "no-iteration", None, None),
        ("`${B.map(f)}`", "live", "imported", "B"),
        ("LIST.map(f); B.map(f)", "live", "imported", "B"),
        ("", "no-iteration", None, None),
    ],
)
def test_loops(body, verdict, reason, root):
    assert judged(body)[:2] == (verdict, reason) and judged(body)[3] == root


def test_floors():
    loop = "for (const x of B) {}; "
    assert judged(loop + "expect(B.length).toBeGreaterThan(1)")[5] is True
    assert judged(loop + "expect(B.size >= 3).toBe(true)")[5] is True
    assert judged(loop + "expect(3 >= B.count)")[5] is True
    assert judged(loop + "expect(n).toBeGreaterThan(0); const f = () => B.length")[5] is False
    assert judged("for (const x of ['a']) {}; expect(B.length).toBeGreaterThan(1)")[5] is None


def test_python_blocks():
    text = "import a.b\nfrom r import X as Y, Z\nclass Suite:\n    @mark\n    async def test_in(self):\n        for x, y in enumerate(Y):\n            pass\n\n    def test_range(self):\n        for i in range(3):\n            pass\n\ndef test_in():\n    for x in ['no']: pass\n"
    rows = {r[1]: r for r in O.file_anchors("a/test_x.py", text)}
    assert rows["test_in"][2:6] == ("live", "call-root", "enumerate(Y)", "enumerate") and rows["test_in"][8] == ["Y"]
    assert rows["test_range"][2:4] == ("literal", "inline-literal")
    assert rows["Suite"][6] == 2


def test_odd_sources():
    assert O.file_anchors("x.test.ts", "") == [] and O.file_titles("x.test.ts", "") == []
    assert O.file_anchors("x.test.ts", "describe('a', () => {") == []
    assert O.file_titles("x.test.ts", "it('a', () => {") == [("x.test.ts", None, "could not be parsed")]
    assert O.file_titles("x.test.ts", "it('a") == [("x.test.ts", None, "could not be parsed")]
    assert O.file_anchors("x.test.ts", "describe('a')")[0][2] == "no-iteration"
    many = "describe('a', () => {\n" + "  for (const x of B) { f(x); }\n" * 3000 + "});\n"
    assert O.file_anchors("x.test.ts", many)[0][6] == 3000


def test_titles():
    text = "describe('s', () => { suite.only(`t`, () => { it('a', f); it('a', f); test.skipIf(c)('b', f); it.todo('c') }); it.each([1])('d', f); it('x' + y, f); it.odd('e', f); obj.it('g') });\ndescribe(name, () => { it('lost', f) });\nit(\"it's\", f); // it('no')\n"
    rows = O.file_titles("x.test.ts", text)
    assert [r[1] for r in rows if r[1]] == ["s t a", "s t b", "s t c", "it's"]
    assert sorted(r[2] for r in rows if r[2]) == ["declaration is parameterized", "modifier is not known", "title is not a string literal"]


def test_named(spark):
    files = spark.createDataFrame([("b.test.ts", "describe('n', () => { for (const x of D) { f(x); } })"), ("a.test.ts", "describe('n', () => { for (const x of D) { f(x); g(x); } })"), ("a.ts", "describe('m', () => D.map(f))"), ("c.test.ts", None)], "path string, text string")
    found = O.anchors(files)
    names = spark.createDataFrame([("n",), ("n",), ("m",), (None,)], "name string")
    assert sorted((r.name or "", r.path or "", r.verdict) for r in O.oracle_domains(names, found).collect()) == [("", "", "not-found"), ("m", "", "not-found"), ("n", "a.test.ts", "live"), ("n", "a.test.ts", "live")]
    claims = spark.createDataFrame([("n", "D", "f", "g"), ("n", "E", "f", "g"), ("n", "D", "f", "h"), ("z", "D", "f", "g")], "name string, domain string, f string, g string")
    assert sorted(r.verdict for r in O.parity_oracles(claims, found).collect()) == ["no-enumeration", "not-found", "ok", "one-sided"]
    assert O.anchors(files.where("false")).count() == 0


def test_static_names(spark):
    file = lambda *xs: spark.createDataFrame([*xs], "ref string, path string, text string")
    state = lambda files, name: O.static_resolution(spark.createDataFrame([(name,)], "name string"), O.titles(O.at_ref(files, "now")), O.prior_owners(O.at_ref(files, "head"), O.at_ref(files, "now"))).first().state
    was, dynamic = ("head", "a.test.ts", "it('old name', f)"), [(r, "d.test.ts", "it(`x ${y}`, f)") for r in ("head", "now")]
    renamed = file(was, ("now", "a.test.ts", "it('new name', f)"), *dynamic)
    assert [state(renamed, n) for n in ("old name", "new name", "never")] == ["absent", "found", "unknown"]
    assert state(file(was, ("now", "a.test.ts", "it(c ? 'old name' : 'b', f)")), "old name") == "unknown"
    assert state(file(was, *dynamic), "old name") == "absent"
    assert state(file(was, ("now", "a.test.ts", "it('old name', f)")), "never") == "absent"
    assert state(file(was), "never") == "unknown"


def test_measured_claims(spark):
    said = ["http://a responds 200", 'http://a responds 200 with "ok"', 'http://a responds 200 with "no"', "http://a responds 500", "http://b responds 200", "typechecks", "lives in x"]
    claims = spark.createDataFrame([(c,) for c in said], "claim string")
    answers = spark.createDataFrame([("http://a", 200, "is ok"), ("http://b", None, None)], "url string, status int, body string")
    assert {r.claim: r.kind for r in K.responds(claims, answers).collect()} == dict(zip(said[:5], ["pass", "pass", "fail", "fail", "skip"], strict=True))
    results = spark.createDataFrame([(True,), (False,)], "passed boolean")
    kinds = [K.typechecks(claims, results.where(w)).first().kind for w in ("passed", "true", "false")]
    assert kinds == ["pass", "fail", "skip"]


def test_claim_forms(spark):
    said = {'passes test "say "hi" twice"': "passes", 'u responds 1000 with ""': "responds", "conforms to 9x": None, "conforms to a-b_9": "conforms", "conforms to a.b": None, "u responds ok": None}
    rows = spark.createDataFrame([(c,) for c in said], "claim string").select("claim", K.form(F.col("claim")).alias("form"))
    assert {r.claim: r.form for r in rows.collect()} == said


def test_regulation(spark):
    columns = "k int, control_readable boolean, target_present boolean, control_present boolean, signal string, damaged_sources int, graph_problems int, conflicts int, unsynthesized int, contested int, unratified int, dangling int, unverified int"
    readings = spark.createDataFrame([(1, True, True, True, "quiet", 0, 0, 0, 0, 0, 0, None, 0), (2, True, True, False, "needs-decision", 0, 0, 0, 0, 0, 0, 2, 1), (3, *[None] * 12), (4, True, False, True, "quiet", 1, 0, 0, 0, 0, 0, 0, 0)], columns)
    got = {(r.k, r.rule): r.status for r in K.observe_regulation(readings, "k").collect()}
    said = lambda k: [got[k, r][0] for r in K.RULES]
    assert [said(k) for k in (1, 2, 3, 4)] == [list("ssss"), list("vvvv"), list("uuuu"), list("usuu")]
