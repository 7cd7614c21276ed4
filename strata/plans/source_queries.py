"""Sources and sinks over files that are written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata import schemas
from strata.functions import columns as C
from strata.functions import markdown as M
from strata.operators import graph as G
from strata.operators.history import places
from strata.sources import extractors as E
from strata.sources import jsonl, project, records, strict
from strata.sources.shared import dealt, folder, shared_folder
from strata.plans import roles as R

_AT = "2024-01-02T03:04:05.678Z"


def _t(c):
    return c.cast("string")


def _written(spark, rows, label, name="value", by="session"):
    """rows(session, value) as text files, a folder for each session, written where the rows are."""
    path = folder(spark, label)
    rows.select(by, F.col(name).alias("value")).write.partitionBy(by).text(path)
    return path


def _by_session(rows):
    """lines() with a session's folder as its file."""
    return rows.withColumn("file", F.regexp_replace("file", r"/session=([^/]+)/[^/]+$", "/$1"))


def _decisions(spark, d):
    """Events as journal lines of six sessions, some of them damaged."""
    e = R.table(spark, d, "events").select(F.col("event_id").alias("k"), "event_type")
    k = F.col("k")
    row = F.struct(
        F.concat(F.lit("d-"), _t(k)).alias("id"), F.when(k % 13 != 0, F.lit(_AT)).alias("at"), F.when(k % 17 != 0, F.col("event_type")).alias("chose"), F.concat(F.lit("s"), _t(k % 6)).alias("session"), F.lit("decision").alias("kind"),
    )
    return e.select(F.concat(F.lit("s"), _t(k % 6)).alias("session"), F.when(k % 19 == 0, F.lit("{torn")).otherwise(F.to_json(row)).alias("value"))


def journal_rows(spark, d):
    """How many lines of each choice a permissive reader keeps, and how many it can't read."""
    rows = _by_session(jsonl.lines(spark, _written(spark, _decisions(spark, d), "journal")))
    good, bad = jsonl.permissive(rows, schemas.DECISIONS, "id", "chose", "at")
    return good.groupBy("chose").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).unionByName(bad.select(F.lit("unreadable").alias("chose"), F.col("unreadable").alias("n"), F.lit(None).cast("long").alias("files")))


def _trusted(spark, d, sound):
    """Orders as decisions with the ids of their content; of the unsound ones some are forged or dangle."""
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    k = F.col("k")
    kind = F.lit("decision") if sound else F.when(k % 40 == 3, "retraction").when(k % 40 == 5, "guess").otherwise("decision")
    r = o.select(
        k, F.lit(_AT).alias("at"), kind.alias("kind"), F.concat(F.lit("s"), _t(k % 4)).alias("session"), F.lit("m").alias("agent"), F.concat(F.lit("pick "), _t(k)).alias("chose"),
        F.array(F.col("o_orderstatus")).alias("over"), F.lit("so").alias("because"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("array<string>").alias("could_be"),
        F.lit(None).cast("string").alias("discriminated_by"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("finding"),
    )
    own = jsonl.decision_id()
    ident = own if sound else F.when(k % 40 == 7, "d-00000000").otherwise(own)
    at = F.col("at") if sound else F.when(k % 40 == 9, "yesterday").otherwise(F.col("at"))
    r = r.select("*", ident.alias("id")).withColumn("at", at)
    fields = [c for c in r.columns if c not in ("k",)]
    text = F.to_json(F.struct(*fields))
    return r.select("session", (text if sound else F.when(k % 40 == 11, "{}x").otherwise(text)).alias("value"))


def journal_trusted(spark, d):
    """All rows of a journal without damage, none of one with it, and its damage by code."""
    out = None
    for sound in (True, False):
        kept, damage = jsonl.strict_decisions(_by_session(jsonl.lines(spark, _written(spark, _trusted(spark, d, sound), "trusted"))))
        part = kept.agg(F.count("*").alias("n")).select(F.lit(f"{'sound' if sound else 'damaged'}:rows").alias("what"), "n").unionByName(damage.groupBy(F.concat(F.lit("damage:"), F.col("code")).alias("what")).agg(F.count("*").alias("n")))
        out = part if out is None else out.unionByName(part)
    return out


#: A link as its writer writes it, but for its id: relation, end, and what it leads to.
_LINK = '{"agent":"a","at":"%s","basis":"agent-assessed","event":"linked","evidence":"seen","from":{"id":"%%s","kind":"%%s"},%%s"job":"j","relation":"%%s","repo":{"branch":"main","commit":null,"dirty":false},"session":"%%s","to":{"id":"%%s","kind":"decision"},"version":1}' % _AT


def _links(spark, d, sound):
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    kind = F.when(k % 3 == 0, "commit").otherwise("work") if sound else F.when(k % 3 == 0, "commit").when(k % 21 == 1, "defect").otherwise("work")
    session = F.concat(F.lit("s"), _t(k % 4))
    body = lambda ident: F.format_string(_LINK, _t(k), kind, ident, F.lit("implements"), session, F.concat(F.lit("d"), _t(k % 50)))
    ident = F.concat(F.lit("lnk-"), F.substring(F.sha2(body(F.lit("")), 256), 1, 12))
    if not sound:
        ident = F.when(k % 33 == 5, "lnk-000000000000").otherwise(ident)
    return o.select(F.when(k % 41 == 0, F.concat(session, F.lit("x"))).otherwise(session).alias("session") if not sound else session.alias("session"), body(F.concat(F.lit('"id":"'), ident, F.lit('",'))).alias("value"))


def consequences_trusted(spark, d):
    out = None
    for sound in (True, False):
        rows = _by_session(jsonl.lines(spark, _written(spark, _links(spark, d, sound), "links")))
        kept, damage = strict.strict(rows, "consequence", F.col("session"))
        part = kept.groupBy(F.concat(F.lit(f"{'sound' if sound else 'damaged'}:"), F.col("from.kind")).alias("what")).agg(F.count("*").alias("n")).unionByName(damage.groupBy(F.concat(F.lit("damage:"), F.col("code")).alias("what")).agg(F.count("*").alias("n")))
        out = part if out is None else out.unionByName(part)
    return out


def appended_once(spark, d):
    """Orders appended to a ledger, and again with the rest of them: a retry adds nothing."""
    rows = R.table(spark, d, "orders").select(F.concat(F.lit("e-"), _t(F.col("o_orderkey"))).alias("id"), F.concat(F.lit("s"), _t(F.col("o_custkey") % 5)).alias("session"), F.col("o_totalprice").alias("value"))
    path = folder(spark, "appended")
    read = lambda: spark.read.schema("id string, value double, session string").json(path)
    jsonl.append(rows.where("value < 100000"), path)
    jsonl.append_once(rows, read(), path)
    return read().groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("value").alias("most"))


def compaction(spark, d):
    """Files of orders by what a compaction does with them."""
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    k = F.col("k")
    files = o.select(
        F.concat(F.lit("f"), _t(k)).alias("file"), F.concat(F.lit("b"), _t(k % 3)).alias("branch"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (k % 7 != 0).alias("committed"),
        F.timestamp_seconds(F.lit(1704067200) - (k % 40) * 600).alias("changed_at"), (k % 11 == 0).cast("int").alias("unreadable"),
    )
    return jsonl.compaction_plan(files, F.timestamp_seconds(F.lit(1704067200))).select("file", "skip", "target")


_TARGETS = (("main", "2024-01", None), ("main", "2024-01", None), ("dev", "2024-02", "still warm"), ("dev", "2024-02", None), ("main", "2024-03", None), ("dev", "2024-02", None), ("main", "2024-01", "never committed"))


def compacted_lines(spark, d):
    """Events folded into one file for each branch and month, as they were, in order of time."""
    e = R.table(spark, d, "events").select(F.col("event_id").alias("k"), "event_type")
    k = F.col("k")
    rows = e.select(F.concat(F.lit("f"), _t(k % 7)).alias("file"), F.concat(F.lit("{ "), _t(k), F.lit(" }  ")).alias("text"), _t(k % 10).alias("at"), F.lpad(_t(k), 9, "0").alias("id"), F.lit("s").alias("session"))
    plan = spark.createDataFrame([(f"f{i}", b, m, s) for i, (b, m, s) in enumerate(_TARGETS)], "file string, branch string, month string, skip string")
    path = folder(spark, "compacted")
    jsonl.compact(rows, plan, path)
    got = spark.read.text(path, wholetext=True)
    return got.select("branch", _t(F.col("month")).alias("month"), F.sha2(F.concat_ws("\n", F.array_remove(F.split("value", "\n"), "")), 256).alias("digest"))


def pinned_baseline(spark, d):
    """Brands and their lines written as a baseline and read again, with a stamp beside it."""
    rows = R.table(spark, d, "part").groupBy(F.concat(F.lit("lines|"), F.col("p_brand")).alias("key")).agg(F.sum("p_size").cast("double").alias("value"))
    path = folder(spark, "baseline").replace("file:", "")
    records.pin(f"{path}/base.json", rows, "key")
    records.stamp(f"{path}/status.json", "mass", {"count": rows.count()}, _AT, None)
    records.stamp(f"{path}/status.json", "atlas", {"count": 1}, _AT, None)
    status = records.read(f"{path}/status.json")
    return records.baseline(spark, f"{path}/base.json", "key string, value double").withColumn("stamped", F.lit(int(status["mass"]["count"] if "atlas" in status else -1)))


def exported_log(spark, d):
    """Orders as commits of an exported log under a prefix: the newest thousand and their files."""
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    li = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("app/p"), _t(F.col("l_partkey")))).otherwise(F.concat(F.lit("lib/p"), _t(F.col("l_partkey")))))).alias("files"))
    said = F.concat(F.lit("h"), _t(F.col("k")), F.lit("\x1fchange "), _t(F.col("k")), F.lit("\n"), F.array_join("files", "\n"))
    path = folder(spark, "log")
    o.join(li, "k").orderBy(F.desc("k")).select(said.alias("value")).write.option("lineSep", "\x1e").text(path)
    _, touched = project.commit_log(spark, path, 1000)
    return project.rebase(touched, "app/").groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def exported_deltas(spark, d):
    li = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "N").alias("a"), F.count_if(F.col("l_returnflag") != "N").alias("x"))
    some = lambda n, word: F.when(n > 0, F.concat(F.lit(", "), _t(n), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""), F.lit("(+)"))).otherwise("")
    path = folder(spark, "stat")
    li.select(F.concat(F.lit("h"), _t(F.col("k")), F.lit("\n 1 file changed"), some(F.col("a"), "insertion"), some(F.col("x"), "deletion"), F.lit("\n")).alias("value")).write.option("lineSep", "\x1e").text(path)
    return project.commit_deltas(spark, path)


def _numstat(spark, d):
    k = F.col("p_partkey")
    tail = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".py", ".md", ".js")]), (k % 4 + 1).cast("int"))
    where = F.when(k % 5 == 0, "src/node_modules/").otherwise("src/")
    return R.table(spark, d, "part").select(F.concat(where, F.lit("p"), _t(k), tail).alias("path"), F.col("p_size").alias("added"), (k % 9).alias("deleted"))


def code_delta(spark, d):
    """Lines of code changed outside ignored folders, with all lines of files that aren't tracked."""
    n = _numstat(spark, d)
    loose = n.where("path like '%7.ts'").select("path", F.col("added").alias("lines"))
    return records.with_untracked(project.loc_delta(n, (".ts", ".py", ".js"), ("node_modules",)), loose)


def changed_paths(spark, d):
    """Paths that differ, are untracked, or are asked for and exist."""
    n = _numstat(spark, d)
    return records.union_paths(n.where("added > 40"), n.where("deleted = 0"), n.where("path like '%1.py'"))


def commits_since(spark, d):
    placed, _ = places(R.table(spark, d, "orders").select(F.col("o_orderkey").alias("hash")), F.desc("hash"))
    o = placed.select("hash", (F.col("place") - 1).cast("int").alias("ord"))
    refs = R.table(spark, d, "customer").select(F.col("c_custkey").alias("hash"))
    return records.commits_since(o, refs)


def _files(spark, d):
    """Parts as source files with a header, imports and exports; some in ignored and hidden folders."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("m"), _t(k))
    folder_ = F.concat(F.lit("c"), _t(k % 9), F.when(k % 23 == 0, "/node_modules").when(k % 29 == 0, "/.git").otherwise(""))
    text = F.concat(
        F.lit("// Part "), _t(k), F.lit(" of it.\n// Second line.\nimport { x } from './m"), _t(k + 9), F.lit("';\nexport function f"), _t(k), F.lit("() {}\nexport type U"), _t(k % 50), F.lit(" = 'a' | 'b' | 'c"), _t(k % 7), F.lit("';\ntest('does "), _t(k), F.lit("', () => {});\n"),
    )
    tail = F.when(k % 10 == 0, ".test.ts").when(k % 31 == 0, ".spec.md").otherwise(".ts")
    return R.table(spark, d, "part").select(F.concat(folder_, F.lit("/"), name, tail).alias("path"), text.alias("text"), k.alias("k"))


_SCANNED: dict = {}


def _scanned(spark, d, extensions=()):
    """The files above on disk, scanned. Tasks write them under names of their own first, so one can run again."""
    import os
    import uuid

    def write(batches):
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{root}/{path}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, at)
            yield batch.slice(0, 0)

    key = (spark.sparkContext.applicationId, d)
    if key not in _SCANNED:
        root = folder(spark, "tree").replace("file:", "")
        given = _files(spark, d).select("path", "text")
        dealt(given, 4 * given.count(), "path").mapInArrow(write, "path string, text string").count()
        _SCANNED[key] = root
    return project.scan(spark, _SCANNED[key], extensions=extensions, ignore=("node_modules",))


def scanned_files(spark, d):
    return project.file_stats(_scanned(spark, d))


def spec_folders(spark, d):
    return project.spec_dirs(_scanned(spark, d, (".spec.md",)))


def test_files(spark, d):
    return project.sources(_scanned(spark, d)).select("path", "test", C.looks_like_test(F.col("path")).alias("context_test"))


def code_surface(spark, d):
    """Exports and members of domains of the files, as a surface."""
    return E.surface(E.facts(_files(spark, d).select("path", "text")), "now").select("kind", "name", "member")


def code_sites(spark, d):
    return E.sites(E.facts(_files(spark, d).select("path", "text"))).select("name", "kind", "file", F.array_join("keys", " ").alias("keys"))


def code_tests(spark, d):
    return E.facts(_files(spark, d).select("path", "text")).where("fact = 'test'").select("path", "name", "line")


def resolved_imports(spark, d):
    found = E.facts(_files(spark, d).select("path", "text"))
    return G.first_candidate(E.import_candidates(found), _files(spark, d).select("path"))


def header_comments(spark, d):
    return E.header_comment(_files(spark, d).select("path", "text"))


def python_facts(spark, d):
    """Functions, classes, imports and domains of modules made from parts, by the grammar."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("import os\nclass K"), _t(k), F.lit(":\n    def run(self):\n        '''Does it.'''\n\nNAMES = ['a', 'b', 'n"), _t(k % 5), F.lit("']\ndef test_"), _t(k % 3), F.lit("():\n    pass\n"), F.when(k % 17 == 0, "def broken(:\n").otherwise(""))
    rows = R.table(spark, d, "part").select(F.concat(F.lit("p"), _t(k), F.lit(".py")).alias("path"), text.alias("text"))
    return E.facts(rows).select("path", "fact", "name", "detail", "line", F.array_join("keys", " ").alias("keys"), "doc")


def test_reports(spark, d):
    """Verdicts of tests in noisy outputs of two kinds of runners."""
    k = F.col("p_partkey")
    p = R.table(spark, d, "part").select(k.alias("k"), "p_size")
    k = F.col("k")
    vit = p.select(k.alias("run"), F.concat(F.lit('noise { "x": "}" } {"testResults":[{"name":"f'), _t(k % 5), F.lit('","assertionResults":[{"fullName":"a > '), _t(k), F.lit('","status":"passed","duration":'), _t(F.col("p_size")), F.lit('}]}]} tail {')).alias("text"))
    py = p.select(k.alias("run"), F.concat(F.lit('==== {"tests":[{"nodeid":"t.py::test_x['), _t(k), F.lit(']","outcome":"failed","call":{"duration":0.5}}]}')).alias("text"))
    both = project.test_report(vit, "vitest").unionByName(project.test_report(py.where("run % 3 = 0"), "pytest"))
    return both.withColumn("function", project.pytest_function(F.col("full_name")))


def manifests(spark, d):
    k = F.col("s_suppkey")
    text = F.when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"dependencies":{"a":"1"'), F.when(k % 2 == 0, ',"b":"2"').otherwise(""), F.lit('},"devDependencies":{"c":"3"}}')))
    return records.dependency_dims(R.table(spark, d, "supplier").select(_t(k).alias("path"), text.alias("text")))


def probes(spark, d):
    """The last number of each probe's output; those that failed or said none are unmeasurable."""
    k = F.col("c_custkey")
    out = R.table(spark, d, "customer").select(_t(k).alias("key"), (k % 5 == 0).cast("int").alias("exit_code"), F.when(k % 3 == 0, "nothing").otherwise(F.concat(F.lit("took 3 s, "), _t(k), F.lit(".5 in all"))).alias("stdout"))
    found, lost = records.probe_dims(out)
    return found.unionByName(lost.withColumn("value", F.lit(None).cast("double")))


def bindings(spark, d):
    found = R.table(spark, d, "customer").select(F.concat(F.lit("B"), _t(F.col("c_custkey") % 100)).alias("name"), F.when((F.col("c_custkey") % 100 < 10) & (F.col("c_custkey") % 200 >= 100), "kv").otherwise("db").alias("kind"))
    good, bad = records.bindings(found)
    return good.unionByName(bad.select("name", F.array_join("kinds", "!").alias("kind")))


def loose_json(spark, d):
    """JSON with comments and trailing commas, TOML, and canonical JSON."""
    k = F.col("p_partkey")
    c = F.concat(F.lit('{ // note\n "b": ['), _t(k), F.lit(',],\n /* x */ "a": "//'), _t(k % 3), F.lit('" }'))
    t = F.concat(F.lit("[x]\nn = "), _t(k), F.lit('\ns = "q"\n'))
    text = lambda f, col: project.python_column(f, "string", col)
    return R.table(spark, d, "part").select(k.alias("k"), text(project.canonical_json, text(project.jsonc, c)).alias("jsonc"), text(project.canonical_json, text(project.toml_json, t)).alias("toml"))


def component_specs(spark, d):
    """Specs of suppliers: name, intent, claims, invariants, refutations, zones, and a region of them replaced."""
    k = _t(F.col("s_suppkey"))
    text = F.concat(
        F.lit("# Core "), k, F.lit("\n\n## intent\nServe "), k, F.lit(".\n\n## claims\n- a\\_"), k, F.lit(" imports b\n- lives in z\n\n## invariants\n- holds "), k, F.lit("\n\n## refutations\n- inv "), k, F.lit(": seen\n- inv "), k,
        F.lit(": again\n\n## zones\n- web: outer\n- store inside web: inner "), k, F.lit("\n<!--b-->old<!--e-->\n"),
    )
    rows = R.table(spark, d, "supplier").select("s_suppkey", text.alias("t"))
    s = M.spec(F.col("t"))
    return rows.select(
        "s_suppkey", s["name"].alias("name"), s["intent"].alias("intent"), F.array_join(s["claims"], "|").alias("claims"), F.array_join(s["invariants"], "|").alias("invariants"), F.array_join(M.refuted(s["refutations"]), "|").alias("refuted"),
        F.array_join(F.transform(M.zones(F.col("t")), lambda z: F.concat_ws(":", z["name"], F.coalesce(z["parent"], F.lit("-")), z["intent"])), "|").alias("zones"),
        F.md5(M.splice(F.col("t"), F.lit("NEW"), "<!--b-->", "<!--e-->")).alias("spliced"), M.extract(F.col("t"), "<!--b-->", "<!--e-->").alias("region"), M.split_why(F.concat(F.lit("Does "), k, F.lit(" @why because")))["why"].alias("why"),
    )


def markdown_domains(spark, d):
    """Enumerated domains of tables and alternations."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("| key | n |\n|---|---|\n| `a"), _t(k), F.lit("` | 1 |\n| b | 2 |\n| c | 3 |\n\nuse `x|y|z"), _t(k % 4), F.lit("` or (p|q)\n"))
    return M.domain_sites(R.table(spark, d, "supplier").select(_t(k).alias("file"), text.alias("text"))).select("file", "kind", F.array_join("keys", " ").alias("keys"))


def prose_of_documents(spark, d):
    """Sentences of documents taken as markdown, by paragraph."""
    return M.units(R.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")).groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last"), F.sum(F.length("text")).alias("chars"))


def patch_reads(spark, d):
    """Files that tool events touch: by patch, by path."""
    k = F.col("o_orderkey")
    cmd = F.concat(F.lit("*** Begin Patch\n*** Add File: a"), _t(k), F.lit(".ts\n+x\n*** Update File: b.ts\n*** Move to: c"), _t(k % 7), F.lit(".ts\n*** Delete File: d.ts\n"))
    payload = F.to_json(F.struct(F.concat(F.lit("s"), _t(k % 5)).alias("session_id"), F.lit("apply_patch").alias("tool_name"), F.struct(F.when(k % 2 == 0, cmd).alias("command"), F.when(k % 2 == 1, F.concat(F.lit("r"), _t(k), F.lit(".ts"))).alias("file_path")).alias("tool_input")))
    r = project.hook_reads(payload)
    ops = F.array_join(F.transform(F.coalesce(project.patch_paths(F.when(k % 2 == 0, cmd).otherwise("")), F.array().cast("array<struct<op:string,path:string>>")), lambda x: x["op"]), " ")
    return R.table(spark, d, "orders").select(k.alias("k"), r["session"].alias("session"), r["tool"].alias("tool"), F.array_join(r["paths"], " ").alias("paths"), ops.alias("ops"))


def premise_leases(spark, d):
    """Whether what orders' reasons name still stands: files, moved files, symbols."""
    k = F.col("o_orderkey")
    o = R.table(spark, d, "orders").select(_t(k).alias("id"), F.concat(F.lit("keep `sym"), _t(k % 30), F.lit("()` as it is")).alias("chose"), F.concat(F.lit("see src/f"), _t(k % 20), F.lit(".ts")).alias("because"), F.when(k % 4 == 0, F.array(F.concat(F.lit("lib/g"), _t(k % 10), F.lit(".ts")))).alias("files"))
    paths = spark.range(15).select(F.concat(F.when(F.col("id") < 10, "src/f").otherwise("moved/f"), _t(F.col("id")), F.lit(".ts")).alias("path")).unionByName(spark.range(5).select(F.concat(F.lit("lib/g"), _t(F.col("id")), F.lit(".ts")).alias("path")))
    symbols = spark.range(25).select(F.concat(F.lit("sym"), _t(F.col("id"))).alias("symbol"))
    return project.premise_leases(project.premise_referents(o), paths, symbols)


QUERIES = {
    f.__name__: f
    for f in (
        journal_rows, journal_trusted, consequences_trusted, appended_once, compaction, compacted_lines, pinned_baseline, exported_log, exported_deltas, code_delta, changed_paths, commits_since, scanned_files, spec_folders, test_files,
        code_surface, code_sites, code_tests, resolved_imports, header_comments, python_facts, test_reports, manifests, probes, bindings, loose_json, component_specs, markdown_domains, prose_of_documents, patch_reads, premise_leases,
    )
}

_KEPT = "f AS (SELECT CASE WHEN p_partkey % 23 = 0 THEN 'c' || (p_partkey % 9) || '/node_modules' WHEN p_partkey % 29 = 0 THEN 'c' || (p_partkey % 9) || '/.git' ELSE 'c' || (p_partkey % 9) END AS dir, p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN '.test.ts' WHEN p_partkey % 31 = 0 THEN '.spec.md' ELSE '.ts' END AS tail FROM part), g AS (SELECT *, dir || '/m' || k || tail AS path, '// Part ' || k || ' of it.' || chr(10) || '// Second line.' || chr(10) || 'import { x } from ''./m' || (k + 9) || ''';' || chr(10) || 'export function f' || k || '() {}' || chr(10) || 'export type U' || (k % 50) || ' = ''a'' | ''b'' | ''c' || (k % 7) || ''';' || chr(10) || 'test(''does ' || k || ''', () => {});' || chr(10) AS text FROM f), disk AS (SELECT * FROM g WHERE NOT contains(dir, '/'))"
_NUM = "n AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'src/node_modules/' ELSE 'src/' END || 'p' || p_partkey || list_extract(['.ts', '.py', '.md', '.js'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS path, p_size AS added, p_partkey % 9 AS deleted FROM part)"
_TS = "NOT ends_with(path, '.md')"

SQL = {
    "journal_rows": """WITH e AS (SELECT *, event_id % 19 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AS good FROM events)
        SELECT event_type AS chose, count(*) AS n, count(DISTINCT event_id % 6) AS files FROM e WHERE good GROUP BY event_type UNION ALL SELECT 'unreadable', count(*) FILTER (WHERE NOT good), NULL FROM e""",
    "journal_trusted": """WITH o AS (SELECT o_orderkey % 40 AS m FROM orders), c(code, own) AS (VALUES ('reference', 3), ('kind', 5), ('forged', 7), ('time', 9), ('corrupt', 11), ('missing', 11), ('displaced', 11))
        SELECT 'sound:rows' AS what, count(*) AS n FROM o UNION ALL SELECT 'damaged:rows', 0 UNION ALL SELECT 'damage:' || code, count(*) FROM c JOIN o ON m = own OR m = 11 GROUP BY code
        UNION ALL SELECT 'damage:conflict', 1 FROM o WHERE m = 7 HAVING count(*) > 1""",
    "consequences_trusted": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AND o_orderkey % 21 = 1 AS wrong, o_orderkey % 33 = 5 AS forged, o_orderkey % 41 = 0 AS moved FROM orders)
        SELECT 'sound:' || CASE WHEN k % 3 = 0 THEN 'commit' ELSE 'work' END AS what, count(*) AS n FROM o GROUP BY 1
        UNION ALL SELECT * FROM (SELECT 'damage:relation', count(*) AS n FROM o WHERE wrong UNION ALL SELECT 'damage:forged', count(*) FROM o WHERE forged AND NOT wrong UNION ALL SELECT 'damage:displaced', count(*) FROM o WHERE moved AND NOT wrong AND NOT forged) WHERE n > 0""",
    "appended_once": "SELECT 's' || (o_custkey % 5) AS session, count(*) AS n, count(*) AS ids, max(o_totalprice) AS most FROM orders GROUP BY 1",
    "compaction": """SELECT 'f' || o_orderkey AS file, s AS skip, CASE WHEN s IS NULL THEN 'b' || (o_orderkey % 3) || '/' || strftime(o_orderdate, '%Y-%m') || '.jsonl' END AS target
        FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'never committed' WHEN (o_orderkey % 40) * 600 < 7200 THEN 'still warm' WHEN o_orderkey % 11 = 0 THEN 'unreadable' END AS s FROM orders)""",
    "compacted_lines": """WITH p(i, branch, month) AS (VALUES (0, 'main', '2024-01'), (1, 'main', '2024-01'), (3, 'dev', '2024-02'), (4, 'main', '2024-03'), (5, 'dev', '2024-02'))
        SELECT branch, month, sha256(string_agg('{ ' || event_id || ' }  ', chr(10) ORDER BY event_id % 10, event_id)) AS digest FROM events JOIN p ON event_id % 7 = i GROUP BY branch, month""",
    "pinned_baseline": "SELECT 'lines|' || p_brand AS key, CAST(sum(p_size) AS DOUBLE) AS value, CAST((SELECT count(DISTINCT p_brand) FROM part) AS INTEGER) AS stamped FROM part GROUP BY p_brand",
    "exported_log": """WITH c AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey ORDER BY l_orderkey DESC LIMIT 1000)
        SELECT 'h' || l_orderkey AS hash, count(DISTINCT l_partkey) AS n, min('p' || l_partkey) AS "first" FROM lineitem SEMI JOIN c USING (l_orderkey) WHERE l_partkey % 2 = 0 GROUP BY l_orderkey""",
    "exported_deltas": "SELECT 'h' || l_orderkey AS hash, count(*) FILTER (WHERE l_returnflag = 'N') AS added, count(*) FILTER (WHERE l_returnflag <> 'N') AS deleted FROM lineitem GROUP BY l_orderkey",
    "code_delta": f"WITH {_NUM} SELECT CAST(sum(added) FILTER (WHERE NOT contains(path, 'node_modules')) + (SELECT coalesce(sum(added), 0) FROM n WHERE path LIKE '%7.ts') AS BIGINT) AS added, CAST(sum(deleted) FILTER (WHERE NOT contains(path, 'node_modules')) AS BIGINT) AS deleted FROM n WHERE {_TS}",
    "changed_paths": f"WITH {_NUM} SELECT DISTINCT path FROM n WHERE added > 40 OR deleted = 0 OR path LIKE '%1.py'",
    "commits_since": "SELECT c_custkey AS hash, n FROM customer LEFT JOIN (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS INTEGER) AS n FROM orders) ON o_orderkey = c_custkey",
    "scanned_files": f"WITH {_KEPT} SELECT path, 6 AS lines, sha1(text) AS hash FROM disk",
    "spec_folders": f"WITH {_KEPT} SELECT dir, min(path) AS spec FROM disk WHERE tail = '.spec.md' GROUP BY dir",
    "test_files": f"WITH {_KEPT} SELECT path, tail = '.test.ts' AS test, tail = '.test.ts' AS context_test FROM disk",
    "code_surface": f"WITH {_KEPT}, t AS (SELECT * FROM g WHERE tail <> '.spec.md') SELECT 'export' AS kind, 'f' || k AS name, '' AS member FROM t UNION SELECT 'export', 'U' || (k % 50), '' FROM t UNION SELECT 'domain', 'U' || (k % 50), unnest(['a', 'b', 'c' || (k % 7)]) FROM t",
    "code_sites": f"WITH {_KEPT} SELECT 'U' || (k % 50) AS name, 'union' AS kind, path AS file, 'a b c' || (k % 7) AS keys FROM g WHERE tail <> '.spec.md'",
    "code_tests": f"WITH {_KEPT} SELECT path, 'does ' || k AS name, 6 AS line FROM g WHERE tail <> '.spec.md'",
    "resolved_imports": f"WITH {_KEPT} SELECT a.path AS source, './m' || (a.k + 9) AS spec, b.path AS target FROM g a JOIN g b ON b.k = a.k + 9 AND b.dir = a.dir AND b.tail = '.ts' WHERE a.tail <> '.spec.md'",
    "header_comments": f"WITH {_KEPT} SELECT path AS file, 'Part ' || k || ' of it.' || chr(10) || 'Second line.' AS text FROM g",
    "python_facts": """WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 17 <> 0)
        SELECT path, 'import' AS fact, 'os' AS name, NULL AS detail, 1 AS line, NULL AS keys, NULL AS doc FROM p UNION ALL SELECT path, 'symbol', 'K' || k, NULL, 2, NULL, NULL FROM p UNION ALL SELECT path, 'symbol', 'run', 'K' || k, 3, NULL, 'Does it.' FROM p
        UNION ALL SELECT path, 'domain', 'NAMES', 'list', 6, 'a b n' || (k % 5), NULL FROM p UNION ALL SELECT path, 'symbol', 'test_' || (k % 3), NULL, 7, NULL, NULL FROM p UNION ALL SELECT path, 'test', 'test_' || (k % 3), NULL, 7, NULL, NULL FROM p""",
    "test_reports": """SELECT p_partkey AS run, 'a > ' || p_partkey AS full_name, 'passed' AS status, 'f' || (p_partkey % 5) AS file, CAST(p_size AS DOUBLE) AS duration, 'a > ' || p_partkey AS "function" FROM part
        UNION ALL SELECT p_partkey, 't.py::test_x[' || p_partkey || ']', 'failed', 't.py', 500.0, 'test_x' FROM part WHERE p_partkey % 3 = 0""",
    "manifests": """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0) SELECT 'dependencies|' || k AS key, CASE WHEN k % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS value, 'packages' AS unit FROM s
        UNION ALL SELECT 'devDependencies|' || k, 1.0, 'packages' FROM s UNION ALL SELECT 'peerDependencies|' || k, 0.0, 'packages' FROM s""",
    "probes": "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN c_custkey + 0.5::DOUBLE END AS value FROM customer",
    "bindings": "SELECT 'B' || (c_custkey % 100) AS name, string_agg(DISTINCT CASE WHEN c_custkey % 100 < 10 AND c_custkey % 200 >= 100 THEN 'kv' ELSE 'db' END, '!' ORDER BY CASE WHEN c_custkey % 100 < 10 AND c_custkey % 200 >= 100 THEN 'kv' ELSE 'db' END) AS kind FROM customer GROUP BY 1",
    "loose_json": """SELECT p_partkey AS k, '{"a":"//' || (p_partkey % 3) || '","b":[' || p_partkey || ']}' AS jsonc, '{"x":{"n":' || p_partkey || ',"s":"q"}}' AS toml FROM part""",
    "component_specs": r"""SELECT s_suppkey, 'Core ' || s_suppkey AS name, 'Serve ' || s_suppkey || '.' AS intent, 'a_' || s_suppkey || ' imports b|lives in z' AS claims, 'holds ' || s_suppkey AS invariants, 'inv ' || s_suppkey AS refuted,
        'web:-:outer|store:web:inner ' || s_suppkey AS zones, md5(replace('# Core @' || chr(10) || chr(10) || '## intent' || chr(10) || 'Serve @.' || chr(10) || chr(10) || '## claims' || chr(10) || '- a\_@ imports b' || chr(10) || '- lives in z' || chr(10) || chr(10) || '## invariants' || chr(10) || '- holds @' || chr(10) || chr(10)
          || '## refutations' || chr(10) || '- inv @: seen' || chr(10) || '- inv @: again' || chr(10) || chr(10) || '## zones' || chr(10) || '- web: outer' || chr(10) || '- store inside web: inner @' || chr(10) || 'NEW' || chr(10), '@', CAST(s_suppkey AS VARCHAR))) AS spliced,
        '<!--b-->old<!--e-->' AS region, 'because' AS why FROM supplier""",
    "markdown_domains": "SELECT CAST(s_suppkey AS VARCHAR) AS file, 'md-table' AS kind, 'a' || s_suppkey || ' b c' AS keys FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'alternation', 'x y z' || (s_suppkey % 4) FROM supplier",
    "prose_of_documents": r"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        f AS (SELECT *, sum(CASE WHEN regexp_matches(said, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS fences FROM l),
        p AS (SELECT file, line, regexp_replace(trim(said), '^([-*+]|[0-9]+\.)\s+', '') AS said FROM f WHERE fences % 2 = 0 AND NOT regexp_matches(said, '^\s*(```|~~~)') AND NOT regexp_matches(said, '^\s*(#|\|)') AND trim(said) <> ''),
        i AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS island FROM p), g AS (SELECT file, min(line) AS line, string_agg(said, ' ' ORDER BY line) AS said FROM i GROUP BY file, island),
        s AS (SELECT file, line, unnest(string_split(regexp_replace(said, '([.!?])\s+([A-Z0-9"''(`\[*_])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS text FROM g)
        SELECT file, count(*) AS n, CAST(max(line) AS INTEGER) AS "last", CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY file""",
    "patch_reads": """SELECT o_orderkey AS k, 's' || (o_orderkey % 5) AS session, 'apply_patch' AS tool, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey || '.ts b.ts c' || (o_orderkey % 7) || '.ts d.ts' ELSE 'r' || o_orderkey || '.ts' END AS paths,
        CASE WHEN o_orderkey % 2 = 0 THEN 'add update move delete' ELSE '' END AS ops FROM orders""",
    "premise_leases": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 10 < 5 THEN 'live' ELSE 'missing' END
        WHEN o_orderkey % 20 >= 15 OR o_orderkey % 30 >= 25 THEN 'missing' WHEN o_orderkey % 20 >= 10 THEN 'moved' ELSE 'live' END AS status FROM orders""",
}
