"""Facts of source code: symbols, imports, exports, enumerated domains, tests.

Python is read with the standard library's own grammar, in Arrow batches. For TypeScript there is
no grammar here: patterns cover exported declarations, imports, string unions, enumerations and
titles of tests, as documented at each. An adapter is a function from (path, text) to rows, so a
project can register its own.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = tuple[str, str, str | None, int, list[str] | None, str | None]
Adapter = Callable[[str, str], list[Row]]
#: fact: symbol, import, domain or test; name; parent or specifier; line; members of a domain; text.
SCHEMA = "path string, fact string, name string, detail string, line int, keys array<string>, doc string"


def _strings(nodes: list[ast.expr]) -> list[str]:
    out = [n.value for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    return out if len(out) == len(nodes) else []


def python_facts(path: str, text: str) -> list[Row]:
    """Functions and classes (detail: class they are in), imports, and domains of three members at
    least: lists, sets and keys of dictionaries of strings, Literal types, Enum classes."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[Row] = []

    def domain(name: str, keys: list[str], line: int, kind: str) -> None:
        if len(set(keys)) >= 3:
            out.append(("domain", name, kind, line, sorted(set(keys)), None))

    def visit(node: ast.AST, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.append(("symbol", n.name, owner, n.lineno, None, ast.get_docstring(n)))
                if n.name.startswith("test") and not isinstance(n, ast.ClassDef):
                    out.append(("test", f"{owner}::{n.name}" if owner else n.name, None, n.lineno, None, None))
                if isinstance(n, ast.ClassDef) and any("Enum" in ast.unparse(b) for b in n.bases):
                    domain(n.name, [t.id for s in n.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)], n.lineno, "enum")
                visit(n, n.name if isinstance(n, ast.ClassDef) else owner)
                continue
            if isinstance(n, ast.Import):
                out.extend(("import", a.name, None, n.lineno, None, None) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                out.append(("import", "." * n.level + (n.module or ""), ",".join(a.name for a in n.names), n.lineno, None, None))
            elif isinstance(n, ast.Assign | ast.AnnAssign) and n.value is not None:
                target = n.targets[0] if isinstance(n, ast.Assign) else n.target
                name = target.id if isinstance(target, ast.Name) else ""
                if isinstance(n.value, ast.List | ast.Set | ast.Tuple):
                    domain(name, _strings(n.value.elts), n.lineno, "list")
                elif isinstance(n.value, ast.Dict):
                    domain(name, _strings([k for k in n.value.keys if k is not None]), n.lineno, "table")
                elif isinstance(n.value, ast.Subscript) and ast.unparse(n.value.value).endswith("Literal") and isinstance(n.value.slice, ast.Tuple):
                    domain(name, _strings(n.value.slice.elts), n.lineno, "union")
            visit(n, owner)

    visit(tree, None)
    return out


_TS = (
    ("symbol", re.compile(r"^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|interface|type|enum)\s+([A-Za-z_$][\w$]*)", re.M)),
    ("import", re.compile(r"""^\s*(?:import|export)\b[^'"\n;]*?\bfrom\s*['"]([^'"]+)['"]|^\s*import\s*['"]([^'"]+)['"]""", re.M)),
    ("test", re.compile(r"""\b(?:test|it)\s*\(\s*(['"`])((?:\\.|(?!\1).)*)\1""")),
)
_UNION = re.compile(r"""\btype\s+([A-Za-z_$][\w$]*)\s*=\s*((?:\s*\|?\s*['"][^'"]*['"])+)""")
_ENUM = re.compile(r"\benum\s+([A-Za-z_$][\w$]*)\s*\{([^}]*)\}")


def typescript_facts(path: str, text: str) -> list[Row]:
    """Exported declarations, static imports, titles of tests given as plain strings, unions of strings
    and enumerations. Declarations inside others, and what is computed, are not seen."""
    line = lambda at: text.count("\n", 0, at) + 1
    out: list[Row] = []
    for fact, pattern in _TS:
        for m in pattern.finditer(text):
            name = m[2] if fact == "test" else next(g for g in m.groups() if g is not None)
            out.append((fact, name, None, line(m.start()), None, None))
    for kind, pattern, member in (("union", _UNION, r"""['"]([^'"]*)['"]"""), ("enum", _ENUM, r"([A-Za-z_$][\w$]*)\s*(?:=[^,]*)?(?:,|$)")):
        for m in pattern.finditer(text):
            keys = sorted(set(re.findall(member, m[2].strip())))
            if len(keys) >= 3:
                out.append(("domain", m[1], kind, line(m.start()), keys, None))
    return out


_ADAPTERS: dict[str, Adapter] = {}


def register(extension: str, adapter: Adapter) -> None:
    """An adapter for files of an extension; it takes the place of a built-in one."""
    _ADAPTERS[extension.lower()] = adapter


for _e in (".py",):
    register(_e, python_facts)
for _e in (".ts", ".tsx", ".js", ".mjs"):
    register(_e, typescript_facts)


def facts(sources: DataFrame) -> DataFrame:
    """SCHEMA rows of sources(path, text). A file of an extension without adapter has no rows."""
    adapters = dict(_ADAPTERS)
    dots = [e for e in adapters]
    wanted = F.lower("path").rlike("(" + "|".join(re.escape(e) for e in dots) + ")$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "fact", "name", "detail", "line", "keys", "doc"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = [
                (path, *r)
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for r in adapters["." + path.rsplit(".", 1)[-1].lower()](path, text or "")
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return sources.where(wanted).select("path", "text").mapInArrow(run, SCHEMA)


def surface(found: DataFrame, ref: str) -> DataFrame:
    """(kind, name, member) of facts, as the ratchet's surface tables have them."""
    exports = found.where("fact = 'symbol' and detail is null").select(F.lit("export").alias("kind"), "name", F.lit("").alias("member"))
    domains = found.where("fact = 'domain'").select(F.lit("domain").alias("kind"), "name", F.explode("keys").alias("member"))
    return exports.unionByName(domains).withColumn("ref", F.lit(ref)).distinct()


def sites(found: DataFrame) -> DataFrame:
    """Domain sites (id, name, kind, file, keys, type_link) for the similarity join."""
    return found.where("fact = 'domain'").select(
        F.xxhash64("path", "name", "line").alias("id"), "name", F.col("detail").alias("kind"), F.col("path").alias("file"), "keys", F.lit(None).cast("string").alias("type_link")
    )


def import_candidates(found: DataFrame) -> DataFrame:
    """(source, spec, candidates): the paths that a relative import may mean, in the order they are tried."""
    rows = found.where("fact = 'import'").select(F.col("path").alias("source"), F.col("name").alias("spec"))
    folder = F.regexp_extract("source", "^(.*?)/?[^/]*$", 1)
    script = F.col("spec").startswith("./") | F.col("spec").startswith("../")
    joined = F.concat_ws("/", F.nullif(folder, F.lit("")), F.col("spec"))
    plain = joined
    for _ in range(8):  # a/b/../c is a/c, ./ is nothing
        plain = F.regexp_replace(F.regexp_replace(plain, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    base = F.regexp_replace(plain, r"\.js$", "")
    ways = F.concat(F.array(plain), F.transform(F.array(*[F.lit(x) for x in (".ts", ".tsx", ".js", "/index.ts", "/index.js")]), lambda x: F.concat(base, x)))
    dotted = F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace(F.regexp_replace("spec", r"^\.", ""), r"\.", "/"))
    absolute = F.regexp_replace("spec", r"\.", "/")
    python = F.when(F.col("spec").startswith("."), F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))).otherwise(F.array(F.concat(absolute, F.lit(".py")), F.concat(absolute, F.lit("/__init__.py"))))
    return rows.select("source", "spec", F.when(script, ways).when(F.col("source").endswith(".py"), python).otherwise(F.array().cast("array<string>")).alias("candidates"))


def header_comment(sources: DataFrame) -> DataFrame:
    """(file, text): the leading comment block of sources(path, text), without its marks."""
    block = F.regexp_extract("text", r"(?s)\A(?:#![^\n]*\n)?\s*(/\*.*?\*/|(?:\s*(?://|#)[^\n]*\n?)+|\"\"\".*?\"\"\")", 1)
    plain = F.regexp_replace(F.regexp_replace(block, r"(?m)^\s*(?://+|#+|/\*+|\*+/|\*|\"\"\")\s?", ""), r"\s*(?:\*/|\"\"\")\s*$", "")
    return sources.select(F.col("path").alias("file"), F.regexp_replace(plain, r"^\s+|\s+$", "").alias("text")).where("text <> ''")
