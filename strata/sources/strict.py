"""Ledgers read all-or-nothing: every line must be what a writer of that ledger writes.

A line is judged by itself in Arrow batches (its fields, their values, its content id); what takes
several lines (files of other sessions, conflicting rows) is joins. Rows are there only if nothing
is damaged.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import schemas
from strata.functions.columns import slug
from strata.operators.activity import event_identity
from strata.operators.assembly import KINDS, RELATIONS
from strata.sources.jsonl import canonical_time, parsed, when_sound
from strata.sources.project import python_column
from strata.sources.shared import materialize

# The fields of each event of each ledger, beside those that all its events have.
WORK_FIELDS = ("version", "event", "id", "at", "session", "agent", "job", "work")
FIELDS = {
    ("work", "opened"): (*WORK_FIELDS, "parent", "objective", "criteria", "constraints", "nonGoals", "authority", "owner", "dependsOn", "readScopes", "writeScopes", "risk", "state"),
    ("work", "transitioned"): (*WORK_FIELDS, "previous", "from", "to", "reason", "evidence"),
    ("work", "handed-off"): (*WORK_FIELDS, "previous", "fromOwner", "toOwner", "reason"),
    ("work", "closed"): (*WORK_FIELDS, "previous", "from", "to", "reason", "resultEvidence", "synthesizedChildren"),
    ("consequence", "linked"): ("version", "event", "id", "at", "session", "agent", "job", "basis", "repo", "from", "relation", "to", "evidence"),
    ("defect", "recorded"): ("version", "event", "id", "at", "basis", "session", "agent", "job", "repo", "summary", "evidence", "files"),
}
# What ids of a ledger's rows begin with, and how many digits follow.
IDS = {"work": ("wev-", 16), "consequence": ("lnk-", 12), "defect": ("def-", 12)}
# What some fields may hold.
VALUES = {
    "risk": ("low", "medium", "high", "critical"), "state": ("open",), "standing": ("open", "active", "blocked"), "ended": ("completed", "cancelled"),
    "authority": ("user-directed", "orchestrator-delegated", "agent-local", "external-approved"), "basis": ("agent-assessed",),
}
# Hosts, ways and attributions of activity.
HOSTS, TRANSPORTS, ATTRIBUTIONS = ("claude", "codex", "unknown"), ("launcher", "direct"), ("agent", "session", "parent-fallback", "unknown")

_WORK, _COMMIT = re.compile(r"wrk-[a-z0-9][a-z0-9._-]{0,95}"), re.compile(r"[a-f0-9]{40}|[a-f0-9]{64}")
_TIME = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3}Z")
_SCHEMAS = {"work": schemas.WORK_EVENTS, "consequence": schemas.CONSEQUENCES, "defect": schemas.DEFECTS}


def _said(x: object) -> bool:
    return isinstance(x, str) and bool(x) and x == x.strip() and not re.search(r"[\x00-\x1f\x7f-\x9f]", x)


def _listed(x: object, good=_said, least: int = 0) -> bool:
    """A sorted list of different good values."""
    return isinstance(x, list) and len(x) >= least and all(map(good, x)) and x == sorted(set(x))


def _work_id(x: object) -> bool:
    return isinstance(x, str) and _WORK.fullmatch(x) is not None


def _path(x: object) -> bool:
    return _said(x) and not re.search(r"\\|^/|^[A-Za-z]:/|(^|/)\.{1,2}(/|$)|//|/$", x)


def _scope(x: object) -> bool:
    return x == "**" or (_path(x) and not re.search(r"[*?\[\]]", x.removesuffix("/**")))


def _object(x: object, **fields) -> bool:
    return isinstance(x, dict) and set(x) == set(fields) and all(good(x[k]) for k, good in fields.items())


def _actor(x: object) -> bool:
    return _object(x, session=lambda s: _said(s) and s != "unknown", agent=_said)


def _repo(x: object) -> bool:
    return _object(x, branch=lambda b: b is None or _said(b), commit=lambda c: c is None or (isinstance(c, str) and _COMMIT.fullmatch(c) is not None), dirty=lambda d: d is None or isinstance(d, bool))


def _ref(x: object) -> bool:
    return _object(x, kind=lambda k: k in KINDS, id=_said)


def _admitted(r: dict) -> bool:
    f, t = r["from"], r["to"]
    for name, ends, to in RELATIONS:
        if name == r["relation"]:
            return f != t and (f["kind"] == t["kind"] if ends == "the same kind" else f["kind"] in ends and t["kind"] in to)
    return False


def _one_of(name: str):
    return lambda x: x in VALUES[name]


_COMMON = {"version": lambda v: v == 1 and not isinstance(v, bool), "at": lambda x: isinstance(x, str) and _TIME.fullmatch(x) is not None, "session": lambda s: _said(s) and s != "unknown", "agent": _said, "job": _said, "work": _work_id}
_GOOD = {
    "parent": lambda p: p is None or _work_id(p), "objective": _said, "criteria": lambda x: _listed(x, least=1), "constraints": _listed, "nonGoals": _listed, "owner": _actor, "fromOwner": _actor, "toOwner": _actor,
    "authority": lambda a: _object(a, kind=_one_of("authority"), grantedBy=_said, boundary=_said), "dependsOn": lambda x: _listed(x, _work_id), "readScopes": lambda x: _listed(x, _scope), "writeScopes": lambda x: _listed(x, _scope),
    "risk": _one_of("risk"), "state": _one_of("state"), "previous": _said, "reason": _said, "resultEvidence": _listed, "synthesizedChildren": lambda x: _listed(x, _work_id), "basis": _one_of("basis"), "repo": _repo,
    "summary": _said, "files": lambda x: _listed(x, _path),
}


def stable(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_id(ledger: str, record: dict) -> str:
    prefix, digits = IDS[ledger]
    return prefix + hashlib.sha256(stable({k: v for k, v in record.items() if k != "id"}).encode()).hexdigest()[:digits]


def faults(ledger: str, text: str) -> list[str]:
    """What is wrong with one line: corrupt, shape (other fields than the event's), the names of fields with
    values that mustn't be, and forged (an id that isn't its content's)."""
    try:
        r = json.loads(text)
    except ValueError:
        return ["corrupt"]
    if not isinstance(r, dict):
        return ["corrupt"]
    event = r.get("event")
    wanted = FIELDS.get((ledger, event)) if isinstance(event, str) else None
    if wanted is None or set(r) != set(wanted):
        return ["shape"]
    good = _COMMON | _GOOD
    if ledger == "work" and event == "transitioned":
        good |= {"from": _one_of("standing"), "to": _one_of("standing"), "evidence": _listed}
    elif ledger == "work" and event == "closed":
        good |= {"from": _one_of("standing"), "to": _one_of("ended"), "resultEvidence": lambda x: _listed(x, least=int(r["to"] == "completed"))}
    elif ledger == "consequence":
        good |= {"from": _ref, "to": _ref, "evidence": _said, "relation": lambda x: not (_ref(r["from"]) and _ref(r["to"])) or _admitted(r)}
    else:
        good |= {"evidence": _said}
    bad = [k for k in sorted(wanted) if k in good and not good[k](r[k])]
    return bad or ([] if r["id"] == content_id(ledger, r) else ["forged"])


def session_file(session: Column, salt: str) -> Column:
    """The one file that a session's rows belong in."""
    return F.concat(F.lit("s-"), F.sha2(F.concat(F.lit(salt), F.lit("\0"), session), 256), F.lit(".jsonl"))


def strict(rows: DataFrame, ledger: str, file_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, damage(file, line, code)) of lines() of a ledger: work, consequence or defect.

    Beside faults(): torn, displaced (not in the file that file_of says; by default one whose name holds the
    session's safe label), and conflict (rows of one id that differ). Equal rows of one id count once; there are
    records only if there is no damage.
    """
    own = python_column(lambda t: faults(ledger, t), "array<string>", F.col("text"))
    body = F.sha2(python_column(lambda t: stable(json.loads(t)), "string", F.when(F.size("_faults") == 0, F.col("text")).otherwise("null")), 256)
    # Read six times below, so every line is judged and written once.
    judged = materialize(parsed(rows, _SCHEMAS[ledger], camel=True).withColumn("_faults", own).withColumn("_body", body).drop("_corrupt", "text"), "judged")
    name = F.substring_index("file", "/", -1)
    displaced = (name != file_of) if file_of is not None else ~F.contains(name, slug(F.col("session")))
    at = lambda df, code: df.select("file", "line", F.lit(code).alias("code"))
    sound = judged.where(F.size("_faults") == 0)
    differ = sound.groupBy("id").agg(F.count_distinct("_body").alias("n"), F.min(F.struct("file", "line")).alias("first")).where("n > 1").select("first.*")
    damage = reduce(
        DataFrame.unionByName,
        (judged.select("file", "line", F.explode("_faults").alias("code")), at(judged.where("torn"), "torn"), at(sound.where(displaced), "displaced"), at(differ, "conflict")),
    )
    records = judged.dropDuplicates(["id"]).drop("_faults", "_body", "torn", "file", "line")
    return when_sound(records, damage), damage


def activity_sound(session: Column) -> Column:
    """Whether a row of schemas.ACTIVITY is one that the session's host wrote."""
    text = lambda c: F.col(c).isNull() | (F.trim(c) != "")
    none = lambda c: F.col(c).isNull()
    ok = (F.col("version") == 1) & (F.col("session") == session) & canonical_time(F.col("at")) & (F.trim("event") != "")
    ok = ok & F.col("host").isin(*HOSTS) & F.col("transport").isin(*TRANSPORTS) & F.col("attribution").isin(*ATTRIBUTIONS)
    ok = reduce(lambda a, b: a & b, map(text, ("bundle_hash", "parent_session", "agent_id", "turn", "tool", "tool_use_id", "event_id", "experiment_id")), ok)
    ok = ok & F.col("event_id").eqNullSafe(event_identity(session, F.col("event"), F.col("turn"), F.col("tool_use_id")))
    by = (
        F.when(F.col("attribution") == "agent", F.col("agent_id").eqNullSafe(session)).when(F.col("attribution") == "session", none("agent_id") & none("parent_session"))
        .when(F.col("attribution") == "parent-fallback", none("agent_id") & F.col("parent_session").eqNullSafe(session)).otherwise((session == "unknown") & none("agent_id") & none("parent_session"))
    )
    c = F.col("command")
    result = F.when(c["exit_code"].isNull(), "unknown").when(c["exit_code"] == 0, "success").otherwise("failure")
    shown = c["kind"].isin("verification", "intervention") & c["name"].isin("verify", "regulate") & ((c["name"] == "verify") == (c["kind"] == "verification")) & (F.trim(c["command"]) != "") & (c["result"] == result)
    return F.coalesce(ok & by & (c.isNull() | F.coalesce(shown, F.lit(False))), F.lit(False))


def trace_sound(session: Column) -> Column:
    """Whether a row of schemas.READ_TRACE is one of the session; a row without a mode is a reading."""
    ok = (F.col("session") == session) & canonical_time(F.col("at")) & (F.col("tool") != "") & (F.col("path") != "") & F.coalesce("mode", F.lit("read")).isin("read", "write")
    p, o = F.col("provenance"), F.col("observation")
    moved = p.isNull() | ((p["source"] == "apply_patch") & p["operation"].isin("add", "update", "delete", "move"))
    by = (
        F.when(o["attribution"] == "agent", o["agent_id"].eqNullSafe(session)).when(o["attribution"] == "session", o["agent_id"].isNull() & o["parent_session"].isNull())
        .when(o["attribution"] == "parent-fallback", o["agent_id"].isNull() & o["parent_session"].eqNullSafe(session)).when(o["attribution"] == "unknown", o["agent_id"].isNull() & o["parent_session"].isNull())
    )
    seen = o.isNull() | ((o["version"] == 1) & o["host"].isin(*HOSTS) & o["transport"].isin(*TRANSPORTS) & by & (o["event_id"].isNull() | o["event_id"].rlike("^e-[a-f0-9]{16}$")))
    return F.coalesce(ok & F.coalesce(moved, F.lit(False)) & F.coalesce(seen, F.lit(False)), F.lit(False))


def counted(rows: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """(sound rows, one row with the number of the others) of parsed()."""
    good = F.col("_corrupt").isNull() & sound
    return rows.where(good).drop("_corrupt", "text", "torn"), rows.agg(F.count_if(~good).alias("unreadable"))
