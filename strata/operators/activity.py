"""Host events: who an event belongs to, its identity, the commands it shows, doubts it records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.columns import content_id


def _text(payload: Column, *paths: str) -> Column:
    """The first of some JSON paths that holds a text."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths])


# Events whose agent is the parent's if the payload names none.
SHARED_EVENTS = ("PostToolUse", "SubagentStart", "SubagentStop")


def attribution(event: Column, payload: Column) -> Column:
    """struct<session, parent_session, agent_id, attribution> of an event's JSON: agent, parent-fallback,
    session or unknown."""
    parent, agent = _text(payload, "$.session_id", "$.sessionId"), _text(payload, "$.agent_id", "$.agentId")
    shared = event.isin(*SHARED_EVENTS)
    grade = F.when(agent.isNotNull(), "agent").when(parent.isNull(), "unknown").when(shared, "parent-fallback").otherwise("session")
    return F.struct(
        F.coalesce(agent, parent, F.lit("unknown")).alias("session"),
        F.when(agent.isNotNull() | shared, parent).alias("parent_session"),
        agent.alias("agent_id"),
        grade.alias("attribution"),
    )


def event_identity(session: Column, event: Column, turn: Column, tool_use: Column) -> Column:
    """An id that a replay of the event has too; null where neither a turn nor a tool use anchors it."""
    kind = F.when(tool_use.isNotNull(), "tool").otherwise("turn")
    return F.when(turn.isNotNull() | tool_use.isNotNull(), content_id("e-", 16, kind, session, event, F.coalesce(turn, F.lit("")), F.coalesce(tool_use, F.lit(""))))


def replay_key(event_id: Column, *provenance: Column) -> Column:
    """The event id within what it came through; null without an id."""
    return F.when(event_id.isNotNull(), F.sha2(F.to_json(F.array(event_id, *[F.coalesce(p, F.lit("")) for p in provenance])), 256))


def command(payload: Column, program: str, launchers: tuple[str, ...] = ("npx",)) -> Column:
    """struct<kind, name, result, exit_code> of a shell event that ran just `program verify` or `program
    regulate` with plain words after it; null for anything else. Only an explicit exit code says
    how it ended."""
    text = F.get_json_object(payload, "$.tool_input.command")
    start = "|".join([program, *[rf"{x}[ \t]+{program}" for x in launchers]])
    pattern = rf"^(?:{start})[ \t]+(verify|regulate)((?:[ \t]+[A-Za-z0-9_./:@%+=,-]+)*)$"
    name = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    code = F.expr("cast(null as int)")
    for path in ("$.tool_response.exitCode", "$.tool_response.exit_code"):
        raw = F.get_json_object(payload, path)
        code = F.when(raw.rlike(r"^-?\d{1,9}$"), raw.cast("int")).otherwise(code)
    result = F.when(code.isNull(), "unknown").when(code == 0, "success").otherwise("failure")
    made = F.struct(F.when(name == "verify", "verification").otherwise("intervention").alias("kind"), name.alias("name"), result.alias("result"), code.alias("exit_code"))
    return F.when((_text(payload, "$.tool_name", "$.toolName") == "Bash") & name.isNotNull(), made)


# Words by which a candidate doubts the apparatus rather than the world.
APPARATUS = (
    "instrument", "measurement", "measured wrong", "harness", "decoder", "parser", "off-by-one", "off by one", "the tool", "the script", "the query", "the regex",
    "the counter", "the probe", "the metric", "miscount", "the test itself",
)
# Fixed value: wording that says the apparatus is fine.
AFFIRMED = r"\b(?:advisory|instrument|measurement|harness|decoder|parser|tool|script|query|regex|counter|probe|metric|test)\s+(?:is|was|are|were)\s+(?:fine|correct|right|sound|working)\b"


def explicit_doubt(candidate: Column, canonical: str, marker: str = "[instrument]") -> Column:
    said = F.trim(candidate)
    return (said == canonical) | said.startswith(f"{marker} ")


def doubts_apparatus(candidate: Column, canonical: str = "the instrument is wrong") -> Column:
    low = F.lower(candidate)
    named = F.lit(False)
    for w in APPARATUS:
        named = named | F.contains(low, F.lit(w))
    return explicit_doubt(candidate, canonical) | (~low.rlike(AFFIRMED) & named)


def with_doubt(candidates: Column, canonical: str = "the instrument is wrong") -> Column:
    """The candidates, after the canonical doubt unless one of them is explicit about it."""
    return F.when(F.exists(candidates, lambda c: explicit_doubt(c, canonical)), candidates).otherwise(F.concat(F.array(F.lit(canonical)), candidates))
