"""Schemas of the logical tables."""

from __future__ import annotations

DECISIONS = """version int, id string, session string, at string, kind string, agent string, job string, branch string, commit string, dirty boolean,
 chose string, `over` array<string>, because string, supersedes string, files array<string>, could_be array<string>, discriminated_by string, metric string,
 value double, baseline double, threshold double, unit string, finding string, work string, subject string,
 scope struct<components:array<string>,files:array<string>,symbols:array<string>,environment:array<string>>, authority string"""

ACTIVITY = """version int, at string, host string, transport string, bundle_hash string, session string, parent_session string, agent_id string, attribution string,
 event string, turn string, tool string, tool_use_id string, event_id string, experiment_id string, command struct<kind:string,name:string,command:string,result:string,exit_code:int>"""

READ_TRACE = """at string, session string, tool string, mode string, path string, provenance struct<source:string,operation:string>,
 observation struct<version:int,host:string,transport:string,bundle_hash:string,parent_session:string,agent_id:string,attribution:string,event_id:string>"""

CALIBRATION = "id string, at string, session string, patch string, changed array<string>, predicted array<string>, observed array<string>, outcome string, attribution string"

WORK_EVENTS = """version int, event string, id string, at string, session string, agent string, job string, work string, parent string, objective string, criteria array<string>,
 constraints array<string>, non_goals array<string>, authority struct<kind:string,granted_by:string,boundary:string>, owner struct<session:string,agent:string>,
 depends_on array<string>, read_scopes array<string>, write_scopes array<string>, risk string, state string, previous string, `from` string, `to` string, reason string,
 evidence array<string>, from_owner struct<session:string,agent:string>, to_owner struct<session:string,agent:string>, result_evidence array<string>, synthesized_children array<string>"""

CONSEQUENCES = """version int, event string, id string, at string, session string, agent string, job string, basis string, repo struct<branch:string,commit:string,dirty:boolean>,
 `from` struct<kind:string,id:string>, relation string, `to` struct<kind:string,id:string>, evidence string"""

DEFECTS = """version int, event string, id string, at string, basis string, session string, agent string, job string, repo struct<branch:string,commit:string,dirty:boolean>,
 summary string, evidence string, files array<string>"""

EXPERIMENTS = """event string, id string, at string, ordinal int, session string, agent string, job string, experiment string, hypothesis string, predicted_context array<string>,
 actions array<struct<id:string,text:string>>, criteria array<struct<id:string,text:string>>, trace_cursor int, activity_cursor int,
 action_results array<struct<id:string,status:string,evidence:string>>, criterion_results array<struct<id:string,status:string,evidence:string>>, outcome string"""

CLAIM_RECORDS = "node string, claim string, kind string, detail string, at string, commit string, tier string, ever_failed boolean, last_fail_at string, last_fail_commit string, runs int"

#: The kinds of rows that a ledger may hold.
DECISION_KINDS = ("session", "decision", "blocked", "retraction", "conjecture", "resolution", "dismissal")
