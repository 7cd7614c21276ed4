"""Sessions as live state: equal to a cold read after appends, restarts, a rewrite and a compaction."""

import json
import os
import random
import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strata.streaming import sessions as S
from strata.streaming import tail as T


def row(rng, i, session):
    kind = rng.choice(["session", "decision", "conjecture", S.OPENED, S.CLOSED, None])
    experiment = f"{session}-e{rng.randrange(6)}" if kind in (S.OPENED, S.CLOSED) else None
    return {"session": session, "id": f"i{i % 37}", "at": f"2024-01-01T00:{rng.randrange(60):02d}:00.000Z", "kind": kind, "agent": rng.choice(["a", "b", "c"]), "experiment": experiment}


def write(path, rows, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def parsed(spark, root):
    return T.rows_of(spark, root, S.ROWS)


def cold(spark, root):
    out = S.settled(spark.read.schema(S.ROWS).option("recursiveFileLookup", "true").json(root))
    return sorted(tuple(r) for r in out.select("session", "start", "last", "entries", "agent", "open").collect())


def warm(spark, out):
    return sorted(tuple(r) for r in S.latest(spark.read.parquet(out)).select("session", "start", "last", "entries", "agent", "open").collect())


def run(spark, tmp_path):
    q = S.start(S.live_sessions(parsed(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_equal_to_a_cold_read(spark, tmp_path):
    rng, root = random.Random(8), f"{tmp_path}/in"
    unique = {}

    def some(n):
        for r in (row(rng, i, rng.choice(["s1", "s2", "s3"])) for i in range(n)):
            yield unique.setdefault((r["session"], r["id"], r["at"]), r)  # one row for each key, as content ids make sure

    files = {s: [] for s in ("s1", "s2", "s3", "all")}

    def append(n):
        for r in some(n):
            files[r["session"]].append(r)
            write(f"{root}/{r['session']}.jsonl", [r])

    append(120)
    run(spark, tmp_path)
    assert warm(spark, f"{tmp_path}/out") == cold(spark, root)
    append(60)  # a restart, with new rows
    run(spark, tmp_path)
    assert warm(spark, f"{tmp_path}/out") == cold(spark, root)
    # A compaction: two files fold into one that is there already, sources go, and rows are added at once.
    write(f"{root}/all.jsonl", sorted(files["s1"] + files["s2"], key=lambda r: (r["at"], r["id"], r["session"])))
    os.remove(f"{root}/s1.jsonl"), os.remove(f"{root}/s2.jsonl")
    append(40)
    run(spark, tmp_path)
    assert warm(spark, f"{tmp_path}/out") == cold(spark, root)
    before = S.latest(spark.read.parquet(f"{tmp_path}/out")).agg(F.sum("entries")).first()[0]
    write(f"{root}/all.jsonl", sorted(files["s1"] + files["s2"], key=lambda r: (r["id"], r["at"], r["session"])), "w")  # another order
    run(spark, tmp_path)
    assert S.latest(spark.read.parquet(f"{tmp_path}/out")).agg(F.sum("entries")).first()[0] == before
    assert warm(spark, f"{tmp_path}/out") == cold(spark, root)


def test_a_quiet_session(spark, tmp_path):
    def until(what):
        for _ in range(100):
            time.sleep(0.3)
            try:
                last = S.latest(spark.read.parquet(f"{tmp_path}/out")).first()
            except AnalysisException:  # nothing written yet
                continue
            if last is not None and what(last):
                return last
        raise AssertionError("not in time")

    write(f"{tmp_path}/in/s1.jsonl", [row(random.Random(1), 1, "s1")])
    q = S.start(S.live_sessions(parsed(spark, f"{tmp_path}/in"), quiet_seconds=1), f"{tmp_path}/out", f"{tmp_path}/cp", processingTime="500 milliseconds")
    try:
        assert until(lambda s: s.quiet).turn == 2
        write(f"{tmp_path}/in/s1.jsonl", [row(random.Random(2), 2, "s1")])
        assert until(lambda s: s.turn >= 3).session == "s1"
    finally:
        q.stop()


def test_a_prefix_is_trusted_only_whole(tmp_path):
    path = f"{tmp_path}/l.jsonl"
    rows = [{"n": i, "pad": "x" * 1000} for i in range(800)]
    write(path, rows)
    reader = T.TailReader(str(tmp_path), ".jsonl")
    one = reader.latestOffset()
    assert [(s.start, s.end) for s in reader.partitions(reader.initialOffset(), one)] == [(0, os.path.getsize(path))]
    rows[400]["pad"] = "y" * 1000  # in the middle, with equal length, and a row more
    write(path, [*rows, {"n": 800, "pad": ""}], "r+")
    two = reader.latestOffset()
    assert [(s.start, s.end) for s in reader.partitions(one, two)] == [(0, os.path.getsize(path))]
    write(path, [{"n": 801, "pad": ""}])
    three = T.TailReader(str(tmp_path), ".jsonl")  # a restart
    now = three.latestOffset()
    (span,) = three.partitions(two, now)
    assert span.start == json.loads(two["files"])["l.jsonl"][0] and span.end == os.path.getsize(path)
    with open(path, "a") as f:
        f.write('{"n": 8')
    assert reader.latestOffset()["files"] == now["files"] and reader.partitions(now, now) == []
    os.truncate(path, 5000)
    short = reader.latestOffset()
    assert [s.start for s in reader.partitions(now, short)] == [0]
    os.remove(path)
    assert json.loads(reader.latestOffset()["files"]) == {}
