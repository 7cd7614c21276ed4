"""The sink for ledgers that several writers append to: races, failures, repeated commits, streams."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strata.sources import ledger as L

SCHEMA = "id string, v long"


def made(spark, first, last, v=1):
    return spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(v).cast("long").alias("v"))


def ids(spark, path):
    return sorted(r.id for r in L.snapshot(spark, path, SCHEMA).collect())


def test_two_writers_race(spark, tmp_path):
    path = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: L.append_once(spark, made(spark, 10 * w, 10 * w + 30, w), path), range(4)))
    assert ids(spark, path) == sorted(f"k{i}" for i in range(60))
    numbers = sorted(r.number for r in L.generations(spark, path).collect())
    assert numbers == list(range(1, len(numbers) + 1))


def test_another_writer_between_decision_and_commit(spark, tmp_path):
    path, turns = str(tmp_path), []

    def decide(now):
        turns.append(now.count())
        if len(turns) == 1:  # another writer appends a part of the same rows while this one is at work
            L.append_once(spark, made(spark, 0, 5, 7), path)
        return made(spark, 0, 10, 1).join(now.select("id"), "id", "left_anti")

    L.change(spark, path, SCHEMA, "id", decide)
    assert turns == [0, 5]
    assert {r.id: r.v for r in L.snapshot(spark, path, SCHEMA).collect()} == {f"k{i}": 7 if i < 5 else 1 for i in range(10)}


def test_writers_of_other_keys_do_not_disturb(spark, tmp_path):
    path, turns = str(tmp_path), []
    bucket = lambda i: L.staged(made(spark, i, i + 1), "id").first().bucket
    assert bucket(1) != bucket(2)

    def decide(now):
        turns.append(1)
        if len(turns) == 1:
            L.append_once(spark, made(spark, 1, 2), path)
        return made(spark, 2, 3)

    L.change(spark, path, SCHEMA, "id", decide)
    assert turns == [1] and ids(spark, path) == ["k1", "k2"] and L.head(path) == 2


def test_a_predecessor_that_changes_is_noticed(spark, tmp_path):
    path, seen = str(tmp_path), []
    L.append_once(spark, made(spark, 1, 2), path)

    def decide(now):
        seen.append(sorted((r.id, r.v) for r in now.collect()))
        if len(seen) == 1:
            L.change(spark, path, SCHEMA, "id", lambda _: made(spark, 1, 2, 9))
        return made(spark, 2, 3)

    L.change(spark, path, SCHEMA, "id", decide, reads=F.array(F.lit("k1")))
    assert seen == [[("k1", 1)], [("k1", 1), ("k1", 9)]]


def test_refused_for_ever(spark, tmp_path):
    path = str(tmp_path)

    def decide(now):
        L.change(spark, path, SCHEMA, "id", lambda _: made(spark, 1, 2))
        return made(spark, 1, 2)

    with pytest.raises(L.Refused):
        L.change(spark, path, SCHEMA, "id", decide, tries=2)
    assert len(ids(spark, path)) == 2 and len(glob.glob(f"{path}/rows/*.jsonl")) == 2


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    path = str(tmp_path)
    L.append_once(spark, made(spark, 0, 3), path)

    def bad(now):
        return made(spark, 10, 100).repartition(4).withColumn("v", F.when(F.col("id") == "k57", F.raise_error(F.lit("lost")).cast("long")).otherwise(1))

    with pytest.raises(PySparkException, match="lost"):
        L.change(spark, path, SCHEMA, "id", bad)
    assert ids(spark, path) == ["k0", "k1", "k2"] and L.head(path) == 1
    L.vacuum(path, older_than=-1)
    assert len(glob.glob(f"{path}/rows/*")) + len([x for x in os.listdir(f"{path}/rows") if x.startswith(".") and x.endswith(".jsonl")]) == len(L._generation(path, 1)["files"])
    assert ids(spark, path) == ["k0", "k1", "k2"]


def test_a_repeated_commit_counts_once(tmp_path):
    path = str(tmp_path)
    said = [L.Staged([("a.jsonl", 1)], {3}), None, L.Staged()]
    L._commit(path, said, "t1", 0)
    L._commit(path, said, "t1", 0)
    assert L.head(path) == 1
    L._commit(path, [L.Staged([("b.jsonl", 1)], {4})], "t2", 0)
    assert L.head(path) == 2
    with pytest.raises(L.Refused):
        L._commit(path, [L.Staged([("c.jsonl", 1)], {9}, {4})], "t3", 1)
    L._commit(path, [L.Staged()], "t4", 2)
    assert L.head(path) == 2


def test_append_once_odd_rows(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("é\n\"", None), ("", 4)], SCHEMA)
    L.append_once(spark, rows, path)
    L.append_once(spark, rows, path)
    L.append_once(spark, rows.limit(0), path)
    assert sorted(((r.id, r.v) for r in L.snapshot(spark, path, SCHEMA).collect()), key=repr) == sorted([("a", 1), ("é\n\"", None), ("", 4)], key=repr)
    assert L.head(path) == 1
    with pytest.raises(PySparkException):
        L.staged(rows, "id").write.format("strata-ledger").mode("overwrite").option("path", path).option("seen", 1).save()


def test_moves(spark, tmp_path):
    path = str(tmp_path)
    works = spark.createDataFrame([("w1",), ("w2",)], "work string")
    to = lambda before, after: works.select("work", F.lit(before).cast("string").alias("before"), F.lit(after).alias("after"))
    L.move(spark, path, to(None, "open"), "a")
    L.move(spark, path, to(None, "open"), "b")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda w: L.move(spark, path, to("open", "active"), w), ["x", "y", "z"]))
    now = L.snapshot(spark, path, L.MOVES).collect()
    assert sorted((r.work, r.step, r.state) for r in now) == [("w1", 0, "open"), ("w1", 1, "active"), ("w2", 0, "open"), ("w2", 1, "active")]


def test_stream_batches_once(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(SCHEMA).json(source)
        q = L.append_stream(stream, path, "id", "s", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    made(spark, 0, 5).write.json(source)
    run()
    made(spark, 5, 9).write.mode("append").json(source)
    L.append_once(spark, made(spark, 100, 101), path)
    run()
    run()
    assert ids(spark, path) == sorted([f"k{i}" for i in range(9)] + ["k100"])
    # The second batch again, as after a crash between its commit and Spark's note of it.
    for notes in ([], glob.glob(f"{path}/streams/s/*")):  # with this sink's own note, and without
        for x in (f"{tmp_path}/cp/commits/1", f"{tmp_path}/cp/commits/.1.crc", *sorted(notes)[1:]):
            os.remove(x)
        run()
        assert ids(spark, path) == sorted([f"k{i}" for i in range(9)] + ["k100"])
