"""Trees of digests against a comparison of whole snapshots."""

import random

from strata.operators import digests as D


def frame(spark, files):
    return spark.createDataFrame([*files.items(), (None, "x")], "path string, content string")


def test_changes_equal_a_full_comparison(spark):
    rng = random.Random(4)
    names = ["a", "b", "c.ts", "", "é"]
    make = lambda: "/".join(rng.choice(names) for _ in range(rng.randrange(1, 6)))
    one = {make(): rng.choice(["x", "y", None, ""]) for _ in range(150)}
    for change in (0, 30):
        two = dict(one)
        for path in rng.sample(sorted(one), change):
            if rng.random() < 0.5:
                del two[path]
            else:
                two[path] = "z"
        two |= {f"{make()}/new": "n" for _ in range(change // 3)}
        want = {(p, "added" if p not in one else "removed" if p not in two else "changed") for p in {*one, *two} if (p in one) != (p in two) or one.get(p) != two.get(p)}
        got = D.changed(spark, D.tree(frame(spark, one), 3), D.tree(frame(spark, two), 3)).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in D.changed(spark, D.tree(frame(spark, {})), D.tree(frame(spark, {"a/b": "x"}))).collect()} == {("a/b", "added")}


def test_what_is_read_follows_the_change(spark):
    files = {f"d{i % 40}/e{i % 7}/f{i}": "x" for i in range(2000)}
    old, new = (D.tree(frame(spark, x), 32) for x in (files, files | {"d3/e3/f3": "y"}))
    read, real = [], D.Tree.level
    try:
        D.Tree.level = lambda self, s, depth, buckets: read.append(real(self, s, depth, buckets).count()) or real(self, s, depth, buckets)
        assert [tuple(r) for r in D.changed(spark, old, new).collect()] == [("d3/e3/f3", "changed")]
    finally:
        D.Tree.level = real
    assert len(read) == 6 and sum(read) < 2 * 200
