"""Paths and graphs: prefixes, overlaps, reachability, cycles, readiness, longest paths.

Prefix joins are equi-joins on exploded ancestors, so they stay hash joins. Recursions are rounds of
joins that the driver starts until a round finds nothing new; what must be walked in one order by
definition is reduced first and walked in a task for each connected part.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.shared import large, materialize, partitions


def ancestors(path: Column, itself: bool = True) -> Column:
    """A path's prefixes by whole segments, shortest first; "" (the root) is the first."""
    parts = F.split(path, "/")
    most = F.size(parts) if itself else F.size(parts) - 1
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), most), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def longest_prefix(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """(path, dir): the deepest of dirs(dir) that holds each of paths(path); null for none."""
    met = paths.select("path").distinct().withColumn("dir", F.explode(ancestors(F.col("path")))).join(dirs.select("dir").distinct(), "dir")
    deepest = met.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return paths.join(deepest, "path", "left")


def unique_suffix(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """(token, path): tokens(token) that are the end, by whole segments, of exactly one of paths(path)."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    met = paths.select("path", F.explode(ends).alias("token")).join(tokens.select("token").distinct(), "token")
    return met.groupBy("token").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("token", "path")


def first_candidate(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, spec, target): the first of imports(source, spec, candidates) that is one of paths(path)."""
    # Paths are as many as files and their size is guessed from what they are made of, so they are never broadcast.
    rows = imports.select("source", "spec", F.posexplode("candidates").alias("ord", "path")).join(paths.select("path").hint("merge"), "path")
    return rows.groupBy("source", "spec").agg(F.min_by("path", "ord").alias("target")).where("source <> target")


def overlaps(scopes: DataFrame) -> DataFrame:
    """(left, right), left < right: pairs of works whose scopes(work, base, tree) meet.

    Two exact scopes meet if equal, a tree also meets what lies under its base; base "" meets all.
    Each scope is joined to the trees among its ancestors.
    """
    rows = scopes.select("work", "base", "tree").distinct()
    any_ = rows.where("base = ''").select(F.col("work").alias("x"))
    trees = rows.where("tree").select(F.col("work").alias("x"), F.col("base").alias("at"))
    under = rows.select(F.col("work").alias("y"), F.explode(ancestors(F.col("base"))).alias("at")).join(trees, "at").select("x", "y")
    same = rows.select(F.col("work").alias("x"), F.col("base").alias("at")).join(rows.select(F.col("work").alias("y"), F.col("base").alias("at")), "at").select("x", "y")
    # An empty base meets every work: that many links are the answer itself.
    whole = any_.distinct().join(rows.select(F.col("work").alias("y")).distinct(), F.col("x") != F.col("y"))
    met = under.unionByName(same).unionByName(whole).where("x <> y")
    return met.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).distinct()


def meetings(scopes: DataFrame, *carried: str) -> DataFrame:
    """(left, right): structs of work, base, tree and what is carried, of each two scopes(work, base, tree, …) of
    different works that meet as in overlaps(), the lesser work first. See meetings_flat()."""
    columns = ("work", "base", "tree", *carried)
    return meetings_flat(scopes, *columns[1:]).select(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for c in columns]).alias(side) for side in ("left", "right")])


def meetings_flat(scopes: DataFrame, *carried: str) -> DataFrame:
    """(left_work, …, right_work, …): the pairs of meetings() with what is carried as columns. Two scopes meet either at
    one base or by a tree above the other's base, so each pair is made once, where it is joined, and isn't shuffled again.

    Scopes are dealt by folders to as many tasks as there are partitions and merged there: there are many more pairs than
    scopes, so neither the few bytes of these nor the files that they are read from tell how many tasks pairs need."""
    columns, n = ("work", *carried), partitions(scopes)
    rows = scopes.select("base", (F.col("tree") | (F.col("base") == "")).alias("over"), *[F.col(c).alias(f"_{c}") for c in columns])
    side = lambda df, name: df.select("at", *[F.col(f"_{c}").alias(f"{name}_{c}") for c in columns])
    joined = lambda x, y: side(x, "x").join(large(side(y, "y")), "at")
    pairs = lambda both, a, b: both.where(F.col(f"{a}_work") < F.col(f"{b}_work")).select(*[F.col(f"{x}_{c}").alias(f"{name}_{c}") for x, name in ((a, "left"), (b, "right")) for c in columns])
    here, below = rows.withColumn("at", F.col("base")).repartition(n, "at"), rows.where("base <> ''")
    tree = joined(here.where("over and at <> ''"), below.withColumn("at", F.explode(F.slice(ancestors(F.col("base"), itself=False), 2, 1 << 20))).repartition(n, "at"))
    # The root is above all, so what is at it meets the others in n tasks.
    root = joined(rows.where("base = ''").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), below.withColumn("at", F.pmod(F.xxhash64("_work"), F.lit(n)).cast("int")))
    # Which of the two is less is a condition of two joins: to choose each column of each pair by it takes longer than to test pairs twice.
    return reduce(DataFrame.unionByName, [pairs(joined(here, here), "x", "y"), pairs(tree, "x", "y"), pairs(tree, "y", "x"), pairs(root, "x", "y"), pairs(root, "y", "x")])


def with_others(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """rows(work, …) plus others: the works that meetings() of scopes(work, base, tree) pairs with each, sorted, without
    making any pair. All exact scopes of a folder meet the same works, and all trees of one do, so their names are put in
    order once for each folder and join its works last; of a work with several scopes they are put together after that."""
    rows_ = scopes.select("work", "base", (F.col("tree") | (F.col("base") == "")).alias("over")).where("work is not null and base is not null")
    by = rows_.groupBy("work").agg(F.collect_set(F.struct("base", "over")).alias("places"))
    # All lies under the root: only if something is at it does a name go there.
    top = 2 if rows_.where("base = ''").isEmpty() else 1
    above = lambda: F.explode(F.slice(ancestors(F.col("base"), itself=False), top, 1 << 20))
    here = rows_.groupBy("base").agg(F.collect_set("work").alias("here"), F.collect_set(F.when(F.col("over"), F.col("work"))).alias("trees"), F.bool_or(~F.col("over")).alias("exact"))
    trees = here.where(F.size("trees") > 0).select(F.col("base").alias("at"), "trees")
    up = here.select("base", above().alias("at")).join(large(trees), "at").groupBy("base").agg(F.flatten(F.collect_list("trees")).alias("up"))
    down = rows_.select("work", above().alias("at")).join(large(trees.select("at")), "at").groupBy(F.col("at").alias("base")).agg(F.collect_set("work").alias("down"))
    none = F.array().cast("array<string>")
    all_ = here.join(large(up), "base", "left").join(large(down), "base", "left")
    names = lambda *more: F.array_sort(F.array_distinct(F.concat("here", *[F.coalesce(c, none) for c in more])))
    # At most two rows for each folder: of what its exact scopes meet, and of what its trees do.
    each = F.array_compact(F.array(F.when(F.col("exact"), F.struct(F.lit(False).alias("over"), names("up").alias("names"))), F.when(F.size("trees") > 0, F.struct(F.lit(True).alias("over"), names("up", "down").alias("names")))))
    lists = all_.select("base", F.explode(each).alias("e")).select("base", "e.over", "e.names")
    placed = materialize(rows.join(large(by), "work", "left"), "placed")  # read for works without scopes, with one and with more
    n = partitions(rows)
    others = lambda c: F.array_remove(c, F.col("work")).alias("others")
    one = placed.where(F.size("places") == 1).withColumns({c: F.col("places")[0][c] for c in ("base", "over")}).repartition(n, "base", "over").join(large(lists), ["base", "over"])
    more = placed.where(F.size("places") > 1).select("work", F.explode("places").alias("p")).select("work", "p.base", "p.over").join(large(lists), ["base", "over"])
    more = more.groupBy("work").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    several = placed.where(F.size("places") > 1).join(large(more), "work")
    alone = placed.where("places is null").select(*rows.columns, none.alias("others"))
    return alone.unionByName(one.select(*rows.columns, others("names"))).unionByName(several.select(*rows.columns, others("names")))


def count_meetings(scopes: DataFrame) -> DataFrame:
    """(n): how many pairs meetings() has, without making any: in each folder its scopes with each other and its
    trees with what lies under it, less the same of each work by itself."""
    rows = scopes.select("work", "base", (F.col("tree") | (F.col("base") == "")).alias("over")).withColumn("at", F.explode(ancestors(F.col("base"))))
    here = F.col("at") == F.col("base")
    made = lambda keys: rows.groupBy(*keys).agg(F.count_if(here).alias("same"), F.count_if(here & F.col("over")).alias("trees"), F.count_if(~here).alias("under")).agg(
        F.coalesce(F.sum((F.col("same") * (F.col("same") - 1) / 2).cast("long") + F.col("trees") * F.col("under")), F.lit(0)).alias("n")
    )
    return made(["at"]).crossJoin(F.broadcast(made(["work", "at"]).withColumnRenamed("n", "own"))).select((F.col("n") - F.col("own")).alias("n"))  # one row each


def meeting_works(scopes: DataFrame) -> DataFrame:
    """(work): the works that meetings() pairs with another, without making any pair: of each folder the least and
    the greatest work at it, with a tree at it and under it say whether there is another than the work itself."""
    rows = scopes.select("work", "base", (F.col("tree") | (F.col("base") == "")).alias("over")).distinct()
    ends = lambda name, c: (F.min(F.when(c, F.col("work"))).alias(f"{name}_lo"), F.max(F.when(c, F.col("work"))).alias(f"{name}_hi"))
    other = lambda name: F.coalesce((F.col(f"{name}_lo") != F.col("work")) | (F.col(f"{name}_hi") != F.col("work")), F.lit(False))
    here = F.col("at") == F.col("base")
    # What is at the root or above all is one row, so that no join deals all works to one task.
    top = rows.agg(*ends("all", F.lit(True)), *ends("root", F.col("base") == ""))
    rooted = rows.crossJoin(F.broadcast(top)).where(((F.col("base") == "") & other("all")) | other("root")).select("work")
    each = rows.where("base <> ''").withColumn("at", F.explode(F.slice(ancestors(F.col("base")), 2, 1 << 20)))
    folders = each.groupBy("at").agg(*ends("same", here), *ends("tree", here & F.col("over")), *ends("any", F.lit(True)))
    found = each.join(folders, "at").where((here & other("same")) | other("tree") | (here & F.col("over") & other("any"))).select("work")
    return found.unionByName(rooted).distinct()


#: Hops that reach() goes one by one before it contracts what is left.
HOPS = 16


def reach(edges: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(node): what can be reached from seeds(node) over edges(source, target), seeds included.

    A round joins only the nodes found last, and drops those known already, until none is new. What is
    farther than `hops` is contracted first: a node with one way in is reached if and only if that way's
    source is, so trees and chains hang on the node they begin at, found by doubling pointers. What comes of
    it is contracted again as long as that helps, so a chain takes rounds in the logarithm of its length.
    """
    found = frontier = seeds.select("node").distinct()
    for _ in range(hops):
        step = edges.join(frontier, F.col("source") == F.col("node"), "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = materialize(step.join(found, "node", "left_anti"), "reach")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    found = materialize(found, "reach")
    # From here on what is found counts as one node, and edges into it say nothing new.
    left = materialize(edges.where("source <> target").join(found.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target").distinct(), "reach")
    hung = _hung(left, found)
    if hung is None:
        return reach(left, found, 1 << 30)
    ends = left.join(hung.toDF("source", "root"), "source", "left").select(F.coalesce("root", "source").alias("source"), "target")
    above = materialize(ends.join(hung.toDF("target", "root"), "target", "left_anti").where("source <> target").distinct(), "reach")
    tops = reach(above, found, hops)
    return tops.unionByName(hung.join(tops.toDF("root"), "root", "left_semi").select(F.col("id").alias("node")).join(tops, "node", "left_anti"))


def _hung(edges: DataFrame, found: DataFrame) -> DataFrame | None:
    """(id, root) of the nodes with one way in, other than found ones, and the node that their tree begins at; None
    if there are none. A ring that nothing leads into begins nowhere, has no row and isn't reached."""
    ways = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("parent")).where("n = 1").select("id", "parent")
    one = materialize(ways.join(found.toDF("id"), "id", "left_anti"), "ways")
    if one.isEmpty():
        return None
    tops = one.select(F.col("parent").alias("id")).distinct().join(one.select("id"), "id", "left_anti").withColumn("parent", F.lit(None).cast(dict(one.dtypes)["parent"]))
    return materialize(root_of(one.unionByName(tops)).where("hops > 0").select("id", "root"), "hung")


def parts(edges: DataFrame) -> DataFrame:
    """(node, part): the weakly connected part of each node of edges(source, target), named by its least node.

    In each round every node points to the least of what it and its neighbours point to, and so does what
    it pointed to itself; then pointers are followed once more. Chains of pointers so halve, and the rounds
    follow the logarithm of a part's width.
    """
    both = materialize(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "links")
    up = materialize(both.groupBy("source").agg(F.min("target").alias("low")).select(F.col("source").alias("node"), F.least("source", "low").alias("up")), "parts")
    while True:
        # What each node's neighbours point to, at best; and the same for what it points to.
        seen = both.join(up.toDF("target", "theirs"), "target").groupBy("source").agg(F.min("theirs").alias("low")).withColumnRenamed("source", "node")
        own = up.join(seen, "node").select("node", "up", F.least("up", "low").alias("low"))
        hooked = own.select(F.col("up").alias("node"), "low").unionByName(own.select("node", "low")).groupBy("node").agg(F.min("low").alias("low"))
        new = hooked.join(hooked.select(F.col("node").alias("low"), F.col("low").alias("further")), "low").select("node", F.least("low", "further").alias("low"))
        now = materialize(up.join(new, "node").select("node", F.least("up", "low").alias("low"), (F.col("low") < F.col("up")).alias("moved")), "parts")
        up = now.select("node", F.col("low").alias("up"))
        if now.where("moved").isEmpty():
            return up.select("node", F.col("up").alias("part"))


def _trimmed(edges: DataFrame, *ends: tuple[str, str], least: float = 0.2) -> DataFrame:
    """edges without those whose node `of` is no other edge's `at`, for each (of, at), again and again, as long as
    that takes away a fifth of what is left. None is left where it goes on to the end."""
    left, n = edges, edges.count()
    while n:
        kept = left
        for of, at in ends:
            kept = kept.join(left.select(F.col(at).alias(of)).distinct(), of, "left_semi").select("source", "target")
        left = materialize(kept, "trimmed")
        n, before = left.count(), n
        if before - n < least * before:
            break
    return left


def _one_way(edges: DataFrame) -> bool:
    """Whether all edges lead up, or all down, in the order of the nodes or in that by length first, which
    numbers as text follow. Nothing that leads one way only comes back."""
    orders = [lambda c: F.struct(F.col(c)), lambda c: F.struct(F.length(F.col(c).cast("string")), F.col(c))]
    up = [F.bool_and(order("source") < order("target")) for order in orders]
    down = [F.bool_and(order("source") > order("target")) for order in orders]
    return any(x is not False for x in edges.agg(*[x.alias(f"x{i}") for i, x in enumerate(up + down)]).first())


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle): those that a walk of edges(source, target) finds, each from its least node on.

    The walk goes depth first from every node in order, over the targets in order, and never enters
    a node twice; an edge to a node that the walk is inside of closes a cycle. So there is at most one
    for each edge, and one at least if there is a cycle at all, of any length. An edge from a node to
    itself is a cycle wherever the walk is. Others have none if they all lead one way in an order of the
    nodes, or if all can be trimmed from both ends. Otherwise nodes that lead nowhere, which don't change
    the walk, go as far as few rounds take them, and every weakly connected part, which no other meets,
    is walked by a task of its own: it is a walk in one order by definition, so its edges must fit a
    task. Nodes sort as what they are, numbers or text.
    """
    kind = dict(edges.dtypes)["source"]
    all_ = materialize(edges.select("source", "target").where("source is not null and target is not null").distinct(), "cycles")
    loops = all_.where("source = target").select(F.array("source").alias("cycle"))
    others = all_.where("source <> target")
    if _one_way(others) or _trimmed(others, ("target", "source"), ("source", "target")).isEmpty():
        return loops
    left = materialize(_trimmed(others, ("target", "source")), "cycles")

    def walk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        onward: dict = {}
        for s, t in sorted(zip(table.column("source").to_pylist(), table.column("target").to_pylist(), strict=True)):
            onward.setdefault(s, []).append(t)
        found, left_, at = set(), set(), {}
        for first in sorted({*onward, *(t for ts in onward.values() for t in ts)}):
            if first in left_:
                continue
            path, todo, at = [first], [iter(onward.get(first, ()))], {first: 0}
            while path:
                t = next(todo[-1], None)
                if t is None:
                    todo.pop()
                    node = path.pop()
                    del at[node]
                    left_.add(node)
                elif t in at:
                    loop = path[at[t] :]
                    k = loop.index(min(loop))
                    found.add(tuple(loop[k:] + loop[:k]))
                elif t not in left_:
                    at[t] = len(path)
                    path.append(t)
                    todo.append(iter(onward.get(t, ())))
        return pa.table({"cycle": pa.array([list(c) for c in sorted(found)], pa.list_(table.schema.field("source").type))})

    of = parts(left).withColumnRenamed("node", "source")
    return left.join(of, "source").groupBy("part").applyInArrow(walk, f"cycle array<{kind}>").unionByName(loops)


def readiness(works: DataFrame, needs: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """(work, readiness) from works(work, state) and needs(work, dependency): done, active, blocked,
    waiting or ready. invalid(work) are blocked. A dependency that doesn't exist counts as none."""
    states = works.select(F.col("work").alias("dependency"), F.col("state").alias("other"))
    met = needs.join(states, "dependency").groupBy("work").agg(F.bool_or(F.col("other").isin("blocked", "cancelled")).alias("stuck"), F.bool_or(~F.col("other").isin("blocked", "cancelled", "completed")).alias("open"))
    rows = works.join(met, "work", "left")
    rows = rows.join(invalid.select("work").distinct().withColumn("bad", F.lit(True)), "work", "left") if invalid is not None else rows.withColumn("bad", F.lit(False))
    said = (
        F.when(F.col("state").isin("completed", "cancelled"), "done").when(F.col("state") == "active", "active").when(F.col("state") == "blocked", "blocked")
        .when(F.coalesce("bad", F.lit(False)) | F.coalesce("stuck", F.lit(False)), "blocked").when(F.coalesce("open", F.lit(False)), "waiting").otherwise("ready")
    )
    return rows.select("work", said.alias("readiness"))


# The states in which a piece of work has ended.
ENDED = ("completed", "cancelled")


def graph_problems(works: DataFrame, needs: DataFrame, synthesized: DataFrame | None = None) -> DataFrame:
    """(work, problem, related) of works(work, state, parent), needs(work, dependency) and what closed
    works took in, synthesized(work, child).

    missing-parent and missing-dependency: nothing of that name; terminal-parent: alive under an ended
    one; dependency-order: active or completed before what it needs; invalid-synthesis: took in what
    isn't a completed child; missing-synthesis: closed without a completed child of its own;
    parent-cycle and dependency-cycle: at the least work of the cycle, related to the others and
    back to it. related is the other work, or the cycle's works joined by spaces.
    """
    w = works.select(F.col("work").cast("string").alias("work"), "state", F.col("parent").cast("string").alias("parent")).distinct()
    n = needs.select(F.col("work").cast("string").alias("work"), F.col("dependency").cast("string").alias("dependency")).distinct()
    said = lambda df, problem, related: df.select("work", F.lit(problem).alias("problem"), F.col(related).alias("related"))
    known = w.select(F.col("work").alias("other"), F.col("state").alias("other_state"), F.col("parent").alias("other_parent"))
    under = w.where("parent is not null").join(known, F.col("parent") == F.col("other"), "left")
    live = ~F.col("state").isin(*ENDED)
    parts = [said(under.where("other is null"), "missing-parent", "parent"), said(under.where(F.col("other_state").isin(*ENDED) & live), "terminal-parent", "parent")]
    need = n.join(w.select("work", "state"), "work").join(known, F.col("dependency") == F.col("other"), "left")
    parts += [said(need.where("other is null"), "missing-dependency", "dependency"), said(need.where("state in ('active', 'completed') and other_state <> 'completed'"), "dependency-order", "dependency")]
    if synthesized is not None:
        took = synthesized.select(F.col("work").cast("string").alias("work"), F.col("child").cast("string").alias("child")).distinct()
        met = took.join(known, F.col("child") == F.col("other"), "left")
        wrong = F.col("other").isNull() | ~F.coalesce(F.col("other_parent") == F.col("work"), F.lit(False)) | (F.col("other_state") != "completed")
        parts.append(said(met.where(wrong), "invalid-synthesis", "child"))
        ended = w.where(F.col("state").isin(*ENDED)).select("work")
        done = w.where("state = 'completed' and parent is not null").select(F.col("parent").alias("work"), F.col("work").alias("child"))
        parts.append(said(done.join(ended, "work", "left_semi").join(took, ["work", "child"], "left_anti"), "missing-synthesis", "child"))
    here = w.select(F.col("work").alias("target")).distinct()
    for kind, edges in (("parent-cycle", w.where("parent is not null").select(F.col("work").alias("source"), F.col("parent").alias("target"))), ("dependency-cycle", n.toDF("source", "target"))):
        inside = edges.join(here, "target", "left_semi").join(here.toDF("source"), "source", "left_semi")
        loops = cycles(inside.select("source", "target"))
        first = F.get("cycle", F.lit(0))
        parts.append(loops.select(first.alias("work"), F.lit(kind).alias("problem"), F.array_join(F.concat(F.slice("cycle", F.lit(2), F.size("cycle")), F.array(first)), " ").alias("related")))
    return reduce(DataFrame.unionByName, parts).distinct()


def root_of(nodes: DataFrame) -> DataFrame:
    """(id, root, hops): the last ancestor over nodes(id, parent) and how far up it is. Pointers double
    in each round, so the rounds follow the logarithm of the longest chain; a chain that leads into
    a loop, or to a parent that doesn't exist, has no root."""
    top = nodes.where("parent is null").select("id")
    now = nodes.select("id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNotNull().cast("long").alias("hops"))
    rounds = int(nodes.count()).bit_length() + 1
    for _ in range(rounds):
        further = now.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("hops").alias("more"))
        nxt = materialize(now.join(large(further), "up").select("id", F.col("further").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("further") != F.col("up")).alias("moved")), "roots")
        now = nxt.select("id", "up", "hops")
        if nxt.where("moved").isEmpty():
            break
    return now.join(large(top.toDF("up")), "up", "left_semi").select("id", F.col("up").alias("root"), "hops")


# Fixed value: the steps after which the search for the longest path ends where regions lead in circles.
SPINE_STEPS = 40_000


def longest_spine(crossings: DataFrame, steps: int = SPINE_STEPS) -> DataFrame:
    """(pos, region, complete): the longest simple path over crossings(from, to, heat).

    It starts at regions that nothing leads to (all regions if every one is led to) and goes on
    only through regions that lead further. Of equally long ones the hottest wins, then the one
    whose path is least by name. Where nothing leads in a circle the best path to each region follows
    from the best ones to those before it, so one pass over the links finds it, of any length. Otherwise
    longest paths are found by trying all, so the search ends after `steps` steps: then complete is false
    and a longer path may exist. Regions and their links, summed before, are walked in one task.
    """
    linked = crossings.where("from <> to").groupBy("from", "to").agg(F.sum(F.coalesce("heat", F.lit(0.0))).alias("heat"))
    alone = crossings.where("from = to").select("from", "to", F.lit(0.0).alias("heat")).distinct()

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        links = sorted(zip(table.column("from").to_pylist(), table.column("to").to_pylist(), table.column("heat").to_pylist(), strict=True))
        onward: dict[str, list[tuple[str, float]]] = {r: [] for pair in links for r in pair[:2]}
        for f, t, h in links:
            if f != t:
                onward[f].append((t, h))
        led = {t for ts in onward.values() for t, _ in ts}
        starts = sorted(r for r in onward if r not in led) or sorted(onward)
        path = _spine_of_acyclic(onward, starts)
        left = 1
        if path is None:
            path, left = _spine_by_search(onward, starts, steps)
        return pa.table({"pos": pa.array(range(len(path)), pa.int32()), "region": pa.array(path, pa.string()), "complete": pa.array([left > 0] * len(path), pa.bool_())})

    return linked.unionByName(alone).groupBy(F.lit(0).alias("all")).applyInArrow(search, "pos int, region string, complete boolean")


def _spine_of_acyclic(onward: dict[str, list[tuple[str, float]]], starts: list[str]) -> list[str] | None:
    """The best path of longest_spine(); None if regions lead in a circle."""
    waits = dict.fromkeys(onward, 0)
    for ts in onward.values():
        for t, _ in ts:
            waits[t] += 1
    ready = [r for r, n in waits.items() if not n]
    #: Of each region the length and heat of the best path to it, and the region before it there.
    best: dict[str, tuple[int, float]] = {r: (1, 0.0) for r in starts}
    before: dict[str, str | None] = dict.fromkeys(starts)

    def lower(a: str | None, b: str | None) -> bool:
        """Whether the path to a is less by name than the one of the same length to b: what differs first decides."""
        less = False
        while a != b:
            less, a, b = a < b, before[a], before[b]
        return less

    done = 0
    while ready:
        r = ready.pop()
        done += 1
        for t, h in onward[r]:
            waits[t] -= 1
            if not waits[t]:
                ready.append(t)
            if r in best and onward[t]:
                new = (best[r][0] + 1, best[r][1] + h)
                if t not in best or new > best[t] or (new == best[t] and lower(r, before[t])):
                    best[t], before[t] = new, r
    if done < len(onward):
        return None
    top: str | None = None
    for r, at in best.items():
        if top is None or at > best[top] or (at == best[top] and lower(r, top)):
            top = r
    path: list[str] = []
    while top is not None:
        path.append(top)
        top = before[top]
    return path[::-1]


def _spine_by_search(onward: dict[str, list[tuple[str, float]]], starts: list[str], left: int) -> tuple[list[str], int]:
    """The best path of longest_spine() among those that `left` steps try, and the steps that are left."""
    top: tuple[int, float] = (0, 0.0)
    found: list[str] = []
    for start in starts:
        if left <= 0:
            break
        left -= 1
        path, inside, warmth, todo = [start], {start}, [0.0], [iter(onward[start])]
        # A path is kept when it is about to be left, so that a long one isn't copied at each step.
        better = (1, 0.0) > top
        while path:
            t, h = next(todo[-1], (None, 0.0))
            if t is None:
                if better:
                    top, found, better = (len(path), warmth[-1]), list(path), False
                inside.discard(path.pop())
                warmth.pop(), todo.pop()
            elif t not in inside and onward[t] and left > 0:
                left -= 1
                now = (len(path) + 1, warmth[-1] + h)
                warmth.append(now[1])
                path.append(t)
                inside.add(t)
                todo.append(iter(onward[t]))
                better = now > top
    return found, left


def classify_crossings(crossings: DataFrame, spine: DataFrame) -> DataFrame:
    """crossings plus class: supply (from a source that isn't the spine's), promotion (forward on the
    spine), reach (off the spine) or aside."""
    led = crossings.where("from <> to").select(F.col("to").alias("from")).distinct().withColumn("led", F.lit(True))
    spine = materialize(spine, "spine")
    at = lambda c, n: spine.select(F.col("region").alias(c), F.col("pos").alias(n))
    rows = crossings.join(at("from", "i"), "from", "left").join(at("to", "j"), "to", "left").join(led, "from", "left")
    ambient = F.col("led").isNull() & ~F.coalesce(F.col("i") == 0, F.lit(False))
    said = F.when(ambient, "supply").when(F.coalesce(F.col("j") > F.col("i"), F.lit(False)), "promotion").when(F.col("i").isNotNull() & F.col("j").isNull(), "reach").otherwise("aside")
    return rows.withColumn("class", said).drop("i", "j", "led")


def component_links(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(source, target): edges(source, target) lifted to the owners(id, component) of both ends."""
    s, t = owner.toDF("source", "s"), owner.toDF("target", "t")
    return edges.join(s, "source").join(t, "target").where("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()


def unique_owner(symbols: DataFrame) -> DataFrame:
    """(symbol, component): symbols(symbol, component) that one component only has."""
    return symbols.groupBy("symbol").agg(F.count_distinct("component").alias("n"), F.min("component").alias("component")).where("n = 1").select("symbol", "component")


def directory_tree(paths: DataFrame) -> DataFrame:
    """(dir, depth): every directory above a path."""
    return paths.select(F.explode(ancestors(F.col("path"), itself=False)).alias("dir")).distinct().select("dir", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"))


def interleave(rows: DataFrame, lane: str, *order: str) -> DataFrame:
    """rows plus place: one of each lane in turn, lanes in the order of their first row."""
    turn = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    first = rows.groupBy(lane).agg(F.min(F.struct(*order)).alias("_lane"))
    return rows.withColumn("turn", turn).join(first, lane)
