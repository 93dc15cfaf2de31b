"""Orphans, dead code, topological levels, strongly connected components, cycles."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.lineage import Steps
from loomgraph.sources.model import Graph

from .traverse import GATHER_AFTER, oriented, small


class TooManyEdges(ValueError):
    """A serial search would need more edges than its limit."""


def orphans(g: Graph) -> DataFrame:
    """Nodes without any edge; a self-loop is one."""
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id"))
    return g.nodes.join(ends, "id", "left_anti")


def dead_code(g: Graph, ignore_kinds: Iterable[str] = ()) -> DataFrame:
    """Nodes that nothing points to, that are not exported and are no files. Edges of ignore_kinds do not count."""
    edges = g.edges.filter(~F.col("kind").isin(list(ignore_kinds))) if list(ignore_kinds) else g.edges
    return g.nodes.filter((F.col("type") != "file") & ~F.coalesce("is_exported", F.lit(False))).join(edges.select(F.col("target").alias("id")), "id", "left_anti")


def inner_edges(g: Graph, kinds: Iterable[str] | None = None, loops: bool = False) -> DataFrame:
    """Distinct (here, there) between nodes of the graph."""
    ids = g.nodes.select("id")
    steps = oriented(g.edges, "out", kinds)
    if not loops:
        steps = steps.filter("here <> there")
    return steps.distinct().join(ids.withColumnRenamed("id", "here"), "here", "left_semi").join(ids.withColumnRenamed("id", "there"), "there", "left_semi").select("here", "there")


def topological_levels(g: Graph, kinds: Iterable[str] | None = None) -> tuple[DataFrame, bool]:
    """((id, level), whether the graph is acyclic). Level 0 has no incoming edge; a node's level is that of its longest way in.

    Emitting by (level, id) is the first-in-first-out order of the reference question: dependents before what they
    depend on. Nodes on or behind a cycle have no row.

    A node is ready once all its incoming edges come from levels before. Each round counts, for the ends of the last
    level's out-edges alone, how many of theirs have been met by now. Counts of nodes that are not ready yet are
    gathered in one table now and then, so a round reads a few small tables whatever the number of levels; nodes and edges are never written again.
    """
    work = Steps(g.nodes.sparkSession)
    edges, _ = work.write(inner_edges(g, kinds, loops=True))
    incoming, _ = work.write(edges.groupBy(F.col("there").alias("id")).agg(F.count(F.lit(1)).alias("all")))
    nodes, count = work.write(g.nodes.select("id").distinct())
    ready, told = work.write(nodes.join(incoming, "id", "left_anti").select("id", F.lit(0).alias("level")))
    levels, met, peeled, n = [ready], [], told["n"], told["n"]
    while n:
        if len(met) > GATHER_AFTER:  # the largest count is the last; a node that is ready gets no more
            gathered, _ = work.write(reduce(DataFrame.unionAll, met).groupBy("id").agg(F.max("met").alias("met"), F.bool_or("ready").alias("ready")).filter("NOT ready"))
            met = [gathered]
        last = small(levels[-1].select(F.col("id").alias("here")), n)
        now = edges.join(last, "here").groupBy(F.col("there").alias("id")).agg(F.count(F.lit(1)).alias("now"))
        # one exchange: what was counted before and what is counted now are rows of one table
        said = reduce(DataFrame.unionAll, [t.select("id", F.col("met").alias("before"), F.lit(0).cast("long").alias("now")) for t in met] + [now.select("id", F.lit(0).cast("long").alias("before"), "now")])
        total = said.groupBy("id").agg((F.max("before") + F.sum("now")).alias("met"), F.sum("now").alias("now")).filter("now > 0").select("id", "met")
        is_ready = F.col("met") == F.col("all")
        touched, told = work.write(total.join(incoming, "id").select("id", "met", is_ready.alias("ready")), ready=F.count_if("ready"))
        met.append(touched)
        n = told["ready"]
        peeled += n
        if n:
            levels.append(touched.filter("ready").select("id", F.lit(len(levels)).alias("level")))
    work.drop(edges, incoming, nodes)
    return reduce(DataFrame.unionAll, levels), peeled == count["n"]


def components(g: Graph, kinds: Iterable[str] | None = None) -> DataFrame:
    """(id, component): strongly connected components, named by their smallest id.

    Each node learns the smallest id that reaches it and the smallest that it reaches, both in the same jobs, with the
    labels of these labels (so long ways take a number of rounds that follows their logarithm). Nodes for which the two
    are one id are that id's component. Edges between nodes with different pairs lie in no component and go, and
    what is left starts anew; a node without edges is a component of its own.
    """
    work = Steps(g.nodes.sparkSession)
    left, told = work.write(g.nodes.select("id").distinct())
    edges, inner = work.write(inner_edges(g, kinds))
    done = []
    while told["n"] and inner["n"]:
        first, _ = work.write(left.select("id", F.col("id").alias("low"), F.col("id").alias("up")))
        labels = first
        while True:
            ends = edges.join(labels.select(F.col("id").alias("here"), F.col("low").alias("low_here"), F.col("up").alias("up_here")), "here")
            ends = ends.join(labels.select(F.col("id").alias("there"), F.col("low").alias("low_there"), F.col("up").alias("up_there")), "there").filter("low_here < low_there OR up_there < up_here")
            none = F.lit(None).cast("string")
            said = lambda end, low, up: F.struct(F.col(end).alias("id"), low.alias("low"), up.alias("up"))
            heard = ends.select(F.explode(F.array(said("there", F.col("low_here"), none), said("here", none, F.col("up_there")))).alias("e"))
            heard = heard.groupBy(F.col("e.id").alias("id")).agg(F.min("e.low").alias("new_low"), F.min("e.up").alias("new_up"))
            moved = labels.join(heard, "id", "left").select("id", F.col("low").alias("old_low"), F.col("up").alias("old_up"), F.least("low", "new_low").alias("low"), F.least("up", "new_up").alias("up"))
            lows = labels.select(F.col("id").alias("low"), F.col("low").alias("lower"))
            ups = labels.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            jumped = moved.join(lows, "low").join(ups, "up").select("id", F.least("low", "lower").alias("low"), F.least("up", "upper").alias("up"), "old_low", "old_up")
            now, moves = work.write(jumped, n_moved=F.count_if((F.col("low") != F.col("old_low")) | (F.col("up") != F.col("old_up"))))
            work.drop(labels)
            labels = now
            if not moves["n_moved"]:
                break
        pairs = labels.select("id", F.struct("low", "up").alias("pair"))
        done.append(labels.filter("low = up").select("id", F.col("low").alias("component")))
        same = edges.join(pairs.select(F.col("id").alias("here"), F.col("pair").alias("p1")), "here").join(pairs.select(F.col("id").alias("there"), F.col("pair").alias("p2")), "there")
        kept, inner = work.write(same.filter("p1 = p2 AND p1.low <> p1.up").select("here", "there"))
        rest, told = work.write(labels.filter("low <> up").select("id"))
        work.drop(edges, left)
        edges, left = kept, rest
    return reduce(DataFrame.unionAll, [*done, left.select("id", F.col("id").alias("component"))])


def cyclic_components(g: Graph, kinds: Iterable[str] | None = None) -> DataFrame:
    """(component, members array): components that hold a cycle, self-loops included. Every cycle lies in one of them."""
    members = components(g, kinds).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    loops = self_loops(g, kinds).withColumnRenamed("id", "component")
    return members.join(loops.withColumn("loop", F.lit(True)), "component", "left").filter("size(members) > 1 OR loop").select("component", "members")


def cyclic_sizes(g: Graph, kinds: Iterable[str] | None = None) -> DataFrame:
    """(component, size): components that hold a cycle and how many nodes they have, counted without their members in a row."""
    return _cyclic(components(g, kinds), g, kinds)


def _cyclic(member: DataFrame, g: Graph, kinds: Iterable[str] | None) -> DataFrame:
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    loops = self_loops(g, kinds).withColumnRenamed("id", "component")
    return sizes.join(loops.withColumn("loop", F.lit(True)), "component", "left").filter("size > 1 OR loop").select("component", "size")


def self_loops(g: Graph, kinds: Iterable[str] | None = None) -> DataFrame:
    return inner_edges(g, kinds, loops=True).filter("here = there").select(F.col("here").alias("id"))


def short_cycles(g: Graph, length: int, kinds: Iterable[str] | None = None) -> DataFrame:
    """Columns n0 … n<length-1>: simple cycles of the length, each once, from its smallest id on."""
    e = inner_edges(g, kinds)
    rows = e.select(F.col("here").alias("n0"), F.col("there").alias("n1")).filter("n1 > n0")
    for k in range(2, length):
        step = e.select(F.col("here").alias(f"n{k - 1}"), F.col("there").alias(f"n{k}"))
        rows = rows.join(step, f"n{k - 1}").filter((F.col(f"n{k}") > F.col("n0")) & ~F.array_contains(F.array(*[f"n{j}" for j in range(k)]), F.col(f"n{k}")))
    last = f"n{length - 1}"
    closing = e.select(F.col("here").alias(last), F.col("there").alias("n0"))
    return rows.join(closing, [last, "n0"], "left_semi").select(*[f"n{k}" for k in range(length)])


def back_edge_cycles(g: Graph, kinds: Iterable[str] | None = None, most_edges: int = 1_000_000) -> list[list[str]]:
    """One cycle per back edge of a depth-first search in order of id, as lists of ids.

    The search is serial: cyclic components come to the driver, and more than most_edges edges are an error.
    """
    member = components(g, kinds)
    inside = member.join(_cyclic(member, g, kinds), "component", "left_semi").select("id")
    e = inner_edges(g, kinds, loops=True)
    e = e.join(inside.withColumnRenamed("id", "here"), "here", "left_semi").join(inside.withColumnRenamed("id", "there"), "there", "left_semi")
    rows = e.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise TooManyEdges(f"cyclic components have more than {most_edges} edges; use cyclic_components")
    ahead: dict[str, list[str]] = {}
    for r in rows:
        ahead.setdefault(r.here, []).append(r.there)
    for names in ahead.values():
        names.sort()
    cycles: list[list[str]] = []
    finished: set[str] = set()
    for root in sorted(ahead):
        if root in finished:
            continue
        path, on, walks = [root], {root}, [iter(ahead[root])]
        while walks:
            for n in walks[-1]:
                if n in on:
                    cycles.append(path[path.index(n) :])
                elif n not in finished and n in ahead:
                    path.append(n)
                    on.add(n)
                    walks.append(iter(ahead[n]))
                    break
            else:
                walks.pop()
                on.discard(path[-1])
                finished.add(path.pop())
    return cycles


def cycles(g: Graph, kinds: Iterable[str] | None = None, most: int = 5, most_edges: int = 1_000_000) -> tuple[list[list[str]], int]:
    """(some cycles, their number): back_edge_cycles, or, where there are too many edges for that, the first `most` nodes of the `most` largest cyclic components and how many components there are."""
    try:
        found = back_edge_cycles(g, kinds, most_edges)
        return found[:most], len(found)
    except TooManyEdges:
        member, _ = Steps(g.nodes.sparkSession).write(components(g, kinds))
        sizes = _cyclic(member, g, kinds)
        largest = [r.component for r in sizes.orderBy(F.desc("size"), "component").limit(most).collect()]
        of = lambda c: [r.id for r in member.filter(F.col("component") == c).orderBy("id").limit(most).collect()]
        return [of(c) for c in largest], sizes.count()
