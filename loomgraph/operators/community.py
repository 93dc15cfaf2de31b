"""Communities by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.lineage import Steps
from loomgraph.sources.model import Graph

from .structure import inner_edges


def label_rounds(g: Graph, rounds: int = 20) -> DataFrame:
    """(id, label) after at most `rounds` synchronous rounds.

    In a round each node takes the label most of its distinct neighbours (either direction) have, the smallest among
    equals; a node without neighbours keeps its own id. Rounds end early when no label changes, or when all
    are what they were two rounds ago, as happens on bipartite parts: what is left then follows from whether an even
    number of rounds is left.
    """
    work = Steps(g.nodes.sparkSession)
    e = inner_edges(g)
    ties, told = work.write(e.unionAll(e.select(F.col("there").alias("here"), F.col("here").alias("there"))).distinct())
    labels, _ = work.write(g.nodes.select("id", F.col("id").alias("label"), F.lit(None).cast("string").alias("before")).distinct())
    for k in range(rounds if told["n"] else 0):
        votes = ties.join(labels.select(F.col("id").alias("there"), "label"), "there").groupBy("here", "label").agg(F.count(F.lit(1)).alias("n"))
        chosen = votes.groupBy("here").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select(F.col("here").alias("id"), F.col("best.label").alias("chosen"))
        now = labels.join(chosen, "id", "left").select("id", F.coalesce("chosen", "label").alias("label"), F.col("label").alias("before"), F.col("before").alias("two_before"))
        moved, returned = F.count_if(F.col("label") != F.col("before")), F.count_if(F.col("label").eqNullSafe(F.col("two_before")))
        now, state = work.write(now, moved=moved, returned=returned)
        work.drop(labels)
        labels = now
        if not state["moved"]:
            break
        if state["returned"] == state["n"]:
            return labels.select("id", F.col("before" if (rounds - 1 - k) % 2 else "label").alias("label"))
    return labels.select("id", "label")


def sizes(g: Graph, rounds: int = 20) -> DataFrame:
    """(label, size) of labels that more than one node has, counted without their members in a row."""
    return label_rounds(g, rounds).groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")


def communities(g: Graph, rounds: int = 20) -> DataFrame:
    """(label, members array, size) of labels that more than one node has."""
    return label_rounds(g, rounds).groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("size")).filter("size > 1")
