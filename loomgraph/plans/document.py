"""The document a viewer reads: nodes with communities, edges, views, layers, cycles, hotspots and stats."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import community, metrics, structure
from loomgraph.sources.lineage import materialise
from loomgraph.sources.model import EDGE_VIEWS, LAYERS, Graph

from . import helpers

VERSION = "1"
#: Nodes and edges that a document holds at most.
MOST_ROWS = 1_000_000


def nodes_with_community(g: Graph) -> DataFrame:
    """Nodes with metrics and the place of their community in order of its label, -1 for none."""
    found = materialise(community.communities(g))
    place = found.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("community"))  # a row a community
    members = found.select("label", F.explode("members").alias("id")).join(place, "label").select("id", "community")
    return metrics.degrees(g).join(members, "id", "left").withColumn("community", F.coalesce("community", F.lit(-1)))


def build(g: Graph, files: DataFrame | None = None) -> dict:
    """The whole document. It comes to the driver: viewers show graphs of projects, not of corpora; beyond MOST_ROWS use Store.export."""
    size = metrics.counts(g).first()
    if size.nodes + size.edges > MOST_ROWS:
        raise ValueError(f"{size.nodes} nodes and {size.edges} edges are more than a document holds ({MOST_ROWS}); use Store.export")
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    layers: dict[str, dict] = {}
    typed = {t: [r.id for r in g.nodes.filter(F.col("type") == t).select("id").orderBy("id").collect()] for t in LAYERS}
    for r in rows(helpers.layers(g)):
        layers.setdefault(r.pop("layer"), {}).setdefault(f"{r.pop('role')}_edges", []).append(r)
    return {
        "version": VERSION,
        "generated_at": datetime.now(UTC).isoformat(),
        "nodes": rows(nodes_with_community(g).orderBy("id")),
        "edges": rows(g.edges),
        "views": {v: rows(helpers.edge_view(g, v)) for v in EDGE_VIEWS},
        "layers": {t: {"nodes": ids} | {f"{role}_edges": layers.get(t, {}).get(f"{role}_edges", []) for role in ("internal", "incoming", "outgoing")} for t, ids in typed.items() if ids},
        "cycles": structure.back_edge_cycles(g),
        "communities": [r["members"] for r in rows(community.communities(g).orderBy("label"))],
        "hotspots": rows(metrics.hotspots(g, 20)),
        "stats": rows(metrics.counts(g, files))[0] | {"by_type": {r["type"]: r["n"] for r in rows(metrics.histogram(g.nodes, "type"))}, "by_kind": {r["kind"]: r["n"] for r in rows(metrics.histogram(g.edges, "kind"))}},
    }
