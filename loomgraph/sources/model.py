"""The relations of a property graph and their schemas."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(columns: str) -> T.StructType:
    """A schema of "name type, ..." that needs no session."""
    pairs = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


FILES = _schema("path string, content_hash string, language string, lines_of_code int, indexed_at timestamp")
NODES = _schema(
    "id string, type string, name string, file_path string, qualified_name string, kind string, start_line int, end_line int, visibility string, "
    "is_exported boolean, is_async boolean, is_static boolean, signature string, metadata string"
)
EDGES = _schema("source string, target string, kind string, label string, line int, metadata string")
#: Node types in the order of layers (fixed values).
LAYERS = ("screen", "component", "hook", "store", "service", "api", "endpoint", "function", "class")
#: Edge kinds of each view (fixed values).
EDGE_VIEWS = {"dependency": ("import", "external"), "component": ("jsx", "contains"), "callgraph": ("call", "references"), "apiflow": ("api_call",)}


@dataclass(frozen=True)
class Graph:
    """Typed nodes and typed directed edges. Edges may be parallel, and their ends need not be nodes."""

    nodes: DataFrame
    edges: DataFrame

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)
