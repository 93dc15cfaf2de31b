"""The library's pure functions under names that SQL text can use."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from . import tags

#: Bodies over the arguments' names; Spark inlines them, so they cost what the expressions cost.
FUNCTIONS = {
    "symbol_id(path STRING, name STRING) RETURNS STRING": "substring(md5(concat_ws('::', path, name)), 1, 12)",
    "variable_id(path STRING, name STRING) RETURNS STRING": "substring(md5(concat(path, '::var:', name)), 1, 12)",
    "file_id(path STRING) RETURNS STRING": "concat('f:', substring(md5(path), 1, 10))",
    "package_id(specifier STRING) RETURNS STRING": "concat('pkg:', split_part(specifier, '/', 1))",
    "endpoint_id(method STRING, url STRING) RETURNS STRING": "concat('ep:', substring(md5(concat(method, ':', coalesce(url, 'unknown'))), 1, 10))",
    "route_id(name STRING) RETURNS STRING": "concat('route:', substring(md5(name), 1, 10))",
    "label_of(qualified_name STRING) RETURNS STRING": r"regexp_replace(element_at(split(qualified_name, '::'), -1), r'\.(js|jsx|ts|tsx)$', '')",
}


def register(spark: SparkSession) -> None:
    """Makes symbol_id, variable_id, file_id, package_id, endpoint_id, route_id, label_of, semantic_roles, node_type and glob_matches known to the session's SQL.

    And the table function source_facts: SELECT * FROM source_facts(TABLE(SELECT path, content FROM files)).
    """
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    cases = ", ".join(f"CASE WHEN coalesce(name, '') RLIKE r'{pattern}' THEN '{role}' END" for role, pattern in tags.role_patterns().items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION semantic_roles(name STRING) RETURNS ARRAY<STRING> RETURN array_compact(array({cases}))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION node_type(path STRING, exports ARRAY<STRING>) RETURNS STRING RETURN {_node_type()}")
    from loomgraph.sources.discover import glob_regex

    def glob_matches(path: str | None, pattern: str | None) -> bool | None:
        return None if path is None or pattern is None else bool(re.search(glob_regex(pattern), path))

    spark.udf.register("glob_matches", glob_matches, T.BooleanType())
    from loomgraph.sources.extract import fact_reader

    spark.udtf.register("source_facts", fact_reader())


def _node_type() -> str:
    """The body of node_type: the rules of functions.tags as one CASE."""
    out = []
    for kind, pattern in tags.type_patterns():
        also = " OR exists(exports, e -> e RLIKE '^use[A-Z]')" if kind == "hook" else ""
        out.append(f"WHEN path RLIKE r'{pattern}'{also} THEN '{kind}'")
    return "CASE " + " ".join(out) + " WHEN exists(exports, e -> e RLIKE '^[A-Z]') THEN 'component' ELSE 'file' END"
