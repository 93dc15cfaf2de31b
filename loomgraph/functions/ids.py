"""Deterministic identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _short(text: Column, n: int) -> Column:
    return F.substring(F.md5(text), 1, n)


def symbol_id(path: Column, name: Column) -> Column:
    return _short(F.concat_ws("::", path, name), 12)


def variable_id(path: Column, name: Column) -> Column:
    return symbol_id(path, F.concat(F.lit("var:"), name))


def dispatch_id(path: Column, action: Column) -> Column:
    return symbol_id(path, F.concat(F.lit("dispatch:"), action))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("f:"), _short(path, 10))


def package_id(specifier: Column) -> Column:
    """Scoped packages count as their scope."""
    return F.concat(F.lit("pkg:"), F.split(specifier, "/")[0])


def endpoint_id(method: Column, url: Column) -> Column:
    return F.concat(F.lit("ep:"), _short(F.concat_ws(":", method, F.coalesce(url, F.lit("unknown"))), 10))


def route_id(name: Column) -> Column:
    return F.concat(F.lit("route:"), _short(name, 10))


def keyed_id(prefix: str, key: Column) -> Column:
    """storage:, event:, deeplink: and analytics: ids; a missing key is unknown."""
    return F.concat(F.lit(f"{prefix}:"), F.coalesce(key, F.lit("unknown")))
