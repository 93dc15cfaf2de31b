"""Components over all events, against reachability by hand."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from loomgraph.sources import projections

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_components_of_all_events(spark):
    g = projections.events(spark, SF)
    nodes = {r.id for r in g.nodes.collect()}
    after = {n: set() for n in nodes}
    for r in g.edges.select("source", "target").distinct().collect():
        after[r.source].add(r.target)

    def reached(n):
        seen, todo = {n}, [n]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    reach = {n: reached(n) for n in nodes}
    found = {r.id: r.component for r in driver.queries()["scc_members"](spark, SF).collect()}
    assert found == {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
