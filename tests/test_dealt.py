"""Line items are dealt before they are grouped."""

from pyspark.sql import functions as F

from loomgraph.sources import projections


def test_no_task_groups_a_whole_split(spark):
    """Each task grouped all rows of its split; now none reads more than a share of them, and the edges are the same."""
    sf = "/root/testdata/sf0.001"
    g = projections.star(spark, sf)
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = projections._dealt(items.select("l_orderkey"), "l_orderkey")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < items.count() / items.rdd.getNumPartitions() / 3
    plan = g.edges.filter("kind = 'api_call'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.index("Aggregate") < plan.index("RepartitionByExpression")
    assert g.edges.filter("kind = 'api_call'").count() == items.select("l_orderkey", "l_partkey", "l_linenumber").distinct().count()
    assert g.edges.filter("kind = 'external'").count() == items.select("l_suppkey", "l_partkey").distinct().count()
