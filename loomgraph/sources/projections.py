"""Property graphs over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import Graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _nodes(df: DataFrame, kind: str, key: str, name: str, type_: str, exported: Column | None = None) -> DataFrame:
    path = F.concat(F.lit(f"src/{kind}s/"), F.pmod(F.col(key), F.lit(10)).cast("string"), F.lit(".js"))
    return df.select(
        _id(kind, key).alias("id"), F.lit(type_).alias("type"), F.col(name).alias("name"), path.alias("file_path"), F.lit(kind).alias("kind"), (F.lit(False) if exported is None else exported).alias("is_exported")
    )


def _edges(df: DataFrame, source: Column, target: Column, kind: str, label: Column | None = None, line: Column | None = None) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), (F.lit(None) if label is None else label).cast("string").alias("label"), (F.lit(None) if line is None else line).cast("int").alias("line"))


#: Tasks that gather the rows of one split of a file.
TASKS_A_SPLIT = 8


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows that are nearly all different, dealt before they are grouped: gathering them where they are read would make few fewer, and a task would hold what its whole split tells."""
    return rows.repartition(TASKS_A_SPLIT * rows.rdd.getNumPartitions(), key)


def star(spark: SparkSession, sf_dir: str, repeated: bool = False) -> Graph:
    """Regions, nations, customers, suppliers, orders and parts: an acyclic graph of five levels.

    repeated: edges come once for each line item that makes them, for questions that take edges together anyway.
    """
    t = lambda name: _table(spark, sf_dir, name)
    nodes = (
        _nodes(t("region"), "region", "r_regionkey", "r_name", "file")
        .unionByName(_nodes(t("nation"), "nation", "n_nationkey", "n_name", "screen"))
        .unionByName(_nodes(t("customer"), "customer", "c_custkey", "c_name", "component"))
        .unionByName(_nodes(t("supplier"), "supplier", "s_suppkey", "s_name", "service"))
        .unionByName(_nodes(t("orders"), "order", "o_orderkey", "o_orderpriority", "hook", F.col("o_orderstatus") == "F"))
        .unionByName(_nodes(t("part"), "part", "p_partkey", "p_name", "endpoint"))
    )
    if repeated:
        items, supplied = t("lineitem").withColumnRenamed("l_returnflag", "label"), t("lineitem")
    else:
        items = _dealt(t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "l_orderkey").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_returnflag").alias("label"))
        supplied = _dealt(t("lineitem").select("l_suppkey", "l_partkey"), "l_partkey").distinct()
    edges = (
        _edges(t("nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains")
        .unionByName(_edges(t("customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "jsx"))
        .unionByName(_edges(t("supplier"), _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "import"))
        .unionByName(_edges(t("orders"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), "call"))
        .unionByName(_edges(items, _id("order", "l_orderkey"), _id("part", "l_partkey"), "api_call", F.col("label"), F.col("l_linenumber")))
        .unionByName(_edges(supplied, _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "external"))
    )
    return Graph(nodes, edges)


def star_dangling(spark: SparkSession, sf_dir: str) -> Graph:
    """The star without the nodes of parts over size 25; edges to them stay."""
    g = star(spark, sf_dir)
    gone = _table(spark, sf_dir, "part").filter("p_size > 25").select(_id("part", "p_partkey").alias("id"))
    return g.with_nodes(g.nodes.join(gone, "id", "left_anti"))


def events(spark: SparkSession, sf_dir: str) -> Graph:
    """What each user does after what: cyclic, with self-loops and parallel edges."""
    e = _table(spark, sf_dir, "events")
    here = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
    e = e.select("user_id", "event_id", "ts", "event_type", here.alias("id"))
    nodes = e.select("id", F.col("event_type").alias("type")).distinct().select("id", "type", F.col("type").alias("name"), F.lit("events.js").alias("file_path"), F.lit("event").alias("kind"), F.lit(False).alias("is_exported"))
    then = F.lead("id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = _edges(e.withColumn("then", then).filter("then IS NOT NULL"), F.col("id"), F.col("then"), "navigates_to", line=F.col("event_id"))
    return Graph(nodes, edges)


def event_types(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types and the distinct transitions between them."""
    g = events(spark, sf_dir)
    kind = lambda c: F.split(c, ":")[1]
    nodes = g.nodes.select(F.col("type").alias("id"), "type", F.col("type").alias("name"), "file_path", "kind", "is_exported").distinct()
    return Graph(nodes, g.edges.select(kind(F.col("source")).alias("source"), kind(F.col("target")).alias("target"), "kind", "label", F.lit(None).cast("int").alias("line")).distinct())


def pages(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages, their hosts, and the paths they refer to."""
    p = _table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all(F.col("html"), F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    page = _id("page", "page_id")
    common = (F.lit("pages.html").alias("file_path"), F.lit("page").alias("kind"), F.lit(False).alias("is_exported"))
    nodes = (
        p.select(page.alias("id"), F.lit("screen").alias("type"), F.col("url").alias("name"), *common)
        .unionByName(p.select(host.alias("name")).distinct().select(F.concat(F.lit("pkg:"), "name").alias("id"), F.lit("package").alias("type"), "name", *common))
        .unionByName(hrefs.select(F.col("href").alias("name")).distinct().select(F.concat(F.lit("f:"), "name").alias("id"), F.lit("file").alias("type"), "name", *common))
    )
    edges = _edges(p, page, F.concat(F.lit("pkg:"), host), "external").unionByName(_edges(hrefs, page, F.concat(F.lit("f:"), F.col("href")), "import"))
    return Graph(nodes, edges)
