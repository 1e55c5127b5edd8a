"""The test tables as the operators' inputs: an event grid, an embedding grid, graphs and pairs of labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.store import row_numbers

EVENT_WIDTH = 100
EMBEDDING_WIDTH = 25
#: Codes of the event types, in the order of their names.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The grid's shape from the largest event id (parquet statistics, no scan)."""
    top = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return (1, top // EVENT_WIDTH + 1, EVENT_WIDTH)


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, z, y, x, label, other, value): event ids on rows of 100, labelled by 5 x 5 squares; other is the user."""
    y = F.floor(F.col("event_id") / EVENT_WIDTH).cast("int")
    x = (F.col("event_id") % EVENT_WIDTH).cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("node_id"), F.lit(0).alias("z"), y.alias("y"), x.alias("x"),
        (F.floor(y / 5) * 20 + F.floor(x / 5)).cast("long").alias("label"),
        (F.col("user_id") % 7).cast("long").alias("other"), F.col("value").cast("double").alias("value"),
    )


def embedding_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    top = read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return (1, top // EMBEDDING_WIDTH + 1, EMBEDDING_WIDTH)


def embedding_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, z, y, x, embedding, label): vector ids on rows of 25."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("node_id"), F.lit(0).alias("z"),
        F.floor(F.col("vec_id") / EMBEDDING_WIDTH).cast("int").alias("y"), (F.col("vec_id") % EMBEDDING_WIDTH).cast("int").alias("x"),
        "embedding", F.col("label").cast("long").alias("label"),
    )


def text_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, cost) of a text file of ``u v cost`` rows."""
    return spark.read.csv(path, sep=" ", schema="u long, v long, cost double")


def text_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node), edges (edge_id, u, v, cost)) of such a file: nodes 0 to the largest end, edge ids in the order of the
    canonical pairs."""
    rows = text_edges(spark, path)
    top = rows.agg(F.max(F.greatest("u", "v"))).first()[0]
    nodes = spark.range((top if top is not None else -1) + 1).select(F.col("id").alias("node"))
    pairs = rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cost")
    return nodes, row_numbers(pairs, ["u", "v", "cost"], "edge_id").select("edge_id", "u", "v", "cost")


def lifted_problem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node), edges (edge_id, u, v, cost, is_lifted)) of a folder of Parquet files ``local`` and ``lifted`` with
    (u, v, cost): local edges are numbered first."""
    local, lifted = (spark.read.parquet(f"{path.rstrip('/')}/{n}").select("u", "v", F.col("cost").cast("double").alias("cost")) for n in ("local", "lifted"))
    both = local.withColumn("is_lifted", F.lit(False)).unionByName(lifted.withColumn("is_lifted", F.lit(True)))
    top = both.agg(F.max(F.greatest("u", "v"))).first()[0]
    nodes = spark.range((top if top is not None else -1) + 1).select(F.col("id").alias("node"))
    pairs = both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cost", "is_lifted")
    return nodes, row_numbers(pairs, ["is_lifted", "u", "v", "cost"], "edge_id").select("edge_id", "u", "v", "cost", "is_lifted")


def packed_graph(edges: DataFrame, n_nodes: int) -> DataFrame:
    """One row of the flat form [nodes, edges, u0, v0, ...]; for graphs that fit a row."""
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "u", "v"))), lambda e: F.array(e["u"], e["v"])))
    return edges.agg(F.concat(F.array(F.lit(n_nodes).cast("long"), F.count(F.lit(1))), flat).alias("graph"))


def unpacked_graph(packed: DataFrame) -> DataFrame:
    """(edge_id, u, v) of the flat form."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.element_at("graph", 2) - 1)).alias("edge_id")
    out = packed.where(F.element_at("graph", 2) > 0).select("graph", at)
    return out.select("edge_id", F.expr("graph[int(2 + 2 * edge_id)]").alias("u"), F.expr("graph[int(3 + 2 * edge_id)]").alias("v"))
