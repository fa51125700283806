"""Writing graphs: parquet, JSON lines, GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_graph(nodes: DataFrame, edges: DataFrame, broken: DataFrame, path: str) -> None:
    """Tables below ``path``; edges are laid out by type, so that readers of some types skip the rest."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    broken.write.mode("overwrite").parquet(f"{path}/broken_links")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges", "broken_links"))


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value): one JSON object per node and edge."""
    pack = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
    return pack(nodes, "node").unionByName(pack(edges, "edge"))


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, value): the lines of a GraphML file, ordered by part and id."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), c, F.lit("</data>"))
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="title" for="node" attr.name="title" attr.type="string"/><key id="type" for="edge" attr.name="type" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "part int, id string, value string")
    n = nodes.select(F.lit(1).alias("part"), F.col("path").alias("id"), F.concat(F.lit('<node id="'), esc(F.col("path")), F.lit('">'), data("title", esc(F.col("title"))), F.lit("</node>")).alias("value"))
    e = edges.select(
        F.lit(2).alias("part"), F.concat("src", F.lit("\t"), "dst").alias("id"),
        F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('">'), data("type", esc(F.col("type"))), data("weight", F.col("weight").cast("string")), F.lit("</edge>")).alias("value"),
    )
    return ends.unionByName(n).unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Text files whose lines, in file order, are one GraphML document."""
    graphml_rows(nodes, edges).orderBy("part", "id").select("value").write.mode("overwrite").text(path)
