"""Walks over the graph: impact, traversal, shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import stem
from lattica.operators.graph import GENERIC_TITLES, STRUCTURAL
from lattica.session import materialize

#: Rounds after which a loop writes its frontier and starts anew from it.
CUT_EVERY = 4


def find_node(nodes: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """(path) of the first note by path whose title is ``query``, else whose stem is; no row if there is none."""
    fold = (lambda c: c) if case_sensitive else F.lower
    wanted = fold(F.lit(query))
    hits = nodes.select("path", F.when(fold(F.col("title")) == wanted, 1).when(fold(stem(F.col("path"))) == wanted, 2).alias("rank")).where("rank is not null")
    return hits.agg(F.min(F.struct("rank", "path"))["path"].alias("path")).where("path is not null")


def directed(edges: DataFrame, direction: str = "both", types: tuple[str, ...] | None = STRUCTURAL) -> DataFrame:
    """(a, b, weight, type): steps from a to b that ``direction`` ('out', 'in', 'both') allows."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    out = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "type")
    back = kept.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight", "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def blast_radius(edges: DataFrame, seed: DataFrame, depth: int = 2, threshold: float = 0.3, direction: str = "both", types: tuple[str, ...] | None = STRUCTURAL) -> DataFrame:
    """(path, relevance, distance, edge_types): notes reached by walks of at most ``depth`` steps.

    relevance is the largest product of weights over walks whose every prefix product is at least ``threshold``;
    walks may pass the seed again. Per level only the best walk per node goes on. distance is the smallest length
    that reaches the rounded relevance. A missing seed gives no rows.
    """
    steps = directed(edges, direction, types)
    front = seed.select(F.col("path").alias("n"), F.lit(1.0).alias("r"), F.array().cast("array<string>").alias("t"))
    levels = []
    for d in range(1, depth + 1):
        walked = front.join(steps, F.col("n") == F.col("a")).select(F.col("b").alias("n"), (F.col("r") * F.col("weight")).alias("r"), F.concat("t", F.array("type")).alias("t")).where(F.col("r") >= threshold)
        front = walked.groupBy("n").agg(F.min(F.struct((-F.col("r")).alias("r"), "t")).alias("m")).select("n", (-F.col("m.r")).alias("r"), "m.t")
        if d % CUT_EVERY == 0:
            front = materialize(front, "front")
        levels.append(front.select("n", F.round("r", 4).alias("r"), F.lit(d).alias("d"), "t"))
    every = reduce(DataFrame.unionByName, levels)
    best = every.groupBy("n").agg(F.min(F.struct((-F.col("r")).alias("r"), "d", "t")).alias("m"))
    found = best.select(F.col("n").alias("path"), (-F.col("m.r")).alias("relevance"), F.col("m.d").alias("distance"), F.col("m.t").alias("edge_types")).where(F.col("relevance") >= threshold)
    return found.join(seed.select("path"), "path", "left_anti")


def traverse(edges: DataFrame, seed: DataFrame, depth: int = 2, mode: str = "out") -> DataFrame:
    """(path, distance) of notes within ``depth`` hops: mode 'out' follows any edge forward, 'structural' structural ones both ways."""
    steps = (directed(edges, "out", None) if mode == "out" else directed(edges, "both", STRUCTURAL)).select("a", "b").distinct()
    seen = seed.select("path", F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(steps, F.col("path") == F.col("a")).select(F.col("b").alias("path")).distinct()
        front = reached.join(seen, "path", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
        if d % CUT_EVERY == 0:
            seen = materialize(seen, "seen")
            front = seen.where(F.col("distance") == d)
    return seen.where("distance > 0")


def structural_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) steps both ways of the undirected structural graph without generic titles and self-loops."""
    kept = nodes.where(~F.coalesce(F.col("title").isin(*GENERIC_TITLES), F.lit(False))).select("path")
    steps = directed(edges, "both", STRUCTURAL).select("a", "b").where("a <> b").distinct()
    return steps.join(kept.withColumnRenamed("path", "a"), "a", "left_semi").join(kept.withColumnRenamed("path", "b"), "b", "left_semi")


def shortest_path(nodes: DataFrame, edges: DataFrame, source: DataFrame, target: DataFrame, longest: int | None = None) -> DataFrame:
    """(hops, path_nodes) of the shortest undirected structural path; of several the first in the order of their nodes.

    No row if there is none, or none within ``longest`` hops where that is given. Each round extends the best path per newly
    reached node; steps go both ways, so a node reached before lies at most one round back.
    """
    steps = materialize(structural_view(nodes, edges), "steps")
    start = source.select(F.col("path").alias("n")).join(nodes.select(F.col("path").alias("n"), "title").where(~F.coalesce(F.col("title").isin(*GENERIC_TITLES), F.lit(False))), "n", "left_semi")
    front = materialize(start.select("n", F.array("n").alias("p")), "front")
    last, goal = front.limit(0), materialize(target.select(F.col("path").alias("n")), "goal")
    d = 0
    while front.take(1) and (longest is None or d <= longest):
        rows = front.join(goal, "n", "left_semi").select(F.lit(d).alias("hops"), F.col("p").alias("path_nodes"))
        if rows.take(1):
            return rows
        walked = front.join(steps, F.col("n") == F.col("a")).select(F.col("b").alias("n"), F.concat("p", F.array("b")).alias("p"))
        near = last.select("n").unionByName(front.select("n"))
        last, front = front, materialize(walked.join(near, "n", "left_anti").groupBy("n").agg(F.min("p").alias("p")), "front")
        d += 1
    return edges.sparkSession.createDataFrame([], "hops int, path_nodes array<string>")


def distances(steps: DataFrame, pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """Adds ``distance`` to ``pairs(a, b, ...)``: hops over ``steps(a, b)``, 99 where there is no way.

    All pairs' frontiers advance together, one join a round; each keeps its own set of reached nodes. Ways of any length
    are followed, unless ``longest`` is given.
    """
    steps = materialize(steps.select(F.col("a").alias("x"), F.col("b").alias("y")), "steps")
    pairs = materialize(pairs, "pairs")
    sources = pairs.select(F.col("a").alias("s")).distinct()
    wanted = pairs.select(F.col("a").alias("s"), F.col("b").alias("n")).distinct()
    seen = sources.select("s", F.col("s").alias("n"), F.lit(0).alias("distance"))
    front, d = seen, 0
    while longest is None or d < longest:
        d += 1
        reached = front.join(steps, F.col("n") == F.col("x")).select("s", F.col("y").alias("n")).distinct()
        front = materialize(reached.join(seen, ["s", "n"], "left_anti").withColumn("distance", F.lit(d)), "front")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if d % CUT_EVERY == 0:
            seen = materialize(seen, "seen")
        if not wanted.join(seen, ["s", "n"], "left_anti").take(1):
            break
    known = seen.select(F.col("s").alias("a"), F.col("n").alias("b"), "distance")
    return pairs.join(known, ["a", "b"], "left").withColumn("distance", F.coalesce("distance", F.lit(99)))
