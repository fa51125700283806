"""Sizes, degrees, orphans and betweenness."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import EXPLICIT
from lattica.session import discard, materialize


def degrees(edges: DataFrame) -> DataFrame:
    """(path, degree): ends of edges; a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """One row: node_count, edge_count, orphan_count, density, broken_count.

    With ``broken``, broken links count as edges, and their sources are no orphans.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path"))
    if broken is not None:
        ends = ends.unionByName(broken.select(F.col("src").alias("path")))
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    lone = count(nodes.join(ends.distinct(), "path", "left_anti"))
    n_broken = count(broken) if broken is not None else F.lit(0).cast("long")
    one = nodes.sparkSession.range(1).select(count(nodes).alias("node_count"), (count(edges) + n_broken).alias("edge_count"), lone.alias("orphan_count"), n_broken.alias("broken_count"))
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    density = F.round(F.when(pairs > 0, F.col("edge_count") / pairs).otherwise(0.0), 6)
    return one.select("node_count", "edge_count", "orphan_count", density.alias("density"), "broken_count")


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "type")


def hubs(nodes: DataFrame, edges: DataFrame, top_n: int = 20) -> DataFrame:
    """(path, title, degree, centrality) of the notes with most edge ends."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    with_degree = nodes.select("path", "title").join(degrees(edges), "path", "left").select("path", "title", F.coalesce("degree", F.lit(0)).alias("degree"), n.alias("_n"))
    score = F.when(F.col("_n") > 1, F.round(F.col("degree") / (F.col("_n") - 1), 6)).otherwise(1.0)
    return with_degree.select("path", "title", "degree", score.alias("centrality")).orderBy(F.col("centrality").desc(), "path").limit(top_n)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, title) of notes without any edge, by title."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return nodes.join(ends, "path", "left_anti").select("path", "title").orderBy("title", "path")


#: Up to this many links a task searches over arrays of all links (about 100 bytes each while they are built); beyond, searches are joins.
ARRAY_LINKS = 4_000_000
#: Links that one batch of array searches may look at in a step, and cells of its tables.
STEP_LINKS, CELLS = 2_000_000, 8_000_000


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int | None = None, seed: int = 42, batch_rows: int = 20_000_000, array_links: int = ARRAY_LINKS) -> DataFrame:
    """(path, betweenness): normalised shortest-path betweenness over explicit links, undirected.

    Brandes' algorithm. Up to ``array_links`` links, each of a few tasks gets all links as integer codes, by a shuffle, and searches
    from its share of the sources (:func:`_searches`). Larger graphs are searched by levels: each level of the searches from all
    sources of a batch is one join of written tables, and credit goes back the same way; sources are then taken in batches of about
    ``batch_rows`` pairs of source and note, which bounds what lies on disk at a time. No link reaches the driver, and no size is
    refused. Exact unless ``sources`` is given: then that many are drawn by a seeded hash and the result is scaled up. Fewer than 3
    notes give no rows.
    """
    spark = nodes.sparkSession
    links = edges.where(F.col("type").isin(*EXPLICIT)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    ids = materialize(nodes.select("path").distinct(), "ids")
    links = materialize(links, "links")
    n, m = ids.count(), links.count()
    if n < 3 or not m:
        return spark.createDataFrame([], "path string, betweenness double")
    linked = links.select(F.explode(F.array("a", "b")).alias("path")).distinct()
    codes = materialize(linked.withColumn("code", F.monotonically_increasing_id()), "codes")
    side = lambda c: codes.select(F.col("path").alias(c), F.col("code").alias(f"_{c}"))
    coded = links.join(side("a"), "a").join(side("b"), "b").select("_a", "_b")
    if sources and sources < n:
        drawn = ids.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(sources)
        scale = n / sources
    else:
        drawn, scale = ids, 1.0
    starts = drawn.join(codes, "path").select(F.col("code").alias("s"))
    if m <= array_links:
        sums = _array_credits(starts, materialize(coded, "coded"))
    else:
        steps = materialize(coded.unionByName(coded.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))), "steps")
        batches = math.ceil(min(sources or n, n) * codes.count() / batch_rows)
        starts = materialize(starts.withColumn("batch", F.pmod(F.xxhash64("s"), F.lit(batches))), "starts")
        parts = [_credits(starts.where(F.col("batch") == i).select("s"), steps) for i in range(batches)]
        sums = reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.sum("credit").alias("credit"))
    scored = sums.join(codes, F.col("v") == F.col("code")).select("path", (F.col("credit") * scale / ((n - 1) * (n - 2))).alias("betweenness"))
    return ids.join(scored, "path", "left").select("path", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _array_credits(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(v, credit) as of :func:`_credits`, for undirected ``links(_a, _b)``: searches in tasks that hold all links as arrays."""
    spark = links.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    # one key for each partition, so that no two tasks' groups meet in one
    keys = spark.range(40 * tasks).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("k")).agg(F.min("key").alias("key"))
    keys = [r["key"] for r in keys.orderBy("k").collect()]
    of = F.array(*[F.lit(k) for k in keys])
    searched = starts.select(F.element_at(of, (F.pmod(F.xxhash64("s"), F.lit(len(keys))) + 1).cast("int")).alias("key"), F.col("s").alias("a"), F.lit(-1).cast("long").alias("b"))
    dealt = links.select(F.explode(of).alias("key"), F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(searched).repartition(tasks, "key")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, own = _arrays(pdf)
        return _searches(graph, own)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, _ = _arrays(pdf[pdf["kind"] < 0])
        return _through_hub(graph, pdf[pdf["kind"] > 0])

    found = materialize(dealt.groupBy("key").applyInPandas(search, "v long, kind int, x double").groupBy("v", "kind").agg(F.sum("x").alias("x")), "found")
    local = found.where("kind = 0").select("v", F.col("x").alias("credit"))
    whole = links.select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.lit(-1).alias("kind"), F.lit(0.0).alias("x"))
    whole = whole.unionByName(found.where("kind > 0").select(F.col("v").alias("a"), F.lit(-1).cast("long").alias("b"), "kind", "x"))
    hub = whole.groupBy(F.lit(0).alias("_one")).applyInPandas(spread, "v long, credit double")
    return local.unionByName(hub).groupBy("v").agg(F.sum("credit").alias("credit"))


def _arrays(pdf: pd.DataFrame) -> tuple[tuple, np.ndarray]:
    """Links (a, b) as (codes, offsets, ends, hub), and the positions of sources, which are rows with b < 0."""
    one = pdf["b"].to_numpy() < 0
    a, b = pdf["a"].to_numpy()[~one], pdf["b"].to_numpy()[~one]
    codes = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    a, b = np.searchsorted(codes, a).astype(np.int32), np.searchsorted(codes, b).astype(np.int32)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(codes)))])
    return (codes, at, dst[order], int(np.argmax(np.diff(at)))), np.searchsorted(codes, pdf["a"].to_numpy()[one])


def _beside(at: np.ndarray, to: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``v`` and other end of every link of the nodes ``v``."""
    size = at[v + 1] - at[v]
    row = np.repeat(np.arange(len(v)), size)
    return row, to[np.arange(len(row)) + np.repeat(at[v] - np.cumsum(size) + size, size)]


def _from_hub(graph: tuple) -> tuple[np.ndarray, np.ndarray, list]:
    """Distances from the hub (-1: none), numbers of shortest paths, and its levels."""
    codes, at, to, hub = graph
    far, ways = np.full(len(codes), -1, np.int32), np.zeros(len(codes))
    far[hub], ways[hub], levels = 0, 1, [np.array([hub])]
    while len(levels[-1]):
        row, u = _beside(at, to, levels[-1])
        new = far[u] < 0
        row, u = row[new], u[new]
        ways += np.bincount(u, ways[levels[-1]][row], len(codes))
        levels.append(np.unique(u))
        far[levels[-1]] = len(levels) - 1
    return far, ways, levels[:-1]


def _searches(graph: tuple, sources: np.ndarray) -> pd.DataFrame:
    """Rows (v, kind, x) of searches from ``sources`` in the graph without its hub, the node with most links.

    A pair's shortest paths go through the hub h, beside it, or both. Paths beside it need only be searched as far as they are no
    longer than the way through it; whatever a search leaves out goes through the hub alone. Nodes on those ways get their part from
    one search from the hub, weighted by how much passes it. kind 0: credit of v from paths beside the hub; 1: what goes from the
    source v through the hub, summed over targets, and 2: what of the paths from all sources to v does not.
    """
    codes, at, to, hub = graph
    n = len(codes)
    far, ways, levels = _from_hub(graph)
    reach = np.where(far < 0, 1 << 28, far)
    near = sum(map(len, levels))
    credit, missing, through = np.zeros(n), np.zeros(n), np.zeros(n)
    every, sources = sources, sources[sources != hub]
    size = max(1, min(256, CELLS // n))
    level, slot = np.full(size * n, -1, np.int8), np.empty(size * n, np.int32)
    done = 0
    while done < len(sources):
        own = sources[done : done + size]
        if (found := _batch(own, at, to, hub, n, reach, ways, level, slot)) is None:
            size = max(1, len(own) // 2)  # too many links at once
            continue
        done += len(own)
        k, v, c, part = found
        credit += np.bincount(v, c, n)
        missing += np.bincount(v, 1 - part, n)
        rest = np.bincount(k, 1 - part, len(own))
        through[own] = np.where(far[own] < 0, 0, near - 2 - rest)
    at0, at1 = np.flatnonzero(credit), np.flatnonzero(missing)
    parts = [(at0, 0, credit[at0]), (every, 1, through[every]), (at1, 2, missing[at1])]
    return pd.DataFrame({"v": np.concatenate([codes[v] for v, _, _ in parts]), "kind": np.concatenate([np.full(len(v), kind, np.int32) for v, kind, _ in parts]), "x": np.concatenate([x for _, _, x in parts])})


def _batch(own: np.ndarray, at, to, hub: int, n: int, reach, ways, level, slot) -> tuple | None:
    """(index into own, node, credit, part of the paths to it that goes through the hub) of all nodes that searches meet."""
    k, v, sigma = np.arange(len(own)), own, np.ones(len(own))
    level[k * n + v] = 0
    steps, d = [(k, v, sigma, None, None)], 0
    links = 0
    while len(v):
        links += int((at[v + 1] - at[v]).sum())
        if links > STEP_LINKS and len(own) > 1:
            for k, v, *_ in steps:
                level[k * n + v] = -1
            return None
        d += 1
        row, u = _beside(at, to, v)
        key = k[row] * n + u
        good = (u != hub) & (reach[own[k[row]]] + reach[u] >= d) & (level[key] < 0)
        row, key = row[good], key[good]
        slot[key] = np.arange(len(key), dtype=np.int32)
        first = key[slot[key] == np.arange(len(key), dtype=np.int32)]
        level[first] = 0
        slot[first] = np.arange(len(first), dtype=np.int32)
        child = slot[key]
        sigma = np.bincount(child, sigma[row], len(first)) if len(first) else np.zeros(0)
        k, v = first // n, first % n
        steps.append((k, v, sigma, row, child))
    steps.pop()
    out, later = [], None
    for d in range(len(steps) - 1, -1, -1):
        k, v, sigma, *_ = steps[d]
        level[k * n + v] = -1
        by = np.where(reach[own[k]] + reach[v] == d, ways[own[k]] * ways[v], 0.0)
        c = np.zeros(len(v)) if later is None else np.bincount(later[1], later[0][later[2]], len(v))
        if d:
            out.append((k, v, sigma * c, by / (sigma + by)))
            later = (c + 1 / (sigma + by), steps[d][3], steps[d][4])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([x[i] for x in out]) if out else none for i in range(4))


def _through_hub(graph: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(v, credit) from paths through the hub, given the sums of kind 1 and 2 of all sources."""
    codes, at, to, hub = graph
    far, ways, levels = _from_hub(graph)
    n = len(codes)
    v, kind, x = np.searchsorted(codes, rows["a"].to_numpy()), rows["kind"].to_numpy(), rows["x"].to_numpy()
    is_source, credit = np.zeros(n, bool), np.zeros(n)
    passed, missing = np.zeros(n), np.zeros(n)
    is_source[v[kind == 1]], passed[v[kind == 1]] = True, x[kind == 1]
    missing[v[kind == 2]] = x[kind == 2]
    inside = far >= 0
    # from v to the hub: all that passes it, and the hub as target; from the hub to v: all sources that reach v through it, and the hub as source
    others = (is_source & inside).sum() - is_source[hub] - is_source
    weight = np.where(inside, np.where(is_source, passed + 1, 0) + others - missing + is_source[hub], 0.0)
    weight[hub] = 0
    for d in range(len(levels) - 1, 1, -1):
        row, u = _beside(at, to, levels[d])
        back = far[u] == d - 1
        row, u = row[back], u[back]
        w = levels[d][row]
        credit += ways * np.bincount(u, (weight[w] + credit[w]) / ways[w], n)
    credit[hub] = passed[is_source & inside].sum()
    return pd.DataFrame({"v": codes, "credit": credit})


def _credits(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(v, credit): what shortest paths from ``starts(s)`` add to the nodes between their ends; ``steps(_a, _b)`` go both ways."""
    front = materialize(starts.select("s", F.col("s").alias("v"), F.lit(1.0).alias("ways")), "level")
    levels = []
    while front.take(1):
        levels.append(front)
        reached = front.join(steps, F.col("v") == F.col("_a")).select("s", F.col("_b").alias("v"), "ways", F.lit(False).alias("old"))
        # the next nodes of a level's nodes lie at most one level back
        for level in levels[-2:]:
            reached = reached.unionByName(level.select("s", "v", F.lit(0.0).alias("ways"), F.lit(True).alias("old")))
        front = materialize(reached.groupBy("s", "v").agg(F.sum("ways").alias("ways"), F.max("old").alias("old")).where("not old").drop("old"), "level")
    total: list[DataFrame] = []
    done = [front]
    for level in reversed(levels[1:]):
        rows = level.select("s", "v", "ways", F.lit(0.0).alias("flow"))
        if total:
            back = total[-1].join(steps, F.col("v") == F.col("_a")).select("s", F.col("_b").alias("v"), F.lit(None).cast("double").alias("ways"), ((1 + F.col("credit")) / F.col("ways")).alias("flow"))
            rows = rows.unionByName(back).groupBy("s", "v").agg(F.max("ways").alias("ways"), F.sum("flow").alias("flow")).where("ways is not null")
        total.append(materialize(rows.select("s", "v", "ways", (F.col("ways") * F.col("flow")).alias("credit")), "credit"))
    done += levels + total
    sums = [t.groupBy("v").agg(F.sum("credit").alias("credit")) for t in total] or [starts.select(F.col("s").alias("v"), F.lit(0.0).alias("credit"))]
    found = materialize(reduce(DataFrame.unionByName, sums).groupBy("v").agg(F.sum("credit").alias("credit")), "credits")
    for df in done:
        discard(df)
    return found


def bridges(nodes: DataFrame, edges: DataFrame, top_n: int = 20, sources: int | None = None) -> DataFrame:
    """(path, title, betweenness) of the notes that most shortest paths pass, rounded to 6 digits."""
    scored = betweenness(nodes, edges, sources).select("path", F.round("betweenness", 6).alias("betweenness"))
    return nodes.select("path", "title").join(scored, "path").orderBy(F.col("betweenness").desc(), "path").limit(top_n)
