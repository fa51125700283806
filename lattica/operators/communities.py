"""Communities and the gaps between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.centrality import degrees
from lattica.session import materialize


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(path, community): deterministic Louvain on the undirected weighted projection.

    Notes move in path order; a pair with two directions takes the larger weight. Modularity optimisation is sequential, so
    one task holds all edges, as arrays of integer codes that joins have put in place of the paths; its memory grows with
    the edges, without a bound. Everything before and after it is distributed. Notes without edges are communities of
    their own. Ids are ordered by their first path.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("w"))
    pairs = materialize(pairs, "pairs")
    # rising with the path, as ids rise over the sorted partitions
    ends = pairs.select(F.explode(F.array("a", "b")).alias("path")).distinct().orderBy("path")
    codes = materialize(ends.withColumn("code", F.monotonically_increasing_id()), "codes")
    side = lambda c: codes.select(F.col("path").alias(c), F.col("code").alias(f"_{c}"))
    coded = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("w").cast("double").alias("w"), F.lit(0).alias("_one"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, member = _communities(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), resolution)
        return pd.DataFrame({"code": ids, "c": member})

    found = coded.groupBy("_one").applyInPandas(run, "code long, c long").join(codes, "code").select("path", "c")
    found = materialize(found, "found")
    named = found.join(found.groupBy("c").agg(F.min("path").alias("first")), "c").select("path", "first")
    return nodes.select("path").distinct().join(named, "path", "left").select("path", F.coalesce("first", "path").alias("community"))


def _communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order and the community of each, for undirected edges between ``a`` and ``b``."""
    ids = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    a, b = np.searchsorted(ids, a).astype(np.int32), np.searchsorted(ids, b).astype(np.int32)
    two = a != b
    src, dst, w = np.concatenate([a, b[two]]), np.concatenate([b, a[two]]), np.concatenate([w, w[two]])
    n, member = len(ids), np.arange(len(ids))
    while True:
        order = np.lexsort((dst, src))
        src, dst, w = src[order], dst[order], w[order]
        labels, moved = _move(src, dst, w, n, resolution)
        _, first, labels = np.unique(labels, return_index=True, return_inverse=True)
        labels = np.argsort(np.argsort(first))[labels]  # numbered by first member
        member, k = labels[member], len(first)
        if not moved or k == n:
            return ids, member
        c, d = labels[src], labels[dst]
        # an inner link is seen from both ends; a loop holds it once
        w = np.where((c == d) & (src != dst), w / 2, w)
        pair, at = np.unique(c.astype(np.int64) * k + d, return_inverse=True)
        src, dst, w, n = (pair // k).astype(np.int32), (pair % k).astype(np.int32), np.bincount(at, w), k


def _move(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, resolution: float) -> tuple[list[int], bool]:
    """One level, over edges in order of ``src``: nodes move to the neighbouring community of largest gain until none does."""
    at = np.searchsorted(src, np.arange(n + 1)).tolist()
    strength = np.bincount(src, np.where(src == dst, 2 * w, w), n).tolist()
    whole = sum(strength)
    label, total = list(range(n)), list(strength)
    moved, again = False, whole > 0
    while again:
        again = False
        for v in range(n):
            own, k = label[v], strength[v]
            total[own] -= k
            links: dict[int, float] = {own: 0.0}
            for u, x in zip(dst[at[v] : at[v + 1]].tolist(), w[at[v] : at[v + 1]].tolist()):
                if u != v:
                    links[label[u]] = links.get(label[u], 0.0) + x
            best, gain = own, links[own] - resolution * total[own] * k / whole
            for c in sorted(links):
                g = links[c] - resolution * total[c] * k / whole
                if g > gain + 1e-12:
                    best, gain = c, g
            total[best] += k
            if best != own:
                label[v], moved, again = best, True, True
    return label, moved


def profiles(nodes: DataFrame, members: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """(community, size, top_tags, top_types, representative) of communities with at least ``min_size`` notes.

    Five most frequent tags and three most frequent types, ties by name; the representative has most edge ends, ties by path.
    """
    placed = members.join(nodes.select("path", "tags", "type"), "path").join(degrees(edges), "path", "left")
    sizes = placed.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min_by("path", F.struct(-F.coalesce("degree", F.lit(0)), "path")).alias("representative")).where(F.col("size") >= min_size)

    def top(values: DataFrame, n: int, name: str) -> DataFrame:
        counts = values.groupBy("community", "v").agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.col("n").desc(), "v"))).where(F.col("r") <= n)
        return ranked.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(name))

    tags = top(placed.select("community", F.explode("tags").alias("v")).where("v is not null"), 5, "top_tags")
    types = top(placed.where("type is not null and type <> ''").select("community", F.col("type").alias("v")), 3, "top_types")
    none = F.array().cast("array<string>")
    return sizes.join(tags, "community", "left").join(types, "community", "left").select("community", "size", F.coalesce("top_tags", none).alias("top_tags"), F.coalesce("top_types", none).alias("top_types"), "representative")


def gaps(profile: DataFrame, members: DataFrame, edges: DataFrame, max_bridges: int = 2, min_shared: int = 1) -> DataFrame:
    """(community_a, community_b, shared_tags, bridges): pairs that share top tags but have few edges between them.

    Pairs meet on a shared top tag, of which each community has five; edges of all types count, both directions separately.
    """
    side = lambda p, c: members.select(F.col("path").alias(p), F.col("community").alias(c))
    kept = profile.select("community")
    ends = edges.join(side("src", "x"), "src").join(side("dst", "y"), "dst").where("x <> y")
    crossing = ends.groupBy(F.least("x", "y").alias("community_a"), F.greatest("x", "y").alias("community_b")).agg(F.count(F.lit(1)).alias("bridges"))
    tags = profile.join(kept, "community").select("community", F.posexplode("top_tags").alias("i", "tag"))
    a, b = tags.select(F.col("community").alias("community_a"), "i", "tag"), tags.select(F.col("community").alias("community_b"), "tag")
    shared = a.join(b, "tag").where("community_a < community_b").groupBy("community_a", "community_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "tag"))), lambda x: x["tag"]).alias("shared_tags"))
    pairs = shared.where(F.size("shared_tags") >= min_shared).join(crossing, ["community_a", "community_b"], "left").withColumn("bridges", F.coalesce("bridges", F.lit(0)))
    return pairs.where(F.col("bridges") <= max_bridges).orderBy("bridges", -F.size("shared_tags"), "community_a", "community_b")
