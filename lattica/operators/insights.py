"""Reports over notes and edges: drift, suggestions, broken links, details, reading sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import folder, iso_date, token_estimate
from lattica.operators.centrality import degrees
from lattica.operators.graph import EXPLICIT, PLACEHOLDER_TITLES
from lattica.operators.search import keyword_search
from lattica.session import materialize
from lattica.operators.traverse import blast_radius, distances, find_node, structural_view


def broken_links(nodes: DataFrame, broken: DataFrame) -> DataFrame:
    """(path, title, target), by title."""
    return broken.join(nodes.select(F.col("path").alias("src"), "title"), "src", "left").select(F.col("src").alias("path"), F.coalesce("title", "src").alias("title"), "target").orderBy("title", "path", "target")


def query_node(nodes: DataFrame, edges: DataFrame, seed: DataFrame) -> DataFrame:
    """(direction, other, type, weight): edges of one note, outbound and inbound."""
    out = edges.join(seed.withColumnRenamed("path", "src"), "src", "left_semi").select(F.lit("outbound").alias("direction"), F.col("dst").alias("other"), "type", "weight")
    back = edges.join(seed.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.lit("inbound").alias("direction"), F.col("src").alias("other"), "type", "weight")
    return out.unionByName(back)


def tag_search(nodes: DataFrame, tag: str) -> DataFrame:
    """(path, title) of notes with the tag, without regard to case, by title."""
    return nodes.where(F.exists("tags", lambda t: F.lower(t) == tag.lower())).select("path", "title").orderBy("title", "path")


def list_stale(nodes: DataFrame, days: int, as_of: str) -> DataFrame:
    """(path, title, last_updated) of notes without a date or with one at least ``days`` before ``as_of``."""
    d = iso_date(F.col("updated"))
    shown = F.when(F.coalesce("updated", F.lit("")) == "", "unknown").otherwise(F.col("updated"))
    return nodes.where(d.isNull() | (d <= F.date_sub(F.lit(as_of).cast("date"), days))).select("path", "title", shown.alias("last_updated")).orderBy("last_updated", "path")


def drift(nodes: DataFrame, edges: DataFrame, as_of: str, stale_days: int = 30, recent_days: int = 14, top_n: int | None = 30) -> DataFrame:
    """(path, title, last_updated, days_stale, connected_recent, reason): stale notes linked with recently changed ones.

    Titles of out-neighbours come first, then new ones of in-neighbours, each in path order; five are kept, three named.
    """
    today = F.lit(as_of).cast("date")
    dated = nodes.select("path", "title", "updated", iso_date(F.col("updated")).alias("d"))
    stale = dated.where(F.col("d").isNull() | (F.col("d") <= F.date_sub(today, stale_days)))
    recent = dated.where(F.col("d") > F.date_sub(today, stale_days)).where(F.col("d") >= F.date_sub(today, recent_days)).select(F.col("path").alias("other"), F.coalesce("title", "path").alias("other_title"))
    pairs = edges.select(F.col("src").alias("path"), F.col("dst").alias("other"), F.lit(0).alias("k")).unionByName(edges.select(F.col("dst").alias("path"), F.col("src").alias("other"), F.lit(1).alias("k")))
    linked = pairs.join(stale.select("path"), "path", "left_semi").join(recent, "other").groupBy("path", "other_title").agg(F.min(F.struct("k", "other")).alias("o"))
    five = linked.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("o", "other_title"))).where("r <= 5")
    named = five.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other_title"))), lambda x: x["other_title"]).alias("connected_recent"))
    days = F.coalesce(F.datediff(today, "d"), F.lit(stale_days + 1))
    out = stale.join(named, "path").select(
        "path", "title", F.when(F.coalesce("updated", F.lit("")) == "", "unknown").otherwise(F.col("updated")).alias("last_updated"), days.alias("days_stale"), "connected_recent",
        F.concat(F.lit("Not updated in "), days.cast("string"), F.lit("d but connected to: "), F.array_join(F.slice("connected_recent", 1, 3), ", ")).alias("reason"),
    )
    return out.orderBy(F.col("days_stale").desc(), "path").limit(top_n) if top_n else out


def suggest_links(nodes: DataFrame, edges: DataFrame, source: DataFrame | None = None, top_n: int | None = 20, min_score: float = 0.3) -> DataFrame:
    """(source, target, score, shared_tags, shared_neighbours): links that are missing.

    Candidates of one ``source(path)``, or of all notes that share a tag. Score: twice the tag overlap, plus up to 1 for
    shared neighbours, halved for equal types. Linked pairs, pairs of one folder and placeholder titles are left out.
    """
    tags = F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    rows = nodes.where("path is not null").select("path", "type", tags.alias("tags"), folder(F.col("path")).alias("f"), F.coalesce(F.col("title").isin(*PLACEHOLDER_TITLES), F.lit(False)).alias("skip"))
    # pairs are formed and joined by numbers in path order; paths come back for the result
    known = materialize(rows.orderBy("path").withColumn("id", F.monotonically_increasing_id()), "known")
    ok = known.where("not skip")
    ids = lambda s: known.select(F.col("path").alias(s), F.col("id").alias(f"{s}_id"))
    links = materialize(edges.select("src", "dst", "type").join(ids("src"), "src").join(ids("dst"), "dst").select(F.col("src_id").alias("s"), F.col("dst_id").alias("d"), "type"), "links")
    kept = links.where(F.col("type").isin(*EXPLICIT)).where("s <> d")
    near = kept.select("s", "d").unionByName(kept.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct()
    tag = ok.select("id", F.explode("tags").alias("tag"))
    right = tag.withColumnRenamed("id", "b")
    linked = links.select(F.least("s", "d").alias("x"), F.greatest("s", "d").alias("y")).distinct()
    if source is None:
        candidates = _promising(ok.where(F.size("tags") > 0), materialize(near, "near"), linked, top_n, min_score)
    else:
        own = known.join(source.select("path"), "path", "left_semi").select("id")
        common = tag.join(own, "id", "left_semi").withColumnRenamed("id", "a").join(right, "tag").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"))
        # without a shared tag, too, candidates of a source can share neighbours with it
        first = near.join(own.withColumnRenamed("id", "s"), "s", "left_semi").select(F.col("s").alias("a"), F.col("d").alias("m"))
        second = first.join(near.select(F.col("s").alias("m"), F.col("d").alias("b")), "m").where("a <> b").select("a", "b").distinct()
        candidates = common.join(second, ["a", "b"], "full_outer").withColumn("i", F.coalesce("i", F.lit(0)))
    side = lambda s: ok.select(F.col("id").alias(s), F.col("type").alias(f"t{s}"), F.size("tags").alias(f"n{s}"), F.col("f").alias(f"f{s}"))
    full = candidates.join(side("a"), "a").join(side("b"), "b").where("fa <> fb")
    union = F.col("na") + F.col("nb") - F.col("i")
    same = (F.coalesce("ta", F.lit("")) != "") & F.col("ta").eqNullSafe(F.col("tb"))
    rated = full.select("a", "b", "i", F.when(same, 0.5).otherwise(1.0).alias("part"), F.when(union > 0, 2.0 * F.col("i") / union).otherwise(0.0).alias("by_tags"))
    free = rated.where(F.col("part") * (F.col("by_tags") + 1.0) >= min_score - 1e-12).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(linked, ["x", "y"], "left_anti").drop("x", "y")
    if top_n:
        # neighbours add at most 1, so pairs that even then stay behind the top_n best by tags alone need no look at neighbours
        free = materialize(free, "free")
        score = F.col("part") * F.col("by_tags")
        best = free.select(score.alias("v")).orderBy(F.col("v").desc()).limit(top_n).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).first()
        if best["n"] == top_n:
            free = free.where(F.col("part") * (F.col("by_tags") + 1.0) >= best["v"] - 1e-9)
    mutual = free.select("a", "b").join(near.select(F.col("s").alias("a"), F.col("d").alias("m")), "a").join(near.select(F.col("s").alias("b"), F.col("d").alias("m")), ["b", "m"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    shared = F.coalesce("k", F.lit(0))
    scored = free.join(mutual, ["a", "b"], "left").withColumn("_s", F.col("part") * (F.col("by_tags") + F.least(shared * 0.3, F.lit(1.0)))).where(F.col("_s") >= min_score - 1e-12)
    short = scored.select("a", "b", F.round("_s", 3).alias("score"), F.col("i").alias("shared_tags"), shared.alias("shared_neighbours"))
    if top_n:
        short = short.orderBy(F.col("score").desc(), "a", "b").limit(top_n)
    names = lambda s, n: known.select(F.col("id").alias(s), F.col("path").alias(n))
    out = short.join(names("a", "source"), "a").join(names("b", "target"), "b").select("source", "target", "score", "shared_tags", "shared_neighbours")
    return out.orderBy(F.col("score").desc(), "source", "target")


def _promising(notes: DataFrame, near: DataFrame, linked: DataFrame, top_n: int | None, min_score: float) -> DataFrame:
    """(a, b, i): pairs of ``notes(id, type, tags, f)`` with ``i`` shared tags, all that may be among the ``top_n`` of :func:`suggest_links`.

    Scores of some good pairs, with equal tags and a shared neighbour in ``near(s, d)``, give a bound. A pair that reaches it needs some
    overlap of tags and, if the bound is above what tags alone can give, some number of shared neighbours: such pairs meet on a
    tag among the rarer ones of either note and a neighbour among the less linked ones of either at once, so that neither
    frequent tags nor notes with many links bring all pairs together. Pairs that tags alone lift to the bound meet on tags.
    """
    counts = notes.select("id", F.size("tags").cast("long").alias("n"), F.explode("tags").alias("tag"))
    often = counts.groupBy("tag").agg(F.count(F.lit(1)).alias("c"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("c", c))), lambda t: t[c])
    sets = counts.join(often, "tag").groupBy("id").agg(listed("tag").alias("tags"))
    links = near.join(near.groupBy("d").agg(F.count(F.lit(1)).alias("c")), "d").groupBy(F.col("s").alias("id")).agg(listed("d").alias("near"))
    none = F.array().cast("array<bigint>")
    rows = sets.join(links, "id", "left").join(notes.select("id", "f", F.nullif(F.col("type"), F.lit("")).alias("type")), "id")
    rows = materialize(rows.withColumn("near", F.coalesce("near", none)), "sets")

    def meet(left: DataFrame, by: list[str], overlap: float, mutual: int, mixed: bool) -> DataFrame:
        """(a, b, i, s): unlinked pairs of rows with equal ``by`` and their scores; ``mixed``: of equal types none."""
        cols = [c for c in ("id", "type", "tags", "near", "f")]
        other = left.select(*by, *[F.col(c).alias(f"{c}_") for c in cols])
        na, nb = F.size("tags"), F.size("tags_")
        fits = (F.col("id") < F.col("id_")) & (F.col("f") != F.col("f_")) & (F.least(na, nb) >= overlap * F.greatest(na, nb) - 1e-9)
        same = F.coalesce(F.col("type") == F.col("type_"), F.lit(False))
        pairs = left.join(other, by).where(fits & (~same if mixed else F.lit(True)))
        i, k = F.size(F.array_intersect("tags", "tags_")), F.size(F.array_intersect("near", "near_"))
        pairs = pairs.select(F.col("id").alias("a"), F.col("id_").alias("b"), same.alias("same"), i.alias("i"), k.alias("k"), (na + nb - i).alias("u")).where(F.col("k") >= mutual)
        score = F.when(F.col("same"), 0.5).otherwise(1.0) * (2.0 * F.col("i") / F.col("u") + F.least(F.col("k") * 0.3, F.lit(1.0)))
        scored = pairs.select("a", "b", F.col("i").cast("long").alias("i"), score.alias("s")).distinct()
        return scored.join(linked, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")

    def front(c: str, shared) -> F.Column:
        """The first items of an array, of which two that share as many as ``shared`` items have one in common."""
        return F.slice(c, 1, F.greatest(F.lit(0), F.size(c) - shared + 1).cast("int"))

    bound = min_score
    if top_n:
        # hubs are no good meeting places for a first look
        first = rows.where(F.size("near") >= 2).select("*", F.array_join(F.array_sort("tags"), "\x00").alias("all"), F.explode(front("near", F.lit(2))).alias("m"))
        best = meet(first, ["all", "m"], 1.0, 1, False).orderBy(F.col("s").desc()).limit(top_n).agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n")).first()
        bound = max(bound, best["s"]) if best["n"] == top_n else bound
    bound -= 1e-3  # scores are compared with three digits
    mixed = bound > 1.5  # pairs of equal types stay below
    mutual = max(1, math.ceil((bound - 2) / 0.3 - 1e-9))
    overlap = max(1e-9, (bound - 1) / 2)

    def by_tags(overlap: float) -> DataFrame:
        return rows.withColumn("tag", F.explode(front("tags", F.ceil(F.size("tags") * overlap - 1e-9))))

    both = by_tags(overlap).withColumn("m", F.explode(front("near", F.lit(mutual))))
    found = meet(both, ["tag", "m"], overlap, mutual, mixed)
    if bound <= 2:
        found = found.unionByName(meet(by_tags(max(1e-9, bound / 2)), ["tag"], max(1e-9, bound / 2), 0, mixed))
    return found.where(F.col("s") >= bound).select("a", "b", "i").distinct()


def surprising_connections(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """(source, target, score, distance): strong suggestions at least three structural hops apart; 99 means unreachable."""
    pairs = suggest_links(nodes, edges, top_n=3 * top_n, min_score=0.5).select(F.col("source").alias("a"), F.col("target").alias("b"), "score")
    pairs, steps = materialize(pairs, "pairs"), structural_view(nodes, edges)
    # most have a neighbour in common, which needs no search; only the rest is searched
    beside = pairs.select("a", "b").join(steps.select("a", F.col("b").alias("m")), "a")
    across = beside.join(steps.select(F.col("a").alias("m"), "b"), ["m", "b"])
    rest = materialize(pairs.join(beside.where("b = m").select("a", "b").unionByName(across.select("a", "b")).distinct(), ["a", "b"], "left_anti"), "pairs")
    far = distances(steps, rest).where("distance >= 3") if rest.take(1) else rest.withColumn("distance", F.lit(99)).limit(0)
    return far.select(F.col("a").alias("source"), F.col("b").alias("target"), "score", "distance").orderBy(F.col("score").desc(), "source", "target").limit(top_n)


def context_pack(nodes: DataFrame, edges: DataFrame, topic: str, token_budget: int = 4000, depth: int = 2) -> DataFrame:
    """(path, title, relevance, word_count, estimated_tokens, tags): a reading set for ``topic``.

    The seed is the note titled so, else the best keyword hit. Notes enter in order of impact while the tokens of those
    before them stay below the budget; the shown relevance has a bonus for degree.
    """
    seed = find_node(nodes, topic)
    if not seed.take(1):
        seed = keyword_search(nodes, topic, 1).select("path")
    reached = blast_radius(edges, seed, depth, 0.1).select("path", "relevance", "distance").unionByName(seed.select("path", F.lit(1.0).alias("relevance"), F.lit(0).alias("distance")))
    degree = degrees(edges)
    rows = reached.join(nodes.select("path", "title", "word_count", "tags"), "path").join(degree, "path", "left").withColumn("_most", degree.agg(F.max("degree")).scalar())
    sized = rows.withColumn("estimated_tokens", token_estimate(F.col("word_count")))
    # the pack is one ordered list; only notes reached from one seed are in it
    order = Window.orderBy(F.col("distance") > 0, F.col("relevance").desc(), "distance", "path").rowsBetween(Window.unboundedPreceding, -1)
    packed = sized.withColumn("_before", F.coalesce(F.sum("estimated_tokens").over(order), F.lit(0))).where(F.col("_before") < token_budget)
    bonus = F.when(F.coalesce("_most", F.lit(0)) > 0, F.coalesce("degree", F.lit(0)) / F.col("_most")).otherwise(0.0)
    shown = F.round(F.col("relevance") * (1 + bonus * 0.2), 4)
    return packed.select("path", "title", shown.alias("relevance"), "word_count", "estimated_tokens", "tags").orderBy(F.col("relevance").desc(), "path")
