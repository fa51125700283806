"""Building the graph: names, links, tags and folders to one edge per pair of notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import GraphConfig
from lattica.functions.text import folder, stem
from lattica.session import materialize

# Titles of pages that link everything, embeds that are no notes, link targets that are section headings.
GENERIC_TITLES = (
    "Summary", "Notes", "Meetings", "Note", "Notes and Thoughts", "Clippings", "Source 1", "Introduction", "Home", "See also", "References", "Overview",
    "Concept A", "Concept B", "Concept A vs Concept B", "Related Concept", "Source A", "Source Name", "Does Scale Improve Reasoning?", "Wikilinks", "wikilinks", "double bracket",
)
PLACEHOLDER_TITLES = (
    "Summary", "Notes", "Meetings", "Note", "Notes and Thoughts", "Clippings", "Source 1", "Concept A", "Concept B", "Concept A vs Concept B", "Related Concept",
    "Source A", "Source Name", "Does Scale Improve Reasoning?", "Wikilinks", "wikilinks", "double bracket",
)
NOT_NOTES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".pdf", ".pptx", ".xlsx", ".docx", ".base", ".csv", ".json", ".canvas")
HEADING_EMOJI = ("🎯", "📅", "✍️", "🏆", "📋", "💬", "📎", "🔗", "💡", "🔑", "📌", "⭐", "🔥", "✅", "⬜", "📝", "🔍", "🧠", "📊", "🏠", "💼", "🚀", "⚙️", "🛠", "📚", "🎓", "🔔", "📍")
STRUCTURAL = ("wikilink", "related_to", "embed", "semantic_similarity")
EXPLICIT = ("wikilink", "related_to", "embed")
BROKEN = "__broken__:"


def _any(conditions) -> F.Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def name_table(notes: DataFrame, by: str = "path") -> DataFrame:
    """(kind, key, path): what a link name may mean, by kind 1 title, 2 alias, 3 stem, 4 path; the last path wins.

    Keys compare in lower case. Null titles and aliases have no key. ``by`` names a column to give instead of the path, in its order.
    """
    low = F.lower
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), low(key).alias("key"))
    keys = F.concat(F.array(one(1, F.col("title")), one(3, stem(F.col("path"))), one(4, F.col("path"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: one(2, a)))
    return notes.select(F.col(by).alias("path"), F.explode(keys).alias("k")).where("k.key is not null").groupBy("k.kind", "k.key").agg(F.max("path").alias("path"))


def resolve_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``dst`` to ``links(target, ...)``: by title, alias, stem, then, for names with '/', path and last segment's stem.

    Distinct targets are looked up once by one equi-join and the best kind kept; ``dst`` is null if nothing fits.
    """
    targets = links.select("target").where("target is not null").distinct()
    low = F.lower("target")
    last = F.regexp_replace(F.regexp_extract(low, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    one = lambda rank, kind, key: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))
    plain = F.array(one(1, 1, low), one(2, 2, low), one(3, 3, low))
    deep = F.array(one(4, 4, low), one(5, 4, F.concat(low, F.lit(".md"))), one(6, 3, last))
    wanted = targets.select("target", F.explode(F.when(F.instr("target", "/") > 0, F.concat(plain, deep)).otherwise(plain)).alias("w")).select("target", "w.*")
    found = wanted.join(names, ["kind", "key"]).groupBy("target").agg(F.min_by("path", "rank").alias("dst"))
    return links.join(found, "target", "left")


def link_edges(notes: DataFrame, config: GraphConfig = GraphConfig(), by: str = "path") -> tuple[DataFrame, DataFrame]:
    """Candidate edges (src, dst, type, weight, stage, ordinal, kind) and broken links (src, target) of notes' links.

    Notes go by their path, or by another column in its order.
    """
    lists = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("type"), F.lit(w).alias("weight"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("targets"))
        for kind, (t, c, w) in enumerate((("embed", "embeds", config.embed_weight), ("wikilink", "wikilinks", config.wikilink_weight), ("related_to", "related_to", config.related_to_weight)))
    ])
    links = notes.select(F.col(by).alias("src"), F.explode(lists).alias("l")).select("src", "l.kind", "l.type", "l.weight", F.explode("l.targets").alias("target"))
    links = links.where("target is not null").where((F.col("type") != "embed") | ~_any(F.lower("target").endswith(s) for s in NOT_NOTES)).distinct()
    resolved = resolve_links(links, name_table(notes, by))
    broken = resolved.where("dst is null and type = 'wikilink'").where(~_any(F.col("target").startswith(e) for e in HEADING_EMOJI) & ~F.col("target").isin(*PLACEHOLDER_TITLES))
    hit = resolved.where("dst is not null").select("src", "dst", "type", "weight", "kind")
    back = hit.where("type = 'related_to'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight", "kind", F.col("src").alias("ordinal"))
    edges = hit.withColumn("ordinal", F.col("src")).unionByName(back).withColumn("stage", F.lit(0))
    return edges, broken.select("src", "target").distinct()


#: Notes that share only frequent tags meet by which of these they hold; at most so many, bits of one number.
FREQUENT_TAGS = 62


def _tags(notes: DataFrame) -> F.Column:
    """A note's tags as a set; null for generic titles."""
    return F.when(~F.coalesce(F.col("title").isin(*GENERIC_TITLES), F.lit(False)), F.array_distinct(F.filter("tags", lambda t: t.isNotNull())))


def tag_edges(notes: DataFrame, weight: float = 0.5, min_jaccard: float = 0.15, top: int = 20) -> DataFrame:
    """(src, dst, type, weight) both ways between notes with overlapping tags.

    A pair stays if it is among the ``top`` heaviest of either end; equal weights rank by path. Generic titles are
    left out.
    """
    tagged = notes.where("path is not null").select("path", _tags(notes).alias("tags"))
    # pairs are found and ranked by numbers in path order; paths come back for the pairs that stay
    numbered = materialize(tagged.where(F.size("tags") > 0).orderBy("path").withColumn("id", F.monotonically_increasing_id()), "tagged")
    names = lambda s: numbered.select(F.col("id").alias(s), F.col("path").alias(f"p{s}"))
    kept = tag_pairs(numbered, weight, min_jaccard, top).join(names("a"), "a").join(names("b"), "b")
    return _both_ways(kept.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "weight"), "tag_overlap")


def tag_pairs(sets: DataFrame, weight: float, min_jaccard: float, top: int) -> DataFrame:
    """(a, b, weight), a < b, of pairs of ``sets(id, tags)`` among the ``top`` heaviest of either end; equal weights rank by id.

    Notes that share a rarer tag meet on it. What notes that share frequent tags only have in common depends on the frequent tags
    they hold and their numbers of tags alone, so the first notes by id of each such kind stand for the rest: those before a note
    in its kind are never lighter, and with ``top`` of them before it, it isn't among the ``top``. Pairs don't grow with the square of
    a frequent tag's notes. How many tags count as frequent is chosen by counts.
    """
    counts = sets.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).cast("double").alias("c"))
    often = counts.orderBy(F.col("c").desc(), "tag").limit(FREQUENT_TAGS).collect()
    whole = counts.agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0.0
    tries = sorted({k for k in (0, 4, 8, 16, 24, 32, 40, 48, 56, FREQUENT_TAGS) if k <= len(often)})
    some = lambda k: F.array(*[F.lit(r["tag"]) for r in often[:k]]).cast("array<string>")
    ways = sets.agg(*[F.sum(F.pow(F.lit(2.0), F.size(F.array_intersect("tags", some(k))))).alias(f"k{k}") for k in tries]).first()
    k = min(tries, key=lambda k: whole - sum(r["c"] ** 2 for r in often[:k]) + (top + 1) * (ways[f"k{k}"] or 0.0))
    bits = F.map_from_arrays(some(k), F.array(*[F.lit(1 << i) for i in range(k)]).cast("array<bigint>"))
    held = F.aggregate(F.array_intersect("tags", some(k)), F.lit(0).cast("bigint"), lambda m, t: m.bitwiseOR(F.coalesce(bits[t], F.lit(0).cast("bigint"))))
    notes = materialize(sets.select("id", F.size("tags").alias("n"), held.alias("held"), F.array_except("tags", some(k)).alias("rare")), "sets")

    jaccard = lambda i, both: (i / (both - i)).alias("j")
    order = lambda of: Window.partitionBy(*of).orderBy(F.round(F.col("j") * weight, 9).desc(), "m")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "m", "j"))), lambda x: F.struct(x["m"].alias("m"), x["j"].alias("j")))
    # by rarer tags; a pair counts where it meets first
    long = notes.select("id", "n", "held", "rare", F.explode("rare").alias("tag"))
    other = long.select("tag", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "held", "rare")])
    met = long.join(other, "tag").where((F.col("id") != F.col("id_")) & (F.least("n", "n_") >= min_jaccard * F.greatest("n", "n_")))
    met = met.withColumn("common", F.array_intersect("rare", "rare_")).where(F.col("common")[0] == F.col("tag"))
    rated = met.select("id", F.col("id_").alias("m"), jaccard(F.size("common") + F.bit_count(F.col("held").bitwiseAND(F.col("held_"))), F.col("n") + F.col("n_"))).where(F.col("j") >= min_jaccard)
    near = rated.withColumn("r", F.row_number().over(order(["id"]))).where(F.col("r") <= top).groupBy("id").agg(listed.alias("near"))

    # by frequent tags: the first notes of each kind and, for all sets of frequent tags, those that hold them
    parts = F.aggregate(
        F.filter(F.array(*[F.lit(1 << i) for i in range(k)]).cast("array<bigint>"), lambda b: F.col("held").bitwiseAND(b) != 0), F.array(F.lit(0).cast("bigint")),
        lambda made, b: F.concat(made, F.transform(made, lambda x: x.bitwiseOR(b))),
    )
    part = F.explode(F.filter(parts, lambda x: x != 0)).alias("part")
    first = lambda df, of: df.withColumn("r", F.row_number().over(Window.partitionBy(*of).orderBy("id"))).where(F.col("r") <= top + 1).drop("r")
    kinds = first(notes.where("held <> 0").select("held", "n", "id"), ["held", "n"])
    holders = materialize(first(kinds.select("held", "n", "id", part), ["part", "n"]).groupBy("part", "n").agg(F.collect_list(F.struct("id", "held")).alias("ids"), F.count(F.lit(1)).alias("size")), "holders")
    ours = notes.where("held <> 0").select("held", "n").distinct().select("held", "n", part)
    fits = ours.join(holders.select("part", F.col("n").alias("n_"), "size"), "part").select("held", "n", "part", "n_", "size", jaccard(F.bit_count("part"), F.col("n") + F.col("n_"))).where(F.col("j") >= min_jaccard)
    # where enough notes reach some overlap, parts that promise less are not needed
    enough = F.max(F.when(F.col("size") > top, F.col("j"))).over(Window.partitionBy("held", "n"))
    needed = fits.withColumn("enough", enough).where(F.col("enough").isNull() | (F.col("j") >= F.col("enough") - 1e-8))
    members = needed.select("held", "n", "part", "n_").join(holders.select("part", F.col("n").alias("n_"), "ids"), ["part", "n_"]).select("held", "n", "n_", F.explode("ids").alias("x"))
    measured = members.select("held", "n", F.col("x.id").alias("m"), jaccard(F.bit_count(F.col("held").bitwiseAND(F.col("x.held"))), F.col("n") + F.col("n_"))).distinct()
    best = measured.withColumn("r", F.row_number().over(order(["held", "n"]))).where(F.col("r") <= top + 1).groupBy("held", "n").agg(listed.alias("best"))

    none = F.array().cast("array<struct<m:bigint,j:double>>")
    both = notes.select("id", "n", "held").join(best, ["held", "n"], "left").join(near, "id", "left").select("id", F.coalesce("near", none).alias("near"), F.coalesce("best", none).alias("best"))
    more = F.filter("best", lambda x: (x["m"] != F.col("id")) & ~F.array_contains(F.transform("near", lambda y: y["m"]), x["m"]))
    ranked = F.array_sort(F.transform(F.concat("near", more), lambda x: F.struct((-F.round(x["j"] * weight, 9)).alias("w"), x["m"].alias("m"), x["j"].alias("j"))))
    ends = both.select("id", F.explode(F.slice(ranked, 1, top)).alias("x"))
    return ends.select(F.least("id", "x.m").alias("a"), F.greatest("id", "x.m").alias("b"), (F.col("x.j") * weight).alias("weight")).repartition("a").dropDuplicates(["a", "b"])


def top_pairs(scored: DataFrame, top: int) -> DataFrame:
    """Pairs of ``scored(a, b, weight)`` that are among the ``top`` of either end."""
    ends = scored.select("a", "b", "weight", F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m")))).alias("e"))
    ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("e.n").orderBy(F.round("weight", 9).desc(), "e.m"))).where(F.col("r") <= top)
    return ranked.select("a", "b", "weight").distinct()


def _both_ways(pairs: DataFrame, kind: str) -> DataFrame:
    two = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(two).alias("e"), "weight").select("e.src", "e.dst", F.lit(kind).alias("type"), "weight")


def folder_edges(notes: DataFrame, weight: float = 0.3, by: str = "path") -> DataFrame:
    """(src, dst, type, weight) both ways between notes of one folder; opt-in, as a folder's pairs grow with its square."""
    placed = notes.where("path is not null").select(F.col(by).alias("key"), folder(F.col("path")).alias("f")).distinct()
    pairs = placed.select(F.col("key").alias("a"), "f").join(placed.select(F.col("key").alias("b"), "f"), "f").where("a < b")
    return _both_ways(pairs.select("a", "b", F.lit(weight).alias("weight")), "folder_proximity")


def resolve_conflicts(candidates: DataFrame, order: list) -> DataFrame:
    """One edge per (src, dst): the heaviest, on a tie the first by ``order``. Combines on the map side."""
    best = candidates.groupBy("src", "dst").agg(F.min_by(F.struct("type", "weight"), F.struct((-F.col("weight")).alias("w"), *order)).alias("e"))
    return best.select("src", "dst", "e.type", "e.weight")


def build_graph(notes: DataFrame, config: GraphConfig = GraphConfig(), semantic: DataFrame | None = None, folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, broken links) of parsed notes: explicit links, then tags, then semantic edges, one edge per pair."""
    # edges are formed and compared by numbers in path order; paths come back for those that stay
    paths = notes.select("path")
    if semantic is not None:
        paths = paths.unionByName(semantic.select(F.explode(F.array("src", "dst")).alias("path")))
    paths = materialize(paths.where("path is not null").distinct().orderBy("path").withColumn("id", F.monotonically_increasing_id()), "paths")
    known = materialize(notes.join(paths, "path"), "notes")
    named = lambda s: paths.select(F.col("id").alias(s), F.col("path").alias(f"p{s}"))
    explicit, broken = link_edges(known, config, "id")
    later = [folder_edges(known, config.folder_proximity_weight, "id")] if folders else []
    if semantic is not None:
        ends = semantic.select(F.col("src").alias("pa"), F.col("dst").alias("pb"), "type", "weight").join(named("a"), "pa").join(named("b"), "pb")
        later.append(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", "weight"))
    parts = [explicit] + [p.select("src", "dst", "type", "weight", F.lit(0).alias("kind"), F.col("src").alias("ordinal"), F.lit(i + 2).alias("stage")) for i, p in enumerate(later)]
    rank = lambda weight, *order: F.struct((-weight).cast("double").alias("w"), *order).cast("struct<w:double,stage:int,ordinal:bigint,kind:int,type:string>")
    one = rank(F.col("weight"), "stage", "ordinal", "kind", "type")
    other = reduce(DataFrame.unionByName, parts).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.min(F.when(F.col("src") <= F.col("dst"), one)).alias("there"), F.min(F.when(F.col("src") > F.col("dst"), one)).alias("back")
    )
    tags = tag_pairs(known.select("id", _tags(known).alias("tags")).where(F.size("tags") > 0), config.tag_overlap_weight, 0.15, 20)
    met = other.join(tags, ["a", "b"], "full_outer").join(named("a"), "a").join(named("b"), "b")
    overlap = lambda s: F.when(F.col("weight").isNotNull(), rank(F.col("weight"), F.lit(1), s, F.lit(0), F.lit("tag_overlap")))
    way = lambda src, dst, best, s: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.least(best, overlap(F.col(s))).alias("e"))
    edges = met.select(F.explode(F.array(way("pa", "pb", "there", "a"), way("pb", "pa", "back", "b"))).alias("x")).where("x.e is not null")
    return edges.select("x.src", "x.dst", "x.e.type", (-F.col("x.e.w")).alias("weight")), broken.join(named("src"), "src").select(F.col("psrc").alias("src"), "target")


def stored_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, broken) of a stored edge table: one edge per pair of known nodes, and distinct broken links."""
    known = nodes.select("path")
    real = edges.where(~F.col("dst").startswith(BROKEN)).join(known.withColumnRenamed("path", "src"), "src", "left_semi").join(known.withColumnRenamed("path", "dst"), "dst", "left_semi")
    broken = edges.where(F.col("dst").startswith(BROKEN)).select("src", F.substring("dst", len(BROKEN) + 1, 10_000_000).alias("target")).distinct()
    return resolve_conflicts(real, ["recorded_at", "type"]), broken
