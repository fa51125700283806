"""All similar pairs between set-valued records.

Extended-prefix join. Two sets with Jaccard overlap t share at least ceil(t / (1 + t) * (a + b)) items, so with
items in one global order (rare first) they share at least L items within their first size - overlap + L
ones. L is chosen for each band of sizes by counting what each choice would cost over all records; records are
joined on combinations of L prefix items, and candidates verified by their exact overlap.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize

#: Prefix extensions that are considered.
MAX_SHARED = 3
#: A longer prefix is considered for a band while its keys are at most this many times the shortest prefix's.
KEY_GROWTH = 6
#: Items that fill more than 1/FREQUENT of all positions count as frequent (so at most FREQUENT items do).
FREQUENT = 10_000


def size_bands(largest: int, threshold: float) -> list[tuple[int, int]]:
    """Bands (low, high) of set sizes: single sizes at first, then widening in proportion."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * (1 + (1 / threshold - 1) / 4)))
        out.append((low, high))
        low = high + 1
    return out


def _needed(size: Column, low: Column, threshold: float) -> Column:
    both = F.ceil(F.lit(threshold / (1 + threshold)) * (size + low) - 1e-9)
    return F.greatest(both, F.ceil(size * threshold - 1e-9)).cast("int")


def _combinations(prefix: Column, n: int) -> Column:
    """Hashes of all combinations of ``n`` items of an array, in its order."""
    if n == 1:
        return F.transform(prefix, lambda x: F.xxhash64(x))
    if n == 2:
        return F.flatten(F.transform(prefix, lambda x, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda y: F.xxhash64(x, y))))
    return F.flatten(F.flatten(F.transform(prefix, lambda x, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda y, j: F.transform(F.slice(prefix, i + j + 3, F.size(prefix)), lambda z: F.xxhash64(x, y, z))))))


def normalize_set(items: Column) -> Column:
    """Trimmed, lower-cased items without leading '#', without nulls, empty items and repeats, sorted."""
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"^[\s#]+", ""), r"\s+$", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def set_classes(records: DataFrame, key: str, items: str, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Groups exact copies: (set_id, items) of distinct sets and (set_id, key) of their members.

    Items are taken as they are, without nulls and repeats. Null or too small sets and null keys are left out.
    """
    sets = records.select(key, F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("_items")).where(F.col(key).isNotNull() & (F.size("_items") >= max(1, min_size)))
    parts = F.transform("_items", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))
    tagged = sets.withColumn("set_id", F.unhex(F.md5(F.array_join(parts, "|"))))
    return tagged.groupBy("set_id").agg(F.first("_items").alias("items")), tagged.select("set_id", key).distinct()


def _ordered(sets: DataFrame) -> DataFrame:
    """(set_id, size, tokens): items as hashes in the global order by exact frequency, rare ones first.

    Counts of frequent items, of which there are at most ``FREQUENT``, are broadcast; those of the rest are joined by item, where
    no key is hot.
    """
    long = sets.select("set_id", F.size("items").alias("size"), F.explode("items").alias("item"))
    counts = materialize(long.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = sets.agg(F.sum(F.size("items"))).first()[0] or 0
    often = F.col("n") > max(1, total // FREQUENT)
    seen = long.join(F.broadcast(counts.where(often)), "item", "left")
    rest = seen.where("n is null").drop("n").join(counts.where(~often), "item")
    every = seen.where("n is not null").unionByName(rest)
    ranked = every.select("set_id", "size", F.struct("n", F.xxhash64("item").alias("h")).alias("t"))
    return ranked.groupBy("set_id", "size").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["h"]).alias("tokens"))


def similar_sets(sets: DataFrame, threshold: float, max_shared: int = MAX_SHARED) -> DataFrame:
    """(set_a, set_b, overlap, jaccard) of all pairs of distinct ``sets(set_id, items)`` with Jaccard >= threshold.

    set_a < set_b. Empty input gives no rows. Nothing is capped: a key that very many sets share is made rarer
    by the longer prefixes, and what is left is split by the adaptive skew join.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    out_schema = "set_a binary, set_b binary, overlap int, jaccard double"
    spark = sets.sparkSession
    sets = materialize(sets, "sets")
    ordered = materialize(_ordered(sets), "ordered")
    largest = ordered.agg(F.max("size")).first()[0]
    if largest is None:
        return spark.createDataFrame([], out_schema)

    # bands grow geometrically, so their number is logarithmic in the largest size
    bands = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(size_bands(largest, threshold))], "band int, lo int, hi int")
    fits = (F.col("hi") >= F.col("size") * threshold - 1e-9) & (F.col("lo") <= F.col("size"))
    placed = ordered.join(F.broadcast(bands), fits).select(
        "set_id", "size", "tokens", "band", (F.col("size") <= F.col("hi")).alias("small"), (F.col("size") - _needed(F.col("size"), F.col("lo"), threshold)).alias("slack")
    ).where("slack >= 0")

    def count_keys(n: int) -> Column:
        p = F.least(F.col("slack") + n, F.col("size")).cast("double")
        ways = reduce(lambda acc, i: acc * (p - i) / (i + 1), range(n), F.lit(1.0))
        return F.greatest(ways, F.lit(0.0))

    # an overlap of at least `need` items leaves no room for a longer shared prefix than that
    need = F.col("size") - F.col("slack")
    sums = placed.groupBy("band").agg(F.min(need).alias("need"), *[F.sum(count_keys(n)).alias(f"k{n}") for n in range(1, max_shared + 1)]).collect()
    allowed = {r["band"]: [n for n in range(1, max_shared + 1) if n <= r["need"] and r[f"k{n}"] <= KEY_GROWTH * r["k1"]] or [1] for r in sums}

    def keyed(n: int, chosen: list[int]) -> DataFrame:
        prefix = F.slice("tokens", 1, F.least(F.col("slack") + n, F.col("size")))
        rows = placed.where(F.col("band").isin(chosen)) if chosen else placed.where("false")
        return rows.select("set_id", "size", "band", "small", F.explode(_combinations(prefix, n)).alias("key"))

    # what each choice would cost, all in one pass
    costs: dict[int, dict[int, float]] = {}
    open_ = {n: [b for b, ns in allowed.items() if n in ns and len(ns) > 1] for n in range(1, max_shared + 1)}
    if any(open_.values()):
        tried = reduce(DataFrame.unionByName, [keyed(n, bands_).withColumn("n", F.lit(n)) for n, bands_ in open_.items() if bands_])
        per_key = tried.groupBy("n", "band", "key").agg(F.sum(F.col("small").cast("long")).alias("s"), F.count(F.lit(1)).alias("a"))
        for r in per_key.groupBy("n", "band").agg(F.sum("a").alias("keys"), F.sum((F.col("s") * F.col("a")).cast("double")).alias("pairs")).collect():
            costs.setdefault(r["band"], {})[r["n"]] = r["keys"] + r["pairs"]
    choice = {b: min(costs[b], key=lambda n: (costs[b][n], n)) if b in costs else ns[0] for b, ns in allowed.items()}

    keys = reduce(DataFrame.unionByName, [keyed(n, [b for b, c in choice.items() if c == n]) for n in sorted(set(choice.values()))])
    small = keys.where("small").select("band", "key", F.col("set_id").alias("a"), F.col("size").alias("sa"))
    every = keys.select("band", "key", F.col("set_id").alias("b"), F.col("size").alias("sb"), F.col("small").alias("bs"))
    # a pair belongs to the band of its smaller set; two sets of one band meet once
    once = F.when(F.col("bs"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    lengths = F.least("sa", "sb") >= F.greatest("sa", "sb") * threshold - 1e-9
    pairs = small.join(every, ["band", "key"]).where(once & lengths).select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b")).distinct()
    items = lambda side: sets.select(F.col("set_id").alias(f"set_{side}"), F.col("items").alias(f"_{side}"))
    both = pairs.join(items("a"), "set_a").join(items("b"), "set_b").withColumn("overlap", F.size(F.array_intersect("_a", "_b")))
    scored = both.withColumn("jaccard", F.col("overlap") / (F.size("_a") + F.size("_b") - F.col("overlap")))
    return scored.where(F.col("jaccard") >= threshold - 1e-12).select("set_a", "set_b", "overlap", "jaccard")


def similar_records(records: DataFrame, key: str, items: str, threshold: float, min_size: int = 1) -> DataFrame:
    """(key_a, key_b) of all pairs of records with similar sets, copies of one set included.

    Pairs of copies grow with the square of a group of copies; :func:`set_classes` with :func:`similar_sets` gives
    the compact form of classes, membership and pairs of classes.
    """
    sets, members = set_classes(records, key, items, min_size)
    members = materialize(members, "members")
    pairs = similar_sets(sets, threshold).select("set_a", "set_b")
    a, b = members.select(F.col("set_id").alias("set_a"), F.col(key).alias("_a")), members.select(F.col("set_id").alias("set_b"), F.col(key).alias("_b"))
    across = pairs.join(a, "set_a").join(b, "set_b").select("_a", "_b")
    within = a.join(b, F.col("set_a") == F.col("set_b")).where("_a < _b").select("_a", "_b")
    return across.unionByName(within).select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b"))


def record_links(records: DataFrame, key: str, items: str, threshold: float, min_size: int = 1) -> DataFrame:
    """(key, class_key, copies, links): one row for each record with a large enough set.

    class_key is the lowest key with the same set, copies the number of such records, links that of distinct other sets that are
    similar. Copies are not paired, so the result grows with the records and not with the square of a class.
    """
    sets, members = set_classes(records, key, items, min_size)
    members = materialize(members, "members")
    pairs = similar_sets(sets, threshold)
    links = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("links"))
    about = members.groupBy("set_id").agg(F.min(key).alias("class_key"), F.count(F.lit(1)).alias("copies")).join(links, "set_id", "left")
    return members.join(about, "set_id").select(key, "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links"))
