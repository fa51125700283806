"""References to records that do not exist when they are recorded.

Parents and children are brought to one long form ``(tbl, key, at, ...)`` with a flag, grouped by parent
table and key, and a reference whose group shows no living parent at its time is an orphan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import hot_keys, salt_points, salt_states

#: A key with more references than this is split over several tasks.
HOT_ROWS = 50_000


def alive_spans(rows: DataFrame, deletions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``until`` to ``rows(path, at, ...)``: the first ``deleted_at`` after ``at``, null if there is none.

    The next deletion is found in one backward pass over the union of both, sorted within each path.
    Rows without path or time are dropped: they can't be alive at any time. Columns of ``deletions``
    other than path and deleted_at are ignored.
    """
    extra = [c for c in rows.columns if c not in ("path", "at", "until")]
    keep = F.struct(*[F.col(c) for c in extra], F.lit(True).alias("_row"))  # extra columns ride along, whatever their names
    live = rows.where("path is not null and at is not null").select("path", "at", keep.alias("_keep"))
    gone = deletions.where("path is not null and deleted_at is not null").select("path", F.col("deleted_at").alias("at")).distinct()
    hot = hot_keys(live, "path", hot_rows)
    points = salt_points(live, "path", hot, ["at"]).withColumn("_gone", F.lit(None).cast("timestamp"))
    states = salt_states(gone.withColumn("_gone", F.col("at")), "path", hot)
    long = points.unionByName(states, allowMissingColumns=True)
    # a deletion at the row's own time is not later than the row: going back in time, rows come first
    w = Window.partitionBy("path", "_salt").orderBy(F.col("at").desc(), F.col("_gone").isNotNull())
    marked = long.withColumn("until", F.min("_gone").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.where(F.col("_gone").isNull()).select("path", "at", *[F.col("_keep")[c].alias(c) for c in extra], "until")


def orphan_references(parents: DataFrame, children: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """References that no parent could serve at their time.

    ``parents``: ``tbl, key, at, until`` (``until`` null: forever; alive for at <= t < until).
    ``children``: ``ref`` (a struct that identifies the reference), ``tbl``, ``key``, ``at``; a reference
    that may mean several keys has a row for each. Result: distinct ``ref, at``.

    Parents are pre-aggregated to the earliest start per key and end. Keys with more than ``hot_rows``
    references are salted: their references are spread by hash, their few parent spans repeated.
    Null keys or times in parents are ignored. A child with a null key but a time is an orphan unless
    another of its rows has a parent; a child without a time is no reference.
    """
    children = children.where("at is not null").withColumn("_k", F.struct("tbl", "key"))
    hot = hot_keys(children, "_k", hot_rows)
    spans = (
        parents.where("key is not null and at is not null")
        .groupBy("tbl", "key", "until").agg(F.min("at").alias("at"))
        .withColumn("_k", F.struct("tbl", "key"))
    )
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp")
    states = salt_states(spans, "_k", hot).select(
        "tbl", "key", "_salt", "at", F.coalesce("until", forever).alias("_until"), F.lit(None).cast(children.schema["ref"].dataType).alias("ref"), F.lit(True).alias("_parent")
    )
    points = salt_points(children, "_k", hot, ["ref", "at"]).select(
        "tbl", "key", "_salt", "at", F.lit(None).cast("timestamp").alias("_until"), "ref", F.lit(False).alias("_parent")
    )
    w = Window.partitionBy("tbl", "key", "_salt").orderBy("at", F.col("_parent").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = states.unionByName(points).withColumn("_open", F.max("_until").over(w))
    alive = F.coalesce(F.col("_open") > F.col("at"), F.lit(False))
    judged = swept.where("not _parent").groupBy("ref", "at").agg(F.max(alive).alias("_served"))
    return judged.where("not _served").select("ref", "at")


def _stem(path):
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)


def name_keys(notes: DataFrame) -> DataFrame:
    """All keys by which a link name may mean a note: (path, at, until, tbl, key)."""
    low = F.lower
    stem = low(_stem(F.col("path")))
    keys = F.array_distinct(
        F.concat(
            F.array(
                F.struct(F.lit("name").alias("tbl"), low("title").alias("key")),
                F.struct(F.lit("name").alias("tbl"), stem.alias("key")),
                F.struct(F.lit("stem").alias("tbl"), stem.alias("key")),
                F.struct(F.lit("path").alias("tbl"), low("path").alias("key")),
            ),
            F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("name").alias("tbl"), low(a).alias("key"))),
        )
    )
    return notes.select("path", "at", "until", F.explode(keys).alias("_key")).select("path", "at", "until", "_key.*")


def link_keys(name):
    """The keys that a link name may mean, as an array of (tbl, key)."""
    low = F.lower(name)
    last = F.regexp_replace(F.regexp_extract(low, r"([^/]*)$", 1), r"\.md$", "")
    key = lambda tbl, k: F.struct(F.lit(tbl).alias("tbl"), k.alias("key"))
    plain = F.array(key("name", low))
    as_path = F.array(key("path", low), key("path", F.concat(low, F.lit(".md"))), key("path", F.regexp_replace(low, r"\.md$", "")), key("stem", last))
    return F.when(F.instr(name, "/") > 0, F.array_distinct(F.concat(plain, as_path))).otherwise(plain)


def orphan_links(parsed_notes: DataFrame, nodes: DataFrame, edges: DataFrame, deletions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Orphans of the three reference fields of a vault: (field, src, target, at).

    Null and blank references are none. Null lists count as empty. Exact duplicates count once.
    """
    scans = parsed_notes.select("path", F.col("scanned_at").alias("at"), "title", "aliases").distinct()
    names = name_keys(alive_spans(scans, deletions, hot_rows)).select("tbl", "key", "at", "until")
    stored = nodes.select("path", F.col("saved_at").alias("at")).distinct()
    paths = alive_spans(stored, deletions, hot_rows).select(F.lit("node").alias("tbl"), F.col("path").alias("key"), "at", "until")

    ref = lambda field, src, target: F.struct(field.alias("field"), src.alias("src"), target.alias("target"))
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(F.col(f)).alias("targets")) for f in ("wikilinks", "related_to")])
    links = (
        parsed_notes.select("path", "scanned_at", F.explode(lists).alias("l"))
        .select("path", "scanned_at", "l.field", F.explode("l.targets").alias("target"))
        .where(F.length(F.trim(F.regexp_replace("target", r"\s+", " "))) > 0)
        .select(ref(F.col("field"), F.col("path"), F.col("target")).alias("ref"), F.explode(link_keys(F.col("target"))).alias("_key"), F.col("scanned_at").alias("at"))
        .select("ref", "_key.tbl", "_key.key", "at")
    )
    dsts = (
        edges.where(F.length(F.trim(F.regexp_replace("dst", r"\s+", " "))) > 0)
        .select(ref(F.lit("dst"), F.col("src"), F.col("dst")).alias("ref"), F.lit("node").alias("tbl"), F.col("dst").alias("key"), F.col("recorded_at").alias("at"))
    )
    found = orphan_references(names.unionByName(paths), links.unionByName(dsts), hot_rows)
    return found.select("ref.field", "ref.src", "ref.target", "at")


def utc_month(at) -> F.Column:
    """yyyy-MM of an instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per referring field and UTC month: rows, and distinct missing targets."""
    return (
        orphans.groupBy("field", utc_month(F.col("at")).alias("period"), "target").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("field", "period").agg(F.sum("n").alias("references"), F.count(F.lit(1)).alias("targets"))
    )
