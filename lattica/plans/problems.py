"""Queries of the general training-data problems (1, 4 and 6)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import changes, references, times
from lattica.session import materialize, shared_dir
from lattica.sources.tables import current_nodes, successful_runs, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_links(
        table(spark, d, "parsed_notes", ["path", "title", "aliases", "wikilinks", "related_to", "scanned_at"]),
        table(spark, d, "nodes", ["path", "saved_at"]),
        table(spark, d, "edges", ["src", "dst", "recorded_at"]),
        table(spark, d, "deletions"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """References that led nowhere when they were recorded, one row per source, target and month."""
    return _orphans(spark, d).select("field", "src", "target", references.utc_month(F.col("at")).alias("period")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per field and month."""
    return references.orphan_counts(_orphans(spark, d))


def _state_store(spark: SparkSession, d: str) -> changes.StateStore:
    """The store of a set of tables: its folder is named by what the tables are, so that each run over them finds the last one's state."""
    return changes.StateStore(spark, f"{shared_dir(spark)}/state/{hashlib.sha256(d.encode()).hexdigest()[:16]}")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths that the next run has to process.

    The state that the successful runs left is brought into the store, as a new version if it differs from the last one;
    the scan is compared with the published version.
    """
    rows = current_nodes(table(spark, d, "nodes", ["path", "content_hash", "run_id", "saved_at"]), successful_runs(spark, d))
    stored = changes.stored_state(rows, table(spark, d, "deletions"))
    store = _state_store(spark, d)
    version = store.version()
    if version is None:
        store.publish(stored, after=version)
    else:
        stored = materialize(stored, "stored")
        if not changes.diff(stored, store.read(version)).isEmpty():
            store.publish(stored, after=version)
    scan = changes.latest_hashes(table(spark, d, "vault_files", ["path", "content_hash", "observed_at"]), "path", "content_hash", "observed_at")
    return changes.diff(scan, store.read()).select(F.col("key").alias("path"), "change")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One UTC instant per distinct record whose string names a full date."""
    vaults = table(spark, d, "vaults", ["vault", "time_zone", "date_order"])
    parts = [
        table(spark, d, t, ["path", c, "run_id"]).select(F.lit(t).alias("tbl"), "path", "run_id", F.col(c).alias("text"))
        for t, c in (("nodes", "updated"), ("drift_results", "last_updated"))
    ]
    rows = parts[0].unionByName(parts[1]).where("text is not null").distinct()
    return times.normalize_times(rows, "text", vaults).select("tbl", "path", "run_id", "utc_us").distinct()


_P1_REFS = """
WITH scans AS (SELECT DISTINCT path, scanned_at s, title, aliases FROM parsed_notes WHERE path IS NOT NULL AND scanned_at IS NOT NULL),
     stems AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') stem FROM scans),
     names AS (SELECT path, s, 'name' t, lower(title) k FROM stems UNION SELECT path, s, 'name', lower(stem) FROM stems
               UNION SELECT path, s, 'name', lower(unnest(aliases)) FROM stems UNION SELECT path, s, 'stem', lower(stem) FROM stems
               UNION SELECT path, s, 'path', lower(path) FROM stems UNION SELECT path, saved_at, 'node', path FROM nodes WHERE path IS NOT NULL),
     alive AS (SELECT t, k, s, (SELECT min(deleted_at) FROM deletions x WHERE x.path = n.path AND x.deleted_at > n.s) u FROM names n),
     links AS (SELECT 'wikilinks' field, path src, unnest(wikilinks) target, scanned_at tm FROM parsed_notes
               UNION SELECT 'related_to', path, unnest(related_to), scanned_at FROM parsed_notes),
     keys AS (SELECT *, 'name' t, lower(target) k FROM links
              UNION SELECT *, 'path', lower(target) FROM links WHERE contains(target, '/')
              UNION SELECT *, 'path', lower(target) || '.md' FROM links WHERE contains(target, '/')
              UNION SELECT *, 'path', regexp_replace(lower(target), '\\.md$', '') FROM links WHERE contains(target, '/')
              UNION SELECT *, 'stem', regexp_replace(regexp_extract(lower(target), '[^/]*$'), '\\.md$', '') FROM links WHERE contains(target, '/')
              UNION SELECT 'dst', src, dst, recorded_at, 'node', dst FROM edges),
     refs AS (SELECT DISTINCT field, src, target, tm FROM keys WHERE tm IS NOT NULL AND regexp_replace(target, '\\s', '', 'g') <> ''),
     served AS (SELECT DISTINCT c.field, c.src, c.target, c.tm FROM keys c JOIN alive a ON a.t = c.t AND a.k = c.k AND a.s <= c.tm AND (a.u IS NULL OR a.u > c.tm)),
     lost AS (SELECT * FROM refs EXCEPT SELECT * FROM served)
"""
_MONTH = "strftime(tm AT TIME ZONE 'UTC', '%Y-%m')"

# The formats of the tables by pattern, zones by DuckDB's own time zone data: it moves skipped times forward, and takes the second of two equal times.
_P6_SQL = """
WITH r AS (SELECT 'nodes' tbl, path, run_id, updated x FROM nodes UNION SELECT 'drift_results', path, run_id, last_updated FROM drift_results),
     t AS (SELECT tbl, path, run_id, time_zone tz, date_order, trim(x, ' "' || chr(39)) s FROM r LEFT JOIN vaults ON vault = split_part(path, '/', 1) WHERE x IS NOT NULL),
     c AS (SELECT *, regexp_extract(s, '^(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})(?:[T ,]|$)', ['y', 'm', 'd']) iso, regexp_extract(s, '^(\\d{4})(\\d{2})(\\d{2})(?:T(\\d{2})(\\d{2})(\\d{2})|$)', ['y', 'm', 'd', 'h', 'i', 's']) joined,
                  regexp_extract(s, '^(\\d{4})-W(\\d{2})-(\\d)$', ['y', 'w', 'd']) wk, regexp_extract(s, '^(\\d{1,2})([/.-])(\\d{1,2})[/.-](\\d{4})(?:[T ,]|$)', ['a', 'sep', 'b', 'y']) num,
                  regexp_extract(s, '^(?:[A-Za-z]+, )?(\\d{1,2})\\.? (?:de )?(\\p{L}+)\\.? (?:de )?(\\d{4})(?:[T ,]|$)', ['d', 'm', 'y']) dmy, regexp_extract(s, '^(\\p{L}+) (\\d{1,2}), (\\d{4})(?:[T ,]|$)', ['m', 'd', 'y']) mdy,
                  regexp_extract(s, '(?:^|[T ])(\\d{1,2}):(\\d{2})(?::(\\d{2}))?(?:\\.(\\d+))?', ['h', 'i', 's', 'f']) clock, lower(regexp_extract(s, ':\\d{2} ?([AaPp][Mm])$', 1)) half,
                  regexp_extract(s, '(?::\\d{2}(?:\\.\\d+)?|T\\d{6}) ?(Z|[+-]\\d{2}(?::?\\d{2})?)(?:\\[[^\\]]*\\])?$', 1) off, regexp_extract(s, ' ([A-Z][A-Za-z]+/[A-Za-z_]+)$', 1) region, regexp_extract(s, ':\\d{2} ([A-Z]{3,4})$', 1) abbr FROM t),
     n AS (SELECT *, lower(CASE WHEN dmy.y <> '' THEN dmy.m ELSE mdy.m END) name FROM c),
     k AS (SELECT *, CASE WHEN name LIKE 'juin%' OR name LIKE 'jun%' THEN 6 WHEN name LIKE 'jui%' OR name LIKE 'jul%' THEN 7 ELSE CASE left(name, 3) WHEN 'jan' THEN 1 WHEN 'ene' THEN 1 WHEN 'feb' THEN 2 WHEN 'fév' THEN 2
                  WHEN 'mar' THEN 3 WHEN 'mär' THEN 3 WHEN 'apr' THEN 4 WHEN 'avr' THEN 4 WHEN 'abr' THEN 4 WHEN 'may' THEN 5 WHEN 'mai' THEN 5 WHEN 'aug' THEN 8 WHEN 'aoû' THEN 8 WHEN 'ago' THEN 8 WHEN 'sep' THEN 9
                  WHEN 'oct' THEN 10 WHEN 'okt' THEN 10 WHEN 'nov' THEN 11 WHEN 'dec' THEN 12 WHEN 'dez' THEN 12 WHEN 'dic' THEN 12 WHEN 'déc' THEN 12 END END mon FROM n),
     e AS (SELECT *, CASE WHEN iso.y <> '' THEN try_cast(concat_ws('-', iso.y, iso.m, iso.d) AS DATE) WHEN joined.y <> '' THEN try_cast(concat_ws('-', joined.y, joined.m, joined.d) AS DATE)
                  WHEN wk.y <> '' THEN try_strptime(concat_ws('-', wk.y, wk.w, wk.d), '%G-%V-%u')::DATE
                  WHEN num.y <> '' AND date_order = 'mdy' AND num.sep <> '.' THEN try_cast(concat_ws('-', num.y, num.a, num.b) AS DATE) WHEN num.y <> '' THEN try_cast(concat_ws('-', num.y, num.b, num.a) AS DATE)
                  WHEN dmy.y <> '' THEN try_cast(concat_ws('-', dmy.y, mon, dmy.d) AS DATE) WHEN mdy.y <> '' THEN try_cast(concat_ws('-', mdy.y, mon, mdy.d) AS DATE) END dt,
                  CASE WHEN joined.h <> '' THEN try_cast(joined.h AS INT) ELSE coalesce(try_cast(clock.h AS INT), 0) % CASE WHEN half = '' THEN 24 ELSE 12 END + CASE half WHEN 'pm' THEN 12 ELSE 0 END END h,
                  coalesce(try_cast(CASE WHEN joined.h <> '' THEN joined.i ELSE clock.i END AS INT), 0) i, coalesce(try_cast(CASE WHEN joined.h <> '' THEN joined.s ELSE clock.s END AS INT), 0) sec,
                  coalesce(try_cast(rpad(clock.f, 6, '0') AS INT), 0) f FROM k),
     l AS (SELECT *, dt::TIMESTAMP + to_microseconds(((h * 60 + i) * 60 + sec) * 1000000::BIGINT + f) loc, replace(off, ':', '') o, CASE WHEN region <> '' THEN region ELSE tz END zn,
                  CASE abbr WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'BST' THEN 60 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'IST' THEN 330 WHEN 'JST' THEN 540 WHEN 'AEST' THEN 600 WHEN 'AEDT' THEN 660 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240
                  WHEN 'CST' THEN -360 WHEN 'CDT' THEN -300 WHEN 'MST' THEN -420 WHEN 'MDT' THEN -360 WHEN 'PST' THEN -480 WHEN 'PDT' THEN -420 END mins FROM e),
     u AS (SELECT *, timezone(zn, loc) z FROM l)
SELECT DISTINCT tbl, path, run_id, CASE WHEN regexp_full_match(s, '\\d{10}|\\d{13}|\\d{16}') THEN try_cast(s || repeat('0', 16 - length(s)) AS BIGINT) WHEN o = 'Z' THEN epoch_us(loc)
       WHEN o <> '' THEN epoch_us(loc) - try_cast(o[1] || '1' AS INT) * (try_cast(o[2:3] AS INT) * 60 + CASE WHEN length(o) > 3 THEN try_cast(o[4:5] AS INT) ELSE 0 END) * 60000000::BIGINT WHEN mins IS NOT NULL THEN epoch_us(loc) - mins * 60000000::BIGINT
       WHEN timezone(zn, z - INTERVAL 1 HOUR) = loc THEN epoch_us(z) - 3600000000 ELSE epoch_us(z) END utc_us
FROM u WHERE dt IS NOT NULL OR regexp_full_match(s, '\\d{10}|\\d{13}|\\d{16}')"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p4_found": p4_found, "p6_found": p6_found}

SQL = {
    "p6_found": _P6_SQL,
    "p1_found": _P1_REFS + f"SELECT DISTINCT field, src, target, {_MONTH} period FROM lost",
    "p1_report": _P1_REFS + f'SELECT field, {_MONTH} period, count(*) "references", count(DISTINCT target) targets FROM lost GROUP BY 1, 2',
    "p4_found": """
WITH cur AS (SELECT path, content_hash h, saved_at FROM nodes n WHERE run_id IN (SELECT run_id FROM sync_runs WHERE status = 'success') AND path IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC, saved_at DESC) = 1),
     st AS (SELECT path, regexp_replace(lower(h), '^0+', '') h FROM cur WHERE NOT EXISTS (SELECT 1 FROM deletions x WHERE x.path = cur.path AND x.deleted_at > cur.saved_at)),
     sc AS (SELECT path, regexp_replace(lower(content_hash), '^0+', '') h FROM vault_files WHERE path IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY path ORDER BY observed_at DESC, regexp_replace(lower(content_hash), '^0+', '') DESC) = 1)
SELECT coalesce(sc.path, st.path) path, CASE WHEN st.path IS NULL THEN 'added' WHEN sc.path IS NULL THEN 'deleted' ELSE 'updated' END change
FROM sc FULL JOIN st ON sc.path = st.path WHERE sc.path IS NULL OR st.path IS NULL OR sc.h IS DISTINCT FROM st.h""",
}
