import random
from datetime import datetime, timedelta

from lattica.operators import references as R

T0 = datetime(2025, 1, 1)
DAY = timedelta(days=1)


def _spans(spark, rows, gone, **kw):
    r = spark.createDataFrame(rows, "path string, at timestamp, _salt string, until string")
    g = spark.createDataFrame(gone, "path string, deleted_at timestamp")
    return {(x["path"], x["at"], x["_salt"]): x["until"] for x in R.alive_spans(r, g, **kw).collect()}


def test_alive_spans_next_deletion_and_clashing_columns(spark):
    rows = [("a", T0, "x", "y"), ("a", T0 + 5 * DAY, "x", None), ("b", T0, None, None), (None, T0, "x", "y"), ("c", None, "x", "y")]
    gone = [("a", T0), ("a", T0 + 2 * DAY), ("a", T0 + 2 * DAY), (None, T0), ("a", None), ("z", T0)]
    want = {("a", T0, "x"): T0 + 2 * DAY, ("a", T0 + 5 * DAY, "x"): None, ("b", T0, None): None}
    assert _spans(spark, rows, gone) == want
    assert _spans(spark, rows, gone, hot_rows=1) == want


def _tables(spark, notes, nodes, edges, gone):
    return (
        spark.createDataFrame(notes, "path string, title string, aliases array<string>, wikilinks array<string>, related_to array<string>, scanned_at timestamp, key string, tbl int"),
        spark.createDataFrame(nodes, "path string, saved_at timestamp, ref string"),
        spark.createDataFrame(edges, "src string, dst string, recorded_at timestamp, _k string"),
        spark.createDataFrame(gone, "path string, deleted_at timestamp"),
    )


def _alive(path, s, t, gone):
    return s <= t and not any(p == path and s < d <= t for p, d in gone if p and d)


def _brute(notes, nodes, edges, gone):
    out = set()
    for n in notes:
        for field, targets in (("wikilinks", n[3]), ("related_to", n[4])):
            for name in targets or []:
                if name is None or not name.strip() or n[5] is None:
                    continue
                low, found = name.lower(), False
                for m in notes:
                    if m[0] is None or m[5] is None or not _alive(m[0], m[5], n[5], gone):
                        continue
                    stem = m[0].rsplit("/", 1)[-1].removesuffix(".md").lower()
                    names = {(m[1] or "").lower(), stem, *[(a or "").lower() for a in m[2] or []]}
                    found |= low in names
                    if "/" in low:
                        found |= m[0].lower() in (low, low + ".md", low.removesuffix(".md")) or stem == low.rsplit("/", 1)[-1].removesuffix(".md")
                if not found:
                    out.add((field, n[0], name, n[5]))
    for src, dst, t, _ in edges:
        if dst and dst.strip() and t and not any(p == dst and s and _alive(p, s, t, gone) for p, s, _ in nodes):
            out.add(("dst", src, dst, t))
    return out


def test_orphans_match_brute_force(spark):
    r = random.Random(5)
    paths = [f"v/{c}/{n}.md" for c in "ab" for n in ("One", "two", "Three x")]
    names = ["One", "ONE", "two", "three X", "Nick", "title 1", "Title 2", "v/a/One", "v/a/two.md", "q/Three x", "gone", "", "  ", None]
    when = lambda: T0 + r.randrange(40) * DAY
    notes = [(r.choice(paths), r.choice(["Title 1", "Title 2", None, ""]), r.choice([["Nick"], [], None, [None]]), r.choices(names, k=3) if r.random() < 0.9 else None, r.choices(names, k=1), when(), "k", 1) for _ in range(60)]
    notes += notes[:3] + [(None, "t", None, ["gone"], None, T0, None, None), ("v/a/One.md", "t", None, ["gone"], None, None, None, None)]
    nodes = [(r.choice(paths), when(), "x") for _ in range(20)] + [(None, T0, None), ("v/a/One.md", None, None)]
    edges = [(r.choice(paths), r.choice([*paths, "__broken__:x", "", None]), when(), "z") for _ in range(80)] + [("s", "nowhere", None, None)]
    gone = [(r.choice(paths), when()) for _ in range(15)] + [(None, T0), ("v/a/One.md", None)]
    want = _brute(notes, nodes, edges, gone)
    for hot in (50_000, 3):
        got = {tuple(x) for x in R.orphan_links(*_tables(spark, notes, nodes, edges, gone), hot_rows=hot).collect()}
        assert got == want and want


def test_orphans_of_empty_tables(spark):
    assert R.orphan_links(*_tables(spark, [], [], [], [])).collect() == []
    only = R.orphan_links(*_tables(spark, [], [], [("a", "b", T0, None)], []))
    assert [tuple(x) for x in only.collect()] == [("dst", "a", "b", T0)]


def test_orphan_counts(spark):
    df = spark.createDataFrame([("dst", "a", "x", T0), ("dst", "b", "x", T0 + DAY), ("dst", "a", "y", T0 + 40 * DAY)], "field string, src string, target string, at timestamp")
    assert sorted(map(tuple, R.orphan_counts(df).collect())) == [("dst", "2025-01", 2, 1), ("dst", "2025-02", 1, 1)]


def test_months_are_utc_in_any_session(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.timestamp_seconds(F.lit(1738367999)).alias("at"))  # 2025-01-31T23:59:59Z
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert df.select(R.utc_month(F.col("at"))).first()[0] == "2025-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
