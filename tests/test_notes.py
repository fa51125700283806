from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lattica.config import Config, load_config, parse_config
from lattica.functions import parse, text
from lattica.operators import incremental, similarity
from lattica.sources.vault import keep_files, read_vault
from lattica.streaming.watch import debounce, watch

NOTE = """---
title: ignored
type: concept
updated: 2026-04-25
tags: [alpha, "beta gamma", null]
aliases: ["Nick"]
related_to: ["[[Other|o]]", Plain]
count: 3
---
# [[Big]] | Title

See [[One|x]], [[Two#h]] and [[#Only]] #inline #täg/sub.
![[pic.png]] ![[Three]] [[Three]]
```
[[df[c]]]
[[code]]
```
`[[ticks]]` [[call(x)]] [[Page Name]] [[a.js]]
## Second
"""


def _parse(spark, rows):
    return {r["path"]: r for r in parse.parse_notes(spark.createDataFrame(rows, "path string, content binary, title int"), Config()).collect()}


def test_parse_notes(spark):
    got = _parse(spark, [("a/b.md", bytearray(NOTE.encode()), 1), ("bad.md", bytearray(b"---\na: [1\n---\n[[x]] #t body"), 1), ("none.md", None, 1), ("plain.md", bytearray("one two\r\nthree".encode()), 1), ("e.md", bytearray(b""), 1)])
    n = got["a/b.md"]
    assert (n["title"], n["type"], n["subtype"], n["updated"]) == ("Big", "concept", "", "2026-04-25")
    assert n["headings"] == ["Big | Title", "Second"] and n["wikilinks"] == ["Big", "One", "Two", ""] and n["embeds"] == ["pic.png", "Three"]
    assert n["tags"] == ["alpha", "beta gamma", "inline", "täg/sub"] or n["tags"] == ["alpha", "beta gamma", "inline"]
    assert n["related_to"] == ["Other", "Plain"] and n["aliases"] == ["Nick"] and n["frontmatter"]["count"] == "3" and len(n["content_hash"]) == 16
    b = got["bad.md"]
    assert b["parse_error"] and b["title"] == "bad" and b["wikilinks"] == [] and b["tags"] == [] and b["word_count"] == 7
    assert got["none.md"]["parse_error"] and got["plain.md"]["word_count"] == 3 and got["plain.md"]["type"] == "note" and got["e.md"]["title"] == "e"


def test_chunks(spark):
    cases = ["", "x" * 100, "x" * 1600, "y" * 1601, "z" * 1700, "".join(chr(97 + i % 26) for i in range(9000))]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select(text.chunk_text(F.col("t")).alias("c"))
    for c, r in zip(cases, df.collect()):
        joined = r["c"][0] + "".join(p[200:] for p in r["c"][1:])
        assert joined == c and all(len(p) <= 1600 for p in r["c"]) and all(a[-200:] == b[:200] for a, b in zip(r["c"], r["c"][1:]))


def test_vault_files(spark, tmp_path):
    for name in ("a.md", "Sub Dir/b.MD", ".obsidian/c.md", "x/Templates/d.md", "e.excalidraw.md", "f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# x")
    assert sorted(r["path"] for r in read_vault(spark, str(tmp_path)).collect()) == ["Sub Dir/b.MD", "a.md"]
    assert keep_files(spark.createDataFrame([], "path string")).count() == 0


def test_config(tmp_path):
    (tmp_path / "lattica.toml").write_text('[graph]\ndefault_depth = 4\nunknown = 1\n[vault]\nexclude_dirs = ["q"]\n[other]\nx = 1\n')
    (tmp_path / "deep" / "er").mkdir(parents=True)
    c = load_config(str(tmp_path / "deep" / "er"))
    assert c.graph.default_depth == 4 and c.vault.exclude_dirs == ("q",) and c.graph.embed_weight == 1.5
    assert parse_config("") == Config()


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x")], "path string, content_hash string, title string")
    new = spark.createDataFrame([("a", "1", "y"), ("b", "9", "y"), ("d", "4", "y")], "path string, content_hash string, title string")
    merged, diff = incremental.update_graph(old, new)
    assert {tuple(r) for r in diff.collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "deleted"), ("d", "added")}
    assert {(r["path"], r["title"]) for r in merged.collect()} == {("a", "x"), ("b", "y"), ("d", "y")}
    assert tuple(incremental.update_counts(diff).first()) == (1, 1, 1, 1)


def test_embedding_and_vector_search(spark):
    notes = spark.createDataFrame([("a", "A", [], "red green " * 400), ("b", "B", ["h"], ""), ("c", "C", [], "x")], "path string, title string, headings array<string>, body string")
    done = spark.createDataFrame([("c",)], "note_path string")
    e = similarity.HashingEmbedder(16)
    rows = similarity.embed_notes(notes, done, e).collect()
    assert sorted((r["note_path"], r["chunk_no"]) for r in rows) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert similarity.embed_notes(notes, done, e, force=True).count() == 5
    keys = [(f"{r['note_path']}::{r['chunk_no']}", r["embedding"]) for r in rows] + [("old", e.embed_batch(["red green"])[0]), ("zero", [0.0] * 16), (None, [1.0] * 16)]
    chunks = similarity.usable_chunks(spark.createDataFrame(keys, "path string, embedding array<float>"), 16)
    hits = similarity.semantic_search(chunks, e.embed_batch(["red green"])[0], notes, 2).collect()
    assert hits[0]["distance"] == 0.0 and hits[0]["match"] == "strong" and {h["path"] for h in hits[:2]} == {"a", "old"}
    assert [h["path"] for h in similarity.semantic_search(chunks, [1.0] * 16, notes, 5, "o").collect()] == ["old"]
    assert {(r["src"], r["dst"]) for r in similarity.semantic_edges(chunks, spark.createDataFrame([("a",), ("old",)], "path string"), 0.9).collect()} == {("a", "old"), ("old", "a")}


def test_debounce_batch_and_stream(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [(t, "a.md"), (t + timedelta(seconds=1), "b.md"), (t + timedelta(seconds=9), "a.md")]
    df = spark.createDataFrame(rows, "ts timestamp, path string")
    assert sorted((r["events"], r["paths"]) for r in debounce(df).collect()) == [(1, ["a.md"]), (2, ["a.md", "b.md"])]
    seen = []
    source = tmp_path / "log"
    df.coalesce(1).write.json(str(source))
    spark.createDataFrame([(t + timedelta(minutes=5), "late.md")], df.schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = watch(stream, lambda paths, _: seen.extend(sorted(r[0] for r in paths.collect())), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {"a.md", "b.md"} <= set(seen) and "late.md" not in seen
