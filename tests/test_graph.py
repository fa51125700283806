import random

import pytest

from lattica.functions.text import iso_date
from lattica.operators import centrality, communities, graph, insights, sinks, traverse
from lattica.operators.search import keyword_search
from tests.fixture import notes as fixture_notes


@pytest.fixture(scope="module")
def vault(spark):
    notes = fixture_notes(spark).cache()
    edges, broken = graph.build_graph(notes)
    return notes, edges.cache(), broken.cache()


def test_edges_of_the_demo_vault(vault):
    notes, edges, broken = vault
    assert {r["type"]: r["n"] for r in centrality.edge_type_counts(edges).collect()} == {"related_to": 22, "wikilink": 13, "embed": 1, "tag_overlap": 80}
    assert graph.tag_edges(notes).count() == 106
    assert {(r["src"], r["target"]) for r in broken.collect()} == {("broken_links.md", "Nonexistent Note A"), ("broken_links.md", "Ghost Page"), ("entities/Meridian Partners.md", "Orion Advisor Services")}
    real = centrality.graph_stats(notes, edges).first()
    assert (real["node_count"], real["edge_count"], real["density"], real["orphan_count"]) == (18, 116, 0.379085, 1)
    assert centrality.graph_stats(notes, edges, broken).first()["density"] == 0.388889
    assert [r["path"] for r in centrality.orphans(notes, edges).collect()] == ["orphan_note.md"]
    assert [r["title"] for r in insights.broken_links(notes, broken).collect()] == ["Broken Links Note", "Broken Links Note", "Meridian Partners"]


def test_tag_edges_match_brute_force_without_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    often, rare = ["wiki", "daily", "concept", ""], [f"t{i}" for i in range(12)]
    tags = {f"p{i:02d}": r.sample(often, r.randrange(4)) + r.sample(rare, r.choice([0, 0, 1, 3])) + [None] * (i % 2) for i in range(70)}
    notes = spark.createDataFrame([(p, "Home" if p == "p07" else p, t) for p, t in tags.items()], "path string, title string, tags array<string>")
    sets = {p: {x for x in t if x is not None} for p, t in tags.items() if p != "p07"}
    weight = {(a, b): len(x & y) / (len(x) + len(y) - len(x & y)) * 0.5 for a, x in sets.items() for b, y in sets.items() if a != b and x & y}
    weight = {k: w for k, w in weight.items() if w >= 0.15 * 0.5}

    def refuse(*_):
        raise AssertionError("all pairs formed")

    monkeypatch.setattr(graph, "top_pairs", refuse)
    for top in (3, 20):
        kept = {(a, b) for a in sets for _, b in sorted((-round(w, 9), y) for (x, y), w in weight.items() if x == a)[:top]}
        for most in (62, 2, 0):  # tags that may count as frequent
            monkeypatch.setattr(graph, "FREQUENT_TAGS", most)
            got = {(e["src"], e["dst"]): e["weight"] for e in graph.tag_edges(notes, top=top).collect()}
            assert got == {k: weight[k] for k in kept | {(b, a) for a, b in kept}}
    assert graph.tag_edges(notes.limit(0)).count() == 0


def test_build_graph_compares_all_sources_without_all_pairs(spark, monkeypatch):
    rows = [("a/x.md", "X", ["t", "u"], ["Y", "X"], []), ("a/y.md", "Y", ["t", "u"], [], ["X", "Z"]), ("b/z.md", "Z", ["t"], ["Nobody"], []), ("b/w.md", "W", ["t", "u"], [], [])]
    notes = spark.createDataFrame([(p, t, g, [], w, [], r) for p, t, g, w, r in rows], "path string, title string, tags array<string>, aliases array<string>, wikilinks array<string>, embeds array<string>, related_to array<string>")
    semantic = spark.createDataFrame([("a/x.md", "b/w.md", "semantic_similarity", 0.5), ("b/w.md", "a/x.md", "semantic_similarity", 0.75), ("gone.md", "a/x.md", "semantic_similarity", 0.6)], "src string, dst string, type string, weight double")

    def refuse(*_):
        raise AssertionError("all pairs formed")

    monkeypatch.setattr(graph, "top_pairs", refuse)
    edges, broken = graph.build_graph(notes, semantic=semantic, folders=True)
    both = lambda a, b, *e: {(a, b): e, (b, a): e}
    want = {**both("a/x.md", "a/y.md", "related_to", 2.0), **both("a/y.md", "b/z.md", "related_to", 2.0), ("a/x.md", "a/x.md"): ("wikilink", 1.0), **both("a/x.md", "b/z.md", "tag_overlap", 0.25), **both("a/y.md", "b/w.md", "tag_overlap", 0.5)}
    want |= {("a/x.md", "b/w.md"): ("tag_overlap", 0.5), ("b/w.md", "a/x.md"): ("semantic_similarity", 0.75), ("gone.md", "a/x.md"): ("semantic_similarity", 0.6), **both("b/w.md", "b/z.md", "folder_proximity", 0.3)}
    assert {(e["src"], e["dst"]): (e["type"], e["weight"]) for e in edges.collect()} == want
    assert [tuple(x) for x in broken.collect()] == [("b/z.md", "Nobody")]


def test_hubs_of_the_demo_vault(vault):
    notes, edges, _ = vault
    got = {r["title"]: (r["degree"], r["centrality"]) for r in centrality.hubs(notes, edges, 6).collect()}
    assert got == {"Career Positioning": (22, 1.294118), "Data Quality": (22, 1.294118), "Medallion Architecture": (22, 1.294118), "Snowflake Streams and Tasks": (20, 1.176471), "Snowflake": (19, 1.117647), "Databricks": (18, 1.058824)}


def test_blast_radius_of_the_demo_vault(vault):
    notes, edges, _ = vault
    seed = traverse.find_node(notes, "medallion architecture")
    title = {r["path"]: r["title"] for r in notes.collect()}

    def run(depth):
        return {title[r["path"]]: (r["relevance"], r["distance"]) for r in traverse.blast_radius(edges, seed, depth).collect()}

    assert run(1) == {**dict.fromkeys(["Databricks", "Data Quality", "Meridian Partners", "Snowflake", "Snowflake Streams and Tasks"], (2.0, 1)), **dict.fromkeys(["Wikilink Alias Note", "2026-04-29", "Fidelity", "Schwab"], (1.0, 1))}
    six = ["Databricks", "Fidelity", "Meridian Partners", "Nexus Consulting", "Snowflake", "Snowflake Streams and Tasks"]
    assert run(2) == {**dict.fromkeys(six, (4.0, 2)), "Embed Note": (3.0, 2), "Data Quality": (2.0, 1), **dict.fromkeys(["Wikilink Alias Note", "Broken Links Note", "2026-04-29", "Plain Markdown Note", "Schwab"], (2.0, 2))}
    assert run(3) == {**dict.fromkeys([*six, "Data Quality"], (8.0, 3)), "Embed Note": (6.0, 3), **dict.fromkeys(["Wikilink Alias Note", "Broken Links Note", "2026-04-29", "Plain Markdown Note", "Schwab"], (4.0, 3))}
    assert traverse.blast_radius(edges, traverse.find_node(notes, "no such note"), 2).count() == 0


def _random_graph(spark, r, n=14, m=30):
    p = [f"n{i:02d}" for i in range(n)]
    pairs = {(r.choice(p), r.choice(p)) for _ in range(m)}
    rows = [(a, b, r.choice(["wikilink", "related_to", "embed", "tag_overlap"]), r.choice([0.5, 1.0, 1.5, 2.0])) for a, b in sorted(pairs)]
    nodes = spark.createDataFrame([(x, "Home" if i == 0 else x, ["t"], "note") for i, x in enumerate(p)], "path string, title string, tags array<string>, type string")
    return p, rows, nodes, spark.createDataFrame(rows, "src string, dst string, type string, weight double")


def test_walks_and_paths_match_brute_force(spark):
    r = random.Random(8)
    for _ in range(3):
        p, rows, nodes, edges = _random_graph(spark, r)
        steps = [(a, b, w) for a, b, t, w in rows if t != "tag_overlap"] + [(b, a, w) for a, b, t, w in rows if t != "tag_overlap"]
        seed = "n03"
        level, best = {seed: 1.0}, {}
        for d in (1, 2, 3):
            nxt = {}
            for n, v in level.items():
                for a, b, w in steps:
                    if a == n and v * w >= 0.6:
                        nxt[b] = max(nxt.get(b, 0), v * w)
            level = nxt
            for n, v in level.items():
                if n not in best or v > best[n][0]:
                    best[n] = (v, d)
        best.pop(seed, None)
        s = nodes.where(f"path = '{seed}'").select("path")
        assert {x["path"]: (x["relevance"], x["distance"]) for x in traverse.blast_radius(edges, s, 3, 0.6).collect()} == best
        near = {x: {b for a, b, _ in steps if a == x and b != x and "n00" not in (a, b)} for x in p}
        paths, front = {seed: [seed]}, {seed: [seed]}
        while front:
            nxt = {}
            for n, way in front.items():
                for b in near[n]:
                    if b not in paths and (b not in nxt or way + [b] < nxt[b]):
                        nxt[b] = way + [b]
            paths |= nxt
            front = nxt
        for goal in ("n00", "n05", "n07", seed):
            got = [(x["hops"], x["path_nodes"]) for x in traverse.shortest_path(nodes, edges, s, nodes.where(f"path = '{goal}'").select("path")).collect()]
            assert got == ([(len(paths[goal]) - 1, paths[goal])] if goal in paths else [])
        pairs = spark.createDataFrame([(seed, g) for g in p], "a string, b string")
        far = {x["b"]: x["distance"] for x in traverse.distances(traverse.structural_view(nodes, edges), pairs).collect()}
        assert far == {g: len(paths[g]) - 1 if g in paths else 99 for g in p}


def test_long_chains_are_followed(spark):
    p = [f"n{i:03d}" for i in range(103)]
    nodes = spark.createDataFrame([(x, x) for x in p], "path string, title string")
    edges = spark.createDataFrame([(a, b, "wikilink", 1.0) for a, b in zip(p, p[1:])], "src string, dst string, type string, weight double")
    end = lambda x: nodes.where(f"path = '{x}'").select("path")
    assert [(r["hops"], r["path_nodes"]) for r in traverse.shortest_path(nodes, edges, end(p[0]), end(p[52])).collect()] == [(52, p[:53])]
    assert traverse.shortest_path(nodes, edges, end(p[0]), end(p[9]), 4).count() == 0
    pairs = spark.createDataFrame([(p[0], p[102]), (p[0], p[60])], "a string, b string")
    assert {r["b"]: r["distance"] for r in traverse.distances(traverse.structural_view(nodes, edges), pairs).collect()} == {p[102]: 102, p[60]: 60}


def test_betweenness_matches_brute_force(spark):
    p, rows, nodes, edges = _random_graph(spark, random.Random(4), 9, 16)
    near = {x: set() for x in p}
    for a, b, t, _ in rows:
        if t != "tag_overlap" and a != b:
            near[a].add(b)
            near[b].add(a)

    def ways(s, t):
        level, found = [[s]], []
        seen = {s}
        while level and not found:
            found = [w for w in level if w[-1] == t]
            nxt = [w + [b] for w in level for b in near[w[-1]] if b not in seen]
            seen |= {w[-1] for w in nxt}
            level = nxt
        return found

    want = dict.fromkeys(p, 0.0)
    for s in p:
        for t in p:
            if s != t and (found := ways(s, t)):
                for w in found:
                    for v in w[1:-1]:
                        want[v] += 1 / len(found)
    scale = (len(p) - 1) * (len(p) - 2)
    got = {x["path"]: x["betweenness"] for x in centrality.betweenness(nodes, edges).collect()}
    assert all(abs(got[v] - want[v] / scale) < 1e-9 for v in p)
    assert centrality.betweenness(nodes.limit(2), edges).count() == 0


def test_betweenness_refuses_no_size_and_collects_no_link(spark, monkeypatch):
    import __spark_entry__ as entry

    _, _, nodes, edges = _random_graph(spark, random.Random(5), 12, 24)
    whole = {x["path"]: x["betweenness"] for x in centrality.betweenness(nodes, edges).collect()}

    def refuse(*_, **__):
        raise AssertionError("links at the driver")

    monkeypatch.setattr(type(edges), "toLocalIterator", refuse)
    parts = centrality.betweenness(nodes, edges, batch_rows=30)  # in several batches
    assert {x["path"]: round(x["betweenness"], 9) for x in parts.collect()} == {p: round(v, 9) for p, v in whole.items()}
    assert "bridges_betweenness_exact" in entry.queries()


def test_betweenness_by_arrays_is_that_by_joins(spark, monkeypatch):
    r = random.Random(6)
    pairs = {(f"n{r.randrange(1, 22):02d}", f"n{r.randrange(1, 22):02d}") for _ in range(30)} | {("n00", f"n{i:02d}") for i in range(1, 16)} | {("x1", "x2"), ("x2", "x3")}
    edges = spark.createDataFrame([(a, b, "wikilink", 1.0) for a, b in sorted(pairs)], "src string, dst string, type string, weight double")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | {"alone"})], "path string")
    score = lambda **more: {x["path"]: round(x["betweenness"], 9) for x in centrality.betweenness(nodes, edges, **more).collect()}
    want = {k: score(sources=k, array_links=0, batch_rows=200) for k in (None, 7)}

    def refuse(*_):
        raise AssertionError("joined level by level")

    monkeypatch.setattr(centrality, "_credits", refuse)
    for limits in ((2_000_000, 8_000_000), (20, 50)):  # batches are made smaller
        monkeypatch.setattr(centrality, "STEP_LINKS", limits[0])
        monkeypatch.setattr(centrality, "CELLS", limits[1])
        assert {k: score(sources=k) for k in (None, 7)} == want


def test_louvain_finds_cliques_and_is_stable(spark):
    rows = [(f"{c}{i}", f"{c}{j}", "wikilink", 1.0) for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", "wikilink", 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, weight double")
    nodes = spark.createDataFrame([(f"{c}{i}", ["t", c], "note") for c in "ab" for i in range(5)] + [("lone", None, None)], "path string, tags array<string>, type string")
    got = {r["path"]: r["community"] for r in communities.louvain(nodes, edges).collect()}
    assert got == {**{f"{c}{i}": f"{c}0" for c in "ab" for i in range(5)}, "lone": "lone"}
    members = communities.louvain(nodes, edges)
    profile = communities.profiles(nodes, members, edges)
    assert {r["community"]: (r["size"], r["top_tags"], r["representative"]) for r in profile.collect()} == {"a0": (5, ["a", "t"], "a0"), "b0": (5, ["b", "t"], "b0")}
    assert [(r["community_a"], r["community_b"], r["shared_tags"], r["bridges"]) for r in communities.gaps(profile, members, edges).collect()] == [("a0", "b0", ["t"], 1)]
    assert communities.louvain(nodes, edges.limit(0)).count() == 11


def test_louvain_task_gets_codes_not_paths(spark, monkeypatch):
    sent = []
    group = type(spark.range(1).groupBy())
    apply = group.applyInPandas

    def watched(self, run, schema):
        sent.append(self._df.dtypes)
        return apply(self, run, schema)

    monkeypatch.setattr(group, "applyInPandas", watched)
    edges = spark.createDataFrame([("b", "a", "wikilink", 1.0), ("a", "b", "embed", 2.0), ("c", "c", "wikilink", 1.0)], "src string, dst string, type string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert {r["path"]: r["community"] for r in communities.louvain(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert sent and all(kind != "string" for kinds in sent for _, kind in kinds)


def test_reading_sets_search_and_suggestions(vault):
    notes, edges, _ = vault
    pack = insights.context_pack(notes, edges, "Medallion Architecture", 1500).collect()
    assert len(pack) == 4 and sum(r["estimated_tokens"] for r in pack[:-1]) < 1500
    assert insights.context_pack(notes, edges, "zzzqqq").count() == 0
    hits = keyword_search(notes, "snowflake").collect()
    assert {h["title"] for h in hits[:2]} == {"Snowflake", "Snowflake Streams and Tasks"} and hits[0]["score"] == 5.0 and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert keyword_search(notes, "  ").count() == 0
    linked = {(r["src"], r["dst"]) for r in edges.collect()}
    for r in insights.suggest_links(notes, edges).collect():
        assert (r["source"], r["target"]) not in linked and (r["target"], r["source"]) not in linked and r["score"] >= 0.3
    assert [r["path"] for r in insights.tag_search(notes, "CDC").collect()] == ["concepts/Snowflake Streams and Tasks.md"]
    stale = insights.drift(notes, edges, "2026-04-30", 30, 14).collect()
    assert all(r["days_stale"] == 31 and r["connected_recent"] for r in stale) and "orphan_note.md" not in {r["path"] for r in stale}


def test_global_suggestions_match_brute_force(spark, monkeypatch):
    r = random.Random(12)
    p = [f"{r.choice('abc')}/n{i:02d}.md" for i in range(60)]
    tags = {x: {"wiki"} | set(r.sample("rstuv", r.choice([0, 0, 1, 3]))) for x in p}
    kind = {x: r.choice(["note", "idea", "log", None]) for x in p}
    pairs = {(r.choice(p), r.choice(p)) for _ in range(150)} | {(x, p[0]) for x in p[::2]}
    nodes = spark.createDataFrame([(x, x, kind[x], sorted(tags[x])) for x in p], "path string, title string, type string, tags array<string>")
    near = {x: {b for a, b in pairs if a == x and b != x} | {a for a, b in pairs if b == x and a != x} for x in p}

    def brute(links, top_n, min_score):
        out = []
        for a in p:
            for b in p:
                if a < b and a[0] != b[0] and (a, b) not in links and (b, a) not in links:
                    i, k = len(tags[a] & tags[b]), len(near[a] & near[b]) if links else 0
                    s = (0.5 if kind[a] and kind[a] == kind[b] else 1.0) * (2 * i / len(tags[a] | tags[b]) + min(k * 0.3, 1.0))
                    out += [(a, b, round(s, 3), i, k)] if s >= min_score - 1e-12 else []
        return sorted(out, key=lambda x: (-x[2], x[0], x[1]))[:top_n]

    whole = []
    promising = insights._promising

    def watched(*args):
        found = promising(*args)
        whole.append(found.count())
        return found

    monkeypatch.setattr(insights, "_promising", watched)
    edges = spark.createDataFrame([(a, b, "wikilink", 1.0) for a, b in sorted(pairs)], "src string, dst string, type string, weight double")
    for links, top_n, min_score in ((pairs, 5, 0.3), (pairs, 700, 0.5), (pairs, None, 0.3), (set(), 20, 0.3)):
        got = [tuple(x) for x in insights.suggest_links(nodes, edges if links else edges.limit(0), None, top_n, min_score).collect()]
        assert got == brute(links, top_n, min_score)
    assert whole[0] < 100 < whole[2]  # few pairs are formed for few results


def test_surprising_connections_search_only_far_pairs(spark, monkeypatch):
    p = [f"{f}/{i}.md" for i, f in enumerate("abcdef")]
    nodes = spark.createDataFrame([(x, "Home" if i == 5 else x, None, ["t", "u"] if i < 4 else []) for i, x in enumerate(p)], "path string, title string, type string, tags array<string>")
    # 0 and 1 share a neighbour (4); 2 and 0, 2 and 1, share only a generic page (5); 3 has no links
    rows = [(p[0], p[4]), (p[1], p[4]), (p[0], p[5]), (p[1], p[5]), (p[2], p[5])]
    edges = spark.createDataFrame([(a, b, "wikilink", 1.0) for a, b in rows], "src string, dst string, type string, weight double")
    searched = []
    distances = insights.distances

    def watched(steps, pairs):
        searched.extend((x["a"], x["b"]) for x in pairs.collect())
        return distances(steps, pairs)

    monkeypatch.setattr(insights, "distances", watched)
    got = [(x["source"], x["target"], x["score"], x["distance"]) for x in insights.surprising_connections(nodes, edges).collect()]
    assert got == [(p[0], p[2], 2.3, 99), (p[1], p[2], 2.3, 99), (p[0], p[3], 2.0, 99), (p[1], p[3], 2.0, 99), (p[2], p[3], 2.0, 99)]
    assert sorted(searched) == sorted(x[:2] for x in got)


def test_strict_dates(spark):
    df = spark.createDataFrame([("2026-04-29",), ("2026-04-29T10:00",), ("2026-4-9",), ("2026-02-30",), ("",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(iso_date(df["d"])).collect()] == ["2026-04-29"] + ["None"] * 5


def test_saving_and_exports(spark, vault, tmp_path):
    import xml.etree.ElementTree as ET

    notes, edges, broken = vault
    sinks.save_graph(notes, edges, broken, str(tmp_path / "g"))
    n, e, b = sinks.load_graph(spark, str(tmp_path / "g"))
    assert (n.count(), e.count(), b.count()) == (18, 116, 3)
    sinks.write_graphml(notes, edges, str(tmp_path / "x"))
    tree = ET.fromstring("\n".join(f.read_text() for f in sorted((tmp_path / "x").glob("part-*"))))
    assert len(tree.findall(".//{*}node")) == 18 and len(tree.findall(".//{*}edge")) == 116
    assert sinks.json_rows(notes, edges).count() == 134
