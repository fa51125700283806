"""Queries of the graph, search and parsing operators over the vault tables.

Notes are the current rows of ``nodes``; edges the recorded links between them, one per pair; broken links the recorded
ones without a note. Parsing and link building read the latest scan of each path in ``parsed_notes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import parse, text
from lattica.operators import centrality, communities, graph, incremental, insights, search, similarity, sinks, traverse
from lattica.session import materialize
from lattica.sources.tables import current_nodes, successful_runs, table
from lattica.streaming.watch import debounce

AS_OF = "2026-06-15"
SEED = "Saffron Meadow Forestry Pattern"
OTHER = "Indigo Anchor Masonry Method"

NODES_SQL = """
cn AS (SELECT path, title, type, updated, coalesce(tags, []) tags, coalesce(headings, []) headings, word_count, content_hash FROM nodes WHERE path IS NOT NULL AND run_id IN (SELECT run_id FROM sync_runs WHERE status = 'success')
       QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC, saved_at DESC) = 1)"""
GRAPH_SQL = NODES_SQL + """,
e AS (SELECT src, dst, type, weight FROM edges WHERE dst NOT LIKE '\\_\\_broken\\_\\_:%' ESCAPE '\\' AND src IN (SELECT path FROM cn) AND dst IN (SELECT path FROM cn)
      QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, recorded_at, type) = 1),
br AS (SELECT DISTINCT src, substr(dst, 12) target FROM edges WHERE starts_with(dst, '__broken__:')),
st AS (SELECT * FROM e WHERE type IN ('wikilink', 'related_to', 'embed', 'semantic_similarity')),
u AS (SELECT src a, dst b, weight w FROM st UNION ALL SELECT dst, src, weight FROM st),
seed AS (SELECT min(path) n FROM cn WHERE lower(title) = lower('{seed}'))""".replace("{seed}", SEED)
NOTES_SQL = """
pn AS (SELECT * FROM parsed_notes WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, note_id DESC) = 1)"""
STEM_SQL = "regexp_replace(regexp_extract({}, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"


def _nodes(spark: SparkSession, d: str, *only: str) -> DataFrame:
    """The current rows of ``nodes``, or some columns of them besides the path."""
    columns = only or ("title", "type", "updated", "tags", "headings", "word_count", "content_hash")
    none = F.array().cast("array<string>")
    rows = current_nodes(table(spark, d, "nodes", ["path", *columns, "run_id", "saved_at"]), successful_runs(spark, d))
    return rows.withColumns({c: F.coalesce(c, none) for c in ("tags", "headings") if c in columns})


def _graph(spark: SparkSession, d: str, written: bool = False, only: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and broken links; ``written`` puts nodes and edges down first, for operators that read them many times."""
    nodes = _nodes(spark, d, *only)
    nodes = materialize(nodes, "nodes") if written else nodes
    edges, broken = graph.stored_graph(nodes, table(spark, d, "edges"))
    return nodes, materialize(edges, "edges") if written else edges, broken


def _notes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "parsed_notes", ["path", "note_id", "scanned_at", *columns]).where("path is not null")
    best = rows.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("scanned_at", "note_id")).alias("r"))
    return best.select("path", *[F.col("r")[c].alias(c) for c in columns])


def _seed(nodes: DataFrame, title: str = SEED) -> DataFrame:
    return traverse.find_node(nodes, title)


def graph_stats(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return centrality.graph_stats(nodes, edges)


def graph_stats_with_broken(spark, d):
    return centrality.graph_stats(*_graph(spark, d))


def edge_type_counts(spark, d):
    return centrality.edge_type_counts(_graph(spark, d)[1])


def hubs(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return centrality.hubs(nodes, edges, 20)


def orphans(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return centrality.orphans(nodes, edges)


def bridges_betweenness(spark, d):
    """Betweenness of all notes, from 100 sources drawn by hash."""
    nodes, edges, _ = _graph(spark, d, written=True)
    return centrality.bridges(nodes, edges, 20, sources=100)


def bridges_betweenness_exact(spark, d):
    """Betweenness of all notes, from every note."""
    nodes, edges, _ = _graph(spark, d, written=True)
    return centrality.bridges(nodes, edges, 20)


def broken_links(spark, d):
    nodes, _, broken = _graph(spark, d)
    return insights.broken_links(nodes, broken)


def query_node_edges(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return insights.query_node(nodes, edges, _seed(nodes))


def tag_search(spark, d):
    return insights.tag_search(_nodes(spark, d), "Evergreen")


def list_stale(spark, d):
    return insights.list_stale(_nodes(spark, d), 30, AS_OF)


def drift(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return insights.drift(nodes, edges, AS_OF, 30, 29, top_n=None).withColumn("connected_recent", F.array_join("connected_recent", "|"))


def _blast(spark, d, depth, threshold=0.3, direction="both"):
    nodes, edges, _ = _graph(spark, d, written=True)
    return traverse.blast_radius(edges, _seed(nodes), depth, threshold, direction).select("path", "relevance", "distance")


def blast_radius_d1(spark, d):
    return _blast(spark, d, 1)


def blast_radius_d2(spark, d):
    return _blast(spark, d, 2)


def blast_radius_out(spark, d):
    return _blast(spark, d, 2, 0.1, "out")


def blast_radius_in(spark, d):
    return _blast(spark, d, 2, 0.1, "in")


def traverse_out(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True)
    return traverse.traverse(edges, _seed(nodes), 2, "out")


def traverse_structural(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True)
    return traverse.traverse(edges, _seed(nodes), 2, "structural")


def shortest_path_hops(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True)
    return traverse.shortest_path(nodes, edges, _seed(nodes), _seed(nodes, OTHER)).select("hops")


def edge_conflict(spark, d):
    return _graph(spark, d)[1]


def link_resolution(spark, d):
    notes = _notes(spark, d, "title", "aliases", "wikilinks")
    links = notes.select(F.col("path").alias("src"), F.explode("wikilinks").alias("target")).where("target is not null").distinct()
    return graph.resolve_links(links, graph.name_table(notes)).select("src", "target", "dst")


def link_edges(spark, d):
    """Edges from the latest scan's explicit links, one per pair."""
    notes = _notes(spark, d, "title", "aliases", "wikilinks", "embeds", "related_to")
    return graph.resolve_conflicts(graph.link_edges(notes)[0], ["stage", "ordinal", "kind", "type"])


def graph_build(spark, d):
    """The whole graph of the latest scan: explicit links and tag overlap."""
    return graph.build_graph(_notes(spark, d, "title", "aliases", "wikilinks", "embeds", "related_to", "tags"))[0].withColumn("weight", F.round("weight", 6))


def tag_overlap_edges(spark, d):
    return graph.tag_edges(_nodes(spark, d, "title", "tags")).withColumn("weight", F.round("weight", 6)).select("src", "dst", "weight")


def folder_edges(spark, d):
    return graph.folder_edges(_nodes(spark, d)).select("src", "dst", "weight")


def suggest_links(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True)
    return insights.suggest_links(nodes, edges, _seed(nodes), 20)


def suggest_links_global(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True, only=("title", "type", "tags"))
    return insights.suggest_links(nodes, edges, None, 20)


def surprising_connections(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True, only=("title", "type", "tags"))
    return insights.surprising_connections(nodes, edges)


def context_pack(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True)
    return insights.context_pack(nodes, edges, SEED, 4000).select("path", "relevance", "word_count", "estimated_tokens")


def keyword_search(spark, d):
    found = search.keyword_search(_nodes(spark, d), "forestry evergreen map", 50)
    return found.select("path", "title", "score", F.array_join("fields", ",").alias("fields"), "context")


def keyword_search_bodies(spark, d):
    found = search.keyword_search(_nodes(spark, d), "forestry evergreen", 50, _notes(spark, d, "body"))
    return found.select("path", "score", F.array_join("fields", ",").alias("fields"))


def communities_louvain(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True)
    return communities.louvain(nodes, edges)


def _given(nodes: DataFrame) -> DataFrame:
    """Vaults as communities."""
    return nodes.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("community"))


def community_profile(spark, d):
    nodes, edges, _ = _graph(spark, d, written=True)
    p = communities.profiles(nodes, _given(nodes), edges)
    return p.withColumns({c: F.array_join(c, "|") for c in ("top_tags", "top_types")})


def gaps_given_communities(spark, d):
    """Pairs of folders (vault and kind) that share top tags but have at most two edges between them."""
    nodes, edges, _ = _graph(spark, d, written=True)
    members = nodes.select("path", text.folder(F.col("path")).alias("community"))
    return communities.gaps(communities.profiles(nodes, members, edges), members, edges).withColumn("shared_tags", F.array_join("shared_tags", "|"))


def content_hash(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", text.content_hash(F.col("text").cast("binary")).alias("hash"))


def word_count(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"))


def chunk_text(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text"]).where("text is not null")
    return docs.select("doc_id", F.posexplode(text.chunk_text(F.col("text"))).alias("chunk", "piece")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("piece").alias("digest"))


def _parsed(spark, d, expr, name):
    rows = _notes(spark, d, "body").where("body is not null")
    return rows.select("path", F.array_join(expr(F.col("body")), "|").alias(name))


def parse_wikilinks(spark, d):
    return _parsed(spark, d, parse.links, "links")


def parse_links_filtered(spark, d):
    return _parsed(spark, d, parse.wikilinks, "links")


def parse_embeds(spark, d):
    return _parsed(spark, d, parse.embeds, "embeds")


def parse_tags(spark, d):
    return _parsed(spark, d, lambda b: F.array_sort(F.array_distinct(parse.inline_tags(b))), "tags")


def parse_headings(spark, d):
    return _parsed(spark, d, parse.headings, "headings")


def parse_whole_notes(spark, d):
    """Notes written back as markdown with front matter, and parsed again."""
    notes = _notes(spark, d, "frontmatter", "body").where("body is not null")
    lines = F.array_join(F.transform(F.map_entries("frontmatter"), lambda e: F.concat(e["key"], F.lit(": '"), F.replace(e["value"], F.lit("'"), F.lit("''")), F.lit("'"))), "\n")
    raw = notes.select("path", F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), "body").cast("binary").alias("content"))
    return parse.parse_notes(raw).select("path", "title", "type", "status", F.array_join("headings", "|").alias("headings"), "word_count", "parse_error")


def _chunks(spark, d):
    return similarity.usable_chunks(table(spark, d, "vec_embeddings"), 64)


def embed_status(spark, d):
    nodes = _nodes(spark, d)
    known = _chunks(spark, d).join(nodes.select(F.col("path").alias("note")), "note", "left_semi")
    return similarity.embed_status(nodes, known)


def note_vectors(spark, d):
    return similarity.note_vectors(_chunks(spark, d)).select("note", F.col("pos").cast("long").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


def semantic_search(spark, d):
    chunks = _chunks(spark, d)
    # the query vector is that of the first key
    first = chunks.agg(F.min_by("v", "key")).first()
    query = [0.0] * 64 if first is None or first[0] is None else list(first[0])
    return similarity.semantic_search(chunks, query, _nodes(spark, d)).select("path", "title", "distance", "match")


def semantic_edges(spark, d):
    return similarity.semantic_edges(_chunks(spark, d), _nodes(spark, d), 0.6).select("src", "dst", F.round("weight", 6).alias("weight"))


def embed_notes(spark, d):
    """Chunks of notes that have no vectors yet, embedded by hashing."""
    notes = _notes(spark, d, "title", "headings", "body")
    done = _chunks(spark, d).select(F.col("note").alias("note_path"))
    found = similarity.embed_notes(notes, done, similarity.HashingEmbedder(64))
    return found.select("note_path", "chunk_no", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squared_norm"))


def snapshot_diff(spark, d):
    nodes = _nodes(spark, d).select("path", "content_hash")
    return incremental.snapshot_diff(nodes, _notes(spark, d, "content_hash"))


def update_counts(spark, d):
    return incremental.update_counts(snapshot_diff(spark, d))


def debounce_sessions(spark, d):
    events = table(spark, d, "events", ["ts", "user_id", "event_type"]).select("ts", "user_id", F.col("event_type").alias("path"))
    return debounce(events, "10 minutes", key="user_id").select("user_id", "started", "events", F.array_join("paths", "|").alias("paths"))


def export_json(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return sinks.json_rows(nodes.select("path", "title", "type"), edges.select("src", "dst", "type"))


def export_graphml(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return sinks.graphml_rows(nodes, edges)


QUERIES = {f.__name__: f for f in (
    graph_stats, graph_stats_with_broken, edge_type_counts, hubs, orphans, bridges_betweenness, bridges_betweenness_exact, broken_links, query_node_edges, tag_search, list_stale, drift, blast_radius_d1, blast_radius_d2,
    blast_radius_out, blast_radius_in, traverse_out, traverse_structural, shortest_path_hops, edge_conflict, link_resolution, link_edges, graph_build, tag_overlap_edges, folder_edges, suggest_links,
    suggest_links_global, surprising_connections, context_pack, keyword_search, keyword_search_bodies, communities_louvain, community_profile, gaps_given_communities, content_hash, word_count,
    chunk_text, parse_wikilinks, parse_links_filtered, parse_embeds, parse_tags, parse_headings, parse_whole_notes, embed_status, note_vectors, semantic_search, semantic_edges, embed_notes,
    snapshot_diff, update_counts, debounce_sessions, export_json, export_graphml,
)}


def _walks(depth: int, threshold: float, view: str) -> str:
    parts = [f"l1 AS (SELECT b n, max(w) r FROM {view} WHERE a = (SELECT n FROM seed) AND w >= {threshold} GROUP BY b)"]
    parts += [f"l{i} AS (SELECT b n, max(r * w) r FROM l{i - 1} JOIN {view} x ON x.a = n WHERE r * w >= {threshold} GROUP BY b)" for i in range(2, depth + 1)]
    every = " UNION ALL ".join(f"SELECT n, round(r, 4) r, {i} d FROM l{i}" for i in range(1, depth + 1))
    return ", ".join(parts) + f", al AS ({every}), m AS (SELECT n, max(r) r FROM al WHERE n <> (SELECT n FROM seed) GROUP BY n)"


def _blast_sql(depth: int, threshold: float = 0.3, view: str = "u") -> str:
    return f"WITH {GRAPH_SQL}, o AS (SELECT src a, dst b, weight w FROM st), i AS (SELECT dst a, src b, weight w FROM st), {_walks(depth, threshold, view)} SELECT m.n path, m.r relevance, min(al.d) distance FROM m JOIN al ON al.n = m.n AND al.r = m.r GROUP BY m.n, m.r"


def _traverse_sql(view: str) -> str:
    return f"""WITH {GRAPH_SQL}, o AS (SELECT src a, dst b FROM e), h1 AS (SELECT DISTINCT b n FROM {view} WHERE a = (SELECT n FROM seed)),
h AS (SELECT n, 1 d FROM h1 UNION ALL SELECT b, 2 FROM h1 JOIN {view} x ON x.a = n) SELECT n path, min(d) distance FROM h WHERE n <> (SELECT n FROM seed) GROUP BY n"""


_EXPLICIT_SQL = f"""
names AS (SELECT 1 kind, lower(title) k, max(path) path FROM pn GROUP BY ALL UNION ALL SELECT 2, lower(a), max(path) FROM (SELECT path, unnest(aliases) a FROM pn) GROUP BY ALL
          UNION ALL SELECT 3, lower({STEM_SQL.format('path')}), max(path) FROM pn GROUP BY ALL UNION ALL SELECT 4, lower(path), max(path) FROM pn GROUP BY ALL),
lk AS (SELECT DISTINCT path src, 'embed' type, 1.5 w, 0 o, unnest(embeds) target FROM pn UNION SELECT path, 'wikilink', 1.0, 1, unnest(wikilinks) FROM pn UNION SELECT path, 'related_to', 2.0, 2, unnest(related_to) FROM pn),
want AS (SELECT DISTINCT target FROM lk WHERE target IS NOT NULL),
cand AS (SELECT target, 1 r, 1 kind, lower(target) k FROM want UNION ALL SELECT target, 2, 2, lower(target) FROM want UNION ALL SELECT target, 3, 3, lower(target) FROM want
         UNION ALL SELECT target, 4, 4, lower(target) FROM want WHERE contains(target, '/') UNION ALL SELECT target, 5, 4, lower(target) || '.md' FROM want WHERE contains(target, '/')
         UNION ALL SELECT target, 6, 3, {STEM_SQL.format('lower(target)')} FROM want WHERE contains(target, '/')),
res AS (SELECT target, arg_min(path, r) dst FROM cand JOIN names ON names.kind = cand.kind AND names.k = cand.k GROUP BY target)"""
_LINKS_SQL = """
ed AS (SELECT src, dst, type, w, 0 stage, src ordinal, o FROM lk JOIN res ON res.target = lk.target WHERE NOT (type = 'embed' AND regexp_matches(lower(lk.target), '\\.(png|jpg|jpeg|gif|webp|svg|pdf|pptx|xlsx|docx|base|csv|json|canvas)$'))),
cx AS (SELECT * FROM ed UNION ALL SELECT dst, src, type, w, 0, src, o FROM ed WHERE type = 'related_to')"""
_PICK_SQL = "QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY w DESC, stage, ordinal, o, type) = 1"


def _tags_sql(source: str) -> str:
    generic = ", ".join("'" + t.replace("'", "''") + "'" for t in graph.GENERIC_TITLES)
    return f"""
tp AS (SELECT DISTINCT path k, unnest(tags) t FROM {source} WHERE coalesce(title, '') NOT IN ({generic})), tg AS (SELECT * FROM tp WHERE t IS NOT NULL), ts AS (SELECT k, count(*) n FROM tg GROUP BY k),
tj AS (SELECT a.k a, b.k b, count(*) i FROM tg a JOIN tg b ON a.t = b.t AND a.k < b.k GROUP BY a.k, b.k),
tw AS (SELECT a, b, 0.5::DOUBLE * (i::DOUBLE / (sa.n + sb.n - i)) w FROM tj JOIN ts sa ON sa.k = a JOIN ts sb ON sb.k = b WHERE i::DOUBLE / (sa.n + sb.n - i) >= 0.15::DOUBLE),
td AS (SELECT a n, b m, w FROM tw UNION ALL SELECT b, a, w FROM tw), tr AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY round(w, 9) DESC, m) rn FROM td),
tk AS (SELECT DISTINCT least(n, m) a, greatest(n, m) b, w FROM tr WHERE rn <= 20), te AS (SELECT a src, b dst, w FROM tk UNION ALL SELECT b, a, w FROM tk)"""


_FOLDER = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"


def _suggest_sql(pairs: str, extra: str = "") -> str:
    placeholders = ", ".join("'" + t.replace("'", "''") + "'" for t in graph.PLACEHOLDER_TITLES)
    return f"""WITH {GRAPH_SQL}, tg AS (SELECT DISTINCT path k, unnest(tags) t FROM cn), tn AS (SELECT k, count(*) n FROM tg WHERE t IS NOT NULL GROUP BY k),
ok AS (SELECT path, type, {_FOLDER} f, coalesce(n, 0) n FROM cn LEFT JOIN tn ON k = path WHERE coalesce(title, '') NOT IN ({placeholders})),
nb AS (SELECT src a, dst m FROM e WHERE type IN ('wikilink', 'related_to', 'embed') AND src <> dst UNION SELECT dst, src FROM e WHERE type IN ('wikilink', 'related_to', 'embed') AND src <> dst),
sh AS (SELECT x.k a, y.k b, count(*) i FROM tg x JOIN tg y ON x.t = y.t AND x.k <> y.k WHERE x.t IS NOT NULL GROUP BY 1, 2),
mu AS (SELECT x.a a, y.a b, count(*) k FROM nb x JOIN nb y ON x.m = y.m AND x.a <> y.a {extra} GROUP BY 1, 2),
pr AS ({pairs}),
sc AS (SELECT pr.a, pr.b, coalesce(i, 0) i, coalesce(mu.k, 0) k, x.n xn, y.n yn, (CASE WHEN x.type <> '' AND x.type = y.type THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
       * ((CASE WHEN x.n + y.n > 0 THEN 2.0::DOUBLE * coalesce(i, 0) / (x.n + y.n - coalesce(i, 0)) ELSE 0.0::DOUBLE END) + least(coalesce(mu.k, 0) * 0.3::DOUBLE, 1.0::DOUBLE)) s
       FROM pr JOIN ok x ON x.path = pr.a JOIN ok y ON y.path = pr.b LEFT JOIN sh ON sh.a = pr.a AND sh.b = pr.b LEFT JOIN mu ON mu.a = pr.a AND mu.b = pr.b
       WHERE x.f <> y.f AND NOT EXISTS (SELECT 1 FROM e WHERE (e.src = pr.a AND e.dst = pr.b) OR (e.src = pr.b AND e.dst = pr.a)))
SELECT a source, b target, round(s, 3) score, i shared_tags, k shared_neighbours FROM sc WHERE s >= 0.3::DOUBLE - 1e-12 ORDER BY round(s, 3) DESC, a, b LIMIT 20"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _target(x: str) -> str:
    return _strip(f"split_part({_strip(f'''split_part({x}, '|', 1)''')}, '#', 1)")


_CHUNKS_SQL = """ch AS (SELECT DISTINCT path key, split_part(path, '::', 1) note, embedding::DOUBLE[] v FROM vec_embeddings WHERE path IS NOT NULL AND len(embedding) = 64
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_NOCODE = "regexp_replace(regexp_replace(regexp_replace(body, '```(?s:.)*?```', '', 'g'), '`[^`\\n]+`', '', 'g'), '!\\[\\[[^\\]\\n]+\\]\\]', '', 'g')"
_BODY = f"WITH {NOTES_SQL}, b AS (SELECT path, body FROM pn WHERE body IS NOT NULL) "

SQL = {
    "graph_stats": f"WITH {GRAPH_SQL} SELECT *, round(edge_count / (node_count::DOUBLE * (node_count - 1)), 6) density FROM (SELECT (SELECT count(*) FROM cn) node_count, (SELECT count(*) FROM e) edge_count, (SELECT count(*) FROM cn WHERE path NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) orphan_count, 0::BIGINT broken_count)",
    "graph_stats_with_broken": f"WITH {GRAPH_SQL} SELECT *, round(edge_count / (node_count::DOUBLE * (node_count - 1)), 6) density FROM (SELECT (SELECT count(*) FROM cn) node_count, (SELECT count(*) FROM e) + (SELECT count(*) FROM br) edge_count, (SELECT count(*) FROM cn WHERE path NOT IN (SELECT src FROM e UNION SELECT dst FROM e UNION SELECT src FROM br)) orphan_count, (SELECT count(*) FROM br) broken_count)",
    "edge_type_counts": f"WITH {GRAPH_SQL} SELECT type, count(*) n FROM e GROUP BY type",
    "hubs": f"WITH {GRAPH_SQL}, dg AS (SELECT p, count(*) k FROM (SELECT src p FROM e UNION ALL SELECT dst FROM e) GROUP BY p) SELECT path, title, coalesce(k, 0) degree, round(coalesce(k, 0) / ((SELECT count(*) FROM cn) - 1)::DOUBLE, 6) centrality FROM cn LEFT JOIN dg ON p = path ORDER BY centrality DESC, path LIMIT 20",
    "orphans": f"WITH {GRAPH_SQL} SELECT path, title FROM cn WHERE path NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
    "broken_links": f"WITH {GRAPH_SQL} SELECT src path, coalesce(title, src) title, target FROM br LEFT JOIN cn ON path = src",
    "query_node_edges": f"WITH {GRAPH_SQL} SELECT 'outbound' direction, dst other, type, weight FROM e WHERE src = (SELECT n FROM seed) UNION ALL SELECT 'inbound', src, type, weight FROM e WHERE dst = (SELECT n FROM seed)",
    "tag_search": f"WITH {NODES_SQL} SELECT path, title FROM cn WHERE len(list_filter(tags, lambda t: lower(t) = 'evergreen')) > 0",
    "list_stale": f"WITH {NODES_SQL}, x AS (SELECT *, CASE WHEN regexp_full_match(updated, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(updated AS DATE) END dd FROM cn) SELECT path, title, CASE WHEN coalesce(updated, '') = '' THEN 'unknown' ELSE updated END last_updated FROM x WHERE dd IS NULL OR dd <= DATE '{AS_OF}' - 30",
    "drift": f"""WITH {GRAPH_SQL}, x AS (SELECT path, title, updated, CASE WHEN regexp_full_match(updated, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(updated AS DATE) END dd FROM cn),
rc AS (SELECT path o, coalesce(title, path) t FROM x WHERE dd > DATE '{AS_OF}' - 30 AND dd >= DATE '{AS_OF}' - 29), sl AS (SELECT * FROM x WHERE dd IS NULL OR dd <= DATE '{AS_OF}' - 30),
pr AS (SELECT src path, dst o, 0 k FROM e UNION ALL SELECT dst, src, 1 FROM e), fi AS (SELECT pr.path, t, min((k, pr.o)) z FROM pr JOIN rc ON rc.o = pr.o GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY z, t) r FROM fi), nm AS (SELECT path, string_agg(t, '|' ORDER BY r) FILTER (r <= 5) five, string_agg(t, ', ' ORDER BY r) FILTER (r <= 3) three FROM rk GROUP BY path)
SELECT sl.path, title, CASE WHEN coalesce(updated, '') = '' THEN 'unknown' ELSE updated END last_updated, coalesce(date_diff('day', dd, DATE '{AS_OF}'), 31)::INT days_stale, five connected_recent,
'Not updated in ' || days_stale || 'd but connected to: ' || three reason FROM sl JOIN nm ON nm.path = sl.path""",
    "blast_radius_d1": _blast_sql(1),
    "blast_radius_d2": _blast_sql(2),
    "blast_radius_out": _blast_sql(2, 0.1, "o"),
    "blast_radius_in": _blast_sql(2, 0.1, "i"),
    "traverse_out": _traverse_sql("o"),
    "traverse_structural": _traverse_sql("u"),
    "edge_conflict": f"WITH {GRAPH_SQL} SELECT * FROM e",
    "link_resolution": f"WITH {NOTES_SQL}, {_EXPLICIT_SQL} SELECT DISTINCT src, lk.target, dst FROM lk LEFT JOIN res ON res.target = lk.target WHERE type = 'wikilink' AND lk.target IS NOT NULL",
    "link_edges": f"WITH {NOTES_SQL}, {_EXPLICIT_SQL}, {_LINKS_SQL} SELECT src, dst, type, w::DOUBLE weight FROM cx {_PICK_SQL}",
    "graph_build": f"WITH {NOTES_SQL}, {_EXPLICIT_SQL}, {_LINKS_SQL}, {_tags_sql('pn')}, ax AS (SELECT src, dst, type, w::DOUBLE w, stage, ordinal, o FROM cx UNION ALL SELECT src, dst, 'tag_overlap', w, 1, src, 0 FROM te) SELECT src, dst, type, round(w, 6) weight FROM ax {_PICK_SQL}",
    "tag_overlap_edges": f"WITH {NODES_SQL}, {_tags_sql('cn')} SELECT src, dst, round(w, 6) weight FROM te",
    "folder_edges": f"WITH {NODES_SQL}, f AS (SELECT path, {_FOLDER} f FROM cn) SELECT x.path src, y.path dst, 0.3::DOUBLE weight FROM f x JOIN f y ON x.f = y.f AND x.path <> y.path",
    "suggest_links": _suggest_sql("SELECT a, b FROM sh WHERE a = (SELECT n FROM seed) UNION SELECT a, b FROM mu WHERE a = (SELECT n FROM seed)", "WHERE x.a = (SELECT n FROM seed)"),
    "suggest_links_global": _suggest_sql("SELECT a, b FROM sh WHERE a < b"),
    "context_pack": f"""WITH {GRAPH_SQL}, {_walks(2, 0.1, 'u')}, dg AS (SELECT p, count(*) k FROM (SELECT src p FROM e UNION ALL SELECT dst FROM e) GROUP BY p),
ca AS (SELECT m.n, m.r, min(al.d) d FROM m JOIN al ON al.n = m.n AND al.r = m.r GROUP BY 1, 2 UNION ALL SELECT n, 1.0, 0 FROM seed),
tk AS (SELECT n, r, d, word_count, greatest(1, floor(coalesce(word_count, 0) / 0.75::DOUBLE))::INT t FROM ca JOIN cn ON path = n),
ru AS (SELECT *, coalesce(sum(t) OVER (ORDER BY d > 0, r DESC, d, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM tk)
SELECT n path, round(r * (1 + coalesce(k, 0)::DOUBLE / (SELECT max(k) FROM dg) * 0.2::DOUBLE), 4) relevance, word_count, t estimated_tokens FROM ru LEFT JOIN dg ON p = n WHERE b < 4000""",
    "keyword_search": f"""WITH {NODES_SQL}, x AS (SELECT *, lower(coalesce(title, '')) lt, lower(array_to_string(tags, ' ')) lg, lower(array_to_string(headings, ' ')) lh FROM cn), t AS (SELECT unnest(['forestry', 'evergreen', 'map']) w),
s AS (SELECT path, sum(3.0 * contains(lt, w)::INT + 2.0 * contains(lg, w)::INT + 1.5 * contains(lh, w)::INT)::DOUBLE score, array_to_string(list_filter([CASE WHEN bool_or(contains(lt, w)) THEN 'title' END, CASE WHEN bool_or(contains(lg, w)) THEN 'tags' END, CASE WHEN bool_or(contains(lh, w)) THEN 'headings' END], lambda y: y IS NOT NULL), ',') fields FROM x, t GROUP BY path),
c AS (SELECT path, title, list_filter(tags, lambda y: regexp_matches(lower(y), 'forestry|evergreen|map')) mt, list_filter(headings, lambda y: regexp_matches(lower(y), 'forestry|evergreen|map'))[1:3] mh FROM cn)
SELECT s.path, coalesce(title, s.path) title, score, fields, array_to_string(list_filter([CASE WHEN coalesce(title, '') <> '' THEN 'title: ' || title END, CASE WHEN len(mt) > 0 THEN 'tags: ' || array_to_string(mt, ', ') END, CASE WHEN len(mh) > 0 THEN 'headings: ' || array_to_string(mh, ', ') END], lambda y: y IS NOT NULL), ' | ') context
FROM s JOIN c ON c.path = s.path WHERE score > 0 ORDER BY score DESC, s.path LIMIT 50""",
    "keyword_search_bodies": f"""WITH {NODES_SQL}, {NOTES_SQL}, x AS (SELECT cn.path, lower(coalesce(cn.title, '')) lt, lower(array_to_string(cn.tags, ' ')) lg, lower(array_to_string(cn.headings, ' ')) lh, lower(coalesce(body, '')) lb FROM cn LEFT JOIN pn ON pn.path = cn.path), t AS (SELECT unnest(['forestry', 'evergreen']) w),
s AS (SELECT path, sum(3.0 * contains(lt, w)::INT + 2.0 * contains(lg, w)::INT + 1.5 * contains(lh, w)::INT + least(0.5 * (length(lb) - length(replace(lb, w, ''))) / length(w), 2.0))::DOUBLE score, array_to_string(list_filter([CASE WHEN bool_or(contains(lt, w)) THEN 'title' END, CASE WHEN bool_or(contains(lg, w)) THEN 'tags' END, CASE WHEN bool_or(contains(lh, w)) THEN 'headings' END, CASE WHEN bool_or(contains(lb, w)) THEN 'body' END], lambda y: y IS NOT NULL), ',') fields FROM x, t GROUP BY path)
SELECT path, score, fields FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 50""",
    "community_profile": f"""WITH {GRAPH_SQL}, dg AS (SELECT p, count(*) k FROM (SELECT src p FROM e UNION ALL SELECT dst FROM e) GROUP BY p), mb AS (SELECT path, split_part(path, '/', 1) community, tags, type, coalesce(k, 0) k FROM cn LEFT JOIN dg ON p = path),
tt AS (SELECT community, v, count(*) n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, v) r FROM (SELECT community, unnest(tags) v FROM mb) WHERE v IS NOT NULL GROUP BY 1, 2),
ty AS (SELECT community, type v, count(*) n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, type) r FROM mb WHERE type <> '' GROUP BY 1, 2)
SELECT community, count(*) size, coalesce((SELECT string_agg(v, '|' ORDER BY r) FROM tt WHERE tt.community = mb.community AND r <= 5), '') top_tags, coalesce((SELECT string_agg(v, '|' ORDER BY r) FROM ty WHERE ty.community = mb.community AND r <= 3), '') top_types, arg_min(path, (-k, path)) representative FROM mb GROUP BY community HAVING count(*) >= 2""",
    "gaps_given_communities": f"""WITH {GRAPH_SQL}, mb AS (SELECT path, {_FOLDER} c, tags FROM cn), sz AS (SELECT c FROM mb GROUP BY c HAVING count(*) >= 2),
tt AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) r FROM (SELECT c, unnest(tags) v FROM mb WHERE c IN (SELECT c FROM sz)) WHERE v IS NOT NULL GROUP BY 1, 2), t5 AS (SELECT * FROM tt WHERE r <= 5),
cr AS (SELECT least(x.c, y.c) a, greatest(x.c, y.c) b, count(*) n FROM e JOIN mb x ON x.path = src JOIN mb y ON y.path = dst WHERE x.c <> y.c GROUP BY 1, 2),
sp AS (SELECT x.c a, y.c b, string_agg(x.v, '|' ORDER BY x.r) s FROM t5 x JOIN t5 y ON x.v = y.v AND x.c < y.c GROUP BY 1, 2)
SELECT sp.a community_a, sp.b community_b, s shared_tags, coalesce(n, 0) bridges FROM sp LEFT JOIN cr ON cr.a = sp.a AND cr.b = sp.b WHERE coalesce(n, 0) <= 2""",
    "content_hash": "SELECT doc_id, substr(sha256(text), 1, 16) hash FROM documents",
    "word_count": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x{85}]+'), lambda x: x <> ''))::BIGINT words FROM documents",
    "chunk_text": "SELECT doc_id, i chunk, md5(substr(text, i * 1400 + 1, 1600)) digest FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 1400.0), 1)::BIGINT)) i FROM documents WHERE text IS NOT NULL)",
    "parse_wikilinks": _BODY + f"SELECT path, array_to_string(list_transform(regexp_extract_all({_NOCODE}, '\\[\\[([^\\]\\n]+)\\]\\]', 1), lambda x: {_target('x')}), '|') links FROM b",
    "parse_embeds": _BODY + f"SELECT path, array_to_string(list_transform(regexp_extract_all(body, '!\\[\\[([^\\]]+)\\]\\]', 1), lambda x: {_target('x')}), '|') embeds FROM b",
    "parse_tags": _BODY + "SELECT path, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '(?m)(?:^|\\s)#([a-zA-Z][\\p{L}\\p{N}_/-]*)', 1))), '|') tags FROM b",
    "parse_headings": _BODY + f"SELECT path, array_to_string(list_transform(regexp_extract_all(body, '(?m)^(#{{1,6}})\\s+(.+)$', 2), lambda h: regexp_replace({_strip('h')}, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')), '|') headings FROM b",
    "embed_status": f"WITH {NODES_SQL}, {_CHUNKS_SQL}, k AS (SELECT * FROM ch WHERE note IN (SELECT path FROM cn)) SELECT *, embedded_notes > 0 AND coverage_pct >= 80 ready FROM (SELECT *, round(100.0::DOUBLE * embedded_notes / total_notes, 1) coverage_pct FROM (SELECT (SELECT count(*) FROM cn) total_notes, (SELECT count(DISTINCT note) FROM k) embedded_notes, (SELECT count(*) FROM k) chunks))",
    "note_vectors": f"WITH {_CHUNKS_SQL}, x AS (SELECT note, unnest(range(64)) pos, unnest(v) x FROM ch) SELECT note, pos, round(avg(x), 5) + 0.0::DOUBLE x FROM x GROUP BY 1, 2",
    "semantic_search": f"""WITH {NODES_SQL}, {_CHUNKS_SQL}, q AS (SELECT arg_min(v, key) q FROM ch), d AS (SELECT key, note, list_distance(v, q) d FROM ch, q ORDER BY d, key LIMIT 30), b AS (SELECT note, min(d) d FROM d GROUP BY note ORDER BY 2, 1 LIMIT 10)
SELECT note path, coalesce(title, note) title, round(d, 4) distance, CASE WHEN d < 0.3 THEN 'strong' WHEN d < 0.5 THEN 'moderate' ELSE 'weak' END "match" FROM b LEFT JOIN cn ON path = note""",
    "snapshot_diff": f"WITH {NODES_SQL}, {NOTES_SQL} SELECT coalesce(cn.path, pn.path) path, CASE WHEN cn.path IS NULL THEN 'added' WHEN pn.path IS NULL THEN 'deleted' WHEN cn.content_hash IS NOT DISTINCT FROM pn.content_hash THEN 'unchanged' ELSE 'updated' END status FROM cn FULL JOIN pn ON cn.path = pn.path",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) started, count(*) events, array_to_string(list_sort(list_distinct(list(event_type))), '|') paths FROM s GROUP BY user_id, k""",
}
SQL["update_counts"] = f"WITH d AS ({SQL['snapshot_diff'].replace('WITH', 'WITH', 1)}) SELECT count(*) FILTER (status = 'added') added, count(*) FILTER (status = 'updated') updated, count(*) FILTER (status = 'deleted') deleted, count(*) FILTER (status = 'unchanged') unchanged FROM d"
SQL["shortest_path_hops"] = f"""WITH RECURSIVE {GRAPH_SQL}, goal AS (SELECT min(path) n FROM cn WHERE lower(title) = lower('{OTHER}')),
w AS (SELECT n, 0 d FROM seed UNION SELECT b, d + 1 FROM w JOIN u ON u.a = w.n WHERE d < 6) SELECT min(d) hops FROM w WHERE n = (SELECT n FROM goal) HAVING count(*) > 0"""
SQL["semantic_edges"] = f"""WITH {NODES_SQL}, {_CHUNKS_SQL}, x AS (SELECT note, unnest(range(64)) pos, unnest(v) x FROM ch WHERE note IN (SELECT path FROM cn)), y AS (SELECT note, pos, avg(x) x FROM x GROUP BY 1, 2), z AS (SELECT note, list(x ORDER BY pos) v FROM y GROUP BY 1),
p AS (SELECT a.note a, b.note b, 0.8::DOUBLE * list_cosine_similarity(a.v, b.v) w FROM z a JOIN z b ON a.note < b.note WHERE list_cosine_similarity(a.v, b.v) >= 0.6::DOUBLE),
dd AS (SELECT a n, b m, w FROM p UNION ALL SELECT b, a, w FROM p), rr AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY round(w, 9) DESC, m) r FROM dd), kk AS (SELECT DISTINCT least(n, m) a, greatest(n, m) b, w FROM rr WHERE r <= 10)
SELECT a src, b dst, round(w, 6) weight FROM kk UNION ALL SELECT b, a, round(w, 6) FROM kk"""
