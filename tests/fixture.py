"""The demo vault of FIXTURES.md as rows: path, title, type, tags, aliases, related_to, wikilinks, embeds, updated."""

W = "wiki concept "
ROWS = [
    ("broken_links.md", "Broken Links Note", "note", "test", "", "", "Nonexistent Note A|Ghost Page|Snowflake", "", ""),
    ("concepts/Career Positioning.md", None, "concept", W + "career job-search", "", "", "Expertise Reversal Effect", "", ""),
    ("concepts/Data Quality.md", None, "concept", W + "data-engineering", "", "Medallion Architecture", "", "", ""),
    ("concepts/Databricks.md", None, "concept", W + "data-engineering spark lakehouse", "", "Medallion Architecture|Snowflake", "Snowflake|Medallion Architecture", "", "2026-04-25"),
    ("concepts/Expertise Reversal Effect.md", None, "concept", W + "cognitive-psychology career interviewing", "", "Career Positioning", "Career Positioning", "", ""),
    ("concepts/Medallion Architecture.md", None, "concept", W + "data-engineering snowflake architecture", "", "Snowflake|Databricks|Meridian Partners", "Fidelity|Schwab|Data Quality|Snowflake Streams and Tasks", "", "2026-04-28"),
    ("concepts/Snowflake Streams and Tasks.md", None, "concept", W + "snowflake cdc", "", "Snowflake|Medallion Architecture", "Snowflake|Medallion Architecture", "", ""),
    ("concepts/Snowflake.md", None, "concept", W + "data-engineering snowflake cloud data-warehouse", "Snowflake Data Cloud", "Medallion Architecture|Databricks", "Meridian Partners|Snowflake Streams and Tasks", "", "2026-04-27"),
    ("daily/2026-04-29.md", None, "note", "daily", "", "", "Medallion Architecture|Meridian Partners", "", ""),
    ("embed_note.md", "Embed Note", "note", "test", "", "", "Databricks", "Snowflake", ""),
    ("entities/Fidelity.md", None, "entity", "wiki entity finance", "", "", "Meridian Partners", "", ""),
    ("entities/Meridian Partners.md", None, "entity", "wiki entity snowflake", "", "Medallion Architecture|Snowflake|Nexus Consulting|Fidelity", "Medallion Architecture|Fidelity|Schwab|Orion Advisor Services", "", "2026-04-28"),
    ("entities/Plative.md", "Nexus Consulting", "entity", "wiki entity", "", "", "Meridian Partners", "", ""),
    ("entities/Schwab.md", None, "entity", "wiki entity finance", "", "", "Meridian Partners", "", ""),
    ("no_frontmatter.md", "Plain Markdown Note", "note", "data-engineering", "", "", "Snowflake", "", ""),
    ("orphan_note.md", "Orphan Note", "note", "misc", "", "", "", "", ""),
    ("string_tags.md", "String Tags Note", "note", "career", "", "", "Career Positioning", "", ""),
    ("wikilink_alias.md", "Wikilink Alias Note", "note", "test", "", "", "Snowflake|Medallion Architecture|Databricks", "", ""),
]
SCHEMA = "path string, title string, type string, tags array<string>, aliases array<string>, related_to array<string>, wikilinks array<string>, embeds array<string>, updated string, headings array<string>, word_count int"


def notes(spark):
    parts = lambda s, sep="|": [x for x in s.split(sep) if x]
    rows = [(p, t or p.rsplit("/", 1)[-1].removesuffix(".md"), k, parts(g, " "), parts(a), parts(r), parts(w), parts(e), u, [], 300) for p, t, k, g, a, r, w, e, u in ROWS]
    return spark.createDataFrame(rows, SCHEMA)
