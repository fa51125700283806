"""Queries of the problems on text and vectors, over whole tables."""

from __future__ import annotations

import unicodedata as ud

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import knn, leaks, lookalike, markup, mixing, setjoin, splitting
from lattica.session import materialize


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(_table(spark, d, "parsed_notes", "note_id", "body"), "note_id", "body")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Notes that had to be split, and those that no natural boundary helps somewhere."""
    kinds = F.filter(
        F.array(F.when(F.size("pieces") > 1, "split"), F.when(F.exists("pieces", lambda p: p["cut"] == "hard"), "hard")), lambda k: k.isNotNull()
    )
    return _pieces(spark, d).where("size(pieces) > 1").select("note_id", F.explode(kinds).alias("kind")).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every note, with its place in code points."""
    pieces = splitting.piece_texts(_table(spark, d, "parsed_notes", "note_id", "body"), "note_id", "body")
    return pieces.withColumnRenamed("end", "stop").dropDuplicates(["note_id", "piece", "start", "stop"])


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What every note's pieces give when put together again, and whether they keep limit and overlap."""
    pieces = splitting.split_texts(_table(spark, d, "parsed_notes", "note_id", "body"), "note_id", "body", with_content=True)
    return splitting.put_together(pieces, "note_id").select("note_id", F.md5("rebuilt").alias("rebuilt"), "fits", "overlapping").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Headings, list entries, code blocks and formulas of every note."""
    rows = markup.structure(_table(spark, d, "parsed_notes", "note_id", "body"), "note_id", "body")
    return rows.select("note_id", F.explode("elements").alias("e")).select("note_id", "e.kind", "e.content").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every note, with its headings, entries, code blocks and formulas still shown."""
    return markup.structure(_table(spark, d, "parsed_notes", "note_id", "body"), "note_id", "body", with_text=True).select("note_id", "clean").distinct()


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headings and code blocks of every note."""
    return p3_found(spark, d).where("kind in ('heading', 'code')")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of paths of which one is among the 5 nearest usable paths of the other."""
    near = knn.nearest_vectors(_table(spark, d, "vec_embeddings", "path", "embedding"), "path", "embedding", k=5, dim=64)
    return near.select(F.least("path", "neighbour").alias("path_a"), F.greatest("path", "neighbour").alias("path_b")).distinct()


def _current_tags(spark: SparkSession, d: str) -> DataFrame:
    runs = _table(spark, d, "sync_runs", "run_id", "status").where("status = 'success'").select("run_id").distinct()
    nodes = _table(spark, d, "nodes", "path", "run_id", "saved_at", "tags").where("path is not null").join(runs, "run_id", "left_semi")
    latest = nodes.groupBy("path").agg(F.max_by("tags", F.struct("run_id", "saved_at")).alias("tags"))
    return latest.select("path", setjoin.normalize_set(F.col("tags")).alias("tags"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of notes with at least 3 tags each whose tag sets overlap by 0.7 or more."""
    pairs = setjoin.similar_records(_current_tags(spark, d), "path", "tags", threshold=0.7, min_size=3)
    return pairs.select(F.col("key_a").alias("path_a"), F.col("key_b").alias("path_b")).distinct()


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """Each note with at least 3 tags: its class of equal tag sets, and to how many other sets that one is similar."""
    return setjoin.record_links(_current_tags(spark, d), "path", "tags", threshold=0.7, min_size=3)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document with each evaluation item of which it holds 20 consecutive words."""
    return leaks.find_leaks(_table(spark, d, "documents", "doc_id", "text"), _table(spark, d, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that needed unifying, and why."""
    docs = _table(spark, d, "documents", "doc_id", "text")
    return lookalike.unify_texts(docs, with_text=False).select("doc_id", F.explode("kinds").alias("kind")).distinct()


def p10_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in one consistent form."""
    docs = _table(spark, d, "documents", "doc_id", "text")
    return lookalike.unify_texts(docs).select("doc_id", "text", F.array_join("kinds", ",").alias("kinds"))


def _mix(spark: SparkSession, d: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan and sized texts; the texts are written once, as both need them."""
    docs = _table(spark, d, "documents", "doc_id", "source", "text")
    supply = materialize(mixing.text_supply(docs, "doc_id", "source", "text"), "supply")
    targets = mixing.mix_targets(_table(spark, d, "mix_targets", "mix_name", "source", "target_share", "max_repeats"))
    return mixing.plan_mix(supply, targets, total), supply


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen texts of each mix with their repeats and training positions."""
    plan, supply = _mix(spark, d)
    return mixing.mix_texts(supply, plan).withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    plan, supply = _mix(spark, d)
    return mixing.mix_shares(plan, mixing.mix_texts(supply, plan))


def p9_total(spark: SparkSession, d: str) -> DataFrame:
    """Shares where each mix is to have two million tokens, so that small sources are repeated up to their caps."""
    plan, supply = _mix(spark, d, 2_000_000)
    return mixing.mix_shares(plan, mixing.mix_texts(supply, plan))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each source in each mix: caps kept, demand reached, no text repeated before the others."""
    plan, supply = _mix(spark, d)
    return mixing.mix_checks(plan, mixing.mix_texts(supply, plan)).withColumn("target_share", F.round("target_share", 6))


def _one_form(text: str) -> str:
    """SQL for the words of ``text`` in one form: lower case, no invisible characters, styled letters and look-alikes as plain ones."""
    styled = [c for c in map(chr, [*range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)]) if len(ud.normalize("NFKC", c)) == 1 and ud.normalize("NFKC", c) != c]
    plain = f"translate({text}, '{''.join(styled)}', '{''.join(ud.normalize('NFKC', c) for c in styled)}')"
    for c in map(chr, range(0xFB00, 0xFB07)):
        plain = f"replace({plain}, '{c}', '{ud.normalize('NFKC', c)}')"
    twins = {c.lower(): x.lower() for table in lookalike.LOOKALIKES.values() for c, x in table.items()}
    bare = f"translate(lower(nfc_normalize(regexp_replace({plain}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'))), '{''.join(twins)}', '{''.join(twins.values())}')"
    return f"regexp_extract_all(replace(nfc_normalize({bare}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


_CODE_RE = r"(?:^(?:````[^\n]*\n.*?^````|```[^\n]*\n.*?^```|~~~[^\n]*\n.*?^~~~)[ \t]*$|<pre\b[^>]*>.*?</pre>|<syntaxhighlight\b[^>]*>.*?</syntaxhighlight>|\\begin\{(?:verbatim|lstlisting)\}.*?\\end\{(?:verbatim|lstlisting)\})"
_TEX_MARK = r"\\(?:textbf|textit|texttt|emph|underline)\{([^{}]*)\}"


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return x


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&#x27;|&apos;", "''"), ("&eacute;", "é"), ("&mdash;", "—"), ("&ndash;|&#8211;", "–"), ("&nbsp;", " "), ("&uuml;", "ü"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&amp;", "&"))
_HEADING_SQL = _replaced(
    "h", (r"(?s)<!--.*?-->", ""), (r"!?\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1"), (r"!?\[\[([^\[\]|]*)\]\]", r"\1"), (r"\[([^\[\]]*)\]\([^()]*\)", r"\1"), (_TEX_MARK, r"\1"), (r"'{2,5}", ""), (r"</?[A-Za-z][^<>]*>", ""),
    (r"\*\*|~~|==|`", ""), (r"(^|[^\pL\pN*])\*([^*]+)\*", r"\1\2"), (r"(^|[^\pL\pN_])__?([^_]+)__?", r"\1\2"), *_ENTITIES, (r"\s+", " "),
)

QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_blocks": p3_blocks, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_total": p9_total, "p9_checks": p9_checks, "p5_found": p5_found, "p7_found": p7_found, "p7_links": p7_links, "p8_found": p8_found, "p10_found": p10_found, "p10_unified": p10_unified}

SQL = {
    "p5_found": """
WITH u AS (SELECT path, min(embedding::DOUBLE[]) v FROM vec_embeddings WHERE path IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY path),
     r AS (SELECT a.path p, b.path q, row_number() OVER (PARTITION BY a.path ORDER BY list_distance(a.v, b.v), b.path) k FROM u a JOIN u b ON a.path <> b.path)
SELECT DISTINCT least(p, q) path_a, greatest(p, q) path_b FROM r WHERE k <= 5""",
    "p10_found": """
WITH t AS (SELECT doc_id, text, regexp_replace(text, '([\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}]\\x{FE0F}?)\\x{200D}', '\\1', 'g') x FROM documents WHERE text IS NOT NULL),
     k AS (SELECT doc_id, list_filter([
       CASE WHEN regexp_matches(text, '[\\x{FF10}-\\x{FF19}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}\\x{FB00}-\\x{FB06}\\x{1D400}-\\x{1D7FF}]') THEN 'form' END,
       CASE WHEN len(list_filter(regexp_extract_all(text, '\\p{L}\\p{M}+'), lambda m: length(nfc_normalize(m)) < length(m))) > 0 THEN 'combining' END,
       CASE WHEN regexp_matches(x, '[\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]') THEN 'invisible' END,
       CASE WHEN regexp_matches(text, '[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]') THEN 'space' END,
       CASE WHEN regexp_matches(regexp_replace(x, '[\\x{AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g'), '\\p{Latin}\\p{N}*[\\p{Cyrillic}\\p{Greek}]|[\\p{Cyrillic}\\p{Greek}]\\p{N}*\\p{Latin}') THEN 'lookalike' END
     ], lambda y: y IS NOT NULL) kinds FROM t)
SELECT DISTINCT doc_id, unnest(kinds) kind FROM k""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_one_form('text')} w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_one_form('text')} w FROM eval_items WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, array_to_string(w[j : j + 19], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) j FROM d)),
     ig AS (SELECT item_id, array_to_string(w[j : j + 19], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) j FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g""",
    "p3_blocks": rf"""
WITH b AS (SELECT DISTINCT note_id, body FROM parsed_notes WHERE body IS NOT NULL),
     c AS (SELECT note_id, unnest(regexp_extract_all(body, '(?ms){_CODE_RE}')) x FROM b),
     d AS (SELECT note_id, CASE WHEN starts_with(x, '<pre') THEN {_replaced("regexp_replace(x, '</?(pre|code)[^>]*>', '', 'g')", *_ENTITIES)} WHEN starts_with(x, '<syn') THEN regexp_replace(x, '</?syntaxhighlight[^>]*>', '', 'g')
                  WHEN starts_with(x, '\') THEN regexp_replace(x, '^\\begin.[a-z]+.|\\end.[a-z]+.$', '', 'g') ELSE regexp_replace(x, '^[`~]+[^\n]*|[`~]+[ \t]*$', '', 'g') END x FROM c),
     p AS (SELECT note_id, regexp_replace(body, '(?ms){_CODE_RE}', '', 'g') t FROM b),
     h AS (SELECT note_id, unnest(list_concat(regexp_extract_all(t, '(?m)^#{{1,6}}[ \t]+(.+?)[ \t]*(?: #+)?[ \t]*$', 1), regexp_extract_all(t, '(?m)(?:^|\n)[ \t]*\n([^\n<|{{\\#=*+-][^\n]*|[*_][^\n]*)\n[-=]{{3,}}[ \t]*$', 1), regexp_extract_all(t, '(?m)^={{2,6}}([^=\n].*?)={{2,6}}[ \t]*$', 1),
                  regexp_extract_all(t, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1), regexp_extract_all(t, '\\(?:(?:sub)*section|chapter|paragraph)\*?\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1))) h FROM p)
SELECT DISTINCT note_id, kind, content FROM (SELECT note_id, 'code' kind, trim(regexp_replace(x, '\s+', ' ', 'g')) content FROM d UNION ALL SELECT note_id, 'heading', trim({_HEADING_SQL}) FROM h) WHERE content <> ''""",
    "p9_checks": """
WITH o AS (SELECT mix_name, regexp_replace(lower(trim(source)), '[\\s_]+', '-', 'g') source, sum(greatest(coalesce(s, 0), 0)) s FROM (SELECT DISTINCT mix_name, source, target_share s, max_repeats FROM mix_targets) WHERE mix_name IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
SELECT mix_name, source, round(s / CASE WHEN sum(s) OVER (PARTITION BY mix_name) > 1.5 THEN 100.0 ELSE 1.0 END, 6) target_share, true capped, true reached, true repeated FROM o""",
    "p2_rebuilt": "SELECT DISTINCT note_id, md5(body) rebuilt, true fits, true overlapping FROM parsed_notes WHERE body IS NOT NULL",
    "p2_found": """
SELECT DISTINCT note_id, 'split' kind FROM parsed_notes WHERE length(body) > 1600
UNION SELECT note_id, 'hard' FROM (SELECT note_id, unnest(regexp_split_to_array(body, '[\\s.!?;,。！？；，、]')) run FROM parsed_notes) WHERE length(run) > 1600""",
    "p7_found": """
WITH cur AS (SELECT path, tags FROM nodes WHERE path IS NOT NULL AND run_id IN (SELECT run_id FROM sync_runs WHERE status = 'success')
             QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC, saved_at DESC) = 1),
     t AS (SELECT DISTINCT path, regexp_replace(regexp_replace(lower(x), '^[\\s#]+', ''), '\\s+$', '') k FROM (SELECT path, unnest(tags) x FROM cur) WHERE x IS NOT NULL),
     s AS (SELECT path, count(*) n FROM t WHERE k <> '' GROUP BY 1 HAVING count(*) >= 3),
     b AS (SELECT t.path, k, n FROM t JOIN s ON s.path = t.path WHERE k <> '')
SELECT x.path path_a, y.path path_b FROM b x JOIN b y ON x.k = y.k AND x.path < y.path
GROUP BY x.path, y.path, x.n, y.n HAVING count(*) >= 0.7 * (x.n + y.n - count(*))""",
}
_TAG_SETS = SQL["p7_found"].split("SELECT x.path path_a")[0]
SQL["p7_links"] = _TAG_SETS + """, c AS (SELECT path, string_agg(k, '|' ORDER BY k) g FROM b GROUP BY path), g AS (SELECT g, min(path) class_key, count(*) copies FROM c GROUP BY g),
     m AS (SELECT class_key, k, n FROM g JOIN b ON b.path = class_key),
     l AS (SELECT x.class_key a, y.class_key o FROM m x JOIN m y ON x.k = y.k AND x.class_key <> y.class_key GROUP BY 1, 2, x.n, y.n HAVING count(*) >= 0.7 * (x.n + y.n - count(*)))
SELECT c.path, g.class_key, copies, (SELECT count(*) FROM l WHERE l.a = g.class_key) links FROM c JOIN g ON c.g = g.g"""
