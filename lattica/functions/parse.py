"""Markdown notes to columns: front matter, title, headings, links, embeds, tags."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.config import Config
from lattica.functions.text import content_hash, stem, strip, word_count

# What marks a link target as code, file or placeholder rather than a note.
JUNK_PARTS = ("'", "dv.", "javascript:", "<", ">", "$", "string(", "!= ", "= \"${", ".pdf", ".docx", ".json", ".bak", ".dump", ".js", ".base")
JUNK_STARTS = ('"', "-z ")
CODE_PARTS = (" for ", " in ", "if ", "else ", "lambda ", "def ", "import ", "return ", "yield ", "class ", "print(", "len(", "range(")
OPERATORS = ("= ", "==", "!=", ">=", "<=")
PLACEHOLDER_TARGETS = (
    "Other Page", "Another Page", "Source Note", "Entity Name", "Other Entity", "Concept Name", "Prerequisite Concept", "Downstream Concept", "Synthesis Title",
    "Parent Entity", "Child Item", "Note Name", "Nonexistent Note", "Page Name", "Alternative Approach", "Source 2", "Note-Name", "Another-Note", "Related-Note-1",
    "Related-Note-2", "Wikilinks", "wikilinks", "double bracket", "redirects", "attachments", "templates", "Concept A", "Concept B", "Concept A vs Concept B",
    "Related Concept", "Source A", "Source Name", "Does Scale Improve Reasoning?", "Timeline", "What Went Well", "What actually went wrong",
    'Option 1: Add as a Separate "Detailed Activity Log" Section', 'Scenario A: If "OpenClaw" is your Software/Coding Project',
)


def links(body: Column) -> Column:
    """Raw wikilink targets of a body, code removed, embeds not counted."""
    no_code = F.regexp_replace(F.regexp_replace(body, r"```[\s\S]*?```", ""), r"`[^`\n]+`", "")
    return F.transform(F.regexp_extract_all(no_code, F.lit(r"(?<!!)(?<!\[)\[\[([^\]\n]+)\]\]"), 1), link_target)


def link_target(link: Column) -> Column:
    """A link without display text, heading or block."""
    return strip(F.split_part(strip(F.split_part(link, F.lit("|"), F.lit(1))), F.lit("#"), F.lit(1)))


def embeds(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(r"!\[\[([^\]]+)\]\]"), 1), link_target)


def is_junk(target: Column) -> Column:
    parts = [target.contains(p) for p in (*JUNK_PARTS, *CODE_PARTS, *OPERATORS)] + [target.startswith(p) for p in JUNK_STARTS]
    return reduce(lambda a, b: a | b, parts) | target.rlike(r"(?U)\w+\(") | target.isin(*PLACEHOLDER_TARGETS)


def wikilinks(body: Column) -> Column:
    """Targets in order, repeats kept, without targets that are also embedded and without junk."""
    embedded = embeds(body)
    return F.filter(links(body), lambda x: ~F.array_contains(embedded, x) & ~is_junk(x))


def headings(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"(?Umd)^(#{1,6})\s+(.+)$"), 2)
    return F.transform(found, lambda h: F.regexp_replace(strip(h), r"\[\[([^\]]+)\]\]", "$1"))


def title(found: Column, path: Column) -> Column:
    return strip(F.split_part(F.coalesce(F.get(found, F.lit(0)), stem(path)), F.lit("|"), F.lit(1)))


def inline_tags(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?Um)(?:^|\s)#([a-zA-Z][\w/-]*)"), 1)


def _plain(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False)


_FRONT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType())])


@F.pandas_udf(_FRONT)
def front_matter(text: pd.Series) -> pd.DataFrame:
    """Front matter as a map of strings (lists and maps as JSON) and the rest; text whose YAML is bad stays whole."""
    import yaml

    rows = []
    for t in text:
        m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\r?\n)---[ \t]*(?:\r?\n|$)", t or "", re.S | re.M)
        if not m:
            rows.append((True, {}, (t or "").strip()))
            continue
        try:
            data = yaml.safe_load(m.group(1)) or {}
            if not isinstance(data, dict):
                raise yaml.YAMLError("front matter is no mapping")
            rows.append((True, {str(k): "None" if v is None else _plain(v if isinstance(v, (list, dict, str)) else str(v)) for k, v in data.items()}, t[m.end() :].strip()))
        except (yaml.YAMLError, ValueError):
            rows.append((False, {}, t))
    return pd.DataFrame(rows, columns=["ok", "fields", "body"])


def _listed(fields: Column, name: str | bool) -> Column:
    """A field as an array of strings: a JSON list, or one string."""
    if not isinstance(name, str):
        return F.array().cast("array<string>")
    value = fields[name]
    many = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(value.isNull() | (value == "None"), F.array().cast("array<string>")).when(value.startswith("["), F.coalesce(many, F.array(value))).otherwise(F.array(value))


def parse_notes(raw: DataFrame, config: Config = Config()) -> DataFrame:
    """``raw(path, content)`` with binary content to one row per note, with the fields of a parsed note.

    Null content gives a stub with a parse error; bad YAML keeps hash and word count, has the stem as title and no
    links or tags. Other columns of ``raw`` are dropped.
    """
    fm = config.frontmatter
    text = F.decode(F.col("content"), "utf-8")
    split = raw.select("path", "content", front_matter(F.coalesce(text, F.lit(""))).alias("f"))
    body, fields, ok = F.col("f.body"), F.col("f.fields"), F.col("f.ok") & F.col("content").isNotNull()
    none = F.array().cast("array<string>")
    field = lambda name, default: F.coalesce(fields[name], F.lit(default)) if isinstance(name, str) else F.lit(default)
    heads = F.when(ok, headings(body)).otherwise(none)
    raw_tags = _listed(fields, fm.tags_field)
    is_list = fields[fm.tags_field].startswith("[") if isinstance(fm.tags_field, str) else F.lit(False)
    own = F.filter(F.transform(F.when(is_list, raw_tags).otherwise(F.flatten(F.transform(raw_tags, lambda t: F.split(t, ",")))), strip), lambda t: t != "")
    related = F.transform(_listed(fields, fm.related_field), lambda x: F.when(x.rlike(r"\[\[[^\]]+\]\]"), link_target(F.regexp_extract(x, r"\[\[([^\]]+)\]\]", 1))).otherwise(strip(x)))
    return split.select(
        "path",
        F.when(ok, title(heads, F.col("path"))).otherwise(stem(F.col("path"))).alias("title"),
        field(fm.type_field, "note").alias("type"), field(fm.subtype_field, "").alias("subtype"), field(fm.status_field, "").alias("status"), field(fm.updated_field, "").alias("updated"),
        F.when(ok, F.array_distinct(F.concat(own, inline_tags(body)))).otherwise(none).alias("tags"),
        heads.alias("headings"),
        F.when(ok, wikilinks(body)).otherwise(none).alias("wikilinks"),
        F.when(ok, embeds(body)).otherwise(none).alias("embeds"),
        F.when(ok, F.filter(related, lambda x: x != "")).otherwise(none).alias("related_to"),
        _listed(fields, fm.aliases_field).alias("aliases"),
        fields.alias("frontmatter"), body.alias("body"), word_count(body).alias("word_count"), content_hash(F.col("content")).alias("content_hash"),
        F.when(F.col("content").isNull(), "unreadable").when(~F.col("f.ok"), "bad front matter").otherwise("").alias("parse_error"),
    )
