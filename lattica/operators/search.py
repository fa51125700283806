"""Keyword search over titles, tags, headings and, on request, bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_context(title: Column, tags: Column, headings: Column, terms: list[str]) -> Column:
    hit = lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(t) for t in terms])
    part = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))
    none = F.array().cast("array<string>")
    return F.concat_ws(" | ", F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("title: "), title)), part("tags", F.filter(F.coalesce(tags, none), hit)), part("headings", F.slice(F.filter(F.coalesce(headings, none), hit), 1, 3)))


def body_snippet(body: Column, terms: list[str]) -> Column:
    """Text around the first term that occurs: 40 characters before it, 60 after."""
    low = F.lower(body)

    def around(t: str) -> Column:
        at = F.instr(low, t)
        start = F.greatest(at - 40, F.lit(1))
        cut = F.substring(body, start, at - start + len(t) + 60)
        return F.when(at > 0, F.concat(F.lit("..."), F.trim(F.regexp_replace(cut, "\n", " ")), F.lit("...")))

    return F.coalesce(*[around(t) for t in terms], F.lit(""))


def keyword_search(nodes: DataFrame, query: str, limit: int | None = 20, bodies: DataFrame | None = None) -> DataFrame:
    """(path, title, score, fields, context), best first, ties by path.

    Each term found in the title adds 3, in the tags 2, in the headings 1.5; with ``bodies(path, body)`` each occurrence
    in the body adds 0.5, at most 2 a term. A query without terms gives no rows.
    """
    terms = [t.lower() for t in query.split()]
    none = F.array().cast("array<string>")
    if not terms:
        terms, nodes = [""], nodes.where("false")
    joined = {"title": F.lower(F.coalesce("title", F.lit(""))), "tags": F.lower(F.array_join(F.coalesce("tags", none), " ")), "headings": F.lower(F.array_join(F.coalesce("headings", none), " "))}
    weight = {"title": 3.0, "tags": 2.0, "headings": 1.5}
    rows = nodes.select("path", "title", "tags", "headings", *([] if bodies is None else ["_b"])) if bodies is None else nodes.select("path", "title", "tags", "headings").join(bodies.select("path", F.col("body").alias("_b")), "path", "left")
    score = reduce(lambda a, b: a + b, [F.when(joined[f].contains(t), w).otherwise(0.0) for f, w in weight.items() for t in terms])
    fields = [F.when(reduce(lambda a, b: a | b, [joined[f].contains(t) for t in terms]), f) for f in weight]
    context = match_context(F.col("title"), F.col("tags"), F.col("headings"), terms)
    if bodies is not None:
        low = F.lower(F.coalesce("_b", F.lit("")))
        count = lambda t: (F.char_length(low) - F.char_length(F.replace(low, F.lit(t), F.lit("")))) / len(t)
        in_body = reduce(lambda a, b: a + b, [F.least(count(t) * 0.5, F.lit(2.0)) for t in terms])
        context = F.when(score > 0, context).otherwise(body_snippet(F.coalesce("_b", F.lit("")), terms))
        fields.append(F.when(in_body > 0, "body"))
        score = score + in_body
    found = rows.select("path", F.coalesce("title", "path").alias("title"), score.alias("score"), F.filter(F.array(*fields), lambda x: x.isNotNull()).alias("fields"), context.alias("context")).where("score > 0")
    return found.orderBy(F.col("score").desc(), "path").limit(limit) if limit else found
