"""Scalar expressions on paths, texts and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)


def folder(path: Column) -> Column:
    """Parent folder; '.' at the root."""
    parent = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(parent == "", F.lit(".")).otherwise(parent)


def word_count(body: Column) -> Column:
    return F.size(F.filter(F.split(body, r"(?U)\s+"), lambda x: x != "")).cast("int")


def content_hash(content: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of raw bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def token_estimate(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(words, F.lit(0)) / 0.75).cast("int"))


def match_band(distance: Column) -> Column:
    return F.when(distance < 0.3, "strong").when(distance < 0.5, "moderate").otherwise("weak")


def note_path(key: Column) -> Column:
    """Note of a chunk key ``note::n``."""
    return F.split_part(key, F.lit("::"), F.lit(1))


def chunk_text(text: Column, size: int = 1600, overlap: int = 200) -> Column:
    """Overlapping slices of fixed size; a short text, the empty one included, is one slice."""
    step = size - overlap
    last = F.greatest(F.ceil((F.char_length(text) - overlap) / float(step)), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def iso_date(text: Column) -> Column:
    """Strict yyyy-MM-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
